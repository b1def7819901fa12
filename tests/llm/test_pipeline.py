import hashlib

import pytest
from pyspark.sql import functions as F
from test_decontaminate import least_edits
from test_host_rules import plain as measures
from test_simhash import plain_groups, plain_print

import corpus_pipeline
from spendframe.llm import bytenet, decontaminate, queries

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def stored(spark, frame, folder, name):
    frame.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=str)


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    """Every stage is checked on what the stage before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "tokens"]
    columns = docs.columns

    kept = stored(spark, stages["quality_rules"](spark, docs, sf_dir), tmp_path, "1")
    good = []
    for row in docs.collect():  # no host of the sample is bad
        words, _, _, _, repeated = measures(row.text)
        if words >= 50 and 100 * repeated <= 50 * words:
            good.append(tuple(row))
    assert kept.columns == columns and rows(kept) == sorted(good, key=str)

    before, kept = kept, stored(spark, stages["quality_classifier"](spark, kept, sf_dir), tmp_path, "2")
    network = queries.quality_network(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = bytenet.predict(before, network).collect()
    assert kept.columns == columns and rows(kept) == sorted((tuple(row)[:-1] for row in scored if row.score >= 0.7), key=str)
    quality = kept.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").groupBy("quality").count().collect()
    assert {row.quality: row["count"] for row in quality}[1] > 0

    before, kept = kept.orderBy("doc_id").collect(), stored(spark, stages["near_duplicates"](spark, kept, sf_dir), tmp_path, "3")
    groups = plain_groups([plain_print(row.text) for row in before], 2)
    assert kept.columns == columns and rows(kept) == sorted((tuple(row) for i, row in enumerate(before) if groups[i] == i), key=str)

    before, kept = kept.collect(), stored(spark, stages["decontamination"](spark, kept, sf_dir), tmp_path, "4")
    items = [(row.item_id, decontaminate.normalise(row.text)) for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = {row.doc_id for row in before} - {row.doc_id for row in kept.collect()}
    for row in before:
        text = decontaminate.normalise(row.text)
        if any(item in text for _, item in items):
            assert row.doc_id in gone
        elif row.doc_id in gone:
            assert any(least_edits(w.text, text) <= w.budget for w in decontaminate.Index(items).windows)
    assert kept.columns == columns

    last = stages["tokens"](spark, kept, sf_dir).collect()
    truth = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {row.doc_id: row.text for row in kept.collect()}
    assert sorted(row.doc_id for row in last) == sorted(texts)
    for row in last:
        ids = truth.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert bytes(row.ids) == b"".join(number.to_bytes(4, "little") for number in ids) and row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    assert rows(corpus_pipeline.run(spark, sf_dir)) == sorted((tuple(row) for row in last), key=str)


def test_odd_rows_pass_every_stage(spark, sf_dir, tmp_path):
    words = " ".join(f"word{i}" for i in range(70))
    data = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, None, None, None, None), (None, words.upper(), None, None, None), (None, "", "en", "a", 0)]
    docs = spark.createDataFrame([(*row, "x", 5) for row in data], "doc_id long, text string, lang string, source string, n_chars long, leaks string, n_words int")
    for frame in (docs, docs.limit(0)):
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stored(spark, stage(spark, frame, sf_dir), tmp_path, f"{number}-{frame is docs}-{name}")
            if number < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            assert out.count() <= len(data)
        cleared = corpus_pipeline.near_duplicates(spark, frame, sf_dir)
        assert sorted(row.doc_id or 0 for row in cleared.collect()) == ([1, 2] if frame is docs else [])
    assert docs.where(F.col("doc_id") == 1).count() == 2


def test_tokens_encode_each_text_once(spark, sf_dir):
    """In one plan the encoder would run again inside the decoder, and batches would hold texts, ids and decoded texts."""
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    coded = corpus_pipeline.tokens(spark, docs, sf_dir)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("run(") == 1 and "run(ids" in plan
    assert sorted((row.doc_id, row.n_tokens, len(row.ids)) for row in coded.collect())[1] == (2, 0, 0)
