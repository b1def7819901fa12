import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spendframe.llm import maxent, queries


def plain(docs, learns):
    """Per document (n_tokens, n_known, base score), and N, by definition. docs: (id, text)."""
    split = [re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None] for _, text in docs]
    counts = collections.Counter(word for words, learn in zip(split, learns) if learn for word in words)
    total, kinds = sum(counts.values()), len(counts)
    rows = [(len(words), sum(counts[word] > 0 for word in words), sum(math.log10((counts[word] + 0.5) / (total + 0.5 * (kinds + 1))) for word in words)) for words in split]
    return rows, total


def block_of(texts, learn=True):
    builder = maxent._BlockBuilder()
    for number, text in enumerate(texts):
        builder.add(number, learn, text.encode())
    return builder.row(0, pa.int64()).to_pylist()[0]


def sentences(count, seed):
    draw = random.Random(seed)
    groups = [[f"{a}{b}" for b in "xyzuvw"] for a in ("the", "der", "le")]
    return [" ".join(draw.choices(group, weights=[32, 16, 8, 4, 2, 1], k=draw.randint(0, 40))) for group in draw.choices(groups, k=count)]


def vocabulary_of(block):
    hashes = np.frombuffer(block["hashes"], np.int64)
    counts = np.frombuffer(block["counts"], np.uint32).astype(np.int64)
    suffixes = np.frombuffer(block["suffixes"], np.uint8)
    words = [k for k in np.argsort(-counts, kind="stable") if hashes[k] != maxent.END]
    top = hashes[words[:3]]
    rest = np.isin(hashes, top, invert=True) & (hashes != maxent.END)
    place = 1 + maxent.TOP_WORDS + suffixes[rest].astype(int)
    return maxent.Vocabulary(int(counts.sum()), len(counts), top, np.bincount(place, counts[rest], maxent.CLASSES), np.bincount(place, minlength=maxent.CLASSES)), counts


def test_probabilities_of_all_words_sum_to_one():
    block = block_of(sentences(50, 1))
    vocabulary, counts = vocabulary_of(block)
    weights = np.random.default_rng(1).standard_normal((1 << maxent.BUCKET_BITS, maxent.CLASSES)).astype(np.float32)
    hashes, suffixes = np.frombuffer(block["hashes"], np.int64), np.frombuffer(block["suffixes"], np.uint8)
    classes = vocabulary.classes(hashes, suffixes)
    share = 10.0 ** vocabulary.inside(classes, counts)
    unseen = 0.5 / (vocabulary.class_tokens + 0.5 * (vocabulary.class_kinds + 1))
    for number in range(maxent.TOP_WORDS + 1, maxent.CLASSES):  # the words of a class, and its share for words never seen
        assert share[classes == number].sum() + unseen[number] == pytest.approx(1)
    rows = maxent.feature_rows(hashes.view(np.uint64), np.zeros(len(hashes), int))
    logits, total = maxent.class_log_odds(weights, rows)
    assert np.allclose(np.exp(logits - total[:, None]).sum(axis=1), 1, atol=1e-4)


def test_histories_stay_inside_their_text_and_batches_change_nothing(monkeypatch):
    texts = sentences(60, 2)
    block = block_of(texts)
    vocabulary, counts = vocabulary_of(block)
    weights = np.random.default_rng(2).standard_normal((1 << maxent.BUCKET_BITS, maxent.CLASSES)).astype(np.float32)
    whole = maxent.score_block(weights, vocabulary, block, counts)["score"]
    monkeypatch.setattr(maxent, "BATCH", 7)
    assert np.allclose(maxent.score_block(weights, vocabulary, block, counts)["score"], whole, rtol=1e-5)
    known = dict(zip(np.frombuffer(block["hashes"], np.int64).tolist(), counts.tolist()))
    for number in range(0, 60, 7):
        single = block_of([texts[number]])
        own = np.array([known[h] for h in np.frombuffer(single["hashes"], np.int64).tolist()])
        assert maxent.score_block(weights, vocabulary, single, own)["score"][0] == pytest.approx(whole[number], rel=1e-5)


def test_training_learns_from_history():
    block = block_of(sentences(900, 3))
    vocabulary, counts = vocabulary_of(block)
    weights = np.zeros((1 << maxent.BUCKET_BITS, maxent.CLASSES), np.float32)
    for turn in range(maxent.ROUNDS):
        maxent.train_block(weights, np.ones(len(weights), np.float32), np.zeros_like(weights), np.zeros(len(weights), np.float32), block, vocabulary, turn)
    fresh = block_of(sentences(100, 4))
    known = dict(zip(np.frombuffer(block["hashes"], np.int64).tolist(), counts.tolist()))
    own = np.array([known.get(h, 0) for h in np.frombuffer(fresh["hashes"], np.int64).tolist()])
    found = maxent.score_block(weights, vocabulary, fresh, own)
    assert found["score"].sum() > found["base_score"].sum() * 0.85
    unused = np.zeros_like(weights)
    maxent.train_block(unused, np.ones(len(weights), np.float32), np.zeros_like(weights), np.zeros(len(weights), np.float32), block_of(["a b"], learn=False), vocabulary, 0)
    assert not unused.any()


def test_histories_are_counted_whole_and_tell_words_of_a_class_apart(spark, monkeypatch):
    texts = sentences(300, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learn = F.col("doc_id") % 4 != 1
    monkeypatch.setattr(maxent, "BLOCK_BYTES", 4000)
    stored = maxent.blocks(docs, learn, "doc_id", "text")
    split = [["<", "<", *text.split(), ">"] for text in texts]
    expected = {n: collections.Counter(tuple(words[k - n + 1 : k + 1]) for number, words in enumerate(split) if number % 4 != 1 for k in range(2, len(words))) for n in (2, 3)}
    packed = collections.defaultdict(lambda: {2: {}, 3: {}})
    for row in maxent.gram_counts(stored).collect():
        packed[row.block][row.kind][row.bucket] = row.counts
    assert len(packed) > 5
    for row in stored.collect():
        block = row.asDict()
        found = maxent.token_grams(block, packed[row.block])
        wanted = {n: [expected[n][tuple(split[i][k - n + 1 : k + 1])] for i in block["doc_ids"] for k in range(2, len(split[i]))] for n in (2, 3)}
        assert {n: found[n].tolist() for n in (2, 3)} == wanted
    # Same class by the last two bytes and same counts: only the history tells them apart.
    lines = ["left xab"] * 30 + ["right yab"] * 30 + [f"w{k}" for k in range(20) for _ in range(99)] + ["left xab", "left yab"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    scores = {row.id: row.score for row in maxent.score(docs, F.col("doc_id") < len(lines) - 2).collect()}
    assert scores[len(lines) - 2] > scores[len(lines) - 1] + 1


def test_words_are_counted_with_the_grams(spark, monkeypatch):
    """One shuffle to the hash ranges and back for words, pairs and triples, and no row for each word of each block."""
    texts = sentences(300, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learn = F.col("doc_id") % 4 != 1
    monkeypatch.setattr(maxent, "BLOCK_BYTES", 4000)
    stored = maxent.blocks(docs, learn, "doc_id", "text")
    expected = collections.Counter(word for number, text in enumerate(texts) if number % 4 != 1 for word in [*text.split(), "<end>"])
    found = collections.defaultdict(dict)
    for row in maxent.gram_counts(stored, [1]).collect():
        found[row.block][row.bucket] = row.counts
    assert len(found) > 5
    for row in stored.collect():
        totals = maxent.word_totals(row.asDict(), found[row.block])
        words = list(dict.fromkeys(["<end>", *(word for i in row.doc_ids for word in texts[i].split())]))
        assert totals.tolist() == [expected[word] for word in words]
    assert "SortMergeJoin" not in maxent.score(docs, learn)._jdf.queryExecution().executedPlan().toString()


def test_large_counts_are_packed_whole():
    counts = np.array([0, 1, 1 << 32, (1 << 40) + 5], np.int64)
    assert maxent.unpack(maxent.pack(counts, "<u8"), "<u8").tolist() == counts.tolist()


def test_sums_of_short_and_long_runs():
    draw = np.random.default_rng(3)
    values = draw.normal(size=(50, 4)).astype(np.float32)
    keys = np.sort(np.concatenate([np.repeat(7, 300), draw.integers(0, 60, 120)]))
    places = draw.integers(0, len(values), len(keys))
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    assert np.array_equal(maxent.group_sums(values, places, edges), np.add.reduceat(values[places], edges, axis=0))


def test_probabilities_after_a_history_sum_to_one():
    texts = sentences(200, 6)
    block = block_of(texts)
    vocabulary, counts = vocabulary_of(block)
    tokens, hashes, suffixes, lengths, firsts = maxent._texts(block)
    keys, starts = hashes.view(np.uint64)[tokens], np.repeat(firsts, lengths)
    known = {kind: collections.Counter(maxent.gram_names(keys, starts, kind).tolist()) for kind in (2, 3)}
    at = next(k for k in range(len(tokens)) if k - starts[k] >= 3)
    prior, total = np.full(len(hashes), 0.5 / len(hashes)), 0.0
    for word in range(len(hashes)):
        own = tokens[starts[at] : at + 1].copy()
        own[-1] = word
        zeros = np.zeros(len(own), int)
        grams = {kind: np.array([known[kind][name] for name in maxent.gram_names(hashes.view(np.uint64)[own], zeros, kind).tolist()]) for kind in (2, 3)}
        total += 10.0 ** maxent.with_histories(np.log10(np.full(len(own), prior[word])), own, zeros, counts, grams)[-1]
    before = counts[tokens[at - 1]]
    pair = known[2][int(maxent.gram_names(keys, starts, 2)[at - 1])]
    assert total == pytest.approx(1 - 0.5 * maxent.PRIORS[2] / (before + maxent.PRIORS[2]) * maxent.PRIORS[3] / (pair + maxent.PRIORS[3]))


def test_odd_rows_and_many_blocks(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "A b\x0bB\n"), (3, "A b\x0bB\n"), (None, "é É b"), (5, "b " * 3000), (6, "q")]
    docs = spark.createDataFrame([(*row, "clash", i % 3 < 2) for i, row in enumerate(rows)], "doc_id long, text string, block string, use boolean").coalesce(1)
    expected, total = plain(rows, [i % 3 < 2 for i in range(len(rows))])
    for size in (1 << 20, 6):
        monkeypatch.setattr(maxent, "BLOCK_BYTES", size)
        found = maxent.score(docs, F.col("use")).collect()
        assert {row.train_tokens for row in found} == {total}
        have = sorted(((row.id or 0, row.n_tokens, row.n_known, round(row.base_score, 6)) for row in found))
        assert have == sorted((row[0] or 0, a, b, round(c, 6)) for row, (a, b, c) in zip(rows, expected))
        assert all(row.score <= 0 for row in found)
    assert maxent.score(docs.limit(0), F.col("use")).count() == 0
    assert {row.n_known for row in maxent.score(docs, F.lit(None).cast("boolean")).collect()} == {0}


def test_query_against_definition(spark, sf_dir):
    docs = [(row.doc_id, row.text) for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = [zlib.crc32(str(number).encode()) % 5 == 1 for number, _ in docs]
    expected, total = plain(docs, [not x for x in held])
    rows = {row.doc_id: row for row in queries.QUERIES["op3_maxent"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for (number, _), out, (tokens, known, base) in zip(docs, held, expected):
        row = rows[number]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (out, tokens, known, total)
        assert row.base_score == pytest.approx(base, rel=1e-9)
    unseen = [rows[number] for (number, _), out in zip(docs, held) if out]
    assert sum(row.score for row in unseen) > sum(row.base_score for row in unseen)


def test_blocks_are_not_moved_to_meet_their_counts(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(sentences(200, 7))), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(maxent, "BLOCK_BYTES", 4000)
    scored = maxent.score(docs, F.col("doc_id") % 4 != 1)
    assert scored.count() == 200
    plan = scored._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("Initial Plan")[-1].splitlines() if "Exchange" in line]
    assert len(moved) == 2 and "Bucketed: true" in plan  # the names to the hash ranges, the counts to the blocks
    assert not [row for row in spark.sql("SHOW TABLES").collect() if "maxent" in row.tableName]


def test_names_are_counted_and_found_like_sorted_ones():
    draw = np.random.default_rng(8)
    for size, kinds in ((1, 1), (5000, 3000), (3000, 1)):
        names = draw.choice(draw.integers(0, 1 << 48, kinds, dtype=np.uint64), size)
        if size == 5000:
            names[:40] = np.arange(40)  # names that lie together only take longer
            names[40] = (1 << 48) - 1
        learn = draw.random(size) < 0.7
        distinct, places = np.unique(names, return_inverse=True)
        found, counts = maxent._counted(names, learn)
        assert np.array_equal(found, distinct) and np.array_equal(counts, np.bincount(places[learn], minlength=len(distinct)))
        assert np.array_equal(maxent._places(names), places)


def test_long_and_blank_texts_are_numbered_as_they_stand():
    texts = ["", " \t\x0b", " A\x1cb Éé  x\x00y ", "a " * 700_000, "q" * 1_200_000 + " z " + "\n" * 5, "B b"]
    block = block_of(texts)
    tokens, hashes, _, lengths, _ = maxent._texts(block)
    words = [[*text.lower().encode().split(), b""] if text.isascii() else [b"a\x1cb", "Éé".encode(), b"x\x00y", b""] for text in texts]
    numbers = {b"": 0}
    assert tokens.tolist() == [numbers.setdefault(word, len(numbers)) for own in words for word in own]
    assert lengths.tolist() == [len(own) for own in words] and len(hashes) == len(numbers)
