"""Registered queries of the subpackage: one per operator, with production parameters over whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendframe.llm import archive, bpe, bytenet, decontaminate, divergence, dual_tree, host_rules, langid, licenses, maxent, minhash, samples, simhash, toxicity
from spendframe.llm.common import held_out, remainder, table
from spendframe.session import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Labelled documents that the classifiers learn from, at most, per label (quality, toxicity) or in all (languages).
QUALITY_SAMPLE = 1500
LANGUAGE_SAMPLE = 1000
TOXICITY_SAMPLE = 2000
QUALITY_THRESHOLD = 0.7


def quality_network(docs: DataFrame, labels: DataFrame) -> bytenet.Network:
    """The network learned from labelled rows of `docs` outside the held-out quarter, at the share of label 1 among all of them."""
    allowed = (remainder("doc_id", 4) != 2) & F.col("quality").isin(0, 1)
    share = labels.where(allowed).join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg("quality")).first()[0]
    chosen = samples.pick(labels.join(samples.usable(docs, "doc_id", "text"), "doc_id", "left_semi"), "doc_id", "quality", allowed, QUALITY_SAMPLE)
    return bytenet.fit(samples.collect_texts(docs, chosen, "doc_id", "text", "quality", 2 * QUALITY_SAMPLE), share)


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = F.transform("licenses.spans", lambda span: span["label"])
    return found.select(
        "doc_id",
        "licenses.n_words",
        F.col("licenses.n_phrases").alias("n_base"),
        "licenses.first_word",
        "licenses.last_word",
        F.array_join("licenses.phrase_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("licenses.phrase_labels", own)), ",").alias("labels"),
        "licenses.score",
    )


@query
def op2_bytenet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality_network(docs, table(spark, sf_dir, "labels"))
    scored = bytenet.predict(docs, network)
    return scored.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = maxent.score(docs, remainder("doc_id", 5) != 1)
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    short = F.octet_length("text") <= samples.LONGEST_SAMPLE
    known = docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & short & F.rlike("text", F.lit(r"\p{L}")))
    languages = known.select("lang").distinct().limit(LANGUAGE_SAMPLE + 1).count()
    chosen = samples.pick(known, "doc_id", "lang", F.lit(True), max(1, LANGUAGE_SAMPLE // max(1, languages)))
    model = langid.fit(samples.collect_texts(docs, chosen, "doc_id", "text", "lang", 2 * LANGUAGE_SAMPLE))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        F.col("identified.language").alias("lang_pred"),
        "identified.score",
        "identified.cross_entropy",
        "identified.rejected",
    )


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    allowed = (remainder("doc_id", 4) != 2) & F.col("toxic").isin(0, 1)
    chosen = samples.pick(labels.join(samples.usable(docs, "doc_id", "text"), "doc_id", "left_semi"), "doc_id", "toxic", allowed, TOXICITY_SAMPLE)
    sample = samples.collect_texts(docs, chosen, "doc_id", "text", "toxic", 2 * TOXICITY_SAMPLE)
    share = labels.where(allowed).join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.avg("toxic")).first()[0]
    chain = toxicity.fit([(text.decode("utf-8", "replace"), label) for text, label in sample], share)
    found = toxicity.classify(docs, chain)
    return found.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        F.col("toxicity.toxic").alias("score"),
        (F.col("toxicity.toxic") >= chain.threshold).cast("int").alias("predicted"),
        F.col("toxicity.insult").alias("insult_score"),
        F.col("toxicity.contempt").alias("contempt_score"),
    )


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op7_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), least_bytes=0)
    return archive.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenizer_path()
    coded = bpe.decode(bpe.encode(docs, path), path)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = durable(host_rules.measure(docs).drop("text"), "measures")
    return host_rules.judge(measured).select("doc_id", *host_rules.MEASURES, "base_failed", "kept")


ORACLES["op9_host_rules"] = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
grams AS (
  SELECT rid, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM words WHERE len(w) > 2)),
repeated AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams) WHERE n > 1),
inside AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS p FROM repeated) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
measures AS (
  SELECT rid, doc_id, source, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM texts JOIN words USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN inside USING (rid)),
checked AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * word_chars
    OR 1000 * n_dup_lines > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS failed
  FROM measures),
hosts AS (SELECT source, count(*) AS docs, sum(failed::INT) AS failures FROM checked GROUP BY source),
moments AS (
  SELECT sum(failures) / sum(docs) AS mean,
    sum(failures * failures / docs) / sum(docs) - (sum(failures) / sum(docs)) ** 2 AS variance FROM hosts),
prior AS (
  SELECT mean, CASE WHEN variance > mean * (1 - mean) / 1001
    THEN greatest(1, mean * (1 - mean) / variance - 1) ELSE 1000 END AS weight FROM moments),
verdicts AS (SELECT source, (failures + mean * weight) / (docs + weight) > 0.8 AS bad FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM checked c JOIN verdicts v ON c.source IS NOT DISTINCT FROM v.source
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = simhash.near_duplicates(docs, "doc_id", "text", size=3, max_bits=2)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op11_dualtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = dual_tree.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", parts=8, entries=16, rounds=6, scale=4096)
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(dual_tree.digest(books)).alias("codebooks_sha256"))


def _lloyd_sql(rounds: int) -> str:
    """Plain Lloyd rounds, every part compared with every entry, one pair of steps after another."""
    steps = [
        f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d
  FROM (SELECT vec_id, part, entry, sum((p.v - c.v) * (p.v - c.v)) AS d FROM points p JOIN c{i} c USING (part, place) GROUP BY ALL)
  GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT part, entry, place, CASE WHEN n IS NULL THEN c.v ELSE (s - (s % n + n) % n) // n END::BIGINT AS v
  FROM c{i} c LEFT JOIN (SELECT part, entry, place, sum(v) AS s, count(*) AS n FROM points JOIN a{i} USING (vec_id, part) GROUP BY ALL) m
    USING (part, entry, place))"""
        for i in range(rounds + 1)
    ]
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 8 AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
points AS MATERIALIZED (
  SELECT vec_id, pos // width AS part, pos % width AS place, floor(4096 * x)::BIGINT AS v
  FROM (SELECT vec_id, width, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16),
c0 AS MATERIALIZED (SELECT part, entry, place, v FROM points JOIN first USING (vec_id)),{",".join(steps)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v, ',' ORDER BY part, entry, place)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


ORACLES["op11_dualtree"] = _lloyd_sql(6)


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), "lang", "source", "text", least_docs=10, top=10)


ORACLES["op12_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
found AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = d.lang) AS v FROM (SELECT DISTINCT lang FROM docs) d),
groups AS MATERIALIZED (
  SELECT lang, source, v, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM docs) g JOIN langs USING (lang)
  LEFT JOIN found USING (lang, source) GROUP BY ALL),
rates AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (size + 2 * v) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
totals AS (SELECT lang, sum(size) AS size, any_value(v) AS v FROM groups GROUP BY lang),
whole AS (
  SELECT f.lang, f.term, 1 + (1000000000::HUGEINT * (sum(f.n) + 2)) // (any_value(t.size) + 2 * any_value(t.v)) AS q
  FROM found f JOIN totals t ON t.lang = f.lang GROUP BY f.lang, f.term),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM rates x JOIN rates y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM rates JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms)
WHERE rank <= 10
"""


@query
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = minhash.near_duplicates(docs, "doc_id", "text", size=3, percent=85)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


ORACLES["op13_minhash"] = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS g
  FROM texts),
sizes AS (SELECT doc_id, len(g)::BIGINT AS n FROM sets),
held AS (SELECT doc_id, unnest(g) AS shingle FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM held a JOIN held b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION SELECT reached.doc_id, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.other),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN smallest USING (doc_id)
"""
