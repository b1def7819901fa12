import random
import zlib

import numpy as np
import pytest

from spendframe.llm import bytenet, queries, samples


def junk(draw, good):
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(draw.randint(20, 200))]
    return (" ".join(words) if good else " ".join(word + "###" for word in words)).encode()


@pytest.fixture(scope="module")
def network():
    draw = random.Random(1)
    return bytenet.fit([(junk(draw, i % 2), i % 2) for i in range(160)])


def packed(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(text) for text in texts])))


def plain_score(network, text):
    """One text, window by window."""
    rows = []
    for chunk in range(max(1, 1 + -(-(len(text) - bytenet.CHUNK) // bytenet.STEP))):
        part = text[chunk * bytenet.STEP :][: bytenet.CHUNK].ljust(bytenet.CHUNK, b"\0")
        outs = [network.embedding[list(part[at : at + 8])].reshape(-1) @ network.filters for at in range(0, bytenet.CHUNK - 7, 4)]
        rows.append(np.maximum(np.max(outs, axis=0) + network.bias, 0))
    logit = np.concatenate((np.mean(rows, axis=0), np.max(rows, axis=0))) @ network.unit + network.offset[0]
    return 1 / (1 + np.exp(-logit))


def test_scores_match_the_definition_and_cover_the_whole_text(network):
    draw = random.Random(2)
    texts = [b"", b"a", junk(draw, 1), bytes(512), bytes(513), draw.randbytes(992), draw.randbytes(993), draw.randbytes(40_000)]
    found = bytenet.score(network, *packed(texts))
    assert np.allclose(found, [plain_score(network, text) for text in texts], atol=1e-4)
    good = b" ".join(junk(draw, 1) for _ in range(20))
    assert bytenet.score(network, *packed([good, good + junk(draw, 0) * 20]))[1] < bytenet.score(network, *packed([good]))[0]


def test_gradients_match_finite_differences():
    draw = random.Random(3)
    network = bytenet.fit([(b"x", 0)])
    network.unit[:] = np.linspace(-1, 1, len(network.unit))
    batch, labels = [b" ".join(junk(draw, i % 2) for _ in range(1 + i)) for i in range(4)], np.array([1, 0, 1, 0], np.float32)

    def loss():
        p = bytenet.score(network, *packed(batch))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)) + 5e-5 * float(network.unit @ network.unit)

    gradients = bytenet._gradients(network, batch, labels)
    for value, gradient in zip(network.parameters(), gradients):
        at = np.unravel_index(int(np.abs(gradient).argmax()), value.shape)
        kept, step = value[at], 5e-4
        value[at] = kept + step
        above = loss()
        value[at] = kept - step
        below = loss()
        value[at] = kept
        assert (above - below) / (2 * step) == pytest.approx(float(gradient[at]), rel=0.1, abs=2e-3)


def test_learns_and_handles_missing_labels(network):
    draw = random.Random(5)
    texts = [junk(draw, i % 2) for i in range(60)]
    assert np.mean((bytenet.score(network, *packed(texts)) >= 0.5) == np.arange(60) % 2) > 0.95
    assert bytenet.score(bytenet.fit([]), *packed([b"a"]))[0] == pytest.approx(0.5)
    assert bytenet.score(bytenet.fit([(b"a", 1)] * 3), *packed([b"b"]))[0] > 0.9


def test_sample_is_bounded_and_skips_nulls(spark):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(None, 1), (5, None), (7, 1), (7, 1)], "doc_id long, quality int")
    chosen = samples.pick(labels, "doc_id", "quality", F.col("quality") < 2, 20)
    assert {row.quality: row["count"] for row in chosen.groupBy("quality").count().collect()} == {0: 20, 1: 20}
    docs = spark.createDataFrame([(i, "x" * (70_000 if i % 2 else 5)) for i in range(300)], "doc_id long, text string")
    texts = samples.collect_texts(docs, chosen, "doc_id", "text", "quality", 40)
    assert texts and all(len(text) == 5 for text, _ in texts)


def test_scores_hold_for_the_true_share_of_labels(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(k, junk(draw, k % 8 != 0).decode(), int((k % 8 != 0) != (draw.random() < 0.3))) for k in range(2400)]
    docs = spark.createDataFrame([row[:2] for row in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(row[0], row[2]) for row in rows] + [(k, 0) for k in range(5000, 5100)], "doc_id long, quality int")
    own = [row[2] for row in rows if zlib.crc32(str(row[0]).encode()) % 4 != 2]
    share = sum(own) / len(own)
    texts = [row[1].encode() for row in rows if zlib.crc32(str(row[0]).encode()) % 4 == 2]
    for bound in (300, 5000):  # a sample of nearly equal parts, and one that holds all rows
        monkeypatch.setattr(queries, "QUALITY_SAMPLE", bound)
        assert bytenet.score(queries.quality_network(docs, labels), *packed(texts)).mean() == pytest.approx(share, abs=0.08)


def test_odd_rows(spark, network):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a b", None)], "doc_id long, text string, score string")
    rows = bytenet.predict(docs, network).collect()
    assert len(rows) == 3 and all(0 <= row.score <= 1 for row in rows)
    assert bytenet.predict(docs.limit(0), network).count() == 0


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op2_bytenet"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) and row.predicted == (row.score >= 0.7) for row in rows)
    scored = [(row.score, labels[row.doc_id]) for row in rows if row.held_out and row.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for a, good in scored for b, other in scored if good and not other]
    assert sum(pairs) / len(pairs) > 0.93
