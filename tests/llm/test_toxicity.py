import random
import zlib

import numpy as np
import pytest

from spendframe.llm import queries, toxicity


def post(draw, kind):
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 6))) for _ in range(draw.randint(5, 80))]
    if kind:
        words += draw.sample(toxicity.SEEDS[draw.choice(["insult", "contempt"])], 2) if kind == 1 else [f"zzzz{draw.randrange(9)}"]
    draw.shuffle(words)
    return " ".join(words)


@pytest.fixture(scope="module")
def chain():
    draw = random.Random(1)
    return toxicity.fit([(post(draw, i % 4 if i % 4 < 3 else 0), int(i % 4 in (1, 2))) for i in range(400)], 0.1)


def test_chain_uses_earlier_categories(chain):
    draw = random.Random(2)
    texts = [post(draw, 0), post(draw, 1), post(draw, 2)]
    rows = [[chain.names[name] for name in toxicity.features(text) if name in chain.names] for text in texts]
    found = chain.probabilities(texts)
    for text, numbers in enumerate(rows):
        logits = []
        for model in chain.models:
            logits.append(float(np.clip(model.weights[numbers].sum() + np.dot(logits, model.earlier) + model.offset, -10, 10)))
        assert np.allclose(found[text], [1 / (1 + np.exp(-x - chain.shift)) for x in logits])
    assert [len(model.earlier) for model in chain.models] == [0, 1, 2] and np.abs(chain.models[2].earlier).sum() > 0


def test_finds_new_toxic_texts_and_spares_clean_ones(chain):
    draw = random.Random(3)
    flagged = lambda kind: np.mean(chain.probabilities([post(draw, kind) for _ in range(100)])[:, 2] >= chain.threshold)
    assert flagged(1) > 0.9 and flagged(2) > 0.8 and flagged(0) < 0.03
    long = " ".join(post(draw, 0) for _ in range(300))
    assert chain.probabilities([long + " idiot moron"])[0, 2] > chain.probabilities([long])[0, 2]


def test_a_rare_label_moves_log_odds_once_and_flips_no_decision():
    draw = random.Random(4)
    sample = [(post(draw, 1 + i % 4 // 2 if i % 2 else 0), i % 2) for i in range(400)]
    plain, rare = toxicity.fit(sample), toxicity.fit(sample, 0.01)
    texts = [post(draw, i % 3) for i in range(90)]
    odds = lambda chain: np.log(chain.probabilities(texts) / (1 - chain.probabilities(texts)))
    assert np.allclose(odds(rare) - odds(plain), np.log(0.01 / 0.99))
    toxic = np.arange(90) % 3 > 0
    flagged = rare.probabilities(texts)[:, 2] >= rare.threshold
    assert (flagged == toxic).mean() > 0.95


def test_words_at_the_border_of_a_piece(monkeypatch):
    text = " ".join(f"word{'abcdefghij'[i % 10] * (i % 7)}" for i in range(200)) + " äöü" * 20
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 5)
    assert toxicity.features(text) == whole


def test_few_labels():
    for sample in ([], [("a b", 0)] * 5, [("a b", 1)] * 5):
        found = toxicity.fit(sample).probabilities(["a b", ""])
        assert found.shape == (2, 3) and ((found >= 0) & (found <= 1)).all()


def test_odd_rows(spark, chain):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "you idiot moron", None)], "doc_id long, text string, toxicity string")
    rows = toxicity.classify(docs, chain).collect()
    assert len(rows) == 3 and all(0 <= row.toxicity.toxic <= 1 for row in rows)
    assert max(rows, key=lambda row: row.toxicity.toxic).text == "you idiot moron"
    assert toxicity.classify(docs.limit(0), chain).count() == 0


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {row.doc_id: row.toxic for row in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op5_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(row.score, labels[row.doc_id]) for row in rows if row.held_out and row.doc_id in labels]
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) for row in rows)
    pairs = [(a > b) + (a == b) / 2 for a, bad in held for b, other in held if bad and not other]
    assert sum(pairs) / len(pairs) > 0.9
