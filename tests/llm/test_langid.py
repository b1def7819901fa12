import collections
import math
import random
import zlib

import numpy as np
import pytest

from spendframe.llm import langid, queries


def text_of(draw, alphabet, words=40):
    return " ".join("".join(draw.choices(alphabet, k=draw.randint(1, 6))) for _ in range(words))


@pytest.fixture(scope="module")
def sample():
    draw = random.Random(1)
    return [(text_of(draw, {"aa": "abcdef", "bb": "defghi", "cc": "äöüdeg"}[language]).encode(), language) for _ in range(20) for language in ("aa", "bb", "cc")]


@pytest.fixture(scope="module")
def model(sample):
    return langid.fit(sample)


def plain_model(texts):
    """Interpolated Kneser-Ney by its definition: (grams' log2 probability function)."""
    raw = [collections.Counter() for _ in range(langid.ORDER)]
    for values in texts:
        padded = [32] * langid.ORDER + values.tolist()
        for end in range(langid.ORDER, len(padded)):
            for order in range(langid.ORDER):
                raw[order][tuple(int(x) for x in padded[end - order : end + 1])] += 1
    counts = [collections.Counter(gram[1:] for gram in raw[order + 1]) if order < langid.ORDER - 1 else raw[order] for order in range(langid.ORDER)]
    totals = []
    for order in range(langid.ORDER):
        groups = {}
        for gram, count in counts[order].items():
            total, kinds = groups.get(gram[:-1], (0, 0))
            groups[gram[:-1]] = total + count, kinds + 1
        ones, twos = (sum(count == k for count in counts[order].values()) for k in (1, 2))
        totals.append((groups, min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))))

    def chance(gram, alphabet):
        if not gram:
            return 1 / alphabet
        groups, discount = totals[len(gram) - 1]
        lower = chance(gram[1:], alphabet)
        if gram[:-1] not in groups:
            return lower
        total, kinds = groups[gram[:-1]]
        return max(counts[len(gram) - 1][gram] - discount, 0) / total + discount * kinds / total * lower

    return chance


def test_probabilities_match_the_definition(sample):
    languages = ["aa", "bb", "cc"]
    texts = {language: [langid.codes(text.decode()) for text, own in sample if own == language][:6] for language in languages}
    model = langid._train(languages, texts)
    alphabet = 1 + len({int(c) for own in texts.values() for values in own for c in values})
    draw = random.Random(9)
    for _ in range(4):
        values = langid.codes(text_of(draw, "abcdefghiäöüz", 12))
        padded = [32] * (langid.ORDER - 1) + values.tolist()
        for column, language in enumerate(languages):
            chance = plain_model(texts[language])
            total = sum(math.log2(chance(tuple(int(x) for x in padded[i : i + langid.ORDER]), alphabet)) for i in range(len(values)))
            assert model.entropies(values)[column] == pytest.approx(-total / len(values), rel=1e-4)


def test_batches_and_pieces_give_the_same(monkeypatch, model):
    draw = random.Random(2)
    texts = [text_of(draw, "abcdefghi", draw.randint(1, 80)) for _ in range(40)]
    single = [model.identify([text])[0] for text in texts]
    monkeypatch.setattr(langid, "PIECE_CHARS", 64)
    for found in (model.identify(texts), [model.identify([text])[0] for text in texts]):
        for a, b in zip(single, found):
            assert a["language"] == b["language"] and a["cross_entropy"] == pytest.approx(b["cross_entropy"], rel=1e-5)


def test_accuracy_and_rejection(model):
    draw = random.Random(3)
    for language, alphabet in (("aa", "abcdef"), ("bb", "defghi"), ("cc", "äöüdeg")):
        found = model.identify([text_of(draw, alphabet) for _ in range(20)])
        assert [x["language"] for x in found] == [language] * 20 and not any(x["rejected"] for x in found)
    assert model.identify(["日本語 文章 テスト"])[0]["rejected"]
    assert [x["language"] for x in model.identify(["", "123 .,", "\n"])] == ["und"] * 3
    assert langid.fit([]).identify(["abc"])[0]["language"] == "und"


def test_hash_lookup():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 63, 500, np.uint64) >> np.uint64(40) << np.uint64(20))
    table = langid.SortedHashes(keys)
    wanted = np.concatenate((keys, keys + np.uint64(1)))
    assert (table.find(wanted) == np.concatenate((np.arange(len(keys)), np.full(len(keys), -1)))).all()
    assert (langid.SortedHashes(keys[:0]).find(wanted) == -1).all()


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "abc abc", None)], "doc_id long, text string, language string")
    rows = langid.identify(docs, model).collect()
    assert sorted((row.text or "", row.identified.language) for row in rows) == [("", "und"), ("", "und"), ("abc abc", "aa")]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark, sf_dir):
    docs = {row.doc_id: row for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_langid"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) and 0 <= row.score <= 1 for row in rows)
    held = [row for row in rows if row.held_out]
    assert sum(row.lang_pred == docs[row.doc_id].lang for row in held) >= 0.95 * len(held)


@pytest.mark.parametrize("text", ["½ ²", "③", "Ⅷ", "12 !", "²³ ⅓"])
def test_numbers_are_no_letters(model, text):
    assert len(langid.codes(text)) == 0
    assert model.identify([text]) == [{"language": "und", "score": 0.0, "cross_entropy": None, "rejected": True}]


def test_numbers_part_words():
    assert langid.codes("ab½cd Ⅷ e").tolist() == langid.codes("ab cd e").tolist()
