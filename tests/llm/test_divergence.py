import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spendframe.llm import divergence


def plain_audit(rows, least_docs=10, top=10):
    """Every term of every group in Python integers."""
    table = {byte: byte + 32 for byte in range(65, 91)}
    counts, lang_counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", (text or "").translate(table)
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        sources[lang].add(source)
        counts[lang, source].update(words)
        lang_counts[lang].update(words)
        docs[lang].update(set(words))
    answers = []
    for lang, names in sources.items():
        kept = [term for term, n in docs[lang].items() if n >= least_docs]

        def rates(found):
            below = sum(found[term] for term in kept) + 2 * len(kept)
            return {term: 1 + 10**9 * (found[term] + 2) // below for term in kept}

        whole, own = rates(lang_counts[lang]), {name: rates(counts[lang, name]) for name in names}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for name in names:
            pairs = [(sum(gap(own[name][t], own[other][t]) for t in kept), other) for other in names if other != name]
            terms = [(gap(own[name][t], whole[t]), t) for t in kept if counts[lang, name][t] and own[name][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda pair: (-pair[0], pair[1].encode()))[:most]
                answers += [(lang, name, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(answers)


def check(spark, rows, least_docs=10, top=10, **options):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    found = divergence.audit(docs, least_docs=least_docs, top=top, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, least_docs, top)


def drawn(seed, count, sources=7):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "aBcdéß漢" for b in ("x", "Yz", "ö", "")]
    rows = []
    for _ in range(count):
        skew = draw.randrange(1, len(words))
        text = " ".join(draw.choice(words[:skew]) + draw.choice(["", ",", "-7", "\n"]) for _ in range(draw.randrange(12)))
        rows.append((draw.choice(["en", "de", None]), f"s{draw.randrange(sources)}", text))
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_terms": 3, "tile_sources": 2}, {"tile_sources": 1}])
def test_matches_the_definition(spark, options):
    check(spark, drawn(1, 400), **options)


def test_ties_nulls_and_empties(spark):
    rows = [("en", source, text) for source in ("a", "b", "ä", "B", None) for text in ("one two", "two THREE", None, "", "12 !")]
    rows += [(None, None, None), ("", "", "x"), ("solo", "only", "a b a b"), ("none", "p", "rare"), ("none", "q", "other"), ("none", None, "9")]
    check(spark, rows + rows, least_docs=3, top=2)


def test_a_hot_source_over_several_batches(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 4)
    check(spark, drawn(2, 150, 3) + [("en", "hot", "aa bb cc " * 50)] * 80)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0
    rows = [(source, "en", "aa bb", 1, "x") for source in "pq" for _ in range(6)]
    clash = spark.createDataFrame(rows, "source string, lang string, text string, rank int, term string")
    assert sorted(map(tuple, divergence.audit(clash).collect())) == [("en", "p", "pair", "q", 0, 1), ("en", "q", "pair", "p", 0, 1)]


def test_runs_cover_the_chunk():
    column = [0, 0, 3, 3, 3, 0, 1, 1, 0]
    places = np.flatnonzero(column).astype("<i4")
    starts, rates = divergence.runs(9, 100, 20, places.tobytes(), np.array(column, "<i8")[places].tobytes())
    assert starts.tolist() == [0, 2, 5, 6, 8]
    assert rates.tolist() == [1 + 10**9 * (n + 2) // 140 for n in (0, 3, 0, 1, 0)]
    other = divergence.runs(9, 10, 20, None, None)
    assert other[0].tolist() == [0]
    plain = sum((1 + 10**9 * (n + 2) // 140 - q) ** 2 // (1 + 10**9 * (n + 2) // 140 + q) for n in column for q in other[1].tolist())
    assert divergence.run_divergence(9, (starts, rates), other) == plain


def test_equal_counts_are_brought_together(spark):
    """The order of a chunk leaves fewer runs than the order of terms by name."""
    draw = random.Random(3)
    cells = [(f"t{i:03}", [(s, draw.randrange(1, 4)) for s in "abcd" if draw.random() < 0.6]) for i in range(300)]
    rows = [("en", term, sum(n for _, n in found), found) for term, found in cells if found]
    kept = spark.createDataFrame(rows, "lang string, term string, total long, cells array<struct<source: string, n: long>>").coalesce(1)
    together = sum(len(divergence.runs(row.length, 1, 1, row.places, row.counts)[0]) for row in divergence.chunks(kept, 1000).collect())
    named = 0
    for source in "abcd":
        column = [dict(found).get(source, 0) for _, _, _, found in rows]
        named += 1 + sum(a != b for a, b in zip(column, column[1:]))
    assert together < named / 2
