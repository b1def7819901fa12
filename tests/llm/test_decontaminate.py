import random

import numpy as np

from spendframe.llm import decontaminate as dc
from spendframe.llm import queries


def words(draw, count):
    return " ".join("".join(draw.choices("abcdefghijklmnoprstuvw", k=draw.randint(2, 8))) for _ in range(count))


def edited(draw, text, edits):
    text = list(text)
    for _ in range(edits):
        at, kind = draw.randrange(len(text)), draw.randrange(3)
        if kind == 0:
            text[at] = "Z"
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, "q")
    return "".join(text)


def least_edits(pattern, text):
    """Fewest edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_every_window_within_the_budget_is_found():
    """The filter loses nothing: windows within their budget by a full alignment are reported, others are not."""
    draw = random.Random(11)
    items = [(i, dc.normalise(words(draw, draw.randint(4, 60)))) for i in range(12)]
    index = dc.Index(items)
    for _ in range(25):
        item, text = draw.choice(items)
        text = edited(draw, text.decode(), draw.randint(0, 12))
        whole = dc.normalise(words(draw, 5) + " " + text + " " + words(draw, 5))
        found = {w for w, *_ in index.search(np.frombuffer(whole, np.uint8))}
        for number, window in enumerate(index.windows):
            if window.item == item:
                assert (number in found) == (least_edits(window.text, whole) <= window.budget), (window, whole)
            else:
                assert number not in found


def test_alignment_counts_edits():
    draw = random.Random(12)
    for _ in range(60):
        pattern = dc.normalise(words(draw, 6))
        text = dc.normalise(edited(draw, pattern.decode(), draw.randint(0, 4)))
        edits, _ = dc.banded(np.frombuffer(text, np.uint8), np.array([-12]), np.frombuffer(pattern, np.uint8).reshape(1, -1), 24)
        assert int(edits[0]) == least_edits(pattern, text)


def test_borders_pieces_and_repeats(monkeypatch):
    draw = random.Random(13)
    item = words(draw, 40)
    index = dc.Index([(7, dc.normalise(item)), (8, dc.normalise("a" * 200)), (9, b"short")])
    half = len(item) // 2
    texts = [item[:half], item[half:], "", words(draw, 3000) + item.upper().replace(" ", "\n") + words(draw, 9), "a" * 5000, "short"]
    for piece in (1 << 20, 700):
        monkeypatch.setattr(dc, "PIECE_BYTES", piece)
        monkeypatch.setattr(dc, "HITS_AT_ONCE", 5000)
        found = dc.matches(index, [dc.normalise(text) for text in texts])
        assert [[hit["item_id"] for hit in hits] for hits in found] == [[], [], [], [7], [8], []]
        place = dc.normalise(texts[3]).find(dc.normalise(item))
        assert found[3][0]["first_byte"] == place and found[3][0]["end_byte"] == place + len(item) and found[3][0]["edits"] == 0


def test_short_passages_are_found_wherever_they_begin(spark):
    draw = random.Random(15)
    items = [(i, dc.normalise(words(draw, 60))) for i in range(4)] + [(9, dc.normalise(words(draw, 5)))]
    index = dc.Passages(items)
    around = [dc.normalise(words(draw, 9)) for _ in range(2)]
    item = items[2][1]
    for start in range(0, len(item) - dc.PASSAGE + 1):
        found = dc.matches(index, [around[0] + b" " + item[start : start + dc.PASSAGE] + b" " + around[1], item[start : start + dc.PASSAGE - 12]])
        assert [[hit["item_id"] for hit in hits] for hits in found] == [[2], []]
        assert found[0][0]["first_byte"] <= len(around[0]) + 1 + 3 and found[0][0]["edits"] == 0
    for _ in range(40):  # the same passages as a full alignment of each
        text = edited(draw, item.decode()[draw.randrange(100) :][: draw.randint(50, 110)], draw.randint(0, 6))
        whole = dc.normalise(words(draw, 5) + " " + text + " " + words(draw, 5))
        passages = [item[k : k + dc.PASSAGE] for k in range(len(item) - dc.PASSAGE + 1)]
        expected = any(least_edits(passage, whole) <= 3 for passage in passages)
        assert bool(dc.matches(index, [whole])[0]) == expected
    docs = spark.createDataFrame([(1, item[70:140].decode()), (2, around[0].decode())], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, text.decode()) for i, text in items], "item_id long, text string")
    assert [(row.doc_id, [hit.item_id for hit in row.leaks]) for row in dc.find(docs, benchmark).orderBy("doc_id").collect()] == [(1, [2]), (2, [])]


def test_odd_rows_and_blocks(spark, monkeypatch):
    draw = random.Random(14)
    items = [words(draw, 30) for _ in range(6)]
    benchmark = spark.createDataFrame([*enumerate(items), (6, None), (None, items[0]), (7, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, items[2], "x"), (3, f"a {items[0]} {items[5]}", None), (3, items[1], "y"), (3, items[1], "y")], "doc_id long, text string, item_id string")
    for size in (1 << 19, 100):
        monkeypatch.setattr(dc, "BLOCK_BYTES", size)
        rows = dc.find(docs, benchmark).collect()
        found = sorted(((row.doc_id or 0, sorted(hit.item_id for hit in row.leaks)) for row in rows))
        assert found == [(0, [2]), (1, []), (2, []), (3, [0, 5]), (3, [1]), (3, [1])]
    assert dc.find(docs, benchmark.limit(0)).selectExpr("sum(size(leaks))").first()[0] == 0
    assert dc.find(docs.limit(0), benchmark).count() == 0


def test_query_finds_all_planted_passages(spark, sf_dir):
    texts = {row.doc_id: dc.normalise(row.text or "") for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {row.item_id: dc.normalise(row.text or "") for row in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(d, i) for d, text in texts.items() for i, item in items.items() if item in text}
    found = {(row.doc_id, row.item_id) for row in queries.QUERIES["op6_decontaminate"](spark, sf_dir).collect()}
    assert exact <= found
    for doc, item in found - exact:
        assert any(least_edits(w.text, texts[doc]) <= w.budget for w in dc.Index([(item, items[item])]).windows)
