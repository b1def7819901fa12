import random
import re

from spendframe.llm import licenses, queries
from spendframe.llm.common import word_blocks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    words = WORD.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        want = phrase.split()
        for at in range(len(words)):
            if words[at : at + len(want)] == want:
                places.append(at)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def base(found):
    return tuple(found[key] for key in ("n_words", "n_phrases", "first_word", "last_word", "phrase_labels"))


def test_automaton_holds_exactly_the_substrings():
    draw = random.Random(4)
    for _ in range(60):
        sequences = [[draw.randrange(3) for _ in range(draw.randint(1, 12))] for _ in range(4)]
        automaton = licenses.Automaton(sequences)
        for _ in range(60):
            wanted = [draw.randrange(3) for _ in range(draw.randint(1, 6))]
            places = {(n, i + len(wanted)) for n, s in enumerate(sequences) for i in range(len(s)) if s[i : i + len(wanted)] == wanted}
            state = 0
            for symbol in wanted:
                state = automaton.next[state].get(symbol) if state is not None else None
            assert (set(automaton.places[state]) if state is not None else set()) == places


def test_phrases_against_brute_force(monkeypatch):
    draw = random.Random(8)
    pieces = "under the mit license apache version 2 cc by nc nc4 été x 2 gnu general public licensed".split()
    scanner = licenses.Scanner()
    for block in (1 << 20, 9):
        monkeypatch.setattr(licenses, "word_blocks", lambda text, limit=block: word_blocks(text, limit))
        for _ in range(1500):
            text = draw.choice(["-", " ", ".\n"]).join(draw.choices(pieces, k=draw.randint(0, 40)))
            text += draw.choice(["", " CC-BY NC", " Apache License, Version 2.0", " under the MIT License"])
            assert base(scanner.scan(text.encode())) == plain(text), text


def test_spans_and_labels():
    scanner = licenses.Scanner()
    found = scanner.scan(b"One. This work is licensed under the GNU General Public License, version 3. Two")
    assert [(s["label"], s["first"], s["end"], s["coverage"]) for s in found["spans"]] == [("gpl-3", 4, 13, 1.0)]
    assert found["n_phrases"] == 0 and found["score"] == 1.0
    changed = licenses.TEMPLATES[2][1].replace("charge", "cost").replace("copy of", "copy really of")
    found = scanner.scan(changed.encode())
    assert [s["label"] for s in found["spans"]] == ["mit"] and 0.8 <= found["score"] < 1
    found = scanner.scan(b"licensed under the one two three gnu general public things")
    assert found["spans"] == [] and 0 < found["score"] < 0.8
    assert len(scanner.scan(b"Licensed under CC BY-NC 4.0. " * 3000)["spans"]) == 3000


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "Under the MIT license", None)], "doc_id long, text string, score string")
    rows = licenses.scan(docs).collect()
    assert sorted((base(row.licenses.asDict()) for row in rows), key=str) == sorted([plain(None), plain(""), plain("Under the MIT license")], key=str)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    found = queries.QUERIES["op1_licenses"](spark, sf_dir).collect()
    texts = {row.doc_id: row.text for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(found) == len(texts)
    for row in found:
        expected = plain(texts[row.doc_id])
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (*expected[:4], ",".join(expected[4]))
        assert set(expected[4]) <= set(row.labels.split(",")) and 0 <= row.score <= 1
