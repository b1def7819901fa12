import random
import re

import compare
import pytest

from spendframe.llm import host_rules, queries


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, repeats = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeats |= {p + k for p in places for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeats)


def test_measures_against_brute_force(spark):
    draw = random.Random(6)
    texts = [None, "", " \n\t ", "a", "a b", "a a a", "a a a a", "\x0ba b c\x0c a b c", "é# 你|\n\né# 你|\n \n", "x y\x1c z"]
    texts += ["".join(draw.choices(["a", "b", "cé", " ", " ", " ", "\n", "$"], k=draw.randint(1, 90))) for _ in range(300)]
    docs = spark.createDataFrame([(i, text, 5) for i, text in enumerate(texts)], "doc_id long, text string, n_words int").repartition(8)
    rows = host_rules.measure(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert tuple(row[name] for name in host_rules.MEASURES) == plain(row.text), repr(row.text)


def test_hosts_are_shrunk_and_rejected(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"h{i % 30}", good) for i in range(600)]
    rows += [(1000 + i, "bad", "short" if i % 20 else good) for i in range(300)]
    rows += [(2000, "tiny", "short"), (2001, None, good), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    measured = host_rules.measure(docs)
    rates = {row.host: row.rate for row in host_rules.host_rates(measured).collect()}
    assert rates["bad"] > 0.8 and rates["tiny"] < 0.95 and rates["h0"] < 0.1
    judged = host_rules.judge(measured).collect()
    assert len(judged) == len(rows)
    assert not any(row.kept for row in judged if row.source == "bad")
    assert all(row.kept for row in judged if (row.source or "")[:1] == "h")
    assert {row.kept for row in judged if row.source is None} == {True, False}


def test_join_beyond_the_broadcast_size(spark, monkeypatch):
    monkeypatch.setattr(host_rules, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame([(i, "bad" if i % 2 else f"h{i}", "x" if i % 2 else " ".join(f"word{k}" for k in range(60))) for i in range(400)], "doc_id long, source string, text string")
    judged = host_rules.judge(host_rules.measure(docs.where("doc_id >= 0")))
    assert judged.where("host_rejected and source <> 'bad'").count() == 0
    assert judged.where("source = 'bad' and not host_rejected").count() == 0


def test_clashing_columns(spark):
    names = ["host", "bad", "measures", "rate", "docs", "failures", "base_failed", "_host"]
    docs = spark.createDataFrame([(1, "h", "a b", *names)], ", ".join(["doc_id long", "source string", "text string", *(f"{name} string" for name in names)]))
    row = host_rules.judge(host_rules.measure(docs)).first()
    assert [row[name] for name in names if name != "base_failed"] == [name for name in names if name != "base_failed"]
    assert row.base_failed is True and row.n_words == 2 and row.kept is False


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert host_rules.judge(host_rules.measure(docs)).count() == 0


def test_query_against_sql(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(compare, "TABLES", [*compare.TABLES, "documents"])
    pytest.importorskip("duckdb")
    name = "op9_host_rules"
    assert compare.difference(spark, queries.QUERIES[name], compare.connect(sf_dir), queries.ORACLES[name], sf_dir) is None
