from conftest import rows
from pyspark.sql import functions as F

from spendframe.operators.lookups import first_by, keep_matching, lookup
from spendframe.operators.paging import ordering, page_after, number_rows, page


def hot(spark):
    """A third of the rows on one key, another third on null."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 100))
    return spark.range(3000).select("id", key.alias("key"), F.create_map(F.lit("a"), F.lit("b")).alias("bag"))


def test_lookup_with_hot_and_null_keys_starts_no_job(spark):
    fact = hot(spark)
    dim = fact.select("key").where("key is not null").distinct().withColumn("name", F.upper("key"))
    spark.sparkContext.setJobGroup("planning", "")
    found = lookup(fact, dim, ["key"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    assert found.count() == 3000
    assert found.where("name is distinct from upper(key)").isEmpty()


def test_large_dimension_keeps_pruning(spark, sf_dir):
    """Beyond the broadcast size the fact side still reads only the columns that are asked for."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    dim = lines.groupBy("l_partkey").agg(F.max("l_tax").alias("tax"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lookup(lines, dim, ["l_partkey"]).select("l_quantity", "tax")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    schemas = [line.rpartition("ReadSchema: ")[2] for line in plan.splitlines() if "ReadSchema" in line]
    assert "SortMergeJoin" in plan and sorted(schema.count(":") for schema in schemas) == [2, 2]


def test_null_safe_lookup(spark):
    fact = spark.createDataFrame([(1, "a", None), (2, "a", "w")], "id int, key string, scope string")
    dim = spark.createDataFrame([("a", None, "any"), ("a", "w", "own")], "key string, scope string, found string")
    out = lookup(fact, dim, ["key", "scope"], null_safe=("scope",))
    assert rows(out, "id", "found") == [(1, "any"), (2, "own")]


def test_keep_matching(spark):
    ids = spark.createDataFrame([("hot",), ("k1",)], "key string")
    counts = [keep_matching(hot(spark), ids, "key", negate).count() for negate in (False, True)]
    assert sum(counts) == 3000 and counts[0] >= 1000


def test_first_by(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    assert rows(first_by(df, ["k"], "o", ["v"])) == [("a", "y"), ("b", None)]


def test_numbers_are_gapless_over_partitions_and_in_a_hot_group(spark):
    df = hot(spark).select("id", F.coalesce("key", F.lit("none")).alias("key"))
    numbered = number_rows(df, ["-id"], "n").collect()
    assert sorted(row.n for row in numbered) == list(range(1, 3001))
    assert {row.n for row in numbered if row.id == 2999} == {1}
    grouped = number_rows(df, ["id"], "n", ("key",))
    inside = [row.n for row in grouped.where("key = 'hot'").orderBy("id").collect()]
    assert inside == list(range(1, 1001))


def test_pages(spark):
    df = spark.range(25)
    first = page(df, ["-id"], limit=10)
    assert [row.id for row in first.collect()] == list(range(24, 14, -1))
    assert {row.total_count for row in first.collect()} == {25}
    assert [row.id for row in page(df, ["id"], limit=10, start=21).collect()] == [20, 21, 22, 23, 24]
    assert page(df, ["id"], limit=10, start=0).count() == 10
    assert page(df, ["id"]).count() == 25
    assert page(df, ["id"], limit=20, max_limit=5).count() == 5


def test_pages_are_not_copied_and_can_be_walked(spark, tmp_path):
    """No page writes its input; key ranges give the pages that offsets give."""
    values = [(i % 4 or None, None if i % 7 == 0 else i % 5, i) for i in range(60)]
    spark.createDataFrame(values, "a int, b int, id int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = page(df, ["a", "id"], limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    for order in (["a", "-b", "id"], ["-a", "b", "-id"]):
        whole = [row.asDict() for row in df.orderBy(*ordering(order)).collect()]
        walked = [row.asDict() for row in page(df, order, limit=7).drop("total_count").collect()]
        while len(walked) < len(whole):
            walked += [row.asDict() for row in page_after(df, order, walked[-1], 7).collect()]
        assert walked == whole
    scan = page_after(df, ["id"], {"id": 50}, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,50)" in scan
