import pytest
from conftest import rows
from pyspark.sql import functions as F

from spendframe.functions.paths import path
from spendframe.functions.periods import add_to_month, in_window, months_between, period_bounds
from spendframe.functions.predicates import condition, keyword, where


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(1, "Alpha", "a", 10), (2, "beta", None, 20), (3, None, "c", None), (4, "ALPHABET", "a", 40)],
        "id int, name string, team string, size int",
    )


@pytest.mark.parametrize(
    "spec, expected",
    [
        ({"k": "team", "v": "a", "o": "eq"}, [1, 4]),
        ({"k": "team", "v": None, "o": "eq"}, [2]),
        ({"k": "team", "v": "a", "o": "not"}, [2, 3]),
        ({"key": "team", "value": ["a", "c"], "operator": "in"}, [1, 3, 4]),
        ({"k": "team", "v": ["c", None], "o": "in"}, [2, 3]),
        ({"k": "team", "v": ["a"], "o": "not_in"}, [2, 3]),
        ({"k": "team", "v": ["a", None], "o": "not_in"}, [3]),
        ({"k": "name", "v": "alpha", "o": "contain"}, [1, 4]),
        ({"k": "name", "v": "alpha", "o": "not_contain"}, [2, 3]),
        ({"k": "size", "v": 20, "o": "gte"}, [2, 4]),
        ({"k": "size", "v": 20, "o": "lt"}, [1]),
        ({"k": "size", "v": 20, "o": "lte"}, [1, 2]),
    ],
)
def test_operators(people, spec, expected):
    assert [row.id for row in people.where(condition(spec)).orderBy("id").collect()] == expected
    kept = people.where(~condition(spec)).count()
    assert kept + len(expected) == 4, "a condition is never null"


def test_unknown_operator():
    with pytest.raises(ValueError):
        condition({"k": "a", "v": 1, "o": "regex"})


def test_filter_or_is_anded_with_filter(people):
    either = [{"k": "id", "v": 1, "o": "eq"}, {"k": "id", "v": 3, "o": "eq"}]
    assert rows(people.where(where([{"k": "team", "v": "a", "o": "eq"}], either)), "id") == [(1,)]


def test_keyword_needs_every_word_somewhere(people):
    assert rows(people.where(keyword("alpha A", ["name", "team"])), "id") == [(1,), (4,)]
    assert rows(people.where(keyword("alpha c", ["name", "team"])), "id") == []


def test_paths_into_maps_and_structs(spark):
    df = spark.sql("select map('a.b', 1, 'c', 2) as bag, named_struct('USD', 5) as cost")
    picked = df.select(path("bag.a.b").alias("x"), path("bag.z").alias("y"), path("cost.USD").alias("z"))
    assert rows(picked) == [(1, None, 5)]


def test_period_bounds_end_is_inclusive_by_one_unit():
    assert period_bounds("1998", "1999", "YEARLY") == ("1998", "2000")
    assert period_bounds("1998-11", "1998-12", "MONTHLY") == ("1998-11", "1999-01")
    assert period_bounds("1998", "1998-03", "MONTHLY") == ("1998-01", "1998-04")
    assert period_bounds("2024-02", "2024-02-29", "DAILY") == ("2024-02-01", "2024-03-01")
    with pytest.raises(ValueError):
        period_bounds("1998-01", "1998-02", "YEARLY")


def test_month_arithmetic():
    assert add_to_month("1998-01", -1) == "1997-12"
    assert add_to_month("1998-12", 13) == "2000-01"


def test_months_between_and_window(spark):
    df = spark.createDataFrame([("1998-11", "1999-02"), ("1998-05", "1998-04")], "a string, b string")
    listed = [row.m for row in df.select(months_between(F.col("a"), F.col("b")).alias("m")).collect()]
    assert listed == [["1998-11", "1998-12", "1999-01", "1999-02"], []]
    months = df.withColumnRenamed("a", "billed_month")
    assert rows(months.where(in_window("1998-05", "1998-10", "MONTHLY")), "billed_month") == [("1998-05",)]
