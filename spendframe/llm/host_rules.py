"""Quality rules judged by host, in DataFrame operations only.

Each document is measured and checked against rules. Failures are summed by host; since a host with few
documents says little, its failure rate is shrunk towards the rate of all hosts with a beta prior fitted
to the hosts themselves (by moments). Documents of hosts above the limit are rejected with those that
fail the base rules themselves.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm.common import fresh_name
from spendframe.session import durable

BLANK = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_SYMBOLS_PERCENT = 30
MOST_DUPLICATE_LINES_PERCENT = 50
WORD_LENGTH = (2, 14)
HOST_LIMIT = 0.8
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
BROADCAST_BYTES = 4 << 20

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _once(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is read inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hashes.

    The hashes are sorted with their positions, so equal windows are neighbours; sorted start positions
    then say how many words each window adds to those before it.
    """

    def covered(starts: Column) -> Column:
        added = F.transform(starts, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(starts, i - 1))))
        return F.aggregate(added, F.lit(0), lambda total, x: total + x)

    def repeated(pairs: Column) -> Column:
        def start(pair: Column, i: Column) -> Column:
            hash_of = lambda at: F.get(pairs, at)["h"]
            return F.when((hash_of(i - 1) == pair["h"]) | (hash_of(i + 1) == pair["h"]), pair["i"])

        return _once(F.array_sort(F.filter(F.transform(pairs, start), lambda p: p.isNotNull())), covered)

    def windows(all_words: Column) -> Column:
        return F.transform(
            F.slice(all_words, F.lit(1), F.greatest(F.size(all_words) - 2, F.lit(0))),
            lambda word, i: F.xxhash64(word, F.get(all_words, i + 1), F.get(all_words, i + 2)),
        )

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_once(pairs, repeated))

    return _once(windows(words), count)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five measures of MEASURES as longs; a null text counts as empty. Columns of these names are replaced."""
    value = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(value, F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
    lines = F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    measures = _once(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _once(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    kept = [F.col(f"`{name}`") for name in docs.columns if name.lower() not in MEASURES]
    found = fresh_name(docs, "measures")
    return docs.select(*kept, measures.alias(found)).select(*kept, *[F.col(f"{found}.{name}").alias(name) for name in MEASURES])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def any_failed() -> Column:
    """A base rule, the share of symbols, of duplicate lines per ten words, or the mean word length fails."""
    low, high = WORD_LENGTH
    return (
        base_failed()
        | (100 * F.col("n_symbols") > MOST_SYMBOLS_PERCENT * F.col("word_chars"))
        | (1000 * F.col("n_dup_lines") > MOST_DUPLICATE_LINES_PERCENT * F.col("n_words"))
        | (F.col("word_chars") < low * F.col("n_words"))
        | (F.col("word_chars") > high * F.col("n_words"))
    )


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, docs, failures, rate): the rate of documents failing any rule, shrunk by the fitted prior.

    A null host is a host of its own. With one host, or equal rates, the prior has its largest weight.
    """
    counts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("docs"), F.sum(any_failed().cast("long")).alias("failures")
    )
    counts = durable(counts, "hosts")
    total = counts.agg(
        F.sum("docs").alias("docs"), F.sum("failures").alias("failures"), F.sum(F.col("failures") * F.col("failures") / F.col("docs")).alias("squares")
    ).first()
    mean = total.failures / total.docs if total.docs else 0.0
    variance = total.squares / total.docs - mean * mean if total.docs else 0.0
    weight = MOST_WEIGHT
    if variance > mean * (1 - mean) / (MOST_WEIGHT + 1):
        weight = max(LEAST_WEIGHT, mean * (1 - mean) / variance - 1)
    return counts.withColumn("rate", (F.col("failures") + mean * weight) / (F.col("docs") + weight))


def judge(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Adds base_failed, host_rejected and kept to measured documents; columns of these names are replaced.

    Rejected hosts are few as a rule and are broadcast once their names have been found to fit; else they
    are joined by shuffle. The input is read twice: pass a stored table where measuring again costs more.
    """
    name, flag = fresh_name(measured, "host"), fresh_name(measured, "bad")
    rejected = durable(host_rates(measured, host).where(F.col("rate") > limit).select(F.col("host").alias(name), F.lit(True).alias(flag)), "bad-hosts")
    size = rejected.agg(F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + 16)).first()[0] or 0
    side = F.broadcast(rejected) if size <= BROADCAST_BYTES else rejected
    joined = measured.join(side, measured[host].eqNullSafe(side[name]), "left")
    bad = F.coalesce(F.col(flag), F.lit(False))
    return joined.withColumns({"base_failed": base_failed(), "host_rejected": bad, "kept": ~base_failed() & ~bad}).drop(name, flag)
