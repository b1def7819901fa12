"""Bounded samples of labelled rows for models that are fitted on the driver."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST_SAMPLE = 64 << 10
LEAD_BITS = 16
MOST_LABELS = 1000
#: Rows looked at for each row wanted, since repeated rows count once in the end.
COPIES = 4


def pick(labels: DataFrame, id: str, label: str, allowed: Column, per_label: int, most_labels: int = MOST_LABELS) -> DataFrame:
    """At most `per_label` rows (id, label) of each label: those whose ids hash lowest, so the choice is spread and repeatable.

    Rows are first counted by label and leading bits of the hash, which tells for each label the bits beyond which no row
    is needed; only the few rows up to there are ranked. Of more than `most_labels` labels the first ones are sampled, so
    the cuts, one per label, may be broadcast.
    """
    rows = labels.where(allowed & F.col(label).isNotNull() & F.col(id).isNotNull()).select(id, label)
    rows = rows.withColumns({"_hash": F.xxhash64(id), "_lead": F.shiftrightunsigned(F.xxhash64(id), 64 - LEAD_BITS)})
    counts = rows.groupBy(label, "_lead").count()
    so_far = F.sum("count").over(Window.partitionBy(label).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1))
    needed = counts.withColumn("_before", F.coalesce(so_far, F.lit(0))).where(F.col("_before") < per_label * COPIES)
    cuts = needed.groupBy(label).agg(F.max("_lead").alias("_cut")).orderBy(label).limit(most_labels)
    few = rows.join(F.broadcast(cuts), label).where(F.col("_lead") <= F.col("_cut")).select(id, label, "_hash", "_lead").distinct()
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_lead", "_hash", id))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= per_label).select(id, label)


def usable(docs: DataFrame, id: str, text: str) -> DataFrame:
    """The ids of documents that `collect_texts` may take."""
    return docs.where((F.octet_length(F.coalesce(F.col(text), F.lit(""))) <= LONGEST_SAMPLE) & F.col(id).isNotNull()).select(id)


def collect_texts(docs: DataFrame, chosen: DataFrame, id: str, text: str, label: str, limit: int) -> list[tuple[bytes, object]]:
    """(UTF-8 text, label) of chosen rows whose text is at most LONGEST_SAMPLE bytes, in a fixed order.

    `chosen` has at most `limit` rows by construction, so it is broadcast, and limit x LONGEST_SAMPLE bounds what
    reaches the driver. A document with two labels, or in two rows, counts as often.
    """
    source = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    source = source.where(F.octet_length("_text") <= LONGEST_SAMPLE)
    picked = chosen.select(F.col(id).alias("_id"), F.col(label).alias("_label"))
    joined = source.join(F.broadcast(picked), "_id").orderBy(F.xxhash64("_id"), "_id", "_label", F.xxhash64("_text")).limit(limit)
    return [(row["_text"].encode(), row["_label"]) for row in joined.collect()]
