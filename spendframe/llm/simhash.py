"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint has 64 bits; it is cut into two 32-bit segments. If two fingerprints differ in at most
r bits, then either their first segments differ in at most r/2 bits or their second segments differ in
fewer than r/2. So each distinct fingerprint is stored under both of its segments and asks for the
Hamming balls of these radii around its own segments; what the equality join brings is verified by the
complete distance.

A segment shared by many distinct fingerprints (a large group of near copies) would be compared pair by
pair. Such buckets are left out of that join, and the fingerprints that hold or ask for one are linked
exactly in linear work instead: two fingerprints are within r bits if and only if their full 64-bit balls
of radius r/2 share a point, and a point's ball holds a fixed number of fingerprints, so a group-by on
the points gives a star of links for each.
"""

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spendframe.llm.common import fresh_name, texts, word_blocks
from spendframe.session import durable

SEED = 42
HASHES_AT_ONCE = 1 << 16
BUCKET_LIMIT = 64
SEGMENT = (1 << 32) - 1


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[start : start + HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def text_fingerprint(text: bytes, size: int) -> int:
    """64 majority bits over the XXH64 of all `size`-word shingles, as a signed integer; zero without words."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    ones, count, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text.lower()):
        tail = tail + words
        if len(tail) < size:
            continue
        shingles = map(b" ".join, zip(*(tail[i:] for i in range(size))))
        hashes = np.fromiter(map(digest, shingles), np.uint64, len(tail) - size + 1)
        ones += _ones(hashes)
        count += len(hashes)
        tail = tail[len(tail) - size + 1 :]
    if not count and tail:
        ones, count = _ones(np.array([digest(b" ".join(tail))], np.uint64)), 1
    bits = np.packbits((2 * ones > count).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str, size: int, name: str) -> DataFrame:
    """Adds the fingerprint of a text column as a long. Null and empty texts have fingerprint zero."""

    @arrow_udf("long")
    def compute(column: pa.Array) -> pa.Array:
        return pa.array([text_fingerprint(value, size) for value in texts(column)], pa.int64())

    return docs.withColumn(name, compute(F.col(text)))


def _ball(radius: int, bits: int) -> list[int]:
    """All masks of up to `radius` of `bits` bits, as signed 64-bit integers."""
    masks = [sum(1 << bit for bit in chosen) for n in range(radius + 1) for chosen in combinations(range(bits), n)]
    return [mask - (1 << 64) if mask >= 1 << 63 else mask for mask in masks]


def _flipped(value: F.Column, masks: list[int]) -> F.Column:
    return F.explode(F.transform(F.array(*[F.lit(mask).cast("long") for mask in masks]), lambda m: value.bitwiseXOR(m)))


def _distance(left: str, right: str) -> F.Column:
    return F.bit_count(F.col(left).bitwiseXOR(F.col(right)))


def links(prints: DataFrame, max_bits: int, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a < b) that connect exactly the fingerprints within `max_bits` of each other, through others at most.

    `prints` has one column `fp` of distinct fingerprints; it is read several times, so pass a stored table.
    """
    if max_bits % 2 or not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0, 2 or 4")
    half = max_bits // 2
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(SEGMENT))
    held = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("key")), F.struct(F.lit(1).alias("seg"), low.alias("key")))).alias("at"))
    held = held.select("fp", "at.seg", "at.key")
    asked = prints.select("fp", F.lit(0).alias("seg"), _flipped(high, _ball(half, 32)).alias("key"))
    if half:
        asked = asked.unionByName(prints.select("fp", F.lit(1).alias("seg"), _flipped(low, _ball(half - 1, 32)).alias("key")))
    large = durable(held.groupBy("seg", "key").count().where(F.col("count") > bucket_limit).select("seg", "key"), "simhash-large")

    light = held.join(large, ["seg", "key"], "left_anti")
    found = asked.withColumnRenamed("fp", "a").join(light.withColumnRenamed("fp", "b"), ["seg", "key"])
    found = found.where((F.col("a") < F.col("b")) & (_distance("a", "b") <= max_bits)).select("a", "b")

    crowded = held.unionByName(asked).join(large, ["seg", "key"], "left_semi").select("fp").distinct()
    points = crowded.select("fp", _flipped(F.col("fp"), _ball(half, 64)).alias("point"))
    # A point's ball bounds this list: 65 fingerprints at radius 1, 2,081 at radius 2.
    near = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    star = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    star = star.where((F.col("a") < F.col("b")) & (_distance("a", "b") <= max_bits))
    return found.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node reachable.

    Large-star and small-star steps alternate until the edges stand still; every round is written to
    the shared folder, so lineage stays short and a lost executor costs one round at most.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "star")
    before = None
    while True:
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(lowest, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(lowest, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(lowest.select("v", F.col("m").alias("u")))
        edges = durable(small.where("v <> u").distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """One row (id, fingerprint, component) per row of `docs`; component is the smallest id of its group.

    Texts are linked when their fingerprints differ in at most `max_bits` bits; groups are the connected
    parts. Null and empty texts share fingerprint zero. Repeated rows stay repeated and fall into one
    group; null ids take part and are never the smallest unless a group has no other. Other columns
    are ignored, an empty table gives no rows.
    """
    prints = with_fingerprint(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", size, "fp").select("id", "fp")
    prints = durable(prints, "simhash")
    nodes = durable(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    linked = nodes.join(roots, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(smallest, "root").select("fp", "component")
    groups = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    groups = durable(groups, "simhash-groups")
    return prints.join(groups, "fp").select("id", F.col("fp").alias("fingerprint"), "component")


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, max_bits: int = 2) -> DataFrame:
    """`docs` with one row of each near-duplicate group: that of the smallest id.

    Rows with equal or null ids are told apart by all their columns; of fully equal rows one stays.
    """
    key = fresh_name(docs, "row_key")
    columns = [F.col(f"`{name}`") for name in docs.columns]
    keyed = docs.withColumn(key, F.struct(F.col(id).isNull().alias("n"), F.col(id).alias("i"), F.xxhash64(*columns).alias("h")))
    groups = near_duplicates(keyed, key, text, size, max_bits)
    first = groups.where("id = component").select(F.col("id").alias(key)).distinct()
    kept = keyed.join(first, keyed[key].eqNullSafe(first[key]), "left_semi")
    return kept.dropDuplicates([key]).drop(key)
