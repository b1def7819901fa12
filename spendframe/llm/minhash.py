"""MinHash near-duplicate groups by a multi-index Hamming join of b-bit signatures.

A text's signature holds 16 bits of each of 32 minimum hashes over its distinct word shingles. Signatures
differ in as many places as these values do, about (1 - similarity) * 32. They are cut into eight chunks of
four values; if two differ in at most 15 places, then by the pigeonhole principle some chunk differs in at
most one. So each signature is stored, for every chunk, under the four keys that leave one of the chunk's
values out, and texts that share a key are candidates: no pair within 15 places escapes. At a similarity of
0.85 a pair differs in more than 15 places with a chance of 4 in a million, and less above. Candidates are
confirmed on the full shingle sets.

Texts of equal sets are one node, so exact copies never meet. Of the nodes that share a key with others, those are
dropped first that hold so many shingles alone that they cannot reach the similarity with any; that takes out texts
which only share a common passage. The rest form families: nodes that share a key with one another, directly or by way
of others; most have two or three nodes. A family is sorted by set size and cut into tiles of bounded size. Tiles of a family that are close enough in size are compared by
one matrix product, exactly, on the shingles that both hold; from each pair of tiles only a spanning forest of the links
comes out. So a key or a family shared by any number of nodes is never held by one task nor written out pair by pair.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spendframe.llm.common import texts, word_blocks
from spendframe.llm.simhash import components
from spendframe.session import durable

SEED = 42
CHUNKS = 8
CHUNK_VALUES = 4
VALUE_BITS = 16
HASHES_AT_ONCE = 1 << 12
#: Nodes and shingles of a tile (a larger set has a tile of its own), and shingles that one matrix product takes.
TILE_NODES, TILE_SHINGLES = 256, 1 << 17
COLUMNS_AT_ONCE = 1 << 13
#: Words whose hash a worker remembers.
KNOWN_WORDS = 1 << 18
#: Odd factors and offsets of the minimum hashes, and the factor that mixes a minimum before 16 bits are taken.
_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 1 << 63, CHUNKS * CHUNK_VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw.integers(0, 1 << 63, CHUNKS * CHUNK_VALUES, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
SIGNATURE = [f"s{chunk}" for chunk in range(CHUNKS)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


_word_hashes = _WordHashes()


def _joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of each `size` consecutive words, from the hashes of the words."""
    count = len(hashes) - size + 1
    value = np.full(count, np.uint64(size))
    for i in range(size):
        value = (value ^ hashes[i : i + count]) * MIX
        value ^= value >> np.uint64(29)
    return value * MIX


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `size`-word shingles; fewer words make one shingle, no words none."""
    found, tail = [], np.empty(0, np.uint64)
    for words in word_blocks(text.lower()):
        tail = np.concatenate([tail, np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))])
        if len(tail) >= size:
            found.append(np.unique(_joined(tail, size)))
            tail = tail[len(tail) - size + 1 :]
    if not found:
        return _joined(tail, len(tail)) if len(tail) else tail
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One signed integer per chunk, with 16 bits of each of the chunk's minimum hashes."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[start : start + HASHES_AT_ONCE, None] * FACTORS + OFFSETS
        least = np.minimum(least, part.min(axis=0))
    values = ((least * MIX) >> np.uint64(64 - VALUE_BITS)).reshape(CHUNKS, CHUNK_VALUES)
    shifts = np.arange(CHUNK_VALUES, dtype=np.uint64) * np.uint64(VALUE_BITS)
    return np.bitwise_or.reduce(values << shifts, axis=1).view(np.int64)


def sketches(docs: DataFrame, text: str, size: int, name: str) -> DataFrame:
    """Adds a struct of n (shingles), digest (of the set, null if it is empty) and the signature."""

    @arrow_udf(f"n long, digest binary, {', '.join(f'{column} long' for column in SIGNATURE)}")
    def compute(column: pa.Array) -> pa.Array:
        sizes, digests, signatures = [], [], []
        for value in texts(column):
            hashes = shingle_hashes(value, size)
            sizes.append(len(hashes))
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            signatures.append(signature(hashes))
        chunks = np.array(signatures, np.int64).reshape(-1, CHUNKS)
        arrays = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(chunks[:, i].copy()) for i in range(CHUNKS))]
        return pa.StructArray.from_arrays(arrays, ["n", "digest", *SIGNATURE])

    return docs.withColumn(name, compute(F.col(text)))


def _set(size: int):
    """All shingle hashes of a text, packed."""

    @arrow_udf("binary")
    def compute(column: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(value, size).tobytes() for value in texts(column)], pa.binary())

    return compute


def _keys() -> Column:
    """(slot, key) for each chunk and each of its values left out."""
    value_mask = (1 << VALUE_BITS) - 1
    keys = []
    for chunk, column in enumerate(SIGNATURE):
        for value in range(CHUNK_VALUES):
            mask = ~(value_mask << VALUE_BITS * value)
            mask = (mask + (1 << 63)) % (1 << 64) - (1 << 63)
            slot = F.lit(chunk * CHUNK_VALUES + value).alias("slot")
            keys.append(F.struct(slot, F.col(column).bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.explode(F.array(*keys))


def families(buckets: DataFrame) -> DataFrame:
    """(node, family) for nodes that share a key with others; the family is its smallest node. `buckets` is (slot, key, node)."""
    first = buckets.groupBy("slot", "key").agg(F.min("node").alias("a"), F.count("*").alias("members")).where("members > 1")
    edges = buckets.join(first, ["slot", "key"]).select("a", F.col("node").alias("b")).distinct()
    return components(edges).withColumnRenamed("root", "family")


def hopeful(members: DataFrame, percent: int) -> DataFrame:
    """The nodes that may be similar to some other. `members` is (node, n, hashes).

    Of two sets with a similarity of p the common part is at least p of either, and a shingle that no other node has is
    not in it.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, hashes in zip(*(batch.column(name) for name in ("node", "hashes"))):
                hashes = np.frombuffer(hashes.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.full(len(hashes), node.as_py()))], ["hash", "node"])

    rows = members.select("node", "hashes").mapInArrow(spread, "hash long, node long")
    alone = rows.groupBy("hash").agg(F.count("*").alias("holders"), F.min("node").alias("node")).where("holders = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("own"))
    common = F.col("n") - F.coalesce("own", F.lit(0))
    return members.join(alone, "node", "left").where(100 * common >= percent * F.col("n")).select("node")


def tiles(members: DataFrame) -> DataFrame:
    """(family, tile, low, high, nodes, sizes, hashes): nodes of a family in runs of similar set size; low and high are sizes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, family, held, shingles = TaskContext.get().partitionId() << 32, None, [], 0

        def tile() -> pa.RecordBatch:
            sizes = np.array([len(hashes) // 8 for _, hashes in held], np.int64)
            values = [family, number, int(sizes.min()), int(sizes.max()), np.array([node for node, _ in held], np.int64).tobytes(), sizes.tobytes(), b"".join(hashes for _, hashes in held)]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(values, kinds)], TILE)

        for batch in batches:
            for own, node, hashes in zip(*(batch.column(name).to_pylist() for name in ("family", "node", "hashes"))):
                if held and (own != family or len(held) == TILE_NODES or shingles + len(hashes) // 8 > TILE_SHINGLES):
                    yield tile()
                    number, held, shingles = number + 1, [], 0
                family = own
                held.append((node, hashes))
                shingles += len(hashes) // 8
        if held:
            yield tile()

    ordered = members.repartitionByRange("family", "n", "node").sortWithinPartitions("family", "n", "node").select("family", "node", "hashes")
    return ordered.mapInArrow(cut, "family long, tile long, low long, high long, nodes binary, sizes binary, hashes binary")


TILE = ["family", "tile", "low", "high", "nodes", "sizes", "hashes"]


def _common(left_sizes: np.ndarray, left: np.ndarray, right_sizes: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by matrix products over the shingles that both sides hold."""
    shared = np.intersect1d(left, right)
    common = np.zeros((len(left_sizes), len(right_sizes)), np.float64)
    sides = []
    for sizes, hashes in ((left_sizes, left), (right_sizes, right)):
        rows, columns = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(shared, hashes)
        held = shared[np.minimum(columns, len(shared) - 1)] == hashes if len(shared) else np.zeros(len(hashes), bool)
        order = np.argsort(columns[held], kind="stable")
        sides.append((rows[held][order], columns[held][order]))
    for start in range(0, len(shared), COLUMNS_AT_ONCE):
        parts = []
        for sizes, (rows, columns) in zip((left_sizes, right_sizes), sides):
            a, b = np.searchsorted(columns, [start, start + COLUMNS_AT_ONCE])
            part = np.zeros((len(sizes), min(COLUMNS_AT_ONCE, len(shared) - start)), np.float32)
            part[rows[a:b], columns[a:b] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T  # each product is below 2^24, exact in 32 bits
    return common.astype(np.int64)


def _forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest row that links lead to."""
    roots = np.arange(len(links))
    while True:
        lowest = np.minimum(roots, np.where(links, roots, len(links)).min(axis=1))
        lowest = lowest[lowest]
        if (lowest == roots).all():
            return roots
        roots = lowest


def _tile_links(left: dict, right: dict | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links within a tile, or between two tiles, connect."""
    one, other = ([np.frombuffer(tile[name], np.int64) for name in ("nodes", "sizes", "hashes")] for tile in (left, right or left))
    common = _common(one[1], one[2], other[1], other[2])
    linked = 100 * common >= percent * (one[1][:, None] + other[1] - common)
    if right is None:
        nodes = one[0]
    else:
        nodes, between, count = np.concatenate([one[0], other[0]]), linked, len(one[0])
        linked = np.zeros((len(nodes), len(nodes)), bool)
        linked[:count, count:], linked[count:, :count] = between, between.T
    roots = _forest(linked)
    own = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[own], nodes[roots[own]]


def links(tiled: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect exactly the nodes of each family that are similar, or reached by similar ones."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                a, b = _tile_links(row["left"], row.get("right"), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    body = F.struct("nodes", "sizes", "hashes")
    inside = tiled.select(body.alias("left")).mapInArrow(compare, "a long, b long")
    light = tiled.select("family", "tile", "low", "high")
    one, other = light.select("family", F.col("tile").alias("x"), F.col("high").alias("most")), light.select("family", F.col("tile").alias("y"), "low")
    # Tiles are numbered by rising size, so the sizes of a later one are not below those of an earlier one.
    close = one.join(other, "family").where((F.col("x") < F.col("y")) & (100 * F.col("most") >= percent * F.col("low"))).select("x", "y")
    pairs = close.join(tiled.select(F.col("tile").alias("x"), body.alias("left")), "x").join(tiled.select(F.col("tile").alias("y"), body.alias("right")), "y")
    return inside.unionByName(pairs.select("left", "right").mapInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """One row (id, n_shingles, component, kept) per row of `docs`; component is the smallest id of its group.

    Rows are linked when 100 * common >= percent * united distinct `size`-word shingles, A-Z lower-cased; groups
    are the connected parts. Texts with fewer words have one shingle, all their words. Null texts and texts
    without words have none and are linked with nothing, not even each other. Repeated rows stay repeated and
    fall into one group. Null ids take part and are never the smallest unless a group has no other. `kept` is
    true where id and component are equal, both null included. Very long texts need eight bytes a shingle.
    Other columns are ignored, an empty table gives no rows.
    """
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    prints = sketches(docs, "text", size, "sketch").select("id", "text_hash", "sketch.*")
    prints = durable(prints, "minhash")
    sketch = [F.max(column).alias(column) for column in ("n", *SIGNATURE)]
    nodes = prints.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("one"), *sketch)
    # Written once, so that the numbers given here hold for all that follows.
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")

    keys = nodes.select("node", _keys().alias("at")).select("node", "at.*")
    shared = keys.groupBy("slot", "key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = durable(keys.join(shared.select("slot", "key"), ["slot", "key"]), "minhash-keys")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    wanted = wanted.select("node", "n", F.col("one.id").alias("node_id"), F.col("one.text_hash").alias("node_hash"))
    match = docs["id"].eqNullSafe(wanted["node_id"]) & (docs["text_hash"] == wanted["node_hash"])
    held = docs.join(wanted, match).dropDuplicates(["node"]).select("node", "n", _set(size)("text").alias("hashes"))
    held = durable(held, "minhash-sets")
    rest = durable(hopeful(held, percent), "minhash-hopeful")
    related = families(buckets.join(rest, "node", "left_semi"))
    tiled = durable(tiles(durable(held.join(related, "node"), "minhash-members")), "minhash-tiles")
    roots = components(links(tiled, percent))

    groups = nodes.select("digest", "node", F.col("one.id").alias("first")).join(roots, "node", "left")
    groups = groups.withColumn("root", F.coalesce("root", "node"))
    smallest = groups.groupBy("root").agg(F.min("first").alias("component"))
    groups = durable(groups.join(smallest, "root").select("digest", "component"), "minhash-groups")
    placed = prints.where("n > 0").join(groups, "digest").select("id", F.col("n").alias("n_shingles"), "component")
    alone = prints.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    return placed.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
