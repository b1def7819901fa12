"""Vector codes: Lloyd rounds with trees over both the vectors' parts and the codebook entries.

Vectors become integers and are cut into consecutive parts; each part position has a small codebook. Tasks pack
rows into blocks and build, once, a tree for each part position of a block: nodes split at the median of their
widest component, with bounding boxes and sums of their points cached. Blocks are stored. In each round a tree
over each codebook's entries is built as well, and both trees are descended together: a pair of nodes is dropped
where the least distance between their boxes exceeds the largest distance from the point node to some other entry
node. A point node left with one entry is assigned whole by its cached sums; in leaves left with several, integer
distances decide. Everything is integer arithmetic, so results do not depend on how rows are dealt.

A round hands the driver one sum for each component of each entry, whatever the number of rows.
"""

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.session import durable

LEAF_POINTS = 16
BLOCK_ROWS = 4096
#: Labels (with their sums) are broadcast up to this many, else joined by shuffle.
BROADCAST_LABELS = 100_000


def largest_component(width: int) -> int:
    """Integers up to this keep the squared distance of two vectors below 2^62."""
    return math.isqrt((1 << 62) // width) // 2


class Shape(NamedTuple):
    """Where the parts of a vector begin and end."""

    cuts: tuple[int, ...]

    @classmethod
    def of(cls, width: int, parts: int) -> "Shape":
        return cls(tuple(width * i // parts for i in range(parts + 1)))

    def parts(self) -> list[slice]:
        return [slice(a, b) for a, b in zip(self.cuts, self.cuts[1:])]


class Level(NamedTuple):
    """One level of a tree: where its nodes' points begin (and the last ends), and their boxes."""

    starts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def splits(count: int, leaf: int) -> list[np.ndarray]:
    """Node boundaries of each level, halving `count` points until no node has more than `leaf`."""
    levels = [np.array([0, count])]
    while np.diff(levels[-1]).max() > leaf:
        depth = len(levels)
        levels.append(np.unique((np.arange((1 << depth) + 1) * count) >> depth))
    return levels


def order_points(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of points in which each node of the tree is consecutive."""
    order = np.arange(len(points))
    if not points.shape[1]:
        return order
    for starts in splits(len(points), leaf)[:-1]:
        placed = points[order]
        node = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        spread = np.maximum.reduceat(placed, starts[:-1]) - np.minimum.reduceat(placed, starts[:-1])
        order = order[np.lexsort((placed[np.arange(len(placed)), spread.argmax(axis=1)[node]], node))]
    return order


def boxes(placed: np.ndarray, leaf: int) -> list[Level]:
    return [Level(starts, np.minimum.reduceat(placed, starts[:-1]), np.maximum.reduceat(placed, starts[:-1])) for starts in splits(len(placed), leaf)]


def children(levels: list[Level], depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First child of each node on the next level, and one past its last; a leaf is its own child."""
    if depth + 1 >= len(levels):
        return nodes, nodes + 1
    below = levels[depth + 1].starts
    return np.searchsorted(below, levels[depth].starts[nodes]), np.searchsorted(below, levels[depth].starts[nodes + 1])


def expand(levels: list[Level], depth: int, nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (node, other) with each node replaced by its children."""
    first, last = children(levels, depth, nodes)
    counts = last - first
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first, counts) + within, np.repeat(others, counts)


def assign(placed: np.ndarray, tree: list[Level], entries: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Nearest entry of every point, ties to the lower index, by a descent of both trees.

    Returns whole nodes as (level, node numbers, entries), and the points of undecided leaves with their entries.
    """
    entry_order = order_points(entries, 1)
    entry_tree = boxes(entries[entry_order], 1)
    points, groups = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole = []
    for depth in range(max(len(tree), len(entry_tree))):
        at, to = min(depth, len(tree) - 1), min(depth, len(entry_tree) - 1)
        if depth:
            points, groups = expand(tree, depth - 1, points, groups) if depth < len(tree) else (points, groups)
            groups, points = expand(entry_tree, depth - 1, groups, points) if depth < len(entry_tree) else (groups, points)
        low, high = tree[at].low[points], tree[at].high[points]
        entry_low, entry_high = entry_tree[to].low[groups], entry_tree[to].high[groups]
        gap = np.maximum(np.maximum(entry_low - high, low - entry_high), 0)
        reach = np.maximum(entry_high - low, high - entry_low)
        least, most = (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)
        bound = np.full(len(tree[at].starts) - 1, np.iinfo(np.int64).max)
        np.minimum.at(bound, points, most)
        near = least <= bound[points]
        points, groups = points[near], groups[near]
        if to == len(entry_tree) - 1:
            single = np.bincount(points, minlength=len(bound))[points] == 1
            whole.append((at, points[single], entry_order[groups[single]]))
            points, groups = points[~single], groups[~single]
    starts = tree[-1].starts
    sizes = np.diff(starts)
    best = np.full(len(placed), np.iinfo(np.int64).max)
    chosen = np.zeros(len(placed), np.int64)
    undecided = np.unique(points)
    for entry in range(len(entries)):
        leaves = points[entry_order[groups] == entry]
        rows = _ranges(starts[leaves], sizes[leaves])
        away = ((placed[rows] - entries[entry]) ** 2).sum(axis=1)
        closer = away < best[rows]
        best[rows[closer]] = away[closer]
        chosen[rows[closer]] = entry
    rows = _ranges(starts[undecided], sizes[undecided])
    return whole, rows, chosen[rows]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, `size` of them."""
    return np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Block:
    """Some rows' integer vectors with, for each part, the order of its tree and the boxes and sums of its nodes."""

    def __init__(self, points: np.ndarray, shape: Shape, trees: list[tuple[np.ndarray, list[Level], list[np.ndarray]]]):
        self.points, self.shape, self.trees = points, shape, trees

    @classmethod
    def build(cls, points: np.ndarray, shape: Shape) -> "Block":
        trees = []
        for part in shape.parts():
            order = order_points(points[:, part], LEAF_POINTS)
            placed = points[order, part]
            tree = boxes(placed, LEAF_POINTS)
            trees.append((order, tree, [np.add.reduceat(placed, level.starts[:-1]) for level in tree]))
        return cls(points, shape, trees)

    def pack(self) -> list[bytes]:
        """Points, orders, boxes and sums as bytes; the sizes follow from the number of points and the shape."""
        orders = [order for order, _, _ in self.trees]
        corners = [corner.ravel() for _, tree, _ in self.trees for level in tree for corner in (level.low, level.high)]
        sums = [total.ravel() for _, _, totals in self.trees for total in totals]
        return [
            self.points.astype("<i4").tobytes(),
            np.concatenate(orders).astype("<u2").tobytes(),
            np.concatenate(corners).astype("<i4").tobytes(),
            np.concatenate(sums).astype("<i8").tobytes(),
        ]

    @classmethod
    def unpack(cls, count: int, shape: Shape, points: bytes, orders: bytes, corners: bytes, sums: bytes) -> "Block":
        points = np.frombuffer(points, "<i4").reshape(count, -1).astype(np.int64)
        orders = np.frombuffer(orders, "<u2").astype(np.int64).reshape(-1, count)
        corners = np.frombuffer(corners, "<i4").astype(np.int64)
        sums = np.frombuffer(sums, "<i8")
        trees, at, sums_at = [], 0, 0
        for part, order in zip(shape.parts(), orders):
            width, tree, totals = part.stop - part.start, [], []
            for starts in splits(count, LEAF_POINTS):
                shaped = (len(starts) - 1, width)
                size = shaped[0] * width
                tree.append(Level(starts, corners[at : at + size].reshape(shaped), corners[at + size : at + 2 * size].reshape(shaped)))
                totals.append(sums[sums_at : sums_at + size].reshape(shaped))
                at, sums_at = at + 2 * size, sums_at + size
            trees.append((order, tree, totals))
        return cls(points, shape, trees)

    def sums(self, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each part, the sums and the number of points nearest to each entry."""
        answers = []
        for part, book, (order, tree, totals) in zip(self.shape.parts(), books, self.trees):
            placed = self.points[order, part]
            whole, rows, chosen = assign(placed, tree, book)
            total, number = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
            for level, nodes, entries in whole:
                np.add.at(total, entries, totals[level][nodes])
                np.add.at(number, entries, np.diff(tree[level].starts)[nodes])
            for place in range(total.shape[1]):  # exact: a block's sums stay below 2^53
                total[:, place] += np.bincount(chosen, placed[rows, place], len(book)).astype(np.int64)
            answers.append((total, number + np.bincount(chosen, minlength=len(book))))
        return answers

    def nearest(self, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each point, its entry in every part and the sum of the squared distances."""
        codes = np.zeros((len(self.points), len(books)), np.int64)
        error = np.zeros(len(self.points), np.int64)
        for i, (part, book, (order, tree, _)) in enumerate(zip(self.shape.parts(), books, self.trees)):
            whole, rows, chosen = assign(self.points[order, part], tree, book)
            code = np.zeros(len(order), np.int64)
            for level, nodes, entries in whole:
                starts, sizes = tree[level].starts, np.diff(tree[level].starts)
                code[_ranges(starts[nodes], sizes[nodes])] = np.repeat(entries, sizes[nodes])
            code[rows] = chosen
            codes[order, i] = code
            error += ((self.points[:, part] - book[codes[:, i]]) ** 2).sum(axis=1)
        return codes, error


def whole_vectors(vectors: DataFrame, id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, numbers) of the rows whose vector is there and has finite components only, as integers."""
    value = F.col(vector)
    number = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), value.alias("vector"))
    kept = kept.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    return kept.withColumn("numbers", F.transform("vector", number)).drop("vector")


def _vector_matrix(column: pa.Array, width: int) -> np.ndarray:
    points = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    limit = largest_component(width)
    if len(points) and (points.max() > limit or points.min() < -limit):
        raise ValueError(f"components beyond {limit} cannot be measured in 64 bits")
    return points


def store_blocks(kept: DataFrame, shape: Shape, rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored blocks of up to `rows` rows of a task: ids and labels as an array, and the packed trees."""
    width = shape.cuts[-1]
    identity = kept.select(F.struct("id", "label").alias("row")).schema["row"].dataType
    schema = f"rows array<{identity.simpleString()}>, points binary, orders binary, corners binary, sums binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def block() -> pa.RecordBatch:
            joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            row = joined.column("row")
            packed = Block.build(_vector_matrix(joined.column("numbers"), width), shape).pack()
            listed = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row)
            return pa.RecordBatch.from_arrays([listed, *(pa.array([value], pa.binary()) for value in packed)], ["rows", "points", "orders", "corners", "sums"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - number)
                batch = batch.slice(part.num_rows)
                held.append(part)
                number += part.num_rows
                if number == rows:
                    yield block()
                    held, number = [], 0
        if number:
            yield block()

    return durable(kept.select(F.struct("id", "label").alias("row"), "numbers").mapInArrow(pack, schema), "vector-blocks")


def _blocks(batch: pa.RecordBatch, shape: Shape) -> Iterator[tuple[pa.Array, Block]]:
    for i in range(batch.num_rows):
        row = batch.column("rows").slice(i, 1).flatten()
        yield row, Block.unpack(len(row), shape, *(batch.column(name)[i].as_py() for name in ("points", "orders", "corners", "sums")))


def lloyd_round(blocks: DataFrame, shape: Shape, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the floored mean of the parts nearest to it, or stays if there are none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)) for book in books]
        for batch in batches:
            for _, block in _blocks(batch, shape):
                for (total, number), (more, count) in zip(totals, block.sums(books)):
                    total += more
                    number += count
        for part, (total, number) in enumerate(totals):
            used = np.flatnonzero(number)
            if len(used) and total.shape[1]:
                entry, place = np.repeat(used, total.shape[1]), np.tile(np.arange(total.shape[1]), len(used))
                columns = [np.full(len(entry), part), entry, place, total[entry, place], number[entry]]
                yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], ["part", "entry", "place", "total", "number"])

    sums = blocks.mapInArrow(add, "part long, entry long, place long, total long, number long").groupBy("part", "entry", "place")
    sums = sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("number").alias("number"))
    new = [book.copy() for book in books]
    for row in sums.collect():  # one row for each component of each entry
        new[row.part][row.entry, row.place] = int(row.total) // row.number
    return new


def codes(blocks: DataFrame, shape: Shape, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every row of the blocks; the code has two hex digits for each part."""
    identity = blocks.schema["rows"].dataType.elementType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _blocks(batch, shape):
                chosen, error = block.nearest(books)
                text = [value.hex() for value in chosen.astype(np.uint8).view(f"V{len(books)}").ravel().tolist()]
                yield pa.RecordBatch.from_arrays([row, pa.array(text, pa.string()), pa.array(error, pa.int64())], ["row", "code", "error"])

    return blocks.mapInArrow(encode, f"row {identity.simpleString()}, code string, error long").select("row.*", "code", "error")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(value) for book in books for value in book.ravel().tolist()).encode()).hexdigest()


def _with_label_error(coded: DataFrame) -> DataFrame:
    sums = durable(coded.groupBy(F.col("label").alias("other")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "label-errors")
    sums = sums.select("other", F.col("total").try_cast("long").alias("label_error"))
    side = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    return coded.join(side, F.col("label").eqNullSafe(F.col("other")), "left").drop("other")


def compress(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (id, label, code, error, label_error) for the kept vectors, and the codebooks of the parts.

    Vectors that are null or hold null or non-finite components are dropped. All others must have the width of the
    first kept vector by id; vectors of another width, and empty ones, cannot be compared and are dropped too. If
    `parts` does not divide the width, parts differ by one component. Components become floor(scale * x), and
    a ValueError names any beyond `largest_component` (134 million in 64 dimensions). The codebooks start with the `entries` smallest ids' parts (fewer if there are fewer rows,
    at most 256; null ids last, equal ids by vector) and have `rounds` rounds. Ties go to the lower entry. Repeated rows count
    and come out each time. Null labels are one label; a label's error beyond 64 bits is null. Other columns are
    ignored; an empty table gives no rows and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256, so that two hex digits name one")
    kept = whole_vectors(vectors, id, vector, label, scale).where(F.size("numbers") > 0)
    start = kept.select("id", "numbers").orderBy(F.asc_nulls_last("id"), "numbers")
    leader = start.first()
    width = len(leader.numbers) if leader else parts
    shape = Shape.of(width, parts)
    kept = kept.where(F.size("numbers") == width)
    first = np.array([row.numbers for row in start.where(F.size("numbers") == width).limit(entries).collect()], np.int64).reshape(-1, width)
    books = [first[:, part] for part in shape.parts()]
    blocks = store_blocks(kept, shape)
    for _ in range(rounds if len(first) else 0):
        books = lloyd_round(blocks, shape, books)
    return _with_label_error(durable(codes(blocks, shape, books), "vector-codes")), books
