"""How far the sources of a language differ in their use of words, from run-length encoded count columns.

Counts of terms by source come from one pass and two group-bys. Each language's vocabulary is put into an order
that brings terms with equal counts together (by their lists of sources and counts) and is cut into chunks of
consecutive terms. In a chunk every source is a column of counts, zeros included, kept as runs of equal counts.
For two sources the run boundaries are intersected; a divergence is worked out once for each joint run and
multiplied by its length. Columns of a chunk are packed into tiles of 64 sources, and tiles of the same chunk meet by
an equality join, so no task holds more than two tiles of one chunk.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendframe.session import durable

TERM = re.compile(rb"[a-z\x80-\xFF]+")
NO_TERM = re.compile(rb"[^a-z\x80-\xFF]")
BLOCK_BYTES = 1 << 20
SCALE = 10**9
LEAST_DOCS = 10
TOP_TERMS = 10
CHUNK_TERMS = 8192
TILE_SOURCES = 64
#: Distinct (language, source, term) counts, and pair sums, that a task holds before it hands them on.
HELD = 1 << 19


def text_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, A-Z lower-cased; a long text comes in blocks that end between terms."""
    text, start = text.lower(), 0
    while start < len(text):
        cut = NO_TERM.search(text, min(len(text), start + BLOCK_BYTES))
        stop = cut.start() if cut else len(text)
        yield TERM.findall(text, start, stop)
        start = stop


def _strings(terms: list[bytes]) -> pa.Array:
    try:
        return pa.array(terms, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([term.decode("utf-8", "replace") for term in terms], pa.string())


class _Group:
    """Counts of one (language, source) in a task."""

    def __init__(self):
        self.rows, self.n, self.docs = 0, Counter(), Counter()

    def add(self, text: bytes) -> None:
        self.rows += 1
        own: set = set()
        for words in text_blocks(text):
            self.n.update(words)
            own.update(words)
        self.docs.update(own)

    def batch(self, lang: str, source: str) -> pa.RecordBatch:
        terms = list(self.n)
        numbers = [np.fromiter([0, *self.n.values()], np.int64), np.fromiter([self.rows, *map(self.docs.__getitem__, terms)], np.int64)]
        names = [pa.repeat(pa.scalar(name, pa.string()), len(terms) + 1) for name in (lang, source)]
        listed = pa.concat_arrays([pa.array([None], pa.string()), _strings(terms)])
        return pa.RecordBatch.from_arrays([*names, listed, *map(pa.array, numbers)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the documents that hold it; nulls are ''.

    A row with a null term stands for every (lang, source), also for those whose texts hold no term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Group] = defaultdict(_Group)
        size = 0
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for name, value in zip(names, batch.column(2).cast(pa.binary())):
                group = held[name]
                size -= len(group.n)
                group.add(value.as_py())
                size += len(group.n)
                if size > HELD:
                    yield from (group.batch(*name) for name, group in held.items())
                    held.clear()
                    size = 0
        yield from (group.batch(*name) for name, group in held.items())

    plain = docs.select(*[F.coalesce(F.col(column), F.lit("")).alias(name) for column, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = plain.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, cells) of the terms in at least `least_docs` documents of the language; cells are (source, n)."""
    terms = counts.where("term is not null").groupBy("lang", "term")
    cells = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells")  # one cell a source
    return terms.agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), cells).where(F.col("docs") >= least_docs).drop("docs")


def group_sizes(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, terms): kept occurrences in the group and the language, and the number of kept terms."""
    cells = kept.select("lang", F.explode("cells").alias("cell"))
    sizes = cells.groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count("*").alias("terms"))
    groups = counts.where("term is null").select("lang", "source")
    return groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "lang_size", "terms"])


def rate(n: Column, size: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (n + 2) / (size + 2 * terms)) as a long, by way of 38-digit decimals."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, (size + 2 * terms).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two rates."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_part(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The `top` terms by which each group exceeds its language most."""
    cells = kept.select("lang", "term", "total", F.explode("cells").alias("cell")).select("lang", "term", "total", "cell.*")
    cells = cells.join(groups, ["lang", "source"])
    p, q = rate(F.col("n"), F.col("size"), F.col("terms")), rate(F.col("total"), F.col("lang_size"), F.col("terms"))
    cells = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = cells.select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def chunks(kept: DataFrame, size: int) -> DataFrame:
    """(lang, chunk, length, source, places, counts): each chunk's non-zero counts by source, in the clustering order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, length, number, columns = None, 0, 0, {}

        def chunk() -> pa.RecordBatch:
            names = sorted(columns)
            arrays = [
                pa.array([lang] * len(names), pa.string()),
                pa.array([f"{task}-{number}"] * len(names), pa.string()),
                pa.array([length] * len(names), pa.int32()),
                pa.array(names, pa.string()),
                pa.array([bytes(columns[name][0]) for name in names], pa.binary()),
                pa.array([bytes(columns[name][1]) for name in names], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["lang", "chunk", "length", "source", "places", "counts"])

        task = TaskContext.get().partitionId()
        for batch in batches:
            for language, cells in zip(batch.column("lang").to_pylist(), batch.column("cells").to_pylist()):
                if length and (language != lang or length == size):
                    yield chunk()
                    length, number, columns = 0, number + 1, {}
                lang = language
                for cell in cells:
                    column = columns.setdefault(cell["source"], (bytearray(), bytearray()))
                    column[0].extend(length.to_bytes(4, "little"))
                    column[1].extend(cell["n"].to_bytes(8, "little"))
                length += 1
        if length:
            yield chunk()

    # Ranges are drawn by a few short columns, since a sample of them passes through the driver.
    leading = F.transform(F.slice("cells", 1, 2), lambda cell: F.xxhash64(cell["source"]).bitwiseXOR(cell["n"]))
    ordered = kept.repartitionByRange("lang", leading, F.xxhash64("term")).sortWithinPartitions("lang", "cells", "term")
    schema = "lang string, chunk string, length int, source string, places binary, counts binary"
    return ordered.select("lang", "cells").mapInArrow(cut, schema)


def tiles(columns: DataFrame, groups: DataFrame, sources: int) -> DataFrame:
    """(lang, chunk, length, tile, columns): for each chunk, the columns of about `sources` sources each.

    A source without terms in the chunk has a column of zeros. A language without kept terms has one empty chunk.
    """
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / sources).cast("int").alias("tiles"), F.max("terms").alias("terms"))
    of_source = F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile")
    placed = groups.join(langs.select("lang", "tiles"), "lang").select("lang", of_source, "source", "size", "terms")
    whole = columns.select("lang", "chunk", "length").distinct()
    whole = whole.unionByName(langs.where("terms = 0").select("lang", F.lit("none").alias("chunk"), F.lit(0).alias("length")))
    wanted = whole.join(langs.select("lang", "tiles"), "lang").select("lang", "chunk", "length", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    empty = F.lit(None).cast("binary")
    zeros = wanted.join(placed, ["lang", "tile"]).select("lang", "chunk", "length", "tile", "source", "size", "terms", empty.alias("places"), empty.alias("counts"))
    none = F.lit(None).cast("long")
    filled = columns.join(langs.select("lang", "tiles"), "lang")
    filled = filled.select("lang", "chunk", "length", of_source, "source", none.alias("size"), none.alias("terms"), "places", "counts")
    parts = F.collect_list(F.struct("source", "size", "terms", "places", "counts"))
    return zeros.unionByName(filled).groupBy("lang", "chunk", "length", "tile").agg(parts.alias("columns"))


def runs(length: int, size: int, terms: int, places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal counts begin, and the rate of each; no places stand for zeros only."""
    column = np.zeros(max(length, 1), np.int64)
    column[np.frombuffer(places or b"", "<i4")] = np.frombuffer(counts or b"", "<i8")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1])
    values, which = np.unique(column[starts], return_inverse=True)
    below = size + 2 * terms
    rates = [1 + SCALE * (int(value) + 2) // below if below else 1 for value in values]
    return starts, np.array(rates, np.int64)[which]


def run_divergence(length: int, one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum over the chunk's terms of the gap of two columns, one value for each joint run."""
    starts = np.union1d(one[0], other[0])
    p, q = (rates[np.searchsorted(begins, starts, "right") - 1] for begins, rates in (one, other))
    return int(((p - q) ** 2 // (p + q) * np.diff(np.append(starts, length))).sum())


def pair_sums(tiled: DataFrame) -> DataFrame:
    """(lang, a, b, value) for each two sources a < b of a language: the sum of their gaps over its kept terms."""

    def decode(length: int, columns: list[dict]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        merged: dict = {}
        for column in columns:
            merged.setdefault(column["source"], {}).update({name: value for name, value in column.items() if value is not None})
        return {name: runs(length, part["size"], part["terms"], part.get("places"), part.get("counts")) for name, part in merged.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def handed_on() -> pa.RecordBatch:
            arrays = [pa.array([key[i] for key in sums], pa.string()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums.values()), pa.int64())], ["lang", "a", "b", "value"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                lang, length = row["lang"], row["length"]
                left = decode(length, row["left"])
                right = left if row["same"] else decode(length, row["right"])
                for a in left:
                    for b in right:
                        if a < b or not row["same"]:
                            key = (lang, *sorted((a, b), key=str.encode))
                            sums[key] = sums.get(key, 0) + run_divergence(length, left[a], right[b])
                    if len(sums) > HELD:
                        yield handed_on()
                        sums.clear()
        if sums:
            yield handed_on()

    one = tiled.select("lang", "chunk", "length", F.col("tile").alias("x"), F.col("columns").alias("left"))
    other = tiled.select("lang", "chunk", F.col("tile").alias("y"), F.col("columns").alias("right"))
    # The right side of a tile with itself is not sent a second time.
    met = one.join(other, ["lang", "chunk"]).where("x <= y")
    same = F.col("x") == F.col("y")
    met = met.select("lang", "length", "left", same.alias("same"), F.when(~same, F.col("right")).alias("right"))
    return met.mapInArrow(add, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pair_part(sums: DataFrame) -> DataFrame:
    """Every other source of the language, by falling divergence."""
    ends = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))])
    found = sums.select("lang", F.explode(ends).alias("end"), "value").select("lang", "end.source", "end.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order))


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    chunk_terms: int = CHUNK_TERMS,
    tile_sources: int = TILE_SOURCES,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): for each source the other sources of its language, and its leading terms.

    Terms are runs of letters A-Z, lower-cased, and characters beyond ASCII; a language keeps those in at least
    `least_docs` of its documents. With n occurrences of a term in a group (or language) of `size` kept occurrences and
    `terms` kept terms its rate is 1 + floor(10^9 (n + 2) / (size + 2 terms)); two rates differ by
    floor((p - q)^2 / (p + q)). Part `pair` has every other source of the language with the sum over all kept terms,
    part `term` the `top` terms that the source uses and has at a higher rate than the language. Equal values are
    ranked by item in the order of its UTF-8 bytes.

    Null text, lang and source are ''. A source without terms takes part in all pairs; where a language keeps no term all
    its pairs have value 0 and there are no terms; a language of one source has no pairs. Repeated rows count each time, very long texts are
    read in blocks, other columns are ignored, and an empty table gives no rows.
    """
    counts = durable(term_counts(docs, lang, source, text), "term-counts")
    kept = durable(vocabulary(counts, least_docs), "vocabulary")
    groups = durable(group_sizes(counts, kept), "groups")
    columns = durable(chunks(kept, chunk_terms), "chunks")
    tiled = durable(tiles(columns, groups, tile_sources), "tiles")
    names = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_part(pair_sums(tiled)).withColumn("part", F.lit("pair")).select(*names)
    terms = term_part(kept, groups, top).withColumn("part", F.lit("term")).select(*names)
    return pairs.unionByName(terms)
