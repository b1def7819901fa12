"""Helpers shared by the operators: input columns, splits of rows, text buffers inside Arrow batches."""

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = re.compile(rb"[\x20\x09-\x0D]")
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def held_out(id_column: str, modulus: int, value: int) -> Column:
    """True for rows that nothing is learned from; a null id is not held out."""
    return F.coalesce(remainder(id_column, modulus) == value, F.lit(False))


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(array: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value, empty for null."""
    for value in array.cast(pa.binary()):
        yield value.as_py() or b""


def joined(parts: Iterable[bytes], kind: pa.DataType) -> pa.Array:
    """A binary or string array of `parts`, each added as it comes: the values are held once, and by nothing that outlives the array."""
    data, ends = bytearray(), [0]
    for part in parts:
        data += part
        ends.append(len(data))
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(data)])


def buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its values (null: empty), without copies of the texts."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole values of about `limit` bytes each; a longer value makes a run of its own."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = max(start + 1, stop)
        yield start, stop
        start = stop


def word_blocks(text: bytes, limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in lists of about `limit` bytes, so that a very long text needs little memory."""
    if len(text) <= limit:
        yield text.split()
        return
    start = 0
    while start < len(text):
        cut = BLANK.search(text, min(len(text), start + limit))
        stop = cut.start() if cut else len(text)
        yield text[start:stop].split()
        start = stop


def text_pieces(text: bytes, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """The text, or of a longer one pieces of about `limit` bytes that end at ASCII white space."""
    start = 0
    while len(text) - start > limit:
        cut = BLANK.search(text, start + limit)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]
