"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

Every benchmark item is cut into windows (the whole item where it is short). If a window of m bytes
stands in a text with at most e edits, then text and window share at least m - q + 1 - q*e q-grams, all
on diagonals (text position minus item position) at most e apart. Diagonals are cut into bands that
overlap by half, so one band holds all of them. Shared q-grams are counted by window and band, bands that
reach the bound are aligned, and those within the edit budget are reported.

Long windows stand at every STEP bytes and bear EDIT_RATE of their length in edits. Besides, passages of PASSAGE bytes are
searched at every byte of an item with the same rate, so any PASSAGE consecutive bytes are found, wherever they begin.
Their windows are made only around shared q-grams, so the index has one entry for each byte of the benchmark.

Texts are compared in lower case, with each white space character as a blank, by UTF-8 bytes. The
benchmark is handled in blocks of bounded size, each of which is broadcast and meets every document.
"""

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

Q = 16
WINDOW = 160
STEP = 80
PASSAGE = 64  # about 12 words
EDIT_RATE = 0.05
BLOCK_BYTES = 512 << 10
PIECE_BYTES = 1 << 20
SEPARATOR = bytes(Q)
HITS_AT_ONCE = 1 << 20
FILTER_BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
FAR = np.int32(1 << 20)

FOUND = pa.list_(
    pa.struct([("item_id", pa.int64()), ("windows", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("edits", pa.int64())])
)
FOUND_DDL = "array<struct<item_id:long,windows:long,first_byte:long,end_byte:long,edits:long>>"


def normalise(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(BLANKS)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 16 bytes at each position."""
    size = len(data) - Q + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    words = np.empty(len(data) - 7, np.uint64)
    for shift in range(8):
        part = data[shift : shift + (len(data) - shift) // 8 * 8]
        words[shift::8] = np.ascontiguousarray(part).view("<u8")
    left, right = words[:size] * MIX[0], words[8 : 8 + size] * MIX[1]
    left ^= left >> np.uint64(29)
    left += right
    left *= MIX[1]
    return left ^ (left >> np.uint64(32))


@dataclass
class Window:
    item: int
    start: int
    text: bytes
    budget: int
    bound: int


class Index:
    """Windows and q-grams of a block of benchmark items (item_id, normalised text)."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.windows: list[Window] = []
        hashes, owners, places = [], [], []
        for item, text in items:
            size = min(WINDOW, len(text))
            if size < Q:
                continue
            budget = min(int(EDIT_RATE * size), (size - Q) // Q)
            starts = sorted({*range(0, len(text) - size + 1, STEP), len(text) - size})
            own = grams(np.frombuffer(text, np.uint8))
            for start in starts:
                count = size - Q + 1
                hashes.append(own[start : start + count])
                owners.append(np.full(count, len(self.windows), np.int64))
                places.append(np.arange(count, dtype=np.int64))
                self.windows.append(Window(item, start, text[start : start + size], budget, count - Q * budget))
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owners = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.distinct, self.first = np.unique(self.hashes, return_index=True)
        self.counts = np.diff(np.append(self.first, len(self.hashes)))
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.bounds = np.array([window.bound for window in self.windows], np.int64)
        self.budgets = np.array([window.budget for window in self.windows], np.int64)
        self.least = int(self.bounds.min()) if len(self.bounds) else 0
        self.reach = WINDOW + int(self.budgets.max()) if len(self.bounds) else 0

    def item(self, window: int) -> int:
        return self.windows[window].item

    def search(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, first byte, end byte, edits) of every band that holds a window within its budget."""
        hashes = grams(data)
        if not len(hashes) or not self.windows:
            return []
        hit = self.present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
        # A region needs `least` hits within `reach` bytes; positions without are out before any look-up.
        places = np.flatnonzero(hit)
        if len(places) < self.least:
            return []
        if self.least > 1:
            near = np.flatnonzero(places[self.least - 1 :] - places[: len(places) - self.least + 1] <= self.reach)
            mark = np.zeros(len(places) + 1, np.int64)
            mark[near] += 1
            mark[near + self.least] -= 1
            places = places[np.cumsum(mark[:-1]) > 0]
        wanted = hashes[places]
        at = np.minimum(np.searchsorted(self.distinct, wanted), len(self.distinct) - 1)
        real = self.distinct[at] == wanted
        at, places = at[real], places[real]
        if not len(at):
            return []
        rows = len(data) + 2 * WINDOW
        keys, counts = self._count(at, places, rows)
        window, band = keys // rows, keys % rows
        full = counts >= self.bounds[window]
        return self._verify(data, window[full], band[full])

    def _count(self, at: np.ndarray, places: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Shared q-grams by window and band (window * rows + band), with bounded memory for frequent q-grams."""
        ends = np.cumsum(self.counts[at])
        keys, totals, start = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while start < len(at):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + HITS_AT_ONCE, "right")))
            counts = self.counts[at[start:stop]]
            offsets = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            entry = np.repeat(self.first[at[start:stop]], counts) + offsets
            window = self.owners[entry]
            band = (np.repeat(places[start:stop], counts) - self.places[entry] + WINDOW) // (self.budgets[window] + 1)
            new = np.concatenate((window * rows + band, (window * rows + band - 1)[band > 0]))
            new, found = np.unique(new, return_counts=True)
            keys, inverse = np.unique(np.concatenate((keys, new)), return_inverse=True)
            totals = np.bincount(inverse, np.concatenate((totals, found)), len(keys)).astype(np.int64)
            start = stop
        return keys, totals

    def _verify(self, data, window, band) -> list[tuple[int, int, int, int]]:
        """Aligns the bands; neighbouring bands find one place twice, its end tells."""
        found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        sizes = np.array([len(self.windows[w].text) for w in window], np.int64)
        step = self.budgets[window] + 1
        for size in np.unique(sizes).tolist():
            group = np.flatnonzero(sizes == size)
            for k in range(0, len(group), 4096):
                own = group[k : k + 4096]
                pattern = np.frombuffer(b"".join(self.windows[w].text for w in window[own]), np.uint8).reshape(len(own), size)
                edits, ends = banded(data, band[own] * step[own] - WINDOW, pattern, 2 * int(step[own[0]]))
                for w, distance, end in zip(window[own].tolist(), edits.tolist(), ends.tolist()):
                    if distance <= self.budgets[w] and (w, end) not in found:
                        found[w, end] = (w, max(0, end - size - distance), end, distance)
        return list(found.values())


class Passages:
    """An index whose windows are those of Index and, numbered after them, the passages at every byte of the items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.fixed = Index(items)
        items = [(item, text) for item, text in items if len(text) >= Q]
        lengths = np.array([len(text) for _, text in items], np.int64)
        starts = np.cumsum(lengths) - lengths
        self.items = [item for item, _ in items]
        self.text = np.frombuffer(b"".join(text for _, text in items), np.uint8)
        self.owners = np.repeat(np.arange(len(items)), lengths)
        self.sizes = np.minimum(PASSAGE, lengths)
        self.budgets = np.minimum((EDIT_RATE * self.sizes).astype(np.int64), (self.sizes - Q) // Q)
        self.bounds = self.sizes - Q + 1 - Q * self.budgets
        self.low, self.high = starts, starts + lengths - self.sizes
        hashes = [grams(np.frombuffer(text, np.uint8)) for _, text in items]
        places = [start + np.arange(len(own)) for start, own in zip(starts, hashes)]
        hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.places = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.distinct, self.first, self.counts = np.unique(hashes[order], return_index=True, return_counts=True)
        self.present = np.zeros(1 << FILTER_BITS, bool)
        self.present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def item(self, window: int) -> int:
        fixed = len(self.fixed.windows)
        return self.fixed.item(window) if window < fixed else self.items[self.owners[window - fixed]]

    def search(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """As Index.search, with the passages."""
        hashes = grams(data)
        places = np.flatnonzero(self.present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(places) or not len(self.distinct):
            return []
        wanted = hashes[places]
        at = np.minimum(np.searchsorted(self.distinct, wanted), len(self.distinct) - 1)
        real = self.distinct[at] == wanted
        if not real.any():
            return []
        return self.fixed.search(data) + self._passages(data, at[real], places[real])

    def _passages(self, data: np.ndarray, at: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int]]:
        width = len(self.text)
        ends = np.cumsum(self.counts[at])
        keys, totals, start = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while start < len(at):  # shared q-grams by band and place in the items
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HITS_AT_ONCE, "right")))
            counts = self.counts[at[start:stop]]
            entry = np.repeat(self.first[at[start:stop]] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            own = self.places[entry]
            band = (np.repeat(places[start:stop], counts) - own + width) // (self.budgets[self.owners[own]] + 1)
            new, found = np.unique(np.concatenate((band * width + own, ((band - 1) * width + own)[band > 0])), return_counts=True)
            keys, inverse = np.unique(np.concatenate((keys, new)), return_inverse=True)
            totals = np.bincount(inverse, np.concatenate((totals, found)), len(keys)).astype(np.int64)
            start = stop
        before = np.concatenate(([0], np.cumsum(totals)))
        found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for k in range(0, len(keys), HITS_AT_ONCE // PASSAGE):
            part = keys[k : k + HITS_AT_ONCE // PASSAGE]
            band, place = part // width, part % width
            owner = self.owners[place]
            first, last = np.maximum(self.low[owner], place - self.sizes[owner] + Q), np.minimum(self.high[owner], place)
            counts = last - first + 1
            window = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            pairs = np.unique(np.repeat(band, counts) * width + window)
            owner = self.owners[pairs % width]
            shared = before[np.searchsorted(keys, pairs + self.sizes[owner] - Q, "right")] - before[np.searchsorted(keys, pairs)]
            self._align(data, pairs[shared >= self.bounds[owner]], found)
        return list(found.values())

    def _align(self, data: np.ndarray, pairs: np.ndarray, found: dict) -> None:
        width, fixed = len(self.text), len(self.fixed.windows)
        band, window = pairs // width, pairs % width
        owner = self.owners[window]
        for size in np.unique(self.sizes[owner]).tolist():
            group = np.flatnonzero(self.sizes[owner] == size)
            budget = int(self.budgets[owner[group[0]]])
            for k in range(0, len(group), 4096):
                own = group[k : k + 4096]
                pattern = self.text[window[own, None] + np.arange(size)]
                edits, ends = banded(data, band[own] * (budget + 1) - width + window[own], pattern, 2 * (budget + 1))
                for w, distance, end in zip(window[own].tolist(), edits.tolist(), ends.tolist()):
                    if distance <= budget and (w, end) not in found:
                        found[w, end] = (fixed + w, max(0, end - size - distance), end, distance)


def banded(data: np.ndarray, lowest: np.ndarray, pattern: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Edits of each pattern against the text on the diagonals from `lowest` on, and where it ends there.

    Column c of row i stands for text position lowest + i + c; the pattern may begin and end at any of
    the band's diagonals. Positions outside the text match nothing.
    """
    rows, size = pattern.shape
    columns = np.arange(width, dtype=np.int64)
    inside = (lowest[:, None] + columns >= 0) & (lowest[:, None] + columns <= len(data))
    cost = np.where(inside, 0, FAR).astype(np.int32)
    ramp = np.arange(width, dtype=np.int32)
    for i in range(size):
        at = lowest[:, None] + i + columns
        valid = (at >= 0) & (at < len(data))
        equal = valid & (data[np.clip(at, 0, len(data) - 1)] == pattern[:, i, None])
        replaced = cost + np.where(equal, 0, np.where(valid, 1, FAR)).astype(np.int32)
        cost[:, :-1], cost[:, -1] = cost[:, 1:] + 1, FAR  # a pattern byte that the text lacks
        # Then text bytes that the pattern lacks: from the column before, any number of times.
        cost = np.minimum(np.minimum(replaced, cost), FAR) - ramp
        cost = np.minimum.accumulate(cost, axis=1) + ramp
    best = cost.argmin(axis=1)
    return cost[np.arange(rows), best], lowest + size + best


def _pieces(texts: list[bytes]):
    """Joined texts of bounded size: (bytes, [(row, offset in the row's text, start in the piece)])."""
    parts, places, size = [], [], 0
    overlap = 2 * WINDOW
    for row, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - overlap), PIECE_BYTES):
            part = text[offset : offset + PIECE_BYTES + overlap]
            places.append((row, offset, size))
            parts += [part, SEPARATOR]
            size += len(part) + len(SEPARATOR)
            if size >= PIECE_BYTES:
                yield b"".join(parts), places
                parts, places, size = [], [], 0
    if parts:
        yield b"".join(parts), places


def matches(index: Index | Passages, texts: list[bytes]) -> list[list[dict]]:
    """Per text, one entry for each benchmark item found: places of its windows, their extent, fewest edits."""
    found: list[dict[int, set]] = [{} for _ in texts]
    for data, places in _pieces(texts):
        starts = np.array([start for _, _, start in places])
        for window, first, end, edits in index.search(np.frombuffer(data, np.uint8)):
            row, offset, start = places[int(np.searchsorted(starts, end - 1, "right")) - 1]
            item = index.item(window)
            found[row].setdefault(item, set()).add((window, max(0, first - start) + offset, end - start + offset, edits))
    return [
        [
            {"item_id": item, "windows": len(own), "first_byte": min(x[1] for x in own), "end_byte": max(x[2] for x in own), "edits": min(x[3] for x in own)}
            for item, own in sorted(items.items())
        ]
        for items in found
    ]


_indexes: dict[str, Passages] = {}


def _index(key: str, items: list[tuple[int, bytes]]) -> Passages:
    """The index of a block, built once per Python worker; only the last block is kept."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Passages(items)
    return _indexes[key]


def blocks(benchmark: DataFrame, item: str, text: str):
    """Items (id, normalised text) in blocks of BLOCK_BYTES; one block at a time is on the driver. Null ids or texts are left out."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row.item, normalise(row.text)))
        size += len(block[-1][1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", result: str = "leaks", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds an array with one struct per benchmark item of which the text holds a window or a passage (the whole item if short).

    Byte positions count in the normalised text; `first_byte` may be too small by the number of edits. Null and
    empty texts hold nothing; items of fewer than 16 bytes are too short to be told from chance and are not
    searched. Texts of any length are searched whole, in overlapping pieces. Rows, repeated ones too, and other columns
    stay; a column that already has the result's name is replaced. An empty table stays empty, an empty benchmark finds
    nothing.
    """
    parts = []
    for block in blocks(benchmark, item, item_text):
        search = _search(docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex)
        parts.append(search(F.col(text)))
    return docs.withColumn(result, F.concat(*parts) if parts else F.array().cast(FOUND_DDL))


def _search(shared, key: str):
    @arrow_udf(FOUND_DDL)
    def run(column: pa.Array) -> pa.Array:
        index = _index(key, shared.value)
        return pa.array(matches(index, [normalise(value.as_py() or "") for value in column]), FOUND)

    return run
