"""Byte-level BPE encoding and decoding with a public tokenizer file.

A text is cut into chunks (white space, or a run of other characters with one space before it), then by
the tokenizer's own pattern into pre-tokens. Each pre-token is a doubly linked list of symbols; a
priority queue holds the ranks of adjacent pairs, and entries whose symbols have changed meanwhile are
skipped when they come up. Results are kept per chunk in a cache of bounded size, since words recur.
"""

import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spendframe.llm.common import joined

# Unicode white space, and the splitting pattern of the byte-level tokenizers.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CACHE_ENTRIES = 500_000
CACHED_CHARS = 64


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [byte for byte in range(256) if byte not in plain]
    return {byte: chr(byte) for byte in plain} | {byte: chr(256 + i) for i, byte in enumerate(shifted)}


class Codec:
    """Encoder and decoder for one vocabulary file (JSON of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        characters = byte_characters()
        to_byte = {character: byte for byte, character in characters.items()}
        vocabulary = spec["model"]["vocab"]
        self.byte_ids = [vocabulary[characters[byte]] for byte in range(256)]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocabulary[left] << 32 | vocabulary[right]] = rank
            self.merged.append(vocabulary[left + right])
        self.pieces = [b""] * (1 + max([*vocabulary.values(), *(token["id"] for token in spec["added_tokens"])]))
        for token, number in vocabulary.items():
            self.pieces[number] = bytes(to_byte[character] for character in token)
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        for content, number in self.special.items():
            self.pieces[number] = content.encode()
        longest = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.packed = _Cache(self._packed)

    def merge(self, token: bytes) -> list[int]:
        """Ids of one pre-token. Queue entries hold a pair's rank above its place; the rank tells stale ones."""
        symbols = [self.byte_ids[byte] for byte in token]
        size = len(symbols)
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        rank_of, merged = self.ranks.get, self.merged
        push, pop = heapq.heappush, heapq.heappop
        queue = []
        for at in range(size - 1):
            rank = rank_of(symbols[at] << 32 | symbols[at + 1])
            if rank is not None:
                queue.append(rank << 32 | at)
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            rank, at = entry >> 32, entry & 0xFFFFFFFF
            right = after[at]
            if right < 0 or symbols[at] < 0 or rank_of(symbols[at] << 32 | symbols[right]) != rank:
                continue
            symbol = symbols[at] = merged[rank]
            symbols[right] = -1
            right = after[at] = after[right]
            if right >= 0:
                before[right] = at
                rank = rank_of(symbol << 32 | symbols[right])
                if rank is not None:
                    push(queue, rank << 32 | at)
            left = before[at]
            if left >= 0:
                rank = rank_of(symbols[left] << 32 | symbol)
                if rank is not None:
                    push(queue, rank << 32 | left)
        return [symbol for symbol in symbols if symbol >= 0]

    def _packed(self, chunk: str) -> bytes:
        """Packed ids of a chunk; letters with at most one space before them are one pre-token."""
        if not (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            tokens = PRETOKEN.findall(chunk)
            if len(tokens) > 1:
                return b"".join(map(self.packed.__getitem__, tokens))
        ids = self.merge(chunk.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.special_pattern is None:
            return self._plain(text)
        parts = self.special_pattern.split(text)
        if len(parts) == 1:
            return self._plain(text)
        return b"".join(np.array([self.special[part]], "<u4").tobytes() if i % 2 else self._plain(part) for i, part in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, (match.group() for match in CHUNK.finditer(text)) if len(text) > 1 << 22 else CHUNK.findall(text)))

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Cache(dict):
    """Remembers results of `make` for short keys. A full cache becomes the older half, which is looked up before it goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker and file, so that its cache serves all of the worker's tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds a binary column of packed little-endian unsigned 32-bit ids. A null text counts as empty.

    `path` is a vocabulary file that every executor can open. All other columns and rows, repeated ones too, stay;
    a column of the new name is replaced. Very long texts are encoded whole. An empty table stays empty.
    """

    @arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        own = codec(path)
        return joined((own.encode(value.as_py() or "") for value in column), pa.binary())

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text that packed ids stand for; null ids give an empty text. A column of the new name is replaced."""

    @arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        own = codec(path)
        return joined((own.decode(value.as_py() or b"").encode() for value in column), pa.string())

    return docs.withColumn(text, run(F.col(ids)))
