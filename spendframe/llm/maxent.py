"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class). The class of the next word is a
softmax over weights of hashed features of the history: the word before, the words two and three back
(skips), and the pair before. The most frequent words and the end of a text are classes of their own, other words
fall into classes by their last two bytes. Inside a class a word has its smoothed share of the
class's count, which is the maximum-entropy solution for word indicators alone.

These weights have a fixed number of rows. They are the prior of history counts that have none: every
distinct pair and triple of words of the learning texts is counted by a 48-bit hash, and the prior is drawn
towards the share of the word after the word before, then after the pair before (Dirichlet smoothing, so
probabilities still sum to one). The pairs and triples of a block go to range buckets of the hash, as many as there
are blocks, as packed sorted arrays; a bucket adds up the counts and returns those that each block asked for.

Texts are cut into blocks; a block is stored as one row with its own vocabulary and the texts as numbers
into it, so everything after works on numpy arrays. Counts are summed over all blocks by word hash.
Training goes over all learning texts in rounds; in each, every task runs minibatch updates from the
shared weights, and the changes are averaged by feature over the tasks in a tree of group-bys. For
scoring, each block gets the counts of its vocabulary as it gets those of its pairs and triples, and meets them in a co-group.

A word is known by the 64-bit hash of its bytes.
"""

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm.common import text_pieces
from spendframe.session import durable, new_path

BLOCK_BYTES = 16 << 20
TOP_WORDS, SUFFIX_CLASSES = 11, 52
CLASSES = 1 + TOP_WORDS + SUFFIX_CLASSES
BUCKET_BITS = 13
FEATURES = 4
ROUNDS, BATCH, RATE = 2, 4096, 1.0
END, START = -1, 0  # hashes of the end of a text and of the places before its first word
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
PRIORS = {2: 8.0, 3: 8.0}  # weight of the shorter history, by words of the counted group
SHORT_RUN = 8
SHARE_ROWS = 512  # feature rows that travel together when changes are averaged

BLOCK_DDL = "block long, doc_ids array<{id}>, learn array<boolean>, lengths array<long>, tokens binary, hashes binary, suffixes binary, counts binary"


def pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Unsigned numbers, of 32 bits unless said otherwise, as compressed planes of bytes; most of the high ones are zero."""
    width = np.dtype(kind).itemsize
    return zstandard.compress(values.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes(), 3)


def unpack(packed: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _BlockBuilder:
    """Texts of one block: distinct words get numbers in the order they appear, the end of a text is 0."""

    def __init__(self):
        self.ids, self.learn, self.pieces, self.owners, self.size = [], [], [], [], 0

    def add(self, doc_id, learn: bool, text: bytes) -> None:
        for piece in text_pieces(text):
            self.pieces.append(piece)
            self.owners.append(len(self.ids))
        self.ids.append(doc_id)
        self.learn.append(learn)
        self.size += len(text)

    def _tokens(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(numbers, lengths by text, words): the empty word stands for the end, others are numbered from 1."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(self.pieces, pa.binary()).view(pa.string()))) if self.pieces else pa.array([], pa.list_(pa.string()))
        words = split.flatten()
        owners = np.repeat(np.array(self.owners, np.int64), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        real = pc.not_equal(pc.binary_length(words), 0)  # white space at either end leaves empty words
        owners, coded = owners[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()
        lengths = np.bincount(owners, minlength=len(self.ids)) + 1
        tokens = np.zeros(len(owners) + len(self.ids), np.uint32)
        tokens[np.arange(len(owners)) + owners] = coded.indices.to_numpy().astype(np.uint32) + 1
        return tokens, lengths, coded.dictionary

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        tokens, lengths, words = self._tokens()
        used = np.repeat(np.array(self.learn), lengths)
        words = [b"", *words.cast(pa.binary()).to_pylist()]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
        hashes[(hashes == END) | (hashes == START)] = 1
        hashes[0] = END
        suffixes = np.fromiter((zlib.crc32(word[-2:]) % SUFFIX_CLASSES for word in words), np.uint8, len(words))
        counts = np.bincount(tokens[used], minlength=len(words)).astype(np.uint32)
        columns = [
            pa.array([number], pa.int64()),
            pa.array([self.ids], pa.list_(id_type)),
            pa.array([self.learn], pa.list_(pa.bool_())),
            pa.array([lengths.tolist()], pa.list_(pa.int64())),
            *(pa.array([values], pa.binary()) for values in (pack(tokens), hashes.tobytes(), suffixes.tobytes(), counts.tobytes())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "learn", "lengths", "tokens", "hashes", "suffixes", "counts"])


def blocks(docs: DataFrame, learn: Column, id: str, text: str) -> DataFrame:
    """Stored blocks of about BLOCK_BYTES of text, one row each; a longer text has a block of its own."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, block, id_type = TaskContext.get().partitionId() << 32, _BlockBuilder(), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, use, value in zip(*(batch.column(k) for k in range(3))):
                value = (value.as_py() or "").encode()
                if block.size and block.size + len(value) > BLOCK_BYTES:
                    yield block.row(number, id_type)
                    number, block = number + 1, _BlockBuilder()
                block.add(doc_id.as_py(), use.as_py(), value)
        if block.ids:
            yield block.row(number, id_type)

    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    return _bucketed(rows.mapInArrow(build, BLOCK_DDL.format(id=rows.schema["doc_id"].dataType.simpleString())), "block", "maxent-blocks")


def _bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like `durable`, with the rows in buckets of `key`, so that a co-group by it moves only its other side.

    The table's name is needed while it is written only; its files are in the shared folder.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    name = re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def word_counts(stored: DataFrame) -> DataFrame:
    """Stored (hash, suffix, c) of all words in learning texts, the end of texts included."""

    def seen_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, suffixes, counts in zip(*(batch.column(k) for k in range(3))):
                counts = np.frombuffer(counts.as_py(), np.uint32)
                seen = np.flatnonzero(counts)
                arrays = [np.frombuffer(hashes.as_py(), np.int64)[seen], np.frombuffer(suffixes.as_py(), np.uint8)[seen].astype(np.int32), counts[seen].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["hash", "suffix", "c"])

    rows = stored.select("hashes", "suffixes", "counts").mapInArrow(seen_words, "hash long, suffix int, c long")
    return durable(rows.groupBy("hash").agg(F.first("suffix").alias("suffix"), F.sum("c").alias("c")), "maxent-counts")


@dataclass
class Vocabulary:
    """What all blocks need of the counts: their totals, by class too, and the most frequent words."""

    tokens: int
    kinds: int
    top: np.ndarray  # hashes, most frequent first
    class_tokens: np.ndarray
    class_kinds: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> "Vocabulary":
        words = counts.where(F.col("hash") != END)
        top = np.array([row["hash"] for row in words.orderBy(F.desc("c"), "hash").limit(TOP_WORDS).collect()], np.int64)
        sums = counts.groupBy(F.when(F.col("hash") == END, 0).when(F.col("hash").isin(top.tolist()), 1).otherwise(2).alias("kind"), "suffix")
        class_tokens, class_kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        rows = sums.agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
        for row in rows:
            if row["kind"] == 2:
                class_tokens[1 + TOP_WORDS + row["suffix"]], class_kinds[1 + TOP_WORDS + row["suffix"]] = row["c"], row["n"]
        return cls(sum(row["c"] for row in rows), sum(row["n"] for row in rows), top, class_tokens, class_kinds)

    def classes(self, hashes: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        found = 1 + TOP_WORDS + suffixes.astype(np.int64)
        for number, value in enumerate(self.top):
            found[hashes == value] = 1 + number
        found[hashes == END] = 0
        return found

    def inside(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; an unseen word has half a count, as in the base score."""
        share = (counts + 0.5) / (self.class_tokens[classes] + 0.5 * (self.class_kinds[classes] + 1))
        return np.where(classes <= TOP_WORDS, 0.0, np.log10(share))


def words_back(keys: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """The key of the word so many places before each token, START where the text has none."""
    before = np.full(len(keys), np.uint64(START))
    inside = np.flatnonzero(np.arange(len(keys)) - starts >= distance)
    before[inside] = keys[inside - distance]
    return before


def gram_names(keys: np.ndarray, starts: np.ndarray, kind: int) -> np.ndarray:
    """A 48-bit hash of each token with the kind - 1 words before it."""
    names = np.full(len(keys), np.uint64(kind))
    for distance in range(kind - 1, -1, -1):
        names ^= words_back(keys, starts, distance) if distance else keys
        names *= MIX[distance]
        names ^= names >> np.uint64(29)
        names *= MIX[3]
        names ^= names >> np.uint64(32)
    return names >> np.uint64(16)


def _counted(names: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct names in order, and how often each stands where `learn` is true."""
    ordered = names << np.uint64(1) | learn.view(np.uint8)  # a plain sort takes a fraction of one that keeps the places
    ordered.sort()
    names = ordered >> np.uint64(1)
    edges = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    seen = np.concatenate(([0], np.cumsum(ordered & np.uint64(1), dtype=np.int64)))
    return names[edges], np.diff(seen[np.append(edges, len(names))])


def _places(names: np.ndarray) -> np.ndarray:
    """The place of each 48-bit name among the distinct ones in order.

    Names are hashes and so lie evenly: a table by their leading bits tells nearly the place, and a few steps lead to it.
    """
    distinct = np.sort(names)
    distinct = distinct[np.concatenate(([True], distinct[1:] != distinct[:-1]))]
    shift = np.uint64(max(0, 48 - len(distinct).bit_length() - 1))
    heads = distinct >> shift
    first = np.searchsorted(heads, np.arange(int(heads[-1]) + 1, dtype=np.uint64)).astype(np.int32)
    places = first[names >> shift]
    left = np.flatnonzero(distinct[places] != names)
    while len(left):
        places[left] += 1
        left = left[distinct[places[left]] != names[left]]
    return places


def _slices(names: np.ndarray, buckets: int, bits: int = 48) -> np.ndarray:
    """Borders of the buckets in sorted names."""
    return np.searchsorted((names >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def pack_names(names: np.ndarray) -> bytes:
    """Sorted names as compressed planes of bytes of their differences."""
    return zstandard.compress(np.diff(names, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_names(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def gram_counts(stored: DataFrame, kinds: Iterable[int] = PRIORS) -> DataFrame:
    """(block, kind, bucket, counts): over all learning texts, those of the block's distinct names in sorted order.

    The names of kind 1, single words, are the hashes of the block's vocabulary, and their counts have 64 bits.
    """
    kinds = list(kinds)
    buckets = max(1, stored.count())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1).to_pylist()[0]
                tokens, hashes, _, lengths, firsts = _texts(block)
                keys, starts = hashes.view(np.uint64)[tokens], np.repeat(firsts, lengths)
                learn = np.repeat(np.array(block["learn"], bool), lengths)
                for kind in kinds:
                    if kind == 1:
                        names, places = np.unique(hashes.view(np.uint64), return_inverse=True)
                        counts = np.bincount(places, np.frombuffer(block["counts"], np.uint32), len(names))
                    else:
                        names, counts = _counted(gram_names(keys, starts, kind), learn)
                    edges = _slices(names, buckets, 64 if kind == 1 else 48)
                    own = [k for k in range(buckets) if edges[k] < edges[k + 1]]
                    arrays = [pa.array([value] * len(own), type) for value, type in ((block["block"], pa.int64()), (kind, pa.int32()))]
                    arrays.append(pa.array(own, pa.int32()))
                    arrays.append(pa.array([pack_names(names[edges[k] : edges[k + 1]]) for k in own], pa.binary()))
                    arrays.append(pa.array([pack(counts[edges[k] : edges[k + 1]]) for k in own], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "kind", "bucket", "names", "counts"])

    def add_up(rows: pa.Table) -> pa.Table:
        parts = [unpack_names(x.as_py()) for x in rows.column("names")]
        names, places = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(places, np.concatenate([unpack(x.as_py()) for x in rows.column("counts")]), len(names)).astype(np.int64)
        asked = np.split(places, np.cumsum([len(part) for part in parts])[:-1])
        size = "<u8" if rows.column("kind")[0].as_py() == 1 else "<u4"
        return rows.select(["block", "kind", "bucket"]).append_column("counts", pa.array([pack(total[part], size) for part in asked], pa.binary()))

    sent = stored.select("block", "learn", "lengths", "tokens", "hashes", "suffixes", "counts").mapInArrow(send, "block long, kind int, bucket int, names binary, counts binary")
    return sent.groupBy("kind", "bucket").applyInArrow(add_up, "block long, kind int, bucket int, counts binary")


def word_totals(block: dict, found: dict[int, bytes]) -> np.ndarray:
    """The count of every word of a block's vocabulary. `found` has the packed counts by bucket."""
    _, places = np.unique(np.frombuffer(block["hashes"], np.uint64), return_inverse=True)
    return np.concatenate([unpack(packed, "<u8") for _, packed in sorted(found.items())]).astype(np.int64)[places]


def token_grams(block: dict, found: dict[int, dict[int, bytes]]) -> dict[int, np.ndarray]:
    """For each kind, the count of every token's group of words. `found` has the packed counts by kind and bucket."""
    tokens, hashes, _, lengths, firsts = _texts(block)
    keys, starts = hashes.view(np.uint64)[tokens], np.repeat(firsts, lengths)
    result = {}
    for kind in PRIORS:
        counts = np.concatenate([unpack(packed) for _, packed in sorted(found[kind].items())])
        result[kind] = counts[_places(gram_names(keys, starts, kind))]
    return result


def feature_rows(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Weight rows (token x FEATURES) of the histories of a run of texts; `starts` has the first token of each token's text."""
    one, two, three = (words_back(keys, starts, distance) for distance in (1, 2, 3))
    parts = [one * MIX[0], two * MIX[1], three * MIX[2], (one * MIX[3] ^ (two >> np.uint64(7))) * MIX[0]]
    rows = [((part ^ (part >> np.uint64(31))) * MIX[(k + 1) % 4]) >> np.uint64(64 - BUCKET_BITS) for k, part in enumerate(parts)]
    return np.column_stack(rows).astype(np.uint16)


def class_log_odds(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unnormalised log probabilities of the classes (natural logarithm) and the log of their sum."""
    logits = weights.take(rows[:, 0], axis=0)
    for k in range(1, FEATURES):
        logits += weights.take(rows[:, k], axis=0)
    top = logits.max(axis=1)
    shares = logits - top[:, None]
    return logits, top + np.log(np.exp(shares, out=shares).sum(axis=1))


def group_sums(values: np.ndarray, places: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values[places] over the runs that begin at `edges`, as `np.add.reduceat` has them to the last bit.

    That walks down every column of every run, which takes long where most runs are short. So the first, second, ... rows of
    short runs are added for all runs at once, and only long runs are left to it.
    """
    sizes = np.diff(edges, append=len(places))
    sums = values.take(places[edges], axis=0)
    short = np.flatnonzero((sizes > 1) & (sizes <= SHORT_RUN))
    rest, left = values.take(places[edges[short] + 1], axis=0), sizes[short]
    for turn in range(2, SHORT_RUN):
        longer = np.flatnonzero(left > turn)
        rest[longer] += values.take(places[edges[short[longer]] + turn], axis=0)
    sums[short] += rest
    long = np.flatnonzero(sizes > SHORT_RUN)
    if len(long):
        taken = values.take(places[np.repeat(sizes > SHORT_RUN, sizes)], axis=0)
        sums[long] = np.add.reduceat(taken, np.cumsum(sizes[long]) - sizes[long], axis=0)
    return sums


def _texts(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    tokens = unpack(block["tokens"])
    hashes = np.frombuffer(block["hashes"], np.int64)
    lengths = np.array(block["lengths"], np.int64)
    firsts = np.cumsum(lengths) - lengths
    return tokens, hashes, np.frombuffer(block["suffixes"], np.uint8), lengths, firsts


def train_block(weights, squares, changes, seen, block: dict, vocabulary: Vocabulary, turn: int) -> None:
    """Minibatch updates of `weights` from every text that learns and whose number gives `turn`; rates fall by feature row (AdaGrad)."""
    tokens, hashes, suffixes, lengths, firsts = _texts(block)
    chosen = np.array(block["learn"], bool) & (np.arange(len(lengths)) % ROUNDS == turn)
    used = np.flatnonzero(np.repeat(chosen, lengths))
    if not len(used):
        return
    classes = vocabulary.classes(hashes, suffixes)[tokens[used]]
    keys = hashes.view(np.uint64)[tokens[used]]
    sizes = lengths[chosen]
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    for k in range(0, len(used), BATCH):
        low = max(0, k - 3)
        part = slice(k, k + BATCH)
        rows = feature_rows(keys[low : k + BATCH], np.maximum(starts[low : k + BATCH] - low, -3))[k - low :]
        logits, total = class_log_odds(weights, rows)
        error = np.exp(np.subtract(logits, total[:, None], out=logits), out=logits)
        error[np.arange(len(error)), classes[part]] -= 1
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        gradient = group_sums(error, order // FEATURES, edges)
        own = ordered[edges]
        squares[own] += np.einsum("ij,ij->i", gradient, gradient)
        step = gradient * (RATE / np.sqrt(squares[own]))[:, None]
        weights[own] -= step
        changes[own] -= step
        seen[own] += np.diff(np.append(edges, len(ordered)))


def train(stored: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Weights (2^BUCKET_BITS x CLASSES) after ROUNDS passes that together take each learning text once."""
    spark = stored.sparkSession
    size = 1 << BUCKET_BITS
    weights = np.zeros((size, CLASSES), np.float32)
    wanted = stored.select("learn", "lengths", "tokens", "hashes", "suffixes")
    salts = max(1, math.isqrt(wanted.rdd.getNumPartitions()))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)
        parts = wanted.mapInArrow(_task(shared, vocabulary, turn, salts), "share int, salt int, changes binary, seen binary")
        parts = parts.groupBy("share", "salt").applyInArrow(_add_up, "share int, salt int, changes binary, seen binary")
        parts = parts.withColumn("salt", F.lit(0)).groupBy("share").applyInArrow(_add_up, "share int, salt int, changes binary, seen binary")
        for row in parts.collect():
            part = slice(row["share"] * SHARE_ROWS, (row["share"] + 1) * SHARE_ROWS)
            changes = np.frombuffer(row["changes"], np.float32).reshape(-1, CLASSES)
            weights[part] += changes / np.maximum(np.frombuffer(row["seen"], np.float32), 1)[:, None]
    return weights


def _task(shared, vocabulary: Vocabulary, turn: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weights = shared.value.copy()
        squares, seen = np.full(len(weights), 1.0, np.float32), np.zeros(len(weights), np.float32)
        changes = np.zeros_like(weights)
        for batch in batches:
            for row in range(batch.num_rows):
                train_block(weights, squares, changes, seen, batch.slice(row, 1).to_pylist()[0], vocabulary, turn)
        if not seen.any():
            return
        salt = TaskContext.get().partitionId() % salts
        changes *= seen[:, None]  # the average over tasks weighs each by how often it saw the feature
        for share in range(len(weights) // SHARE_ROWS):
            part = slice(share * SHARE_ROWS, (share + 1) * SHARE_ROWS)
            columns = [pa.array([share], pa.int32()), pa.array([salt], pa.int32()), *(pa.array([x[part].tobytes()], pa.binary()) for x in (changes, seen))]
            yield pa.RecordBatch.from_arrays(columns, ["share", "salt", "changes", "seen"])

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    sums = [np.sum([np.frombuffer(x.as_py(), np.float32) for x in rows.column(name)], axis=0, dtype=np.float64).astype(np.float32) for name in ("changes", "seen")]
    first = rows.slice(0, 1).to_pylist()[0]
    return pa.table([pa.array([first["share"]], pa.int32()), pa.array([first["salt"]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)], names=["share", "salt", "changes", "seen"])


def with_histories(scores: np.ndarray, tokens: np.ndarray, starts: np.ndarray, counts: np.ndarray, grams: dict[int, np.ndarray]) -> np.ndarray:
    """log10 probabilities of the tokens after the prior's have met the counts of their histories."""
    begins = np.arange(len(tokens)) == starts
    texts = counts[0]  # learning texts, since each ends once; so often nothing stands before a token
    pairs = np.where(begins, texts, np.roll(grams[2], 1))
    words = np.where(begins, texts, np.roll(counts[tokens], 1))
    value = 10.0**scores
    for kind, before in ((2, words), (3, pairs)):
        value = (grams[kind] + PRIORS[kind] * value) / (before + PRIORS[kind])
    return np.log10(value)


def score_block(weights: np.ndarray, vocabulary: Vocabulary, block: dict, counts: np.ndarray, grams: dict[int, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Per text: tokens, known tokens, the base score and the model's log10 probability; that of the prior alone without `grams`."""
    tokens, hashes, suffixes, lengths, firsts = _texts(block)
    base = np.log10((counts + 0.5) / (vocabulary.tokens + 0.5 * (vocabulary.kinds + 1)))
    classes = vocabulary.classes(hashes, suffixes)
    inside = vocabulary.inside(classes, counts)
    keys, starts = hashes.view(np.uint64), np.repeat(firsts, lengths)
    scores = np.empty(len(tokens))
    for k in range(0, len(tokens), BATCH):
        low = max(0, k - 3)
        own = tokens[k : k + BATCH]
        rows = feature_rows(keys[tokens[low : k + BATCH]], np.maximum(starts[low : k + BATCH] - low, -3))[k - low :]
        logits, total = class_log_odds(weights, rows)
        scores[k : k + BATCH] = (logits[np.arange(len(own)), classes[own]] - total) / math.log(10) + inside[own]
    if grams is not None:
        scores = with_histories(scores, tokens, starts, counts, grams)
    return {
        "n_tokens": lengths,
        "n_known": np.add.reduceat((counts[tokens] > 0).astype(np.int64), firsts),
        "base_score": np.add.reduceat(base[tokens], firsts),
        "score": np.add.reduceat(scores, firsts),
    }


def score(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs`, learned from the rows where `learn` is true.

    Null texts count as empty: their only token is the end. A null `learn` counts as false; without learning
    rows all words are unknown and the class model is uniform. Repeated rows are scored repeatedly, other columns
    are ignored, an empty table gives no rows.
    """
    stored = blocks(docs, learn, id, text)
    counts = word_counts(stored)
    vocabulary = Vocabulary.of(counts)
    shared = docs.sparkSession.sparkContext.broadcast(train(stored, vocabulary))

    found = gram_counts(stored, (1, *PRIORS))
    id_type = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def apply(block: pa.Table, known: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        packed: dict[int, dict[int, bytes]] = {kind: {} for kind in (1, *PRIORS)}
        for kind, bucket, values in zip(*(known.column(name).to_pylist() for name in ("kind", "bucket", "counts"))):
            packed[kind][bucket] = values
        result = score_block(shared.value, vocabulary, row, word_totals(row, packed[1]), token_grams(row, packed))
        ids = block.column("doc_ids").combine_chunks().values
        total = np.full(len(ids), vocabulary.tokens, np.int64)
        arrays = [ids, result["n_tokens"], result["n_known"], total, result["base_score"], result["score"]]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole = stored.select("block", "doc_ids", "learn", "lengths", "tokens", "hashes", "suffixes")
    return whole.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        apply, f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
