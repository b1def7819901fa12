"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased letters with single blanks between words. Each language's model interpolates the
orders 1 to N; lower orders count in how many contexts a gram continues. The grams of all languages
share one sorted array of 64-bit hashes per order, with a row of log probabilities (one per language)
for each gram and a row of back-off weights for its use as a context. A text gets the language of the
lowest cross-entropy per character. Held-back texts of the sample calibrate the score and the
cross-entropy above which a text is marked as rejected (unlike anything learned).
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

ORDER = 5
FACTOR = np.uint64(0x9E3779B97F4A7C15)
PIECE_CHARS = 1 << 18
CALIBRATION_SHARE = 5  # one in five sampled texts
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
RESULT = pa.struct([("language", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])
RESULT_DDL = "language string, score double, cross_entropy double, rejected boolean"


def codes(text: str) -> np.ndarray:
    """Code points of the lower-case words, blanks between and around; empty without letters."""
    words = LETTERS.findall(text.lower())
    if not "".join(words).isalpha():  # numbers such as fractions and Roman numerals are no digits to the pattern
        words = [part for word in words for part in "".join(c if c.isalpha() else " " for c in word).split()]
    if not words:
        return np.zeros(0, np.uint64)
    return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)


def gram_hashes(values: np.ndarray) -> list[np.ndarray]:
    """For each order n the hash of the n characters that end at each position; blanks stand before the first."""
    values = np.concatenate((np.full(ORDER, 32, np.uint64), values))
    seeds = values * FACTOR
    seeds ^= seeds >> np.uint64(31)
    found = [seeds]
    for _ in range(ORDER - 1):
        before = np.concatenate((seeds[:1], found[-1][:-1]))
        found.append((before * FACTOR) ^ (before >> np.uint64(29)) ^ seeds + np.uint64(1))
    return [hashes[ORDER:] for hashes in found]


class SortedHashes:
    """A sorted array of hashes with the start of each run of equal leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.starts = np.append(self.starts, len(keys)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where absent."""
        found = np.full(len(wanted), -1, np.int32)
        run = (wanted >> self.shift).astype(np.int64)
        at, end = self.starts[run], self.starts[run + 1]
        left = np.arange(len(wanted))
        while True:
            open_ = at < end
            if not open_.all():
                left, at, end = left[open_], at[open_], end[open_]
            if not len(left):
                return found
            hit = self.keys[at] == wanted[left]
            found[left[hit]] = at[hit]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]


@dataclass
class Model:
    languages: list[str]
    tables: list[SortedHashes]  # by order
    logs: list[np.ndarray]  # gram x language, log2 probability
    weights: list[np.ndarray]  # gram x language, log2 back-off weight as a context
    unseen: np.ndarray  # language, log2 probability of a character never seen
    temperature: float = 1.0
    limits: np.ndarray | None = None  # language, highest accepted cross-entropy

    def entropies(self, values: np.ndarray) -> np.ndarray:
        """Bits per character of one text, per language."""
        total = np.zeros(len(self.languages))
        for start in range(0, len(values), PIECE_CHARS):
            lead = min(start, ORDER - 1)
            total += self.log_sum(values[start - lead : start + PIECE_CHARS], np.array([lead]))[0]
        return -total / len(values)

    def log_sum(self, values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Sums of log probabilities from each first position to the next, per language."""
        hashes = gram_hashes(values)
        logs = np.zeros((len(values), len(self.languages)), np.float32)
        left = np.arange(len(values))
        for order in range(ORDER - 1, -1, -1):
            at = self.tables[order].find(hashes[order][left])
            hit = at >= 0
            logs[left[hit]] += self.logs[order][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            if order:
                # The context ends one position earlier; before the first character only blanks stand.
                context = self.tables[order - 1].find(hashes[order - 1][np.maximum(left - 1, 0)])
                known = (context >= 0) & (left > 0)
                logs[left[known]] += self.weights[order - 1][context[known]]
            else:
                logs[left] += self.unseen
        return np.add.reduceat(logs.astype(np.float64), firsts, axis=0)

    def identify(self, texts: list[str]) -> list[dict]:
        """Languages of texts, those without letters `und`; short texts are looked up together."""
        coded = [codes(text) for text in texts]
        results, batch, size = [None] * len(texts), [], 0
        for number, values in enumerate(coded):
            if not len(values) or not self.languages:
                results[number] = {"language": UNDETERMINED, "score": 0.0, "cross_entropy": None, "rejected": True}
            elif len(values) > PIECE_CHARS:
                results[number] = self._verdict(self.entropies(values))
            else:
                batch.append(number)
                size += len(values)
                if size > PIECE_CHARS:
                    self._together(coded, batch, results)
                    batch, size = [], 0
        self._together(coded, batch, results)
        return results

    def _together(self, coded, batch, results):
        if not batch:
            return
        # Blanks between texts, as many as a context is long, make each text begin as if it stood alone.
        gap = np.full(ORDER - 1, 32, np.uint64)
        parts = [part for number in batch for part in (gap, coded[number])]
        lengths = np.array([len(coded[number]) for number in batch])
        firsts = np.cumsum(lengths + ORDER - 1) - lengths
        sums = self.log_sum(np.concatenate(parts), np.ravel(np.column_stack((firsts - ORDER + 1, firsts))))[1::2]
        for number, total, length in zip(batch, sums, lengths):
            results[number] = self._verdict(-total / length)

    def _verdict(self, entropies: np.ndarray) -> dict:
        best = int(entropies.argmin())
        odds = np.exp(-(entropies - entropies[best]) * self.temperature)
        rejected = self.limits is not None and bool(entropies[best] > self.limits[best])
        return {"language": self.languages[best], "score": float(1 / odds.sum()), "cross_entropy": float(entropies[best]), "rejected": rejected}


def _counted(texts: list[np.ndarray]):
    """Per order: distinct grams' hashes, their counts, and the hashes of their contexts and suffixes."""
    gap = np.full(ORDER, 32, np.uint64)
    values = np.concatenate([part for text in texts for part in (gap, text)])
    real = np.concatenate([np.repeat([False, True], (ORDER, len(text))) for text in texts])
    at = np.flatnonzero(real)
    hashes = gram_hashes(values)
    found = []
    for order in range(ORDER):
        keys, first, counts = np.unique(hashes[order][at], return_index=True, return_counts=True)
        place = at[first]
        context = hashes[order - 1][place - 1] if order else np.zeros(len(keys), np.uint64)
        suffix = hashes[order - 1][place] if order else np.zeros(len(keys), np.uint64)
        found.append([keys, counts.astype(np.float64), context, suffix])
    for order in range(ORDER - 1):  # continuations: the distinct longer grams that end in this one
        suffixes, counts = np.unique(found[order + 1][3], return_counts=True)
        place = np.minimum(np.searchsorted(suffixes, found[order][0]), len(suffixes) - 1)
        found[order][1] = np.where(suffixes[place] == found[order][0], counts[place], 1).astype(np.float64)
    return found


def _train(languages: list[str], texts: dict[str, list[np.ndarray]]) -> Model:
    counted = {language: _counted(texts[language]) for language in languages}
    tables, logs, weights = [], [], []
    alphabet = 1 + len(set().union(*(counted[language][0][0].tolist() for language in languages)))
    lower, suffixes_of, start_weights = None, None, None
    for order in range(ORDER):
        keys, first = np.unique(np.concatenate([counted[language][order][0] for language in languages]), return_index=True)
        context = np.concatenate([counted[language][order][2] for language in languages])[first]
        suffix = np.concatenate([counted[language][order][3] for language in languages])[first]
        chance = np.empty((len(keys), len(languages)))
        backoff = np.zeros((1 if not order else len(tables[-1].keys), len(languages)))
        for column, language in enumerate(languages):
            own, counts, contexts, _ = counted[language][order]
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = float(np.clip(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1, 0.9))
            groups, inverse = np.unique(contexts, return_inverse=True)
            total, kinds = np.bincount(inverse, counts), np.bincount(inverse)
            rest = discount * kinds / total
            # Contexts never seen in this language leave everything to the lower order.
            group = np.minimum(np.searchsorted(groups, context), len(groups) - 1)
            share = np.where(groups[group] == context, rest[group], 1.0)
            base = lower[np.searchsorted(tables[-1].keys, suffix), column] if order else 1 / alphabet
            chance[:, column] = share * base
            chance[np.searchsorted(keys, own), column] += np.maximum(counts - discount, 0) / total[inverse]
            if order:
                place = np.searchsorted(tables[-1].keys, groups)
                inside = (place < len(tables[-1].keys)) & (tables[-1].keys[np.minimum(place, len(tables[-1].keys) - 1)] == groups)
                backoff[place[inside], column] = np.log2(rest[inside])
            else:
                backoff[0, column] = np.log2(rest[0] / alphabet)
        if order:
            weights.append(backoff.astype(np.float32))
        else:
            start_weights = backoff[0]
        tables.append(SortedHashes(keys))
        logs.append(np.log2(chance).astype(np.float32))
        lower = chance
    return Model(languages, tables, logs, weights, start_weights.astype(np.float32))


def fit(sample: list[tuple[bytes, str]]) -> Model:
    """Learns from (UTF-8 text, language). Texts without letters and languages without texts are left out."""
    coded = [(codes(text.decode("utf-8", "replace")), language) for text, language in sample]
    coded = [(values, language) for values, language in coded if len(values)]
    languages = sorted({language for _, language in coded})
    if not languages:
        return Model([], [], [], [], np.zeros(0, np.float32))
    training, held = {language: [] for language in languages}, []
    for number, (values, language) in enumerate(coded):
        if number % CALIBRATION_SHARE == 0 and training[language]:
            held.append((values, languages.index(language)))
        else:
            training[language].append(values)
    model = _train(languages, training)
    if held:
        entropies = np.array([model.entropies(values) for values, _ in held])
        truth = np.array([language for _, language in held])
        model.temperature = _temperature(entropies, truth)
        own = entropies[np.arange(len(held)), truth]
        spread = [own[truth == k] for k in range(len(languages))]
        model.limits = np.array([x.mean() + 6 * x.std() + 0.1 if len(x) else np.inf for x in spread])
    return model


def _temperature(entropies: np.ndarray, truth: np.ndarray) -> float:
    """The scale of a soft maximum over -entropies that makes the held-back languages likeliest."""
    shifted = entropies - entropies.min(axis=1, keepdims=True)
    loss = []
    scales = np.geomspace(0.5, 64, 29)
    for scale in scales:
        odds = np.exp(-shifted * scale)
        loss.append(-np.log(np.maximum(odds[np.arange(len(truth)), truth] / odds.sum(axis=1), 1e-9)).mean())
    return float(scales[int(np.argmin(loss))])


def identify(docs: DataFrame, model: Model, text: str = "text", result: str = "identified") -> DataFrame:
    """Adds (language, score, cross_entropy, rejected) for each whole text.

    Null texts and texts without a letter are `und` with score 0. Ties go to the language that sorts first. Very long texts
    are read in pieces. Repeated rows and other columns stay; a column that already has the result's name is replaced; an
    empty table stays empty. The model is broadcast; its size is bounded by the sample it was learned from times the
    number of languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(RESULT_DDL)
    def run(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.identify([value.as_py() or "" for value in column]), RESULT)

    return docs.withColumn(result, run(F.col(text)))
