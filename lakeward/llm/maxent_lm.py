"""Language-model scoring: hashed maximum-entropy model with a class-factored softmax.

log p(word | history) = log p(class | history) + log p(word | class). The most
frequent words have a class each, the others share classes by their last
letters, so a word's class follows from the word alone. The class factor is a
maximum-entropy model over hashed features of the history: previous word
(bigram), previous two (trigram) and the one before (skip). The word factor is
its add-one share of the class, with one unknown word per class, so the model
sums to one over every history.

Counts cover all training texts and stay distributed; the driver gets totals,
at most ``FREQUENT`` frequent words (the rest is scored through a join) and the
weights, ``ROWS x CLASSES`` numbers. Training goes once through all training
texts in ``ROUNDS`` disjoint parts: each task takes gradient steps on its texts
from the broadcast weights, and the steps of all tasks are averaged row by row,
weighted by how often a row was seen. Scoring is by sparse numpy batches.

Null texts count as empty: one end token. A null id is not held out. Identical
rows are scored (and counted) each. With no training text the class factor is
even. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import col, materialise, text_of

FOLDS, HELD = 7, 2
HEAD, CLASSES = 11, 24  # frequent words with a class each; all classes, the end token's first
ROWS = 1 << 16  # up to this many, rows sort as 16-bit numbers
FREQUENT = 250_000
ROUNDS = 3
RATE, SHRINK = 1.0, 10
BLOCKS = 64
_STEP = 1 << 14  # tokens of one gradient step
_TEXT_AT_ONCE = 1 << 22


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def _parts(batch: pa.RecordBatch):
    """Slices of a batch with about ``_TEXT_AT_ONCE`` bytes of text."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
    for own in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size // _TEXT_AT_ONCE)) + 1):
        if len(own):
            yield batch.slice(int(own[0]), len(own))


def _words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each token's index among them (the end token is -1), and where each text's tokens begin."""
    chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, ends = chunks.flatten(), chunks.offsets.to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.r_[0, np.cumsum(full)]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    begin = before[ends] + np.arange(len(ends))
    token = np.full(begin[-1], -1, np.int64)
    inside = np.ones(begin[-1], bool)
    inside[begin[1:] - 1] = False
    token[inside] = coded.indices.to_numpy()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), token, begin


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all of ``docs``."""

    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                words, token, _ = _words(part.column("text"))
                n = np.bincount(token[token >= 0], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n)], ["word", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(run, "word string, n bigint")
    return materialise(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")


def _suffix_class(word: str) -> int:
    return 1 + HEAD + zlib.crc32(word[-3:].encode()) % (CLASSES - 1 - HEAD)


class Vocabulary:
    """What every task needs of the words: frequent ones by name, the head's classes, class totals."""

    def __init__(self, frequent: list[tuple[str, int]], head: list[str], totals: np.ndarray):
        own = {w: 1 + i for i, w in enumerate(head)}
        self.index = {w: i for i, (w, _) in enumerate(frequent)}
        self.log_n = np.array([0.0, *np.log10([n + 1 for _, n in frequent])])[1:]
        self.head, self.log_total = own, np.log10(totals)
        self.hashed = np.array([zlib.crc32(w.encode()) for w, _ in frequent], np.uint64)
        self.classes = np.array([own.get(w) or _suffix_class(w) for w, _ in frequent], np.int64)

    def look_up(self, words: list[str]):
        """Per word: hash, class, log10(n + 1), whether it is frequent."""
        at = np.array([self.index.get(w, -1) for w in words], np.int64)
        hashed, classes, log_n = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), np.zeros(len(at))
        known = at >= 0
        hashed[known], classes[known], log_n[known] = self.hashed[at[known]], self.classes[at[known]], self.log_n[at[known]]
        for i in np.flatnonzero(~known).tolist():
            hashed[i] = zlib.crc32(words[i].encode())
            classes[i] = self.head.get(words[i]) or _suffix_class(words[i])
        return hashed, classes, log_n, known


def _history(token: np.ndarray, begin: np.ndarray, hashed: np.ndarray, rows: int) -> np.ndarray:
    """Feature rows of each token: bigram, trigram, skip. Texts start from an empty history."""
    own = np.r_[hashed, np.uint64(0xE0D)][token]  # index -1: the end token
    back = []
    for k in (1, 2):
        h = np.r_[np.zeros(k, np.uint64), own[:-k]] if k < len(own) else np.zeros(len(own), np.uint64)
        for j in range(k):
            at = begin[:-1] + j
            h[at[at < begin[1:]]] = 0xB05 + j
        back.append(h)
    one, two = back
    mixed = [one * np.uint64(3) + np.uint64(1), (one * np.uint64(0x9E3779B97F4A7C15) ^ two) * np.uint64(5), two * np.uint64(7) + np.uint64(2)]
    out = np.empty((len(own), 3), np.uint16 if rows <= 1 << 16 else np.uint32)
    for k, m in enumerate(mixed):
        m = m * np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = ((m ^ (m >> np.uint64(31))) % np.uint64(rows)).astype(out.dtype)
    return out


def _log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = weights[rows[:, 0]] + weights[rows[:, 1]]
    z += weights[rows[:, 2]]
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _descend(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One gradient step, in place: each feature row moves by the mean gradient of the tokens that have it,
    shrunk as if ``SHRINK`` more tokens with no gradient had it."""
    g = np.exp(_log_softmax(weights, rows))
    g[np.arange(len(g)), classes] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    touched, n = ordered[first], np.diff(np.r_[first, len(flat)])
    total = np.add.reduceat(g[order // 3], first, axis=0)
    weights[touched] -= (RATE / (n + SHRINK))[:, None].astype(np.float32) * total
    seen[touched] += n


def train_round(docs: DataFrame, weights, vocabulary) -> np.ndarray:
    """New weights from one part of the training texts. ``weights`` and ``vocabulary`` are broadcast variables."""
    shape = weights.value.shape
    size = shape[0] // BLOCKS

    def run(batches):
        w, v = weights.value.copy(), vocabulary.value
        seen = np.zeros(shape[0], np.int64)
        for batch in batches:
            for part in _parts(batch):
                words, token, begin = _words(part.column("text"))
                hashed, classes, _, _ = v.look_up(words)
                rows, classes = _history(token, begin, hashed, shape[0]), np.r_[classes, 0][token]
                for at in range(0, len(token), _STEP):
                    _descend(w, seen, rows[at : at + _STEP], classes[at : at + _STEP])
        if seen.any():
            step = (w - weights.value).astype(np.float16)
            blocks = [step[i * size : (i + 1) * size].tobytes() for i in range(BLOCKS)]
            counts = [seen[i * size : (i + 1) * size].astype(np.float32).tobytes() for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary()), pa.array(counts, pa.binary())],
                ["block", "step", "seen"],
            )

    def average(batches):
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, step, n in zip(*(batch.column(c).to_pylist() for c in ("block", "step", "seen")), strict=True):
                n = np.frombuffer(n, np.float32)
                step = np.frombuffer(step, np.float16).reshape(size, -1).astype(np.float32) * n[:, None]
                held = total.setdefault(b, [np.zeros_like(step), np.zeros_like(n)])
                held[0] += step
                held[1] += n
        means = [(s / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes() for s, n in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(means, pa.binary())], ["block", "step"])

    steps = docs.select(text_of().alias("text")).mapInArrow(run, "block int, step binary, seen binary")
    new = weights.value.copy()
    for r in steps.repartition("block").mapInArrow(average, "block int, step binary").collect():  # the weights' own size
        part = np.frombuffer(r["step"], np.float32).reshape(size, -1)
        new[r["block"] * size : (r["block"] + 1) * size] += part
    return new


def _vocabulary(words: DataFrame, texts: int, frequent: int) -> Vocabulary:
    by_size = F.floor(F.log2("n") * 4)
    held, least = 0, None
    for r in sorted(words.groupBy(by_size.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["b"]):
        held += r["k"]
        if held > frequent:
            break
        least = r["b"]
    named = words.where(by_size >= least).collect() if least is not None else []  # at most `frequent` rows
    named = sorted(((r["word"], r["n"]) for r in named), key=lambda x: (-x[1], x[0]))
    head = [w for w, _ in named[:HEAD]]
    own = F.array_position(F.array(*[F.lit(w) for w in head]) if head else F.array().cast("array<string>"), F.col("word"))
    suffix = F.crc32(F.expr("right(word, 3)")) % (CLASSES - 1 - HEAD) + 1 + HEAD
    totals = np.ones(CLASSES)
    totals[0] += texts + 1
    sums = words.groupBy(F.when(own > 0, own).otherwise(suffix).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    for r in sums.collect():  # one row per class
        totals[r["c"]] += r["n"] + r["v"]
    return Vocabulary(named, head, totals)


def score(docs: DataFrame, rows: int = ROWS, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    sc = docs.sparkSession.sparkContext
    learned = docs.where(~held_out(col("doc_id")))
    words = count_words(learned)
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    texts = learned.count()
    named = _vocabulary(words, texts, frequent)
    vocabulary = sc.broadcast(named)
    # the three features of a history start as the classes' shares of the corpus together
    weights = np.tile((named.log_total * np.log(10) / 3).astype(np.float32), (rows, 1))
    for k in range(rounds):
        part = learned.where(F.pmod(F.xxhash64(col("doc_id"), col("text")), F.lit(rounds)) == k)
        weights = train_round(part, sc.broadcast(weights), vocabulary)
    shared = sc.broadcast(weights)
    end = float(np.log10(texts + 1))

    def run(batches):
        v, w, task, at_row = vocabulary.value, shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _parts(batch):
                names, token, begin = _words(part.column("text"))
                hashed, classes, log_n, known = v.look_up(names)
                history, classes = _history(token, begin, hashed, rows), np.r_[classes, 0][token]
                model = np.empty(len(token))
                for at in range(0, len(token), _STEP):
                    own = slice(at, at + _STEP)
                    z = _log_softmax(w, history[own])
                    model[own] = z[np.arange(len(z)), classes[own]] / np.log(10) - v.log_total[classes[own]]
                first, n = begin[:-1], np.diff(begin)
                sums = [np.add.reduceat(x, first) for x in (np.r_[log_n, end][token], np.r_[known, texts > 0][token].astype(np.int64), model)]
                rare = [[] for _ in n]
                hidden = np.flatnonzero(~np.r_[known, True][token])
                for d, i in zip((np.searchsorted(begin, hidden, "right") - 1).tolist(), token[hidden].tolist(), strict=True):
                    rare[d].append(names[i])
                row = (task << 40) + at_row + np.arange(len(n))
                at_row += len(n)
                arrays = [part.column("_id"), pa.array(row), pa.array(n), *map(pa.array, sums), pa.array(rare, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "_row", "n_tokens", "log_n", "n_known", "model", "rare"])

    kinds_of = "_id bigint, _row bigint, n_tokens bigint, log_n double, n_known bigint, model double, rare array<string>"
    found = docs.select(col("doc_id").alias("_id"), text_of().alias("text")).mapInArrow(run, kinds_of)
    found = materialise(found, "scored")
    rare = found.select("_row", F.explode("rare").alias("word")).join(words, "word")
    rare = rare.groupBy("_row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_log"), F.count(F.lit(1)).alias("rare_known"))
    kinds += texts > 0
    total += texts
    log_n = F.col("log_n") + F.coalesce("rare_log", F.lit(0.0))
    return found.drop("rare").join(rare, "_row", "left").select(
        "_id",
        held_out(F.col("_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (log_n - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))).alias("base_score"),
        (log_n + F.col("model")).alias("score"),
    )
