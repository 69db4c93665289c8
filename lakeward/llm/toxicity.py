"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text,
over the same ordinary base content, so that a window of plain text compresses
alike with both and only what toxic text adds makes a difference. The toxic
samples are the words of toxic texts that hold a character gram over-represented
there; the base and the ordinary samples leave such words out, which ordinary
text may use now and then. A document's windows are compressed with both; how
much shorter the toxic side is (mean, extremes, high percentile, share and count
of windows above each margin) is calibrated to a probability by logistic
regression on labelled texts that the dictionaries did not see.

Fitting uses at most ``PER_CLASS`` labelled texts of each class, by hash of their
id, and nothing but their texts and labels; scoring covers whole texts of any
length. Null and empty texts get the score of a text without evidence; without
labels of both classes every score is 0. A label that repeats counts as toxic if
any of its rows is. Repeated documents get a row each. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import col, row_key, text_of

PER_CLASS = (2000, 6000)  # ordinary texts are more varied
FOLDS = 5
WINDOW, STEP, LEVEL = 64, 32, 12
GROUP = 65_536  # windows in one call of a compressor, which digests its dictionary anew
MARGINS = (1, 2, 3, 4, 6)  # bytes by which the toxic side is shorter
BASE_BYTES, OWN_BYTES = 110_000, 2048
GRAM, GRAMS = 5, 60
SEED = 7


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Documents whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def windows(text: bytes) -> list[bytes]:
    if len(text) <= WINDOW:
        return [text]
    return [text[i : i + WINDOW] for i in range(0, len(text) - WINDOW + STEP, STEP)]


def _grams(word: str) -> set[str]:
    word = " " + word.strip(".,!#$%&*")
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def _content(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b" ".join(samples)[:size]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the constant

    def compressors(self):
        """For each side, compressed sizes of many windows."""

        def one(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(
                dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False
            )

            def sizes(parts: list[bytes]) -> np.ndarray:
                if not any(parts):  # refused as a group
                    return np.array([len(c.compress(p)) for p in parts])
                packed = c.multi_compress_to_buffer(parts)
                return np.array([len(packed[i]) for i in range(len(packed))])

            return sizes

        return one(self.ordinary), one(self.toxic)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(texts: list[str], ordinary: Callable, toxic: Callable) -> np.ndarray:
    """A row per text; the windows of all texts are compressed in groups."""
    counts = []

    def cut():
        for t in texts:
            own = windows(t.lower().encode())
            counts.append(len(own))
            yield from own

    if not texts:
        return np.zeros((0, 4 + 2 * len(MARGINS)))
    gain = np.concatenate([ordinary(g) - toxic(g) for g in map(list, batched(cut(), GROUP))])
    n = np.array(counts)
    start = np.cumsum(n) - n
    ranked = gain[np.lexsort((gain, np.repeat(np.arange(len(n)), n)))]
    place = 0.9 * (n - 1)
    below = np.floor(place).astype(int)
    low, high = ranked[start + below], ranked[start + np.minimum(below + 1, n - 1)]
    out = [
        np.add.reduceat(gain, start) / n, np.minimum.reduceat(gain, start), low + (high - low) * (place - below),
        np.maximum.reduceat(gain, start),
    ]
    for margin in MARGINS:
        above = np.add.reduceat((gain >= margin).astype(int), start)
        out += [np.log1p(above), above / n]
    return np.column_stack(out)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps with a small ridge, so that separable classes stay finite."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.r_[np.full(x.shape[1], 0.5), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(rows: list[tuple[str, int]]) -> Model | None:
    """From (text, label) pairs: dictionaries on three quarters of them, calibration on the last."""
    rows = sorted({(t, y) for t, y in rows})
    random.Random(SEED).shuffle(rows)
    split = [i % 4 == 3 for i in range(len(rows))]
    fit = [r for r, last in zip(rows, split, strict=True) if not last]
    rest = [r for r, last in zip(rows, split, strict=True) if last]
    if {y for _, y in fit} != {0, 1} or {y for _, y in rest} != {0, 1}:
        return None
    toxic, ordinary = ([t.lower() for t, y in fit if y == k] for k in (1, 0))
    seen = [Counter(), Counter()]
    for k, texts in ((1, toxic), (0, ordinary)):
        for t in texts:
            seen[k].update(set().union(*map(_grams, set(t.split()))))

    def excess(gram: str) -> float:
        n, p = seen[1][gram], (seen[1][gram] + 0.5) / (len(toxic) + 1)
        q = (seen[0][gram] + 0.5) / (len(ordinary) + 1)
        return n * math.log(p / q) if n >= 3 and p > 2 * q else 0.0

    marks = set(sorted(seen[1], key=lambda g: (-excess(g), g))[:GRAMS])
    words = {w for t in toxic + ordinary for w in t.split()}
    marked = {w for w in words if not marks.isdisjoint(_grams(w))}
    own = [f" {w}".encode() for t in toxic for w in t.split() if w in marked]
    unmarked = [[w for w in t.split() if w not in marked] for t in ordinary]
    plain = [f" {w}".encode() for t in unmarked for w in t if len(w) >= GRAM]
    base = [w for t in unmarked for w in windows(" ".join(t).encode())[::2]]
    for samples in (own, plain, base):
        random.Random(SEED).shuffle(samples)
    shared = _content(base[:60_000], BASE_BYTES)
    one = Model(
        shared + _content(own[:60_000], OWN_BYTES), shared + _content(plain[: max(len(own), 2000)], OWN_BYTES),
        np.zeros(0), np.zeros(0), np.zeros(0),
    )
    both = one.compressors()
    x, y = features([t for t, _ in rest], *both), np.array([float(k) for _, k in rest])
    return Model(one.toxic, one.ordinary, *_logistic(x, y))


def sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> list[tuple[str, int]]:
    """At most ``per_class`` (toxic, ordinary) labelled texts that are not held out."""
    known = labels.select(col("doc_id").alias("_id"), col("toxic").alias("_toxic")).where("_id is not null and _toxic is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    known = known.withColumn("_h", F.xxhash64("_id"))
    chosen = None
    for label, most in zip((1, 0), per_class, strict=True):
        own = known.where(F.col("_toxic") == label).orderBy("_h", "_id").limit(most)
        chosen = own if chosen is None else chosen.union(own)
    texts = docs.select(col("doc_id").alias("_id"), col("text").alias("_text")).where("_text <> ''")
    found = texts.join(F.broadcast(chosen.select("_id", "_toxic")), "_id").dropDuplicates(["_id"])
    return [(r["_text"], int(r["_toxic"])) for r in found.select("_text", "_toxic").collect()]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: ``_id, _key, score`` from 0 to 1."""

    def run(batches):
        both = model.compressors() if model else None
        for batch in batches:
            if model:
                p = model.probability(features(batch.column("text").to_pylist(), *both))
            else:
                p = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), pa.array(p)], ["_id", "_key", "score"])

    rows = docs.select(col("doc_id").alias("_id"), row_key(docs).alias("_key"), text_of().alias("text"))
    return rows.mapInArrow(run, "_id bigint, _key bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> DataFrame:
    """``_id, _key, held_out, score, predicted``."""
    scored = score(docs, train(sample(docs, labels, per_class)))
    return scored.select(
        "_id", "_key", held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
