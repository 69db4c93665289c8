"""Quality by a sparse rule ensemble.

Small boosted trees are grown over statistics of labelled texts. Every path from
a root to a node is a rule: a conjunction of bounds on statistics. A lasso
logistic regression over the rules keeps few of them, and these become one Spark
column expression, so scoring is JVM work inside the scan and ships no model.

Fitting sees statistics and labels of at most ``PER_CLASS`` labelled texts of each
class, by hash of their id, and never of held-out ids; the penalty is chosen on a
quarter of them. The constant is then moved to the classes' shares among all
labels that may be learned from. Scoring covers every whole text.

Null and empty texts have all statistics zero and are scored by the same rules.
An id with several labels counts as good only if all its rows do; an id with
several texts is fitted on the one with the least statistics. Rows without an id
are never fitted on and not held out. With labels of one class only every score
is 0 or 1 for that class, without labels 0.5. Repeated documents get a row each;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import col, row_key, text_of, words_of

PER_CLASS = 4000
FOLDS = 5
KEEP_FROM = 0.3
TREES, DEPTH, RATE, LEAST = 40, 3, 0.3, 20
CUTS = 32
PENALTIES = (0.03, 0.01, 0.003, 0.001)
SEED = 11
GRAM = 4

STATISTICS = (
    "n_words", "word_length", "symbol_share", "bang_share", "upper_share", "digit_share", "odd_word_share",
    "line_words", "ended_line_share", "distinct_line_share", "distinct_word_share", "same_as_last_share", "distinct_gram_share",
)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Documents whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` columns and one double per name in ``STATISTICS``, of whole texts. Spark functions only."""
    kept = docs.select(*keep).columns
    t, w, h, lines = F.col("_t"), F.col("_w"), F.col("_h"), F.col("_l")
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    step = docs.select(*keep, text_of().alias("_t")).select(
        "*", words_of(t).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l")
    )
    step = step.select("*", F.transform(w, lambda x: F.xxhash64(x)).alias("_h"))
    grams = F.when(
        F.size(h) >= GRAM,
        F.element_at(
            F.transform(
                F.array(h),
                lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - GRAM), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(GRAM)])),
            ),
            1,
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    same = F.element_at(
        F.transform(F.array(h), lambda a: F.size(F.filter(F.transform(a, lambda x, i: x == F.get(a, i - 1)), lambda y: y))), 1
    )
    step = step.select(
        *[col(c) for c in kept],
        F.length(t).alias("_chars"), F.size(w).alias("_n"), F.length(F.array_join(w, "")).alias("_wc"), F.size(lines).alias("_nl"),
        left(r"[^#*$%&|<>{}=~^_\\]+").alias("_symbols"), left(r"[^!?]+").alias("_bangs"),
        left(r"[^\p{Lu}]+").alias("_upper"), left(r"[^0-9]+").alias("_digits"),
        F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}0-9]"))).alias("_odd"),
        F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;\"'”»)][\x20\x09-\x0D]*$"))).alias("_ended"),
        F.size(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("_dl"),
        F.size(F.array_distinct(h)).alias("_dw"), same.alias("_same"),
        grams.alias("_g"),
    )
    c = lambda name: F.col(f"_{name}").cast("double")
    return step.select(
        *[col(k) for k in kept],
        c("n").alias("n_words"), _share(c("wc"), c("n")).alias("word_length"), _share(c("symbols"), c("chars")).alias("symbol_share"),
        _share(c("bangs"), c("chars")).alias("bang_share"), _share(c("upper"), c("wc")).alias("upper_share"),
        _share(c("digits"), c("wc")).alias("digit_share"), _share(c("odd"), c("n")).alias("odd_word_share"),
        _share(c("n"), c("nl")).alias("line_words"), _share(c("ended"), c("nl")).alias("ended_line_share"),
        _share(c("dl"), c("nl")).alias("distinct_line_share"), _share(c("dw"), c("n")).alias("distinct_word_share"),
        _share(c("same"), c("n")).alias("same_as_last_share"),
        _share(F.size(F.array_distinct("_g")).cast("double"), F.size("_g").cast("double")).alias("distinct_gram_share"),
    )


#: A bound on a statistic: (its number, True for "at most", the bound). A rule is a tuple of them, all to hold.
Bound = tuple[int, bool, float]
Rule = tuple[Bound, ...]


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    constant: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return rule_matrix(self.rules, x)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.holds(x) @ np.array(self.weights) + self.constant, -30, 30)))

    def column(self) -> Column:
        """The score as a column over the statistics."""
        z = F.lit(float(self.constant))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = reduce(lambda a, b: a & b, (_bound(b) for b in rule))
            z = z + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))

    def describe(self) -> list[tuple[str, float]]:
        text = lambda r: " and ".join(f"{STATISTICS[j]} {'<=' if most else '>'} {at:.4g}" for j, most, at in r)
        return sorted(((text(r), w) for r, w in zip(self.rules, self.weights, strict=True)), key=lambda x: -abs(x[1]))


def _bound(bound: Bound) -> Column:
    j, most, at = bound
    return F.col(STATISTICS[j]) <= F.lit(float(at)) if most else F.col(STATISTICS[j]) > F.lit(float(at))


def rule_matrix(rules: tuple[Rule, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, most, at in rule:
            out[:, k] *= (x[:, j] <= at) if most else (x[:, j] > at)
    return out


def _paths(x: np.ndarray, grad: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], path: Rule, depth: int, fit: np.ndarray) -> list[Rule]:
    """Grow one regression tree over ``grad``; its fit goes into ``fit``, the path of every node but the root is returned."""
    best, own = (1e-9, -1, 0.0), grad[rows]
    if depth and len(rows) >= 2 * LEAST:
        for j, at in enumerate(cuts):
            place = np.searchsorted(at, x[rows, j], side="left")  # value <= at[k] for k >= place
            n = np.cumsum(np.bincount(place, minlength=len(at) + 1))[:-1]
            s = np.cumsum(np.bincount(place, own, minlength=len(at) + 1))[:-1]
            ok = (n >= LEAST) & (len(rows) - n >= LEAST)
            if not ok.any():
                continue
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (own.sum() - s) ** 2 / np.maximum(len(rows) - n, 1), 0) - own.sum() ** 2 / len(rows)
            k = int(np.argmax(np.where(ok, gain, -1)))
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), j, float(at[k]))
    if best[1] < 0:
        fit[rows] = own.mean()
        return []
    _, j, at = best
    low = x[rows, j] <= at
    found = []
    for side, most in ((low, True), (~low, False)):
        below = (*[b for b in path if (b[0], b[1]) != (j, most)], (j, most, at))  # the later bound is the tighter one
        found += [below, *_paths(x, grad, rows[side], cuts, below, depth - 1, fit)]
    return found


def grow_rules(x: np.ndarray, y: np.ndarray) -> tuple[Rule, ...]:
    """The distinct node paths of boosted trees, each over a random half of the rows and of the statistics."""
    rng = np.random.default_rng(SEED)
    quantiles = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(x.shape[1])]
    z, rules = np.full(len(x), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        rows = np.sort(rng.permutation(len(x))[: max(2 * LEAST, len(x) // 2)])
        some = rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]
        cuts = [q if j in some else np.zeros(0) for j, q in enumerate(quantiles)]
        p = 1 / (1 + np.exp(-z))
        grown = _paths(x, y - p, rows, cuts, (), DEPTH, np.zeros(len(x)))
        fit = np.zeros(len(x))
        for rule in grown:  # a node's rows take its mean; deeper nodes come later
            inside = rule_matrix((rule,), x)[:, 0] > 0
            own = rows[inside[rows]]
            fit[inside] = (y - p)[own].mean() if len(own) else 0.0
        z = z + RATE * 4 * fit
        for rule in grown:
            rules.setdefault(tuple(sorted(rule)), None)
    return tuple(rules)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps."""
    n = len(y)
    step = 4 * n / (np.linalg.norm(np.c_[a, np.ones(n)], 2) ** 2 + 1e-9)
    w = v = np.zeros(a.shape[1] + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v[:-1] + v[-1], -30, 30)))
        g = np.r_[a.T @ (p - y), (p - y).sum()] / n
        u = v - step * g
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = u + (last - 1) / t * (u - w), u
    return w[:-1], float(w[-1])


def _log_loss(a: np.ndarray, y: np.ndarray, w: np.ndarray, c: float) -> float:
    p = 1 / (1 + np.exp(-np.clip(a @ w + c, -30, 30)))
    return float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))


def fit(x: np.ndarray, y: np.ndarray, good_share: float | None = None) -> Ensemble:
    """An ensemble from statistics ``x`` and labels ``y``; ``good_share``: of label 1 among all labels, if ``y`` is a sample by class."""
    if len(y) == 0 or y.min() == y.max():
        return Ensemble((), (), 0.0 if len(y) == 0 else 30.0 if y[0] else -30.0)
    rules = grow_rules(x, y)
    a = rule_matrix(rules, x)
    some = a.mean(0)
    keep = (some >= 0.005) & (some <= 0.995)
    rules, a = tuple(r for r, k in zip(rules, keep, strict=True) if k), a[:, keep]
    last = np.arange(len(y)) % 4 == 3
    tried = [(_log_loss(a[last], y[last], *lasso(a[~last], y[~last], p)), -p) for p in PENALTIES]
    w, c = lasso(a, y, -min(tried)[1])
    if good_share is not None and 0 < good_share < 1:
        c += np.log(good_share / (1 - good_share)) - np.log(y.mean() / (1 - y.mean()))
    on = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(tuple(rules[k] for k in on), tuple(float(w[k]) for k in on), float(c))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ensemble:
    """Fit on at most ``per_class`` labelled texts of each class; only their statistics and labels reach the driver."""
    known = labels.select(col("doc_id").alias("_id"), col("quality").alias("_good")).where("_id is not null and _good is not null")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_good").alias("_good"))
    known = known.select("_id", (F.col("_good") > 0).cast("int").alias("_good"), F.xxhash64("_id").alias("_h"))
    chosen = None
    for label in (0, 1):
        own = known.where(F.col("_good") == label).orderBy("_h", "_id").limit(per_class)
        chosen = own if chosen is None else chosen.union(own)
    sizes = {r["_good"]: r["count"] for r in known.groupBy("_good").count().collect()}
    texts = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    found = texts.join(F.broadcast(chosen.select("_id", "_good")), texts["doc_id"] == F.col("_id")).select("_id", "_good", "text")
    seen = statistics(found, F.col("_id"), F.col("_good"))
    seen = seen.groupBy("_id").agg(F.min(F.struct(*STATISTICS)).alias("s"), F.first("_good").alias("_good"))
    rows = sorted(seen.select("_id", "_good", *[f"s.{c}" for c in STATISTICS]).collect(), key=lambda r: r["_id"])
    x = np.array([[r[c] for c in STATISTICS] for r in rows], float).reshape(-1, len(STATISTICS))
    y = np.array([r["_good"] for r in rows], float)
    whole = sum(sizes.values())
    return fit(x, y, sizes.get(1, 0) / whole if whole else None)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``_id, _key, held_out, score, predicted``; one row per document."""
    model = learn(docs, labels, per_class)
    scored = statistics(docs, col("doc_id").alias("_id"), row_key(docs).alias("_key")).withColumn("score", model.column())
    return scored.select("_id", "_key", held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
