"""Quality rules: per-document statistics and cross-document line frequency. Spark SQL functions only.

A line is normalised (lower case, single spaces, trimmed) and hashed. A host is
the document's ``source``. A line is boilerplate on its host when more than
``max(MIN_DOCS, HOST_SHARE x documents of the host)`` distinct documents hold it;
copies of one text are not distinct documents: each (host, line) counts the
distinct hashes of its documents' whole normalised texts (all lines, in order).
A document is depleted when boilerplate holds more than ``DEPLETED`` of
its words.

Null texts count as empty (no words, so ``base_failed``); a null source is a
host of its own. Identical rows get the same verdict each. An empty table gives
an empty result. Lines travel as two hashes; a hot line is counted before and
after one distinct step, never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import WS, col, materialise, row_key, text_of, words_of

MIN_DOCS = 20
HOST_SHARE = 0.005
DEPLETED = 0.7
WINDOW = 8
MIN_WORDS = 20
REPEATED_PERCENT = 30


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hashes(words: Column) -> Column:
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(
        n >= WINDOW,
        _let(
            hashed,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
            ),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: sort by hash, keep those equal to a neighbour, sum the union."""
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    starts = _let(
        pairs,
        lambda s: F.sort_array(
            F.filter(
                F.transform(
                    s,
                    lambda e, i: F.when(
                        (F.get(s, i - 1)["x"] == e["x"]) | (F.get(s, i + 1)["x"] == e["x"]), e["i"]
                    ).otherwise(F.lit(-1)),
                ),
                lambda p: p >= 0,
            )
        ),
    )
    return F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def base_stats(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` columns, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``; one row per document."""
    t = F.col("_t")
    step = docs.select(*keep, text_of().alias("_t"))
    step = step.select(
        "*",
        words_of(t).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    step = step.select("*", _window_hashes(F.col("_w")).alias("_g"))
    repeated = F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0).cast("bigint")).otherwise(_covered(F.col("_g")))
    kept = [c for c in step.columns if c not in ("_t", "_w", "_l", "_g")]
    step = step.select(
        *[col(c) for c in kept],
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text that have a word, in order."""
    flat = F.regexp_replace(F.lower(text), r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """``source, line`` (hash): the lines above their host's limit."""
    lines = docs.select(col("source").alias("source"), normal_lines(text_of()).alias("l"))
    each = lines.select(
        "source", F.xxhash64("l").alias("text"), F.explode(F.transform(F.array_distinct("l"), lambda x: F.xxhash64(x))).alias("line")
    )
    held = each.groupBy("source", "line").agg(F.count_distinct("text").alias("n"))
    hosts = docs.groupBy(col("source").alias("_source")).agg(F.count(F.lit(1)).alias("docs"))
    limit = F.greatest(F.lit(float(min_docs)), F.col("docs") * F.lit(host_share))
    return (
        held.where(F.col("n") > min_docs)
        .join(hosts, F.col("source").eqNullSafe(F.col("_source")))
        .where(F.col("n") > limit)
        .select("source", "line")
    )


def line_hits(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``_id, _key, line, n``: boilerplate lines of each distinct document, with their words (repeats counted)."""
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    lines = docs.select(
        col("doc_id").alias("_id"), row_key(docs).alias("_key"), col("source").alias("source"),
        F.explode(F.transform(normal_lines(text_of()), lambda x, i: F.struct(F.xxhash64(x).alias("line"), (spaces(x) + 1).alias("n"), i.alias("i")))).alias("x"),
    ).select("_id", "_key", "source", "x.line", "x.n", "x.i")
    f = frequent.select(F.col("source").alias("_source"), F.col("line").alias("_line"))
    hits = lines.join(f, (F.col("line") == F.col("_line")) & F.col("source").eqNullSafe(F.col("_source")))
    once = hits.groupBy("_id", "_key", "i").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    return once.groupBy("_id", "_key", "line").agg(F.sum("n").alias("n"))


def removed_words(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``_id, _key, removed``: words of each distinct document that stand in boilerplate lines."""
    return line_hits(docs, frequent).groupBy("_id", "_key").agg(F.sum("n").alias("removed"))


def assess(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """One row per document: ``_id, _key``, the base statistics, ``removed_words`` and ``kept``."""
    frequent = materialise(boilerplate(docs, min_docs, host_share), "boilerplate")
    removed = materialise(removed_words(docs, frequent), "removed").withColumnsRenamed({"_id": "_r_id", "_key": "_r_key"})
    stats = base_stats(docs, col("doc_id").alias("_id"), row_key(docs).alias("_key"))
    same = (F.col("_key") == F.col("_r_key")) & F.col("_id").eqNullSafe(F.col("_r_id"))
    gone = F.coalesce("removed", F.lit(0))
    return stats.join(removed, same, "left").select(
        "_id", "_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        gone.alias("removed_words"),
        (~F.col("base_failed") & (gone <= F.col("n_words") * F.lit(depleted))).alias("kept"),
    )


def filter_quality(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """The documents that pass, with the columns of ``docs`` and their texts as they were.

    The base rules are judged in the scan; only keys of depleted documents are
    joined, as a written table, so Spark sees their real size.
    """
    frequent = materialise(boilerplate(docs, min_docs, host_share), "boilerplate")
    removed = removed_words(docs, frequent)
    words = F.size(words_of(text_of())).alias("n")
    sized = docs.select(col("doc_id").alias("_id"), row_key(docs).alias("_key"), words).withColumnsRenamed({"_id": "_w_id", "_key": "_w_key"})
    same = (F.col("_key") == F.col("_w_key")) & F.col("_id").eqNullSafe(F.col("_w_id"))
    lost = removed.join(sized, same).where(F.col("removed") > F.col("n") * F.lit(depleted)).select("_id", "_key").distinct()
    lost = materialise(lost, "depleted").withColumnsRenamed({"_id": "_d_id", "_key": "_d_key"})
    passed = base_stats(
        docs, col("doc_id").alias("_id"), row_key(docs).alias("_key"), F.struct(*[col(c) for c in docs.columns]).alias("_row")
    ).where(~F.col("base_failed"))
    same = (F.col("_key") == F.col("_d_key")) & F.col("_id").eqNullSafe(F.col("_d_id"))
    return passed.join(lost, same, "left_anti").select("_row.*")


def remove_lines(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """``docs`` with every boilerplate line taken out of its text; other lines stay as they were."""
    frequent = materialise(boilerplate(docs, min_docs, host_share), "boilerplate")
    per_doc = line_hits(docs, frequent).groupBy("_id", "_key").agg(F.collect_set("line").alias("_lines"))
    per_doc = per_doc.withColumnsRenamed({"_id": "_l_id", "_key": "_l_key"})
    rows = docs.select(col("doc_id").alias("_id"), row_key(docs).alias("_key"), F.struct(*[col(c) for c in docs.columns]).alias("_row"))
    same = (F.col("_key") == F.col("_l_key")) & F.col("_id").eqNullSafe(F.col("_l_id"))
    spaced = lambda x: F.trim(F.regexp_replace(F.lower(x), WS, " "))
    text = F.array_join(
        F.filter(F.split(F.col("_row.text"), "\n"), lambda x: ~F.array_contains(F.col("_lines"), F.xxhash64(spaced(x)))), "\n"
    )
    new = F.when(F.col("_lines").isNull(), F.col("_row.text")).otherwise(text)
    return rows.join(per_doc, same, "left").select(*[(new if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])
