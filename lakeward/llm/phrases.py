"""Phrase collocations by dynamic itemset counting.

The corpus is split once into bounded chunks of coded words, dealt to ``shards``.
Shards are scanned in a cycle and every scan counts phrases of all lengths at
once: words from the first scan on, a longer phrase from the scan after the one
in which its prefix and its suffix (one word shorter each) both reached the
threshold, and for exactly one full cycle. No count is lost by starting late,
since the cycle comes back to the shards that went by before.

The scans count 64-bit hashes of phrases, so only numbers are shuffled; a hash's
count is never below the count of any phrase it stands for. One last scan counts
the phrases themselves whose hash reached the threshold, and these exact counts
decide. Which hashes have reached it travels to the tasks as a bitmap of bounded
size that only ever grows, so a phrase that a wrong hit lets in early is also
counted for one whole cycle: wrong hits cost time, never change a count. Beyond
``MOST_BITS`` the bitmap stays as large as it is and lets more phrases through,
which the shuffle counts and drops below the threshold.

Words are lower-cased (A-Z only) runs of anything but blank and tab within the
pieces between ``.,;:!?`` and line ends. Null texts are empty, a null language is
``und``. Repeated rows and copies count as often as they stand there. Ties in the
ranking end in the phrase itself. An empty table gives an empty result; further
columns of the input are not read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.llm.common import col, materialise, text_of
from lakeward.operators.ingest import hadoop_path
from lakeward.session import ensure_checkpoint_dir

THRESHOLD = 100
LONGEST = 5  # up to 15
SHARDS = 4
INSIDE_PERCENT = 100
TOP = 2000
#: Bytes of text after which a task closes a chunk.
CHUNK = 4 << 20
#: One bit for so many words of the corpus; at most ``MOST_BITS`` (64 MB).
WORDS_A_BIT, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 29
#: Words of the corpus that one task of the last scan adds up, and phrases that it holds meanwhile.
WORDS_A_TASK, HELD = 32_000_000, 250_000
BATCH = 8 << 20
UNKNOWN = "und"

#: The low bits of a counted hash hold the phrase's length.
_SIZE = 15


def _code(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of the texts, and all words as codes; the first word of a piece as ``~code``."""
    pieces = pc.list_flatten(pc.split_pattern_regex(pc.ascii_lower(texts), "[.,;:!?\x0a-\x0d]"))
    words = pc.split_pattern_regex(pieces, "[\x20\x09]+")
    flat = pc.dictionary_encode(words.flatten())
    codes = np.asarray(flat.indices).astype(np.int32)
    piece = np.repeat(np.arange(len(words)), np.diff(np.asarray(words.offsets)))
    some = np.asarray(pc.greater(pc.binary_length(flat.dictionary), 0), bool)
    keep = some[codes] if len(codes) else np.zeros(0, bool)
    codes, piece = codes[keep], piece[keep]
    first = np.r_[True, piece[1:] != piece[:-1]][: len(codes)]
    return flat.dictionary, np.where(first, ~codes, codes).astype(np.int32)


def chunks(docs: DataFrame, shards: int = SHARDS, chunk: int = CHUNK) -> DataFrame:
    """``lang, words, hashes, codes, n, shard``: the coded corpus, a row per language and chunk, written once by shard.

    ``hashes`` has the hash of each word in its language, so only the last scan reads the words themselves."""

    def run(batches):
        from pyspark import TaskContext

        turn, size, held = TaskContext.get().partitionId(), 0, {}

        def flush():
            for lang, texts in sorted(held.items()):
                words, codes = _code(pa.array(texts, pa.large_string()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.ListArray.from_arrays([0, len(words)], words), pa.array([_word_hashes(lang, words).tobytes()], pa.binary()),
                     pa.array([codes.tobytes()], pa.binary()), pa.array([len(codes)], pa.int64()), pa.array([turn % shards], pa.int32())],
                    ["lang", "words", "hashes", "codes", "n", "shard"],
                )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= chunk:
                    yield from flush()
                    turn, size, held = turn + 1, 0, {}
        yield from flush()

    rows = docs.select(F.coalesce(col("lang"), F.lit(UNKNOWN)).alias("lang"), text_of().alias("text"))
    schema = "lang string, words array<string>, hashes binary, codes binary, n long, shard int"
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/phrases-chunks-{uuid.uuid4().hex}"
    # small row groups: a reader holds a few chunks at a time
    rows.mapInArrow(run, schema).write.option("parquet.block.size", 16 << 20).partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(4)) & np.uint64(len(bitmap) * 8 - 1)  # above the length
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _distinct(codes: np.ndarray, at: np.ndarray, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A position of each distinct phrase of ``size`` words at ``at``, and its count. Equal hashes are checked word by word."""
    _, first, back, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    if all((codes[at + k] == codes[at[first][back] + k]).all() for k in range(size)):
        return at[first], n
    rows = np.stack([codes[at + k] for k in range(size)], 1)
    _, first, n = np.unique(rows, axis=0, return_index=True, return_counts=True)
    return at[first], n


def _word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    word = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)
    own = pd.util.hash_array(np.array([f"language {lang}"], dtype=object), categorize=False)
    return _mix(word, np.broadcast_to(own, word.shape))


def _marked(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & ~np.uint64(_SIZE)) | np.uint64(size)


def _longer(at: np.ndarray, hashes: np.ndarray, size: int, codes: np.ndarray, starts: np.ndarray, word: np.ndarray):
    """Of the phrases of ``size`` words at ``at``: which go on to the next one within the piece, and the longer phrases' places and hashes."""
    follows = np.zeros(len(at), bool)
    if len(at):
        follows[:-1] = (at[1:] == at[:-1] + 1) & ~starts[at[1:] + size - 1]
    i = np.flatnonzero(follows)
    return i, at[i], _mix(hashes[i], word[codes[at[i] + size]])


def _count(chunk, reached: np.ndarray, before: np.ndarray | None, longest: int):
    """``hash, n`` of one chunk: per length, the phrases that are in their cycle.

    ``reached``: what had reached the threshold before this scan; ``before``: the
    same one cycle ago (None within the first cycle). A phrase whose parts were
    both in ``before`` has had its cycle.
    """
    word, signed = chunk
    codes, starts = np.where(signed < 0, ~signed, signed), signed < 0
    words = _marked(word, 1)
    if before is None:
        n = np.bincount(codes, minlength=len(word))
        yield words[n > 0], n[n > 0]
    at = np.flatnonzero(_has(reached, words)[codes])
    done = (np.zeros(len(word), bool) if before is None else _has(before, words))[codes[at]]
    hashes = word[codes[at]]
    for size in range(2, longest + 1):
        # longer phrases start where the phrases here and one word on have both reached the threshold
        i, at, hashes = _longer(at, hashes, size - 1, codes, starts, word)
        had, marked = done[i] & done[i + 1], _marked(hashes, size)
        if not had.all():
            yield np.unique(marked[~had], return_counts=True)
        known = _has(reached, marked)
        at, hashes, done, marked = at[known], hashes[known], had[known], marked[known]
        if before is not None:
            done &= _has(before, marked)


def _scan(shard: DataFrame, reached, before, longest: int) -> DataFrame:
    """``hash, n``: what one scan counts, a row per task and hash or fewer."""

    def run(batches):
        now, past = np.frombuffer(reached.value, np.uint8), before and np.frombuffer(before.value, np.uint8)
        for chunk in _chunks_of(batches):
            for hashes, n in _count(chunk, now, past, longest):
                for k in range(0, len(n), 200_000):
                    part = slice(k, k + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["hash", "n"])

    return shard.select("hashes", "codes").mapInArrow(run, "hash long, n long")


def _chunks_of(batches, *names: str):
    """The hashes and codes of each chunk, and further columns as they are."""
    for batch in batches:
        for i in range(batch.num_rows):
            hashes, codes = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("hashes", np.uint64), ("codes", np.int32)))
            yield hashes, codes, *(batch.column(c)[i] for c in names)
            pa.default_memory_pool().release_unused()


def _phrases(coded: DataFrame, found, longest: int, tasks: int) -> DataFrame:
    """``lang, phrase, size, n``: the phrases themselves whose hash is in ``found``, counted over all chunks.

    A task adds up its chunks before it sends anything on, ``HELD`` phrases at most.
    """

    def run(batches):
        known, held = np.frombuffer(found.value, np.uint8), {}

        def add(lang, size, phrase, n):
            own = held.setdefault((lang, size), {})
            for x, m in zip(phrase.to_pylist(), n.tolist(), strict=True):
                own[x] = own.get(x, 0) + m

        def out():
            for (lang, size), own in held.items():
                each = iter(own.items())
                while some := list(islice(each, 50_000)):
                    m = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * m, pa.string()), pa.array([x for x, _ in some], pa.string()), pa.array(np.full(m, size, np.int32)),
                         pa.array([n for _, n in some], pa.int64())],
                        ["lang", "phrase", "size", "n"],
                    )
            held.clear()

        for word, signed, lang, words in _chunks_of(batches, "lang", "words"):
            codes, starts, lang, words = np.where(signed < 0, ~signed, signed), signed < 0, lang.as_py(), words.values
            hit = _has(known, _marked(word, 1))
            n = np.bincount(codes, minlength=len(word))
            some = np.flatnonzero(hit & (n > 0))
            add(lang, 1, words.take(pa.array(some)), n[some])
            at = np.flatnonzero(hit[codes])
            hashes = word[codes[at]]
            for size in range(2, longest + 1):
                _, at, hashes = _longer(at, hashes, size - 1, codes, starts, word)
                hit = _has(known, _marked(hashes, size))
                at, hashes = at[hit], hashes[hit]
                one, n = _distinct(codes, at, size, hashes)
                parts = [words.take(pa.array(codes[one + k])) for k in range(size)]
                add(lang, size, pc.binary_join_element_wise(*parts, " "), n)
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    rows = coded.select("lang", "words", "hashes", "codes").repartition(tasks).mapInArrow(run, "lang string, phrase string, size int, n long")
    return rows.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.sum("n").alias("n"))


@contextmanager
def _small_batches(spark: SparkSession):
    """While chunks are scanned, a batch on its way to Python holds a few chunks: a row is megabytes here."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _set_bits(table: DataFrame, **bitmaps) -> set[str]:
    """Set the bits of ``hash`` in each bitmap where its condition holds; they come 64 to a row, so at most a bitmap's
    size reaches the driver. The names of those that got any."""
    size = len(next(iter(bitmaps.values()))[0]) * 8
    place = F.shiftrightunsigned("hash", 4).bitwiseAND(F.lit(size - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    any_of = reduce(lambda a, b: a | b, [c for _, c in bitmaps.values()])
    bits = [F.bit_or(F.when(c, one).otherwise(F.lit(0).cast("long"))).alias(n) for n, (_, c) in bitmaps.items()]
    rows = table.where(any_of).groupBy(F.shiftright(place, 6).alias("word")).agg(*bits).toArrow()
    found = set()
    for name, (bitmap, _) in bitmaps.items():
        new = np.asarray(rows[name]).view(np.uint64)
        bitmap.view(np.uint64)[np.asarray(rows["word"])] |= new
        if new.any():
            found.add(name)
    return found


def frequent(coded: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """``lang, phrase, size, n``: all phrases of 1 to ``longest`` words that occur ``threshold`` times or more."""
    spark = coded.sparkSession
    total = coded.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (total // WORDS_A_BIT).bit_length()))
    reached, found, past = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), []
    running, table, last_new, scan = None, None, 0, 0
    often = F.col("n") >= threshold
    while scan < last_new + shards:
        past.append(spark.sparkContext.broadcast(reached.tobytes()))
        earlier = past[scan - shards] if scan >= shards else None
        counted = _scan(coded.where(F.col("shard") == scan % shards), past[scan], earlier, longest)
        counted = counted.select("hash", "n", F.lit(0).cast("long").alias("before"), F.lit(scan).alias("since"))
        if running is not None:
            counted = counted.union(running.select("hash", "n", F.col("n").alias("before"), "since"))
        counted = counted.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("before").alias("before"), F.min("since").alias("since"))
        counted, last = materialise(counted, f"phrases-scan-{scan}"), table
        table = counted.inputFiles()[:1]
        # what was first met in scan k began in k at the latest, so its cycle is over after k + shards - 1
        over = F.col("since") <= scan - shards + 1
        new = often & (F.col("before") < threshold) & (F.col("hash").bitwiseAND(F.lit(_SIZE)) < longest)
        if "reached" in _set_bits(counted, reached=(reached, new), found=(found, over & often)):
            last_new = scan + 1
        running = counted.where(~over)
        for file in last or []:  # the table before is not read any more
            fs, path = hadoop_path(spark, file.rsplit("/", 1)[0])
            fs.delete(path, True)
        if earlier is not None:
            earlier.unpersist()
        scan += 1
    _set_bits(running, found=(found, often))
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // WORDS_A_TASK))
    exact = _phrases(coded, spark.sparkContext.broadcast(found.tobytes()), longest, tasks)
    return materialise(exact.where(often), "phrases-frequent")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT,
    shards: int = SHARDS, chunk: int = CHUNK,
) -> DataFrame:
    """``lang, phrase, a, l, r, n, score``: scored phrases of two words or more that no longer phrase takes in."""
    coded = chunks(docs, shards, chunk)
    sizes = coded.groupBy("lang").agg(F.sum("n").alias("n"))
    with _small_batches(docs.sparkSession):
        known = frequent(coded, threshold, longest, shards)
    phrases = known.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    w = F.split("phrase", " ")

    # f never grows with length, so among longer phrases those of one more word decide
    longer = phrases.where("size > 2").select(
        "lang", "a", F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("size") - 1), " "))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    taken = (100 * F.coalesce("_longer", F.lit(0))) >= inside_percent * F.col("a")
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(~taken).select("lang", "phrase", "size", "a")

    cut = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(w, F.col("k") + 1, F.col("size")), " ").alias("rest")
    )
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    # exact: decimals of 38 digits, whole division
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    cut = cut.withColumn("score", score.cast("long"))
    best = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def ranked(scored: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` by score, count and phrase, with ``rank``; tasks keep ``top`` rows a language before they meet."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    found = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
