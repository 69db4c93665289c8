"""Exact removal of repeated substrings by suffix buckets.

Texts are UTF-8 bytes. Every ``LENGTH``-byte string that also starts earlier
(smaller doc_id, or earlier in the same document) has its bytes removed; matches
never cross documents. Suffixes meet only where they can match: each window of
``LENGTH`` bytes belongs to the bucket of its least hashed ``GRAM``-byte gram,
and consecutive windows with the same least gram form one run, so equal windows
always lie in runs of one bucket. Buckets with a single run drop out. The runs of
the others (with their bytes) are refined: windows start in the bucket of their
first gram and are split by sorting on the bucket identifiers of the grams at
later offsets, each round starting from the identifiers of the round before and
only from buckets that still hold two windows or more, until the grams cover the
whole window. The earliest window of a final bucket stays. A run whose bytes all
occur in an earlier run is settled as a whole.

No bucket is capped: those above ``hot`` runs are not brought together, their
windows are dealt out by their own hash and settled by grouped minima. The bitmap
that keeps single-run buckets out of the second pass has a fixed size; when it
fills up it only lets more runs through.

Null and empty texts have nothing to remove. Null ids come last. Rows with the
same doc_id and text are one document, each row reporting it; other texts of one
id are ordered by a hash of the text. Bucket identifiers are 64-bit hashes. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import col, materialise, row_key, text_of

LENGTH, GRAM = 100, 32
HOT = 1 << 14
MOST_HOT = 1 << 20
FILTER_BITS = 1 << 26
_WIDE = LENGTH - GRAM + 1  # grams in a window
_LONGEST = 256  # windows of one run; a longer run (periodic text) is cut
_AT_ONCE = 1 << 18  # bytes hashed at once, unless one text is longer
_RUNS_AT_ONCE = 1 << 14

_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_ID_BITS = 32  # low bits of `pos`: where in the text; above: 31 bits of the text's hash
_LOW = (1 << _ID_BITS) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_tables = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next call up to a few megabytes."""
    global _tables
    if len(_tables[0]) >= n:
        return _tables
    made = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    if n <= 1 << 21:
        _tables = made
    return made


class Hasher:
    """Rolling hashes of substrings, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, down = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * down[:n], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.up[:n]) if n > 0 else np.zeros(0, np.uint64)

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` over each stretch of ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        x, k = least(x[:-k], x[k:]), 2 * k
    return least(x[: -(width - k)], x[width - k :]) if k < width else x


def runs(data: np.ndarray, ends: np.ndarray):
    """Runs ``(bucket, start, windows)`` of texts on end, and the buckets whose gram stands twice in reach of a window."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    grams = Hasher(data).every(GRAM)
    least = _slide(grams, _WIDE, np.minimum)
    end = np.repeat(ends[1:], np.diff(ends))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + LENGTH <= end)
    inside = np.zeros(len(least) + 2 * (_WIDE - 1), np.uint64)
    inside[at + _WIDE - 1] = least[at]
    chosen = np.flatnonzero(_slide(inside, _WIDE, np.maximum)[: len(grams)] == grams)
    again = (np.diff(chosen) <= _WIDE) & (grams[chosen[1:]] == grams[chosen[:-1]])
    if not len(at):
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    own = least[at]
    first = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (own[1:] != own[:-1])])
    size = np.diff(np.r_[first, len(at)])
    pieces = -(-size // _LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(at[first], pieces) + nth * _LONGEST
    windows = np.minimum(np.repeat(size, pieces) - nth * _LONGEST, _LONGEST)
    return np.repeat(own[first], pieces), start, windows, grams[chosen[1:]][again]


def _parts(batch: pa.RecordBatch):
    """``(rows, bytes, ends)`` for slices of a batch with about ``_AT_ONCE`` bytes."""
    text = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    cuts = np.flatnonzero(np.diff(offsets[1:] // _AT_ONCE)) + 1
    for rows in np.split(np.arange(len(text)), cuts):
        if len(rows):
            low, high = offsets[rows[0]], offsets[rows[-1] + 1]
            yield rows, data[low:high], offsets[rows[0] : rows[-1] + 2] - low


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of stretches ``start .. start + size``, on end."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def _count(batches):
    for batch in batches:
        for _, data, ends in _parts(batch):
            bucket, _, _, again = runs(data, ends)
            kinds, n = np.unique(np.r_[bucket, again], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n.astype(np.int32))], ["bucket", "n"])


def _gather(bits, hot, windows_only: bool):
    """Runs whose bucket may hold another one, with their bytes; or the single windows of the hot buckets."""

    def run(batches):
        known, large = bits.value, hot.value
        for batch in batches:
            ids, text_hash, held = batch.column("_id"), batch.column("_hash").to_numpy(), []
            for rows, data, ends in _parts(batch):
                bucket, start, windows, _ = runs(data, ends)
                slot = bucket % np.uint64(FILTER_BITS)
                keep = (known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                keep &= np.isin(bucket, large) == windows_only
                bucket, start, windows = bucket[keep], start[keep], windows[keep]
                if not len(bucket):
                    continue
                doc = np.searchsorted(ends, start, "right") - 1
                pos = (text_hash[rows[doc]] << _ID_BITS) + start - ends[doc]
                own = ids.take(pa.array(rows[doc]))
                if windows_only:
                    each, of = _stretches(start, windows), np.repeat(np.arange(len(start)), windows)
                    key = Hasher(data).some(each, each + LENGTH)
                    held.append((key, own.take(pa.array(of)), pos[of] + each - start[of]))
                    continue
                size = windows + LENGTH - 1
                offsets = pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes())
                body = pa.py_buffer(data[_stretches(start, size)].tobytes())
                body = pa.Array.from_buffers(pa.binary(), len(start), [None, offsets, body])
                arrays = [pa.array(bucket.view(np.int64)), own, pa.array(pos), body]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "_id", "pos", "body"])
            if held:
                key, pos = (np.concatenate([h[k] for h in held]) for k in (0, 2))
                yield _earliest(key, pa.concat_arrays([h[1] for h in held]), pos)

    return run


def _order(ids: pa.Array, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document order, and whether each but the first in it stands at the very place of the one before."""
    number, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((pos, number, null))
    a, b = order[:-1], order[1:]
    return order, (pos[a] == pos[b]) & (number[a] == number[b]) & (null[a] == null[b])


def _earliest(key: np.ndarray, ids: pa.Array, pos: np.ndarray) -> pa.RecordBatch:
    """Of equal windows the earliest, with its key; the others as stretches without one: they go in any case."""
    order, same = _order(ids, pos)
    order = order[np.r_[True, ~same]]
    _, at, of = np.unique(key[order], return_index=True, return_inverse=True)
    later = at[of] != np.arange(len(order))
    first, rest = order[~later], order[later]
    number = ids.fill_null(0).to_numpy()[rest]
    begin = np.flatnonzero(np.r_[True, (np.diff(pos[rest]) != 1) | (np.diff(number) != 0)]) if len(rest) else rest
    n = np.diff(np.r_[begin, len(rest)]) + LENGTH - 1
    keys = pa.concat_arrays([pa.array(key[first].view(np.int64)), pa.nulls(len(begin), pa.int64())])
    rows = np.r_[first, rest[begin]]
    size = np.r_[np.full(len(first), LENGTH), n].astype(np.int32)
    return pa.RecordBatch.from_arrays([keys, ids.take(pa.array(rows)), pa.array(pos[rows]), pa.array(size)], ["key", "_id", "pos", "n"])


def refine(first: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """For each window (at ``first`` in ``grams``) whether an equal one stands before it in the list.

    Bucket-pointer refinement: bucket identifiers of the first gram, split round
    by round by those of the grams at later offsets.
    """
    alive, bucket = np.arange(len(first)), grams[first]
    repeated = np.zeros(len(first), bool)
    for offset in [*range(GRAM, LENGTH - GRAM, GRAM), LENGTH - GRAM]:
        key = _mix(bucket * np.uint64(_BASE) + grams[first[alive] + offset])
        _, bucket, n = np.unique(key, return_inverse=True, return_counts=True)
        several = n[bucket] > 1
        alive, bucket = alive[several], bucket[several].astype(np.uint64)
    _, at = np.unique(bucket, return_index=True)
    repeated[alive] = True
    repeated[alive[at]] = False
    return repeated


def settle(key: np.ndarray, ids: pa.Array, pos: np.ndarray, body: pa.Array):
    """Removed stretches ``(row, offset in the run, length)`` of complete buckets; rows in document order."""
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    hasher = Hasher(data)
    grams = hasher.every(GRAM)
    whole = hasher.some(start, end)
    _, first, of = np.unique(whole, return_index=True, return_inverse=True)
    copy = first[of] != np.arange(len(key))
    rows = np.flatnonzero(~copy)
    _, inverse, n = np.unique(key[rows], return_inverse=True, return_counts=True)
    inner = end[rows] - start[rows] - GRAM + 1
    same = grams[_stretches(start[rows], inner)] == np.repeat(key[rows].view(np.uint64), inner)
    twice = np.add.reduceat(same.astype(np.int64), np.cumsum(inner) - inner) > 1 if len(rows) else np.zeros(0, bool)
    rows = rows[(n[inverse] > 1) | twice]
    windows = end[rows] - start[rows] - LENGTH + 1
    at = _stretches(start[rows], windows)
    repeated = refine(at, grams)
    of = np.repeat(np.arange(len(rows)), windows)
    hit = np.flatnonzero(repeated)
    begin = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(of[hit]) > 0)]) if len(hit) else hit
    last = np.r_[begin[1:], len(hit)] - 1 if len(hit) else hit
    part_row = rows[of[hit[begin]]]
    part_at = at[hit[begin]] - start[part_row]
    part_size = hit[last] - hit[begin] + LENGTH
    copies = np.flatnonzero(copy)
    return np.r_[copies, part_row], np.r_[np.zeros(len(copies), np.int64), part_at], np.r_[end[copies] - start[copies], part_size]


def _settle_sorted(batches):
    """Batches sorted by bucket in; only the last, unfinished bucket is carried over."""

    def solve(table: pa.Table):
        ids = table.column("_id").combine_chunks()
        place = table.column("pos").to_numpy()
        order, same = _order(ids, place)  # a run that comes twice is a row that comes twice
        table = table.take(pa.array(order[np.r_[True, ~same]])).combine_chunks()
        ids, place, body = (table.column(c).combine_chunks() for c in ("_id", "pos", "body"))
        place = place.to_numpy()
        row, offset, size = settle(table.column("key").to_numpy(), ids, place, body)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row)), pa.array(place[row] + offset), pa.array(size.astype(np.int32))], ["_id", "pos", "n"]
        )

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < _RUNS_AT_ONCE:
            continue
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        cut = int((key == key[-1]).argmax())
        if cut:
            yield solve(table.slice(0, cut))
        held, rows = table.slice(cut).combine_chunks().to_batches(), len(key) - cut
    if rows:
        yield solve(pa.Table.from_batches(held))


def repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``_id, pos, n``: stretches to remove; ``pos`` holds the text's hash above the place in the text."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(col("doc_id").alias("_id"), _text_hash().alias("_hash"), text_of().alias("text"))
    counted = texts.select("text").mapInArrow(_count, "bucket bigint, n int")
    several = materialise(counted.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1"), "buckets")
    slot = F.pmod(F.col("bucket"), F.lit(FILTER_BITS))  # FILTER_BITS divides 2^64, so signed and unsigned agree
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    words = several.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    got = words.toArrow()  # at most FILTER_BITS / 64 rows
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    runs_in = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = several.where(F.col("n") > max(hot, runs_in // MOST_HOT)).select("bucket").toArrow()  # below MOST_HOT rows
    large = np.sort(large.column("bucket").to_numpy().view(np.uint64))
    bits, large = sc.broadcast(bits), sc.broadcast(large)
    cold = texts.mapInArrow(_gather(bits, large, False), "key bigint, _id bigint, pos bigint, body binary")
    cold = cold.repartition("key").sortWithinPartitions("key")
    settled = cold.mapInArrow(_settle_sorted, "_id bigint, pos bigint, n int")
    if not len(large.value):
        return settled
    windows = texts.mapInArrow(_gather(bits, large, True), "key bigint, _id bigint, pos bigint, n int")
    windows = materialise(windows, "windows")
    single = windows.where("key is not null").select("key", "_id", "pos")
    place = F.struct(F.col("_id").isNull().alias("no"), "_id", "pos")
    first = single.groupBy("key").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1")
    first = first.select(F.col("key").alias("_key"), F.col("f._id").alias("_f_id"), F.col("f.pos").alias("_f_pos"))
    later = single.join(first, F.col("key") == F.col("_key")).where(
        ~(F.col("_id").eqNullSafe(F.col("_f_id")) & (F.col("pos") == F.col("_f_pos")))
    )
    later = later.select("_id", "pos", F.lit(LENGTH).alias("n"))
    return settled.union(later).union(windows.where("key is null").select("_id", "pos", "n"))


def _text_hash():
    return F.xxhash64(text_of()).bitwiseAND(F.lit((1 << 31) - 1))


def spans_of(place: list[int], size: list[int]) -> list[tuple[int, int]]:
    """The union of stretches as maximal ``(start, end)``."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(zip(place, size, strict=True)):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], at + n))
        else:
            out.append((at, at + n))
    return out


def _cut(batches):
    for batch in batches:
        n_bytes, removed, n_spans, kept = [], [], [], []
        for text, places in zip(batch.column("text"), batch.column("stretches"), strict=True):
            data = text.as_py().encode()
            found = places.as_py() or []
            spans = spans_of([p["pos"] & _LOW for p in found], [p["n"] for p in found])
            left, at = [], 0
            for start, end in spans:
                left.append(data[at:start])
                at = end
            left.append(data[at:])
            kept.append(b"".join(left))
            n_bytes.append(len(data))
            removed.append(len(data) - len(kept[-1]))
            n_spans.append(len(spans))
        arrays = [batch.column("_id"), batch.column("_key"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64())]
        arrays += [pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["_id", "_key", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document: ``_id, _key, n_bytes, n_removed, n_spans`` and the ``kept`` bytes."""
    found = repeats(docs, hot).withColumn("_hash", F.shiftright("pos", _ID_BITS))
    per_text = found.groupBy("_id", "_hash").agg(F.collect_set(F.struct("pos", "n")).alias("stretches"))
    per_text = per_text.select(F.col("_id").alias("_s_id"), F.col("_hash").alias("_s_hash"), "stretches")
    texts = docs.select(col("doc_id").alias("_id"), row_key(docs).alias("_key"), _text_hash().alias("_hash"), text_of().alias("text"))
    same = (F.col("_hash") == F.col("_s_hash")) & F.col("_id").eqNullSafe(F.col("_s_id"))
    joined = texts.join(per_text, same, "left").select("_id", "_key", "text", "stretches")
    kinds = "_id bigint, _key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return joined.mapInArrow(_cut, kinds)
