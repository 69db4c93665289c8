"""Best-fit packing of token pieces into sequences by exact-complement hashing.

A document is its token ids and one closing id 0. Only documents longer than a
sequence are cut. Which pieces share a sequence depends on lengths alone, so the
driver plans over a histogram (one count per length, at most ``CAPACITY``): from
the longest length down, the gap is looked up among single lengths, then sums of
pairs, then of triples, and each combination found is consumed as often as the
counts allow; what is left goes best-fit into the smallest gap that holds it. A
plan entry covers a run of ranks of a length; every task then places its own
pieces by rank.

Null and empty texts are one piece holding only the closing id. Rows that repeat
are packed once each. An empty table gives an empty result. Tokenizing goes
through a memo of blank-separated chunks, which the tokenizer never joins, and
is written once; ranks come from per-task counters, so no length is gathered.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.common import col, materialise, row_key, text_of

CAPACITY = 2048
#: Chunks a worker remembers; the others are tokenized anew. Results do not depend on it.
MEMO = 800_000
_TEXT_AT_ONCE = 1 << 23

_PIECES = (
    "_id bigint, _key bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _task bigint, _nth bigint"
)


def public_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """Ids of texts, chunk by chunk through a memo.

    The tokenizer lower-cases, so texts without special-token marks are lower-cased
    (ASCII only) first; a comma or full stop after a letter (one that is still a
    letter in lower case) is a token run of its own, so the word before it is looked
    up without it. Each distinct chunk of a
    batch is looked up once.
    """

    def __init__(self, path: str, memo: int = MEMO):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.memo = Tokenizer.from_file(path), memo, {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.point = {c: np.array(self.tokenizer.encode(c).ids, "<u4").tobytes() for c in ".,"}

    def _tokenize(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks of letters only are one token run each and go many to a call, told apart by their word-end tokens."""
        plain = [c for c in chunks if c.isalpha() and c.lower().isalpha()]
        out = {}
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                out.update((c, raw[4 * i : 4 * j]) for c, i, j in zip(part, [0, *ends], ends, strict=False))
        other = [c for c in chunks if c not in out]
        for at in range(0, len(other), 512):
            part = other[at : at + 512]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            out.update((c, np.array(e.ids, dtype="<u4").tobytes()) for c, e in zip(part, found, strict=True))
        return out

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        memo = self.memo
        found = list(map(memo.get, chunks))
        new = [i for i, ids in enumerate(found) if ids is None]
        stems = {i: c[:-1] for i in new if (c := chunks[i])[-1] in ".," and c[-2:-1].lower()[-1:].isalpha() and "<|" not in c}
        need = {stems.get(i, chunks[i]) for i in new}
        learned = {c: ids for c in need if (ids := memo.get(c)) is not None}
        fresh = self._tokenize([c for c in need if c not in learned])
        learned.update(fresh)
        if len(memo) < self.most:
            memo.update(fresh)
        for i in new:
            c = chunks[i]
            found[i] = learned[stems[i]] + self.point[c[-1]] if i in stems else learned[c]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` on end, and where each text's ids begin and end."""
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        found = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, at = np.cumsum(size) - size, coded.indices.to_numpy()
        many = size[at]
        ends = np.r_[0, np.cumsum(many)]
        where = np.repeat(first[at] - ends[:-1], many) + np.arange(ends[-1])
        return ids[where], ends[chunks.offsets.to_numpy()]


_held: dict[str, ChunkTokenizer] = {}


def cut(path: str, capacity: int):
    def run(batches):
        if path not in _held:
            _held[path] = ChunkTokenizer(path)
        tokenizer, task, seen = _held[path], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
            for own in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size // _TEXT_AT_ONCE)) + 1):
                part = batch.slice(int(own[0]), len(own))
                rows = []
                ids, ends = tokenizer.encode(part.column("text"))
                keys = zip(part.column("_id").to_pylist(), part.column("_key").to_pylist(), strict=True)
                for (i, key), begin, end in zip(keys, ends.tolist(), ends[1:].tolist(), strict=False):
                    for piece, start in enumerate(range(0, end - begin + 1, capacity)):
                        mine = ids[begin + start : min(begin + start + capacity, end)]
                        crc, n = zlib.crc32(mine), len(mine)
                        if n < capacity:  # the closing id
                            crc, n = zlib.crc32(bytes(4), crc), n + 1
                        rows.append((i, key, piece, start, n, crc, task, int(seen[n])))
                        seen[n] += 1
                names = [x.split()[0] for x in _PIECES.split(", ")]
                types = [pa.int32() if n == "piece" else pa.int64() for n in names]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _single(gap: int, left: np.ndarray) -> tuple[int, ...]:
    return (gap,) if left[gap] else ()


def _pair(gap: int, left: np.ndarray) -> tuple[int, ...]:
    """The available pair with this sum whose longer part is longest."""
    longer = np.arange(gap - 1, (gap + 1) // 2 - 1, -1)
    fits = (left[longer] > 0) & (left[gap - longer] > (longer * 2 == gap))
    at = int(fits.argmax()) if len(fits) else 0
    return (int(longer[at]), gap - int(longer[at])) if len(fits) and fits[at] else ()


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences as ``(times, [(length, how many), ...])``; ``counts[n]`` pieces have length ``n``."""
    left = counts.copy()
    made: list[tuple[int, list[tuple[int, int]]]] = []
    pair_sums, fresh = np.zeros(0, bool), False

    def triple(gap: int) -> tuple[int, ...]:
        nonlocal pair_sums, fresh
        if not fresh:
            on = (left > 0).astype(np.float32)
            pair_sums, fresh = np.convolve(on, on) > 0.5, True
        for a in range(gap - 2, 0, -1):
            if left[a] and pair_sums[gap - a]:
                left[a] -= 1
                rest = _pair(gap - a, left)
                left[a] += 1
                if rest:
                    return (a, *rest)
        return ()

    for longest in range(capacity, 0, -1):
        while left[longest]:
            gap, rest = capacity - longest, ()
            left[longest] -= 1
            if gap:
                rest = _single(gap, left) or _pair(gap, left) or triple(gap)
            left[longest] += 1
            if gap and not rest:
                break
            parts = Counter((longest, *rest))
            times = min(int(left[n]) // k for n, k in parts.items())
            for n, k in parts.items():
                left[n] -= times * k
                fresh &= bool(left[n])
            made.append((times, sorted(parts.items(), reverse=True)))

    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            gap = min((g for g in open_bins if g >= n), default=0)
            times, held = open_bins[gap].pop() if gap else (todo, [])
            gap_now = gap or capacity
            if gap and not open_bins[gap]:
                del open_bins[gap]
            each = min(gap_now // n, todo)
            use = min(times, todo // each)
            if gap and use < times:
                open_bins.setdefault(gap, []).append((times - use, held))
            todo -= use * each
            open_bins.setdefault(gap_now - each * n, []).append((use, [*held, (n, each)]))
    return made + [b for bins in open_bins.values() for b in bins]


def _table(made: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows ``length, first rank, each, sequence, offset``, sorted: ``each`` ranks at a time go to one sequence."""
    rows, used, sequence = [], Counter(), 0
    for times, parts in made:
        offset = 0
        for n, each in parts:
            rows.append((n, used[n], each, sequence, offset))
            used[n] += times * each
            offset += n * each
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(table: np.ndarray):
    key = (table[:, 0] << 50) + table[:, 1]

    def run(batches):
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            row = table[np.searchsorted(key, (n << 50) + rank, side="right") - 1]
            own = rank - row[:, 1]
            out = [batch.column(c) for c in ("_id", "_key", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(row[:, 3] + own // row[:, 2]), pa.array(row[:, 4] + own % row[:, 2] * n)]
            names = ["_id", "_key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``_id, _key, piece, start, length, ids_crc32, sequence_id, offset``."""
    path = tokenizer or public_tokenizer_path()
    rows = docs.select(col("doc_id").alias("_id"), row_key(docs).alias("_key"), text_of().alias("text"))
    pieces = materialise(rows.mapInArrow(cut(path, capacity), _PIECES), "pieces")
    per_task = materialise(pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row per length
        counts[r["length"]] = r["n"]
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "_task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    ranked = pieces.join(before, ["length", "_task"]).select(
        "_id", "_key", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_nth")).alias("_rank")
    )
    kinds = "_id bigint, _key bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place(_table(plan(counts, capacity))), kinds)
