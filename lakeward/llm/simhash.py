"""SimHash near-dedup with BK-trees.

Fingerprints are 64-bit SimHashes of word shingles (XXH64, seed 42). Two within
``RADIUS`` bits agree on at least ``m`` of ``RADIUS + m`` blocks, so each distinct
fingerprint goes to one shard per choice of ``m`` blocks and every link is found
inside a shard; ``m`` is the smallest that leaves shards of about ``SHARD``
fingerprints. A shard is a BK-tree: a child hangs on its parent by their Hamming
distance, and a search at distance d from a node follows only the edges d -
radius to d + radius. Shards above ``TREE`` fingerprints are split into trees of
about that size, and each tree meets each part of the shard in a task of its own.
A shard passes on a spanning forest of its links, never all pairs; equal
fingerprints meet once however many documents have them.

Null texts count as empty; texts without words have fingerprint 0, which links
like any other. A component is named by its smallest non-null doc_id (null when
it has none). Repeated rows get a row each. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import col, components, keep_rows, materialise, row_key, text_of

SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD = 2048
TREE = 4096
_AT_ONCE = 1 << 15  # shingles whose bits are summed at once
_FRONTIER = 1 << 20  # (query, node) pairs a search may start from at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, most significant first. ``bytes.lower`` and ``bytes.split`` know ASCII letters and blanks only."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _AT_ONCE):
        pairs = zip(starts[at : at + _AT_ONCE].tolist(), ends[at : at + _AT_ONCE].tolist(), strict=True)
        h = b"".join([xxhash.xxh64_digest(line[a:b], SEED) for a, b in pairs])
        ones += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts)).tobytes()


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            fp = [int.from_bytes(fingerprint(t.as_py().encode(), shingle), "big", signed=True) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(fp, pa.int64())], ["_id", "_key", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``_id, _key, fp`` (the 64 bits as a long), one row per document."""
    rows = docs.select(col("doc_id").alias("_id"), row_key(docs).alias("_key"), text_of().alias("text"))
    return materialise(rows.mapInArrow(_fingerprints(shingle), "_id bigint, _key bigint, fp bigint"), "fingerprints")


class BKForest:
    """One BK-tree per group over ``fps`` (uint64, sorted by group, distinct within it), built level by level."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        self.fps = fps
        n = len(fps)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.root_of = np.repeat(first, np.diff(np.r_[first, n]))
        todo = np.setdiff1d(np.arange(n), first)
        node, edges, children = self.root_of[todo], [], []
        while len(todo):
            slot = node * 65 + np.bitwise_count(fps[todo] ^ fps[node])
            kinds, at, inverse = np.unique(slot, return_index=True, return_inverse=True)
            edges.append(kinds)
            children.append(todo[at])
            node = todo[at][inverse]
            rest = np.ones(len(todo), bool)
            rest[at] = False
            todo, node = todo[rest], node[rest]
        self.edges = np.concatenate([np.zeros(0, np.int64), *edges])
        order = np.argsort(self.edges)
        self.edges, self.children = self.edges[order], np.concatenate([np.zeros(0, np.int64), *children])[order]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Pairs ``(query index, node)`` at most ``radius`` apart; query i searches the tree at ``roots[i]``."""
        q, node = np.arange(len(queries)), roots
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right") - low
            start = np.cumsum(many) - many
            q = np.repeat(q, many)
            node = self.children[np.arange(len(q)) - np.repeat(start - low, many)]


def _forest_of(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least reachable index for each of ``n`` nodes over the links ``u, v``."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shard_links(group: np.ndarray, fps: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int):
    """A spanning forest ``(fp, fp)`` of the links between tree and query members of each group."""
    nodes = np.flatnonzero(tree)
    forest = BKForest(group[nodes], fps[nodes])
    ask = np.flatnonzero(query)
    at = np.searchsorted(group[nodes], group[ask])
    found = at < len(nodes)
    found[found] = group[nodes][at[found]] == group[ask][found]
    ask, at = ask[found], at[found]
    size = np.bincount(np.searchsorted(np.unique(group), group[nodes]), minlength=1)[
        np.searchsorted(np.unique(group), group[ask])
    ]
    part = np.cumsum(size) // _FRONTIER
    label_u, label_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        hits = [(q, n) for q, n in forest.search(fps[ask[own]], at[own], radius)]
        u = np.concatenate([label_u, *[ask[own][q] for q, _ in hits]])
        v = np.concatenate([label_v, *[nodes[n] for _, n in hits]])
        label = _forest_of(u, v, len(fps))
        label_u = np.flatnonzero(label != np.arange(len(fps)))
        label_v = label[label_u]
    return fps[label_u], fps[label_v]


def _search(radius: int):
    """Batches sorted by (key, a, b) in; links out. Only the last, unfinished group is carried over."""

    def solve(table: pa.Table):
        key, a, b, own = (table.column(c).to_numpy() for c in ("key", "a", "b", "own"))
        fps = table.column("fp").to_numpy().view(np.uint64)
        change = np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        u, v = shard_links(np.cumsum(change), fps, own == a, own == b, radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 1 << 16:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key, a, b = (table.column(c).to_numpy() for c in ("key", "a", "b"))
            last = (key == key[-1]) & (a == a[-1]) & (b == b[-1])
            cut = int(last.argmax())
            if cut:
                yield solve(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def blocks_kept(n: int, radius: int, shard: int = SHARD) -> int:
    """The fewest agreeing blocks that cut ``n`` spread-out fingerprints to shards of ``shard``."""
    m = 1
    while m < 8 and n >> (64 // (radius + m) * m) > shard:
        m += 1
    return m


def links(distinct: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD, tree: int = TREE) -> DataFrame:
    """``u, v``: links that span every component of ``distinct.fp`` within ``radius`` bits."""
    m = blocks_kept(n, radius, shard)
    blocks = radius + m
    edges = [64 * i // blocks for i in range(blocks + 1)]

    def block(i: int):
        wide = edges[i + 1] - edges[i]
        return F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << wide) - 1))

    keys = []
    for k, chosen in enumerate(combinations(range(blocks), m)):
        bits = F.lit(0).cast("bigint")
        for i in chosen:
            bits = F.shiftleft(bits, edges[i + 1] - edges[i]).bitwiseOR(block(i))
        keys.append(bits + F.lit(k << 50))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree)
    large = materialise(large.select("key", F.ceil(F.col("n") / tree).cast("int").alias("c")), "large-shards")
    dealt = rows.join(large, "key", "left").select("fp", "key", F.coalesce("c", F.lit(1)).alias("c"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    cells = dealt.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j")).select(
        "fp", "key", "own", F.least("own", "j").alias("a"), F.greatest("own", "j").alias("b")
    )
    sorted_cells = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return sorted_cells.mapInArrow(_search(radius), "u bigint, v bigint")


def group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, **how) -> DataFrame:
    """One row per document: ``_id, _key, fp, root, component_id``."""
    rows = fingerprints(docs, shingle)
    distinct = materialise(rows.groupBy("fp").agg(F.min("_id").alias("least")), "distinct")
    found = components(links(distinct, distinct.count(), radius, **how), "simhash")
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialise(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, **how) -> DataFrame:
    """One document of each component (the one that names it), with the columns of ``docs``."""
    grouped = group(docs, shingle, radius, **how).where(F.col("_id").eqNullSafe(F.col("component_id")))
    kept = grouped.groupBy("root").agg(F.first("_id").alias("_id"), F.min("_key").alias("_key")).select("_id", "_key")
    return keep_rows(docs, kept).select("_row.*")
