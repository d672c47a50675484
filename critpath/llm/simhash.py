"""SimHash near-duplicates with exact pairs from a distributed vantage-point tree.

Fingerprints: 64 bits, one XXH64 per word shingle, bit set if set in over half of the hashes.

The tree. A fingerprint, drawn by hash, is a level's vantage point, and a row's branch is its Hamming distance to it over the
bits of the level. All rows pass the first BASE levels. Then a shard with more than SHARD_ROWS rows is split by a vantage point
of its own, as often as it needs, whatever the size of the others; a level takes the next eight of the 64 bits. After all eight levels a
second round begins with new vantage points for shards with more than DENSE_ROWS rows.

The bound. Within a round the levels' bits are disjoint, so for two fingerprints within r bits of each other the
differences of their distances, summed over the levels, are at most r (the triangle bounds of all levels, together). A
row stays in its home branch and is also sent to the branches that its remaining budget reaches, the first time to
a greater distance only. So of two fingerprints within r bits exactly one visits the other's home shard, and pairs are
compared exactly there. A shard returns its links as a spanning forest, at most one row for each fingerprint, and
components follow from alternating large-star and small-star steps. A group too alike to be split is compared in blocks.

Copies collapse to one fingerprint before the search (a partial aggregate, whatever their number). Fingerprints link
and bridge whatever the doc_ids of their rows are.

Defined results: null, empty and all-space texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle; repeated shingles count; repeated doc_ids and null ones keep one output row each, and a
component is named after its least doc_id, null only if all of its are; further columns may have any name and are ignored; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critpath.llm.common import cut, only, words_of

SEED = 42
#: Rows from which on a shard is split, the same in the second and last round of levels, and bits of a level.
SHARD_ROWS, DENSE_ROWS, LEVEL_BITS = 1 << 15, 1 << 19, 8
#: Levels that all fingerprints pass at every size, each with one vantage point.
BASE = 4
#: Full shards (16 bytes each) that are broadcast; more of them are joined by a shuffle, in which none is hot.
BROADCAST_ROWS = 200_000
_CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    size, digest = min(size, n), xxhash.xxh64_intdigest
    starts = np.concatenate(([0], ends[: n - size])).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, n - size + 1)


def fingerprint(text: str | None, size: int = 3) -> int:
    return fingerprint_of(shingle_hashes(words_of(text), size))


def fingerprint_of(hashes: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK]
        bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes)).view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _split(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """Rows (shard, home, left, fp) of shards that are too full, as rows of the shards of the next level.

    left: bits by which a row may still differ; home: whether it is at its own place.
    """
    first, bits = level % (64 // LEVEL_BITS) == 0, ((1 << LEVEL_BITS) - 1) << (level % (64 // LEVEL_BITS) * LEVEL_BITS)
    mask = F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")).bitwiseAND(mask))
    left = F.lit(radius) if first else F.col("left")
    steps = F.explode(F.sequence(F.when(F.col("home"), 0).otherwise(-left), left))
    moved = rows.withColumns({"distance": distance, "left": left}).select("shard", "home", "fp", "left", "distance", steps.alias("step")).withColumn("to", F.col("distance") + F.col("step"))
    return moved.filter(F.col("to").between(0, LEVEL_BITS)).select(
        F.xxhash64("shard", F.lit(level), "to").alias("shard"), (F.col("home") & (F.col("step") == 0)).alias("home"), (F.col("left") - F.abs("step")).cast("int").alias("left"), "fp"
    )


def shards(fps: DataFrame, radius: int) -> DataFrame:
    """shard, home, left, fp: every fingerprint (column fp, distinct) at home in one shard and visiting those that the bounds leave."""
    rows = fps.select(F.lit(0).cast("long").alias("shard"), F.lit(True).alias("home"), F.lit(radius).alias("left"), "fp")
    drawn = fps.agg(*(F.min_by("fp", F.xxhash64("fp", F.lit(level))) for level in range(BASE))).first()  # BASE numbers
    if drawn[0] is None:
        return rows
    for level, vantage in enumerate(drawn):
        rows = _split(rows.withColumn("vantage", F.lit(vantage)), radius, level)
    rows, done, levels = cut(rows), None, 64 // LEVEL_BITS
    for level in range(BASE, 2 * levels):
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(level))).alias("vantage"))
        full = cut(sizes.filter(F.col("n") > (SHARD_ROWS if level < levels else DENSE_ROWS)).select("shard", "vantage"))
        n = full.count()
        if not n:
            break
        if n <= BROADCAST_ROWS:
            full = F.broadcast(full)
        settled = rows.join(full, "shard", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        rows = cut(_split(rows.join(full, "shard"), radius, level))
    return rows if done is None else done.unionByName(rows)


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """Joins the trees of each a and b; the pairs that did join two."""
    joined = []

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for own, other in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(own), find(other)
        if x != y:
            parent[max(x, y)] = min(x, y)
            joined.append((own, other))
    return joined


def near_pairs(fps: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i in at, j) with i != j within radius, block by block; a block has 4 million comparisons at most."""
    step = max(1, (1 << 22) // max(1, len(fps)))
    for k in range(0, len(at), step):
        own = at[k : k + step]
        i, j = np.nonzero(np.bitwise_count(fps[own, None] ^ fps[None, :]) <= radius)
        keep = own[i] != j
        yield own[i[keep]], j[keep]


def _linked(radius: int, near: bool):
    """Within a shard: home rows against all rows by a finer local level, links as a spanning forest (near: of pairs within the radius)."""

    def run(group: pa.Table) -> pa.Table:
        nodes = group["fp"].to_numpy()
        fps = nodes.view(np.uint64)
        homes, parent, joined = np.flatnonzero(group["home"].to_numpy(zero_copy_only=False)), {}, []
        if len(homes) <= 64:
            parts = [(homes, np.arange(len(fps)))]
        else:  # the same bound once more, for the bits of even place: only rows whose distance differs by radius at most
            ring = np.bitwise_count(fps & np.uint64(0x5555555555555555)).astype(np.int64)
            parts = [(homes[ring[homes] == d], np.flatnonzero(abs(ring - d) <= radius)) for d in np.unique(ring[homes])]
        for own, rows in parts:
            place = np.searchsorted(rows, own)
            for i, j in near_pairs(fps[rows], place, radius):
                joined += _forest(nodes[rows[i]], nodes[rows[j]], parent)
        links = joined if near else [(x, r) for x in parent if (r := _root(parent, x)) != x]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([r for _, r in links], pa.int64())})

    return run


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        x = parent[x]
    return x


def links(fps: DataFrame, radius: int = 2, near: bool = False) -> DataFrame:
    """Edges (a, b) that join exactly the fingerprints (column fp, distinct) linked by chains within radius bits; near: each edge is within them itself."""
    return shards(fps, radius).groupBy("shard").applyInArrow(_linked(radius, near), "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node that has an edge, by large-star and small-star steps.

    Both steps aggregate before they join, and each round is stored in the shared checkpoint folder.
    """
    state = lambda e: e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    rows = cut(fingerprints(docs, size))
    named = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))  # nodes are fingerprints, names come last
    roots = components(links(named.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    placed = named.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
