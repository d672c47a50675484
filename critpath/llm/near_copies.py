"""Near copies: the groups of all pairs of texts whose sets of word shingles have Jaccard similarity 0.8 or more.

A text is the set of its SHINGLE-word shingles (as XXH64). Texts of the same set collapse to one node. Each node has a
SimHash fingerprint, and the distributed vantage-point tree of `simhash` links all fingerprints within RADIUS bits; the
texts of these links are compared exactly, and similar ones are joined to groups.

Sets of similarity 0.8 may differ by more bits than any tree can prune by, so an exact prefix join follows for the
pairs that are not in one group yet. Two sets of similarity 0.8 or more share one of the first n - ceil(0.8 n) + 1
shingles of each, whatever the order, as long as it is the same for all sets. The order here is
rare first: shingles are counted in BUCKETS buckets by their hash, so a shingle of many texts seldom leads a set. Texts that
share a leading shingle are candidates unless their sizes or the shingle's places rule them out; the candidates'
texts then meet in blocks and are compared exactly. Similar pairs are joined to groups, chains included.

A large group of near copies would still give all its pairs as candidates. So each text is first compared with one
text only of those that share a leading shingle (drawn by hash, another for each shingle), and once more while there are many more
candidates than nodes: what is similar falls into one group at once, and pairs within a group need no comparison any more. In
the end all candidates whose texts are in different groups are compared. A bound spares most of these: two sets
differ by at least as many shingles as their sketches of parities differ by bits. So no similar pair is lost by the
tree, the draw, the order, the buckets, the bound or the blocks: they decide the work alone.

What is sent is kept small: leading shingles go in packed blocks, by 32 bits of hash within their group (shingles that fall together only add
candidates), and texts that a bitmap of MARKS bits shows to be in no pair aren't sent.

Defined results: null, empty and all-space texts have the empty set and are copies of each other only; fewer words than
a shingle make one shingle; of a group the row of least doc_id stays (a null doc_id comes last), one row even where
doc_ids repeat; columns other than doc_id and text never matter and may have any name; no rows, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from critpath.llm.common import cut, plain, stored, words_of
from critpath.llm.simhash import _forest, _root, components, fingerprint_of, links, shingle_hashes

SHINGLE = 5
#: Bits by which fingerprints differ at most that the tree links.
RADIUS = 2
#: Counters of the order (4 bytes each, broadcast), and rows of them that a task hands on at once.
BUCKETS, PART = 1 << 20, 1 << 14
#: Bytes of text for each group of the prefix join, and for each side of a block of candidates.
GROUP_BYTES, BLOCK_BYTES = 8 << 20, 32 << 20
#: Values that a worker gathers before it counts or merges them.
_STEP = 1 << 19
#: Leading shingles that are packed at once, and bits of the map of texts to send (in rows of PART_BITS), whatever the input.
PACKED, MARKS, PART_BITS = 1 << 19, 1 << 26, 1 << 20
#: Candidates for each node from which on texts are compared with a drawn one of each shingle once more, and how often that is done at most.
MANY, DRAWS = 4, 2
#: Pairs (16 bytes each) that the driver joins to groups by itself; more of them take distributed rounds, with the same groups.
LOCAL_PAIRS = 1 << 17
#: Bits of a set's sketch: each says whether an odd number of shingles fell on it.
SKETCH_BITS = 512
MEMBER = "part int, hash long, node long, n int, pos int, drawn long"


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles, sorted."""
    return np.unique(shingle_hashes(words_of(text), SHINGLE))


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 5) - (1 << 63)


def similar(shared: np.ndarray | int, m: np.ndarray | int, n: np.ndarray | int) -> np.ndarray | bool:
    """shared / (m + n - shared) >= 0.8, in whole numbers."""
    return 9 * shared >= 4 * (m + n)


def sketch(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own >> np.uint64(20)) % np.uint64(SKETCH_BITS), minlength=SKETCH_BITS).astype(np.int64) & 1).tobytes()


def leading(own: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The shingles by which a set is looked up, the rarest first."""
    k = len(own) - (4 * len(own) + 4) // 5 + 1
    return own[np.lexsort((own, order[own % np.uint64(BUCKETS)]))[:k]]


def _with_nodes(docs: DataFrame) -> DataFrame:
    """docs as c0, c1, ... with _node, _sketch and _fp, the same for texts of the same set, and _row; stored, so that no row changes its number."""
    rows, (at,) = plain(docs, "text")
    schema = StructType([*rows.schema.fields, StructField("_node", LongType()), StructField("_sketch", BinaryType()), StructField("_fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(at)]
            fps = np.fromiter(map(fingerprint_of, sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(node_of, sets), pa.int64()), pa.array(map(sketch, sets), pa.binary()), pa.array(fps)], names=schema.names)

    return stored(rows.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """node and set of the rows (_node, text), each node once in a task."""
    seen: set[int] = set()
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if node not in seen:
                seen.add(node)
                yield node, shingles(text.as_py())


def _packed(values: np.ndarray) -> bytes:
    """values, like bytes next to each other."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _order(rows: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n = np.zeros(BUCKETS, np.int64), [], 0
        for _, own in _fresh(batches):
            held.append((own % np.uint64(BUCKETS)).astype(np.int64))
            n += len(own)
            if n >= _STEP:
                counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        for i in range(0, BUCKETS, PART):
            if counts[i : i + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([_packed(counts[i : i + PART])], pa.binary())], names=["at", "counts"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(_unpacked(x.as_py(), np.int64) for x in group["counts"])
        return pa.table({"at": group["at"][:1], "counts": pa.array([np.minimum(total, (1 << 31) - 1).astype(np.int32).tobytes()], pa.binary())})

    order = np.zeros(BUCKETS, np.int32)
    parts = rows.select("_node", "text").mapInArrow(run, "at long, counts binary").groupBy("at").applyInArrow(added, "at long, counts binary")
    for at, counts in parts.collect():  # BUCKETS counters, whatever the input
        order[at : at + PART] = np.frombuffer(counts, np.int32)
    return order


def _members(rows: DataFrame, size: int) -> DataFrame:
    """The nodes (with n, the size of the set, and pos, the shingle's place) of every leading shingle that two nodes or more have.

    drawn: a node of the same shingle to compare with first, null if that can't be similar.
    """
    order, groups = rows.sparkSession.sparkContext.broadcast(_order(rows)), max(64, size // GROUP_BYTES)
    kinds = {"hash": np.uint32, "node": np.int64, "n": np.int32, "pos": np.int32}

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        hashes, k = np.concatenate([h for _, h, _ in held]), [len(h) for _, h, _ in held]
        parts, short = (hashes % np.uint64(groups)).astype(np.int32), (hashes >> np.uint64(32)).astype(np.uint32)
        by = np.lexsort((short, parts))
        parts, short = parts[by], short[by]
        columns = [np.repeat(np.array([x for x, _, _ in held], np.int64), k)[by], np.repeat(np.array([n for _, _, n in held], np.int32), k)[by], np.concatenate([np.arange(x, dtype=np.int32) for x in k])[by]]
        edges = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(parts))
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        data = [[_packed(np.diff(short[a:b], prepend=np.uint32(0))) for a, b in spans], *([_packed(c[a:b]) for a, b in spans] for c in columns)]
        return pa.RecordBatch.from_arrays([pa.array(parts[edges[:-1]]), *(pa.array(x, pa.binary()) for x in data)], names=["part", *kinds])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for node, own in _fresh(batches):
            if len(own):
                held.append((node, leading(own, order.value), len(own)))
                total += len(held[-1][1])
            if total >= PACKED:
                yield batch_of(held)
                held, total = [], 0
        if held:
            yield batch_of(held)

    def met(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        hashes, nodes, n, pos = (np.concatenate([np.cumsum(v, dtype=np.uint32) if c == "hash" else v for x in group[c] for v in (_unpacked(x.as_py(), kind),)]) for c, kind in kinds.items())
        by = np.lexsort((pos, nodes, hashes))
        by = by[np.append(True, (hashes[by][1:] != hashes[by][:-1]) | (nodes[by][1:] != nodes[by][:-1]))]  # a node of several tasks
        same = hashes[by][1:] == hashes[by][:-1]
        by = by[np.append(False, same) | np.append(same, False)]
        hashes, nodes, n, pos = hashes[by], nodes[by], n[by], pos[by]
        first = np.append(True, hashes[1:] != hashes[:-1])[: len(by)]
        starts, of = np.flatnonzero(first), np.cumsum(first) - 1
        mixed = (nodes.view(np.uint64) ^ (hashes * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(11)
        one = np.lexsort((mixed, of))[starts][of] if len(by) else by  # of each shingle, by hash
        most = np.minimum(n - pos, n[one] - pos[one]).astype(np.int64)
        skip = (nodes == nodes[one]) | ~similar(most, n.astype(np.int64), n[one].astype(np.int64))
        return pa.table({"part": pa.array(np.full(len(by), part, np.int32)), "hash": pa.array((np.int64(part) << 32) | hashes.astype(np.int64)), "node": pa.array(nodes), "n": pa.array(n), "pos": pa.array(pos), "drawn": pa.array(nodes[one], mask=skip)})

    packed = rows.select("_node", "text").mapInArrow(looked_up, "part int, hash binary, node binary, n binary, pos binary")
    return packed.groupBy("part").applyInArrow(met, MEMBER)


def _possible(x: str, y: str) -> Column:
    """Whether two members (columns under these prefixes) of one shingle may be similar: by size, and by what follows the shared shingle."""
    n, m = F.col(f"{x}n").cast("long"), F.col(f"{y}n").cast("long")
    most = F.least(n - F.col(f"{x}pos"), m - F.col(f"{y}pos"))
    return 9 * most >= 4 * (n + m)


def _drawn(members: DataFrame, turn: int) -> DataFrame:
    """a < b: each member and the one that is drawn for its shingle, where they are of different groups."""
    one = members.groupBy("hash").agg(F.min_by(F.struct("node", "n", "pos", "root"), F.xxhash64("node", "hash", F.lit(turn))).alias("c"))
    both = members.join(one, "hash").select("node", "n", "pos", "root", F.col("c.node").alias("c_node"), F.col("c.n").alias("c_n"), F.col("c.pos").alias("c_pos"), F.col("c.root").alias("c_root"))
    return both.filter((F.col("root") != F.col("c_root")) & _possible("", "c_")).select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct()


def _apart(group: pa.Table) -> pa.Table:
    """a < b: all pairs of members of one shingle that are in different groups and may be similar; none within the largest group is looked at."""
    hashes, nodes, n, pos, roots = (group[c].to_numpy() for c in ("hash", "node", "n", "pos", "root"))
    by = np.lexsort((nodes, n, hashes))
    hashes, nodes, n, pos, roots = hashes[by], nodes[by], n[by].astype(np.int64), pos[by], roots[by]
    sketches = np.frombuffer(b"".join(group["_sketch"].to_pylist()), np.uint64).reshape(len(by), -1)[by]
    found, held, waiting = np.zeros((0, 2), np.int64), [], 0
    edges = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    for start, stop in zip(edges.tolist(), np.append(edges[1:], len(hashes)).tolist(), strict=True):
        own = roots[start:stop]
        names, number = np.unique(own, return_inverse=True)
        if len(names) < 2:
            continue
        largest = np.bincount(number).argmax()
        for i in (start + np.flatnonzero(number != largest)).tolist():
            low, high = np.searchsorted(n[start:stop], (-(-4 * n[i] // 5), 5 * n[i] // 4 + 1)) + start
            others = np.arange(low, high)
            others = others[(roots[others] != roots[i]) & similar(np.minimum(n[i] - pos[i], n[others] - pos[others]), n[i], n[others])]
            others = others[9 * np.bitwise_count(sketches[others] ^ sketches[i]).sum(axis=1, dtype=np.int64) <= n[i] + n[others]]
            held.append(np.stack((np.minimum(nodes[others], nodes[i]), np.maximum(nodes[others], nodes[i])), axis=1))
            waiting += len(others)
            if waiting >= _STEP:
                found, held, waiting = np.unique(np.concatenate((found, *held)), axis=0), [], 0
    found = np.unique(np.concatenate((found, *held)), axis=0)
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


def _similar(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """x, y of the pairs (a, b, x, y) for which the texts of a and b are similar; texts: node, text. A text is sent to a block once, however many pairs it has there."""
    blocks = max(4, size // BLOCK_BYTES)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = pairs.select("a", "b", "x", "y", (of("a") * blocks + of("b")).alias("block"))
    ends = placed.select(F.col("block").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct()

    def compared(some: pa.Table, sent: pa.Table) -> pa.Table:
        sets = {node: shingles(text.as_py()) for node, text in zip(sent["node"].to_pylist(), sent["text"], strict=True)}
        found = []
        for a, b in zip(some["a"].to_pylist(), some["b"].to_pylist(), strict=True):
            m, n = sets[a], sets[b]
            found.append(similar(len(np.intersect1d(m, n, assume_unique=True)), len(m), len(n)))
        return some.select(["x", "y"]).filter(pa.array(found, pa.bool_()))

    # a shingle set is made once for a text of a block
    return placed.groupBy("block").cogroup(ends.join(texts, "node").groupBy("to")).applyInArrow(compared, "x long, y long")


def _linked(nodes: DataFrame) -> DataFrame:
    """a < b: nodes whose fingerprints are linked by the vantage-point tree or equal, one of each fingerprint with all others of it."""
    one = cut(nodes.groupBy("fp").agg(F.min("node").alias("one")))
    ends = links(one.select("fp"), RADIUS, near=True).join(one.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(one.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b")
    alike = nodes.join(one, "fp").filter("node <> one").select(F.col("node").alias("x"), F.col("one").alias("y"))
    return ends.select("x", "y").unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _marked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (node, text) of texts whose node is in wanted (node), and few others: those that fall on the bits of a wanted one."""
    at = F.xxhash64("node").bitwiseAND(F.lit(MARKS - 1))

    def mapped(group: pa.Table) -> pa.Table:
        bits = np.zeros(PART_BITS, bool)
        bits[group["at"].to_numpy() % PART_BITS] = True
        return pa.table({"part": group["part"][:1], "bits": pa.array([_packed(np.packbits(bits))], pa.binary())})

    marks = np.zeros(MARKS // 8, np.uint8)
    for part, bits in wanted.select(at.alias("at"), F.shiftright(at, PART_BITS.bit_length() - 1).alias("part")).groupBy("part").applyInArrow(mapped, "part long, bits binary").collect():  # MARKS bits, whatever the input
        marks[part * (PART_BITS // 8) : (part + 1) * (PART_BITS // 8)] = _unpacked(bits, np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(_packed(marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unpacked(sent.value, np.uint8)
        for batch in batches:
            places = batch.column(2).to_numpy()
            yield batch.select([0, 1]).filter(pa.array((own[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)))

    return texts.select("node", "text", at.alias("at")).mapInArrow(run, "node long, text string")


def _components(pairs: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node of the stored pairs (a, b)."""
    if pairs.count() > LOCAL_PAIRS:
        return components(pairs)
    ends, parent = pairs.select("a", "b").toArrow(), {}
    _forest(ends["a"].to_numpy(), ends["b"].to_numpy(), parent)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((_root(parent, x) for x in parent), np.int64, len(parent))
    spark = pairs.sparkSession
    return spark.createDataFrame(pa.table({"node": nodes, "root": roots})) if len(nodes) else spark.createDataFrame([], "node long, root long")


def groups(rows: DataFrame) -> DataFrame:
    """node, root of every node that is similar to another, chains included; rows: _node, _row, _sketch, _fp, text."""
    size = int(rows.select(F.sum(F.octet_length("text"))).first()[0] or 0)
    # copies of a node have one sketch and fingerprint
    nodes = cut(rows.groupBy(F.col("_node").alias("node")).agg(F.min("_row").alias("row"), F.first("_sketch").alias("_sketch"), F.first("_fp").alias("fp")))

    def compared(pairs: DataFrame) -> DataFrame:
        # one row of each node is sent: pairs of rows a and b, with their nodes x and y
        x, y = (nodes.select(F.col("node").alias(of), F.col("row").alias(c)) for of, c in (("x", "a"), ("y", "b")))
        pairs = cut(pairs.toDF("x", "y").join(x, "x").join(y, "y"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = _marked(rows.select(F.col("_row").alias("node"), "text"), wanted)
        return cut(_similar(pairs, texts, size).toDF("a", "b"))

    def apart(pairs: DataFrame) -> DataFrame:
        a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    def rooted() -> DataFrame:
        return members.drop("drawn").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    found = compared(_linked(nodes.filter(F.col("node") != node_of(shingles(None)))))
    roots, members = _components(found), cut(_members(rows, size))
    drawn = members.filter("drawn is not null").select(F.least("node", "drawn").alias("a"), F.greatest("node", "drawn").alias("b")).distinct()
    for turn in range(DRAWS):
        if turn:
            ends = rooted().groupBy("hash", "root").agg(F.count("*").alias("k")).groupBy("hash").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("own"))
            open_, n = ends.select(F.sum((F.col("k") * F.col("k") - F.col("own")) / 2), F.sum("k")).first()
            if not n or open_ <= MANY * n:
                break
            drawn = _drawn(rooted(), turn)
        found = cut(found.unionByName(compared(apart(drawn))))
        roots = _components(found)
    sketches = nodes.select("node", "_sketch")
    new = compared(rooted().join(sketches, "node").groupBy("part").applyInArrow(_apart, "a long, b long").distinct())
    return _components(found.unionByName(new))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row (the one of least doc_id) of each group of near copies, all columns as they are."""
    rows, (doc_id, text) = _with_nodes(docs), plain(docs, "doc_id", "text")[1]
    own = rows.select("_node", "_row", "_sketch", "_fp", F.col(f"c{doc_id}").alias("doc_id"), F.col(f"c{text}").alias("text"))
    roots = groups(own.select("_node", "_row", "_sketch", "_fp", "text"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")
    first = own.groupBy("_node").agg(F.min(place).alias("place"))  # copies collapse before they meet the groups
    stay = first.join(roots, F.col("_node") == F.col("node"), "left").groupBy(F.coalesce("root", "_node")).agg(F.min("place").alias("place")).select(F.col("place._row").alias("_row"))
    return rows.join(stay, "_row", "left_semi").drop("_node", "_row", "_sketch", "_fp").toDF(*docs.columns)
