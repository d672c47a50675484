"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model, smoothed at each order by as many imagined tokens of the order below (PRIOR):

    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1));  p2(w|a) = (c(a w) + m2 p1(w)) / (c(a) + m2)
    p3(w|a b) = (c(a b w) + m3 p2(w|b)) / (c(a b) + m3)

so the probabilities of V words and one class of unknown words sum to 1 in every state. As an automaton: the states are the
root, the words and the pairs of words seen in training; a state has an arc for each word seen after it, weighted with the
log of the smoothed probability, which leads to the longest state that fits, and a failure arc to the state without its first
word, weighted with log m / (c + m); the root has an arc for every word. A text is read once from left to right, from the
state of a text's end: the state is carried along, arcs are taken where there are any, else failure arcs, and all
weights are summed. The texts of a block are read side by side, a token of each at a time. Long texts are read in
segments: a segment starts at the root two tokens early, which leads to the same state, since no state is longer.

The automaton grows with the corpus, so no task ever holds all of it. Documents are turned into blocks of word
numbers, stored once. A block asks for exactly the n-grams that its texts can reach, as sorted hashes in packed
arrays, dealt to shards by range; shards add up what all blocks counted and answer each block in the order asked; a block and its
answers meet by block, and the traversal runs on that part of the automaton. A frequent n-gram is asked for once
by a block, however often it occurs there, so no key is hot, and shards are as many as the tokens demand.

Words are told apart by hashes of WORD_BITS bits, pairs and triples by KEY_BITS.

Defined results: null and empty texts are one end token; repeated rows and a null doc_id keep a row each (a null counts
as the empty text for the hold-out rule); without training rows every word is unknown and has probability 1; ties do
not occur; other columns are ignored and may have any name; no rows, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.llm.common import crc_of, cut, only, words_of

FOLDS, HELD_OUT = 5, 1
#: Imagined tokens behind a word and behind a pair of words.
PRIOR = {2: 1000.0, 3: 10.0}
#: Tokens of a block, entries of a shard on average, and tokens of a segment.
BLOCK_TOKENS, SHARD_ENTRIES, SEGMENT = 2_000_000, 2_000_000, 1024
#: Bits of the keys of words, and of pairs and triples. With 48 bits one n-gram in 20,000 shares its count with another at 30 GB
#: of text and one in 500 at 1 TB; larger corpora should take 56 for both.
WORD_BITS, KEY_BITS = 56, 48
_END_HASH = np.uint64(0x5EED0FE0DD0C0FE5)
_MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = "block string, doc_ids array<bigint>, held_out array<boolean>, lengths binary, tokens binary, hashes binary, n_tokens long"
MESSAGE = "grams int, shard int, block string, keys binary, n binary, stats array<bigint>"
_KINDS = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
_NAMES = [x.split()[0] for x in MESSAGE.split(", ")]


def packed(values: np.ndarray, level: int = 1) -> bytes:
    """Numbers byte by byte, all low bytes first: the high ones are mostly zero."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes))


def unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their steps."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _MIX) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shard_of(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Shards are ranges of keys."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class Numbers(dict):
    """Numbers of words, from 0 in the order met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks of word numbers; number 0 is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        ids, held, lengths, tokens, vocabulary, size = [], [], [], [], Numbers(), 0

        def row() -> pa.RecordBatch:
            digest = xxhash.xxh64_intdigest
            hashes = np.append(_END_HASH, np.fromiter((digest(w, 42) for w in vocabulary), np.uint64, len(vocabulary)))
            found = np.concatenate(tokens)  # frequent words get low numbers, which pack well; the end of a text stays 0
            order = np.append(0, 1 + np.argsort(-np.bincount(found, minlength=len(hashes))[1:], kind="stable"))
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(len(order))
            cells = ([f"{task}-{n}"], [ids], [held], [np.array(lengths, np.int64).tobytes()], [packed(number[found], 3)], [packed(hashes[order] >> np.uint64(64 - WORD_BITS))], [size])
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=BLOCK.replace(",", "").split()[::2])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                found = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
                tokens.append(np.append(found + 1, 0).astype(np.int32))
                ids.append(doc.as_py())
                held.append(crc_of(doc.as_py()) % FOLDS == HELD_OUT)
                lengths.append(len(words) + 1)
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield row()
                    ids, held, lengths, tokens, vocabulary, size, n = [], [], [], [], Numbers(), 0, n + 1
        if ids:
            yield row()

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK)


class Block:
    """A block's texts and their n-grams: words by number, pairs as previous * size + word, triples as number of the pair
    before * size + word, each sorted; last is a triple's last pair."""

    def __init__(self, row: dict):
        self.ids, self.held, self.lengths = row["doc_ids"], np.array(row["held_out"], bool), np.frombuffer(row["lengths"], np.int64)
        self.tokens, self.hashes = unpacked(row["tokens"], np.int32).astype(np.int64), unpacked(row["hashes"], np.uint64)
        self.starts, self.size = np.cumsum(self.lengths) - self.lengths, len(self.hashes)
        first = np.zeros(len(self.tokens), bool)
        first[self.starts] = True
        before = np.where(first, 0, np.roll(self.tokens, 1))
        self.pairs, self.pair_of = np.unique(before * self.size + self.tokens, return_inverse=True)
        self.later = np.flatnonzero(~first)  # a text's first token has no triple
        self.triples, at, self.triple_of = np.unique(self.pair_of[self.later - 1] * self.size + self.tokens[self.later], return_index=True, return_inverse=True)
        self.last = self.pair_of[self.later[at]]
        self.a, self.b = np.divmod(self.pairs, self.size)

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, the keys of the block's n-grams, and which n-gram ends at each token that has one."""
        pair_hashes, spare = _mixed(self.hashes[self.a], self.hashes[self.b]), np.uint64(64 - KEY_BITS)
        yield 1, self.hashes, self.tokens
        yield 2, pair_hashes >> spare, self.pair_of
        yield 3, _mixed(pair_hashes[self.triples // self.size] ^ _MIX, self.hashes[self.triples % self.size]) >> spare, self.triple_of

    def asked(self, name: str, shards: int) -> Iterator[tuple]:
        trained = np.repeat(~self.held, self.lengths)
        for n, keys, of in self.grams():
            counts = np.bincount(of[trained[self.later] if n == 3 else trained], minlength=len(keys)).astype(np.uint32)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.searchsorted(shard_of(keys, shards, WORD_BITS if n == 1 else KEY_BITS), np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(at)).tolist():
                own = slice(at[s], at[s + 1])
                yield n, s, name, packed_keys(keys[own]), packed(counts[own]), None

    def answered(self, answers: list[dict]) -> dict[int, np.ndarray]:
        """Counts of the block's n-grams from the shards' answers."""
        found = {}
        for n, keys, _ in self.grams():
            own = [unpacked(r["n"], np.int64) for r in sorted((r for r in answers if r["grams"] == n), key=lambda r: r["shard"])]
            found[n] = np.zeros(len(keys), np.int64)
            found[n][np.argsort(keys, kind="stable")] = np.concatenate([np.zeros(0, np.int64), *own])
        return found


def _batches(rows: Iterator[tuple], size: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(_KINDS)], names=_NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(_KINDS)], names=_NAMES)


def _asked(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                yield from _batches(Block(row).asked(row["block"], shards))

    return run


def _answered(group: pa.Table) -> pa.Table:
    """A shard's n-grams: counts over all blocks, returned to each block in the order asked; and how many words there are and occur."""
    out, names, kinds, shard = [], group["block"].to_pylist(), group["grams"].to_numpy(), group["shard"][0].as_py()
    for n in (1, 2, 3):
        own = np.flatnonzero(kinds == n).tolist()
        if not own:
            continue
        keys = [unpacked_keys(group["keys"][i].as_py()) for i in own]
        ends = np.cumsum([0, *map(len, keys)])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpacked(group["n"][i].as_py(), np.uint32) for i in own]), len(distinct)).astype(np.int64)
        out += [(n, shard, names[i], None, packed(total[place[x:y]]), None) for i, x, y in zip(own, ends[:-1], ends[1:], strict=True)]
        if n == 1:
            out.append((0, shard, None, None, None, [int((total > 0).sum()), int(total.sum())]))
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_KINDS)], names=_NAMES)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Automaton:
    """The part of the automaton that a block's texts can reach. Arcs are known by the n-gram that ends at a token, so none is searched for."""

    def __init__(self, block: Block, counts: dict[int, np.ndarray], distinct: int, tokens: int):
        c1, c2, c3 = counts[1], counts[2], counts[3]
        m2, m3 = PRIOR[2], PRIOR[3]
        p1 = (c1 + 0.5) / (tokens + 0.5 * (distinct + 1))
        p2 = (c2 + m2 * p1[block.b]) / (c1[block.a] + m2)
        p3 = (c3 + m3 * p2[block.last]) / (c2[block.triples // block.size] + m3)
        self.base, nan = np.log10(p1), np.nan
        # weights of the arcs of words and of pairs, nan where there is none, and of failure arcs; a last one for the root and for tokens without a triple
        self.word_arc, self.pair_arc = np.where(c2 > 0, np.log10(p2), nan), np.append(np.where(c3 > 0, np.log10(p3), nan), nan)
        self.word_failure, self.pair_failure = np.append(np.log10(m2 / (c1 + m2)), 0.0), np.append(np.log10(m3 / (c2 + m3)), 0.0)
        self.triple_at = np.full(len(block.tokens), -1)
        self.triple_at[block.later] = block.triple_of

    def step(self, pair: np.ndarray, last: np.ndarray, word: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight of reading a word in each state, and the next states; a state is a pair, or with pair -1 a word, or
        with last -1 too the root. ends: the pair and the triple that end at the word."""
        weight = np.where(pair >= 0, self.pair_arc[ends[1]], np.nan)
        fails = np.isnan(weight)
        by_word = np.where(last >= 0, self.word_arc[ends[0]], np.nan)
        lost = fails & np.isnan(by_word)
        weight = np.where(fails, self.pair_failure[pair] + by_word, weight)
        weight = np.where(lost, self.pair_failure[pair] + self.word_failure[last] + self.base[word], weight)
        return weight, np.where(lost, -1, ends[0]), word

    def read(self, block: Block) -> np.ndarray:
        """The weight of every token of the block's texts."""
        parts = block.lengths // SEGMENT + 1
        first, stop = np.repeat(block.starts, parts), np.repeat(block.starts + block.lengths, parts)
        number = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, end = first + number * SEGMENT, np.minimum(first + (number + 1) * SEGMENT, stop)
        begin, end, number = (x[begin < end] for x in (begin, end, number))
        at = begin - np.where(number > 0, 2, 0)
        order = np.argsort(at - end, kind="stable")  # longest first, so that those still read are the first ones
        at, end, begin, number = at[order], end[order], begin[order], number[order]
        pair, last, out = np.full(len(at), -1), np.where(number > 0, -1, 0), np.zeros(len(block.tokens))
        left = end - at
        for k in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -k, side="left"))
            here = at[:n] + k
            weight, pair, last = self.step(pair[:n], last[:n], block.tokens[here], (block.pair_of[here], self.triple_at[here]))
            counts = here >= begin[:n]
            out[here[counts]] = weight[counts]
        return out


def scored(block: Block, counts: dict[int, np.ndarray], distinct: int, tokens: int) -> pa.Table:
    """The result rows of a block's texts."""
    automaton = Automaton(block, counts, distinct, tokens)
    texts = lambda v: np.add.reduceat(v, block.starts)
    return pa.table({
        "doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(block.lengths), "n_known": pa.array(texts((counts[1] > 0)[block.tokens].astype(np.int64))),
        "train_tokens": pa.array(np.full(len(block.ids), tokens, np.int64)), "base_score": pa.array(texts(automaton.base[block.tokens])), "score": pa.array(texts(automaton.read(block))),
    })


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    stored = cut(blocks(docs))
    tokens = stored.select(F.sum("n_tokens")).first()[0]
    if tokens is None:
        return docs.sparkSession.createDataFrame([], SCORES)
    shards = max(1, -(-int(tokens) // SHARD_ENTRIES))
    answers = cut(stored.mapInArrow(_asked(shards), MESSAGE).groupBy("shard").applyInArrow(_answered, MESSAGE))
    distinct, train = (int(x or 0) for x in answers.filter("grams = 0").select(*(F.sum(F.get("stats", F.lit(i))) for i in range(2))).first())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, replies = [], right.to_pylist()
        for row in left.to_pylist():
            block = Block(row)
            found.append(scored(block, block.answered(replies), distinct, train))
        return pa.concat_tables(found)

    return stored.groupBy("block").cogroup(answers.filter("grams > 0").select("block", "grams", "shard", "n").groupBy("block")).applyInArrow(run, SCORES)
