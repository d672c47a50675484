"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every text is read as lower-case words without ASCII punctuation. Seeds are all word n-grams of the test items: which
of them an edited copy keeps is not known beforehand, so none is dropped, common or not. One pass joins documents to
items where a seed occurs and aligns the passage around it with the whole item. The score is the alignment's share of
a perfect one; a passage from CUT on is a leak. Before an alignment an exact bound is taken: it can't score more than
the words that passage and item have in common. A copy without any n-gram of its item is not seen.

The items are broadcast in blocks of at most twice BLOCK_BYTES of text (checked), half of it on average, one scan of the
documents for each block. The driver builds one block at a time. Documents are never shuffled.

Defined results: null, empty and wordless texts and items match nothing; items shorter than an n-gram are one seed of
all their words; repeated documents and items give repeated rows; a null doc_id or item_id stays null; of several
passages of one document that match an item the best, then the first, is returned; other columns are ignored; no
rows in either table, no leaks.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.llm.common import filtered, only

SEED_WORDS, CUT = 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20
_BLANK = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_BLANK).split() if text else []


class Items:
    """Test items as word numbers, and their seeds as sorted codes with the places where they occur."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(r[1])], np.int64) for r in rows]
        self.size = len(self.vocabulary) + 1
        self.short = [any(len(w) == n for w in self.words) for n in range(SEED_WORDS)]
        if self.size**SEED_WORDS >= 1 << 63:
            raise ValueError("a block of items has too many different words, take a smaller BLOCK_BYTES")
        codes = [self._grams(w, min(SEED_WORDS, len(w))) if len(w) else np.zeros(0, np.int64) for w in self.words]
        code, item = np.concatenate([np.zeros(0, np.int64), *codes]), np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c)) for c in codes)])
        self.keep(code, item.astype(np.int32), place.astype(np.int32))

    def keep(self, code: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        """Seeds as sorted distinct codes; the places of seed number s are those from first[s] to last[s]."""
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place = code[order], item[order], place[order]
        self.seeds, self.first = np.unique(self.code, return_index=True)
        self.last = np.append(self.first[1:], len(code))

    def read(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text where seeds occur, and which seeds."""
        if not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = []
        for n in range(1, SEED_WORDS + 1):  # n-grams shorter than SEED_WORDS are seeds of the shortest items alone
            if n < SEED_WORDS and not self.short[n]:
                continue
            codes = self._grams(ids, n)
            at = np.searchsorted(self.seeds, codes).clip(max=len(self.seeds) - 1)
            where = np.flatnonzero((codes >= 0) & (self.seeds[at] == codes))
            found.append((where, at[where]))
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def _grams(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Codes of a text's n-grams, -1 where a word is none of the items'."""
        if len(ids) < n:
            return np.zeros(0, np.int64)
        out, known = np.zeros(len(ids) - n + 1, np.int64), np.ones(len(ids) - n + 1, bool)
        for k in range(n):
            part = ids[k : k + len(out)]
            out, known = out * self.size + part + 1, known & (part >= 0)
        return np.where(known, out, -1)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman): score, start and end of it in the passage."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        steps = -GAP * np.arange(len(b))
        row, top, end = np.zeros(len(b), np.int64), 0, 0
        for w in a.tolist():
            diagonal = np.where(b == w, MATCH, MISMATCH)
            diagonal[1:] += row[:-1]
            open_ = np.maximum(np.maximum(diagonal, row + GAP), 0)
            row = np.maximum.accumulate(open_ + steps) - steps
            if (m := int(row.max())) > top:
                top, end = m, int(row.argmax())
        return top, end

    score, end = best(item, passage)
    _, back = best(item[::-1], passage[end::-1])
    return score, end - back, end + 1


def leaks_in(items: Items, ids: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(number of the item, score, first and last+1 word of the passage) of every item that leaks into a text."""
    where, which = items.hits(ids)
    if not len(where):
        return []
    spans: dict[int, set[tuple[int, int]]] = {}
    for pos, seed in zip(where.tolist(), which.tolist(), strict=True):
        at = slice(items.first[seed], items.last[seed])
        for k, i in zip(items.item[at].tolist(), items.place[at].tolist(), strict=True):
            n = len(items.words[k])
            slack = n // 4 + 2
            spans.setdefault(k, set()).add((max(0, pos - i - slack), min(len(ids), pos - i + n + slack)))
    found = []
    for k, windows in sorted(spans.items()):
        item, best, joined = items.words[k], None, []
        for a, b in sorted(windows):  # windows that overlap become one, so each passage is aligned once
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        need = CUT * MATCH * len(item)
        wanted = np.bincount(item, minlength=items.size)
        for a, b in joined:
            passage = ids[a:b]
            shared = np.minimum(np.bincount(passage[passage >= 0], minlength=items.size), wanted).sum()
            if MATCH * shared < need:
                continue
            score, start, end = align(item, passage)
            if score >= need and (best is None or score > best[0]):
                best = (score, a + start, a + end)
        if best:
            found.append((k, best[0] / (MATCH * len(item)), best[1], best[2]))
    return found


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks, with all their seeds, one block at a time on the driver.

    Items are dealt by a hash of id and text, copies apart by their number, so neither null nor repeated ids make a block
    larger than the others.
    """
    items = only(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").groupBy("item_id", "text").agg(F.count("*").alias("copies"))
    size = items.select(F.sum(F.octet_length("text") * F.col("copies"))).first()[0] or 0
    n = max(1, -(-2 * size // BLOCK_BYTES) if size > BLOCK_BYTES else 1)  # half full on average
    parts = items.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("block", F.pmod(F.xxhash64("item_id", "text", "k"), F.lit(n)))
    for b in range(n):
        rows = parts.filter(F.col("block") == b).select("item_id", "text").collect()
        if sum(len(r[1].encode()) for r in rows) > 2 * BLOCK_BYTES:
            raise ValueError("a test item is longer than a block")
        yield Items(sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word (exclusive) of each item that leaks into a document."""
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    found, rows_of = None, only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                rows = [(d.as_py(), own.ids[k], s, a, b) for d, t in zip(batch.column(0), batch.column(1), strict=True) for k, s, a, b in leaks_in(own, own.read(t.as_py()))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=schema.replace(",", "").split()[::2])

        part = rows_of.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaks, all columns as they are."""
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def made(shared=shared) -> Callable[..., pa.Array]:
            own = shared.value
            return lambda texts: pa.array([not leaks_in(own, own.read(t.as_py())) for t in texts], pa.bool_())

        docs = filtered(docs, ["text"], made)
    return docs
