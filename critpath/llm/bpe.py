"""Byte-level BPE encoding and decoding by tree concatenation.

Two levels, both exact and both without limits on the length of a text:

* Documents longer than PIECE characters are cut into pieces that different tasks encode. Around each join a window
  is re-encoded that starts at a split point of the left piece which no text to its right can move, and grows until
  its split points meet one of the right piece; splitting runs left to right, so from there on both sides agree. A stretch
  that runs on from piece to piece keeps its tokens: the window then grows token by token, as within a stretch.
* A stretch that the splitting pattern leaves whole and that exceeds LEAF bytes is halved, the halves are encoded,
  and a window of tokens around the join grows until its outermost tokens equal those of both sides. A token
  sequence is the BPE encoding of its bytes if every two neighbours are the encoding of theirs, which then holds for
  all: inside both halves, inside the window and where they meet.

Defined results: null and empty texts have no tokens; a special token's string inside a text is that token, as the
tokenizers library reads it; repeated rows and doc_ids keep a row each; other columns are ignored and may have any name;
no rows, no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.llm.common import only

VOCABULARY = "byte_bpe_50k.json"
PIECE = 1 << 16
LEAF = 1 << 11
#: Characters that splitting may look ahead: the longest special string, or a contraction.
MARGIN = 16
#: Entries of a worker's cache of encoded stretches, and their longest length.
CACHE_ROWS, CACHE_CHARS = 400_000, 32
_BEYOND = regex.compile(r"[԰-\U0010FFFF]")
_BREAK = regex.compile(r"\S\s")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a visible character: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder of one vocabulary file, with a bounded cache of encoded stretches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, added = _byte_of(), {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.special, self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}, frozenset(added.values())
        self.bytes_of = [b""] * (1 + max(*ranks.values(), *added.values()))
        for t, i in ranks.items():
            self.bytes_of[i] = t
        for t, i in added.items():
            self.bytes_of[i] = t.encode()
        from public_tokenizers import PATTERN

        self.path, self.pattern = path, regex.compile(PATTERN)
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.cache: dict[str, bytes] = {}
        self.library = None
        #: bytes that joins encoded anew
        self.again = 0

    def stretch(self, data: bytes) -> list[int]:
        """Ids of bytes that the pattern leaves whole."""
        if len(data) <= LEAF:
            return self.core.encode_single_piece(data)
        half = len(data) // 2
        return self.joined(self.stretch(data[:half]), self.stretch(data[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        k, window = self.seam(left, right)
        return left[: max(0, len(left) - k)] + window + right[k:]

    def seam(self, left: Sequence[int], right: Sequence[int]) -> tuple[int, list[int]]:
        """How many tokens at either side of a join are encoded anew, and as what."""
        k = 4
        while True:
            a, b = [int(i) for i in left[-k:]], [int(i) for i in right[:k]]
            data = b"".join([self.bytes_of[i] for i in a + b])
            self.again += len(data)
            window = self.core.encode_single_piece(data)
            start = k >= len(left) or window[:2] == a[:2]
            end = k >= len(right) or window[-2:] == b[-2:]
            if start and end and (len(window) >= 4 or k >= max(len(left), len(right))):
                return k, window
            k *= 2

    def packed(self, part: str) -> bytes:
        """Ids of one stretch as little-endian unsigned 32-bit integers."""
        found = self.cache.get(part)
        if found is None:
            found = np.array(self.stretch(part.encode()), "<u4").tobytes()
            if len(part) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ROWS:
                    self.cache.clear()
                self.cache[part] = found
        return found

    def splits(self, text: str) -> list[str]:
        """The stretches of a text, special strings among them."""
        if self.around is None or not any(s in text for s in self.special):
            return self.pattern.findall(text)
        return [y for x in self.around.split(text) for y in ([x] if x in self.special else self.pattern.findall(x))]

    def odd(self, text: str) -> bool:
        """Whether a character is too new for both Unicode tables to be known alike; such texts go to the library."""
        return bool(_BEYOND.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))

    def encode(self, text: str) -> bytes:
        if self.odd(text):
            return np.array(self.by_library(text), "<u4").tobytes()
        return b"".join([self.special.get(x) or self.packed(x) for x in self.splits(text)])

    def by_library(self, text: str) -> list[int]:
        """Ids by the tokenizers library, part by part: parts end where any version of its pattern splits."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return [i for part in chunks(text) for i in self.library.encode(part, add_special_tokens=False).ids]

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Bpe:
    return Bpe(path)


def chunks(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in parts of about size characters that end before white space after a word: always a split point."""
    at = 0
    while len(text) - at > size:
        if not (m := _BREAK.search(text, at + size)):
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


class Encoded:
    """A piece's ids with the token offsets at which its stretches start (and end)."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.ids, self.bounds = ids, bounds

    @classmethod
    def of(cls, bpe: Bpe, text: str) -> Encoded:
        parts = [bpe.special.get(x) or bpe.packed(x) for x in bpe.splits(text)]
        bounds = np.cumsum([0, *(len(x) // 4 for x in parts)])
        return cls(np.frombuffer(b"".join(parts), "<u4"), bounds)


def concatenated(bpe: Bpe, left: Encoded, right: Encoded) -> Encoded:
    """The encoding of two pieces' text as one."""
    text = lambda ids: b"".join([bpe.bytes_of[i] for i in ids.tolist()]).decode()
    k = 4
    while True:
        i, j = max(0, len(left.bounds) - 1 - k), min(len(right.bounds) - 1, k)
        a, b = int(left.bounds[i]), int(right.bounds[j])
        before, after = text(left.ids[a:]), text(right.ids[:b])
        whole_left, whole_right = i == 0, j == len(right.bounds) - 1
        if whole_left or len(before) > MARGIN:
            parts = bpe.splits(before + after)
            ends = np.cumsum([len(x) for x in parts])
            theirs = {len(before) + n: m for n, m in zip(np.cumsum([0, *map(len, _cut(bpe, right, j))]).tolist(), right.bounds[: j + 1].tolist(), strict=True)}
            last = len(before) + len(after) - (0 if whole_right else MARGIN)
            for n, end in enumerate(ends.tolist()):
                if end in theirs and end <= last and end >= len(before):
                    m = theirs[end]
                    over = _across(bpe, left, right, parts[n], end, len(before))
                    packed = [over if over is not None and q == n else bpe.special.get(x) or bpe.packed(x) for q, x in enumerate(parts[: n + 1])]
                    middle = np.frombuffer(b"".join(packed), "<u4")
                    ids = np.concatenate((left.ids[:a], middle, right.ids[m:]))
                    inner = a + np.cumsum([len(x) // 4 for x in packed])
                    outer = right.bounds[np.searchsorted(right.bounds, m) + 1 :] - m + a + len(middle)
                    return Encoded(ids, np.concatenate((left.bounds[: i + 1], inner, outer)))
            if whole_left and whole_right:
                return Encoded.of(bpe, before + after)
        k *= 2


def _across(bpe: Bpe, left: Encoded, right: Encoded, part: str, end: int, join: int) -> bytes | None:
    """Ids of a stretch that is the last of left and the first of right as one: only tokens around the join are encoded anew."""
    if part in bpe.special or len(left.bounds) < 2 or len(right.bounds) < 2:
        return None
    a, b = left.ids[int(left.bounds[-2]) :], right.ids[: int(right.bounds[1])]
    if len(a) + len(b) < 64 or any(int(i) in bpe.added for i in (a[0], b[0])):
        return None
    size = lambda ids: len(b"".join([bpe.bytes_of[i] for i in ids.tolist()]).decode())
    first, second = size(a), size(b)
    if end != join + second or len(part) != first + second:
        return None
    k, window = bpe.seam(a, b)
    return np.concatenate((a[: max(0, len(a) - k)], np.array(window, "<u4"), b[k:])).astype("<u4").tobytes()


def _cut(bpe: Bpe, piece: Encoded, j: int) -> list[str]:
    return [b"".join([bpe.bytes_of[i] for i in piece.ids[x:y].tolist()]).decode() for x, y in zip(piece.bounds[:j].tolist(), piece.bounds[1 : j + 1].tolist(), strict=True)]


def tree(bpe: Bpe, pieces: list[Encoded]) -> Encoded:
    """Pieces joined two by two until one is left."""
    while len(pieces) > 1:
        pieces = [concatenated(bpe, *pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0]


RESULT = "doc_id long, ids binary, decoded string"


PART = "doc_id long, row long, pos long, exact boolean, "


def encode_documents(docs: DataFrame, path: str | None = None, piece: int = PIECE) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), decoded (the text that those ids give)."""
    path = path or vocabulary_path()
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                ids = [bpe.encode(x.as_py()) for x in part.column(1)]
                texts = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    def rows_of(rows: list[tuple], last: tuple[str, pa.DataType], *more: tuple[str, pa.DataType]) -> pa.RecordBatch:
        fields = [("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int64()), ("exact", pa.bool_()), last, *more]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                exact = encoder(path).odd(text)  # such texts are cut at split points alone, and their parts are put together as they are
                parts = list(chunks(text, piece)) if exact else [text[k : k + piece] for k in range(0, len(text), piece)]
                for k in range(0, len(parts), 16):
                    yield rows_of([(doc.as_py(), row.as_py(), k + n, exact, x) for n, x in enumerate(parts[k : k + 16])], ("text", pa.string()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for doc, row, pos, exact, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if exact:
                    ids = np.array(bpe.by_library(text.as_py()), "<u4")
                    found = Encoded(ids, np.array([0, len(ids)]))
                else:
                    found = Encoded.of(bpe, text.as_py())
                yield rows_of([(doc, row, pos, exact, found.ids.tobytes(), found.bounds.astype("<i8").tobytes())], ("ids", pa.binary()), ("bounds", pa.binary()))

    def joined(group: pa.Table) -> pa.Table:
        bpe, rows = encoder(path), sorted(group.to_pylist(), key=lambda x: x["pos"])
        copies = sum(x["pos"] == 0 for x in rows)  # rows with the same doc_id and text
        rows = rows[::copies]
        parts = [Encoded(np.frombuffer(x["ids"], "<u4"), np.frombuffer(x["bounds"], "<i8")) for x in rows]
        ids = np.concatenate([x.ids for x in parts]) if rows[0]["exact"] else tree(bpe, parts).ids
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]] * copies, pa.int64()), "ids": pa.array([ids.tobytes()] * copies, pa.binary()), "decoded": pa.array([bpe.decode(ids)] * copies)})

    short = docs.filter(F.length("text") <= piece).mapInArrow(whole, RESULT)
    # a row is known by its content, so that a task that runs again gives its pieces the same name
    long = docs.filter(F.length("text") > piece).withColumn("row", F.xxhash64("doc_id", "text")).select("doc_id", "row", "text")
    parts = long.mapInArrow(cut_up, PART + "text string").repartition(F.col("row"), F.col("pos"))
    done = parts.mapInArrow(encoded, PART + "ids binary, bounds binary").groupBy("row", "doc_id").applyInArrow(joined, RESULT)
    return short.unionByName(done)


def digests(encodings: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and more columns as they are."""
    return encodings.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )

