"""Toxicity by compression distance.

Two zstandard dictionaries, one of ordinary text and one of toxic text. The toxic one holds the segments that toxic
texts have far more often than ordinary ones, in front of the same ordinary text, so a window without such a segment
compresses alike under both. A window is one word in a fixed frame; its gain is the number of bytes that it is shorter
under the toxic dictionary. A text's figure is how many of its windows gain at least a threshold. A second pair of
dictionaries may hold whole words. Shortest match, thresholds, the second pair and the probability of each count are
calibrated on labelled rows that the fold's dictionaries have not seen.

Window gains depend on the word alone, so a worker keeps them in a bounded cache.

Defined results: null and empty texts have no window and a score from no hits; repeated rows keep a row each; no labels
of either kind: every score is the share of toxic labels (0.5 with none) and nothing is above it; columns outside
doc_id and text never enter a score and may have any name; no rows, no rows.
"""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType

from critpath.llm import labelled
from critpath.llm.bpe import CACHE_CHARS, CACHE_ROWS
from critpath.llm.common import appended, filtered, words_of
from critpath.llm.simhash import shingle_hashes

#: Labelled documents of each class that a model is fitted on, whole texts.
PER_CLASS = 2000
#: Bytes of the shortest match that may count (each is tried), and what makes a part of that length tell toxic texts:
#: least odds, and least log-likelihood ratio among some ten thousand candidates.
LENGTHS, ODDS, LEAST_EVIDENCE = (5, 6), 20.0, 9.0
#: Stands for whole words as parts, for telling words that are made of common pieces.
WHOLE = 0
#: Ordinary text in both dictionaries, segments in one, and the frame that ends a window.
ORDINARY_BYTES, SEGMENTS, FRAME = 8000, 4000, b"=0123456789abcdef="
#: Window gains that may make a hit, and the number of hits from which on texts are alike.
THRESHOLDS, WHOLE_THRESHOLDS, MOST = range(1, 7), (None, 2, 3, 4, 5), 4
#: A text is toxic from this score on.
CUT = 0.7


def _parts(word: bytes, n: int) -> list[bytes]:
    framed = b" " + word + b" "
    if n == WHOLE:
        return [framed]
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def segments(toxic: list[list[bytes]], ordinary: list[list[bytes]], n: int) -> list[bytes]:
    """Longest runs of parts that mark toxic texts, most frequent first; every part of a segment marks them."""
    a, b = (Counter(p for words in docs for p in {p for w in set(words) for p in _parts(w, n)}) for docs in (toxic, ordinary))
    pos, neg = len(toxic), max(1, len(ordinary))
    share = pos / (pos + neg)

    def marks(part: bytes) -> bool:
        x, y = a[part], b[part]
        if x / pos <= ODDS * (y + 0.2) / neg:
            return False
        return x * math.log(x / ((x + y) * share)) + (y * math.log(y / ((x + y) * (1 - share))) if y else 0.0) >= LEAST_EVIDENCE

    marked = {p for p in a if marks(p)}
    runs: Counter[bytes] = Counter()
    for words in toxic:
        for word in words:
            framed, i, parts = b" " + word + b" ", 0, _parts(word, n)
            while i < len(parts):
                j = i
                while j < len(parts) and parts[j] in marked:
                    j += 1
                if j > i:
                    runs[framed if n == WHOLE else framed[i : j + n - 1]] += 1
                i = j + 1
    return [r for r, _ in sorted(runs.items(), key=lambda x: (-x[1], x[0]))[:SEGMENTS]]


def distinct(docs: list[list[bytes]]) -> list[list[bytes]]:
    """docs without later ones that share one of three least five-word shingles with an earlier one: near copies."""
    seen: set[int] = set()
    kept = []
    for words in docs:
        hashes = shingle_hashes(words, 5)
        least = {int((hashes * np.uint64(m) >> np.uint64(3)).min(initial=1 << 62)) * 3 + k for k, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))}
        if not least & seen:
            kept.append(words)
        seen |= least
    return kept


class Gains(dict):
    """Bytes that a word's window gains under the toxic dictionary; a bounded cache."""

    def __init__(self, toxic: bytes, ordinary: bytes, shortest: int):
        super().__init__()
        options = {"source_size": 64, "min_match": shortest or 6, "strategy": zstandard.STRATEGY_LAZY2, "hash_log": 17, "chain_log": 17, "search_log": 6, "window_log": 17, "target_length": 64}
        self.toxic, self.ordinary = (labelled.compressor(x, 9, **options) for x in (toxic, ordinary))
        # a whole word counts if it needs no more than the dictionary's own words do, that is one match from end to end
        own = [x for x in toxic[: len(toxic) - len(ordinary)].split(b"\n") if x] if shortest == WHOLE else []
        self.floor = max((len(self.toxic.compress(x + FRAME)) for x in own), default=0) if shortest == WHOLE else 1 << 30

    def __missing__(self, word: bytes) -> int:
        window = b" " + word + b" " + FRAME
        size = len(self.toxic.compress(window))
        gain = len(self.ordinary.compress(window)) - size if size <= self.floor else 0
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ROWS:
                self.clear()
            self[word] = gain
        return gain

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], n: int) -> tuple[bytes, bytes]:
    known = [w for words in ordinary for w in words]
    random.Random(1).shuffle(known)  # so that a dictionary of ORDINARY_BYTES holds words of any place in any text
    plain = b" ".join(known[:ORDINARY_BYTES])[:ORDINARY_BYTES] + FRAME
    return b"\n".join(segments(toxic, ordinary, n)[::-1]) + b"\n" + plain, plain


class Detector:
    """One pair of dictionaries with the least gain of a hit."""

    def __init__(self, toxic: bytes, ordinary: bytes, shortest: int, threshold: int):
        self.toxic, self.ordinary, self.shortest, self.threshold = toxic, ordinary, shortest, threshold
        self.gains: Gains | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"gains": None}

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.gains is None:
            self.gains = Gains(self.toxic, self.ordinary, self.shortest)
        return self.gains.of(words)


class Model:
    """One or two detectors, and the probability of each number of windows (0 to MOST) that is a hit for any of them."""

    def __init__(self, detectors: list[Detector], table: list[float]):
        self.detectors, self.table = detectors, table

    def score(self, text: str | None) -> tuple[float, int]:
        """The probability of label 1 and the number of hits."""
        words = words_of(text)
        hit, best = np.zeros(len(words), bool), 0
        for d in self.detectors:
            gains = d.of(words)
            hit |= gains >= d.threshold
            best = max(best, int(gains.max(initial=0)))
        hits = int(hit.sum())
        # between texts of one probability, hits per window and the best gain order the scores, by less than 0.001
        finer = 8e-4 * (hits / (1 + len(words)) + min(best, 20) / 100)
        return min(1.0, 0.999 * self.table[min(hits, MOST)] + finer), hits


def fit(toxic: list[str], ordinary: list[str], folds: int = 3) -> Model:
    pos, neg = distinct([words_of(t) for t in toxic]), distinct([words_of(t) for t in ordinary])
    if min(len(pos), len(neg)) < folds:
        share = len(pos) / (len(pos) + len(neg)) if pos or neg else 0.5
        return Model([], [min(share, CUT - 0.01)] * (MOST + 1))
    gains: dict[int, list[np.ndarray]] = {n: [] for n in (*LENGTHS, WHOLE)}
    y = []
    for k in range(folds):
        apart = lambda docs, own: [d for i, d in enumerate(docs) if (i % folds == k) == own]  # noqa: B023, E731
        for n, found in gains.items():
            g = Gains(*dictionaries(apart(pos, False), apart(neg, False), n), n)
            found += [g.of(w) for docs in (pos, neg) for w in apart(docs, True)]
        y += [1] * len(apart(pos, True)) + [0] * len(apart(neg, True))
    y, best = np.array(y), None
    for n in LENGTHS:
        for threshold in THRESHOLDS:
            for whole in WHOLE_THRESHOLDS:
                hits = np.array([min(MOST, int(((g >= threshold) | (w >= whole) if whole else g >= threshold).sum())) for g, w in zip(gains[n], gains[WHOLE], strict=True)])
                ones, every = np.bincount(hits, y, MOST + 1), np.bincount(hits, minlength=MOST + 1)
                table = labelled.monotone((ones + 0.5) / (every + 1), every + 1e-9)
                p = np.clip(table[hits], 1e-6, 1 - 1e-6)
                loss = -np.where(y == 1, np.log(p), np.log(1 - p)).mean()
                if best is None or loss < best[0] - 1e-9:
                    best = (loss, n, threshold, whole, table.tolist())
    _, n, threshold, whole, table = best
    detectors = [Detector(*dictionaries(pos, neg, n), n, threshold)]
    return Model(detectors + ([Detector(*dictionaries(pos, neg, WHOLE), WHOLE, whole)] if whole else []), table)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*labelled.sample(docs, labels, "toxic", PER_CLASS, PER_CLASS))


def _shared(docs: DataFrame, model: Model) -> Callable[[], Model]:
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # under 400 kB: ORDINARY_BYTES and SEGMENTS bound it
    return lambda: pickle.loads(sent.value)


def score_documents(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The carried columns of docs and toxic_score, toxic_hits (names in use get leading underscores)."""
    own = _shared(docs, model)

    def made() -> Callable[..., list[pa.Array]]:
        mine = own()

        def scored(texts: pa.Array) -> list[pa.Array]:
            found = [mine.score(x.as_py()) for x in texts]
            return [pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())]

        return scored

    return appended(docs, ["text"], carry, {"toxic_score": DoubleType(), "toxic_hits": LongType()}, made)


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score stays below CUT, all columns as they are."""
    own = _shared(docs, model)

    def made() -> Callable[..., pa.Array]:
        mine = own()
        return lambda texts: pa.array([mine.score(x.as_py())[0] < CUT for x in texts], pa.bool_())

    return filtered(docs, ["text"], made)
