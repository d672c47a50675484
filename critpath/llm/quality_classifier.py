"""Quality by compression: zstandard dictionaries of good and bad labelled text.

Every window of a text is compressed under both. The score comes from the normalised difference of the summed sizes,
(bad - good) / (bad + good), and from nothing else: a nondecreasing curve, fitted on labelled documents that are not in
the dictionaries, turns it into a probability. Both dictionaries are of one size and hold short windows of the training
texts, dealt alike over the texts, so that a long text gives no more of them than a short one while there is a choice.

Defined results: null and empty texts are one empty window and get a score like any other; repeated rows keep a row
each; with too few labels of a kind every score is the share of good labels (0.5 with none); columns other than doc_id
and text never enter a score and may have any name; no rows, no rows.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType

from critpath.llm import labelled
from critpath.llm.common import appended

#: Labelled documents of each class that a model is fitted on, whole texts; two of three go into the dictionaries.
PER_CLASS, APART = 2000, 3
WINDOW, LEVEL, DICTIONARY_BYTES, CUT = 256, 6, 1 << 18, 0.5


def windows(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data)), WINDOW)]


def dictionary(texts: list[str], size: int) -> bytes:
    """size bytes of windows: a text's windows in a fixed mixed order, the first of every text, then the second, and so on."""
    draw, dealt = random.Random(1), [windows(t) for t in texts]
    for d in dealt:
        draw.shuffle(d)
    chosen, total, turn = [], 0, 0
    while total < size and any(len(d) > turn for d in dealt):
        more = [d[turn] for d in dealt if len(d) > turn]
        chosen += more
        total += sum(len(w) + 1 for w in more)
        turn += 1
    draw.shuffle(chosen)
    return b"\n".join(chosen)[:size]


class Model:
    """Dictionaries and the curve; without it, a constant."""

    def __init__(self, good: bytes, bad: bytes, curve: labelled.Curve | None, constant: float):
        self.good, self.bad, self.curve, self.constant, self.both = good, bad, curve, constant, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"both": None}

    def figure(self, text: str | None) -> float:
        """The normalised difference of the compressed sizes."""
        if self.both is None:
            self.both = [labelled.compressor(x, LEVEL) for x in (self.good, self.bad)]
        parts = windows(text)
        good, bad = (sum(len(c.compress(w)) for w in parts) for c in self.both)
        return (bad - good) / (bad + good)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.constant)
        return self.curve.of(np.array([self.figure(t) for t in texts], float))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def fit(good: list[str], bad: list[str], share: float | None = None) -> Model:
    """share: of good texts among all; the sample holds as many of either kind as it can."""
    share = share if share is not None else len(good) / (len(good) + len(bad)) if good or bad else 0.5
    if min(len(good), len(bad)) < 2 * APART:
        return Model(b" " * 8, b" " * 8, None, share)
    own, apart = ([[t for i, t in enumerate(x) if (i % APART == 0) == held] for x in (good, bad)] for held in (False, True))
    size = min(DICTIONARY_BYTES, *(sum(len(t.encode()) + 1 for t in x) for x in own))
    model = Model(*(dictionary(x, size) for x in own), None, share)
    figures = np.array([model.figure(t) for x in apart for t in x])
    model.curve = labelled.Curve(figures, np.repeat([1, 0], [len(x) for x in apart]), share)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*labelled.sample(docs, labels, "quality", PER_CLASS, PER_CLASS), labelled.share(labels, "quality"))


def score_documents(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The carried columns of docs and quality_score (with leading underscores if that name is carried)."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # two dictionaries of DICTIONARY_BYTES

    def made() -> Callable[..., list[pa.Array]]:
        own: Model = pickle.loads(shared.value)
        return lambda texts: [pa.array(own.scores(texts.to_pylist()), pa.float64())]

    return appended(docs, ["text"], carry, {"quality_score": DoubleType()}, made)
