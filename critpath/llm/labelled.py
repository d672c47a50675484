"""Labelled training rows and small calibrated models for the classifiers of this subpackage."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.llm.common import crc_mod, only

#: Rows whose crc32(doc_id) leaves this remainder are held out of learning.
FOLDS, HELD_OUT = 3, 1


def _usable(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y of the documents to learn from; those with labels of both kinds are left out."""
    rows = only(labels, "doc_id", column).filter(crc_mod("doc_id", FOLDS) != HELD_OUT).select("doc_id", F.col(column).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("doc_id", "y")


def sample(docs: DataFrame, labels: DataFrame, column: str, ones: int, zeros: int) -> tuple[list[str], list[str]]:
    """Whole texts of at most so many documents labelled 1 and 0, in an order that depends on the doc_id alone; copies once.

    The labels are cut before they meet the documents, so the broadcast side is bounded, and rows of one doc_id become
    one before they reach the driver.
    """
    usable, order = _usable(labels, column), F.xxhash64("doc_id", F.lit(7))
    picked = usable.filter("y = 1").orderBy(order, "doc_id").limit(ones).unionByName(usable.filter("y = 0").orderBy(order, "doc_id").limit(zeros))
    rows = only(docs, "doc_id", "text").filter("text is not null").join(F.broadcast(picked), "doc_id")  # ones + zeros rows
    found = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).toArrow().to_pylist()
    found.sort(key=lambda r: (hash_of(r["doc_id"]), r["doc_id"]))
    texts: tuple[dict, dict] = ({}, {})
    for r in found:
        texts[r["y"]].setdefault(r["text"], None)
    return list(texts[1]), list(texts[0])


def share(labels: DataFrame, column: str) -> float:
    """The share of label 1 among all documents to learn from (0.5 without any)."""
    ones, every = _usable(labels, column).select(F.sum("y"), F.count("y")).first()
    return (ones or 0) / every if every else 0.5


def hash_of(n: int) -> int:
    """A fixed mixing of integers, for an order without regard to their size."""
    return (n * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 11


def held_out(column: str = "doc_id"):
    return crc_mod(column, FOLDS) == HELD_OUT


def compressor(content: bytes, level: int, **options) -> zstandard.ZstdCompressor:
    """A zstandard compressor with content as its dictionary and frames as short as can be."""
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), **plain, **options)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


def monotone(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The nondecreasing values nearest to p under weights n (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for value, weight in zip(p, n, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v, w, k = blocks.pop()
            u = blocks[-1]
            total = u[1] + w
            blocks[-1] = [(u[0] * u[1] + v * w) / total if total else (u[0] + v) / 2, total, u[2] + k]
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks])


class Curve:
    """The probability of label 1 at a figure: nondecreasing, straight between the centres of the blocks that
    monotone() makes, with a slope of 1e-6 in all besides so that scores keep the figures' order."""

    def __init__(self, figures: np.ndarray, y: np.ndarray, share: float):
        """share: of label 1 where the curve is used; the rows given may hold any other."""
        ones = max(1e-9, min(1 - 1e-9, share))
        weight = np.where(y == 1, ones / max(1, (y == 1).sum()), (1 - ones) / max(1, (y == 0).sum()))
        x, inverse = np.unique(figures, return_inverse=True)
        w = np.bincount(inverse, weight, len(x))
        p = monotone(np.bincount(inverse, weight * y, len(x)) / w, w)
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        total = np.add.reduceat(w, starts)
        self.x = np.add.reduceat(w * x, starts) / total
        least = 0.5 / max(2, len(y))  # no probability is 0 or 1
        self.p = np.clip(p[starts], least, 1 - least)

    def of(self, figures: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(figures, self.x, self.p) * (1 - 2e-6) + 1e-6 + 1e-6 * np.tanh(figures), 0, 1)
