"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A node's features are its subtree's size, density, links and paragraphs, its depth, place and size among siblings, and
how often its element name and attribute words, and those of its ancestors, belonged to articles in training. The
trees give each node the log-odds of being kept. Decoding finds the best consistent choice for the whole tree: a node
that is dropped takes its subtree along, a kept node's ancestors are kept, and of all such choices the one of greatest
summed log-likelihood is taken.

The model is trained on generated pages (html_training), never on the corpus.

Defined results: null and empty pages have an empty text; broken markup is read as far as it goes, unclosed elements end
with their parents; repeated rows keep a row each; other columns are ignored unless carried; no rows, no rows.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from critpath.llm import boosting, html_training
from critpath.llm.common import appended
from critpath.llm.html_tree import SILENT, Node, parse, walk

TRAINING_PAGES = 1500
_MARKS = {"keep", "drop"}


def _totals(nodes: list[Node]) -> dict[int, np.ndarray]:
    """Of each node: characters, link characters, tags, paragraphs, inputs, stops, digits and texts of its subtree."""
    out: dict[int, np.ndarray] = {}
    for node in reversed(nodes):
        own = "".join([t for _, t in node.texts]).strip()
        v = np.array([len(own), node.link_chars, node.tags, node.tag == "p", node.inputs, sum(map(own.count, ".,;:!?")), sum(map(str.isdigit, own)), bool(own)], float)
        for child in node.children:
            v += out[id(child)]
        out[id(node)] = v
    return out


def features(nodes: list[Node], odds: dict[str, float]) -> np.ndarray:
    totals, rows = _totals(nodes), []
    page, above = totals[id(nodes[0])][0] + 1, {}
    before = 0.0
    places = {id(c): i for n in nodes for i, c in enumerate(n.children)}
    for node in nodes:
        t, parent = totals[id(node)], node.parent
        tag = odds.get("<" + node.tag, 0.0)
        words = [odds.get(w, 0.0) for w in node.tokens]
        low, high = min(words, default=0.0), max(words, default=0.0)
        up = above[id(parent)] if parent else (0.0, 0.0, 0.0)
        above[id(node)] = (min(up[0], low, 0.0), max(up[1], high, 0.0), min(up[2], tag))
        siblings = parent.children if parent else [node]
        mean = (totals[id(parent)][0] if parent else t[0]) / len(siblings)
        own = sum(len(x) for _, x in node.texts)
        rows.append([
            node.depth, len(siblings), places.get(id(node), 0) / len(siblings), math.log1p(t[0]), math.log1p(own), t[1] / (t[0] + 1), math.log1p(t[0] / t[2]),
            len(node.children), t[3], t[5] / (t[0] + 1), tag, odds.get("<" + parent.tag, 0.0) if parent else 0.0, low, high, *up, math.log1p(mean), t[0] / (mean + 1),
            t[6] / (t[0] + 1), t[4], t[0] / page, before / page, t[0] / (t[7] + 1), len(node.tokens),
        ])
        before += own
    return np.array(rows)


def marked(nodes: list[Node]) -> list[bool]:
    """Labels of a generated page, from the nearest mark above; marks are taken off the nodes."""
    labels: dict[int, bool] = {}
    for node in nodes:
        mark = [w for w in node.tokens if w in _MARKS]
        node.tokens = [w for w in node.tokens if w not in _MARKS]
        above = labels[id(node.parent)] if node.parent else True
        labels[id(node)] = above and mark != ["drop"]
    return [labels[id(n)] for n in nodes]


class Extractor:
    def __init__(self, odds: dict[str, float], trees: boosting.Boosted):
        self.odds, self.trees = odds, trees

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = [walk(parse(p)) for p in pages]
        if not trees:
            return []
        logits = self.trees.logits(np.concatenate([features(nodes, self.odds) for nodes in trees]))
        ends = np.cumsum([len(nodes) for nodes in trees])
        return [joined(nodes, decoded(nodes, logits[e - len(nodes) : e])) for nodes, e in zip(trees, ends.tolist(), strict=True)]


def decoded(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """The most likely consistent choice: dropped nodes have dropped subtrees."""
    keep = -np.logaddexp(0, -logits)
    drop = -np.logaddexp(0, logits)
    place = {id(n): i for i, n in enumerate(nodes)}
    best, gone = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, -1, -1):
        for child in nodes[i].children:
            j = place[id(child)]
            gone[i] += gone[j]
            best[i] += max(best[j], gone[j])
    kept = [True] * len(nodes)
    for i, node in enumerate(nodes):
        if node.parent is not None:
            kept[i] = kept[place[id(node.parent)]] and node.tag not in SILENT and bool(best[i] >= gone[i])
    return kept


def joined(nodes: list[Node], kept: list[bool]) -> str:
    """Texts of kept nodes in page order; text of one block without a block between is one piece."""
    pieces = sorted((order, i, text) for i, (node, k) in enumerate(zip(nodes, kept, strict=True)) if k for order, text in node.texts)
    starts = sorted(n.order for n in nodes)
    out, last, at = [], None, 0
    for order, i, text in pieces:
        passed = at
        while at < len(starts) and starts[at] < order:
            at += 1
        out.append(text if i == last and passed == at else " " + text)
        last = i
    return " ".join("".join(out).split())


@lru_cache(maxsize=1)
def trained(n: int = TRAINING_PAGES) -> bytes:
    """The extraction model, pickled: a few dozen small trees and a few hundred words, whatever the corpus."""
    pages = [walk(parse(p)) for p in html_training.pages(n)]
    labels = [marked(nodes) for nodes in pages]
    counts: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for nodes, ys in zip(pages, labels, strict=True):
        for node, y in zip(nodes, ys, strict=True):
            for w in {*node.tokens, "<" + node.tag}:
                counts[w][y] += 1
    odds = {w: math.log(a[1] / a[0]) for w, a in counts.items() if sum(a) >= 5}
    x = np.concatenate([features(nodes, odds) for nodes in pages])
    return pickle.dumps(Extractor(odds, boosting.fit(x, np.array(sum(labels, []), float), trees=90)))


def extract(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of pages (page_id, url) and text (with leading underscores if that name is carried)."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def made() -> Callable[..., list[pa.Array]]:
        model: Extractor = pickle.loads(shared.value)
        return lambda htmls: [pa.array(model.texts([x.as_py() for x in htmls]), pa.string())]

    return appended(pages, ["html"], ["page_id", "url"] if carry is None else carry, {"text": StringType()}, made, 64)
