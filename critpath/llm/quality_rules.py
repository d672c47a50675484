"""Quality rules on tokeniser fertility.

A public vocabulary with byte fallback reads every word of a text. Three figures follow: characters per token, the
share of tokens that are single bytes, and the entropy of the tokens in bits. A text is rejected if a figure leaves
the band of its language or, for other languages, of its main script; short or repetitive texts fail before that.

Defined results: null and empty texts have no words and fail; ties do not occur; repeated rows keep a row each; without
a lang column (text), or for a null or unknown language, the script decides; other columns are ignored and may have any
name; no rows, no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, LongType

from critpath.llm.bpe import CACHE_CHARS, CACHE_ROWS
from critpath.llm.common import appended, filtered

VOCABULARY = "piece_bpe_32k.model"
WORD, SPACE, SYMBOLS = re.compile(r"[^ \t-\r]+"), " \t\n\v\f\r", "#*$%&|<>"
CHUNK, _END = 1 << 16, re.compile(r"[^ \t-\r][ \t-\r]")


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte-fallback share, least and most entropy in bits per token."""

    chars: tuple[float, float]
    bytes: float
    entropy: tuple[float, float]


@dataclass(frozen=True)
class Rules:
    """The floors by language are equal low quantiles of both figures of good documents (labels to learn from, none that are
    held out), the highest under which 98.5 % of those stay. short_entropy: few tokens can't reach a band's entropy; this share of what they can reach is enough."""

    min_words: int = 50
    max_repeat: float = 0.5
    short_entropy: float = 0.85
    by_language: dict[str, Band] = field(
        default_factory=lambda: {
            "en": Band((2.07, 8.0), 0.15, (5.81, 11.5)),
            "de": Band((2.1, 8.0), 0.15, (5.79, 11.5)),
            "fr": Band((1.84, 8.0), 0.15, (5.7, 11.5)),
            "es": Band((1.82, 8.0), 0.15, (5.8, 11.5)),
        }
    )
    by_script: dict[str, Band] = field(
        default_factory=lambda: {
            "latin": Band((1.5, 9.0), 0.3, (5.2, 12.0)),
            "greek, cyrillic": Band((1.0, 7.0), 0.5, (5.0, 12.0)),
            "cjk": Band((0.3, 4.0), 0.9, (4.0, 12.0)),
            "other": Band((0.2, 9.0), 1.0, (3.5, 12.0)),
        }
    )


SCRIPTS = {"latin": re.compile("[A-Za-zÀ-ɏ]"), "greek, cyrillic": re.compile("[Ͱ-ԯ]"), "cjk": re.compile("[぀-ヿ㐀-鿿가-힯]")}


def script_of(text: str) -> str:
    """The script with most characters of a text; ties go to the first in SCRIPTS; none: other."""
    counts = {k: sum(1 for _ in p.finditer(text)) for k, p in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


class Fertility:
    """Tokens of words under a sentencepiece vocabulary, with a bounded cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.cache: dict[str, bytes] = {}

    def tokens(self, word: str) -> bytes:
        found = self.cache.get(word)
        if found is None:
            found = np.array(self.pieces.encode(word, num_threads=1), np.int32).tobytes()
            if len(word) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ROWS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def of(self, words: list[str], counts: np.ndarray) -> tuple[int, int, float]:
        """Tokens, byte tokens and entropy of words that occur so many times."""
        packed = [self.tokens(w) for w in words]
        ids = np.frombuffer(b"".join(packed), np.int32)
        if not len(ids):
            return 0, 0, 0.0
        weights = np.repeat(counts, np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed)))
        per_id = np.bincount(ids, weights)
        p = per_id[per_id > 0] / per_id.sum()
        return int(weights.sum()), int(weights[self.is_byte[ids]].sum()), float(-(p * np.log2(p)).sum())


@lru_cache(maxsize=2)
def reader(path: str) -> Fertility:
    return Fertility(path)


def repeated_words(ids: np.ndarray, distinct: int, window: int = 3) -> int:
    """Words in windows that are found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.int64)
    for k in range(window):  # codes stay below 2**63: ranks are taken after each word
        key = key * distinct + ids[k : k + n]
        if k + 1 < window and distinct > 1 << 20:
            key = np.unique(key, return_inverse=True)[1]
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[place] > 1)
    hit = np.zeros(len(ids), bool)
    for k in range(window):
        hit[starts + k] = True
    return int(hit.sum())


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text in parts of about size characters that end before white space that ends a word here (bpe's knows more kinds)."""
    at = 0
    while len(text) - at > size and (m := _END.search(text, at + size)):
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


def measured(text: str, fertility: Fertility) -> dict:
    vocabulary: dict[str, int] = {}
    parts = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(part)), np.int64) for part in chunks(text)]
    ids = np.concatenate(parts)
    counts = np.bincount(ids, minlength=len(vocabulary))
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            duplicates += line in seen
            seen.add(line)
    tokens, byte_tokens, entropy = fertility.of(list(vocabulary), counts)
    chars = len(text) - sum(map(text.count, SPACE))
    return {
        "n_words": len(ids), "word_chars": chars, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": duplicates,
        "n_repeat_words": repeated_words(ids, len(vocabulary)), "n_tokens": tokens, "chars_per_token": chars / max(1, tokens),
        "byte_share": byte_tokens / max(1, tokens), "entropy": entropy,
    }


def verdict(m: dict, text: str, lang: str | None, rules: Rules) -> tuple[bool, bool]:
    """Whether the base rules fail, and whether the text is kept."""
    failed = m["n_words"] < rules.min_words or m["n_repeat_words"] > rules.max_repeat * m["n_words"]
    if failed:
        return True, False
    band = rules.by_language.get(lang or "") or rules.by_script[script_of(text)]
    least = min(band.entropy[0], rules.short_entropy * math.log2(max(2, m["n_tokens"])))
    good = band.chars[0] <= m["chars_per_token"] <= band.chars[1] and m["byte_share"] <= band.bytes and least <= m["entropy"] <= band.entropy[1]
    return False, good


_FIGURES = {k: LongType() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": BooleanType(), "kept": BooleanType(), "n_tokens": LongType(), "chars_per_token": DoubleType(), "byte_share": DoubleType(), "entropy": DoubleType()}


def _judge(rules: Rules | None, path: str | None) -> Callable[[], Callable[[str | None, str | None], dict]]:
    """Gives a worker its function from text and language to figures and verdict."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    rules = rules or Rules()

    def made() -> Callable[[str | None, str | None], dict]:
        fertility = reader(path)

        def judged(text: str | None, lang: str | None) -> dict:
            m = measured(text or "", fertility)
            m["base_failed"], m["kept"] = verdict(m, text or "", lang, rules)
            return m

        return judged

    return made


def apply_rules(docs: DataFrame, carry: list[str], rules: Rules | None = None, path: str | None = None) -> DataFrame:
    """The carried columns of docs with a text's figures and verdict (names in use get leading underscores)."""
    judge = _judge(rules, path)

    def made() -> Callable[..., list[pa.Array]]:
        judged = judge()

        def of(texts: pa.Array, langs: pa.Array) -> list[pa.Array]:
            found = [judged(t.as_py(), x.as_py()) for t, x in zip(texts, langs, strict=True)]
            return [pa.array([m[k] for m in found], to_arrow_type(t)) for k, t in _FIGURES.items()]

        return of

    return appended(docs, ["text", "lang"], carry, _FIGURES, made)


def kept_documents(docs: DataFrame, rules: Rules | None = None, path: str | None = None) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""
    judge = _judge(rules, path)

    def made() -> Callable[..., pa.Array]:
        judged = judge()
        return lambda texts, langs: pa.array([judged(t.as_py(), x.as_py())["kept"] for t, x in zip(texts, langs, strict=True)], pa.bool_())

    return filtered(docs, ["text", "lang"], made)
