"""Token counts by a two-tier lookup on the map side; no stretch of text is ever shuffled.

First tier: a broadcast hash table from frequent stretches (pre-tokens) to their numbers of tokens: TABLE_ROWS entries of at
most bpe.CACHE_CHARS characters, so under 4 MB whatever the input. They come from the whole texts of the first
SAMPLE_DOCS rows that Spark finds, so the documents are read once, not twice. The table only saves time: what it
lacks is encoded in a worker and kept in that worker's bounded cache, so no count depends on it.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings count as the tokenizers library reads
them; repeated rows keep a row each; other columns are ignored and may have any name; no rows, no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.llm import bpe
from critpath.llm.common import only

SAMPLE_DOCS, TABLE_ROWS = 1024, 32_768


class Lengths(dict):
    """Numbers of tokens of stretches; what the first tier lacks is encoded and kept, CACHE_ROWS of it at most."""

    def __init__(self, first: dict[str, int], coder: bpe.Bpe):
        super().__init__(first)
        self.first, self.coder = first, coder

    def __missing__(self, part: str) -> int:
        found = len(self.coder.special[part]) // 4 if part in self.coder.special else len(self.coder.stretch(part.encode()))
        if len(part) <= bpe.CACHE_CHARS:
            if len(self) >= bpe.CACHE_ROWS + len(self.first):
                self.clear()
                self.update(self.first)
            self[part] = found
        return found


_workers: dict[str, Lengths] = {}


def tokens_in(text: str, lengths: Lengths) -> int:
    if lengths.coder.odd(text):
        return len(lengths.coder.by_library(text))
    return sum(sum(map(lengths.__getitem__, lengths.coder.splits(part))) for part in bpe.chunks(text))


def frequent(docs: DataFrame, path: str) -> dict[str, int]:
    """The first tier's table; docs: any rows with a text."""
    coder, found = bpe.encoder(path), Counter()
    for text in docs.select("text").limit(SAMPLE_DOCS).toArrow().column(0):
        found.update(x for x in coder.splits(text.as_py() or "") if len(x) <= bpe.CACHE_CHARS)
    return {x: len(coder.special[x]) // 4 if x in coder.special else len(coder.stretch(x.encode())) for x, _ in found.most_common(TABLE_ROWS)}


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row."""
    path, docs = path or bpe.vocabulary_path(), only(docs, "doc_id", "text")
    table, key = docs.sparkSession.sparkContext.broadcast(frequent(docs, path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Lengths(table.value, bpe.encoder(path))
        lengths = _workers[key]
        for batch in batches:
            counts = [tokens_in(x.as_py(), lengths) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
