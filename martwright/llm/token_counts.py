"""Token counts by a map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map, as_bytes, batch
from martwright.llm.pretokens import blocks, vocabulary

LIMIT = 2048
# Documents that choose the broadcast table, about; and pre-tokens it holds, at most. Neither
# changes a result, only how often a worker looks further.
SAMPLE_DOCUMENTS = 2000
TABLE_WORDS = 1 << 15
_SAMPLE_TASKS = 4
_CACHE_WORDS = 150_000
_LONG = 64


def _frequent(path: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts = vocabulary(path), Counter()
    for rows in batches:
        for text in rows.column("text"):
            for part in blocks(text.as_py().decode()):
                counts.update(words.pretokens(part))
            if len(counts) > 40 * limit:
                counts = Counter(dict(counts.most_common(20 * limit)))
    top = [(w, n) for w, n in counts.most_common(limit) if len(w) <= _LONG]
    yield pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
        names=["word", "n"],
    )


def frequent_table(docs: DataFrame, tokenizer: str) -> tuple[bytes, bytes]:
    """Compact table of frequent pre-tokens: their text joined by spaces, and one length byte each.

    Chosen on documents picked evenly, about ``SAMPLE_DOCUMENTS`` of them at any size of the
    input; each of a few tasks reports a bounded list, which is all that reaches the driver.
    """
    every = max(1, docs.count() // SAMPLE_DOCUMENTS)
    sample = docs.filter(F.rand(7) * every < 1)
    found = arrow_map(
        sample.select(as_bytes()).repartition(_SAMPLE_TASKS),
        partial(_frequent, tokenizer, TABLE_WORDS // _SAMPLE_TASKS),
        "word string, n long",
    ).collect()
    counts: Counter = Counter()
    for row in found:
        counts[row["word"]] += row["n"]
    words = vocabulary(tokenizer)
    lengths = {w: len(words.ids(w)) for w, _ in counts.most_common(TABLE_WORDS)}
    lengths = {w: n for w, n in lengths.items() if n < 256}
    return " ".join(lengths).encode(), bytes(lengths.values())


class _Lengths(dict):
    """Second tier: lengths of rarer pre-tokens, encoded on first use by this worker."""

    def __init__(self, path: str):
        super().__init__()
        self.words = vocabulary(path)

    def __missing__(self, pretoken: str) -> int:
        n = len(self.words.ids(pretoken))
        if len(pretoken) <= _LONG:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[pretoken] = n
        return n


_lengths = lru_cache(maxsize=4)(_Lengths)


@lru_cache(maxsize=1)
def _first_tier(words: bytes, lengths: bytes) -> dict[str, int]:
    return dict(zip(words.decode().split(" "), lengths)) if lengths else {}


def count_tokens(text: str, frequent: dict[str, int], rare: _Lengths) -> int:
    total = 0
    for part in blocks(text):
        words = rare.words.pretokens(part)
        known = list(map(frequent.get, words))
        total += sum(filter(None, known))
        total += sum(rare[w] for w, n in zip(words, known) if n is None)
    return total


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _count(
    path: str, table: Broadcast, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    frequent, rare = _first_tier(*table.value), _lengths(path)
    for rows in batches:
        sizes, tokens = [], []
        for text in rows.column("text"):
            data = text.as_py()
            sizes.append(len(data))
            tokens.append(count_tokens(data.decode(), frequent, rare))
        yield batch(
            _COUNTS,
            doc_id=rows.column("doc_id"),
            n_bytes=np.array(sizes, np.int64),
            n_tokens=np.array(tokens, np.int64),
        )


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row.

    Each text is split into pre-tokens where it is read. Lengths of frequent ones come from
    the broadcast table (at most ``TABLE_WORDS`` entries of at most 64 characters); others are
    encoded once by the worker that meets them and kept in its bounded cache. No pre-token is
    shuffled. Special strings of the vocabulary in a text count one. NULL texts count as
    empty: 0 bytes, 0 tokens. Repeated rows and rows without doc_id are counted like others;
    an empty table gives no rows. Other columns are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, tokenizer))
    rows = docs.select(F.col("doc_id").cast("long"), as_bytes())
    counted = arrow_map(
        rows, partial(_count, tokenizer, table), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
