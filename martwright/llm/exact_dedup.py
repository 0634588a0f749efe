"""Exact dedup: sorted digest runs, merged in binomial exchange rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.llm.common import arrow_map, as_bytes, batch, shuffle_width, stored

# Runs of this many partitions (a power of two) are merged at once in a round.
FAN_IN_BITS = 3
_KEY = ["d0", "d1", "d2", "d3", "n_bytes"]
_DIGEST_DDL = "doc_id long, tag long, d0 long, d1 long, d2 long, d3 long, n_bytes long"
_DIGESTS = pa.schema([(c, pa.int64()) for c in ("doc_id", "tag", *_KEY)])
_RUNS = pa.schema([(c, pa.int64()) for c in ("doc_id", "tag", *_KEY, "n")])


def _digest_columns(texts: pa.Array) -> dict[str, np.ndarray]:
    """SHA-256 of the texts with A-Z lower-cased, as four longs, and their byte length."""
    digests, sizes = [], []
    for text in texts:
        data = text.as_py().lower()
        digests.append(hashlib.sha256(data).digest())
        sizes.append(len(data))
    words = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 4).astype(np.int64)
    return {f"d{i}": words[:, i] for i in range(4)} | {"n_bytes": np.array(sizes, np.int64)}


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield batch(
            _DIGESTS,
            doc_id=rows.column("doc_id"),
            tag=rows.column("tag"),
            **_digest_columns(rows.column("text")),
        )


def digests(docs: DataFrame) -> DataFrame:
    """One stored row per document: doc_id, a row tag, digest and length of its text.

    The tag tells repeated rows apart; it is stored, so every later step sees the same.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("tag"), as_bytes()
    )
    return stored(arrow_map(rows, _digest_rows, _DIGEST_DDL), "digests")


def _merge_sorted(last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse rows sorted by key and identifier to one row per key.

    The row kept is the last or first of its key; counts add up. Only the newest key
    is held over to the next batch, already collapsed.
    """
    held = None
    for rows in batches:
        table = pa.Table.from_batches([rows.select(_RUNS.names)]).cast(_RUNS)
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        key = np.stack([table.column(c).to_numpy() for c in _KEY])
        starts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]
        ends = np.r_[starts[1:], table.num_rows] - 1
        total = np.add.reduceat(table.column("n").to_numpy(), starts)
        table = table.take(pa.array(ends if last else starts))
        table = table.set_column(table.schema.get_field_index("n"), "n", pa.array(total))
        held = table.slice(table.num_rows - 1)
        yield from table.slice(0, table.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def _identifier_order(largest: bool) -> list[Column]:
    """The row to keep comes last (largest) or first (smallest); NULL ids lose."""
    if largest:
        return [F.col("doc_id").asc_nulls_first(), F.col("tag").asc()]
    return [F.col("doc_id").asc_nulls_last(), F.col("tag").asc()]


def merge_runs(rows: DataFrame, largest: bool = True, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row per text: the kept ``doc_id`` and ``tag``, and ``n``, its number of rows.

    Every partition sorts its digests into a run and collapses it. Then runs are
    exchanged in binomial rounds: in round r a partition trades only with those whose
    number differs in the r-th digit, and each row goes to the one named by that digit of
    its digest. The receiver merges the sorted runs and keeps one verified row (equal
    digest and equal length) per text. A text with a third of all rows is one row per run
    from the first level on, so no task gathers its copies, and after the last round the
    texts are spread evenly over all partitions.
    """
    fan = 1 << fan_in_bits
    rounds = 1
    while fan**rounds < shuffle_width(rows.sparkSession):
        rounds += 1
    width = fan**rounds
    order = [*_KEY, *_identifier_order(largest)]
    schema = f"{_DIGEST_DDL}, n long"

    def collapse(frame: DataFrame) -> DataFrame:
        return arrow_map(frame.sortWithinPartitions(*order), partial(_merge_sorted, largest), schema)

    runs = collapse(rows.select(*_DIGESTS.names, F.lit(1).cast("long").alias("n")))
    for r in range(rounds):
        low = fan_in_bits * r
        at = F.pmod(F.spark_partition_id(), F.lit(width))
        here = F.shiftright(at, low).bitwiseAND(F.lit(fan - 1))
        there = F.shiftrightunsigned("d0", low).bitwiseAND(F.lit(fan - 1)).cast("int")
        runs = runs.withColumn("_to", at + F.shiftleft(there - here, low))
        runs = collapse(runs.repartitionById(width, F.col("_to")).drop("_to"))
    return runs


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row.

    Texts are equal if they are the same after lower-casing A-Z; NULL counts as empty.
    Of equal texts the row with the largest (or ``keep="smallest"``) doc_id is kept.
    Repeated rows count each, and exactly one of them is kept. Rows without doc_id lose
    against others; among themselves one is kept with keep_id NULL. Other columns are
    not read; an empty table gives no rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be largest or smallest")
    rows = digests(docs)
    groups = merge_runs(rows, keep == "largest").select(
        *_KEY, F.col("doc_id").alias("keep_id"), F.col("tag").alias("_keep"), "n"
    )
    sha = F.concat(*(F.lpad(F.lower(F.hex(f"d{i}")), 16, "0") for i in range(4)))
    # The rows of a very common text are on the left of a plain join, which is split.
    return rows.join(groups, _KEY).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("tag") == F.col("_keep")).alias("kept"),
        sha.alias("text_sha256"),
    )


def _digest_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        more = _digest_columns(rows.column("text"))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc"), *(pa.array(more[c]) for c in _KEY)], names=["doc", *_KEY]
        )


def keep_first(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents themselves, one of each group of equal texts; columns unchanged.

    Documents whose doc_id is theirs alone are dropped by it. Rows that share a doc_id or
    have none are matched by their text as well, so one of several equal rows stays.
    """
    found = stored(
        exact_groups(docs, keep).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("rows"), F.bool_and("kept").alias("stays")
        ),
        "found",
    )
    leave = found.filter("rows = 1 and doc_id is not null and not stays").select("doc_id")
    shared = found.filter("rows > 1 or doc_id is null").select("doc_id")
    if shared.isEmpty():
        return docs.join(leave, "doc_id", "left_anti").select(*docs.columns)
    alone = docs.filter("doc_id is not null").join(leave.union(shared), "doc_id", "left_anti")
    wrapped = docs.select(F.col("doc_id").cast("long"), F.struct(*docs.columns).alias("doc"), as_bytes())
    wrapped = wrapped.join(
        shared.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"
    )
    schema = T.StructType(
        [T.StructField("doc", wrapped.schema["doc"].dataType), *(T.StructField(c, T.LongType()) for c in _KEY)]
    )
    ours = arrow_map(wrapped, _digest_docs, schema)
    groups = merge_runs(digests(docs), keep == "largest").select(*_KEY, F.col("doc_id").alias("_id"))
    one = (
        ours.join(groups, _KEY)
        .filter(F.col("doc.doc_id").eqNullSafe(F.col("_id")))
        .groupBy(*_KEY)
        .agg(F.first("doc").alias("doc"))
        .select("doc.*")
    )
    return alone.select(*docs.columns).unionByName(one)
