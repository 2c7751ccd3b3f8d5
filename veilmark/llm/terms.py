"""Problem 1: frequency of every distinct value and term.

Method: external sort of (term, record) pairs. A task forms a pair for every occurrence, sorts blocks of pairs in memory
and writes each block as a run: pages of a term's records (16-bit numbers inside a chunk of 65,536 record indexes) with
the length of each pair's own run, its occurrences. The runs, cut from their lineage in the shared folder, are
range-partitioned and sorted by term and chunk, so the records of a term of a third of all rows spread over partitions;
a run-length scan then counts the occurrences and the distinct records of every term. A record that was delivered twice
gives the same pairs twice and is counted once. No text is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import records
from veilmark.session import checkpointed

#: Pairs sorted at once in a task, and records of a term in one row of a run.
BLOCK_PAIRS, PAGE = 1_000_000, 512
RARE_OCCURRENCES, COMMON_SHARE = 2, 0.5
RARE_SITE_RECORDS, COMMON_SITE_SHARE = 10, 0.05

_TERM = re.compile(r"\w+")
#: A run: records as 16-bit numbers of the chunk, counts as 32-bit numbers beside them.
_RUNS = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("chunk", pa.int64()), ("records", pa.binary()), ("counts", pa.binary())])
_RUNS_DDL = "field_name string, term string, chunk bigint, records binary, counts binary"
_COUNTS = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
_COUNTS_DDL = "field_name string, term string, occurrences bigint, records bigint"


def terms_of(text: str) -> list[str]:
    """Maximal runs of letters, numbers and underscores after NFKC and case folding."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _TERM.findall(text.casefold())


def _slices(values: np.ndarray, starts: np.ndarray, width: str) -> pa.Array:
    """Binary cells that begin at each start."""
    data = values.astype(width)
    offsets = np.append(starts, len(data)) * data.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


def sorted_run(names: list[tuple[str, str]], ids: np.ndarray, holders: np.ndarray) -> pa.RecordBatch:
    """One sorted run of the pairs (names[id], holder)."""
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    known, holder = np.unique(holders, return_inverse=True)
    pairs = place[ids] * len(known) + holder
    pairs.sort()
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    counts = np.diff(np.append(first, len(pairs)))
    term, record = pairs[first] // len(known), known[pairs[first] % len(known)]
    fresh = np.concatenate([[True], (term[1:] != term[:-1]) | (record[1:] >> 16 != record[:-1] >> 16)])
    at = np.arange(len(term)) - np.maximum.accumulate(np.where(fresh, np.arange(len(term)), 0))
    pages = np.flatnonzero(at % PAGE == 0)
    own = [names[order[k]] for k in term[pages]]
    columns = [pa.array([n[0] for n in own], pa.string()), pa.array([n[1] for n in own], pa.string()), pa.array(record[pages] >> 16), _slices(record & 65_535, pages, "<u2"), _slices(counts, pages, "<u4")]
    return pa.RecordBatch.from_arrays(columns, schema=_RUNS)


def _form_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number: dict[tuple[str, str], int] = {}
    ids: list[int] = []
    holders: list[int] = []
    sizes: list[int] = []
    seen: set[int] = set()  # records of the block

    def run() -> pa.RecordBatch:
        out = sorted_run(list(number), np.array(ids, np.int64), np.repeat(np.array(holders, np.int64), sizes))
        number.clear(), ids.clear(), holders.clear(), sizes.clear(), seen.clear()
        return out

    for batch in batches:
        for record, site, text in zip(*(c.to_pylist() for c in batch.columns)):
            if record in seen:
                continue
            seen.add(record)
            before = len(ids)
            ids.append(number.setdefault(("", ""), len(number)))  # every record, for the total
            if site is not None:
                ids.append(number.setdefault(("site_id", site), len(number)))
            if text:
                ids += [number.setdefault(("text", t), len(number)) for t in terms_of(text)]
            holders.append(record)
            sizes.append(len(ids) - before)
            if len(ids) >= BLOCK_PAIRS:
                yield run()
    if ids:
        yield run()


def _cells(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(width)
    return data, np.diff(offsets) // data.itemsize


def _counted(rows: pa.Table) -> pa.RecordBatch:
    """Occurrences and distinct records of each (field_name, term) of sorted rows."""
    rows = rows.combine_chunks()
    columns = [c.chunk(0) for c in rows.columns]
    changed = lambda c: ~np.asarray(c.slice(1).to_pandas().values == c.slice(0, len(c) - 1).to_pandas().values, bool)
    term = np.concatenate([[True], changed(columns[0]) | changed(columns[1])])
    run = np.cumsum(np.concatenate([[True], term[1:] | changed(columns[2])])) - 1
    low, n = _cells(columns[3], "<u2")
    counts, _ = _cells(columns[4], "<u4")
    pair = (np.repeat(run, n).astype(np.int64) << 16) | low
    order = np.lexsort((counts, pair))
    pair, counts = pair[order], counts[order].astype(np.int64)
    last = np.concatenate([pair[1:] != pair[:-1], [True]])  # a record delivered twice is one pair
    of_run = np.cumsum(term)[np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))] - 1
    of = of_run[pair[last] >> 16]
    size = int(term.sum())
    starts = pa.array(np.flatnonzero(term))
    sums = [np.bincount(of, counts[last], size).astype(np.int64), np.bincount(of, minlength=size)]
    return pa.RecordBatch.from_arrays([columns[0].take(starts), columns[1].take(starts), *(pa.array(s, pa.int64()) for s in sums)], schema=_COUNTS)


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted rows; the last (field_name, term, chunk) of a batch may go on in the next."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows.cast(held.schema)])
        last = rows.num_rows - 1
        key = [rows.column(k)[last].as_py() for k in range(3)]
        while last and [rows.column(k)[last - 1].as_py() for k in range(3)] == key:
            last -= 1
        if last:
            yield _counted(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield _counted(held)


def term_counts(df: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, records) for every term of ``text`` and every value of ``site_id``, and one row
    with an empty field name that counts all records.

    df: source_record_index, site_id, text; repeated rows of a record count once, null is no value, an empty text has no
    terms; an empty table gives no rows.
    """
    rows = df.select("source_record_index", "site_id", "text").where("source_record_index IS NOT NULL")
    runs = checkpointed(rows.mapInArrow(_form_runs, _RUNS_DDL))
    keys = ("field_name", "term", "chunk")
    scanned = runs.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_scan_runs, _COUNTS_DDL)
    # a term's chunks can lie in several partitions and batches: a few rows a term
    return scanned.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_marks(df: DataFrame) -> DataFrame:
    """term_counts with n_records, rare and common."""
    counts = term_counts(df)
    total = counts.where("field_name = ''").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n_records"))
    text = F.col("field_name") == "text"
    return (
        counts.where("field_name <> ''")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("rare", F.when(text, F.col("occurrences") <= RARE_OCCURRENCES).otherwise(F.col("records") < RARE_SITE_RECORDS))
        .withColumn("common", F.when(text, F.col("records") > COMMON_SHARE * F.col("n_records")).otherwise(F.col("records") > COMMON_SITE_SHARE * F.col("n_records")))
    )


def marked_terms(spark: SparkSession, folder: str) -> DataFrame:
    """p1_found: the rare and the common terms and values; in tiny tables a term can be both."""
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return term_marks(records(spark, folder, "site_id", "text")).select("field_name", "term", F.explode(marks).alias("mark"))


def all_terms(spark: SparkSession, folder: str) -> DataFrame:
    """p1_counts: occurrences and records of every term and value."""
    return term_counts(records(spark, folder, "site_id", "text")).where("field_name <> ''")
