"""Problem 4: lines repeated across one site's documents.

Method: the records of a line are kept as compressed bitmaps per site (containers of 65,536 record indexes: sorted 16-bit
numbers while sparse, a bit set when dense). Bitmaps of the variants of a line are united, exact cardinalities held
against the thresholds, and lines deleted from a record where their bitmap holds it. A record delivered twice sets the
same bit, and a container is never larger than 8 KB, however many records a site has.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import records, whole_records
from veilmark.session import checkpointed

LEAST_RECORDS, LEAST_SHARE = 5, 0.1
#: Lines held by a task before their bitmaps are written.
BLOCK_LINES = 300_000
_DENSE = 4096
_DIGITS = re.compile("[0-9]+")
_BITMAPS = pa.schema([("site_id", pa.string()), ("line", pa.string()), ("chunk", pa.int64()), ("container", pa.binary()), ("records", pa.int64())])
_BITMAPS_DDL = "site_id string, line string, chunk bigint, container binary, records bigint"


def normal_line(line: str) -> str:
    """NFKC, case folding, runs of white space as one space, trimmed, runs of 0-9 as one ``#``."""
    if not line.isascii():
        line = unicodedata.normalize("NFKC", line)
    return _DIGITS.sub("#", " ".join(line.casefold().split()))


def pack(values: np.ndarray) -> bytes:
    """A container of sorted distinct 16-bit numbers."""
    if len(values) < _DENSE:
        return values.astype("<u2").tobytes()
    bits = np.zeros(65_536, np.uint8)
    bits[values] = 1
    return np.packbits(bits).tobytes()


def unpack(container: bytes) -> np.ndarray:
    if len(container) == 8192:
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8)))
    return np.frombuffer(container, "<u2")


def holds(container: bytes, value: int) -> bool:
    """Bitmap lookup."""
    if len(container) == 8192:
        return bool(container[value >> 3] >> (7 - (value & 7)) & 1)
    found = np.frombuffer(container, "<u2")
    at = int(np.searchsorted(found, value))
    return at < len(found) and found[at] == value


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BITMAPS)], schema=_BITMAPS)


def _united_variants(variants: dict[tuple[str, str], list[int]]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of raw lines, united over the variants of each normal line."""
    united: dict[tuple[str, str], list[int]] = {}
    for (site, raw), held in variants.items():
        if line := normal_line(raw):
            key = (site, line)
            united[key] = united[key] + held if key in united else held
    rows = []
    for (site, line), held in united.items():
        if len(held) == 1:
            rows.append((site, line, held[0] >> 16, (held[0] & 65_535).to_bytes(2, "little"), 1))
        else:
            values = np.unique(np.array(held, np.int64))
            chunks = values >> 16
            for part in np.split(values, np.flatnonzero(np.diff(chunks)) + 1):
                rows.append((site, line, int(part[0] >> 16), pack(part & 65_535), len(part)))
        if len(rows) >= 20_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _line_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    variants: dict[tuple[str, str], list[int]] = defaultdict(list)
    for batch in batches:
        for record, site, text in zip(*(c.to_pylist() for c in batch.columns)):
            for raw in set(text.split("\n")):
                if raw:
                    variants[site, raw].append(record)
        if len(variants) > BLOCK_LINES:
            yield from _united_variants(variants)
            variants = defaultdict(list)
    yield from _united_variants(variants)


def _merge_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the bitmaps of sorted rows by (site_id, line, chunk); lines of fewer than LEAST_RECORDS records are left
    out. At most LEAST_RECORDS small containers wait for a line's decision, after that one container at a time."""
    line: tuple | None = None
    waiting: list[tuple] = []
    total, out = 0, []
    chunk: int | None = None
    parts: list[bytes] = []

    def close_chunk() -> None:
        nonlocal total, parts
        if parts:
            values = unpack(parts[0]) if len(parts) == 1 else np.unique(np.concatenate([unpack(p) for p in parts]))
            waiting.append((*line, chunk, parts[0] if len(parts) == 1 else pack(values), len(values)))
            total += len(values)
            parts = []
            if total >= LEAST_RECORDS:
                out.extend(waiting)
                waiting.clear()

    for batch in batches:
        for site, text, part_chunk, container, _ in zip(*(c.to_pylist() for c in batch.columns)):
            if line is None or text != line[1] or site != line[0]:
                close_chunk()
                waiting.clear()
                line, total, chunk = (site, text), 0, part_chunk
            elif part_chunk != chunk:
                close_chunk()
                chunk = part_chunk
            elif len(parts) >= 64:  # many runs of one chunk: unite what is there
                parts = [pack(np.unique(np.concatenate([unpack(p) for p in parts])))]
            parts.append(container)
            if len(out) >= 5000:
                yield _batch(out)
                out = []
    close_chunk()
    if out:
        yield _batch(out)


def line_bitmaps(df: DataFrame) -> DataFrame:
    """(site_id, line, chunk, container, records): bitmaps of all lines of at least LEAST_RECORDS records of a site.

    df: source_record_index, site_id, text. Rows with a null site, index or text have no lines.
    """
    rows = df.select("source_record_index", "site_id", "text").dropna()
    runs = rows.mapInArrow(_line_bitmaps, _BITMAPS_DDL)
    return runs.repartition("site_id", "line").sortWithinPartitions("site_id", "line", "chunk").mapInArrow(_merge_bitmaps, _BITMAPS_DDL)


def repeated_lines(df: DataFrame, bitmaps: DataFrame | None = None) -> DataFrame:
    """(site_id, line, records, site_records): lines of at least 5 records and 10 % of the site's records."""
    bitmaps = line_bitmaps(df) if bitmaps is None else bitmaps
    totals = bitmaps.groupBy("site_id", "line").agg(F.sum("records").alias("records"))
    sites = df.select("site_id", "source_record_index").dropna().distinct().groupBy("site_id").agg(F.count("*").alias("site_records"))
    return totals.join(sites, "site_id").where(F.col("records") >= LEAST_SHARE * F.col("site_records"))


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that each kept bitmap holds: (source_record_index, line)."""
    schema = pa.schema([("source_record_index", pa.int64()), ("line", pa.string())])
    for batch in batches:
        for line, chunk, container in zip(*(c.to_pylist() for c in batch.columns)):
            held = (chunk << 16) + unpack(container).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([line]).take(pa.array(np.zeros(len(held), np.int64)))], schema=schema)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("source_record_index", pa.int64()), ("site_id", pa.string()), ("text", pa.string())])
    for batch in batches:
        texts = []
        for text, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if text is not None and drop:
                drop = set(drop)
                text = "\n".join(raw for raw in text.split("\n") if not raw or normal_line(raw) not in drop)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)


def without_repeated_lines(df: DataFrame) -> DataFrame:
    """(source_record_index, site_id, text) of every row, its site's repeated lines deleted; other texts unchanged.

    The bitmaps of the lines to delete are looked up once and turned round into each record's own lines, at most as many
    as its text has, so no record meets the whole list of its site.
    """
    bitmaps = checkpointed(line_bitmaps(df))
    found = bitmaps.join(repeated_lines(df, bitmaps).select("site_id", "line"), ["site_id", "line"], "left_semi")
    own = found.select("line", "chunk", "container").mapInArrow(_lookup, "source_record_index bigint, line string").groupBy("source_record_index").agg(F.collect_set("line").alias("found"))
    rows = df.select("source_record_index", "site_id", "text").where("source_record_index IS NOT NULL")
    return rows.join(own, "source_record_index", "left").select("source_record_index", "site_id", "text", "found").mapInArrow(_strip, "source_record_index bigint, site_id string, text string")


def site_lines(spark: SparkSession, folder: str) -> DataFrame:
    """p4_found: (site_id, line)."""
    return repeated_lines(records(spark, folder, "site_id", "text")).select("site_id", "line")


def stripped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """p4_texts: every record's text without them."""
    return without_repeated_lines(whole_records(spark, folder, "site_id", "text"))
