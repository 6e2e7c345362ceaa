"""Substring deduplication over content-defined chunks.

A gear hash rolls over the bytes: each step shifts the hash by one bit and adds a random number
for the byte, so that its 16 bits depend on the last 16 bytes.  Where the upper bits are zero, a
chunk ends, so boundaries move with the text when something is inserted before it.  Where none comes
for long, hashes that are the least around them make some, in periodic text one a period.  A unit begins
at each boundary and joins chunks until it spans ``span`` bytes.  Units are deduplicated by
digest: the least doc_id that holds a digest keeps it, all others lose it; within a
text the first place keeps it.  What is lost is the union of lost units.

Digests have 128 bits.  All documents' digests are counted by their upper half, with map-side aggregation; those that several documents
hold are few and are told apart by the lower half.  So most of the shuffle is (half a digest, doc_id), and no unit goes because
another one has half its digest.  Digests that many documents hold are dealt to several tasks.  No group is gathered; the digests of one
document are, which its length bounds.

Defined cases: null is an empty text.  Rows with null doc_id pass unchanged but for
repeats within themselves.  Rows of equal doc_id count as one document, and repeated rows are treated alike.  Texts
shorter than ``span`` bytes stay.  Texts of any length are read whole.  Columns of other names are ignored.  Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm.common import Tables, dealt_join, map_rows, whole_text

GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 16, 256, dtype=np.uint16)
#: Upper bits that are zero at a boundary (a mean chunk of 2 ** BITS bytes); longer gaps get more boundaries.
BITS, LONGEST = 5, 128
SPAN = 80


def low_points(h: np.ndarray, around: int = 64) -> np.ndarray:
    """Where a value is the least of the window that it is the middle of."""
    least, width = h, 1
    while width < around:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    middle = around // 2
    return np.flatnonzero(h[middle : middle + len(least)] == least) + middle


def cuts(data: bytes) -> np.ndarray:
    """Ends of chunks, 0 first, always between characters."""
    raw = np.frombuffer(data, np.uint8)
    h = GEAR[raw]
    for step in (1, 2, 4, 8):  # windows of 2, 4, 8, 16 bytes
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    at = np.flatnonzero(h < 1 << 16 - BITS) + 1
    at = np.concatenate(([0], at[at < len(raw)], [len(raw)]))
    # Periodic text may have no boundary at all: there a hash that is the least around it marks one, in each period.
    more = [low_points(h[at[k] : at[k + 1]]) + at[k] + 1 for k in np.flatnonzero(np.diff(at) > LONGEST)]
    at = np.unique(np.concatenate([at, *more]))
    if len(wide := np.flatnonzero(np.diff(at) > 8 * LONGEST)):
        at = np.unique(np.concatenate([at, *(np.arange(at[k], at[k + 1], 8 * LONGEST) for k in wide)]))
    inner = at[(at > 0) & (at < len(raw))]
    while len(bad := np.flatnonzero((raw[inner] & 0xC0) == 0x80)):
        inner[bad] += 1
        inner = inner[inner < len(raw)]
    return np.unique(np.concatenate(([0], inner, [len(raw)])))


def units(data: bytes, span: int = SPAN) -> list[tuple[int, int, int]]:
    """start, end, digest."""
    if len(data) < span:
        return []
    at = cuts(data)
    starts = at[at <= len(data) - span]
    ends = at[np.searchsorted(at, starts + span)]
    h = xxhash.xxh3_128_intdigest
    return [(s, e, h(data[s:e])) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _halves(found: set[int]) -> tuple[np.ndarray, np.ndarray]:
    upper, lower = (np.fromiter((part(d) for d in found), np.uint64, len(found)).view(np.int64) for part in (lambda d: d >> 64, lambda d: d & (1 << 64) - 1))
    return upper, lower


def digests(docs: DataFrame, span: int = SPAN, whole: bool = False) -> DataFrame:
    """digest (the upper half), lower if whole, doc_id: each digest once for a document."""
    names = ["digest", "lower", "doc_id"] if whole else ["digest", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found, ids):
            columns = [np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.repeat(np.array(ids, np.int64), [len(f[0]) for f in found])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (columns if whole else columns[::2])], names=names)

        for b in batches:
            found, ids, held = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found.append(_halves({u[2] for u in units(text.as_py().encode(), span)}))
                ids.append(doc_id)
                held += len(found[-1][0])
                if held > 100_000:
                    yield batch(found, ids)
                    found, ids, held = [], [], 0
            if held:
                yield batch(found, ids)

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def remove(text: str, lost: set[int], span: int = SPAN) -> tuple[str, int, int]:
    """The text without lost units, the bytes removed, the units lost."""
    data, seen, out, at, n = text.encode(), set(), [], 0, 0
    removed: list[list[int]] = []
    for s, e, d in units(data, span):
        if d in lost or d in seen:
            n += 1
            if removed and s <= removed[-1][1]:
                removed[-1][1] = max(e, removed[-1][1])
            else:
                removed.append([s, e])
        seen.add(d)
    for s, e in removed:
        out.append(data[at:s])
        at = e
    out.append(data[at:])
    kept = b"".join(out)
    return kept.decode(), len(data) - len(kept), n


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, text (what is left), removed_bytes, n_removed and n_shared units, has_repeat: a row for each row.

    n_shared also counts the units that this document keeps because it is the first that holds them.
    """
    tables, kept = Tables(docs.sparkSession), Tables(docs.sparkSession)
    often = digests(docs, span).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = tables.put(dealt_join(digests(docs, span, whole=True), tables.put(often), "digest", ["doc_id"]).drop("n"))
    first = own.groupBy("digest", F.col("lower").alias("f_lower")).agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    shared = dealt_join(own, tables.put(first), "digest", ["doc_id"]).where("lower = f_lower").select("doc_id", "digest", "lower", "first_doc").distinct()
    lost = F.collect_list(F.when(F.col("doc_id") != F.col("first_doc"), F.struct("digest", "lower"))).alias("lost")
    lost = kept.put(shared.groupBy("doc_id").agg(lost, F.count(F.lit(1)).alias("n_shared")).withColumnRenamed("doc_id", "__id"))
    tables.clear()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.join(lost, F.col("doc_id") == F.col("__id"), "left")

    def one(doc_id, text, lost, shared):
        low = (1 << 64) - 1
        text, removed, n = remove(text, {(d["digest"] & low) << 64 | d["lower"] & low for d in lost or ()}, span)
        return doc_id, text, removed, n, shared or 0, bool(n or shared)

    fields = [("doc_id", "long", pa.int64()), ("text", "string", pa.string()), ("removed_bytes", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("n_shared", "long", pa.int64()), ("has_repeat", "boolean", pa.bool_())]
    return map_rows(rows, ["doc_id", "text", "lost", "n_shared"], lambda: one, fields)
