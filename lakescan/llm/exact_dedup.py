"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a byte string s is the sum of s[i] * B ** (|s| - 1 - i) modulo a prime, for two
primes.  That of a concatenation follows from the parts and the length of the second:

    f(x + y) = f(x) * B ** |y| + f(y)

so a huge text is hashed chunk by chunk, in any grouping.  Rows with equal length and
fingerprints are candidates.  Each candidate's text is compared, chunk by chunk, with
that of the row that would stay; rows that differ are compared among themselves in
another round, until none is left.

A large group is dealt to several tasks: its representative's chunks are repeated for
each share of ``share`` members.

Defined cases: null is an empty text.  The largest doc_id of equal texts stays; null
doc_ids are the smallest.  Of rows equal in doc_id and text one stays.  Texts of any length are hashed and
compared whole, chunk by chunk.  Columns of other names are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakescan.llm.common import map_rows, materialise, whole_text

#: Two primes below 2 ** 31 and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525)
#: Bytes of a hashed chunk: 4096 products below 2 ** 39 stay below 2 ** 53, exact in any order.
CHUNK = 4096
#: Characters of a compared chunk; bytes of a text whose chunks are hashed by several tasks.
COMPARED, HUGE = 1 << 20, 1 << 25


def _powers(prime: int, base: int) -> np.ndarray:
    out = [1]
    for _ in range(CHUNK - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], np.float64)


POWERS = np.stack([_powers(p, b) for p, b in zip(PRIMES, BASES, strict=True)], axis=1)


def combine(x: tuple, y: tuple) -> tuple:
    """Of (fingerprint, fingerprint, length) of two parts, that of their concatenation."""
    return (*((f * pow(b, y[2], p) + g) % p for f, g, p, b in zip(x[:2], y[:2], PRIMES, BASES, strict=True)), x[2] + y[2])


def polynomial(data: bytes) -> tuple[int, int, int]:
    """Whole chunks are hashed together, then folded; the first, shorter one goes in front."""
    head = len(data) % CHUNK
    first = np.frombuffer(data, np.uint8, head).astype(np.float64) @ POWERS[CHUNK - head :] if head else np.zeros(2)
    out = (int(first[0]) % PRIMES[0], int(first[1]) % PRIMES[1], head)
    for at in range(head, len(data), CHUNK * 256):  # a bounded block of chunks
        block = np.frombuffer(data, np.uint8, min(CHUNK * 256, len(data) - at), at).reshape(-1, CHUNK).astype(np.float64) @ POWERS
        for a, b in block.tolist():
            out = combine(out, (int(a) % PRIMES[0], int(b) % PRIMES[1], CHUNK))
    return out


FIELDS = [("doc_id", "long", pa.int64()), ("th", "long", pa.int64()), ("size", "long", pa.int64()), ("f1", "long", pa.int64()), ("f2", "long", pa.int64()), ("text_sha256", "string", pa.string())]


def fingerprints(docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """doc_id, th (a hash that ties a row to its text), size, f1, f2, text_sha256; a row for each row.

    Texts of over ``huge`` bytes are left out in the first pass; only if there are any does a second one deal their chunks to tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("th", F.xxhash64("text"))

    def one(doc_id, th, text):
        if text is None:
            return doc_id, th, -1, None, None, None
        f1, f2, n = polynomial(data := text.encode())
        return doc_id, th, n, f1, f2, hashlib.sha256(data).hexdigest()

    fits = F.octet_length("text") <= huge
    signed = materialise(map_rows(rows.withColumn("text", F.when(fits, F.col("text"))), ["doc_id", "th", "text"], lambda: one, FIELDS))
    if signed.where("size < 0").isEmpty():
        return signed
    return signed.where("size >= 0").unionByName(_by_chunks(rows.where(~fits)))


def _by_chunks(rows: DataFrame) -> DataFrame:
    """The same of few, huge texts: chunks are hashed by different tasks, and their fingerprints combined in order."""
    chunks = rows.select("doc_id", "th", F.sha2("text", 256).alias("sha"), F.posexplode_outer(_chunks(F.col("text"))).alias("k", "chunk"))
    chunks = chunks.repartition("doc_id", "th", "k")
    fields = [*FIELDS[:2], ("sha", "string", pa.string()), ("k", "int", pa.int32()), *FIELDS[2:5]]

    def one(doc_id, th, sha, k, chunk):
        f1, f2, n = polynomial(chunk.encode())
        return doc_id, th, sha, k, n, f1, f2

    parts = map_rows(chunks, ["doc_id", "th", "sha", "k", "chunk"], lambda: one, fields)
    parts = parts.groupBy("doc_id", "th", "sha", "k").agg(F.first(F.struct("f1", "f2", "size")).alias("part"), F.count(F.lit(1)).alias("rows"))
    whole = parts.groupBy("doc_id", "th", "sha").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"), F.first("rows").alias("rows"))

    def joined(doc_id, th, sha, parts, rows):
        out = (0, 0, 0)
        for p in parts:
            out = combine(out, tuple(p["part"].values()))
        return doc_id, th, out[2], out[0], out[1], sha, rows

    out = map_rows(whole, ["doc_id", "th", "sha", "parts", "rows"], lambda: joined, [*FIELDS, ("rows", "long", pa.int64())])
    return out.withColumn("rows", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rows")


def _chunks(text):
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / COMPARED).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * COMPARED + 1, F.lit(COMPARED)))


def _equal(put: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """put: doc_id, th, rep, rep_th, n, is_rep of groups of several.  id, i_th, same: whether the text is the representative's.

    Texts are joined once; what is compared is written as chunks.
    """
    keys = put.select(*(F.col(c).alias(f"p_{c}") for c in ("doc_id", "th")), "rep", "rep_th", "n", "is_rep")
    rows = texts.join(keys, F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("th") == F.col("p_th")))
    chunks = materialise(rows.select("doc_id", "th", "rep", "rep_th", F.ceil(F.col("n") / share).cast("int").alias("shares"), "is_rep", F.posexplode_outer(_chunks(F.col("text"))).alias("k", "chunk")))
    own = chunks.where(~F.col("is_rep")).select(F.col("doc_id").alias("id"), F.col("th").alias("i_th"), "rep", "rep_th", "k", "chunk", F.pmod(F.xxhash64("doc_id", "th"), F.col("shares")).cast("int").alias("salt"))
    held = chunks.where("is_rep").select(F.col("rep").alias("h_rep"), F.col("rep_th").alias("h_th"), F.col("k").alias("h_k"), F.col("chunk").alias("h_chunk"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("h_salt"))
    on = F.col("rep").eqNullSafe(F.col("h_rep")) & (F.col("rep_th") == F.col("h_th")) & (F.col("k") == F.col("h_k")) & (F.col("salt") == F.col("h_salt"))
    return own.join(held, on).groupBy("id", "i_th").agg(F.min(F.col("chunk") == F.col("h_chunk")).alias("same"))


def classes(docs: DataFrame, share: int = 256) -> DataFrame:
    """doc_id, text_sha256, keep_id, group_size, kept: a row for each row of docs."""
    signed = materialise(fingerprints(docs))
    alike = ["size", "f1", "f2"]
    # Rows equal in doc_id and text are one member; so every member has a key (doc_id, th).
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    left = signed.groupBy(*alike, "doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    columns = [*alike, "doc_id", "th", "rows", "rep", "rep_th", "is_rep"]
    done: DataFrame | None = None
    while True:
        # Only groups of several are joined back: few rows, and a join whose hot groups can be split.
        top = materialise(left.groupBy(*alike).agg(F.max(F.struct(F.col("doc_id"), F.col("th"))).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        own = F.coalesce("top", F.struct("doc_id", "th"))
        put = left.join(top, alike, "left").select(*alike, "doc_id", "th", "rows", own["doc_id"].alias("rep"), own["th"].alias("rep_th"), F.coalesce("n", F.lit(1)).alias("n"))
        put = materialise(put.withColumn("is_rep", F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th"))))
        several = put.where("n > 1")
        if several.isEmpty():
            same, rest = put, None
        else:
            compared = put.join(materialise(_equal(several, texts, share)), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("i_th")), "left")
            same = compared.where(F.col("is_rep") | F.col("same"))
            rest = compared.where(~F.col("is_rep") & ~F.coalesce("same", F.lit(False))).select(*alike, "doc_id", "th", "rows")
        done = same.select(*columns) if done is None else done.unionByName(same.select(*columns))
        if rest is None or rest.isEmpty():
            break
        left = materialise(rest)
    done = materialise(done)
    sizes = done.groupBy(*alike, "rep", "rep_th").agg(F.sum("rows").alias("group_size")).where("group_size > 1")
    sizes = materialise(sizes.select(*(F.col(c).alias(f"s_{c}") for c in [*alike, "rep", "rep_th"]), "group_size"))
    on = F.col("rep").eqNullSafe(F.col("s_rep"))
    for c in (*alike, "rep_th"):
        on = on & (F.col(c) == F.col(f"s_{c}"))
    found = done.join(sizes, on, "left").select(F.col("doc_id").alias("id"), F.col("th").alias("i_th"), F.col("rep").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("is_rep").alias("stays"))
    out = signed.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("i_th")))
    first = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("text_sha256")) == 1
    return out.select("doc_id", "keep_id", "group_size", (F.col("stays") & first).alias("kept"), "text_sha256")
