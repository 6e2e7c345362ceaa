"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

The 64 bits are dealt to three segments of 22, 21 and 21 bits.  If two fingerprints
differ in at most three bits, then two of the segments differ in at most one bit each:
the second-best segment cannot hold two errors, or the worst would hold two as well.
A segment, padded to 23 bits, is decoded to Golay codewords: its home (the nearest) and
those within four bits, one of which is the home of any word one bit away.  So each
fingerprint has one home key for each pair of segments, and some 28 search keys for
each; a join of search with home keys finds every link, and a bit count verifies it.

A bucket with more than ``bucket`` different homes is not enumerated, as all are from some 10^9 fingerprints on.  What belongs to or
searches such a bucket gets longer keys: of four segments of 16 bits one then holds no error, and two of the other three one each at most, so
a key joins the one as it is with the codewords of two others, 40 bits.  Twelve home keys and some 340 search keys come of it, which only
crowded fingerprints pay for.  What is crowded even so, by dense groups, is linked in an exact way whose rows grow in proportion to the
fingerprints: two within two bits share a point one bit from both, so everything one
bit around a point is one group.  The largest group so formed needs no further search in
itself; the others look for points that are two bits from them and one bit from
another.

Only different fingerprints are joined; copies follow their fingerprint.  Components come
from star rounds.

Defined cases: a null text is an empty text.  A text without words has fingerprint zero
and links as any other.  Fewer words than a shingle: the whole sequence is the shingle.
Null doc_ids get a fingerprint and follow their component, but never name it if another
id is there.  Repeated rows give repeated rows.  Texts of any length are read whole, block by block.  Columns of other names are ignored.  Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm import golay, similar
from lakescan.llm.common import Tables, dealt_join, map_rows, whole_text
from lakescan.llm.components import components

#: First bit and width of each segment, and the segments of each key: one that is taken as it is (or none), two that are decoded.
#: First the short keys, then the long ones.
LEVELS = (
    (((0, 22), (22, 21), (43, 21)), tuple((None, *p) for p in combinations(range(3), 2))),
    (((0, 16), (16, 16), (32, 16), (48, 16)), tuple((e, *p) for e in range(4) for p in combinations([k for k in range(4) if k != e], 2))),
)
SEED, BLOCK = 42, 1 << 15
#: Differing bits of a link; the segments and the groups around points are made for three.
BITS = 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """As a signed 64-bit integer.  Words are hashed block by block."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    set_in = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        joined = b" ".join(part)
        ends = list(accumulate((len(w) + 1 for w in part), initial=0))
        count = max(1, len(part) - shingle + 1)
        last = min(shingle, len(part))
        h = xxhash.xxh64_intdigest
        found = np.fromiter((h(joined[s : e - 1], SEED) for s, e in zip(ends[:count], ends[last:], strict=False)), np.uint64, count)
        set_in += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view(np.int64)[0])


def signatures(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and the text's hash th, a row for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    fields = [("doc_id", "long", pa.int64()), ("th", "long", pa.int64()), ("fp", "long", pa.int64())]
    return map_rows(rows, ["doc_id", "th", "text"], lambda: lambda d, th, text: (d, th, fingerprint(text, shingle)), fields)


def _keys(home: bool, level: int = 0):
    segments, parts = LEVELS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 256):
                part, keys, sizes = fps[at : at + 256], [], []
                for fp in part.tolist():
                    plain = [(fp >> first) & (1 << width) - 1 for first, width in segments]
                    codes = [golay.near(x)[: 1 if home else None] for x in plain]
                    own = [((n << 40) + (0 if e is None else plain[e] << 24) + (codes[i][:, None] << 12) + codes[j]).ravel() for n, (e, i, j) in enumerate(parts)]
                    keys += own
                    sizes.append(sum(map(len, own)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(part, sizes))], names=["key", "fp"])

    return run


def _around(radii: tuple[int, ...]):
    masks = np.array([sum(1 << b for b in at) for r in radii for at in combinations(range(64), r)], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 256):
                part = fps[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel()), pa.array(np.repeat(part, len(masks)))], names=["point", "fp"])

    return run


def _dealt(fps: DataFrame, run, column: str, name: str = "fp") -> DataFrame:
    """Many rows for each fingerprint.  The planner takes them for as few as the fingerprints are, and would broadcast them."""
    return fps.mapInArrow(run, f"{column} long, fp long").withColumnRenamed("fp", name).hint("merge")


def _crowded(fps: DataFrame, tables: Tables) -> DataFrame:
    """Edges that connect whatever is within three bits, without enumerating groups."""
    one = _dealt(fps, _around((0, 1)), "point")
    # Everything one bit around a point is within two bits of each other.  The least stands for the point.
    centre = tables.put(one.groupBy("point").agg(F.min("fp").alias("centre"), F.count(F.lit(1)).alias("n")))
    close = one.join(centre.where("n > 1").select("point", "centre"), "point").where("fp != centre").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()
    close = tables.put(close)
    rooted = fps.join(components(close, tables).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    rooted = tables.put(rooted)
    most = rooted.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1).collect()
    rest = rooted.where(F.col("root") != most[0]["root"]).select("fp") if most else rooted.select("fp")
    far = _dealt(rest, _around((2,)), "point").join(centre.select("point", "centre"), "point").where("fp != centre")
    return close.unionByName(far.select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct())


def links(fps: DataFrame, tables: Tables, bucket: int = 64, level: int = 0) -> DataFrame:
    """Edges a, b between different fingerprints (column fp) within BITS bits, which connect all that are."""
    home = tables.put(fps.mapInArrow(_keys(True, level), "key long, fp long"))
    search = _dealt(fps, _keys(False, level), "key", "a")
    full = tables.put(home.groupBy("key").count().where(F.col("count") > bucket).select("key"))
    crowded = not full.isEmpty()
    held = home.withColumnRenamed("fp", "b")
    if crowded:  # one mark instead of the homes of a full bucket, so that the search keys are dealt out once
        held = held.join(full, "key", "left_anti").unionByName(full.select("key", F.lit(None).cast("long").alias("b")))
    close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS) & (F.col("a") != F.col("b"))
    found = search.join(held, "key").where(F.col("b").isNull() | close).select("a", "b")
    if crowded:
        found = tables.put(found)
        rest = tables.put(found.where("b is null").select(F.col("a").alias("fp")).distinct())
        more = links(rest, tables, bucket, level + 1) if level + 1 < len(LEVELS) else _crowded(rest, tables)
        found = found.where("b is not null").unionByName(more)
    return found


def _named(signed: DataFrame, firsts: DataFrame, edges: DataFrame, on: str, tables: Tables) -> DataFrame:
    """signed with component_id.  firsts: one row for each value of ``on`` with its first_doc and the number n of its rows."""
    roots = components(edges, tables).withColumnRenamed("node", on)
    rooted = tables.put(firsts.join(roots, on, "left").select(on, "first_doc", "n", F.coalesce("root", on).alias("root")))
    named = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = tables.put(dealt_join(rooted.select(on, F.col("n").alias("rows"), "root"), tables.put(named), "root", [on]).select(on, F.col("rows").alias("n"), "component_id"))
    return dealt_join(signed, named, on, ["doc_id", "th"]).select(*signed.columns, "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket: int = 64) -> DataFrame:
    """doc_id, th, fp, component_id: the least doc_id reachable over links."""
    tables = Tables(docs.sparkSession)
    signed = tables.put(signatures(docs, shingle))
    fps = tables.put(signed.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")))
    out = Tables(docs.sparkSession).put(_named(signed, fps, links(fps.select("fp"), tables, bucket), "fp", tables))
    tables.clear()
    return out


def similar_texts(docs: DataFrame, bucket: int = 64, tables: Tables | None = None) -> DataFrame:
    """doc_id, th, component_id: the least doc_id reachable over five-word similarities of 0.8 or more.

    Candidates are the links of fingerprints, found by Golay keys, and min-wise bands (see ``similar``).
    """
    tables = tables or Tables(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    fields = [("doc_id", "long", pa.int64()), ("th", "long", pa.int64()), ("fp", "long", pa.int64()), ("keys", "array<bigint>", pa.list_(pa.int64()))]
    signed = tables.put(map_rows(rows, ["doc_id", "th", "text"], lambda: lambda d, th, text: (d, th, fingerprint(text), similar.band_keys(text)), fields))
    texts = tables.put(signed.groupBy("th").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    homes = tables.put(texts.groupBy("fp").agg(F.min("th").alias("home"), F.count(F.lit(1)).alias("n")))
    near = links(homes.select("fp"), tables, bucket).join(homes.select(F.col("fp").alias("a"), F.col("home").alias("x")), "a").join(homes.select(F.col("fp").alias("b"), F.col("home").alias("y")), "b")
    same = dealt_join(texts.select("th", "fp"), homes, "fp", ["th"]).select(F.col("th").alias("a"), F.col("home").alias("b"))
    more = near.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same)
    found = similar.links(texts.select("th", "keys"), docs, more, tables)
    return _named(signed.select("doc_id", "th"), texts.select("th", "first_doc", "n"), found, "th", tables)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, one for each component of ``similar_texts``: that of the least doc_id (a null id counts as the largest).

    Rows equal in doc_id and text count as one.  All columns stay as they are.
    """
    inner, tables = Tables(docs.sparkSession), Tables(docs.sparkSession)
    found = inner.put(similar_texts(docs, tables=inner))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    kept = found.groupBy("component_id").agg(F.min(first).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th"))
    kept, repeats = tables.put(kept), not found.groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    inner.clear()
    out = docs.withColumn("__h", F.xxhash64(whole_text()))
    out = out.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left_semi")
    if repeats:
        out = out.dropDuplicates(["doc_id", "__h"])
    return out.drop("__h")
