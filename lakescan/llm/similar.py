"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash at three bits finds only the nearest of such pairs, so min-wise bands add
candidates: ``BANDS`` keys of ``ROWS`` minima each, by which a pair at 0.8 meets in at
least one bucket with a probability of 0.998.  Every candidate is verified on the whole
sets of shingles; nothing is estimated.

A bucket's texts aren't paired with each other.  First each is compared with the one that
stands for the bucket, that whose own buckets are largest: in a group of edited copies the
text from which the others differ least.  So there are no more pairs than texts in buckets.  What is then still
in several components of a bucket is searched by prefixes, which is exact: if
the shingles of all texts are put in one order, the rarest first, two texts at 0.8 share one
within their first fifth (the first ninth, for the smaller of two), and
places and sizes bound how many they can share.  Only texts of different components are
paired: for each shingle those outside its largest component with all others.

Words are those of SimHash.  Defined cases: fewer than five words are one shingle; texts
without words are alike, and nulls are empty.  Repeated rows count as one text.  Texts are known by a 64-bit hash of theirs, shingles by 32 bits when compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm.common import Tables, dealt_join, map_rows, whole_text
from lakescan.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 5
BLOCK = 512
_drawn = np.random.default_rng(5)
FACTORS = _drawn.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _drawn.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
#: Guards bounds of real numbers against rounding.
EPS = 1e-9


def shingles(text: str) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n, h = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[s : e - 1]) for s, e in zip(ends[:n], ends[min(SHINGLE, len(words)) :], strict=False)), np.uint64, n))


def held_set(text: str) -> np.ndarray:
    """The shingles' upper 32 bits, sorted.  Two texts of n shingles share n * n / 2 ** 32 by chance."""
    return np.unique((shingles(text) >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def band_keys(text: str) -> list[int]:
    found, least = shingles(text), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[at : at + BLOCK, None] * FACTORS + OFFSETS).min(0))
    digests = (xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS))
    return np.fromiter(digests, np.uint64, BANDS).view(np.int64).tolist()


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        near = []
        for x, y in zip(b.column("a_set"), b.column("b_set"), strict=True):
            x, y = (v.values.to_numpy() for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(both >= SIMILARITY * (len(x) + len(y) - both) - EPS)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in (b.column("a"), b.column("b"))], names=["a", "b"])


def _sizes_allow(a: str, b: str):
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b) - EPS


def verify(pairs: DataFrame, sets: DataFrame, tables: Tables, share: int = 256) -> DataFrame:
    """Of the pairs (a, b), different ones, those that are near.  Sets (th, set, n) are only moved for pairs whose sizes allow it;
    what many pairs share is repeated for each ``share`` of them."""
    sizes = sets.select("th", "n")
    known = pairs.join(sizes.select(F.col("th").alias("a"), F.col("n").alias("a_n")), "a").join(sizes.select(F.col("th").alias("b"), F.col("n").alias("b_n")), "b")
    left = tables.put(known.where(_sizes_allow("a_n", "b_n")).select("a", "b"))
    many = left.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares"))
    many = tables.put(many)
    own = left.join(many, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int")).drop("shares")
    held = sets.join(many.withColumnRenamed("b", "th"), "th").select(F.col("th").alias("b"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.col("set").alias("b_set"))
    both = own.join(sets.select(F.col("th").alias("a"), F.col("set").alias("a_set")), "a").join(held, ["b", "salt"])
    return tables.put(both.select("a", "b", "a_set", "b_set").mapInArrow(_near, "a long, b long"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of th, root, n and the shared shingles with their frequencies: the shingles of the longer prefix, by which a text
    searches smaller ones; ``index`` tells which of them lie in the shorter, by which larger ones find it."""
    for b in batches:
        shared = b.column("shared")
        frequency, shingle = shared.flatten().field("f").to_numpy(), shared.flatten().field("s").to_numpy()
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(shared).to_numpy())))
        out = {k: [] for k in ("s", "at", "rows")}
        for k, n in enumerate(b.column("n").to_pylist()):
            f, s = frequency[ends[k] : ends[k + 1]], shingle[ends[k] : ends[k + 1]]
            first = n - len(s)  # shingles that no other text has come before all others
            wanted = n - math.ceil(SIMILARITY * n - EPS) + 1 - first
            if wanted > 0:
                order = np.lexsort((s, f))[:wanted]
                out["s"].append(s[order])
                out["at"].append(np.arange(first, first + len(order)))
                out["rows"].append(np.full(len(order), k))
        if out["s"]:
            s, at, rows = (np.concatenate(out[k]) for k in ("s", "at", "rows"))
            n = b.column("n").to_numpy()[rows]
            index = at < n - np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * n - EPS) + 1
            own = [b.column(c).take(pa.array(rows)) for c in ("th", "root", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(s), *own, pa.array(at.astype(np.int32)), pa.array(index)], names=["s", "th", "root", "n", "at", "index"])


def by_prefixes(rooted: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """Candidates a, b among the texts (th, root) of different roots: all at 0.8 or more are among them."""
    texts = tables.put(sets.join(rooted, "th"))
    held = texts.select("th", F.explode("set").alias("s"))
    often = tables.put(held.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = dealt_join(held, often, "s", ["th"]).groupBy("th").agg(F.collect_list(F.struct(F.col("n").alias("f"), "s")).alias("shared"))
    rows = texts.select("th", "root", "n").join(shared, "th")
    keyed = tables.put(rows.mapInArrow(_prefixes, "s int, th long, root long, n int, at int, `index` boolean"))
    # By shingle: the component with most of its texts.  Shingles of one component aren't searched.
    sides = keyed.groupBy("s", "root").agg(F.count(F.lit(1)).alias("rows"))
    main = sides.groupBy("s").agg(F.max(F.struct("rows", "root"))["root"].alias("main"), F.sum("rows").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    rows = tables.put(dealt_join(keyed.withColumnRenamed("n", "size"), main, "s", ["th"]).withColumn("outside", F.col("root") != F.col("main")).drop("main", "n"))
    found = []
    for outside in (True, False):  # searching texts outside the main component see all others; those inside only those outside
        x = rows.where(F.col("outside") == outside).select("s", *(F.col(c).alias(f"x_{c}") for c in ("th", "root", "size", "at")))
        y = rows.where(F.col("index") if outside else F.col("index") & F.col("outside")).select("s", *(F.col(c).alias(f"y_{c}") for c in ("th", "root", "size", "at")))
        most = F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
        able = (F.col("y_size") <= F.col("x_size")) & _sizes_allow("x_size", "y_size") & (most >= SIMILARITY / (1 + SIMILARITY) * (F.col("x_size") + F.col("y_size")) - EPS)
        found.append(x.join(y, "s").where((F.col("x_root") != F.col("y_root")) & able).select(F.least("x_th", "y_th").alias("a"), F.greatest("x_th", "y_th").alias("b")))
    return found[0].unionByName(found[1]).distinct()


def links(texts: DataFrame, docs: DataFrame, more: DataFrame, tables: Tables, share: int = 256) -> DataFrame:
    """Edges a, b between the texts (columns th, keys) of docs; ``more`` holds further candidates a, b."""
    keyed = tables.put(texts.select("th", F.explode("keys").alias("key")))
    sizes = tables.put(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    left = tables.put(dealt_join(keyed, sizes, "key", ["th"]))
    tables.drop(keyed)
    weights = left.groupBy("th").agg(F.sum("n").alias("weight"))
    stands = left.select("th", "key").join(weights, "th").groupBy("key").agg(F.max(F.struct("weight", "th"))["th"].alias("b"), F.count(F.lit(1)).alias("n"))
    stands = tables.put(stands)
    met = tables.put(dealt_join(left.select("th", "key"), stands, "key", ["th"]).where("th != b").select("key", F.col("th").alias("a"), "b"))
    tables.drop(left)
    pairs = met.select("a", "b").unionByName(more.where("a != b").select("a", "b"))
    pairs = tables.put(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    needed = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    texts_of = docs.select(whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    once = texts_of.join(needed, "th", "left_semi")
    sets = map_rows(once, ["th", "text"], lambda: lambda th, text: (th, held_set(text)), [("th", "long", pa.int64()), ("set", "array<int>", pa.list_(pa.int32()))])
    sets = tables.put(sets.dropDuplicates(["th"]).withColumn("n", F.size("set")))
    found = verify(pairs, sets, tables, share)
    # All have met the text that stands for their bucket; what is left are buckets of several components.
    roots = components(found, tables).select(F.col("node").alias("a"), "root")
    open_ = met.select("key", "a").join(roots, "a", "left").select("key", "a", F.coalesce("root", "a").alias("root"))
    open_ = tables.put(open_)
    several = open_.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high").select("key", "n")
    rooted = tables.put(dealt_join(open_, tables.put(several), "key", ["a"]).select(F.col("a").alias("th"), "root").distinct())
    if rooted.isEmpty():
        return found
    return tables.put(found.unionByName(verify(by_prefixes(rooted, sets, tables), sets, tables, share)))
