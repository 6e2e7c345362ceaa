"""Quality rules with adaptive thresholds.

Fixed base rules reject very short and very repetitive texts.  Beyond them, each language
and source has thresholds of its own, in both directions, from quantile sketches, which merge across
tasks.  A ratio that the group's upper quartile shows is judged by outer fences: the group's quartiles
plus ``reach`` times their distance (at least half of that of all rows, as copies can make it 0).  A ratio
that is 0 up to the upper quartile has no such distance: its threshold is the ``tail`` quantile of
those of the group's rows that lie within the fences, so that junk, which they find, doesn't hide there.

A threshold lies between half and twice the same quantile of all rows.  Groups with
fewer than ``least`` rows use the thresholds of all rows.  Constants decide only what can't be learned: ratios
of which that quantile of all rows is 0, and all of them in tables with fewer than ``least`` good rows.
The thresholds are joined to the rows; rows are not regrouped for it.

Defined cases: a null text has no words and fails.  Null languages or sources form groups
of their own.  Rows are judged one by one, so repeats get the same verdict.  Ratios that tie with a threshold
pass.  Texts of any length are read whole.  Null doc_ids and columns of other names are passed on by ``keep``.  An empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm.common import map_rows, materialise, whole_text

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Ratio, and the thresholds below and above it where none can be learned.
RATIOS = (("mean_word", 2.0, 16.0), ("symbols", None, 0.1), ("dup_lines", None, 0.3), ("repeated", None, 0.15))
#: Ratio, side, sign and default of each threshold.
SIDES = tuple((r, side, sign, x) for r, low, high in RATIOS for side, sign, x in (("low", -1, low), ("high", 1, high)) if x is not None)


def features(text: str | None, window: int = WINDOW) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = text or ""
    data = text.encode()  # of bytes, split() takes exactly the six ASCII spaces
    words, seen, lines, dup = data.split(), set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    repeated = 0
    if len(number) < len(ids):  # without a repeated word no window repeats
        first: dict[tuple, int] = {}
        marks = bytearray(len(ids))
        for i, key in enumerate(zip(*(ids[k:] for k in range(window)), strict=False)):
            if (at := first.setdefault(key, i)) != i:
                marks[at : at + window] = marks[i : i + window] = b"\1" * window
        repeated = sum(marks)
    return len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), lines, dup, repeated


def _row_hash():
    """Ties a verdict to what it was made from."""
    return F.xxhash64(whole_text(), F.coalesce(F.col("lang").cast("string"), F.lit("\0")), F.coalesce(F.col("source").cast("string"), F.lit("\0")))


def measured(docs: DataFrame) -> DataFrame:
    """A row for each row: doc_id, lang, source and the counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), _row_hash().alias("th"), whole_text().alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    fields = [("doc_id", "long", pa.int64()), ("lang", "string", pa.string()), ("source", "string", pa.string()), ("th", "long", pa.int64()), *((n, "long", pa.int64()) for n in names)]
    return map_rows(rows, ["doc_id", "lang", "source", "th", "text"], lambda: lambda d, lang, source, th, text: (d, lang, source, th, *features(text)), fields)


def _ratios(df: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return df.select("*", (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbols"), (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"), (F.col("n_repeat_words") / words).alias("repeated"))


def _sketch(name: str, shares: list[float], accuracy: int):
    return F.percentile_approx(name, F.array(*map(F.lit, shares)), accuracy)


def thresholds(good: DataFrame, reach: float, least: int, tail: float, accuracy: int) -> tuple[DataFrame, dict[str, float]]:
    """g_lang, g_source and the thresholds of each group that has its own; those of all rows."""
    quartiles = [_sketch(r, [0.25, 0.75], accuracy).alias(f"q_{r}") for r, *_ in RATIOS]
    tails = [_sketch(r, [1 - tail, tail], accuracy).alias(f"t_{r}") for r, *_ in RATIOS]
    # One row for all: read once into literals.
    whole = good.agg(F.count(F.lit(1)).alias("n"), *quartiles).first()
    fixed = {f"{r}_{side}": x for r, side, _, x in SIDES}
    if whole["n"] < least:
        return good.sparkSession.createDataFrame([], "g_lang string, g_source string, " + ", ".join(f"g_{k} double" for k in fixed)), fixed
    spread = {r: (whole[f"q_{r}"][1] - whole[f"q_{r}"][0]) / 2 for r, *_ in RATIOS}

    def fences(q) -> dict:
        """Null where the upper quartile is 0."""
        return {f"{r}_{side}": F.when(q(r)[1] > 0, q(r)[1 if sign > 0 else 0] + sign * reach * F.greatest(q(r)[1] - q(r)[0], F.lit(spread[r]))) for r, side, sign, _ in SIDES}

    def within(prefix: str):
        inside = F.lit(True)
        for r, side, sign, _ in SIDES:
            inside = inside & F.coalesce(sign * F.col(r) <= sign * F.col(f"{prefix}{r}_{side}"), F.lit(True))
        return inside

    at_all = fences(lambda r: F.array(*map(F.lit, whole[f"q_{r}"])))
    rest = good.withColumns({f"a_{k}": x for k, x in at_all.items()}).where(within("a_"))
    ends = rest.agg(*tails, *(F.first(f"a_{k}").alias(k) for k in at_all)).first()
    bound = {f"{r}_{side}": (ends[f"t_{r}"] or [0, 0])[sign > 0] for r, side, sign, _ in SIDES}

    def limited(k: str, x):
        return F.least(F.greatest(x, F.lit(bound[k] / 2)), F.lit(bound[k] * 2)) if bound[k] > 0 else F.lit(fixed[k])

    own = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *quartiles).where(F.col("n") >= least)
    own = own.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(x.alias(f"f_{k}") for k, x in fences(lambda r: F.col(f"q_{r}")).items()))
    rest = good.join(own, _same_group()).where(within("f_"))
    groups = rest.groupBy("g_lang", "g_source").agg(*tails, *(F.first(f"f_{k}").alias(f"f_{k}") for k in fixed))
    groups = groups.select("g_lang", "g_source", *(limited(k, F.coalesce(f"f_{k}", F.col(f"t_{r}")[int(sign > 0)])).alias(f"g_{k}") for r, side, sign, _ in SIDES for k in [f"{r}_{side}"]))
    every = {k: min(max(bound[k] if ends[k] is None else ends[k], bound[k] / 2), bound[k] * 2) if bound[k] > 0 else fixed[k] for k in fixed}
    return groups, every


def _same_group():
    return F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))


def judged(counted: DataFrame, reach: float = 6.0, least: int = 50, tail: float = 0.99, accuracy: int = 1000) -> DataFrame:
    """The counts with base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = _ratios(counted).withColumn("base_failed", failed)
    groups, every = thresholds(rows.where(~F.col("base_failed")), reach, least, tail, accuracy)
    bad = F.lit(False)
    for r, side, sign, _ in SIDES:
        bad = bad | (sign * F.col(r) > sign * F.coalesce(F.col(f"g_{r}_{side}"), F.lit(every[f"{r}_{side}"])))
    return rows.join(groups, _same_group(), "left").withColumn("kept", ~F.col("base_failed") & ~bad)


def assess(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, th, counts, base_failed, kept: a row for each row."""
    out = judged(materialise(measured(docs)), **settings)
    return out.select("doc_id", "th", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that pass, unchanged."""
    lost = assess(docs, **settings).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    out = docs.withColumn("__h", _row_hash())
    return out.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left_anti").drop("__h")
