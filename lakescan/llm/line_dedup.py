"""Line deduplication with a log-template tree.

The tree has a fixed depth: the number of tokens, then the leading tokens, with tokens that hold a
digit taken as variable.  In a leaf, lines form templates by the places at which they are equal.  The
exact line is one.  Lines with digits and at least ``tokens`` tokens have a second, in which the tokens with digits
are fields.  Lines of at least ``wide`` tokens have four more: the tokens after the leading ones are cut into four
blocks, and in each template one of the blocks is left open, whatever stands there.  A line always equals its template's
other lines in at least half of its tokens, with fields without digits in three quarters: lines that need wider fields, or
such fields in several blocks, aren't generalised.

An exact line recurs if it stands in two or more documents, however many tokens it has; another template
recurs if it also stands for at least ``least`` lines.  A line belongs to one template, the recurring one of its own that
stands for most lines, and is dropped if the template also stands in a document of lesser doc_id.  So the template's lines in its first document
stay: every dropped line has a survivor that equals it at all of the template's constant places.

Only DataFrame operations are used.  Templates are counted with map-side aggregation
and joined to the lines, those of most lines dealt to several tasks; no template's lines are gathered.

Defined cases: null texts have no lines and stay null.  Lines of fewer than ``shortest`` characters
stay.  Null doc_ids count as none: their lines of templates that other documents hold go.  Rows of equal
doc_id count as one document, also if they repeat or differ in text.  Very long texts take work in proportion to
their length.  Empty tables give empty tables.  All columns stay, also those with names that are used here; only the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakescan.llm.common import Tables, dealt_join, whole_text

DEPTH, SHORTEST, TOKENS, WIDE, LEAST = 3, 4, 3, 8, 5
#: Blocks of a line of which one may be open.
BLOCKS = 4
#: A token with a digit, looked for at starts of tokens only, without going back.
VARIABLE = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
FIELD = "<*>"


def _lines(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("th"), F.split(whole_text(), "\n").alias("lines"))
    # Without the text, which each line would carry along.  The outer forms keep the optimiser from repeating the whole expression in a filter below.
    lines = rows.select("doc_id", "th", F.posexplode_outer("lines").alias("line", "raw"))
    lines = lines.select("doc_id", "th", "line", F.btrim("raw", F.lit(" \t\r")).alias("raw"))
    digits, words = F.col("raw").rlike("[0-9]"), lambda c: F.split(c, "[ \t\r]+")
    masked = F.when(digits, F.regexp_replace("raw", VARIABLE, FIELD)).otherwise(F.col("raw"))
    # Of lines without digits the template is the exact line.
    fixed = F.when(digits, F.xxhash64(F.lit(3), words(F.col("raw"))))
    return lines.select("doc_id", "th", "line", F.length("raw").alias("chars"), words(masked).alias("t"), fixed.alias("fixed"))


def _key(hashed, exact: bool):
    """The lowest bit tells whether the template is an exact line."""
    return hashed.bitwiseOR(F.lit(1)) if exact else hashed.bitwiseAND(F.lit(-2))


def templates(docs: DataFrame, depth: int = DEPTH, shortest: int = SHORTEST, tokens: int = TOKENS, wide: int = WIDE) -> DataFrame:
    """doc_id, th, line, template: one to six rows for each line that is long enough.  wide is at least depth + BLOCKS."""
    n, rest = F.col("n"), F.col("n") - depth
    after = [((k * rest + BLOCKS - 1) / BLOCKS).cast("int") + depth for k in range(BLOCKS + 1)]
    lines = _lines(docs).withColumn("n", F.size("t"))
    fields = F.when(F.col("fixed").isNotNull(), F.size(F.filter("t", lambda x: x == FIELD))).otherwise(0)
    blocks = [F.when(n >= wide, F.xxhash64(F.slice("t", after[k] + 1, after[k + 1] - after[k]))).alias(f"b{k}") for k in range(BLOCKS)]
    leaf = F.when(n >= wide, F.xxhash64("n", F.slice("t", 1, depth))).alias("leaf")
    # The whole line is hashed by its parts where it has them.
    whole = F.when(n < wide, F.xxhash64(F.lit(0), "n", "t")).alias("short")
    lines = lines.select("doc_id", "th", "line", "chars", "n", "fixed", fields.alias("fields"), whole, leaf, *blocks)
    parts = [f"b{k}" for k in range(BLOCKS)]
    whole = F.coalesce("short", F.xxhash64(F.lit(0), "leaf", *parts))
    exact = _key(F.coalesce("fixed", whole), True)
    masked = F.when(F.col("fixed").isNotNull() & (2 * F.col("fields") <= n), _key(whole, False))
    widest = ((rest + BLOCKS - 1) / BLOCKS).cast("int")
    enough = 2 * (F.col("fields") + widest) <= n
    opened = [F.when(enough, _key(F.xxhash64(F.lit(k + 1), "leaf", *parts[:k], *parts[k + 1 :]), False)) for k in range(BLOCKS)]
    keys = F.when(F.col("chars") < shortest, F.array(F.lit(None).cast("long"))).when(n >= wide, F.array(exact, masked, *opened)).when(n >= tokens, F.array(exact, masked)).otherwise(F.array(exact))
    keyed = lines.select("doc_id", "th", "line", keys.alias("keys"))
    return keyed.select("doc_id", "th", "line", F.explode_outer("keys").alias("template")).where(F.col("template").isNotNull())


def recurring(found: DataFrame, least: int = LEAST) -> DataFrame:
    """template, n: its lines."""
    counts = found.groupBy("template").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n"))
    enough = (F.col("template").bitwiseAND(F.lit(1)) == 1) | (F.col("n") >= least)
    return counts.where(enough & (F.col("first_doc") != F.col("last_doc"))).select("template", "n")


def chosen(docs: DataFrame, tables: Tables, least: int = LEAST, **tree) -> DataFrame:
    """doc_id, th, line, template: the template of each line that has a recurring one."""
    found = templates(docs, **tree)
    hits = dealt_join(found, tables.put(recurring(found, least)), "template", ["doc_id", "th", "line"])
    return hits.groupBy("doc_id", "th", "line").agg(F.max(F.struct("n", "template"))["template"].alias("template"))


def dedup(docs: DataFrame, least: int = LEAST, **tree) -> DataFrame:
    """docs with shorter texts, and n_dropped."""
    tables, kept = Tables(docs.sparkSession), Tables(docs.sparkSession)
    own = tables.put(chosen(docs, tables, least, **tree))
    first = tables.put(own.groupBy("template").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where(F.col("first_doc").isNotNull()))
    lost = dealt_join(own, first, "template", ["doc_id", "th", "line"]).where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first_doc")))
    lost = kept.put(lost.groupBy("doc_id", "th").agg(F.collect_list("line").alias("__lost")).withColumnsRenamed({"doc_id": "__id", "th": "__th"}))
    tables.clear()
    # The text goes through the join as its lines, which are then picked by number.
    out = docs.withColumns({"__h": F.xxhash64(whole_text()), "text": F.split("text", "\n")})
    out = out.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size("text") - 1), "__lost")
    left = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(F.transform(numbers, lambda k: F.get("text", k)))
    return out.withColumns({"text": F.array_join(left, "\n"), "n_dropped": F.coalesce(F.size("__lost"), F.lit(0))}).drop("__h", "__id", "__th", "__lost")
