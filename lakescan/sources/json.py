"""JSON: newline-delimited records, or one array of objects.

Lines are parsed once into the types on the executors; those that don't fit are parsed again into variants.
Names and types come from the first records:
per record in sorted order, new names appended.  Nested values become their compact text.
Malformed records fail the read, also if only rows are counted or something follows a record on its line; records that aren't objects give a row of nulls in
newline-delimited files and are left out of arrays.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan.sources.files import needed
from lakescan.sources.inference import FALSE, FLOAT, INTEGER, SAMPLE, TRUE, widened

FORMATS = ("auto", "array", "ndjson")
MISFIT = "__misfit"
#: Text of a string column that may come from a value that isn't a string and whose compact form may differ.
SHAPED = r"^([\[{]|-?[0-9]+[.eE][0-9.eE+-]*$)"


def _kind(value) -> str:
    if value is None:
        return "void"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if -(1 << 63) <= value < 1 << 63 else "double"
    return "double" if isinstance(value, float) else "string"


def _typed(value: Column, kind: str) -> Column:
    """A column of one kind out of a variant, by what the value is."""
    what = F.schema_of_variant(value)
    number = (what == "BIGINT") | (what == "DOUBLE") | what.startswith("DECIMAL")
    text = F.try_variant_get(value, "$", "string")
    if kind == "bigint":
        real = F.try_variant_get(value, "$", "double").try_cast("bigint")
        return F.when(number, F.coalesce(F.try_variant_get(value, "$", "bigint"), real)).when((what == "STRING") & text.rlike(INTEGER), text.try_cast("bigint"))
    if kind == "double":
        return F.when(number, F.try_variant_get(value, "$", "double")).when((what == "STRING") & text.rlike(FLOAT), text.try_cast("double"))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(what == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when((what == "STRING") & low.isin(*TRUE), True).when((what == "STRING") & low.isin(*FALSE), False)
    if kind == "void":
        return F.lit(None).cast("void")
    return F.when(what == "STRING", text).when(what != "VOID", F.to_json(value))


def read(spark: SparkSession, path: str, form: str = "auto", sample: int = SAMPLE) -> DataFrame:
    if form not in FORMATS:
        raise ValueError(f"the format is one of {', '.join(FORMATS)}")
    needed(spark, path)
    records = None
    marked = F.col("value").startswith("\ufeff")
    lines = spark.read.text(path).select(F.when(marked, F.substring("value", 2, 1 << 30)).otherwise(F.col("value")).alias("value"))
    filled = lines.where(F.btrim("value", F.lit(" \t\r")) != "")
    first = filled.select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if first is None:
        raise OSError(f"{path} has no records")
    if form == "array" or form == "auto" and first["c"] == "[":
        whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
        parsed = F.coalesce(F.from_json("value", "array<variant>", {"mode": "FAILFAST"}), F.raise_error(F.lit(f"{path} holds no array")))
        records = whole.select(F.explode(parsed).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
        texts = [r["t"] for r in records.select(F.to_json("v").alias("t")).limit(sample).collect()]
    else:
        texts = [r["value"] for r in filled.limit(sample).collect()]
    kinds: dict[str, set[str]] = {}
    for k, t in enumerate(texts):
        try:
            record = json.loads(t)
        except ValueError as e:
            raise OSError(f"{path}, record {k + 1}: {e}") from e
        for name in sorted(record) if isinstance(record, dict) else ():
            kinds.setdefault(name, set()).add(_kind(record[name]))
    if not texts or not kinds:
        raise OSError(f"{path} has no records")
    typed = {name: widened(k) if k != {"void"} else "void" for name, k in kinds.items()}
    if records is None:
        return _lines(lines, typed)
    rows = records.select(F.try_variant_get("v", "$", "map<string,variant>").alias("m"))
    return rows.select(*(_typed(F.col("m")[name], kind).alias(name) for name, kind in typed.items()))


def _lines(lines: DataFrame, typed: dict[str, str]) -> DataFrame:
    """A row for each line.

    A parser stops at the end of a record, so a line is only known to hold nothing else if its first closing brace is its
    last character.  Others, and those that don't fit the types, are put into an array in a record with an end
    mark: the parser finds the mark, and one element, only if the line is one whole value.
    """
    names = [f"`{n.replace('`', '``')}` {k}" for n, k in typed.items() if k != "void"]
    parsed = F.from_json("value", f"struct<{', '.join([*names, f'`{MISFIT}` string'])}>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MISFIT})
    rows = lines.select("value", parsed.alias("t"))
    t = F.col("t")
    odd = t.isNull() | t[MISFIT].isNotNull() | (F.instr("value", "}") != F.length("value"))
    for name, kind in typed.items():
        if kind == "string":
            odd = odd | F.coalesce(t[name].rlike(SHAPED), F.lit(False))
    # The rows' numbers keep the filter from being moved below the parsing, which it would repeat.
    rows = rows.select("t", F.when(odd, F.col("value")).alias("value"), F.monotonically_increasing_id().alias("at"))
    put = F.try_parse_json(F.concat(F.lit('{"r":['), "value", F.lit('],"end":true}')))
    rows = rows.select("t", "value", "at", F.when(F.col("value").isNotNull(), F.coalesce(put, F.parse_json(F.lit("{}")))).alias("v"))
    v, blank = F.col("v"), F.btrim("value", F.lit(" \t\r")) == ""
    whole = F.coalesce(F.try_variant_get(v, "$.end", "boolean"), F.lit(False)) & F.try_variant_get(v, "$.r[1]", "variant").isNull()
    bad = F.raise_error(F.concat(F.lit("malformed record: "), F.substring("value", 1, 80))).cast("boolean")
    rows = rows.where(F.when(v.isNull(), F.col("at") >= 0).when(blank, False).when(whole, True).otherwise(bad))
    rows = rows.select("t", v.isNotNull().alias("misfit"), F.when(v.isNotNull(), F.try_variant_get("v", "$.r[0]", "map<string,variant>")).alias("m"))
    out = []
    for name, kind in typed.items():
        own = F.lit(None).cast("void") if kind == "void" else F.col("t")[name]
        out.append(F.when(F.col("misfit"), _typed(F.col("m")[name], kind)).otherwise(own).alias(name))
    return rows.select(*out)
