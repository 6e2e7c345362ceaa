"""CSV with a fixed inference.

Quotes are doubled inside quotes, fields are trimmed, empty ones are null.  Names come from the
header or are col0, col1 and so on.  Types come from the first records; later values
that don't fit are null.  Short rows end in nulls, what long ones have in excess is dropped, and blank
lines are skipped.

The reader converts records to the types at once; only those that don't fit are split again into
texts and converted by the rules of the inference, which are wider in some places.  Floats stay texts in the reader, as it
takes spellings that the inference doesn't.

A file can only be split at line ends if no field holds one.  A distributed look at the lines
tells: a field with a line end leaves an odd number of quotes in the line where it begins.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan.errors import need_unique
from lakescan.sources.files import needed
from lakescan.sources.inference import FLOAT, SAMPLE, converted, kind_of, widened

MISFIT = "__misfit"


def has_quoted_newlines(spark: SparkSession, path: str, quote: str = '"') -> bool:
    lines = spark.read.text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit(quote)))) % 2 == 1
    return not lines.where(odd).isEmpty()


def _first(spark: SparkSession, path: str, options: dict, delimiter: str, quote: str) -> list[str] | None:
    """The first record's fields."""
    line = spark.read.text(path).where(F.btrim("value") != "").first()
    if line is None:
        return None
    if line["value"].count(quote) % 2 or any(c in line["value"] for c in "\r\0"):  # it goes on, or needs the reader's own rules
        head = spark.read.options(**options | {"header": False}).csv(path).first()
        return [v or "" for v in head]
    return next(csv.reader([line["value"].lstrip("﻿")], delimiter=delimiter, quotechar=quote, skipinitialspace=options["ignoreLeadingWhiteSpace"]))


def read(spark: SparkSession, path: str, has_header: bool = True, delimiter: str = ",", quote: str = '"', sample: int = SAMPLE, trim: bool = True, quoted_newlines: bool | None = None) -> DataFrame:
    """quoted_newlines: None looks at the lines first; False promises that there are none."""
    needed(spark, path)
    if not delimiter:
        raise ValueError("the delimiter is empty")
    whole = has_quoted_newlines(spark, path, quote) if quoted_newlines is None else quoted_newlines
    options = {"sep": delimiter[0], "quote": quote, "escape": quote, "header": has_header, "multiLine": whole, "ignoreLeadingWhiteSpace": trim, "ignoreTrailingWhiteSpace": trim, "enforceSchema": True}
    first = _first(spark, path, options, delimiter[0], quote)
    if not first:
        raise OSError(f"{path} has no columns")
    names = [(v.strip() if has_header else "") or f"col{k}" for k, v in enumerate(first)]
    need_unique(names)
    texts = ", ".join(f"`c{k}` string" for k in range(len(names)))
    cell = (lambda c: F.btrim(c, F.lit(" \t\r\n"))) if trim else (lambda c: c)
    raw = spark.read.options(**options).schema(texts).csv(path)
    seen = raw.select(*(cell(F.col(n)).alias(n) for n in raw.columns)).limit(sample).collect()
    kinds = [widened({kind_of(r[k]) for r in seen if r[k]}) for k in range(len(names))]
    held = [k if k in ("bigint", "boolean") else "string" for k in kinds]
    fast = ", ".join(f"`c{k}` {t}" for k, t in enumerate(held))
    rows = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=MISFIT).schema(f"{fast}, `{MISFIT}` string").csv(path)
    own = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k not in ("header", "multiLine", "enforceSchema")}
    again = F.when(F.col(MISFIT).isNotNull(), F.from_csv(MISFIT, texts, own))
    rows = rows.select("*", again.alias("again"))
    out = []
    for k, (name, kind) in enumerate(zip(names, kinds, strict=True)):
        c, text = F.col(f"c{k}"), cell(F.col("again")[f"c{k}"])
        last = F.substring(c, -1, 1)
        if kind == "double":
            # Of what a cast takes the inference refuses hexadecimals and type letters, which end in d or f, as does inf.  A cast trims.
            fits = F.when((last < "0") | (last > "9"), cell(c).rlike(FLOAT)).otherwise(~F.contains(c, F.lit("x")) & ~F.contains(c, F.lit("X")))
            c = F.when(fits, c.try_cast("double"))
        elif kind not in ("bigint", "boolean"):
            # The reader has trimmed what isn't quoted.
            c = F.when((F.ascii(c) <= 32) | (last <= " "), cell(c)).otherwise(c) if trim else c
            c = F.when(c != "", c)
        out.append(F.when(F.col("again").isNotNull(), converted(text, kind)).otherwise(c).alias(name))
    return rows.select(*out)
