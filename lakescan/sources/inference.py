"""Types of text columns: a fixed ladder of integer, float, boolean and string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Records that decide the types.
SAMPLE = 1024
INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)$"
#: Spellings of booleans.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")
_integer, _float = re.compile(INTEGER), re.compile(FLOAT)


def kind_of(text: str) -> str:
    if _integer.match(text) and -(1 << 63) <= int(text) < 1 << 63:
        return "bigint"
    if _float.match(text):
        return "double"
    return "boolean" if text.lower() in ("true", "false") else "string"


def widened(kinds: set[str]) -> str:
    """The one type for values of several; unlike ones make a string."""
    kinds = kinds - {"void"}
    if len(kinds) == 1:
        return next(iter(kinds))
    return "double" if kinds == {"bigint", "double"} else "string"


def converted(text: Column, kind: str) -> Column:
    """Null where the text is blank or doesn't fit."""
    if kind == "bigint":
        return F.when(text.rlike(INTEGER), text.try_cast("bigint"))
    if kind == "double":
        return F.when(text.rlike(FLOAT), text.try_cast("double"))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return F.when(text != "", text)
