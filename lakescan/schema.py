"""Schemas with unique names."""

from __future__ import annotations

from pyspark.sql import types as T

from lakescan.dtypes import display
from lakescan.errors import need_columns, need_unique


class Schema:
    """Ordered fields over a StructType."""

    def __init__(self, struct: T.StructType):
        need_unique(struct.names)
        self.struct = struct

    @classmethod
    def of(cls, *fields: tuple) -> Schema:
        """Fields as (name, type[, nullable[, metadata]])."""
        return cls(T.StructType([T.StructField(n, t, *(rest or (True,))) for n, t, *rest in fields]))

    @property
    def names(self) -> list[str]:
        return self.struct.names

    def __len__(self) -> int:
        return len(self.struct)

    def contains(self, name: str) -> bool:
        return name in self.struct.names

    def column_index(self, name: str) -> int:
        need_columns(self.names, [name])
        return self.names.index(name)

    def field(self, key: str | int) -> T.StructField:
        if isinstance(key, int):
            return self.struct.fields[key]
        return self.struct.fields[self.column_index(key)]

    def project(self, names: list[str]) -> Schema:
        need_columns(self.names, names)
        return Schema(T.StructType([self.struct[n] for n in names]))

    def __repr__(self) -> str:
        return "Schema(" + ", ".join(f"{f.name}: {display(f.dataType)}" for f in self.struct) + ")"
