"""Files behind a path, through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class File:
    path: str
    size: int


def listed(spark: SparkSession, path: str) -> list[File]:
    """Files of a path, folder or pattern, in order of name; hidden ones are left out."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    out: list[File] = []
    for status in fs.globStatus(where) or []:
        todo = [status]
        while todo:
            s = todo.pop()
            name = s.getPath().getName()
            if s.isDirectory():
                todo += [x for x in fs.listStatus(s.getPath()) if not x.getPath().getName().startswith(("_", "."))]
            elif not name.startswith(("_", ".")) or s is status:
                out.append(File(s.getPath().toString(), s.getLen()))
    return sorted(out, key=lambda f: f.path)


def needed(spark: SparkSession, path: str) -> list[File]:
    """The same; OSError if there are none or all are empty."""
    try:
        found = listed(spark, path)
    except Exception as e:
        raise OSError(f"can't read {path}: {str(e).splitlines()[0]}") from e
    if not found:
        raise FileNotFoundError(f"no such file: {path}")
    if not any(f.size for f in found):
        raise OSError(f"{path} is empty")
    return found


def local(path: str) -> str:
    """A local path without its scheme, for libraries that open files themselves."""
    return path.removeprefix("file://").replace("file:/", "/", 1) if path.startswith("file:") else path
