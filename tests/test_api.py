"""Arrays, batches, scans and plans on slices of the test tables, with expectations from DuckDB and Python."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import lakescan
from lakescan import Array, ArrayBuilder, Batch, QueryPlan, Schema, case, cast, col, from_arrow, lit
from lakescan.array import equal, mask
from lakescan.dtypes import accepted, byte_size, display, is_binary, is_primitive, is_temporal, is_vectorised
from lakescan.functions import alias_of
from lakescan.operators import relational
from lakescan.plans import Empty, Scan, Union
from lakescan.scan import scan, scan_ipc, scan_parquet
from lakescan.sources import parquet


TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines():
    """1500 rows of lineitem, by which DuckDB says what to expect."""
    return pq.read_table(f"{TABLES}/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]).slice(200, 1500).combine_chunks()


@pytest.fixture(scope="module")
def ask(lines):
    c = duckdb.connect()
    c.register("lines", lines)
    return lambda sql: c.execute(sql).fetchall()


@pytest.fixture(scope="module")
def ipc(spark, lines, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ipc") / "lines.arrow")
    lakescan.write_ipc_batches(path, [lines.slice(0, 1100), lines.slice(1100)])
    return scan_ipc(path, spark)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The events in row groups of 300."""
    path = str(tmp_path_factory.mktemp("pq") / "events.parquet")
    table = pq.read_table(f"{TABLES}/events.parquet", columns=["event_id", "user_id", "value", "event_type"]).sort_by("event_id")
    pq.write_table(table, path, row_group_size=300)
    return scan(path, spark), table


# --- arrays


def test_arrays():
    regions = pq.read_table(f"{TABLES}/nation.parquet")["n_regionkey"].to_pylist()
    a = lakescan.from_i32_list(regions)
    assert (len(a), a.dtype, a.null_count, a.is_empty(), a.memory_size) == (25, "i32", 0, False, 100)
    assert [f([]).dtype for f in (lakescan.from_i64_list, lakescan.from_f32_list, lakescan.from_f64_list, lakescan.from_bool_list, lakescan.from_str_list)] == ["i64", "f32", "f64", "bool", "string"]
    assert a.slice(7, 4).to_pylist() == regions[7:11] and a.to_pylist(as_float=True) == list(map(float, regions))
    assert a.take([24, 3, 3]).to_pylist() == [regions[24], regions[3], regions[3]] and a.take([]).to_pylist() == []
    assert a.filter(mask(a, ">", 2)).to_pylist() == [k for k in regions if k > 2]
    assert np.frombuffer(a.to_buffer(), np.int32).tolist() == regions
    assert pa.array(a).to_pylist() == regions and equal(a, lakescan.import_array(pa.array(regions, pa.int32())))
    with pytest.raises(IndexError):
        a.slice(20, 9)
    with pytest.raises(ValueError):
        ArrayBuilder("i64").append(1).append_null().finish().to_buffer()
    with pytest.raises(TypeError):
        lakescan.from_str_list(["a"]).to_buffer()
    with pytest.raises(TypeError):
        ArrayBuilder("i128")


def test_schema_and_types():
    s = Schema.of(("name", T.StringType(), False), ("age", T.IntegerType()), ("salary", T.DoubleType()), ("active", T.BooleanType()))
    assert s.contains("age") and s.column_index("salary") == 2 and s.project(["active", "name"]).names == ["active", "name"] and not s.field("name").nullable
    with pytest.raises(KeyError):
        s.field("nothing")
    with pytest.raises(ValueError):
        Schema.of(("a", T.LongType()), ("a", T.LongType()))
    assert display(T.ArrayType(T.IntegerType())) == "list[i32]" and display(T.StructType([T.StructField("name", T.StringType())])) == "struct<name: string>"
    assert is_primitive(T.DateType()) and not is_primitive(T.TimestampType()) and is_temporal(T.TimestampType()) and is_binary(T.BinaryType())
    assert not is_vectorised(T.BooleanType()) and byte_size(T.BooleanType()) == 1 and byte_size(T.LongType()) == 8
    assert accepted(pa.uint32()) == pa.int64() and accepted(pa.float16()) == pa.float32() and accepted(pa.dictionary(pa.int8(), pa.string())) == pa.string()


# --- batches


def test_batch_construction(spark):
    parts = pq.read_table(f"{TABLES}/part.parquet").slice(0, 40)
    sizes, prices = parts["p_size"].to_pylist(), parts["p_retailprice"].to_pylist()
    b = Batch(["size", "a`b"], [lakescan.from_i32_list(sizes), lakescan.from_f64_list(prices)])
    assert (b.num_rows, b.num_columns, b.column_names, len(b)) == (40, 2, ["size", "a`b"], 40)
    assert b.column("size").to_pylist() == sizes and b.select(["a`b"]).column_names == ["a`b"] and b.memory_size > 0
    assert pa.table(b).column("a`b").to_pylist() == prices and b.to_pandas()["size"].tolist() == sizes and b.to_numpy("a`b").tolist() == prices
    assert b.to_tensor("size").to_numpy().tolist() == sizes and b.cast("a`b", "string").null_counts() == {"size": 0, "a`b": 0}
    assert lakescan.from_batch(b).to_pydict() == b.to_pydict() and not b.has_nulls()
    with pytest.raises(ValueError):
        Batch(["x"], [])
    with pytest.raises(ValueError):
        Batch(["x", "y"], [[1], [1, 2]])
    with pytest.raises(ValueError):
        Batch(["x", "x"], [[1], [2]])
    with pytest.raises(KeyError):
        b.column("z")
    with pytest.raises(KeyError):
        b.select(["size", "z"])


def test_batch_accepts_arrow_types_that_spark_rejects(spark):
    t = pa.table({"u8": pa.array([1, 255], pa.uint8()), "u64": pa.array([1, 2**64 - 1], pa.uint64()), "f16": pa.array(np.array([1, 2], np.float16)), "d64": pa.array([0, 86400000], pa.date64()), "view": pa.array(["a", "b"], pa.string_view()), "dict": pa.array(["a", "b"]).dictionary_encode(), "fixed": pa.array([[1.0], [2.0]], pa.list_(pa.float32(), 1))})
    got = from_arrow(t).to_pydict()
    assert got["u8"] == [1, 255] and got["u64"][1] == 2**64 - 1 and got["view"] == got["dict"] == ["a", "b"] and got["fixed"] == [[1.0], [2.0]]


@pytest.mark.parametrize(("column", "op", "sql", "value"), [("l_orderkey", ">", ">", 90), ("l_partkey", "<", "<", 40), ("l_partkey", "==", "=", 77), ("l_orderkey", "!=", "<>", 60), ("l_quantity", "le", "<=", 7), ("l_partkey", "ge", ">=", 150), ("l_extendedprice", "<", "<", 2500.5), ("l_returnflag", "eq", "=", "R"), ("l_quantity", ">=", ">=", 49.0)])
def test_filters(ipc, ask, column, op, sql, value):
    n = ask(f"SELECT count(*) FROM lines WHERE {column} {sql} {value!r}")[0][0]
    assert ipc.read_all().filter(column, op, value).num_rows == n
    assert ipc.filter_column(column, op, value).num_rows == n
    assert ipc.filter_parallel(column, op, value).num_rows == n


def test_aggregates(ipc, ask):
    b = ipc.read_all()
    want = ask("SELECT sum(l_partkey)::BIGINT, avg(l_partkey), avg(l_partkey), min(l_partkey), max(l_partkey), count(l_partkey) FROM lines")[0]
    assert [b.agg(o, "l_partkey") for o in ("sum", "mean", "avg", "min", "MAX", "Count")] == pytest.approx(list(want))
    assert [ipc.agg_column(o, "l_partkey") for o in ("sum", "mean", "min", "max", "count")] == pytest.approx([want[k] for k in (0, 1, 3, 4, 5)])
    assert ipc.agg_column("count", "l_returnflag") == 1500 and isinstance(ipc.agg_column("count", "l_quantity"), int)
    assert ipc.filter_agg("l_quantity", "<", 5, "l_extendedprice", "sum") == pytest.approx(ask("SELECT sum(l_extendedprice) FROM lines WHERE l_quantity < 5")[0][0])
    assert ipc.filter_agg("l_partkey", ">=", 180, "l_partkey", "count") == ask("SELECT count(*) FROM lines WHERE l_partkey >= 180")[0][0]
    assert b.select(["l_orderkey", "l_quantity"]).filter("l_orderkey", "ge", 90).select(["l_quantity"]).agg("mean", "l_quantity") == pytest.approx(ask("SELECT avg(l_quantity) FROM lines WHERE l_orderkey >= 90")[0][0])
    none = b.filter("l_orderkey", "<", 0)
    assert none.agg("sum", "l_orderkey") == 0 and none.agg("sum", "l_quantity") == 0.0 and none.agg("min", "l_orderkey") is None and none.agg("count", "l_orderkey") == 0 and none.num_rows == 0
    assert ipc.filter_agg("l_orderkey", "<", 0, "l_partkey", "sum") is None and ipc.filter_agg("l_orderkey", "<", 0, "l_partkey", "max") is None and ipc.filter_agg("l_orderkey", "<", 0, "l_partkey", "count") == 0


def test_errors(ipc, events):
    b, (pq_scan, _), key = ipc.read_all(), events, "l_orderkey"
    for call in (lambda: b.agg("median", key), lambda: b.filter(key, "~", 1), lambda: ipc.agg_column("median", key), lambda: ipc.filter_agg(key, "??", 1, key, "sum"), lambda: ipc.read_columns([]), lambda: ipc.read_columns(["nothing"])):
        with pytest.raises(ValueError):
            call()
    for call in (lambda: b.filter(key, "=", [1]), lambda: b.filter("l_returnflag", ">", 1), lambda: b.filter(key, "=", "1"), lambda: b.agg("sum", "l_returnflag"), lambda: b.filter(col(key).isin([1, "x"])), lambda: b.filter(col(key).like("1%"))):
        with pytest.raises(TypeError):
            call()
    for call in (lambda: b.agg("sum", "nothing"), lambda: b["nothing"], lambda: b.sort(["nothing"])):
        with pytest.raises(KeyError):
            call()
    for call in (lambda: b.filter("nothing", "=", 1), lambda: ipc.agg_column("sum", "nothing"), lambda: ipc.filter_agg("nothing", "=", 1, key, "sum")):
        with pytest.raises(RuntimeError):
            call()
    for call in (lambda: ipc.read_batch(2), lambda: pq_scan.read_batch(999), lambda: ipc.read_batch(-1)):
        with pytest.raises(IndexError):
            call()
    for call in (lambda: scan("/nothing/here.parquet"), lambda: scan("/nothing/here.arrow"), lambda: scan("/nothing.csv")):
        with pytest.raises(OSError):
            call()


def test_nulls_and_nan(spark):
    b = Batch(["i", "f", "s"], [pa.array([1, None, 3, 4]), pa.array([math.nan, 1.0, None, -0.0]), pa.array(["a", None, "b", "a"])])
    assert b.null_counts() == {"i": 1, "f": 1, "s": 1} and b.has_nulls()
    assert b.agg("sum", "i") == 8 and b.agg("count", "i") == 3 and math.isnan(b.agg("max", "f"))
    assert b.filter("i", "!=", 3).num_rows == 2 and b.filter(~(col("i") > 3)).num_rows == 2
    assert b.filter((col("i") > 99) | (col("s") == "a")).num_rows == 2 and b.filter((col("i") > 99) & (col("s") == "b")).num_rows == 0
    assert b.filter("f", "=", 0.0).num_rows == 1 and b.filter(col("s").is_null()).num_rows == 1
    nothing = Batch(["x"], [pa.array([None, None], pa.int64())])
    assert nothing.agg("sum", "x") == 0 and nothing.agg("mean", "x") is None and nothing.agg("count", "x") == 0


def test_expressions(ipc, ask):
    e = (col("l_partkey") > 5) & ~(col("l_quantity") == 7)
    assert e.referenced_columns() == ["l_partkey", "l_quantity"] and repr(e) == "((l_partkey > 5) AND NOT ((l_quantity = 7)))"
    assert repr(col("s").like("a%")) == "(s LIKE 'a%')" and repr(col("s").matches("a$")) == "(s RLIKE 'a$')"
    b = ipc.read_all()
    count = lambda where: ask(f"SELECT count(*) FROM lines WHERE {where}")[0][0]
    assert b.filter(lit(50).lt(col("l_partkey"))).num_rows == count("50 < l_partkey") and b.filter(b["l_orderkey"] >= 70).num_rows == count("l_orderkey >= 70") and b.filter(col("l_partkey").eq(col("l_quantity"))).num_rows == count("l_partkey = l_quantity")
    assert b.with_column("z", case([(col("l_quantity") < 3, "few")], "many")).filter("z", "=", "few").num_rows == count("l_quantity < 3")
    assert b.with_column("z", cast(col("l_returnflag"), "int")).agg("count", "z") == 0 and b.cast("l_orderkey", "string").schema.field("l_orderkey").dataType == T.StringType()
    assert b.with_column("z", -(col("l_partkey") + 1) * 2 - 1).agg("max", "z") == ask("SELECT max(-(l_partkey + 1) * 2 - 1) FROM lines")[0][0]
    assert b.filter(col("l_returnflag").like("_")).num_rows == 1500 and b.filter(col("l_returnflag").matches("A|R")).num_rows == count("l_returnflag IN ('A', 'R')")


def test_rows(events):
    s, table = events
    b, ids = s.read_all(), table["event_id"].to_pylist()
    assert b.slice(10, 3, by=["event_id"]).to_pydict()["event_id"] == ids[10:13]
    assert b.take([5, 0, 5, 999], by=["event_id"]).to_pydict()["event_id"] == [ids[k] for k in (5, 0, 5, 999)]
    assert sum(t.num_rows for t in b.iter_batches(300)) == len(ids) and next(s.iter_batches(7)).num_rows == 7
    with pytest.raises(IndexError):
        b.take([-1], by=["event_id"])
    numbered = relational.numbered(b.df, ["event_type"], "at").collect()  # ties take the order of the other columns
    want = sorted((r["event_type"], r["event_id"]) for r in table.to_pylist())
    assert [(r["event_type"], r["event_id"]) for r in sorted(numbered, key=lambda r: r["at"])] == want and sorted(r["at"] for r in numbered) == list(range(len(ids)))


def test_user_functions(spark):
    b = Batch(["k", "v"], [[1, 1, 2], [3.0, 4.0, 5.0]])
    assert sorted(b.map_column("w", lambda k, v: pc.add(k, v), ["k", "v"], "double").to_pydict()["w"]) == [4.0, 5.0, 7.0]
    assert sorted(b.group_by("k").map_groups(lambda t: pa.table({"n": [t.num_rows]}), "n long").to_pydict()["n"]) == [1, 2]
    assert b.intersect(Batch(["k", "v"], [[1, 9], [3.0, 9.0]])).num_rows == 1 and b.subtract(Batch(["k", "v"], [[1, 9], [3.0, 9.0]])).num_rows == 2


# --- scans


def test_ipc_scan(ipc, spark, lines):
    assert (ipc.num_rows, ipc.num_columns, len(ipc), ipc.format, ipc.num_batches) == (1500, 5, 1500, "ipc", 2) and ipc.mmap_size > 0
    assert ipc.batch_row_counts() == [1100, 400] and ipc.read_batch(1).to_pydict()["l_orderkey"][0] == lines["l_orderkey"][1100].as_py() and ipc.read_batch(0, ["l_returnflag"]).column_names == ["l_returnflag"]
    assert ipc.read_columns(["l_quantity", "l_orderkey"]).column_names == ["l_quantity", "l_orderkey"] and ipc.read_columns_at([3]).column_names == ["l_extendedprice"]
    assert ipc.df.rdd.getNumPartitions() == 2 and scan(ipc.path, spark).format == "ipc" and "Scan" in repr(ipc)


def test_ipc_sinks(ipc, spark, tmp_path, ask):
    for compression in (None, "lz4", "zstd"):
        path = str(tmp_path / f"{compression}.arrow")
        lakescan.write_ipc_file(path, ipc.read_all(), compression)
        assert pa.ipc.open_file(path).read_all().num_rows == 1500
    lakescan.append_ipc_file(path, ipc.read_batch(0))
    assert scan_ipc(path, spark).num_rows == 2600
    folder, total = str(tmp_path / "many"), ask("SELECT sum(l_partkey)::BIGINT FROM lines")[0][0]
    lakescan.write_ipc_folder(folder, ipc.read_all(), "lz4")
    lakescan.write_ipc_folder(folder, ipc.read_all(), append=True)
    assert scan_ipc(folder, spark).agg_column("sum", "l_partkey") == 2 * total
    lakescan.write_ipc_folder(folder, ipc.read_all())
    assert scan_ipc(folder, spark).num_rows == 1500
    for _ in range(2):  # an empty table keeps its schema, also in place of another
        lakescan.write_ipc_folder(folder, ipc.filter_column("l_orderkey", "<", -1).select(["l_orderkey", "l_returnflag"]))
        empty = scan_ipc(folder, spark)
        assert empty.num_rows == 0 and empty.df.dtypes == [("l_orderkey", "bigint"), ("l_returnflag", "string")] and empty.read_all().df.collect() == []
        folder = str(tmp_path / "new")
    with pytest.raises(ValueError):
        lakescan.write_ipc_batches(path, [])
    with pytest.raises(ValueError):
        lakescan.write_ipc_batches(path, [pa.table({"a": [1]}), pa.table({"b": [1]})])


def test_parquet_scan(events, tmp_path, spark):
    s, table = events
    n = table.num_rows
    assert (s.format, s.num_rows, s.column_names, s.mmap_size) == ("parquet", n, ["event_id", "user_id", "value", "event_type"], 0)
    sizes = [min(300, n - at) for at in range(0, n, 300)]
    assert s.batch_row_counts() == sizes and s.num_batches == len(sizes)
    for k in (0, len(sizes) - 1):
        assert s.read_batch(k).to_pydict() == table.slice(300 * k, 300).to_pydict()
    ids, v = table["event_id"].to_numpy(), table["value"].to_numpy()
    assert s.filter_parallel("event_id", ">", int(ids[-10])).num_rows == 9 and s.filter_column("event_id", "==", int(ids[3])).num_rows == 1
    assert s.filter_agg("value", ">", 90, "value", "sum") == pytest.approx(v[v > 90].sum()) and s.agg_column("max", "value") == v.max() and s.null_count("value") == 0
    assert s.row_groups_matching_filter("event_id", ">", int(ids[-1]) - 1) == [len(sizes) - 1] and s.row_groups_matching_filter("event_id", "==", int(ids[5])) == [0] and s.row_groups_matching_filter("event_id", "<", int(ids[0])) == []
    plan = s.filter_parallel("event_id", ">", 990).select(["event_id"]).explain()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,990)]" in plan and "ReadSchema: struct<event_id:bigint>" in plan
    folder = tmp_path / "odd name=%1"
    folder.mkdir()
    for k in range(3):
        pq.write_table(table.slice(100 * k, 100), folder / f"p {k}.parquet", row_group_size=40)
    many = scan_parquet(str(folder), spark)
    assert many.batch_row_counts() == [40, 40, 20] * 3 and many.read_batch(5, ["event_id"]).to_pydict() == {"event_id": table["event_id"].to_pylist()[180:200]}


def test_row_groups_at_once(ipc, tmp_path, spark):
    """Groups of 1 to 400 rows in files with awkward names, under columns named as the reader's own."""
    table = pq.read_table(f"{TABLES}/events.parquet", columns=["event_id", "value", "event_type", "user_id"]).slice(0, 1000).rename_columns(["first", "row 0", "file", "a.b"])
    folder = tmp_path / "odd ü=%1"
    folder.mkdir()
    cuts, parts = [[0, 1, 2, 3, 403, 500], [500, 500], [500, 510, 900, 1000]], []
    for k, cut in enumerate(cuts):
        with pq.ParquetWriter(folder / f"p é+{k}.parquet", table.schema) as out:
            for a, b in zip(cut, cut[1:]):
                if b > a:
                    out.write_table(table.slice(a, b - a), row_group_size=b - a)
                    parts.append(table.slice(a, b - a))
    s = scan_parquet(str(folder), spark)
    assert s.batch_row_counts() == [len(p) for p in parts] == [1, 1, 1, 400, 97, 10, 390, 100]

    def same(got, indices, columns=table.column_names):
        want = [(*r.values(), k) for k in indices for r in parts[k].select(columns).to_pylist()]
        assert got.column_names == [*columns, "k"] and sorted(tuple(r) for r in got.df.collect()) == sorted(want)

    same(s.read_row_groups(number="k"), range(8))
    same(s.read_row_groups([6, 0, 6, 2], ["file", "first"], "k"), [6, 0, 6, 2], ["file", "first"])
    same(s.read_row_groups([7], number="k"), [7])
    same(s.read_row_groups([], number="k"), [])
    plan = s.read_row_groups(columns=["first"]).explain()
    assert plan.count("ReadSchema") == plan.count("ReadSchema: struct<first:bigint,_tmp") == 1
    assert s.read_batch(5).to_pydict() == parts[5].to_pydict()
    for bad, columns, error in (([8], None, IndexError), ([-1], None, IndexError), ([0], ["no"], IndexError)):
        with pytest.raises(error):
            s.read_row_groups(bad, columns)
    with pytest.raises(NotImplementedError):
        ipc.read_row_groups()
    kept = scan_parquet(str(folder), spark).prefetch()
    same(kept.read_row_groups([3, 4], number="k"), [3, 4])
    kept.release()
    pq.write_table(table.slice(0, 5), folder / "q.parquet")
    with pytest.raises(OSError):  # not among the rows of the scan that is open
        s.read_row_groups()


def test_row_groups_query_scans_once(spark, monkeypatch):
    """One scan and one look at the footers, whatever the number of groups."""
    found, footers = [], parquet.row_groups
    monkeypatch.setattr(parquet, "row_groups", lambda *x: found.append(footers(*x)) or found[-1])
    df = entry.queries()["parquet_row_groups"](spark, "/root/testdata/sf0.01")
    assert len(found) == 1 and len(found[0]) > 1
    assert df._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    want = duckdb.sql("SELECT o_orderkey, o_totalprice FROM '/root/testdata/sf0.01/orders.parquet'").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


# --- plans


def test_query_plan(spark):
    supplier = pq.read_table(f"{TABLES}/supplier.parquet")
    key, balance = supplier["s_suppkey"].to_pylist(), supplier["s_acctbal"].to_pylist()
    b = Batch(["key", "balance"], [key, balance])
    plan = QueryPlan().filter(col("key") > 4).project(["balance"]).aggregate("sum", "balance").aggregate("count", "balance", "n")
    some = [x for k, x in zip(key, balance) if k > 4]
    assert plan.execute(b) == {"SUM_balance": pytest.approx(sum(some)), "n": len(some)} and alias_of("avg", "x") == "MEAN_x"
    assert QueryPlan().filter(col("key") > 1).filter(col("key") < 4).execute(b).num_rows == sum(1 < k < 4 for k in key)
    with pytest.raises(KeyError):
        QueryPlan().project(["key"]).aggregate("sum", "balance").execute(b)


def test_logical_plan(spark):
    df = spark.createDataFrame([(k, f"n{k}", k * 1.0) for k in range(10)], "id long, name string, value double")
    plan = Scan(df).filter(col("id") >= 3).project(["id", "name"]).sort([("id", False)]).limit(2, 1)
    assert [r["id"] for r in plan.collect(spark)] == [8, 7]
    assert plan.pretty().split("\n")[0] == "Limit 2 offset 1" and plan.pretty().count("\n") == 4
    assert Union([Scan(df), Scan(df)]).lower(spark).count() == 20 and Empty("a long").collect(spark) == []
    assert Scan(df, ["name"], 3).lower(spark).count() == 3
    df.createOrReplaceTempView("plan_view")
    assert Scan("plan_view").lower(spark).count() == 10


@pytest.mark.parametrize(("how", "n"), [("inner", 2), ("left", 4), ("right", 3), ("full", 5), ("semi", 2), ("anti", 2)])
def test_joins(spark, how, n):
    a = Batch(["k", "v"], [pa.array([1, 2, 3, None]), [1, 2, 3, 4]])
    b = Batch(["k", "v"], [pa.array([2, 3, None]), [20, 30, 40]])
    out = a.join(b, "k", how)
    assert out.num_rows == n and out.column_names == (["k", "v"] if how in ("semi", "anti") else ["k", "v", "v_right"])
    if how == "full":
        assert sorted((r["k"] is None, r["k"], r["v"], r["v_right"]) for r in out.df.collect() if r["k"]) == [(False, 1, 1, None), (False, 2, 2, 20), (False, 3, 3, 30)]
    with pytest.raises(ValueError):
        a.join(b, None, how)


def test_optimizer_does_what_the_rules_ask(spark, events):
    s, _ = events
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in optimized(s.df.filter(F.lit(True))) and "LocalRelation <empty>" in optimized(s.df.filter(F.lit(False)).select("event_id").limit(3))
    assert "NOT NOT" not in optimized(s.df.filter(~~(F.col("event_id") > 3))) and "(5 > 3)" not in optimized(s.df.filter((F.lit(5) > 3) & (F.col("event_id") > 1)))
    assert optimized(s.df.select("event_id", "value").filter("event_id > 5")).index("Project") < optimized(s.df.select("event_id", "value").filter("event_id > 5")).index("Filter")
    assert "LocalLimit" in optimized(s.df.select("event_id").limit(5)) and "(1 + 2)" not in optimized(s.df.filter(F.col("event_id") > F.lit(1) + F.lit(2)))
    assert "LocalRelation <empty>" in optimized(s.df.filter(F.lit(False)).join(s.df.select("event_id"), "event_id"))


def test_config():
    conf = lakescan.EngineConfig(num_workers=3, memory_budget=1 << 30, spill_dir="/tmp", codegen=False, optimizer=False).spark_conf()
    assert conf["spark.master"] == "local[3]" and conf["spark.sql.codegen.wholeStage"] == "false" and "ConstantFolding" in conf["spark.sql.optimizer.excludedRules"]
