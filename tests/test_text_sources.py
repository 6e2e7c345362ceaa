"""CSV and JSON: inference and conversion."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakescan.scan import scan_csv, scan_json
from lakescan.sources.csv import has_quoted_newlines
from lakescan.sources.inference import kind_of, widened


@pytest.fixture
def put(tmp_path):
    def f(text, name="f.csv"):
        (tmp_path / name).write_bytes(text.encode() if isinstance(text, str) else text)
        return str(tmp_path / name)

    return f


def rows(s):
    return [tuple(r) for r in s.df.collect()]


def kinds(s):
    return [t for _, t in s.df.dtypes]


def test_csv_types(spark, put):
    s = scan_csv(put("i,f,b,s,m,w\n1,1.5,true,x,1,true\n2,nan,False,y,2.5,1\n"), spark=spark)
    assert kinds(s) == ["bigint", "double", "boolean", "string", "double", "string"] and s.num_rows == 2
    assert rows(s)[0] == (1, 1.5, True, "x", 1.0, "true") and str(rows(s)[1][1]) == "nan"


def test_csv_quotes_spaces_and_ragged_rows(spark, put):
    p = put('a , b,c\n "al,ice" ,"say ""hi""",1\nshort\nlong,1,2,3,4\n\n"two\nlines", x ,7\n')
    assert has_quoted_newlines(spark, p)
    assert rows(scan_csv(p, spark=spark)) == [("al,ice", 'say "hi"', 1), ("short", None, None), ("long", "1", 2), ("two\nlines", "x", 7)]
    assert not has_quoted_newlines(spark, put('a,b\n"x","y"\n', "g.csv"))


def test_csv_options(spark, put):
    assert scan_csv(put("1;2\n3;4\n"), has_header=False, delimiter=";|", spark=spark).column_names == ["col0", "col1"]
    assert rows(scan_csv(put("a,b\r\n1,\r\n,2\r\n"), spark=spark)) == [(1, None), (None, 2)]
    s = scan_csv(put("a,b\n"), spark=spark)
    assert s.num_rows == 0 and kinds(s) == ["string", "string"]
    with pytest.raises(OSError):
        scan_csv(put(""), spark=spark)
    with pytest.raises(ValueError):
        scan_csv(put("a,a\n1,2\n"), spark=spark)


def test_csv_beyond_the_sample(spark, put):
    body = "".join(f"{k},{'yes' if k % 2 else 'true'}\n" for k in range(3)).replace("yes", "false")
    s = scan_csv(put("n,b\n" + body + "x,YES\n9,0\n1d,t\n"), spark=spark, sample=3)
    assert kinds(s) == ["bigint", "boolean"] and rows(s)[3:] == [(None, True), (9, False), (None, None)]


def test_csv_queries(spark, put):
    s = scan_csv(put("id,v\n" + "".join(f"{k},{k * 2}\n" for k in range(50))), spark=spark)
    assert s.agg_column("sum", "v") == 2450 and s.filter_agg("id", "<", 3, "v", "max") == 4 and s.filter_column("id", ">", 47).num_rows == 2
    assert s.read_columns(["v"]).column_names == ["v"] and s.read_batch(0).num_rows == 50
    with pytest.raises(IndexError):
        s.read_batch(1)


def test_json_formats(spark, put):
    lines = '{"b": 1, "a": "x"}\n\n{"a": "y", "b": 2.5, "c": {"k": [1, 2]}}\r\n'
    s = scan_json(put(lines, "f.ndjson"), spark=spark)
    assert s.column_names == ["a", "b", "c"] and kinds(s) == ["string", "double", "string"] and rows(s) == [("x", 1.0, None), ("y", 2.5, '{"k":[1,2]}')]
    s = scan_json(put('﻿  [ {"a": 1, "t": "b{r}"},\n 5, null, {"a": null, "z": true} ]', "f.json"), spark=spark)
    assert s.column_names == ["a", "t", "z"] and rows(s) == [(1, "b{r}", None), (None, None, True)]
    assert rows(scan_json(put('{"a": null}\n[1]\n{"a": null}', "n.json"), form="ndjson", spark=spark)) == [(None,)] * 3


def test_json_conversions(spark, put):
    first = '{"i": 1, "f": 1.5, "b": true, "s": "x", "n": 12345678901234567890}\n'
    more = ['{"i": 2.7, "f": "2.5", "b": "YES", "s": 5}', '{"i": "5", "f": "x", "b": 1, "s": true, "late": 1}', '{"i": "2.7", "b": "no", "s": [1, {"k": "v"}]}', '{"i": true, "b": null}', "7"]
    s = scan_json(put(first + "\n".join(more), "f.json"), spark=spark, form="auto")
    assert "late" in s.column_names
    from lakescan.sources import json as source

    df = source.read(spark, s.path, sample=1)
    assert df.columns == ["b", "f", "i", "n", "s"] and [t for _, t in df.dtypes] == ["boolean", "double", "bigint", "double", "string"]
    assert [tuple(r) for r in df.select("i", "f", "b", "s").collect()] == [(1, 1.5, True, "x"), (2, 2.5, True, "5"), (5, None, None, "true"), (None, None, False, '[1,{"k":"v"}]'), (None, None, None, None), (None, None, None, None)]


def test_json_errors(spark, put):
    for text in ("", "\n\n", '{"a": 1}\n{"a": \n'):
        with pytest.raises(OSError):
            scan_json(put(text, "f.json"), spark=spark)
    from lakescan.sources import json as source

    with pytest.raises(Exception, match="malformed"):
        source.read(spark, put('{"a": 1}\n{"a": 2}\n{"a":\n', "g.json"), sample=2).collect()


def test_widening():
    assert [kind_of(x) for x in ("1", "-7", "1e3", ".5", "5.", "inf", "NaN", "True", "1d", "1_0", "9223372036854775808", "2024-01-01")] == ["bigint", "bigint", *["double"] * 5, "boolean", "string", "string", "double", "string"]
    assert [widened(set(x)) for x in (["bigint", "double"], ["bigint"], ["boolean", "bigint"], ["void", "double"], [])] == ["double", "bigint", "string", "double", "string"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.fixed_dictionaries({}, optional={"a": st.none() | st.booleans() | st.integers(-(2**62), 2**62), "b": st.text("ab\"\\ é\n", max_size=5), "c": st.integers(0, 9) | st.sampled_from([0.5, -2.25])}), min_size=1, max_size=8))
def test_json_equals_a_model(spark, tmp_path, records):
    if not any(records):
        return
    p = tmp_path / "h.json"
    p.write_text("\n".join(map(json.dumps, records)))
    s = scan_json(str(p), spark=spark)
    for name, kind in zip(s.column_names, kinds(s)):
        values = [r.get(name) for r in records]
        got = [r[name] for r in s.df.select(name).collect()]
        want = [json.dumps(v) if kind == "string" and not isinstance(v, (str, type(None))) else v for v in values]
        assert got == want


def test_json_takes_one_record_a_line(spark, put):
    from lakescan.sources import json as source

    good = "".join(f'{{"a": {k}, "s": "x}}{k}", "n": {{"k": [{k}, 1.50]}}}}\n' for k in range(1500))
    s = scan_json(put(good, "good.json"), spark=spark)
    assert s.num_rows == 1500 and rows(s)[7] == (7, '{"k":[7,1.5]}', "x}7")
    for bad in ('{"a": 2} garbage', '{"a": 2} {"a": 3}', '{"a": 2},{"a": 3}', '{"a":', '{"a": 2}]} x', '{"a": 2}]', '{"a": 2}}', "x"):
        path = put(good + bad + "\n" + good, "bad.json")
        s = scan_json(path, spark=spark)
        for use in (lambda: s.num_rows, lambda: s.df.collect(), lambda: s.agg_column("sum", "a"), lambda: s.read_columns(["s"]).num_rows):
            with pytest.raises(Exception, match="malformed record"):
                use()
    odd = put('{"s": "1.50", "t": "x"}\n{"s": 1.50, "t": [1, 2]}\n{"s": "[1, 2]", "t": "{}"}\n{"s": 1e2, "t": true}\n{"t": 7}\n', "odd.json")
    assert [tuple(r) for r in source.read(spark, odd, sample=1).collect()] == [("1.50", "x"), ("1.5", "[1,2]"), ("[1, 2]", "{}"), ("100.0", "true"), (None, "7")]


def test_csv_values_that_the_reader_would_take(spark, put):
    body = "1,1.5,true\n2,2,FALSE\n"
    more = '"  3 ", inf ,yes\n+4,-Infinity,1\n1d,1d,no\n0x1,0x1p3,0\n9223372036854775808,1f,t\n5,1e400,True\n" 6"," nan ",x\n7\n8,.5,true,extra\n'
    got = rows(scan_csv(put("i,f,b\n" + body + more), spark=spark, sample=2))
    assert [r[0] for r in got] == [1, 2, 3, 4, None, None, None, 5, 6, 7, 8]
    assert [r[2] for r in got] == [True, False, True, True, False, False, None, True, None, None, True]
    assert [str(r[1]) for r in got] == ["1.5", "2.0", "inf", "-inf", "None", "None", "None", "inf", "nan", "None", "0.5"]
    quoted = scan_csv(put('"a ""x""", b \n"one\ntwo",1\n"three, four",x\n', "q.csv"), spark=spark, sample=1)
    assert quoted.column_names == ['a "x"', "b"] and rows(quoted) == [("one\ntwo", 1), ("three, four", None)]
