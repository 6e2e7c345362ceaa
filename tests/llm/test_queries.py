"""The registered queries over whole tables against brute force, and the pipeline."""

import hashlib
import zlib
from collections import Counter

import pytest

from lakescan.llm import line_dedup, mixing, simhash
from lakescan.llm.queries import QUERIES, vocabulary_path
from tests.llm.test_operators import brute_base, brute_components, brute_fingerprint, brute_quality, brute_similar, brute_substrings, brute_url, check_lines

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}


def result(spark, name):
    return QUERIES[name](spark, BASE).collect()


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    got = result(spark, "op1_bpe")
    assert len(got) == len(docs)
    for r in got:
        ids = t.encode(docs[r["doc_id"]]["text"], add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op2(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op2_substring_dedup")}
    ids = sorted(docs)
    want = dict(zip(ids, brute_substrings([(k, docs[k]["text"]) for k in ids])))
    assert sorted(got) == ids
    for k in ids:
        text, shared = want[k]
        assert (got[k]["text"], got[k]["n_shared"]) == (text, len(shared)) and got[k]["removed_bytes"] == len(docs[k]["text"].encode()) - len(text.encode())
        # What makes a document a repeat are at least 80 bytes that another document holds as well, or it itself.
        assert got[k]["has_repeat"] == bool(shared or got[k]["n_removed"]) and all(len(u) >= 80 and sum(u in d["text"].encode() for d in docs.values()) > 1 for u in list(shared)[:5])


def test_op3(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op3_line_dedup")}
    ids = sorted(docs)
    assert sorted(got) == ids
    lost = check_lines([(k, docs[k]["text"]) for k in ids], {n: (got[k]["text"], got[k]["n_dropped"]) for n, k in enumerate(ids)})
    assert len(lost) > 50


def test_op4(spark, docs):
    got = result(spark, "op4_language_id")
    assert {r["doc_id"] for r in got} == set(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)


def test_op5(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{BASE}/pages.parquet").collect()}
    got = result(spark, "op5_url_filters")
    assert len(got) == len(urls)
    for r in got:
        host, path, fit = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit and fit[0]) and (not fit or r["verdict"] == fit[1])


def test_op7(spark, docs):
    for r in result(spark, "op7_pii"):
        base = brute_base(docs[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in base.split(",")) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in result(spark, "op9_simhash")}
    ids = sorted(docs)
    fps = [brute_fingerprint(docs[k]["text"]) for k in ids]
    assert [got[k]["fingerprint"] for k in ids] == [f"{f:016x}" for f in fps]
    assert [got[k]["component_id"] for k in ids] == brute_components(fps, ids)


def test_op10(spark, docs):
    for r in result(spark, "op10_quality_rules"):
        assert tuple(r)[1:7] == brute_quality(docs[r["doc_id"]]["text"]) and not (r["base_failed"] and r["kept"])


def test_op6_rates_meet_targets(spark):
    got = result(spark, "op6_mixing")
    total = sum(r["n_tokens"] for r in got)
    for name, share in mixing.TARGETS.items():
        p = "p_" + name.replace(" ", "_")
        if sum(r[p] for r in got) > 1:
            assert sum(r["n_tokens"] * r[p] * r["rate"] for r in got) / total == pytest.approx(share, abs=0.02)


def test_pipeline_chain_equals_brute_force(spark, docs):
    """Each stage on what the stage before has kept."""
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    stages = dict(corpus_pipeline.STAGES)
    held = lambda df: (df := spark.createDataFrame(df.collect(), df.schema), sorted(map(tuple, df.select("doc_id", "text").collect())))
    kept, rows = held(stages["quality rules"](spark, spark.read.parquet(f"{BASE}/documents.parquet"), BASE))
    verdicts = {r["doc_id"]: r["kept"] for r in result(spark, "op10_quality_rules")}
    assert {d for d, _ in rows} == {d for d, v in verdicts.items() if v}
    assert all(not brute_quality(t)[-1] and docs[d]["text"] == t for d, t in rows) and len(rows) < len(docs)
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup(kept).collect()}
    lines, after = held(stages["line dedup"](spark, kept, BASE))
    assert check_lines(rows, {n: (t, dropped[d]) for n, (d, t) in enumerate(after)})
    near, rows = held(stages["simhash near-dedup"](spark, lines, BASE))
    assert rows == [x for x in after if x[0] in set(brute_similar([t for _, t in after], [d for d, _ in after]))]
    rates = {r["doc_id"]: r["rate"] for r in mixing.mix(near, mixing.labelled_domains(spark.read.parquet(f"{BASE}/labels.parquet"))).collect()}
    mixed, after = held(stages["mixing"](spark, near, BASE))
    assert all(f.columns == ["doc_id", "text", "lang", "source", "n_chars"] for f in (kept, lines, near, mixed))
    copies = Counter(after)
    assert set(copies) <= set(rows) and all(int(rates[d]) <= copies[d, t] <= int(rates[d]) + 1 for d, t in rows)
    library = Tokenizer.from_file(vocabulary_path())
    final = corpus_pipeline.run(spark, BASE).collect()
    texts = dict(rows)
    assert Counter(r["doc_id"] for r in final) == Counter(d for d, _ in after)
    for r in final:
        assert r["n_tokens"] == len(r["token_ids"]) and r["token_ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_stages_take_awkward_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c\n" * 30, "en", "s", 1), (2, "word " * 40, "en", None, 2), (2, "word " * 40, "en", None, 2), (3, "", "", "", 0), (4, " ".join(f"w{k}" for k in range(3000)), "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, BASE)
            assert name == "bpe" or out.columns == frame.columns
            assert (out.count() == 0) if frame is not df else out.count() <= 2 * len(rows)
    kept = [tuple(r)[:2] for r in simhash.keep_one(df).collect()]
    assert len(kept) == len(set(kept)) and (1, None) in kept and sum(k == 2 for k, _ in kept) <= 1
