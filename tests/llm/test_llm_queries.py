"""The registered queries over whole small tables, against SQL or brute force."""

import collections
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from llm.test_operators import BYTE, WORD, base_spans, brute_components, brute_quality, brute_scores, library

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def run(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SF_DIR).collect()]


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    got = entry.queries()[name](spark, SF_DIR)
    c = duckdb.connect()
    for table in ("conversations", "documents", "embeddings"):
        c.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    wanted = c.execute(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(wanted)


def test_op2(spark, documents):
    at = 0
    rows = {r["doc_id"]: r for r in run(spark, "op2_token_store")}
    for key in sorted(documents):
        ids = np.array([*library(BYTE, documents[key]), 0], "<u4")
        assert rows[key] == {"doc_id": key, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        at += len(ids)


def test_op4(spark, documents):
    for r in run(spark, "op4_secret_scan"):
        spans = base_spans(documents[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(filter(None, r["spans"].split(",")))
        assert r["n_assign"] == spans.count("assign:") and r["n_access"] == spans.count("access:") and r["n_hex"] == spans.count("hex:")


def test_op5(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    whole = {(k, i) for k, t in documents.items() for i, item in items if item in (t or "")}
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op5_decontaminate")} == whole


def test_op6(spark, documents):
    got = run(spark, "op6_ngram_join")
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(list(documents.items()))


def test_op7(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    score, least = brute_scores(list(documents.items()), {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()})
    for r in run(spark, "op7_quality_rules"):
        wanted = brute_quality(documents[r["doc_id"]])
        assert r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and score[r["doc_id"]] >= least - 1e-9)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == wanted


@pytest.mark.parametrize("size, most", [("sf0.001", 2), ("sf0.01", 2), ("sf0.1", 0)])
def test_op7_keeps_good_and_drops_junk(spark, size, most):
    sf_dir = os.path.join(os.path.dirname(SF_DIR), size)
    judged = entry.queries()["op7_quality_rules"](spark, sf_dir).where("not base_failed")
    judged = judged.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("quality", "toxic", "kept").collect()
    junk = [r.kept for r in judged if r.quality == 0]
    assert junk and sum(junk) <= most, (sum(junk), len(junk))
    assert all(r.kept for r in judged if r.quality == 1 and r.toxic == 0)


def test_op8_and_op10(spark, documents):
    sizes = collections.Counter()
    for r in run(spark, "op8_packing"):
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {k: len(library(WORD, t)) + 1 for k, t in documents.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in run(spark, "op10_token_counts")} == {k: len(library(BYTE, t)) for k, t in documents.items()}


def test_op3_and_op9(spark, documents):
    assert {r["doc_id"] for r in run(spark, "op3_license_scan")} == set(documents)
    pages = run(spark, "op9_html_extract")
    assert len({r["page_id"] for r in pages}) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in pages)
