"""Decontamination of repetitive texts, secrets masked by their owners, and extraction that labelled pages decide."""

import os
import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from caseloom.llm import decontaminate, html_extract, secrets
from llm.test_operators import edits

SF_DIR = "/root/testdata/sf0.001"


def indented(rnd, lines, indent):
    return "\n".join(" " * indent + " ".join(rnd.choices(["if", "x", "return", "foo", "bar"], k=5)) for _ in range(lines))


@pytest.mark.parametrize("fill", [" " * 1_000_000, "\t\n " * 300_000, "ab" * 400_000, "- - =" * 150_000])
def test_repetitive_texts_cost_little(fill):
    rnd = random.Random(1)
    items = [(k, indented(rnd, 6, 60)) for k in range(200)] + [(200, "ab" * 40), (201, "-" * 70)]
    index = decontaminate.Index(items)
    tracemalloc.start()
    began = time.perf_counter()
    (got,) = decontaminate.leaks_of(index, [fill[:500_000] + items[7][1] + fill[500_000:]])
    seconds, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert (7, 500_000, 500_000 + len(items[7][1]), 0) in [g for g in got if g[0] == 7]
    assert peak < 400e6 and seconds < 30, (peak, seconds)


def test_slices_of_pairs_change_nothing(monkeypatch):
    rnd = random.Random(2)
    items = [(k, indented(rnd, 3, 12)) for k in range(30)]
    texts = [" ".join(indented(rnd, 2, 9) + rnd.choice(items)[1] for _ in range(6)) for _ in range(5)]
    index = decontaminate.Index(items)
    whole = [sorted(x) for x in decontaminate.leaks_of(index, texts)]
    monkeypatch.setattr(decontaminate, "PAIRS", 37)
    assert [sorted(x) for x in decontaminate.leaks_of(index, texts)] == whole and any(whole)


def test_indented_items_against_brute_force():
    """Whole items within the budget are found, and nothing else, where much of them is white space."""
    rnd = random.Random(3)
    items = [(k, indented(rnd, 2, rnd.choice([3, 20, 40]))) for k in range(10)] + [(10, " " * 30), (11, "#" * 20 + "x")]
    index = decontaminate.Index(items)
    for _ in range(25):
        key, item = rnd.choice(items)
        part = list(item)
        for _ in range(rnd.randint(0, 4)):
            part[rnd.randrange(len(part))] = rnd.choice(["", "q", " "])
        text = indented(rnd, 1, 15) + "".join(part) + indented(rnd, 1, 8)
        (got,) = decontaminate.leaks_of(index, [text])
        low = decontaminate.normal
        truth = {k for n, (k, x) in enumerate(index.items) if edits(x, low(text)) <= (index.edits[n] if n not in index.short else 0)}
        assert {g[0] for g in got} == truth


def test_masking_follows_the_verdict(spark):
    """A key that many owners copy stays as it stands, the same kind of key of one owner goes; both are reported."""
    shared, own = "AKIA" + "Q" * 16, "AKIA" + "Z" * 16
    rows = [(k, f"as in the guide {shared} here", f"owner{k}", "en") for k in range(5)] + [(9, f"ours is {own}, theirs {shared}", "owner9", "en"), (10, None, None, None), (11, "token = sample-12345", "o", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert masked == {**{k: rows[k][1] for k in range(5)}, 9: f"ours is {secrets.MASK}, theirs {shared}", 10: None, 11: "token = sample-12345"}
    spans = {r.doc_id: len(r.spans) for r in secrets.scan_secrets(df).collect()}
    assert spans == {**dict.fromkeys(range(5), 1), 9: 2, 10: 0, 11: 1}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_copied_candidates_of_the_tables(spark):
    """Candidates of more owners or repositories than a key may have stay in the texts; all others are masked."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    spans = docs.select("doc_id", "source", "lang", F.explode(secrets.candidates(F.col("text"))).alias("s")).select("doc_id", "source", "lang", "s.*").collect()
    owners, repos = {}, {}
    for r in spans:
        owners.setdefault(r.value, set()).add(r.source)
        repos.setdefault(r.value, set()).add((r.source, r.lang))
    copied = {v for v in owners if len(owners[v]) > secrets.MAX_OWNERS or len(repos[v]) > secrets.MAX_REPOS}
    stays = {r.doc_id for r in spans if r.value in copied or r.stock}
    goes = {r.doc_id for r in spans if r.value not in copied and not r.stock}
    assert stays and goes
    masked = secrets.redact_secrets(docs).withColumnRenamed("text", "new").select("doc_id", "new").join(docs, "doc_id").where("new <> text").select("doc_id").collect()
    assert {r.doc_id for r in masked} == goes and not (stays - goes) & {r.doc_id for r in masked}


# --- extraction: class names that no list has


def page(rnd, marked, junk_first):
    """An article between parts whose classes sound like nothing."""
    story = "".join(f"<p>{' '.join(rnd.choices(['river', 'stone', 'walk', 'light'], k=12))}</p>" for _ in range(3))
    junk = [f'<div class="qzone-{k}"><p>{" ".join(rnd.choices(["buy", "now", "offer"], k=9))}</p></div>' for k in range(2)]
    body = f"<article class='vtext'>{story}</article>" if marked else f"<div class='vtext'>{story}</div>"
    return f"<html><body>{junk[0] if junk_first else ''}{body}{''.join(junk)}</body></html>", story


def test_labelled_pages_decide_where_no_list_does():
    rnd = random.Random(4)
    fitted = html_extract.fit([page(rnd, True, k % 2)[0] for k in range(40)])
    prior = html_extract.fit([])
    right = {"fitted": 0, "prior": 0}
    for k in range(30):
        html, story = page(rnd, False, k % 2)
        wanted = story.replace("<p>", "").replace("</p>", "\n").strip()
        right["fitted"] += html_extract.main_text(html, fitted) == wanted
        right["prior"] += html_extract.main_text(html, prior) == wanted
    assert right == {"fitted": 30, "prior": 0}


def test_elements_that_end_themselves_and_line_breaks():
    weights = html_extract.fit([])
    assert html_extract.main_text("<p>before <svg class='i'/> after</p><p>more</p>", weights) == "before after\nmore"
    assert html_extract.main_text("<p>a<svg><text>no</text></svg>b</p>", weights) == "ab"
    assert html_extract.main_text("<p>one<br>two<br/>\n three</p>", weights) == "one two three"
