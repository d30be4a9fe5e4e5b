"""The training-data operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.llm import chat, decontaminate, html_extract, license_scan, ngram_join, packing, quality, secrets, shingles, token_counts, token_store, tokens
from caseloom.llm._common import scratch

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
AKIA = "AKIA" + "ABCD2345EFGH6789"

TEXTS = [
    None, "", " \n ", "one", "Hello, World!\nHello, World!\n\n  twice  ", "a" * 30_000, "naïve café — “quotes” 日本語 😀 x\x1cy\x85z",
    "the cat sat on the mat and the cat sat on the mat again " * 12, "<|endoftext|> in <|endoftext|>text  <|startoftext|>",
    f"password = hunter22 token: abc {AKIA} 0123456789abcdef0123456789abcdef secret=token: abcdefgh api-key='x_y=z/12'",
    "MIT License. The Apache License, GNU General Public License MIT license\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\n",
    "x y z\n" * 200, " ".join(f"w{k}" for k in range(3000)), "one",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}", "en", "other", k) for k, t in enumerate(TEXTS)] + [(3, "one", None, None, "x", 1), (None, "no id here", "s", "de", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, words string, n_chars long").repartition(3)


def empty(docs):
    return docs.where("false")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- tokens ---------------------------------------------------------------------


def library(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(string.ascii_letters + " \n\t'.,!0123éßıſ²ªŉ–“日😀́\x85\x1c "), max_size=60))
def test_ids_are_the_library_s(path, text):
    coder = tokens.ids(path)
    assert coder.bytes_of(text) == coder.whole(text)
    if path == BYTE:
        assert token_counts.counter(path).count(text) == len(coder.whole(text)) // 4


def test_token_store(docs, spark):
    path = scratch(spark, "store")
    token_store.write_store(docs, path, BYTE, end_id=0)
    got = sorted(rows_of(token_store.read_store(spark, path)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda k: (k is not None, k))
    wanted = collections.Counter((r.doc_id, tuple([*library(BYTE, r.text), 0])) for r in docs.collect())
    assert wanted == collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    (one,) = rows_of(token_store.read_store(spark, path, only=5))
    assert one == next(r for r in got if r["doc_id"] == 5)
    token_store.write_store(empty(docs), path + "-none", BYTE)
    assert token_store.read_store(spark, path + "-none").count() == 0


def test_token_counts(docs):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows_of(token_counts.count_tokens(docs, BYTE)))
    wanted = collections.Counter()
    for r in docs.collect():
        n = len(library(BYTE, r.text))
        wanted[r.doc_id, len((r.text or "").encode()), n, n > 512] += 1
    assert got == wanted


def test_packing(docs):
    limits = packing.Limits(tokens=256, segments=16, loss=200)
    got = rows_of(packing.pack(docs, WORD, end_id=1, limits=limits))
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
        assert sum(r["length"] for r in own) <= 256 and len(own) <= 16 and sum(r["loss_tokens"] for r in own) <= 200
    covered = collections.Counter((r["doc_id"], i) for r in got for i in range(r["start"], r["start"] + r["length"]))
    wanted, crcs = collections.Counter(), collections.defaultdict(set)
    for r in docs.collect():
        ids = np.array([*library(WORD, r.text), 1], "<u4")
        wanted.update((r.doc_id, i) for i in range(len(ids)))
        crcs[r.doc_id].add(ids.tobytes())
    assert covered == wanted
    for r in got:
        assert any(zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for b in crcs[r["doc_id"]])
    assert packing.pack(empty(docs), WORD).count() == 0


def test_packing_of_prompts(spark):
    rows = [(k, "answer " * (k % 50 + 1), "ask " * (k % 9) if k % 7 else None) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prompt string").repartition(2)
    limits = packing.Limits(tokens=64, segments=4, loss=40)
    got = rows_of(packing.pack(docs, WORD, limits=limits, prompt_col="prompt"))
    loss, length = collections.Counter(), collections.Counter()
    for r in got:
        loss[r["doc_id"]] += r["loss_tokens"]
        length[r["sequence_id"]] += r["length"]
    assert loss == {k: len(library(WORD, text)) + 1 for k, text, _ in rows}
    assert all(n == 64 or n & (n - 1) == 0 for n in length.values())


@pytest.mark.parametrize("sizes", [[1, 5, 90, 700, 5000], [1, 2, 3], [9000], [33, 40_000]])
@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(2048, 4, 1000)])
def test_packing_pads_nothing(sizes, limits):
    rnd = random.Random(5)
    given = [(k, np.arange(rnd.choice(sizes), dtype="<u4").tobytes(), packing.CONTEXT) for k in range(800)]
    used, loss, segments, ids = collections.Counter(), collections.Counter(), collections.Counter(), 0
    for r in packing.pack_partition(iter(given), limits, 0):
        used[r[5]] += r[2]
        loss[r[5]] += r[7]
        segments[r[5]] += 1
        ids += r[2]
    assert all(n == 2048 or n & (n - 1) == 0 for n in used.values()) and max(used.values()) <= 2048
    assert max(loss.values()) <= limits.loss and max(segments.values()) <= limits.segments
    assert ids == sum(len(data) // 4 for _, data, _ in given)


def test_packing_takes_the_largest_dot_product():
    """The pool's choice among all waiting pieces is the brute-force one; each limit changes it."""
    rnd = random.Random(6)
    limits = packing.Limits(2048, 8, 1500)
    for _ in range(200):
        pool, waiting = packing.Pool(limits), []
        for k in range(rnd.randint(1, 60)):
            n = rnd.randint(1, 1500)
            start = rnd.choice([0, 0, 10, 500])
            piece = packing.Piece(k, memoryview(bytes(4 * (start + n))), rnd.choice([32, 400]), start, start + n)
            pool.add(piece)
            waiting.append(piece)
        tokens, segments, loss = rnd.randint(1, 2048), rnd.randint(1, 8), rnd.randint(0, 1500)
        dot = lambda p: p.length / 2048 * tokens / 2048 + 1 / 8 * segments / 8 + (p.length - p.free) / 1500 * loss / 1500
        fit = [p for p in waiting if p.length <= tokens and p.length - p.free <= loss]
        got = pool.best(tokens, segments, loss)
        assert (got is None) == (not fit)
        if fit:
            assert dot(got) == pytest.approx(max(map(dot, fit)))


def test_packing_of_a_long_document_is_linear():
    import time

    def seconds(n):
        began = time.process_time()
        assert sum(r[2] for r in packing.pack_partition(iter([(1, bytes(4 * n), 32)]), packing.Limits(), 0)) == n
        return time.process_time() - began

    assert seconds(4_000_000) < 10 * max(seconds(1_000_000), 0.05)


# --- licences, secrets, quality ---------------------------------------------------


def test_license_scan(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in rows_of(license_scan.scan_licenses(docs)):
        texts = [t.text for t in docs.where(F.col("doc_id").eqNullSafe(F.lit(r["doc_id"]))).collect()]
        words = word.findall((texts[0] or "").translate(LOWER))
        hits = [
            (k, label)
            for phrase, label in license_scan.BASE_PHRASES.items()
            for k in range(len(words))
            if words[k : k + len(phrase.split())] == phrase.split()
        ]
        assert (r["n_words"], r["n_base"]) == (len(words), len(hits))
        assert r["base_labels"] == ",".join(sorted({x for _, x in hits}))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def brute_expression(words):
    """Labels and weight by recursive descent; None if the words are no expression."""
    known = {"mit": ("mit", 1.0), "apache-2.0": ("apache", 1.0), "gpl-2.0-only": ("gpl", 0.4), "epl-2.0": ("epl", 0.6), "x-y": ("other", 0.2)}

    def level(at, k):
        if k == 3:
            if at < len(words) and words[at] == "(":
                got, at = level(at + 1, 0)
                if words[at : at + 1] != [")"]:
                    raise ValueError
                return got, at + 1
            if at >= len(words) or words[at] in ("and", "or", "with", ")"):
                raise ValueError
            label, weight = known[words[at].lower()]
            return ({label}, weight), at + 1
        (labels, weight), at = level(at, k + 1)
        while at < len(words) and words[at] == ("or", "and", "with")[k]:
            (more, other), at = level(at + 1, k + 1)
            labels, weight = (labels, min(1.0, weight + 0.2)) if k == 2 else (labels | more, (max, min)[k](weight, other))
        return (labels, weight), at

    try:
        got, at = level(0, 0)
    except (ValueError, IndexError):
        return None
    return got if at == len(words) else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "Apache-2.0", "GPL-2.0-only", "EPL-2.0", "x-y", "and", "or", "with", "(", ")"]), min_size=1, max_size=9))
def test_license_expressions_against_recursive_descent(words):
    """Adjacent ids can't come from a text: the expression ends before the second."""
    apart = all(a in ("and", "or", "with", "(") or b in ("and", "or", "with", ")") for a, b in zip(words, words[1:]))
    wanted = brute_expression(words)
    if apart and wanted is not None:
        labels, weight = license_scan.evaluate(words)
        assert labels == wanted[0] and weight == pytest.approx(wanted[1])
    elif apart:
        assert license_scan.evaluate(words)[1] == 0.5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*license_scan.MORE_PHRASES, *license_scan.BASE_PHRASES, "cc by", "MIT", "license", "x", "no\nrights", "SPDX-License-Identifier: MIT OR GPL-2.0-only\n"]), max_size=8))
def test_license_labels_against_windows(pieces):
    """Labels and score of phrases found by comparing every window of words; at a place the longest phrase of the method counts."""
    text = " ".join(pieces)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    labels, weights = set(), []
    for k in range(len(words)):
        here = {p: x for p, x in {**license_scan.MORE_PHRASES, **license_scan.BASE_PHRASES, license_scan.TAG: ""}.items() if words[k : k + len(p.split())] == p.split()}
        longest = max(map(len, here), default=0)
        for p, label in here.items():
            if label and (p in license_scan.BASE_PHRASES or len(p) == longest):
                labels.add(label)
                weights.append(license_scan.WEIGHTS[label])
    for _ in range(text.count("SPDX-License-Identifier: MIT OR GPL")):
        labels |= {"mit", "gpl"}
        weights.append(1.0)
    got = license_scan.scan_text(text)
    assert got[5] == ",".join(sorted(labels)) and got[6] == min(weights, default=0.0)


def test_license_expressions():
    parse = lambda text: license_scan.evaluate(license_scan.lexemes(text, 0))
    assert license_scan.postfix("MIT or Apache-2.0 and GPL-2.0".split()) == ["MIT", "Apache-2.0", "GPL-2.0", "and", "or"]
    assert parse("MIT OR GPL-2.0-only") == ({"mit", "gpl"}, 1.0)
    assert parse("(MIT OR Apache-2.0) AND GPL-2.0-only") == ({"mit", "apache", "gpl"}, 0.4)
    assert parse("GPL-2.0-only WITH Classpath-exception-2.0")[1] == pytest.approx(0.6)
    assert parse("MIT and (") == ({"mit"}, 0.5)
    assert parse("MIT This text goes on")[0] == {"mit"}


PATTERNS = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_scan(docs, spark):
    got = secrets.scan_secrets(docs).select("doc_id", secrets.written(F.filter("spans", lambda s: s["kind"] < 3)).alias("base"))
    wanted = collections.Counter((r.doc_id, base_spans(r.text)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.base) for r in got.collect()) == wanted
    assert secrets.scan_secrets(empty(docs)).count() == 0

    live, copied, spread, stock = ("ghp_" + x * 9 for x in ("a1B2", "c3D4", "e5F6", "EXAMPLE1"))
    rows = [(k, f"see {copied} now", f"owner{k}", "en") for k in range(5)] + [(9, f"mine {live}", "owner9", "en"), (10, f"{live} again", "owner9", "en")]
    rows += [(20 + k, f"all over {spread}", "owner20", f"l{k}") for k in range(secrets.MAX_REPOS + 1)] + [(40, f"as in {stock}", "owner40", None)]
    more = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    spans = {r.doc_id: len(r.spans) for r in secrets.scan_secrets(more).collect()}
    assert {k for k, n in spans.items() if n} == {9, 10} and len(spans) == len(rows)
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(more).collect()}
    assert masked[9] == "mine [SECRET]" and masked[10] == "[SECRET] again" and masked[0] == rows[0][1]
    clean = {(r.doc_id, r.source): r for r in secrets.redact_secrets(docs).collect()}
    assert secrets.redact_secrets(docs).columns == docs.columns and len(clean) == docs.select("doc_id", "source").distinct().count()
    assert AKIA not in clean[9, "s0"].text and "hunter22" not in clean[9, "s0"].text and clean[9, "s0"].n_chars == len(clean[9, "s0"].text)


def test_secret_places_of_many_candidates(spark):
    """Running sums by blocks give every place, and their cost grows little faster than the text."""
    import time

    def seconds(n):
        text = " ".join(f"{'é' * (k % 3)}AKIA{'A' * 16}{k}" for k in range(n))
        began = time.perf_counter()
        (row,) = secrets.scan_secrets(spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")).collect()
        took = time.perf_counter() - began
        assert [(x.start, x.end) for x in row.spans] == [m.span() for m in PATTERNS[1][1].finditer(text)]
        return took

    for n in (0, 1, 2, 3, 10, 17):
        seconds(n)
    assert seconds(40_000) < 10


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(docs, spark):
    labels = spark.createDataFrame([(12, 1, 0), (11, 0, 0), (None, 1, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = rows_of(quality.quality_rules(docs, labels))
    wanted = collections.Counter((r.doc_id, *brute_quality(r.text)) for r in docs.collect())
    assert collections.Counter((r["doc_id"], *(r[c] for c in columns)) for r in got) == wanted
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert next(r for r in got if r["doc_id"] == 12)["kept"]
    assert {r["score"] for r in rows_of(quality.quality_rules(docs, labels.where("false")))} == {0.0}
    assert quality.quality_filter(docs, labels).columns == docs.columns
    assert quality.quality_rules(empty(docs), labels).count() == 0


def brute_scores(rows, trusted):
    """Score of each text by the same formula, hashed by another library; and the least of the trusted ones."""
    import math

    import xxhash

    own = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    parity = lambda key: signed(own(key.to_bytes(8, "little", signed=True))) % 2
    size = quality.BUCKETS

    def buckets(text):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return [signed(own(w)) % size for w in words] + [signed(own(b, own(a))) % size for a, b in zip(words, words[1:])]

    found = {key: buckets(text) for key, text in rows}
    n, t = collections.Counter(), (collections.Counter(), collections.Counter())
    for key, bs in found.items():
        n.update(bs)
        if key in trusted:
            t[parity(key)].update(bs)
    raw = sum(n.values()) + size

    def weight(side, b):
        total = sum(t[side].values())
        share = (n[b] + 1) / raw
        return round((1 << 20) * math.log((t[side][b] + size * share) / (total + size) / share)) if total else 0

    score = {key: sum(weight(1 - parity(key), b) for b in bs) / (max(len(bs), 1) * (1 << 20)) for key, bs in found.items()}
    return score, min((score[k] for k, text in rows if k in trusted and not brute_quality(text)[-1]), default=quality.THRESHOLD)


def test_quality_tells_junk(spark):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = [(k, " ".join(rnd.choices(vocabulary, k=120))) for k in range(60)]
    rows += [(k, " ".join(w + rnd.choice("#$%") * 3 for w in rnd.choices(vocabulary, k=120))) for k in range(60, 80)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(60))
    score, least = brute_scores(rows, set(range(0, 60, 2)))
    for r in got:
        assert r.score == pytest.approx(score[r.doc_id], abs=1e-12)
        assert r.kept == (not r.base_failed and score[r.doc_id] >= least - 1e-12)


def test_quality_is_fitted_on_all_trusted_documents(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=3)) for _ in range(80)]
    rows = [(k, " ".join(rnd.choices(vocabulary, k=3))) for k in range(20_300)]
    rows += [(k, " ".join(rnd.choices(vocabulary, k=60))) for k in range(20_300, 20_360)]
    trusted = {k for k, _ in rows if k % 20 or k < 20_300}
    labels = spark.createDataFrame([(k, 1, 0) for k in trusted], "doc_id long, quality int, toxic int")
    score, least = brute_scores(rows, trusted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (before, "-1"):  # trusted ids that fit into memory, and such as do not
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = quality.quality_rules(docs, labels).collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert len(got) == len(rows)
        for r in got:
            assert r.score == pytest.approx(score[r.doc_id], abs=1e-12)
            assert r.kept == (not r.base_failed and score[r.doc_id] >= least - 1e-12)


# --- benchmark passages -----------------------------------------------------------


def edits(a, b):
    """Fewest edits of ``a`` to a part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choices("abcdeé", k=rnd.randint(2, 7))) for _ in range(n))
    items = [(k, text(20)) for k in range(12)] + [(12, "tiny"), (13, None), (14, ""), (15, "same length item x"), (15, "same length item x")]
    docs, truth = [(0, None), (1, ""), (2, "tin")], set()
    for k in range(3, 60):
        body = text(60)
        if k % 3 == 0:
            item = rnd.choice(items[:12])
            part = list(item[1])
            for _ in range(rnd.randint(0, decontaminate.budget(len(part)))):
                part[rnd.randrange(len(part))] = rnd.choice(["", "q", "zz"[:1], " "])
            at = rnd.randint(0, len(body))
            body = body[:at] + "".join(c.upper() if c.isascii() else c for c in part) + body[at:]
        docs.append((k, body))
    docs.append((3, docs[3][1]))
    for k, body in docs:
        for i, item in items:
            low = lambda s: s.translate(LOWER)
            if item and body and edits(low(item), low(body)) <= decontaminate.budget(len(item)):
                truth.add((k, i))
    given_docs = spark.createDataFrame([(k, t, "extra") for k, t in docs], "doc_id long, text string, start string").repartition(3)
    given_items = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(decontaminate.find_leaks(given_docs, given_items))
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth and truth
    assert all(0 <= r["start"] < r["end"] and r["edits"] >= 0 for r in got)
    kept = decontaminate.drop_leaking(given_docs, given_items)
    assert kept.columns == given_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in docs if k not in {d for d, _ in truth})
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)  # several blocks, one after the other
    assert sorted(map(repr, rows_of(decontaminate.find_leaks(given_docs, given_items)))) == sorted(map(repr, got))
    assert sorted(r.doc_id for r in decontaminate.drop_leaking(given_docs, given_items).collect()) == sorted(r.doc_id for r in kept.collect())
    named = given_items.select(F.when(F.col("item_id") < 6, F.concat(F.lit("n"), "item_id")).alias("item_id"), "text")  # some ids are null
    assert {r["doc_id"] for r in rows_of(decontaminate.find_leaks(given_docs, named))} == {d for d, _ in truth}
    assert decontaminate.find_leaks(given_docs, given_items.where("false")).count() == 0
    assert decontaminate.find_leaks(given_docs.where("false"), given_items).count() == 0


def test_alignment():
    rnd = random.Random(3)
    points = lambda s: np.array([ord(c) for c in s], "<u4")
    for _ in range(60):
        item, text = ("".join(rnd.choices("ab", k=rnd.randint(1, n))) for n in (12, 30))
        got = decontaminate.align(points(item), points(text), -len(item), len(text), len(item))
        assert got[2] == edits(item, text) and edits(item, text[got[0] : got[1]]) == got[2]


# --- near duplicates ---------------------------------------------------------------


def brute_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    own = [brute_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and 100 * both >= 80 * (len(own[i]) + len(own[j]) - both):
                up[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for k, (key, _) in enumerate(rows):
        groups[top(k)].append(key)
    least = lambda keys: min((k for k in keys if k is not None), default=None)
    return collections.Counter((key, len(own[k]), least(groups[top(k)])) for k, (key, _) in enumerate(rows))


def family(rnd, size, words, most):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(rnd.randint(0, most)):
            own[rnd.randrange(len(own))] = f"v{rnd.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("rare, frequent, part, bits", [(16, 500_000, 512, 1 << 26), (2, 500_000, 4, 64), (2, 10, 512, 1 << 26)])
def test_ngram_join(spark, monkeypatch, rare, frequent, part, bits):
    """Also with few frequent tokens, large keys dealt to parts, and a filter too small to hold anything back."""
    monkeypatch.setattr(ngram_join, "RARE_MAX", rare)
    monkeypatch.setattr(ngram_join, "MAX_FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "KEY_PART", part)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)
    rnd = random.Random(rare)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = list(TEXTS[:8]) + list(family(rnd, 40, 100, 5)) + list(family(rnd, 6, 30, 2)) + list(family(rnd, 5, 7, 1))
    texts += [" ".join(family(rnd, 1, 40, 0)) + " " + passage for _ in range(25)]  # much shared text, no near copies
    texts += [" ".join(family(rnd, 1, 8, 0)) + " " + passage for _ in range(25)]
    rows = list(enumerate(texts)) + [(3, "one"), (None, "lonely words without id here"), (None, texts[10])]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, id_0 string").repartition(4)
    got = ngram_join.similarity_components(docs)
    assert collections.Counter(map(tuple, got.collect())) == brute_components(rows)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    wanted = {k for k, _, c in brute_components(rows) if k == c}
    assert {r.doc_id for r in kept.collect()} - {None} == wanted - {None}


def test_one_of_each_with_repeated_and_null_ids(spark):
    rnd = random.Random(7)
    three, own, near = (" ".join(family(rnd, 1, 60, 0)) for _ in range(3))
    rows = [(3, three), (5, own), (5, three), (None, near), (None, near + " more"), (None, near), (7, "blank"), (7, "blank"), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(tuple, ngram_join.one_of_each(docs).collect()), key=repr)
    named = [r for r in kept if r[0] is not None]
    assert named == [(3, three), (5, own), (7, "blank")]
    assert len(kept) == 6 and sum(t in (near, near + " more") for _, t in kept) == 1


def test_ngram_join_of_large_and_null_ids(spark):
    texts = list(family(random.Random(11), 4, 100, 2))
    rows = list(zip((2**60 + 1, 2**60 + 3, None, 2**60 + 5), texts))
    assert len({c for _, _, c in brute_components(rows)}) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert collections.Counter(map(tuple, ngram_join.similarity_components(docs).collect())) == brute_components(rows)


def test_ngram_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similarity_components(docs).count() == 0


def test_index_keys_meet():
    """Any two sets that link share a key, whatever the classes are."""
    rnd = np.random.default_rng(4)
    for trial in range(300):
        n = int(rnd.integers(2, 90))
        a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        drop = rnd.integers(0, len(a) // 9 + 1)
        b = np.unique(np.concatenate([rnd.choice(a, len(a) - drop, replace=False), rnd.integers(0, 2**63, drop, dtype=np.uint64)]))
        if not ngram_join.links_exactly(a, b) or len(a) == len(b) == len(np.intersect1d(a, b)):
            continue
        share = rnd.random()
        often = lambda s: (shingles.mix(s) % np.uint64(1000)) < np.uint64(int(share * 1000))
        rare = set(ngram_join._rare_keys(a, often(a)).tolist()) & set(ngram_join._rare_keys(b, often(b)).tolist())
        keys = [{}, {}]
        for side, s in zip(keys, (a, b)):
            for got, small, large in ngram_join.frequent_keys(s, often(s)):
                for k in got.tolist():
                    side[k] = (small, large)
        pairs = [k for k in keys[0].keys() & keys[1].keys() if keys[0][k][0] or keys[1][k][0]]
        assert rare or pairs, (trial, len(a), len(b))


# --- pages and chats ----------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header class="site"><a href="/">Home</a></header>
<nav><ul><li>One</li><li>Two</li></ul></nav><div class="ad">Buy many more things today</div>%s<p>First   &amp; <b>bold</b> one.</p><div class="ad">Buy</div>
<ul><li>item a</li><li>item b</li></ul><p>Go.<script>var p="</p>";</script></p>%s<form><input>Sign up</form>
<div id="comments"><p>A reader says a lot of words here</p></div><footer>&copy; all</footer></body></html>"""


def test_html(spark):
    marked = PAGE % ("<article><h1>Head</h1>", "</article>")
    rows = [(1, "u", marked), (2, None, PAGE % ("<h1>Head</h1>", "")), (3, "u", None), (4, "u", ""), (5, "u", "plain &lt;words&gt;"), (5, "u", "plain &lt;words&gt;")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], r["text"]) for r in rows_of(html_extract.extract(pages))]
    body = "Head\nFirst & bold one.\nitem a\nitem b\nGo."
    assert sorted(got, key=repr) == sorted([(1, "u", body), (2, None, body), (3, "u", ""), (4, "u", ""), *[(5, "u", "plain <words>")] * 2], key=repr)
    assert html_extract.extract(pages.where("false")).count() == 0


ARTICLE = "<h1>Head</h1><p>" + "word " * 40 + "</p>"
SIDE = '<nav>One Two</nav>%s<div id="comments"><article class="comment"><p>A reader says so</p></article></div><footer>end</footer>'


@pytest.mark.parametrize(
    "around",
    [
        "<div class='site right-sidebar'>%s</div>", "<div class='header-fixed page'>%s</div>", "<div class='content-side'>%s</div>",
        "<div class='elementor-widget-container'>%s</div>", "<form>%s</form>", "<div>%s</div><aside><article>Teaser card</article></aside>",
    ],
)
@pytest.mark.parametrize("article", ["<article>%s</article>", "<div>%s</div>"])
def test_html_layouts(around, article):
    body = (article % ARTICLE).join(around.split("%s"))
    weights = html_extract.fit(["<body><nav>One</nav><article>%s</article></body>" % ARTICLE])
    for page in ("<body>" + SIDE % body + "</body>", "<body>" + (SIDE % (article % ARTICLE)).join(around.split("%s")) + "</body>"):
        assert html_extract.main_text(page, weights) == "Head\n" + ("word " * 40).strip()


LABELLED = ["<body><nav>One</nav><ul class='x7'><li>buy this</li></ul><article>%s<div class='promo2'>x</div></article><hr><div class='x8'><p>%s</p></div></body>" % (ARTICLE, "more " * 30)] * 40


def test_html_weights_decide():
    """A class that no list names is boilerplate because the labelled pages say so; without weights it is text."""
    weights = html_extract.fit(LABELLED)
    page = "<body><div class='x8'><p>an old one</p></div><div><p>a text of its own</p></div></body>"
    assert html_extract.main_text(page, weights) == "a text of its own"
    assert html_extract.main_text(page, html_extract.Weights()) == "an old one\na text of its own"
    listed = "<body><nav>One two three</nav><p>a text</p></body>"
    assert html_extract.main_text(listed, weights) == "a text" != html_extract.main_text(listed, html_extract.Weights())


def test_html_scan_decides():
    """Blocks that score above zero are left out where the tags between cost more than they bring."""
    weights = html_extract.Weights({}, {"hr": -1.0})
    page = "<p>%s</p>" + "<hr>" * 8 + "<p>far tail</p>"
    assert html_extract.main_text(page % ("word " * 9), weights) == ("word " * 9).strip()
    assert html_extract.main_text(page % ("word " * 9), html_extract.Weights()).endswith("far tail")


def brute_text(page, weights):
    """All regions compared, each word's weight from the whole way up."""
    own = html_extract.events(page)
    has_mark = any(e.place.marked for e in own)

    def of_word(e):
        found = [weights.words.get(html_extract.OUTSIDE if has_mark and not e.place.marked else html_extract.INSIDE if e.place.marked else "", 0.0)]
        p = e.place
        while p is not None:
            found += [weights.words.get(f, 0.0) for f in p.features]
            p = p.parent
        return min([0.0, *found]) if min(found) < html_extract.BAD else min(1.0, html_extract.NEUTRAL + max([0.0, *found]))

    bad = lambda e, w: -0.01 if e.place.marked else max(w, html_extract.LEAST) * len(e.text.split())
    score = [weights.tag(e) if e.text is None else of_word(e) * len(e.text.split()) if of_word(e) >= 0 else bad(e, of_word(e)) for e in own]
    regions = [(0, 0)] + [(i, j) for i in range(len(own)) for j in range(i + 1, len(own) + 1)]
    most = max(sum(score[i:j]) for i, j in regions)
    return {"\n".join(e.text for e in own[i:j] if e.text is not None and of_word(e) > 0) for i, j in regions if sum(score[i:j]) > most - 1e-9}


def test_html_against_brute_force():
    weights, rnd = html_extract.fit(LABELLED), random.Random(8)
    names = ["p", "div", "ul", "li", "nav", "article", "span class=ad", "b", "hr", "div class='x8'", "section id=x9", "form", "div hidden"]

    def tree(depth):
        out = []
        for _ in range(rnd.randint(1, 3)):
            name = rnd.choice(names)
            inner = tree(depth - 1) if depth and rnd.random() < 0.7 else " ".join(rnd.choices(["a", "b &amp; c", "d"], k=rnd.randint(0, 6)))
            out.append(f"<{name}>{inner}" + rnd.choice(["", "", f"</{name.split()[0]}>"]) + rnd.choice(["", " tail "]))
        return "".join(out)

    for _ in range(300):
        page = tree(3)
        assert html_extract.main_text(page, weights) in brute_text(page, weights)


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<p title=it's>alpha beta</p><p>don't stop</p>", "alpha beta\ndon't stop"),
        ("<p title = 'a > b' alt=\"c > d\">x y</p>", "x y"),
        ("<p>one <img src=x> two <video><source src=y></video> three</p>", "one two three"),
        ("<p a=\"open>never closed</p> tail", "never closed\ntail"),
        ("<p>a < b and c > d &lt;e&gt; &nope;</p>", "a < b and c > d <e> &nope;"),
    ],
)
def test_html_syntax(page, wanted):
    assert html_extract.main_text(page, html_extract.Weights()) == wanted


def test_html_depth_is_linear():
    import time

    def seconds(n):
        began = time.process_time()
        assert html_extract.main_text("<div class='ad'><b><i>" * n + "<p>deep", html_extract.Weights()) == "deep"
        return time.process_time() - began

    assert seconds(40_000) < 10 * max(seconds(10_000), 0.05)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=12))
def test_best_region(scores):
    a, b = html_extract.best_region(scores)
    best = max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert sum(scores[a:b]) == best


NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "\\", "\\<|im_end|>", "<", "<\\|im_start|>", "a\nb", "", None, "[INST]<<SYS>>\\N", "é😀"]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "sys\ntem\\N", "<|im_start|>", None]
    rows = [(c, t, roles[(c + t) % len(roles)], NASTY[(c * 7 + t) % len(NASTY)]) for c in range(8) for t in range(c)]
    rows += [(20, 5, "user", "late"), (20, 2, "assistant", "early"), (20, 2, "assistant", "early"), (None, 0, "assistant", "no id")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, score int").repartition(3)
    out = chat.format_trees(chat.nodes_of_turns(turns), per_tree=None).withColumn("parts", chat.segments(F.col("formatted")))
    got = out.select("tree_id", F.transform("parts", chat.parse).alias("turns"), chat.loss_texts(F.col("parts"), F.col("loss_spans")).alias("loss")).collect()
    wanted = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(c, []).append((role or "", text or ""))
    assert {r.tree_id: [tuple(t) for t in r.turns] for r in got} == wanted
    assert {r.tree_id: r.loss for r in got} == {c: [x for role, x in own if role == "assistant"] for c, own in wanted.items()}
    assert chat.format_trees(chat.nodes_of_turns(turns.where("false"))).count() == 0


def test_reply_trees(spark):
    # a - b - c, a - d (better), e - f - e (a cycle), g alone, h under a missing parent
    rows = [("a", None, 1.0), ("b", "a", 0.0), ("c", "b", 5.0), ("d", "a", 9.0), ("e", "f", 1.0), ("f", "e", 1.0), ("g", None, None), ("h", "zz", 2.0)]
    nodes = spark.createDataFrame([("t", n, p, "user", n, s) for n, p, s in rows], "tree_id string, node_id string, parent_id string, role string, text string, score double")
    paths = lambda k: {(r.leaf_id, r["rank"]): "".join(t.text for t in r.turns) for r in chat.format_trees(nodes, per_tree=k).select(
        "leaf_id", "rank", F.transform(chat.segments(F.col("formatted")), chat.parse).alias("turns")).collect()}
    assert paths(1) == {("d", 1): "ad", ("g", 1): "g", ("h", 1): "h"}
    assert paths(None) == {("d", 1): "ad", ("c", 2): "abc", ("g", 1): "g", ("h", 1): "h"}
    chain = spark.createDataFrame([("t", k, k - 1 if k else None, "user", str(k), 0.0) for k in range(300)], "tree_id string, node_id long, parent_id long, role string, text string, score double")
    (one,) = chat.format_trees(chain).collect()
    assert one.n_turns == 300


# --- the pipeline -------------------------------------------------------------------


def test_pipeline_on_a_fixture(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    text = lambda: " ".join(rnd.choices(vocabulary, k=150))
    item = " ".join(rnd.choices(vocabulary, k=30))
    rows = [(k, text()) for k in range(30)]
    rows += [(30, rows[0][1]), (31, rows[1][1] + " more"), (32, text() + " " + item), (33, "too short"), (34, text() + f" {AKIA}")]
    frame = spark.createDataFrame([(k, t, "en", f"s{k % 4}", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {*range(30), 34}
    ids = library(WORD, rows[-1][1].replace(AKIA, secrets.MASK))
    assert {r.doc_tokens for r in out if r.doc_id == 34} == {len(ids) + 1}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns


def test_pipeline_keeps_trusted_documents_however_many(spark, tmp_path):
    import corpus_pipeline
    import xxhash

    rnd = random.Random(5)
    words = lambda n: " ".join(rnd.choices(["".join(p) for p in zip("abcdefgh", "hgfedcba")], k=n))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ids = sorted(range(20_300), key=lambda k: signed(xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)))
    odd = " ".join(f"#{k}" for k in range(60))
    rows = [(k, words(60)) for k in ids[:20]] + [(k, words(5)) for k in ids[20:-1]] + [(ids[-1], odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(k, 1, 0) for k in ids], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    judged = quality.quality_rules(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).where("not base_failed").collect()
    assert ids[-1] in kept and kept == {r.doc_id for r in judged}


def test_pipeline_counts_owners_over_all_documents(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    text = lambda: " ".join(rnd.choices(vocabulary, k=80))
    shared, item, own = (f"AKIA{c * 16}" for c in "QRS")
    copied, leak = f"{text()} {shared}", text()
    rows = [(k, copied, f"s{k}") for k in range(secrets.MAX_OWNERS + 1)]  # one of them is kept
    rows += [(10 + k, f"{item} {k}", f"s{k}") for k in range(secrets.MAX_OWNERS)] + [(20, f"{text()} {item}", "s9")]  # the short ones go
    rows += [(30, f"{text()} {own}", "s0"), (31, text(), "s1"), (32, f"{text()} {leak} {own}", "s2")]
    frame = spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    text_of = {k: t for k, t, _ in rows}
    wanted = {k: text_of[k] for k in (0, 20, 31)} | {30: text_of[30].replace(own, secrets.MASK)}
    assert {r.doc_id: r.text for r in docs.collect()} == wanted
    # Documents that the corpus lacks count as well.
    lone = frame.where("doc_id = 30")
    assert [r.text for r in secrets.redact_secrets(lone, corpus=frame.where("doc_id = 31")).collect()] == [wanted[30]]
