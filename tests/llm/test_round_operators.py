"""Language identification, vector codes and structure repair against brute force."""

import collections
import hashlib
import heapq
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import language, repair, vector_codes
from caseloom.llm.queries import damaged, op11_language_id

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- structure repair -------------------------------------------------------------

#: What may be put out on the way to pairs of turns.
BEGUN = re.compile("(s?(ua)*u?)?")


def brute_repair(rows):
    """Cheapest edits of (role, text) rows: a search over edit strings in order of cost, then letters."""
    kinds, seen = [], set()
    for role, text in rows:
        kinds.append(repair.fault(text, (role, text) in seen))
        seen.add((role, text))
    todo, closed = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, at, roles, lines = heapq.heappop(todo)
        if not BEGUN.fullmatch(roles) or (at, roles[-1:]) in closed:
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(lines), kinds
        closed.add((at, roles[-1:]))
        for new in ("user", "assistant"):
            heapq.heappush(todo, (cost + 2, audit + "I", at, roles + new[0], (*lines, f"{new}:")))
        if at == len(rows):
            continue
        role, text = rows[at]
        heapq.heappush(todo, (cost + 3, audit + "D", at + 1, roles, lines))
        if kinds[at] >= repair.CUT_OFF:
            more = int(kinds[at] == repair.CUT_OFF)
            heapq.heappush(todo, (cost + more, audit + "K", at + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                heapq.heappush(todo, (cost + 2 + more, audit + "R", at + 1, roles + new[0], (*lines, f"{new}:{text}")))


def wanted_of(rows):
    """The result for one conversation of (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    cost, audit, text, kinds = brute_repair([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": kinds.count(0), "duplicate": kinds.count(1), "truncated": kinds.count(2),
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def conversations(spark, seed, n, longest):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(pick.randrange(longest)):
            turn = None if pick.random() < 0.05 else t + 2 * (pick.random() < 0.2)
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c if c else None, turn, role, pick.choice(["One.", "Two!", "cut", " \n", "", None, "é?", f"own {t}."]), "extra", "digest"))
    schema = "conv_id long, turn long, role string, text string, uid string, digest string"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("seed, block_rows", [(1, 4096), (2, 2), (3, 3)])
def test_repair_is_the_cheapest(spark, seed, block_rows):
    rows, df = conversations(spark, seed, 40, 9)
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:4])
    got = {r.pop("conv_id"): r for r in rows_of(repair.repair(df, block_rows=block_rows))}
    assert got == {k: wanted_of(v) for k, v in by.items()}


def test_repair_of_one_long_conversation(spark):
    pick = random.Random(5)
    long = [(7, t, pick.choice(["user", "assistant"]), f"{pick.choice('abc')}{t // 3}{pick.choice(['.', ''])}") for t in range(3000)]
    df = spark.createDataFrame(long, "conv_id long, turn long, role string, text string").repartition(6)
    (cut,) = rows_of(repair.repair(df, block_rows=50))
    (whole,) = rows_of(repair.repair(df))
    assert cut == whole and cut["audit"].count("K") > 1000
    assert {k: v for k, v in cut.items() if k != "conv_id"} == wanted_of([r[1:] for r in long])


def test_repair_of_absent_and_empty(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 0, "user", "Hi."), ("b", None, None, None)], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: r for r in rows_of(repair.repair(df, spark.createDataFrame([("c",), ("c",), (None,), ("a",)], "conv_id string")))}
    nothing = hashlib.sha256(b"").hexdigest()
    assert set(got) == {"a", "b", "c", None}
    assert all((got[k]["cost"], got[k]["audit"], got[k]["repaired_sha256"]) == (0, "", nothing) for k in ("c", None))
    # The second row must go (3); an assistant is put in for 2, before or after that: D is the lesser letter.
    assert (got["a"]["audit"], got["a"]["cost"], got["a"]["duplicate"]) == ("KDI", 5, 1)
    assert (got["b"]["audit"], got["b"]["blank"]) == ("D", 1)
    assert repair.repair(df.where("false"), df.where("false").select("conv_id")).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"It is {c}. Is it? {t}!") for c in range(60) for t in range(4)] + [(None, None, None, None)]
    left, gone = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    wanted, dropped = collections.Counter(), collections.Counter()
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            dropped[(c,)] += 1
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        wanted[(c, t, "user" if k == 4 else role, text)] += 2 if k == 3 else 1
    assert collections.Counter(map(tuple, left.collect())) == wanted and collections.Counter(map(tuple, gone.collect())) == dropped


# --- vector codes -----------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = np.array([[np.floor(1024 * float(np.float32(x))) for x in r[1]] for r in kept]).astype(np.int64)
    width = v.shape[1] // parts
    cut = [v[:, k * width : (k + 1) * width] for k in range(parts)]
    books = [c[:entries].copy() for c in cut]
    near = lambda: [((c[:, None, :] - b[None]) ** 2).sum(axis=2) for c, b in zip(cut, books)]
    for _ in range(rounds):
        for c, b, d in zip(cut, books, near()):
            own = d.argmin(axis=1)
            for e in set(own.tolist()):
                b[e] = [int(s) // int((own == e).sum()) for s in c[own == e].sum(axis=0)]
    d = near()
    codes = ["".join(f"{int(x[k].argmin()):02x}" for x in d) for k in range(len(kept))]
    errors = [sum(int(x[k].min()) for x in d) for k in range(len(kept))]
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    by = collections.Counter()
    for r, e in zip(kept, errors):
        by[r[2]] += e
    return collections.Counter((r[0], c, e, by[r[2]], digest) for r, c, e in zip(kept, codes, errors))


@pytest.mark.parametrize("n, spread, chunk", [(700, 1.0, 200), (900, 0.004, 64), (40, 1.0, 4096), (500, 3000.0, 128)])
def test_codes_are_lloyd_s(spark, n, spread, chunk):
    draw = np.random.default_rng(n)
    rows = [(int(k), [float(np.float32(x)) for x in spread * draw.standard_normal(8)], int(k) % 3 if k % 7 else None, "x") for k in draw.permutation(n)]
    rows += [(r[0] + n, rows[5][1], 1, "x") for r in rows[: n // 2]]  # a third are one vector
    rows += [(-1, None, 1, "x"), (-2, [float("nan")] * 8, 1, "x"), (-3, [1.0] * 7 + [None], 1, "x"), (-4, [float("inf")] + [0.0] * 7, 1, "x"), (None, [0.5] * 8, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(4)
    got = collections.Counter(map(tuple, vector_codes.compress(df, chunk=chunk).collect()))
    assert got == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    kinds = "vec_id string, embedding array<double>, label string"
    assert vector_codes.compress(spark.createDataFrame([], kinds)).count() == 0
    rows = [("b", [1e9, 2.0, 3.0, 4.0, -1e9], "p"), ("a", [0.0] * 5, None), ("a", [0.0, 0.0, 1.0], None), ("a", [0.0] * 5, None)]
    got = rows_of(vector_codes.compress(spark.createDataFrame(rows, kinds)))
    # A vector of another length than the first one's is dropped; equal rows are entries each, and the lower one is nearest.
    assert sorted((r["vec_id"], r["error"], r["code"]) for r in got) == [("a", 0, "00" * 4), ("a", 0, "00" * 4), ("b", 0, "02020200")]


# --- language identification --------------------------------------------------------


def test_probabilities_are_those_of_all_ways():
    draw = np.random.default_rng(3)
    moves, begins = draw.standard_normal((3, 3)), draw.standard_normal(3)
    sizes = [1, 4, 2, 5, 1, 3]
    scores = draw.standard_normal((sum(sizes), 3)).astype(np.float32)
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got, at = language.probabilities(scores, first, moves, begins), 0
    for n in sizes:
        own, total = np.zeros((n, 3)), 0.0
        for way in itertools.product(range(3), repeat=n):
            p = np.exp(begins[way[0]] + sum(scores[at + t, s] for t, s in enumerate(way)) + sum(moves[a, b] for a, b in itertools.pairwise(way)))
            total += p
            for t, s in enumerate(way):
                own[t, s] += p
        assert np.allclose(got[at : at + n], own / total, atol=1e-4)
        at += n
    # Stretches are joined: a long sequence has the same probabilities as by plain steps.
    scores = draw.standard_normal((1000, 3)).astype(np.float32)
    got = language.probabilities(scores, np.arange(1000) == 0, moves, begins)
    expected, _, _ = language._expectations(scores[None].astype(float), moves, begins)
    assert np.allclose(got, expected[0], atol=1e-3)


def test_features_are_of_the_word_alone():
    one, owner = language.features(["straße"])
    many, owners = language.features(["a", "straße", "日本"])
    assert sorted(one) == sorted(many[owners == 1]) and set(owner) == {0}


ENGLISH, GERMAN = "the house is on the hill and they think this with that thing".split(), "das haus ist auf dem hügel und nicht schön über die straßen".split()


def switching(spark):
    pick = random.Random(1)
    rows = [(k, " ".join(pick.choices(ENGLISH if k % 2 else GERMAN, k=30)), "en" if k % 2 else "de") for k in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_switches_are_found(spark):
    field = language.fit(switching(spark))
    mixed = " ".join(ENGLISH[:7] + GERMAN + ENGLISH)
    odd = [(1, mixed, "x"), (2, None, "x"), (3, "", "x"), (4, "12 ² ½ !", "x"), (None, "THE HOUSE", "x"), (5, "über" * 5000, "x"), (5, "und nicht", "x"), (6, f"{mixed} " * 9000, "x")]
    got = rows_of(language.identify(spark.createDataFrame(odd, "doc_id long, text string, lang_pred string"), field, runs=True))
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert len(got) == len(odd)
    first = by[1, 32]
    assert [(x.lang, x.first, x.n) for x in first["runs"]] == [("en", 0, 7), ("de", 7, 12), ("en", 19, 13)]
    assert first["lang_pred"] == "en" and first["n_switches"] == 2 and 0.5 < first["score"] < 0.8
    assert all((by[k, 0]["lang_pred"], by[k, 0]["score"]) == ("und", 0.0) for k in (2, 3, 4))
    assert by[None, 2]["lang_pred"] == "en" and by[5, 2]["lang_pred"] == "de" and by[6, 288_000]["lang_pred"] == "en"


def test_nothing_to_learn(spark):
    none = switching(spark).where("false")
    assert {r["lang_pred"] for r in rows_of(language.identify(switching(spark), language.fit(none)))} == {"und"}
    assert rows_of(language.identify(none, language.fit(switching(spark).where("lang = 'de'")))) == []
    only = rows_of(language.identify(switching(spark), language.fit(switching(spark).where("lang = 'de'"))))
    assert {(r["lang_pred"], r["score"]) for r in only} == {("de", 1.0)}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, size):
    sf_dir = os.path.join(os.path.dirname(SF_DIR), size)
    got = op11_language_id(spark, sf_dir).withColumnRenamed("doc_id", "id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = got.join(docs, F.col("id") == F.col("doc_id")).where("held_out and lang is not null and lang_pred <> 'und'").select("lang", "lang_pred", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 20 and right >= 0.97 * len(rows), (right, len(rows))
