"""Cases made of data, streamed gathers, states of files, large case tables, the store's log, resources, lifetimes and figures."""

import collections
import gc
import os
import subprocess
import sys
import textwrap
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

import caseloom as cl
from caseloom.errors import AttributeValidationError, EntityComputationError, UnsetEntityError
from caseloom.plans import resources, store as stores
from caseloom.sources import figures

VISITS = [("ann", "fr", 3), ("bob", "de", 5), ("ann", "de", 7), ("cid", "fr", 2), (None, "es", 11), ("bob", "fr", 13)]


@pytest.fixture
def visits(builder, spark):
    builder.assign("visits", cl.FrameSource(spark.createDataFrame(VISITS, "who string, land string, n long").repartition(3), version="1"))
    return builder


def guests(b):
    @b
    @cl.cases
    def guest(visits):
        return visits.select(F.col("who").alias("guest"))

    return b


# --- cases made of data


def test_cases_of_data(visits):
    b = guests(visits)
    b.assign("least", values=[3, 6])

    @b
    @cl.lifted("guest", "least")
    def stays(cases, visits):
        return cases.join(visits, F.col("who").eqNullSafe(F.col("guest")) & (F.col("n") >= F.col("least"))).select("case_id", "n")

    @b
    @cl.expr
    def greeting(guest):
        return F.concat(F.lit("hi "), guest)

    @b
    @cl.typed("long")
    def letters(greeting):
        return len(greeting or "")

    flow = b.build()
    wanted = collections.Counter((who, least, n) for who, _, n in VISITS for least in (3, 6) if n >= least)
    assert collections.Counter((r.guest, r.least, r.n) for r in flow.frame("stays").collect()) == wanted
    # A null value is a case like others.
    assert {(r.guest, r.greeting) for r in flow.frame("greeting").collect()} == {(w, w and f"hi {w}") for w, _, _ in VISITS}
    assert {(r.guest, r.letters) for r in flow.frame("letters").collect()} == {("ann", 6), ("bob", 6), ("cid", 6), (None, 0)}
    assert flow.get("guest", set) == {"ann", "bob", "cid", None}
    series = flow.get("letters", "series")
    assert {(i.get(), v) for i, v in zip(series.index.get_level_values("guest"), series)} == {("ann", 6), ("bob", 6), ("cid", 6), (None, 0)}
    with pytest.raises(ValueError):
        flow.get("guest")


def test_cases_that_vary_together_and_with_arguments(visits):
    b = visits
    b.assign("least", values=[4, 12, 100])

    @b
    @cl.cases
    @cl.outputs("person", "place")
    def _(visits, least):
        return visits.where(F.col("n") >= least).select(F.col("who").alias("person"), F.col("land").alias("place"))

    @b
    @cl.expr
    def both(person, place):
        return F.concat_ws("@", person, place)

    @b
    @cl.agg
    @cl.gather("person", "both")
    def n_both(gather_df):
        return F.count(gather_df["both"])

    flow = b.build()
    wanted = {(least, who, land) for who, land, n in VISITS for least in (4, 12) if n >= least}
    assert {(r.least, r.person, r.place) for r in flow.frame("both").collect()} == wanted
    # Its cases vary with the least number, so gathering them gathers that too.
    assert [r.n_both for r in flow.frame("n_both").collect()] == [len(wanted)]


def test_cases_are_computed_anew_for_new_data_alone(visits, spark):
    seen = []

    @visits
    @cl.cases
    def land(visits):
        seen.append(1)
        return visits.select("land")

    assert visits.build().frame("land").count() == 3 and visits.build().frame("land").count() == 3 and len(seen) == 1
    other = visits.build().setting("visits", cl.FrameSource(spark.createDataFrame([("x", "pt", 1)], "who string, land string, n long"), version="2"))
    assert other.get("land") == "pt" and len(seen) == 2
    none = visits.build().setting("visits", cl.FrameSource(spark.createDataFrame([], "who string, land string, n long"), version="3"))
    assert none.get("land", list) == []
    with pytest.raises(UnsetEntityError):
        none.get("land")


def test_rules_of_cases(visits):
    with pytest.raises(AttributeValidationError):
        visits(cl.output("g")(cl.gather("visits")(cl.cases(lambda gather_df: gather_df))))
    visits(cl.output("wrong")(cl.cases(lambda visits: visits)))
    with pytest.raises(EntityComputationError, match="wrong"):
        visits.build().get("wrong", list)


# --- streamed gathers


def streaming(b, function):
    return b(cl.output("told")(cl.typed("string")(cl.streamed(cl.gather("x", "pair")(function)))))


@pytest.mark.parametrize("unset", [None, "x", "y"])
def test_streamed_gather_is_the_gather(builder, unset):
    b = builder
    b.assign("x", values=[1, 2, 3])
    b.assign("y", values=[10, 20])
    b.assign("z", values=["p", "q"])
    if unset:
        b.clear_cases(unset)
    b(cl.output("pair")(cl.expr(lambda x, y: x * y)))
    streaming(b, lambda gather_df, z: z + str(sorted(v for part in gather_df for v in part["pair"])))
    b(cl.output("whole")(cl.typed("string")(cl.gather("x", "pair")(lambda gather_df, z: z + str(sorted(gather_df["pair"]))))))
    flow = b.build()
    read = lambda name: sorted((r.y, r.z, r[name]) for r in flow.frame(name).collect())
    assert read("told") == read("whole") and len(read("told")) == (0 if unset == "y" else 4)
    assert (unset == "x") == all(t.endswith("[]") for _, _, t in read("told") or [(0, 0, "x" if unset != "x" else "[]")])


def test_streamed_gather_is_stored(builder, tmp_path):
    b, log = builder, tmp_path / "calls"

    def total(gather_df):
        with open(log, "a") as f:
            f.write("x")
        return str(sum(len(part) for part in gather_df))

    b.assign("x", values=list(range(50)))
    b.assign("y", values=[1, 2])
    b(cl.output("pair")(cl.expr(lambda x, y: x * y)))
    streaming(b, total)
    assert b.build().get("told", list) == ["50", "50"] == b.build().get("told", list) and len(log.read_text()) == 2
    assert sorted(b.build().setting("y", values=[2, 3]).get("told", list)) == ["50", "50"] and len(log.read_text()) == 3


def test_streamed_group_is_not_held(builder, spark):
    """A group of three million rows of which a worker holds one batch at a time."""
    n = 3_000_000
    builder.assign("rows", cl.FrameSource(spark.range(n).toDF("k"), version="1"))
    builder(cl.output("k")(cl.cases(lambda rows: rows)))

    @builder
    @cl.streamed
    @cl.gather("k")
    def held(gather_df):
        import resource

        before, count, largest = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, 0
        for part in gather_df:
            count, largest = count + len(part), max(largest, len(part))
        return [count, largest, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before]

    count, largest, kb = builder.build().get("held")
    assert count == n and largest <= 10_000 and kb < 400_000, (count, largest, kb)


def test_streamed_errors(builder):
    builder.assign("x", values=[1, 2])
    builder(cl.output("pair")(cl.expr(lambda x: x)))
    streaming(builder, lambda gather_df: 1 // 0)
    with pytest.raises(EntityComputationError, match="told"):
        builder.build().get("told")
    with pytest.raises(AttributeValidationError):
        builder(cl.output("q")(cl.streamed(lambda x: x)))


# --- states of files


def counted(b, spark, path, reads, merges={"n": "sum", "least": "min", "users": "hll"}):
    b.set("lines", cl.FileSource(spark, str(path), schema="land string, who string, n long"))

    @b
    @cl.rollup(by="land", **merges)
    def by_land(lines):
        reads.append(sorted(os.path.basename(f) for f in lines.inputFiles()))
        return lines.groupBy("land").agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.hll_sketch_agg("who").alias("users"))

    rows = b.build().frame("by_land").select("land", "n", "least", F.hll_sketch_estimate("users").alias("users")).collect()
    return {r.land: (r.n, r.least, r.users) for r in rows}


def by_hand(rows):
    return {land: (sum(n for _, la, n in rows if la == land), min(n for _, la, n in rows if la == land), len({w for w, la, _ in rows if la == land and w})) for land in {r[1] for r in rows}}


def test_only_added_files_are_read(builder, spark, tmp_path):
    path, reads, all_rows = tmp_path / "lines", [], []
    builder.declare("lines")

    def add(rows):
        all_rows.extend(rows)
        before = set(os.listdir(path)) if path.exists() else set()
        spark.createDataFrame(rows, "who string, land string, n long").coalesce(1).write.mode("append").parquet(str(path))
        return sorted(f for f in set(os.listdir(path)) - before if f.startswith("part"))

    first = add(VISITS)
    assert counted(builder, spark, path, reads) == by_hand(all_rows) and reads == [first]
    assert counted(builder, spark, path, reads) == by_hand(all_rows) and len(reads) == 1
    second = add([("dot", "fr", 1), ("eve", "it", 4)])
    assert counted(builder, spark, path, reads) == by_hand(all_rows) and reads[1:] == [second]
    third = add([("fay", "it", 2)])
    assert counted(builder, spark, path, reads) == by_hand(all_rows) and reads[2:] == [third]
    # A file goes: what was read with it does not count any more, the rest stays.
    os.remove(path / second[0])
    left = [*VISITS, ("fay", "it", 2)]
    assert counted(builder, spark, path, reads) == by_hand(left) and len(reads) == 3
    # A file changes under its name: it is read again.
    os.remove(path / f".{third[0]}.crc")
    pd.DataFrame([("gus", "it", 9)], columns=["who", "land", "n"]).to_parquet(path / third[0])
    os.utime(path / third[0], (1, 1))
    assert counted(builder, spark, path, reads) == by_hand([*VISITS, ("gus", "it", 9)]) and reads[3:] == [third]


def test_many_additions_are_merged(builder, spark, tmp_path, monkeypatch):
    from caseloom.plans import states

    monkeypatch.setattr(states, "FANOUT", 3)
    builder.declare("lines")
    reads, rows, path = [], [], tmp_path / "lines"
    path.mkdir()
    for k in range(5):
        rows.append(("ann", "fr", k + 1))
        pd.DataFrame(rows[-1:], columns=["who", "land", "n"]).to_parquet(path / f"{k}.parquet")
        assert counted(builder, spark, path, reads)["fr"] == (sum(r[2] for r in rows), 1, 1)
    assert [len(r) for r in reads] == [1] * 5


def test_rollup_rules(builder, spark, tmp_path):
    with pytest.raises(AttributeValidationError):
        cl.rollup(by="x", n="avg")
    builder.assign("lines", cl.FrameSource(spark.range(3), version="1"))
    builder(cl.output("total")(cl.rollup(n="sum")(lambda lines: lines.agg(F.count("*").alias("n")))))
    with pytest.raises(EntityComputationError, match="FileSource"):
        builder.build().frame("total")


# --- large case tables and the store's log


def test_many_values_are_quick(builder, spark):
    began = time.time()
    builder.assign("x", values=list(range(20_000)))
    assert time.time() - began < 3
    builder(cl.output("y")(cl.expr(lambda x: x + 1)))
    began = time.time()
    assert builder.build().frame("y").agg(F.sum("y")).first()[0] == sum(range(1, 20_001))
    assert time.time() - began < 30


def test_large_case_table_is_parquet(builder, spark, monkeypatch):
    from caseloom.operators import source

    monkeypatch.setattr(source, "LOCAL_BYTES", 100)
    builder.assign("x", values=[f"v{k}" for k in range(100)])
    flow = builder.build()
    assert flow.get("x", set) == {f"v{k}" for k in range(100)}
    store = flow.cache._store
    assert len(stores.folders(spark, store.path(stores.CASES))) == 1
    assert builder.build().frame("x").count() == 100 and len(stores.folders(spark, store.path(stores.CASES))) == 1


def test_versions_of_cases_do_not_mix(builder):
    builder.assign("x", values=[1])
    one = builder.build()
    left, right = one.adding_case("x", 2), one.adding_case("x", 3)
    assert (one.get("x", list), sorted(left.get("x", list)), sorted(right.get("x", list))) == ([1], [1, 2], [1, 3])


def plus(b, values):
    b.assign("x", values=values)
    b(cl.output("y")(lambda x: x + 1))
    b(cl.output("z")(cl.persist(True)(lambda x: [x])))
    return b.build()


def test_a_thousand_entries_in_one_commit(builder, spark):
    flow = plus(builder, list(range(1000)))
    assert len(flow.get("y", list)) == len(flow.get("z", list)) == 1000
    flow.get.y("list", "filename")
    store, cache = flow.cache._store, flow.cache
    assert len(stores.folders(spark, store.path(f"{stores.FILES}/y"))) == 1000
    assert cache.frame().count() == 2000
    some = cache.frame().where("entity = 'y'").select("entity", F.col("provenance").alias("p")).limit(600)
    assert cache.delete(spark.createDataFrame(some.collect(), "entity string, p string")) == 600
    assert len(store.graves(0)) == 1 and cache.frame().groupBy("entity").count().orderBy("entity").collect() == [("y", 400), ("z", 1000)]
    assert len(stores.folders(spark, store.path(f"{stores.FILES}/y"))) == 400  # the copies of dead results go with them
    assert len(builder.build().get("y", list)) == 1000 and cache.frame().where("entity = 'y'").count() == 1000
    assert cache.delete(F.col("entity") == "z") == 1000 and cache.delete() == 1000 and cache.delete() == 0
    assert cache.frame().count() == 0 and sorted(builder.build().get("z", list)) == [[k] for k in range(1000)]


def test_runs_are_merged(builder, spark, monkeypatch):
    monkeypatch.setattr(stores, "FANOUT", 3)
    monkeypatch.setattr(stores.Store.merge_runs, "__defaults__", (3,))
    builder.assign("x", 0)
    builder(cl.output("y")(lambda x: x + 1))
    for k in range(7):
        assert builder.build().setting("x", k).get("y") == k + 1
        if k == 3:
            assert builder.build().cache.get_entries()[0].delete()
    store = builder.build().cache._store
    runs = store.writes("y", 0)
    assert len(runs) < 4 and any(stores._tier(w) for w in runs) and builder.build().cache.frame().count() == 6
    # A merge that was not finished does not count, and one that was counts from its mark on.
    store.merge_runs("y", 0, at_least=2)
    merged = max(store.writes("y", 0), key=stores._tier)
    stores.delete(spark, f"{store.path('y')}/{merged}/_SUCCESS")
    assert builder.build().cache.frame().count() == 6
    builder.build().cache.merge()
    stores.Store.vacuum(store, "y", 0, grace_s=-1)
    assert builder.build().cache.frame().count() == 6
    assert sorted(builder.build().setting("x", values=list(range(7))).get("y", list)) == list(range(1, 8))


def test_tiers_are_deleted_apart(builder, tmp_path):
    builder.set("core__persistent_cache__cloud__url", str(tmp_path / "second"))
    flow = plus(builder, [1, 2, 3])
    assert sorted(flow.get("y", list)) == [2, 3, 4]
    assert flow.cache.delete(tier="local") == 3
    assert {(e.tier, e.entity) for e in flow.cache.get_entries()} == {("cloud", "y")}
    assert sorted(builder.build().get("y", list)) == [2, 3, 4]  # found in the second root
    assert flow.cache.delete(tier="cloud") == 3 and flow.cache.get_entries() == []


# --- resources, lifetimes, figures


def test_no_profile_on_a_local_master(builder, spark):
    assert resources.stage_profile(spark, {"cpus": 2}) is None and resources.stage_profile(spark, {"pool": "x"}) is None
    builder.assign("x", 3)
    builder(cl.output("y")(cl.run_with(cpus=2, memory="1g")(lambda x: x * 2)))
    assert builder.build().get("y") == 6


def test_stage_has_its_profile(tmp_path):
    """On a cluster of one executor with two cores, each call of the function has both."""
    program = textwrap.dedent(f"""
        from pyspark.sql import SparkSession
        import caseloom as cl
        spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "{tmp_path}").config("spark.driver.host", "127.0.0.1").getOrCreate())
        b = cl.FlowBuilder("profiled")
        b.assign("x", values=[1, 2])
        def cpus(x):
            from pyspark import TaskContext
            return TaskContext.get().cpus()
        b(cl.output("two")(cl.run_with(cpus=2)(cpus)))
        b(cl.output("one")(lambda x: cpus(x)))
        flow = b.build()
        print("CPUS", flow.get("two", list), flow.get("one", list))
    """)
    import pyspark

    home = tmp_path / "home"  # executors work in a folder of their own below Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    (tmp_path / "program.py").write_text(program)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": str(home), "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    ran = subprocess.run([sys.executable, str(tmp_path / "program.py")], capture_output=True, text=True, timeout=300, env=env)
    said = [x for x in ran.stderr.splitlines() if not x.lstrip().startswith("at ")]
    assert "CPUS [2, 2] [1, 1]" in ran.stdout, ran.stdout[-500:] + "\n".join(said)[-3000:]


@pytest.mark.parametrize("there, given", [(0, 0), (1, 1)])
def test_stage_has_gpus_where_executors_do(tmp_path, there, given):
    """On a cluster without GPUs a function that would have one is called all the same; with one, each call has it."""
    script = tmp_path / "gpus.sh"
    script.write_text("""#!/bin/sh\necho '{"name": "gpu", "addresses": ["7"]}'\n""")
    script.chmod(0o755)
    own = {"spark.worker.resource.gpu.amount": 1, "spark.worker.resource.gpu.discoveryScript": script, "spark.executor.resource.gpu.amount": 1}
    program = textwrap.dedent(f"""
        from pyspark.sql import SparkSession
        import caseloom as cl
        spark = (SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "{tmp_path}").config("spark.driver.host", "127.0.0.1")
            .config(map={ {k: str(v) for k, v in own.items()} if there else {} }).getOrCreate())
        b = cl.FlowBuilder("gpus")
        b.assign("x", values=[1, 2])
        def gpus(x):
            from pyspark import TaskContext
            return sum(len(r.addresses) for r in TaskContext.get().resources().values())
        b(cl.output("one")(cl.run_with(pool="small", gpus=1)(gpus)))
        print("GPUS", b.build().get("one", list))
    """)
    import pyspark

    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    (tmp_path / "program.py").write_text(program)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": str(home), "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13"}
    ran = subprocess.run([sys.executable, str(tmp_path / "program.py")], capture_output=True, text=True, timeout=300, env=env)
    said = [x for x in ran.stderr.splitlines() if not x.lstrip().startswith("at ")]
    assert f"GPUS [{given}, {given}]" in ran.stdout, ran.stdout[-500:] + "\n".join(said)[-3000:]


def test_frames_are_given_back(builder, spark):
    cached = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    gc.collect()
    before = cached()
    builder.set("core__persist_by_default", False)
    builder.set("core__memoize_by_default", False)
    builder.assign("x", values=[1, 2])
    builder(cl.output("y")(lambda x: x + 1))
    flow = builder.build()
    held = flow.frame("y")
    assert held.count() == 2 and cached() == before + 1
    del held
    gc.collect()
    assert cached() == before
    assert sorted(flow.get("y", list)) == [2, 3] and cached() == before


def test_sketches(spark):
    rows = spark.createDataFrame([(float(k), k % 2, None) for k in range(100)] + [(None, 0, None), (float("nan"), 1, None)], "v double, side int, nothing double")
    h = figures.histogram(rows, "v", bins=10)
    assert h["n"].tolist() == [10] * 10 and h["low"].iloc[0] == 0 and h["high"].iloc[-1] == 99
    assert figures.histogram(rows, "v", bins=4, by="side").groupby("side")["n"].sum().to_dict() == {0: 50, 1: 50}
    assert len(figures.histogram(rows, "nothing")) == 0
    q = figures.quantiles(rows.where("not isnan(v)"), ["v", "side"], [0.0, 0.5, 1.0])
    assert q.loc["v"].tolist() == [0, 49, 99] and q.loc["side"].tolist() == [0, 0, 1]
    assert figures.histogram(rows.where("v = 5"), "v", bins=3)["n"].tolist() == [1]


def test_figure_of_frames(builder, spark, monkeypatch):
    """A plotting function of DataFrames, alone and gathered, gets pyplot and the frames."""
    drawn = []
    pyplot = type(sys)("matplotlib.pyplot")
    pyplot.close, pyplot.bar = (lambda what: None), (lambda *given: drawn.append(given))
    pyplot.savefig = lambda out, format: out.write(b"\x89PNG\r\n\x1a\n" + str(len(drawn)).encode())
    matplotlib = type(sys)("matplotlib")
    matplotlib.use, matplotlib.pyplot = (lambda backend: None), pyplot
    monkeypatch.setitem(sys.modules, "matplotlib", matplotlib)
    monkeypatch.setitem(sys.modules, "matplotlib.pyplot", pyplot)
    builder.assign("rows", cl.FrameSource(spark.range(100).toDF("v"), version="1"))
    builder.assign("least", values=[10, 90])

    @builder
    @cl.pyplot("plt")
    def shape(rows, plt):
        h = figures.histogram(rows, "v", bins=5)
        plt.bar(h["low"].tolist(), h["n"].tolist())

    @builder
    @cl.frame
    def above(rows, least):
        return rows.where(F.col("v") >= least)

    @builder
    @cl.pyplot("plt")
    @cl.gather("least", "above")
    def sizes(gather_df, plt):
        plt.bar(sorted((r.least, r["count"]) for r in gather_df.groupBy("least").count().collect()))

    flow = builder.build()
    assert bytes(flow.get("shape"))[:4] == b"\x89PNG" and drawn == [([0.0, 19.8, 39.6, 59.400000000000006, 79.2], [20] * 5)]
    assert bytes(flow.get("sizes"))[:4] == b"\x89PNG" and drawn[1] == ([(10, 90), (90, 10)],)
