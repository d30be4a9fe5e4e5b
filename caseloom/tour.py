"""The rest of the interface as registered queries: each gives what it found as a small table, with SQL that states it."""

from __future__ import annotations

import json
import tempfile
import uuid
import warnings
from collections.abc import Callable
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import caseloom as cl

from . import protocol
from .codecs import Codec, register
from .descriptors import parse
from .errors import MalformedDescriptorError
from .examples import SQL as EXAMPLES_SQL
from .examples import builder, cases_of, revenue_flow, source
from .plans.store import delete, work_folder
from .sources import figures


def said(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def error_of(action: Callable[[], Any]) -> str:
    try:
        action()
    except Exception as e:
        return type(e).__name__
    return ""


def delete_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity goes; what is left has its rows."""
    b = builder(spark, "delete")
    for table in ("orders", "customer", "supplier"):
        source(b, spark, sf_dir, table)
    b.delete("orders")
    flow = b.build()
    gone = error_of(lambda: flow.get("orders"))
    return reduce(DataFrame.unionByName, [flow.frame(n).agg(F.lit(n).alias("entity"), F.lit(gone).alias("gone"), F.count("*").alias("n_rows")) for n in flow.all_entity_names()])


def outputs_and_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = builder(spark, "outputs")
    cases_of(b, spark, sf_dir, "x", "supplier", "s_suppkey")

    @b
    @cl.outputs("low", "high")
    @cl.typed("long")
    def _(x):
        return x - 1, x + 2

    @b
    @cl.accepts(ends="low, (high, x)")
    @cl.typed("long")
    def spread(ends):
        low, (high, x) = ends
        return (high - low) * x

    return b.build().frame("low, high, spread")


def docs_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a flow says of its entities, and how many cases each has."""
    b = builder(spark, "docs")
    source(b, spark, sf_dir, "supplier")
    b.assign("step", 3, doc="a number")

    @b
    @cl.cases
    def x(supplier):
        """Keys of suppliers."""
        return supplier.select(F.col("s_suppkey").alias("x"))

    @b
    @cl.outputs("one", "two")
    @cl.docs("the first", "the second")
    def _(x, step):
        return x, step

    @b
    @protocol.picklable()
    def three(x):
        """In its own words."""
        return x

    flow = b.build()
    said = [flow.frame(n).agg(*(F.lit(v).alias(k) for k, v in {"entity": n, "doc": flow.entity_doc(n), "codec": flow.entity_protocol(n).name, "flow": flow.name}.items()), F.count("*").alias("n_cases"))
            for n in ("step", "x", "one", "two", "three")]
    return reduce(DataFrame.unionByName, said)


def collections_of_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = builder(spark, "get")
    cases_of(b, spark, sf_dir, "x", "supplier", "s_suppkey")
    b.assign("y", 10)

    @b
    def total(x, y):
        return x + y

    flow = b.build()
    series = flow.get("total", "series")
    rows = [("single", json.dumps(flow.get("y"))), ("proxy", json.dumps(flow.get.y())), ("list", json.dumps(sorted(flow.get("total", list))))]
    rows += [("set", json.dumps(sorted(flow.get("total", set)))), ("tuple", json.dumps(sorted(flow.get("x, (y,)", list))))]
    rows += [("series", json.dumps(sorted((x.get(), v) for x, v in zip(series.index.get_level_values("x"), series))))]
    return said(spark, "how string, value string", rows)


def errors_of_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be asked, of one case for each supplier."""
    b = builder(spark, "errors")
    cases_of(b, spark, sf_dir, "many", "supplier", "s_suppkey")
    b.declare("unset")

    @b
    def above(unset, many):
        return many

    @b
    @cl.returns("a, b")
    def _(many):
        return 1, 2, 3

    @b
    def broken(many):
        raise KeyError("no")

    @b
    @cl.frame
    def rows_of(unset, supplier):
        return supplier

    flow = b.build()
    asked = {
        "unset": lambda: flow.get("above"), "unset frame": lambda: flow.frame("rows_of"), "undefined": lambda: flow.get("nothing"),
        "more than one": lambda: flow.get("many"), "wrong arity": lambda: flow.get("a", list), "raises": lambda: flow.get("broken", list),
    }
    try:
        named = ""
        flow.get("above")
    except Exception as e:
        named = str(e).rpartition("unset: ")[2]
    rows = said(spark, "asked string, error string, named string", [(k, error_of(f), named if k == "unset" else None) for k, f in asked.items()])
    return rows.crossJoin(flow.frame("many").agg(F.count("*").alias("n_many")))


def null_and_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null value is a value; a case of an unset entity is not there."""
    b = builder(spark, "null")
    cases_of(b, spark, sf_dir, "x", "supplier", "s_suppkey")
    b.declare("unset")

    @b
    def maybe(x):
        return None if x % 3 == 1 else x

    @b
    def never(x, unset):
        return x

    flow = b.build()
    n = flow.frame("never").count()
    return flow.frame("maybe").withColumn("n_missing", F.lit(n).cast("long"))


def retrieval_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = builder(spark, "modes")
    source(b, spark, sf_dir, "customer")

    @b
    def doubled(customer):
        return 2 * customer.count()

    flow, out = b.build(), work_folder(spark, "copies")
    read = lambda path: bytes(spark.read.format("binaryFile").load(str(path)).first()["content"]).decode()
    target = f"{out if '://' in out else f'file://{out}'}"
    rows = [("filename", read(flow.get("doubled", mode="filename"))), ("object", str(flow.get("doubled")))]
    flow.get("doubled", mode="FileCopier").copy(f"{target}/copy.json")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        rows += [("FileCopier", read(f"{out}/copy.json")), ("export", read(flow.export("doubled"))), ("export to", read(flow.export("doubled", f"{target}/other.json")))]
    try:  # a path is of a local file system
        rows.append(("path", read(flow.get("doubled", mode="path"))))
    except ValueError:
        rows.append(("path", str(flow.get("doubled"))))
    return said(spark, "mode string, value string", rows)


def flow_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows made from a flow, each asked how many suppliers its nations have."""
    b = builder(spark, "variants")
    source(b, spark, sf_dir, "supplier")
    b.assign("nation", 1)
    b.declare("label")

    @b
    def n(supplier, nation):
        return supplier.where(F.col("s_nationkey") == nation).count()

    @b
    def labelled(n, label):
        return f"{label} {n}"

    flow = b.build()
    other = cl.FlowBuilder("other")
    other.assign("z", 5)
    cased = flow.declaring("w").then_setting({"w": 1}, "label", "one")
    made = {
        "assigning": flow.assigning("y", values=[1, 2]).get("n, y", list), "setting": flow.setting("nation", 9).get("n", list),
        "setting proxy": flow.setting.nation(values=[8, 3]).get("n", list), "adding_case": flow.adding_case("label", "a").get("labelled", list),
        "then_setting": cased.get("labelled", list), "clearing_cases": flow.clearing_cases("nation").get("n", list),
        "merging": flow.merging(other.build()).get("z, n", list), "to_builder": flow.to_builder().build().get("n", list), "as it was": flow.get("n", list),
    }
    return said(spark, "variant string, found string", [(k, json.dumps(sorted(v))) for k, v in made.items()])


def function_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a function's values, one for each segment of the customers, stay within a flow and over two (not told where
    they are only kept in memory), and are stored."""
    b = builder(spark, "attributes")
    cases_of(b, spark, sf_dir, "x", "customer", "c_mktsegment")
    for name, kind in {
        "plain": lambda f: f, "unstored": cl.persist(False), "immediate": cl.immediate, "per_run": cl.changes_per_run,
        "forgotten": lambda f: cl.persist(False)(cl.memoize(False)(f)), "with_hint": cl.run_with(pool="small", gpus=1),
    }.items():
        b(cl.output(name)(kind(lambda x: x + uuid.uuid4().hex)))
    one, two = b.build(), b.build()
    rows = []
    for name in ("plain", "unstored", "immediate", "per_run", "forgotten", "with_hint"):
        first, again, other = (sorted(f.get(name, list)) for f in (one, one, two))
        stored = sum(e.entity == name for e in one.cache.get_entries())
        rows.append((name, first == again, None if name in ("unstored", "immediate") else first == other, stored and len(first), len(first)))
    return said(spark, "attribute string, same_in_flow boolean, same_in_next boolean, n_stored long, n_cases long", rows)


def attribute_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorators that forbid one another, tried on a function that counts the customers; and what it gives where they don't."""
    b = builder(spark, "rules")
    source(b, spark, sf_dir, "customer")

    def f(wrap) -> str:
        def n_rows(customer):
            return customer.count()

        try:
            b(wrap(n_rows))
            return str(b.build().get("n_rows"))
        except Exception as e:
            return type(e).__name__

    rows = [
        ("persist twice", f(lambda g: cl.persist(True)(cl.persist(False)(g)))), ("memoize twice", f(lambda g: cl.memoize(True)(cl.memoize(True)(g)))),
        ("docs twice", f(lambda g: cl.docs("a")(cl.docs("b")(g)))), ("version twice", f(lambda g: cl.version(1)(cl.version(2)(g)))),
        ("per run twice", f(lambda g: cl.changes_per_run(cl.changes_per_run(g)))), ("one of each", f(lambda g: cl.persist(True)(cl.memoize(True)(g)))),
    ]
    return said(spark, "rule string, outcome string", rows)


def versioning_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the number of customers, changed again and again: what is computed anew by mode and version."""
    b = builder(spark, "versions")
    source(b, spark, sf_dir, "customer")

    @b
    @cl.version_no_warnings
    def x(customer):
        return customer.count()

    def ask(mode: str, function, wrap=lambda f: f) -> str:
        b.set("core__versioning_mode", mode)
        b(cl.output("y")(wrap(function)))
        try:
            flow = b.build()
            return str(flow.get("y") - flow.get("x"))
        except Exception as e:
            return type(e).__name__

    rows = [
        ("manual", "first", ask("manual", lambda x: x + 1)), ("manual", "changed", ask("manual", lambda x: x + 2)),
        ("manual", "new major", ask("manual", lambda x: x + 3, cl.version(1))), ("assist", "changed", ask("assist", lambda x: x + 4, cl.version(1))),
        ("assist", "new minor", ask("assist", lambda x: x + 5, cl.version(1, 1))), ("assist", "new major", ask("assist", lambda x: x + 6, cl.version(2))),
        ("assist", "no warnings", ask("assist", lambda x: x + 7, cl.version_no_warnings(2))),
        ("auto", "first", ask("auto", lambda x: x + 8)), ("auto", "changed", ask("auto", lambda x: x + 9)), ("other", "first", ask("other", lambda x: x)),
    ]
    b.set("core__versioning_mode", "manual")
    return said(spark, "mode string, change string, outcome string", rows).withColumn("x", F.lit(b.build().get("x")).cast("long"))


def early_cut_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table under another version is counted again; the count is the same, so what follows from it stays as it is stored."""
    b = builder(spark, "cut")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    b.assign("orders", cl.FrameSource(rows, version="one"))

    @b
    def n_rows(orders):
        return orders.count()

    @b
    def after(n_rows):
        return f"{n_rows} {uuid.uuid4().hex}"

    first = b.build().get("after")
    flow = b.build().setting("orders", cl.FrameSource(rows, version="two"))
    again = flow.get("after")
    entries = flow.cache.frame().groupBy("entity").agg(F.count("*").alias("n_stored"))
    return entries.withColumn("same", F.lit(again == first)).withColumn("n_rows", F.lit(int(again.split()[0])).cast("long"))


def store_delete_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is stored is deleted in one commit, frames of many cases included, and computed again."""
    b = revenue_flow(spark, sf_dir, "again")
    flow = b.build()
    flow.frame("by_segment").count()
    n = flow.cache.delete()
    left = flow.cache.frame().count()
    return b.build().frame("by_segment").withColumns({"n_deleted": F.lit(n).cast("long"), "n_left": F.lit(left).cast("long")})


def delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for each part; half of them are deleted in one commit, and only these are computed again."""
    b = builder(spark, "delete-many")
    cases_of(b, spark, sf_dir, "part_key", "part", "p_partkey")

    @b
    @cl.typed("long")
    def digits(part_key):
        return sum(map(int, str(part_key)))

    flow = b.build()
    flow.frame("digits").count()
    cache = flow.cache
    n = cache.frame().where("entity = 'digits'").count()
    deleted = cache.delete((F.col("entity") == "digits") & (F.substring("p", 1, 1) < "8"))
    left = cache.frame().where("entity = 'digits'").count()
    out = b.build().frame("digits").agg(F.count("*").alias("n"), F.sum("digits").alias("total"))
    commits, again = len(cache._store.graves(0)), cache.frame().where("entity = 'digits'").count()
    said = {"n_stored": n, "n_stored_again": again, "n_missed": n - deleted - left, "n_commits": commits}
    return out.withColumns({k: F.lit(v).cast("long") for k, v in said.items()})


def second_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first root is lost; the second one has everything, DataFrames included."""
    b = revenue_flow(spark, sf_dir, "tiers")
    first = work_folder(spark, "first-root")
    b.set("core__persistent_cache__flow_dir", first)
    b.set("core__persistent_cache__cloud__url", work_folder(spark, "second-root"))
    b.build().frame("by_segment").count()
    delete(spark, first)
    flow = b.build()
    out = flow.frame("by_segment")
    tiers = flow.cache.frame().where("entity = 'revenue'").select("tier").distinct().count()
    return out.withColumn("n_tiers", F.lit(tiers).cast("long"))


class Pairs(Codec):
    """A codec of a user's own: pairs of numbers as text."""

    name, extension = "number-pair", "txt"

    def accepts(self, value):
        return isinstance(value, complex)

    def dump(self, value):
        return f"{value.real} {value.imag}".encode()

    def load(self, data):
        return complex(*map(float, data.decode().split()))


register(Pairs())


def codec_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each codec, made of the suppliers, as they come back from the store."""
    import numpy as np
    import pandas as pd

    b = builder(spark, "codecs")
    source(b, spark, sf_dir, "supplier")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey").collect()]
    keys, names = [r[0] for r in rows], [r[1] for r in rows]
    frame = pd.DataFrame({"key": keys, "name": [None, *names[1:]], "half": [float("nan"), *(k / 2 for k in keys[1:])]})
    ordered = pd.DataFrame({"c": pd.Categorical(names, categories=sorted(names, reverse=True), ordered=True)})
    values = {
        "json": (protocol.json(), {"keys": keys, "names": names, "none": None}), "picklable": (protocol.picklable(), (tuple(keys), {names[0]})),
        "dillable": (protocol.dillable(), len), "frame": (protocol.frame(), frame), "feather": (protocol.frame(file_format="feather"), ordered),
        "numpy": (protocol.numpy(), np.array(keys, float).reshape(-1, 1)), "image": (protocol.image(), b"\x89PNG\r\n\x1a\n" + names[0].encode()),
        "yaml": (protocol.yaml(), {"k": names}), "sets": (protocol.sets(), frozenset(keys)), "enum": (protocol.enum(*names), names[0]),
        "type": (protocol.type(int), keys[-1]), "combined": (protocol.combine(protocol.numpy(), protocol.json()), keys), "custom": (Pairs(), complex(keys[0], keys[-1])),
    }
    for name, (codec, value) in values.items():
        b(cl.output(f"as_{name}")(codec(_giving(value))))

    @b
    @protocol.path("move")
    def as_path(text):
        folder = Path(tempfile.mkdtemp(prefix="caseloom-tour-"))
        (folder / "names.txt").write_text(text)
        return folder / "names.txt"

    b.assign("text", "\n".join(names))
    flow = b.build()

    def same(a: Any, b: Any) -> bool:
        if isinstance(b, pd.DataFrame):
            return a.equals(b) and list(map(str, a.dtypes)) == list(map(str, b.dtypes))
        return bool((a == b).all()) if isinstance(b, np.ndarray) else type(a) is type(b) and a == b

    found = [(n, same(flow.get(f"as_{n}"), v)) for n, (_, v) in values.items()]
    found.append(("path", flow.get("as_path").read_text() == "\n".join(names)))
    return said(spark, "codec string, equal boolean", found).withColumn("n_rows", F.lit(len(rows)).cast("long"))


def _giving(value: Any) -> Callable:
    def give(text):
        return value

    return give


def codec_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the suppliers that codecs refuse."""
    import pandas as pd

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name").orderBy("s_suppkey").collect()
    keys, names = [r[0] for r in rows], [r[1] for r in rows]
    tried = {
        "json of a tuple": lambda: protocol.json().encode(tuple(keys)), "frame with equal names": lambda: protocol.frame().encode(pd.DataFrame([keys, keys], columns=["a"] * len(keys))),
        "frame with categories": lambda: protocol.frame().encode(pd.DataFrame({"c": pd.Categorical(names)})), "enum of another": lambda: protocol.enum(*names).encode(keys[0]),
        "type of another": lambda: protocol.type(int).encode(names[0]), "pickle of a lambda": lambda: protocol.picklable().encode(lambda: keys),
        "type of its own": lambda: protocol.type(int).encode(keys[0]),
    }
    return said(spark, "tried string, error string", [(k, error_of(f)) for k, f in tried.items()]).withColumn("n_rows", F.lit(len(rows)).cast("long"))


def core_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for key in ("core__persist_by_default", "core__memoize_by_default", "core__temp_memoize_if_uncached"):
        for value in (True, False):
            b = builder(spark, "core")
            source(b, spark, sf_dir, "orders")
            b.set(key, value)

            @b
            def y(orders):
                return orders.count()

            flow = b.build()
            rows.append((key, value, flow.get("y"), len(flow.cache.get_entries())))
    # Where no folder is set, the store lies under the default root in the session's shared folder, by the flow's name.
    b = cl.FlowBuilder(f"rooted-{uuid.uuid4().hex}")
    source(b, spark, sf_dir, "orders")
    b(y)
    flow = b.build()
    n, root = flow.get("y"), flow.cache._store.roots[0]
    rows.append((root.rstrip("/").rpartition("/")[0].rpartition("/")[2], flow.name in root, n, len(flow.cache.get_entries())))
    delete(spark, root)
    return said(spark, "setting string, value boolean, y long, n_stored long", rows)


def descriptor_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How descriptors are read, and what a flow gives for those that it can be asked."""
    given = [" a ", "(a , b)", "a,", "()", "((a), (b, (c,)))", "<a>", "a b", "(a", "a,,b", "1a", ""]
    b = builder(spark, "descriptors")
    for name, table in (("a", "supplier"), ("b", "customer"), ("c", "part")):
        source(b, spark, sf_dir, table)
        b(cl.output(name)(cl.accepts(rows=table)(lambda rows: rows.count())))
    flow = b.build()

    def read(text: str) -> tuple[str, str | None]:
        try:
            canonical = str(parse(text))
        except MalformedDescriptorError:
            return "malformed", None
        return canonical, None if "<" in text else json.dumps(flow.get(text))

    return said(spark, "given string, canonical string, value string", [(t, *read(t)) for t in given])


def names_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose names differ in case alone, under the session's own setting."""
    b = builder(spark, "case")
    cases_of(b, spark, sf_dir, "n", "supplier", "s_suppkey")
    cases_of(b, spark, sf_dir, "N", "lineitem", "l_linenumber")

    @b
    @cl.typed("long")
    def total(n, N):  # noqa: N803
        return n + N

    return said(spark, "total long", [(v,) for v in b.build().get("total", list)])


def many_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two functions of every pair of a supplier and a part's size: a write for each, and one for each table of keys."""
    b = builder(spark, "many")
    cases_of(b, spark, sf_dir, "x", "supplier", "s_suppkey")
    cases_of(b, spark, sf_dir, "y", "part", "p_size")

    @b
    @cl.expr
    def place(x, y):
        return x * 100 + y

    @b
    @cl.typed("long")
    def digits(place):
        return sum(map(int, str(place)))

    flow = b.build()
    out = flow.frame("digits").agg(F.count("*").alias("n"), F.sum("digits").alias("total"))
    store = flow.cache._store
    writes = sum(len(store.writes(t, 0)) for t in store.tables())
    return out.withColumn("n_writes", F.lit(writes).cast("long"))


#: Values of one entity, given in the program.
MANY = 10_000


def many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousand values of one entity, given in the program, each with the line items of that order."""
    b = builder(spark, "values")
    source(b, spark, sf_dir, "lineitem")
    b.assign("key", values=list(range(MANY)))

    @b
    @cl.lifted("key")
    def lines(cases, lineitem):
        counted = lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("n_lines"))
        return cases.join(counted, "key").select("case_id", "n_lines")

    return b.build().frame("lines")


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a figure of the line items draws: a histogram and quantiles, and no row."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    counts = figures.histogram(rows, "l_quantity", bins=7, by="l_returnflag")
    ends = figures.quantiles(rows, ["l_quantity"], [0.0, 1.0])
    made = spark.createDataFrame(counts[["l_returnflag", "low", "n"]]).withColumn("part", F.round((F.col("low") - 1) / 7).cast("long")).drop("low")
    return made.withColumns({"least": F.lit(float(ends.iloc[0, 0])), "most": F.lit(float(ends.iloc[0, 1]))})


_V = "select * from (values {}) t({})"
_X = "(select distinct s_suppkey as x from supplier)"
_N = "(select count(*) from {})"
_OF = "(select count(*) from supplier where s_nationkey = {})"
_LISTED = "'[' || string_agg({}, ', ' order by x) || ']'"
SQL = {
    "delete_entity": """select 'customer' as entity, 'UndefinedEntityError' as gone, count(*) as n_rows from customer
        union all select 'supplier', 'UndefinedEntityError', count(*) from supplier""",
    "outputs_and_accepts": f"select x, x - 1 as low, x + 2 as high, 3 * x as spread from {_X}",
    "docs_and_names": f"""select entity, doc, codec, 'docs' as flow, case when entity = 'step' then 1 else (select count(*) from {_X}) end as n_cases
        from (values ('step', 'a number', 'any'), ('x', 'Keys of suppliers.', 'any'), ('one', 'the first', 'any'), ('two', 'the second', 'any'),
        ('three', 'In its own words.', 'pickle')) t(entity, doc, codec)""",
    "collections_of_get": f"""select 'single' as how, '10' as value union all select 'proxy', '10' union all select unnest(['list', 'set']), {_LISTED.format('x + 10')} from {_X}
        union all select 'tuple', {_LISTED.format("'[' || x || ', [10]]'")} from {_X} union all select 'series', {_LISTED.format("'[' || x || ', ' || x + 10 || ']'")} from {_X}""",
    "errors_of_get": f"""select *, (select count(*) from {_X}) as n_many from (values ('unset', 'UnsetEntityError', '''unset'''), ('unset frame', 'UnsetEntityError', null),
        ('undefined', 'UndefinedEntityError', null), ('more than one', 'ValueError', null), ('wrong arity', 'EntityValueError', null),
        ('raises', 'EntityComputationError', null)) t(asked, error, named)""",
    "null_and_missing": f"select x, case when x % 3 <> 1 then cast(x as varchar) end as maybe, 0::bigint as n_missing from {_X}",
    "retrieval_modes": "select unnest(['filename', 'object', 'FileCopier', 'export', 'export to', 'path']) as mode, cast(2 * count(*) as varchar) as value from customer",
    "flow_variants": f"""select variant, '[' || found || ']' as found from (values
        ('assigning', '[' || {_OF.format(1)} || ', 1], [' || {_OF.format(1)} || ', 2]'), ('setting', {_OF.format(9)} || ''),
        ('setting proxy', least({_OF.format(8)}, {_OF.format(3)}) || ', ' || greatest({_OF.format(8)}, {_OF.format(3)})),
        ('adding_case', '"a ' || {_OF.format(1)} || '"'), ('then_setting', '"one ' || {_OF.format(1)} || '"'), ('clearing_cases', ''),
        ('merging', '[5, ' || {_OF.format(1)} || ']'), ('to_builder', {_OF.format(1)} || ''), ('as it was', {_OF.format(1)} || '')) t(variant, found)""",
    "function_attributes": """select attribute, same_in_flow, same_in_next, case when stored then n else 0 end as n_stored, n as n_cases from (values
        ('plain', true, true, true), ('unstored', true, null, false), ('immediate', true, null, false), ('per_run', true, false, true),
        ('forgotten', false, false, false), ('with_hint', true, true, true)) t(attribute, same_in_flow, same_in_next, stored),
        (select count(distinct c_mktsegment) as n from customer)""",
    "attribute_rules": f"""select rule, coalesce(outcome, {_N.format('customer')} || '') as outcome from (values
        ('persist twice', 'AttributeValidationError'), ('memoize twice', 'AttributeValidationError'), ('docs twice', 'AttributeValidationError'),
        ('version twice', 'ValueError'), ('per run twice', 'ValueError'), ('one of each', null)) t(rule, outcome)""",
    "versioning_modes": f"""select *, {_N.format('customer')} as x from (values ('manual', 'first', '1'), ('manual', 'changed', '1'), ('manual', 'new major', '3'),
        ('assist', 'changed', 'CodeVersioningError'), ('assist', 'new minor', '3'), ('assist', 'new major', '6'), ('assist', 'no warnings', '6'),
        ('auto', 'first', '8'), ('auto', 'changed', '9'), ('other', 'first', 'ValueError')) t(mode, change, outcome)""",
    "early_cut_off": f"select entity, cast(n as bigint) as n_stored, true as same, {_N.format('orders')} as n_rows from (values ('n_rows', 2), ('after', 1)) t(entity, n)",
    "store_delete_recompute": f"select *, 11::bigint as n_deleted, 0::bigint as n_left from ({EXAMPLES_SQL['param_sweep_revenue']})",
    "delete_many": """select count(*) as n, cast(sum(list_sum(list_transform(string_split(cast(k as varchar), ''), lambda c: cast(c as bigint)))) as bigint) as total,
        count(*) as n_stored, count(*) as n_stored_again, 0::bigint as n_missed, 1::bigint as n_commits from (select distinct p_partkey as k from part)""",
    "second_tier": f"select *, cast(2 as bigint) as n_tiers from ({EXAMPLES_SQL['param_sweep_revenue']})",
    "codec_round_trips": f"""select unnest(['json', 'picklable', 'dillable', 'frame', 'feather', 'numpy', 'image', 'yaml', 'sets', 'enum', 'type', 'combined', 'custom', 'path']) as codec,
        true as equal, {_N.format('supplier')} as n_rows""",
    "codec_limits": f"""select *, {_N.format('supplier')} as n_rows from (values ('json of a tuple', 'EntityValueError'), ('frame with equal names', 'EntitySerializationError'),
        ('frame with categories', 'EntitySerializationError'), ('enum of another', 'EntityValueError'), ('type of another', 'EntityValueError'),
        ('pickle of a lambda', 'EntitySerializationError'), ('type of its own', '')) t(tried, error)""",
    "core_settings": f"""select setting, value, {_N.format('orders')} as y, cast(case when setting = 'core__persist_by_default' and not value then 0 else 1 end as bigint) as n_stored
        from (values ('core__persist_by_default'), ('core__memoize_by_default'), ('core__temp_memoize_if_uncached')) t(setting), (values (true), (false)) v(value)
        union all select 'caseloom-data', true, {_N.format('orders')}, 1""",
    "descriptor_texts": f"""with n(a, b, c) as (select {_N.format('supplier')}, {_N.format('customer')}, {_N.format('part')})
        select given, canonical, value from n, lateral (values (' a ', 'a', a || ''), ('(a , b)', 'a, b', '[' || a || ', ' || b || ']'), ('a,', 'a,', '[' || a || ']'), ('()', '()', '[]'),
        ('((a), (b, (c,)))', 'a, (b, (c,))', '[' || a || ', [' || b || ', [' || c || ']]]'), ('<a>', '<a>', null), ('a b', 'malformed', null), ('(a', 'malformed', null),
        ('a,,b', 'malformed', null), ('1a', 'malformed', null), ('', 'malformed', null)) t(given, canonical, value)""",
    "names_by_case": f"select x + l as total from {_X}, (select distinct l_linenumber as l from lineitem)",
    "many_cases": f"""select count(*) as n, cast(sum(list_sum(list_transform(string_split(cast(x * 100 + y as varchar), ''), lambda c: cast(c as bigint)))) as bigint) as total,
        4::bigint as n_writes from {_X}, (select distinct p_size as y from part)""",
    "many_values": f"select l_orderkey as key, count(*) as n_lines from lineitem where l_orderkey between 0 and {MANY - 1} group by 1",
    "sketches": """select l_returnflag, cast(least(floor((l_quantity - least) / ((most - least) / 7)), 6) as bigint) as part, count(*) as n, least, most
        from lineitem, (select min(l_quantity) as least, max(l_quantity) as most from lineitem) group by all""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}
