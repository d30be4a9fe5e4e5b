"""Tensors and ordered categories: held as Spark types, given to Python functions as arrays and labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import caseloom as cl
from caseloom import protocol
from caseloom.errors import EntityComputationError, EntityValueError
from caseloom.functions.tensors import dot, elementwise, mapped, tensor


@pytest.mark.parametrize(
    "dtype, value",
    [
        ("float64", np.arange(6, dtype=np.int32).reshape(2, 3)),
        ("float64", np.array(1.5)),
        ("float32", np.array([0.5, np.nan, -np.inf])),
        ("int64", np.zeros((0, 4), np.int64)),
        ("int16", np.array([[7], [-7]], np.int64)),
        ("bool", np.array([True, False])),
    ],
)
def test_what_a_tensor_holds_gives_it_back(dtype, value):
    codec = protocol.tensor(dtype)
    for got in (codec.release(codec.hold(value)), codec.load(codec.dump(value)), codec.load(codec.written(codec.hold(value)))):
        assert got.dtype == dtype and got.shape == value.shape
        np.testing.assert_array_equal(got, value)


@pytest.mark.parametrize(
    "codec, value",
    [
        (protocol.tensor("float32"), np.array([0.1])),  # float32 has no such number
        (protocol.tensor("int64"), np.array([1.0])),
        (protocol.tensor("int64"), np.array([2**63], np.uint64)),
        (protocol.tensor("float64"), np.array([2**53 + 1])),
        (protocol.tensor("float64"), np.array(["a"])),
        (protocol.tensor("float64"), [1.0]),
        (protocol.tensor("float64", (2, None)), np.zeros((3, 1))),
        (protocol.tensor("float64", (2, None)), np.zeros(2)),
        (protocol.category("low", "high"), "middle"),
        (protocol.category("low", "high"), None),
    ],
)
def test_what_a_codec_does_not_take(codec, value):
    with pytest.raises(EntityValueError):
        codec.encode(value)


def test_wrong_declarations():
    with pytest.raises(ValueError):
        protocol.tensor("complex128")
    with pytest.raises(ValueError):
        protocol.category("low", "low")


def grids(builder):
    builder.assign("n", values=[1, 2, 3])
    builder.assign("base", np.array([[1.0, 2.0], [3.0, 4.0]]), protocol=protocol.tensor("float64"))

    @builder
    @protocol.tensor("float64", (2, 2))
    def grid(n, base):
        assert base.shape == (2, 2)
        return base * n

    @builder
    @protocol.tensor("float64", (2, 2))
    @cl.agg
    @cl.gather("n", "grid")
    def total(gather_df):
        return elementwise(F.sum, gather_df["grid"], (2, 2))

    @builder
    @protocol.tensor("float64")
    @cl.expr
    def half(grid):
        return mapped(lambda x: x / 2, grid)

    @builder
    @cl.gather("n", "half")
    def corners(gather_df):
        return sorted(float(x[1, 1]) for x in gather_df["half"])

    return builder


def test_columns_and_python_functions_share_a_tensor(builder):
    flow = grids(builder).build()
    np.testing.assert_array_equal(flow.get("total"), [[6, 12], [18, 24]])
    assert flow.get("corners") == [2.0, 4.0, 6.0]
    np.testing.assert_array_equal(flow.setting("n", 5).get("half"), [[2.5, 5], [7.5, 10]])
    shown = {r["n"]: r["grid"].asDict() for r in flow.frame("grid").collect()}
    assert shown[2] == {"shape": [2, 2], "dtype": "float64", "data": [2.0, 4.0, 6.0, 8.0]}


def test_sums_of_tensors_need_no_python_and_no_lists(builder):
    flow = grids(builder).build()
    flow.get("grid", "list")  # from here on the tensors are stored
    plan = flow.frame("total")._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "collect_list" not in plan and "partial_sum" in plan


def test_a_stored_tensor_is_read_and_not_made_again(builder):
    counted = builder.build().spark.sparkContext.accumulator(0)

    def defined(name):
        @builder
        @cl.version(1)
        @protocol.tensor("int64")
        @cl.output(name)
        def made(n):
            counted.add(1)
            return np.full(3, n)

    builder.assign("n", values=[1, 2])
    defined("made")
    for _ in range(2):
        assert sorted(x.tolist() for x in builder.build().get("made", "list")) == [[1, 1, 1], [2, 2, 2]]
    assert counted.value == 2


def test_a_file_of_a_tensor(builder):
    flow = grids(builder).build().setting("n", 2)
    np.testing.assert_array_equal(np.load(flow.get("grid", mode="path")), [[2, 4], [6, 8]])
    np.testing.assert_array_equal(np.load(flow.get("half", mode="path")), [[1, 2], [3, 4]])
    np.testing.assert_array_equal(np.load(flow.get("base", mode="path")), [[1, 2], [3, 4]])


def test_missing_tensors_are_left_out(builder):
    builder.declare("place")
    builder.declare("reading", protocol=protocol.tensor("float64"))
    builder.add_case("place", 1)
    for place in (2, 3):
        builder.add_case("place", place).then_set("reading", np.full(2, float(place)))

    @builder
    @protocol.tensor("float64")
    @cl.agg
    @cl.gather("reading")
    def together(gather_df):
        return elementwise(F.sum, gather_df["reading"], (2,))

    assert builder.build().get("together").tolist() == [5.0, 5.0]


def test_a_group_without_tensors_is_null(builder):
    b = grids(builder)
    b.clear_cases("n")
    assert b.build().get("total") is None


def test_columns_of_tensors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, None), (4, [])]
    df = spark.createDataFrame(rows, "k int, x array<double>").withColumn("t", tensor(F.col("x"), [F.size("x")]))
    out = {r.k: r for r in df.select("k", "t", dot(F.col("t"), F.col("t")).alias("d"), mapped(lambda x: -x, F.col("t")).alias("m")).collect()}
    assert [out[k].d for k in (1, 2, 3, 4)] == [5.0, 25.0, None, 0.0]
    assert out[1].m.data == [-1.0, -2.0] and out[3].m is None and out[4].t.shape == [0]
    assert df.select(elementwise(F.max, F.col("t"), (2,)).alias("s")).first().s.data == [3.0, 4.0]
    assert df.where("k > 4").select(elementwise(F.max, F.col("t"), (2,)).alias("s")).first().s is None
    two = spark.createDataFrame([([1.0], [1.0, 2.0])], "x array<double>, y array<double>")
    assert two.select(dot(tensor(F.col("x"), [1]), tensor(F.col("y"), [2])).alias("d")).first().d is None


def graded(builder, *labels):
    @builder
    @cl.version(1)
    @protocol.category(*labels)
    def grade(n):
        return "low" if n < 3 else "high"

    @builder
    @protocol.category(*labels)
    @cl.agg
    @cl.gather("n", "grade")
    def last(gather_df):
        return F.max(gather_df["grade"])

    return builder.build()


def test_categories_are_in_their_own_order(builder):
    builder.assign("n", values=[1, 2, 3])
    flow = graded(builder, "low", "high")
    assert flow.get("last") == "high" and sorted(flow.get("grade", "list")) == ["high", "low", "low"]
    frame = flow.frame("grade")
    assert dict(frame.dtypes)["grade"] == "string"
    assert frame.schema["grade"].metadata == {"ordered_categories": ["low", "high"]}
    # With the order declared anew, what is stored in the old one is not read.
    assert graded(builder, "high", "low").get("last") == "low"


def test_a_wrong_label_names_the_entity(builder):
    builder.assign("n", 7)
    with pytest.raises((EntityComputationError, EntityValueError)):
        graded(builder, "low").get("grade")
