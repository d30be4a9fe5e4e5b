"""Functions over cases: column expressions, and Python functions in Spark tasks."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..codecs import DEFAULT, Codec, content_hash, release_as
from ..descriptors import Group, Name, Node
from ..errors import EntityValueError
from .relation import col_name

RESULT = T.StructType([T.StructField("c", T.StringType()), T.StructField("v", T.BinaryType()), T.StructField("h", T.StringType())])


def result_type(codec: Codec) -> T.StructType:
    """A result's struct, its value as bytes or as the Spark type that the codec says."""
    return RESULT if codec.spark_type is None else T.StructType([RESULT["c"], T.StructField("v", _parse_datatype_string(codec.spark_type)), RESULT["h"]])


def one_result(codec: Codec, value: Any) -> tuple[str, Any, str]:
    """The codec's name, what is held of the value, and its hash."""
    name, data = codec.encode(value)
    return name, data if codec.spark_type is None else codec.hold(value), content_hash(name, data)


def plain(value: Any) -> Any:
    """Rows from Spark as plain dicts and lists."""
    if isinstance(value, T.Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


def decode(codec: str | None, value: Any) -> Any:
    return plain(value) if codec is None else release_as(codec, value)


def argument(node: Node, values: dict[str, Any]) -> Any:
    """A value, or for a tuple descriptor a tuple of them."""
    return values[node.name] if isinstance(node, Name) else tuple(argument(p, values) for p in node.parts)


def leaves(node: Node, value: Any) -> list[tuple[str, Any]]:
    """The entities of an output descriptor and their values in what a function gave."""
    if isinstance(node, Name):
        return [(node.name, value)]
    if not isinstance(value, (tuple, list)):
        raise EntityValueError(f"expected a tuple for {str(node)!r}, got {value!r}")
    if len(value) != len(node.parts):
        hint = "; for a single value use output(...)" if len(node.parts) == 1 else ""
        raise EntityValueError(f"expected {len(node.parts)} values for {str(node)!r}, got {len(value)}{hint}")
    return [x for p, v in zip(node.parts, value) for x in leaves(p, v)]


def gathered_frame(items: list, names: tuple[str, ...]):
    import pandas as pd

    rows = [[decode(r[col_name("c", n)], r[col_name("v", n)]) for n in names] for r in items]
    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=None if rows else object) for k, n in enumerate(names)}, columns=list(names))


def encoded(output: Node, codecs: dict[str, Codec], got: Any) -> list[tuple[str, Any, str]]:
    return [one_result(codecs.get(name, DEFAULT), value) for name, value in leaves(output, got)]


def caller(
    function: Callable,
    args: list[tuple[str, Node]],
    values: list[str],
    frames: dict[str, tuple[str, ...]],
    output: Node,
    codecs: dict[str, Codec],
    describe: str,
) -> Callable:
    """A function of (value, codec) for each of ``values`` and of the gathered rows for each of ``frames``; gives a tuple of (codec, bytes, hash)."""

    def call(*given):
        known = {n: decode(given[2 * k + 1], given[2 * k]) for k, n in enumerate(values)}
        for k, (into, names) in enumerate(frames.items()):
            known[into] = gathered_frame(given[2 * len(values) + k], names)
        return called(function, args, known, output, codecs, describe)

    return call


def called(function: Callable, args: list[tuple[str, Node]], known: dict[str, Any], output: Node, codecs: dict[str, Codec], describe: str) -> tuple:
    try:
        got = function(**{arg: argument(node, known) for arg, node in args})
    except Exception as e:
        raise RuntimeError(f"EntityComputationError: error while computing {describe}: {type(e).__name__}: {e}") from e
    return tuple(encoded(output, codecs, got))


def result_schema(output: Node, codecs: dict[str, Codec]) -> T.StructType:
    return T.StructType([T.StructField(f"o{k}", result_type(codecs.get(n, DEFAULT))) for k, n in enumerate(output.entities())])


def arrow_results(got: list[tuple], schema: T.StructType) -> list[pa.Array]:
    """An Arrow column for each output of calls' results."""
    names = RESULT.names
    return [pa.array([dict(zip(names, one[k])) for one in got], f.type) for k, f in enumerate(to_arrow_schema(schema))]


def python_map(
    function: Callable,
    args: list[tuple[str, Node]],
    frames: dict[str, tuple[str, ...]],
    output: Node,
    codecs: dict[str, Codec],
    describe: str,
) -> Column:
    """A column of one struct (codec, bytes, hash) per output.  One call per case, in the tasks of the case relation."""
    values = value_names(args, frames)
    call = caller(function, args, values, frames, output, codecs, describe)
    columns = [F.col(c) for c in inputs(values, frames)]
    # Cases go to Python and back in Arrow batches; not to be called again where the optimizer would repeat an expression.
    return F.udf(call, result_schema(output, codecs), useArrow=True).asNondeterministic()(*columns)


def value_names(args: list[tuple[str, Node]], frames) -> list[str]:
    return [n for n in dict.fromkeys(e for _, node in args for e in node.entities()) if n not in frames]


def inputs(values: list[str], frames) -> list[str]:
    return [c for n in values for c in (col_name("v", n), col_name("c", n))] + [col_name("v", i) for i in frames]


def profiled_map(rows: DataFrame, function: Callable, args: list[tuple[str, Node]], frames: dict, output: Node, codecs: dict, describe: str, profile) -> DataFrame:
    """As ``python_map``, in a stage that has a resource profile of its own."""
    values, given = value_names(args, frames), inputs(value_names(args, frames), frames)
    call, made = caller(function, args, values, frames, output, codecs, describe), result_schema(output, codecs)
    schema = T.StructType([*rows.schema, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in given]
            got = [call(*one) for one in (zip(*columns) if columns else [()] * batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrow_results(got, made)], names=schema.names)

    return rows.mapInArrow(run, schema, profile=profile)


def streamed_map(members: DataFrame, function: Callable, args: list[tuple[str, Node]], into: str, names: tuple[str, ...], output: Node, codecs: dict, describe: str) -> DataFrame:
    """One call for each ``p``: the group's rows come in Arrow batches, and each becomes a pandas frame when the function asks for it.

    A row that is not ``there`` only says that its group is.
    """
    values = value_names(args, (into,))
    made = result_schema(output, codecs)
    schema = T.StructType([T.StructField("p", T.StringType()), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)

        def frames():
            for batch in itertools.chain([first], batches):
                rows = [r for r in batch.to_pylist() if r["there"]]
                if rows:
                    yield gathered_frame(rows, names)

        own = {n: decode(first.column(col_name("c", n))[0].as_py(), first.column(col_name("v", n))[0].as_py()) for n in values}
        got = called(function, args, {**own, into: frames()}, output, codecs, describe)
        for _ in batches:  # what the function did not ask for
            pass
        yield pa.RecordBatch.from_arrays([first.column("p").slice(0, 1), *arrow_results([got], made)], names=schema.names)

    return members.groupBy("p").applyInArrow(run, schema)


def expression_map(function: Callable, args: list[tuple[str, Node]]) -> Column:
    """The Column that an ``expr`` function gives for its arguments' Columns."""

    def column(node: Node):
        return F.col(col_name("v", node.name)) if isinstance(node, Name) else tuple(map(column, node.parts))

    return function(**{arg: column(node) for arg, node in args})


def typed_result(value: Column, kind: str | None) -> Column:
    return value.cast(kind) if kind else value


__all__ = ["Group", "argument", "decode", "encoded", "expression_map", "gathered_frame", "leaves", "python_map", "typed_result"]
