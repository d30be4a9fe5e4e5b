"""Fixed entities as relations."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..codecs import DEFAULT, Codec
from ..values import FixedValue, spark_type
from .relation import Relation, col_name

#: Case tables beyond this go through a Parquet table: Spark then knows their size and reads them in parts.
LOCAL_BYTES = 32 << 20


def fixed_relation(
    spark: SparkSession,
    name: str,
    keys: tuple[str, ...],
    rows: Iterable[tuple[tuple[str | None, ...], FixedValue | None]],
    stored: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None,
    codec: Codec = DEFAULT,
) -> Relation:
    """One row for each case: its tokens in the order of ``keys`` and its value (None: the entity is unset there).

    Values that one Spark type holds, be it their codec's, are put in as they are; others as their codec's bytes; a DataFrame
    as the name under which the flow holds it.  The table goes to Spark as Arrow columns: no literal and
    no call for each value.  ``stored`` keeps a large one as Parquet under a name.
    """
    rows = list(rows)
    values = [v for _, v in rows if v is not None]
    kind = spark_type([v.value for v in values]) if values and all(v.codec == "json" for v in values) else None
    frames = any(v.codec == "frame" for v in values)
    typed = codec.spark_type if values and all(v.codec == codec.name for v in values) else None
    v_type = _parse_datatype_string(kind or typed) if kind or typed else T.StringType() if frames or not values else T.BinaryType()
    own = [v for _, v in rows]
    if frames:
        held, codecs = [v and f"fixed:{name}:{v.token}" for v in own], [v and "frame" for v in own]
    elif typed:
        held, codecs = [v and codec.hold(v.value) for v in own], [v and v.codec for v in own]
    elif kind:
        held, codecs = [None if v is None else v.value for v in own], [None] * len(own)
    else:
        held, codecs = [None if v is None else DEFAULT.encode(v.value)[1] if v.data is None else v.data for v in own], [v and v.codec for v in own]
    columns = [*([tokens[k] for tokens, _ in rows] for k in range(len(keys))), [v and v.token for v in own], held, codecs]
    names = [*(col_name("k", k) for k in keys), col_name("h", name), col_name("v", name), col_name("c", name)]
    texts = [T.StringType()] * len(keys) + [T.StringType(), v_type, T.StringType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, texts)])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))], names=names)
    make = lambda: spark.createDataFrame(table, schema)
    if stored is not None and table.nbytes > LOCAL_BYTES:
        digest = hashlib.sha256("\n".join(f"{t}={v and v.token}" for t, v in rows).encode("utf-8", "surrogatepass"))
        return Relation(stored(f"{name}-{digest.hexdigest()[:32]}", make), frozenset(keys), (name,))
    return Relation(make(), frozenset(keys), (name,))
