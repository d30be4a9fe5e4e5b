"""Tokens of fixed values: short, filename-safe names; equal values of one type have equal tokens."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import DEFAULT, Codec, content_hash

MAX_TOKEN = 32
_PLAIN = {bool: "bool", int: "int", float: "float", str: "str", bytes: "bytes"}


def _cleaned(text: str) -> str:
    if len(text) <= MAX_TOKEN and text.isascii() and text.isalnum() and text == text.lower():
        return text
    clean = re.sub(r"[^A-Za-z0-9_.-]", ".", text).lower()
    if clean.startswith("."):
        clean = "_" + clean
    if len(clean) > MAX_TOKEN:
        clean = f"{clean[: MAX_TOKEN // 2 - 2]}...{clean[-(MAX_TOKEN // 2 - 1) :]}"
    return clean if clean == text else f"{clean}_{hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()[:10]}"


@dataclass(frozen=True)
class FrameSource:
    """A DataFrame as a fixed value.  With ``version`` the content is not read to name it."""

    df: DataFrame
    version: str | None = None


@dataclass(frozen=True)
class FileSource:
    """The files below a path as a fixed value, named by their paths, sizes and times; their content is not read to name them.

    Functions take it as a DataFrame; a ``rollup`` is given what it has not seen.  ``options`` are the reader's.
    """

    spark: SparkSession
    path: str
    format: str = "parquet"
    schema: str | None = None
    options: tuple[tuple[str, str], ...] = ()

    def files(self) -> DataFrame:
        """``path, length, modified`` of all files; the listing stays with Spark, and no content is read."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.path)
        return listed.select("path", "length", F.col("modificationTime").cast("double").alias("modified"))

    def read(self, paths: list[str] | None = None) -> DataFrame:
        reader = self.spark.read.format(self.format).options(**dict(self.options))
        reader = reader.schema(self.schema) if self.schema else reader
        return reader.load(self.path) if paths is None else reader.option("basePath", self.path).load(paths)


@dataclass(frozen=True)
class FixedValue:
    token: str
    value: Any
    codec: str  # "" for a value that Spark types hold, "frame" for a DataFrame
    data: bytes | None
    source: FileSource | None = None


def fixed(value: Any, codec: Codec) -> FixedValue:
    """The type is part of the token: 1 and "1" differ."""
    if isinstance(value, FileSource):
        from .functions.fingerprint import fingerprint

        return FixedValue(f"files-{fingerprint(value.files())[:16]}", value.read(), "frame", None, value)
    if isinstance(value, DataFrame):
        value = FrameSource(value)
    if isinstance(value, FrameSource):
        from .functions.fingerprint import fingerprint

        token = f"frame-{_cleaned(value.version)}" if value.version is not None else f"frame-{fingerprint(value.df)[:16]}"
        return FixedValue(token, value.df, "frame", None)
    if codec is DEFAULT and type(value) in (bool, int, float, str):  # Spark types hold these: no bytes are made unless they are asked for
        return FixedValue(f"{_PLAIN[type(value)]}-{_cleaned(str(value))}", value, "json", None)
    name, data = codec.encode(value)
    kind = _PLAIN.get(type(value))
    token = f"{kind}-{_cleaned(str(value))}" if kind else f"{name}-{content_hash(name, data)[:20]}"
    return FixedValue(token, value, name, data)


def spark_type(values: list[Any]) -> str | None:
    """The Spark type that holds all the values as they are, if one does."""
    kinds = {type(v) for v in values}
    if kinds == {list}:
        inner = spark_type([x for v in values for x in v])
        return inner and f"array<{inner}>"
    one = kinds.pop() if len(kinds) == 1 else None
    if one is int and any(not -(2**63) <= v < 2**63 for v in values):
        return None
    return {bool: "boolean", int: "long", float: "double", str: "string"}.get(one)
