"""Relations of entities.

An entity's relation has one row per case: ``k_<root>`` string columns with the
tokens of the fixed entities it varies with (null: that entity is unset), and
for each entity it carries ``h_`` (the hash that dependents see), ``v_`` (the
value: a Spark type, or a codec's bytes) and ``c_`` (the codec's name; null for
a Spark type, "frame" for the path of a stored DataFrame).  Column names are all
lower case, so that entities whose names differ in case alone have columns of
their own whatever the session's setting is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_name(kind: str, name: str) -> str:
    return f"{kind}_" + re.sub("[A-Z]", lambda m: m[0].lower() + "^", name)


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    keys: frozenset[str]
    entities: tuple[str, ...]

    def key_columns(self) -> list[str]:
        return [col_name("k", k) for k in sorted(self.keys)]

    def columns_of(self, name: str) -> list[str]:
        return [col_name("h", name), col_name("v", name), col_name("c", name)]

    def only(self, *names: str) -> Relation:
        own = [n for n in names if n in self.entities]
        return Relation(self.df.select(*self.key_columns(), *(c for n in own for c in self.columns_of(n))), self.keys, tuple(own))

    def is_typed(self, name: str) -> bool:
        """Whether the value is a Spark type: then there is never a codec's name beside it."""
        return self.df.schema[col_name("v", name)].dataType.typeName() != "binary"


def missing(keys) -> Column:
    """Whether a case has an unset entity."""
    return reduce(lambda a, b: a | b, [F.col(col_name("k", k)).isNull() for k in sorted(keys)], F.lit(False))


def present(relation: Relation) -> Relation:
    return Relation(relation.df.where(~missing(relation.keys)), relation.keys, relation.entities)
