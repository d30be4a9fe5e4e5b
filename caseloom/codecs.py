"""Codecs: what values an entity may have, and their bytes in the store.

A codec is also a decorator of functions and an argument of ``declare`` and
``assign``.  A value goes to the first codec of ``DEFAULT`` that takes it.
"""

from __future__ import annotations

import hashlib
import io
import json as _json
import pickle
import shutil
import tarfile
import tempfile
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from .errors import EntitySerializationError, EntityValueError, UnsupportedSerializedValueError


class Codec:
    """Subclass with ``accepts``, ``dump`` and ``load`` to store values of another kind."""

    name = "base"
    extension = "bin"
    #: The Spark type that holds the values, so that Columns can compute with them; None: they are held as bytes.
    spark_type: str | None = None

    def accepts(self, value: Any) -> bool:
        return True

    def validate(self, value: Any) -> None:
        if not self.accepts(value):
            raise EntityValueError(f"{self.name} does not take {value!r}")

    def dump(self, value: Any) -> bytes:
        raise NotImplementedError

    def load(self, data: bytes) -> Any:
        raise NotImplementedError

    def encode(self, value: Any) -> tuple[str, bytes]:
        """The name under which ``load_as`` finds the codec, and the bytes."""
        self.validate(value)
        try:
            return self.name, self.dump(value)
        except EntityValueError:
            raise
        except Exception as e:
            raise EntitySerializationError(f"{self.name} can't write {value!r}: {e}") from e

    def hold(self, value: Any) -> Any:
        """What Spark holds of a value, beside the codec's name."""
        return self.encode(value)[1]

    def release(self, held: Any) -> Any:
        """The value of what ``hold`` gave."""
        return self.load(bytes(held))

    def written(self, held: Any) -> bytes:
        """The bytes of a file of what ``hold`` gave."""
        return self.dump(self.release(held))

    def __call__(self, function):
        from .decorators import _note

        return _note(function, "codec", self, repeat="outer")

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and vars(self) == vars(other)

    def __hash__(self) -> int:
        return hash((type(self), repr(sorted(map(repr, vars(self).items())))))


class Json(Codec):
    """None, booleans, numbers, strings, and lists and string-keyed dicts of them."""

    name, extension = "json", "json"

    def accepts(self, value):
        if value is None or type(value) in (bool, int, float, str):
            return True
        if type(value) is list:
            return all(map(self.accepts, value))
        return type(value) is dict and all(type(k) is str and self.accepts(v) for k, v in value.items())

    def dump(self, value):
        return _json.dumps(value, sort_keys=False).encode()

    def load(self, data):
        return _json.loads(data)


class Picklable(Codec):
    name, extension = "pickle", "pkl"

    def dump(self, value):
        return pickle.dumps(value, protocol=4)

    def load(self, data):
        return pickle.loads(data)


class Dillable(Codec):
    """What pickle can't take, such as functions of a notebook: by the pickler that comes with Spark."""

    name, extension = "dill", "dill"

    def dump(self, value):
        from pyspark import cloudpickle

        return cloudpickle.dumps(value)

    def load(self, data):
        return pickle.loads(data)


class PandasFrame(Codec):
    """A pandas frame as one Parquet file; ordered categories are kept beside it."""

    name, extension = "pandas", "pq"

    def __init__(self, check_dtypes: bool = True, file_format: str = "parquet"):
        if file_format not in ("parquet", "feather"):
            raise ValueError(f"unknown file format {file_format!r}")
        self.check_dtypes, self.file_format = check_dtypes, file_format

    def accepts(self, value):
        import pandas as pd

        return isinstance(value, pd.DataFrame)

    def validate(self, value):
        super().validate(value)
        if not value.columns.is_unique:
            raise EntitySerializationError("a frame with repeated column names can't be stored")
        if self.file_format == "parquet" and self.check_dtypes and any(str(t) == "category" for t in value.dtypes):
            raise EntitySerializationError("Parquet may lose categories; use frame(check_dtypes=False) or the feather format")

    def dump(self, value):
        out = io.BytesIO()
        if self.file_format == "feather":
            import pyarrow as pa
            import pyarrow.feather as feather

            feather.write_feather(pa.Table.from_pandas(value), out)
        else:
            value.to_parquet(out)
        return out.getvalue()

    def load(self, data):
        if data[:4] == b"PAR1":
            import pandas as pd

            return pd.read_parquet(io.BytesIO(data))
        import pyarrow.feather as feather

        return feather.read_feather(io.BytesIO(data))


class Numpy(Codec):
    name, extension = "numpy", "npy"

    def accepts(self, value):
        import numpy as np

        return isinstance(value, np.ndarray)

    def dump(self, value):
        import numpy as np

        out = io.BytesIO()
        np.save(out, value, allow_pickle=False)
        return out.getvalue()

    def load(self, data):
        import numpy as np

        return np.load(io.BytesIO(data), allow_pickle=False)


#: Spark's type of each element type of a tensor.
ELEMENTS = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double"}


class Tensor(Numpy):
    """An array as ``struct<shape, dtype, data>``: Columns can compute with it, and Python functions get the array.

    ``data`` has the elements row by row.  Arrays of another element type are cast where none of their values
    changes; ``shape``, with None for any length, must be that of the array.
    """

    name = "tensor"

    def __init__(self, dtype: str = "float64", shape: tuple[int | None, ...] | None = None):
        if dtype not in ELEMENTS:
            raise ValueError(f"a tensor's elements are of one of {sorted(ELEMENTS)}, not {dtype!r}")
        self.dtype, self.shape = dtype, shape if shape is None else tuple(shape)
        self.spark_type = f"struct<shape:array<bigint>,dtype:string,data:array<{ELEMENTS[dtype]}>>"

    def _cast(self, value):
        """The array with the codec's elements; None if a value would change."""
        import numpy as np

        if value.dtype == self.dtype:
            return value
        if value.dtype.kind not in "biuf" or not np.can_cast(value.dtype, self.dtype, "same_kind"):
            return None
        with np.errstate(all="ignore"):
            made = value.astype(self.dtype)
            back = made.astype(value.dtype)
        floats = value.dtype.kind == "f"
        same = np.array_equal(made, value, equal_nan=floats) and np.array_equal(back, value, equal_nan=floats)
        return made if same else None

    def accepts(self, value):
        if not super().accepts(value):
            return False
        if self.shape is not None and (len(self.shape) != value.ndim or any(n is not None and n != m for n, m in zip(self.shape, value.shape))):
            return False
        return self._cast(value) is not None

    def dump(self, value):
        return super().dump(self._cast(value))

    def hold(self, value):
        return {"shape": list(value.shape), "dtype": self.dtype, "data": self._cast(value).ravel().tolist()}

    def release(self, held):
        import numpy as np

        return np.array(held["data"], held["dtype"]).reshape(tuple(held["shape"]))

    def written(self, held):
        return super().dump(self.release(held))


class Category(Codec):
    """One of the given labels, in their order, as ``struct<code, label>``: the greatest of a column is the last in that order."""

    name, extension, spark_type = "category", "json", "struct<code:int,label:string>"

    def __init__(self, *labels: str):
        if len(set(labels)) != len(labels) or not all(type(x) is str for x in labels):
            raise ValueError("labels are different strings")
        self.labels = labels

    def accepts(self, value):
        return type(value) is str and (not self.labels or value in self.labels)

    def dump(self, value):
        return _json.dumps(value).encode()

    def load(self, data):
        return _json.loads(data)

    def hold(self, value):
        return {"code": self.labels.index(value), "label": value}

    def release(self, held):
        return held["label"]


class Image(Codec):
    """A PIL image, or PNG bytes where PIL is not installed."""

    name, extension = "image", "png"

    def accepts(self, value):
        try:
            from PIL import Image as pil
        except ImportError:
            pil = None
        png = isinstance(value, bytes) and value[:8] == b"\x89PNG\r\n\x1a\n"
        return png or pil is not None and isinstance(value, pil.Image)

    def dump(self, value):
        if isinstance(value, bytes):
            return value
        out = io.BytesIO()
        value.save(out, format="png")
        return out.getvalue()

    def load(self, data):
        try:
            from PIL import Image as pil
        except ImportError:
            return data
        return pil.open(io.BytesIO(data))


class Sets(Codec):
    """Sets and frozensets; equal sets have equal bytes."""

    name, extension = "set", "setpkl"

    def accepts(self, value):
        return type(value) in (set, frozenset)

    def dump(self, value):
        parts = {pickle.dumps(x, protocol=4) for x in value}
        return pickle.dumps((type(value).__name__, sorted(parts)), protocol=4)

    def load(self, data):
        kind, parts = pickle.loads(data)
        return {"set": set, "frozenset": frozenset}[kind](map(pickle.loads, parts))


class Yaml(Codec):
    name, extension = "yaml", "yaml"

    def __init__(self, **options):
        self.options = options

    def dump(self, value):
        import yaml

        return yaml.safe_dump(value, **self.options).encode()

    def load(self, data):
        import yaml

        return yaml.safe_load(data)


class Paths(Codec):
    """A file or folder that a function wrote; its content is stored.  ``operation``: move or copy."""

    name, extension = "path", "as_path"

    def __init__(self, operation: str = "move"):
        if operation not in ("move", "copy"):
            raise ValueError("operation is 'move' or 'copy'")
        self.operation = operation

    def accepts(self, value):
        return isinstance(value, Path)

    def dump(self, value):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            tar.add(value, arcname=value.name, filter=lambda i: i.replace(mtime=0, uid=0, gid=0, uname="", gname="", deep=False))
        if self.operation == "move":
            shutil.rmtree(value) if value.is_dir() else value.unlink()
        return out.getvalue()

    def load(self, data):
        folder = Path(tempfile.mkdtemp(prefix="caseloom-path-"))
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            tar.extractall(folder, filter="data")
        (found,) = folder.iterdir()
        return found


class GeoFrame(Codec):
    name, extension = "geo", "gpq"

    def accepts(self, value):
        return type(value).__name__ == "GeoDataFrame"

    def dump(self, value):
        out = io.BytesIO()
        value.to_parquet(out)
        return out.getvalue()

    def load(self, data):
        import geopandas

        return geopandas.read_parquet(io.BytesIO(data))


class Enum(Picklable):
    """One of the given values."""

    def __init__(self, *allowed):
        self.allowed = allowed

    def accepts(self, value):
        return value in self.allowed


class Type(Picklable):
    """A value of the given type, as ``isinstance`` has it."""

    def __init__(self, kind: type):
        self.kind = kind

    def accepts(self, value):
        return isinstance(value, self.kind)


class AnyOf(Codec):
    """The first of several codecs that takes the value."""

    name = "any"

    def __init__(self, *codecs: Codec):
        self.codecs = codecs

    def accepts(self, value):
        return any(c.accepts(value) for c in self.codecs)

    def encode(self, value):
        for c in self.codecs:
            if c.accepts(value):
                return c.encode(value)
        raise EntityValueError(f"no codec takes {value!r}")


DEFAULT = AnyOf(Json(), GeoFrame(), PandasFrame(), Image(), Numpy(), Sets(), Picklable())
_BY_NAME = {c.name: c for c in (*DEFAULT.codecs, Dillable(), Yaml(), Paths(), Tensor(), Category())}


def register(codec: Codec) -> Codec:
    """Makes values of a codec of one's own readable: its name must be its own."""
    _BY_NAME[codec.name] = codec
    return codec


def load_as(name: str, data: bytes) -> Any:
    if name not in _BY_NAME:
        raise UnsupportedSerializedValueError(f"no codec is named {name!r}")
    return _BY_NAME[name].load(bytes(data))


def release_as(name: str, held: Any) -> Any:
    """The value of what Spark holds under a codec's name: bytes, or what is of the codec's Spark type."""
    if held is None or isinstance(held, (bytes, bytearray, memoryview)):
        return None if held is None else load_as(name, held)
    if name not in _BY_NAME:
        raise UnsupportedSerializedValueError(f"no codec is named {name!r}")
    return _BY_NAME[name].release(held)


def bytes_of(name: str, held: Any) -> bytes:
    """The bytes of a file of the value."""
    return bytes(held) if isinstance(held, (bytes, bytearray, memoryview)) else _BY_NAME[name].written(held)


def extension_of(name: str) -> str:
    return _BY_NAME[name].extension


def content_hash(name: str, data: bytes) -> str:
    return hashlib.sha256(name.encode() + b"\0" + data).hexdigest()


def distinct(values: Iterable[Any]) -> list[Any]:
    """Values of which no two are equal; they need not be hashable."""
    out: list[Any] = []
    for v in values:
        if not any(type(v) is type(o) and v == o for o in out):
            out.append(v)
    return out
