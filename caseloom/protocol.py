"""Codecs under the names used as decorators and arguments."""

from .codecs import AnyOf as combine  # noqa: F401
from .codecs import Category as category  # noqa: F401
from .codecs import Codec  # noqa: F401
from .codecs import Dillable as dillable  # noqa: F401
from .codecs import Enum as enum  # noqa: F401
from .codecs import GeoFrame as geodataframe  # noqa: F401
from .codecs import Image as image  # noqa: F401
from .codecs import Json as json  # noqa: F401
from .codecs import Numpy as numpy  # noqa: F401
from .codecs import PandasFrame as frame  # noqa: F401
from .codecs import Paths as path  # noqa: F401
from .codecs import Picklable as picklable  # noqa: F401
from .codecs import Sets as sets  # noqa: F401
from .codecs import Tensor as tensor  # noqa: F401
from .codecs import Type as type  # noqa: F401
from .codecs import Yaml as yaml  # noqa: F401
