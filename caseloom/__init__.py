"""Declarative, parameterised data flows on Spark.

Entities are fixed values, sets of alternative values, or functions of other
entities; a flow expands every entity over its cases by natural joins, gathers
cases back by grouping, and stores results by what they were made from.
"""

from . import protocol, util  # noqa: F401
from .catalog import FlowBuilder  # noqa: F401
from .decorators import (  # noqa: F401
    accepts,
    agg,
    cases,
    changes_per_run,
    docs,
    expr,
    frame,
    gather,
    immediate,
    lifted,
    memoize,
    output,
    outputs,
    persist,
    pyplot,
    returns,
    rollup,
    run_with,
    streamed,
    typed,
    version,
    version_no_warnings,
)
from .flow import Flow  # noqa: F401
from .values import FileSource, FrameSource  # noqa: F401

__version__ = "0.1.0"
