"""Helpers for sessions."""

from __future__ import annotations

import logging
import sys


def init_basic_logging(level: int = logging.INFO) -> None:
    """The library's messages (what is computed, what is loaded) on standard error."""
    log = logging.getLogger("caseloom")
    if not log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(level)
