"""Queries of the library on the test tables."""

import importlib

MODULES = ["scoring", "catalogue", "encoding", "pairs", "series", "songs", "logs", "sequences", "files", "streams"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
