"""Registered queries, by family. Importing a module of this package registers its queries."""

import importlib

MODULES = ("language", "ranking", "search", "series", "coverage", "textual", "graphs", "events", "similarity", "headlines", "extraction", "metrics", "sessions", "stories", "composites")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
