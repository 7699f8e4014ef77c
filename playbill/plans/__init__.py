"""Registered queries."""

import importlib

MODULES = ["core", "preference", "parsing", "web", "streams"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
