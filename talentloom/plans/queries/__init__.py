"""All registered queries; ``load`` imports the modules that fill the registry."""

from __future__ import annotations

from importlib import import_module

MODULES = ["sources", "texts", "extraction", "matching", "aggregates", "vectors", "sampled", "streams", "reports"]


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
