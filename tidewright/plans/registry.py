"""All core queries and their SQL, gathered from the modules of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ["packed_queries", "relational", "analytics", "model_queries", "label_queries"]


def _gather(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(f"{__package__}.{m}"), attr)
        if twice := out.keys() & part.keys():
            raise ValueError(f"queries named twice: {sorted(twice)}")
        out |= part
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracles() -> dict:
    return _gather("ORACLE")
