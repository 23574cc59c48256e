"""Registered queries of the training-data operators."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that define ``QUERIES`` and ``ORACLES``.
MODULES = ("simhash", "decontamination", "warc", "embeddings", "substrings", "secrets", "langid", "packing", "chat", "line_dedup")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
