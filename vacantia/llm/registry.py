"""The query modules of this subpackage, in the order of their problems."""

from __future__ import annotations

from vacantia.llm import canonical, languages, names, nearcopies, packing, quality, tokens


def modules() -> list:
    """Every module with QUERIES and ORACLES."""
    return [canonical, nearcopies, names, languages, tokens, packing, quality]
