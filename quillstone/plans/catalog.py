"""All registered queries outside the language-model subpackage, with their SQL."""

from __future__ import annotations

from . import answers, documents, graphs, hierarchical, policy, retrieval

_PARTS = (retrieval, documents, graphs, policy, answers, hierarchical)
QUERIES: dict = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
