"""The queries of this subpackage and their SQL twins, as far as SQL can express them."""

from __future__ import annotations

from tessera.llm import cross_polytope, cube, katz, licenses, ngram_join, nra, packing, shards, toxicity, warc

_MODULES = (katz, ngram_join, cross_polytope, nra, warc, licenses, shards, toxicity, packing, cube)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
