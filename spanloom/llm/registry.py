"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import benchmarks, languages, licenses, mixing, simhash, sketches, substrings, tokens, toxicity, urls

MODULES = [benchmarks, languages, licenses, mixing, simhash, sketches, substrings, tokens, toxicity, urls]

QUERIES = {m.NAME: m.query for m in MODULES}
ORACLES = {m.NAME: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL}
