"""The queries of the training-data operators: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from . import decontaminate, jaccard, language, licenses, mixing, quality, repeats, secrets, sharding, toxicity

MODULES = (decontaminate, jaccard, sharding, language, toxicity, quality, repeats, mixing, licenses, secrets)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
