"""All queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import chat, hardneg, linecrf, lm, media, minhash, mixing, packing, quality, ring, tokenstore, toxicity, whitening

MODULES = (media, quality, chat, packing, lm, minhash, tokenstore, toxicity, mixing, ring, linecrf, whitening, hardneg)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
