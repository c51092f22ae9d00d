"""The queries of this package by name, and the SQL of those that SQL can express."""

from . import exact_dedup, jaccard, language_model, line_dedup, media, nbest, packing, quality, sharding, spelling, toxicity, warc, whitening

_MODULES = (toxicity, warc, exact_dedup, quality, packing, sharding, jaccard, media, nbest, line_dedup, whitening, language_model, spelling)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
