"""Queries of the corpus operators and their SQL."""

from . import ann, chat, decontaminate, expiring, interactions, jaccard, langid, licenses, packing, quality, secrets, substrings, urls

_MODULES = (substrings, langid, secrets, chat, decontaminate, licenses, ann, jaccard, quality, packing, urls, interactions, expiring)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
