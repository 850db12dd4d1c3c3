"""Registered queries of the operators and the SQL they are checked against."""

from __future__ import annotations

from fleetscope.llm.query_list import corpus, dedup, models, native, texts

QUERIES = {**corpus.QUERIES, **dedup.QUERIES, **models.QUERIES, **native.QUERIES, **texts.QUERIES}
ORACLES = {**corpus.ORACLES, **dedup.ORACLES, **models.ORACLES, **native.ORACLES, **texts.ORACLES}
