"""All queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.operators import layout, pagework, pairs, relational, rowwork, scoring, segments, store, tablework, telemetry, terms, texts
from quillstream.plans import corpus, dataflow
from quillstream.sources import pages, written
from quillstream.streaming import queries as streams

_MODULES = (segments, store, telemetry, terms, pairs, relational, layout, pagework, rowwork, tablework, scoring, texts, pages, written, streams, dataflow, corpus)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
