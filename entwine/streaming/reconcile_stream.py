"""Reconciling a stream of queries against a static index.

Ranks and margins need all candidates of a query at once, so each micro-batch runs the batch plan; the index tables are read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from entwine.config import MatchConfig
from entwine.operators.matching import match


def reconcile_stream(queries: DataFrame, names: DataFrame, orgs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: MatchConfig = MatchConfig()) -> StreamingQuery:
    """Start a query that hands each micro-batch's decided candidates to `sink` (with the batch's number, so a repeated batch can be told)."""
    names, orgs = names.persist(), orgs.persist()

    def each(batch: DataFrame, number: int) -> None:
        sink(match(batch, names, orgs, config), number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
