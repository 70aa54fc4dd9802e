"""Newest state of each document, kept up by a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docquarry.operators.catalog import latest_document_state
from docquarry.streaming.run import fold_batches


def stream_latest_state(log: DataFrame, path: str, checkpoint: str, key: str = "id", *order: str, compact_every: int = 10) -> DataFrame:
    """The batch operator run as a stream: each micro-batch writes the documents it touched.

    Any document may change again, so none may be forgotten; their states lie in files, not in memory.
    """
    newest = lambda rows: latest_document_state(rows, key, *order)
    return fold_batches(log, path, checkpoint, log.schema, newest, newest, compact_every)
