"""Geocoding a stream of queries, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tokoro.config import Config
from tokoro.operators.index import Index
from tokoro.plans.geocode import geocode


def geocode_stream(queries: DataFrame, index: Index, path: str, checkpoint: str, cfg: Config | None = None, model=None):
    """queries: a streaming DataFrame (qid, query). Each micro-batch is geocoded whole (its
    windows need a batch plan) and written under its own number, so that a batch that is
    run again replaces itself. The started query."""

    def batch(rows: DataFrame, number: int) -> None:
        geocode(rows, index, cfg, model).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
