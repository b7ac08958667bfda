"""The ingest as a stream: each micro-batch is one version of the state, and a replayed one changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orbisplit.plans.engine import Engine


def ingest_stream(rows: DataFrame, engine: Engine, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Ingest all that a streaming DataFrame (id, v, …) has now, then stop. Micro-batches run one after the other."""

    def one(df: DataFrame, batch: int) -> None:
        engine.ingest(df, batch_id=f"{name}-{batch}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
