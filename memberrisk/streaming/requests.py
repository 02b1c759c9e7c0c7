"""Streaming request scoring (§2.10): score requests arriving on a stream.

Each micro-batch is a static DataFrame, so ``foreachBatch`` runs the same
batch decision plan on it (stateless: no streaming state, no watermark is
needed) and upserts the result into the versioned decision table. The
analyzer tables it joins against come from the hub (checkpointed), so a
micro-batch only touches its own requests plus keyed lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from memberrisk.operators import decide as D
from memberrisk.plans.pipeline import Hub
from memberrisk.sources import sinks


def score_batch(h: Hub, requests: DataFrame, analyzers: tuple | None = None) -> DataFrame:
    from memberrisk.plans import q_decide as QD
    return D.decide(QD.assess(h, requests, analyzers or QD.AS.RULES))


def start(h: Hub, stream: DataFrame, table_dir: str, checkpoint_dir: str,
          available_now: bool = True, bundle_dir: str | None = None) -> StreamingQuery:
    """Start the stream -> decisions -> keyed upsert query. With ``bundle_dir`` requests are
    scored with the models saved there; no model is fitted."""
    analyzers = None
    if bundle_dir:
        from memberrisk.operators import bundle
        from memberrisk.plans import analyzer_set
        analyzers = analyzer_set.bundled(bundle.load(h.spark, bundle_dir))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        # A batch that Spark runs again after a failure commits nothing the second time.
        sinks.upsert_table(sinks.decision_records(score_batch(h, batch, analyzers)), table_dir, "scoring_results", (checkpoint_dir, batch_id))

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
