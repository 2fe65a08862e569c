"""Fetch results as a stream: each micro-batch is merged into the store as one commit, the same merge as the batch path's."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomewise.plans.enrichment import commit_results
from tomewise.plans.views import reader
from tomewise.sources.labels import no_labels
from tomewise.sources.store import Store

#: Deltas of a table that are merged into it.
COMPACT = 50
RESULTS = "asin string, status string, source string, stages string, error string, candidates array<struct<candidate_id:string,search_rank:int,item_xml:string>>"


def merge_stream(spark: SparkSession, store: Store, incoming: str | Path, checkpoint: str | Path, clock: Callable[[], datetime]) -> StreamingQuery:
    """Merge JSON files of results that arrive in a folder. Of several results of a book in one batch a found one counts, then the status that comes first by name.

    A batch that is replayed after a failure replaces the same keys again, so the store comes to the same state."""
    arriving = spark.readStream.schema(RESULTS).json(str(incoming))

    def merge(batch: DataFrame, _: int) -> None:
        rank = F.struct((F.col("status") != "found").alias("other"), F.col("status"), F.col("source"), F.col("stages"), F.col("error"), F.col("candidates"))
        one = batch.where("asin is not null").groupBy("asin").agg(F.min(rank).alias("r")).select("asin", "r.status", "r.source", "r.stages", "r.error", "r.candidates").cache()
        candidates = one.where("status <> 'error'").select("asin", F.inline(F.coalesce("candidates", F.expr("array()").cast("array<struct<candidate_id:string,search_rank:int,item_xml:string>>"))))
        now = clock()
        try:
            commit_results(reader(spark, store, no_labels(spark)), store, one.drop("candidates"), candidates, now, {"bib_metadata": {"last_enrich_at": now}})
        finally:
            one.unpersist()
        if store.deltas() >= COMPACT:
            store.compact(spark)

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
