"""Stream-static scoring: micro-batches of source records against a static target table, resumable by checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.blocking import candidates, index_targets
from ..operators.matching import MatchingClassifier, matches
from ..operators.records import prepare
from ..sources.staging import stage


def score_stream(stream: DataFrame, targets: DataFrame, model: MatchingClassifier, out: str, checkpoint: str, threshold: float = 0.98):
    """Starts the query; each batch's matches go to a folder of their own in out, which a repeated batch writes anew, so each record counts once. Targets and their index are made once."""
    static = stage(prepare(targets), "targets")
    index = stage(index_targets(static), "index")

    def batch(df: DataFrame, number: int) -> None:
        source = stage(prepare(df), "batch")
        scored = model.score_matches(candidates(source, static, index=index), source, static, threshold)
        matches(scored, source, threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
