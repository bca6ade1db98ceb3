"""A hit list that follows the journal: each batch is folded in, none is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.operators import hits
from assayframe.streaming.runs import Runs


class ReportFold:
    """Batch operator that keeps one mergeable state per ligand.

    A state holds the best record, the last record, the number of records and the first
    position; the minimum, maximum and sum of such states do not depend on how records
    were dealt over batches, so the report equals the one over the whole journal after
    every batch, in whatever order files came. The batch itself costs its own rows and a
    share of the merges; only ``results`` reads all states, since it lists all of them.

    Records need ``ligand_id``, ``modes``, ``status``, ``seed`` and a unique ``ordinal``.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.runs = Runs(spark, f"{folder}/states", hits.merged_states)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.runs.add(batch_id, hits.ligand_states(hits.scored_records(batch)))

    def results(self, manifest: DataFrame, latest_only: bool = False) -> DataFrame:
        """The ranked hit list of everything folded in so far, ``hits.ranked_hits`` of those records."""
        states = self.runs.current()
        if states is None:
            raise ValueError("no batch was folded in yet")
        return hits.ranked_states(states, manifest, latest_only)
