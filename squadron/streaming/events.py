"""Ordered disturbance events as a stream; the state of a fleet is the version of its plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run_id bigint, event_idx int, place int, ts timestamp"


def disturbance_events(events: DataFrame, first: int = 2) -> DataFrame:
    """(run_id, place, ts, event_id): the first error events, whose place is derived from the user."""
    d = events.where("event_type = 'error'").orderBy("ts", "event_id").limit(first)
    return d.select(F.lit(0).cast("bigint").alias("run_id"), (F.col("user_id") % 20 + 2).cast("int").alias("place"), "ts", "event_id")


def numbered(events: DataFrame) -> DataFrame:
    """Events of a stream with their number within the fleet, and the places that come too late left out.

    A vessel does not go back: an event at a place not after the fleet's last one is dropped. State is one pair of
    integers for each fleet and never expires, as voyages have no bound in time.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["place", "ts", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            if r.place > last:
                n, last = n + 1, int(r.place)
                out.append((key[0], n, last, r.ts))
        state.update((n, last))
        yield pd.DataFrame(out, columns=["run_id", "event_idx", "place", "ts"])

    return events.groupBy("run_id").applyInPandasWithState(step, OUT, "n int, last int", "append", GroupStateTimeout.NoTimeout)


def run_stream(spark: SparkSession, source: DataFrame, checkpoint: str, each) -> None:
    """Feeds every micro-batch of numbered events to ``each`` (such as a replanning fold) until the source is read."""
    q = numbered(source).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
