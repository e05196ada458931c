"""The incremental reducer on a stream of line events.

State is one position's cluster groups, so the stream is keyed by document, page and
line. Each micro-batch takes its events up by time and id; an event that comes in a
later batch than its time is taken up when it comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evenfold.functions import text
from evenfold.operators.plurality import GROUPS, Groups
from evenfold.operators.replay import lines_of

_OUT = "group_id string, page int, line_index int, winner string, largest int, total int"
_STATE = f"groups {GROUPS}"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    groups = Groups([[tuple(m) for m in c] for c in state.get[0]] if state.exists else None)
    rows = sorted((r for b in batches for r in zip(b["timestamp"], b["id"], b["t"], strict=True)))  # one micro-batch of one position
    for _, _, value in rows:
        groups.insert(value)
    state.update((groups.members(),))
    yield pd.DataFrame([(*key, groups.winner(), max(c[2] for c in groups.clusters), sum(c[2] for c in groups.clusters))], columns=["group_id", "page", "line_index", "winner", "largest", "total"])


def positions(events: DataFrame, key: str) -> DataFrame:
    """Streaming positions in update mode: every position that got an event, with its winner by now."""
    lines = lines_of(events, key).where("applied").withColumn("t", text.plain(F.col("text"))).where("t <> ''")
    keyed = lines.select("group_id", "page", "line_index", "timestamp", "id", "t").groupBy("group_id", "page", "line_index")
    return keyed.applyInPandasWithState(_step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def read_events(spark, path: str, schema) -> DataFrame:
    """A stream of the event files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def write_positions(stream: DataFrame, path: str, checkpoint: str):
    """Keeps one folder per micro-batch; a batch that is run again overwrites its own."""

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
