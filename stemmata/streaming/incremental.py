"""Growing collections: new units against a static index, as a stream.

New texts arrive as files; each is cut into units and met with the static right side on rare
bigrams.  The words and bigrams of the right side are written once, before the stream starts;
a micro-batch reads them but cuts only what is new, and its own tables are deleted after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import units as U
from ..operators.shared import release, written
from ..plans.compare import Compare, Side
from ..plans.params import Params


def stream_candidates(stream: DataFrame, right: DataFrame | Side, sink, params: Params = Params(max_candidates=None), checkpoint: str | None = None):
    """Start a query that hands (unit, j, shared) of every micro-batch to ``sink(df, epoch)``.

    ``stream``: (unit, label, text) of new texts; ``right``: units as of ``Compare``.  With the
    default parameters all candidates of a new text are handed over, so the result does not
    depend on how texts fall into batches; a limit would apply to each batch.  Writing by
    epoch makes the hand-over exactly-once for an idempotent sink, which must have used the
    rows when it returns.
    """
    index = right if isinstance(right, Side) else Side(right, params)
    index.bigrams(), index.count()

    def batch(df: DataFrame, epoch: int) -> None:
        before = written(df.sparkSession)
        left = U.tokenised(df, ["unit", "label"], F.col("text"), params)
        sink(Compare(left, index, params).candidates().select(F.col("i").alias("unit"), "j", "shared"), epoch)
        release(df.sparkSession, before)

    w = stream.writeStream.foreachBatch(batch)
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per type and window of event time; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
