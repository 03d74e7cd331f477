"""Gap merge on streams: intervals of a key that follow each other within a gap are one session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, start, end, n): sessions of events no further apart than the gap; on a stream `late` sets the watermark.

    Spark's session window ends one gap after its last event; `end` here is the last event itself.
    """
    known = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = known.groupBy(F.session_window(ts, gap).alias("_w"), key).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "start", "end", "n")


def run_once(stream: DataFrame, sink: str, checkpoint: str, path: str):
    """All that is there now, exactly once, to files at path."""
    return stream.writeStream.format(sink).option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
