"""Pairing two live streams in time, and rolling health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_stream(primary: DataFrame, side: DataFrame, *, tolerance: str = "50 milliseconds", delay: str = "250 milliseconds") -> DataFrame:
    """Primary frames with the nearest side frame within the tolerance, or none once it can no longer come.

    Both streams: session_id, frame_id, ts. A left outer interval join gives the candidates, a windowed
    aggregate keeps the nearest when the watermark has passed; the earlier side frame wins a tie.
    """
    a = primary.select(
        F.col("session_id"), F.col("frame_id").alias("primary_id"), F.col("ts").alias("primary_ts")
    ).withWatermark("primary_ts", delay)
    b = side.select(
        F.col("session_id").alias("s_session"), F.col("frame_id").alias("side_id"), F.col("ts").alias("side_ts")
    ).withWatermark("side_ts", delay)
    near = F.expr(
        f"session_id = s_session AND side_ts >= primary_ts - INTERVAL {tolerance} AND side_ts <= primary_ts + INTERVAL {tolerance}"
    )
    gap = F.abs(F.unix_micros("side_ts") - F.unix_micros("primary_ts"))
    picked = F.min(F.when(F.col("side_id").isNotNull(), F.struct(gap.alias("gap"), F.unix_micros("side_ts").alias("at"), F.col("side_id").alias("id"))))
    nearest = a.join(b, near, "leftOuter").groupBy(
        F.window("primary_ts", "1 second"), "session_id", "primary_id"
    ).agg(picked.alias("s"))
    return nearest.select(
        "session_id", "primary_id", F.col("s.id").alias("side_id"), (F.col("s.gap") / 1000.0).alias("pair_delta_ms"),
        F.col("s").isNotNull().alias("synchronized"),
    )


def with_open_primaries(emitted: DataFrame, primary: DataFrame, side: DataFrame, **options) -> DataFrame:
    """The pairs of a replay that has ended: those emitted, and the primaries that still waited for the watermark.

    primary and side are the replayed frames as tables; every primary comes out exactly once.
    """
    open_primaries = primary.join(
        emitted.select("session_id", F.col("primary_id").alias("frame_id")), ["session_id", "frame_id"], "left_anti"
    )
    return emitted.unionByName(pair_stream(open_primaries, side, **options))


def live_health(events: DataFrame, *, width: str = "1 day", slide: str | None = None, delay: str = "250 milliseconds", cell_ms: float = 0.01) -> DataFrame:
    """Frames, failures and latency of each device and time window (ts, device_id, latency_ms, ok).

    Two aggregates in a row: latencies are counted per cell of ``cell_ms``, then the 95th percentile is taken over cells and their
    counts. So the state of a window grows with the cells that occur and not with its frames.
    """
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    base = events.withWatermark("ts", delay) if events.isStreaming else events
    cell = F.round(F.col("latency_ms") / cell_ms) * cell_ms
    counted = base.groupBy(span.alias("w"), "device_id", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("bad"), F.max("latency_ms").alias("top")
    )
    return counted.groupBy("w", "device_id").agg(
        F.sum("n").alias("frames"), F.sum("bad").alias("failures"),
        F.percentile("cell", F.lit(0.95), F.col("n")).alias("p95_ms"), F.max("top").alias("max_ms"),
    ).select(F.unix_micros(F.col("w.start")).alias("window_us"), "device_id", "frames", "failures", "p95_ms", "max_ms")


def with_open_windows(emitted: DataFrame, events: DataFrame, **options) -> DataFrame:
    """The windows of a replay that has ended: those emitted, and those that still waited for the watermark."""
    whole = live_health(events, **options)
    return emitted.unionByName(whole.join(emitted.select("window_us", "device_id"), ["window_us", "device_id"], "left_anti"))
