"""STR1-STR11: streams over the event table, run over what is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.catalog.base import query
from framelake.catalog.views import THUMB_CELLS, thumb_sql, thumbnail
from framelake.catalog.windows import TRACK_SQL
from framelake.session import scratch_path
from framelake.streaming import pairing
from framelake.streaming import stateful as T
from framelake.streaming.common import event_stream, manifest_sink, run_to_table


def device_events(spark, sf):
    """Events as commands and frames: errors start the motion, sign-ups stop it, the rest are frames."""
    c = F.col
    e = event_stream(spark, sf)
    kind = F.when(c("event_type") == "error", "start").when(c("event_type") == "signup", "stop").otherwise("frame")
    return e.select(
        c("user_id").alias("device_id"), (F.unix_micros("ts") * 1000).alias("ns"), c("event_id").alias("seq"), kind.alias("kind"), "ts",
        thumbnail(c("value")).alias("primary"), F.when(c("event_id") % 5 != 0, thumbnail(c("value") + 3)).alias("side"), c("value"), c("event_type"),
        (c("event_type") != "error").alias("selected"), F.when(c("value") < 60, "a").otherwise("b").alias("class_key"),
        (c("value") / 10).alias("x"), F.lit(0.0).alias("y"),
    )


HOUR_MS = 3_600_000
LIMITS = T.InterlockLimits(discard=1, settle_ms=4.0 * HOUR_MS, stable=1, max_motion=17.5, timeout_ms=48.0 * HOUR_MS)
#: No event of the table is late by more.
DELAY = "1 hour"


def gap_sql(a: str, b: str) -> str:
    return f"(list_sum([abs({a}[i + 1] - {b}[i + 1]) for i in range({THUMB_CELLS})]) / {THUMB_CELLS}.0)"


def camera_sql(p: str, picture: str) -> str:
    """Next values of a camera's columns (prefix p) after an event with kind, ns and a picture."""
    waited = f"(e.ns - {p}stop) / 1e6"
    looks = f"(e.kind = 'frame' AND {p}state = 'SETTLING' AND {picture} IS NOT NULL)"
    timed, dropped = f"({looks} AND {waited} > {LIMITS.timeout_ms})", f"({looks} AND {p}seen < {LIMITS.discard})"
    base = f"({looks} AND ({waited} < {LIMITS.settle_ms} OR {p}last IS NULL))"
    calm = f"CASE WHEN {gap_sql(picture, p + 'last')} <= {LIMITS.max_motion} THEN {p}calm + 1 ELSE 0 END"
    begins, stops = "e.kind = 'start'", f"(e.kind = 'stop' AND {p}state = 'MOVING')"
    return f"""CASE WHEN {begins} THEN 'MOVING' WHEN {stops} THEN 'SETTLING' WHEN {timed} OR {dropped} OR {base} OR NOT {looks} THEN {p}state WHEN {calm} >= {LIMITS.stable} THEN 'READY' ELSE {p}state END,
      CASE WHEN {begins} THEN 0 WHEN {stops} THEN e.ns ELSE {p}stop END, CASE WHEN {begins} OR {stops} THEN 0 WHEN {timed} THEN {p}seen WHEN {dropped} THEN {p}seen + 1 ELSE {p}seen END,
      CASE WHEN {begins} OR {stops} THEN 0 WHEN {timed} OR {dropped} OR {base} OR NOT {looks} THEN {p}calm ELSE {calm} END,
      CASE WHEN {begins} OR {stops} THEN NULL WHEN {timed} THEN {p}last WHEN {dropped} THEN NULL WHEN {looks} THEN {picture} ELSE {p}last END,
      CASE WHEN {begins} OR {stops} THEN false WHEN {timed} THEN true WHEN {dropped} OR {base} OR NOT {looks} THEN {p}late WHEN {calm} >= {LIMITS.stable} THEN false ELSE {p}late END"""


CAMERA_COLUMNS = "{p}state, {p}stop, {p}seen, {p}calm, {p}last, {p}late"
FRESH_SQL = "'READY', CAST(0 AS BIGINT), 0, 0, CAST(NULL AS BIGINT[]), false"
#: Events numbered per device, as `device_events` makes them.
EVENT_SQL = f"""e AS (SELECT user_id AS d, epoch_us(ts) * 1000 AS ns, event_id AS seq, CASE event_type WHEN 'error' THEN 'start' WHEN 'signup' THEN 'stop' ELSE 'frame' END AS kind,
  {thumb_sql("value")} AS pic, CASE WHEN event_id % 5 <> 0 THEN {thumb_sql("value + 3")} END AS pic2, event_type <> 'error' AS selected, CASE WHEN value < 60 THEN 'a' ELSE 'b' END AS class_key, value / 10 AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""


@query(
    "str1_pair_stream",
    """WITH p AS (SELECT user_id AS session_id, event_id AS primary_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'),
     s AS (SELECT user_id AS session_id, event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
     j AS (SELECT p.session_id, primary_id, s.id, abs(s.t - p.t) AS gap, s.t AS side_t
           FROM p LEFT JOIN s ON p.session_id = s.session_id AND abs(s.t - p.t) <= 21600000000)
    SELECT session_id, primary_id, first(id ORDER BY gap, side_t, id) AS side_id, min(gap) / 1000.0 AS pair_delta_ms,
     count(id) > 0 AS synchronized FROM j GROUP BY 1, 2""",
)
def _(spark, sf):
    def frames_of(events, kind):
        return events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_id"), "ts")

    limits = {"tolerance": "6 hours", "delay": "12 hours"}
    live = [frames_of(event_stream(spark, sf), kind) for kind in ("click", "view")]
    emitted = run_to_table(pairing.pair_stream(*live, **limits), "pair-stream")
    stored = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return pairing.with_open_primaries(emitted, *[frames_of(stored, kind) for kind in ("click", "view")], **limits)


@query("str2_latest_only", "SELECT user_id AS device_id, max(epoch_us(ts)) * 1000 AS ns FROM events GROUP BY 1")
def _(spark, sf):
    return run_to_table(T.latest_only(device_events(spark, sf)), "latest-only").select("device_id", "ns")


def interlock_sql(dual: bool) -> str:
    cameras = ["a_", "b_"] if dual else ["a_"]
    columns = ", ".join(CAMERA_COLUMNS.format(p=p) for p in cameras)
    nexts = ", ".join(camera_sql(p, picture) for p, picture in zip(cameras, ("e.pic", "e.pic2")))
    paired = "CASE WHEN e.kind = 'frame' THEN e.pic2 IS NOT NULL ELSE paired END" if dual else "false"
    states = "[a_state, CASE WHEN paired THEN b_state ELSE a_state END]" if dual else "[a_state]"
    late = "(a_state = 'SETTLING' AND a_late)" + (" OR (paired AND b_state = 'SETTLING' AND b_late)" if dual else "")
    return f"""WITH RECURSIVE {EVENT_SQL}, w(d, k, seq, kind, paired, {columns}) AS (
       SELECT DISTINCT d, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', {str(dual).lower()}, {", ".join([FRESH_SQL] * len(cameras))} FROM e
       UNION ALL SELECT e.d, e.k, e.seq, e.kind, {paired}, {nexts} FROM w JOIN e ON e.d = w.d AND e.k = w.k + 1),
      s AS (SELECT d, seq, kind, CASE WHEN list_contains({states}, 'MOVING') THEN 'MOVING' WHEN list_contains({states}, 'SETTLING') THEN 'SETTLING' ELSE 'READY' END AS run_state, {late} AS late FROM w WHERE k > 0),
      t AS (SELECT *, CASE run_state WHEN 'MOVING' THEN 'BUSY_MOVING' WHEN 'READY' THEN 'OK' ELSE CASE WHEN late THEN 'MOTION_UNSTABLE' ELSE 'SETTLING' END END AS status FROM s)
    SELECT d AS device_id, seq, kind, run_state, status, CASE status WHEN 'OK' THEN 'ready' WHEN 'BUSY_MOVING' THEN 'tool_moving' WHEN 'SETTLING' THEN 'settling' ELSE 'motion_unstable' END AS reason, run_state = 'READY' AS can_compute FROM t"""


@query("str3_motion_interlock", interlock_sql(False))
def _(spark, sf):
    one = device_events(spark, sf).withColumn("side", F.lit(None).cast("array<bigint>"))
    return T.replay(one, T.interlock_rule(LIMITS), "interlock", delay=DELAY).drop("ns")


@query("str4_dual_interlock", interlock_sql(True))
def _(spark, sf):
    return T.replay(device_events(spark, sf), T.interlock_rule(LIMITS), "dual-interlock", delay=DELAY).drop("ns")


@query(
    "str5_gated_detections",
    f"""WITH RECURSIVE {EVENT_SQL}, w(d, k, seq, kind, selected, class_key, x, same, {CAMERA_COLUMNS.format(p="a_")}) AS (
       SELECT DISTINCT d, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', false, '', 0.0::DOUBLE, '', {FRESH_SQL} FROM e
       UNION ALL SELECT e.d, e.k, e.seq, e.kind, e.selected, e.class_key, e.x, w.a_state, {camera_sql("a_", "e.pic")} FROM w JOIN e ON e.d = w.d AND e.k = w.k + 1),
     g AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY k) AS part FROM w WHERE k > 0),
     r AS (SELECT *, row_number() OVER v AS pos, selected AND coalesce(lag(selected) OVER v AND lag(class_key) OVER v = class_key AND abs(lag(x) OVER v - x) <= 3, false) AS same_place
           FROM g WHERE kind = 'frame' AND a_state = 'READY' WINDOW v AS (PARTITION BY d, part ORDER BY k)),
     n AS (SELECT *, pos - max(CASE WHEN NOT same_place THEN pos END) OVER (PARTITION BY d, part ORDER BY pos) + 1 AS n FROM r)
    SELECT d AS device_id, seq, class_key, selected AND n >= 2 AS selected FROM n""",
)
def _(spark, sf):
    return T.replay(device_events(spark, sf), T.gated_rule(LIMITS), "gated", delay=DELAY).drop("ns")


@query(
    "str6_stability_stream",
    f"""WITH {TRACK_SQL}, l AS (SELECT *, row_number() OVER w AS pos, selected AND coalesce(lag(selected) OVER w AND lag(class_key) OVER w = class_key AND abs(lag(x) OVER w - x) <= 3, false) AS same FROM tr
       WINDOW w AS (PARTITION BY session_id ORDER BY ns, frame_id)),
     s AS (SELECT *, pos - max(CASE WHEN NOT same THEN pos END) OVER (PARTITION BY session_id ORDER BY pos) + 1 AS n FROM l)
    SELECT frame_id AS seq, CAST(CASE WHEN selected THEN n ELSE 0 END AS INT) AS stable_count, selected AND n >= 2 AS stable_selected FROM s""",
    "frames",
)
def _(spark, sf):
    all_frames = device_events(spark, sf).withColumn("kind", F.lit("frame"))
    return T.replay(all_frames, T.stability_rule(), "stability", delay=DELAY).select("seq", "stable_count", "stable_selected")


QUALITY_SQL = f"""th AS (SELECT *, {thumb_sql("value")} AS pic FROM frames), la AS (SELECT *, lag(pic) OVER w AS prev, row_number() OVER w AS pos FROM th WINDOW w AS (PARTITION BY session_id ORDER BY ns, frame_id)),
  l AS (SELECT *, {gap_sql("pic", "prev")} AS motion FROM la),
  s AS (SELECT *, pos - max(CASE WHEN NOT coalesce(motion <= 17.5, false) THEN pos END) OVER (PARTITION BY session_id ORDER BY pos) AS stable_frames FROM l)"""


@query(
    "str7_quality_stream",
    f"""WITH {QUALITY_SQL} SELECT frame_id AS seq, round(motion, 6) AS motion, CAST(stable_frames AS INT) AS stable_frames, concat_ws(',', CASE WHEN stable_frames < 2 THEN 'camera_or_object_moving' END, CASE WHEN value / 60 < 0.85 THEN 'depth_valid_ratio_low' END,
      CASE WHEN value / 2 > 50 THEN 'rgb_depth_out_of_sync' END) AS reasons, stable_frames >= 2 AND value / 60 >= 0.85 AND value / 2 <= 50 AS ready FROM s""",
    "frames",
)
def _(spark, sf):
    e = device_events(spark, sf).withColumns({"picture": F.col("primary"), "valid_ratio": F.col("value") / 60, "sync_ms": F.col("value") / 2})
    counted = T.replay(e, T.quality_rule(max_motion=17.5), "quality", delay=DELAY)
    return T.with_readiness(counted, required=2).select(
        "seq", F.round("motion", 6).alias("motion"), "stable_frames", F.array_join("reasons", ",").alias("reasons"), "ready"
    )


@query(
    "str8_auto_capture",
    """SELECT session_id AS device_id, frame_id AS seq, row_number() OVER (PARTITION BY session_id ORDER BY ns, frame_id) AS capture_index FROM frames WHERE value > 50
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ns, frame_id) <= 5""",
    "frames",
)
def _(spark, sf):
    ready = device_events(spark, sf).withColumn("ready", F.col("value") > 50)
    return T.replay(ready, T.capture_rule(target=5), "auto-capture", delay=DELAY).select("device_id", "seq", "capture_index")


@query("str9_manifest_sink", "SELECT user_id AS device_id, event_id AS seq, event_type AS label_id FROM events WHERE value > 20")
def _(spark, sf):
    accepted = device_events(spark, sf).filter("value > 20").select("device_id", "seq", F.col("event_type").alias("label_id"))
    path = scratch_path(spark, "manifest-sink")
    for _ in range(2):
        manifest_sink(accepted, f"{path}/table", f"{path}/checkpoint", partitions=["label_id"]).awaitTermination()
    return spark.read.schema("device_id bigint, seq bigint, label_id string").json(f"{path}/table")


@query(
    "str10_live_health",
    """SELECT epoch_us(date_trunc('day', ts)) AS window_us, user_id % 10 AS device_id, count(*) AS frames, count(*) FILTER (event_type = 'error') AS failures, round(quantile_cont(value, 0.95), 4) AS p95_ms, max(value) AS max_ms FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    def frames_of(events):
        return events.select("ts", (F.col("user_id") % 10).alias("device_id"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("ok"))

    emitted = run_to_table(pairing.live_health(frames_of(event_stream(spark, sf))), "live-health")
    stored = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return pairing.with_open_windows(emitted, frames_of(stored)).withColumn("p95_ms", F.round("p95_ms", 4))


@query(
    "str11_motion_stretches",
    """WITH c AS (SELECT user_id AS device_id, epoch_us(ts) * 1000 AS ns, event_type = 'error' AS st, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type IN ('error', 'signup')),
     b AS (SELECT device_id, ns, st FROM c WHERE (st AND coalesce(prev, 'signup') = 'signup') OR (NOT st AND prev = 'error')), n AS (SELECT *, lead(ns) OVER (PARTITION BY device_id ORDER BY ns) AS nx FROM b)
    SELECT device_id, ns AS start_ns, nx AS stop_ns FROM n WHERE st AND nx IS NOT NULL""",
)
def _(spark, sf):
    return T.replay(device_events(spark, sf).where("kind <> 'frame'"), T.stretch_rule(), "stretches", delay=DELAY)
