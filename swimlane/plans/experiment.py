"""More queries of the catalog: an experiment's files and outputs, per-bout figures, models.

Queries about files write them from a table into the shared folder first and read them back.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as G, stimulus as S, text as X
from ..operators import bouts as B, compare as C, frequency as Q, joins as J, stats as T, timeseries as W, trials as R
from ..session import shared_folder
from ..sources import files as files_, sinks as K
from .catalog import _BOUTS, _ST, _TRIALS, _counts, _stim, KEYS, ORDER, SQL, STIM, E, bouts_of, events, query, r6, read, trials_of
from .dims import CATEGORIES, STIM_ID
from .specs import epochs, load_config, spec_table


def folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/query-{uuid.uuid4().hex}"


# per-bout figures ---------------------------------------------------------------------------------

_FRAMES = f"""{E}, f0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS frame FROM e),
f AS (SELECT user_id AS file, frame, frame * 1000000000 AS ts, event_id, event_type, value AS x, CAST(event_id % 100 AS DOUBLE) AS y, value / 50 AS yaw, value - 40 AS axial, 30 - value AS yawspeed,
  sqrt(pow(value - (event_id % 90), 2) + pow(event_id % 100 - event_id % 80, 2)) AS cerr,
  CASE WHEN pow(event_id % 7 - 3.5, 2) + pow(event_id % 5 - 2, 2) > 0 THEN degrees(acos(greatest(-1, least(1, (cos(value) * (event_id % 7 - 3.5) + sin(value) * (event_id % 5 - 2)) / sqrt(pow(event_id % 7 - 3.5, 2) + pow(event_id % 5 - 2, 2)))))) END AS herr FROM f0)"""


def _frames(spark, d) -> DataFrame:
    f = events(spark, d).withColumn("frame", F.row_number().over(W.over(KEYS, ORDER)) - 1)
    m = lambda n: F.pmod("event_id", F.lit(n)).cast("double")
    return f.select(
        F.col("user_id").alias("file"), F.col("frame").cast("long").alias("frame"), (F.col("frame").cast("long") * 1_000_000_000).alias("timestamp"), "event_id", "event_type", F.col("value").alias("x_smooth"), m(100).alias("y_smooth"),
        (F.col("value") / 50).alias("yaw_smooth"), (F.col("value") - 40).alias("axial_speed"), (30 - F.col("value")).alias("yaw_speed"), F.col("value").alias("centroid_x"), m(100).alias("centroid_y"), F.cos("value").alias("pc1_x"), F.sin("value").alias("pc1_y"),
        m(90).alias("bladder_x"), m(80).alias("bladder_y"), (m(90) + m(7) - 3.5).alias("head_x"), (m(80) + m(5) - 2).alias("head_y"),
    )


@query(f"""WITH {_FRAMES},
tr0 AS (SELECT file, frame, ts AS start, lead(ts) OVER (PARTITION BY file ORDER BY frame) AS nx, event_id % 2 AS k, max(ts) OVER (PARTITION BY file) AS mx FROM f WHERE event_type IN ('signup', 'error') QUALIFY true),
tr AS (SELECT file, start, coalesce(nx, mx) AS stop, CASE WHEN k = 0 THEN '90.0' ELSE '270.0' END AS condition, row_number() OVER (PARTITION BY file, k ORDER BY frame) - 1 AS trial_num FROM tr0),
sg AS (SELECT file, frame // 3 AS bout_index, frame AS onset, frame + 2 AS off FROM f WHERE frame % 3 = 0),
st AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM f WINDOW w AS (PARTITION BY file ORDER BY frame)),
b0 AS (SELECT sg.*, a.ts AS t_on, z.ts AS t_off, a.x AS x_on, a.y AS y_on, z.yaw - a.yaw AS heading_change FROM sg JOIN f a ON a.file = sg.file AND a.frame = sg.onset JOIN f z ON z.file = sg.file AND z.frame = sg.off),
b AS (SELECT b0.*, tr.start, tr.condition, tr.trial_num, lag(off) OVER (PARTITION BY b0.file, condition, trial_num ORDER BY onset) AS prev FROM b0 JOIN tr ON b0.file = tr.file AND t_on > tr.start AND t_off < tr.stop),
q AS (SELECT b.file, bout_index, condition, trial_num, coalesce(sum(st.step) FILTER (st.frame > onset), 0) AS distance, arg_max(st.axial, (abs(st.axial), -st.frame)) FILTER (st.frame >= onset) AS pa, arg_max(st.yawspeed, (abs(st.yawspeed), -st.frame)) FILTER (st.frame >= onset) AS py,
  sum(cerr) / any_value(off - coalesce(prev, 0)) AS ca, max(cerr) AS cm, sum(herr) / any_value(off - coalesce(prev, 0)) AS ha, max(herr) AS hm, coalesce(bool_or(herr > 160), false) AS flip
  FROM b JOIN st ON st.file = b.file AND st.frame >= coalesce(prev, 0) AND st.frame < off GROUP BY ALL)
SELECT b.file, b.bout_index, b.condition, CAST(b.trial_num AS BIGINT) AS trial_num, onset AS frame_start, off AS frame_stop, round(1e-9 * (t_on - start), 6) AS trial_time, round(heading_change, 6) AS heading_change, round(q.distance, 6) AS distance,
  round(sqrt(pow(x_on - 50, 2) + pow(y_on - 50, 2)), 6) AS distance_center, round((off - onset) / 2.0, 6) AS bout_duration, round((onset - coalesce(prev, 0)) / 2.0, 6) AS interbout_duration, round(pa, 6) AS peak_axial_speed, round(py, 6) AS peak_yaw_speed,
  round(ca, 6) AS centroid_mismatch_avg, round(cm, 6) AS centroid_mismatch_max, round(ha, 6) AS heading_mismatch_avg, round(hm, 6) AS heading_mismatch_max, flip AS heading_flip
FROM b JOIN q ON b.file = q.file AND b.bout_index = q.bout_index AND b.condition = q.condition AND b.trial_num = q.trial_num""")
def bout_metrics(spark, d):
    f = _frames(spark, d)
    s = f.where(F.col("event_type").isin(STIM)).select("file", F.col("frame").alias("position"), "timestamp", F.lit(STIM_ID["OMR"]).alias("stim_select"), F.when(F.col("event_id") % 2 == 0, 90.0).otherwise(270.0).alias("omr_angle_deg"))
    empty = F.lit(None).cast("array<double>")
    conditions = ("background_color", "foreground_color", "phototaxis_polarity", "okr_speed_deg_per_sec", "prey_arc_start_deg", "prey_arc_stop_deg", "prey_speed_deg_s", "start_time_sec")
    s = s.select("*", *(empty.alias(c) if c.endswith("color") else F.lit(None).cast("double").alias(c) for c in conditions), empty.alias("looming_center_mm"))
    tr = R.from_log(s, s.groupBy("file").agg(F.max("timestamp").alias("last")))
    seg = f.where("frame % 3 = 0").select("file", F.floor(F.col("frame") / 3).alias("bout_index"), F.col("frame").alias("onset"), (F.col("frame") + 2).alias("offset"), F.lit(1).alias("category"), F.lit(1).alias("sign"), F.lit(0.9).alias("proba"))
    one = f.select("file").distinct()
    out = B.metrics(seg, f, tr, f.select("file", "frame", "centroid_x", "centroid_y", "pc1_x", "pc1_y"), f.select("file", "frame", "bladder_x", "bladder_y", "head_x", "head_y"), one.select("file", F.lit(50.0).alias("cx_mm"), F.lit(50.0).alias("cy_mm")), one.select("file", F.lit(2.0).alias("fps")))
    exact = ("trial_time", "heading_change", "distance", "distance_center", "bout_duration", "interbout_duration", "peak_axial_speed", "peak_yaw_speed", "centroid_mismatch_avg", "centroid_mismatch_max", "heading_mismatch_avg", "heading_mismatch_max")
    return out.select("file", "bout_index", "condition", F.col("trial_num").cast("long").alias("trial_num"), "frame_start", "frame_stop", *(r6(F.when(~F.isnan(c), F.col(c)), c) for c in exact), "heading_flip")


@query(f"WITH {_BOUTS} SELECT user_id, event_id, lag(us) OVER (PARTITION BY user_id, stim, trial_num ORDER BY us, event_id) AS off_previous FROM b")
def previous_end_or_null(spark, d):
    return R.previous_end(bouts_of(spark, d), [*KEYS, "stim", "trial_num"], ORDER, "us", None).select("user_id", "event_id", "off_previous")


@query(f"""WITH {_FRAMES}, g AS (SELECT file, frame AS onset, frame + 1 + event_id % 4 AS off, CAST(event_id % 13 AS INTEGER) AS category, CAST(1 - 2 * (event_id % 2) AS INTEGER) AS sign FROM f WHERE frame % 5 = 0)
SELECT f.file, f.frame, g.category, g.sign FROM f LEFT JOIN g ON f.file = g.file AND f.frame >= g.onset AND f.frame < g.off""")
def ethogram(spark, d):
    f = _frames(spark, d)
    m = lambda n: F.pmod("event_id", F.lit(n))
    g = f.where("frame % 5 = 0").select("file", F.col("frame").alias("onset"), (F.col("frame") + 1 + m(4)).alias("offset"), m(13).cast("int").alias("category"), (1 - 2 * m(2)).cast("int").alias("sign"))
    return B.ethogram(f, g)


@query(f"WITH {_FRAMES} SELECT a.file, a.frame AS bout_index, round(z.x / 200, 6) AS proba FROM f a LEFT JOIN f z ON a.file = z.file AND a.frame = z.frame AND z.event_id % 4 <> 0")
def bout_probability(spark, d):
    f = _frames(spark, d).withColumn("bout_index", F.col("frame"))
    p = f.where("event_id % 4 <> 0").select("file", "bout_index", (F.col("x_smooth") / 200).alias("proba"))
    return B.probability(f.select("file", "bout_index"), p).select("file", "bout_index", r6("proba", "proba"))


# angles, units, stimuli ---------------------------------------------------------------------------

_V = "v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings)"


def _vectors(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abcd")))


@query(f"WITH {_V} SELECT vec_id, CASE WHEN a > 0 THEN round(degrees(atan2((a - c) * 1 - (b - d) * 0, (a - c) * 0 + (b - d) * 1)), 6) END AS eye_angle FROM v")
def eye_angle(spark, d):
    return _vectors(spark, d).select("vec_id", r6(G.eye_angle("a", "b", "c", "d", valid=F.col("a") > 0), "eye_angle"))


@query(f"WITH {_V} SELECT vec_id, round(a / 17.5, 9) AS mm, round((a + b) / 2, 9) AS version, round(b - a, 9) AS vergence, round((a - 0.1) * c + (b - 0.2) * d, 9) AS along, round((b - 0.2) * c - (a - 0.1) * d, 9) AS across FROM v")
def coordinates(spark, d):
    version, vergence = G.version_vergence("a", "b")
    along, across = G.egocentric("a", "b", 0.1, 0.2, "c", "d")
    return _vectors(spark, d).select("vec_id", *(F.round(c, 9).alias(n) for c, n in ((G.to_mm("a", 17.5), "mm"), (version, "version"), (vergence, "vergence"), (along, "along"), (across, "across"))))


@query("WITH s AS (SELECT event_id, value, event_id % 251 AS k FROM events) SELECT event_id, round(value * (1 - k / 251) + 7 * (k / 251), 6) AS mixed, round(sin(k) * 43758.5453123 - floor(sin(k) * 43758.5453123), 6) AS hashed, round(10 * (1 - 0.25) + value * 0.25, 6) AS blended FROM s")
def mixing(spark, d):
    k = F.pmod("event_id", F.lit(251))
    return events(spark, d).select("event_id", r6(G.mix("value", 7.0, k / 251), "mixed"), r6(G.hash_unit(k.cast("double")), "hashed"), r6(G.alpha_blend(10.0, "value", F.lit(0.25)), "blended"))


@query(f"WITH {_ST} SELECT event_id, 0.0::DOUBLE AS constant, round(radians(15) + (radians(70) - radians(15)) * (tt - floor(tt / (55 / 20.0)) * (55 / 20.0)) / (55 / 20.0), 5) AS prey_angle FROM q")
def stim_constant_and_angle(spark, d):
    return _stim(spark, d).select("event_id", S.constant("start", "trial").alias("constant"), F.round(S.prey_angle("start", "trial", 15.0, 70.0, 20.0), 5).alias("prey_angle"))


@query("""WITH s AS (SELECT event_id, event_id % 12 AS stim, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
SELECT event_id, CASE WHEN stim = 3 THEN coalesce(v, 10.0) END AS omr_speed_mm_per_sec, CASE WHEN stim = 6 THEN coalesce(v, 360.0) END AS prey_arc_stop_deg, CASE WHEN stim = 5 THEN coalesce(v, 0.5) END AS looming_expansion_time_sec FROM s""")
def stim_defaults(spark, d):
    names = ["omr_speed_mm_per_sec", "prey_arc_stop_deg", "looming_expansion_time_sec"]
    v = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    s = events(spark, d).select("event_id", F.pmod("event_id", F.lit(12)).alias("stim"), *(v.alias(n) for n in names))
    return s.select("event_id", *S.with_defaults(names, F.col("stim"), STIM_ID))


@query("""SELECT event_id, '[' || CAST(round(value, 2) AS VARCHAR) || ', ' || CAST(CAST(event_id % 5 AS DOUBLE) AS VARCHAR) || ']' AS key, coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 5 END, -1) AS second, 7.5::DOUBLE AS third FROM events""")
def list_fields(spark, d):
    second = F.pmod("event_id", F.lit(5)).cast("double")
    e = events(spark, d).select("event_id", F.array(F.col("value"), second).alias("a"), F.when(F.col("event_id") % 2 == 0, F.array(F.col("value"), second)).alias("b"))
    return e.select("event_id", X.list_key(F.col("a"), 2).alias("key"), X.element(F.col("b"), 1, -1.0).cast("long").alias("second"), X.element(F.col("b"), 2, 7.5).alias("third"))


# traces -------------------------------------------------------------------------------------------


@query(f"""WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos, CASE WHEN event_id % 10 >= 4 THEN value END AS v FROM e),
x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pa, last_value(v IGNORE NULLS) OVER b AS va, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS pb, first_value(v IGNORE NULLS) OVER f AS vb
      FROM k WINDOW b AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
y AS (SELECT event_id, CASE WHEN v IS NOT NULL THEN v WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + (vb - va) * (pos - pa) / (pb - pa) END AS l FROM x)
SELECT event_id, round(l, 6) AS left_angle, round(2 * l, 6) AS right_angle FROM y""")
def eye_traces(spark, d):
    p = (F.pmod("event_id", F.lit(10)) / 10 + 0.5).alias("likelihood")
    e = events(spark, d).withColumn("pos", F.row_number().over(W.over(KEYS, ORDER))).select("user_id", "event_id", "pos", F.col("value").alias("left"), (2 * F.col("value")).alias("right"), p)
    return W.eye_traces(e, "left", "right", "likelihood", "likelihood", "pos", KEYS).select("event_id", r6("left", "left_angle"), r6("right", "right_angle"))


@query(f"""WITH {_TRIALS}, tk AS (SELECT user_id, us, max(value) AS x, CAST(max(event_id % 100) AS DOUBLE) AS y FROM e GROUP BY ALL),
sg AS (SELECT t.user_id, t.stim, t.trial_num, tk.us, x, y, x - floor(x / (2 * pi())) * 2 * pi() - pi() AS th FROM tk JOIN t ON tk.user_id = t.user_id AND us BETWEEN start AND stop),
a AS (SELECT *, (us - first_value(us) OVER w) * 1e-6 AS tt, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) / 2 AS step, th - lag(th) OVER w AS dd FROM sg WINDOW w AS (PARTITION BY user_id, stim, trial_num ORDER BY us)),
b AS (SELECT *, sum(coalesce(step, 0)) OVER r AS distance, sqrt(pow(x / 2 - 20, 2) + pow(y / 2 - 20, 2)) AS distance_center, step / nullif(tt - lag(tt) OVER w, 0) AS speed, th + sum(coalesce(-2 * pi() * floor((dd + pi()) / (2 * pi())), 0)) OVER r AS un
      FROM a WINDOW w AS (PARTITION BY user_id, stim, trial_num ORDER BY us), r AS (PARTITION BY user_id, stim, trial_num ORDER BY us ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, un - first_value(un) OVER (PARTITION BY user_id, stim, trial_num ORDER BY us) AS theta FROM b),
v AS (SELECT user_id, stim, trial_num, tt, u.name, u.v FROM c, LATERAL (VALUES ('distance', distance), ('distance_center', distance_center), ('speed', speed), ('theta', theta)) u(name, v) WHERE u.v IS NOT NULL),
g AS (SELECT DISTINCT user_id, stim, trial_num, name, k AS sample, k * 43200.0::DOUBLE AS time FROM c, (SELECT unnest(range(8)) AS k), (SELECT unnest(['distance', 'distance_center', 'speed', 'theta']) AS name)),
p AS (SELECT g.*, v.tt AS ta, v.v AS va FROM g ASOF LEFT JOIN v ON g.user_id = v.user_id AND g.stim = v.stim AND g.trial_num = v.trial_num AND g.name = v.name AND g.time >= v.tt),
q AS (SELECT p.*, v.tt AS tb, v.v AS vb FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.stim = v.stim AND p.trial_num = v.trial_num AND p.name = v.name AND p.time <= v.tt),
z AS (SELECT *, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va WHEN tb = ta THEN va ELSE va + (vb - va) * (time - ta) / (tb - ta) END AS o FROM q)
SELECT user_id, stim, trial_num, CAST(sample AS INTEGER) AS sample, round(max(o) FILTER (name = 'distance'), 5) AS distance, round(max(o) FILTER (name = 'distance_center'), 5) AS distance_center, round(max(o) FILTER (name = 'speed'), 5) AS speed, round(max(o) FILTER (name = 'theta'), 5) AS theta FROM z GROUP BY ALL""")
def time_series(spark, d):
    e = events(spark, d)
    th = (G.floor_mod("x", 2 * math.pi) - math.pi).alias("th")
    tracking = e.groupBy("user_id", "us").agg(F.max("value").alias("x"), F.max(F.pmod("event_id", F.lit(100))).cast("double").alias("y")).select("user_id", "us", "x", "y", th)
    t = W.time_series(tracking, trials_of(e).withColumn("condition", F.lit("c")), KEYS, "us", "x", "y", "th", F.lit(20.0), F.lit(20.0), 0.5, 345600.0, 1 / 43200, 1e-6)
    return t.select("user_id", "stim", "trial_num", "sample", *(F.round(c, 5).alias(c) for c in ("distance", "distance_center", "speed", "theta")))


@query("WITH m AS (SELECT event_id % 30 AS sample, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events) SELECT sample, round(avg(v), 6) AS mean FROM m GROUP BY sample")
def mean_over_traces(spark, d):
    e = events(spark, d).select("event_id", F.pmod("event_id", F.lit(30)).alias("sample"), F.when(F.col("event_id") % 4 != 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("v"))
    return Q.mean_of_means(e, ["sample", "event_id"], ["sample"], "v").select("sample", r6("mean", "mean"))


@query("SELECT event_id, value FROM events WHERE epoch_us(ts) BETWEEN 1704499200000000 AND 1705104000000000 ORDER BY ts, event_id")
def time_slice(spark, d):
    return W.between(events(spark, d), "us", 1704499200000000, 1705104000000000).orderBy("us", "event_id").select("event_id", "value")


@query("SELECT event_id, CASE WHEN value > 90 THEN NULL ELSE value END AS value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id FROM events")
def outliers(spark, d):
    e = W.without_outliers(events(spark, d).select("event_id", "value", "user_id"), F.col("value") > 90, "value")
    kept = W.without_outliers(e.select("user_id", F.col("event_id").alias("_id")), F.col("_id") % 7 == 0).select("user_id").columns
    return e.select("event_id", "value", *(F.when(F.col("event_id") % 7 != 0, F.col(c)).alias(c) for c in kept))


@query(f"WITH {E}, a AS (SELECT user_id, max(us) FILTER (event_type = 'click') AS c, max(us) FILTER (event_type = 'view') AS v FROM e WHERE event_type IN ('click', 'view') GROUP BY 1) SELECT user_id, greatest(c, v) AS last FROM a")
def last_clock(spark, d):
    e = events(spark, d)
    return R.last_clock(e.where("event_type = 'click'"), e.where("event_type = 'view'"), KEYS, "us")


@query(f"WITH {_TRIALS} SELECT user_id, start, stop FROM t WHERE stim = 'error'")
def kept_trials(spark, d):
    s = events(spark, d).where(F.col("event_type").isin(STIM))
    t = R.intervals(s, KEYS, ORDER, "us", F.max("us").over(Window.partitionBy(*KEYS)), F.col("event_type") == "error")
    return t.select("user_id", "start", "stop")


@query(f"WITH {E}, c AS (SELECT *, CASE WHEN event_type IN ('signup', 'error') THEN event_type END AS k FROM e) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY us, event_id) - 1 AS trial_num FROM c WHERE k IS NOT NULL")
def trials_with_a_condition(spark, d):
    e = events(spark, d).withColumn("k", F.when(F.col("event_type").isin(STIM), F.col("event_type")))
    return R.numbered(e, KEYS, "k", ORDER).select("user_id", "event_id", F.col("trial_num").cast("long").alias("trial_num"))


# tables -------------------------------------------------------------------------------------------

_TALL = f"""{_BOUTS}, bb AS (SELECT user_id, event_id % 13 AS category, CASE WHEN sign = 0 THEN -1 ELSE 1 END AS side, trial_num, trial_time FROM b WHERE stim = 'error'),
ep(epoch_num, lo, hi) AS (VALUES (0, 0.0, 7200.0), (1, 3600.0, 10800.0)), pr AS (SELECT DISTINCT user_id FROM bb),
g AS (SELECT * FROM pr, ep, (SELECT unnest([1, 3]) AS trial_num, unnest([0, 1]) AS pos), (SELECT unnest(range(13)) AS category), (SELECT unnest([-1, 1]) AS side)),
fr AS (SELECT g.*, count(bb.user_id) AS n FROM g LEFT JOIN bb ON g.user_id = bb.user_id AND g.trial_num = bb.trial_num AND g.category = bb.category AND g.side = bb.side AND trial_time >= lo AND trial_time < hi GROUP BY ALL)"""


def _rates(spark, d) -> DataFrame:
    b = bouts_of(spark, d).withColumn("category", F.pmod("event_id", F.lit(13)).cast("int")).withColumn("sign", F.when(F.col("sign") == 0, -1).otherwise(1))
    name = F.concat(F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"), F.lit("_07dpf_WT_Fri_10_Oct_2025_"), F.lpad((F.col("user_id") % 24).cast("string"), 2, "0"), F.lit("h35min10sec_fish_"), F.col("user_id").cast("string"))
    config = {"stimuli": [{"stim": "error", "name": "error", "parameters": [{}], "trial_range": {"start": 1, "stop": 5, "step": 2}, "time_bins": [[0, 7200], [3600, 10800]]}]}
    return Q.epoch_frequency(b.withColumn("file", name), epochs(config, {s: s for s in STIM}), list(range(13)), [-1, 1])


@query(f"""WITH {_TALL}
SELECT lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '_07dpf_WT_Fri_10_Oct_2025_' || lpad(CAST(user_id % 24 AS VARCHAR), 2, '0') || 'h35min10sec_fish_' || user_id AS fish, 7 AS dpf, '10.Oct.2025' AS day, round(cos(2 * pi() * (user_id % 24 * 3600 + 2110) / 86400), 6) AS time_of_day_cos,
  round(sin(2 * pi() * (user_id % 24 * 3600 + 2110) / 86400), 6) AS time_of_day_sin, 'error' AS epoch_name, '' AS stim_param, CAST(pos AS INTEGER) AS trial_num, CAST((lo + hi) / 2 AS DOUBLE) AS trial_time, CAST(hi - lo AS DOUBLE) AS time_bin_duration,
  ['{"', '".join(CATEGORIES)}'][category + 1] AS bout_category, side AS bout_side, round(n / (hi - lo), 9) AS bout_frequency, n AS bout_counts, epoch_num FROM fr""")
def tall_table(spark, d):
    t = Q.tall(_rates(spark, d))
    return t.withColumns({"time_of_day_cos": F.round("time_of_day_cos", 6), "time_of_day_sin": F.round("time_of_day_sin", 6), "bout_frequency": F.round("bout_frequency", 9)})


@query(f"WITH {_TALL} SELECT lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || '_07dpf_WT_Fri_10_Oct_2025_' || lpad(CAST(user_id % 24 AS VARCHAR), 2, '0') || 'h35min10sec_fish_' || user_id AS file, epoch_num, CAST(category AS INTEGER) AS category, side AS sign, pos, round(n / (hi - lo), 9) AS rate FROM fr")
def dense_table(spark, d):
    t = Q.dense(_rates(spark, d)).select("file", "epoch_num", "category", "sign", F.posexplode("rates").alias("pos", "rate"))
    return t.withColumn("rate", F.round("rate", 9))


@query("SELECT DISTINCT p_brand AS term, CASE WHEN starts_with(p_brand, 'Brand#1') THEN substr(p_brand, 8) END AS short FROM part")
def term_names(spark, d):
    return read(spark, d, "part").select(F.col("p_brand").alias("term")).distinct().withColumnsRenamed({"term": "name"}).select(F.col("name").alias("term"), X.term_name(F.col("name"), "Brand#1").alias("short"))


@query("""WITH t AS (SELECT CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 'danieau' ELSE event_type END AS condition FROM events)
SELECT condition = 'danieau' AS untreated, condition, count(*) AS n FROM t WHERE condition IS NOT NULL GROUP BY ALL""")
def treated_and_untreated(spark, d):
    t = events(spark, d).select(F.when(F.col("event_type") == "click", "danieau").when(F.col("event_type") != "view", F.col("event_type")).alias("condition"))
    a, b = C.split_treated(t, "condition", "danieau")
    return a.withColumn("untreated", F.lit(True)).unionByName(b.withColumn("untreated", F.lit(False))).groupBy("untreated", "condition").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size < 25 THEN 0 ELSE 1 END, p_partkey) - 1 AS roi_rank FROM part WHERE p_size < 50")
def roi_order(spark, d):
    p = J.point_in_roi(read(spark, d, "part"), [(0, 0, 25, 1e6), (25, 0, 25, 1e6)], "p_size", "p_retailprice").where("roi >= 0")
    return J.roi_order(p, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", F.col("roi_rank").cast("long").alias("roi_rank"))


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id FROM events WHERE event_id IN (SELECT CAST(floor(i * 999 / 9.0) AS BIGINT) FROM range(10) r(i))")
def evenly_spaced(spark, d):
    return C.evenly_spaced(events(spark, d), "event_id", 1000, 10).select("event_id")


@query(f"WITH {_BOUTS}, g AS (SELECT stim, category, count(*) AS n FROM b GROUP BY ALL) SELECT stim, category, n, row_number() OVER (ORDER BY stim, category) AS place FROM g ORDER BY stim, category")
def groups_in_order(spark, d):
    g = bouts_of(spark, d).groupBy("stim", "category").agg(F.count("*").alias("n"))
    # a row a group of stimulus and category, so one partition holds them
    return g.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("stim", "category")).cast("long")).orderBy("stim", "category")


@query("""SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 1 WHEN event_id % 4 = 2 THEN 0 ELSE 0 END AS user_labelled, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS first_is_user,
CASE WHEN event_id % 4 IN (0, 1) THEN CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END END AS x FROM events""")
def label_instances(spark, d):
    point = F.array(F.struct(F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("x"), F.lit(1.0).alias("y")))
    one = lambda predicted: F.struct(F.lit(predicted).alias("predicted"), point.alias("points"))
    k = F.pmod("event_id", F.lit(4))
    f = events(spark, d).select("event_id", F.when(k == 0, F.array(one(False), one(True))).when(k == 1, F.array(one(True), one(False))).when(k == 2, F.array(one(True), one(True))).otherwise(F.slice(F.array(one(True)), 1, 0)).alias("instances"))
    flag = lambda df, name: df.select("event_id", F.lit(1).alias(name))
    p = files_.first_user_instance(f).select("event_id", F.col("points")[0]["x"].alias("x"))
    out = f.select("event_id").join(flag(files_.labelled_suggestions(f.select("event_id"), files_.user_labelled(f), ["event_id"]), "user_labelled"), "event_id", "left")
    out = out.join(flag(files_.first_is_user(f), "first_is_user"), "event_id", "left").join(p, "event_id", "left")
    return out.select("event_id", F.coalesce("user_labelled", F.lit(0)).alias("user_labelled"), F.coalesce("first_is_user", F.lit(0)).alias("first_is_user"), "x")


# files --------------------------------------------------------------------------------------------

_STAMP = "strftime(o_orderdate + to_seconds({s}), '%d_%b_%Y_%Hh%Mmin%Ssec')"
_PATHS = f"""n AS (SELECT o_orderkey AS k, '/d/' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '_07dpf_L' || o_orderkey || '_Fri_' || {_STAMP.format(s="10")} || '.metadata' AS path,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '/d/stim_' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '_07dpf_L' || o_orderkey || '_Fri_' || {_STAMP.format(s="10 + o_orderkey % 60")} || '.json' END AS stim FROM orders WHERE o_orderkey <= 2000)"""


def _paths(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").where("o_orderkey <= 2000")
    stamp = lambda s: F.date_format(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=s), "dd_MMM_yyyy_HH'h'mm'min'ss'sec'")
    stem = lambda s: F.concat(F.lpad((k % 100).cast("string"), 2, "0"), F.lit("_07dpf_L"), k.cast("string"), F.lit("_Fri_"), stamp(s))
    a = o.select(F.concat(F.lit("/d/"), stem(F.lit(10).cast("decimal(18,6)")), F.lit(".metadata")).alias("path"))
    b = o.where(k % 5 != 0).select(F.concat(F.lit("/d/stim_"), stem((k % 60 + 10).cast("decimal(18,6)")), F.lit(".json")).alias("path"))
    return a, b


@query(f"WITH {_PATHS} SELECT path AS metadata, CASE WHEN k % 60 <= 40 THEN stim END AS stimuli FROM n")
def files_of_an_experiment(spark, d):
    a, b = _paths(spark, d)
    every = a.unionAll(b)
    return files_.assemble({"metadata": files_.named(every, "metadata"), "stimuli": files_.named(every, "stimuli")})


@query(f"WITH {_PATHS}, e AS (SELECT path FROM n UNION ALL SELECT stim FROM n WHERE stim IS NOT NULL) SELECT CAST(count(*) FILTER (path NOT LIKE '%.json') AS BIGINT) AS rejected, (SELECT count(*) FROM n WHERE stim IS NULL OR k % 60 > 40) AS missing FROM e")
def files_left_over(spark, d):
    a, b = _paths(spark, d)
    every = a.unionAll(b)
    lost = files_.missing(files_.assemble({"metadata": files_.named(a, "metadata"), "stimuli": files_.named(b, "stimuli")}))
    return files_.rejected(every, "stimuli").agg(F.count("*").alias("rejected")).crossJoin(lost.agg(F.count("*").alias("missing")))


@query(f"""WITH {E} SELECT event_id AS index, us * 1000 AS timestamp, CAST(user_id % 4 AS INTEGER) AS identity, value AS centroid_x, CASE WHEN event_id % 2 = 0 THEN value + 1 END AS centroid_y FROM e""")
def tracking_csv(spark, d):
    at = folder(spark)
    e = events(spark, d).select(F.col("event_id").alias("index"), (F.col("us") * 1000).alias("timestamp"), F.pmod("user_id", F.lit(4)).alias("identity"), F.col("value").alias("centroid_x"), (F.col("value") + 1).alias("centroid_y"), "event_type")
    K.write_csv(e.where("index % 2 = 0"), at)
    K.write_csv(e.where("index % 2 = 1").select("event_type", "identity", "centroid_x", "timestamp", "index"), at, append=True)  # another order, and a column less
    return files_.read_tracking(spark, f"{at}/*.csv").select("index", "timestamp", "identity", "centroid_x", "centroid_y")


@query(f"WITH {E} SELECT event_id AS index, us * 1000 AS timestamp FROM e")
def timestamps_csv(spark, d):
    at = folder(spark)
    K.write_csv(events(spark, d).select((F.col("us") * 1000).alias("timestamp"), F.col("event_id").alias("index")), at)
    return files_.read_timestamps(spark, f"{at}/*.csv").select("index", "timestamp")


@query(f"WITH {E} SELECT row_number() OVER (ORDER BY us, event_id) - 1 AS position, us AS timestamp, CAST(event_id % 12 AS INTEGER) AS stim_select, value AS omr_angle_deg FROM e WHERE event_type = 'signup'")
def stimuli_json(spark, d):
    at = folder(spark)
    s = events(spark, d).where("event_type = 'signup'").select(F.col("us").alias("timestamp"), F.pmod("event_id", F.lit(12)).alias("stim_select"), F.col("value").alias("omr_angle_deg"), "event_id")
    s.orderBy("timestamp", "event_id").select(F.to_json(F.struct("timestamp", "stim_select", "omr_angle_deg")).alias("value")).write.text(at)
    # the log's parts are in order by name; a row a part, so one partition holds them
    above = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    parts = spark.read.text(f"{at}/*.txt").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n")).withColumn("file", files_.file_stem(F.col("path"))).select("file", F.coalesce(above, F.lit(0)).alias("above"))
    return files_.read_stimuli(spark, f"{at}/*.txt").join(F.broadcast(parts), "file").select((F.col("position") + F.col("above")).alias("position"), "timestamp", "stim_select", "omr_angle_deg")


def _metadata(spark, d) -> DataFrame:
    """One document a nation, written and read."""
    at, k = folder(spark), F.col("n_nationkey")
    doc = F.struct(F.struct((k + 0.5).alias("pix_per_mm")).alias("calibration"), F.struct(F.lit(120.0).alias("framerate_value")).alias("camera"), F.struct(F.array(F.array(k, F.lit(0), F.lit(10), F.lit(20)), F.array(k + 10, F.lit(5), F.lit(10), F.lit(20))).alias("ROIs")).alias("identity"))
    read(spark, d, "nation").select(F.to_json(doc).alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(at)
    return files_.read_metadata(spark, at).withColumn("file", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))


@query("SELECT 'n' || n_nationkey AS file, CAST(i AS INTEGER) AS identity, CAST(n_nationkey + 10 * i AS INTEGER) AS x, CAST(5 * i AS INTEGER) AS y, 10 AS w, 20 AS h, n_nationkey + 0.5::DOUBLE AS pix_per_mm, CAST(i AS INTEGER) AS fish_ID FROM nation, (SELECT unnest([0, 1]) AS i)")
def metadata_by_animal(spark, d):
    return K.animal_metadata(_metadata(spark, d)).select("file", "identity", "x", "y", "w", "h", F.col("calibration.pix_per_mm").alias("pix_per_mm"), "fish_ID")


@query("SELECT 'n' || n_nationkey AS file, CAST(i AS INTEGER) AS identity, n_name AS line FROM nation, (SELECT unnest([0, 1]) AS i)")
def log_by_animal(spark, d):
    log = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"), F.col("n_name").alias("line"))
    return K.per_roi(log, K.rois_of(_metadata(spark, d))).select("file", "identity", "line")


@query("SELECT 'n' || CAST(user_id % 25 AS INTEGER) AS file, CAST(event_id % 2 AS INTEGER) AS identity, event_id AS index, round(value - (user_id % 25 + 10 * (event_id % 2)), 6) AS centroid_x, round(value - 5 * (event_id % 2), 6) AS centroid_y FROM events")
def tracking_by_animal(spark, d):
    t = events(spark, d).select(F.concat(F.lit("n"), F.pmod("user_id", F.lit(25)).cast("string")).alias("file"), F.pmod("event_id", F.lit(2)).cast("int").alias("identity"), F.col("event_id").alias("index"), F.col("value").alias("centroid_x"), F.col("value").alias("centroid_y"))
    at = folder(spark)
    K.export({"tracking": K.split_by_roi(t, K.rois_of(_metadata(spark, d))), "left_out": t}, at, ["tracking"])
    K.export({"tracking": t}, at)  # what is there stays
    return spark.read.parquet(f"{at}/tracking").select("file", F.col("identity").cast("int").alias("identity"), "index", r6("centroid_x", "centroid_x"), r6("centroid_y", "centroid_y"))


@query("SELECT event_id AS frame, CASE WHEN event_id % 3 <> 0 THEN value END AS Head_x, CAST(event_id % 50 AS DOUBLE) AS Head_y, 0.5::DOUBLE AS Head_likelihood, CAST(NULL AS DOUBLE) AS Tail_0_x FROM events")
def pose_csv(spark, d):
    at, k = folder(spark), F.col("event_id")
    x = F.coalesce(F.when(k % 3 != 0, F.col("value").cast("string")), F.lit(""))
    rows = events(spark, d).select(F.concat_ws(",", k.cast("string"), x, F.pmod("event_id", F.lit(50)).cast("string"), F.lit("0.5")).alias("value"))
    K.write_lines(rows, at, ["scorer,s,s,s", "bodyparts,Head,Head,Head", "coords,x,y,likelihood"])
    return files_.read_pose(spark, f"{at}/*.txt", ["Head", "Tail_0"]).select("frame", "Head_x", "Head_y", "Head_likelihood", "Tail_0_x")


@query("SELECT CAST(event_id AS VARCHAR) AS time, event_type AS celsius FROM events WHERE event_id < 1000")
def temperature_csv(spark, d):
    at = folder(spark)
    K.write_csv(events(spark, d).where("event_id < 1000").select(F.col("event_id").alias("time"), F.col("event_type").alias("celsius")), at)
    none = files_.read_temperature(spark, f"{at}/none-*.csv")
    return files_.read_temperature(spark, f"{at}/*.csv").unionByName(none, allowMissingColumns=True).select("time", "celsius")


@query("SELECT n_name AS fish, CAST(n_nationkey AS INTEGER) AS n, CASE WHEN n_regionkey < 2 THEN 'WT' ELSE 'mut' END AS line, CASE WHEN n_nationkey % 2 = 0 THEN 'danieau' ELSE 'drug' END AS condition FROM nation")
def datasets(spark, d):
    at, n = folder(spark), read(spark, d, "nation")
    for line, of in (("WT", F.col("n_regionkey") < 2), ("mut", F.col("n_regionkey") >= 2)):
        for condition, part in (("danieau", 0), ("drug", 1)):
            K.write_csv(n.where(of & (F.col("n_nationkey") % 2 == part)).select(F.col("n_name").alias("fish"), F.col("n_nationkey").alias("n")), f"{at}/{line}/{condition}")
    return files_.read_datasets(spark, at, "part-*.csv", "fish string, n int")


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def bout_table(spark, d):
    at = folder(spark)
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    K.write_table(li.where("l_returnflag <> 'R'"), at, ["l_returnflag"])
    K.write_table(li, at, ["l_returnflag"])  # what is there stays
    K.append_table(li.where("l_returnflag = 'R'"), at, ["l_returnflag"])
    return files_.read_bouts(spark, at).select("l_orderkey", "l_linenumber", F.col("l_returnflag").cast("string").alias("l_returnflag"), "l_quantity")


@query("""SELECT * FROM (VALUES (0, 'a', 'omr_angle_deg==90', 0, 0.0::DOUBLE, 5.0::DOUBLE), (0, 'a', 'omr_angle_deg==90', 2, 0.0, 5.0), (1, 'a', '', 0, 0.0, 5.0), (1, 'a', '', 2, 0.0, 5.0), (2, 'b', '', 7, 1.0, 2.5)) t(epoch_num, epoch_name, stim_param, trial_num, lo, hi)""")
def epochs_of_a_file(spark, d):
    import tempfile

    text = "time_bins: [[0, 5]]\nstimuli:\n- {stim: OMR, name: a, parameters: [{omr_angle_deg: {'==': 90}}, {}], trial_range: {start: 0, stop: 4, step: 2}}\n- {stim: DARK, name: b, parameters: [{}], trial_range: {start: 7, stop: 8, step: 1}, time_bins: [[1, 2.5]]}\n"
    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:  # a configuration is the driver's own file
        f.write(text)
        f.flush()
        table = spec_table(spark, epochs(load_config(f.name)))
    return table.select("epoch_num", "epoch_name", "stim_param", F.explode("trials").alias("trial_num"), "lo", "hi")


# models -------------------------------------------------------------------------------------------

#: Two-sided p of a t statistic with whole degrees of freedom, by its finite series.
_P = """CASE WHEN {v} % 2 = 0 THEN 1 - sin(atan(abs({t}) / sqrt({v}))) * list_sum(list_transform(range(0, {v} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + 2 * j * ln(cos(atan(abs({t}) / sqrt({v})))))))
ELSE 1 - 2 / pi() * (atan(abs({t}) / sqrt({v})) + sin(atan(abs({t}) / sqrt({v}))) * cos(atan(abs({t}) / sqrt({v}))) * list_sum(list_transform(range(0, ({v} - 1) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) + 2 * j * ln(cos(atan(abs({t}) / sqrt({v})))))))) END"""


def _p(t: str, v: str) -> str:
    return _P.format(t=t, v=v)


_COUNTS = f"{E}, c AS (SELECT user_id, event_type AS g, CAST(count(*) AS DOUBLE) AS n, (max(us) - min(us) + 1) / 8.64e10 + 1 AS days, avg(value) AS v FROM e GROUP BY ALL), lv AS (SELECT g, row_number() OVER (ORDER BY count(*) DESC, g) AS k, count(*) OVER () AS m FROM c GROUP BY g)"

SQL["linear_model"] = f"""WITH {_COUNTS},
s AS (SELECT g, count(*) AS k, avg(n) AS mn, avg(v) AS mv FROM c GROUP BY g),
x AS (SELECT sum((n - mn) * (v - mv)) / sum(pow(n - mn, 2)) AS b, sum(pow(n - mn, 2)) AS sxx, count(*) AS nn FROM c JOIN s USING (g)),
r AS (SELECT sum(pow(v - mv - b * (n - mn), 2)) / any_value(nn - m - 1) AS s2, CAST(any_value(nn - m - 1) AS BIGINT) AS df FROM c JOIN s USING (g) JOIN lv USING (g), x),
z AS (SELECT s.mv - b * s.mn AS a, s.k, s.mn FROM s JOIN lv USING (g), x WHERE lv.k = lv.m),
o AS (SELECT 'event_type_' || s.g AS term, s.mv - b * s.mn - z.a AS est, sqrt(s2 * (1.0 / s.k + 1.0 / z.k + pow(s.mn - z.mn, 2) / sxx)) AS err, df FROM s JOIN lv USING (g), x, r, z WHERE lv.k < lv.m
  UNION ALL SELECT 'n', b, sqrt(s2 / sxx), df FROM x, r UNION ALL SELECT '(Intercept)', z.a, sqrt(s2 * (1.0 / z.k + z.mn * z.mn / sxx)), df FROM x, r, z)
SELECT term, round(est, 6) AS estimate, round(err, 6) AS std_error, round(est / err, 6) AS statistic, round({_p("(est / err)", "df")}, 6) AS p_value FROM o"""

SQL["poisson_glm"] = f"""WITH {_COUNTS},
s AS (SELECT g, sum(n) AS sn, sum(n) / sum(days) AS rate FROM c GROUP BY g),
dv AS (SELECT 2 * sum(n * ln(n / (rate * days)) - (n - rate * days)) / any_value(nn - m) AS phi, CAST(any_value(nn - m) AS BIGINT) AS df FROM c JOIN s USING (g) JOIN lv USING (g), (SELECT count(*) AS nn FROM c)),
z AS (SELECT s.* FROM s JOIN lv USING (g) WHERE k = m),
o AS (SELECT 'event_type_' || s.g AS term, ln(s.rate / z.rate) AS est, sqrt(phi * (1 / s.sn + 1 / z.sn)) AS err, df, phi FROM s JOIN lv USING (g), z, dv WHERE k < m UNION ALL SELECT '(Intercept)', ln(z.rate), sqrt(phi / z.sn), df, phi FROM z, dv)
SELECT term, round(est, 6) AS estimate, round(err, 6) AS std_error, round(est / err, 4) AS statistic, round({_p("(est / err)", "df")}, 6) AS p_value, round(phi, 6) AS dispersion FROM o"""

SQL["paired_holm"] = f"""WITH w AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS c, avg(value) FILTER (event_type = 'view') AS v, avg(value) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id), x AS (SELECT 'click' AS a, 'view' AS b, c - v AS d FROM w UNION ALL SELECT 'click', 'purchase', c - p FROM w UNION ALL SELECT 'view', 'purchase', v - p FROM w),
t AS (SELECT a, b, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t, count(d) - 1 AS df FROM x GROUP BY ALL), q AS (SELECT a, b, {_p("t", "df")} AS p FROM t), h AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS k, count(*) OVER () AS n FROM q),
m AS (SELECT a, b, p, max(least(1, p * (n - k + 1))) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING) AS ph FROM h)
SELECT a, b, round(p, 6) AS p, round(ph, 6) AS p_holm, CASE WHEN ph < 1e-4 THEN '****' WHEN ph < 1e-3 THEN '***' WHEN ph < 1e-2 THEN '**' WHEN ph < 0.05 THEN '*' ELSE 'ns' END AS stars FROM m"""

SQL["stationary_distribution"] = f"""WITH RECURSIVE {E}, p AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS dst FROM e), n AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL),
m AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) / 2 AS p FROM n UNION ALL SELECT src, src, 0.5 FROM (SELECT DISTINCT src FROM n)),
v(k, c, w) AS (SELECT 0, src, 1.0::DOUBLE / (SELECT count(DISTINCT src) FROM n) FROM (SELECT DISTINCT src FROM n) UNION ALL SELECT any_value(v.k) + 1, m.dst, sum(v.w * m.p) FROM v JOIN m ON v.c = m.src WHERE v.k < 300 GROUP BY m.dst)
SELECT c AS category, round(w, 6) AS weight FROM v WHERE k = 300"""

#: Moments of the 41 places -20 .. 20.
_MOMENTS = tuple(sum(i**k for i in range(-20, 21)) for k in (0, 2, 4))
_FIT = f"""(({_MOMENTS[2]} * s0 - {_MOMENTS[1]} * s2) + (s1 / {_MOMENTS[1]}.0) * u * {_MOMENTS[0] * _MOMENTS[2] - _MOMENTS[1] ** 2} + ({_MOMENTS[0]} * s2 - {_MOMENTS[1]} * s0) * u * u) / {_MOMENTS[0] * _MOMENTS[2] - _MOMENTS[1] ** 2}.0"""
SQL["smoothed"] = f"""WITH {E}, k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM e),
z AS (SELECT *, least(greatest(pos, 21), n - 20) AS mid FROM k),
s AS (SELECT z.event_id, any_value(z.pos - z.mid) AS u, sum(k.value) AS s0, sum((k.pos - z.mid) * k.value) AS s1, sum(pow(k.pos - z.mid, 2) * k.value) AS s2 FROM z JOIN k ON z.user_id = k.user_id AND k.pos BETWEEN z.mid - 20 AND z.mid + 20 WHERE z.n >= 41 GROUP BY z.event_id)
SELECT event_id, round({_FIT}, 6) AS smooth FROM s UNION ALL SELECT event_id, round(value, 6) FROM k WHERE n < 41"""

SQL["spline_model"] = f"""WITH {_COUNTS},
kn AS (SELECT g, min(n) AS k0, quantile_cont(n, 0.5) AS k1, max(n) AS k2, avg(n) AS mu FROM c GROUP BY g),
b AS (SELECT c.g, v, n - mu AS x1, (pow(greatest(n - k0, 0), 3) - pow(greatest(n - k2, 0), 3)) / (k2 - k0) - (pow(greatest(n - k1, 0), 3) - pow(greatest(n - k2, 0), 3)) / (k2 - k1) AS x2 FROM c JOIN kn USING (g)),
a AS (SELECT g, count(*) AS nn, count(*) + 1e-8 AS a00, sum(x1) AS a01, sum(x2) AS a02, sum(x1 * x1) + 1e-8 AS a11, sum(x1 * x2) AS a12, sum(x2 * x2) + 1e-8 AS a22, sum(v) AS y0, sum(x1 * v) AS y1, sum(x2 * v) AS y2 FROM b GROUP BY g),
i AS (SELECT *, a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02) AS det FROM a),
w AS (SELECT *, (a11 * a22 - a12 * a12) / det AS i00, (a02 * a12 - a01 * a22) / det AS i01, (a01 * a12 - a02 * a11) / det AS i02, (a00 * a22 - a02 * a02) / det AS i11, (a01 * a02 - a00 * a12) / det AS i12, (a00 * a11 - a01 * a01) / det AS i22 FROM i),
f AS (SELECT g, nn, i00, i11, i22, i00 * y0 + i01 * y1 + i02 * y2 AS b0, i01 * y0 + i11 * y1 + i12 * y2 AS b1, i02 * y0 + i12 * y1 + i22 * y2 AS b2 FROM w),
r AS (SELECT sum(pow(v - b0 - b1 * x1 - b2 * x2, 2)) / (count(*) - 3 * count(DISTINCT g)) AS s2 FROM b JOIN f USING (g))
SELECT g AS event_type, t.term, round(t.est, 6) AS estimate, round(sqrt(s2 * t.u), 6) AS std_error FROM f, r, LATERAL (VALUES ('(Intercept)', b0, i00), ('s(n).1', b1, i11), ('s(n).2', b2, i22)) t(term, est, u)"""


@query(f"""WITH {_COUNTS}, s AS (SELECT g, avg(n) AS mn, avg(v) AS mv FROM c GROUP BY g), x AS (SELECT sum((n - mn) * (v - mv)) / sum(pow(n - mn, 2)) AS b FROM c JOIN s USING (g))
SELECT user_id, g AS event_type, round(mv + b * (n - mn), 6) AS prediction, round(v - mv - b * (n - mn), 6) AS residual FROM c JOIN s USING (g), x""")
def fitted_and_residuals(spark, d):
    c = _counts(spark, d)
    _, model = T.linear_model(c, "value ~ event_type + n")
    return T.residuals(model, c, "value ~ event_type + n", "value").select("user_id", "event_type", r6("prediction", "prediction"), r6("residual", "residual"))


@query("""WITH p AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(event_id % 10) AS DOUBLE) AS sx, sum(value) AS sy, CAST(sum(pow(event_id % 10, 2)) AS DOUBLE) AS xx, sum(event_id % 10 * value) AS xy, sum(value * value) AS yy FROM events WHERE value IS NOT NULL GROUP BY user_id),
w AS (SELECT sum(xx - sx * sx / n) AS wxx, sum(xy - sx * sy / n) AS wxy, sum(yy - sy * sy / n) AS wyy, sum(n) AS nn, count(*) AS k, sum(sx) AS tx, sum(sy) AS ty, sum(xx) AS txx, sum(xy) AS txy, sum(yy) AS tyy, sum(n * n) AS m0, sum(n * sx) AS m1, sum(sx * sx) AS m2 FROM p),
v AS (SELECT (wyy - wxy * wxy / wxx) / (nn - k - 1) AS s2, nn * txx - tx * tx AS det, * FROM w),
o AS (SELECT *, tyy - (ty * (txx * ty - tx * txy) + txy * (nn * txy - tx * ty)) / det AS rss, (txx * m0 - 2 * tx * m1 + nn * m2) / det AS tr FROM v),
t AS (SELECT s2, greatest(0, (rss - (nn - 2) * s2) / (nn - tr)) AS t2 FROM o),
g AS (SELECT any_value(s2) AS s2, any_value(t2) AS t2, sum(n - c * n * n) AS a0, sum(sx - c * n * sx) AS a1, sum(xx - c * sx * sx) AS a2, sum(sy - c * n * sy) AS r0, sum(xy - c * sx * sy) AS r1 FROM (SELECT p.*, s2, t2, t2 / (s2 + n * t2) AS c FROM p, t)),
f AS (SELECT *, a0 * a2 - a1 * a1 AS d FROM g)
SELECT u.term, round(u.b, 5) AS estimate, round(u.e, 6) AS std_error, round(t2, 4) AS subject_var, round(s2, 4) AS residual_var FROM f, LATERAL (VALUES ('(Intercept)', (a2 * r0 - a1 * r1) / d, sqrt(s2 * a2 / d)), ('x', (a0 * r1 - a1 * r0) / d, sqrt(s2 * a0 / d))) u(term, b, e)""")
def mixed_model(spark, d):
    m = T.mixed_model(events(spark, d).withColumn("x", F.pmod("event_id", F.lit(10))), "user_id", "value", ["x"])
    return m.select("term", F.round("estimate", 5).alias("estimate"), r6("std_error", "std_error"), F.round("subject_var", 4).alias("subject_var"), F.round("residual_var", 4).alias("residual_var"))


@query(f"""WITH {_COUNTS}, s AS (SELECT g, avg(v) AS mv, avg(n) AS mn FROM c GROUP BY g), x AS (SELECT sum((n - mn) * (v - mv)) / sum(pow(n - mn, 2)) AS b FROM c JOIN s USING (g)),
r AS (SELECT sum(pow(v - mv, 2)) AS r0, sum(pow(v - mv - b * (n - mn), 2)) AS r1, count(*) - any_value(m) - 1 AS df FROM c JOIN s USING (g) JOIN lv USING (g), x)
SELECT round((r0 - r1) / (r1 / df), 5) AS f, 1 AS extra FROM r""")
def nested_models(spark, d):
    c = _counts(spark, d)
    f, _, extra = T.nested_anova(T.linear_model(c, "value ~ event_type")[1], T.linear_model(c, "value ~ event_type + n")[1])
    return spark.createDataFrame([(round(f, 5), int(extra))], "f double, extra int")
