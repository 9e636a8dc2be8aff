"""Queries over the driver's tables that run the engine's operators, each with the same result in DuckDB's SQL where SQL has one.

``events`` stands for frames and bouts (``user_id`` the recording, ``signup`` and
``error`` the stimuli), ``lineitem`` for a bout table, ``orders`` with customers and
nations for trial averages by line and condition.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import geometry as G, stimulus as S, text as X
from ..operators import compare as C, frequency as Q, joins as J, stats as T, timeseries as W, transitions as N, trials as R
from .rules import Rule, RuleSet, apply, funnel, parse
from .specs import epochs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time in microseconds."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", us.alias("us"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


KEYS, ORDER = ["user_id"], ["us", "event_id"]
E = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us FROM events)"
STIM = ["signup", "error"]


def trials_of(e: DataFrame) -> DataFrame:
    s = e.where(F.col("event_type").isin(STIM)).select("user_id", F.col("event_type").alias("stim"), "us", "event_id")
    t = R.intervals(s, KEYS, ORDER, "us", F.max("us").over(Window.partitionBy(*KEYS)))
    return R.numbered(t, KEYS, "stim", ORDER).select("user_id", "stim", "start", "stop", F.col("trial_num").cast("long").alias("trial_num"))


_TRIALS = f"""{E},
s AS (SELECT user_id, event_type AS stim, us, event_id, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nx, max(us) OVER (PARTITION BY user_id) AS mx
      FROM e WHERE event_type IN ('signup', 'error')),
t AS (SELECT user_id, stim, us AS start, coalesce(nx, mx) AS stop, row_number() OVER (PARTITION BY user_id, stim ORDER BY us, event_id) - 1 AS trial_num FROM s)"""


@query(f"WITH {_TRIALS} SELECT * FROM t")
def trials(spark, d):
    return trials_of(events(spark, d))


def bouts_of(spark, d) -> DataFrame:
    e = events(spark, d)
    b = e.where(~F.col("event_type").isin(STIM))
    b = J.contained_once(b, trials_of(e), KEYS, "us", "us", "start", "stop")
    return b.select("value", "user_id", "event_id", "us", F.col("event_type").alias("category"), F.pmod("event_id", F.lit(2)).cast("int").alias("sign"), "stim", "trial_num", ((F.col("us") - F.col("start")) / 1e6).alias("trial_time"))


_BOUTS = f"""{_TRIALS},
b AS (SELECT e.user_id, e.event_id, e.us, e.event_type AS category, CAST(e.event_id % 2 AS INTEGER) AS sign, t.stim, t.trial_num, (e.us - t.start) / 1e6 AS trial_time
      FROM e JOIN t ON e.user_id = t.user_id AND e.us > t.start AND e.us < t.stop WHERE e.event_type NOT IN ('signup', 'error'))"""


@query(f"WITH {_BOUTS} SELECT user_id, event_id, stim, trial_num, trial_time, coalesce(lag(us) OVER (PARTITION BY user_id, stim, trial_num ORDER BY us, event_id), 0) AS off_previous FROM b")
def bout_in_trial(spark, d):
    return R.previous_end(bouts_of(spark, d), [*KEYS, "stim", "trial_num"], ORDER, "us").select("user_id", "event_id", "stim", "trial_num", "trial_time", "off_previous")


_XY = f"{E}, x AS (SELECT *, value AS x, CAST(event_id % 100 AS DOUBLE) AS y FROM e), st AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM x WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))"


def steps(spark, d) -> DataFrame:
    w = W.over(KEYS, ORDER)
    e = events(spark, d).withColumn("x", F.col("value")).withColumn("y", F.pmod("event_id", F.lit(100)).cast("double"))
    return e.withColumn("step", W.step_distance("x", "y", w))


@query(f"WITH {_XY} SELECT event_id, round(step, 6) AS step FROM st")
def step_distance(spark, d):
    return steps(spark, d).select("event_id", r6("step", "step"))


@query(f"WITH {_XY} SELECT event_id, round(sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 4) AS distance FROM st")
def cumulative_distance(spark, d):
    return steps(spark, d).select("event_id", F.round(W.cumulative(F.col("step"), W.over(KEYS, ORDER)), 4).alias("distance"))


@query(f"WITH {_XY} SELECT event_id, round(step / nullif((us - lag(us) OVER w) / 1e6, 0), 6) AS speed, round((us - first_value(us) OVER w) / 1e6, 6) AS seconds FROM st WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)")
def speed(spark, d):
    w = W.over(KEYS, ORDER)
    x = steps(spark, d).withColumn("seconds", W.relative_seconds("us", w, 1e-6))
    return x.select("event_id", r6(W.speed(F.col("step"), F.col("seconds"), w), "speed"), r6("seconds", "seconds"))


@query(f"WITH {_XY} SELECT user_id, round(coalesce(sum(step), 0), 4) AS distance FROM st GROUP BY user_id")
def path_length(spark, d):
    from ..operators.bouts import path_length as total

    return steps(spark, d).groupBy("user_id").agg(F.round(total(F.col("step"), F.lit(True)), 4).alias("distance"))


@query(f"WITH {_XY} SELECT event_id, round(sqrt(pow(x - 50, 2) + pow(y - 50, 2)), 6) AS distance_center FROM x")
def radial_distance(spark, d):
    return steps(spark, d).select("event_id", r6(G.distance("x", "y", 50.0, 50.0), "distance_center"))


@query(f"WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM e) SELECT user_id, event_id, event_type FROM n WHERE k <= 3")
def first_n_per_group(spark, d):
    return W.first_n(events(spark, d), KEYS, ORDER, 3).select("user_id", "event_id", "event_type")


_MEANS = "m AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL)"


@query(f"WITH {_MEANS} SELECT event_type, round(avg(m), 6) AS mean FROM m GROUP BY event_type")
def mean_of_means(spark, d):
    return Q.mean_of_means(events(spark, d), ["event_type", "user_id"], ["event_type"], "value").select("event_type", r6("mean", "mean"))


@query(f"WITH {_MEANS} SELECT event_type, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem, round(stddev_samp(m), 6) AS std FROM m GROUP BY event_type")
def sem_by_group(spark, d):
    return W.mean_and_sem(events(spark, d), ["event_type", "user_id"], ["event_type"], "value").select("event_type", *(r6(c, c) for c in ("mean", "sem", "std")))


@query("WITH s AS (SELECT event_id, 2 * pi() * (epoch_us(ts) // 1000000 % 86400) / 86400 AS a FROM events) SELECT event_id, round(cos(a), 6) AS time_of_day_cos, round(sin(a), 6) AS time_of_day_sin FROM s")
def cosinor(spark, d):
    c, s = G.cosinor(F.pmod(F.floor(F.col("us") / 1000000), F.lit(86400)))
    return events(spark, d).select("event_id", r6(c, "time_of_day_cos"), r6(s, "time_of_day_sin"))


_NEXT = f"{E}, p AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS dst FROM e), n AS (SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_NEXT} SELECT * FROM n")
def transition_counts(spark, d):
    return N.counts(events(spark, d), KEYS, ORDER, "event_type")


@query(f"WITH {_NEXT} SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 6) AS p FROM n")
def transition_prob(spark, d):
    return N.probabilities(transition_counts(spark, d)).select("src", "dst", "n", r6("p", "p"))


@query()
def stationary_distribution(spark, d):
    p = N.probabilities(transition_counts(spark, d)).cache()
    out = N.stationary(p, [r.src for r in p.select("src").distinct().orderBy("src").collect()])
    return out.select("category", r6("weight", "weight"))


RULES = {"l_quantity": {"<": 25, ">=": 3}, "l_returnflag": {"in": ["A", "N"]}, "l_linestatus": {"!=": "F"}, "l_discount": {"not_in": [0.05]}}


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 25 AND l_quantity >= 3 AND l_returnflag IN ('A', 'N') AND l_linestatus <> 'F' AND l_discount <> 0.05")
def rule_filter(spark, d):
    return apply(read(spark, d, "lineitem"), parse(RULES)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END IS DISTINCT FROM 'A' GROUP BY 1")
def not_in_rule(spark, d):
    li = read(spark, d, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
    return apply(li, RuleSet((Rule("flag", "not_in", ["A"]),))).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_quantity < 25 AS a, l_quantity >= 3 AS b, l_returnflag IN ('A', 'N') AS c, l_linestatus <> 'F' AS d, l_discount <> 0.05 AS e FROM lineitem),
g AS (SELECT count(*) AS n, count_if(NOT a) AS r0, count_if(a AND NOT b) AS r1, count_if(a AND b AND NOT c) AS r2, count_if(a AND b AND c AND NOT d) AS r3, count_if(a AND b AND c AND d AND NOT e) AS r4 FROM f)
SELECT CAST(u.step AS INTEGER) AS step, u.rule, CAST(u.removed AS BIGINT) AS removed, round(u.removed / n, 6) AS fraction FROM g, LATERAL (VALUES (0, 'l_quantity<25', r0), (1, 'l_quantity>=3', r1), (2, 'l_returnflagin[''A'', ''N'']', r2), (3, 'l_linestatus!=F', r3), (4, 'l_discountnot_in[0.05]', r4)) u(step, rule, removed)""")
def filter_funnel(spark, d):
    return funnel(read(spark, d, "lineitem"), parse(RULES)).select("step", "rule", "removed", r6("fraction", "fraction"))


EPOCHS = {
    "stimuli": [
        {"stim": "error", "name": "error", "parameters": [{}], "trial_range": {"start": 0, "stop": 5, "step": 1}, "time_bins": [[0, 7200], [3600, 10800]]},
        {"stim": "signup", "name": "signup", "parameters": [{"value": {">=": 20}}, {}], "trial_range": {"start": 0, "stop": 5, "step": 1}, "time_bins": [[0, 86400]]},
    ]
}
CATS = ["click", "purchase", "view"]
_FREQ = f"""{_BOUTS}, bv AS (SELECT b.*, e.value FROM b JOIN e USING (event_id)),
sp(epoch_num, stim, lo, hi, least) AS (VALUES (0, 'error', 0.0, 7200.0, -1e9), (1, 'error', 3600.0, 10800.0, -1e9), (2, 'signup', 0.0, 86400.0, 20.0), (3, 'signup', 0.0, 86400.0, -1e9)),
m AS (SELECT bv.user_id, sp.*, bv.trial_num, bv.category, bv.sign, bv.trial_time FROM bv JOIN sp ON bv.stim = sp.stim AND bv.value >= sp.least),
pr AS (SELECT DISTINCT user_id, epoch_num, lo, hi FROM m),
g AS (SELECT pr.*, k.trial_num, c.category, s.sign FROM pr CROSS JOIN (SELECT unnest(range(5)) AS trial_num) k CROSS JOIN (SELECT unnest(['click', 'purchase', 'view']) AS category) c CROSS JOIN (SELECT unnest([0, 1]) AS sign) s),
ct AS (SELECT user_id, epoch_num, trial_num, category, sign, count(*) AS n FROM m WHERE trial_time >= lo AND trial_time < hi GROUP BY ALL),
fr AS (SELECT g.user_id AS file, g.epoch_num, g.trial_num, g.category, g.sign, coalesce(ct.n, 0) AS bout_counts, coalesce(ct.n, 0) / (g.hi - g.lo) AS f
       FROM g LEFT JOIN ct ON g.user_id = ct.user_id AND g.epoch_num = ct.epoch_num AND g.trial_num = ct.trial_num AND g.category = ct.category AND g.sign = ct.sign)"""


def _frequency(spark, d) -> DataFrame:
    return Q.epoch_frequency(bouts_of(spark, d), epochs(EPOCHS, {s: s for s in STIM}), CATS, [0, 1], file="user_id")


@query(f"WITH {_FREQ} SELECT file, CAST(epoch_num AS INTEGER) AS epoch_num, CAST(trial_num AS INTEGER) AS trial_num, category, CAST(sign AS INTEGER) AS sign, bout_counts, round(f, 9) AS bout_frequency FROM fr")
def epoch_frequency(spark, d):
    return _frequency(spark, d).select("file", "epoch_num", "trial_num", "category", "sign", "bout_counts", F.round("bout_frequency", 9).alias("bout_frequency"))


@query(f"WITH {_FREQ}, a AS (SELECT epoch_num, category, sign, file, avg(f) AS f FROM fr GROUP BY ALL) SELECT CAST(epoch_num AS INTEGER) AS epoch_num, category, CAST(sign AS INTEGER) AS sign, round(avg(f), 9) AS mean_frequency FROM a GROUP BY ALL")
def epoch_heatmap(spark, d):
    return Q.heatmap(_frequency(spark, d)).select("epoch_num", "category", "sign", F.round("mean_frequency", 9).alias("mean_frequency"))


@query(f"WITH {_BOUTS}, n AS (SELECT stim, category, sign, count(*) AS n FROM b GROUP BY ALL) SELECT stim, category, sign, n, round(n / sum(n) OVER (PARTITION BY stim), 6) AS share FROM n")
def epoch_share(spark, d):
    return Q.share(bouts_of(spark, d), ["stim"], ["category", "sign"]).select("stim", "category", "sign", "n", r6("share", "share"))


@query(f"WITH {E}, s AS (SELECT user_id, us, max(event_type) AS state FROM e WHERE event_type IN ('signup', 'error') GROUP BY ALL) SELECT e.event_id, s.state FROM e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.us >= s.us")
def asof_state(spark, d):
    e = events(spark, d)
    s = e.where(F.col("event_type").isin(STIM)).select("user_id", F.col("us").alias("t"), F.col("event_type").alias("state"))
    return J.as_of(e.select("event_id", "user_id", "us"), s, KEYS, "us", "t", ["state"]).select("event_id", "state")


@query(f"""WITH {E}, l AS (SELECT event_id, user_id, us FROM e WHERE event_type = 'purchase'), r AS (SELECT user_id, us, event_id AS k FROM e WHERE event_type <> 'purchase'),
x AS (SELECT l.event_id, r.k, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.us - l.us), r.k) AS n FROM l JOIN r USING (user_id))
SELECT l.event_id, x.k AS nearest FROM l LEFT JOIN x ON l.event_id = x.event_id AND x.n = 1""")
def nearest_frame(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    right = e.where("event_type <> 'purchase'").select("user_id", F.col("us").alias("t"), F.col("event_id").alias("k"))
    return J.nearest(left, right, KEYS, "us", "t", "k").select("event_id", "nearest")


@query(f"WITH {E}, s AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS v FROM e) SELECT user_id, arg_max(v, (abs(v), -event_id)) AS peak FROM s GROUP BY user_id")
def peak_signed(spark, d):
    from ..operators.bouts import signed_peak

    v = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    return events(spark, d).groupBy("user_id").agg(signed_peak(v, F.col("event_id")).alias("peak"))


@query(f"""WITH {E}, h AS (SELECT user_id, cos(value) AS a, sin(value) AS b, event_id % 7 - 3.5 AS c, event_id % 5 - 2 AS d FROM e),
x AS (SELECT user_id, degrees(acos(greatest(-1, least(1, (a * c + b * d) / sqrt(c * c + d * d))))) AS g FROM h)
SELECT user_id, round(sum(g) / 100, 6) AS heading_mismatch_avg, round(max(g), 6) AS heading_mismatch_max, bool_or(g > 160) AS heading_flip FROM x GROUP BY user_id""")
def mismatch_qc(spark, d):
    from ..operators.bouts import quality

    e = G.angle_error(F.cos("value"), F.sin("value"), F.pmod("event_id", F.lit(7)) - 3.5, F.pmod("event_id", F.lit(5)) - 2)
    x = events(spark, d).groupBy("user_id").agg(*quality(e, F.lit(100), "heading_mismatch", 160.0))
    return x.select("user_id", r6("heading_mismatch_avg", "heading_mismatch_avg"), r6("heading_mismatch_max", "heading_mismatch_max"), "heading_flip")


@query(f"""WITH {E}, a AS (SELECT *, (value - floor(value / (2 * pi())) * 2 * pi()) - pi() AS th FROM e),
s AS (SELECT *, th - lag(th) OVER w AS dd FROM a WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
u AS (SELECT *, th + sum(coalesce(-2 * pi() * floor((dd + pi()) / (2 * pi())), 0)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS un FROM s)
SELECT event_id, round(un - first_value(un) OVER (PARTITION BY user_id ORDER BY us, event_id), 6) AS unwrapped FROM u""")
def unwrap_angle(spark, d):
    e = events(spark, d).withColumn("th", G.floor_mod("value", 2 * math.pi) - math.pi)
    return W.unwrapped(e, "th", KEYS, ORDER).select("event_id", r6("unwrapped", "unwrapped"))


@query(f"""WITH {E}, p AS (SELECT user_id, (us - min(us) OVER (PARTITION BY user_id)) / 1e6 AS t, value FROM e),
q AS (SELECT user_id, t, max(value) AS value FROM p GROUP BY ALL),
g AS (SELECT user_id, k AS sample, k * 86400.0 AS time FROM (SELECT DISTINCT user_id FROM q), (SELECT unnest(range(25)) AS k)),
a AS (SELECT g.*, q.t AS ta, q.value AS va FROM g ASOF LEFT JOIN q ON g.user_id = q.user_id AND g.time >= q.t),
b AS (SELECT a.*, q.t AS tb, q.value AS vb FROM a ASOF LEFT JOIN q ON a.user_id = q.user_id AND a.time <= q.t)
SELECT user_id, CAST(sample AS INTEGER) AS sample, CAST(time AS DOUBLE) AS time, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va WHEN tb = ta THEN va ELSE va + (vb - va) * (time - ta) / (tb - ta) END, 6) AS value FROM b""")
def resample_linear(spark, d):
    e = events(spark, d)
    first = e.groupBy("user_id").agg(F.min("us").alias("t0"))
    p = e.join(first, "user_id").withColumn("t", (F.col("us") - F.col("t0")) / 1e6).groupBy("user_id", "t").agg(F.max("value").alias("value"))
    return W.resampled(p, KEYS, "t", ["value"], 25 * 86400.0, 1 / 86400.0).select("user_id", "sample", "time", r6("value", "value"))


@query(f"""WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS pos, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM e),
x AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pa, last_value(v IGNORE NULLS) OVER b AS va, first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS pb, first_value(v IGNORE NULLS) OVER f AS vb
      FROM k WINDOW b AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + (vb - va) * (pos - pa) / (pb - pa) END, 6) AS filled FROM x""")
def gap_fill(spark, d):
    e = events(spark, d).withColumn("pos", F.row_number().over(W.over(KEYS, ORDER))).withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return e.select("event_id", r6(W.filled("v", "pos", KEYS), "filled"))


def trial_table(spark, d) -> DataFrame:
    """Orders as trial rows: line (region), condition (priority), animal (nation), rate."""
    n = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("fish"), F.col("n_regionkey").alias("line"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.select("fish", "line", F.col("o_orderpriority").alias("condition"), F.col("c_mktsegment").alias("epoch"), F.col("o_totalprice").alias("rate"))


_TT = "t AS (SELECT n_name AS fish, n_regionkey AS line, o_orderpriority AS condition, c_mktsegment AS epoch, o_totalprice AS rate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""WITH {_TT}, a AS (SELECT fish, line, condition, epoch, avg(rate) AS rate FROM t GROUP BY ALL),
k AS (SELECT epoch, avg(rate) AS control FROM a WHERE line = 0 AND condition = '1-URGENT' GROUP BY epoch)
SELECT fish, line, condition, epoch, round(rate, 7) AS rate, round(rate - control, 7) AS delta FROM a LEFT JOIN k USING (epoch) WHERE NOT (line = 0 AND condition = '1-URGENT')""")
def baseline_delta(spark, d):
    control = (F.col("line") == 0) & (F.col("condition") == "1-URGENT")
    a = C.trial_average(trial_table(spark, d), ["fish", "line", "condition", "epoch"], ["rate"])
    out = C.without_control(C.baseline_delta(a, control, ["epoch"], "rate"), control)
    return out.select("fish", "line", "condition", "epoch", F.round("rate", 7).alias("rate"), F.round("delta", 7).alias("delta"))


@query(f"WITH {_TT} SELECT fish, line || ' | ' || condition || ' | ' || epoch AS key, count(*) AS n FROM t WHERE condition NOT IN ('5-LOW', '3-MEDIUM') GROUP BY ALL")
def interaction_key(spark, d):
    t = apply(trial_table(spark, d), parse({"condition": {"not_in": ["5-LOW", "3-MEDIUM"]}}))
    return t.groupBy("fish", X.interaction(F.col("line"), F.col("condition"), F.col("epoch")).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_label(spark, d):
    return J.matching(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_label(spark, d):
    return J.matching(read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels"), ["doc_id"], present=False)


@query("SELECT p_partkey, CASE WHEN p_size >= 25 AND p_size < 45 AND p_retailprice >= 900 AND p_retailprice < 1400 THEN 1 WHEN p_size >= 0 AND p_size < 30 AND p_retailprice >= 0 AND p_retailprice < 1200 THEN 0 ELSE -1 END AS roi FROM part")
def point_in_roi(spark, d):
    return J.point_in_roi(read(spark, d, "part"), [(0, 0, 30, 1200), (25, 900, 20, 500)], "p_size", "p_retailprice").select("p_partkey", "roi")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_same_header(spark, d):
    return C.union_strict([read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), read(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))])


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def union_outer(spark, d):
    return C.union_outer([read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), read(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))])


@query("UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value")
def unpivot(spark, d):
    return C.melt(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("WITH n AS (SELECT event_type, CAST(least(floor(value / 5), 35) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 180 GROUP BY ALL) SELECT event_type, bin, n, round(n / (sum(n) OVER (PARTITION BY event_type) * 5), 9) AS density FROM n")
def histogram(spark, d):
    return Q.histogram(events(spark, d), "value", 0.0, 180.0, 36, ["event_type"], density=True).select("event_type", "bin", "n", F.round("density", 9).alias("density"))


@query("SELECT event_type, x, round(avg(exp(-0.5 * pow((x - value) / 8, 2)) / (8 * sqrt(2 * pi()))), 9) AS density FROM events, (SELECT unnest(range(11)) * 10.0::DOUBLE AS x) GROUP BY ALL")
def kde(spark, d):
    return Q.kde(events(spark, d), "value", [10.0 * i for i in range(11)], 8.0, ["event_type"]).select("event_type", "x", F.round("density", 9).alias("density"))


@query("SELECT user_id, CAST(count_if(event_type = 'purchase') AS BIGINT) AS n FROM events GROUP BY user_id")
def category_count(spark, d):
    return C.count_by(events(spark, d), KEYS, F.col("event_type") == "purchase")


@query("SELECT event_type, min(event_id) AS first_at FROM events GROUP BY event_type")
def order_of_appearance(spark, d):
    return C.in_order_of_appearance(events(spark, d), "event_type", "event_id")


@query("SELECT page_id, regexp_extract(url, '^(\\w+)://([^/]+)/([^?#]*)', 1) AS scheme, regexp_extract(url, '^(\\w+)://([^/]+)/([^?#]*)', 2) AS host, regexp_extract(url, '^(\\w+)://([^/]+)/([^?#]*)', 3) AS rest FROM pages")
def regex_fields(spark, d):
    p = r"^(\w+)://([^/]+)/([^?#]*)"
    return read(spark, d, "pages").select("page_id", *(F.regexp_extract("url", p, n).alias(c) for n, c in enumerate(("scheme", "host", "rest"), 1)))


_NAME = "lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '_07dpf_WT_Fri_' || strftime(o_orderdate, '%d_%b_%Y_') || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || 'h05min09sec' || CASE WHEN o_orderkey % 3 = 0 THEN '_fish_1' ELSE '' END"


@query("SELECT o_orderkey, CAST(o_orderkey % 100 AS INTEGER) AS fish_id, 7 AS age, 'WT' AS line, CAST(day(o_orderdate) AS INTEGER) || '.' || strftime(o_orderdate, '%b.%Y') AS day_label, CASE WHEN o_orderkey % 3 = 0 THEN 'fish_1' END AS extra, strftime(o_orderdate, '%Y-%m-%d ') || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':05:09' AS at FROM orders")
def name_fields(spark, d):
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.to_date("o_orderdate")
    name = F.concat(two(k % 100), F.lit("_07dpf_WT_Fri_"), F.date_format(day, "dd_MMM_yyyy_"), two(k % 24), F.lit("h05min09sec"), F.when(k % 3 == 0, F.lit("_fish_1")).otherwise(F.lit("")))
    n = read(spark, d, "orders").select("o_orderkey", X.parse_name(name).alias("n"))
    return n.select("o_orderkey", "n.fish_id", "n.age", "n.line", X.day_label(F.col("n")).alias("day_label"), "n.extra", F.date_format(X.name_time(F.col("n")), "yyyy-MM-dd HH:mm:ss").alias("at"))


_ST = "s AS (SELECT event_id, value AS trial, CAST(event_id % 4000 AS DOUBLE) AS start FROM events), c AS (SELECT *, (trial + start) - floor((trial + start) / 3600) * 3600 AS st FROM s), q AS (SELECT *, st - start AS tt FROM c)"


def _stim(spark, d) -> DataFrame:
    return events(spark, d).select("event_id", F.col("value").alias("trial"), F.pmod("event_id", F.lit(4000)).cast("double").alias("start"))


@query(f"WITH {_ST} SELECT event_id, round(greatest(0, least(1, (tt - floor(tt / 12) * 12) / 12)), 6) AS ramp FROM q")
def stim_ramp(spark, d):
    return _stim(spark, d).select("event_id", r6(S.ramp("start", "trial", 12.0), "ramp"))


@query(f"""WITH {_ST}, p AS (SELECT *, 1.7 * st AS a, radians(33) * st AS b, 2 * radians(20) / (2 * abs(radians(55))) * tt AS c FROM q)
SELECT event_id, round((a - floor(a / 2) * 2) * pi(), 5) AS omr, round((b - floor(b / 2) * 2) * pi(), 5) AS okr, round((c - floor(c / 2) * 2) * pi(), 5) AS prey FROM p""")
def stim_phase(spark, d):
    return _stim(spark, d).select("event_id", F.round(S.grating_phase("start", "trial", 17.0, 10.0), 5).alias("omr"), F.round(S.rotation_phase("start", "trial", 33.0), 5).alias("okr"), F.round(S.prey_phase("start", "trial", 15.0, 70.0, 20.0), 5).alias("prey"))


@query(f"""WITH {_ST}, r AS (SELECT *, tt - floor(tt / 30) * 30 AS rt, 240 / tan(radians(10) / 2) AS t0, 240 / tan(radians(100) / 2) AS tf FROM q),
k AS (SELECT *, 1000 * tt - floor(1000 * tt / (t0 - tf)) * (t0 - tf) AS ms FROM r)
SELECT event_id, round(CASE WHEN rt <= 10 THEN 5 * rt ELSE 0 END, 6) AS linear_radius, round(8 * tan(CASE WHEN rt <= 10 THEN radians(9) * rt ELSE 0 END / 2), 6) AS linear_angle, round(8 * 240 / (t0 - ms), 5) AS approach FROM k""")
def looming_radius(spark, d):
    return _stim(spark, d).select("event_id", r6(S.looming_linear_radius("start", "trial", 30.0, 10.0, 5.0), "linear_radius"), r6(S.looming_linear_angle("start", "trial", 30.0, 10.0, 9.0, 8.0), "linear_angle"), F.round(S.looming_constant_velocity("start", "trial", 10.0, 100.0, 240.0, 8.0), 5).alias("approach"))


@query("WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings) SELECT vec_id, round(atan2(a * d - b * c, a * c + b * d), 6) AS angle FROM v")
def angle_between(spark, d):
    v = [F.col("embedding")[i].cast("double") for i in range(4)]
    return read(spark, d, "embeddings").select("vec_id", r6(G.angle_between(*v), "angle"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS DOUBLE), 2.5) AS missing FROM events")
def json_param_default(spark, d):
    j = F.from_json("props", "k int, missing double")
    return events(spark, d).select("event_id", F.coalesce(j["k"], F.lit(-1)).alias("k"), F.coalesce(j["missing"], F.lit(2.5)).alias("missing"))


_PAIRS = "w AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS c, avg(value) FILTER (event_type = 'view') AS v, avg(value) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id), x AS (SELECT 'click' AS a, 'view' AS b, c - v AS d FROM w UNION ALL SELECT 'click', 'purchase', c - p FROM w UNION ALL SELECT 'view', 'purchase', v - p FROM w)"


@query(f"WITH {_PAIRS} SELECT a, b, count(d) AS n, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS sd_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t FROM x GROUP BY ALL")
def paired_ttest(spark, d):
    return T.paired(events(spark, d), "user_id", "event_type", "value", ["click", "view", "purchase"]).select("a", "b", "n", *(r6(c, c) for c in ("mean_diff", "sd_diff", "t")))


@query()
def paired_holm(spark, d):
    p = T.paired_p(T.paired(events(spark, d), "user_id", "event_type", "value", ["click", "view", "purchase"]))
    return T.holm(p).select("a", "b", r6("p", "p"), r6("p_holm", "p_holm"), X.stars(F.col("p_holm")).alias("stars"))


@query("""WITH t AS (SELECT user_id, event_id, value / 2000 AS p FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM t)
SELECT user_id, event_id, round(max(least(1, p * (n - k + 1))) OVER (PARTITION BY user_id ORDER BY p, event_id ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""")
def holm(spark, d):
    t = events(spark, d).where("value is not null").select("user_id", "event_id", (F.col("value") / 2000).alias("p"))
    return T.holm(t, "p", ["event_id"], KEYS).select("user_id", "event_id", r6("p_holm", "p_holm"))


@query("""WITH c AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), f AS (SELECT *, count(v) OVER (PARTITION BY user_id) AS k FROM c QUALIFY k = (SELECT count(DISTINCT event_type) FROM events)),
m AS (SELECT *, avg(v) OVER (PARTITION BY user_id) AS s, avg(v) OVER (PARTITION BY event_type) AS m, avg(v) OVER () AS g FROM f),
a AS (SELECT sum(pow(m - g, 2)) AS ssc, sum(pow(v - s - m + g, 2)) AS sse, count(DISTINCT user_id) AS n, max(k) AS k FROM m)
SELECT round((ssc / (k - 1)) / (sse / ((k - 1) * (n - 1))), 6) AS f, k - 1 AS df_condition, (k - 1) * (n - 1) AS df_error FROM a""")
def rm_anova(spark, d):
    return T.rm_anova(events(spark, d), "user_id", "event_type", "value").select(r6("f", "f"), "df_condition", "df_error")


def _counts(spark, d) -> DataFrame:
    return events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"), (F.max("us") - F.min("us") + 1).cast("double").alias("us"), F.avg("value").alias("value"))


@query()
def poisson_glm(spark, d):
    c, dispersion, _ = T.poisson_model(_counts(spark, d).withColumn("days", F.col("us") / 8.64e10 + 1), "n ~ event_type", "days", quasi=True)
    return c.select("term", *(F.round(x, 4 if x == "statistic" else 6).alias(x) for x in c.columns[1:]), F.lit(round(dispersion, 6)).alias("dispersion"))


@query()
def linear_model(spark, d):
    c, _ = T.linear_model(_counts(spark, d), "value ~ event_type + n")
    return c.select("term", *(r6(x, x) for x in c.columns[1:]))


@query()
def spline_model(spark, d):
    c = T.spline_by_group(_counts(spark, d), ["event_type"], "n", "value", pooled=True)
    return c.select("event_type", "term", r6("estimate", "estimate"), r6("std_error", "std_error"))


@query("""WITH p AS (SELECT event_type, user_id, count(*) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS s2 FROM events WHERE value IS NOT NULL GROUP BY ALL),
g AS (SELECT event_type, count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum((n - 1) * s2) AS ssw, sum(n * m) AS sm, sum(n * m * m) AS smm FROM p GROUP BY ALL),
h AS (SELECT *, ssw / (nn - k) AS msw, (smm - sm * sm / nn) / (k - 1) AS msb, (nn - n2 / nn) / (k - 1) AS n0 FROM g),
v AS (SELECT *, greatest(0, (msb - msw) / n0) AS b FROM h)
SELECT event_type, round(sm / nn, 6) AS mean, round(b, 4) AS subject_var, round(msw, 4) AS residual_var, k AS n_subjects, round(sqrt(b / k + msw / nn), 6) AS std_error FROM v""")
def random_intercept(spark, d):
    r = T.random_intercept(events(spark, d), ["event_type"], "user_id", "value")
    return r.select("event_type", r6("mean", "mean"), F.round("subject_var", 4).alias("subject_var"), F.round("residual_var", 4).alias("residual_var"), "n_subjects", r6("std_error", "std_error"))


@query()
def smoothed(spark, d):
    e = events(spark, d).withColumn("pos", F.row_number().over(W.over(KEYS, ORDER))).select("user_id", "event_id", "pos", F.col("value").cast("double").alias("value"))
    return W.savgol(e, KEYS, "pos", ["value"]).select("event_id", r6("value", "smooth"))


@query(f"""WITH {E}, i AS (SELECT event_id AS k, user_id, us AS lo, us + 21600000000 AS hi FROM e WHERE event_type IN ('signup', 'error'))
SELECT i.k, count(*) AS n, round(sum(e.value), 4) AS total FROM i JOIN e ON e.user_id = i.user_id AND e.us >= i.lo AND e.us < i.hi GROUP BY i.k""")
def frames_in_bout(spark, d):
    e = events(spark, d)
    i = e.where(F.col("event_type").isin(STIM)).select("user_id", F.col("event_id").alias("k"), F.col("us").alias("lo"), (F.col("us") + 21_600_000_000).alias("hi"))
    return J.points_in(e.select("user_id", "us", "value"), i, KEYS, "us", "lo", "hi", 43_200_000_000.0).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


from . import experiment  # noqa: E402, F401  adds its queries
