import math
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swimlane.functions import geometry as G, stimulus as S, text as X
from swimlane.operators import bouts as B, compare as C, frequency as Q, joins as J, stats as T, timeseries as W, transitions as N, trials as R
from swimlane.plans import dims
from swimlane.plans.rules import Rule, RuleSet, apply, funnel, parse, register
from swimlane.plans.specs import epochs, spec_table

NAN = float("nan")
COLOUR = [0.5, 0.1, 0.0, 0.8]


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


# ---- rules


@pytest.fixture(scope="module")
def missing(spark):
    return spark.createDataFrame([(1.0, "a"), (2.0, None), (NAN, "b"), (None, "a")], "x double, s string")


@pytest.mark.parametrize(
    ("rule", "kept"),
    [(("x", ">=", 0.5), [0, 1]), (("x", "!=", 1.0), [1, 2, 3]), (("x", "==", 1.0), [0]), (("x", "<", 5), [0, 1]), (("x", "in", [1.0, 2.0]), [0, 1]), (("x", "not_in", [1.0]), [1, 2, 3]), (("s", "not_in", ["a"]), [1, 2]), (("s", "!=", "a"), [1, 2]), (("s", "in", []), []), (("s", "not_in", []), [0, 1, 2, 3])],
)
def test_missing_values_in_rules(missing, rule, kept):
    d = pd.DataFrame({"x": [1.0, 2.0, NAN, NAN], "s": ["a", None, "b", "a"]})
    rows = [tuple(r) for r in missing.collect()]
    got = [tuple(r) for r in apply(missing, RuleSet((Rule(*rule),))).collect()]
    assert list(map(str, got)) == [str(rows[i]) for i in kept]
    assert len(d) == 4


def test_rule_sets(missing):
    assert apply(missing, RuleSet()).count() == 4
    r = parse({"x": {">=": 0.5, "<": 2}, "s": {"in": ["a"]}})
    assert r.label == "x>=0.5_x<2_sin['a']" and parse(None).label == ""
    with pytest.raises(ValueError):
        Rule("x", "like", 1)
    register("near", lambda c, v: F.abs(c - v) < 0.1)
    assert apply(missing, parse({"x": {"near": 2.05}})).count() == 1


def test_funnel(missing):
    got = [(r.removed, r.fraction) for r in funnel(missing, parse({"x": {">=": 0.5}, "s": {"!=": "a"}})).orderBy("step").collect()]
    assert got == [(2, 0.5), (1, 0.25)]
    assert funnel(missing.limit(0), parse({"x": {">": 0}})).first().fraction == 0 and funnel(missing, RuleSet()).count() == 0


# ---- epochs: every cell against plain loops


def small_bouts(n=4000, seed=42):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        f, stim = f"0{r.randrange(6)}_07dpf_WT_Fri_10_Oct_2025_14h35min10sec", r.choice([0, 3, 5])
        if f.startswith("05") and stim == 3:
            stim = 0
        rows.append((f, stim, r.randrange(15), round(r.uniform(0, 12), 2), r.randrange(13), r.choice([-1, 1]), float(r.choice([0, 90])), NAN if i % 97 == 0 else r.random()))
    return rows


SPEC = {
    "filters": {"proba": {">=": 0.3}},
    "time_bins": [[0, 2.5], [2.5, 5], [5, 10]],
    "stimuli": [
        {"stim": "OMR", "name": "omr", "parameters": [{"angle": {"==": 0.0}}, {"angle": {"==": 90.0}}], "trial_range": {"start": 0, "stop": 5, "step": 1}},
        {"stim": "DARK", "name": "dark", "parameters": [{}], "trial_range": {"start": 10, "stop": 14, "step": 1}, "time_bins": [[0, 1], [0.5, 2]]},
        {"stim": "LOOMING", "name": "loom", "parameters": [{"angle": {">": 360}}], "trial_range": {"start": 0, "stop": 2, "step": 1}},
    ],
}


def test_frequency_equals_plain_loops(spark):
    rows = small_bouts()
    df = spark.createDataFrame(rows, "file string, stim int, trial_num int, trial_time double, category int, sign int, angle double, proba double")
    kept = apply(df, parse(SPEC["filters"]))
    specs = epochs(SPEC)
    assert len(specs) == 11
    got = {(r.file, r.epoch_num, r.trial_position, r.category, r.sign): (r.bout_counts, r.bout_frequency) for r in Q.epoch_frequency(kept, specs, list(range(13))).collect()}
    p = pd.DataFrame(rows, columns=df.columns)
    p = p[p.proba >= 0.3]
    want = {}
    for e in specs:
        rule = e.rules.rules[0] if e.rules.rules else None
        m = p[p.stim == e.stim]
        if rule:
            m = m[{"==": m.angle == rule.value, ">": m.angle > rule.value}[rule.op]]
        for f in m.file.unique():
            x = m[(m.file == f) & (m.trial_time >= e.lo) & (m.trial_time < e.hi)].groupby(["trial_num", "category", "sign"]).size().to_dict()
            for k, t in enumerate(e.trials):
                for c in range(13):
                    for s in (-1, 1):
                        n = x.get((t, c, s), 0)
                        want[f, e.num, k, c, s] = (n, n / (e.hi - e.lo))
    assert got == want
    freq = Q.epoch_frequency(kept, specs, list(range(13)))
    assert freq.agg(F.sum("bout_counts")).first()[0] == sum(n for n, _ in want.values())
    t = Q.tall(freq).first()
    assert (t.dpf, t.day, t.bout_category) == (7, "10.Oct.2025", t.bout_category) and t.bout_category in dims.CATEGORIES
    heat = Q.heatmap(freq).where("epoch_num = 0 and category = 0 and sign = 1").first().mean_frequency
    by = {}
    for (f, e, _, c, s), (_, x) in want.items():
        if (e, c, s) == (0, 0, 1):
            by.setdefault(f, []).append(x)
    assert heat == pytest.approx(np.mean([np.mean(v) for v in by.values()]))
    assert len(Q.dense(freq).where("epoch_num = 0").first().rates) == 5


def test_spec_errors(spark):
    with pytest.raises(ValueError, match="No such stimulus"):
        epochs({"stimuli": [{"stim": "NONE", "name": "x"}]})
    with pytest.raises(ValueError, match="time bins"):
        epochs({"stimuli": [{"stim": "OMR", "name": "x", "time_bins": [], "parameters": [], "trial_range": {"start": 0, "stop": 1, "step": 1}}]})
    assert spec_table(spark, epochs(SPEC)).count() == 11
    empty = Q.epoch_frequency(spark.createDataFrame([], "file string, stim int, trial_num int, trial_time double, category int, sign int, angle double"), epochs(SPEC), [0])
    assert empty.count() == 0


# ---- trials and bouts


def test_intervals_and_numbers(spark):
    log = spark.createDataFrame([("f", 2, 300, 3, "a"), ("f", 0, 100, 3, "a"), ("f", 1, 200, 3, None), ("f", 3, 400, 3, "a"), ("g", 0, 50, 3, "b")], "file string, pos int, ts long, stim int, cond string")
    last = R.last_clock(spark.createDataFrame([("f", 450), ("f", 500), ("g", 90)], "file string, timestamp long"), spark.createDataFrame([("f", 480)], "file string, timestamp long"), ["file"])
    t = R.numbered(R.intervals(log, ["file"], ["pos"], "ts", last), ["file", "stim"], "cond", ["pos"])
    assert {(r.file, r.start, r.stop, r.trial_num) for r in t.collect()} == {("f", 100, 200, 0), ("f", 300, 400, 1), ("f", 400, 500, 2), ("g", 50, 90, 0)}
    some = R.intervals(log, ["file"], ["pos"], "ts", last, F.col("pos") != 1)
    assert {r.stop for r in some.where("file = 'f' and pos = 0").collect()} == {200}


@pytest.mark.parametrize("width", [None, 7.0, 1000.0])
def test_containment_is_strict(spark, width):
    t = spark.createDataFrame([("f", 10, 20), ("f", 20, 40)], "file string, start long, stop long")
    b = spark.createDataFrame([("f", 1, 10, 12), ("f", 2, 15, 20), ("f", 3, 18, 22), ("f", 4, 11, 11), ("f", 5, 21, 39), ("g", 6, 11, 12)], "file string, k int, a long, z long")
    got = {(r.k, r.start) for r in R.bouts_in(b, t, ["file"], "a", "z", width).collect()}
    assert got == {(4, 10), (5, 20)}


def test_points_in_equals_loops(spark):
    r = random.Random(1)
    pts = [(r.choice("ab"), r.randrange(100)) for _ in range(300)]
    ivs = [(r.choice("ab"), a, a + r.randrange(30)) for a in (r.randrange(90) for _ in range(40))]
    p, i = spark.createDataFrame(pts, "k string, p long"), spark.createDataFrame(ivs, "k string, lo long, hi long")
    for closed, ok in (("left", lambda x, a, z: a <= x < z), ("none", lambda x, a, z: a < x < z), ("both", lambda x, a, z: a <= x <= z)):
        want = sorted((k, x, a, z) for k, x in pts for j, a, z in ivs if j == k and ok(x, a, z))
        assert sorted((r.k, r.p, r.lo, r.hi) for r in J.points_in(p, i, ["k"], "p", "lo", "hi", 8.0, closed).collect()) == want


def test_as_of_and_nearest_equal_loops(spark):
    r = random.Random(2)
    left = [(n, r.choice("abc"), r.randrange(60)) for n in range(200)]
    right = sorted({(r.choice("ab"), r.randrange(60)): n for n in range(60)}.items())
    right = [(k, t, n) for (k, t), n in right]
    a, b = spark.createDataFrame(left, "n long, k string, t long"), spark.createDataFrame(right, "k string, u long, v long")
    got = {r.n: r.v for r in J.as_of(a, b, ["k"], "t", "u", ["v"]).collect()}
    near = {r.n: r.nearest for r in J.nearest(a, b, ["k"], "t", "u", "v").collect()}
    for n, k, t in left:
        of = [(u, v) for j, u, v in right if j == k]
        assert got[n] == max(((u, v) for u, v in of if u <= t), default=(0, None))[1]
        assert near[n] == min(((abs(u - t), v) for u, v in of), default=(0, None))[1]


def test_metrics_of_bouts(spark):
    n, fps = 60, 10.0
    g = np.random.default_rng(3)
    x, y, yaw, ax, yw = g.normal(size=(5, n))
    ax[12], ax[14] = 9.0, -9.0
    ts = [1_000_000_000_000 + 100_000_000 * k for k in range(n)]
    traj = spark.createDataFrame([("f", k, ts[k], float(x[k]), float(y[k]), float(yaw[k]), float(ax[k]), float(yw[k])) for k in range(n)], "file string, frame long, timestamp long, x_smooth double, y_smooth double, yaw_smooth double, axial_speed double, yaw_speed double")
    seg = spark.createDataFrame([("f", 0, 10, 16, 2, -1, 0.9), ("f", 1, 20, 21, 3, 1, 0.8), ("f", 2, 33, 37, 1, 1, 0.7)], "file string, bout_index long, onset long, offset long, category int, sign int, proba double")
    c, h = g.normal(size=(2, n, 2))
    p = g.normal(size=(n, 2))
    q = p + g.normal(size=(n, 2))
    online = spark.createDataFrame([("f", k, *map(float, (*c[k], *h[k]))) for k in range(n)], "file string, frame long, centroid_x double, centroid_y double, pc1_x double, pc1_y double")
    post = spark.createDataFrame([("f", k, *map(float, (*p[k], *q[k]))) for k in range(n)], "file string, frame long, bladder_x double, bladder_y double, head_x double, head_y double")
    log = ", ".join(f"{c} double" for c in dims.PARAMETERS)
    params = {"prey_arc_start_deg": 15.0, "prey_arc_stop_deg": 70.0, "prey_speed_deg_s": 20.0, "start_time_sec": 5.0}
    row = lambda pos, t, s: ("f", pos, t, s, COLOUR, COLOUR, [1.0, 2.0], *(params.get(c) for c in dims.PARAMETERS))
    stim = spark.createDataFrame([row(0, ts[5], 0), row(1, ts[30], 6), row(2, ts[50], 8)], "file string, position int, timestamp long, stim_select int, foreground_color array<double>, background_color array<double>, looming_center_mm array<double>, " + log)
    trials = R.from_log(stim, spark.createDataFrame([("f", ts[-1])], "file string, last long"))
    assert {r.foreground_color for r in trials.collect()} == {str(COLOUR)} and trials.count() == 2
    out = B.metrics(seg, traj, trials, online, post, spark.createDataFrame([("f", 1.0, 2.0)], "file string, cx_mm double, cy_mm double"), spark.createDataFrame([("f", fps)], "file string, fps double"), bucket=8)
    rows = {r.bout_index: r.asDict() for r in out.collect()}
    assert rows.keys() == {0, 1, 2}
    unit = (q - p) / np.linalg.norm(q - p, axis=1, keepdims=True)
    before = {0: 0, 1: 16, 2: 0}
    for i, (on, off) in enumerate([(10, 16), (20, 21), (33, 37)]):
        r, w = rows[i], slice(before[i], off)
        step = np.hypot(np.diff(x[on:off]), np.diff(y[on:off])).sum()
        cm = np.linalg.norm(c[w] - p[w], axis=1)
        hm = np.degrees(np.arccos(np.clip((h[w] * unit[w]).sum(axis=1), -1, 1)))
        start = ts[5] if i < 2 else ts[30]
        want = {
            "distance": step, "heading_change": yaw[off] - yaw[on], "distance_center": math.hypot(x[on] - 1, y[on] - 2), "bout_duration": (off - on) / fps, "interbout_duration": (on - before[i]) / fps,
            "peak_axial_speed": ax[on:off][np.argmax(np.abs(ax[on:off]))], "peak_yaw_speed": yw[on:off][np.argmax(np.abs(yw[on:off]))], "trial_time": 1e-9 * (ts[on] - start), "time_start": on / fps, "time_stop": off / fps,
            "centroid_mismatch_avg": cm.mean(), "centroid_mismatch_max": cm.max(), "heading_mismatch_avg": hm.mean(), "heading_mismatch_max": hm.max(),
        }
        for k, v in want.items():
            assert r[k] == pytest.approx(v, abs=1e-9), k
        assert r["heading_flip"] == bool((hm > 160).any()) and r["trial_num"] == 0 and r["stim"] == (0 if i < 2 else 6)
    phase = 2 * (math.radians(20) / (2 * math.radians(55))) * (((1e-9 * (ts[33] - ts[30]) + 5) % 3600) - 5)
    assert rows[2]["stim_phase"] == pytest.approx((phase % 2) * math.pi) and rows[0]["stim_phase"] is None
    assert {"file", "stim_start_time", "omr_angle_deg", "proba", "sign", "category"} <= set(out.columns)


def test_peaks_and_quality(spark):
    d = spark.createDataFrame([("t", 0, -3.0), ("t", 1, 3.0), ("n", 0, 5.0), ("n", 1, NAN), ("n", 2, NAN), ("p", 0, 1.0), ("p", 1, -2.0)], "k string, f int, v double")
    got = {r.k: r.p for r in d.groupBy("k").agg(B.signed_peak(F.col("v"), F.col("f")).alias("p")).collect()}
    assert got["t"] == -3.0 and math.isnan(got["n"]) and got["p"] == -2.0
    q = spark.createDataFrame([(160.0,), (NAN,)], "e double").agg(*B.quality(F.col("e"), F.lit(4), "h", 160.0)).first()
    assert not q.heading_flip and math.isnan(q.h_avg) and math.isnan(q.h_max)
    assert spark.createDataFrame([(160.5,)], "e double").agg(*B.quality(F.col("e"), F.lit(2), "h", 160.0)).first().heading_flip
    assert math.isnan(one(spark, G.angle_error(1.0, 0.0, 0.0, 0.0))) and one(spark, G.angle_error(F.lit(None).cast("double"), 0.0, 1.0, 0.0)) is None
    assert one(spark, G.angle_error(1.0, 0.0, -2.0, 0.0)) == 180.0


def test_rois(spark):
    p = spark.createDataFrame([("f", 0, 5.0, 5.0), ("f", 1, 15.0, 5.0), ("f", 2, 9.0, 9.0), ("f", 3, 99.0, 9.0)], "file string, n int, x double, y double")
    got = J.roi_order(J.point_in_roi(p, [(0, 0, 10, 10), (8, 8, 4, 4), (10, 0, 10, 10)], "x", "y"), ["file"], "n")
    assert {(r.n, r.roi, r.roi_rank) for r in got.collect()} == {(0, 0, 1), (1, 2, 3), (2, 1, 2), (3, -1, 0)}


# ---- functions


def test_stimulus_functions(spark):
    f = lambda c: one(spark, c)
    st, t = 3590.0, 25.0
    clock = (st + t) % 3600
    assert f(S.display_time(st, t)) == clock and f(S.display_trial_time(st, t)) == clock - st
    assert f(S.ramp(0.0, 25.0, 10.0)) == pytest.approx(0.5) and f(S.constant(0.0, 1.0)) == 0
    assert f(S.grating_phase(st, t, 10.0, 3.0)) == pytest.approx((10 / 3 * clock % 2) * math.pi)
    assert f(S.grating_phase(st, t, 10.0, 3.0, corrected=True)) == pytest.approx(10 / 3 * clock % (2 * math.pi))
    assert f(S.grating_phase(st, t, 10.0, 0.0)) is None
    assert f(S.rotation_phase(0.0, 7.0, 90.0)) == pytest.approx((math.radians(90) * 7 % 2) * math.pi)
    assert f(S.looming_linear_radius(0.0, 12.0, 10.0, 5.0, 3.0)) == pytest.approx(6) and f(S.looming_linear_radius(0.0, 17.0, 10.0, 5.0, 3.0)) == 0
    assert f(S.looming_linear_angle(0.0, 12.0, 10.0, 5.0, 30.0, 4.0)) == pytest.approx(4 * math.tan(math.radians(60) / 2))
    t0, tf = 240 / math.tan(math.radians(5)), 240 / math.tan(math.radians(50))
    assert f(S.looming_constant_velocity(0.0, 3.0, 10.0, 100.0, 240.0, 8.0)) == pytest.approx(8 * 240 / (t0 - 3000 % (t0 - tf)))
    period = math.radians(55) / math.radians(20)
    assert f(S.prey_angle(0.0, 7.0, 15.0, 70.0, 20.0)) == pytest.approx(math.radians(15) + math.radians(55) * (7 % period) / period)
    d = spark.createDataFrame([(3, None, 1.0), (4, None, 2.0)], "stim int, omr_angle_deg double, other double")
    assert [tuple(r) for r in d.select(*S.with_defaults(["omr_angle_deg", "other"], F.col("stim"), dims.STIM_ID)).collect()] == [(90.0, 1.0), (None, 2.0)]


def test_geometry(spark):
    f = lambda c: one(spark, c)
    assert f(G.angle_between(1.0, 0.0, 0.0, 1.0)) == pytest.approx(math.pi / 2) and f(G.floor_mod(-1.0, 3.0)) == 2 and f(G.floor_mod(1.0, 0.0)) is None
    assert f(G.clamp(5.0, 0.0, 1.0)) == 1 and f(G.mix(2.0, 4.0, 0.25)) == 2.5 and f(G.to_mm(10.0, 4.0)) == 2.5 and f(G.alpha_blend(0.0, 1.0, 0.5)) == 0.5
    assert 0 <= f(G.hash_unit(12.0)) < 1 and [f(c) for c in G.version_vergence(2.0, 6.0)] == [4, 4]
    assert [f(c) for c in G.egocentric(1.0, 2.0, 0.0, 0.0, 0.0, 1.0)] == [2.0, -1.0]
    assert f(G.eye_angle(0.0, 1.0, 0.0, 0.0)) == 0 and f(G.eye_angle(0.0, 1.0, 0.0, 0.0, valid=F.lit(False))) is None
    c, s = (f(x) for x in G.cosinor(21600.0))
    assert abs(c) < 1e-12 and s == 1


def test_names(spark):
    names = [("03_07dpf_WT_Fri_10_Oct_2025_14h35min10sec",), ("03_07dpf_WT_Fri_10_Okt_2025_14h35min10sec_fish_2",), ("03_07dpf_W_T_Fri_10_Oct_2025_14h35min10sec",), (None,)]
    n = spark.createDataFrame(names, "f string").select(X.parse_name(F.col("f")).alias("n"))
    r = n.select("n", X.name_time(F.col("n")).alias("t"), X.day_label(F.col("n")).alias("d")).collect()
    assert r[0].n.fish_id == 3 and r[0].n.extra is None and r[0].t == datetime(2025, 10, 10, 14, 35, 10) and r[0].d == "10.Oct.2025"
    assert r[1].n.extra == "fish_2" and r[1].t == r[0].t and r[2].n is None and r[3].n is None
    assert one(spark, X.stars(F.lit(0.0005))) == "***" and one(spark, X.stars(F.lit(0.05))) == "ns"
    assert one(spark, X.interaction(F.lit("a"), F.lit(1))) == "a | 1" and one(spark, X.interaction(F.lit("a"), F.lit(None))) is None
    assert one(spark, X.list_key(F.array(F.lit(0.1), F.lit(1.0)))) == "[0.1, 1.0]" and one(spark, X.list_key(F.array(F.lit(0.10000000149)), 6)) == "[0.1]"
    assert one(spark, X.element(F.array(F.lit(4)), 1, 7)) == 7 and one(spark, X.term_name(F.lit("groupsA | b"), "groups")) == "A | b"


# ---- series


def test_unwrap_is_numpys(spark):
    r = np.random.default_rng(4)
    a = r.uniform(-math.pi, math.pi, 400)
    d = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(a)] + [(0, 1000, None), (0, 1001, NAN)], "k int, t int, a double")
    got = [x.unwrapped for x in W.unwrapped(d, "a", ["k"], ["t"]).orderBy("t").collect()]
    u = np.unwrap(a)
    assert np.allclose(got, u - u[0], atol=1e-9)
    half = spark.createDataFrame([(0, 0, 0.0), (0, 1, math.pi)], "k int, t int, a double")
    assert [x.unwrapped for x in W.unwrapped(half, "a", ["k"], ["t"]).orderBy("t").collect()] == [0.0, math.pi]


def test_filling_and_resampling_are_interp(spark):
    r = np.random.default_rng(5)
    t, v = np.sort(r.uniform(-1, 12, 30)), r.normal(size=30)
    d = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(t, v)], "k int, t double, v double")
    got = [x.v for x in W.resampled(d, ["k"], "t", ["v"], 10.0, 5.0).orderBy("sample").collect()]
    assert np.allclose(got, np.interp(np.linspace(0, 10, 50, endpoint=False), t, v))
    holes = [None if k in (0, 1, 5, 6, 9) else float(k * k) for k in range(10)]
    h = spark.createDataFrame([(0, k, x) for k, x in enumerate(holes)], "k int, p int, v double")
    want = pd.Series(holes, dtype=float).interpolate(limit_direction="both").tolist()
    assert [x.f for x in h.select("p", W.filled("v", "p", ["k"]).alias("f")).orderBy("p").collect()] == pytest.approx(want)
    e = h.select("k", "p", F.col("p").cast("double").alias("l"), F.col("p").cast("double").alias("r"), F.when(F.col("p").isin(0, 4), 0.1).otherwise(0.95).alias("q"))
    assert [x.l for x in W.eye_traces(e, "l", "r", "q", "q", "p", ["k"]).orderBy("p").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_smoothing_keeps_parabolas(spark):
    d = spark.createDataFrame([(0, k, 0.5 * k * k - k) for k in range(60)] + [(1, k, 1.0 * (k % 2)) for k in range(5)], "k int, p int, v double")
    got = {(r.k, r.p): r.v for r in W.savgol(d, ["k"], "p", ["v"]).collect()}
    assert all(got[0, k] == pytest.approx(0.5 * k * k - k, abs=1e-6) for k in range(60)) and got[1, 1] == 1.0


def test_running_sums_and_outliers(spark):
    d = spark.createDataFrame([(0, 0, 1.0), (0, 1, NAN), (0, 2, None), (0, 3, 2.0)], "k int, t int, v double")
    w = W.over(["k"], ["t"])
    assert [r.c for r in d.select("t", W.cumulative(F.col("v"), w).alias("c")).orderBy("t").collect()] == [1, 1, 1, 3]
    assert W.first_n(d, ["k"], ["t"], 2).count() == 2 and W.between(d, "t", 1, 3).count() == 3
    assert [r.v for r in W.without_outliers(d.where("t = 0 or t = 3"), F.col("v") > 1.5, "v").orderBy("t").collect()] == [1.0, None]
    m = W.mean_and_sem(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 2, NAN)], "g string, s int, v double"), ["g", "s"], ["g"], "v").first()
    assert (m.mean, m.std) == (2.0, pytest.approx(math.sqrt(2))) and m.sem == pytest.approx(1.0)


def test_time_series(spark):
    r = np.random.default_rng(6)
    track = spark.createDataFrame([("f", 100 * k, float(k), 0.0, float(a)) for k, a in enumerate(r.uniform(-3, 3, 50))], "file string, ts long, x double, y double, a double")
    trials = spark.createDataFrame([("f", 3, "0", 0, 1000, 3000)], "file string, stim int, condition string, trial_num int, start long, stop long")
    out = W.time_series(track, trials, ["file"], "ts", "x", "y", "a", F.lit(10.0), F.lit(0.0), 1.0, 3.0, 10.0, unit=1e-3).orderBy("sample").collect()
    assert len(out) == 30 and out[5].distance == pytest.approx(5) and out[29].distance == pytest.approx(20) and out[3].speed == pytest.approx(10)


# ---- transitions, comparison, statistics


def test_transitions(spark):
    d = spark.createDataFrame([(0, t, c) for t, c in enumerate("abcabcab")] + [(1, 0, "a"), (1, 1, "c")], "k int, t int, c string")
    n = {(r.src, r.dst): r.n for r in N.counts(d, ["k"], ["t"], "c").collect()}
    assert n == {("a", "b"): 3, ("b", "c"): 2, ("c", "a"): 2, ("a", "c"): 1}
    p = N.probabilities(N.counts(d, ["k"], ["t"], "c"))
    s = {r.category: r.weight for r in N.stationary(p, ["a", "b", "c"]).collect()}
    m = np.array([[0, 0.75, 0.25], [0, 0, 1], [1, 0, 0]])
    v = np.array([s[c] for c in "abc"])
    assert np.allclose(v @ m, v, atol=1e-9) and sum(v) == pytest.approx(1) and N.graph_edges(p, 0.5).count() == 3


def test_comparison(spark):
    d = spark.createDataFrame([("WT", "d", "e", 2.0), ("WT", "d", "e", 4.0), ("m", "d", "e", 7.0), ("m", None, "e", 1.0), ("m", "d", "z", 5.0)], "line string, condition string, epoch string, v double")
    control = (F.col("line") == "WT") & (F.col("condition") == "d")
    x = C.baseline_delta(d, control, ["epoch"], "v")
    assert {(r.line, r.epoch, r.v): r.delta for r in x.where("line = 'm'").collect()} == {("m", "e", 7.0): 4.0, ("m", "e", 1.0): -2.0, ("m", "z", 5.0): None}
    assert C.without_control(x, control).count() == 3 and [f.count() for f in C.split_treated(d, "condition", "d")] == [4, 0]
    assert math.isnan(C.control_mean(spark.createDataFrame([(1, NAN), (1, 1.0)], "k int, v double"), F.lit(True), ["k"], "v").first().control)
    assert C.trial_average(spark.createDataFrame([(1, NAN), (1, 1.0)], "k int, v double"), ["k"], ["v"]).first().v == 1.0
    with pytest.raises(ValueError, match="Columns differ"):
        C.union_strict([d, d.select("condition", "line", "epoch", "v")])
    assert C.union_outer([d, d.select("line")]).count() == 10 and C.melt(d, ["line"], ["v"]).columns == ["line", "variable", "value"]
    assert C.evenly_spaced(spark.range(100).withColumnRenamed("id", "p"), "p", 100, 4).count() == 4
    assert C.in_order_of_appearance(d.withColumn("n", F.monotonically_increasing_id()), "line", "n").first().line == "WT"


def test_models(spark):
    r = np.random.default_rng(7)
    rows = [(f"g{k % 3}", float(x), float(2 + 0.5 * (k % 3) + 1.5 * x + e), int(r.poisson(math.exp(0.3 + 0.2 * (k % 3)) * t)), float(t)) for k, (x, e, t) in enumerate(zip(r.normal(size=400), r.normal(size=400), r.uniform(1, 5, 400)))]
    d = spark.createDataFrame(rows, "g string, x double, y double, n int, t double")
    c, model = T.linear_model(d, "y ~ x")
    a = np.array([[1, b[1]] for b in rows])
    y = np.array([b[2] for b in rows])
    beta, ss = np.linalg.lstsq(a, y, rcond=None)[:2]
    got = {q.term: q for q in c.collect()}
    err = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * ss[0] / 398)
    assert got["x"].estimate == pytest.approx(beta[1]) and got["(Intercept)"].estimate == pytest.approx(beta[0]) and got["x"].std_error == pytest.approx(err[1])
    f, p_value, extra = T.nested_anova(model, T.linear_model(d, "y ~ x + g")[1])
    full = np.column_stack([a, [b[0] == "g1" for b in rows], [b[0] == "g2" for b in rows]])
    ss2 = np.linalg.lstsq(full, y, rcond=None)[1]
    assert extra == 2 and f == pytest.approx(((ss - ss2) / 2 / (ss2 / 396))[0]) and 0 < p_value < 1
    assert T.residuals(model, d, "y ~ x", "y").agg(F.sum("residual")).first()[0] == pytest.approx(0, abs=1e-6)
    p, dispersion, _ = T.poisson_model(d, "n ~ g", "t")
    q, _, _ = T.poisson_model(d, "n ~ g", "t", quasi=True)
    rate = {g: sum(b[3] for b in rows if b[0] == g) / sum(b[4] for b in rows if b[0] == g) for g in ("g0", "g1", "g2")}
    est = {x.term: x for x in p.collect()}
    base = math.exp(est["(Intercept)"].estimate)
    fitted = {math.log(v / base) for v in rate.values()}
    assert all(any(abs(x.estimate - f) < 1e-6 for f in fitted) for t, x in est.items() if t != "(Intercept)")
    for x in q.collect():
        assert x.std_error == pytest.approx(est[x.term].std_error * math.sqrt(dispersion))
    s = T.spline_by_group(d, ["g"], "x", "y").groupBy("g").count().collect()
    assert {x["count"] for x in s} == {3}


def test_tests_of_pairs(spark):
    vals = {0: (1.0, 2.0, 4.0), 1: (2.0, 2.5, 3.0), 2: (3.0, 5.0, 4.0), 3: (0.5, 1.0, 3.5)}
    rows = [(s, "abc"[i], v) for s, x in vals.items() for i, v in enumerate(x)] + [(9, "a", 1.0)]
    d = spark.createDataFrame(rows, "s int, c string, v double")
    t = {(r.a, r.b): r for r in T.paired_p(T.paired(d, "s", "c", "v", ["a", "b", "c"])).collect()}
    diff = np.array([a - b for a, b, _ in vals.values()])
    assert t["a", "b"].n == 4 and t["a", "b"].t == pytest.approx(diff.mean() / (diff.std(ddof=1) / 2))
    # from a table of Student's distribution
    assert T.t_p(2.353363, 3) == pytest.approx(0.1, abs=1e-5) and T.t_p(3.182446, 3) == pytest.approx(0.05, abs=1e-5) and math.isnan(T.t_p(None, 3))
    assert T.f_p(4.757063, 3, 6) == pytest.approx(0.05, abs=1e-5)
    h = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.04), ("b", "c", 0.03), ("x", "y", None)], "a string, b string, p double")
    assert {r.p: pytest.approx(r.p_holm) for r in T.holm(h).collect()} == {0.01: 0.03, 0.03: 0.06, 0.04: 0.06}
    x = np.array(list(vals.values()))
    m, s, c = x.mean(), x.mean(axis=1), x.mean(axis=0)
    f = (4 * ((c - m) ** 2).sum() / 2) / (((x - s[:, None] - c + m) ** 2).sum() / 6)
    got = T.rm_anova(d, "s", "c", "v").first()
    assert got.f == pytest.approx(f) and (got.df_condition, got.df_error) == (2, 6)


def test_random_intercept_of_balanced_groups(spark):
    g = np.random.default_rng(8)
    x = g.normal(size=(6, 1)) * 2 + g.normal(size=(6, 5)) + 10
    d = spark.createDataFrame([("g", s, float(v)) for s in range(6) for v in x[s]], "g string, s int, v double")
    r = T.random_intercept(d, ["g"], "s", "v").first()
    msw = x.var(axis=1, ddof=1).mean()
    assert r.mean == pytest.approx(x.mean()) and r.residual_var == pytest.approx(msw) and r.subject_var == pytest.approx(x.mean(axis=1).var(ddof=1) - msw / 5)


def test_mixed_model_against_generalised_least_squares(spark):
    import numpy as np

    from swimlane.operators.stats import mixed_model

    r = np.random.default_rng(3)
    rows = []
    for fish in range(60):
        u, g = r.normal(0, 2), fish % 2
        for _ in range(int(r.integers(3, 12))):
            x = float(r.normal())
            rows.append((fish, float(g), x, float(5 + 1.5 * g - 0.7 * x + u + r.normal(0, 1))))
    out = {o.term: o for o in mixed_model(spark.createDataFrame(rows + [(1, 0.0, None, 3.0), (1, 0.0, 1.0, float("nan"))], "fish int, g double, x double, y double"), "fish", "y", ["g", "x"]).collect()}
    any_ = out["x"]
    a = np.array(rows)
    left, right = np.zeros((3, 3)), np.zeros(3)
    for fish in range(60):  # one animal's rows at a time
        own = a[a[:, 0] == fish]
        z = np.column_stack((np.ones(len(own)), own[:, 1], own[:, 2]))
        w = np.linalg.inv(any_.subject_var + np.eye(len(own)) * any_.residual_var)
        left, right = left + z.T @ w @ z, right + z.T @ w @ own[:, 3]
    inv = np.linalg.inv(left)
    beta = inv @ right
    for k, t in enumerate(("(Intercept)", "g", "x")):
        assert abs(out[t].estimate - beta[k]) < 1e-8 and abs(out[t].std_error - np.sqrt(inv[k, k])) < 1e-8
    assert abs(any_.subject_var - 4) < 2 and abs(any_.residual_var - 1) < 0.3
