import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from swimlane.plans import catalog, dims
from swimlane.sources import files as S, sinks as K
from swimlane.streaming import bouts as streaming

REPO = Path(__file__).resolve().parents[1]
STEM = "03_07dpf_WT_Fri_10_Oct_2025_14h35min{:02}sec"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / (STEM.format(10) + ".metadata")).write_text(json.dumps({"calibration": {"pix_per_mm": 2.0}, "camera": {"framerate_value": 120.0}, "identity": {"ROIs": [[0, 0, 10, 20], [10, 0, 10, 20]]}}, indent=1))
    (tmp_path / ("stim_" + STEM.format(40) + ".json")).write_text("\n".join(json.dumps(x) for x in [{"timestamp": 5, "stim_select": 3, "foreground_color": [1, 0, 0, 1], "background_color": [0, 0, 0, 1], "omr_angle_deg": 90}, {"timestamp": 2, "stim_select": "0"}]) + "\n")
    (tmp_path / ("tracking_" + STEM.format(12) + ".csv")).write_text("index,timestamp,identity,centroid_x,centroid_y,other\n0,5,0,1.5,2,x\n1,6,1,12,,y\n")
    (tmp_path / (STEM.format(50) + ".csv")).write_text("scorer,s,s,s\nbodyparts,Head,Head,Head\ncoords,x,y,likelihood\n0,1.5,2,0.9\n1,,4,0.1\n")
    (tmp_path / ("eyes_" + STEM.format(55) + ".csv")).write_text("x\n")
    (tmp_path / "notes.txt").write_text("no experiment")
    return tmp_path


def test_files_that_belong_together(spark, folder):
    paths = S.listing(spark, str(folder))
    by = {r: S.named(paths, r) for r in ("metadata", "stimuli", "tracking", "eyes", "temperature")}
    assert by["metadata"].count() == 1 and S.rejected(paths, "metadata").count() == 5
    row = S.assemble(by).first()
    assert row.stimuli.endswith("40sec.json") and row.tracking and row.temperature is None and row.eyes is None  # 45 seconds off
    assert S.missing(S.assemble(by)).count() == 0
    assert S.missing(S.assemble({**by, "stimuli": by["temperature"]})).count() == 1


def test_nearest_file_wins(spark):
    of = lambda *s: S.named(spark.createDataFrame([(f"/d/tracking_{STEM.format(x)}.csv",) for x in s], "path string"), "tracking")
    m = S.named(spark.createDataFrame([(f"/d/{STEM.format(10)}.metadata",)], "path string"), "metadata")
    assert "12sec" in S.find(m, of(12, 7, 50)).first().other
    assert S.matches(m, of(50)).count() == 1 and S.matches(m, of(51)).count() == 0 and S.matches(m, of(51), None).count() == 1
    german = S.named(spark.createDataFrame([(f"/d/tracking_{STEM.format(12)}.csv".replace("Oct", "Okt"),)], "path string"), "tracking")
    assert S.find(m, german).first().other


def test_tables(spark, folder):
    m = S.read_metadata(spark, str(folder / "*.metadata")).first()
    assert m.file == STEM.format(10) and m.calibration.pix_per_mm == 2 and m.identity.ROIs == [[0, 0, 10, 20], [10, 0, 10, 20]]
    s = S.read_stimuli(spark, str(folder / "stim_*.json")).orderBy("position").collect()
    assert [(r.position, r.timestamp) for r in s] == [(0, 5), (1, 2)] and s[0].omr_angle_deg == 90 and s[1].omr_angle_deg is None and set(dims.PARAMETERS) <= set(s[0].asDict())
    t = S.read_tracking(spark, str(folder / "tracking_*.csv")).orderBy("index").collect()
    assert t[0].file == STEM.format(12) and t[0].centroid_x == 1.5 and t[1].centroid_y is None and "other" not in t[0].asDict()
    p = S.read_pose(spark, str(folder / (STEM.format(50) + ".csv")), ["Head", "Tail_0"]).orderBy("frame").collect()
    assert [(r.frame, r.Head_x, r.Head_likelihood, r.Tail_0_x) for r in p] == [(0, 1.5, 0.9, None), (1, None, 0.1, None)]
    assert S.read_pose(spark, str(folder / "none.csv"), ["Head"]).count() == 0 and S.read_temperature(spark, str(folder / "none.csv")).count() == 0
    assert S.read_timestamps(spark, str(folder / "tracking_*.csv")).columns == ["file", "index", "timestamp"]


def test_instances(spark):
    i = "instances array<struct<predicted: boolean, points: array<struct<x: double, y: double>>>>"
    d = spark.createDataFrame([(0, [(True, [(1.0, 1.0)]), (False, [(2.0, float("nan"))])]), (1, [(True, [])]), (2, []), (3, [(False, [(3.0, 3.0)])])], f"frame int, {i}")
    assert {r.frame for r in S.user_labelled(d).collect()} == {0, 3} and {r.frame for r in S.first_is_user(d).collect()} == {3}
    assert {r.frame: [tuple(p) for p in r.points] for r in S.first_user_instance(d).collect()} == {0: [(2.0, 0.0)], 3: [(3.0, 3.0)]}
    assert S.labelled_suggestions(spark.createDataFrame([(0,), (7,), (0,)], "frame int"), S.user_labelled(d), ["frame"]).count() == 2


def test_sinks(spark, folder, tmp_path):
    m = S.read_metadata(spark, str(folder / "*.metadata"))
    rois = K.rois_of(m)
    t = S.read_tracking(spark, str(folder / "tracking_*.csv")).withColumn("file", F.lit(STEM.format(10)))
    moved = {r.identity: r.centroid_x for r in K.split_by_roi(t, rois).collect()}
    assert moved == {0: 1.5, 1: 2.0}
    assert K.animal_metadata(m).count() == 2 and K.per_roi(t, rois).count() == 4
    out = str(tmp_path / "out")
    K.export({"tracking": t, "rois": rois}, out, ["tracking"])
    K.export({"tracking": t.limit(0)}, out)
    assert spark.read.parquet(out + "/tracking").count() == 2 and not (tmp_path / "out/rois").exists()
    K.append_table(t, out + "/tracking", ["identity"])
    K.write_csv(rois, str(tmp_path / "csv"))
    K.write_csv(rois, str(tmp_path / "csv"), append=True)
    assert spark.read.parquet(out + "/tracking").count() == 4 and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4


def test_datasets_by_path(spark, tmp_path):
    for line, cond in (("WT", "danieau"), ("mut", "drug")):
        (tmp_path / line / cond).mkdir(parents=True)
        (tmp_path / line / cond / "bout_frequency.csv").write_text("fish,n\na,1\n")
    (tmp_path / "other.csv").write_text("fish,n\nb,2\n")
    got = {(r.line, r.condition, r.fish) for r in S.read_datasets(spark, str(tmp_path)).collect()}
    assert got == {("WT", "danieau", "a"), ("mut", "drug", "a")}
    assert S.read_bouts(spark, str(tmp_path / "other.csv")).first().n == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("f", 10, 12, "a"), ("f", 30, 31, "b")], "file string, a long, z long, category string").write.parquet(src)
    trials = spark.createDataFrame([("f", 5, 20)], "file string, start long, stop long")
    live = spark.readStream.schema("file string, a long, z long, category string").parquet(src)
    q = streaming.attach_trials(live, trials, ["file"], "a", "z").writeStream.format("memory").queryName("attached").start()
    q.processAllAvailable()
    q.stop()
    assert [r.category for r in spark.table("attached").collect()] == ["a"]
    timed = live.withColumn("ts", F.timestamp_seconds("a"))
    q = streaming.counts(timed, "ts", "20 seconds", "1 second", ["category"]).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.category, r.n) for r in spark.table("counted").collect()} == {("a", 1), ("b", 1)}


def plain(v):
    return None if v is None else v if isinstance(v, (bool, str)) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else bytes(v) if isinstance(v, (bytes, bytearray)) else float(v) if v.__class__.__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    with duckdb.connect() as c:
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            p = Path(sf, f"{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
        o = c.execute(catalog.SQL[name])
        names = [x[0] for x in o.description]
        want = [tuple(plain(r[names.index(k)]) for k in cols) for r in o.fetchall()]
    got = [tuple(plain(r[k]) for k in cols) for r in df.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(names) == cols and sorted(got, key=key) == sorted(want, key=key)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['swimlane.llm'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') for n in e.queries()) and 'trials' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True).returncode == 0


def test_workers_find_the_package_from_any_folder(sf, tmp_path):
    """A session of its own, in another folder and without a PYTHONPATH."""
    code = f"import sys; sys.path.insert(0, {str(REPO)!r}); import __spark_entry__ as e; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.queries()['spline_model'](s, {sf!r}).count()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def test_plans(spark, sf):
    """Filters and columns reach the scan, and membership in epochs needs no join."""
    plan = catalog.rule_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_tax" not in plan
    from swimlane.operators.frequency import in_epochs
    from swimlane.plans.specs import epochs

    bv = spark.range(5).selectExpr("id as user_id", "'error' as stim", "1.0D as value")
    plan = in_epochs(bv, epochs(catalog.EPOCHS, {s: s for s in catalog.STIM}))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    plan = catalog.epoch_frequency(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 2  # the log and the bouts, each moved once
    for name in ("asof_state", "bout_in_trial", "nearest_frame", "frames_in_bout"):
        assert "NestedLoop" not in catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_columns_are_found_by_name_in_each_file_of_any_file_system(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b/tracking_x.csv").write_text("index,timestamp,identity\n1,100,0\n")
    (tmp_path / "a b/tracking_y.csv").write_text("timestamp,extra,index\n200,z,2\n")
    t = S.read_tracking(spark, f"file://{tmp_path}/a b/tracking_*.csv")
    assert sorted((r.file, r["index"], r.timestamp, r.identity) for r in t.collect()) == [("x", 1, 100, 0), ("y", 2, 200, None)]
    (tmp_path / "p.csv").write_text("scorer,s,s,s\nbodyparts,Head,Head,Head\ncoords,x,y,likelihood\n0,1.5,2,0.9\n")
    (tmp_path / "q.csv").write_text("scorer,s,s,s\nbodyparts,Head,Head,Head\ncoords,likelihood,y,x\n0,0.8,5,7\n")
    got = {r.file: (r.Head_x, r.Head_y, r.Head_likelihood) for r in S.read_pose(spark, f"file://{tmp_path}/[pq].csv", ["Head"]).collect()}
    assert got == {"p": (1.5, 2.0, 0.9), "q": (7.0, 5.0, 0.8)}
    (tmp_path / "temperature_z.csv").write_text("time,celsius\n1,28\n")
    assert S.read_temperature(spark, f"file://{tmp_path}/temperature_*.csv").first().celsius == "28"
    assert S.read_pose(spark, f"file://{tmp_path}/none*.csv", ["Head"]).count() == 0 and S.present(spark, None) == []
    with pytest.raises(ValueError):
        S.read_pose(spark, f"{tmp_path}/temperature_z.csv", ["Head"])
    with pytest.raises(FileNotFoundError):
        S.load(spark, {"metadata": f"{tmp_path}/none.metadata"})


def test_pose_tables_are_written_by_every_task(spark, sf, tmp_path):
    """A file a partition, each with its header, and none sorted by one task; a missing value is an empty field, and no rows leave a header."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("value", F.expr("if(event_id = 7, null, value)"))
    e.repartition(4).write.parquet(f"{tmp_path}/some/events.parquet")
    e.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    p = catalog.QUERIES["pose_csv"](spark, f"{tmp_path}/some")
    texts = [Path(f.removeprefix("file://")).read_text().splitlines() for f in p.inputFiles()]
    assert len(texts) == 5 and all(t[:3] == ["scorer,s,s,s", "bodyparts,Head,Head,Head", "coords,x,y,likelihood"] for t in texts)
    assert sorted(x for t in texts for x in t[3:] if x[0] in "sbc") == [] and sum(len(t) - 3 for t in texts) == e.count() > max(len(t) for t in texts)
    want = {(r.event_id, None if r.event_id % 3 == 0 else r.value, float(r.event_id % 50), 0.5, None) for r in e.collect()}
    got = [tuple(r) for r in p.collect()]
    assert len(got) == len(want) and set(got) == want and (7, None, 7.0, 0.5, None) in want
    assert catalog.QUERIES["pose_csv"](spark, f"{tmp_path}/none").collect() == []


def test_stimulus_logs_are_in_no_single_task(spark, sf, tmp_path):
    """A log keeps its lines' places however a table is split, and none is one row or sorted by one task."""
    for name, end in (("stim_a", "\n"), ("stim_b", "\r\n")):
        (tmp_path / f"{name}.json").write_bytes(end.join(json.dumps({"timestamp": i, "omr_angle_deg": i / 2}) if i % 10 else " " for i in range(400)).encode())
    (tmp_path / "stim_c.json").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for size in ("997b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = S.read_stimuli(spark, f"{tmp_path}/stim_*.json")
            assert sorted((r.file, r.position, r.timestamp, r.omr_angle_deg) for r in got.collect()) == [(f, i, i, i / 2) for f in "ab" for i in range(400) if i % 10]
            assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts of a small table
        q = catalog.QUERIES["stimuli_json"](spark, sf)
        assert len(set(q.inputFiles())) > 1
        e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'signup'").orderBy("ts", "event_id").collect()
        assert [(r.position, r.stim_select, r.omr_angle_deg) for r in q.orderBy("position").collect()] == [(i, r.event_id % 12, r.value) for i, r in enumerate(e)]
        spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
        assert catalog.QUERIES["stimuli_json"](spark, f"{tmp_path}/none").collect() == []
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
