"""No operator loses rows to NULL keys, missing models, late arrival, file layouts or NaN."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F, types as T

from flowlens.functions.coerce import prediction, slug_text
from flowlens.functions.numeric import clip
from flowlens.operators import constraints, models, split
from flowlens.operators.score import LinearModel, routed_score
from flowlens.sources import readers, sinks
from flowlens.streaming import alerts


def test_replay_keeps_rows_that_come_late(spark, tmp_path):
    root = str(tmp_path / "in")
    for day in (3, 2, 1, 2):  # newest first, one file a trigger, one file twice
        rows = [(f"k{day}-{i}", day) for i in range(10)]
        spark.createDataFrame(rows, "key string, day int").coalesce(1).write.mode("append").parquet(root)
    stream = alerts.flow_stream(spark, root, schema=spark.read.parquet(root).schema, glob="*.parquet", files_per_trigger=1)
    out = alerts.drain(alerts.dedupe_replay(stream, key=["key"]))
    assert sorted(r.key for r in out.collect()) == sorted(f"k{d}-{i}" for d in (1, 2, 3) for i in range(10))


def test_streams_without_input(spark, tmp_path):
    schema = T.StructType([T.StructField("ts", T.LongType()), T.StructField("prediction", T.IntegerType())])
    (tmp_path / "none").mkdir()
    stream = alerts.flow_stream(spark, str(tmp_path / "none"), schema=schema, glob="*.parquet")
    assert alerts.drain(alerts.session_rollup(stream, by="ts"), mode="complete").count() == 0
    assert alerts.drain_recent(stream, order=["ts"], cap=5).columns == ["ts", "prediction"]


def test_scores_that_are_not_numbers_pass_no_threshold(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, 0.5), (0.5, 0.5), (0.4, 0.5), (None, 0.5)], "s double, t double")
    got = [(r.p, r.c) for r in df.select(prediction("s", "t").alias("p"), clip("s", 0.0, 1.0).alias("c")).collect()]
    assert [p for p, _ in got] == [0, 1, 0, None] and math.isnan(got[0][1])


def test_models_are_found_by_slug(spark):
    df = spark.createDataFrame([("WiFi", 1.0), (" mqtt ", 1.0), ("other", 1.0), (None, 1.0)], "protocol_hint string, x double")
    m = {"Wi-Fi": LinearModel({"x": 1.0}), "MQTT": LinearModel({"x": -1.0}), "WiFi": LinearModel({"x": 2.0})}
    got = routed_score(df, m, {}, default="WiFi").collect()
    assert [r.protocol_used for r in got] == ["wifi", "mqtt", "wifi", "wifi"]
    assert [r.threshold for r in got] == [0.5] * 4 and [r.prediction for r in got] == [1, 0, 1, 1]
    assert slug_text("Wi-Fi") == "wi_fi" and slug_text(" ") == "unknown"
    with pytest.raises(ValueError):
        routed_score(df, {"WiFi": m["WiFi"], "wifi": m["MQTT"]}, {})


def test_rows_without_a_model_keep_a_place(spark):
    rows = [(g, float(i % 2), i % 2) for i in range(20) for g in ("a", None)] + [("new", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    fitted = models.train_logistic(df.where("g = 'a' or g is null"), features=["x"], label="y", by="g")
    assert list(fitted) == ["a", None]
    trees = models.train_boosted_trees(df.where("g = 'a'"), features=["x"], label="y", by="g", rounds=2, depth=1)
    scored = models.score_models(df, trees, features=["x"], label="y", by="g")
    assert scored.columns == ["g", "x", "y", "score_attack"] and scored.count() == 41
    assert scored.where("score_attack is null").count() == 21
    with pytest.raises(Exception, match="(?i)unresolved|cannot be resolved"):
        models.tune_trials(df, df, features=["missing"], label="y", by="g", max_fpr=0.1)


def test_floor_keeps_rows_without_a_decision(spark):
    rows = [("c1", i, 1, v) for i, v in enumerate([True] * 5 + [False, None])]
    df = spark.createDataFrame(rows, "capture string, row int, label int, is_val boolean")
    out = split.train_floor(df, stratum=F.col("label") == 1, capture="capture", row="row", floor=4, seed=1)
    assert out.count() == 7 and out.where("is_val is null").count() == 1
    event = split.train_floor_event(df, out, stratum=F.col("label") == 1, floor=4).first()
    assert event.asDict() == {
        "floor_target": 4, "floor_applied": True, "train_rows_before_floor": 1, "val_rows_before_floor": 5,
        "train_rows_after_floor": 4, "val_rows_after_floor": 2, "rows_moved": 3,
    }


def test_rows_without_a_profile_stay_and_are_locked(spark):
    profile = spark.createDataFrame([("a", [0.0, 0.0], [1.0, 1.0], [False, False])], "p string, p_lower array<double>, p_upper array<double>, p_locked array<boolean>")
    df = spark.createDataFrame([("a", [5.0, -1.0]), ("b", [5.0, -1.0]), (None, [2.0, 2.0])], "p string, x array<double>")
    out = constraints.attach_profile(df, profile, by="p").select("p", constraints.project_bounds(F.col("x"), F.col("x"), 2).alias("y"))
    assert {r.p: r.y for r in out.collect()} == {"a": [1.0, 0.0], "b": [5.0, -1.0], None: [2.0, 2.0]}


def csv_file(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    csv_file(tmp_path / "in", "a b.csv", "x,y\n1,10\n2,oops\n")
    csv_file(tmp_path / "in", "b.csv", "y,x,more\n5,50,z\n")
    csv_file(tmp_path / "in", "c.csv", "x,y\n")
    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
    got = readers.read_flows_csv(spark, str(tmp_path / "in"), schema=schema, source="file").collect()
    assert sorted((r.x, r.y) for r in got if r.y) == [(1, 10), (50, 5)] and [r.x for r in got if r.y is None] == [2]
    assert {r.file.rsplit("/", 1)[1] for r in got} == {"a b.csv", "b.csv"}
    csv_file(tmp_path / "in", "d.csv", "x,z\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_flows_csv(spark, str(tmp_path / "in"), schema=schema)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_captures_below_a_uri(spark, tmp_path, scheme):
    csv_file(tmp_path / "WiFI_and_MQTT" / "attacks" / "csv" / "train", "x+y%20z.csv", "a\n1\n")
    csv_file(tmp_path / "WiFI_and_MQTT" / "attacks" / "pcap", "no.csv", "a\n1\n")
    got = readers.discover_captures(spark, f"{scheme}{tmp_path}").collect()
    assert [r.source_relpath for r in got] == ["WiFI_and_MQTT/attacks/csv/train/x+y%20z.csv"]


def test_replay_is_rebuilt_when_its_inputs_change(spark, tmp_path):
    source, store = str(tmp_path / "source"), str(tmp_path / "store")
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").partitionBy().parquet(source)
        out = sinks.materialize_replay(spark, lambda: spark.read.parquet(source), store, {"a": 1}, [source])
        assert out.count() == n
    out = sinks.materialize_replay(spark, lambda: spark.range(99), store, {"a": 1}, [source])
    assert out.count() == 5


def test_rows_of_another_split_are_written_apart(spark, tmp_path):
    from flowlens.sources.sinks import write_splits

    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, None), (4, "holdout")], "id int, part string")
    paths = write_splits(df, str(tmp_path / "a"), split="part")
    ids = {name: sorted(r.id for r in spark.read.parquet(path).collect()) for name, path in paths.items()}
    assert ids == {"train": [1], "test": [2], "other": [3, 4]}
    assert set(write_splits(df.where("id < 3"), str(tmp_path / "b"), split="part")) == {"train", "test"}
