"""Inputs that used to give wrong answers or crashes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haze.config import ClassificationConfig
from haze.functions import features, scalers
from haze.operators import dedupe, grouped, joins, metrics, quality, split
from haze.plans import training
from haze.sources import files


def test_csv_columns_by_header_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("humidity,timestamp,extra,city,pm2.5,aqi,temperature,pressure,wind_speed\n"
                                    "50,2024-01-01 00:00:00.000000,x,A,1,2,20,1000,3\n")
    r = files.read_csv(spark, str(tmp_path)).first()
    assert (r["humidity"], r["temperature"], r["pm25"], r["city"]) == (50.0, 20.0, 1.0, "A")
    good, bad = files.read_csv_permissive(spark, str(tmp_path))
    assert good.first()["humidity"] == 50.0 and bad.count() == 0
    (tmp_path / "a.csv").write_text("humidity,city\n50,A\n")
    with pytest.raises(quality.DataQualityError, match="wind_speed"):
        files.read_csv(spark, str(tmp_path))


def test_least_squares_on_large_offsets(spark):
    rng = np.random.default_rng(1)
    x, z = 1.7e9 + rng.uniform(0, 1e5, 500), rng.normal(size=500)
    rows = [(str(i % 2), float(a), float(b), float(2 * a - 0.5 * b), 4.0) for i, (a, b) in enumerate(zip(x, z))]
    df = spark.createDataFrame(rows, "g string, x double, z double, y double, `c.d` double")
    for r in grouped.fit_per_group(df, "g", ["x", "z", "c.d"], "y").collect():
        assert r["b_x"] == pytest.approx(2, rel=1e-9) and r["b_z"] == pytest.approx(-0.5, rel=1e-4) and r["b_c.d"] == 0


def test_dedupe_keeps_rows_with_null_order_and_is_deterministic(spark):
    df = spark.createDataFrame([("a", None, 5), ("b", 2, 6), ("b", None, 7), ("c", 1, 9), ("c", 1, 8)], "k string, o int, v int")
    for n in (1, 4):
        got = {r["k"]: (r["o"], r["v"]) for r in dedupe.dedupe_keep_first(df.repartition(n), ["k"], "o").collect()}
        assert got == {"a": (None, 5), "b": (2, 6), "c": (1, 8)}


def test_null_label_is_no_class(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "y string")
    coded, model = features.label_index(df, "y")
    assert {r["y"]: r["label_idx"] for r in coded.collect()} == {"a": 0, "b": 1, None: None}
    assert list(model.labels) == ["a", "b"]


def test_dotted_category_can_be_scaled(spark):
    df = spark.createDataFrame([("St. Louis", 1.0), ("Rome", 3.0)], "city string, x double")
    out = scalers.scale(features.one_hot(df, "city"), ["x", "city_St. Louis"], "minmax")
    assert sorted(r["city_St. Louis"] for r in out.collect()) == [0.0, 1.0]


def test_twenty_thousand_categories(spark):
    df = spark.range(20_000).select(F.concat(F.lit("v"), "id").alias("c"))
    assert len(features.category_values(df, "c")) == 20_000


def test_splits_of_repeated_null_and_equal_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    flagged = split.holdout_split(df, ["k"], 0.2)
    assert flagged.where("is_test = 1").count() == 200
    nulls = spark.createDataFrame([(None, i) for i in range(50)], "k long, v int")
    assert split.holdout_split(nulls, ["k"], 0.2).where("is_test = 1").count() == 10
    equal = spark.createDataFrame([(1, "x")] * 300 + [(2, "y")] * 50, "k long, v string")
    folds = split.kfold(equal, ["k"], 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [70] * 5


def test_two_thousand_strata(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 2000).alias("g"))
    sizes = split.holdout_split(df, ["id"], 0.2, strata=["g"]).where("is_test = 1").groupBy("g").count()
    assert sizes.count() == 2000 and sizes.where("count <> 1").count() == 0


def test_two_thousand_classes(spark):
    df = spark.range(2000).select(F.col("id").alias("y"), ((F.col("id") + F.col("id") % 2) % 2000).alias("y_hat"))
    m = metrics.confusion_matrix(df)
    assert m.count() == 2000 ** 2 and m.agg(F.sum("n")).first()[0] == 2000


def test_asof_with_a_hot_key_and_ties(spark):
    left = spark.range(5000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") % 60).alias("t"), F.col("id").alias("i"))
    left = left.unionByName(spark.createDataFrame([(None, None, -1), ("cold", None, -2)], "k string, t timestamp, i long"))
    right = spark.createDataFrame([("hot", 10, 1.0), ("hot", 10, 7.0), ("hot", 30, 2.0), (None, 0, 9.0), ("hot", None, 5.0)],
                                  "k string, s int, v double").select("k", F.timestamp_seconds("s").alias("rt"), "v")
    out = joins.asof_join(left, right, ["k"], "t", "rt")
    assert out.count() == 5002
    for r in out.collect():
        s = r["i"] % 60
        assert r["v"] == (None if r["i"] < 0 or s < 10 else 7.0 if s < 30 else 2.0)


def test_training_reads_text_times_and_fills_the_target(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        x = float(rng.normal())
        rows.append((i, f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00", None if i % 40 == 7 else ("hi" if x > 0 else "lo"),
                     x, float(rng.normal()), ["St. Louis", "Rome"][i % 2]))
    df = spark.createDataFrame(rows, "reading_id long, ts string, aqi_class string, x double, z double, city string")
    cfg = ClassificationConfig(cv_folds=2, max_features=4, outlier_method="zscore")
    prep = training.prepare(df, cfg, "classification")
    assert prep.labels == ["hi", "lo"] and prep.data.where("label > 1").count() == 0
    assert {"hour", "city_St_ Louis"} & set(prep.candidates) and not any(c.startswith("ts_") for c in prep.candidates)
