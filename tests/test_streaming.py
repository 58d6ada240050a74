import math
import random

import pytest
from rowsets import as_set
from pyspark.sql import functions as F

from tidegrid.functions.temporal import cyclical_features
from tidegrid.session import scratch_path
from tidegrid.streaming import jobs
from tidegrid.streaming.detectors import Adwin, PageHinkley, make_detector
from tidegrid.streaming.learner import OnlineLinear, online_learner


START = 1700006400  # midnight


def feed(spark, frames, files_per_batch=1):
    """A file stream that delivers one frame per micro-batch, in order."""
    import time

    path = scratch_path(spark, "feed")
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source orders by modification time in seconds
    return jobs.stream_parquet(spark, path, frames[0].schema, files_per_batch=files_per_batch)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), START + 3600 * h + rng.randint(0, 3599), round(rng.random(), 2)) for h in range(48) for _ in range(5)]
    return spark.createDataFrame(rows, "series_id string, t long, value double").selectExpr("series_id", "timestamp_seconds(t) AS timestamp", "value").cache()


def test_resampling_equals_batch_and_drops_late_rows(spark, events):
    cut = F.timestamp_seconds(F.lit(START + 24 * 3600))
    first, second = events.where(F.col("timestamp") < cut), events.where(F.col("timestamp") >= cut)
    late = spark.sql("SELECT 'a' AS series_id, timestamp_seconds(1700006500) AS timestamp, 1000.0D AS value")
    # a row counts as late against the watermark of the batch before
    stream = feed(spark, [first, second, late])
    got = jobs.run_to_table(jobs.stream_resample_hourly(stream), scratch_path(spark, "out"))
    batch = events.groupBy("series_id", F.date_trunc("hour", "timestamp").alias("timestamp")).agg(F.sum("value").alias("load"))
    closed = batch.where(F.unix_seconds("timestamp") + 3600 <= F.lit(events.agg(F.unix_seconds(F.max("timestamp"))).first()[0] - 7200))
    rounded = lambda d: as_set(d.select("series_id", "timestamp", F.round("load", 6).alias("load")))
    assert rounded(got) == rounded(closed)


def test_dedupe_across_batches(spark, events):
    hours = events.select("series_id", F.date_trunc("hour", "timestamp").alias("timestamp"))
    part = hours.where(F.hour("timestamp") >= 0)
    last = hours.where(F.col("timestamp") >= F.lit(hours.agg(F.max("timestamp")).first()[0]))
    out = jobs.run_to_table(jobs.stream_dedupe(feed(spark, [part, last])), scratch_path(spark, "out"))
    assert as_set(out) == as_set(hours.distinct())


X = ["hour_sin", "hour_cos"]


def test_learner_state_survives_batches(spark, load):
    rows = cyclical_features(load).select("series_id", "timestamp", "load", *X)
    half = F.timestamp_seconds(F.lit(1672531200 + 3600 * 360))
    parts = [rows.where(F.col("timestamp") < half), rows.where(F.col("timestamp") >= half)]
    two = jobs.run_to_table(online_learner(feed(spark, parts), X), scratch_path(spark, "two")).orderBy("timestamp").collect()
    model, want = OnlineLinear(2), []
    for r in rows.orderBy("timestamp").collect():
        want.append(model.learn([r.hour_sin, r.hour_cos], r.load)[0])
    assert [r.y_pred for r in two] == pytest.approx(want) and [r.sample_number for r in two] == list(range(1, 721))
    assert two[-1].rmse < 1.5 and two[-1].r2 > 0


def test_learner_skips_old_rows(spark, load):
    rows = cyclical_features(load).select("series_id", "timestamp", "load", *X)
    newest = rows.where(F.col("timestamp") >= F.timestamp_seconds(F.lit(1672531200 + 3600 * 700)))
    older = rows.where(F.col("timestamp") < F.timestamp_seconds(F.lit(1672531200 + 3600 * 10)))
    more = spark.createDataFrame([("a", 1672531200 + 3600 * 800, 5.0, 0.0, 1.0)], "series_id string, t long, load double, hour_sin double, hour_cos double").selectExpr("series_id", "timestamp_seconds(t) AS timestamp", "load", *X)
    out = jobs.run_to_table(online_learner(feed(spark, [newest, older, more]), X), scratch_path(spark, "late"))
    assert out.count() == 21 and out.agg(F.max("late_rows")).first()[0] == 10


def _in_one_go(rows):
    model = OnlineLinear(2)
    return [model.learn([r.hour_sin, r.hour_cos], r.load)[0] for r in rows]


@pytest.mark.parametrize("pane", [6, 1])
def test_late_rows_inside_the_watermark_are_learned_in_order(spark, load, pane):
    rows = cyclical_features(load).select("series_id", "timestamp", "load", *X)
    hour = ((F.unix_seconds("timestamp") - 1672531200) / 3600).cast("int")
    # odd hours of each stretch come a batch after the even ones
    parts = [rows.where((hour >= a) & (hour < a + 240) & (hour % 2 == odd)) for a in (0, 240, 480) for odd in (0, 1)]
    stream = online_learner(feed(spark, parts), X, delay="20 days", pane_hours=pane)
    got = jobs.run_to_table(stream, scratch_path(spark, "ordered")).orderBy("sample_number").collect()
    # closed: panes that end 20 days before the newest hour
    whole = rows.orderBy("timestamp").limit((719 - 480) // pane * pane).collect()
    assert [r.timestamp for r in got] == [r.timestamp for r in whole]
    assert [r.y_pred for r in got] == pytest.approx(_in_one_go(whole))
    assert all(r.late_rows == 0 for r in got)


def test_learner_holds_one_pane_of_a_batch(spark, load):
    """A batch of many chunks, in no order, with gaps, copies and rows without a value."""
    rows = cyclical_features(load).select("series_id", "timestamp", "load", *X)
    gaps = rows.withColumn("load", F.when(F.hour("timestamp") != 5, F.col("load")))
    mixed = gaps.unionByName(gaps.where("hour(timestamp) = 7")).orderBy(F.hash("timestamp"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = jobs.run_to_table(online_learner(feed(spark, [mixed]), X, pane_hours=10), scratch_path(spark, "panes")).orderBy("sample_number").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = rows.where("hour(timestamp) <> 5").orderBy("timestamp").collect()
    assert [r.timestamp for r in got] == [r.timestamp for r in whole] and got[-1].late_rows == 30
    assert [r.y_pred for r in got] == pytest.approx(_in_one_go(whole))


def test_learner_converges():
    rng, model = random.Random(1), OnlineLinear(1, detector=None)
    for _ in range(3000):
        x = rng.gauss(3, 2)
        model.learn([x], 7 + 4 * x)
    assert model.predict([5.0]) == pytest.approx(27, abs=0.5)
    again = OnlineLinear(1, detector=None).load(model.dump())
    assert again.predict([5.0]) == model.predict([5.0])


@pytest.mark.parametrize("detector", [Adwin(), PageHinkley(20.0)])
def test_detectors_find_a_jump(detector):
    rng = random.Random(4)
    calm = [detector.update(rng.gauss(1, 0.3)) for _ in range(1000)]
    jump = [detector.update(rng.gauss(4, 0.3)) for _ in range(300)]
    assert not any(calm) and any(jump)
    if isinstance(detector, Adwin):
        assert detector.mean > 3.5 and detector.width < 400


def test_adwin_buckets_grow_slowly():
    a = Adwin()
    for i in range(5000):
        a.update(math.sin(i))
    assert len(a.buckets) < 80 and a.width == 5000
    b = make_detector("adwin").load(a.dump())
    assert b.width == a.width
    with pytest.raises(ValueError):
        make_detector("other")


def test_performance_batches_are_replaced_not_doubled(spark, load):
    rows = load.selectExpr("series_id", "'m' AS model", "timestamp", "load AS y_true", "load + 1 AS y_pred")
    base = spark.createDataFrame([("a", "m", 0.5)], "series_id string, model string, baseline_rmse double")
    out = jobs.stream_performance_alert(feed(spark, [rows]), base, scratch_path(spark, "perf"))
    assert out.count() == 30 and out.where("alert = 1 AND abs(degradation - 1) < 1e-9").count() == 30


def test_a_day_in_two_batches_is_one_record(spark, load):
    rows = load.selectExpr("series_id", "'m' AS model", "timestamp", "load AS y_true", "load + 1 AS y_pred")
    halves = [rows.where("hour(timestamp) % 2 = 0"), rows.where("hour(timestamp) % 2 = 1")]
    base = spark.createDataFrame([("a", "m", 0.5)], "series_id string, model string, baseline_rmse double")
    out = jobs.stream_performance_alert(feed(spark, halves), base, scratch_path(spark, "perf"), delay="60 days").collect()
    assert len(out) == 30
    assert {r.n_samples for r in out} == {24}
    assert all(r.rmse == pytest.approx(1) and r.alert == 1 for r in out)


def test_learner_names_its_key_and_keeps_digits(spark, load):
    far = load.selectExpr("series_id AS meter", "timestamp", "load + 1e8 AS load").orderBy("timestamp")
    out = jobs.run_to_table(online_learner(feed(spark, [cyclical_features(far)]), X, key="meter"), scratch_path(spark, "key"))
    assert out.columns[:2] == ["meter", "timestamp"]
    values = [r.load for r in far.orderBy("timestamp").collect()]
    last = out.orderBy("sample_number").collect()[-1]
    mean = sum(values) / len(values)
    spread = sum((v - mean) ** 2 for v in values)
    assert last.r2 == pytest.approx(1 - last.rmse**2 * len(values) / spread, rel=1e-4)


def test_hybrid_weights(spark, load):
    batch = load.selectExpr("series_id", "timestamp", "load AS y_true", "1.0D AS y_pred")
    online = load.limit(10).selectExpr("series_id", "timestamp", "2.0D AS y_pred")
    got = jobs.hybrid_forecast(batch, online, 0.5).groupBy("hybrid_pred").count().collect()
    assert {r.hybrid_pred: r["count"] for r in got} == {2.0: 10, 1.0: 710}
