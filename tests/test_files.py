import json
import os

import pytest

from tidegrid.session import scratch_path
from tidegrid.sources import readers, writers


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_series(spark, tmp_path):
    path = put(tmp_path, "a.csv", "timestamp,load\n2023-01-01 00:00:00,1.5\n2023-01-01 01:00:00,oops\n2023-01-01T02:00:00+02:00,NaN\n")
    rows = readers.read_series(spark, path, timezone="Europe/Berlin").orderBy("timestamp").collect()
    assert [str(r.timestamp) for r in rows] == ["2022-12-31 23:00:00", "2023-01-01 00:00:00", "2023-01-01 00:00:00"]
    assert sorted([r.load is None for r in rows]) == [False, True, True]


def test_reader_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_series(spark, str(tmp_path / "none.csv"))
    bad = put(tmp_path, "bad.csv", "wrong_col\n1\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_series(spark, bad)
    with pytest.raises(ValueError, match="Unsupported"):
        readers.read_series(spark, bad, file_format="xlsx")


def test_missing_events_file_is_empty(spark, tmp_path):
    out = readers.read_grid_events(spark, str(tmp_path / "none.csv"))
    assert out.count() == 0 and "duration_hours" in out.columns


def test_wide_meter(spark, tmp_path):
    path = put(tmp_path, "m.csv", ";MT_001;MT_002\n2012-01-01 00:15:00;1,5;2\nbroken;3;4\n2012-01-01 00:30:00;;7,25\n")
    rows = {(r.series_id, str(r.timestamp)[-8:]): r.kw for r in readers.read_wide_meter(spark, path).collect()}
    assert rows == {("MT_001", "00:15:00"): 1.5, ("MT_002", "00:15:00"): 2.0, ("MT_001", "00:30:00"): None, ("MT_002", "00:30:00"): 7.25}


def test_payload(spark, tmp_path):
    doc = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "shortwave_radiation": [1, 2.5]}}
    path = put(tmp_path, "p.json", json.dumps(doc))
    rows = readers.read_hourly_json(spark, path).orderBy("timestamp").collect()
    assert [r.ghi for r in rows] == [1.0, 2.5] and rows[0].dni is None
    with pytest.raises(Exception, match="no hourly section"):
        readers.read_hourly_json(spark, put(tmp_path, "q.json", "{}")).collect()


def test_writers(spark, load, tmp_path):
    with pytest.raises(ValueError):
        writers.write_table(load, str(tmp_path / "t"), "orc")
    csv = writers.write_table(load, str(tmp_path / "c"), "csv")
    assert not [n for n in os.listdir(csv) if "snappy" in n]
    parquet = writers.write_table(load, str(tmp_path / "p"))
    assert [n for n in os.listdir(parquet) if n.endswith("snappy.parquet")]
    assert readers.read_features(spark, parquet).count() == 720


def test_cache_is_built_once(spark, load):
    path, calls = scratch_path(spark, "cache"), []

    def build():
        calls.append(1)
        return load

    assert readers.read_through_cache(spark, path, build).count() == 720
    assert readers.read_through_cache(spark, path, build).count() == 720 and len(calls) == 1


def test_scoring_needs_all_features(load):
    from pyspark.ml.feature import SQLTransformer

    model = SQLTransformer(statement="SELECT *, load * 2 AS prediction FROM __THIS__")
    assert writers.score_batch(load, model, ["load"]).columns == ["series_id", "timestamp", "prediction"]
    with pytest.raises(ValueError, match="temperature"):
        writers.score_batch(load, model, ["temperature"])


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tidegrid import session

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Fake:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake())
