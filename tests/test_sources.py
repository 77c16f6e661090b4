"""Files in and out."""

import json

import pytest
from pyspark.sql import functions as F

from evospark.models.__main__ import run
from evospark.operators import logs as L
from evospark.sources import files
from evospark.streaming import streams


def _record(i, fitness):
    config = {c: float((i * (k + 3)) % 17) for k, c in enumerate(files.CONFIG)}
    return {"config": config, "aero": {"ld": None}, "fitness": fitness}


def test_dataset(spark, tmp_path):
    path = tmp_path / "d.json"
    text = json.dumps([_record(i, float(sum(_record(i, 0)["config"].values()))) for i in range(60)] + [_record(99, -1e9)])
    path.write_text(text[:-1] + ', {"config": null, "aero": null, "fitness": NaN}]')
    assert files.load_dataset(spark, f"file://{path}").count() == 60
    assert run(spark, f"file://{path}", "knn")["test"]["rmse"] >= 0
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps([_record(1, -1e9)]))
    with pytest.raises(ValueError):
        files.load_dataset(spark, f"file://{bad}")


def test_tolerant_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([_record(1, 2.0), {"fitness": None}]))
    assert files.load_tolerant(spark, f"file://{path}").count() == 1


def test_runs(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text('{"generation": 1, "best_fitness": 2.5}\n\n{"generation": 0}\n')
    rows = files.read_runs(spark, f"file://{tmp_path}/*.jsonl")
    assert rows.count() == 4 and rows.select("run").distinct().count() == 2


def test_mesh(spark, tmp_path):
    d = spark.createDataFrame([(1, 100.0, 50.0, 25.0, 10.0, 2.0)], "id long, wing_span double, wing_root_chord double, wing_tip_chord double, wing_sweep double, naca_m double")
    facets = files.wing_facets(d, sections=6)
    assert facets.count() == 6 * 2 * 2 * 2
    files.write_stl(facets.union(facets.withColumn("id", F.lit(2))), f"file://{tmp_path}/m")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/m").collect()]
    assert sum("vertex" in x for x in lines) == 2 * 3 * 48 and {x for x in lines if "solid" in x} == {f"{w} airframe-{k}" for w in ("solid", "endsolid") for k in (1, 2)}
    normals = [[float(v) for v in x.split()[2:]] for x in lines if "normal" in x]
    assert all(abs(sum(v * v for v in n) - 1) < 1e-9 or n == [0.0, 0.0, 0.0] for n in normals) and sum(any(n) for n in normals) > 80


def test_log_lines_come_back_by_tail(spark, tmp_path):
    rows = spark.createDataFrame([("worker-1", "ERROR", "lost"), ("worker-2", "INFO", "fine")], "container_name string, level string, message string")
    files.write_log(rows, f"file://{tmp_path}/log")
    lines = streams.normalized(streams.tail_files(spark, {"logs.worker": f"file://{tmp_path}/log"}))
    sent = []
    push = streams.push_to_clients(lines, {"all": L.Filter(), "errors": L.Filter(level="ERROR")}, lambda client, kind, df: sent.append((client, kind, df.count())), once=True)
    push.awaitTermination()
    assert sent == [("all", "logs", 2), ("all", "candidates", 0), ("all", "stats", 2), ("errors", "logs", 1), ("errors", "candidates", 0), ("errors", "stats", 2)]
    live = streams.to_memory(streams.live_best(lines), "tailed", "complete")
    assert live.count() == 0 and "event_id" in live.columns
