"""The jobs: same rows as their SQL, safe reruns, and only what is new over a growing input."""

import json
import logging
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs import log_archive, registered, training_set  # noqa: E402
from jobs.settings import from_command_line  # noqa: E402

DATA = "/root/testdata/sf0.001"
rows_of = lambda df: sorted(map(str, df.collect()))


def _norm(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = registered.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    res = con.execute(registered.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall())
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect()) == want


# The archive


def documents(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text")).coalesce(1).write.mode("append").parquet(path)


FIRST = [(1, "ERROR: disk 7 full\nall good\n\n  \nWARN low 12", "web"), (2, None, "web"), (3, "", "db"), (4, "id 1\nid 2\r\nid 33", "web")]
LATER = [(5, "id 4\n[FATAL] gone", "web"), (6, "x", None), (7, "INFO ok", ""), (1, "ERROR: disk 7 full", "web"), (8, '{"level": "debug", "message": "m 9", "island_id": "i2"}', "db")]


@pytest.fixture
def archive(tmp_path):
    return log_archive.Settings(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", 1)


def test_archive_takes_only_what_is_new(spark, archive, tmp_path, caplog):
    documents(spark, FIRST, archive.input)
    with caplog.at_level(logging.INFO):
        assert log_archive.run(spark, archive) == 4
    assert "wrote 6 lines of 5 templates" in caplog.text and "read 4 new documents" in caplog.text
    first = rows_of(log_archive.read_lines(spark, archive))
    assert log_archive.run(spark, archive) == 0 and rows_of(log_archive.read_lines(spark, archive)) == first
    documents(spark, LATER, archive.input)
    assert log_archive.run(spark, archive) == 5
    grown = log_archive.read_lines(spark, archive)
    assert set(first) < set(rows_of(grown)) and grown.count() == 12
    got = {(r["doc_id"], r["line_no"]): r for r in grown.filter("batch = 1").collect()}
    assert got[(5, 1)]["level"] == "ERROR" and got[(8, 0)]["island"] == "i2" and got[(8, 0)]["level"] == "DEBUG" and got[(6, 0)]["source"] == got[(7, 0)]["source"] == "unknown"
    counts = {(r["source"], r["template"]): r["n"] for r in log_archive.read_templates(spark, archive).collect()}
    assert counts[("web", "id #")] == 3 and counts[("web", "id #\r")] == 1 and counts[("web", "ERROR: disk # full")] == 2
    assert sum(counts.values()) == 12


def test_archive_in_two_runs_equals_one(spark, archive, tmp_path):
    documents(spark, FIRST, archive.input)
    log_archive.run(spark, archive)
    documents(spark, LATER, archive.input)
    log_archive.run(spark, archive)
    once = log_archive.Settings(archive.input, f"{tmp_path}/once", f"{tmp_path}/once-mark")
    assert log_archive.run(spark, once) == 9
    lines = lambda s: rows_of(log_archive.read_lines(spark, s).drop("batch"))
    assert lines(archive) == lines(once)
    assert rows_of(log_archive.read_templates(spark, archive)) == rows_of(log_archive.read_templates(spark, once))


def test_a_batch_that_runs_again_changes_nothing(spark, archive):
    documents(spark, FIRST, archive.input)
    log_archive.run(spark, archive)
    before = rows_of(log_archive.read_lines(spark, archive)), rows_of(log_archive.read_templates(spark, archive))
    log_archive.write_batch(spark.read.schema(log_archive.DOCUMENTS).parquet(archive.input), 0, archive)
    assert (rows_of(log_archive.read_lines(spark, archive)), rows_of(log_archive.read_templates(spark, archive))) == before


def test_archive_caches_no_lines(spark, archive, monkeypatch):
    """A cached partition holds a split's lines, several times its bytes, and one task reads it."""
    documents(spark, FIRST, archive.input)
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *a: pytest.fail("cached"))
    log_archive.write_batch(spark.read.schema(log_archive.DOCUMENTS).parquet(archive.input), 3, archive)
    counts = {(r["source"], r["template"]): r["n"] for r in log_archive.read_templates(spark, archive).collect()}
    assert counts == {("web", "ERROR: disk # full"): 1, ("web", "all good"): 1, ("web", "WARN low #"): 1, ("web", "id #"): 2, ("web", "id #\r"): 1}


def test_archive_of_empty_texts(spark, archive):
    documents(spark, [(1, None, "a"), (2, " \n ", None)], archive.input)
    assert log_archive.run(spark, archive) == 2
    assert log_archive.read_lines(spark, archive).count() == 0 and log_archive.read_templates(spark, archive).count() == 0


# The training set


def genomes(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2).write.mode("append").parquet(path)


def test_training_set(spark, tmp_path, caplog):
    settings = training_set.Settings(f"{tmp_path}/in", f"{tmp_path}/out", genes=10, members=10, generations=2)
    v = lambda i: [((i * 37 + k * 11) % 41) / 20.5 - 1 for k in range(12)]
    odd = [(900, None, 0), (901, [0.1], 0), (902, [float("nan")] * 10, 0), (903, [None] * 10, 0), (904, [float("inf")] + [0.0] * 9, 0), (None, v(1), 0)]
    genomes(spark, [(i, v(i % 30), 0) for i in range(60)] + odd, settings.input)
    with caplog.at_level(logging.INFO):
        samples = training_set.run(spark, settings)
    assert "read 66 rows" in caplog.text and "wrote 30 samples of eras 0 to 1" in caplog.text
    first = rows_of(samples)
    assert sorted(r["vec_id"] for r in samples.collect()) == list(range(30))
    assert rows_of(training_set.run(spark, settings)) == first
    files = sorted(f"{d}/{x}" for d, _, names in os.walk(f"{settings.output}/samples") for x in names if x.endswith(".parquet"))
    # new eras only: the old partitions' files stay as they are, and no design changes its part
    genomes(spark, [(100 + i, v(i + 40), 0) for i in range(1)] + [(100 + i, [0.01 * i] * 10, 0) for i in range(1, 40)], settings.input)
    grown = training_set.run(spark, training_set.Settings(settings.input, settings.output, genes=10, members=10, generations=2, first_era=5))
    assert set(first) < set(rows_of(grown)) and set(files) < {f"{d}/{x}" for d, _, names in os.walk(f"{settings.output}/samples") for x in names}
    report = training_set.read(spark, settings, "report")
    assert report.agg(F.sum("designs")).first()[0] == grown.count()
    scaler = {r["dim"]: r["mean"] for r in training_set.read(spark, settings, "scaler").collect()}
    train = [r["g"] for r in grown.filter("part = 'train'").collect()]
    assert scaler[3] == pytest.approx(sum(g[3] for g in train) / len(train))


def test_training_set_of_nothing(spark, tmp_path):
    settings = training_set.Settings(f"{tmp_path}/in", f"{tmp_path}/out")
    genomes(spark, [(1, None, 0)], settings.input)
    assert training_set.run(spark, settings).count() == 0
    assert training_set.read(spark, settings, "report").count() == 0


def test_settings_from_file_and_command_line(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"input": "a", "output": "b", "genes": 4}))
    got = from_command_line(training_set.Settings, ["--config", str(path), "--output", "z", "--members", "7"], "")
    assert got == training_set.Settings("a", "z", genes=4, members=7)
    path.write_text(json.dumps({"inputs": "a"}))
    with pytest.raises(SystemExit):
        from_command_line(training_set.Settings, ["--config", str(path)], "")


def test_command_line_starts_and_stops_a_session(tmp_path):
    """In a process of its own, since it stops the session."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    command = [sys.executable, "-m", "jobs.log_archive", "--config", f"{root}/jobs/log_archive.json", "--input", f"{DATA}/documents*.parquet", "--output", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/c"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run(command, cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 new documents" in done.stderr
