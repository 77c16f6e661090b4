"""Live state against plain folds over the events, and lines of files that grow."""

import collections
import random

from pyspark.sql import functions as F

from evospark.streaming import live, streams, tail


def run(spark, path, batches, schema, op):
    """The rows each run of a stream writes; every batch of rows arrives after the run before."""
    out = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        got = live.to_folder(op(stream), f"{path}/out", f"{path}/mark")
        out.append([tuple(r)[:-1] for r in got.filter(F.col("batch") == n).collect()])
    return out


def test_rings(spark, tmp_path):
    rng = random.Random(1)
    ids = iter(range(10_000))
    batches = [[(next(ids), rng.choice("aab")) for _ in range(n)] for n in (3, 40, 1, 200, 17)]
    for batch in batches:
        rng.shuffle(batch)
    got = run(spark, tmp_path, batches, "event_id long, source string", lambda s: live.log_ring(s, 20))
    rings, arrivals = collections.defaultdict(list), collections.Counter()
    for batch, rows in zip(batches, got):
        for i, source in sorted(batch):
            rings[source].append(i)
            arrivals[source] += 1
            if len(rings[source]) > 25:
                rings[source] = rings[source][-16:]
        assert sorted(rows) == sorted((s, i, arrivals[s]) for s in {s for _, s in batch} for i in rings[s])


def test_drift_and_activation(spark, tmp_path):
    rows = lambda n, fresh, leaf: [(1, leaf + i % 2, i < fresh) for i in range(n)]
    got = run(spark, tmp_path, [rows(40, 10, 3), rows(20, 20, 8), rows(10, 1, 5), rows(2, 0, 0)], "node long, leaf int, fresh boolean", lambda s: live.drift(s, 50, 0.4))
    assert got == [[(1, 40, 10, 0, False, [3, 4])], [(1, 60, 30, 0, True, [3, 4, 8, 9])], [(1, 70, 1, 1, False, [5])], [(1, 72, 1, 1, False, [5])]]


def test_mailbox_is_drained_once(spark, tmp_path):
    batches = [[(0, 1, False), (0, 2, False), (1, 3, True)], [(0, 5, True), (0, 4, False), (0, 6, True), (0, 7, False)], [(0, 8, True), (1, 9, True)]]
    got = run(spark, tmp_path, batches, "island long, event_id long, drains boolean", live.mailbox)
    assert [sorted(x) for x in got] == [[], [(0, 5, 1), (0, 5, 2), (0, 5, 4)], [(0, 8, 7)]]


def test_ages(spark, tmp_path):
    rng = random.Random(4)
    batches = [[(rng.randint(0, 1), rng.randint(0, 30), g + rng.randint(0, 2)) for _ in range(25)] for g in (0, 1, 4, 9, 2, 12)]
    got = run(spark, tmp_path, batches, "island long, id long, generation long", lambda s: live.ages(s, 3))
    last, now = collections.defaultdict(dict), {}
    for batch, rows in zip(batches, got):
        for island, i, g in batch:
            now[island] = max(now.get(island, 0), g)
            last[island][i] = max(last[island].get(i, -1), g)
        for island in last:
            last[island] = {i: g for i, g in last[island].items() if now[island] - g <= 3}
        assert sorted(rows) == sorted((k, now[k], i, g) for k in {k for k, _, _ in batch} for i, g in last[k].items())


def test_the_setting_comes_back(spark, tmp_path):
    spark.conf.unset(live.PROVIDER)
    before = spark.conf.get(live.PROVIDER)
    run(spark, tmp_path, [[(0, 1, False)]], "island long, event_id long, drains boolean", live.mailbox)
    assert spark.conf.get(live.PROVIDER) == before


# Lines of files that grow


def tailed(spark, globs, path):
    """All lines so far, after one more run."""
    return [tuple(r) for r in live.to_folder(streams.tail_files(spark, globs), f"{path}/out", f"{path}/mark").orderBy("event_id").select("event_id", "raw", "topic").collect()]


def test_tail_takes_each_line_once(spark, tmp_path):
    log, globs = tmp_path / "log", {"logs.worker": f"file://{tmp_path}/log/w*.log", "logs.lead": f"file://{tmp_path}/log/lead.log"}
    log.mkdir()
    (log / "w1.log").write_text("one\ntwo\nhal")
    (log / "lead.log").write_text("é first\r\n")
    first = tailed(spark, globs, tmp_path)
    assert [(r, t) for _, r, t in first] == [("é first", "logs.lead"), ("one", "logs.worker"), ("two", "logs.worker")]
    with (log / "w1.log").open("a") as f:
        f.write("f\n\nfour\n")
    (log / "w2.log").write_text("x\n")
    (log / "other.txt").write_text("no\n")
    second = tailed(spark, globs, tmp_path)
    assert second[:3] == first and [r for _, r, _ in second[3:]] == ["half", "", "four", "x"]
    assert tailed(spark, globs, tmp_path) == second  # a restart reads nothing twice
    with (log / "w1.log").open("a") as f:
        f.write("five\n")
    third = tailed(spark, globs, tmp_path)
    ids = [i for i, _, _ in third]
    assert third[:-1] == second and third[-1][1] == "five" and ids == sorted(set(ids))


def test_ranges_of_a_long_file(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abc é") for _ in range(rng.choice([0, 1, 5, 90]))) for _ in range(300)]
    path = tmp_path / "a.log"
    path.write_text("\n".join(lines) + "\nunfinished", encoding="utf-8")
    monkeypatch.setattr(tail, "RANGE", 64)
    monkeypatch.setattr(tail, "LOOK", 16)
    reader = tail.TailReader({"t": str(path)})
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    got = [row for p in parts for row in reader.read(p)]
    assert len(parts) > 50 and [r[1] for r in got] == lines
    places = [0]
    for line in lines:
        places.append(places[-1] + len(line.encode()) + 1)
    assert [r[0] for r in got] == places[:-1]


def test_a_shorter_file_starts_anew(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("old line\n")
    reader = tail.TailReader({"t": str(path)})
    first = reader.latestOffset()
    path.write_text("new\n")
    second = reader.latestOffset()
    assert [r[1] for p in reader.partitions(first, second) for r in reader.read(p)] == ["new"]
    assert tail.listed(f"{tmp_path}/none/*.log") == {}


def test_halves_share_one_middle(spark, tmp_path, monkeypatch):
    """A middle that is found anew comes out elsewhere, as sketches merged in another order do; no row is lost or doubled."""
    monkeypatch.setattr(F, "percentile_approx", lambda c, _: (F.max(c) + F.unix_micros(F.current_timestamp())) % 900)
    rows = spark.range(1_000).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("node"), F.lit(0).alias("leaf"), F.lit(True).alias("fresh"))
    got = live.with_restart(rows, "event_id", lambda s: live.drift(s, activate=False), f"{tmp_path}/x")
    kept = [r.event_id for r in spark.read.parquet(f"{tmp_path}/x/in").select("event_id").collect()]
    assert sorted(kept) == list(range(1_000)) and got.agg(F.max("total")).first()[0] == 1_000


def test_windows_take_sizes_alone(spark, tmp_path):
    """The first sample that isn't empty says the dimension; genomes themselves never reach the state."""
    schema = "island string, event_id long, genome array<double>"
    batches = [[("a", 2, [1.0]), ("a", 1, []), ("a", 3, [1.0, 2.0]), ("a", 4, None)], [("a", i, [0.5]) for i in range(5, 11)]]
    got = run(spark, tmp_path, batches, schema, lambda s: streams.sliding_windows(s, cap=4, least=4, fresh=2))
    assert got == [[("a", 3, 2, 0, False)], [("a", 10, 4, 4, True)]]
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    assert "size(genome" in streams.sliding_windows(stream)._jdf.queryExecution().analyzed().toString()
