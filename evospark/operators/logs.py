"""Log streams: normalization, filters, pages, counts and candidates.

The same column expressions serve batch tables and streams. A raw record is one JSON string; what
cannot be parsed becomes a message of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RAW = """source string, container_name string, file_path string, log string, level string, levelStr string, severity string, stream string,
message string, msg string, target string, name string, logger string, island_id string, island string, role string, worker_id string, worker_pool string,
ts bigint, timestamp string, `@timestamp` string, best_genome string, gen int, best double, best_ever double,
fields struct<message: string, msg: string, level: string, levelStr: string, target: string, island_id: string, island: string, role: string, best_genome: string, gen: int, best: double, best_ever: double>"""
NESTED = "level string, levelStr string, message string, msg string, target string, logger string, name string, timestamp string, ts bigint, best_genome string, island_id string, island string, role string, worker_pool string, worker_id string"

# The levels that a filter includes, and the names of numeric levels.
ERRORS = ["ERROR", "CRIT", "ALERT", "EMERG"]
WARNINGS = ["WARN", "WARNING", *ERRORS]
SYSLOG = ["EMERG", "ALERT", "CRIT", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG"]
# The formats that must be read out of names and messages.
TAG_OF_FILE = r"([^/]+)\.log$"
LEVEL_SAID = r"(?i)^\[?(ERROR|CRIT|FATAL|WARNING|WARN|INFO|DEBUG|TRACE)\]?[:\s]"
ISLAND_NUMBER = r"(?:orchestrator|worker|surrogate|island|pool)[-_]?(\d+)"
GENOME_SAID = r"(?i)best[\s_]*(?:candidate[\s_]*)?genome\s*[:=]\s*(\[[^\]]+\])"
GENERATION_SAID = r"(?i)Gen\s+(\d+)"
BEST_EVER_SAID, BEST_SAID = r"(?i)best_ever\s*[:=]\s*([-0-9.eE+]+)", r"(?i)best\s*[:=]\s*([-0-9.eE+]+)"
#: Most rows that a page of each kind may ask for.
LIMITS = {"logs": 1000, "tail": 500, "history": 200}


def _text(x: Column) -> Column:
    """Null for the empty string too."""
    return F.when(F.length(x) > 0, x)


def _match(text: Column, pattern: str, group: int = 1) -> Column:
    return _text(F.regexp_extract(text, pattern, group))


def level_name(level: Column) -> Column:
    """Upper case; syslog numbers by name."""
    names = F.array(*(F.lit(n) for n in SYSLOG))
    return F.when(level.rlike("^[0-7]$"), F.get(names, F.expr("0") + level.try_cast("int"))).otherwise(F.upper(level))


def timestamp_ms(ts: Column, timestamp: Column, at: Column, broker: Column, now: Column | None = None) -> Column:
    """The first of ts, timestamp, @timestamp (seconds below 1e11, milliseconds or text), the
    broker's time and now."""
    ms = lambda t: F.unix_millis(F.try_to_timestamp(t))
    number = at.try_cast("double")
    stamped = F.when(number.isNotNull(), F.when(number < 1e11, number * 1000).otherwise(number).cast("bigint")).otherwise(ms(at))
    parts = [F.nullif(ts, F.lit(0)), F.when(timestamp.isNotNull(), ms(timestamp)).when(at.isNotNull(), stamped).otherwise(broker)]
    return F.coalesce(*parts, *([now] if now is not None else []))


def normalize(df: DataFrame, raw: str = "raw", topic: str = "topic", broker_ts: str = "broker_ts", now: Column | None = None) -> DataFrame:
    """``source, source_tag, level, message, target, island, role, worker_id, ts`` and the parts of
    a candidate, with what ``df`` has besides."""
    text = F.col(raw)
    parsed = F.from_json(text, RAW)
    ok = F.trim(text).startswith("{") & F.get_json_object(text, "$").isNotNull()
    rows = df.withColumn("r", F.when(ok, parsed)).withColumn("n", F.when(F.trim("r.log").startswith("{"), F.from_json(F.trim("r.log"), NESTED)))
    c = lambda *names: F.coalesce(*(_text(F.col(x)) for x in names))
    tag = F.coalesce(F.regexp_replace(_text(F.col("r.container_name")), "^/", ""), _match(F.col("r.file_path"), TAG_OF_FILE))
    message = F.when(F.col("r").isNull(), text).otherwise(F.coalesce(c("r.message", "n.message", "n.msg", "r.msg", "r.fields.message", "r.fields.msg"), F.trim("r.log"), F.lit("")))
    rows = rows.withColumn("source", F.coalesce(_text(F.col(topic)), c("r.source"), F.lit("unknown"))).withColumn("source_tag", tag).withColumn("message", F.regexp_replace(message, r"\r?\n$", ""))
    said = F.upper(_match(F.col("message"), LEVEL_SAID))
    from_text = F.when(said == "WARNING", "WARN").when(said.isin("CRIT", "FATAL"), "ERROR").otherwise(said)
    stderr = F.when(F.col("r.stream") == "stderr", "WARN")
    level = F.upper(F.coalesce(c("r.level", "n.level", "n.levelStr", "r.levelStr", "r.fields.level", "r.fields.levelStr", "r.severity"), stderr, from_text, F.lit("INFO")))
    rows = rows.withColumn("level", level).withColumn("target", F.coalesce(c("r.target", "n.target", "n.logger", "n.name", "r.fields.target", "r.name", "r.logger"), F.col("source_tag"), F.col("source")))
    ident = F.lower(F.coalesce(F.col("source_tag"), c("r.container_name"), _text(F.col("target")), c("r.file_path"), F.lit("")))
    number = _match(ident, ISLAND_NUMBER)
    ours = ident.rlike("orchestrator|worker|surrogate") | F.col("source").isin("logs.orchestrator", "logs.worker", "logs.surrogate")
    guessed = F.when(number.isNotNull(), F.concat(F.lit("island-"), number)).when((F.col("source") == "logs.lead") | ident.contains("lead"), "lead").when(ours, "island-1").otherwise("default")
    rows = rows.withColumn("island", F.coalesce(c("r.island_id", "n.island_id", "r.island", "n.island", "r.fields.island_id", "r.fields.island"), guessed))
    who = F.lower(F.coalesce(F.col("source_tag"), F.col("target"), F.col("source")))
    role = F.when(who.contains("orchestrator"), "orchestrator").when(who.contains("worker"), "worker").when(who.contains("surrogate"), "surrogate").when(who.contains("lead"), "lead").otherwise("unknown")
    rows = rows.withColumn("role", F.coalesce(c("r.role", "n.role", "r.fields.role"), role)).withColumn("worker_id", c("r.worker_id", "n.worker_id"))
    when = timestamp_ms(F.coalesce("r.ts", "n.ts"), c("r.timestamp", "n.timestamp"), c("r.@timestamp"), F.col(broker_ts).try_cast("bigint"), now)
    rows = rows.withColumn("ts", when)
    said_genome = _match(F.col("message"), GENOME_SAID)
    genome = F.from_json(F.coalesce(c("r.best_genome", "n.best_genome", "r.fields.best_genome"), said_genome), "array<double>")
    gen = F.coalesce("r.gen", "r.fields.gen", _match(F.col("message"), GENERATION_SAID).try_cast("int"), F.lit(0))
    ever, best = (_match(F.col("message"), said).try_cast("double") for said in (BEST_EVER_SAID, BEST_SAID))
    rows = rows.withColumn("genome", genome).withColumn("gen", F.when(F.col("genome").isNotNull(), gen)).withColumn("fitness", F.when(F.col("genome").isNotNull(), F.coalesce("r.best_ever", "r.fields.best_ever", "r.best", "r.fields.best", ever, best)))
    return rows.drop("r", "n")


@dataclass(frozen=True)
class Filter:
    """What a reader asks for; parts that are None don't restrict."""

    source: str | None = None
    island: str | None = None
    role: str | None = None
    container: str | None = None
    level: str | None = None
    since: int | None = None
    until: int | None = None
    search: str | None = None
    target: str | None = None
    worker_id: str | None = None

    def column(self, columns: list[str]) -> Column:
        out = F.lit(True)
        for value, name in ((self.source, "source"), (self.island, "island"), (self.role, "role"), (self.container, "source_tag"), (self.target, "target"), (self.worker_id, "worker_id")):
            if value is not None:
                out = out & (F.col(name) == value)
        if self.level is not None:
            out = out & at_level(F.col("level"), self.level)
        if self.since is not None:
            out = out & (F.col("ts").isNull() | (F.col("ts") >= self.since))
        if self.until is not None:
            out = out & (F.col("ts").isNull() | (F.col("ts") <= self.until))
        if self.search is not None:
            out = out & F.lower(F.to_json(F.struct(*columns))).contains(self.search.lower())
        return out


def at_level(level: Column, wanted: str) -> Column:
    got, want = level_name(level), wanted.upper()
    return got.isin(ERRORS) if want == "ERROR" else got.isin(WARNINGS) if want == "WARN" else got == want


def matching(df: DataFrame, f: Filter) -> DataFrame:
    return df.filter(f.column(df.columns))


def newest(df: DataFrame, limit: int, tie: str, kind: str = "tail") -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc(tie)).limit(max(1, min(limit, LIMITS[kind])))


def page_before(df: DataFrame, before: int, limit: int, tie: str) -> DataFrame:
    """A page of what came before a time, newest first."""
    return newest(df.filter(F.col("ts") < before), limit, tie, "history")


def counts(df: DataFrame) -> DataFrame:
    """``kind, key, n``: by source, by level and in all, in one pass."""
    kind = F.when(F.grouping("source") == 0, "source").when(F.grouping("level") == 0, "level").otherwise("total")
    sets = df.groupingSets([["source"], ["level"], []], "source", "level")
    return sets.agg(kind.alias("kind"), F.count("*").alias("n")).select("kind", F.coalesce("source", "level", F.lit("")).alias("key"), "n")


def latest_candidate(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(F.struct(order, "fitness"), order).alias("c")).select(*by, "c.*")


def best_candidate(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The highest fitness; a later arrival wins a tie, and no fitness is lowest."""
    rank = F.struct(F.coalesce("fitness", F.lit(float("-inf"))), F.col(order))
    return df.groupBy(*by).agg(F.max_by(F.struct(order, "fitness"), rank).alias("c")).select(*by, "c.*")
