"""A training set of evaluated designs for surrogate models, from a table of genomes.

Reads ``vec_id, embedding`` with Spark's Parquet reader; the first genes of a vector, moved into
[0, 1], are a design's genome. Designs whose genes are missing or not finite and such as are marked
as rejected go, equal genomes stay once (the first id), and every design keeps its part (train,
validation, test: 6, 2 and 2 tenths by a digest of its id) in every later run, so that nothing moves
from test to training when the table grows. Writes

* ``samples``: genome, decoded parameters and fitness, partitioned by ``part`` and ``era`` (a
  number of generations);
* ``scaler``: mean and deviation of each gene over the training part, as it stands;
* ``report``: fitness and diversity of each part and era.

``first_era`` and ``last_era`` restrict a run to new eras. A rerun overwrites the partitions that
it makes and no others, with the same rows; an era from which every design has gone from the
input keeps its old partition.

    python -m jobs.training_set --config jobs/training_set.json --input PATH --output PATH
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evospark.functions import airframe as A
from evospark.functions import vectors as V
from evospark.operators import stats as S

from .settings import from_command_line

log = logging.getLogger("jobs.training_set")


@dataclass(frozen=True)
class Settings:
    input: str
    output: str
    genes: int = 10
    members: int = 50
    generations: int = 1_000
    least_fitness: float = -1e8
    first_era: int = 0
    last_era: int = 2**31 - 1


def part_of(key: Column) -> Column:
    """By the first eight hex digits of the key's MD5, so that a design's part never changes."""
    tenth = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 10
    return F.when(tenth < 6, "train").when(tenth < 8, "validation").otherwise("test")


def designs(rows: DataFrame, settings: Settings) -> DataFrame:
    """``vec_id, era, part, g, fitness`` and decoded parameters of the usable, distinct genomes."""
    finite = (F.size("embedding") >= settings.genes) & F.forall(F.slice("embedding", 1, settings.genes), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    genome = F.transform(F.slice("embedding", 1, settings.genes), lambda x: (x.cast("double") + 1.0) / 2.0)
    usable = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", genome.alias("g"))
    distinct = usable.groupBy("g").agg(F.min("vec_id").alias("vec_id"))
    era = F.expr(f"vec_id div {settings.members * settings.generations}").cast("int")
    made = distinct.select("vec_id", era.alias("era"), part_of(F.col("vec_id")).alias("part"), "g", V.sphere(F.col("g")).alias("fitness"))
    p = A.parameters(F.col("g"))
    kept = made.filter((F.col("fitness") > settings.least_fitness) & F.col("era").between(settings.first_era, settings.last_era))
    return kept.select("*", p["wing_span"].alias("wing_span"), p["wing_root_chord"].alias("wing_root_chord"), p["naca_m"].alias("naca_m"))


SAMPLES = "vec_id bigint, g array<double>, fitness double, wing_span double, wing_root_chord double, naca_m double, part string, era int"
SCALER = "dim int, mean double, std double"
REPORT = "part string, era int, designs bigint, best double, avg double, worst double, std double, entropy double"


def read(spark: SparkSession, settings: Settings, name: str) -> DataFrame:
    """One of the job's tables, as it stands."""
    return spark.read.schema({"samples": SAMPLES, "scaler": SCALER, "report": REPORT}[name]).parquet(f"{settings.output}/{name}")


def run(spark: SparkSession, settings: Settings) -> DataFrame:
    """Makes the tables and returns the samples."""
    rows = spark.read.parquet(settings.input).select("vec_id", "embedding")
    log.info("read %d rows of %s", rows.count(), settings.input)
    made = designs(rows, settings).hint("rebalance", "part", "era")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "era").parquet(f"{settings.output}/samples")
    samples = read(spark, settings, "samples")
    wrote = samples.filter(F.col("era").between(settings.first_era, settings.last_era)).agg(F.count("*"), F.min("era"), F.max("era")).first()
    log.info("wrote %s samples of eras %s to %s to %s/samples", *wrote, settings.output)
    S.scaler(samples.filter("part = 'train'"), "g").write.mode("overwrite").parquet(f"{settings.output}/scaler")
    by = ["part", "era"]
    stats = S.fitness_stats(samples, "fitness", by).join(samples.groupBy(*by).agg(F.count("*").alias("designs")), by).join(S.population_entropy(samples, "g", by=by), by)
    stats.select(*REPORT.replace(",", "").split()[::2]).coalesce(1).write.mode("overwrite").parquet(f"{settings.output}/report")
    for r in read(spark, settings, "report").groupBy("part").agg(F.sum("designs").alias("n"), F.max("best").alias("best")).collect():  # three parts
        log.info("part %s now holds %s designs, the best of fitness %.6f", r["part"], r["n"], r["best"])
    return samples


def main(argv: list[str] | None = None) -> None:
    settings = from_command_line(Settings, argv, "Builds a training set of evaluated designs.")
    spark = SparkSession.builder.appName("training-set").getOrCreate()
    try:
        run(spark, settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
