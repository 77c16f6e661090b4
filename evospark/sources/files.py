"""JSON, JSON-lines and CSV sources and sinks of training records, telemetry and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 22 design parameters, in file order, and the five results of a record.
CONFIG = tuple("fuse_length fuse_max_diam nose_ratio tail_ratio wing_span wing_root_chord wing_tip_chord wing_sweep wing_dihedral wing_twist wing_x_pos wing_z_pos naca_m naca_p naca_t tail_x_pos v_stab_height v_stab_root v_stab_tip h_stab_span h_stab_root h_stab_tip".split())
RESULTS = ("ld", "alpha_trim", "cm_alpha", "cl_req", "mass_g")
_doubles = lambda names: T.StructType([T.StructField(n, T.DoubleType()) for n in names])
RECORD = T.StructType([T.StructField("config", _doubles(CONFIG)), T.StructField("aero", _doubles(RESULTS)), T.StructField("fitness", T.DoubleType())])
GENERATION = """generation bigint, elapsed_sec double, best_fitness double, avg_fitness double, worst_fitness double, std_fitness double, best_genome array<double>, gene_variance array<double>, entropy double,
population array<array<double>>, tier1_exact_hits bigint, tier2_surrogate_hits bigint, tier3_cfd_evals bigint, tier_bypass_ratio double"""


def usable(records: DataFrame, least: float = -1e8) -> DataFrame:
    """Records with a finite fitness above the mark of rejection."""
    return records.filter(F.col("fitness").isNotNull() & ~F.isnan("fitness") & (F.abs("fitness") < float("inf")) & (F.col("fitness") > least))


def load_dataset(spark: SparkSession, path: str, least: float = -1e8) -> DataFrame:
    """Records of a JSON array; NaN and infinities are null. An empty result is an error."""
    rows = usable(spark.read.schema(RECORD).option("multiLine", True).option("allowNonNumericNumbers", True).json(path), least)
    if rows.isEmpty():
        raise ValueError(f"no usable record in {path}")
    return rows


def load_tolerant(spark: SparkSession, path: str, required: tuple[str, ...] = ("fitness",)) -> DataFrame:
    """A JSON array, or JSON lines with comments and bad lines between them: what can be read and
    has the required keys."""
    lines = spark.read.text(path).filter(~F.trim("value").rlike("^(#|//|$)"))
    array = lines.filter(F.trim("value").startswith("[")).limit(1).count() > 0
    if array:
        rows = spark.read.schema(RECORD).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    else:
        rows = lines.select(F.from_json("value", RECORD).alias("r")).select("r.*")
    for name in required:
        rows = rows.filter(F.col(name).isNotNull())
    return rows


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_telemetry(rows: DataFrame, path: str) -> None:
    """JSON lines; what was there goes."""
    rows.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Generation records of all files of a pattern, with the file as their run."""
    rows = spark.read.schema(GENERATION).json(glob).filter(F.col("generation").isNotNull())
    return rows.withColumn("run", F.input_file_name())


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def facet_normal() -> list:
    """The unit normal of a facet ``ax .. cz``; zero for one without an area."""
    u, v = ([F.col(p + c) - F.col("a" + c) for c in "xyz"] for p in "bc")
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return [F.when(size > 0, x / F.nullif(size, F.lit(0.0))).otherwise(0.0) for x in n]


def write_stl(facets: DataFrame, path: str, by: str = "id") -> None:
    """A whole ASCII solid for each design: facets (``ax .. cz``) with their normals, between the
    lines that name it. One file a task; a design's few hundred facets stay together."""
    point = lambda p: F.concat(F.lit("      vertex "), F.concat_ws(" ", *(F.col(p + c).cast("string") for c in "xyz")))
    head = F.concat(F.lit("  facet normal "), F.concat_ws(" ", *(x.cast("string") for x in facet_normal())))
    facet = F.concat_ws("\n", head, F.lit("    outer loop"), point("a"), point("b"), point("c"), F.lit("    endloop"), F.lit("  endfacet"))
    name = F.concat(F.lit("airframe-"), F.col(by).cast("string"))
    solids = facets.select(name.alias("name"), facet.alias("facet")).groupBy("name").agg(F.array_sort(F.collect_list("facet")).alias("facets"))
    solids.select(F.concat_ws("\n", F.concat(F.lit("solid "), "name"), F.array_join("facets", "\n"), F.concat(F.lit("endsolid "), "name")).alias("value")).write.mode("overwrite").text(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Structured log lines: one JSON object each, as ``streams.tail_files`` reads them back."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def wing_facets(designs: DataFrame, sections: int = 24) -> DataFrame:
    """Triangles of both wing halves of each design (``id``, span, chords, sweep): upper and lower
    skins between root and tip, as rows."""
    import math

    from ..functions.airframe import naca_point

    grid = designs.select("*", F.explode(F.sequence(F.lit(0), F.lit(sections - 1))).alias("i"), F.lit(1).alias("_")).select("*", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("side")).select("*", F.explode(F.array(F.lit("u"), F.lit("l"))).alias("skin"))
    place = lambda k: 0.5 * (1 - F.cos((F.col("i") + k) * math.pi / sections))

    def corner(k: int, tip: bool) -> list:
        p = naca_point(place(k), F.col("naca_m") / 100, F.lit(0.4), F.lit(0.12))
        x = F.when(F.col("skin") == "u", p["xu"]).otherwise(p["xl"])
        z = F.when(F.col("skin") == "u", p["yu"]).otherwise(p["yl"])
        chord = F.col("wing_tip_chord") if tip else F.col("wing_root_chord")
        shift = F.col("wing_span") * F.tan(F.radians("wing_sweep")) if tip else F.lit(0.0)
        return [shift + x * chord, F.col("side") * (F.col("wing_span") if tip else F.lit(0.0)), z * chord]

    quads = [(corner(0, False), corner(1, False), corner(0, True)), (corner(1, False), corner(1, True), corner(0, True))]
    names = [p + c for p in "abc" for c in "xyz"]
    out = None
    for corners in quads:
        part = grid.select("id", *(F.round(v, 6).alias(n) for n, v in zip(names, [v for c in corners for v in c])))
        out = part if out is None else out.union(part)
    return out
