"""A ring of unsigned 64-bit ids, kept as 16 lower-case hex digits: string order is number order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP = 2**64


def sha1_id(x: Column) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, 16)


def sha256_id(x: Column) -> Column:
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 16)


def to_number(x: Column) -> Column:
    """A 16-digit hex id as decimal(20,0)."""
    return F.conv(x, 16, 10).cast("decimal(20,0)")


def to_id(x: Column) -> Column:
    return F.lpad(F.lower(F.conv(x.cast("decimal(20,0)").cast("string"), 10, 16)), 16, "0")


def in_range(x: Column, start: Column, end: Column, inclusive_end: bool = True) -> Column:
    """(start, end] or (start, end) with wraparound; equal ends are the whole ring or nothing."""
    below = x <= end if inclusive_end else x < end
    return F.when(start == end, F.lit(inclusive_end)).when(start < end, (x > start) & below).otherwise((x > start) | below)


def in_half_open(a: Column, b: Column, x: Column) -> Column:
    """(a, b]; equal ends are empty."""
    return F.when(a == b, F.lit(False)).otherwise(in_range(x, a, b, True))


def in_open(a: Column, b: Column, x: Column) -> Column:
    return F.when(a == b, F.lit(False)).otherwise(in_range(x, a, b, False))


def finger_start(x: Column, i: int) -> Column:
    """id + 10^(i - 1), modulo 2^64; id itself for 0."""
    jump = 0 if i == 0 else min(10 ** (i - 1), TOP - 1) if i - 1 < 19 else TOP - 1
    total = to_number(x).cast("decimal(38,0)") + F.lit(str(jump)).cast("decimal(38,0)")
    return to_id(F.pmod(total, F.lit(str(TOP)).cast("decimal(38,0)")))


def vnodes(spark: SparkSession, nodes: list[str], each: int) -> DataFrame:
    """``vid, node, i``: the virtual ids of every node."""
    urls = spark.createDataFrame([(n,) for n in nodes], "node string")
    rows = urls.select("node", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("i"))
    return rows.select(sha1_id(F.concat(F.col("i").cast("string"), F.lit("|"), F.col("node"))).alias("vid"), "node", "i")


def topology(vids: DataFrame) -> DataFrame:
    """Predecessor and successor of every id, around the ring. A ring's ids are a small table."""
    w = Window.orderBy("vid")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vids.select("*", F.coalesce(F.lag("vid").over(w), F.max("vid").over(whole)).alias("pred"), F.coalesce(F.lead("vid").over(w), F.min("vid").over(whole)).alias("succ"))


def owners(keys: DataFrame, ring: DataFrame, hash_col: str = "h") -> DataFrame:
    """Each key's owner: the first id at or after its hash, else the first of the ring.

    The ring is a literal table of nodes times virtual ids, whatever the number of keys; it goes
    to the keys as one sorted array, so that a key costs a binary search and no shuffle.
    """
    ids = [r["vid"] for r in ring.select("vid").distinct().orderBy("vid").collect()]
    if not ids:
        return keys.withColumn("owner", F.lit(None).cast("string"))
    sorted_ids = F.array(*(F.lit(i) for i in ids))
    return keys.withColumn("owner", F.coalesce(F.element_at(F.filter(sorted_ids, lambda v: v >= F.col(hash_col)), F.lit(1)), F.lit(ids[0]))) if len(ids) <= 16 else _by_prefix(keys, ring, hash_col, ids[0])


def _by_prefix(keys: DataFrame, ring: DataFrame, hash_col: str, first: str) -> DataFrame:
    """Keys and ids meet in slices of the ring: in a slice of three hex digits a key sees the ids of
    its slice, and the next id beyond it. The table of slices has a fixed 4096 rows."""
    spark = keys.sparkSession
    own = ring.select(F.substring("vid", 1, 3).alias("slice"), "vid").groupBy("slice").agg(F.array_sort(F.collect_set("vid")).alias("ids"))
    every = spark.range(4096).select(F.lpad(F.lower(F.hex("id")), 3, "0").alias("slice"))
    w = Window.orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    slices = every.join(own, "slice", "left").select("slice", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), F.coalesce(F.first(F.get("ids", F.lit(0)), ignorenulls=True).over(w), F.lit(first)).alias("beyond"))
    joined = keys.withColumn("slice", F.substring(hash_col, 1, 3)).join(F.broadcast(slices), "slice")
    inside = F.get(F.filter("ids", lambda v: v >= F.col(hash_col)), F.lit(0))
    return joined.withColumn("owner", F.coalesce(inside, F.col("beyond"))).drop("slice", "ids", "beyond")


def lookup(keys: DataFrame, ring: DataFrame, hash_col: str = "h") -> DataFrame:
    """``successor, predecessor, following`` of each key's hash: its owner and that one's neighbours."""
    around = topology(ring.select("vid").distinct()).select(F.col("vid").alias("successor"), F.col("pred").alias("predecessor"), F.col("succ").alias("following"))
    return owners(keys, ring, hash_col).withColumnRenamed("owner", "successor").join(F.broadcast(around), "successor")  # a row for each virtual id


def notify(vids: DataFrame, came: DataFrame) -> DataFrame:
    """``vid, before, after, changed``: predecessors of ``vids`` before and after others came."""
    before = topology(vids).select("vid", F.col("pred").alias("before"))
    after = topology(vids.union(came).distinct()).select("vid", F.col("pred").alias("after"))
    return before.join(after, "vid").withColumn("changed", F.col("before") != F.col("after"))


def routes(keys: DataFrame, ids: list[str], start: str, max_hops: int = 33) -> DataFrame:
    """Hops from node ``start`` to the owner of each key by decimal fingers, in one expression: a
    bounded fold over the hops, with the fingers of the few nodes as literals."""
    ids = sorted(ids)
    number = {i: int(i, 16) for i in ids}

    def successor(x: int) -> str:
        return next((i for i in ids if number[i] >= x), ids[0])

    fingers = {i: sorted({successor((number[i] + 10**e) % TOP) for e in range(17)} | {ids[(k + 1) % len(ids)]}) for k, i in enumerate(ids)}
    succ = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    as_map = lambda d, f: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), f(v))))
    table, after = as_map(fingers, lambda v: F.array(*(F.lit(x) for x in v))), as_map(succ, F.lit)

    def step(acc: Column, _: Column) -> Column:
        here, done, hops = acc["at"], acc["done"], acc["hops"]
        h = F.col("h")
        arrived = in_range(h, here, after[here], True)
        nearer = F.filter(table[here], lambda f: in_open(here, h, f))
        # the finger farthest along the way to the key: the largest behind the wrap, if any
        ahead = F.filter(nearer, lambda f: f > here)
        wrapped = F.filter(nearer, lambda f: f <= here)
        best = F.when(F.size(wrapped) > 0, F.array_max(wrapped)).when(F.size(ahead) > 0, F.array_max(ahead)).otherwise(after[here])
        following = F.struct(F.when(arrived, after[here]).otherwise(best).alias("at"), arrived.alias("done"), (hops + 1).alias("hops"))
        return F.when(done, acc).otherwise(following)

    state = F.struct(F.lit(start).alias("at"), F.lit(False).alias("done"), F.lit(0).alias("hops"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(max_hops)), state, step)
    return keys.select("*", folded.alias("_r")).select(*keys.columns, F.col("_r.at").alias("owner"), F.col("_r.hops").alias("hops"))
