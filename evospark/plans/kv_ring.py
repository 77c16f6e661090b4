"""Queries on the key/value table, the ring and the learned index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curve
from ..operators import kv as K
from ..operators import ring as R
from ..operators import rmi as M
from ..registry import query
from .base import KV_SQL, hex16, pairs, r6, table

START = "0000000000000100"
NODES = ["http://node-a:5000", "http://node-b:5000", "http://node-c:5000"]
VNODES_SQL = "vn AS (SELECT sha1(i::VARCHAR || '|' || node)[1:16] AS vid, node, i FROM (SELECT unnest(['http://node-a:5000', 'http://node-b:5000', 'http://node-c:5000']) AS node), (SELECT range AS i FROM range(100)))"
HASHED_SQL = f"{KV_SQL}, {VNODES_SQL}, ke AS (SELECT k, sha1(k)[1:16] AS h FROM kv)"
OWNER_SQL = f"{HASHED_SQL}, own AS (SELECT ke.k, ke.h, coalesce(v.vid, (SELECT min(vid) FROM vn)) AS owner FROM ke ASOF LEFT JOIN (SELECT vid FROM vn) v ON ke.h <= v.vid)"


@query("kv_get", f"WITH {KV_SQL} SELECT k, v FROM kv WHERE k = '{START}'")
def kv_get(spark, d):
    return K.get(pairs(spark, d), START)


@query("kv_upsert", f"WITH {KV_SQL}, ch AS (SELECT k, 'new-' || v AS v FROM kv WHERE k < '0000000000000400' UNION ALL SELECT 'f' || k[2:], v FROM kv WHERE k < '0000000000000040') SELECT k, v FROM ch UNION ALL SELECT k, v FROM kv WHERE k NOT IN (SELECT k FROM ch)")
def kv_upsert(spark, d):
    kv = pairs(spark, d)
    old = kv.filter("k < '0000000000000400'").select("k", F.concat(F.lit("old-"), "v").alias("v"), F.lit(1).alias("seq"))
    new = kv.filter("k < '0000000000000400'").select("k", F.concat(F.lit("new-"), "v").alias("v"), F.lit(2).alias("seq"))
    fresh = kv.filter("k < '0000000000000040'").select(F.concat(F.lit("f"), F.substring("k", 2, 15)).alias("k"), "v", F.lit(1).alias("seq"))
    return K.upsert(kv, old.union(new).union(fresh))


@query("kv_delete", f"WITH {KV_SQL} SELECT k, v FROM kv WHERE NOT (k < '0000000000000400')")
def kv_delete(spark, d):
    kv = pairs(spark, d)
    return K.delete(kv, kv.filter("k < '0000000000000400'").select("k"))


@query("kv_range_scan", f"WITH {KV_SQL} SELECT k, v FROM kv WHERE k >= '{START}' ORDER BY k LIMIT 25")
def kv_range_scan(spark, d):
    return K.range_scan(pairs(spark, d), START, 25)


@query("kv_range_after", f"WITH {KV_SQL} SELECT k, v FROM kv WHERE k > '{START}' ORDER BY k LIMIT 25")
def kv_range_after(spark, d):
    return K.range_scan(pairs(spark, d), START, 25, inclusive=False)


@query("kv_snapshot", f"WITH {KV_SQL} SELECT k, v FROM kv ORDER BY k")
def kv_snapshot(spark, d):
    return pairs(spark, d).orderBy("k")


@query("kv_len", f"WITH {KV_SQL} SELECT count(*) AS n, count(*) = 0 AS is_empty FROM kv")
def kv_len(spark, d):
    return pairs(spark, d).agg(F.count("*").alias("n"), (F.count("*") == 0).alias("is_empty"))


@query("range_scatter", f"WITH {KV_SQL} SELECT k, v FROM kv WHERE k >= '{START}' ORDER BY k LIMIT 40")
def range_scatter(spark, d):
    kv = pairs(spark, d)
    second = kv.filter("k >= '0000000000000080'").select("k", F.when(F.col("k") < "0000000000000200", F.col("v")).otherwise(F.col("v")).alias("v"))
    return K.scatter_range([kv.filter("k < '0000000000000200'"), second], START, 40)


@query("cluster_keys", f"WITH {KV_SQL} SELECT DISTINCT k FROM kv")
def cluster_keys(spark, d):
    kv = pairs(spark, d)
    return K.cluster_keys([kv.filter("k < '0000000000001000'"), kv])


@query("vnode_ids", f"WITH {VNODES_SQL} SELECT vid, node, i FROM vn")
def vnode_ids(spark, d):
    return R.vnodes(spark, NODES, 100).select("vid", "node", F.col("i").cast("long").alias("i"))


@query("ring_topology", f"WITH {VNODES_SQL} SELECT vid, coalesce(lag(vid) OVER (ORDER BY vid), (SELECT max(vid) FROM vn)) AS pred, coalesce(lead(vid) OVER (ORDER BY vid), (SELECT min(vid) FROM vn)) AS succ FROM vn")
def ring_topology(spark, d):
    return R.topology(R.vnodes(spark, NODES, 100).select("vid"))


def _hashed(spark, d):
    return pairs(spark, d).select("k", R.sha1_id(F.col("k")).alias("h"))


@query("ring_owner", f"WITH {OWNER_SQL} SELECT k, owner FROM own")
def ring_owner(spark, d):
    return R.owners(_hashed(spark, d), R.vnodes(spark, NODES, 100)).select("k", "owner")


@query("kv_routed_get", f"WITH {OWNER_SQL} SELECT kv.k, kv.v, vn.node FROM own JOIN kv USING (k) JOIN vn ON vn.vid = own.owner WHERE kv.k = '{START}'")
def kv_routed_get(spark, d):
    ring = R.vnodes(spark, NODES, 100)
    found = R.owners(K.get(pairs(spark, d), START).withColumn("h", R.sha1_id(F.col("k"))), ring)
    return found.join(F.broadcast(ring), found["owner"] == ring["vid"]).select("k", "v", "node")


@query("kv_routed_put", f"WITH {OWNER_SQL}, ch AS (SELECT k, 'new-' || v AS v FROM kv WHERE k < '0000000000000400') SELECT kv.k, coalesce(ch.v, kv.v) AS v, vn.node FROM own JOIN kv USING (k) JOIN vn ON vn.vid = own.owner LEFT JOIN ch ON ch.k = kv.k")
def kv_routed_put(spark, d):
    """The nodes' tables after writes that went to each key's owner."""
    kv = pairs(spark, d)
    changes = kv.filter("k < '0000000000000400'").select("k", F.concat(F.lit("new-"), "v").alias("v"), F.lit(1).alias("seq"))
    return K.routed_put(_routed(spark, kv), _routed(spark, changes))


@query("kv_routed_delete", f"WITH {OWNER_SQL} SELECT kv.k, kv.v, vn.node FROM own JOIN kv USING (k) JOIN vn ON vn.vid = own.owner WHERE kv.k >= '0000000000000400'")
def kv_routed_delete(spark, d):
    """The nodes' tables after deletes that went to each key's owner."""
    kv = pairs(spark, d)
    return K.routed_delete(_routed(spark, kv), _routed(spark, kv.filter("k < '0000000000000400'")))


def _routed(spark, rows):
    """Rows with the node that owns their key."""
    ring = R.vnodes(spark, NODES, 100).select("vid", "node")
    found = R.owners(rows.withColumn("h", R.sha1_id(F.col("k"))), ring)
    return found.join(F.broadcast(ring), found["owner"] == ring["vid"]).drop("h", "owner", "vid")  # a row for each virtual id


@query("ring_lookup", f"WITH {OWNER_SQL}, t AS (SELECT vid, coalesce(lag(vid) OVER (ORDER BY vid), (SELECT max(vid) FROM vn)) AS pred, coalesce(lead(vid) OVER (ORDER BY vid), (SELECT min(vid) FROM vn)) AS succ FROM vn) SELECT k, owner AS successor, pred AS predecessor, succ AS following FROM own JOIN t ON t.vid = own.owner")
def ring_lookup(spark, d):
    """The successor of each key's hash, with its neighbours on the ring."""
    return R.lookup(_hashed(spark, d), R.vnodes(spark, NODES, 100)).select("k", "successor", "predecessor", "following")


@query("ring_notify", f"WITH {VNODES_SQL}, old AS (SELECT vid FROM vn WHERE node <> 'http://node-c:5000'), t AS (SELECT vid, coalesce(lag(vid) OVER (ORDER BY vid), (SELECT max(vid) FROM old)) AS pred FROM old), new AS (SELECT vid, coalesce(lag(vid) OVER (ORDER BY vid), (SELECT max(vid) FROM vn)) AS pred FROM vn) SELECT t.vid, t.pred AS before, new.pred AS after, t.pred <> new.pred AS changed FROM t JOIN new USING (vid)")
def ring_notify(spark, d):
    """Predecessors of two nodes' ids before and after a third one makes itself known."""
    ring = R.vnodes(spark, NODES, 100).select("vid", "node")
    return R.notify(ring.filter(F.col("node") != NODES[2]).select("vid"), ring.filter(F.col("node") == NODES[2]).select("vid"))


@query("peer_hash", f"WITH {KV_SQL} SELECT k, sha1(k)[1:16] AS h FROM kv")
def peer_hash(spark, d):
    return _hashed(spark, d)


@query("addr_hash", f"WITH {KV_SQL} SELECT k, sha256(k)[1:16] AS h FROM kv")
def addr_hash(spark, d):
    return pairs(spark, d).select("k", R.sha256_id(F.col("k")).alias("h"))


RANGES_SQL = f"{HASHED_SQL}, x AS (SELECT k, h, sha256(k)[1:16] AS a, sha1(k || 'b')[1:16] AS b FROM ke)"


def _ranges(spark, d):
    return _hashed(spark, d).select("k", "h", R.sha256_id(F.col("k")).alias("a"), R.sha1_id(F.concat("k", F.lit("b"))).alias("b"))


@query("in_range", f"WITH {RANGES_SQL} SELECT k, CASE WHEN a < b THEN h > a AND h <= b ELSE h > a OR h <= b END AS closed, CASE WHEN a < b THEN h > a AND h < b ELSE h > a OR h < b END AS opened, true AS whole, false AS nothing FROM x")
def in_range(spark, d):
    h, a, b = F.col("h"), F.col("a"), F.col("b")
    return _ranges(spark, d).select("k", R.in_range(h, a, b).alias("closed"), R.in_range(h, a, b, False).alias("opened"), R.in_range(h, a, a).alias("whole"), R.in_range(h, a, a, False).alias("nothing"))


@query("in_half_open", f"WITH {RANGES_SQL} SELECT k, CASE WHEN a < b THEN h > a AND h <= b ELSE h > a OR h <= b END AS half_open, CASE WHEN a < b THEN h > a AND h < b ELSE h > a OR h < b END AS open_both, false AS nothing FROM x")
def in_half_open(spark, d):
    h, a, b = F.col("h"), F.col("a"), F.col("b")
    return _ranges(spark, d).select("k", R.in_half_open(a, b, h).alias("half_open"), R.in_open(a, b, h).alias("open_both"), R.in_half_open(a, a, h).alias("nothing"))


@query("finger_start", f"WITH {VNODES_SQL} SELECT vid, lpad(lower(to_hex((('0x' || vid)::UBIGINT::HUGEINT % 18446744073709551616)::UBIGINT)), 16, '0') AS f0, lpad(lower(to_hex(((('0x' || vid)::UBIGINT::HUGEINT + 1000) % 18446744073709551616)::UBIGINT)), 16, '0') AS f4, lpad(lower(to_hex(((('0x' || vid)::UBIGINT::HUGEINT + 1000000000000000000) % 18446744073709551616)::UBIGINT)), 16, '0') AS f19, lpad(lower(to_hex(((('0x' || vid)::UBIGINT::HUGEINT + 18446744073709551615) % 18446744073709551616)::UBIGINT)), 16, '0') AS f20 FROM vn")
def finger_start(spark, d):
    v = F.col("vid")
    return R.vnodes(spark, NODES, 100).select("vid", *(R.finger_start(v, i).alias(f"f{i}") for i in (0, 4, 19, 20)))


# Eight nodes with their successors and decimal fingers, and every key's way from the first of them.
HOPS_SQL = f"""{KV_SQL}, ids AS (SELECT sha1('0|http://node-' || range || ':5000')[1:16] AS vid FROM range(8)),
nx AS (SELECT vid, coalesce(lead(vid) OVER (ORDER BY vid), (SELECT min(vid) FROM ids)) AS succ FROM ids),
jumps AS (SELECT vid, lpad(lower(to_hex(((('0x' || vid)::UBIGINT::HUGEINT + ('1' || repeat('0', range::INT))::HUGEINT) % 18446744073709551616)::UBIGINT)), 16, '0') AS target FROM ids, range(17)),
fingers AS (SELECT j.vid, coalesce(min(i.vid), (SELECT min(vid) FROM ids)) AS finger FROM jumps j LEFT JOIN ids i ON i.vid >= j.target GROUP BY j.vid, j.target UNION SELECT vid, succ FROM nx),
nodes AS (SELECT nx.vid, succ, list(finger) AS fs FROM nx JOIN fingers USING (vid) GROUP BY nx.vid, succ),
way AS (SELECT k, sha1(k)[1:16] AS h, (SELECT min(vid) FROM ids) AS here, false AS done, 0 AS hops FROM kv
UNION ALL SELECT k, h, CASE WHEN arrived THEN succ ELSE coalesce(CASE WHEN here > h THEN list_max([f FOR f IN fs IF f < h]) END, list_max([f FOR f IN fs IF f > here AND (f < h OR here > h)]), succ) END, arrived, hops + 1
FROM (SELECT way.*, succ, fs, CASE WHEN here = succ THEN true WHEN here < succ THEN h > here AND h <= succ ELSE h > here OR h <= succ END AS arrived FROM way JOIN nodes ON nodes.vid = here WHERE NOT done)),
routed AS (SELECT k, h, here AS owner, hops FROM way WHERE done)"""


@query("ring_hops", f"WITH RECURSIVE {HOPS_SQL} SELECT k, h, owner, hops FROM routed")
def ring_hops(spark, d):
    """Hops of every key's lookup from the first of eight nodes."""
    ids = sorted(r["vid"] for r in R.vnodes(spark, [f"http://node-{i}:5000" for i in range(8)], 1).collect())
    return R.routes(_hashed(spark, d), ids, ids[0])


@query("hop_stats", f"WITH RECURSIVE {HOPS_SQL} SELECT round(avg(hops), 6) AS mean, max(hops) AS max, round(var_pop(hops), 6) AS variance, round(quantile_cont(hops::DOUBLE, 0.95), 6) AS p95 FROM routed")
def hop_stats(spark, d):
    """Mean, maximum, variance and 95th percentile of the hops."""
    return ring_hops(spark, d).agg(r6(F.avg("hops")).alias("mean"), F.max("hops").alias("max"), r6(F.var_pop("hops")).alias("variance"), r6(F.percentile("hops", 0.95)).alias("p95"))


@query("parse_key", f"WITH {KV_SQL}, c AS (SELECT k, (('0x' || k[16:16])::INT % 3)::VARCHAR || k || '|{{\"v\": \"' || v || '\"}}' AS full_key FROM kv) SELECT k, full_key[1:1]::INT AS curve, split_part(full_key, '|', 1)[2:] AS hkey, json_extract_string(full_key[strpos(full_key, '|') + 1:], '$.v') AS v FROM c")
def parse_key(spark, d):
    kv = pairs(spark, d)
    digit = F.conv(F.substring("k", 16, 1), 16, 10).cast("int") % 3
    full = kv.select("k", F.concat(digit.cast("string"), "k", F.lit("|"), F.to_json(F.struct("v"))).alias("full_key"))
    key = F.col("full_key")
    return full.select("k", curve.curve_of(key).alias("curve"), F.substring(curve.key_of(key), 2, 64).alias("hkey"), F.from_json(curve.payload_of(key), "v string")["v"].alias("v"))


FEATURE_SQL = "('0x' || {})::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE"


@query("key_feature", f"""WITH {KV_SQL}, x AS (SELECT k, sha1(k)[1:16] AS h, sha1('w-' || k)[1:16] AS w FROM kv)
SELECT k, round((1.0 + {FEATURE_SQL.format('h')}) / 3.0, 6) AS by_curve, round({FEATURE_SQL.format('h')}, 6) AS plain, round(('0x' || h[1:5])::UBIGINT::DOUBLE / 1048575.0, 6) AS short, round({FEATURE_SQL.format('w')}, 6) AS hashed FROM x""")
def key_feature(spark, d):
    h = F.col("h")
    rows = _hashed(spark, d)
    return rows.select("k", r6(M.feature(F.concat(F.lit("1"), h, F.lit("|{}")))).alias("by_curve"), r6(M.feature(h)).alias("plain"), r6(M.feature(F.substring(h, 1, 5))).alias("short"), r6(M.feature(F.concat(F.lit("w-"), "k"))).alias("hashed"))


# Keys of the learned index: hashes of the order keys.
LEARN_SQL = f"{KV_SQL}, lk AS (SELECT DISTINCT sha1(k)[1:16] AS k FROM kv), rk AS (SELECT k, {FEATURE_SQL.format('k')} AS f, row_number() OVER (ORDER BY k) - 1 AS rank, count(*) OVER () AS n FROM lk), pk AS (SELECT *, rank::DOUBLE / n AS p FROM rk)"


def learned(spark, d):
    return pairs(spark, d).select(R.sha1_id(F.col("k")).alias("k"))


def leaves_sql(bins: int) -> str:
    return f"lv AS (SELECT b.bin::INT AS bin, CASE WHEN coalesce(m, 0) < 2 OR abs(den) < 1e-12 THEN 1.0::DOUBLE ELSE (m * sxy - sx * sy) / den END AS weight, sx, sy, m, den FROM (SELECT range AS bin FROM range({bins})) b LEFT JOIN (SELECT least(floor(f * {bins}), {bins - 1})::INT AS bin, count(*) AS m, sum(f) AS sx, sum(p) AS sy, sum(f * p) AS sxy, sum(f * f) AS sxx, count(*) * sum(f * f) - sum(f) * sum(f) AS den FROM pk GROUP BY 1) s USING (bin)), lb AS (SELECT bin, weight, CASE WHEN coalesce(m, 0) < 2 OR abs(den) < 1e-12 THEN 0.0::DOUBLE ELSE (sy - weight * sx) / m END AS bias FROM lv)"


@query("key_cdf", f"WITH {LEARN_SQL} SELECT k, rank, round(p, 6) AS p FROM pk")
def key_cdf(spark, d):
    return M.ranked(learned(spark, d)).select("k", "rank", r6("p").alias("p"))


@query("rmi_train", f"WITH {LEARN_SQL}, {leaves_sql(1)} SELECT bin, round(weight, 6) AS weight, round(bias, 6) AS bias FROM lb")
def rmi_train(spark, d):
    return M.train(learned(spark, d)).select("bin", r6("weight").alias("weight"), r6("bias").alias("bias"))


@query("rmi_train_binned", f"WITH {LEARN_SQL}, {leaves_sql(16)} SELECT bin, round(weight, 6) AS weight, round(bias, 6) AS bias FROM lb")
def rmi_train_binned(spark, d):
    return M.train(learned(spark, d), 16).select("bin", r6("weight").alias("weight"), r6("bias").alias("bias"))


SLOTS_SQL = "sl AS (SELECT least(floor(f * 16), 15)::INT AS bin, least(floor(f * 1024), 1023)::INT AS slot, floor(max_by(p, rank) * 4294967295.0)::BIGINT AS value FROM pk GROUP BY 1, 2), fu AS (SELECT (range // 1024)::INT AS bin, (range % 1024)::INT AS slot FROM range(16384)), fl AS (SELECT bin, slot, coalesce(last_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY bin ORDER BY slot ROWS UNBOUNDED PRECEDING), 0) AS value FROM fu LEFT JOIN sl USING (bin, slot))"


@query("rmi_radix", f"WITH {LEARN_SQL}, {SLOTS_SQL} SELECT bin, slot, value FROM fl")
def rmi_radix(spark, d):
    return M.radix_slots(M.ranked(learned(spark, d)), 16)


@query("radix_fill", f"WITH {LEARN_SQL}, {SLOTS_SQL} SELECT bin, count(*) AS slots, count(DISTINCT value) AS values, max(value) AS top FROM fl GROUP BY bin")
def radix_fill(spark, d):
    return rmi_radix(spark, d).groupBy("bin").agg(F.count("*").alias("slots"), F.countDistinct("value").alias("values"), F.max("value").alias("top"))


# Each number of bins with its leaves and its error on the sketch, then the radix model of the best.
AUTO_SQL = f"""{LEARN_SQL}, tried AS (SELECT unnest(CASE WHEN (SELECT count(*) FROM lk) < 100 THEN [1] ELSE [8, 16, 32, 64] END) AS bins),
binned AS (SELECT bins, least(floor(f * bins), bins - 1)::INT AS bin, f, p, rank, rank % greatest(n // 100, 1) = 0 AS in_sketch FROM pk, tried),
sums AS (SELECT bins, bin, count(*) AS m, sum(f) AS sx, sum(p) AS sy, sum(f * p) AS sxy, count(*) * sum(f * f) - sum(f) * sum(f) AS den FROM binned GROUP BY 1, 2),
slopes AS (SELECT *, m < 2 OR abs(den) < 1e-12 AS flat, CASE WHEN m < 2 OR abs(den) < 1e-12 THEN 1.0::DOUBLE ELSE (m * sxy - sx * sy) / den END AS weight FROM sums),
fitted AS (SELECT bins, bin, weight, CASE WHEN flat THEN 0.0::DOUBLE ELSE (sy - weight * sx) / m END AS bias FROM slopes),
chosen AS (SELECT bins, avg(abs(greatest(0.0::DOUBLE, least(1.0::DOUBLE, weight * f + bias)) - f)) AS error FROM binned JOIN fitted USING (bins, bin) WHERE in_sketch GROUP BY bins ORDER BY error, bins LIMIT 1),
slots AS (SELECT bin, least(floor(f * 1024), 1023)::INT AS slot, floor(max_by(p, rank) * 4294967295.0::DOUBLE) / 4294967295.0::DOUBLE AS cdf FROM binned JOIN chosen USING (bins) GROUP BY 1, 2),
radix AS (SELECT avg(abs(cdf - f)) AS error FROM binned b JOIN chosen USING (bins) JOIN slots s ON s.bin = b.bin AND s.slot = least(floor(f * 1024), 1023)::INT WHERE in_sketch),
verdict AS (SELECT bins, CASE WHEN bins >= 16 AND radix.error < chosen.error THEN 'radix' ELSE 'linear' END AS model FROM chosen, radix)"""


@query("rmi_auto", f"WITH {AUTO_SQL} SELECT v.bins, model, e.bin::INT AS bin, round(CASE WHEN model = 'radix' THEN 0.0::DOUBLE ELSE coalesce(weight, 1.0::DOUBLE) END, 6) AS weight, round(CASE WHEN model = 'radix' THEN 0.0::DOUBLE ELSE coalesce(bias, 0.0::DOUBLE) END, 6) AS bias FROM verdict v JOIN (SELECT range AS bin FROM range(64)) e ON e.bin < v.bins LEFT JOIN fitted f ON f.bins = v.bins AND f.bin = e.bin")
def rmi_auto(spark, d):
    """Bins, kind and leaves of the model that suits the keys best."""
    bins, kind, leaves = M.auto(learned(spark, d))
    return leaves.select(F.lit(bins).alias("bins"), F.lit(kind).alias("model"), "bin", r6("weight").alias("weight"), r6("bias").alias("bias"))


PREDICT_SQL = f"{LEARN_SQL}, {leaves_sql(16)}, pr AS (SELECT k, f, p, greatest(0.0::DOUBLE, least(1.0::DOUBLE, weight * f + bias)) AS cdf FROM pk JOIN lb ON lb.bin = least(floor(f * 16), 15)::INT)"


@query("rmi_predict", f"WITH {PREDICT_SQL} SELECT k, round(cdf, 6) AS cdf FROM pr")
def rmi_predict(spark, d):
    keys = learned(spark, d).distinct()
    return M.predict(keys, M.train(keys, 16), 16).select("k", r6("cdf").alias("cdf"))


POSITION_SQL = "lpad(lower(to_hex(CASE WHEN {0} >= 1.0 THEN 18446744073709551615::UBIGINT ELSE floor({0} * 18446744073709551616.0::DOUBLE)::UBIGINT END)), 16, '0')"


@query("rmi_position", f"WITH {LEARN_SQL} SELECT k, {POSITION_SQL.format('p')} AS position FROM pk UNION ALL SELECT 'end', 'ffffffffffffffff'")
def rmi_position(spark, d):
    """Ring positions of the keys' shares, all digits, and of a whole one."""
    rows = M.ranked(learned(spark, d)).select("k", "p").union(spark.createDataFrame([("end", 1.0)], "k string, p double"))
    return rows.select("k", M.position(F.col("p")).alias("position"))


PLACED_SQL = f"{PREDICT_SQL}, {VNODES_SQL}, q AS (SELECT k, {POSITION_SQL.format('cdf')} AS pos FROM pr), po AS (SELECT k, coalesce(v.vid, (SELECT min(vid) FROM vn)) AS owner FROM q ASOF LEFT JOIN (SELECT vid FROM vn) v ON q.pos <= v.vid)"


def _placed(spark, d):
    keys = learned(spark, d).distinct()
    placed = M.predict(keys, M.train(keys, 16), 16).withColumn("h", M.position(F.col("cdf")))
    return R.owners(placed, R.vnodes(spark, NODES, 100))


@query("key_owner", f"WITH {PLACED_SQL} SELECT k, owner FROM po")
def key_owner(spark, d):
    return _placed(spark, d).select("k", "owner")


@query("rebalance", f"WITH {HASHED_SQL}, o1 AS (SELECT ke.k, coalesce(v.vid, (SELECT min(vid) FROM vn)) AS a FROM ke ASOF LEFT JOIN (SELECT vid FROM vn) v ON ke.h <= v.vid), v2 AS (SELECT * FROM vn WHERE node <> 'http://node-c:5000'), o2 AS (SELECT ke.k, coalesce(v.vid, (SELECT min(vid) FROM v2)) AS b FROM ke ASOF LEFT JOIN (SELECT vid FROM v2) v ON ke.h <= v.vid) SELECT k, a AS before, b AS after FROM o1 JOIN o2 USING (k) WHERE a <> b")
def rebalance(spark, d):
    keys, ring = _hashed(spark, d), R.vnodes(spark, NODES, 100)
    a = R.owners(keys, ring).select("k", F.col("owner").alias("before"))
    b = R.owners(keys, ring.filter(F.col("node") != NODES[2])).select("k", F.col("owner").alias("after"))
    return a.join(b, "k").filter("before <> after")


MODELS_SQL = f"{LEARN_SQL}, part_keys AS (SELECT m.m AS model, k FROM lk, (SELECT unnest([0, 1, 2]) AS m) m WHERE ('0x' || k[16:16])::INT % 3 = m.m), pr3 AS (SELECT model, k, {FEATURE_SQL.format('k')} AS f, (row_number() OVER (PARTITION BY model ORDER BY k) - 1)::DOUBLE / count(*) OVER (PARTITION BY model) AS p FROM part_keys), fm AS (SELECT model, least(floor(f * 8), 7)::INT AS bin, count(*) AS m, sum(f) AS sx, sum(p) AS sy, (count(*) * sum(f * p) - sum(f) * sum(p)) / (count(*) * sum(f * f) - sum(f) * sum(f)) AS weight FROM pr3 GROUP BY 1, 2), fn AS (SELECT model, count(*) AS n FROM part_keys GROUP BY 1), mo AS (SELECT model, n, bin, weight, (sy - weight * sx) / m AS bias FROM fm JOIN fn USING (model))"


def _models(spark, d):
    keys = learned(spark, d).distinct()
    out = None
    for m in range(3):
        own = keys.filter(F.conv(F.substring("k", 16, 1), 16, 10).cast("int") % 3 == m)
        leaves = M.train(own, 8).withColumn("model", F.lit(m)).join(own.agg(F.count("*").alias("n")))
        out = leaves if out is None else out.union(leaves)
    return out


@query("fed_avg", f"WITH {MODELS_SQL}, t AS (SELECT sum(n) AS total FROM fn) SELECT bin, round(sum(weight * n / total), 6) AS weight, round(sum(bias * n / total), 6) AS bias, 1.0::DOUBLE AS scale FROM mo, t GROUP BY bin")
def fed_avg(spark, d):
    return M.federated_average(_models(spark, d)).select("bin", r6("weight").alias("weight"), r6("bias").alias("bias"), "scale")


@query("model_diff", f"WITH {MODELS_SQL} SELECT a.bin, round(a.weight - b.weight, 6) AS weight, round(a.bias - b.bias, 6) AS bias FROM mo a JOIN mo b USING (bin) WHERE a.model = 0 AND b.model = 1 AND (abs(a.weight - b.weight) > 1e-12 OR abs(a.bias - b.bias) > 1e-12)")
def model_diff(spark, d):
    m = _models(spark, d)
    return M.difference(m.filter("model = 0"), m.filter("model = 1")).select("bin", r6("weight").alias("weight"), r6("bias").alias("bias"))


@query("window_counts", f"WITH {PLACED_SQL} SELECT least(floor(f * 16), 15)::INT AS bin, count(*) FILTER (node = '{NODES[0]}') AS inside, count(*) FILTER (node <> '{NODES[0]}') AS outside FROM po JOIN pr USING (k) JOIN vn ON vn.vid = po.owner GROUP BY 1")
def window_counts(spark, d):
    """Keys of each leaf whose predicted place is the first node's, and the others."""
    nodes = R.vnodes(spark, NODES, 100).select(F.col("vid").alias("owner"), "node")
    rows = _placed(spark, d).join(F.broadcast(nodes), "owner")  # a row for each virtual id
    inside = F.col("node") == NODES[0]
    return rows.groupBy(M.bin_of(M.feature(F.col("k")), 16).alias("bin")).agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


# A round of the controller for each row of ``rounds``, from the state after the one before it.
PID_SQL = f"""{LEARN_SQL}, counts AS (SELECT least(floor(f * 16), 15)::INT AS bin, rank % 10 AS step, count(*) FILTER (rank % 7 <> 0)::DOUBLE AS inside, count(*)::DOUBLE AS total FROM rk GROUP BY 1, 2),
rounds AS (SELECT bin, row_number() OVER (PARTITION BY bin ORDER BY step) AS n, total, inside / greatest(total, 1) - 0.95::DOUBLE AS error FROM counts),
leaf AS (SELECT DISTINCT bin, 0::BIGINT AS n, 0 AS p, 0 AS i, false AS up, 0 AS d, 1.0::DOUBLE AS scale, 0.0::DOUBLE AS shifted FROM rounds
UNION ALL SELECT bin, n, CASE WHEN idle THEN p ELSE level END, CASE WHEN idle THEN i WHEN output > 2 OR output < 0.5 THEN 1 ELSE least(i + 1, 15) END, CASE WHEN idle THEN up ELSE output BETWEEN 0.5 AND 2 AND level < p END,
CASE WHEN idle THEN d WHEN output BETWEEN 0.5 AND 2 AND level > p THEN 1 ELSE 0 END, CASE WHEN idle THEN scale WHEN output > 2 THEN scale * 1.05::DOUBLE WHEN output < 0.5 THEN scale * 0.95::DOUBLE ELSE scale END,
CASE WHEN idle THEN shifted WHEN error > 0 THEN shifted - 0.01::DOUBLE * least(abs(error), 1) ELSE shifted + 0.01::DOUBLE * least(abs(error), 1) END
FROM (SELECT *, level + i / 4.0::DOUBLE + CASE WHEN up THEN d ELSE -d END AS output FROM (SELECT leaf.* EXCLUDE (n), r.n, error, total < 20 AS idle, CASE WHEN error > 0.05 THEN 3 WHEN error > 0.02 THEN 2 WHEN error > -0.02 THEN 1 ELSE 0 END AS level FROM leaf JOIN rounds r ON r.bin = leaf.bin AND r.n = leaf.n + 1)))"""


@query("pid_fold", f"WITH RECURSIVE {PID_SQL} SELECT bin, p, i, up, d, round(scale, 6) AS scale, round(shifted, 6) AS \"offset\" FROM leaf QUALIFY n = max(n) OVER (PARTITION BY bin)")
def pid_fold(spark, d):
    """Scale and offset of every leaf after ten control rounds."""
    steps = M.ranked(learned(spark, d)).groupBy(M.bin_of(F.col("f"), 16).alias("bin"), (F.col("rank") % 10).alias("step")).agg(F.count_if(F.col("rank") % 7 != 0).alias("inside"), F.count_if(F.col("rank") % 7 == 0).alias("outside"))
    return M.tune(steps).select("bin", "p", "i", "up", "d", r6("scale").alias("scale"), r6("offset").alias("offset"))


@query("error_rate", "SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (event_type = 'error')::DOUBLE / count(*) END, 6) AS rate FROM events GROUP BY user_id")
def error_rate(spark, d):
    errors = F.count_if(F.col("event_type") == "error")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("requests"), errors.alias("errors"), r6(F.when(F.count("*") == 0, 0.0).otherwise(errors / F.count("*"))).alias("rate"))


@query("prune", "WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS rate, date_diff('second', max(ts), (SELECT max(ts) FROM events)) AS idle FROM events GROUP BY user_id), p AS (SELECT *, rate > 0.3 OR idle > 86400 AS cut, row_number() OVER (ORDER BY user_id) AS rn, bool_and(rate > 0.3 OR idle > 86400) OVER () AS every FROM u) SELECT user_id, cut AND NOT (every AND rn = 1) AS pruned FROM p")
def prune(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    u = e.groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("rate"), F.max("ts").alias("last")).join(F.broadcast(now))
    idle = F.unix_timestamp("now") - F.unix_timestamp("last")
    marked = u.withColumn("cut", (F.col("rate") > 0.3) | (idle > 86400))
    whole = F.broadcast(marked.agg(F.bool_and("cut").alias("every"), F.min("user_id").alias("first")))
    return marked.join(whole).select("user_id", (F.col("cut") & ~(F.col("every") & (F.col("user_id") == F.col("first")))).alias("pruned"))


@query("quorum", "WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') = 0 AS ready FROM events GROUP BY 1) SELECT round(avg(ready::INT), 6) AS share, avg(ready::INT) >= 0.9 AS quorum FROM u")
def quorum(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") == 0).cast("int").alias("ready"))
    return u.agg(r6(F.avg("ready")).alias("share"), (F.avg("ready") >= 0.9).alias("quorum"))


@query("drift_ready", "WITH x AS (SELECT event_id, count(*) OVER (ORDER BY event_id) AS total, (event_id * 7919) % 3 = 0 AS fresh FROM events), y AS (SELECT event_id, total, sum(fresh::INT) OVER (ORDER BY event_id) AS inserts FROM x) SELECT event_id, round(inserts::DOUBLE / total, 6) AS drift, total >= 50 AND inserts::DOUBLE / total >= 0.4 AS ready, total % 100 = 0 AS due FROM y")
def drift_ready(spark, d):
    from ..operators.stats import running

    e = table(spark, d, "events").select("event_id", F.lit(1).alias("one"), F.when((F.col("event_id") * 7919) % 3 == 0, 1).otherwise(0).alias("fresh"))
    run = running(e, "event_id", {"total": "one", "inserts": "fresh"})
    drift = F.col("inserts") / F.col("total")
    return run.select("event_id", r6(drift).alias("drift"), ((F.col("total") >= 50) & (drift >= 0.4)).alias("ready"), (F.col("total") % 100 == 0).alias("due"))
