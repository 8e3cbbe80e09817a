"""Queries over runs against a truth, labelled samples, folders and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import evaluation as E
from ..operators import services
from .registry import Tables, query

_OWNERS = "SELECT CASE WHEN p_partkey % 9 <> 0 THEN p_partkey * CASE WHEN p_size % 5 = 0 THEN 1 ELSE 3 END END AS cluster, p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS logical FROM part"


def _owners(t: Tables) -> DataFrame:
    """Parts stand for the clusters of the true files, brands for the files; every ninth was overwritten."""
    place = F.col("p_partkey") * F.when(F.col("p_size") % 5 == 0, 1).otherwise(3)
    return t.part.select(F.when(F.col("p_partkey") % 9 != 0, place).alias("cluster"), F.col("p_brand").alias("name"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("logical"))


@query(f"""WITH o AS ({_OWNERS}), p AS (SELECT DISTINCT cluster, name, CASE WHEN cluster % 7 = 0 THEN logical + 1 ELSE logical END AS logical FROM o WHERE cluster % 4 <> 1),
n AS (SELECT DISTINCT l_orderkey + 1 AS cluster FROM lineitem WHERE l_orderkey + 1 NOT IN (SELECT cluster FROM o WHERE cluster IS NOT NULL)), x AS (SELECT DISTINCT cluster FROM p UNION SELECT 8),
j AS (SELECT name, logical, logical % 3 <> 0 AS correct FROM o WHERE cluster % 2 = 0), t AS (SELECT a.name, a.logical FROM o a JOIN o b ON a.name = b.name AND b.logical = a.logical + 1 WHERE b.cluster <> a.cluster + 1),
c AS (SELECT count(*) AS correct FROM (SELECT DISTINCT name, logical FROM p SEMI JOIN o USING (cluster, name, logical))), q AS (SELECT count(*) AS total, count(cluster) AS surviving FROM o),
w AS (SELECT count(*) AS noise, count_if(cluster IN (SELECT cluster FROM p)) AS wrong FROM n), l AS (SELECT count(*) AS made, count_if(correct) AS good FROM j),
r AS (SELECT count(*) AS asked, count_if((name, logical) IN (SELECT (name, logical) FROM j WHERE correct)) AS met FROM (SELECT DISTINCT name, logical FROM t))
SELECT round(100 * correct / total, 1) AS recovered, round(100 * correct / surviving, 1) AS recovered_of_surviving, round(100 * good / made, 1) AS link_precision, round(100 * met / asked, 1) AS link_recall,
round(100 * wrong / noise, 2) AS false_positives, round(100 * (surviving - correct) / surviving, 1) AS false_negatives FROM c, q, w, l, r""")
def q_recovery_metrics(t: Tables) -> DataFrame:
    owners = _owners(t)
    placed = owners.where("cluster % 4 <> 1").select("cluster", "name", (F.col("logical") + F.when(F.col("cluster") % 7 == 0, 1).otherwise(0)).alias("logical")).distinct()
    noise = t.lineitem.select((F.col("l_orderkey") + 1).alias("cluster")).distinct().join(owners.where("cluster is not null").select("cluster"), "cluster", "left_anti")
    joins = owners.where("cluster % 2 = 0").select("name", "logical", (F.col("logical") % 3 != 0).alias("correct"))
    return E.recovery_metrics(placed, owners, noise, joins, E.truth_joins(owners))


@query("""SELECT l_orderkey * 10 + l_linenumber AS file, l_partkey AS owner, l_quantity * 2 AS integrity, l_returnflag = 'N' AS predicted_valid, coalesce(p_size = l_quantity, FALSE) AS exact, coalesce(p_type = CASE WHEN l_linenumber % 2 = 0 THEN 'PROMO' ELSE 'ECONOMY' END, FALSE) AS type_ok FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 5 <> 0""")
def q_file_records(t: Tables) -> DataFrame:
    """Lines stand for recovered files, parts for the true ones, of which some are unknown."""
    digest = lambda c: F.sha2(F.col(c).cast("int").cast("string").cast("binary"), 256)
    files = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file"), F.col("l_partkey").alias("owner"), (F.col("l_quantity") * 2).alias("integrity"), F.when(F.col("l_returnflag") == "N", "validated").otherwise("partial").alias("class"),
        digest("l_quantity").alias("sha256"), F.when(F.col("l_linenumber") % 2 == 0, "PROMO").otherwise("ECONOMY").alias("type"),
    )
    truth = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("owner"), digest("p_size").alias("sha256"), F.col("p_type").alias("type"))
    return E.file_records(files, truth)


@query("""SELECT 'price' AS metric, round(avg(o_totalprice), 1) AS mean, count(o_totalprice) AS n FROM orders UNION ALL SELECT 'half', round(avg(CASE WHEN o_custkey % 2 = 0 THEN o_totalprice / 2 END), 1), count(CASE WHEN o_custkey % 2 = 0 THEN 1 END) FROM orders UNION ALL SELECT 'none', NULL, 0""")
def q_mean_metrics(t: Tables) -> DataFrame:
    """Means of metrics over the runs that have them."""
    runs = t.orders.select(F.col("o_totalprice").alias("price"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice") / 2).alias("half"), F.lit(None).cast("double").alias("none"))
    return E.mean_metrics(runs, ("price", "half", "none"))


@query("""WITH s AS (SELECT l_partkey AS image, l_shipdate AS made, l_orderkey AS run, 0 AS k FROM lineitem WHERE l_partkey % 3 = 0 UNION ALL SELECT l_partkey, l_shipdate, l_orderkey + 1000000, 1 FROM lineitem WHERE l_linenumber = 1)
SELECT image, made, run FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY k, made DESC, run DESC) AS rn FROM s) WHERE rn = 1""")
def q_sample_union(t: Tables) -> DataFrame:
    """Samples of two sources, the first of which wins, the latest of each image."""
    a = t.lineitem.where("l_partkey % 3 = 0").select(F.col("l_partkey").alias("image"), F.col("l_shipdate").alias("made"), F.col("l_orderkey").alias("run"))
    b = t.lineitem.where("l_linenumber = 1").select(F.col("l_partkey").alias("image"), F.col("l_shipdate").alias("made"), (F.col("l_orderkey") + 1000000).alias("run"))
    return E.sample_union((a, b), "image", ("made",))


@query("""WITH i AS (SELECT o_custkey AS source, count(*) AS incidents, sum(o_orderkey % 4) AS deleted, sum(o_orderkey % 3) AS modified, sum((o_orderkey % 5 = 0)::INT) AS corrupted FROM orders GROUP BY 1)
SELECT c_custkey AS source, coalesce(incidents, 0) AS incidents, coalesce(deleted, 0)::BIGINT AS deleted, coalesce(modified, 0)::BIGINT AS modified, coalesce(corrupted, 0)::BIGINT AS corrupted FROM customer LEFT JOIN i ON source = c_custkey""")
def q_folder_overview(t: Tables) -> DataFrame:
    """Customers stand for protected folders, orders for incidents."""
    paths = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("p"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    k = F.col("o_orderkey")
    incidents = t.orders.select(F.col("o_custkey").alias("source"), paths(k % 4).alias("deleted"), paths(k % 3).alias("modified"), paths(F.when(k % 5 == 0, 1).otherwise(0)).alias("corrupted"))
    return E.folder_overview(incidents, t.customer.select(F.col("c_custkey").alias("source")))


@query("""SELECT o_custkey AS source, o_orderdate AS made, o_orderkey AS snapshot, TRUE AS complete FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1""")
def q_latest_snapshots(t: Tables) -> DataFrame:
    snapshots = t.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("made"), F.col("o_orderkey").alias("snapshot"), (F.col("o_orderstatus") == "F").alias("complete"))
    return E.latest_snapshots(snapshots, "source", ("made", "snapshot"))


@query("""SELECT o_orderkey AS rel_path, CASE WHEN o_custkey % 10 = 0 THEN 'lost' WHEN o_custkey % 7 = 0 THEN 'changed' ELSE 'ok' END AS state FROM orders""")
def q_verify_snapshot(t: Tables) -> DataFrame:
    """Stored copies against the hashes of their manifest."""
    sha = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    manifest = t.orders.select(F.col("o_orderkey").alias("rel_path"), sha.alias("sha256"))
    stored = t.orders.where("o_custkey % 10 <> 0").select(F.col("o_orderkey").alias("rel_path"), F.when(F.col("o_custkey") % 7 == 0, F.reverse(sha)).otherwise(sha).alias("sha256"))
    return services.verify_snapshot(manifest, stored)


@query("SELECT l_suppkey AS scan, count(*) AS items, count_if(l_returnflag <> 'R') AS recoverable, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS bytes FROM lineitem GROUP BY 1")
def q_recycle_counts(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_suppkey").alias("scan"), (F.col("l_returnflag") != "R").alias("has_data"), F.col("l_quantity").cast("long").alias("size"))
    return E.recycle_counts(items, "scan")


@query("SELECT level, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['5-LOW', '1-URGENT', 'NONE', '2-HIGH']) AS level) LEFT JOIN (SELECT o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1) USING (level)")
def q_level_counts(t: Tables) -> DataFrame:
    return E.level_counts(t.orders, "o_orderpriority", ("5-LOW", "1-URGENT", "NONE", "2-HIGH"))


@query("SELECT o_orderkey AS file, o_custkey % 4 AS gaps, n AS fragments, o_totalprice AS priority FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY (o_custkey % 4 > 0) DESC, n DESC, o_totalprice DESC, o_orderkey LIMIT 1")
def q_default_pick(t: Tables) -> DataFrame:
    """The one file that a first view shows."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("file")).agg(F.count(F.lit(1)).alias("fragments"))
    files = t.orders.select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 4).alias("gaps"), F.col("o_totalprice").alias("priority")).join(n, "file")
    return E.default_pick(files.select("file", "gaps", "fragments", "priority"))


@query("SELECT c_mktsegment AS who, round(sum(v), 4) AS total FROM (SELECT c_mktsegment, greatest(0, max(c_acctbal)) / 1000 AS v FROM customer GROUP BY c_mktsegment, c_nationkey) GROUP BY 1")
def q_weight_total(t: Tables) -> DataFrame:
    """The sum of a map of weights per user; segments stand for users, nations for criteria."""
    per = t.customer.groupBy("c_mktsegment", "c_nationkey").agg((F.greatest(F.lit(0), F.max("c_acctbal")) / 1000).alias("v"))
    maps = per.groupBy(F.col("c_mktsegment").alias("who")).agg(F.map_from_entries(F.collect_list(F.struct("c_nationkey", "v"))).alias("w"))
    return maps.select("who", F.round(E.weight_total(F.col("w")), 4).alias("total"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber * 100000 + l_partkey AS moment, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'executed' ELSE 'failed' END AS decision FROM lineitem WHERE l_quantity > 25),
d AS (SELECT id, arg_max(decision, moment) AS state FROM (SELECT id, moment, max(decision) AS decision FROM l GROUP BY id, moment) GROUP BY id)
SELECT o_orderkey AS id, coalesce(state, 'pending') AS state, CASE coalesce(state, 'pending') WHEN 'pending' THEN 0 WHEN 'failed' THEN 1 WHEN 'executed' THEN 2 ELSE 3 END AS rank FROM orders LEFT JOIN d ON id = o_orderkey""")
def q_decisions(t: Tables) -> DataFrame:
    """The state of each recommendation by its last decision."""
    decision = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "executed").otherwise("failed")
    log = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("at"), decision.alias("decision"))
    return E.decisions(t.orders.select(F.col("o_orderkey").alias("id")), log)


@query("""SELECT o_orderkey AS file, CASE WHEN o_custkey % 31 = 0 THEN 'blocked' WHEN o_orderstatus = 'O' THEN 'absent' WHEN o_custkey % 5 = 0 THEN 'changed' ELSE 'ok' END AS state FROM orders""")
def q_download_gate(t: Tables) -> DataFrame:
    sha = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    files = t.orders.select(F.col("o_orderkey").alias("file"), F.when(F.col("o_custkey") % 31 == 0, "MALWARE_DETECTED").otherwise("CLEAN").alias("security"), sha.alias("sha256"))
    exports = t.orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("file"), F.when(F.col("o_custkey") % 5 == 0, F.upper(F.reverse(sha))).otherwise(sha).alias("sha256"))
    return E.download_gate(files, exports)


_EDGE = {"type_compat": "1.0", "struct_order": "l_discount * 10", "entropy_sim": "l_tax * 10", "hist_sim": "l_quantity / 50"}
_PARTS = ", ".join(f"struct_pack(name := '{n}', v := {w} * ({_EDGE.get(n, '0.5')} - {fixed.EDGE_MEAN[n]}) / {fixed.EDGE_STD[n]})" for n, w in fixed.EDGE_WEIGHTS.items())


@query(f"""WITH c AS (SELECT id, l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([{_PARTS}]) AS p FROM (SELECT *, row_number() OVER () AS id FROM lineitem)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(p.v) DESC) AS k FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, weight FROM (SELECT id, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(abs(p.v)), 4) AS weight FROM r WHERE k <= 5 GROUP BY ALL)""")
def q_top_contributions(t: Tables) -> DataFrame:
    """How much the five strongest of an edge's contributions weigh; five is what the explanation shows."""
    c = F.col
    parts = S.edge_contributions({"type_compat": F.lit(1.0), "struct_order": c("l_discount") * 10, "entropy_sim": c("l_tax") * 10, "hist_sim": c("l_quantity") / 50})
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.top_contributions(parts).alias("top"))
    total = F.aggregate("top", F.lit(0.0), lambda s, x: s + F.abs(x["value"]))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(total, 4).alias("weight"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS file, l_linenumber * 1000 AS s, l_linenumber * 1000 + 500 AS e, CASE WHEN l_returnflag = 'R' THEN 'missing' ELSE 'recovered' END AS kind FROM lineitem)
SELECT file, sha256('[' || string_agg('{"start":' || s || ',"end":' || e || ',"kind":"' || kind || '"}', ',' ORDER BY s, e, kind) || ']') AS digest, sum(CASE WHEN kind = 'missing' THEN e - s ELSE 0 END)::BIGINT AS missing FROM s GROUP BY file""")
def q_segment_manifest(t: Tables) -> DataFrame:
    """The manifest of each file's segments, as the hash of its JSON."""
    n = F.col("l_linenumber").cast("long") * 1000
    segments = t.lineitem.select(F.col("l_orderkey").alias("file"), n.alias("start"), (n + 500).alias("end"), F.when(F.col("l_returnflag") == "R", "missing").otherwise("recovered").alias("kind")).distinct()
    return services.segment_manifest(segments).select("file", F.sha2(F.col("manifest").cast("binary"), 256).alias("digest"), "missing")


@query("""WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents), c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT *, sqrt(n / sum(n) OVER (PARTITION BY doc_id)) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, byte) AS k FROM c)
SELECT doc_id, round(sum(weight * weight), 6) AS length, string_agg(byte, ' ' ORDER BY k) FILTER (WHERE k <= 6) AS top FROM w GROUP BY doc_id""")
def q_byte_vectors(t: Tables) -> DataFrame:
    """The vector of each artefact: the square roots of its bytes' shares, of length one, and its six commonest bytes."""
    bytes_ = t.documents.select("doc_id", F.explode(S.byte_array(F.col("text").cast("binary"))).alias("byte"))
    counts = bytes_.groupBy("doc_id", "byte").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("doc_id").agg(F.sum("n").alias("total"))
    weighed = counts.join(total, "doc_id").withColumn("weight", F.sqrt(F.col("n") / F.col("total")))
    entry = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "byte", "weight")))
    vectors = weighed.groupBy("doc_id").agg(entry.alias("v"))  # 256 entries at most
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["weight"] * x["weight"])
    return vectors.select("doc_id", F.round(length, 6).alias("length"), F.array_join(F.slice(F.col("v.byte"), 1, 6), " ").alias("top"))
