"""Queries over relations between rows: similarity, time, graphs, matching, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import fragment_index, placement
from ..operators import relational as R
from ..operators import similarity as M
from ..sources.shared import SharedTables
from .registry import Tables, query


@query("""WITH s AS MATERIALIZED (SELECT text, min(doc_id) AS doc_id FROM documents WHERE length(text) > 200 GROUP BY text),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM s) GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM s), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS MATERIALIZED (SELECT doc_id, term, tf * ln(1 + n / df) AS w FROM tf JOIN df USING (term), n),
q AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(dot / (x.norm * y.norm), 6) AS cosine, round(least(0.85, dot / (x.norm * y.norm)), 6) AS confidence FROM p JOIN q x ON x.doc_id = a JOIN q y ON y.doc_id = b WHERE dot / (x.norm * y.norm) >= 0.3""")
def q_tfidf(t: Tables) -> DataFrame:
    return M.tfidf_pairs(t.documents.where(F.length("text") > 200), least=0.3)


@query("""SELECT a.user_id, a.event_id AS a, b.event_id AS b, floor(epoch(b.ts))::BIGINT - floor(epoch(a.ts))::BIGINT AS gap,
round(0.6 * exp(-(floor(epoch(b.ts))::BIGINT - floor(epoch(a.ts))::BIGINT) / 3600.0 / 12), 6) AS confidence
FROM events a JOIN events b ON a.user_id = b.user_id AND (floor(epoch(b.ts))::BIGINT > floor(epoch(a.ts))::BIGINT OR floor(epoch(b.ts))::BIGINT = floor(epoch(a.ts))::BIGINT AND b.event_id > a.event_id) AND floor(epoch(b.ts))::BIGINT - floor(epoch(a.ts))::BIGINT <= 86400""")
def q_temporal(t: Tables) -> DataFrame:
    events = t.events.select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    pairs = R.band_pairs(events, "user_id", "s", "event_id", 86400)
    return pairs.withColumn("confidence", F.round(0.6 * F.exp(-F.col("gap") / 3600.0 / 12), 6))


@query("""WITH v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_inner_product(a.e, b.e) / (a.n * b.n), 6) AS cosine, a.label = b.label AS same FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, cosine, rank, CASE WHEN cosine >= 0.97 AND same THEN 'STRONG' WHEN cosine >= 0.92 THEN 'POSSIBLE' WHEN cosine >= 0.8 THEN 'WEAK' ELSE 'NONE' END AS label FROM r WHERE rank <= 12""")
def q_dna_similar(t: Tables) -> DataFrame:
    """The twelve most similar vectors of each query vector (those whose id is divisible by 20)."""
    found = fragment_index.nearest(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), k=12)
    labels = t.embeddings.select("vec_id", "label")
    both = found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    label = S.dna_label(F.col("cosine"), F.lit(0.0), F.col("label") == F.col("own"), F.lit(False))
    return both.select("query_id", "vec_id", "cosine", "rank", label.alias("label"))


@query("""WITH b AS (SELECT doc_id, source, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM documents WHERE text <> ''), c AS (SELECT doc_id, source, byte, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM c), v AS MATERIALIZED (SELECT doc_id, byte, sqrt(share) AS w FROM s),
f AS (SELECT doc_id, source, -sum(share * log2(share)) AS e FROM s GROUP BY doc_id, source),
p AS (SELECT a.doc_id AS query_id, b.doc_id AS vec_id, round(sum(a.w * b.w), 6) AS cosine FROM v a JOIN v b ON a.byte = b.byte AND a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM p),
x AS (SELECT r.*, round(abs(a.e - b.e), 6) AS entropy_gap, a.source IS NOT DISTINCT FROM b.source AS same, a.e > 7.5 AND b.e > 7.5 AS random FROM r JOIN f a ON a.doc_id = query_id JOIN f b ON b.doc_id = vec_id WHERE rank <= 12)
SELECT query_id, vec_id, cosine, rank, entropy_gap, CASE WHEN random AND cosine >= 0.8 THEN 'WEAK' WHEN cosine >= 0.97 AND entropy_gap <= 0.2 AND same THEN 'STRONG' WHEN cosine >= 0.92 AND entropy_gap <= 0.5 THEN 'POSSIBLE' WHEN cosine >= 0.8 THEN 'WEAK' ELSE 'NONE' END AS label FROM x""")
def q_dna_documents(t: Tables) -> DataFrame:
    """The twelve documents most like each query document (ids divisible by 20) by the bytes they are made of."""
    prints = fragment_index.fingerprints(t.documents.select("doc_id", "source", F.col("text").cast("binary").alias("data")), "doc_id", "data")
    prints = SharedTables(t.spark, "prints").save(prints)
    return fragment_index.similar(prints, prints.where("doc_id % 20 = 0"), k=12, id_col="doc_id", family="source")


@query()
def q_pca(t: Tables) -> DataFrame:
    return M.pca_map(t.embeddings, "vec_id", "embedding")


def _edge_sql() -> str:
    cols = {"type_compat": "same", "entropy_sim": "qty", "proximity": "near", "time_consistent": "flow"}
    z = " + ".join(f"{w!r} * (({cols.get(k, '0.5')}) - {fixed.EDGE_MEAN[k]!r}) / {fixed.EDGE_STD[k]!r}" for k, w in fixed.EDGE_WEIGHTS.items())
    return f"""WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN n IS NULL THEN NULL ELSE (p = l_returnflag)::INT::DOUBLE END AS same, 1 - abs(l_quantity - q) / 50.0 AS qty,
exp(-abs(l_partkey - k) / 96.0) AS near, exp(-abs(d) / 8.0) AS flow, n FROM (SELECT *, lead(l_linenumber) OVER w AS n, lead(l_returnflag) OVER w AS p, lead(l_quantity) OVER w AS q, lead(l_partkey) OVER w AS k,
date_diff('day', l_shipdate, lead(l_shipdate) OVER w) AS d FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE n IS NOT NULL),
s AS (SELECT l_orderkey, l_linenumber, 1 / (1 + exp(-greatest(-40, least(40, {z} + {fixed.EDGE_BIAS!r})))) AS c FROM f)
SELECT l_orderkey, l_linenumber, round(c, 6) AS confidence, CASE WHEN c >= 0.9 THEN 'Strong' WHEN c >= 0.75 THEN 'Probable' WHEN c >= 0.55 THEN 'Possible' WHEN c >= 0.35 THEN 'Weak' ELSE 'Uncertain' END AS label FROM s"""


@query(_edge_sql())
def q_edge_model(t: Tables) -> DataFrame:
    """Logistic edge score of neighbouring rows (the lines of an order play the fragments of a file)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    nxt = lambda c: F.lead(c).over(w)
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", nxt("l_linenumber").alias("n"), (nxt("l_returnflag") == F.col("l_returnflag")).cast("double").alias("same"),
        (1 - F.abs(F.col("l_quantity") - nxt("l_quantity")) / 50.0).alias("qty"), F.exp(-F.abs(F.col("l_partkey") - nxt("l_partkey")) / 96.0).alias("near"),
        F.exp(-F.abs(F.datediff(nxt("l_shipdate"), "l_shipdate")) / 8.0).alias("flow"),
    ).where("n is not null")
    parts = S.edge_contributions({"type_compat": F.col("same"), "entropy_sim": F.col("qty"), "proximity": F.col("near"), "time_consistent": F.col("flow")})
    scored = rows.withColumn("c", S.edge_confidence(parts))
    return scored.select("l_orderkey", "l_linenumber", F.round("c", 6).alias("confidence"), S.relation_label(F.col("c")).alias("label"))


@query("""SELECT event_id, user_id, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (
SELECT *, (lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type OR floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER w))::BIGINT > 1800)::INT AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def q_islands(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    breaks = (F.lag("event_type").over(w) != F.col("event_type")) | (seconds - F.lag(seconds).over(w) > 1800)
    return R.islands(t.events, ["user_id"], ["ts", "event_id"], breaks).select("event_id", "user_id", "island")


_SEG = "SELECT l_suppkey, l_partkey * 10 AS s, l_partkey * 10 + l_quantity::BIGINT AS e FROM lineitem"


@query(f"""SELECT l_suppkey, gap_start, gap_end FROM (SELECT l_suppkey, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start, s AS gap_end FROM ({_SEG})) WHERE gap_end > gap_start""")
def q_gap_fill(t: Tables) -> DataFrame:
    segments = t.lineitem.select("l_suppkey", (F.col("l_partkey") * 10).alias("s"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("e"))
    return R.fill_gaps(segments, ["l_suppkey"], "s", "e")


@query(f"""WITH m AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT *, coalesce((s > max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS n FROM ({_SEG})))
SELECT l_suppkey, count(*) AS n_runs, sum(e - s)::BIGINT AS covered FROM (SELECT l_suppkey, run, min(s) AS s, max(e) AS e FROM m GROUP BY 1, 2) GROUP BY 1""")
def q_coverage(t: Tables) -> DataFrame:
    """Covered length per key from disjoint intervals, not from sets of cells."""
    segments = t.lineitem.select("l_suppkey", (F.col("l_partkey") * 10).alias("s"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("e"))
    return R.covered_length(segments, ["l_suppkey"], "s", "e")


_CUT = """WITH seg AS (SELECT DISTINCT l_orderkey AS k, 0::BIGINT AS s, 60::BIGINT AS e FROM lineitem),
cut AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 5::BIGINT AS cs, l_linenumber * 5 + (l_quantity::BIGINT % 4) + 1 AS ce FROM lineitem WHERE l_returnflag = 'R'),
pts AS (SELECT DISTINCT k, unnest([cs, ce]) AS p FROM cut), ed AS (SELECT k, s AS p FROM seg UNION SELECT seg.k, p FROM seg JOIN pts ON seg.k = pts.k WHERE p > s AND p < e),
pc AS (SELECT k, p AS s, coalesce(lead(p) OVER (PARTITION BY k ORDER BY p), 60) AS e FROM ed)"""


@query(_CUT + " SELECT k, s AS start, e AS \"end\", EXISTS (SELECT 1 FROM cut WHERE cut.k = pc.k AND cs < e AND ce > s) AS inside FROM pc")
def q_interval_split(t: Tables) -> DataFrame:
    seg = t.lineitem.select(F.col("l_orderkey").alias("k"), F.lit(0).cast("long").alias("start"), F.lit(60).cast("long").alias("end")).distinct()
    at = F.col("l_linenumber").cast("long") * 5
    cut = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), at.alias("cut_start"), (at + F.pmod(F.col("l_quantity").cast("long"), F.lit(4)) + 1).alias("cut_end")).distinct()
    return R.split_intervals(seg, cut, "k")


@query("""WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS votes FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(votes) OVER (PARTITION BY l_suppkey) AS total, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, l_partkey) AS rn FROM c)
SELECT l_suppkey, l_partkey, votes, round(votes / total, 6) AS share FROM r WHERE rn = 1""")
def q_votes(t: Tables) -> DataFrame:
    return R.majority(t.lineitem, "l_suppkey", "l_partkey").withColumn("share", F.round("share", 6))


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def q_first_latest(t: Tables) -> DataFrame:
    return R.latest_by(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"])


_OLD = "SELECT o_orderkey, o_orderstatus AS c FROM orders WHERE o_orderkey % 7 <> 0"
_NEW = "SELECT CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS c FROM orders WHERE o_orderkey % 5 <> 0"
_DIFF = f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.c AS old_content, b.c AS new_content, CASE WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.o_orderkey IS NULL THEN 'new' WHEN a.c = b.c THEN 'unchanged' ELSE 'modified' END AS change
FROM ({_OLD}) a FULL JOIN ({_NEW}) b ON a.o_orderkey = b.o_orderkey"""


def _snapshots(t: Tables) -> DataFrame:
    old = t.orders.where("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("c"))
    moved = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") + 10000000).otherwise(F.col("o_orderkey"))
    new = t.orders.where("o_orderkey % 5 <> 0").select(moved.alias("o_orderkey"), F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("c"))
    return R.snapshot_diff(old, new, "o_orderkey", "c")


@query(_DIFF)
def q_diff(t: Tables) -> DataFrame:
    """Two snapshots of the orders: some keys leave, some move, some change."""
    return _snapshots(t)


@query(f"""WITH d AS ({_DIFF}), g AS (SELECT o_orderkey AS old_key, old_content AS content, row_number() OVER (PARTITION BY old_content ORDER BY o_orderkey) AS n FROM d WHERE change = 'deleted'),
m AS (SELECT o_orderkey AS new_key, new_content AS content, row_number() OVER (PARTITION BY new_content ORDER BY o_orderkey) AS n FROM d WHERE change = 'new')
SELECT old_key, new_key, content FROM g JOIN m USING (content, n)""")
def q_rename(t: Tables) -> DataFrame:
    return R.match_renames(_snapshots(t), "o_orderkey")


@query(f"""WITH n AS (SELECT count_if(change = 'deleted') AS deleted, count_if(change = 'new') AS new, count_if(change = 'modified') AS modified, count_if(change = 'unchanged') AS unchanged, count_if(change = 'modified' AND new_content = 'X') AS corrupted FROM ({_DIFF}))
SELECT *, CASE WHEN deleted + corrupted >= 5 OR deleted > 0 AND corrupted > 0 THEN 'HIGH' WHEN deleted + corrupted >= 1 OR modified >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM n WHERE deleted + corrupted > 0 OR modified >= 3""")
def q_incident(t: Tables) -> DataFrame:
    d = _snapshots(t)
    n = d.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("deleted", "new", "modified", "unchanged")], F.count_if((F.col("change") == "modified") & (F.col("new_content") == "X")).alias("corrupted"))
    lost = F.col("deleted") + F.col("corrupted")
    return n.where((lost > 0) | (F.col("modified") >= 3)).withColumn("severity", S.incident_severity(lost, F.col("deleted"), F.col("corrupted"), F.col("modified")))


@query(f"SELECT d.o_orderkey FROM ({_DIFF}) d WHERE change = 'deleted' AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = d.o_orderkey AND o_orderstatus = 'F')")
def q_new_loss(t: Tables) -> DataFrame:
    """Losses that were not reported before (those of status F were)."""
    reported = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    return _snapshots(t).where("change = 'deleted'").select("o_orderkey").join(reported, "o_orderkey", "left_anti")


_LINKS = """SELECT DISTINCT least(l_partkey, f) AS a, greatest(l_partkey, f) AS b FROM (SELECT l_partkey, min(l_partkey) OVER (PARTITION BY l_suppkey, l_quantity, l_linenumber) AS f FROM lineitem) WHERE l_partkey <> f"""


def _links(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_quantity", "l_linenumber", "l_partkey")
    first = rows.groupBy("l_suppkey", "l_quantity", "l_linenumber").agg(F.min("l_partkey").alias("a"))
    return rows.join(first, ["l_suppkey", "l_quantity", "l_linenumber"]).where("l_partkey <> a").select("a", F.col("l_partkey").alias("b")).distinct()


#: Labels spread over links; sixteen steps are more than the test tables need, and one more must change nothing.
_STEPS = ", ".join(f"s{i + 1} AS MATERIALIZED (SELECT x.a, least(min(y.c), min(x.c)) AS c FROM s{i} x JOIN arcs ON arcs.a = x.a JOIN s{i} y ON y.a = arcs.b GROUP BY x.a)" for i in range(16))


@query(f"""WITH e AS MATERIALIZED ({_LINKS}), arcs AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), s0 AS MATERIALIZED (SELECT DISTINCT a, a AS c FROM arcs), {_STEPS}
SELECT a AS id, c AS component FROM s16""")
def q_components(t: Tables) -> DataFrame:
    return R.components(_links(t))


@query(f"""WITH e AS ({_LINKS}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT a AS id, count(*) AS degree, count(DISTINCT b) AS neighbours FROM s GROUP BY a)
SELECT id, degree, neighbours, round(neighbours / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d""")
def q_degree(t: Tables) -> DataFrame:
    return R.degree(_links(t)).withColumn("centrality", F.round("centrality", 6))


@query()
def q_components_all(t: Tables) -> DataFrame:
    """The same as q_components, under its former name; tested against union-find."""
    return R.components(_links(t))


@query(f"""WITH e AS ({_LINKS}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT a AS id, count(*) AS degree, count(DISTINCT b) AS neighbours FROM s GROUP BY a)
SELECT id, degree, neighbours, round(neighbours / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d""")
def q_degree_all(t: Tables) -> DataFrame:
    """The same as q_degree, under its former name."""
    return R.degree(_links(t)).withColumn("centrality", F.round("centrality", 6))


@query("SELECT user_id, bool_and(event_id > coalesce(p, -1)) AS monotonic, count(*) AS n FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def q_monotonic(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("p", F.lag("event_id").over(w))
    return rows.groupBy("user_id").agg(F.bool_and(F.col("event_id") > F.coalesce("p", F.lit(-1))).alias("monotonic"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(*) AS n_steps, count_if(event_id % 8 <> (p + 1) % 8) AS breaks FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL GROUP BY user_id")
def q_sequence_breaks(t: Tables) -> DataFrame:
    """Steps whose cyclic number (0..7) is not the successor of the one before, as with restart markers."""
    rows = t.events.withColumn("p", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))).where("p is not null")
    broken = F.pmod("event_id", F.lit(8)) != F.pmod(F.col("p") + 1, F.lit(8))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(broken).alias("breaks"))


@query("""SELECT a.l_suppkey, a.l_partkey, a.l_orderkey, b.l_orderkey AS next_orderkey FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber + 1 = b.l_linenumber AND a.l_partkey = b.l_partkey""")
def q_continuity(t: Tables) -> DataFrame:
    """Rows joined to those that continue them: same key, next number."""
    a = t.lineitem.select("l_suppkey", "l_partkey", "l_orderkey", (F.col("l_linenumber") + 1).alias("n"))
    b = t.lineitem.select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("next_orderkey"), F.col("l_linenumber").alias("n"))
    return a.join(b, ["l_suppkey", "l_partkey", "n"]).drop("n")


@query("""WITH c AS (SELECT l_partkey * 7 % 500 AS slot, l_orderkey, l_linenumber, abs(l_partkey - l_suppkey) AS dist, l_quantity AS strength FROM lineitem)
SELECT slot, l_orderkey, l_linenumber, dist, strength FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY dist, strength DESC, l_orderkey, l_linenumber) AS rn FROM c) WHERE rn = 1""")
def q_slots(t: Tables) -> DataFrame:
    claims = t.lineitem.select((F.col("l_partkey") * 7 % 500).alias("slot"), "l_orderkey", "l_linenumber", F.abs(F.col("l_partkey") - F.col("l_suppkey")).alias("dist"), F.col("l_quantity").alias("strength"))
    return R.resolve_slots(claims, "slot", [F.col("dist"), F.col("strength").desc(), F.col("l_orderkey"), F.col("l_linenumber")])


@query("""SELECT s_suppkey, c_custkey, round(abs(s_acctbal - c_acctbal), 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS rn FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE rn = 1""")
def q_nearest_size(t: Tables) -> DataFrame:
    """For each target the candidate of its type that is nearest in size."""
    targets = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("type"), F.col("s_acctbal").alias("size"))
    pool = t.customer.select("c_custkey", F.col("c_nationkey").alias("type"), F.col("c_acctbal").alias("size"))
    best = placement.nearest(targets, pool, ["type"], "size", "c_custkey").where("c_custkey is not null")
    return best.select("s_suppkey", "c_custkey", F.round("off", 6).alias("gap"))
