"""Queries of the PDF verdict and of walks over trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pdf as P
from .registry import Tables, query

_NAMES = tuple(P.WEIGHTS)
_SCORES = "SELECT o_orderkey AS file, ['" + "', '".join(_NAMES) + "'][k + 1] AS name, CASE WHEN k = 8 THEN NULL WHEN (o_orderkey + o_custkey * (k + 1)) % 5 < 3 THEN 1.0 WHEN (o_orderkey + o_custkey * (k + 1)) % 5 = 3 THEN 0.0 ELSE 0.95 END AS score, o_custkey % 3 AS pages, o_custkey % 4 AS declared, o_custkey % 5 AS intact FROM orders, range(9) t(k)"
_WEIGHT = "CASE name " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in P.WEIGHTS.items()) + " END"


@query(f"""WITH s AS (SELECT *, {_WEIGHT} AS w FROM ({_SCORES})), a AS (SELECT file, round(100 * sum(w * score) / sum(CASE WHEN score IS NOT NULL THEN w END), 1) AS integrity, count_if(score < 1) AS failing, max(pages) AS pages, max(declared) AS d, max(intact) AS intact,
bool_and(name NOT IN ('header', 'trailer', 'page_tree') OR score = 1) AS structural, max(CASE WHEN name = 'references' THEN score END) AS r FROM s GROUP BY file)
SELECT file, integrity, CASE WHEN failing = 0 AND greatest(d, pages) > 0 AND pages = greatest(d, pages) THEN 'FULLY_RECOVERED' WHEN structural AND greatest(d, pages) > 0 AND pages = greatest(d, pages) AND r >= 0.9 THEN 'MOSTLY_RECOVERED'
WHEN pages > 0 THEN 'PARTIALLY_RECOVERED' WHEN intact > 0 THEN 'FRAGMENT_ONLY' ELSE 'UNRECOVERABLE' END AS status, failing AS problems FROM a""")
def q_pdf_verdict(t: Tables) -> DataFrame:
    """The verdict from nine scores; orders stand for files. tests/test_pdf.py has the checks on real files."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score = lambda i: F.lit(None).cast("double") if i == 8 else F.when((k + c * (i + 1)) % 5 < 3, 1.0).when((k + c * (i + 1)) % 5 == 3, 0.0).otherwise(0.95)
    rows = t.orders.select(k.alias("file"), F.struct((c % 3).alias("pages"), (c % 4).alias("declared"), (c % 5).alias("intact")).alias("facts"), F.explode(F.array(*[F.struct(F.lit(n).alias("check"), score(i).alias("score")) for i, n in enumerate(_NAMES)])).alias("x"))
    found = P.verdict(rows.select("file", "facts", "x.check", "x.score"))
    return found.withColumn("problems", F.size("problems").cast("long"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey // 5 AS parent, p_partkey AS child FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 7 = 3),
r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT child, depth + 1 FROM r JOIN e ON parent = node WHERE depth < 12) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def q_tree_walk(t: Tables) -> DataFrame:
    """What node 1 reaches over a tree with some links back, twelve levels deep."""
    down = t.part.where("p_partkey > 0").select(F.lit(0).alias("group"), F.floor(F.col("p_partkey") / 5).alias("parent"), F.col("p_partkey").alias("child"))
    back = t.part.where("p_partkey % 7 = 3").select(F.lit(0).alias("group"), F.col("p_partkey").alias("parent"), F.floor(F.col("p_partkey") / 2).alias("child"))
    roots = t.spark.range(1, 2).select(F.lit(0).alias("group"), F.col("id").alias("node"))
    return P.walk(down.unionByName(back).distinct(), roots, 12).select("node", "depth")
