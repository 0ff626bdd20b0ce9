"""Queries of hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from . import adapters as A
from .ranges import query

R = ["class", "order", "family"]


@query("discrete_ranks", """WITH h AS (SELECT p_type AS a, p_brand AS b, CASE WHEN p_size < 10 THEN p_type WHEN p_size < 20 THEN p_brand ELSE p_name END AS c FROM part),
u AS (SELECT DISTINCT k, rank, name FROM (SELECT 0 AS k, 'a' AS rank, a AS name FROM h UNION ALL SELECT 1, 'b', b FROM h UNION ALL SELECT 2, 'c', c FROM h) WHERE name IS NOT NULL),
j AS (SELECT x.k AS i, y.k AS j, x.rank, y.rank AS other_rank, name FROM u x JOIN u y USING (name) WHERE x.k <> y.k)
SELECT 'adj' AS scope, rank, other_rank, name FROM j WHERE j = i + 1 UNION ALL SELECT 'all', rank, other_rank, name FROM j WHERE i < 2""")
def discrete_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    x = A.table(spark, sf_dir, "part").select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"), F.when(size < 10, F.col("p_type")).when(size < 20, F.col("p_brand")).otherwise(F.col("p_name")).alias("c"))
    return ranks.discrete_ranks(x)


_DUP = """, t3 AS (SELECT family AS taxon, 'family' AS rank FROM (SELECT DISTINCT "class", "order", family FROM h WHERE family IS NOT NULL) GROUP BY 1 HAVING count(*) > 1),
t2 AS (SELECT "order" AS taxon, 'order' AS rank FROM (SELECT DISTINCT "class", "order" FROM h WHERE "order" IS NOT NULL) GROUP BY 1 HAVING count(*) > 1)
SELECT * FROM t3 UNION ALL SELECT * FROM t2"""


@query("find_duplicates", f"WITH {A.CONFLICT}{_DUP}")
def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.find_duplicates(A.conflict(spark, sf_dir), R)


@query("find_duplicates_tree", f"WITH {A.TREE}{_DUP}")
def find_duplicates_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.find_duplicates(A.tree(spark, sf_dir), R)


_TREE_GAPS = A.TREE.replace("FROM supplier", "FROM supplier").replace('n_name AS "order"', """CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS "order\"""")
_EDGES = """, e AS (SELECT child, parent, max(cr) AS child_rank, max(pr) AS parent_rank, count(*) AS freq FROM (
  SELECT "order" AS child, "class" AS parent, 2 AS cr, 1 AS pr FROM h WHERE "order" IS NOT NULL AND "class" IS NOT NULL
  UNION ALL SELECT family, coalesce("order", "class"), 3, CASE WHEN "order" IS NOT NULL THEN 2 ELSE 1 END FROM h WHERE family IS NOT NULL AND coalesce("order", "class") IS NOT NULL) WHERE child <> parent GROUP BY 1, 2)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (A.table(spark, sf_dir, k) for k in ("supplier", "nation", "region"))
    x = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select(F.col("r_name").alias("class"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("order"), F.col("s_name").alias("family"))


@query("tgraph_edges", f"WITH {_TREE_GAPS}{_EDGES} SELECT * FROM e")
def tgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.tgraph(_gaps(spark, sf_dir), R).edges


@query("tgraph_vertices", f"""WITH {_TREE_GAPS}{_EDGES} SELECT name, max(rank) AS rank, CAST(sum(d) AS BIGINT) AS degree, CAST(sum(f) AS BIGINT) AS strength
FROM (SELECT child AS name, child_rank AS rank, 1 AS d, freq AS f FROM e UNION ALL SELECT parent, parent_rank, 0, 0 FROM e) GROUP BY 1""")
def tgraph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.tgraph(_gaps(spark, sf_dir), R).vertices


@query("neighbourhood", f"""WITH RECURSIVE {A.TREE}{_EDGES}, n(name, step) AS (SELECT 'ASIA', 0 UNION ALL SELECT child, step + 1 FROM n JOIN e ON parent = name WHERE step < 1)
SELECT * FROM e WHERE child IN (SELECT name FROM n) AND parent IN (SELECT name FROM n)""")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.neighbourhood(ranks.tgraph(A.tree(spark, sf_dir), R), ["ASIA"], "child", 1).edges


@query("update_graph", f"""WITH {A.TREE}{_EDGES}, k AS (SELECT child, parent, freq FROM e WHERE parent <> 'ASIA'),
v AS (SELECT name, max(rank) AS rank FROM (SELECT child AS name, child_rank AS rank FROM e UNION ALL SELECT parent, parent_rank FROM e) GROUP BY 1)
SELECT v.name, rank, count(child) AS degree, CAST(coalesce(sum(freq), 0) AS BIGINT) AS strength FROM v LEFT JOIN k ON child = v.name GROUP BY 1, 2""")
def update_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ranks.tgraph(A.tree(spark, sf_dir), R)
    return ranks.update_graph(g, g.edges.where("parent = 'ASIA'")).vertices


@query("resolve_duplicates", f"""WITH {A.TANGLED}, {A.RESOLVED} SELECT o_orderkey, "class", "order", family FROM y""")
def resolve_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.resolve_duplicates(A.tangled(spark, sf_dir), R)


@query("find_duplicates_tangled", f"""WITH {A.TANGLED}, l AS (SELECT DISTINCT "class", "order", family FROM x), k AS (SELECT DISTINCT "class", "order" FROM x WHERE "order" IS NOT NULL)
SELECT family AS taxon, 'family' AS rank FROM l GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT "order", 'order' FROM k GROUP BY 1 HAVING count(*) > 1""")
def find_duplicates_tangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.find_duplicates(A.tangled(spark, sf_dir), R)


@query("assess_duplicates", f"""WITH {A.TANGLED}, {A.RESOLVED} SELECT DISTINCT f.family AS taxon, 'family' AS rank,
  CASE WHEN orders + gap > 2 THEN 'retained: three parents or more' WHEN gap = 1 THEN 'cut: rank skipped' ELSE 'cut: rarer of two equal paths' END AS decision,
  CASE WHEN orders + gap > 2 THEN NULL WHEN gap = 1 THEN "class" ELSE (SELECT max("order") FROM l WHERE l.family = f.family AND "order" <> best) END AS cut_from
FROM f JOIN l USING (family) WHERE orders + gap > 1""")
def assess_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranks.assess_duplicates(A.tangled(spark, sf_dir).drop("o_orderkey"), R)
    return out.select("taxon", "rank", "decision", F.get("cut", F.lit(0))["parent"].alias("cut_from"))
