"""Queries over similar names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.functions import names
from shelfscope.functions.numbers import half_up
from shelfscope.operators import matching, similar
from shelfscope.sources.tables import read


def _listed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The names of all parts, and as another store writes them: a word more, one less, a letter less."""
    name, key = F.col("p_name"), F.col("p_partkey") % 4
    other = F.when(key == 0, name).when(key == 1, F.concat(name, F.lit(" new"))).when(key == 2, F.regexp_replace(name, " [^ ]*$", "")).otherwise(F.concat(F.substring(name, 1, 2), F.expr("substring(p_name, 4)")))
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("ord"), names.plain(name).alias("plain")), p.select(F.col("p_partkey").alias("ord"), names.plain(other).alias("plain"))


def similar_names(spark, d):
    """All pairs of names of two catalogues with similarity of 0.8 at least."""
    mine, theirs = _listed(spark, d)
    return similar.similar_pairs(mine, theirs, matching.THRESHOLD).select("a", "b", (F.floor(F.col("score") * 1000000 + 0.5) / 1000000).alias("score"))


def name_links(spark, d):
    """How many rows of the other catalogue each row of mine could be matched with by name."""
    mine, theirs = _listed(spark, d)
    copies = theirs.groupBy(F.col("plain").alias("b")).agg(F.count("*").alias("n"))
    links = matching.similar_names(mine, theirs).join(copies, "b").groupBy("a").agg(F.sum("n").alias("links"), F.max(half_up(F.col("score") * 100)).alias("best"))
    return mine.join(links, F.col("plain") == F.col("a")).select(F.col("ord").alias("mine"), "links", "best")


def name_matches(spark, d):
    """Rows of both catalogues one to one by similar names: how many of each confidence."""
    mine, theirs = _listed(spark, d)
    return matching.fuzzy_matches(mine, theirs).groupBy("confidence").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (similar_names, name_links, name_matches)}

_PLAIN = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_OTHER = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' new' WHEN 2 THEN regexp_replace(p_name, ' [^ ]*$', '') ELSE substr(p_name, 1, 2) || substr(p_name, 4) END"
_SCORED = f"""one AS MATERIALIZED (SELECT p_partkey AS mine, {_PLAIN.format("p_name")} AS a FROM part), two AS MATERIALIZED (SELECT p_partkey AS theirs, {_PLAIN.format(_OTHER)} AS b FROM part),
  p AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM (SELECT DISTINCT a FROM one WHERE a <> ''), (SELECT DISTINCT b FROM two WHERE b <> '')),
  y AS (SELECT *, len(list_intersect(ta, tb)) AS i FROM p), z AS (SELECT a, b, i / (len(ta) + len(tb) - i) AS j, least(length(a), length(b)) / greatest(length(a), length(b)) AS r FROM y),
  scored AS (SELECT * FROM (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN j >= 0.75 THEN j WHEN contains(a, b) OR contains(b, a) THEN 0.6 + 0.35 * r ELSE 1.0 - levenshtein(a, b) / greatest(length(a), length(b)) END AS score FROM z) WHERE score >= 0.8)"""

ORACLES = {
    "similar_names": f"WITH {_SCORED} SELECT a, b, floor(score * 1000000 + 0.5) / 1000000 AS score FROM scored",
    "name_links": f"""WITH {_SCORED} SELECT mine, count(*) AS links, max(floor(score * 100 + 0.5))::BIGINT AS best FROM scored JOIN one USING (a) JOIN two USING (b)
      WHERE floor(length(b) / 5 + 0.5) BETWEEN greatest(0, floor((length(a) - 15) / 5 + 0.5)) AND floor((length(a) + 15) / 5 + 0.5) GROUP BY 1""",
}
