"""Sketch, bitmap, heavy-hitter, scatter-matrix, nice-histogram and observed-write queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabprobe.functions.columns import month_period
from tabprobe.operators import sketches as sk
from tabprobe.operators import stats as st
from tabprobe.operators._util import broadcast_if_small, numeric_long, persist
from tabprobe.operators.heavy import heavy_hitters
from tabprobe.operators.reshape import explode_tokens
from tabprobe.plans import q_domains as qd
from tabprobe.plans.registry import ORACLE_SQL, query
from tabprobe.session import ensure_checkpoint_dir
from tabprobe.sources.io import table, write_observed

_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]
_SKETCHED = ["l_extendedprice", "l_quantity", "l_discount"]


@query("sketch_quantile_error", "\nUNION ALL\n".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", CAST({p} AS DOUBLE) AS p, count({c}) AS n, true AS within FROM lineitem GROUP BY l_returnflag"
    for c in _SKETCHED for p in _PROBS))
def q_sketch_quantile_error(spark, d):
    """Whether the ranks of merged per-file sketches' quantiles lie within twice the published error."""
    li, by = table(spark, d, "lineitem"), ["l_returnflag"]
    merged = sk.merge_sketches(persist(sk.quantile_sketches(li, _SKETCHED, by)), [*by, "column"])
    q = persist(sk.sketch_quantiles(merged, [*by, "column"], _PROBS))
    values = numeric_long(li, _SKETCHED, by).filter("value is not null").join(broadcast_if_small(q), [*by, "column"])
    ranks = values.groupBy(*by, "column", "p").agg(F.max("n").alias("n"), F.avg((F.col("value") < F.col("q")).cast("int")).alias("below"),
                                                   F.avg((F.col("value") <= F.col("q")).cast("int")).alias("upto"))
    error = 2 * sk.rank_error()
    return ranks.select(*by, "column", "p", "n", ((F.col("below") - error <= F.col("p")) & (F.col("p") <= F.col("upto") + error)).alias("within"))


@query("distinct_customers_bitmap", """
SELECT strftime(o_orderdate, '%Y-%m') AS period, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1
UNION ALL SELECT strftime(o_orderdate, '%Y'), count(DISTINCT o_custkey) FROM orders GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT o_custkey) FROM orders
""")
def q_distinct_customers_bitmap(spark, d):
    """Distinct customers a month, and from the months' bitmaps a year and in all."""
    o = table(spark, d, "orders").select(month_period("o_orderdate").alias("period"), "o_custkey")
    months = persist(sk.distinct_bitmaps(o, ["period"], "o_custkey"))
    years = sk.merge_bitmaps(months.withColumn("period", F.substring("period", 1, 4)), ["period"])
    ever = sk.merge_bitmaps(months.withColumn("period", F.lit("all")), ["period"])
    sets = months.unionByName(years).unionByName(ever)
    return sk.count_bitmaps(sets, ["period"], "customers")


@query("heavy_words_top50", """
SELECT word, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> ''
GROUP BY word ORDER BY count DESC, word LIMIT 50
""")
def q_heavy_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    return heavy_hitters(words, "word", 50)


@query("games_tags_heavy", ORACLE_SQL["games_tags_top20"])
def q_games_tags_heavy(spark, d):
    games = qd._games(spark, d).filter(F.col("popular_tags").isNotNull())
    return heavy_hitters(explode_tokens(games, "popular_tags", pattern=",", name="tag"), "tag", 20)


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _place(x: str, e: str, bins: int) -> str:
    return f"CASE WHEN {e}.b > {e}.a THEN CAST(least(floor(({x} - {e}.a) / (({e}.b - {e}.a) / {bins}.0)), {bins - 1}) AS INTEGER) ELSE 0 END"


@query("scatter_matrix", f"WITH " + ", ".join(
    f"e{i} AS (SELECT min({c}) AS a, max({c}) AS b FROM lineitem)" for i, c in enumerate(_MATRIX)) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{x}' AS x, '{y}' AS y, {_place(x, f'e{i}', 20)} AS x_bin, {_place(y, f'e{j}', 20)} AS y_bin, count(*) AS count FROM lineitem, e{i}, e{j} GROUP BY ALL"
    for i, x in enumerate(_MATRIX) for j, y in enumerate(_MATRIX) if i < j))
def q_scatter_matrix(spark, d):
    return st.scatter_matrix(table(spark, d, "lineitem"), _MATRIX, bins=20)


@query("scatter_matrix_embeddings", f"""
WITH v AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
e AS (SELECT i, min(x) AS a, max(x) AS b FROM v GROUP BY i)
SELECT CAST(p.i AS VARCHAR) AS x, CAST(q.i AS VARCHAR) AS y, {_place('p.x', 'ep', 10)} AS x_bin, {_place('q.x', 'eq', 10)} AS y_bin, count(*) AS count
FROM v p JOIN v q ON p.vec_id = q.vec_id AND p.i < q.i JOIN e ep ON ep.i = p.i JOIN e eq ON eq.i = q.i GROUP BY ALL
""")
def q_scatter_matrix_embeddings(spark, d):
    return st.scatter_matrix(table(spark, d, "embeddings"), bins=10, vector="embedding")


def _nice_sql(rel: str, column: str, by: str | None, bins: int) -> str:
    key = f"{by}, " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM {rel})," if by else ""
    return f"""
WITH r AS (SELECT min({column}) AS a, max({column}) AS b, (max({column}) - min({column})) / {bins}.0 AS raw FROM {rel}),
m AS (SELECT *, pow(10.0, floor(log10(raw))) AS p FROM r),
s AS (SELECT *, CASE WHEN raw <= p THEN p WHEN raw <= 2 * p THEN 2 * p WHEN raw <= 5 * p THEN 5 * p ELSE 10 * p END AS step FROM m),
c AS (SELECT {key}CAST(floor({column} / step) AS BIGINT) AS place, count(*) AS n FROM {rel}, s GROUP BY ALL),
g AS (SELECT {key}place FROM {groups} (SELECT unnest(range(CAST(floor(a / step) AS BIGINT), CAST(floor(b / step) AS BIGINT) + 1)) AS place FROM s))
SELECT {key}'{column}' AS "column", round(place * step, 6) AS bin_lo, round((place + 1) * step, 6) AS bin_hi, coalesce(n, 0) AS count
FROM g LEFT JOIN c USING ({key}place), s"""


def _nice(df, column, bins, by=()):
    h = st.histogram_nice(df, [column], bins, by)
    return h.withColumn("bin_lo", F.round("bin_lo", 6)).withColumn("bin_hi", F.round("bin_hi", 6))


@query("histogram_nice", _nice_sql("customer", "c_acctbal", None, 40))
def q_histogram_nice(spark, d):
    return _nice(table(spark, d, "customer"), "c_acctbal", 40)


@query("histogram_nice_by_class", _nice_sql("lineitem", "l_extendedprice", "l_returnflag", 50))
def q_histogram_nice_by_class(spark, d):
    return _nice(table(spark, d, "lineitem"), "l_extendedprice", 50, ["l_returnflag"])


@query("observed_kpis", """
SELECT count(*) AS contacts, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS subscriptions,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 9) AS conversion_rate, round(avg(o_totalprice), 6) AS mean_totalprice,
  count(*) FILTER (WHERE customer IS NULL) AS missing_rows, round(count(*) FILTER (WHERE customer IS NULL) * 100.0 / count(*), 9)::DOUBLE AS missing_pct
FROM (SELECT *, CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS customer FROM orders)
""")
def q_observed_kpis(spark, d):
    """KPI row and missing-key audit of a table while it is written."""
    o = table(spark, d, "orders").withColumn("customer", F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")))
    final, missing, rows = (F.col("o_orderstatus") == "F").cast("int"), F.count_if(F.col("customer").isNull()), F.count(F.lit(1))
    return write_observed(o, f"{ensure_checkpoint_dir(spark)}/orders-{uuid.uuid4().hex}", {
        "contacts": rows, "subscriptions": F.sum(final), "conversion_rate": F.round(F.avg(final), 9), "mean_totalprice": F.round(F.avg("o_totalprice"), 6),
        "missing_rows": missing, "missing_pct": F.round(F.try_divide(missing * 100.0, rows), 9)})
