"""Table-profiling queries (Q*, T*, U*, C*, B1, H*, A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabprobe.operators import correlation as cr
from tabprobe.operators import groups as gp
from tabprobe.operators import quality as qa
from tabprobe.operators import stats as st
from tabprobe.operators.outliers import outlier_report_iqr
from tabprobe.plans.registry import query
from tabprobe.sources.io import table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r(df, cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _union_sql(parts):
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


_CUSTOMER_COLS = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                  ("c_acctbal", "double"), ("c_mktsegment", "string")]

_DQ_SQL = _union_sql([
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls,
  round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, count(DISTINCT {c}) AS cardinality,
  coalesce(CAST(min({c}) AS VARCHAR), '') AS sample FROM customer"""
    for c, t in _CUSTOMER_COLS])


@query("data_quality", _DQ_SQL)
def q_data_quality(spark, d):
    r = qa.data_quality_report(table(spark, d, "customer"))
    return _r(r, ["null_pct"])


_LINEITEM_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
                   "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                   "l_linestatus": "string", "l_shipdate": "timestamp"}
_DQ_LINEITEM_SQL = _union_sql([
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null,
  count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, count(DISTINCT {c}) AS cardinality
  FROM lineitem""" for c, t in _LINEITEM_TYPES.items()])


@query("data_quality_lineitem", _DQ_LINEITEM_SQL)
def q_data_quality_lineitem(spark, d):
    """Eleven columns; the samples, whose text form differs between engines, are left out."""
    r = qa.data_quality_report(table(spark, d, "lineitem")).drop("sample")
    return _r(r, ["null_pct"]).withColumn("dtype", F.regexp_replace("dtype", "_ntz$", ""))


@query("duplicate_summary", """
SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus,
  l_quantity, l_discount, l_tax FROM lineitem)) AS duplicate_rows,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax
  FROM lineitem))) * 100.0 / count(*), 6) AS duplicate_pct
FROM lineitem
""")
def q_duplicate_summary(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    return _r(qa.duplicate_summary(li), ["duplicate_pct"])


@query("duplicate_summary_full", """
SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem))) * 100.0 / count(*), 6) AS duplicate_pct
FROM lineitem
""")
def q_duplicate_summary_full(spark, d):
    return _r(qa.duplicate_summary(table(spark, d, "lineitem")), ["duplicate_pct"])


_MISSING_SQL = """
WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio,
                  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus FROM orders)
SELECT "column", null_pct FROM (
  SELECT 'o_orderkey' AS "column", round((count(*) - count(o_orderkey)) * 100.0 / count(*), 6) AS null_pct FROM o
  UNION ALL SELECT 'prio', round((count(*) - count(prio)) * 100.0 / count(*), 6) FROM o
  UNION ALL SELECT 'price', round((count(*) - count(price)) * 100.0 / count(*), 6) FROM o
  UNION ALL SELECT 'o_orderstatus', round((count(*) - count(o_orderstatus)) * 100.0 / count(*), 6) FROM o)
WHERE null_pct > 0
"""


@query("missing_values", _MISSING_SQL)
def q_missing_values(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("prio"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), "o_orderstatus")
    return _r(qa.missing_values(qa.data_quality_report(o)), ["null_pct"])


def _stats_sql(table_name, cols, by=None):
    parts = []
    for c in cols:
        sel_by = f"{by}, " if by else ""
        parts.append(f"""SELECT {sel_by}'{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS median,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max,
  round(CASE WHEN min({c}) = max({c}) AND count({c}) >= 3 THEN 0 ELSE skewness({c}) END, 6) AS skew,
  round(CASE WHEN min({c}) = max({c}) AND count({c}) >= 4 THEN 0 ELSE kurtosis({c}) END, 6) AS kurtosis
FROM {table_name}{f' WHERE {by} IS NOT NULL GROUP BY {by}' if by else ''}""")
    return _union_sql(parts)


_STAT_COLS = ["mean", "std", "min", "p25", "median", "p75", "max", "skew", "kurtosis"]


@query("descriptive_stats", _stats_sql("lineitem", LI_NUM + ["l_linenumber"]))
def q_descriptive_stats(spark, d):
    r = st.descriptive_stats(table(spark, d, "lineitem"), LI_NUM + ["l_linenumber", "no_such_column", "l_returnflag"])
    return _r(r, _STAT_COLS)


@query("describe_by_class", """
SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean,
  round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, round(max(l_extendedprice), 6) AS max
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag
""")
def q_describe_by_class(spark, d):
    r = gp.describe_by_class(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    return _r(r, _STAT_COLS)


def _hist_sql(table_name, c, bins, by=None, where=None):
    by_sel = f"{by}, " if by else ""
    w = f"WHERE {where}" if where else ""
    grp_src = f"(SELECT DISTINCT {by} FROM {table_name} WHERE {c} IS NOT NULL {('AND ' + where) if where else ''})" \
        if by else "(SELECT 1 AS _one)"
    return f"""
WITH src AS (SELECT {by_sel}CAST({c} AS DOUBLE) AS v FROM {table_name} {w}),
     e AS (SELECT min(v) AS mn, max(v) AS mx FROM src),
     b AS (SELECT {by_sel}CASE WHEN e.mx = e.mn THEN 0
                  ELSE least(floor((v - e.mn) / ((e.mx - e.mn) / {float(bins)})), {bins - 1}) END AS bin
           FROM src, e WHERE v IS NOT NULL),
     cnt AS (SELECT {by_sel}CAST(bin AS INTEGER) AS bin, count(*) AS count FROM b GROUP BY ALL),
     grid AS (SELECT {by_sel}CAST(bin AS INTEGER) AS bin FROM {grp_src} g, range(0, {bins}) r(bin))
SELECT {('grid.' + by + ', ') if by else ''}'{c}' AS "column", grid.bin,
  round(e.mn + grid.bin * ((e.mx - e.mn) / {float(bins)}), 6) AS bin_lo,
  round(e.mn + (grid.bin + 1) * ((e.mx - e.mn) / {float(bins)}), 6) AS bin_hi,
  CAST(coalesce(cnt.count, 0) AS BIGINT) AS count
FROM grid CROSS JOIN e LEFT JOIN cnt ON grid.bin = cnt.bin {('AND grid.' + by + ' = cnt.' + by) if by else ''}
"""


@query("histogram", _hist_sql("orders", "o_totalprice", 40))
def q_histogram(spark, d):
    return _r(st.histogram(table(spark, d, "orders"), ["o_totalprice"], bins=40), ["bin_lo", "bin_hi"])


@query("histogram_by_class", _hist_sql("lineitem", "l_extendedprice", 50, by="l_returnflag"))
def q_histogram_by_class(spark, d):
    h = st.histogram(table(spark, d, "lineitem"), ["l_extendedprice"], bins=50, by=["l_returnflag"])
    return _r(h, ["bin_lo", "bin_hi"])


@query("histogram_faceted", _union_sql([_hist_sql("lineitem", c, 40) for c in ["l_quantity", "l_discount", "l_tax"]]))
def q_histogram_faceted(spark, d):
    h = st.histogram(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], bins=40)
    return _r(h, ["bin_lo", "bin_hi"])


def _iqr_sql(table_name, cols, k=1.5):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column",
  count(*) FILTER (WHERE {c} < q.lo OR {c} > q.hi) AS outliers,
  round(count(*) FILTER (WHERE {c} < q.lo OR {c} > q.hi) * 100.0 / count(*), 6) AS outlier_pct,
  round(any_value(q.lo), 6) AS lower_bound, round(any_value(q.hi), 6) AS upper_bound,
  round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max
FROM {table_name}, (SELECT quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
  quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {table_name}) q""")
    return _union_sql(parts)


@query("outlier_iqr", _iqr_sql("lineitem", LI_NUM))
def q_outlier_iqr(spark, d):
    r = outlier_report_iqr(table(spark, d, "lineitem"), LI_NUM)
    return _r(r, ["outlier_pct", "lower_bound", "upper_bound", "min", "max"])


def _box_sql(table_name, c, by=None):
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON true"
    where = f"WHERE {by} IS NOT NULL" if by else ""
    return f"""
WITH q AS (SELECT {sel}quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
                  quantile_cont({c}, 0.75) AS q3 FROM {table_name} {where} {grp}),
     f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT {('f.' + by + ', ') if by else ''}'{c}' AS "column", round(any_value(q1), 6) AS q1,
  round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(any_value(lf), 6) AS lower_fence, round(any_value(uf), 6) AS upper_fence,
  round(min({c}) FILTER (WHERE {c} BETWEEN lf AND uf), 6) AS whisker_low,
  round(max({c}) FILTER (WHERE {c} BETWEEN lf AND uf), 6) AS whisker_high,
  round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  count(*) FILTER (WHERE NOT ({c} BETWEEN lf AND uf)) AS outliers
FROM {table_name} JOIN f {join} WHERE {c} IS NOT NULL {('GROUP BY f.' + by) if by else ''}
"""


_BOX_COLS = ["q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high", "mean", "std"]


@query("box_summary", _union_sql([_box_sql("lineitem", c) for c in ["l_quantity", "l_extendedprice"]]))
def q_box_summary(spark, d):
    return _r(st.box_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), _BOX_COLS)


@query("box_by_group", _box_sql("lineitem", "l_extendedprice", by="l_linestatus"))
def q_box_by_group(spark, d):
    b = st.box_summary(table(spark, d, "lineitem"), ["l_extendedprice"], by=["l_linestatus"])
    return _r(b.filter(F.col("l_linestatus").isNotNull()), _BOX_COLS)


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _corr_sql(fn="corr", src="lineitem"):
    parts = []
    for a in _CORR_COLS:
        for b in _CORR_COLS:
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round({fn}({a}, {b}), 9) AS corr FROM {src}")
    return _union_sql(parts)


@query("corr_matrix", _corr_sql())
def q_corr_matrix(spark, d):
    return _r(cr.correlation_long(table(spark, d, "lineitem"), _CORR_COLS), ["corr"], 9)


_RANKED = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
                                 for c in _CORR_COLS) + " FROM lineitem)"


@query("corr_spearman", _corr_sql(src=_RANKED))
def q_corr_spearman(spark, d):
    return _r(cr.correlation_long(table(spark, d, "lineitem"), _CORR_COLS, "spearman"), ["corr"], 9)


_KENDALL_COLS = ["c_acctbal", "c_nationkey", "c_custkey"]


def _kendall_sql() -> str:
    """Tau-b over all pairs of rows; customer is small enough for a pair join."""
    one = []
    for a in _KENDALL_COLS:
        for b in _KENDALL_COLS:
            dx, dy = f"sign(p.{a} - q.{a})", f"sign(p.{b} - q.{b})"
            one.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round(sum({dx} * {dy}) / (sqrt(sum(abs({dx}))) * sqrt(sum(abs({dy})))), 9) AS corr "
                       f"FROM customer p JOIN customer q ON p.c_custkey < q.c_custkey")
    return " UNION ALL ".join(one)


@query("corr_kendall", _kendall_sql())
def q_corr_kendall(spark, d):
    return _r(cr.correlation_long(table(spark, d, "customer"), _KENDALL_COLS, "kendall"), ["corr"], 9)


def _kendall_lineitem_sql() -> str:
    """Tau-b without a pair join: one column of each pair has few levels. For each value of the other one, rows
    below it are counted by level, and concordant less discordant pairs are summed over (value, level) cells."""
    cols = sorted(_CORR_COLS, key=lambda c: c != "l_extendedprice")
    one = [f"SELECT '{c}' AS var1, '{c}' AS var2, 1.0::DOUBLE AS corr" for c in cols]
    for k, a in enumerate(cols):
        for b in cols[k + 1:]:
            one.append(f"""SELECT unnest(['{a}', '{b}']) AS var1, unnest(['{b}', '{a}']) AS var2, corr FROM (
WITH g AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
cells AS (SELECT x, y, coalesce(n, 0) AS n FROM (SELECT DISTINCT x FROM g) CROSS JOIN (SELECT DISTINCT y FROM g) LEFT JOIN g USING (x, y)),
below AS (SELECT x, y, n, coalesce(sum(n) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM cells),
sides AS (SELECT n, coalesce(sum(b) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less,
                 coalesce(sum(b) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS more FROM below),
pairs AS (SELECT (SELECT sum(n) FROM g) AS m, (SELECT sum(n * (n - 1)) FROM (SELECT sum(n) AS n FROM g GROUP BY x)) AS tx,
                 (SELECT sum(n * (n - 1)) FROM (SELECT sum(n) AS n FROM g GROUP BY y)) AS ty, (SELECT sum(n * (less - more)) FROM sides) AS s)
SELECT round(2.0::DOUBLE * s / (sqrt((m * (m - 1) - tx)::DOUBLE) * sqrt((m * (m - 1) - ty)::DOUBLE)), 9) AS corr FROM pairs)""")
    return " UNION ALL ".join(one)


@query("corr_kendall_lineitem", _kendall_lineitem_sql())
def q_corr_kendall_lineitem(spark, d):
    return _r(cr.correlation_long(table(spark, d, "lineitem"), _CORR_COLS, "kendall"), ["corr"], 9)


@query("top_correlations", f"""
SELECT var1, var2, corr FROM ({_corr_sql()}) m
WHERE list_position({_CORR_COLS!r}, var1) < list_position({_CORR_COLS!r}, var2)
ORDER BY abs(corr) DESC NULLS LAST, var1, var2 LIMIT 5
""")
def q_top_correlations(spark, d):
    return _r(cr.top_correlations(table(spark, d, "lineitem"), _CORR_COLS, n=5), ["corr"], 9)


@query("class_balance", """
SELECT o_orderstatus, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS percent
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus
""")
def q_class_balance(spark, d):
    return _r(gp.class_balance(table(spark, d, "orders"), "o_orderstatus"), ["percent"], 9)


@query("class_balance_labels", """
SELECT quality, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS percent
FROM labels WHERE quality IS NOT NULL GROUP BY quality
""")
def q_class_balance_labels(spark, d):
    return _r(gp.class_balance(table(spark, d, "labels"), "quality"), ["percent"], 9)


@query("scatter_bins", """
WITH e AS (SELECT min(l_quantity) AS xa, max(l_quantity) AS xb, min(l_extendedprice) AS ya, max(l_extendedprice) AS yb
           FROM lineitem)
SELECT CAST(least(floor((l_quantity - xa) / ((xb - xa) / 20.0)), 19) AS INTEGER) AS x_bin,
       CAST(least(floor((l_extendedprice - ya) / ((yb - ya) / 20.0)), 19) AS INTEGER) AS y_bin, count(*) AS count
FROM lineitem, e WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY ALL
""")
def q_scatter_bins(spark, d):
    return st.scatter_bins(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 20, 20)


@query("scatter_sample", f"""
SELECT l_orderkey, l_linenumber, {", ".join(LI_NUM)} FROM lineitem
ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber LIMIT 5000
""")
def q_scatter_sample(spark, d):
    # the scatter-matrix input: a 5,000-row deterministic sample (sampling is the feature)
    from tabprobe.sources.io import sample_n
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LI_NUM)
    return sample_n(li, 5000, ["l_orderkey", "l_linenumber"])
