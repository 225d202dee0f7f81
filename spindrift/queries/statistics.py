"""Queries of the matrix and statistics operators: order quantities by part group and line as counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..functions.pvalues import adjusted
from ..operators import learning as ml
from ..operators import statistics as o
from ..operators import tables as tab
from .tables import _describe, rounded

S = [f"s{i}" for i in range(1, 7)]
FIXTURES["counts"] = "SELECT 'g' || CAST(l_partkey % 300 AS STRING) AS gene, " + ", ".join(f"coalesce(sum(CASE WHEN l_linenumber = {i} THEN l_quantity END), 0) AS s{i}" for i in range(1, 7)) + " FROM lineitem GROUP BY l_partkey % 300"
_L = "(" + " UNION ALL ".join(f"SELECT gene AS \"row\", '{s}' AS \"column\", CAST({s} AS DOUBLE) AS value FROM counts" for s in S) + ")"
FIXTURES["edges"] = "SELECT o_custkey AS a, 100000000 + o_custkey % 97 AS b, o_totalprice AS w FROM orders"


def L(t):
    return o.long_matrix(t.counts, "gene", S)


A, B = S[:3], S[3:]
_IN = lambda g: "\"column\" IN (" + ", ".join(f"'{x}'" for x in g) + ")"
_CPM = f"(SELECT \"row\", \"column\", value * 1e6 / sum(value) OVER (PARTITION BY \"column\") AS value FROM {_L})"
_TWO = f"(SELECT \"row\", count(value) FILTER (WHERE {_IN(A)}) AS n, count(value) FILTER (WHERE {_IN(B)}) AS m, avg(value) FILTER (WHERE {_IN(A)}) AS ma, avg(value) FILTER (WHERE {_IN(B)}) AS mb, var_samp(value) FILTER (WHERE {_IN(A)}) AS va, var_samp(value) FILTER (WHERE {_IN(B)}) AS vb FROM {_L} GROUP BY 1)"

add("counts_summary", lambda t: rounded(L(t).groupBy("column").agg(F.sum("value").alias("size"), F.sum((F.col("value") > 0).cast("long")).alias("detected")), "size"), f"SELECT \"column\", round(sum(value), 4) AS size, count(*) FILTER (WHERE value > 0) AS detected FROM {_L} GROUP BY 1")
add("counts_cpm", lambda t: rounded(o.per_million(L(t)), "value"), f"SELECT \"row\", \"column\", round(value, 4) AS value FROM {_CPM}")
add("counts_tpm", lambda t: rounded(o.tpm(L(t), t.counts.select(F.col("gene").alias("row"), (F.length("gene") * 100 + 500).alias("length"))), "value"), f"SELECT \"row\", \"column\", round(r * 1e6 / sum(r) OVER (PARTITION BY \"column\"), 4) AS value FROM (SELECT \"row\", \"column\", value / (length(\"row\") * 100 + 500) * 1000 AS r FROM {_L})")
add("counts_quantile_normalize", lambda t: rounded(o.quantile_normalized(L(t)), "value", n=3), f"SELECT \"row\", \"column\", round(avg(value) OVER (PARTITION BY k), 3) AS value FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY value, \"row\") AS k FROM {_L})")
add("counts_zscore", lambda t: rounded(tab.scaled(t.counts, "gene", S, "rows"), "value"), f"SELECT \"row\", \"column\", round((value - avg(value) OVER (PARTITION BY \"row\")) / nullif(stddev_samp(value) OVER (PARTITION BY \"row\"), 0), 4) + 0.0 AS value FROM {_L}")
add("interactive_heatmap_viewer", lambda t: rounded(tab.scaled(t.counts, "gene", S, "columns"), "value"), f"SELECT \"row\", \"column\", round((value - avg(value) OVER (PARTITION BY \"column\")) / nullif(stddev_samp(value) OVER (PARTITION BY \"column\"), 0), 4) + 0.0 AS value FROM {_L}")
add("counts_log_transform", lambda t: L(t).select("row", "column", F.round(F.log2(F.col("value") + 1), 4).alias("value")), f"SELECT \"row\", \"column\", round(log2(value + 1), 4) AS value FROM {_L}")
add("counts_fold_change", lambda t: rounded(o.fold_change(L(t), A, B), "mean_a", "mean_b", "log2fc"), f"SELECT \"row\", round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(log2((mb + 1) / (ma + 1)), 4) + 0.0 AS log2fc FROM {_TWO}")
_COR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {{t}}" for i, a in enumerate(S) for b in S[i + 1 :])
add("counts_sample_correlation", lambda t: rounded(o.correlations(t.counts, S), "r", n=6), _COR.format(t="counts"))
add("counts_dedupe_merge", lambda t: t.counts.select("gene", ((F.col("s1") + F.col("s2")) / 2).alias("a"), ((F.col("s3") + F.col("s4")) / 2).alias("b")), "SELECT gene, (s1 + s2) / 2 AS a, (s3 + s4) / 2 AS b FROM counts")
add("counts_filter_low_expression", lambda t: t.counts.where(F.size(F.filter(F.array(*S), lambda x: x >= 10)) >= 3).select("gene"), "SELECT gene FROM counts WHERE len(list_filter([s1, s2, s3, s4, s5, s6], lambda x: x >= 10)) >= 3")
add("counts_tidy_long", L, f"SELECT * FROM {_L}")
add("counts_add_calc_column", lambda t: tab.row_math(t.counts, S, "sum").select("gene", "value"), "SELECT gene, s1 + s2 + s3 + s4 + s5 + s6 AS value FROM counts")
add("counts_feature_stats", lambda t: rounded(L(t).groupBy("row").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max("value").alias("high")), "mean", "sd"), f"SELECT \"row\", round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, max(value) AS high FROM {_L} GROUP BY 1")
_POOL = "((n - 1) * va + (m - 1) * vb) / (n + m - 2)"
_T = f"round((ma - mb) / nullif(sqrt({_POOL} * (1 / n + 1 / m)), 0), 4) + 0.0"
add("deseq_lite", lambda t: rounded(adjusted(o.t_test(o.two_groups(o.per_million(L(t)), A, B), welch=True), "p").select("row", "t"), "t"), f"SELECT \"row\", round((ma - mb) / nullif(sqrt(va / n + vb / m), 0), 4) + 0.0 AS t FROM {_TWO.replace(_L, _CPM)}")
_EVEN = "1 - sin(atan(abs({t}) / 2)) * (1 + pow(cos(atan(abs({t}) / 2)), 2) / 2)"  # both tails of Student's t at 4 degrees of freedom, and at 7
_ODD = "1 - 2 / pi() * ({a} + sin({a}) * (cos({a}) + 2.0 / 3 * pow(cos({a}), 3) + 8.0 / 15 * pow(cos({a}), 5)))"
_RAW_T = f"(ma - mb) / nullif(sqrt({_POOL} * (1 / n + 1 / m)), 0)"
add("stats_ttest", lambda t: rounded(o.t_test(o.two_groups(L(t), A, B)).select("row", "t", "df", "p"), "t", "p"), f"SELECT \"row\", {_T} AS t, CAST(n + m - 2 AS DOUBLE) AS df, round({_EVEN.format(t=f'({_RAW_T})')}, 4) + 0.0 AS p FROM {_TWO}")
add("limma_moderated_t", lambda t: rounded(o.moderated_t(o.two_groups(L(t), A, B)).select("row", "t", "p"), "t", "p"), f"SELECT \"row\", round(x, 4) + 0.0 AS t, round({_ODD.format(a='atan(abs(x) / sqrt(7))')}, 4) + 0.0 AS p FROM (SELECT \"row\", (ma - mb) / nullif(sqrt(((n + m - 2) * p + 3 * avg(p) OVER ()) / (n + m + 1) * (1 / n + 1 / m)), 0) AS x FROM (SELECT *, {_POOL} AS p FROM {_TWO}))")
add("volcano_plot", lambda t: rounded(o.fold_change(L(t), A, B).select("row", "log2fc"), "log2fc"), f"SELECT \"row\", round(log2((mb + 1) / (ma + 1)), 4) + 0.0 AS log2fc FROM {_TWO}")
add("ma_plot", lambda t: rounded(o.fold_change(L(t), A, B).select("row", F.log2((F.col("mean_a") + F.col("mean_b")) / 2 + 1).alias("a"), F.col("log2fc").alias("m")), "a", "m"), f"SELECT \"row\", round(log2((ma + mb) / 2 + 1), 4) AS a, round(log2((mb + 1) / (ma + 1)), 4) + 0.0 AS m FROM {_TWO}")
add("gene_set_counts", lambda t: rounded(L(t).groupBy(F.length("row").cast("long").alias("set"), "column").agg(F.avg("value").alias("score")), "score"), f"SELECT length(\"row\") AS set, \"column\", round(avg(value), 4) AS score FROM {_L} GROUP BY 1, 2")
_MW = f"WITH v AS (SELECT \"row\", \"column\", value FROM {_L}), r AS (SELECT *, avg(k) OVER (PARTITION BY \"row\", value) AS rank, count(*) OVER (PARTITION BY \"row\", value) AS ties FROM (SELECT *, row_number() OVER (PARTITION BY \"row\" ORDER BY value) AS k FROM v)) SELECT \"row\", round(u, 4) AS u, round((u - 4.5) / nullif(sqrt(9 / 12 * (7 - t / 30)), 0), 4) + 0.0 AS z FROM (SELECT \"row\", sum(rank) FILTER (WHERE {_IN(A)}) - 6 AS u, sum(ties * ties - 1) AS t FROM r GROUP BY 1)"
for _name in ("stats_rank_tests", "presto_wilcoxon_markers", "seurat_marker_genes"):
    add(_name, lambda t: rounded(o.rank_sum(L(t), A, B).select("row", "u", "z"), "u", "z"), _MW)
add("seurat_normalise", lambda t: rounded(o.per_million(L(t)).select("row", "column", F.log1p(F.col("value") / 100).alias("value")), "value"), f"SELECT \"row\", \"column\", round(ln(value / 100 + 1), 4) AS value FROM {_CPM}")
add("seurat_qc_metrics", lambda t: rounded(L(t).groupBy("column").agg(F.sum("value").alias("counts"), F.sum((F.col("value") > 0).cast("long")).alias("genes"), (100 * F.sum(F.when(F.col("row").startswith("g1"), F.col("value")).otherwise(0)) / F.sum("value")).alias("marked")), "counts", "marked"), f"SELECT \"column\", round(sum(value), 4) AS counts, count(*) FILTER (WHERE value > 0) AS genes, round(100 * sum(CASE WHEN prefix(\"row\", 'g1') THEN value ELSE 0 END) / sum(value), 4) AS marked FROM {_L} GROUP BY 1")
add("multiomics_merge_tables", lambda t: tab.join_tables(t.customer.select("c_custkey", "c_acctbal"), t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "c_custkey", "o_custkey", "left").select("c_custkey", "c_acctbal", "n"), "SELECT c_custkey, c_acctbal, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
_describe("stats_describe_columns", "lineitem", ["l_quantity", "l_discount", "l_tax"], ["count", "mean", "median", "stdev", "min", "max", "q1", "q3"], 4)
add("stats_group_summary", lambda t: rounded(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*"))).alias("sem")), "mean", "sd", "sem"), "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem FROM orders GROUP BY 1")
add("stats_correlation_matrix", lambda t: rounded(o.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "r", n=6), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]))
_RANK = lambda c: f"avg({c}_k) OVER (PARTITION BY {c})"
add("stats_correlation_pair", lambda t: rounded(o.correlation(t.lineitem, "l_quantity", "l_extendedprice", "spearman").select("n", "r"), "r", n=6), f"SELECT count(*) AS n, round(corr(a, b), 6) AS r FROM (SELECT {_RANK('l_quantity')} AS a, {_RANK('l_extendedprice')} AS b FROM (SELECT l_quantity, l_extendedprice, row_number() OVER (ORDER BY l_quantity) AS l_quantity_k, row_number() OVER (ORDER BY l_extendedprice) AS l_extendedprice_k FROM lineitem))")
add("stats_regression", lambda t: rounded(o.regression(t.lineitem, "l_quantity", "l_extendedprice"), "slope", "intercept", "r2"), "SELECT regr_count(l_extendedprice, l_quantity) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem")
add("stats_contingency", lambda t: rounded(o.contingency(t.orders, "o_orderstatus", "o_orderpriority").select("n", "chi2", "g", "df", "p"), "chi2", "g", "p"), "SELECT n, round(chi2, 4) AS chi2, g, df, round(exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6), 4) AS p FROM (WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS k FROM orders GROUP BY 1, 2), m AS (SELECT *, sum(k) OVER (PARTITION BY r) * sum(k) OVER (PARTITION BY c) / sum(k) OVER () AS e FROM c) SELECT CAST(sum(k) AS BIGINT) AS n, sum(pow(k - e, 2) / e) + sum(k) - sum(e) AS chi2, round(sum(2 * k * ln(k / e)), 4) AS g, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS DOUBLE) AS df FROM m)")
add("stats_anova", lambda t: rounded(o.anova(t.orders, "o_orderpriority", "o_totalprice").select("n", "k", "f", "p"), "f", "p"), "SELECT n, k, round(f, 4) AS f, round(pow((n - 5) / (n - 5 + 4 * f), (n - 5) / 2) * (1 + (n - 5) / 2 * (1 - (n - 5) / (n - 5 + 4 * f))), 4) AS p FROM (WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS w FROM orders GROUP BY 1), f AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(w) AS w FROM g) SELECT CAST(f.n AS BIGINT) AS n, k, (SELECT sum(n * pow(m - f.mean, 2)) FROM g) / (k - 1) / (w / (f.n - k)) AS f FROM f)")
add("stats_p_adjust_table", lambda t: rounded(adjusted(t.orders.select("o_orderkey", (F.col("o_totalprice") / 1e6).alias("p")), "p"), "q", n=6).select("o_orderkey", "q"), "SELECT o_orderkey, round(least(1, min(v) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS v FROM (SELECT o_orderkey, o_totalprice / 1e6 AS p FROM orders))")
add("stats_normality", lambda t: rounded(o.moments(t.lineitem, ["l_quantity", "l_extendedprice"]).select("column", "n", "skewness", "kurtosis"), "skewness", "kurtosis", n=6), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, round(avg(pow(z, 3)), 6) + 0.0 AS skewness, round(avg(pow(z, 4)) - 3, 6) + 0.0 AS kurtosis FROM (SELECT ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z FROM lineitem)" for c in ("l_quantity", "l_extendedprice")))
add("stats_distribution_plot", lambda t: rounded(tab.histogram(t.customer, "c_acctbal", 25), "low", "high", n=2), "WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), c AS (SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 25)), 24) AS BIGINT) AS bin, count(*) AS n FROM customer, e GROUP BY 1) SELECT r.bin, round(lo + r.bin * ((hi - lo) / 25), 2) AS low, round(lo + (r.bin + 1) * ((hi - lo) / 25), 2) AS high, coalesce(n, 0) AS n FROM e, (SELECT unnest(range(0, 25)) AS bin) r LEFT JOIN c ON c.bin = r.bin")
add("stats_two_sample_ks", lambda t: rounded(o.two_sample_ks(t.orders, "o_totalprice", F.col("o_orderstatus") == "F"), "d", n=6), "WITH v AS (SELECT o_totalprice AS v, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus <> 'F') AS b FROM orders GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY v) AS fa, sum(b) OVER (ORDER BY v) AS fb, sum(a) OVER () AS n, sum(b) OVER () AS m FROM v) SELECT CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS m, round(max(abs(fa / n - fb / m)), 6) AS d FROM c")
add("stats_outlier_detection", lambda t: tab.outliers(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "z-score", 1.5), "SELECT c_custkey, c_acctbal FROM (SELECT *, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z FROM customer) WHERE abs(z) > 1.5")
_RN = "WITH v AS (SELECT l_extendedprice AS v, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag <> 'R') AS f FROM lineitem GROUP BY 1), c AS (SELECT *, sum(p) OVER w AS tp, sum(f) OVER w AS fp, sum(p) OVER () AS ap, sum(f) OVER () AS af FROM v WINDOW w AS (ORDER BY v DESC)) "
add("stats_auc_roc", lambda t: rounded(o.auc(t.lineitem, "l_extendedprice", F.col("l_returnflag") == "R"), "auc", n=6), _RN + "SELECT round(sum(p * (af - fp + f / 2)) / (max(ap) * max(af)), 6) AS auc FROM c")
_MI = "SELECT '{c}' AS \"column\", round(sum(k / n * ln(k * n / (r * q))), 6) AS mi FROM (SELECT k, sum(k) OVER () AS n, sum(k) OVER (PARTITION BY t) AS r, sum(k) OVER (PARTITION BY v) AS q FROM (SELECT t, v, count(*) AS k FROM (SELECT least(9, floor((l_extendedprice - lo) / ((hi - lo) / 10))) AS t, least(9, floor(({c} - l2) / ((h2 - l2) / 10))) AS v FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min({c}) AS l2, max({c}) AS h2 FROM lineitem)) GROUP BY 1, 2))"
add("stats_mutual_information", lambda t: rounded(o.mutual_information(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice"), "mi", n=6), " UNION ALL ".join(_MI.format(c=c) for c in ("l_quantity", "l_discount")))
add("stats_time_series_trend", lambda t: rounded(o.regression(t.events, "event_id", "value"), "slope", "intercept", "r2", n=6), "SELECT regr_count(value, event_id) AS n, round(regr_slope(value, event_id), 6) + 0.0 AS slope, round(regr_intercept(value, event_id), 6) AS intercept, round(regr_r2(value, event_id), 6) AS r2 FROM events")
add("stats_summary_of_bedgraph", lambda t: rounded(t.track.agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("bases"), (F.sum(F.col("value") * (F.col("stop") - F.col("start"))) / F.sum(F.col("stop") - F.col("start"))).alias("mean")), "mean"), "SELECT count(*) AS n, CAST(sum(stop - start) AS BIGINT) AS bases, round(sum(value * (stop - start)) / sum(stop - start), 4) AS mean FROM track")
add("network_from_edge_list", lambda t: rounded(o.degrees(t.edges, "a", "b", "w"), "strength", n=2), "WITH e AS (SELECT a AS x, b AS y, w FROM edges UNION ALL SELECT b, a, w FROM edges), p AS (SELECT x, y, sum(w) AS w FROM e WHERE x <> y GROUP BY 1, 2) SELECT x AS node, count(*) AS degree, round(sum(w), 2) AS strength FROM p GROUP BY 1")
add("network_flow_table", lambda t: rounded(o.transitions(t.orders, "o_orderstatus", "o_orderpriority"), "percent"), "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 4) AS percent FROM orders GROUP BY 1, 2")
add("network_venn", lambda t: tab.overlap(t.customer, t.orders, "c_custkey", "o_custkey"), "SELECT *, shared / greatest(n_a + n_b - shared, 1) AS jaccard FROM (SELECT count(a) AS n_a, count(b) AS n_b, count(*) FILTER (WHERE a = b) AS shared, count(*) FILTER (WHERE b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL) AS only_b FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS b FROM orders) ON a = b)")
_UP = "SELECT CAST(m AS BIGINT) AS combination, count(*) AS n FROM (SELECT l_partkey, max(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END) + max(CASE l_returnflag WHEN 'N' THEN 2 ELSE 0 END) + max(CASE l_returnflag WHEN 'R' THEN 4 ELSE 0 END) AS m FROM lineitem GROUP BY 1) GROUP BY 1"
for _name in ("network_upset_plot", "multiomics_set_overlap"):
    add(_name, lambda t: o.set_combinations(t.lineitem, "l_partkey", "l_returnflag", ["A", "N", "R"]), _UP)
add("interactive_pivot_table", lambda t: rounded(tab.cross_tab(t.lineitem, "l_linestatus", "l_returnflag", ["A", "N", "R"], "l_quantity"), "l_returnflag_A", "l_returnflag_N", "l_returnflag_R"), "SELECT l_linestatus, " + ", ".join(f"round(avg(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 4) AS l_returnflag_{f}" for f in "ANR") + " FROM lineitem GROUP BY 1")
add("interactive_scatter_explorer", lambda t: t.part.select("p_size", "p_retailprice", "p_brand"), "SELECT p_size, p_retailprice, p_brand FROM part")
add("ml_kmeans", lambda t: ml.kmeans(t.embeddings, "vec_id", "embedding", 3))
add("ml_gmm_bic", lambda t: ml.mixture(t.part.select("p_partkey", F.array("p_size", "p_retailprice").alias("v")), "p_partkey", "v", 2))
add("ml_pca", lambda t: ml.pca(t.embeddings, "vec_id", "embedding", 2))
add("counts_pca_samples", lambda t: ml.pca(t.counts.select("gene", F.array(*S).alias("v")), "gene", "v", 2))
_MAD = lambda c: f"0.6745 * abs({c} - m_{c}) / nullif(d_{c}, 0)"
add("ml_anomaly_detection", lambda t: rounded(ml.anomalies(t.part, "p_partkey", ["p_size", "p_retailprice"]), "score"), f"WITH m AS (SELECT quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS m_p_size, quantile_cont(p_retailprice, 0.5) AS m_p_retailprice FROM part), d AS (SELECT quantile_cont(abs(p_size - m_p_size), 0.5) AS d_p_size, quantile_cont(abs(p_retailprice - m_p_retailprice), 0.5) AS d_p_retailprice FROM part, m) SELECT p_partkey, round(s, 4) AS score, s > 3 AS anomaly FROM (SELECT p_partkey, greatest({_MAD('p_size')}, {_MAD('p_retailprice')}) AS s FROM part, m, d)")
add("ml_split_and_encode", lambda t: ml.split(t.part.select("p_partkey"), "p_partkey"))
