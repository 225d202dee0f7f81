"""Queries of the table and line operators, on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import FIXTURES
from ..catalog import register as add
from ..operators import tables as o

FIXTURES["lines"] = "SELECT o_orderkey AS ln, o_orderpriority || ' ' || o_orderstatus || ' ' || CAST(o_custkey AS STRING) AS line FROM orders"
FIXTURES["cells"] = "SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS STRING) AS nation, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_acctbal AS STRING) END AS balance, CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE CAST(c_custkey * 2 AS STRING) END AS twice FROM customer"
FIXTURES["sparse"] = "SELECT p_partkey AS id, p_size AS a, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END AS b, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS c FROM part"
FIXTURES["short_words"] = "SELECT DISTINCT p_brand AS word FROM part UNION SELECT DISTINCT c_mktsegment AS word FROM customer"
FIXTURES["longer_words"] = "SELECT DISTINCT substr(p_brand, 1, 6) || 'x' AS word FROM part UNION SELECT DISTINCT c_mktsegment || 'y' AS word FROM customer"


def rounded(df: DataFrame, *columns: str, n: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c in columns})  # no negative zero


FLAGS, LINES = ["A", "N", "R"], list(range(1, 8))

add("text_cut_columns", lambda t: o.cut_columns(t.orders, "1,3-4,O_ORDERPRIORITY"), "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
add("text_paste_columns", lambda t: o.paste(t.nation.select("n_nationkey", "n_name"), t.region.select("r_regionkey", "r_name"), ["n_nationkey"], ["r_regionkey"]),
    "SELECT coalesce(a.ln, b.ln) AS ln, n_nationkey, n_name, r_regionkey AS other_r_regionkey, r_name AS other_r_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS ln, n_nationkey, n_name FROM nation) a FULL JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) AS ln, r_regionkey, r_name FROM region) b ON a.ln = b.ln")
add("text_join_files", lambda t: o.join_tables(t.orders, t.customer, "o_custkey", "c_custkey", "full").select("o_orderkey", "c_name", "c_acctbal"),
    "SELECT o_orderkey, c_name, c_acctbal FROM orders FULL JOIN customer ON o_custkey = c_custkey")
_at = lambda c, i: f"substr(rpad(substr(lower({c}), 1, 8), 8, chr(1)), {i}, 1)"
_differ = " + ".join(f"CAST({_at('a.word', i)} <> {_at('b.word', i)} AS INT)" for i in range(1, 9))
add("text_join_with_loose_cutoff", lambda t: o.loose_join(t.short_words, t.longer_words, "word", "word"),
    f"SELECT left_key, right_key, distance FROM (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY distance, right_key) AS n FROM (SELECT a.word AS left_key, b.word AS right_key, {_differ} + abs(length(a.word) - length(b.word)) AS distance FROM short_words a, longer_words b) WHERE distance <= 2) WHERE n = 1")
add("text_replace", lambda t: o.replace_text(t.part.select("p_partkey", "p_name"), "p_name", "[aeiou]+", "_"),
    "SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS p_name, CAST(len(regexp_extract_all(p_name, '[aeiou]+')) AS BIGINT) AS hits FROM part")
add("text_change_case", lambda t: o.change_case(t.lines, "line", "swap"), "SELECT ln, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ') AS line FROM lines")
add("text_concatenate", lambda t: o.concatenate(t.nation, t.region), "SELECT n_nationkey, n_name, n_regionkey, NULL AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")
add("text_head", lambda t: o.head(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
add("text_tail", lambda t: o.tail(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
add("text_insert_lines", lambda t: o.insert_lines(t.lines, "ln", "line", 5, "## separator"), "SELECT ln, 1 AS part, line FROM lines UNION ALL SELECT ln, 0, '## separator' FROM lines WHERE ln % 5 = 0")
add("text_wrap", lambda t: o.wrap(t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text", 60),
    "SELECT doc_id, CAST(i AS INT) AS piece, substr(text, i * 60 + 1, 60) AS line FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(0, greatest(1, CAST(ceil(length(coalesce(text, '')) / 60) AS BIGINT)))) AS i FROM documents)")
add("text_word_counter", lambda t: o.word_counts(t.documents, "text"),
    r"SELECT CAST(sum(len(l)) AS BIGINT) AS n_lines, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+'))) AS BIGINT) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(list_filter(l, lambda x: trim(x) = ''))) AS BIGINT) AS n_blank FROM (SELECT coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")
add("text_grep", lambda t: o.grep(t.lines, "line", "urgent o"), "SELECT ln, line FROM lines WHERE regexp_matches(line, '(?i)urgent o')")
add("text_tr", lambda t: o.tr(t.part.select("p_partkey", "p_name"), "p_name", "abc", "xyz"), "SELECT p_partkey, translate(p_name, 'abc', 'xyz') AS p_name FROM part")
add("text_sort", lambda t: o.ranked_lines(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderpriority", "o_orderkey"]), "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS position FROM orders")
add("text_uniq", lambda t: o.uniq(t.orders, "o_orderpriority", "o_orderkey"), "SELECT o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
add("text_random_lines", lambda t: o.sample(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], fraction=0.3))
add("text_subtract", lambda t: o.subtract(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]), "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
_SETS = "(SELECT coalesce(a.v, b.v) AS value, a.v IS NOT NULL AS in_a, b.v IS NOT NULL AS in_b FROM (SELECT DISTINCT c_custkey AS v FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderstatus = 'F') b ON a.v = b.v)"
_late = lambda t: t.orders.where("o_orderstatus = 'F'")
_OVERLAP = f"SELECT *, shared / greatest(n_a + n_b - shared, 1) AS jaccard FROM (SELECT count(*) FILTER (WHERE in_a) AS n_a, count(*) FILTER (WHERE in_b) AS n_b, count(*) FILTER (WHERE in_a AND in_b) AS shared, count(*) FILTER (WHERE in_a AND NOT in_b) AS only_a, count(*) FILTER (WHERE in_b AND NOT in_a) AS only_b FROM {_SETS})"
add("text_compare_two_files", lambda t: o.overlap(t.customer, _late(t), "c_custkey", "o_custkey"), _OVERLAP)
add("text_split_on_column", lambda t: o.split_on_column(t.orders.withColumn("line", o.as_lines(t.orders, ["o_orderkey", "o_orderpriority"])), "o_orderstatus", "o_orderkey", "line"),
    "SELECT o_orderstatus, count(*) AS n, arg_min(CAST(o_orderkey AS VARCHAR) || chr(9) || o_orderpriority, o_orderkey) AS first_line FROM orders GROUP BY 1")
add("text_column_formatter", lambda t: o.padded(t.nation.select("n_nationkey", "n_name"), ["n_name"], 8), "SELECT n_nationkey, rpad(n_name, 8, ' ') AS n_name FROM nation")
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM cells" for c in ("name", "nation", "balance", "twice"))
add("text_find_most_dispensable_column", lambda t: rounded(o.column_profile(t.cells, ["name", "nation", "balance", "twice"]), "modal_fraction"),
    f"SELECT \"column\", CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) FILTER (WHERE value IS NULL OR trim(value) = '') AS BIGINT) AS n_empty, CAST(coalesce(sum(n) FILTER (WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL), 0) AS BIGINT) AS n_numeric, count(value) AS distinct_values, round(max(n) / sum(n), 4) AS modal_fraction FROM (SELECT \"column\", value, count(*) AS n FROM ({_PROFILE}) GROUP BY ALL) GROUP BY 1".replace("CAST(sum(n) FILTER (WHERE value IS NULL OR trim(value) = '') AS BIGINT)", "CAST(coalesce(sum(n) FILTER (WHERE value IS NULL OR trim(value) = ''), 0) AS BIGINT)"))
add("text_extract_with_regex", lambda t: o.extract_matches(t.part, "p_partkey", "p_name", "[a-z]+"), "SELECT p_partkey, unnest(range(1, len(m) + 1)) AS nth, unnest(m) AS found FROM (SELECT p_partkey, regexp_extract_all(p_name, '[a-z]+') AS m FROM part)")
add("text_histogram_of_column", lambda t: rounded(o.histogram(t.orders, "o_totalprice", 20), "low", "high", n=2),
    "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1) SELECT r.bin, round(lo + r.bin * ((hi - lo) / 20), 2) AS low, round(lo + (r.bin + 1) * ((hi - lo) / 20), 2) AS high, coalesce(n, 0) AS n FROM e, (SELECT unnest(range(0, 20)) AS bin) r LEFT JOIN c ON c.bin = r.bin")
add("filter_first_n", lambda t: o.head(t.part.select("p_partkey", "p_name"), ["p_partkey"], 5), "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5")
add("filter_by_ids", lambda t: o.by_ids(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_acctbal < 0"), "o_custkey", "c_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
add("filter_last_column", lambda t: o.compare(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", ">", 1000.0), "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 1000.0")
add("filter_with_regexp", lambda t: o.grep(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", "^(AUTO|BUILD)", ignore_case=False), "SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '^(AUTO|BUILD)')")
add("filter_non_numeric_rows", lambda t: o.numeric_rows(t.cells, ["nation", "balance", "twice"], 60).select("id"),
    "SELECT id FROM cells WHERE (CAST(TRY_CAST(nation AS DOUBLE) IS NOT NULL AS INT) + CAST(TRY_CAST(balance AS DOUBLE) IS NOT NULL AS INT) + CAST(TRY_CAST(twice AS DOUBLE) IS NOT NULL AS INT)) * 100.0 / 3 >= 60")
add("sort_table_column", lambda t: o.ranked_lines(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"]), "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders")
add("shuffle_table_rows", lambda t: o.shuffled(t.orders.select("o_orderkey"), ["o_orderkey"], 42))
add("sample_rows", lambda t: o.every_nth(t.orders.select("o_orderkey"), ["o_orderkey"], 10), "SELECT o_orderkey, ln FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ln FROM orders) WHERE (ln - 1) % 10 = 0")
add("remove_duplicate_rows", lambda t: o.first_of(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]),
    "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")

_DUCK = {
    "count": "count({c})", "sum": "sum({c})", "mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "min": "min({c})", "max": "max({c})", "range": "max({c}) - min({c})", "stdev": "coalesce(stddev_samp({c}), 0)",
    "variance": "coalesce(var_samp({c}), 0)", "cv": "100 * stddev_samp({c}) / avg({c})", "sem": "stddev_samp({c}) / sqrt(count({c}))", "q1": "quantile_cont({c}, 0.25)", "q3": "quantile_cont({c}, 0.75)",
    "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "p5": "quantile_cont({c}, 0.05)", "p95": "quantile_cont({c}, 0.95)", "distinct": "count(DISTINCT {c})", "rms": "sqrt(avg({c} * {c}))", "geomean": "exp(avg(ln({c})))",
}


def _stats(functions: list[str], column: str, n: int = 2) -> str:
    return ", ".join((_DUCK[f].format(c=column) if f in ("count", "distinct") else f"round({_DUCK[f].format(c=column)}, {n})") + f" AS {f}" for f in functions)


def _describe(name: str, table: str, columns: list[str], functions: list[str], n: int = 2) -> None:
    whole = [f for f in functions if f not in ("count", "distinct")]
    add(name, lambda t: rounded(o.describe(getattr(t, table), columns, functions), *whole, n=n), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_stats(functions, f'CAST({c} AS DOUBLE)', n)} FROM {table}" for c in columns))


_describe("first_and_last_column_stats", "orders", ["o_orderkey", "o_totalprice"], ["count", "mean", "stdev", "median", "min", "max"])
_describe("datamash_column_stats", "lineitem", ["l_quantity", "l_extendedprice"], ["count", "sum", "mean", "median", "min", "max", "stdev", "variance", "q1", "q3", "iqr", "distinct", "rms", "geomean", "cv"])
_describe("datamash_summary_all", "part", ["p_size", "p_retailprice"], ["count", "sum", "mean", "median", "min", "max", "range", "stdev", "variance", "cv", "sem", "q1", "q3", "p5", "p95"])
add("filter_missing_values", lambda t: o.without_missing(t.sparse, ["a", "b", "c"]), "SELECT id, a, b, c FROM sparse WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
add("filter_top_n_by_column", lambda t: o.head(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("group_by_column", lambda t: rounded(o.group_summary(t.supplier, "s_nationkey", ["s_acctbal"], "s_name"), "mean_s_acctbal"),
    "SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 4) AS mean_s_acctbal, string_agg(s_name, ',' ORDER BY s_name) AS members FROM supplier GROUP BY 1")
add("aggregate_group", lambda t: rounded(o.grouped(t.orders, "o_orderpriority", ["o_totalprice"], "median"), "median_o_totalprice"), "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median_o_totalprice FROM orders GROUP BY 1")
add("subtract_tables", lambda t: o.subtract(t.part.select("p_partkey", "p_brand"), t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"]), "SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
add("set_operations_on_columns", lambda t: o.set_operation(t.customer, _late(t), "c_custkey", "o_custkey", "symmetric"), f"SELECT value FROM {_SETS} WHERE in_a <> in_b")
add("jaccard_between_tables", lambda t: o.overlap(t.customer, _late(t), "c_custkey", "o_custkey").select("jaccard"), f"SELECT jaccard FROM ({_OVERLAP})")
add("transpose_table", lambda t: rounded(o.transposed(o.grouped(t.lineitem, "l_returnflag", ["l_quantity", "l_discount", "l_tax"], "mean"), "l_returnflag", ["mean_l_quantity", "mean_l_discount", "mean_l_tax"], FLAGS), *FLAGS),
    " UNION ALL ".join(f"SELECT 'mean_{c}' AS \"column\", " + ", ".join(f"round(avg({c}) FILTER (WHERE l_returnflag = '{f}'), 4) AS \"{f}\"" for f in FLAGS) + " FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
add("reverse_rows", lambda t: o.ranked_lines(t.part.select("p_partkey"), [F.desc("p_partkey")]), "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) AS position FROM part")
add("datamash_grouped", lambda t: rounded(o.grouped(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice"], "mean"), "mean_l_quantity", "mean_l_extendedprice"),
    "SELECT l_returnflag, round(avg(l_quantity), 4) AS mean_l_quantity, round(avg(l_extendedprice), 4) AS mean_l_extendedprice FROM lineitem GROUP BY 1")
add("datamash_percentiles", lambda t: rounded(o.percentiles(t.orders, "o_totalprice", [5, 25, 50, 75, 95]), "value"), " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont(o_totalprice, {p / 100}), 4) AS value FROM orders" for p in (5, 25, 50, 75, 95)))
add("datamash_cross_tab", lambda t: o.cross_tab(t.lineitem, "l_linestatus", "l_returnflag", FLAGS), "SELECT l_linestatus, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{f}') AS l_returnflag_{f}" for f in FLAGS) + " FROM lineitem GROUP BY 1")
_QUANT = "SELECT l_returnflag AS flag, " + ", ".join(f"sum(CASE WHEN l_linenumber = {n} THEN l_quantity END) AS n{n}" for n in LINES) + " FROM lineitem GROUP BY l_returnflag"
FIXTURES["flag_matrix"] = _QUANT
_LONG = "(" + " UNION ALL ".join(f"SELECT flag AS \"row\", 'n{n}' AS \"column\", n{n} AS value FROM flag_matrix" for n in LINES) + ")"
_NS = [f"n{n}" for n in LINES]
add("datamash_matrix_summary", lambda t: rounded(o.totals(t.flag_matrix, "flag", _NS), "value"), f"SELECT 'row' AS axis, \"row\" AS name, round(sum(value), 4) AS value FROM {_LONG} GROUP BY 2 UNION ALL SELECT 'column', \"column\", round(sum(value), 4) FROM {_LONG} GROUP BY 2")
add("datamash_normalize_column", lambda t: rounded(o.normalized(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "z-score"), "normalized"), "SELECT o_orderkey, o_totalprice, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER (), 4) AS normalized FROM orders")
add("datamash_cumulative", lambda t: rounded(o.cumulative(t.events.select("event_id", "value"), ["event_id"], "value"), "cumulative", n=2), "SELECT event_id, value, round(sum(value) OVER (ORDER BY event_id), 2) AS cumulative FROM events")
add("datamash_bin_column", lambda t: o.binned(t.lineitem, "l_extendedprice", 5000.0, "l_quantity"), "SELECT floor(l_extendedprice / 5000.0) * 5000.0 AS bin, count(l_quantity) AS value FROM lineitem GROUP BY 1")
add("datamash_outliers", lambda t: o.outliers(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "iqr", 0.4),
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM orders) SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice < lo - 0.4 * (hi - lo) OR o_totalprice > hi + 0.4 * (hi - lo)")
add("datamash_unique_values", lambda t: rounded(o.value_counts(t.orders, "o_orderpriority"), "percent"), "SELECT o_orderpriority AS value, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM orders), 4) AS percent FROM orders GROUP BY 1")
add("row_math", lambda t: o.row_math(t.sparse, ["a", "b", "c"], "mean").select("id", F.round("value", 4).alias("value")),
    "SELECT id, round((a + coalesce(b, 0) + coalesce(c, 0)) / (1 + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT)), 4) AS value FROM sparse")
add("scale_matrix", lambda t: rounded(o.scaled(t.flag_matrix, "flag", _NS), "value"), f"SELECT \"row\", \"column\", round((value - avg(value) OVER (PARTITION BY \"row\")) / stddev_samp(value) OVER (PARTITION BY \"row\"), 4) AS value FROM {_LONG}")
add("apply_function_to_rows", lambda t: o.row_math(t.sparse, ["a", "b", "c"], "median").select("id", F.round("value", 4).alias("value")), "SELECT id, round(list_median(list_filter([a, b, c], lambda x: x IS NOT NULL)), 4) AS value FROM sparse")
add("missing_value_imputation", lambda t: rounded(o.imputed(t.sparse, ["b", "c"]), "b", "c"), "SELECT id, a, round(coalesce(b, avg(b) OVER ()), 4) AS b, round(coalesce(c, avg(c) OVER ()), 4) AS c FROM sparse")
add("column_arithmetic_pairwise", lambda t: o.pairwise(t.lineitem, "l_extendedprice", "l_quantity", "divide").select("l_orderkey", "l_linenumber", "value"), "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS value FROM lineitem")
add("collection_list_from_column", lambda t: o.distinct_in_order(t.orders, "o_orderpriority", "o_orderkey"), "SELECT row_number() OVER (ORDER BY f, value) AS index, value FROM (SELECT o_orderpriority AS value, min(o_orderkey) AS f FROM orders GROUP BY 1)")
add("collection_filter_elements", lambda t: o.grep(t.part.select("p_partkey", "p_name"), "p_name", "^[a-m]", ignore_case=False), "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m]')")
add("collection_rename_elements", lambda t: o.renamed_values(t.nation, "n_name", "x_", "_y", "A"), "SELECT DISTINCT n_name AS old, 'x_' || replace(n_name, 'A', '') || '_y' AS new FROM nation")
add("collection_extract_by_index", lambda t: o.ordinal(t.nation.select("n_name"), ["n_name"]).where(F.col("ln").isin(1, 3, 25)), "SELECT * FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS ln FROM nation) WHERE ln IN (1, 3, 25)")
add("collection_sort_elements", lambda t: o.ranked_lines(t.nation.select("n_name"), [F.length("n_name"), "n_name"]), "SELECT n_name, row_number() OVER (ORDER BY length(n_name), n_name) AS position FROM nation")
add("collection_zip_pairs", lambda t: o.paste(t.nation.select("n_name"), t.region.select("r_name"), ["n_name"], ["r_name"]).where("n_name is not null and other_r_name is not null"),
    "SELECT a.ln, n_name, r_name AS other_r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS ln FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_name) AS ln FROM region) b ON a.ln = b.ln")
add("collection_unzip", lambda t: o.cut_columns(t.nation, ["n_nationkey", "n_name"]), "SELECT n_nationkey, n_name FROM nation")
add("collection_count_elements", lambda t: t.lines.select("ln", F.size(F.split("line", " ")).cast("long").alias("fields"), F.length("line").cast("long").alias("chars")), "SELECT ln, CAST(len(string_split(line, ' ')) AS BIGINT) AS fields, length(line) AS chars FROM lines")
add("collection_merge", lambda t: o.set_operation(t.customer, _late(t), "c_custkey", "o_custkey", "union"), f"SELECT value FROM {_SETS}")
add("collection_group_by_label", lambda t: rounded(o.group_summary(t.nation, "n_regionkey", [], "n_name")), "SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation GROUP BY 1")
add("get_data_extract_column", lambda t: o.cut_columns(t.customer, "2"), "SELECT c_name FROM customer")
add("get_data_concatenate_history", lambda t: o.concatenate(o.concatenate(t.customer.select(F.col("c_name").alias("name")), t.supplier.select(F.col("s_name").alias("name"))), t.nation.select(F.col("n_name").alias("name"))), "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation")
add("send_data_paste_to_column", lambda t: o.cut_columns(t.supplier, "s_name"), "SELECT s_name FROM supplier")
add("send_data_download_table", lambda t: t.nation.select(o.as_lines(t.nation, t.nation.columns, ",").alias("line")), "SELECT CAST(n_nationkey AS VARCHAR) || ',' || n_name || ',' || CAST(n_regionkey AS VARCHAR) AS line FROM nation")
add("send_data_summary_report", lambda t: o.word_counts(t.lines, "line").select("n_lines", "n_chars"), "SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines")
add("text_line_numbers", lambda t: o.ordinal(t.lines, ["ln"], "nth").select(F.concat_ws("\t", F.col("nth").cast("string"), "line").alias("line")), "SELECT CAST(row_number() OVER (ORDER BY ln) AS VARCHAR) || chr(9) || line AS line FROM lines")
add("text_diff_two_sorted", lambda t: o.membership(t.customer, _late(t), "c_custkey", "o_custkey"), f"SELECT value, in_a, in_b FROM {_SETS}")
add("text_column_summarizer", lambda t: o.column_profile(t.cells, ["balance", "twice"]).select("column", "n", "n_empty", "n_numeric"),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '') AS n_empty, count(TRY_CAST({c} AS DOUBLE)) AS n_numeric FROM cells" for c in ("balance", "twice")))
add("text_filter_by_row_count", lambda t: o.first_rows(t.lines, ["ln"], 0.5).select("line"), "SELECT line FROM (SELECT line, row_number() OVER (ORDER BY ln) AS k, count(*) OVER () AS n FROM lines) WHERE k <= floor(n * 0.5)")
add("text_top_scores", lambda t: o.ordinal(t.part.select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], "rank"), "SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
add("text_extract_column_by_name", lambda t: o.cut_columns(t.part, ["P_BRAND", "p_size"]), "SELECT p_brand, p_size FROM part")
add("text_add_row_index", lambda t: o.ordinal(t.supplier.select("s_suppkey"), ["s_suppkey"], "row", 0), "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS row FROM supplier")
add("text_rename_by_pattern", lambda t: o.replace_text(t.supplier.select("s_suppkey", "s_name"), "s_name", "^Supplier#0*", "S").select("s_suppkey", "s_name"), "SELECT s_suppkey, regexp_replace(s_name, '^Supplier#0*', 'S', 'g') AS s_name FROM supplier")
