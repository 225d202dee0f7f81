"""Operators on delimited tables and lines: projection, filters, sorts, joins, set operations, aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.aggregates import statistic
from ..plans.quantiles import quantile_row, quantiles
from ..plans.ordinals import ordinal, previous, running

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def resolve(df: DataFrame, spec: str | list) -> list[str]:
    """Columns by name (any case), 1-based number, range a-b, ``last`` or ``all``, in the order of the spec."""
    names, lower = df.columns, {c.lower(): c for c in df.columns}
    out: list[str] = []
    for part in [str(x).strip() for x in (spec if isinstance(spec, list) else spec.split(","))]:
        digits = part[1:] if part[:1] == "c" and part[1:].isdigit() else part
        if part in names or part.lower() in lower:
            out.append(part if part in names else lower[part.lower()])
        elif part == "all":
            out += names
        elif part == "last":
            out.append(names[-1])
        elif digits.isdigit():
            out.append(names[int(digits) - 1])
        elif part.count("-") == 1 and all(x.isdigit() for x in part.split("-")):
            a, b = map(int, part.split("-"))
            out += names[a - 1 : b]
        else:
            raise ValueError(f"no column {part}")
    return out


def cut_columns(df: DataFrame, spec: str | list) -> DataFrame:
    return df.select(*resolve(df, spec))


def as_lines(df: DataFrame, columns: list[str], sep: str = "\t", null: str = ".") -> Column:
    """A row as delimited text; nulls as a mark."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns])


def paste(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Rows of two tables side by side by position; the shorter side is null."""
    a = ordinal(left, left_order, "ln")
    b = ordinal(right.select(*[F.col(c).alias(f"other_{c}") for c in right.columns]), [f"other_{c}" for c in right_order], "other_ln")
    return a.join(b, F.col("ln") == F.col("other_ln"), "full").withColumn("ln", F.coalesce("ln", "other_ln")).drop("other_ln")


def join_tables(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", cut: str | None = None) -> DataFrame:
    """Equi-join on one column of each side; ``cut`` ends keys at a character. Null keys match nothing."""
    key = (lambda c: F.split_part(F.col(c), F.lit(cut), F.lit(1))) if cut else F.col
    return left.join(right, key(left_key) == key(right_key), how)


def loose_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, prefix: int = 8, cutoff: int = 2, ignore_case: bool = True) -> DataFrame:
    """For each left key, the nearest right key: differing characters of the prefixes plus the difference in length,
    at most ``cutoff``; equal distances go to the smaller right key.

    Keys within the cutoff agree on at least one of ``cutoff + 1`` pieces of the padded prefix, which are the keys
    of an equi-join; no pair that can match is missed.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    edges = [round(i * prefix / (cutoff + 1)) for i in range(cutoff + 2)]

    def pieces(c: str) -> Column:
        padded = F.rpad(F.substring(fold(F.col(c)), 1, prefix), prefix, "\x00")
        return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring(padded, a + 1, b - a).alias("p")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]))

    a = left.select(F.col(left_key).alias("left_key")).distinct().where("left_key is not null")
    b = right.select(F.col(right_key).alias("right_key")).distinct().where("right_key is not null")
    near = a.withColumn("piece", pieces("left_key")).join(b.withColumn("piece", pieces("right_key")), "piece").select("left_key", "right_key").distinct()
    at = lambda c, i: F.substring(F.rpad(F.substring(fold(F.col(c)), 1, prefix), prefix, "\x00"), i, 1)
    differ = reduce(lambda x, y: x + y, [(at("left_key", i + 1) != at("right_key", i + 1)).cast("int") for i in range(prefix)])
    distance = (differ + F.abs(F.length("left_key") - F.length("right_key"))).cast("long")
    best = F.row_number().over(Window.partitionBy("left_key").orderBy("distance", "right_key"))
    return near.withColumn("distance", distance).where(F.col("distance") <= cutoff).withColumn("_best", best).where("_best = 1").drop("_best")


def replace_text(df: DataFrame, column: str, pattern: str, replacement: str, regex: bool = True, ignore_case: bool = False) -> DataFrame:
    """Substituted text and the number of hits."""
    p = pattern if regex else r"\Q" + pattern + r"\E"
    p = "(?i)" + p if ignore_case else p
    return df.withColumns({"hits": F.coalesce(F.regexp_count(F.col(column), F.lit(p)), F.lit(0)).cast("long"), column: F.regexp_replace(column, p, replacement if regex else replacement.replace("\\", "\\\\").replace("$", "\\$"))})


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def change_case(df: DataFrame, column: str, mode: str = "upper") -> DataFrame:
    c = F.col(column)
    made = {
        "upper": F.upper(c), "lower": F.lower(c), "title": F.initcap(c),
        "swap": F.translate(c, _UPPER + _LOWER, _LOWER + _UPPER),
        "sentence": F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))),
    }
    return df.withColumn(column, made[mode])


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables, missing columns null."""
    return first.unionByName(second, allowMissingColumns=True)


def head(df: DataFrame, order: list, n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def insert_lines(df: DataFrame, ln: str, line: str, every: int, separator: str, before: bool = True) -> DataFrame:
    """A separator line at every ``every``-th line: rows (ln, part, line)."""
    own, mark = F.struct(F.lit(1).alias("part"), F.col(line).alias("line")), F.struct(F.lit(0 if before else 2).alias("part"), F.lit(separator).alias("line"))
    return df.withColumn("_x", F.explode(F.when(F.col(ln) % every == 0, F.array(mark, own)).otherwise(F.array(own)))).select(ln, "_x.part", "_x.line")


def wrap(df: DataFrame, id: str, text: str, width: int = 60) -> DataFrame:
    """Hard-wrapped pieces (id, piece, line); an empty text is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / width)).cast("int")
    return df.select(id, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * width + 1, width))).alias("piece", "line"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Lines, words, characters and blank lines of all texts, one row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    return df.agg(
        F.sum(F.size(lines)).cast("long").alias("n_lines"), F.sum(F.regexp_count(t, F.lit(r"[^ \t\n\r\f\x0B]+"))).cast("long").alias("n_words"),
        F.sum(F.length(t)).cast("long").alias("n_chars"), F.sum(F.size(F.filter(lines, lambda x: F.trim(x) == ""))).cast("long").alias("n_blank"),
    )


def grep(df: DataFrame, column: str, pattern: str, invert: bool = False, ignore_case: bool = True, whole: bool = False) -> DataFrame:
    p = f"^(?:{pattern})$" if whole else pattern
    hit = F.coalesce(F.col(column).rlike("(?i)" + p if ignore_case else p), F.lit(False))
    return df.where(~hit if invert else hit)


def tr(df: DataFrame, column: str, set1: str, set2: str = "", mode: str = "translate") -> DataFrame:
    """Translate, delete or squeeze characters; ``dna`` complements bases."""
    inside = "".join("\\" + c if not c.isalnum() else c for c in set1)
    c = F.col(column)
    made = {"translate": lambda: F.translate(c, set1, set2), "delete": lambda: F.translate(c, set1, ""), "squeeze": lambda: F.regexp_replace(c, f"([{inside}])\\1+", "$1"), "dna": lambda: F.translate(c, "ACGTUacgtu", "TGCAAtgcaa")}
    return df.withColumn(column, made[mode]())


def ranked_lines(df: DataFrame, keys: list, name: str = "position") -> DataFrame:
    """Sorted rows, as their position in a total order."""
    return ordinal(df, keys, name)


def uniq(df: DataFrame, column: str, order: str, ignore_case: bool = False) -> DataFrame:
    """Values, their counts, and where they come first."""
    key = F.lower(column) if ignore_case else F.col(column)
    return df.groupBy(key.alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def sample(df: DataFrame, key: list, fraction: float = 1.0, n: int | None = None, seed: int = 1) -> DataFrame:
    """A seeded sample by a hash of the key: the same rows at any partitioning; n rows, or a fraction."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30))
    kept = df.withColumn("_draw", draw)
    kept = kept.orderBy("_draw", *key).limit(n) if n is not None else kept.where(F.col("_draw") < int(fraction * (1 << 30)))
    return kept.drop("_draw")


def shuffled(df: DataFrame, key: list, seed: int = 42) -> DataFrame:
    """A seeded permutation: rows with their new position."""
    return ordinal(df.withColumn("_draw", F.xxhash64(F.lit(seed), *key)), ["_draw", *key], "position").drop("_draw")


def subtract(main: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``main`` whose key isn't in ``other`` (null keys equal each other)."""
    renamed = other.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    return main.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]), "left_anti")


def membership(first: DataFrame, second: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """(value, in_a, in_b) of all distinct values."""
    a, b = first.select(F.col(column_a).alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b")), second.select(F.col(column_b).alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return a.unionAll(b).groupBy("value").agg((F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b"))


def overlap(first: DataFrame, second: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """Sizes of the two sets, of what they share, and their Jaccard index."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b = F.col("in_a"), F.col("in_b")
    m = membership(first, second, column_a, column_b).agg(n(a).alias("n_a"), n(b).alias("n_b"), n(a & b).alias("shared"), n(a & ~b).alias("only_a"), n(b & ~a).alias("only_b"))
    return m.withColumn("jaccard", F.col("shared") / F.greatest(F.col("n_a") + F.col("n_b") - F.col("shared"), F.lit(1)))


def set_operation(first: DataFrame, second: DataFrame, column_a: str, column_b: str, operation: str) -> DataFrame:
    a, b = F.col("in_a"), F.col("in_b")
    kept = {"union": a | b, "intersect": a & b, "difference": a & ~b, "complement": b & ~a, "symmetric": a != b}[operation]
    return membership(first, second, column_a, column_b).where(kept).select("value")


def split_on_column(df: DataFrame, column: str, order: str, line: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min_by(line, order).alias("first_line"))


def padded(df: DataFrame, columns: list[str], pad: int = 12) -> DataFrame:
    return df.withColumns({c: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), pad, " ") for c in columns})


def long_cells(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., column, value) with every cell as a string."""
    kept = keep or []
    return df.select(*kept, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(kept, columns, "column", "value")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells, empty and numeric cells, distinct values and the largest share of one value, by column."""
    cells = long_cells(df, columns).groupBy("column", "value").count()
    filled = F.col("value").isNotNull() & (F.trim("value") != "")
    n = F.sum("count")
    return cells.groupBy("column").agg(
        n.alias("n"), F.sum(F.when(~filled | F.col("value").isNull(), F.col("count")).otherwise(0)).alias("n_empty"),
        F.sum(F.when(F.expr("try_cast(value as double)").isNotNull(), F.col("count")).otherwise(0)).alias("n_numeric"),
        F.count("value").alias("distinct_values"), (F.max("count") / n).alias("modal_fraction"),
    )


def extract_matches(df: DataFrame, id: str, text: str, pattern: str) -> DataFrame:
    """(id, nth, found): all matches of a pattern, from 1."""
    return df.select(id, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("_i", "found")).select(id, (F.col("_i") + 1).cast("long").alias("nth"), "found")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal widths from least to greatest value, empty bins included."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("long")
    counted = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0).cast("long")).alias("bin")).count()
    every = ends.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("n"))


def by_ids(df: DataFrame, ids: DataFrame, column: str, id: str, invert: bool = False) -> DataFrame:
    kept = ids.select(F.col(id).alias("_id")).distinct()
    return df.join(kept, F.col(column) == F.col("_id"), "left_anti" if invert else "left_semi")


def compare(df: DataFrame, column: str, op: str, threshold: float) -> DataFrame:
    """Rows by a numeric comparison; cells that aren't numbers go. Equality has a tolerance of 1e-9."""
    v = F.expr(f"try_cast(`{column}` as double)")
    return df.where({">": v > threshold, ">=": v >= threshold, "<": v < threshold, "<=": v <= threshold, "==": F.abs(v - threshold) <= 1e-9, "!=": F.abs(v - threshold) > 1e-9}[op])


def numeric_rows(df: DataFrame, columns: list[str], least_percent: float = 100) -> DataFrame:
    """Rows of which at least so many percent of the cells are numbers."""
    cells = F.array(*[F.expr(f"try_cast(`{c}` as double)") for c in columns])
    return df.where(F.size(F.filter(cells, lambda x: x.isNotNull())) * 100.0 / len(columns) >= least_percent)


def without_missing(df: DataFrame, columns: list[str], most: float = 0.0) -> DataFrame:
    """Rows whose share of missing cells (null or empty) is at most ``most``."""
    missing = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1).otherwise(0) for c in columns])
    return df.where(missing / len(columns) <= most)


def first_of(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row of each key: the first (or last) in the order."""
    by = [F.desc(c) if isinstance(c, str) else c.desc() for c in order] if last else order
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def every_nth(df: DataFrame, order: list, step: int) -> DataFrame:
    """A systematic sample: rows 1, 1 + step, ..."""
    return ordinal(df, order, "ln").where((F.col("ln") - 1) % step == 0)


def grouped(df: DataFrame, by: str, values: list[str], function: str = "mean") -> DataFrame:
    """One statistic of each value column by group (see functions.aggregates)."""
    return df.groupBy(by).agg(*[statistic(function, F.col(c)).alias(f"{function}_{c}") for c in values])


def group_summary(df: DataFrame, by: str, values: list[str], member: str) -> DataFrame:
    """Count, joined members (all of them, in order) and means by group. A group's members are one value."""
    members = F.array_join(F.sort_array(F.collect_list(F.col(member).cast("string"))), ",")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.nullif(members, F.lit("")).alias("members"), *[F.avg(c).alias(f"mean_{c}") for c in values])


#: Statistics that are quantiles; iqr is a difference of two.
_QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p5": 0.05, "p95": 0.95}


def describe(df: DataFrame, columns: list[str], functions: list[str]) -> DataFrame:
    """(column, statistics...): one row a column. Quantiles are exact, by ``quantiles``; columns of any length."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    points = {f: p for f, p in _QUANTILES.items() if f in functions or (f in ("q1", "q3") and "iqr" in functions)}
    own = long.groupBy("column").agg(F.count("*").alias("_rows"), *[statistic(f, F.col("value")).alias(f) for f in functions if f not in (*_QUANTILES, "iqr")])
    if not points:
        return own.drop("_rows")
    found = quantile_row(long, ["column"], "value", points).withColumnRenamed("column", "_column")
    both = own.join(found, F.col("column") == F.col("_column"), "left")
    return both.select("column", *[(F.col("q3") - F.col("q1")).alias("iqr") if f == "iqr" else F.col(f) for f in functions])


def percentiles(df: DataFrame, column: str, points: list[float]) -> DataFrame:
    """(p, value): interpolated percentiles, exact for columns of any length."""
    named = F.create_map(*[F.lit(x) for p in points for x in (float(p / 100), float(p))])
    return quantiles(df, [], column, [p / 100 for p in points]).select(F.element_at(named, F.col("p")).alias("p"), "value")


def cross_tab(df: DataFrame, row: str, column: str, values: list, value: str | None = None) -> DataFrame:
    """Counts, or means of a value, by row and the listed values of a column."""
    cell = (lambda w: F.count(w)) if value is None else (lambda w: F.avg(w))
    return df.groupBy(row).agg(*[cell(F.when(F.col(column) == v, F.lit(1) if value is None else F.col(value))).alias(f"{column}_{v}") for v in values])


def totals(df: DataFrame, row: str, columns: list[str], stat: str = "sum") -> DataFrame:
    """(axis, name, value): a statistic of each row and each column of a matrix."""
    long = df.select(F.col(row).cast("string").alias("row"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("row", columns, "column", "value")
    one = lambda axis: long.groupBy(axis).agg(statistic(stat, F.col("value")).alias("value")).select(F.lit(axis).alias("axis"), F.col(axis).alias("name"), "value")
    return one("row").unionAll(one("column"))


def normalized(df: DataFrame, column: str, mode: str, out: str = "normalized") -> DataFrame:
    """A column as z-score, min-max, share of the sum, percent, log2(x + 1) or robust z."""
    v = F.col(column).cast("double")
    if mode == "log2":
        return df.withColumn(out, F.log2(v + 1))
    if mode == "rank":
        return ordinal(df, [column], out)
    if mode == "robust":
        both = df.join(F.broadcast(quantile_row(df, [], column, {"_median": 0.5})), how="left")
        spread = quantile_row(both.select(F.abs(v - F.col("_median")).alias("_apart")), [], "_apart", {"_mad": 0.5})
        both = both.join(F.broadcast(spread), how="left")
    else:
        both = df.crossJoin(F.broadcast(df.agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.sum(v).alias("_sum"))))
    made = {
        "z-score": lambda: (v - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)), "min-max": lambda: (v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)),
        "sum": lambda: v / F.nullif(F.col("_sum"), F.lit(0.0)), "percent": lambda: 100 * v / F.nullif(F.col("_sum"), F.lit(0.0)),
        "robust": lambda: 0.6745 * (v - F.col("_median")) / F.nullif(F.col("_mad"), F.lit(0.0)),
    }[mode]()
    return both.select(*df.columns, made.alias(out))


def cumulative(df: DataFrame, order: list, column: str, function: str = "cumsum", out: str = "cumulative") -> DataFrame:
    """cumsum, cummean, cummax, cummin, diff or percent change in a total order, for tables of any size."""
    if function in ("diff", "pct_change"):
        back = previous(df, order, column, "_back")
        change = F.col(column) - F.col("_back")
        return back.withColumn(out, change if function == "diff" else change / F.nullif(F.col("_back"), F.lit(0))).drop("_back")
    if function == "cummean":
        return running(running(df, order, column, "_sum"), order, column, "_n", "count").withColumn(out, F.col("_sum") / F.col("_n")).drop("_sum", "_n")
    return running(df, order, column, out, {"cumsum": "sum", "cummax": "max", "cummin": "min"}[function])


def binned(df: DataFrame, column: str, width: float, value: str, function: str = "count") -> DataFrame:
    at = F.floor(F.col(column) / width)
    return df.where(F.col(column).isNotNull()).groupBy((at * width).cast("double").alias("bin")).agg(statistic(function, F.col(value)).alias("value"))


def outliers(df: DataFrame, column: str, method: str = "iqr", cutoff: float = 1.5) -> DataFrame:
    """Rows beyond the fences: iqr, z-score or modified-z."""
    if method == "iqr":
        both = df.join(F.broadcast(quantile_row(df, [], column, {"_lo": 0.25, "_hi": 0.75})), how="left")
        lo, hi = F.col("_lo"), F.col("_hi")
        far = (F.col(column) < lo - cutoff * (hi - lo)) | (F.col(column) > hi + cutoff * (hi - lo))
        return both.where(far).select(*df.columns)
    scored = normalized(df, column, {"z-score": "z-score", "modified-z": "robust"}[method], "_z")
    return scored.where(F.abs("_z") > cutoff).drop("_z")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Values, counts and percent of all rows."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return counted.crossJoin(F.broadcast(total)).select("value", "n", (100 * F.col("n") / F.col("_all")).alias("percent"))


def row_math(df: DataFrame, columns: list[str], operation: str, out: str = "value") -> DataFrame:
    """One statistic across the columns of each row; nulls don't count."""
    cells = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    n = F.size(cells)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(cells) / F.nullif(n, F.lit(0))
    sd = F.sqrt(total(F.transform(cells, lambda x: (x - mean) * (x - mean))) / F.nullif(n - 1, F.lit(0)))
    ordered = F.array_sort(cells)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.ceil((n - 1) / 2).cast("int"))) / 2
    made = {
        "sum": total(cells), "mean": mean, "min": F.array_min(cells), "max": F.array_max(cells), "median": middle, "stdev": sd, "cv": 100 * sd / F.nullif(mean, F.lit(0.0)),
        "range": F.array_max(cells) - F.array_min(cells), "nonzero": F.size(F.filter(cells, lambda x: x != 0)).cast("double"),
        "product": F.aggregate(cells, F.lit(1.0), lambda s, x: s * x), "geomean": F.exp(total(F.transform(cells, lambda x: F.log(x))) / F.nullif(n, F.lit(0))), "log10sum": F.log10(total(cells)),
    }[operation]
    return df.withColumn(out, made)


def pairwise(df: DataFrame, left: str, right: str, operation: str, out: str = "value") -> DataFrame:
    a, b = F.col(left).cast("double"), F.col(right).cast("double")
    made = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": F.try_divide(a, b), "log2_ratio": F.when((a > 0) & (b > 0), F.log2(a / b)), "abs_difference": F.abs(a - b)}[operation]
    return df.withColumn(out, made)


def imputed(df: DataFrame, columns: list[str], method: str = "mean") -> DataFrame:
    """Missing numbers as the mean, median, min, max of their column, or zero."""
    if method == "zero":
        return df.fillna(0, subset=columns)
    facts = df.agg(*[statistic(method, F.col(c)).alias(f"_{c}") for c in columns])
    return df.crossJoin(F.broadcast(facts)).select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """(index, value): distinct values numbered by where they come first."""
    firsts = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    return ordinal(firsts, ["first", "value"], "index").select("index", "value")


def transposed(df: DataFrame, row: str, columns: list[str], rows: list) -> DataFrame:
    """Columns become rows; ``rows`` lists the values of the row column that become columns."""
    long = df.select(F.col(row).alias("_row"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("_row", columns, "column", "value")
    return long.groupBy("column").agg(*[F.max(F.when(F.col("_row") == r, F.col("value"))).alias(str(r)) for r in rows])


def scaled(df: DataFrame, row: str, columns: list[str], axis: str = "rows", mode: str = "z-score") -> DataFrame:
    """(row, column, value): a matrix scaled by row, by column or as a whole."""
    long = df.select(F.col(row).alias("row"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("row", columns, "column", "value")
    keys = {"rows": ["row"], "columns": ["column"], "all": []}[axis]
    v = F.col("value")
    facts = long.groupBy(*keys).agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_sd"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.sqrt(F.sum(v * v)).alias("_norm"))
    both = long.join(facts, keys) if keys else long.crossJoin(F.broadcast(facts))
    made = {"z-score": (v - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0)), "center": v - F.col("_mean"), "min-max": (v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), "unit": v / F.nullif(F.col("_norm"), F.lit(0.0))}[mode]
    return both.select("row", "column", made.alias("value"))


def renamed_values(df: DataFrame, column: str, prefix: str = "", suffix: str = "", strip: str = "") -> DataFrame:
    """(old, new) names."""
    base = F.regexp_replace(column, strip, "") if strip else F.col(column)
    return df.select(F.col(column).alias("old"), F.concat(F.lit(prefix), base, F.lit(suffix)).alias("new")).distinct()


def first_rows(df: DataFrame, order: list, fraction: float) -> DataFrame:
    """The first share of all rows."""
    total = df.agg(F.count("*").alias("_all"))
    return ordinal(df, order, "ln").crossJoin(F.broadcast(total)).where(F.col("ln") <= F.floor(F.col("_all") * fraction)).drop("_all")
