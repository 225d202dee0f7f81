"""Learning and graphs on Spark's own estimators and distributed iterations."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordinals import materialized
from ..plans.quantiles import quantile_row


def standardized(df: DataFrame, vector: str = "features") -> DataFrame:
    """Vectors centred and scaled once."""
    made = df.withColumn("_raw", array_to_vector(F.col(vector).cast("array<double>")))
    return StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(made).transform(made)


def kmeans(df: DataFrame, id: str, vector: str, k: int = 3, seed: int = 1) -> DataFrame:
    x = standardized(df, vector)
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(x).transform(x).select(id, "cluster")


def mixture(df: DataFrame, id: str, vector: str, k: int = 2, seed: int = 1) -> DataFrame:
    x = standardized(df, vector)
    return GaussianMixture(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(x).transform(x).select(id, "cluster")


def pca(df: DataFrame, id: str, vector: str, k: int = 2) -> DataFrame:
    x = standardized(df, vector)
    return PCA(k=k, inputCol="_x", outputCol="_s").fit(x).transform(x).select(id, vector_to_array("_s").alias("scores"))


def anomalies(df: DataFrame, id: str, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """(id, score, anomaly): the greatest robust z of the columns."""
    v = {c: F.col(c).cast("double") for c in columns}
    both = df
    for c in columns:
        both = both.join(F.broadcast(quantile_row(df, [], c, {f"_m_{c}": 0.5})), how="left")
    apart = both.select(*[F.abs(v[c] - F.col(f"_m_{c}")).alias(c) for c in columns])
    for c in columns:
        both = both.join(F.broadcast(quantile_row(apart, [], c, {f"_d_{c}": 0.5})), how="left")
    z = [0.6745 * F.abs(v[c] - F.col(f"_m_{c}")) / F.nullif(F.col(f"_d_{c}"), F.lit(0.0)) for c in columns]
    score = F.greatest(*z) if len(z) > 1 else z[0]
    return both.select(id, score.alias("score"), (score > threshold).alias("anomaly"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, by alternating star contractions on written-out edges."""
    now = materialized(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    facts = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        after = materialized(large.join(low, F.col("a") == F.col("u")).select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        if facts(after) == facts(now):
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now = after


def split(df: DataFrame, id: str, test: float = 0.25, seed: int = 1) -> DataFrame:
    """A seeded split by a hash of the id, the same at any partitioning."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1 << 20)) < int(test * (1 << 20)), "test").otherwise("train"))


def classified(df: DataFrame, vector: str, label: str, test: float = 0.25, seed: int = 1) -> DataFrame:
    """(label, prediction, n) of the held-out rows of a seeded split, by a logistic model."""
    from pyspark.ml.classification import LogisticRegression

    x = standardized(split(df.withColumn("_key", F.xxhash64(*df.columns)), "_key", test, seed), vector)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1e-3).fit(x.where("part = 'train'"))
    return model.transform(x.where("part = 'test'")).groupBy(label, "prediction").agg(F.count("*").alias("n"))


def regressed(df: DataFrame, vector: str, target: str, ridge: float = 0.1, test: float = 0.25, seed: int = 1) -> DataFrame:
    """(n, rmse, r2) on the held-out rows of a seeded split, by ridge regression."""
    from pyspark.ml.regression import LinearRegression

    x = standardized(split(df.withColumn("_key", F.xxhash64(*df.columns)), "_key", test, seed), vector)
    model = LinearRegression(featuresCol="_x", labelCol=target, regParam=ridge).fit(x.where("part = 'train'"))
    p = model.transform(x.where("part = 'test'"))
    e = F.col("prediction") - F.col(target)
    return p.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(target) * F.count("*"))).alias("r2"))


def validated(df: DataFrame, vector: str, ks: list[int], seed: int = 1) -> DataFrame:
    """(k, cost, silhouette) of k-means for each k."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    x = materialized(standardized(df, vector).select("_x"))
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(x)
        rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(model.transform(x)))))
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")


def density_clusters(points: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, cluster, core) of points (id, x, y): DBSCAN over a grid of cells as wide as ``eps``. Points meet those of
    the nine cells around theirs; clusters are the components of core points, a border point joins its nearest core
    (then the smaller id), and noise has no cluster."""
    # equal points share their neighbours and their cluster: only distinct ones are paired, each by its least id
    one = materialized(points.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("times")))
    cell = one.withColumns({"_i": F.floor(F.col("x") / eps), "_j": F.floor(F.col("y") / eps)})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    other = cell.select(F.col("id").alias("b"), F.col("times").alias("_times"), F.col("x").alias("bx"), F.col("y").alias("by"), around.alias("d"), "_i", "_j").select("b", "_times", "bx", "by", (F.col("_i") + F.col("d.i")).alias("_i"), (F.col("_j") + F.col("d.j")).alias("_j"))
    gap = F.sqrt((F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by")))
    # merged: the planner would send nine rows for each point through the driver
    near = materialized(cell.join(other.hint("merge"), ["_i", "_j"]).select(F.col("id").alias("a"), "b", "_times", gap.alias("d")).where(F.col("d") <= eps))
    core = materialized(near.groupBy("a").agg(F.sum("_times").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("core")))
    linked = near.join(core, F.col("a") == F.col("core"), "left_semi").join(core, F.col("b") == F.col("core"), "left_semi")
    label = components(linked, "a", "b")
    named = core.join(label, F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("cluster"))
    joined = near.join(named, F.col("b") == F.col("core")).groupBy("a").agg(F.min(F.struct("d", "b", "cluster")).alias("best"))
    own = core.withColumnRenamed("core", "_core")
    found = one.join(joined, F.col("id") == F.col("a"), "left").join(own, F.col("id") == F.col("_core"), "left").select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("best.cluster").alias("cluster"), F.col("_core").isNotNull().alias("core"))
    both = points.join(found.hint("merge"), F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y")), "left")
    return both.select("id", "cluster", "core")
