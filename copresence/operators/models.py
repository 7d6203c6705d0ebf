"""Regression, clustering and baseline models on Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Normalizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from copresence.functions import draws
from copresence.operators.compare import wavg
from copresence.session import beside, cut


def split(df: DataFrame, keys: list[str], shares: list[float], seed: int = 0) -> list[DataFrame]:
    """Disjoint parts by a seeded hash of the row key: the same rows whatever the partitioning."""
    u = draws.uniform([F.col(k) for k in keys], seed)
    total, lo, out = sum(shares), 0.0, []
    for i, s in enumerate(shares):
        hi = 1.0 if i == len(shares) - 1 else lo + s / total
        out.append(df.where((u > lo) & (u <= hi)))
        lo = hi
    return out


def group_regression(df: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted straight line per group: slope, intercept and R2 from centred sums."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = ok.groupBy(*by).agg(wavg(F.col(x), F.col(w)).alias("_mx"), wavg(F.col(y), F.col(w)).alias("_my"))
    c = beside(ok, m, by)
    dx, dy, wt = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"), F.col(w)
    s = c.groupBy(*by).agg(F.sum(wt * dx * dx).alias("sxx"), F.sum(wt * dx * dy).alias("sxy"), F.sum(wt * dy * dy).alias("syy"),
                           F.first("_mx").alias("mx"), F.first("_my").alias("my"), F.count(F.lit(1)).alias("n"))
    slope = F.col("sxy") / F.col("sxx")
    return s.select(*by, "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
                    (F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))).alias("r2"))


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns to mean 0 and standard deviation 1."""
    row = df.select(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    stats = row.select(F.struct("*")).scalar()
    return df.withColumn("_s", stats).withColumns(
        {c: F.try_divide(F.col(c) - F.col("_s")[f"m_{c}"], F.col("_s")[f"s_{c}"]) for c in cols}).drop("_s")


def _rmse(model: PipelineModel, parts: dict[str, DataFrame], y: str) -> list[tuple]:
    ev = RegressionEvaluator(labelCol=y, predictionCol="prediction", metricName="rmse")
    return [(name, float(ev.evaluate(model.transform(part)))) for name, part in parts.items()]


def gbt_baseline(df: DataFrame, keys: list[str], cols: list[str], y: str, pca: int | None = None, iters: int = 10, seed: int = 0):
    """Assemble, scale rows to L1 norm 1, optionally reduce, boost; error on both parts of a 90/10 split.

    Rows with equal features are one case with their number as weight and their mean as label: under squared error the gain of a split
    and the value of a leaf depend on these only, and the error adds the spread inside a case. Components are those of the rows.
    """
    train, test = split(df.select(*dict.fromkeys([*keys, *cols, y])).dropna(), keys, [0.9, 0.1], seed)
    stages = [VectorAssembler(inputCols=cols, outputCol="raw"), Normalizer(inputCol="raw", outputCol="norm", p=1.0)]
    features = "norm"
    if pca:
        stages.append(PCA(k=pca, inputCol="norm", outputCol="pca"))
        features = "pca"
    prepared = Pipeline(stages=stages).fit(train)
    cases = {part: cut(_cases(rows, cols, y)) for part, rows in (("train", train), ("test", test))}
    boosted = GBTRegressor(featuresCol=features, labelCol=y, weightCol="_n", maxIter=iters, seed=seed).fit(prepared.transform(cases["train"]))
    model = PipelineModel([*prepared.stages, boosted])
    off = F.col("_n") * (F.pow(F.col("prediction") - F.col(y), 2) + F.col("_spread"))
    errors = [(part, model.transform(c).select(F.sqrt(F.sum(off) / F.sum("_n"))).first()[0]) for part, c in cases.items()]
    return model, df.sparkSession.createDataFrame(errors, "part string, rmse double")


def _cases(rows: DataFrame, cols: list[str], y: str) -> DataFrame:
    """Rows with equal features as one: their number, mean label and its variance."""
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(y).alias(y), F.var_pop(y).alias("_spread"))


def feature_regression(df: DataFrame, keys: list[str], cols: list[str], y: str, seed: int = 0):
    """Regression on standardised features: boosted trees and a linear model, with their errors."""
    train, test = split(cut(df.select(*dict.fromkeys([*keys, *cols, y])).dropna()), keys, [0.8, 0.2], seed)
    prep = [VectorAssembler(inputCols=cols, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
    rows = []
    for name, est in (("gbt", GBTRegressor(featuresCol="x", labelCol=y, maxIter=10, seed=seed)),
                      ("linear", GeneralizedLinearRegression(featuresCol="x", labelCol=y))):
        model = Pipeline(stages=[*prep, est]).fit(train)
        rows += [(name, part, e) for part, e in _rmse(model, {"train": train, "test": test}, y)]
    return df.sparkSession.createDataFrame(rows, "model string, part string, rmse double")


def additive_model(df: DataFrame, cols: list[str], y: str, bins: int = 8, pairs: int = 0, seed: int = 0):
    """Additive model on binned features: importance table and effect per bin.

    Features enter as quantile bins; the fitted part of a bin is its effect. Importance is the mean absolute effect over
    the rows. `pairs` adds products of the features that lead by importance in the model without products.
    """
    if pairs:
        main = {r["feature"]: r["importance"] for r in additive_model(df, cols, y, bins, 0, seed)[0].collect()}
        cols = sorted(cols, key=lambda c: (-main.get(c, 0.0), c))
    spark, data = df.sparkSession, cut(df.select(*cols, y).dropna())
    probs = [i / bins for i in range(1, bins)]
    edges = dict(zip(cols, data.approxQuantile(cols, probs, 0.001)))
    names, exprs = [], []
    for c in cols:
        cutpoints = sorted(set(edges[c]))
        for i, lo in enumerate(cutpoints):
            hi = cutpoints[i + 1] if i + 1 < len(cutpoints) else float("inf")
            names.append((c, i + 1, lo))
            exprs.append(((F.col(c) > lo) & (F.col(c) <= hi)).cast("double").alias(f"{c}__{i + 1}"))
    lead = sorted(((i + j, i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))))[:pairs]
    lead = [(cols[i], cols[j]) for _, i, j in lead]
    for a, b in lead:
        names.append((f"{a} x {b}", 0, 0.0))
        exprs.append((F.col(a) * F.col(b)).alias(f"{a}__x__{b}"))
    wide = data.select(F.col(y), *exprs)
    inputs = wide.columns[1:]
    model = GeneralizedLinearRegression(featuresCol="f", labelCol=y, regParam=1e-6).fit(
        VectorAssembler(inputCols=inputs, outputCol="f").transform(wide))
    weights = wide.select(*[F.avg(F.abs(c)).alias(c) for c in inputs]).first()
    effects = [(n, b, float(lo), float(model.coefficients[i]), float(weights[inputs[i]])) for i, (n, b, lo) in enumerate(names)]
    table = spark.createDataFrame(effects, "feature string, bin int, edge double, effect double, share double")
    importance = table.groupBy("feature").agg(F.sum(F.abs("effect") * F.col("share")).alias("importance"))
    return importance, table


def additive_by_group(df: DataFrame, by: list[str], cols: list[str], y: str, bins: int = 8, pairs: int = 3) -> DataFrame:
    """Additive models of binned features for all groups in one job: by, feature, bin, bin2, share, effect, importance.

    The normal equations of bin indicators are counts of bin pairs and sums of y, so one aggregate holds them for every group, and each
    group's few thousand numbers are solved apart. Effects of a feature average zero over the group's rows. Pairs of features are screened by how much
    of the squared residual the means of their cells explain; the `pairs` best of each group enter with those means as effects
    (`bin2` is null for single features). Importance is the mean absolute effect. Rows with a null take no part; bins are cut at quantiles of all rows.
    """
    k = len(cols)
    data = cut(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("_y")).dropna())
    cuts = data.approxQuantile(cols, [i / bins for i in range(1, bins)], 0.001) if bins > 1 else [[] for _ in cols]
    place = [sum([(F.col(c) > e).cast("int") for e in sorted(set(es))], F.lit(0)).alias(f"_b{i}") for i, (c, es) in enumerate(zip(cols, cuts))]
    binned = cut(data.select(*by, "_y", *place))

    def cells(rows: DataFrame, value: str, first: int) -> DataFrame:
        """Counts and sums for every pair of features and of their bins."""
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"_b{i}").alias("p"), F.col(f"_b{j}").alias("q")) for i in range(k) for j in range(i + first, k)]))
        return rows.select(*by, value, each.alias("c")).groupBy(*by, "c.a", "c.b", "c.p", "c.q").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["a"] == rows["b"]].sort_values(["a", "p"])
        at = {(f, b): i for i, (f, b) in enumerate(zip(own["a"], own["p"]))}
        n, total = own["n"].to_numpy(float), own["s"].to_numpy(float)
        gram = np.zeros((len(at), len(at)))
        for r in rows.itertuples():
            i, j = at[r.a, r.p], at[r.b, r.q]
            gram[i, j] = gram[j, i] = r.n
        whole = n[own["a"].to_numpy() == own["a"].iloc[0]].sum()
        mean = total[own["a"].to_numpy() == own["a"].iloc[0]].sum() / whole
        # a row for each feature fixes its effects to average zero
        zero = np.array([np.where(own["a"] == f, n, 0.0) / whole for f in range(k)])
        effect = np.linalg.lstsq(np.vstack([gram / whole, zero]), np.concatenate([(total - mean * n) / whole, np.zeros(k)]), rcond=1e-12)[0]
        return pd.DataFrame({**dict(zip(by, key)), "a": own["a"].to_numpy(), "p": own["p"].to_numpy(), "share": n / whole, "effect": effect, "mean": mean})

    single = cut(cells(binned, "_y", 0).groupBy(*by).applyInPandas(solve, f"{fields}a int, p int, share double, effect double, mean double"))
    known = single.groupBy(*by).agg(F.first("mean").alias("_mean"), F.map_from_entries(F.collect_list(F.struct(F.struct("a", "p"), "effect"))).alias("_f"))
    fitted = sum([F.element_at("_f", F.struct(F.lit(i).alias("a"), F.col(f"_b{i}").alias("p"))) for i in range(k)], F.col("_mean"))
    left = beside(binned, known, by).withColumn("_r", F.col("_y") - fitted)
    both = cut(cells(left, "_r", 1)) if pairs and k > 1 else None
    name = F.array(*[F.lit(c) for c in cols])
    at = lambda c: F.element_at(name, F.col(c) + 1)
    out = single.select(*by, at("a").alias("feature"), F.col("p").alias("bin"), F.lit(None).cast("int").alias("bin2"), "share", "effect")
    if both is not None:
        gain = both.groupBy(*by, "a", "b").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("gain"), F.sum("n").alias("all"))
        best = Window.partitionBy(*by).orderBy(F.desc("gain"), "a", "b")  # pairs of features
        lead = gain.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= pairs).drop("nth", "gain")
        more = both.join(lead, [*by, "a", "b"]).select(
            *by, F.concat(at("a"), F.lit(" x "), at("b")).alias("feature"), F.col("p").alias("bin"), F.col("q").alias("bin2"), (F.col("n") / F.col("all")).alias("share"), (F.col("s") / F.col("n")).alias("effect"))
        out = out.unionByName(more)
    out = cut(out)
    return out.join(out.groupBy(*by, "feature").agg(F.sum(F.abs("effect") * F.col("share")).alias("importance")), [*by, "feature"])


def rf_cv(df: DataFrame, vec: str, label: str, folds: int = 10, trees: int = 20, depth: int = 7, seed: int = 0) -> DataFrame:
    """Cross-validated accuracy of a random forest on vectors."""
    data = cut(df.select(array_to_vector(F.col(vec)).alias("x"), F.col(label).cast("string").alias("label")))
    stages = [StringIndexer(inputCol="label", outputCol="y"), RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)]
    cv = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds, seed=seed,
                        evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"), parallelism=4)
    model = cv.fit(data)
    return df.sparkSession.createDataFrame([(folds, float(model.avgMetrics[0]), float(model.stdMetrics[0]))], "folds int, accuracy double, sd double")


def cluster(df: DataFrame, key: str, cols: list[str], ks: list[int], w: str | None = None, pick: int | None = None, seed: int = 0):
    """k-means on standardised columns for each k with its silhouette, and the labels for the picked k (or the best)."""
    data = cut(df.select(*dict.fromkeys([key, *cols, *([w] if w else [])])).dropna())
    stages = [VectorAssembler(inputCols=cols, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
    scaled = Pipeline(stages=stages).fit(data).transform(data).select(key, "x", *([w] if w else []))
    ev = ClusteringEvaluator(featuresCol="x", predictionCol="cluster")
    scores, models = [], {}
    for k in ks:
        km = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster")
        models[k] = (km.setWeightCol(w) if w else km).fit(scaled)
        scores.append((k, float(ev.evaluate(models[k].transform(scaled)))))
    best = pick or max(scores, key=lambda s: s[1])[0]
    return df.sparkSession.createDataFrame(scores, "k int, silhouette double"), models[best].transform(scaled).select(key, "cluster")


def place_type_table(visits: DataFrame, place: str, kind: str, values: list[str]) -> DataFrame:
    """Places by type counts."""
    return visits.groupBy(place).pivot(kind, values).agg(F.count(F.lit(1))).fillna(0)


def vectors(df: DataFrame, col: str) -> Column:
    return vector_to_array(F.col(col))
