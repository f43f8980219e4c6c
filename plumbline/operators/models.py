"""Probes that need a fitted model, on spark.ml: out-of-fold scores, importances, cluster scans. Folds come from the hash of the id, so no row is scored by a model that has seen it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut_lineage, drop_step
from .decisions import auc
from .features import fold_of


def _kept(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns of df as a table in the shared folder: models pass over them many times, and what they come from is read and worked out once."""
    return cut_lineage(df.select(*dict.fromkeys(columns)))


def assembled(df: DataFrame, columns: Sequence[str], scale: bool = True) -> DataFrame:
    """df with features, without rows that miss one."""
    v = VectorAssembler(inputCols=list(columns), outputCol="_raw" if scale else "features", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(v).transform(v).drop("_raw") if scale else v


def out_of_fold(df: DataFrame, id_col: str, label: str, estimator, folds: int = 5, seed: int = 42) -> DataFrame:
    """(id, label, score): the probability of class 1 from the model of the other folds. df has features."""
    d = _kept(df.where(F.col(label).isNotNull()).withColumn("_f", fold_of(id_col, folds, seed)).withColumn("label", F.col(label).cast("double")), [id_col, "_f", "label", "features"])
    out = None
    for k in range(folds):
        scored = estimator.fit(d.where(F.col("_f") != k)).transform(d.where(F.col("_f") == k)).select(F.col(id_col), "label", vector_to_array("probability").getItem(1).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def single_feature_auc(df: DataFrame, id_col: str, label: str, columns: Sequence[str], threshold: float = 0.9, folds: int = 5) -> DataFrame:
    """(column, auc, suspicious): out-of-fold area under the curve of a tree of depth 3 on each column alone; a leak shows as one near 1."""
    d, out = _kept(df, [id_col, label, *columns]), None
    for c in columns:
        s = out_of_fold(assembled(d, [c], False), id_col, label, DecisionTreeClassifier(maxDepth=3, seed=42), folds)
        a = auc(s, "label", "score").select(F.lit(c).alias("column"), "auc", (F.col("auc") > threshold).alias("suspicious"))
        out = a if out is None else out.unionByName(a)
    return out


def separability(df: DataFrame, id_col: str, label: str, folds: int = 5) -> DataFrame:
    """One row (n, accuracy, auc) of logistic regression out of fold. df has features."""
    s = out_of_fold(df, id_col, label, LogisticRegression(maxIter=30), folds)
    return s.agg(F.count("*").alias("n"), F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int")).alias("accuracy")).crossJoin(auc(s, "label", "score"))


def suspect_labels(df: DataFrame, id_col: str, label: str, thresh: float = 0.95, folds: int = 5) -> DataFrame:
    """(id, label, score) that models which haven't seen them contradict with confidence."""
    s = out_of_fold(df, id_col, label, LogisticRegression(maxIter=30), folds)
    return s.where(((F.col("label") == 1) & (F.col("score") < 1 - thresh)) | ((F.col("label") == 0) & (F.col("score") > thresh)))


def missingness_auc(df: DataFrame, id_col: str, column: str, predictors: Sequence[str], folds: int = 3) -> DataFrame:
    """One row (auc, verdict): whether other columns tell where a column is missing; near one half they don't (MCAR is plausible), above 0.6 they do (MAR)."""
    d = df.withColumn("_missing", F.col(column).isNull().cast("int"))
    s = out_of_fold(assembled(d, predictors, False), id_col, "_missing", RandomForestClassifier(numTrees=30, maxDepth=5, seed=42), folds)
    return auc(s, "label", "score").withColumn("verdict", F.when(F.col("auc") >= 0.6, "depends_on_others").otherwise("no_sign_of_dependence"))


def _noise(columns: Sequence[str], seed: int):
    """Evenly spread numbers by the hash of a row's values: the same on every cluster; rows that are equal have equal ones."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def forest_importance(df: DataFrame, label: str, columns: Sequence[str], trees: int = 50, noise: int = 2, seed: int = 42) -> DataFrame:
    """(column, importance, above_noise): impurity importance beside columns of noise that are added; what isn't above the greatest of them is no better than chance."""
    d = _kept(df.where(F.col(label).isNotNull()), [label, *columns]).withColumns({f"_noise{k}": _noise([label, *columns], seed + k) for k in range(noise)})
    names = [*columns, *[f"_noise{k}" for k in range(noise)]]
    model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=5, seed=seed).fit(assembled(d, names, False))
    w = dict(zip(names, map(float, model.featureImportances.toArray()), strict=True))
    floor = max([w[n] for n in names if n.startswith("_noise")], default=0.0)
    return df.sparkSession.createDataFrame([(c, w[c], w[c] > floor) for c in columns], "column string, importance double, above_noise boolean")


def k_scan(df: DataFrame, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette, is_elbow): the elbow is farthest from the line between the first and the last. df has features."""
    rows = []
    for k in ks:
        m = KMeans(k=k, seed=seed, maxIter=20).fit(df)
        rows.append((k, float(m.summary.trainingCost), float(ClusteringEvaluator().evaluate(m.transform(df)))))
    (a, s, _), (z, e, _) = rows[0], rows[-1]
    far = [abs((e - s) * (k - a) / max(1, z - a) - (i - s)) for k, i, _ in rows]
    return df.sparkSession.createDataFrame([(*r, far[j] == max(far)) for j, r in enumerate(rows)], "k int, inertia double, silhouette double, is_elbow boolean")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari) from the table of counts."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda x: F.sum(x * (x - 1) / 2)
    i = c.agg(pairs(F.col("n")).alias("i"), F.sum("n").alias("t"))
    x = c.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("x"))
    y = c.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("y"))
    e = F.try_divide(F.col("x") * F.col("y"), F.col("t") * (F.col("t") - 1) / 2)
    return i.crossJoin(x).crossJoin(y).select(F.coalesce(F.try_divide(F.col("i") - e, (F.col("x") + F.col("y")) / 2 - e), F.lit(1.0)).alias("ari"))


def cluster_stability(df: DataFrame, id_col: str, k: int = 3, n: int = 5, share: float = 0.8, seed: int = 42) -> DataFrame:
    """(run, ari): agreement of clusterings of samples with that of all rows, over the samples' rows. df has features."""
    whole = KMeans(k=k, seed=seed, maxIter=20).fit(df).transform(df).withColumnRenamed("prediction", "_a")
    out = None
    for run in range(n):
        sample = whole.where(F.pmod(F.xxhash64(id_col, F.lit(seed + run)), F.lit(1000)) < int(share * 1000))
        part = KMeans(k=k, seed=seed + run + 1, maxIter=20).fit(sample).transform(sample)
        a = adjusted_rand(part, "_a", "prediction").select(F.lit(run).alias("run"), "ari")
        out = a if out is None else out.unionByName(a)
    return out


def mrmr(relevance: DataFrame, correlations: DataFrame, k: int) -> DataFrame:
    """(rank, column, score): greedy choice by relevance (column, score) less the mean |r| (a, b, r) to those chosen before. Both tables are of columns, not of rows."""
    rel = {r["column"]: r.score for r in relevance.collect()}
    cor = {}
    for r in correlations.collect():
        cor[r.a, r.b] = cor[r.b, r.a] = abs(r.r or 0.0)
    chosen: list[tuple[int, str, float]] = []
    while len(chosen) < min(k, len(rel)):
        done = [c for _, c, _ in chosen]
        value = {c: rel[c] - (sum(cor.get((c, d), 0.0) for d in done) / len(done) if done else 0.0) for c in rel if c not in done}
        best = min(value, key=lambda c: (-value[c], c))
        chosen.append((len(chosen) + 1, best, float(value[best])))
    return relevance.sparkSession.createDataFrame(chosen, "rank int, column string, score double")


def rank_of(df: DataFrame, score: str, id_col: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), id_col)))


def _shuffled(df: DataFrame, id_col: str, column: str, buckets: int, seed: int) -> DataFrame:
    """df with the values of a column dealt anew within buckets of rows by the hash of the id: a row gets that of the next row in a second order, so every value is used once and no task sorts the whole table."""
    b = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(buckets))
    own = df.withColumn("_b", b)
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(id_col, F.lit(seed + 1)), id_col)))
    second = own.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64(id_col, F.lit(seed + 2)), id_col))).select("_b", "_r", F.col(column).alias("_v"))
    return first.join(second, ["_b", "_r"]).withColumn(column, F.col("_v")).drop("_b", "_r", "_v")


def permutation_importance_oof(df: DataFrame, id_col: str, label: str, columns: Sequence[str], folds: int = 3, buckets: int = 64, seed: int = 42) -> DataFrame:
    """(column, importance): loss of the area under the curve, out of fold, when a column's values are dealt anew among the rows that a model hasn't seen."""
    d = _kept(df.where(F.col(label).isNotNull()).withColumn("_f", fold_of(id_col, folds, seed)).withColumn("label", F.col(label).cast("double")).dropna(subset=list(columns)), [id_col, "_f", "label", *columns])
    total: dict[str, list[float]] = {c: [] for c in columns}
    for k in range(folds):
        model = LogisticRegression(maxIter=30).fit(assembled(d.where(F.col("_f") != k), columns, False))
        held = d.where(F.col("_f") == k)
        score = lambda x: auc(model.transform(assembled(x, columns, False)).select("label", vector_to_array("probability").getItem(1).alias("score")), "label", "score").first().auc or 0.5  # noqa: B023, E731
        base = score(held)
        for j, c in enumerate(columns):
            total[c].append(base - score(_shuffled(held, id_col, c, buckets, seed + 10 * j)))
    drop_step(d)
    return df.sparkSession.createDataFrame([(c, round(sum(v) / len(v), 5)) for c, v in total.items()], "column string, importance double")


def null_target_importance(df: DataFrame, id_col: str, label: str, columns: Sequence[str], n: int = 5, buckets: int = 64, trees: int = 20, seed: int = 42) -> DataFrame:
    """(column, real, null_p95, above_noise): impurity importance against that for targets dealt anew n times."""
    d = _kept(df.where(F.col(label).isNotNull()).dropna(subset=list(columns)), [id_col, label, *columns])
    fit = lambda x, k: RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=5, seed=seed + k).fit(assembled(x, columns, False)).featureImportances.toArray()
    real = fit(d, 0)
    null = np.percentile(np.array([fit(_shuffled(d, id_col, label, buckets, seed + 10 * (k + 1)), k + 1) for k in range(n)]), 95, axis=0)
    drop_step(d)
    return df.sparkSession.createDataFrame([(c, round(float(real[j]), 5), round(float(null[j]), 5), bool(real[j] > null[j])) for j, c in enumerate(columns)], "column string, real double, null_p95 double, above_noise boolean")


def rfe_select(df: DataFrame, label: str, columns: Sequence[str], n_features: int, seed: int = 42) -> DataFrame:
    """(column, ranking, selected): the least important column leaves, the model is fitted again, until n_features are left (ranking 1)."""
    d, left, rank = _kept(df.where(F.col(label).isNotNull()).dropna(subset=list(columns)), [label, *columns]), list(columns), {}
    while len(left) > n_features:
        w = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=20, maxDepth=5, seed=seed).fit(assembled(d, left, False)).featureImportances.toArray()
        worst = left[int(np.argmin(w))]
        rank[worst] = len(left) - n_features + 1
        left.remove(worst)
    drop_step(d)
    return df.sparkSession.createDataFrame([(c, rank.get(c, 1), c in left) for c in columns], "column string, ranking int, selected boolean")


def anomalous_clusters(df: DataFrame, id_col: str, columns: Sequence[str], least: int = 1, most_groups: int = 50, most_rounds: int = 100) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(groups, centres, scaled rows): clusters extracted one by one. The row farthest from the grand mean is a seed; rows nearer to it than to the grand mean are its members, and their mean the new seed, until nothing changes; then they leave.
    Columns are centred and divided by their range. groups: (order, size, contribution, is_kept); kept are those of more than `least` rows, and centres are theirs.

    Each round is one pass of sums over plain columns. The rows that are left when a group has gone are written anew, so that a pass reads no more than these."""
    m = df.dropna(subset=list(columns)).agg(*[f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("a", F.min), ("z", F.max))], F.count("*").alias("n")).first()
    names = [f"_v{i}" for i in range(len(columns))]
    square = lambda parts: sum((p * p for p in parts), F.lit(0.0))
    to = lambda c: square([F.col(v) - F.lit(float(e)) for v, e in zip(names, c, strict=True)])
    x = df.dropna(subset=list(columns)).select(id_col, *[((F.col(c).cast("double") - m[f"m_{i}"]) / ((m[f"z_{i}"] - m[f"a_{i}"]) or 1.0)).alias(names[i]) for i, c in enumerate(columns)])
    x = cut_lineage(x.withColumn("_d", square([F.col(v) for v in names])))
    scatter = x.agg(F.sum("_d")).first()[0] or 0.0
    if scatter <= 0:
        raise ValueError("all rows coincide")
    groups, centres, left = [], [], x
    while len(groups) < most_groups:
        far = left.orderBy(F.desc("_d"), id_col).limit(1).collect()
        if not far:
            break
        c, n, alone = np.array([far[0][v] for v in names]), None, False
        for _ in range(most_rounds):
            s = left.where(to(c) < F.col("_d")).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in names]).first()
            if not s.n:
                # a seed at the grand mean has nobody nearer
                n, mean, alone = 1, np.array([far[0][v] for v in names]), True
                break
            mean, same = np.array([s[v] for v in names]) / s.n, s.n == n
            n = s.n
            if same and np.allclose(mean, c, atol=1e-12):
                break
            c = mean
        groups.append((len(groups), n, round(n * float((mean**2).sum()) / scatter, 4), n > least))
        if n > least:
            centres.append(mean)
        rest = cut_lineage(left.where(F.col(id_col) != far[0][id_col]) if alone or n == 1 else left.where(~(to(c) < F.col("_d"))))
        if left is not x:
            drop_step(left)
        left = rest
    if left is not x:
        drop_step(left)
    return df.sparkSession.createDataFrame(groups, "`order` int, size long, contribution double, is_kept boolean"), np.array(centres), x.select(id_col, F.array(*names).alias("v"), "_d", *names)


def ik_means(df: DataFrame, id_col: str, columns: Sequence[str], least: int = 1, rounds: int = 20) -> DataFrame:
    """(id, cluster): k-means from the centres of the anomalous clusters, as many as were kept; ties go to the first."""
    _, c, x = anomalous_clusters(df, id_col, columns, least)
    if not len(c):
        raise ValueError("no group has more than `least` rows")
    names = [f"_v{i}" for i in range(len(columns))]

    def nearest(c: np.ndarray):
        d = F.array(*[sum(((F.col(v) - F.lit(float(e))) * (F.col(v) - F.lit(float(e))) for v, e in zip(names, q, strict=True)), F.lit(0.0)) for q in c])
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    for _ in range(rounds):
        s = x.groupBy(nearest(c).alias("k")).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in names]).collect()  # a row a cluster
        new = c.copy()
        for r in s:
            new[r.k] = [r[v] for v in names]
        done, c = np.allclose(new, c, atol=1e-12), new
        if done:
            break
    return x.select(id_col, nearest(c).alias("cluster"))
