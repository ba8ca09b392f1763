"""Clustering operators: robust scaling, Ward linkage, silhouette, agreement of partitions, stability, model choice."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import staged


def robust_scale(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """columns less their median, by their interquartile range (1 where that is 0), within groups; exact quantiles."""
    q = lambda c, p: F.percentile(c, p)
    stats = df.groupBy(*by).agg(*[F.struct(q(c, 0.5).alias("m"), (q(c, 0.75) - q(c, 0.25)).alias("r")).alias(f"_{c}") for c in columns])
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"_{c}.m")) / F.when(F.col(f"_{c}.r") > 0, F.col(f"_{c}.r")).otherwise(1.0) for c in columns}
    return df.join(stats, by).withColumns(scaled).drop(*[f"_{c}" for c in columns])


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by Ward's criterion: Lance-Williams updates of squared distances, ties to the first pair."""
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    size, group, alive = np.ones(n), np.arange(n), np.ones(n, dtype=bool)
    for _ in range(n - k):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        a, b, c = size[i], size[j], size
        new = ((a + c) * d[i] + (b + c) * d[j] - c * d[i, j]) / (a + b + c)
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j], alive[j] = np.inf, np.inf, False
        d[i, ~alive] = d[~alive, i] = np.inf
        size[i] += size[j]
        group[group == j] = i
    return np.unique(group, return_inverse=True)[1]


def ward_line(x: np.ndarray, k: int) -> np.ndarray:
    """ward's labels for one column x, in n log n and without a matrix.

    On a line only neighbours can be nearest: for a < b < c the distance of a and c is larger than the least of the others,
    unless that is 0. So equal values join first, then a heap holds neighbours by distance, ties to the first pair as in ward.
    """
    values, first, at, counts = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
    n, m = len(x), len(values)
    group = first[at]
    if m <= k:  # ward ends amid equal values: the last pairs stay apart
        copies = np.setdiff1d(np.arange(n), first)
        alone = copies[np.lexsort((copies, group[copies]))][n - k :]
        group[alone] = alone
        return np.unique(group, return_inverse=True)[1]
    size, total, least = counts.tolist(), (values * counts).tolist(), first.tolist()
    before, after, age = list(range(-1, m - 1)), [*range(1, m), -1], [0] * m

    def pair(a: int, b: int) -> tuple:
        p, q = size[a], size[b]
        i, j = sorted((least[a], least[b]))
        return 2.0 * (total[b] * p - total[a] * q) ** 2 / (p * q * (p + q)), i, j, a, b, age[a], age[b]

    heap = [pair(a, a + 1) for a in range(m - 1)]
    heapq.heapify(heap)
    left = m - k
    while left:
        _, i, _, a, b, old_a, old_b = heapq.heappop(heap)
        if age[a] != old_a or age[b] != old_b:
            continue
        left -= 1
        size[a], total[a], least[a], after[a] = size[a] + size[b], total[a] + total[b], i, after[b]
        age[a], age[b] = age[a] + 1, -1
        if after[a] >= 0:
            before[after[a]] = a
            heapq.heappush(heap, pair(a, after[a]))
        if before[a] >= 0:
            heapq.heappush(heap, pair(before[a], a))
    heads = np.flatnonzero(np.array(age) >= 0)
    run = np.searchsorted(heads, np.arange(m), side="right") - 1
    return np.unique(np.array(least)[heads][run][at], return_inverse=True)[1]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean over all points of (b - a) / max(a, b); 0 for the only member of a cluster."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    ids = np.unique(labels)
    sums = np.stack([d[:, labels == c].sum(1) for c in ids], 1)
    sizes = np.array([(labels == c).sum() for c in ids])
    own = np.searchsorted(ids, labels)
    rows = np.arange(len(x))
    a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[rows, own] = np.inf
    b = means.min(1)
    return float(np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).mean())


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari) of two labellings of the same rows, from the sums over their contingency table; 1 where chance leaves no room."""
    pairs = lambda c: c * (c - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("both"), pairs(F.sum("n")).alias("all"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias(name))
    one = lambda x: x.withColumn("k", F.lit(1))
    t = one(both).join(one(side(a, "left")), "k").join(one(side(b, "right")), "k")
    expected, most = F.col("left") * F.col("right") / F.col("all"), (F.col("left") + F.col("right")) / 2
    return t.select(F.when((F.col("all") == 0) | (most == expected), 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def best_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each label of a its largest Jaccard similarity to a label of b."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    left, right = cells.groupBy(a).agg(F.sum("n").alias("na")), cells.groupBy(b).agg(F.sum("n").alias("nb"))
    return cells.join(left, a).join(right, b).groupBy(a).agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


def _ari(a: np.ndarray, b: np.ndarray) -> float:
    pairs = lambda v: (v * (v - 1) / 2).sum()
    table = np.unique(a * (b.max() + 1) + b, return_counts=True)[1]
    left, right, n = pairs(np.unique(a, return_counts=True)[1]), pairs(np.unique(b, return_counts=True)[1]), len(a)
    expected, most = left * right / max(n * (n - 1) / 2, 1), (left + right) / 2
    return 1.0 if n < 2 or most == expected else float((pairs(table) - expected) / (most - expected))


def stability(spark, x: np.ndarray, k: int, rounds: int = 100, share: float = 0.8, seed: int = 20260812) -> DataFrame:
    """(round, ari): agreement of Ward labels of the whole with those of each subsample, drawn in order by one generator and fitted in parallel."""
    rng, n = np.random.default_rng(seed + k), len(x)
    take = max(k + 1, int(round(share * n)))
    draws = [np.sort(rng.choice(n, size=take, replace=False)).tolist() for _ in range(rounds)]
    whole = ward(x, k)

    def fit(batches):
        for b in batches:
            yield pd.DataFrame({"round": b["round"], "ari": [_ari(whole[np.array(i)], ward(x[np.array(i)], k)) for i in b["rows"]]})

    return spark.createDataFrame(list(enumerate(draws)), "round long, rows array<long>").repartition(min(rounds, 16)).mapInPandas(fit, "round long, ari double")


def choose(candidates: list[dict]) -> dict | None:
    """Of the candidates that pass every gate the one of highest silhouette, then fewest clusters; None if none passes."""
    passing = [c for c in candidates if all(c["gates"].values())]
    return max(passing, key=lambda c: (c["silhouette"], -c["k"]), default=None)


def ward_groups(df: DataFrame, key: str, by: str, columns: list[str], k: int) -> DataFrame:
    """(by, key, cluster) with a Ward partition of each group; clusters are numbered by their least key. A group's rows have to fit a task, with several columns their squared number."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x, most = pdf[columns].to_numpy(dtype=float), min(k, len(pdf))
        labels = ward_line(x[:, 0], most) if len(columns) == 1 else ward(x, most)
        order = {c: i for i, c in enumerate(dict.fromkeys(labels.tolist()))}
        return pd.DataFrame({by: pdf[by], key: pdf[key], "cluster": [order[c] for c in labels.tolist()]})

    return df.select(by, key, *columns).groupBy(by).applyInPandas(fit, f"{by} long, {key} long, cluster long")


def profiles(df: DataFrame, key: str, cluster: str, columns: list[str]) -> DataFrame:
    """(cluster, members, median of each column, medoid): the medoid is the member of least summed distance to the others, ties to the least key.

    One column: distances are sums over the members below and above in order, n log n. More: a cluster has to fit a task.
    """
    medians = df.groupBy(cluster).agg(F.count("*").alias("members"), *[F.percentile(c, 0.5).alias(f"{c}_median") for c in columns])
    if len(columns) == 1:
        x, w = F.col(columns[0]).cast("double"), W.partitionBy(cluster).orderBy(F.col(columns[0]).cast("double"), key)
        upto, n, total = F.sum(x).over(w.rowsBetween(W.unboundedPreceding, 0)), F.count("*").over(W.partitionBy(cluster)), F.sum(x).over(W.partitionBy(cluster))
        i = F.row_number().over(w)
        sums = df.select(cluster, key, (x * (2 * i - n) - 2 * upto + total).alias("sum"))
        medoid = sums.groupBy(cluster).agg(F.min_by(key, F.struct(F.round("sum", 6), key)).alias("medoid"))
    else:

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key)
            v = pdf[columns].to_numpy(dtype=float)
            sums = np.array([np.sqrt(((v - row) ** 2).sum(1)).sum() for row in v])
            return pd.DataFrame({cluster: pdf[cluster].iloc[:1], "medoid": pdf[key].iloc[[int(np.argmin(sums.round(9)))]].to_numpy()})

        types = dict(df.dtypes)
        medoid = df.select(cluster, key, *columns).groupBy(cluster).applyInPandas(fit, f"{cluster} {types[cluster]}, medoid {types[key]}")
    return medians.join(medoid, cluster)


def names(told: DataFrame, cluster: str, hub: str, remote: str, aged: str) -> DataFrame:
    """told with a name: of all the highest in hub, of the rest the highest in remote, of the rest the highest in aged, then by number; ties to the least cluster."""
    out = told.withColumn("name", F.lit(None).cast("string"))
    for column, name in ((hub, "hub"), (remote, "remote"), (aged, "aged")):
        first = out.where("name is null").agg(F.max_by(cluster, F.struct(column, -F.col(cluster))).alias("_first"))
        out = out.join(F.broadcast(first), F.col(cluster) == F.col("_first"), "left").withColumn("name", F.coalesce("name", F.when(F.col("_first").isNotNull(), name))).drop("_first")
    return out.withColumn("name", F.coalesce("name", F.concat(F.lit("mixed-"), F.col(cluster).cast("string"))))


def stability_summary(rounds: DataFrame) -> DataFrame:
    """(rounds, median, p10) of the agreement of each round."""
    return rounds.agg(F.count("*").alias("rounds"), F.percentile("ari", 0.5).alias("median"), F.percentile("ari", 0.1).alias("p10"))


def sensitivity(df: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """(ari, least_jaccard): agreement of Ward clusters of the columns with those of their logarithms. All rows have to fit a task, with several columns their squared number."""
    one = df.select(F.lit(0).cast("long").alias("g"), F.col(key).cast("long").alias(key), *columns)
    logs = one.select("g", key, *[(F.signum(c) * F.log1p(F.abs(c))).alias(c) for c in columns])
    a = ward_groups(one, key, "g", columns, k).select(key, F.col("cluster").alias("a"))
    b = ward_groups(logs, key, "g", columns, k).select(key, F.col("cluster").alias("b"))
    both = staged(a.join(b, key), "sensitivity")
    return adjusted_rand(both, "a", "b").join(best_jaccard(both, "a", "b").agg(F.min("jaccard").alias("least_jaccard")).withColumn("one", F.lit(1)), F.lit(1) == F.col("one")).select("ari", "least_jaccard")


def select_model(candidates: DataFrame) -> DataFrame:
    """Of candidates (k, silhouette, gates) that pass all gates the one of highest silhouette, then fewest clusters; a null k if none passes."""
    return candidates.where(F.forall("gates", lambda g: g)).agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"), F.count("*").alias("passing"))
