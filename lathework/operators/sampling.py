"""Seeded samples and group-aware splits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*parts: Column | str, seed: int | Column = 0) -> Column:
    """A repeatable random order: the MD5 of the seed and the parts."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", seed.cast("string"), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def per_class(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each class in the seeded order."""
    order = Window.partitionBy(*by).orderBy(hash_order(key, seed=seed), key)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def strided(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Every k-th row of each class by ``order``, k such that about ``most`` remain at most."""
    w = Window.partitionBy(*by)
    numbered = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(most))).cast("long")
    return numbered.filter(F.col("_i") % stride == 0).drop("_i", "_n")


def proportions(df: DataFrame, by: str, weight: Column | None = None) -> DataFrame:
    """Share of each class; 0 where the total is not positive."""
    rows = df.groupBy(by).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return rows.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def best_of(df: DataFrame, key: str, by: str, size: int, candidates: int, seed: int) -> DataFrame:
    """Of ``candidates`` seeded samples the one whose class shares are nearest to all rows'.

    Nearest: least largest difference, then least sum of differences, then least candidate.
    Returns the candidate's number, differences and keys.
    """
    spark = df.sparkSession
    whole = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    tries = spark.range(candidates).select(F.col("id").cast("int").alias("candidate"))
    ranked = df.select(key, by).crossJoin(F.broadcast(tries))  # a fixed number of seeds
    order = Window.partitionBy("candidate").orderBy(hash_order(key, seed=F.col("candidate") + seed), key)
    taken = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    got = taken.groupBy("candidate", by).agg(F.count(F.lit(1)).alias("got"))
    total = F.sum("n").over(Window.partitionBy("candidate"))
    size_of = F.sum(F.coalesce("got", F.lit(0))).over(Window.partitionBy("candidate"))
    shares = (
        whole.crossJoin(F.broadcast(tries))
        .join(got, ["candidate", by], "left")
        .withColumn("gap", F.abs(F.coalesce("got", F.lit(0)) / size_of - F.col("n") / total))
    )
    scores = shares.groupBy("candidate").agg(F.round(F.max("gap"), 9).alias("max_gap"), F.round(F.sum("gap"), 9).alias("sum_gap"))
    best = scores.agg(F.min(F.struct("max_gap", "sum_gap", "candidate")).alias("b")).select("b.*")
    return taken.join(F.broadcast(best), "candidate").select("candidate", "max_gap", "sum_gap", key, by)  # one row


def assign_groups(sizes: dict[str, np.ndarray], targets: dict[str, float], seed: int = 42, restarts: int = 800, steps: int = 30_000, negatives: bool = False):
    """Split of each group so that shares of rows (entry 0) and classes (the rest) meet the targets.

    With ``negatives`` the last entry counts rows of no class, which weigh less. Errors are relative to the
    targets; a share of rows more than 0.02 off its target costs extra.

    Greedy restarts in seeded orders, then annealing by moves and swaps of groups; the groups are few
    (components of a dataset), so this runs on the driver. Returns {group: split} and the cost.
    """
    if not sizes:
        return {}, 0.0
    rng = np.random.default_rng(seed)
    names, splits = sorted(sizes), list(targets)
    weight = np.array([sizes[g] for g in names], float)
    share = np.array([targets[s] for s in splits])
    whole = np.maximum(weight.sum(axis=0), 1e-12)
    target = weight.sum(axis=0) * share[:, None]
    factor = np.array([8.0] + [1.5] * (weight.shape[1] - 1))
    if negatives:
        factor[-1] = 0.1

    def cost(total):
        gap = (total - target) / np.maximum(target, 1.0)
        beyond = np.maximum(np.abs(total[:, 0] / whole[0] - share) - 0.02, 0)
        return float((gap**2 @ factor).sum() + 500 * (beyond**2).sum())

    best, best_cost = None, math.inf
    for _ in range(restarts):
        order = rng.permutation(len(names))
        order = order[np.argsort(-weight[order, 0], kind="stable")] if rng.random() < 0.5 else order
        total, own = np.zeros((len(splits), weight.shape[1])), np.zeros(len(names), int)
        for g in order:
            room = (share - total[:, 0] / whole[0]) / share
            own[g] = int(room.argmax())
            total[own[g]] += weight[g]
        if (c := cost(total)) < best_cost:
            best, best_cost = own.copy(), c
    own = best.copy()
    total = np.zeros((len(splits), weight.shape[1]))
    np.add.at(total, own, weight)
    now = best_cost
    for k in range(steps):
        heat = 0.03 * (1e-4 / 0.03) ** (k / steps)
        a = rng.integers(len(names))
        b = rng.integers(len(names)) if rng.random() < 0.4 else None
        moved = total.copy()
        to = own[b] if b is not None else int(rng.integers(len(splits)))
        if to == own[a]:
            continue
        moved[own[a]] -= weight[a]
        moved[to] += weight[a]
        if b is not None:
            moved[to] -= weight[b]
            moved[own[a]] += weight[b]
        c = cost(moved)
        if c < now or rng.random() < math.exp(-(c - now) / heat):
            if b is not None:
                own[b] = own[a]
            own[a], total, now = to, moved, c
            if c < best_cost:
                best, best_cost = own.copy(), c
    return {g: splits[int(s)] for g, s in zip(names, best)}, float(best_cost)
