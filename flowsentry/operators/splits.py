"""Splits, sampling and concatenation.

Membership is decided by a keyed hash order, so a split is reproducible,
independent of partitioning, and checkable against plain SQL.  Split sizes
come from per-class counts read off the hash-bucket histogram; the hash value
at each cut is found exactly from the few boundary buckets
(``rank.hash_cuts``), and every row is then labelled by comparing its hash
with those thresholds: a narrow projection, no shuffle of the table.
"""

from __future__ import annotations

import logging
import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c
from .rank import cut_label, hash_cuts, key_at_or_below, order_cuts

log = logging.getLogger(__name__)

LABEL = "Label"
SEED = 42


def class_counts(df: DataFrame, label: str = LABEL) -> dict:
    """Rows per class (one small aggregate; NULL labels are not counted)."""
    rows = df.filter(c(label).isNotNull()).groupBy(c(label).alias("y")).count().collect()
    return {r["y"]: int(r["count"]) for r in rows}


def novelty_counts(n: int, train_size: float, val_ratio: float) -> tuple[int, int, int]:
    """(train, val, test) for one class, with the floating-point rounding of the spec."""
    temp = math.ceil((1.0 - train_size) * n)
    test = math.ceil((1.0 - val_ratio) * temp)
    return n - temp, temp - test, test


def novelty_split(df: DataFrame, key_cols: Sequence[str], label: str = LABEL,
                  train_size: float = 0.6, val_ratio: float = 0.25,
                  seed: int = SEED) -> DataFrame:
    """train = normals only; val/test hold both classes; 60 % of outliers dropped."""
    def cuts(counts):
        out = {}
        for y in (0, 1):
            if y in counts:
                tr, va, _ = novelty_counts(counts[y], train_size, val_ratio)
                out[y] = [tr, tr + va]
        return out
    d, _, th = hash_cuts(df.filter(c(label).isin(0, 1)), key_cols, seed, "split", [label],
                         cuts)
    names = {0: ["train", "val", "test"], 1: ["_drop", "val", "test"]}
    out = d.withColumn("split", cut_label([label], th, names))
    return out.filter(F.col("split") != "_drop").drop("_h")


def largest_remainder(total: int, counts: dict) -> dict:
    """Integer allocation of ``total`` proportional to ``counts``: floors, then
    one more to the largest remainders (ties to the smaller label)."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    base = {k: (total * v) // n for k, v in counts.items()}
    left = total - sum(base.values())
    order = sorted(counts, key=lambda k: (-((total * counts[k]) % n), k))
    for k in order[:left]:
        base[k] += 1
    return base


def stratified_counts(counts: dict, train_size: float, val_ratio: float) -> dict:
    n = sum(counts.values())
    n_train = math.floor(train_size * n)
    train = largest_remainder(n_train, counts)
    temp = {k: counts[k] - train[k] for k in counts}
    n_test = math.ceil((1.0 - val_ratio) * sum(temp.values()))
    test = largest_remainder(n_test, temp)
    return {k: (train[k], temp[k] - test[k], test[k]) for k in counts}


def stratified_split(df: DataFrame, key_cols: Sequence[str], label: str = LABEL,
                     train_size: float = 0.6, val_ratio: float = 0.25,
                     seed: int = SEED) -> DataFrame:
    """Every class in every split, per-class sizes by largest remainder."""
    def cuts(counts):
        alloc = stratified_counts(counts, train_size, val_ratio)
        return {y: [tr, tr + va] for y, (tr, va, te) in alloc.items()}
    d, _, th = hash_cuts(df.filter(c(label).isNotNull()), key_cols, seed, "split", [label],
                         cuts)
    return d.withColumn("split", cut_label([label], th, ["train", "val", "test"])).drop("_h")


def positional_counts(n: int, train_size: float, val_ratio: float) -> tuple[int, int]:
    n_train = int(n * train_size)
    temp = n - n_train
    n_test = int(temp * (1.0 - val_ratio))
    return n_train, n_train + (temp - n_test)


def positional_split(df: DataFrame, order_cols: Sequence[str], label: str = LABEL,
                     train_size: float = 0.6, val_ratio: float = 0.25) -> DataFrame:
    """Order kept; train first, then val, test last.  ``order_cols`` must be unique."""
    n = df.count()
    train_end, val_end = positional_counts(n, train_size, val_ratio)
    t_train, t_val = order_cuts(df, order_cols, [train_end, val_end], n)
    split = (F.when(key_at_or_below(order_cols, t_train), "train")
             .when(key_at_or_below(order_cols, t_val), "val").otherwise("test"))
    return df.withColumn("split", split)


def single_class_splits(split_df: DataFrame, label: str = LABEL) -> DataFrame:
    """Splits with fewer than two classes (each warns)."""
    prof = split_df.groupBy("split").agg(F.count_distinct(c(label)).alias("n_classes"))
    bad = prof.filter(F.col("n_classes") < 2)
    return bad


def contamination(train: DataFrame, target: float | None, key_cols: Sequence[str],
                  label: str = LABEL, seed: int = SEED) -> DataFrame:
    """Keep normals, keep min(int(c·n0/(1−c)), n1) hash-chosen attacks."""
    if target is None:
        return train
    n0 = train.filter(c(label) == 0).count()

    def cuts(counts):
        n1 = counts.get((), 0)
        need = int((target * n0) / (1 - target))
        if need > n1:
            log.warning("contamination %.3f needs %d attacks, only %d available",
                        target, need, n1)
            need = n1
        return {(): [need]}
    d, _, th = hash_cuts(train.filter(c(label) == 1), key_cols, seed, "contamination", [], cuts)
    attacks = d.filter(cut_label([], th, ["in", "out"]) == "in").drop("_h")
    return train.filter(c(label) == 0).unionByName(attacks)


def sample_n(df: DataFrame, n: int | None, key_cols: Sequence[str], purpose: str = "sample",
             seed: int = SEED, group_cols: Sequence[str] = ()) -> DataFrame:
    """≤ n hash-chosen rows (per group when ``group_cols``)."""
    if n is None:
        return df
    d, _, th = hash_cuts(df, key_cols, seed, purpose, list(group_cols),
                         lambda counts: {g: [int(n)] for g in counts})
    return d.filter(cut_label(list(group_cols), th, ["in", "out"]) == "in").drop("_h")


def fewshot_split(df: DataFrame, cls: int, ratio: float, key_cols: Sequence[str],
                  label: str = LABEL, seed: int = SEED) -> DataFrame:
    """X7 (cls=0) / X8 (cls=1): n = max(1, int(n_cls·ratio)) rows of ``cls`` → ``few``;
    every other row → ``holdout``."""
    d, _, th = hash_cuts(df.filter(c(label) == cls), key_cols, seed, "fewshot", [],
                         lambda counts: {(): [max(1, int(counts.get((), 0) * ratio))]})
    few = d.withColumn("part", cut_label([], th, ["few", "holdout"])).drop("_h")
    rest = df.filter(~(c(label) == cls) | c(label).isNull()).withColumn("part", F.lit("holdout"))
    return few.unionByName(rest)


def append(train: DataFrame, extra: DataFrame) -> DataFrame:
    """Stack rows (by column name)."""
    return train.unionByName(extra, allowMissingColumns=False)
