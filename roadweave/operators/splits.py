"""Leakage-safe splits and label summaries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def group_of(samples: DataFrame, group_key: str, id_col: str) -> Column:
    """The group key, else the video, else the site, else a group of its own."""
    names = [n for n in dict.fromkeys([group_key, "video_id", "site_id"]) if n in samples.columns]
    filled = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names]
    return F.coalesce(*filled, F.concat(F.lit("ungrouped_"), F.col(id_col).cast("string")))


def grouped_split(samples: DataFrame, id_col: str, group_key: str = "site_id", val_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: all rows of a group are train or all are val, ceil(val_frac x groups) groups in val.

    Groups are ranked by a seeded hash; only the cut is computed apart, by an ordered limit. With
    fewer than two groups the last rows by id are val (at least one of each if there are two rows).
    """
    grouped = samples.withColumn("__group", group_of(samples, group_key, id_col))
    groups = grouped.select("__group").distinct().withColumn("__h", F.xxhash64("__group", F.lit(seed)))
    k = groups.count()
    if k < 2:
        n = samples.count()
        train = min(max(1, round(n * (1 - val_frac))), max(n - 1, 1))
        head = samples.select(F.col(id_col).alias("__id")).orderBy("__id").limit(train).withColumn("__train", F.lit(True))
        return samples.join(head, samples[id_col] == head["__id"], "left").withColumn("split", F.when(F.col("__train"), "train").otherwise("val")).drop("__id", "__train")
    val = groups.orderBy("__h", "__group").limit(max(1, math.ceil(k * val_frac))).select("__group").withColumn("__val", F.lit(True))
    return grouped.join(val, "__group", "left").withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__group", "__val")


def seeded_group_split(groups: list[str], val_frac: float, seed: int) -> set[str]:
    """Validation groups of a short list by a seeded NumPy permutation, as the usual group shuffle split draws them."""
    names = sorted(set(groups))
    return {names[i] for i in np.random.RandomState(seed).permutation(len(names))[: max(1, math.ceil(len(names) * val_frac))]}


def label_summary(samples: DataFrame, label_col: str = "label", site_col: str = "site_id") -> DataFrame:
    y = F.col(label_col).cast("int")
    return samples.agg(F.count("*").alias("n"), F.count(F.when(y == 1, 1)).alias("positives"), F.count(F.when(y == 0, 1)).alias("negatives"), F.array_sort(F.collect_set(site_col)).alias("sites"))
