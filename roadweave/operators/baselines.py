"""Tabular baselines by name: logistic regression of pyspark.ml, and own dense networks and forests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators import forest, mlp


def prepare(rows: DataFrame, features_col: str = "features", label_col: str = "y", balanced: bool = False) -> DataFrame:
    """Vector column ``__x``, label ``__y`` and weight ``__w`` (n / (classes x class size) if balanced)."""
    out = rows.withColumn("__x", array_to_vector(F.col(features_col).cast("array<double>"))).withColumn("__y", F.col(label_col).cast("long").cast("double"))
    if not balanced:
        return out.withColumn("__w", F.lit(1.0))
    sizes = {r["__y"]: r["n"] for r in out.groupBy("__y").agg(F.count("*").alias("n")).collect()}  # one row per class
    n = sum(sizes.values())
    weight = F.create_map(*(F.lit(x) for y, c in sizes.items() for x in (y, n / (len(sizes) * c))))
    return out.withColumn("__w", weight[F.col("__y")])


class _Baseline:
    """fit(rows) then predict(rows): columns prediction (long) and probability (array)."""

    features_col = "features"
    label_col = "y"
    model: Model | None = None
    balanced = False

    def estimator(self, train: DataFrame):
        raise NotImplementedError

    def fit(self, rows: DataFrame) -> _Baseline:
        train = prepare(rows, self.features_col, self.label_col, self.balanced)
        self.model = self.estimator(train).fit(train)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("the model isn't fitted")
        scored = self.model.transform(rows.withColumn("__x", array_to_vector(F.col(self.features_col).cast("array<double>"))))
        return scored.select(*rows.columns, F.col("prediction").cast("long").alias("prediction"), vector_to_array("probability").alias("probability"))


@dataclass
class MajorityClass(_Baseline):
    """The most frequent label, the smallest of equals; probability 1 for it."""

    majority: int | None = None
    classes: list[int] | None = None

    def fit(self, rows: DataFrame) -> MajorityClass:
        counts = rows.groupBy(F.col(self.label_col).cast("long").alias("y")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "y").collect()  # one row per class
        if not counts:
            raise ValueError("no rows to fit on")
        self.majority, self.classes = counts[0]["y"], sorted(r["y"] for r in counts)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.majority is None:
            raise RuntimeError("the model isn't fitted")
        hot = F.array(*(F.lit(float(c == self.majority)) for c in self.classes))
        return rows.select("*", F.lit(self.majority).cast("long").alias("prediction"), hot.alias("probability"))


@dataclass
class LogisticBaseline(_Baseline):
    C: float = 1.0
    max_iter: int = 1000
    balanced: bool = True

    def estimator(self, train: DataFrame):
        total = train.agg(F.sum("__w")).first()[0] or 1.0
        return LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=self.max_iter, regParam=1.0 / (self.C * total), elasticNetParam=0.0, standardization=False)


def _likeliest(rows: DataFrame, columns: list[str], classes: list[int]) -> DataFrame:
    """The first class with the greatest probability, beside the columns."""
    first = F.array_position("probability", F.array_max("probability")).cast("int")
    return rows.select(*columns, F.get(F.array(*map(F.lit, classes)), first - 1).cast("long").alias("prediction"), "probability")


@dataclass
class RandomForestBaseline(_Baseline):
    """Trees down to pure leaves unless limited."""

    n_estimators: int = 200
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    balanced: bool = True
    seed: int = 42
    forest: forest.Forest | None = None

    def fit(self, rows: DataFrame) -> RandomForestBaseline:
        options = forest.Options(self.n_estimators, self.max_depth, self.min_samples_split, self.min_samples_leaf, seed=self.seed)
        self.forest = forest.train(rows, options, self.features_col, self.label_col, self.balanced)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.forest is None:
            raise RuntimeError("the model isn't fitted")
        return _likeliest(forest.probability(self.forest, rows, self.features_col), rows.columns, self.forest.classes)


@dataclass
class MLPBaseline(_Baseline):
    """ReLU units, Adam, L2 and early stopping on a held-out tenth."""

    hidden: tuple[int, ...] = (128, 64, 32)
    alpha: float = 1e-4
    rate: float | None = None
    max_iter: int = 500
    held_out: float = 0.1
    tol: float = 1e-4
    patience: int = 10
    seed: int = 42
    trained: mlp.Trained | None = None

    def fit(self, rows: DataFrame) -> MLPBaseline:
        options = {k: getattr(self, k) for k in ("hidden", "alpha", "rate", "max_iter", "held_out", "tol", "patience", "seed")}
        self.trained = mlp.train(rows, features_col=self.features_col, label_col=self.label_col, **options)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.trained is None:
            raise RuntimeError("the model isn't fitted")
        net = self.trained.net
        return _likeliest(rows.withColumn("probability", net.probability(F.col(self.features_col))), rows.columns, net.classes)


REGISTRY = {"majority": MajorityClass, "logistic": LogisticBaseline, "random_forest": RandomForestBaseline, "mlp": MLPBaseline}


def get_baseline(name: str, **options) -> _Baseline:
    if name not in REGISTRY:
        raise ValueError(f"unknown baseline {name!r}; available: {sorted(REGISTRY)}")
    return REGISTRY[name](**options)
