"""Comparing models: splits, feature sets and models in a grid, next-year panels, spatial holdout, and what models weigh."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bool_int
from ..operators.contracts import disjoint
from ..operators.stats import classification_metrics
from .learning import SPLITS, fit_boosted, fit_forest, fit_logistic, imputed, majority, panel, predict, spatial_split, temporal_split

Fit = Callable[..., PipelineModel]
MODELS: dict[str, Fit] = {"logistic": fit_logistic, "forest": fit_forest, "boosted": fit_boosted}
#: Forward-chaining steps, each trained on earlier transitions than it is tested on, by the name of the split.
CHAIN = ("robustness", "primary", "extended")
#: Models that are fitted at once.
AT_ONCE = 8
PANEL_NUMERIC = ("detections_Y", "active_days_Y")


def joined_features(features: DataFrame, extra: DataFrame, dates: DataFrame, value: str, computable: str, key: str = "event_id") -> DataFrame:
    """Features with one more, and the start date of each event. Where the new feature can't be computed it is 0.0, and its flag,
    which always travels with it, is false."""
    more = extra.select(F.col(key).alias("_x"), F.coalesce(F.col(computable), F.lit(False)).alias(computable), F.col(value).cast("double").alias("_v"))
    starts = dates.select(F.col(key).alias("_d"), "start_date")
    base = features.drop(value, computable, "start_date")
    joined = base.join(more, F.col(key) == F.col("_x")).join(starts, F.col(key) == F.col("_d"))
    return joined.select(*base.columns, "start_date", F.when(F.col(computable), F.col("_v")).otherwise(0.0).alias(value), computable)


def halves(rows: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a split method: `temporal` or `spatial`."""
    if method == "temporal":
        marked, column = temporal_split(rows), "split"
    elif method == "spatial":
        marked, column = spatial_split(rows), "assignment"
    else:
        raise ValueError(f"no such split: {method}")
    return marked.filter(F.col(column) == "train"), marked.filter(F.col(column) == "test")


def _at_once(tasks: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """The tasks' results in their order, AT_ONCE tasks at a time: a fit is a long row of small jobs, which leave room for others'."""
    with ThreadPool(min(AT_ONCE, max(1, len(tasks)))) as pool:
        return pool.map(lambda run: run(), [inheritable_thread_target(t) for t in tasks], chunksize=1)


def _judged(train: DataFrame, test: DataFrame, label: str, numeric: list[str], categorical: list[str], models: dict[str, Fit]) -> list[Callable[[], DataFrame]]:
    """For the majority class and each model what fits it and gives its metrics."""

    def plain() -> DataFrame:
        return classification_metrics(test.withColumn("predicted_class", F.lit(majority(train, label))), label, "predicted_class").withColumn("model", F.lit("majority"))

    def one(name: str, fit: Fit) -> DataFrame:
        scored = predict(fit(train, label, numeric, categorical), test, label)
        return classification_metrics(scored, label, "predicted_class").withColumn("model", F.lit(name))

    return [plain, *(partial(one, name, fit) for name, fit in models.items())]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scores(train: DataFrame, test: DataFrame, label: str, numeric: list[str], categorical: list[str], models: dict[str, Fit]) -> DataFrame:
    """(model, class, precision, recall, f1, support, accuracy) of the majority class and each model, fitted on train only."""
    return _union(_at_once(_judged(train, test, label, numeric, categorical, models)))


def run_grid(rows: DataFrame, label: str, sets: dict[str, tuple[list[str], list[str]]], methods: tuple[str, ...] = ("temporal", "spatial"), models: dict[str, Fit] = MODELS, forbidden: set[str] = frozenset()) -> DataFrame:
    """The long table of all feature sets, splits and models, with one configuration for each model throughout. Fits run AT_ONCE at a time."""
    tasks, marks = [], []
    for method in methods:
        train, test = halves(rows, method)
        for name, (numeric, categorical) in sets.items():
            disjoint([*numeric, *categorical], set(forbidden) | {label})
            own = _judged(train, test, label, numeric, categorical, models)
            tasks, marks = tasks + own, marks + [{"feature_set": F.lit(name), "split": F.lit(method)}] * len(own)
    return _union([found.withColumns(mark) for found, mark in zip(_at_once(tasks), marks, strict=True)])


def spatial_holdout(rows: DataFrame, label: str, numeric: list[str], categorical: list[str] = (), fit: Fit = fit_boosted) -> DataFrame:
    """Metrics of one model on the checkerboard split."""
    train, test = halves(rows, "spatial")
    return classification_metrics(predict(fit(train, label, numeric, list(categorical)), test, label), label, "predicted_class")


def next_year(rows: DataFrame, statics: tuple[str, ...] = (), splits: dict = SPLITS, models: dict[str, Fit] | None = None) -> DataFrame:
    """Metrics of every split of the next-year panel. Transitions of train and test must be apart."""
    models = {"logistic": fit_logistic, "forest": fit_forest} if models is None else models
    out = None
    for name, (before, after) in splits.items():
        disjoint([f"{a}-{b}" for a, b in before], {f"{a}-{b}" for a, b in after})
        train, test = (panel(rows, t, statics).withColumn("outcome", F.col("target").cast("string")) for t in (before, after))
        one = scores(train, test, "outcome", [*PANEL_NUMERIC, *statics], [], models).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def feature_names(model: PipelineModel, column: str = "features") -> list[str]:
    """Names of the places of a model's feature vector, read from its stages, so a loaded model has them too: numbers by column, then
    `column=category` in the order of the indexer."""
    names: dict[str, list[str]] = {}
    for stage in model.stages:
        kind = stage.__class__.__name__
        if kind == "StringIndexerModel":
            names[stage.getOutputCol()] = [f"{stage.getInputCol()}={v or '(none)'}" for v in stage.labelsArray[0]]
        elif kind in ("OneHotEncoderModel", "StandardScalerModel"):
            ins, outs = ([stage.getInputCol()], [stage.getOutputCol()]) if stage.hasParam("inputCol") and stage.isDefined("inputCol") else (stage.getInputCols(), stage.getOutputCols())
            names |= {o: names[i] for i, o in zip(ins, outs, strict=True)}
        elif kind == "VectorAssembler":
            names[stage.getOutputCol()] = [n for c in stage.getInputCols() for n in names.get(c, [c])]
    return names[column]


def weights(model: PipelineModel) -> DataFrame:
    """(class, feature, weight, rank): coefficients of a logistic model (a row for each class; `positive` for two), a forest's
    importances, or how many splits of boosted trees each feature makes, ranked by size."""
    from pyspark.sql import SparkSession

    last, names = model.stages[-1], feature_names(model)
    if hasattr(last, "featureImportances"):
        held = last.featureImportances
        rows = [("all", n, float(w)) for n, w in zip(names, held.toArray() if hasattr(held, "toArray") else held, strict=False)]
    else:
        table, labels = last.coefficientMatrix.toArray(), model.stages[0].labels
        classes = labels if len(table) == len(labels) else ["positive"] if len(table) == 1 else [*labels, *(f"other-{k}" for k in range(len(table) - len(labels)))]
        rows = [(c, n, float(w)) for c, line in zip(classes, table, strict=True) for n, w in zip(names, line, strict=False)]
    ranked = []
    for c in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-abs(r[2]), r[1]))
        ranked += [(*r, k + 1) for k, r in enumerate(own)]
    return SparkSession.active().createDataFrame(ranked, "class string, feature string, weight double, rank int")


#: The columns of a cluster's row that describe it for learning, by what they measure.
INCLUDED = {
    "unique_years": "persistence", "occurrence_rate": "persistence", "total_detections_5yr": "activity", "mean_frp": "activity", "frp_ratio": "activity", "trend_slope": "trend", "cv_annual_detections": "trend",
    "top3_months_share": "seasonality", "top3_days_share": "seasonality", "night_fraction": "seasonality", "centroid_lat": "place", "centroid_lon": "place", "extent_radius_m": "place",
    "n_industrial": "context", "n_power": "context", "n_waste": "context", "n_agricultural": "context", "n_transport": "context", "n_other": "context", "features_found_in_radius": "context",
    "nearest_distance_m": "context", "nearest_is_named": "context",
}


def feature_matrix(rows: DataFrame, key: str = "cluster_id", included: dict[str, str] = INCLUDED) -> DataFrame:
    """(key, ...included columns as numbers, features): one row for each cluster. A missing distance is the search radius, which is known
    to hold nothing nearer; a flag is 0 or 1. The vector's places carry the columns' names (`place_names`)."""
    whole = imputed(rows) if "nearest_distance_m" in included else rows
    number = lambda c: bool_int(F.col(c)).cast("double") if dict(rows.dtypes)[c] == "boolean" else F.col(c).cast("double")
    named = whole.select(key, *(number(c).alias(c) for c in included))
    return VectorAssembler(inputCols=list(included), outputCol="features", handleInvalid="error").transform(named)


def place_names(df: DataFrame, column: str = "features") -> list[str]:
    """The names that a vector column's places carry in its schema."""
    attributes = df.schema[column].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for kind in attributes.values() for a in kind), key=lambda a: a["idx"])]


def feature_inventory(df: DataFrame, included: dict[str, str], excluded: dict[str, tuple[str, str]]) -> DataFrame:
    """(column, included, category, reason): every column of a table as declared; a column that isn't declared raises."""
    from ..operators.contracts import inventoried

    inventoried(df.columns, list(included), list(excluded))
    rows = [(c, True, kind, None) for c, kind in included.items()] + [(c, False, kind, why) for c, (kind, why) in excluded.items()]
    return df.sparkSession.createDataFrame(rows, "column string, included boolean, category string, reason string")
