"""Splits, panels and classifiers for events and clusters, on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import imputed_distance
from ..operators.events import global_rank
from ..operators.labels import TRAINED
from ..operators.spatial import nearest_any
from ..operators.stats import classification_metrics
from . import boosting
from .sinks import read_text, write_text
from .storage import stored

SPLIT_DEGREES = 0.5
TRAIN_YEARS, TEST_YEARS = (2019, 2020, 2021, 2022), (2023, 2024, 2025)
VALID_TRANSITIONS = ((2019, 2020), (2020, 2021), (2021, 2022), (2023, 2024), (2024, 2025))
EXCLUDED_TRANSITIONS = ((2022, 2023), (2025, 2026))
SPLITS = {
    "robustness": (((2019, 2020),), ((2020, 2021),)),
    "primary": (((2019, 2020), (2020, 2021)), ((2021, 2022),)),
    "extended": (((2019, 2020), (2020, 2021), (2021, 2022), (2023, 2024)), ((2024, 2025),)),
}
SEED = 42


def spatial_split(df: DataFrame, lat: str = "centroid_lat", lon: str = "centroid_lon", size: float = SPLIT_DEGREES) -> DataFrame:
    """A checkerboard: a cell is train or test as a whole, and labels are never read."""
    row, col = F.floor(F.col(lat) / size).cast("int"), F.floor(F.col(lon) / size).cast("int")
    return df.withColumns({"grid_row": row, "grid_col": col, "assignment": F.when(F.pmod(row + col, F.lit(2)) == 1, "test").otherwise("train")})


def split_report(df: DataFrame, label: str, classes: tuple[str, ...] = TRAINED) -> DataFrame:
    counts = [F.count_if(F.col(label) == c).alias(f"n_{c}") for c in classes]
    return df.groupBy("grid_row", "grid_col", "assignment").agg(*counts, F.count(F.lit(1)).alias("total"))


def temporal_split(df: DataFrame, start: str = "start_date") -> DataFrame:
    """Adds `split`; rows of other years get null, which a caller may treat as an error."""
    y = F.year(start)
    return df.withColumn("split", F.when(y.isin(*TRAIN_YEARS), "train").when(y.isin(*TEST_YEARS), "test"))


def panel(rows: DataFrame, transitions: tuple = VALID_TRANSITIONS, statics: tuple[str, ...] = ()) -> DataFrame:
    """One row for each cluster and transition: counts of the first year, statics, and whether the next year has detections."""
    bad = set(transitions) & set(EXCLUDED_TRANSITIONS)
    if bad:
        raise ValueError(f"excluded transitions: {sorted(bad)}")
    each = F.array(*(F.struct(F.lit(y).alias("year"), F.lit(z).alias("target_year"), F.col(f"detections_{y}").cast("long").alias("detections_Y"), F.col(f"active_days_{y}").cast("long").alias("active_days_Y"), (F.col(f"detections_{z}") > 0).cast("int").alias("target")) for y, z in transitions))
    return rows.select("cluster_id", *statics, F.explode(each).alias("_p")).select("cluster_id", "_p.*", *statics)


def imputed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("nearest_distance_m", imputed_distance(F.col("nearest_distance_m"), F.col("extent_radius_m")))


def nearest_same_class(df: DataFrame, label: str) -> DataFrame:
    """(event_id, label, metres): each test row's distance to the nearest train row of its class; null if the class has none."""
    points = df.select("event_id", label, F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), "assignment")
    parts = []
    for name in sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None):  # a handful of classes
        own = points.filter(F.col(label) == name)
        test, train = own.filter(F.col("assignment") == "test"), own.filter(F.col("assignment") == "train")
        parts.append(test.select("event_id", label).join(nearest_any(test, train, "metres", "event_id"), "event_id", "left"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distance_summary(distances: DataFrame, label: str) -> DataFrame:
    near = F.count_if(F.col("metres") <= 300)
    return distances.groupBy(label).agg(
        F.count("metres").alias("n"), F.round(F.min("metres"), 1).alias("min_m"), F.round(F.percentile("metres", F.lit(0.5)), 1).alias("median_m"), F.round(F.max("metres"), 1).alias("max_m"),
        near.alias("within_300m"), F.round(F.try_divide(near * 100.0, F.count("metres")), 4).alias("pct_within_300m"),
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight`: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total, classes = df.count(), counts.count()
    return df.join(F.broadcast(counts), label).withColumn("weight", F.lit(float(total)) / (F.lit(float(classes)) * F.col("_n"))).drop("_n")  # a row for each class


def preprocess(numeric: list[str], categorical: list[str] = ()) -> list:
    """Stages to `features`: standardised numbers and one-hot categories, unknown ones all zero."""
    stages: list = [VectorAssembler(inputCols=numeric, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"_{c}_at", handleInvalid="keep"), OneHotEncoder(inputCol=f"_{c}_at", outputCol=f"_{c}_hot", handleInvalid="keep")]
    return [*stages, VectorAssembler(inputCols=["_scaled", *(f"_{c}_hot" for c in categorical)], outputCol="features")]


def fit_boosted(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = (), rounds: int = 100, depth: int = 4, leaves: int = 15) -> PipelineModel:
    """Boosted trees for all classes at once, on rows weighted so that classes count the same."""
    prepared = Pipeline(stages=preprocess(numeric, list(categorical))).fit(df)
    rows = balanced_weights(prepared.transform(df), label)
    return PipelineModel(stages=[*prepared.stages, boosting.fit(rows, label, "weight", rounds=rounds, depth=depth, leaves=leaves)])


def save_boosted(model: PipelineModel, path: str) -> None:
    """The preparation, and the trees as JSON beside it."""
    PipelineModel(stages=model.stages[:-1]).write().overwrite().save(f"{path}/prepare")
    write_text(SparkSession.active(), f"{path}/trees.json", model.stages[-1].to_json())


def load_boosted(spark: SparkSession, path: str) -> PipelineModel:
    trees = boosting.SoftmaxBoost.from_json(read_text(spark, f"{path}/trees.json"))
    return PipelineModel(stages=[*PipelineModel.load(f"{path}/prepare").stages, trees])


def _labelled(df: DataFrame, label: str):
    return StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc")


def fit_logistic(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = ()) -> PipelineModel:
    model = LogisticRegression(labelCol="_y", featuresCol="features", weightCol="weight", maxIter=200, regParam=1e-3)
    return Pipeline(stages=[_labelled(df, label), *preprocess(numeric, list(categorical)), model]).fit(balanced_weights(df, label))


def fit_forest(df: DataFrame, label: str, numeric: list[str], categorical: list[str] = (), trees: int = 100, depth: int = 4) -> PipelineModel:
    model = RandomForestClassifier(labelCol="_y", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=SEED)
    return Pipeline(stages=[_labelled(df, label), *preprocess(numeric, list(categorical)), model]).fit(balanced_weights(df, label))


def predict(model: PipelineModel, df: DataFrame, label: str | None = None) -> DataFrame:
    """Adds `predicted_class`; never fits."""
    inputs = df if label is None or label in df.columns else df.withColumn(label, F.lit(""))
    out = model.transform(inputs)
    if "predicted_class" in out.columns:
        return out
    names = F.array(*map(F.lit, model.stages[0].labels))
    return out.withColumn("predicted_class", F.get(names, F.col("prediction").cast("int")))


def majority(df: DataFrame, label: str) -> str | None:
    row = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).first()
    return row[0] if row else None


def permutation_importance(model: PipelineModel, df: DataFrame, label: str, features: list[str], repeats: int = 5, key: str = "event_id") -> DataFrame:
    """(feature, drop): mean fall of macro F1 when a feature's values are dealt anew among rows. Rows are ranked by hashes of their
    key, with another seed for each deal, in two levels, so that no task holds all of them; the deal is the same in every run."""
    macro = lambda d: classification_metrics(predict(model, d, label), label, "predicted_class").filter(F.col("class") == "macro").first()["f1"]

    def ranked(rows: DataFrame, seed: int) -> DataFrame:
        hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_part", F.pmod("_h", F.lit(256)))
        return global_rank(hashed, "_part", ["_h", key], "_row").drop("_h", "_part")

    base, rows = macro(df), []
    own = stored(ranked(df, 0), "evaluation")
    for n, f in enumerate(features):
        drops = []
        for k in range(repeats):
            dealt = ranked(df.select(key, F.col(f).alias("_v")), 1 + n * repeats + k).select("_row", "_v")
            drops.append(base - macro(own.drop(f).join(dealt, "_row").withColumnRenamed("_v", f)))
        rows.append((f, float(sum(drops) / len(drops))))
    return df.sparkSession.createDataFrame(rows, "feature string, drop double").orderBy(F.desc("drop"), "feature")


def kmeans_sweep(df: DataFrame, features: list[str], ks: range = range(2, 9)) -> tuple[DataFrame, dict[int, float]]:
    """Rows with `unsupervised_group` of the smallest k within 0.01 of the best silhouette, and the silhouette of each k.

    Groups are named A, B, ... by falling size, then by the smallest mean of the first feature.
    """
    ready = Pipeline(stages=preprocess(features)).fit(df).transform(df).cache()
    n = ready.count()
    scores, models = {}, {}
    for k in ks:
        if k >= n:
            break
        models[k] = KMeans(k=k, seed=SEED, maxIter=50).fit(ready)
        scores[k] = ClusteringEvaluator().evaluate(models[k].transform(ready))
    if not scores:
        return df.withColumn("unsupervised_group", F.lit("Group A")), {}
    best = max(scores.values())
    chosen = min(k for k, s in scores.items() if s >= best - 0.01)
    placed = models[chosen].transform(ready)
    sizes = placed.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.avg(features[0]).alias("m"))
    names = sizes.select("prediction", F.concat(F.lit("Group "), F.char(F.lit(64) + F.row_number().over(Window.orderBy(F.desc("n"), "m")))).alias("unsupervised_group"))  # k rows
    return placed.join(F.broadcast(names), "prediction").select(*df.columns, "unsupervised_group"), scores


def principal_components(df: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """Rows with pc1..pck of the standardised features; each component's largest loading is positive."""
    ready = Pipeline(stages=preprocess(features)).fit(df).transform(df)
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(ready)
    loads = model.pc.toArray()
    signs = [1.0 if loads[abs(loads[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(ready).withColumn("_a", vector_to_array("_pc"))
    return out.select(*df.columns, *((F.col("_a")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)))


#: Rows that one task groups: distances to all live rows are computed from centres, so memory grows with rows only.
MOST_WARD_ROWS = 20_000


def ward_merges(x) -> list[tuple[int, int, float, int]]:
    """(a, b, height, size) of Ward's agglomeration by rising height: rows are 0..n-1, the k-th merge makes n + k.

    Nearest-neighbour chains: follow nearest neighbours until two are each other's, merge them, go on from what is left of
    the chain. A merge's distances follow from sizes and centres, which is what the Lance-Williams update of Ward's distance comes to, so a
    step looks at each live row once: n^2 time, n live rows, no matrix of distances.
    """
    import numpy as np

    n = len(x)
    centre, size, live = np.array(x, float), np.ones(n), np.ones(n, bool)
    chain: list[int] = []
    found = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(live)))
        while True:
            at = chain[-1]
            cost = ((centre - centre[at]) ** 2).sum(1) * (size * size[at] / (size + size[at]))
            cost[~live] = np.inf
            cost[at] = np.inf
            near = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
                near = chain[-2]
                break
            chain.append(near)
        chain = chain[:-2]
        a, b = sorted((at, near))
        found.append((a, b, float(np.sqrt(2 * cost[near]))))
        centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        live[b] = False
    name, many, out = list(range(n)), [1] * n, []
    for k, (a, b, height) in enumerate(sorted(found, key=lambda m: m[2])):
        many[a] += many[b]
        out.append((*sorted((name[a], name[b])), height, many[a]))
        name[a] = n + k
    return out


def _few(df: DataFrame) -> DataFrame:
    if df.limit(MOST_WARD_ROWS + 1).count() > MOST_WARD_ROWS:
        raise ValueError(f"Ward's agglomeration takes at most {MOST_WARD_ROWS} rows")
    return df


def _standard(x):
    import numpy as np

    spread = x.std(0)
    return (x - x.mean(0)) / np.where(spread == 0, 1, spread)


def ward_summary(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(n_rows, n_merges, scatter, first_height, last_height): a merge of height h adds h^2 / 2 to the scatter within groups, so all
    merges together make that of the whole table."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        heights = [m[2] for m in ward_merges(_standard(rows.sort_values(key)[features].to_numpy(float)))]
        return pd.DataFrame({"n_rows": [len(rows)], "n_merges": [len(heights)], "scatter": [round(sum(h * h for h in heights) / 2, 6)], "first_height": [round(heights[0], 6) if heights else None], "last_height": [round(heights[-1], 6) if heights else None]})

    one = _few(df).select(key, *(F.col(f).cast("double").alias(f) for f in features), F.lit(1).alias("_all"))
    return one.groupBy("_all").applyInPandas(run, "n_rows long, n_merges long, scatter double, first_height double, last_height double")


def ward_groups(df: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """(key, ward_group) by Ward's agglomeration of the standardised features: k groups, numbered by falling size, then by the
    first of their keys.

    For a table of clusters, in one task; a table of more than MOST_WARD_ROWS rows raises instead of running there.
    """
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        x = _standard(rows[features].to_numpy(float))
        members = {i: [i] for i in range(len(x))}
        for at, (a, b, _, _) in enumerate(ward_merges(x)[: max(0, len(x) - k)]):
            members[len(x) + at] = members.pop(a) + members.pop(b)
        label = np.zeros(len(x), int)
        for n, g in enumerate(sorted(members.values(), key=lambda g: (-len(g), min(g)))):
            label[g] = n
        return pd.DataFrame({key: rows[key].to_numpy(), "ward_group": label})

    kind = df.schema[key].dataType.simpleString()
    return _few(df).select(key, *features, F.lit(1).alias("_all")).groupBy("_all").applyInPandas(run, f"{key} {kind}, ward_group int")


def group_profiles(df: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Size, members and feature means of each discovered group, for a table of clusters."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("cluster_id")), ";").alias("cluster_ids"), *(F.round(F.avg(f), 4).alias(f"mean_{f}") for f in features))

