"""Writers: tables, one-file exports, JSON sidecars, model provenance, GeoJSON."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a page that people open.
MOST_FEATURES = 50_000


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet table, with a fixed projection if given. An empty frame still writes its schema."""
    out = (df.select(*columns) if columns else df).write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One headed CSV file for people to open: for result tables, not for data that grow. An empty table is a file with the header alone."""
    (df.select(*columns) if columns else df).repartition(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def _moved(spark: SparkSession, path: str, text: str, overwrite: bool) -> bool:
    """Write a small text beside its place and move it there in one step; false if it may not overwrite and something is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    target, draft = fs.makeQualified(hadoop.Path(path)), fs.makeQualified(hadoop.Path(f"{path}.{uuid.uuid4().hex}.part"))
    out = fs.create(draft, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    try:
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except Exception:
        if overwrite or not fs.exists(target):
            raise
        fs.delete(draft, False)
        return False
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side file in any store, moved over the old one, so that readers see the one or the other, whole."""
    _moved(spark, path, text, True)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """The same for a file that must not be there yet; false if it is."""
    return _moved(spark, path, text, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, record: dict) -> None:
    write_text(spark, path, json.dumps(record, indent=2, default=str, sort_keys=True))


def save_model(model, path: str, provenance: dict) -> None:
    """A fitted pipeline and, beside it, what it was made from."""
    model.write().overwrite().save(path)
    write_json(SparkSession.active(), f"{path.rstrip('/')}.provenance.json", provenance)


def geojson(df: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature a row, in a column `feature`."""
    point: Column = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def write_labelled(detections: DataFrame, labels: DataFrame, path: str, key: str = "id") -> None:
    """Detections with all their columns and the cluster of each, -1 where there is none."""
    named = labels.select(F.col(key).alias("_key"), "cluster_id")
    joined = detections.drop("cluster_id").join(named, F.col(key) == F.col("_key"), "left").drop("_key")
    write_table(joined.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))), path)


METRICS = ("split", "feature_set", "model", "class", "precision", "recall", "f1", "support", "accuracy")


def write_metrics(tables: list[DataFrame], path: str) -> None:
    """Metrics of several runs as one long table, a row for each split, feature set, model and class."""
    out = None
    for df in tables:
        one = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in METRICS))
        out = one if out is None else out.unionByName(one)
    export_csv(out.orderBy("split", "feature_set", "model", "class"), path)


def write_predictions(by_split: dict[str, DataFrame], path: str, key: str) -> None:
    """Predictions of several splits as one table, with probabilities to four places."""
    out = None
    for name, df in by_split.items():
        shares = [c for c in df.columns if c.startswith("prob_")]
        one = df.select(F.lit(name).alias("split"), key, "predicted_class", *(F.round(c, 4).alias(c) for c in shares))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    write_table(out, path)


def html_map(df: DataFrame, path: str, lat: str, lon: str, properties: list[str], title: str) -> None:
    """A page with the rows as GeoJSON inside, for people to open: for result tables (a row for each cluster or cell). More than
    MOST_FEATURES rows raise."""
    features = [r["feature"] for r in geojson(df, lat, lon, properties).limit(MOST_FEATURES + 1).collect()]
    if len(features) > MOST_FEATURES:
        raise ValueError(f"a page takes at most {MOST_FEATURES} rows")
    data = json.dumps({"type": "FeatureCollection", "features": [json.loads(f) for f in features]}).replace("</", "<\\/")
    page = (
        f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><svg id=map viewBox='0 0 1000 800' style='border:1px solid'></svg><script>const data={data};"
        "const p=data.features.map(f=>f.geometry.coordinates),x=p.map(q=>q[0]),y=p.map(q=>q[1]),a=Math.min(...x),b=Math.max(...x),c=Math.min(...y),d=Math.max(...y);"
        "for(const f of data.features){const [u,v]=f.geometry.coordinates,e=document.createElementNS('http://www.w3.org/2000/svg','circle');"
        "e.setAttribute('cx',20+960*(u-a)/((b-a)||1));e.setAttribute('cy',780-760*(v-c)/((d-c)||1));e.setAttribute('r',5);"
        "const t=document.createElementNS('http://www.w3.org/2000/svg','title');t.textContent=JSON.stringify(f.properties);e.append(t);document.getElementById('map').append(e)}</script>"
    )
    write_text(df.sparkSession, path, page)
