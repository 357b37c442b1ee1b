"""Centroid clustering: plain Lloyd rounds over integer vectors.

Each round sends the centroids (at most `clusters` vectors) to the tasks; a task takes integer squared differences to each
centroid in NumPy, the nearest one (of equal ones the lowest number), and returns one sum vector and count for each
centroid it met. Those partial sums, at most `clusters` rows a task, merge in an aggregation; the driver gets one row for
each centroid. Vectors never move. All arithmetic is on whole numbers, so results don't depend on partitions or order.

Defined results: vectors that are null, of another length, or with null, NaN or infinite entries give no row. A null id
counts as an empty text in the hash and stays null. Repeated ids are rows of their own; starts with equal hashes go by their
vectors. With fewer vectors than clusters there are fewer centroids; an empty table gives no rows. A sum or distance beyond
a long fails the job instead of wrapping. Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import AT_ONCE, integers

DIMENSIONS, FACTOR = 64, 256
CLUSTERS, ROUNDS, SEED = 40, 5, 2
#: Below this, differences squared and summed over 2^9 dimensions fit in a long.
SMALL = 1 << 26


def start(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in hash order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(hashed.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in found], np.int64) if found else np.zeros((0, 0), np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; ties go to the lowest number."""
    large = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0))) >= SMALL
    distances = np.empty((len(x), len(centroids)), object if large else np.int64)
    held = x.astype(object) if large else x
    for k, centroid in enumerate(centroids):
        difference = held - centroid
        distances[:, k] = (difference * difference).sum(1) if large else np.einsum("ij,ij->i", difference, difference)
    best = distances.argmin(1)
    least = distances[np.arange(len(x)), best]
    if large and len(least) and max(least) >= 1 << 63:
        raise OverflowError("a squared distance is beyond a long")
    return best, least.astype(np.int64)


def _chunks(vectors: pd.Series, d: int) -> Iterator[np.ndarray]:
    step = max(1, AT_ONCE // max(1, d))
    for at in range(0, len(vectors), step):
        yield np.stack(vectors.iloc[at : at + step].to_list()).astype(np.int64, copy=False)


def partial_sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums): a row for each centroid that some vector of a task is nearest to."""
    k, d = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = [0] * k, [np.zeros(d, object) for _ in range(k)]
        for batch in batches:
            for x in _chunks(batch["x"], d):
                best, _ = nearest(x, centroids)
                order = np.argsort(best, kind="stable")
                met, first, n = np.unique(best[order], return_index=True, return_counts=True)
                small = int(np.abs(x).max()) < 1 << 40
                added = np.add.reduceat(x[order] if small else x[order].astype(object), first, axis=0)
                for c, m, total in zip(met.tolist(), n.tolist(), added, strict=True):
                    counts[c] += m
                    sums[c] = sums[c] + total.astype(object)
        met = [c for c in range(k) if counts[c]]
        yield pd.DataFrame({"cluster": pd.Series(met, dtype="int32"), "n": pd.Series([counts[c] for c in met], dtype="int64"), "sums": pd.Series([[int(v) for v in sums[c]] for c in met], dtype=object)})

    return rows.select("x").mapInPandas(run, "cluster int, n long, sums array<long>")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) by component; those without vectors stay."""
    k, d = centroids.shape
    merged = partial_sums(rows, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(d)))
    out = centroids.copy()
    for row in merged.collect():
        out[row["cluster"]] = [s // row["n"] for s in row[2:]]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    d = centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [nearest(x, centroids) for x in _chunks(batch["x"], d)]
            if found:
                best, least = (np.concatenate(part) for part in zip(*found, strict=True))
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": best.astype("int32"), "distance": least})

    return rows.mapInPandas(run, "vec_id long, cluster int, distance long")


def lloyd(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after so many rounds, from (vec_id, x) with vectors of one length."""
    centroids = start(rows, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids)
    return centroids


def kept(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS, factor: int = FACTOR) -> DataFrame:
    """(vec_id, x): the whole vectors of this many dimensions as integers, written once for all rounds."""
    return stored(integers(embeddings, id_column, vector_column, factor).filter(F.size("x") == dimensions), "vectors")


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS, factor: int = FACTOR) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept."""
    rows = kept(embeddings, id_column, vector_column, dimensions, factor)
    centroids = lloyd(rows, clusters, rounds, seed)
    spark = embeddings.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    last = stored(assigned(rows, centroids), "assigned")
    sums = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, total, names[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, factor: int = FACTOR) -> str:
    """The same in DuckDB SQL: all distances in each round."""
    whole = f"embedding is not null and len(embedding) = {dimensions} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0"
    parts = [
        f"v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: cast(floor({factor} * cast(e as double)) as bigint)) as x from embeddings where {whole})",
        f"c0 as (select row_number() over (order by h, x) - 1 as c, x from (select sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')) as h, x from v) order by c limit {clusters})",
    ]
    distance = "cast(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    for k in range(rounds + 1):
        parts.append(f"a{k} as (select r, vec_id, x, c, d from (select v.r, v.vec_id, v.x, c.c, {distance} as d from v cross join c{k} c) qualify row_number() over (partition by r order by d, c) = 1)")
        if k < rounds:
            mean = "cast((s - ((s % n) + n) % n) // n as bigint)"
            parts.append(f"m{k} as (select c, list({mean} order by j) as x from (select c, j, sum(e) as s, count(*) as n from (select c, generate_subscripts(x, 1) as j, unnest(x) as e from a{k}) group by c, j) group by c)")
            parts.append(f"c{k + 1} as (select c.c, coalesce(m.x, c.x) as x from c{k} c left join m{k} m using (c))")
    return f"""with {", ".join(parts)}
select a.vec_id, cast(a.c as int) as cluster, a.d as distance, cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
    sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.c = c.c"""
