"""A stored index of vectors: cells around centroids, few of which are searched, and exact scores within them.

The centroids are trained on a sample of SAMPLE vectors at most, taken by a hash
of their keys; every row is then assigned to its nearest centroid and stored in
that cell. A cell is dealt into parts of some PART_ROWS rows, so a cell that
holds a third of all rows is many parts. A query goes to its nearest cells, as
one row for each part of them; where part and queries meet, a block of queries
is multiplied with the part's vectors and only the k best of each query leave.
With all cells probed the result is that of a full scan.

Rows whose vector is null, has no length or holds NaN or an infinity are stored
in no cell and never found; queries of that kind find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.retrieval import top_per_query, vector_topk
from factloom.shipping import checkpoint, ship

SAMPLE, MOST_CELLS, ROUNDS = 50_000, 4096, 12
PART_ROWS, QUERY_ROWS = 8192, 1024
#: Stored rows that are asked to find how many cells to probe, and the recall that they must reach: a little over what is promised.
ASKED, WANTED = 256, 0.95


@dataclass(frozen=True)
class VectorIndex:
    path: str
    centroids: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """cell, part, key, embedding."""
        return spark.read.parquet(f"{self.path}/rows")

    def parts(self, spark: SparkSession) -> DataFrame:
        """cell, parts: one row for each cell."""
        return spark.read.parquet(f"{self.path}/cells")


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)[:, None]


def train_centroids(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Directions around which the sample's vectors lie: its rows of least hash, split among `cells` centroids again and again.

    vectors: key, embedding. Without `cells` there is about one for the root of the number of rows.
    """
    good = vectors.where(usable(F.col("embedding")))
    cells = cells or int(min(MOST_CELLS, max(1, good.count() ** 0.5)))
    held = good.select("embedding").orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    points = _unit(np.array([r["embedding"] for r in held], np.float64).reshape(len(held), -1)) if held else np.zeros((0, 1))
    if len(points) <= cells:
        return np.unique(points, axis=0) if len(points) else np.zeros((1, 1))
    # The first of every n-th: the sample's order is that of a hash, so this is a random start.
    centroids = points[np.linspace(0, len(points) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(block @ centroids.T, axis=1) for block in np.array_split(points, -(-len(points) // 4096))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        empty = np.bincount(near, minlength=cells) == 0
        sums[empty] = points[np.flatnonzero(empty) * 7919 % len(points)]
        centroids = _unit(sums)
    return centroids


def _nearest(rows: DataFrame, id_col: str, centroids: np.ndarray, n: int) -> DataFrame:
    """id_col, embedding and cell: a row for each of the n nearest cells. The centroids, MOST_CELLS at most, go to every task."""
    spark = rows.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(centroids)
    n = min(n, len(centroids))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 1024):
                part = pdf.iloc[k : k + 1024]
                score = _unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)) @ sent.value.T
                cell = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(n), (len(part), 1))
                at = np.repeat(np.arange(len(part)), n)
                yield pd.DataFrame({id_col: part[id_col].to_numpy()[at], "embedding": part["embedding"].to_numpy()[at], "cell": cell.ravel()})

    good = rows.where(usable(F.col("embedding"))).select(id_col, F.col("embedding").cast("array<double>").alias("embedding"))
    return good.mapInPandas(run, f"{id_col} {kind}, embedding array<double>, cell int")


def write_index(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Trains centroids, assigns every row of vectors (key, embedding) to a cell and writes it at path."""
    spark = vectors.sparkSession
    centroids = train_centroids(vectors, cells, sample)
    assigned = _nearest(vectors, "key", centroids, 1)
    assigned.write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    counts = assigned.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    counts.coalesce(1).write.parquet(f"{path}/cells")
    held = assigned.join(F.broadcast(spark.read.parquet(f"{path}/cells")), "cell")  # MOST_CELLS rows
    dealt = held.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
    dealt.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(centroids)], "cell int, embedding array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return VectorIndex(path, centroids)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    held = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MOST_CELLS rows
    return VectorIndex(path, np.array([r["embedding"] for r in held]))


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, digits: int = 6) -> DataFrame:
    """query_id, key, score, rank: the k nearest rows by cosine in the `probes` cells nearest to each query (query_id, embedding); in all cells without `probes`.

    Scores are exact and rounded before they rank; ties by key.
    """
    spark = queries.sparkSession
    ship(spark)
    probes = probes or len(index.centroids)
    probed = checkpoint(_nearest(queries, "query_id", index.centroids, probes).join(F.broadcast(index.parts(spark)), "cell"))
    per_cell = probed.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    cells = checkpoint(per_cell)
    wanted = [r["cell"] for r in cells.select("cell").collect()]  # MOST_CELLS at most; the scan opens only these folders
    rows = index.rows(spark).where(F.col("cell").isin(*wanted)).join(F.broadcast(cells), "cell")
    ask = probed.join(F.broadcast(cells), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    # A group is one part of a cell and one block of the queries that probe it: bounded on either side.
    left = ask.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "query_id", "embedding")
    right = rows.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "embedding")
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, "query_id"), (right, "key"))}

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "key": [], "score": []})
        held = held.sort_values("key", kind="stable")
        a, b = (_unit(np.stack(x["embedding"].to_numpy())) for x in (asked, held))
        score = np.round(a @ b.T, digits)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(a)), top.shape[1])
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[at], "key": held["key"].to_numpy()[top.ravel()], "score": score[at, top.ravel()]})

    group = ["cell", "part", "block"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(best, f"query_id {kinds['query_id']}, key {kinds['key']}, score double")
    return top_per_query(found, k, "key")


def probes_for(index: VectorIndex, vectors: DataFrame, k: int, wanted: float = WANTED, asked: int = ASKED) -> int:
    """How many cells to probe so that on average the share `wanted` of a query's k nearest rows is found.

    Up to `asked` stored rows, taken by a hash, are compared with all vectors (key, embedding), themselves left out; where
    the cell of each of their nearest rows stands among the cells nearest to them tells the number. Where vectors lie in no
    clusters that is a large part of all cells.
    """
    spark = vectors.sparkSession
    chosen = vectors.where(usable(F.col("embedding"))).orderBy(F.xxhash64("key", F.lit("asked")), "key").limit(asked)
    sample = checkpoint(chosen.select(F.col("key").alias("query_id"), "embedding"))
    hits = vector_topk(vectors, sample, k + 1).where("query_id != key").select("query_id", "key")
    held = index.rows(spark).select("key", "cell").join(F.broadcast(hits), "key").select("query_id", "cell").toPandas()  # asked x (k + 1) rows
    if not len(held):
        return 1
    own = sample.collect()
    scores = _unit(np.array([r["embedding"] for r in own], np.float64)) @ index.centroids.T
    place = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1)
    at = {r["query_id"]: n for n, r in enumerate(own)}
    rows = held["query_id"].map(at).to_numpy()
    found = np.bincount(place[rows, held["cell"].to_numpy()], weights=1 / np.bincount(rows, minlength=len(own))[rows], minlength=len(index.centroids))
    share = np.cumsum(found) / held["query_id"].nunique()
    return int(min(np.searchsorted(share, wanted - 1e-9) + 1, len(index.centroids)))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of a query's exact hits (query_id, key) that were found."""
    hit = exact.select("query_id", "key").join(found.select("query_id", "key", F.lit(1).alias("hit")), ["query_id", "key"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
