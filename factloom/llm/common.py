"""What the operators share: inputs, the shared folder, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table with one narrow row per key is broadcast; beyond it, it is shuffled.
BROADCAST_ROWS = 20_000
#: Rows up to which the rows of one key may always meet in one task.
HOT_ROWS = 1_000
#: Copies of one row that a task makes at once.
COPIES_AT_ONCE = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset in local mode a new folder.

    A cluster without the setting is refused, as its machines share no local folder.
    """
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="factloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared folder, and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if counting finds at most so many rows; else it joins by shuffle.

    df must be cheap to count, such as a checkpoint.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def map_documents(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], fields: str) -> DataFrame:
    """rows through run, which takes and returns doc_id as text: in pandas, integers beside nulls would lose digits."""
    kind = rows.schema["doc_id"].dataType
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, f"doc_id string, {fields}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def join_by_key(rows: DataFrame, per_key: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows joined with per_key: one row for each key (null counts as a key), and in column n how many rows have that key.

    A key with over HOT_ROWS rows and over 1 / BROADCAST_ROWS of all rows is hot, so there are fewer hot keys than
    BROADCAST_ROWS. Their rows stay where they are and get the key's row by broadcast; all others are shuffled. Both
    tables are read more than once, so they should be checkpoints or written tables.
    """
    total = per_key.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_ROWS, total // BROADCAST_ROWS)
    keys = {c: f"factloom_key_{c}" for c in on}
    named = per_key.select(*[F.col(c).alias(keys.get(c, c)) for c in per_key.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    hot, others = named.where(F.col(n) > most), named.where(F.col(n) <= most)
    if hot.isEmpty():
        return rows.join(others, same).drop(*keys.values())
    spread = rows.join(F.broadcast(hot), same)
    rest = rows.join(F.broadcast(hot.select(*keys.values())), same, "left_anti").join(others, same)
    return spread.unionByName(rest).drop(*keys.values())


def each_copy(units: DataFrame, n: str, copy: str) -> DataFrame:
    """units without column n, each as often as n says, numbered from 0 in column copy.

    Units of over COPIES_AT_ONCE are first cut into ranges of so many, which are dealt out before they are spread. units
    should be cheap to count, such as a checkpoint.
    """
    spread = units.where(F.col(n) <= COPIES_AT_ONCE).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    large = units.where(F.col(n) > COPIES_AT_ONCE)
    if not large.isEmpty():
        start = f"{copy}_from"
        ranges = large.withColumn(start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(COPIES_AT_ONCE).cast("long")))).repartition(*units.columns, start)
        upto = F.least(F.col(start) + COPIES_AT_ONCE, F.col(n)) - 1
        spread = spread.unionByName(ranges.withColumn(copy, F.explode(F.sequence(F.col(start), upto))).drop(start))
    return spread.drop(n)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def column_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores after it until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
