"""Helpers shared by the text operators: the shared folder, written tables, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the only characters that part words.
SPACES = " \t\n\x0b\x0c\r"
#: Groups with this share of all rows, and so many rows at least, are joined by broadcast.
HOT_GROUPS, HOT_ROWS = 10_000, 1_000
#: Names of rows (id and text hash) that may be broadcast, 20 MB; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_KEPT: list[str] = []
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is empty a local folder is set, but on a single machine only (tests):
    executors of a cluster would each write to a disk of their own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="foliomere-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/foliomere/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that are staged within, but for those to keep, are deleted at the end."""
    path = shared_dir(spark, name)
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_staged(spark: SparkSession) -> int:
    """Deletes the tables that earlier results still read, and says how many; call it once these results are written."""
    n = len(_KEPT)
    while _KEPT:
        _delete(spark, _KEPT.pop())
    return n


def stage_table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts lineage in a way that outlives any executor."""
    spark, inside = df.sparkSession, _SCRATCH.get()
    path = f"{inside}/{name}-{uuid.uuid4().hex}" if inside and not keep else shared_dir(spark, name)
    if not path.startswith(f"{inside}/"):
        _KEPT.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Array of the runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+", -1), "")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row for each of their keys and the group's ``size``.

    Groups of a ten-thousandth of the rows or more number 10,000 at most: these are broadcast, so no
    task takes a large group; all others meet by a shuffle. Keys are not null."""
    groups = stage_table(groups, "groups")
    n = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) >= max(HOT_ROWS, n / HOT_GROUPS)
    first = rows.join(F.broadcast(groups.filter(large)), keys, "left")
    rest = first.filter(F.col(size).isNull()).select(*rows.columns).join(groups.filter(~large), keys)
    return first.filter(F.col(size).isNotNull()).select(*rest.columns).union(rest)


def row_key() -> tuple[Column, Column]:
    """_id and _r: a row is known by its id and the hash of its text."""
    return F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("_r")


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not named in ``gone`` (_id, _r); other columns may have any name."""
    gone = stage_table(gone.select("_id", "_r").distinct(), "rows-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = docs.select(F.struct("*").alias("_row"), *row_key()).alias("a")
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._r") == F.col("b._r"))
    return rows.join(side.alias("b"), same, "left_anti").select("_row.*")
