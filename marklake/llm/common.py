"""Helpers shared by the corpus operators: the shared scratch folder, let-bindings and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java character class: the space and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that a side may have to be broadcast; every use counts the rows first and has a shuffled way beyond it.
BROADCAST_ROWS = 200_000


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: below spark.checkpoint.dir, which all executors share.

    Only a session on one machine (master local) may name none: then a temporary folder is chosen.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="marklake-")
        _local_root[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/marklake-{spark.sparkContext.applicationId}"


#: The temporary folders of applications on one machine.
_local_root: dict[str, str] = {}


#: Writer's options for a table whose rows are megabytes long: the size is looked at after every row, not after a hundred,
#: so that a task holds a few rows when it writes and when it reads a row group.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


#: With it, a query's shuffles are removed from all executors when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: cuts lineage and survives lost executors.

    options: the writer's. What was shuffled for it is gone when it is written: a chain of tables holds the shuffles of
    one of them at a time. The setting for that is read when a DataFrame is made, hence the select, and put back.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.getAll.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._marklake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    spark, location = df.sparkSession, getattr(df, "_marklake_path", None)
    if location:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; call it once the results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """Evaluate value once and use it several times in body, also where Catalyst would inline it into a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text: maximal runs of anything but SPACE. Null and empty texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE, -1))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows. Spark bounds a batch by bytes; this bounds what is made of it."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it is small, else df itself, for a shuffled join.

    Small: at most so many rows, and as many values of the column `size` (elements of an array, say) ten times over.
    """
    some = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(size if size is not None else F.lit(1)).alias("size")).first()
    return F.broadcast(df) if some.n <= rows and (some["size"] or 0) <= 10 * rows else df


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name
