"""Session settings and tables in a shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "pairwright", master: str | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; sizes and masters come from the cluster unless given."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    return (b.master(master) if master else b).getOrCreate()


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="pairwright-")


def persisted(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read again; only a local session without that setting uses a folder of its own."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _own_dir()
    path = f"{where.rstrip('/')}/pairwright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pairwright_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of persisted() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_pairwright_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of few columns that are broadcast at most.
BROADCAST_ROWS = 500_000


def few(table: DataFrame) -> DataFrame:
    """A table of persisted(), marked for broadcast if it has BROADCAST_ROWS rows at most: what meets it is not shuffled then."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def together(tables: list[DataFrame]) -> DataFrame:
    """One scan over several tables of persisted(), all of one schema."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._pairwright_path for t in tables])


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in spark.sql.shuffle.partitions parts by some columns, ahead of work that costs far more than its rows' bytes say
    (dozens of patterns a title): adaptive execution would put small rows together in a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def once_each(df: DataFrame, by: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that compute adds, computed once for each distinct row of `by` alone and joined to all rows that
    have it (null is a value like others): listings repeat their titles far more often than the patterns are cheap."""
    each = compute(spread(df.select(*by).distinct(), *by))
    each = each.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[c for c in each.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    # files of few distinct titles are far smaller than their rows, so Spark would take them for broadcasts
    return df.join(each.hint("merge"), functools.reduce(lambda x, y: x & y, same)).drop(*[f"_by_{c}" for c in by])
