"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local_dirs: dict[str, str] = {}
_written: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they share the driver's file system; elsewhere it must be installed."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else, on a local master only, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _local_dirs[app]


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and reread it: the lineage is cut, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*stored: DataFrame) -> None:
    """Delete tables of :func:`materialise` before the end, once all that was made of them is stored too."""
    for df in stored:
        _written.remove(df.stored_at)
        _delete(df.sparkSession, df.stored_at)


def cleanup(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialise` wrote in this process; call it when their results have been read."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n


def _width(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.ArrayType, T.MapType, T.StructType, T.StringType, T.BinaryType)):
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 24
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 24
    return F.lit(8)


#: Tables of so many bytes at most, as rows in memory, are broadcast.
BROADCAST_BYTES = 16 << 20


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a stored table take ``limit`` bytes or less."""
    width = F.lit(16)
    for f in df.schema:
        width = width + _width(f.name, f.dataType)
    return (df.agg(F.sum(width.cast("long"))).first()[0] or 0) <= limit


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if it fits; larger tables are joined by shuffles."""
    return F.broadcast(df) if fits(df, limit) else df


#: Rows of one key that one task joins, about, where their number is known.
KEY_ROWS = 4096


def salted_join(big: DataFrame, small: DataFrame, key: str, by: tuple[str, ...], how: str = "inner", salts: int = 16, rows: str | None = None) -> DataFrame:
    """``big`` joined with the stored table ``small``, of one row a key: by broadcast if ``small`` fits, else a key's rows in
    ``big`` are dealt over ``salts`` tasks by the hash of ``by``.

    ``rows`` names a column of ``small``, not of the result, with about the number of a key's rows in ``big``: then only keys of more than
    ``KEY_ROWS`` are dealt, over as many tasks as that takes, and the other rows of ``small`` are not repeated.
    """
    plain = small.drop(rows) if rows else small
    if fits(plain):
        return big.join(F.broadcast(plain), key, how)
    if rows:
        n = F.greatest(F.ceil(F.col(rows) / KEY_ROWS), F.lit(1)).cast("int")
        often = bounded(small.where(F.col(rows) > KEY_ROWS).select(key, n.alias("_deals")))
        left = big.join(often, key, "left").withColumn("_deal", F.pmod(F.xxhash64(*by), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_deals")
        right = small.withColumn("_deal", F.explode(F.sequence(F.lit(0), n - 1))).drop(rows)
    else:
        left = big.withColumn("_deal", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
        right = small.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_deal"], how).drop("_deal")
