"""Cost profiles in, reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """``name, cost``: a JSON object of costs by name, or an array of records with ``name`` or ``qname`` and ``cost``, ``ms``, ``time`` or ``value``.

    Records without a name or cost are left out.
    """
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    if first is None or first[0] not in "{[":
        raise ValueError("a cost profile is a JSON object or array")
    whole = spark.read.text(path, wholetext=True)
    if first[0] == "{":
        return whole.select(F.explode(F.from_json("value", "map<string, double>")).alias("name", "cost")).where("cost is not null")
    rows = F.from_json("value", "array<struct<name: string, qname: string, cost: double, ms: double, time: double, value: double>>")
    r = whole.select(F.explode(rows).alias("r")).select(F.coalesce("r.name", "r.qname").alias("name"), F.coalesce("r.cost", "r.ms", "r.time", "r.value").alias("cost"))
    return r.where("name is not null and cost is not null")


def write_report(df: DataFrame, path: str, rank: str | None = None) -> None:
    """The rows as JSON lines, in order of ``rank`` if given."""
    (df.orderBy(rank) if rank else df).coalesce(1).write.mode("overwrite").json(path)


def table(df: DataFrame, limit: int = 50) -> str:
    """The first rows as aligned text."""
    rows = [[("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)) for v in r] for r in df.limit(limit).collect()]
    grid = [df.columns, *rows]
    widths = [max(len(r[i]) for r in grid) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in grid)
