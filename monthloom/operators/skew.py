"""Joining per-entity results back to the series of the entity.

One entity may hold a large share of all series, so series are never shuffled by
entity alone. A per-entity table of checked size is broadcast. Beyond that, series are
spread over salts by a hash of the feature, and the per-entity rows are repeated per
salt: an entity's series then meet their row in as many tasks as its largest number needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
SERIES_PER_SALT = 2_000


def table_bytes(df: DataFrame) -> int:
    """Rough size of a small written table: 8 bytes per array cell, 32 per other column."""
    cells = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            cells = cells + 8 * F.coalesce(F.size(field.name), F.lit(0))
        else:
            cells = cells + 32
    return df.agg(F.coalesce(F.sum(cells), F.lit(0)).alias("b")).first().b


def join_by_entity(series: DataFrame, per_entity: DataFrame, how: str = "inner") -> DataFrame:
    """`series` (with `feature`) joined to a written table with one row per entity."""
    if table_bytes(per_entity) <= BROADCAST_BYTES:
        return series.join(F.broadcast(per_entity), "entity", how)
    most = series.groupBy("entity").count().agg(F.max("count").alias("n")).first().n or 1
    salts = -(-most // SERIES_PER_SALT)
    salted = series.withColumn("_salt", F.pmod(F.xxhash64("feature"), F.lit(salts)).cast("int"))
    repeated = per_entity.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, ["entity", "_salt"], how).drop("_salt")
