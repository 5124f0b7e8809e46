"""Distributed dense numbering (0..n-1) in a given order.

A global ``row_number()`` window without ``partitionBy`` funnels every row
through one task.  Instead: sort (range-partitioned), tag each row with
``monotonically_increasing_id`` (partition id in the high bits, position in
the low 33 bits), checkpoint so the tags are stable, count rows per
partition (a table with one row per partition, i.e. bounded by the
partition count), prefix-sum those counts on the driver and add the offset
back as a literal map lookup (no join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pairlane.session import materialize

_LOW = (1 << 33) - 1
MAX_LITERAL_KEYS = 64


def dense_index(df: DataFrame, order_cols: list, name: str,
                checkpoint: bool = True) -> DataFrame:
    tagged = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        tagged = materialize(tagged)
    part = F.shiftright(F.col("_mid"), 33)
    # one row per non-empty partition: bounded by the partition count
    counts = (tagged.groupBy(part.alias("_p"))
              .agg((F.max(F.col("_mid").bitwiseAND(F.lit(_LOW))) + 1).alias("_n"))
              .collect())
    offsets, acc = {}, 0
    for r in sorted(counts, key=lambda r: r["_p"]):
        offsets[int(r["_p"])] = acc
        acc += int(r["_n"])
    if not offsets:
        return tagged.select(F.lit(0).cast("bigint").alias(name), *df.columns)
    low = F.col("_mid").bitwiseAND(F.lit(_LOW))
    if len(offsets) <= MAX_LITERAL_KEYS:
        # a map literal is searched linearly per row: only for a few keys
        off_map = F.create_map(*[x for k, v in offsets.items() for x in (F.lit(k), F.lit(v))])
        off = F.element_at(off_map, part).cast("bigint")
        return tagged.select((off + low).alias(name), *df.columns)
    # one row per partition: bounded by the partition count, so broadcast
    offs = df.sparkSession.createDataFrame(list(offsets.items()), "_p long, _off long")
    return (tagged.join(F.broadcast(offs), part == F.col("_p"))
            .select((F.col("_off") + low).alias(name), *df.columns))


def successor(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Distinct (``key``, ``value``) with ``name``, the next larger value of the
    same key; after the largest comes the smallest.  Keys of one value have no row.

    The rows are numbered in order over the whole table and each is joined to the
    number after it, so a key that holds most values is spread like any other (a
    window for each key would put it into one task)."""
    idx = dense_index(df.select(key, value).distinct(), [F.col(key), F.col(value)], "_i")
    after = idx.select((F.col("_i") - 1).alias("_i"), F.col(key).alias("_key"), F.col(value).alias(name))
    pairs = idx.join(after, "_i", "left").withColumn("_inside", F.coalesce(F.col("_key") == F.col(key), F.lit(False)))
    inside = pairs.where("_inside").select(key, value, name)
    # the largest value of a key: one row for each key
    wrap = (pairs.where("NOT _inside").select(key, value)
            .join(idx.groupBy(key).agg(F.min(value).alias(name)), key).where(F.col(name) != F.col(value)))
    return inside.unionByName(wrap.select(key, value, name))
