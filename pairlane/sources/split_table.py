"""The published split table: one folder of Parquet files for each (category,
split) and a manifest that names the folders in force.

A write stages its folders under a name of its own and then publishes them by one
manifest file, ``_manifests/v<number>.json``, renamed into place.  Readers take the
highest number, so a write that fails or is interrupted before that leaves the
table as it was, and a reader never sees half of a write.  Two writers cannot
publish the same number: the second one fails.

Holdouts stay holdouts: what a stored or new ``test`` part of a category holds is
removed from its ``val`` and train parts, and what ``val`` holds from the train
parts.  That goes for the new parts and, where a holdout is replaced, for the
stored ones too.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOLDOUTS = ("test", "val")


class _Folder:
    """The table's folder, in whatever file system it is."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        if not self.fs.exists(self.path("_manifests")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path("_manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, number: int) -> dict:
        stream = self.fs.open(self.path(f"_manifests/v{number:08d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> None:
        final, staged = self.path(f"_manifests/v{number:08d}.json"), self.path(f"_manifests/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(staged)
        out.write(bytearray(json.dumps(content, indent=1, sort_keys=True).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(staged, final):
            self.fs.delete(staged, False)
            raise RuntimeError(f"another writer published version {number} of {self.root}")


def stored_parts(spark: SparkSession, root: str) -> dict[tuple[str, str], str]:
    """(category, split) -> folder of the published parts; empty without a table."""
    folder = _Folder(spark, root)
    numbers = folder.numbers()
    if not numbers:
        return {}
    return {(p["category"], p["split"]): f"{folder.root}/{p['folder']}" for p in folder.read(numbers[-1])["parts"]}


def read_part(spark: SparkSession, parts: dict, category: str, split: str) -> DataFrame:
    return (spark.read.parquet(parts[category, split])
            .withColumn("category", F.lit(category)).withColumn("split", F.lit(split)))


def write_splits(df: DataFrame, root: str, force: bool = False, key: str = "pair_id") -> None:
    """Publish the (category, split) parts of ``df``.  Parts that are stored already
    stay as they are without ``force`` and are replaced with it; rows that belong to
    a holdout of their category are left out of its other parts (see above).  Rows
    without a category or split, or with an empty one, are refused."""
    spark = df.sparkSession
    stored = stored_parts(spark, root)
    # one row for each part
    given = {(r["category"], r["split"]) for r in df.select("category", "split").distinct().collect()}
    if any(not c or not s for c, s in given):
        raise ValueError("rows without a category or split")
    new = given if force else given - set(stored)
    if not new:
        return
    names = F.concat_ws("\u0000", "category", "split")
    fresh = df.where(names.isin(["\u0000".join(p) for p in new]))
    categories = {c for c, _ in new}
    holdout = {s: fresh.where(F.col("split") == s).select("category", key) for s in HOLDOUTS}
    for (c, s) in stored:
        if s in HOLDOUTS and c in categories and (c, s) not in new:
            holdout[s] = holdout[s].unionByName(read_part(spark, stored, c, s).select("category", key))

    def without_holdouts(rows: DataFrame, above: tuple[str, ...]) -> DataFrame:
        for s in above:
            rows = rows.join(holdout[s].distinct(), ["category", key], "left_anti")
        return rows

    # stored parts below a replaced holdout are written again without its rows
    again = {(c, s) for c, s in stored if (c, s) not in new and s != "test"
             and ((c, "test") in new or (s != "val" and (c, "val") in new))}
    rows = fresh
    for c, s in sorted(again):
        rows = rows.unionByName(read_part(spark, stored, c, s), allowMissingColumns=True)
    test, val = F.col("split") == "test", F.col("split") == "val"
    columns = df.columns
    clean = (rows.where(test).unionByName(without_holdouts(rows.where(val), ("test",)).select(*columns))
             .unionByName(without_holdouts(rows.where(~test & ~val), ("test", "val")).select(*columns)))
    version = uuid.uuid4().hex[:12]
    folder = _Folder(spark, root)
    clean.write.partitionBy("category", "split").parquet(f"{folder.root}/{version}")
    staged = spark.read.schema(clean.schema).parquet(f"{folder.root}/{version}")
    counts = {(r["category"], r["split"]): r["n"] for r in
              staged.groupBy("category", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    parts = {p: f[len(folder.root) + 1:] for p, f in stored.items() if p not in new | again}
    for c, s in new | again:
        name = f"{version}/category={escape(c)}/split={escape(s)}"
        if (c, s) not in counts:  # every row belongs to a holdout: an empty part, not a missing one
            clean.limit(0).drop("category", "split").write.mode("overwrite").parquet(f"{folder.root}/{name}")
        parts[c, s] = name
    numbers = folder.numbers()
    folder.publish(numbers[-1] + 1 if numbers else 1, {"parts": [
        {"category": c, "split": s, "folder": f} for (c, s), f in sorted(parts.items())]})


def load_split(spark: SparkSession, root: str, split: str, category: str) -> DataFrame:
    """The published part of a category and split."""
    parts = stored_parts(spark, root)
    if (category.lower(), split) not in parts:
        raise FileNotFoundError(f"no split {split!r} of {category!r} in {root}")
    return read_part(spark, parts, category.lower(), split)
