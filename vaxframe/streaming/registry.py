"""A registry kept by a stream: reduced parts in buckets by key, with compaction of the buckets that grew.

Layout under ``path``: ``parts/part=<name>/bucket=<b>`` holds reduced rows (one per key), ``manifest/batch=<id>`` the
live parts after a batch as rows (bucket, part).  A batch writes its part, merges the buckets that then have more
than ``MOST_PARTS`` parts into one, and writes its manifest last, so

* a batch that failed half way leaves the registry as it was, and runs again from the start;
* a batch that already has its manifest changes nothing when it runs again;
* a bucket has at most ``MOST_PARTS`` parts however many batches came, and a batch reads only the buckets it merges.

Parts that neither the last nor the previous manifest names are removed.  The number of buckets is fixed when the
registry is made; a bucket should be about one task's work.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Groups = dict[str, tuple[list[str], str | None]]


def reduce_batch(batch: DataFrame, keys: list[str], groups: Groups, order: list[str], date: str) -> DataFrame:
    """One row per key with the last value (and its order) of every column group."""
    def last(cols, where):
        keep = f" filter (where {where})" if where else ""
        return f"max(struct({', '.join(order)}, struct({', '.join(cols)}) as v)){keep}"

    return batch.groupBy(*keys).agg(
        *[F.expr(f"{last(cols, where)} as {g}") for g, (cols, where) in groups.items()],
        F.min(date).alias("reported_date"), F.max(date).alias("updated_date"))


def merge_reduced(parts: DataFrame, keys: list[str], groups: Groups) -> DataFrame:
    """Reduced rows of several parts as one row per key: the same maximum that made them."""
    return parts.groupBy(*keys).agg(*[F.max(g).alias(g) for g in groups], F.min("reported_date").alias("reported_date"),
                                    F.max("updated_date").alias("updated_date"))


def merge_parts(parts: DataFrame, keys: list[str], groups: Groups) -> DataFrame:
    """The registry's rows: the parts of all batches merged per key, with the columns of the groups."""
    merged = merge_reduced(parts, keys, groups)
    return merged.selectExpr(*keys, *[f"{g}.v.{c} as {c}" for g, (cols, _) in groups.items() for c in cols],
                             "reported_date", "updated_date")


class Registry:
    MOST_PARTS = 4
    MANIFEST = "bucket int, part string"

    def __init__(self, spark: SparkSession, path: str, keys: list[str], groups: Groups, order: list[str], date: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.keys, self.groups, self.order, self.date = keys, groups, order, date

    def _found(self, pattern: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, [x.getPath() for x in fs.globStatus(path) or ()]

    def batches(self) -> list[int]:
        """The batches whose manifest was written whole."""
        return sorted(int(p.getParent().getName().split("=")[1]) for p in self._found("manifest/*/_SUCCESS")[1])

    def live(self, batch: int | None = None) -> list[tuple[int, str]]:
        """(bucket, part) after a batch (the last one): at most MOST_PARTS rows a bucket."""
        done = self.batches()
        if not done:
            return []
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest/batch={done[-1] if batch is None else batch}")
        return sorted((r.bucket, r.part) for r in rows.collect())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def reduced(self, live: list[tuple[int, str]]) -> DataFrame:
        """Reduced rows of the given parts."""
        folders = [f"{self.path}/parts/part={part}/bucket={bucket}" for bucket, part in live]
        return self.spark.read.option("basePath", f"{self.path}/parts").parquet(*folders).drop("part")

    def _write(self, rows: DataFrame, part: str) -> list[tuple[int, str]]:
        """Writes a part by bucket; a large bucket may take several files."""
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/parts/part={part}")
        return [(int(p.getName().split("=")[1]), part) for p in self._found(f"parts/part={part}/bucket=*")[1]]

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Takes a batch in; a foreachBatch function."""
        before = self.batches()
        if batch_id in before:
            return
        rows = reduce_batch(batch, self.keys, self.groups, self.order, self.date).withColumn("bucket", self.bucket())
        live = self.live() + self._write(rows, f"batch-{batch_id}")
        parts = Counter(bucket for bucket, _ in live)
        crowded = {bucket for bucket, n in parts.items() if n > self.MOST_PARTS}
        if crowded:
            merged = merge_reduced(self.reduced([x for x in live if x[0] in crowded]), ["bucket", *self.keys], self.groups)
            live = [x for x in live if x[0] not in crowded] + self._write(merged, f"merged-{batch_id}")
        manifest = self.spark.createDataFrame(sorted(live), self.MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")
        self._clean({*live, *(self.live(before[-1]) if before else ())}, {batch_id, *before[-1:]})

    def _clean(self, named: set[tuple[int, str]], manifests: set[int]) -> None:
        fs, folders = self._found("parts/part=*/bucket=*")
        for p in folders:
            if (int(p.getName().split("=")[1]), p.getParent().getName().split("=", 1)[1]) not in named:
                fs.delete(p, True)
        for p in self._found("manifest/batch=*")[1]:
            if int(p.getName().split("=")[1]) not in manifests:
                fs.delete(p, True)

    def rows(self) -> DataFrame:
        """All rows of the registry; needs a batch with rows."""
        return merge_parts(self.reduced(self.live()), self.keys, self.groups)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The registry's rows with the keys in ``wanted``, read from their buckets alone."""
        keys = wanted.select(*self.keys).distinct()
        own = {r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect()}  # at most ``buckets`` numbers
        live = [x for x in self.live() if x[0] in own]
        rows = self.reduced(live or self.live()[:1])
        return merge_parts(rows.join(keys, self.keys, "left_semi"), self.keys, self.groups)
