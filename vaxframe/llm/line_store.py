"""Incremental line dedup: exact reference tables behind sharded cuckoo filters.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of LEAST_CHARS code points and more
count. A key that LEAST_DOCS documents or more hold is active: its lines go everywhere but in the largest doc_id.

The store is a folder of versions, one per change:

* ``refs``: a row (key, doc_id, n) per document that holds the key, +1 where it came and -1 where it went, partitioned by
  shard. The sum per key and document is exact, so documents can be deleted and the store is as if they never came.
* ``filters``: per shard the cuckoo filter of its active keys. A change rewrites the filters of those shards alone in which a
  key became active (added) or stopped being so (removed); every active key is added once, and a removal never takes
  away a fingerprint that another key needs.

``drops`` passes the references through the filters of a bounded number of shards at a time. What passes holds all references
of active keys and few others, is counted exactly, and names the lines to drop. Only that part is shuffled.

Keys are 128 bits of two 64-bit hashes. A version counts once its ``filters`` folder is written whole; a change that failed
half way is written over by the next one.

Defined results: null and empty texts are one empty line; rows of one doc_id are one document for counting; rows without a
doc_id count as one document that is smaller than any other; inserting a stored document again changes nothing for
lines that it already holds; deleting unknown ids changes nothing. Columns other than doc_id and text are unused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaxframe.llm import words as w
from vaxframe.sources.scratch import new_path, stage

LEAST_CHARS, LEAST_DOCS = 20, 3
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shards of a store; more for one whose active keys would take more than some 10 million a shard.
SHARDS = 16
#: Bytes of filters that are broadcast at a time.
FILTER_BYTES = 32 << 20
REFS = "shard int, k1 long, k2 long, doc_id long, n int"
FILTERS = "shard int, cells binary"


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; a further table follows when the others are full."""

    SLOTS, LEAST_BITS, ROUNDS, LOAD = 4, 8, 200, 0.9

    def __init__(self):
        self.tables: list[np.ndarray] = []

    @classmethod
    def load(cls, cells: bytes | None) -> Cuckoo:
        """From what ``dump`` gave: each table after the number of its bucket bits."""
        out, flat, at = cls(), np.frombuffer(cells or b"", np.uint16), 0
        while at < len(flat):
            size = cls.SLOTS << int(flat[at])
            out.tables.append(flat[at + 1 : at + 1 + size].reshape(-1, cls.SLOTS).copy())
            at += 1 + size
        return out

    def dump(self) -> bytes:
        return b"".join(np.uint16(len(x).bit_length() - 1).tobytes() + x.tobytes() for x in self.tables)

    @staticmethod
    def _spread(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (never 0, which is a free slot), and bits for the buckets."""
        spread = w.mix(hashes.astype(np.uint64))
        return np.maximum(spread >> np.uint64(48), np.uint64(1)).astype(np.uint16), spread

    @staticmethod
    def _bucket(table: np.ndarray, spread: np.ndarray) -> np.ndarray:
        return (spread & np.uint64(len(table) - 1)).astype(np.int64)

    def _other(self, table: np.ndarray, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ self._bucket(table, w.mix(prints.astype(np.uint64)))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        prints, spread = self._spread(hashes)
        found = np.zeros(len(hashes), bool)
        for table in self.tables:
            bucket = self._bucket(table, spread)
            for rows in (bucket, self._other(table, prints, bucket)):
                found |= (table[rows] == prints[:, None]).any(1)
        return found

    def _table(self, bits: int) -> np.ndarray:
        self.tables.append(np.zeros((1 << bits, self.SLOTS), np.uint16))
        return self.tables[-1]

    def add(self, hashes: np.ndarray) -> None:
        prints, spread = self._spread(hashes)
        for table in list(self.tables):
            room = max(0, int(self.LOAD * table.size) - np.count_nonzero(table))
            self._fill(table, prints[:room], self._bucket(table, spread[:room]))
            prints, spread = prints[room:], spread[room:]
        if len(prints):
            table = self._table(max(self.LEAST_BITS, int(2 * len(prints) / self.SLOTS).bit_length()))
            self._fill(table, prints, self._bucket(table, spread))

    def _fill(self, table: np.ndarray, prints: np.ndarray, bucket: np.ndarray) -> None:
        """Puts fingerprints in free slots of their bucket, else of the other one, else in place of one that moves on.

        What finds no place in ROUNDS turns goes to a new table of the same size, where its buckets hold too.
        """
        rng = np.random.default_rng(len(prints))
        for turn in range(self.ROUNDS):
            if not len(prints):
                return
            order = np.argsort(bucket, kind="stable")
            prints, bucket = prints[order], bucket[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            free = table[bucket] == 0
            fits = rank < free.sum(1)
            slot = np.argmax(np.cumsum(free[fits], 1) > rank[fits, None], axis=1)
            table[bucket[fits], slot] = prints[fits]
            prints, bucket = prints[~fits], bucket[~fits]
            if turn and len(prints):
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                slot = rng.integers(0, self.SLOTS, len(first))
                moved = table[bucket[first], slot]
                table[bucket[first], slot] = prints[first]
                prints[first] = moved
            bucket = self._other(table, prints, bucket)
        if len(prints):
            self._fill(self._table(len(table).bit_length() - 1), prints, bucket)

    def remove(self, hashes: np.ndarray) -> None:
        """Takes out one fingerprint of each of these keys; each must have been added.

        In one table, equal fingerprints in a key's two buckets stand for one another. If several tables have one, it is
        not known whose it is and all stay: a key too many passes, none is lost.
        """
        prints, spread = self._spread(hashes)
        for k in range(len(prints)):
            found = []
            for table in self.tables:
                bucket = self._bucket(table, spread[k : k + 1])
                rows = [bucket[0], self._other(table, prints[k : k + 1], bucket)[0]]
                found += [(table, row, slot) for row in rows for slot in np.flatnonzero(table[row] == prints[k])[:1]][:1]
            if len(found) == 1:
                table, row, slot = found[0]
                table[row, slot] = 0


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def references(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, k1, k2, doc_id): each key once for each document that holds it."""
    keys = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key), lambda k: F.length(k) >= LEAST_CHARS)
    rows = docs.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).select(
        F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.select(F.pmod("k2", F.lit(shards)).cast("int").alias("shard"), "*")
    # by document and not by key: a line that very many documents hold has no task of its own
    return rows.repartition("shard", "doc_id").dropDuplicates(["shard", "k1", "k2", "doc_id"])


def _changed(old: pa.Table, change: pa.Table) -> pa.Table:
    """The filter of a shard after keys were added (n = 1) or removed (n = -1)."""
    filters = Cuckoo.load(old.column("cells")[0].as_py() if old.num_rows else None)
    n, keys = change.column("n").to_numpy(), change.column("k1").to_numpy().view(np.uint64)
    filters.remove(keys[n < 0])
    filters.add(keys[n > 0])
    return pa.table({"shard": change.column("shard")[:1], "cells": pa.array([filters.dump()], pa.binary())}) if change.num_rows else old.select(["shard", "cells"])[:0]


def _passing(shared):
    def run(batches):
        filters = {shard: Cuckoo.load(cells) for shard, cells in shared.value.items()}
        for batch in batches:
            shard, keys = batch.column("shard").to_numpy(), batch.column("k1").to_numpy().view(np.uint64)
            keep = np.zeros(batch.num_rows, bool)
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                keep[own] = filters[s].holds(keys[own]) if s in filters else False
            yield batch.filter(pa.array(keep))

    return run


def _seeded(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=seed)


def _kept_rows(batches):
    """Texts without the lines whose keys are in ``gone``."""
    fold = str.maketrans(UPPER, LOWER)
    for batch in w.chunks(batches):
        ids, lines_out, dropped, kept = batch.column("doc_id"), [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines, gone = (text or "").split("\n"), {g % (1 << 64) for g in gone}
            stay = [x for x in lines if len(k := x.strip(BLANKS).translate(fold)) < LEAST_CHARS or _seeded(k, 42) not in gone]
            lines_out.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append("\n".join(stay))
        yield pa.RecordBatch.from_arrays([ids, pa.array(lines_out, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                                         names=["doc_id", "n_lines", "n_dropped", "kept"])


class LineStore:
    """The stored state; ``folder`` must be one that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int = SHARDS):
        self.spark, self.folder, self.shards = spark, folder or new_path(spark, "line-store"), shards
        self.version = max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        """Versions whose filters were written whole."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/filters/*/_SUCCESS")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        return [int(x.getPath().getParent().getName().split("=")[1]) for x in found or ()]

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/version={v}" for v in range(1, self.version + 1)]
        rows = self.spark.createDataFrame([], f"version int, {schema}")
        for v, path in enumerate(paths, 1):
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(path).withColumn("version", F.lit(v))) if v > 1 else (
                self.spark.read.schema(schema).parquet(path).withColumn("version", F.lit(v)))
        return rows

    def refs(self) -> DataFrame:
        """(shard, k1, k2, doc_id) of all documents that are in the store now."""
        rows = self._read("refs", REFS)
        if self.version > 1:  # one version holds no row twice and takes none back
            rows = rows.groupBy("shard", "k1", "k2", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        return rows.select("shard", "k1", "k2", "doc_id")

    def filters(self) -> DataFrame:
        """(shard, cells): the last filter of each shard that has one."""
        return self._read("filters", FILTERS).groupBy("shard").agg(F.max_by("cells", "version").alias("cells"))

    def _commit(self, change: DataFrame) -> None:
        """Writes a change of references, and the filters of the shards in which keys became active or stopped being so."""
        version = self.version + 1
        path = f"{self.folder}/refs/version={version}"
        change.write.mode("overwrite").partitionBy("shard").parquet(path)
        written = self.spark.read.schema(REFS).parquet(path)
        by_key = written.groupBy("shard", "k1", "k2").agg(F.sum("n").alias("after"))
        if self.version:
            touched = by_key.select("shard", "k1", "k2")
            before = self.refs().join(touched, ["shard", "k1", "k2"], "left_semi").groupBy("shard", "k1", "k2").agg(F.count("*").alias("before"))
            by_key = by_key.join(before, ["shard", "k1", "k2"], "left").selectExpr(
                "shard", "k1", "k2", "coalesce(before, 0) as before", "coalesce(before, 0) + after as after")
        else:
            by_key = by_key.selectExpr("shard", "k1", "k2", "0L as before", "after")
        active = by_key.selectExpr("shard", "k1", f"int(after >= {LEAST_DOCS}) - int(before >= {LEAST_DOCS}) as n").where("n <> 0")
        old = self.filters()
        new = old.groupBy("shard").cogroup(active.groupBy("shard")).applyInArrow(_changed, FILTERS)
        new.write.mode("overwrite").parquet(f"{self.folder}/filters/version={version}")
        self.version = version

    def insert(self, docs: DataFrame) -> None:
        """Adds the documents' references."""
        new = references(docs, self.shards)
        if self.version:
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("shard", "k1", "k2", "doc_id")]
            new = new.alias("a").join(self.refs().alias("b"), same, "left_anti")
        self._commit(new.withColumn("n", F.lit(1)))

    def delete(self, ids: DataFrame) -> None:
        """Takes back all references of the documents in ``ids.doc_id``."""
        ids = ids.select("doc_id").distinct()
        gone = self.refs().alias("a").join(ids.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left_semi")
        self._commit(gone.withColumn("n", F.lit(-1)))

    def _groups(self):
        """Shards whose filters together take at most FILTER_BYTES (or one shard), as {shard: cells}."""
        sizes = self.filters().select("shard", F.octet_length("cells").alias("size")).orderBy("shard").collect()  # a row per shard
        group, total = [], 0
        for r in [*sizes, None]:
            if group and (r is None or total + r.size > FILTER_BYTES):
                yield {x.shard: x.cells for x in self.filters().where(F.col("shard").isin(group)).collect()}
                group, total = [], 0
            if r is not None:
                group.append(r.shard)
                total += r.size

    def drops(self) -> DataFrame:
        """(k1, k2, doc_id): the lines that go, by key and document."""
        passed = None
        for group in self._groups():
            part = self.refs().where(F.col("shard").isin(list(group))).mapInArrow(_passing(self.spark.sparkContext.broadcast(group)), "shard int, k1 long, k2 long, doc_id long")
            passed = part if passed is None else passed.unionByName(part)
        if passed is None:
            return self.spark.createDataFrame([], "k1 long, k2 long, doc_id long")
        passed = stage(passed, "lines-passed")
        counts = passed.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("top"))
        active = stage(counts.where(F.col("docs") >= LEAST_DOCS), "lines-active")  # stored, so that the join knows its size before it shuffles
        return passed.join(active, ["k1", "k2"]).where("not doc_id <=> top").select("k1", "k2", "doc_id")

    def clean(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept) of stored documents, a row for each row of ``docs``."""
        lines = self.drops().groupBy("doc_id").agg(F.collect_list("k1").alias("gone"))  # at most a document's lines
        gone = stage(lines, "lines-dropped").withColumnRenamed("doc_id", "id")
        # nearly half of all documents lose a line: their texts meet the lines to drop in one shuffle, in the same way at any size
        rows = docs.select("doc_id", "text").join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
        whole = F.coalesce("text", F.lit(""))
        same = rows.where("gone is null").select("doc_id", F.size(F.split(whole, "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), whole.alias("kept"))
        less = rows.where("gone is not null").select("doc_id", "text", "gone").mapInArrow(_kept_rows, "doc_id long, n_lines long, n_dropped long, kept string")
        return same.unionByName(less)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of a whole table, by way of a store of its own."""
    store = LineStore(docs.sparkSession)
    store.insert(docs)
    return store.clean(docs)


def lines_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
