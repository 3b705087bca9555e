"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

Sets that reach similarity t share at least l of their first ``size - ceil(t * size) + l`` shingles, in any
order that all documents share. Rare shingles come first. Each document takes the l (1 to MAX_MATCHES) with
the least estimated cost: a longer prefix means more postings to read but fewer pairs to verify. Two
documents are compared when they share at least the smaller of their two l.

Documents with equal sets are one class, so copies are never paired. Within a posting list, everything is
first held against two leaders; what links to one is in one component and need not be compared among itself.
Only members of different components are then paired, behind the multi-match rule.

Defined results: null and empty texts (and texts of white space) have an empty set and link with nothing;
fewer words than a shingle make one shingle of the whole text. Columns other than doc_id and text are unused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaxframe.llm import blocks
from vaxframe.llm import words as w
from vaxframe.llm.components import components
from vaxframe.llm.keys import maybe_in, row_key
from vaxframe.sources.scratch import stage

SHINGLE_WORDS = 5
SIMILARITY = 80
MAX_MATCHES = 4
#: Buckets of the frequency sketch (1 MB of levels, broadcast), whatever the corpus. Any sketch gives the same
#: links; one with few shingles a bucket tells common from rare ones better and so leaves fewer pairs to verify.
SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
#: Cost of verifying a pair, in postings read.
VERIFY_COST = 20.0


def shingle_sets(texts: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of all documents of a chunk, and where each document's begin."""
    flat, bounds = w.flat_words(texts, w.SPACES_LOWER)
    hashes, n_docs = w.word_hashes(flat), len(bounds) - 1
    starts, docs = w.starts_inside(bounds, width)
    prints = [w.gram_hashes(hashes, width)[starts]] if len(starts) else [np.empty(0, np.uint64)]
    owners = [docs]
    lengths = np.diff(bounds)
    for short in range(1, width):
        which = np.flatnonzero(lengths == short)
        if len(which):
            prints.append(w.mix(w.gram_hashes(hashes, short)[bounds[which]] + np.uint64(short)))
            owners.append(which)
    values, owner = np.concatenate(prints), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(n_docs + 1))


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.mix(values + np.uint64(0x51ED2701)), dtype=np.uint64)])
    return w.mix(sums[bounds[1:]] - sums[bounds[:-1]] + w.mix(np.diff(bounds).astype(np.uint64))).view(np.int64)


def _profile_rows(batches):
    """A row per document, and at the end of the task its share of the frequency sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    for batch in w.chunks(batches):
        values, bounds = shingle_sets(batch.column("text"))
        sizes = np.diff(bounds)
        sketch += np.bincount((w.mix(values) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.int32)
        none, blank = pa.nulls(len(sizes), pa.int64()), pa.nulls(len(sizes), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(set_keys(values, bounds), mask=sizes == 0), none, blank],
            names=["doc_id", "row", "n_shingles", "key", "block", "counts"])
    parts = blocks.to_rows(sketch, SKETCH_BLOCK)
    none = pa.nulls(len(parts), pa.int64())
    for column in ("key", "n_shingles", "row", "doc_id"):
        parts = parts.add_column(0, column, none)
    yield from parts.to_batches(max_chunksize=64)


def _prefix_rows(sketch):
    """Postings of each class's adaptive prefix: token, key, set size n, the token's place, and the prefix's l."""

    def run(batches):
        levels, seen = sketch.value, set()
        usual = 1.5 * 2 ** (np.median(levels) / 4)
        for batch in w.chunks(batches):
            values, bounds = shingle_sets(batch.column("text"))
            keys = set_keys(values, bounds)
            sizes = np.diff(bounds)
            fresh = np.array([n > 0 and k not in seen and not seen.add(k) for k, n in zip(keys.tolist(), sizes.tolist(), strict=True)], bool)
            spread = w.mix(values)
            level = levels[(spread >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((spread, level, owner))
            values, count = values[order], 2 ** (level[order].astype(float) / 4)
            others = np.concatenate([[0.0], np.cumsum(np.maximum(count - usual, 0))])
            first = bounds[:-1]
            need = -(-SIMILARITY * sizes // 100)
            best, length = np.full(len(sizes), np.inf), np.zeros(len(sizes), np.int64)
            match = np.zeros(len(sizes), np.int64)
            for m in range(1, MAX_MATCHES + 1):
                upto = sizes - need + m
                pairs = (others[first + np.minimum(upto, sizes)] - others[first])
                cost = np.where((upto <= sizes) & (need >= m), upto + pairs + VERIFY_COST * pairs / m, np.inf)
                take = cost < best
                best[take], length[take], match[take] = cost[take], upto[take], m
            length[~fresh] = 0
            rows = w.ragged(first, length)
            yield from pa.table({
                "token": values[rows].view(np.int64), "key": np.repeat(keys, length),
                "n": pa.array(np.repeat(sizes, length), pa.int32()), "place": pa.array(rows - np.repeat(first, length), pa.int32()),
                "l": pa.array(np.repeat(match, length), pa.int32())}).to_batches(max_chunksize=200_000)

    return run


def _fresh_sets(batches):
    """Sets, their bounds, row keys and set keys of the documents of each chunk whose row key the task has not seen."""
    seen: set = set()
    for batch in w.chunks(batches):
        fresh = [i for i, row in enumerate(batch.column("row").to_pylist()) if row not in seen and not seen.add(row)]
        batch = batch.take(pa.array(fresh, pa.int64()))
        values, bounds = shingle_sets(batch.column("text"))
        yield values, bounds, batch.column("row").to_pylist(), set_keys(values, bounds)


def _set_rows(batches):
    """(row, key, shingles) once per task for each row key."""
    for values, bounds, rows, keys in _fresh_sets(batches):
        for at in range(0, len(rows), 500):
            part = range(at, min(at + 500, len(rows)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[at : at + 500], pa.int64()), pa.array(keys[at : at + 500], pa.int64()), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in part], pa.binary())],
                names=["row", "key", "shingles"])


def _parity(values: np.ndarray) -> bytes:
    """Bit i is the parity of the number of shingles hashed to i; 2 to 4 bits a shingle, a power of two."""
    width = 1 << max(6, int(2 * len(values) - 1).bit_length())
    return np.packbits(np.bincount((w.mix(values) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def _signature_rows(batches):
    """(row, key, n, parity) once per task for each row key."""
    for values, bounds, rows, keys in _fresh_sets(batches):
        yield pa.RecordBatch.from_pydict({
            "row": pa.array(rows, pa.int64()), "key": pa.array(keys, pa.int64()), "n": pa.array(np.diff(bounds), pa.int64()),
            "parity": pa.array([_parity(values[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})


def _possible(batches):
    """Pairs that their parities allow: where parities differ, an odd number of shingles belong to one set alone."""
    for batch in batches:
        kept = []
        left, right = batch.column("left"), batch.column("right")
        both = (batch.column("n_left").to_numpy() + batch.column("n_right").to_numpy()).tolist()
        for i in range(batch.num_rows):
            x, y = sorted((np.frombuffer(side[i].as_buffer(), np.uint8) for side in (left, right)), key=len)
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            most = (both[i] - int(np.bitwise_count(x ^ y).sum())) // 2
            if 100 * most >= SIMILARITY * (both[i] - most):
                kept.append(i)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def _verified(batches):
    for batch in batches:
        kept = []
        left, right = batch.column("left"), batch.column("right")
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(side[i].as_buffer(), np.uint64) for side in (left, right))
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = int((x[at] == y).sum())
            if 100 * both >= SIMILARITY * (len(x) + len(y) - both):
                kept.append(i)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def _of_classes(pairs: DataFrame, docs: DataFrame, classes: DataFrame, run, columns: str) -> DataFrame:
    """What ``run`` makes of one document for each class in some pair.

    Texts are not shuffled: a bitmap lets those documents through and a few others, whose rows go afterwards.
    """
    keys = pairs.selectExpr("explode(array(a, b)) as key").distinct()
    rows = stage(classes.groupBy("key").agg(F.min("row").alias("row")).join(keys, "key", "left_semi").select("row"), "rows")
    made = maybe_in(docs, "row", rows).select("row", "text").mapInArrow(run, f"row long, {columns}")
    return stage(made.join(rows, "row", "left_semi").dropDuplicates(["row"]).drop("row"), "sets")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity.

    Parities of a few bits a shingle bound what two sets share from above. Whole sets, 16 times as large at
    least, are read only for pairs within that bound.
    """
    signatures = _of_classes(pairs, docs, classes, _signature_rows, "key long, n long, parity binary")
    left = signatures.selectExpr("key as a", "parity as left", "n as n_left")
    right = signatures.selectExpr("key as b", "parity as right", "n as n_right")
    possible = stage(pairs.join(left, "a").join(right, "b").mapInArrow(_possible, "a long, b long").distinct(), "possible")
    sets = _of_classes(possible, docs, classes, _set_rows, "key long, shingles binary")
    left = sets.selectExpr("key as a", "shingles as left")
    right = sets.selectExpr("key as b", "shingles as right")
    return stage(possible.join(left, "a").join(right, "b").mapInArrow(_verified, "a long, b long").distinct(), "links")


#: Shared shingles that sets of sizes {0} and {1} need: 100 * both >= SIMILARITY * (x + y - both).
NEED = f"(({SIMILARITY} * ({{0}} + {{1}}) + {99 + SIMILARITY}) div {100 + SIMILARITY})"
#: Sizes allow the similarity.
SIZES_FIT = f"100 * least({{0}}, {{1}}) >= {SIMILARITY} * greatest({{0}}, {{1}})"
#: A shared token at these places can be among the first l shared ones of a similar pair.
PLACES_FIT = f"least({{0}}.n - {{0}}.place, {{1}}.n - {{1}}.place) + least({{0}}.l, {{1}}.l) - 1 >= {NEED}".replace("{0} +", "{0}.n +").replace("+ {1})", "+ {1}.n)")


def posting_lists(postings: DataFrame) -> DataFrame:
    """Postings of tokens that several classes hold, without those whose place rules out every partner in the list.

    A token at some place of a set of n shingles, among the first l that it shares with a partner of m, leaves
    at most n - place + l - 1 in common, which bounds m from above; the smallest set of the list must be within.
    A list's leader is the class with the fewest rarer shingles before the token: the one with the fewest edits.
    """
    postings = postings.withColumn("most", F.expr(f"(({100 + SIMILARITY} * (n - place + l - 1)) div {SIMILARITY}) - n"))
    several = stage(postings.groupBy("token").agg(F.min("key").alias("first"), F.max("key").alias("other")).where("first < other").select("token"), "several")
    lists = stage(maybe_in(postings, "token", several).join(several, "token").distinct(), "lists")
    for _ in range(2):  # the second time without what the first has ruled out
        shared = lists.groupBy("token").agg(
            F.min_by("key", "place").alias("leader"), F.min("key").alias("first"), F.max("key").alias("other"), F.min("n").alias("low")
        ).where("first < other").drop("first")
        lists = stage(lists.drop("leader", "other").join(shared, "token").where("most >= low").drop("low"), "lists")
    return lists.drop("most")


def rooted_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, key, root) of every row: its row key, set key and the component of its set, null without shingles."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", row_key().alias("row"), "text")
    profile = stage(docs.mapInArrow(_profile_rows, "doc_id long, row long, n_shingles long, key long, block long, counts binary"), "profile")
    classes = profile.where("block is null").select("doc_id", "row", "n_shingles", "key")

    counts = np.maximum(blocks.total(profile.where("block is not null"), 1 << SKETCH_BITS), 1)
    sketch = spark.sparkContext.broadcast(np.floor(4 * np.log2(counts)).astype(np.uint8))
    postings = stage(docs.mapInArrow(_prefix_rows(sketch), "token long, key long, n int, place int, l int"), "postings")
    lists = posting_lists(postings)

    # 1. Everything against the two leaders of its posting lists.
    sizes = lists.groupBy("key").agg(F.first("n").alias("n"))
    led = lists.selectExpr("explode(array(leader, other)) as leader", "key", "n").where("key <> leader").distinct().join(sizes.selectExpr("key as leader", "n as leader_n"), "leader")
    stars = stage(led.where(SIZES_FIT.format("n", "leader_n")).selectExpr("least(leader, key) as a", "greatest(leader, key) as b").distinct(), "stars")
    links = verify(stars, docs, classes)
    roots = components(links)

    # 2. Members of different components, behind the multi-match rule and the places of what they share.
    placed = lists.join(roots.selectExpr("node as key", "root"), "key", "left").withColumn("root", F.expr("coalesce(root, key)")).drop("leader", "other")
    split = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    rest = stage(placed.join(split, "token"), "rest")
    pairs = (
        rest.alias("x").join(rest.alias("y"), "token").where("x.key < y.key and x.root <> y.root")
        .where(SIZES_FIT.format("x.n", "y.n")).where(PLACES_FIT.format("x", "y"))
        .selectExpr("x.key as a", "y.key as b", "x.n as n_a", "y.n as n_b", "least(x.l, y.l) as l", "x.n - x.place as left_a", "y.n - y.place as left_b")
        .groupBy("a", "b", "n_a", "n_b", "l").agg(F.count("*").alias("both"), F.min("left_a").alias("left_a"), F.min("left_b").alias("left_b"))
        .where("both >= l").where(f"both + least(left_a, left_b) - 1 >= {NEED.format('n_a', 'n_b')}")
        .select("a", "b").join(stars, ["a", "b"], "left_anti")
    )
    more = verify(stage(pairs, "pairs"), docs, classes)
    roots = components(links.unionByName(more))

    return classes.join(roots.selectExpr("node as key", "root"), "key", "left").withColumn("root", F.expr("coalesce(root, key)"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach."""
    rooted = rooted_rows(docs)
    smallest = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    return rooted.join(smallest, "root", "left").selectExpr("doc_id", "n_shingles", "coalesce(smallest, doc_id) as component_id")
