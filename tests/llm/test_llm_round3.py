"""Conversation repair, ranked search and line dedup against brute-force versions, on small tables."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaxframe.llm import conversations, line_store, ranked_search, spans
from vaxframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
sys.setrecursionlimit(50_000)  # of the brute force
DOCS = "doc_id long, text string, uid long, sketch string, k1 long, gone string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DOCS)


# ---- 11: brute force over (row, state, inserts in a row), every path by (cost, audit)

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def repaired(rows):
    """(cost, audit, lines) of rows (role, text, fault)."""
    def tell(state):
        return "a" if state == "u" else "u"

    memo = {}

    def best(i, state, inserts):
        key = (i, state, inserts)
        if key not in memo:
            options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if inserts < 3:
                c, a, ls = best(i, tell(state), inserts + 1)
                options.append((c + 2, "I" + a, (({"u": "user:", "a": "assistant:"}[tell(state)]), *ls)))
            if i < len(rows):
                role, text, fault = rows[i]
                c, a, ls = best(i + 1, state, 0)
                options.append((c + 3, "D" + a, ls))
                if fault not in ("blank", "duplicate"):
                    cut = fault == "truncated"
                    if (state, role[:1]) in STEP:
                        c, a, ls = best(i + 1, STEP[state, role[:1]], 0)
                        options.append((c + cut, "K" + a, (f"{role}:{text}", *ls)))
                    c, a, ls = best(i + 1, tell(state), 0)
                    options.append((c + 2 + cut, "R" + a, ({"u": "user", "a": "assistant"}[tell(state)] + f":{text}", *ls)))
            memo[key] = min(options, key=lambda x: x[:2]) if options else (math.inf, "", ())
        return memo[key]

    return best(0, "", 0)


def expected_repairs(rows):
    out, groups = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        one = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, marked, counts = set(), [], Counter()
        for _, role, text in own:
            plain = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = repaired(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal,
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made_conversations():
    rng = random.Random(5)
    texts = ["Yes.", "No?", "cut off", "", " \n", None, "Fine!", "ünï\x0b. ", "a longer answer. It ends here."]
    rows = []
    for conv in [*range(40), None]:
        for _ in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "", None, "tool", "user", "assistant"]), rng.choice(texts)))
    unique = {(r[0], r[1], r[2] or " "): r for r in rows}  # rows of one turn and role are ordered by hash, which the brute force doesn't know
    return list(unique.values())


def repairs(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, copies int, conv string").drop("copies")
        got = conversations.repair_digest(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_repairs_match_brute_force(spark, partitions):
    rows = made_conversations()
    assert repairs(spark, rows, partitions) == expected_repairs(rows)


@pytest.mark.parametrize("held", [1 << 22, 200])
def test_long_conversation_over_many_tasks(spark, monkeypatch, held):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "user", "assistant"]), rng.choice(["Yes.", "cut", f"text {t}."])) for t in range(700)] + [(8, 1, "user", "Hi.")]
    monkeypatch.setattr(conversations, "HELD_BYTES", held)
    monkeypatch.setattr(conversations, "SEGMENT", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert repairs(spark, rows, 6) == expected_repairs(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_conversations_and_identical_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair_digest(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 1, "user", "Same.")] * 300 + [(1, 2, "assistant", "Same.")]
    got = conversations.repair(spark.createDataFrame(rows, schema)).first()
    assert (got.duplicate, got.cost, got.audit) == (299, 3 * 299, "K" + "D" * 299 + "K")
    alone = next(k for k in range(1000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    gone = conversations.repair_digest(spark.createDataFrame([(alone, 1, "user", "Hi.")], schema)).first()
    assert tuple(gone) == (alone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_op11_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert got == expected_repairs(rows)


# ---- 12


def ranked(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(line_store.UPPER, line_store.LOWER)))
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:10], 1)]
    return sorted(out, key=repr)


def test_search_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "日本語", "X9", "the"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice([".", "\n", "!"])
    rows = [(i, prose(rng.randrange(1, 60))) for i in range(120)] + [(200, prose(4000)), (201, "the " * 700), (202, None), (203, ""), (204, "!!"), (None, "the X9")]
    rows += [(300 + i, rows[3][1]) for i in range(15)] + [(3, rows[3][1])]  # ties and repeated rows
    items = [(k, prose(rng.randrange(1, 20))) for k in range(30)] + [(40, rows[3][1]), (41, None), (42, ""), (43, "absent words only"), (40, "the"), (None, "x9 ünï")]
    for name, value in (("STEP", 2), ("CELLS", 700), ("BLOCK_ITEMS", 20), ("COUNTED_TERMS", 50)):
        monkeypatch.setattr(ranked_search, name, value)
    got = ranked_search.search(docs_of(spark, rows).repartition(4), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score long"))
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == ranked(rows, items)


def test_search_of_empty_tables(spark):
    none, items = docs_of(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(docs_of(spark, [(1, "a b")]), items.limit(0)).count() == 0


# ---- 13


def deduped(rows):
    key = lambda x: x.strip(line_store.BLANKS).translate(str.maketrans(line_store.UPPER, line_store.LOWER))
    holders = defaultdict(set)
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(doc)
    top = {k: max(d for d in ids if d is not None) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if top.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lines_rows():
    rng = random.Random(4)
    pool = [f"Line number {k} that many documents hold" for k in range(30)] + ["short", "", "  \t", "ÄÖ exactly twenty ch.", "exactly nineteen ch"]
    text = lambda n: "\n".join(rng.choice([x, x.upper(), f"  {x}\r", x]) for x in (rng.choice(pool) for _ in range(n)))
    rows = [(i, text(rng.randrange(1, 8))) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (103, text(3000)), (None, text(20)), (5, text(6)), rows[7]]


def kept(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)


def test_lines_match_brute_force(spark):
    rows = lines_rows()
    assert kept(line_store.dedup_lines(docs_of(spark, rows).repartition(5))) == deduped(rows)
    assert line_store.dedup_lines(docs_of(spark, [])).count() == 0


def test_store_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(line_store, "FILTER_BYTES", 1)  # a shard at a time
    rows = [r for r in lines_rows() if r[0] is not None]
    a, b = [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2]
    store = line_store.LineStore(spark, shards=3)
    store.insert(docs_of(spark, a))
    assert kept(store.clean(docs_of(spark, a))) == deduped(a)
    store.insert(docs_of(spark, b))
    store.insert(docs_of(spark, b))  # again: changes nothing
    assert kept(store.clean(docs_of(spark, rows))) == deduped(rows)
    store.delete(spark.createDataFrame([(r[0],) for r in b] + [(9999,)], "doc_id long"))
    reopened = line_store.LineStore(spark, store.folder, shards=3)
    assert reopened.version == 4
    assert kept(reopened.clean(docs_of(spark, a))) == deduped(a)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 30_000, dtype=np.uint64)
    f = line_store.Cuckoo()
    for part in np.array_split(keys, 7):
        f.add(part)
    f = line_store.Cuckoo.load(f.dump())
    assert f.holds(keys).all()
    assert f.holds(rng.integers(0, 2**63, 30_000, dtype=np.uint64)).mean() < 0.01
    f.remove(keys[:10_000])
    assert f.holds(keys[10_000:]).all() and f.holds(keys[:10_000]).mean() < 0.1
    f.add(keys[:10_000])
    assert f.holds(keys).all()


# ---- the pipeline's stages on rows with any columns, and mended details

ODD = "doc_id long, text string, lang string, source string, n_chars long, _key long, _p long, row string, key string, `a.b` int, spans string"


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal"])
def test_stages_keep_any_columns(spark, name):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [" ".join(f"v{rng.randrange(3000)}" for _ in range(80)) for _ in range(12)]
    rows = [(i, t, "en", "s", 1, 7, 9, f"r{i}", f"k{i}", i, "x") for i, t in enumerate([*texts, None, "", " ", texts[0], "write to me@example.org now " + texts[1]])]
    rows += [rows[3]] * 2
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    stage = getattr(corpus_pipeline, name)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    given = {tuple(r) for r in rows}
    if name == "personal":
        assert len(got) == len(rows) and sum(r.text is None for r in got) == 1
        assert {(r.doc_id, *r[2:]) for r in got} == {(r[0], *r[2:]) for r in given}
        assert [r.text for r in got if r.doc_id == 16] == [rows[16][1].replace("me@example.org", "[EMAIL]")]
    else:
        assert {tuple(r) for r in got} <= given
    if name == "near_duplicates":
        assert sorted(r.doc_id for r in got) == [*range(15)]  # 15 and 16 are copies of 0 and 1
    if name == "benchmark_decontamination":
        assert len(got) == len(rows)
    if name == "quality_rules":
        assert {r.doc_id for r in got} == {*range(12), 15, 16} and sum(r.doc_id == 3 for r in got) == 3
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_items_without_an_id_are_not_named(spark):
    from vaxframe.llm import decontaminate

    items = spark.createDataFrame([(None, "alpha beta"), (3, "gamma")], "item_id long, text string")
    got = decontaminate.contamination_digest(docs_of(spark, [(1, "x alpha beta y gamma"), (2, "alpha beta")]), items).collect()
    assert {(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in got} == {(1, 3, 1, True), (2, 2, 0, True)}


def test_wide_classes_are_indexed():
    from vaxframe.llm import secret_index

    query = secret_index.trigram_query
    github = next(r for r in secret_index.RULES if r.kind == "github")
    assert query(github.pattern) == sorted((frozenset({f"gh{c}", f"h{c}_"}) for c in "oprsu"), key=sorted)
    assert query("abc[" + "".join(map(chr, range(97, 123))) + "]def") == sorted(
        (frozenset({"abc", f"bc{c}", f"c{c}d", f"{c}de", "def"}) for c in map(chr, range(97, 123))), key=sorted)
    assert query("abc[qwertyuiop][asdfghjkl]xyz") == sorted((frozenset({"abc", f"bc{c}", "xyz"}) for c in "qwertyuiop"), key=sorted)


def test_folds_halving_and_replacing_over_many_blocks(spark):
    sizes = [0, 1, 255, 256, 257, 1000]
    rows = spark.createDataFrame([(n, [(i * 37) % 11 for i in range(n)]) for n in sizes], "n int, xs array<int>")
    got = rows.select(
        "n", spans.running(F.col("xs"), lambda a, b: a + b).alias("sums"), spans.running(F.col("xs"), spans.larger).alias("tops"),
        F.transform(F.lit([-1, 0, 3, 10, 11]), lambda v: spans.below(F.sort_array("xs"), lambda x: x < v)).alias("below")).collect()
    for r in got:
        xs = [(i * 37) % 11 for i in range(r.n)]
        assert r.sums == [sum(xs[: i + 1]) for i in range(r.n)]
        assert r.tops == [max(xs[: i + 1]) for i in range(r.n)]
        assert r.below == [sum(x < v for x in xs) for v in (-1, 0, 3, 10, 11)]
    text = "".join(f"é{i} " for i in range(700))
    marks = [(m.start(), m.end() + (i % 3 == 0) * 4) for i, m in enumerate(re.finditer("[0-9]+", text))]
    out, at = [], 0
    for start, end in marks:
        if start >= at:
            out.append(text[at:start] + "<" + str(start) + ">")
        at = max(at, end)
    held = spark.createDataFrame([(text, marks)], "text string, marks array<struct<start:int,end:int>>")
    word = lambda s: F.concat(F.lit("<"), s["start"].cast("string"), F.lit(">"))
    assert held.select(spans.replaced(F.col("text"), F.col("marks"), word)).first()[0] == "".join(out) + text[at:]
