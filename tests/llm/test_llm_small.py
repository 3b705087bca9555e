"""Operators on small hand-made tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vaxframe.llm import (
    decontaminate, host_reputation, outliers, personal_data, pieces, quality_model, reshard, secret_index, shingle_join, substrings,
)
from vaxframe.llm.components import components
from vaxframe.llm.keys import maybe_in, without

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, other = prose(1, 120), prose(2, 90)
    shared = prose(3, 60)
    return [
        None, "", " \n\t ", "one two", "one two", base, base, base.replace("w1 ", "x1 ", 1), other,
        f"{prose(4, 40)} {shared} {prose(5, 40)}", f"{shared} {prose(6, 20)}", f"{prose(7, 30)}\n{shared}",
        "same " * 200, prose(8, 3000), "a" * 30_000, "Ünï ▁ çode 日本語 🎉\n \x0b x " * 4, f"{other} {other}",
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, "s", None, 7, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- 10


def kept_words(all_texts, k=35):
    words = [WORD.findall(t or "") for t in all_texts]
    seen = Counter(tuple(ws[i : i + k]) for ws in words for i in range(len(ws) - k + 1))
    out = []
    for ws in words:
        gone = {j for i in range(len(ws) - k + 1) if seen[tuple(ws[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(ws), len(gone), " ".join(x for i, x in enumerate(ws) if i not in gone)))
    return out


def test_repeats_match_brute_force(docs, texts):
    got = by_id(substrings.remove_repeats(docs))
    for i, (n, gone, kept) in enumerate(kept_words(texts)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest()), i


def test_repeats_of_repeated_rows_and_empty_table(spark, none):
    text = prose(11, 50)
    rows = spark.createDataFrame([(1, text), (1, text), (None, prose(12, 50))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(rows).collect()) == [(0, 0), (1, 50), (1, 50)]
    assert substrings.remove_repeats(none).count() == 0


def test_suffix_automaton_statistics():
    rng = random.Random(5)
    for _ in range(30):
        passages = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(4)]
        query = [rng.randrange(5) for _ in range(40)]
        machine = substrings.automata(passages, 1 << 30)[0]
        subs = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        want = [max([0, *(n for n in range(1, e + 2) if tuple(query[e - n + 1 : e + 1]) in subs)]) for e in range(len(query))]
        assert machine.statistics(query) == want


def test_reference_spans(spark, docs):
    shared = prose(3, 60)
    reference = spark.createDataFrame([(shared,), (prose(99, 80),), (None,)], "text string")
    for shard in (70, 10_000):
        got = by_id(substrings.remove_reference_spans(docs, reference, 35, shard))
        assert got[10].text == prose(6, 20) and got[9].text == f"{prose(4, 40)} {prose(5, 40)}" and got[0].text == ""
        assert got[8].text == prose(2, 90)


# ---- 5


def near_components(all_texts):
    sets = []
    for t in all_texts:
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)})
    root = list(range(len(sets)))
    for _ in sets:
        for a, b in itertools.combinations(range(len(sets)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def test_near_documents_match_brute_force(spark, docs, texts, none):
    got = by_id(shingle_join.similar_documents(docs))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == near_components(texts)
    assert shingle_join.similar_documents(none).count() == 0


def test_near_copies_of_one_template(spark):
    rng = random.Random(9)
    template = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        words = list(template)
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3])):
            words[at] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = by_id(shingle_join.similar_documents(rows))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(60)] == near_components(texts)


@pytest.mark.parametrize("bits", [7, 24])
def test_rows_without_keys(spark, bits):
    rows = spark.createDataFrame([(i if i % 7 else None, f"t{i}") for i in range(300)] + [(5, "t5")] * 3, "doc_id long, text string")
    keys = spark.createDataFrame([(i,) for i in range(0, 300, 5)] + [(None,)], "doc_id long")
    left = sorted(r.text for r in without(rows, "doc_id", keys, bits).collect())
    assert left == sorted(r.text for r in rows.collect() if r.doc_id is None or r.doc_id % 5)
    assert without(rows, "doc_id", keys.limit(0), bits).count() == 303 and without(rows.limit(0), "doc_id", keys, bits).columns == rows.columns
    assert {r.doc_id for r in rows.collect() if r.doc_id and r.doc_id % 5 == 0} <= {r.doc_id for r in maybe_in(rows, "doc_id", keys, bits).collect()}


def test_parities_keep_every_similar_pair():
    rng = np.random.default_rng(5)
    pairs, similar = [], []
    for n in rng.integers(1, 700, 400).tolist():
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.3 * rng.random()], rng.integers(0, 1 << 63, 1 + n // 9, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        similar.append(100 * both >= 80 * (len(x) + len(y) - both))
        pairs.append((x, y))
    batch = pa.RecordBatch.from_pydict({
        "a": list(range(len(pairs))), "b": [0] * len(pairs), "n_left": [len(x) for x, _ in pairs], "n_right": [len(y) for _, y in pairs],
        "left": pa.array([shingle_join._parity(x) for x, _ in pairs], pa.binary()), "right": pa.array([shingle_join._parity(y) for _, y in pairs], pa.binary())})
    kept = set(next(shingle_join._possible([batch])).column("a").to_pylist())
    assert {i for i, is_similar in enumerate(similar) if is_similar} <= kept
    assert sum(similar) > 50 and len(kept) < len(pairs)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 300), (300, 400), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 400: 300, 500: 300}


# ---- 3


def test_contamination_and_proximity(spark, docs, texts, none):
    items = [(1, texts[8]), (2, "ONE, two"), (3, None), (4, ""), (2, "w0 never there"), (5, " ".join(reversed(texts[8].split()[20:30])))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    got = by_id(decontaminate.contamination_digest(docs, bench))
    near = {(r.doc_id, r.item_id) for r in decontaminate.proximity_matches(docs, bench, slop=0).collect()}
    for i, text in enumerate(texts):
        ws, hit, found, close = split(text), set(), set(), set()
        for item, t in items:
            iw = split(t)
            k = min(10, len(iw))
            for s in range(len(iw) - k + 1) if k else []:
                for p in range(len(ws) - k + 1):
                    if ws[p : p + k] == iw[s : s + k]:
                        hit.update(range(p, p + k))
                        found.add(str(item))
                    if set(iw[s : s + k]) <= set(ws[p : p + k]):
                        close.add(str(item))
        want = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want, i
        assert {x for d, x in near if d == i} == close, i
    assert decontaminate.contamination_digest(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination_digest(docs, bench.limit(0)).collect()} == {0}


# ---- 2


def test_viterbi_finds_the_best_of_all_cuts():
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "▁a", "▁", "▁▁", "bca"]
    coder = pieces.Pieces([("", i) for i in range(256)] + [(p, 256 + i) for i, p in enumerate(names)])
    score = dict(zip(names, coder.score, strict=True))
    for n in range(1, 7):
        for part in map("".join, itertools.product("abcé", repeat=n)) if n < 5 else ["▁abcab", "▁▁acab", "abcabc"]:
            best = -np.inf
            for cuts in itertools.product([0, 1], repeat=len(part) - 1):
                at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(part)]
                cut = [part[a:b] for a, b in zip(at, at[1:], strict=False)]
                if all(x in score or len(x) == 1 for x in cut):
                    best = max(best, sum(score.get(x, pieces.BYTE_SCORE * len(x.encode())) for x in cut))
            ids = np.frombuffer(coder.parts([part])[0], "<i4")
            total = sum(coder.score[i - 256] if i >= 256 else pieces.BYTE_SCORE for i in ids)
            assert total == pytest.approx(best), part
            chars = np.array([ord(c) for c in part], np.int64)
            assert coder._ids(chars[None], *coder.alone(chars))[0].tolist() == ids.tolist()


def test_round_trip(spark, docs, texts, none):
    encoded = pieces.encode_documents(docs)
    got, back = by_id(encoded), by_id(pieces.decode_documents(encoded))
    for i, t in enumerate(texts):
        assert got[i].round_trip and back[i].text == (t or "") and got[i].n_pieces == len(got[i].pieces), i
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert got[0].n_pieces == got[1].n_pieces == 0 and got[15].n_bytes > 0
    assert pieces.encode_documents(none).count() == 0


# ---- 4 and 7


def test_personal_data(spark, none):
    texts = [None, "", "mail a@b.com_x@d.e and a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3",
             "4111 1111 1111 1111, 4111111111111112 41111111111111114111 +1 (234) 567-8901 +12345", "a" * 20_000 + "@" + "b.c" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(personal_data.personal_digest(rows))
    assert [got[i].spans for i in range(5)] == [
        "", "", "email:5:12,email:12:18,email:23:28", "ip:0:7,ip:8:15,ip:26:41", "card:0:19,phone:59:76"]
    assert got[5].n_email == 1
    masked = by_id(personal_data.mask(rows))
    assert masked[0].text is None and masked[4].text == "[CARD], 4111111111111112 41111111111111114111 [PHONE] +12345"
    assert personal_data.personal_digest(none).count() == 0 and personal_data.mask(none).columns == none.columns


def test_contexts_reveal_identifiers(spark):
    known = [f"Account holder ip 10.0.0.{i} was seen" for i in range(40)]
    rows = [*known, "Account holder ip 10.0.0.x7 was seen", "some other 10.0.0.y7 is here"]
    got = by_id(personal_data.personal_digest(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert got[40].spans == "ip:18:27" and got[40].n_ip == 0 and got[41].spans == ""


def test_contexts_of_several_words_and_at_the_ends(spark):
    luhn = lambda n: next(f"{n}{d}" for d in range(10) if sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(f"{n}{d}"[::-1])) % 10 == 0)
    cards = [" ".join(re.findall("....", luhn(f"4111111111{i:05d}"))) for i in range(40)]
    rows = [f"Please call {' ' * 60}+1 (017) 555-77{i:02d} before noon" for i in range(40)] + [f"charged to {c}, thanks" for c in cards]
    rows += [f"10.0.1.{i} begins here" for i in range(40)] + [f"written by u{i}@mail.org" for i in range(40)]
    asked = ["Please call 017 555 77x3 before noon", "charged to 4111 1111 1111 111x, thanks", "10.0.1.x begins here", "written by u7 AT 9mail.org", "written by u7@mail",
             "+1 (017) 555-7713 4111 x", "Please call 5 - 6 (7) before noon", "never 017 555 77x3 seen"]
    got = by_id(personal_data.personal_digest(spark.createDataFrame(list(enumerate(rows + asked)), "doc_id long, text string")))
    assert all(got[i].n_phone == 1 and len(got[i].spans.split(",")) == 1 for i in range(40)) and all(got[40 + i].n_card == 1 for i in range(40))
    assert [got[160 + i].spans for i in range(8)] == [
        "phone:12:24", "card:11:31", "ip:0:8", "", "email:11:18", "phone:0:22", "phone:12:21", ""]


def test_secrets(spark, none):
    key = "ghp_" + "a1B2" * 9
    texts = [None, "", 'PassWord = "abc123XYZ" token:short', "AKIA" + "A" * 12 + " AKIA" + "B" * 11, "x" + "0f" * 16 + " " + "0f" * 15, f"api_key: {key}", "apiKEY=12345678"]
    got = by_id(secret_index.secrets_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].spans for i in range(7)] == ["", "", "assign:0:21", "access:0:16", "hex:1:33", "assign:0:49,github:9:49", "assign:0:15"]
    assert secret_index.secrets_digest(none).count() == 0


def test_long_secrets(spark):
    token = lambda a, b, c: f"eyJ{'h' * a}.eyJ{'p-' * (b // 2)}.{'s_' * (c // 2)}"
    texts = [token(30, 5000, 43 * 2), token(5000, 20, 5000), "ghp_" + "Zz" * 150, "xoxb-" + "1-z" * 100, "eyJ" * 100_000,
             f"{token(20, 20, 8)} {token(9, 20, 20)} eyJ{'a' * 10}.{token(10, 10, 10)}", f"=x{token(12, 14, 16)}."]
    got = by_id(secret_index.secrets_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    third = texts[5].rindex(" ") + 1
    assert [got[i].spans for i in range(7)] == [
        f"jwt:0:{len(texts[0])}", f"jwt:0:{len(texts[1])}", "github:0:304", "slack:0:305", "", f"jwt:{third}:{third + 41}", f"jwt:2:{len(texts[6]) - 1}"]


def test_trigram_queries():
    query = secret_index.trigram_query
    assert query("ab[cd]e") == [frozenset({"abc", "bce"}), frozenset({"abd", "bde"})]
    assert query("abc?d") == [frozenset({"abc", "bcd"}), frozenset({"abd"})]
    assert query("[a-z]+") is None and query("abcd|x") is None
    assert query("(abc)+[0-9]xyz") == [frozenset({"abc", "xyz"})]


# ---- 6, 8, 9, 1


def test_quality_rules(spark, docs, texts, none):
    got = by_id(outliers.rules_digest(docs))
    for i, t in enumerate(texts):
        ws = WORD.findall(t or "")
        seen = Counter(tuple(ws[j : j + 3]) for j in range(len(ws) - 2))
        rep = len({k for j in range(len(ws) - 2) if seen[tuple(ws[j : j + 3])] > 1 for k in (j, j + 1, j + 2)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(ws) < 50 or 100 * rep > 50 * len(ws))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == want, i
        assert not (want[-1] and got[i].kept)
    assert outliers.rules_digest(none).count() == 0


def test_outliers_are_rejected_per_source(spark):
    rows = [(i, prose(i, 100, 5000), "en", "a") for i in range(120)] + [(1000 + i, prose(i, 100, 5000).replace(" ", "### "), "en", "a") for i in range(6)]
    got = by_id(outliers.rules_digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert all(got[i].kept for i in range(120)) and not any(got[1000 + i].kept for i in range(6))


def test_tables_are_outliers_and_a_repeated_line_is_none(spark):
    rows = [(i, prose(i, 100, 5000)) for i in range(200)]
    rows += [(1000 + i, re.sub(r"(\S+ \S+) ", r"\1 | ", prose(i, 100, 5000))) for i in range(8)]
    rows += [(2000 + i, "\n".join([prose(i, 9), prose(i, 9), prose(900 + i, 80, 5000)])) for i in range(3)]
    docs = spark.createDataFrame([(*r, "en", "a") for r in rows], "doc_id long, text string, lang string, source string")
    got = by_id(outliers.rules_digest(docs))
    assert not any(got[i].kept or got[i].base_failed for i in range(1000, 1008))
    assert all(got[i].kept for i in [*range(200), 2000, 2001, 2002])


def test_urls(spark):
    urls = [None, "no host", "http://A.Net/es/1?x", "http://example.com/en/2", "https://www.example.com/en/3#t", "http://www.example.com", "ftp://x.org/a://b?c"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in host_reputation.judge(rows).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(7)] == [
        ("", "", None), ("", "", None), ("a.net", "/es/1", "net/es/"), ("example.com", "/en/2", "example.com/en/"),
        ("www.example.com", "/en/3", "www.example.com/en/"), ("www.example.com", "", None), ("x.org", "/a://b", None)]
    assert (got[2].verdict, got[3].verdict, got[4].verdict) == ("block", "block", "allow")
    assert host_reputation.judge(rows.limit(0)).count() == 0


def test_host_rates_are_shrunk(spark):
    rows = [("bad.x.org", 90, 100), ("new.x.org", 0, 0), ("good.y.org", 0, 100), ("one.y.org", 1, 1), ("c.com", 0, 50)]
    got = {r.host: r for r in host_reputation.reputation(spark.createDataFrame(rows, "host string, y long, n long")).collect()}
    assert got["bad.x.org"].rate > got["new.x.org"].rate > got["good.y.org"].rate
    assert got["one.y.org"].rate < 1 and got["new.x.org"].low < got["bad.x.org"].low


def test_flow_moves_the_least():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randrange(0, 1000) for _ in range(rng.randrange(1, 6))]
        plan = reshard.transfer_plan(sizes, 4)
        total = sum(sizes)
        got = [sum(hi - lo for _, lo, hi, new in plan if new == j) for j in range(4)]
        assert got == [total // 4 + (j < total % 4) for j in range(4)]
        stay = sum(min(s, c) for s, c in zip(sizes, got, strict=False))
        assert sum(hi - lo for old, lo, hi, new in plan if old != new) == total - stay


def test_shards(spark, docs, texts, none, tmp_path):
    big = [(i % 900, prose(i, 1 + i % 37), i) for i in range(1000)] + [(None, None, 0)] * 5
    rows = spark.createDataFrame(big, "doc_id long, text string, shard long").repartition(5)
    out = reshard.shards_digest(rows).collect()
    assert len(out) == 1005 and sorted({r.shard for r in out}) == list(range(16))
    sizes = [sum(r.size for r in out if r.shard == j) for j in range(16)]
    assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / 16
    for j in range(16):
        assert sorted(r.slot for r in out if r.shard == j) == list(range(sum(r.shard == j for r in out)))
    assert reshard.shards_digest(none).count() == 0
    unique = docs.select("doc_id", "text")
    reshard.rewrite(unique, reshard.assign(unique), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() <= len(texts)


def test_rewrite_keeps_every_row_once(spark, tmp_path):
    rows = [(i % 300, prose(i % 300, 1 + i % 37), i, -i) for i in range(600)] + [(None, "no id", 1, 1)] * 40 + [(None, None, 2, None)] * 3 + [(7, None, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, slot long").repartition(5)
    path = str(tmp_path / "live")
    assigned = reshard.assign(docs, 3, 4)
    reshard.rewrite(docs, assigned, path)
    out = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in out.collect()) == Counter(rows)
    place = lambda df, a, b: Counter((r.doc_id, r[a], r[b]) for r in df.collect())
    assert place(out, "_shard", "_slot") == place(assigned, "shard", "slot")
    # Shard 0 takes shard 1's rows, shard 1 is left empty, shards 2 and 3 stay.
    stays = assigned.selectExpr("doc_id", "key", "shard as old_shard", "case when shard = 1 then 0 else shard end as shard", "slot + if(shard = 1, 10000, 0) as slot")
    reshard.rewrite(docs, spark.createDataFrame(stays.collect(), stays.schema), path)
    files = {r.f for r in out.where("_shard >= 2").selectExpr("input_file_name() as f").distinct().collect()}
    again = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in again.collect()) == Counter(rows) and again.where("_shard = 1").count() == 0
    assert files == {r.f for r in again.where("_shard >= 2").selectExpr("input_file_name() as f").distinct().collect()}


def test_quality_scores(spark, docs, texts, none):
    rows = [(i, prose(i, 60) if i % 2 else "### " * 30 + prose(i, 10)) for i in range(300)]
    labelled = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame([*rows, (300, None), (None, "")], "doc_id long, text string")
    got = quality_model.score_documents(table, labelled).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all((r.score > 0.5) == bool(r.doc_id % 2) for r in held)
    assert {r.score for r in quality_model.score_documents(docs, labelled.limit(0)).collect()} == {0.5}
    assert quality_model.score_documents(none, labelled).count() == 0


def test_pooled_vectors_ignore_chunking():
    texts = pa.array([prose(1, 50), None, "", prose(2, 80)])
    vectors = np.random.default_rng(1).normal(size=(quality_model.BUCKETS, quality_model.DIMS)).astype(np.float32)
    whole = quality_model.pool(vectors, texts)
    alone = np.concatenate([quality_model.pool(vectors, texts.slice(i, 1)) for i in range(4)])
    assert np.allclose(whole, alone) and not whole[1].any() and not whole[2].any()
