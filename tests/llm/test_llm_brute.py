"""op4, op7, op8 and op9 against step-by-step versions in plain Python, over a whole table and over awkward texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import sqrt

import pytest

from vaxframe.llm import host_reputation, personal_data, queries, secret_index

SF = "/root/testdata/sf0.01"


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def base_spans(text, rules, by_start):
    found = [(m.start(), place, kind, m.end()) for place, (kind, (pattern, fits)) in enumerate(rules.items())
             for m in re.finditer(pattern, text or "", re.ASCII) if fits(m)]
    found.sort(key=(lambda s: s[:2]) if by_start else (lambda s: (s[1], s[0])))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in found]


def awkward(pieces, seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


PERSONAL_PIECES = ["a", "é", "@", ".", "-", "+", "%", " ", "  ", "\n", " ", "(", ")", "0", "7", "19", "255", "256", "4111", "4111 1111 1111 1111",
                   "1.2.3.4", "x@y.z", "+1 (017) 555-7713", "🎉", "٣", "word "]
SECRET_PIECES = ["password", "PassWd", "ſecret", "SECRET", "toKen", "toKen", "api_key", "APIkey", "=", ":", " ", "'", '"', "abcDEF123", "short", "+/_.=-",
                 "AKIA", "ABCD1234EFGH", "Z9", "0123456789abcdef", "f" * 16, "é", "🎉", "\n", "ghp_", "x"]


@pytest.mark.parametrize("digest, rules, pieces, by_start", [
    (personal_data.personal_digest, PERSONAL, PERSONAL_PIECES, False), (secret_index.secrets_digest, SECRETS, SECRET_PIECES, True)])
def test_base_spans(spark, digest, rules, pieces, by_start):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    texts |= {-i - 1: t for i, t in enumerate([None, "", *awkward(pieces, 5)])}
    got = {r.doc_id: r for r in digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got.keys() == texts.keys()
    total = Counter()
    for doc_id, text in texts.items():
        want, row = base_spans(text, rules, by_start), got[doc_id]
        counts = Counter(s.split(":")[0] for s in want)
        total += counts
        assert {k: row[f"n_{k}"] for k in rules} == {k: counts[k] for k in rules}, (doc_id, text)
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (doc_id, text, want)
        assert not Counter(want) - Counter(row.spans.split(",")), (doc_id, text)
    assert all(total[k] for k in rules)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, re.split("[?#]", rest[cut:], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(name + start), name + start, verdict) for verdict, name, start in host_reputation.RULES
            if (host == name or host.endswith("." + name)) and path.startswith(start)]
    return max(fits)[1:] if fits else (None, None)


def lower_bounds(outcomes):
    """host: lower bound of its rate, from {host: (blocked, labelled)}."""
    def family(host):
        labels = host.split(".")
        if re.fullmatch(r"[0-9.:\[\]]*", host):
            return host, host
        wide = min(len(labels), 2 if ".".join(labels[-2:]) in host_reputation.LONG_SUFFIXES else 1)
        return ".".join(labels[-wide:]), ".".join(labels[-min(len(labels), wide + 1):])

    suffixes, domains = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for host, (y, n) in outcomes.items():
        for table, key in ((suffixes, family(host)[0]), (domains, family(host))):
            table[key][0] += y
            table[key][1] += n
    rate = (sum(y for y, _ in outcomes.values()) + 0.5) / (sum(n for _, n in outcomes.values()) + 1)

    def strength(level):
        level = [(y, n) for y, n in level if n]
        total, noise = sum(n for _, n in level), rate * (1 - rate)
        room = (total - sum(n * n for _, n in level) / total if total else 0) - (len(level) - 1)
        if len(level) < 2 or room <= 0:
            return 2.0
        spread = sum(n * (y / n - rate) ** 2 for y, n in level)
        within = min(max((spread - noise * (len(level) - 1)) / (noise * room), 0.001), 0.9)
        return (1 - within) / within

    s, d, h = strength(suffixes.values()), strength(domains.values()), strength(outcomes.values())
    lows = {}
    for host, (y, n) in outcomes.items():
        suffix, domain = family(host)
        up = (suffixes[suffix][0] + s * rate) / (suffixes[suffix][1] + s)
        up = (domains[suffix, domain][0] + d * up) / (domains[suffix, domain][1] + d)
        a, b = y + h * up, n - y + h * (1 - up)
        lows[host] = a / (a + b) - host_reputation.BOUND * sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return lows


def test_urls(spark):
    pieces = ["http", "://", "://", "/", "?", "#", ".", "com", "example.com", "www.example.com", "/en/", "net", "/es/", "/fr/", "NET", "É", "co.uk", "bad.net/es/",
              "10.0.0.1", ":80", "\n", "x"]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    urls |= {-i - 1: u for i, u in enumerate([None, "", "example.com/en/", *[f"http://{u}" for u in awkward(pieces, 6, 300)], *awkward(pieces, 7, 100)])}
    got = host_reputation.judge(spark.createDataFrame(list(urls.items()), "page_id long, url string")).collect()
    parsed = {i: split_url(u) for i, u in urls.items()}
    ruled = {i: rule_of(*p) for i, p in parsed.items()}
    outcomes = defaultdict(lambda: [0, 0])
    for i, (host, _) in parsed.items():
        outcomes[host][0] += ruled[i][1] == "block"
        outcomes[host][1] += ruled[i][1] is not None
    low = lower_bounds(outcomes)
    assert len(got) == len(urls)
    for r in got:
        rule, verdict = ruled[r.page_id]
        assert (r.host, r.path, r.rule) == (*parsed[r.page_id], rule), urls[r.page_id]
        if verdict or abs(low[r.host] - host_reputation.THRESHOLD) > 1e-9:
            assert r.verdict == (verdict or ("block" if low[r.host] > host_reputation.THRESHOLD else "allow")), urls[r.page_id]
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_shards(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op9_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= 1.06 * min(sizes.values())
