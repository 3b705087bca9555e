"""Secrets by an inverted index of trigrams.

Each rule's regular expression gives a Boolean trigram query (an OR of ANDs). The index keeps, for every
document, the trigrams that some query names; postings are intersected per clause, and only the documents
that remain are read by the rule's expression. A rule without mandatory trigrams reads every document.

Only DataFrame functions run on the rows. Defined results: a null text is empty and has no spans; rows alike
in id and text have equal results; an empty table has no results; a very long text is read whole, and placing very many
matches of one text takes time by the square of their number; other columns are not used, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaxframe.llm.keys import maybe_in, row_key
from vaxframe.llm.spans import matches, spelled
from vaxframe.sources.scratch import stage

SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` means the same in Python and Java; ``fits`` drops matches (no retry). ``index``, if not the pattern, matches all that is kept."""

    kind: str
    pattern: str
    fits: Callable[[Column], Column] = lambda value: F.lit(True)
    index: str = ""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which spans at one place are listed. The first three are the base.
BASE = (
    Rule("assign", _ASSIGN, lambda v: F.char_length(F.regexp_extract(v, "^" + _ASSIGN, 1)) >= 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),  # the same as AKIA[A-Z0-9]+ with matches under 16 characters dropped
    Rule("hex", r"[0-9a-f]{32,}"),
)
_SEGMENT = "[A-Za-z0-9_-]{10,}+"
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    # Reads past what has one or two segments and drops it: no token begins inside, and a long run is read once.
    Rule("jwt", rf"eyJ{_SEGMENT}(?:\.eyJ{_SEGMENT}(?:\.{_SEGMENT})?+)?+", lambda v: F.size(F.split(v, r"\.")) == 3, rf"eyJ{_SEGMENT}\.eyJ{_SEGMENT}\.{_SEGMENT}"),
)
RULES = BASE + MORE


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which every match contains whole; None if there is no such set.

    Literal runs give trigrams; alternatives, options and classes of listed characters branch; anything else ends
    a run, and so does a class that would make more than ``most`` branches. More than ``most`` of them in all give
    up on the query, never on a match.
    """

    def flush(state):
        had, run = state
        return had | {run[i : i + 3] for i in range(len(run) - 2)}, ""

    def walk(items, states):
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                states = {(had, run + chr(arg).lower()) for had, run in states}
            elif name == "SUBPATTERN":
                states = walk(arg[-1], states)
            elif name == "BRANCH":
                states = set().union(*(walk(option, states) for option in arg[1]))
            elif name == "IN" and len(arg) * len(states) <= most and all(str(o) == "LITERAL" for o, _ in arg):
                states = {(had, run + chr(c).lower()) for had, run in states for _, c in arg}
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                if (low, high) == (0, 1):
                    states = states | walk(inner, states)
                else:
                    states = {flush(s) for s in (walk(inner, states) if low else states)}
            elif name != "AT":
                states = {flush(s) for s in states}
            if len(states) > most:
                raise OverflowError
        return states

    try:
        done = {flush(s)[0] for s in walk(re._parser.parse(pattern), {(frozenset(), "")})}
    except OverflowError:
        return None
    clauses = [frozenset(c) for c in done if not any(other < c for other in done)]
    return None if not all(clauses) else sorted(clauses, key=sorted)


def _spans(text: Column, rule: Rule, place: int) -> Column:
    kept = F.filter(matches(text, rule.pattern), lambda m: rule.fits(m["value"]))
    return F.transform(kept, lambda m: F.struct(
        m["place"].alias("start"), F.lit(place).alias("place"), (m["place"] + F.char_length(m["value"])).alias("end"), F.lit(rule.kind).alias("kind")))


def candidates(docs: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): documents that satisfy each kind's trigram query, by intersecting postings."""
    spark = docs.sparkSession
    vocabulary = sorted({t for clauses in queries.values() for c in clauses for t in c})
    lower = F.lower("text")
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("lower"), F.lit(t)), F.lit(t)) for t in vocabulary]))
    postings = docs.select("key", lower.alias("lower")).select("key", F.explode(present).alias("trigram"))
    rows = [(kind, i, t, len(c)) for kind, clauses in queries.items() for i, c in enumerate(clauses) for t in c]
    clauses = spark.createDataFrame(rows, "kind string, clause int, trigram string, need long")  # bounded by the rules
    return (
        postings.distinct().join(F.broadcast(clauses), "trigram").groupBy("key", "kind", "clause", "need").agg(F.count("*").alias("n"))
        .where("n = need").groupBy("key").agg(F.collect_set("kind").alias("kinds"))
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, key, spans): all spans by start, then kind as listed."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("key"))
    queries = {r.kind: trigram_query(r.index or r.pattern) for r in rules}
    indexed = [(i, r) for i, r in enumerate(rules) if queries[r.kind]]
    scanned = [(i, r) for i, r in enumerate(rules) if not queries[r.kind]]
    found = stage(candidates(docs, {r.kind: queries[r.kind] for _, r in indexed}), "candidates")
    empty = F.array().cast(SPANS)
    verified = (
        maybe_in(docs, "key", found).join(found, "key")
        .select("key", F.concat(empty, *[F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r, i)).otherwise(empty) for i, r in indexed]).alias("more"))
        .where("size(more) > 0").dropDuplicates(["key"])
    )
    everywhere = docs.select("doc_id", "key", F.concat(empty, *[_spans(F.col("text"), r, i) for i, r in scanned]).alias("spans"))
    return everywhere.join(verified, "key", "left").select("doc_id", "key", F.sort_array(F.concat("spans", F.coalesce("more", empty))).alias("spans"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def secrets_digest(docs: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("spans", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    return find_secrets(docs).select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
