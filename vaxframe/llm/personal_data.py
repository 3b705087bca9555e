"""Personal data: fixed patterns, and identifiers that bootstrapped contexts reveal.

The fixed patterns give the base spans and the seeds. A seed is a whole base span with the words that it touches,
however many; its context is the word before the first and the word after the last of them. Every other sequence of
adjacent identifier-like words (with a digit or an @; brackets, dots and dashes may stand between) is a candidate with
its own context. Contexts and values form a graph: a context is as confident for a kind as the share of its distinct
values that are known to be of that kind, a value as the chance that any of its contexts is right. A few rounds of
the two scores let confident contexts make values known and these support further contexts. Occurrences in
contexts that end up confident, outside all base spans, are added; of nested ones the longest.

Everything is DataFrame functions and grouped sums. Contexts with fewer than MIN_SUPPORT distinct values can
never be confident and leave the graph first. Defined results: a null text is empty and has no spans; rows
alike in id and text have equal spans; the begin and the end of a text are sides of contexts like words; a
neighbour of marks alone is the side as it stands; a value of marks alone is no identifier; an empty table has
no spans. A very long text is read whole; places are found by halving
and by folds in blocks, so that many identifiers in one text take time in proportion. Columns other than doc_id and text are unused, whatever their names, and kept by ``mask``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaxframe.llm.keys import keyed_rows, row_key
from vaxframe.llm.spans import below, larger, let, matches, replaced, running, spelled
from vaxframe.sources.scratch import stage

KINDS = ("email", "ip", "card", "phone")
#: Distinct known tokens that a context needs, the confidence it needs, and the weight of the doubt against it.
MIN_SUPPORT, CONFIDENT, DOUBT = 5, 0.9, 0.25
ROUNDS = 3
#: Identifier-like words of a candidate: no kind has more than 19 digits, so none has more words with a digit.
MOST_WORDS = 19
#: Sides of a context at the ends of a text; no word has a space.
BEGIN, END = " begin", " end"

# The base patterns, with starts inside a failed run ruled out and possessive repeats: the same matches, in linear time.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD, _SPACE = r"[^ \t\n\x0B\f\r]", r"[ \t\n\x0B\f\r]"
_TOKEN = rf"[^ \t\n\x0B\f\r0-9@]*+[0-9@]{_WORD}*+"
#: Adjacent identifier-like words, as many as there are. Every base span lies in one run.
RUN = rf"(?<!{_WORD}){_TOKEN}(?:{_SPACE}++(?:[().-]++{_SPACE}++)*+{_TOKEN})*+"

SPANS = "array<struct<place:int,start:int,end:int,kind:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits (at most a few dozen) pass the Luhn check."""

    def doubled(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    parts = F.transform(F.split(F.reverse(digits), ""), doubled)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.when(F.char_length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


FITS = {
    "email": (EMAIL, lambda v: F.lit(True)),
    "ip": (IP, lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    "card": (CARD, _card),
    "phone": (PHONE, lambda v: F.char_length(_digits(v)).between(8, 15)),
}


def _base(text: Column) -> Column:
    def of(place: int, kind: str) -> Column:
        pattern, fits = FITS[kind]
        kept = F.filter(matches(text, pattern), lambda m: fits(m["value"]))
        return F.transform(kept, lambda m: F.struct(
            F.lit(place).alias("place"), m["place"].alias("start"), (m["place"] + F.char_length(m["value"])).alias("end"), F.lit(kind).alias("kind")))

    return F.concat(F.array().cast(SPANS), *[of(i, k) for i, k in enumerate(KINDS)])


def _bare(word: Column) -> Column:
    """Lower case, without marks at the ends."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _side(word: Column) -> Column:
    return let(_bare(word), lambda bare: F.when(bare == "", F.lower(word)).otherwise(bare))


def _runs(text: Column, base: Column) -> Column:
    """The runs with the words before and after them, their own words, and the base spans in them by start."""

    def described(run: Column, i: Column, gaps: Column, spans: Column) -> Column:
        before = F.regexp_extract(F.get(gaps, i), rf"(?<!{_WORD})({_WORD}++){_SPACE}*+$", 1)
        after = F.regexp_extract(F.get(gaps, i + 1), rf"^{_SPACE}*+({_WORD}++)", 1)
        end = run["place"] + F.char_length(run["value"])
        words = F.transform(matches(run["value"], rf"{_WORD}++"), lambda w: F.struct(
            (run["place"] + w["place"]).alias("start"), (run["place"] + w["place"] + F.char_length(w["value"])).alias("end"), w["value"].alias("value")))
        first = below(spans, lambda s: s["start"] < run["place"])
        return F.struct(
            F.when(before == "", F.lit(BEGIN)).otherwise(_side(before)).alias("left"), F.when(after == "", F.lit(END)).otherwise(_side(after)).alias("right"),
            words.alias("words"), let(first, lambda k: F.slice(spans, k + 1, below(spans, lambda s: s["start"] < end) - k)).alias("base"))

    def placed(runs: Column) -> Column:
        by_start = F.sort_array(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["place"].alias("place"))))
        return F.when(F.size(runs) > 0, let(F.split(text, RUN, -1), lambda gaps: let(by_start, lambda spans: F.transform(
            runs, lambda run, i: described(run, i, gaps, spans)))))

    return let(matches(text, RUN), placed)


def _items() -> Column:
    """The seeds and candidates of a run (left, right, words, base): contexts, value, place, and the seed's kind."""
    words, base = F.col("words"), F.col("base")

    def item(i: Column, j: Column, known: Column) -> Column:
        return F.struct(
            F.when(i == 0, F.col("left")).otherwise(_side(F.get(words, i - 1)["value"])).alias("left"),
            F.when(j == F.size(words) - 1, F.col("right")).otherwise(_side(F.get(words, j + 1)["value"])).alias("right"),
            _bare(F.array_join(F.transform(F.slice(words, i + 1, j - i + 1), lambda w: w["value"]), " ")).alias("value"),
            F.get(words, i)["start"].alias("start"), F.get(words, j)["end"].alias("end"), known.alias("known"))

    seeds = F.transform(base, lambda s: item(
        below(words, lambda w: w["end"] <= s["start"]), below(words, lambda w: w["start"] < s["end"]) - 1, s["place"]))

    def touched(word: Column, reach: Column) -> Column:
        """Whether a base span starts before the word's end and reaches beyond its start."""
        return F.coalesce(F.get(reach, below(base, lambda s: s["start"] < word["end"]) - 1) > word["start"], F.lit(False))

    likely = let(running(F.transform(base, lambda s: s["end"]), larger), lambda reach: F.transform(
        F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda w: w["word"]["value"].rlike("[0-9@]")),
        lambda w: F.struct(w["at"].alias("at"), touched(w["word"], reach).alias("taken"))))

    def from_here(at: Column, ahead: Column) -> Column:
        def free(taken: Column) -> Column:
            upto = F.when(taken == 0, F.size(ahead)).otherwise(taken - 1).cast("int")
            return F.transform(F.slice(ahead, F.lit(1), upto), lambda w: item(at, w["at"], F.lit(None).cast("int")))

        return let(F.array_position(F.transform(ahead, lambda w: w["taken"]), True), free)

    candidates = let(likely, lambda ws: F.flatten(F.transform(ws, lambda w, n: let(F.slice(ws, n + 1, F.lit(MOST_WORDS)), lambda ahead: from_here(w["at"], ahead)))))
    return F.concat(seeds, candidates)


def _scores(edges: DataFrame) -> DataFrame:
    """(left, right, kind place, confidence) of the contexts that are confident after the rounds."""
    k = range(len(KINDS))
    known = edges.groupBy("value").agg(*[F.max(f"s{i}").alias(f"s{i}") for i in k])
    scored = known
    for turn in range(ROUNDS):
        weighed = edges.select("left", "right", "value").join(scored, "value")
        contexts = weighed.groupBy("left", "right").agg(*[F.sum(f"s{i}").alias(f"t{i}") for i in k], F.count("*").alias("n"))
        contexts = stage(contexts.select(
            "left", "right", *[F.expr(f"case when t{i} >= {MIN_SUPPORT} then least(t{i} / (n + {DOUBT}D), 0.999) else 0D end").alias(f"p{i}") for i in k]
        ).where(" or ".join(f"p{i} > 0" for i in k)), "contexts")
        if turn < ROUNDS - 1:
            lent = edges.select("left", "right", "value").join(contexts, ["left", "right"]).groupBy("value").agg(
                *[F.expr(f"1 - exp(sum(ln(1 - p{i})))").alias(f"q{i}") for i in k])
            scored = known.join(lent, "value", "left").select(
                "value", *[F.expr(f"case when s{i} > 0 then 1D when q{i} >= {CONFIDENT} then q{i} else 0D end").alias(f"s{i}") for i in k])
    best = F.greatest(*[F.col(f"p{i}") for i in k])
    place = F.coalesce(*[F.when(F.col(f"p{i}") == best, F.lit(i)) for i in k])
    return contexts.where(best >= CONFIDENT).select("left", "right", place.alias("place"))


def find_personal(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, spans): base spans and all spans, by kind as listed, then start."""
    read = docs.select("doc_id", row_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = read.select("doc_id", "key", let(_base(F.col("text")), lambda b: F.struct(b.alias("base"), _runs(F.col("text"), b).alias("runs"))).alias("f"))
    rows = stage(found.select("doc_id", "key", "f.*"), "spans")
    runs = rows.select("key", F.explode("runs").alias("r")).select("key", "r.*")
    items = runs.select("key", F.explode(_items()).alias("t")).select("key", "t.*")
    flags = [F.max((F.coalesce("known", F.lit(-1)) == i).cast("double")).alias(f"s{i}") for i in range(len(KINDS))]
    edges = items.where("value <> ''").groupBy("left", "right", "value").agg(*flags)
    often = edges.groupBy("left", "right").agg(F.count("*").alias("n")).where(f"n >= {MIN_SUPPORT}").drop("n")
    contexts = _scores(stage(edges.join(often, ["left", "right"]), "edges"))
    kinds = F.array(*[F.lit(x) for x in KINDS])
    longest_first = F.sort_array(F.transform("all", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("least"), x.alias("span"))))
    outer = let(longest_first, lambda xs: let(running(F.transform(xs, lambda x: -x["least"]), larger), lambda reach: F.transform(
        F.filter(F.transform(xs, lambda x, i: F.struct(x["span"].alias("span"), F.get(reach, i - 1).alias("before"))), lambda x: F.coalesce(x["before"] < x["span"]["end"], F.lit(True))),
        lambda x: x["span"])))
    more = (
        items.where("known is null and value <> ''").join(contexts, ["left", "right"])
        .select("key", F.struct("place", "start", "end", F.get(kinds, F.col("place")).alias("kind")).alias("span"))
        .groupBy("key").agg(F.collect_set("span").cast(SPANS).alias("all"))
        .select("key", outer.alias("more"))
    )
    return rows.join(more, "key", "left").select(
        "doc_id", "key", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("spans"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def personal_digest(docs: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return find_personal(docs).select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by [KIND]; overlapping spans are one, named by the first. Null texts stay null."""
    hits = find_personal(docs).where("size(spans) > 0").groupBy("key").agg(F.first("spans").alias("spans"))
    joined = keyed_rows(docs).join(hits, "key", "left").select("row", "spans", F.col("row")["text"].alias("text"))
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    masked = replaced(F.col("text"), ordered, lambda span: F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))
    done = joined.select("row", F.when(F.col("spans").isNull(), F.col("text")).otherwise(masked).alias("text"))
    return done.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
