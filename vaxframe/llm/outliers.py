"""Quality rules: counts per document, fixed limits, and robust multivariate outliers per language and source.

The vector of a document is its transformed statistics (the logarithm of the mean word length, and the square roots
of the shares of symbols, repeated lines and repeated words, the last two shrunk: one repeat among three lines says
little). Per (lang, source), the minimum covariance determinant is
sought from two starts by concentration steps: the documents nearest to the current centre give the next
centre and covariance, and the start with the smaller determinant wins. A document far from the final centre
in Mahalanobis distance is rejected: beyond a chi-squared quantile, the covariance of the nearest share being
scaled to that of the whole.

All of it is DataFrame expressions and grouped sums, so a source with a third of all rows is only partial sums;
the nearest ``SUBSET`` share comes from a histogram of distances with fixed bins, not from sorting a group.

Defined results: a null or empty text has no words and fails the base; null languages and sources are groups
of their own; a group with fewer than ``LEAST_ROWS`` documents uses the estimate over all documents; equal
rows get equal verdicts; constant statistics get the variance floor; an empty table has no verdicts. Other columns are
unused, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaxframe.llm.keys import row_key
from vaxframe.llm.spans import let
from vaxframe.sources.scratch import stage

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
SUBSET = 0.75
STEPS = 3
LEAST_ROWS = 40
#: Chi-squared with four degrees: its 0.999 quantile, and what makes the covariance of the nearest SUBSET consistent,
#: SUBSET / P(chi-squared with six degrees <= 5.385, the SUBSET quantile for four).
CUTOFF = 18.467
CONSISTENCY = 1.486
#: Lines and words without a repeat that are added to a document before its shares of repeats are taken.
PRIOR_LINES, PRIOR_WORDS = 20, 100
#: Variance added to each statistic, so that constant ones do not make any change an outlier.
FLOOR = (0.0016, 0.0025, 0.01, 0.01)
DIMS = range(4)


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""

    def inner(prints: Column) -> Column:
        def twins(rows: Column) -> Column:
            same = F.filter(rows, lambda x, i: F.coalesce(F.get(rows, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(rows, i + 1)["h"] == x["h"], F.lit(False)))
            return let(F.sort_array(F.transform(same, lambda x: x["p"])), lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda total, x: total + x))

        rows = F.sort_array(F.transform(prints, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(prints)) < F.size(prints), let(rows, twins)).otherwise(F.lit(0))

    def outer(w: Column) -> Column:
        prints = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) > 3, let(prints, inner)).otherwise(F.lit(0))

    return let(words, outer)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, key, lang, source and the counts of each document's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.split(trimmed, r"[ \t\n\x0B\f\r]+")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
    measured = docs.select(
        "doc_id", row_key().alias("key"), "lang", "source",
        F.char_length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("line"),
        F.when(trimmed == "", F.struct(F.lit(0).alias("n"), F.lit(0).alias("rep")))
        .otherwise(let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("rep")))).alias("word"),
    )
    return measured.select(
        "doc_id", "key", "lang", "source", F.col("word.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("line.dup").cast("long").alias("n_dup_lines"), F.col("word.rep").cast("long").alias("n_repeat_words"),
        F.col("line.lines").cast("long").alias("n_lines"),
    ).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED} * n_words"))


def _vectors(stats: DataFrame) -> DataFrame:
    return stats.select(
        "*", F.expr("ln(greatest(word_chars, 1) / greatest(n_words, 1))").alias("x0"), F.expr("sqrt(n_symbols / greatest(word_chars, 1))").alias("x1"),
        F.expr(f"sqrt(n_dup_lines / (n_lines + {PRIOR_LINES}))").alias("x2"), F.expr(f"sqrt(n_repeat_words / (n_words + {PRIOR_WORDS}))").alias("x3"))


def _fit(rows: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Centre m*, Cholesky factor l* of the covariance, and log-determinant, per key."""
    sums = [F.avg(f"x{i}").alias(f"m{i}") for i in DIMS]
    sums += [F.avg(F.expr(f"x{i} * x{j}")).alias(f"s{i}{j}") for i in DIMS for j in DIMS if j <= i]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    for i in DIMS:
        for j in range(i + 1):
            cov = f"{scale}D * (s{i}{j} - m{i} * m{j})" + (f" + {FLOOR[i]}D" if i == j else "")
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out = out.withColumn(f"l{i}{j}", F.expr(f"sqrt(greatest({cov}{rest}, {FLOOR[i]}D))" if i == j else f"({cov}{rest}) / l{j}{j}"))
    det = " + ".join(f"2 * ln(l{i}{i})" for i in DIMS)
    return out.withColumn("logdet", F.expr(det)).drop(*[f"s{i}{j}" for i in DIMS for j in DIMS if j <= i])


PARAMETERS = [f"m{i}" for i in DIMS] + [f"l{i}{j}" for i in DIMS for j in DIMS if j <= i]


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in DIMS:
        rest = "".join(f" - l{i}{k} * y{k}" for k in range(i))
        df = df.withColumn(f"y{i}", F.expr(f"(x{i} - m{i}{rest}) / l{i}{i}"))
    return df.withColumn("d2", F.expr(" + ".join(f"y{i} * y{i}" for i in DIMS))).drop(*[f"y{i}" for i in DIMS])


def estimates(vectors: DataFrame) -> DataFrame:
    """(grp, parameters): the concentrated estimate of each group, and of all rows under grp = '*'."""
    members = vectors.select(F.explode(F.array(F.col("grp"), F.lit("*"))).alias("grp"), *[f"x{i}" for i in DIMS]).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    # Start 0: all rows. Start 1: rows whose share statistics are all small, the plain majority of most sources.
    from pyspark.sql import Window

    fitted = stage(_fit(members.where("start = 0 or (x1 < 0.2 and x2 < 0.3 and x3 < 0.6)"), ["grp", "start"]), "estimate")
    for _ in range(STEPS):
        near = _distance(members.join(fitted.select("grp", "start", *PARAMETERS), ["grp", "start"])).withColumn("bin", F.expr("cast(floor(ln(d2 + 1e-6) * 16) as int)"))
        bins = near.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"))
        w = Window.partitionBy("grp", "start")
        reach = (
            bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
            .where(F.expr(f"upto >= {SUBSET}D * all")).groupBy("grp", "start").agg(F.min("bin").alias("last"))
        )
        reach = stage(reach, "reach")  # a row per group, of measured size: the join moves no documents to their group
        fitted = stage(_fit(near.join(reach, ["grp", "start"]).where("bin <= last").drop(*PARAMETERS), ["grp", "start"], CONSISTENCY), "estimate")
    return fitted.groupBy("grp").agg(F.min_by(F.struct("n", *PARAMETERS), "logdet").alias("e")).select("grp", "e.*")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Statistics of every document with base_failed, distance and kept."""
    vectors = stage(_vectors(statistics(docs)).withColumn("grp", F.to_json(F.struct("lang", "source"))), "statistics")
    fitted = stage(estimates(vectors.where("not base_failed")), "estimates")
    all_rows = fitted.where("grp = '*'").select(*[F.col(c).alias(f"all_{c}") for c in PARAMETERS]).first()
    own = fitted.where(f"n >= {SUBSET * LEAST_ROWS}").select("grp", *PARAMETERS)
    joined = vectors.join(own, "grp", "left")
    if all_rows is not None:
        joined = joined.withColumns({c: F.coalesce(c, F.lit(all_rows[f"all_{c}"])) for c in PARAMETERS})
    return _distance(joined).withColumn("kept", F.expr(f"not base_failed and coalesce(d2 <= {cutoff}D, true)")).drop(*PARAMETERS)


def rules_digest(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 4).alias("distance"))
