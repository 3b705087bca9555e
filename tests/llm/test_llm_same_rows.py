"""op4, op6, op7 and op8: repeated rows, input columns named like inner ones, empty tables, one text of very many matches."""

import pytest

from vaxframe.llm import host_reputation, outliers, personal_data, secret_index

CLASH = ["key", "row", "base", "spans", "runs", "f", "place", "value", "left", "right", "known", "grp", "d2", "kept", "n", "rate", "low", "a.b", "_w"]
TEXTS = [None, "", "mail x@y.org now, mail x@y.org now", "token = abcdefgh12 and " + "0f" * 20, "one two three four " * 30 + "# | $", "1.2.3.4\n5.6.7.8"]


def rows_of(df):
    return sorted(df.collect(), key=str)


def with_more(df):
    return df.selectExpr("*", *[f"'{c}' as `{c}`" for c in CLASH])


@pytest.mark.parametrize("digest", [personal_data.personal_digest, secret_index.secrets_digest, outliers.rules_digest])
def test_documents(spark, digest):
    schema = "doc_id long, text string, lang string, source string"
    plain = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(TEXTS)], schema)
    twice = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(TEXTS)] * 2 + [(None, TEXTS[2], "en", None)] * 2, schema)
    once = rows_of(digest(plain))
    assert rows_of(digest(with_more(plain))) == once and len(once) == len(TEXTS)
    got = rows_of(digest(twice))
    assert len(got) == 2 * len(TEXTS) + 2
    for row in once if digest is not outliers.rules_digest else []:  # the estimate counts every row
        assert sum(r == row for r in got) == 2
    unnamed = [r for r in got if r.doc_id is None]
    assert len(unnamed) == 2 and unnamed[0] == unnamed[1]
    assert digest(plain.limit(0)).collect() == []


def test_pages(spark):
    urls = [None, "", "http://a.net/es/x", "http://a.net/es/x", "http://a.net/other", "https://b.com/", "nothing"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    once = rows_of(host_reputation.judge(pages))
    assert rows_of(host_reputation.judge(with_more(pages).selectExpr("*", "'h' as host", "'p' as path", "'r' as rule"))) == once
    got = rows_of(host_reputation.judge(pages.unionByName(pages)))
    assert len(got) == 2 * len(urls) and got[::2] == got[1::2]
    assert host_reputation.judge(pages.limit(0)).collect() == []


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@mail.org , {i:040x}" for i in range(1500))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert personal_data.personal_digest(docs).first().n_email == 1500
    assert secret_index.secrets_digest(docs).first().n_hex == 1500
