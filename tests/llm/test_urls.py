"""URL filters: rules by hand, edge cases, and what the models learn; op12's SQL is run with the other queries' SQL."""

import pytest
from pyspark.sql import functions as F

from folio.llm import urls


def judged(spark, rows, rules=urls.RULES):
    df = spark.createDataFrame(rows, "page_id long, url string")
    return {r["page_id"]: r for r in urls.judge(df, rules).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.ORG/en/1x?q#f", "a.example.org", "/en/1x", "example.org/en/1", "block"),
        ("https://example.org/es/", "example.org", "/es/", "example.org/es/", "block"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://y.org", "y.org", "", None, None),
        ("x://y.org?/z", "y.org", "", None, None),
        ("x://org/a://b/c", "org", "/a://b/c", "org/", "allow"),
        ("https://www.a.com/fr/9", "www.a.com", "/fr/9", "com/fr/", "allow"),
        ("https://com/de/9", "com", "/de/9", "com/de/", "block"),
        ("https://com.net/de/9", "com.net", "/de/9", None, None),
        ("no scheme.org/es/", "", "", None, None),
        ("a\nb://É.ORG/x", "É.org", "/x", "org/", "allow"),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ]
    got = judged(spark, [(k, c[0]) for k, c in enumerate(cases)])
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == (verdict or got[k]["verdict"])


def test_ties_of_rules(spark):
    rules = [urls.Rule("allow", "b.org", "/x"), urls.Rule("block", "org", "/x/2"), urls.Rule("allow", "org", "/x/2")]
    got = judged(spark, [(1, "s://b.org/x/2"), (2, "s://b.org/x"), (3, "s://c.org/x")], rules)
    assert [(got[k]["rule"], got[k]["verdict"]) for k in (1, 2)] == [("org/x/2", "block"), ("b.org/x", "allow")]
    assert got[3]["rule"] is None


def test_no_rows_no_rules_and_one_label(spark):
    assert judged(spark, []) == {}
    rows = [(1, "s://a.net/x"), (1, "s://a.net/x"), (2, None), (3, "q" * 50_000)]
    assert {(r["score"], r["verdict"]) for r in judged(spark, rows).values()} == {(0, "allow")}
    assert judged(spark, [(k, f"s://a.org/{k}") for k in range(40)] + [(99, "s://b.net/")])[99]["verdict"] in ("allow", "block")


@pytest.fixture(scope="module")
def made(spark):
    good = [f"https://w{k % 7}.lib.org/papers/{k}/reader" for k in range(400)]
    bad = [f"https://x{k % 5}.shop.com/de/casino-{k}-bonus" for k in range(300)]
    rest = [f"https://q{k}.lib.net/papers/{k}/reader" for k in range(50)] + [f"https://z{k}.shop.net/en/casino-{k}-bonus" for k in range(50)]
    return [*enumerate(good + bad + rest)]


def test_models_generalise_from_rules(spark, made):
    got = judged(spark, made)
    assert [got[k]["verdict"] for k in range(700, 800)] == ["allow"] * 50 + ["block"] * 50
    assert all(got[k]["rule"] is None for k in range(700, 800))


def test_scores_against_a_plain_fold(spark, made):
    """The same model in plain Python: counts, smoothing by shorter contexts, the longest kept context of each symbol."""
    import math
    from collections import Counter

    labelled = spark.createDataFrame(made, "page_id long, url string").withColumn("_rule", urls.rule_of(urls.host_of(F.col("url")), urls.path_of(F.col("url")), urls.RULES))
    taught = labelled.where(F.col("_rule").isNotNull() & ~urls.for_threshold(F.col("url"))).select("url", F.col("_rule.verdict").alias("v")).collect()
    seen = {"allow": Counter(), "block": Counter()}
    plain = lambda url: "".join(c if c in urls.LETTERS else urls.OTHER for c in url.lower()) + urls.END
    for r in taught:
        text = urls.START * urls.ORDER + plain(r["url"])
        for i in range(urls.ORDER, len(text)):
            for k in range(urls.ORDER + 1):
                seen[r["v"]][text[i - k : i], text[i]] += 1
    total = {v: Counter() for v in seen}
    for v, counts in seen.items():
        for (context, _), n in counts.items():
            total[v][context] += n
    everything = total["allow"][""] + total["block"][""]

    def chance(v, context, symbol):
        if not context:
            return (seen[v]["", symbol] + 1) / (total[v][""] + len(urls.SYMBOLS))
        return (seen[v][context, symbol] + urls.PRIOR * chance(v, context[1:], symbol)) / (total[v][context] + urls.PRIOR)

    def score(url):
        text, out = urls.START * urls.ORDER + plain(url), 0
        for i in range(urls.ORDER, len(text)):
            k = max(k for k in range(urls.ORDER + 1) if not k or (total["allow"][text[i - k : i]] + total["block"][text[i - k : i]]) * urls.CONTEXTS >= everything)
            out += round((math.log(chance("allow", text[i - k : i], text[i])) - math.log(chance("block", text[i - k : i], text[i]))) * urls.UNIT)
        return out // (len(text) - urls.ORDER)

    got = judged(spark, made)
    for k in range(0, 800, 23):
        assert abs(got[k]["score"] - score(made[k][1])) <= 1


def test_clashing_columns_are_replaced_and_others_kept(spark):
    df = spark.createDataFrame([(1, "s://a.org/x", "h", "v", 5)], "page_id long, url string, host string, verdict string, more long")
    row = urls.judge(df, urls.RULES).first()
    assert (row["host"], row["verdict"], row["more"], row["url"]) == ("a.org", "allow", 5, "s://a.org/x")
