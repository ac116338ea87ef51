"""The url model counts all words of pages and names, of any length, and all tokens."""

import math
from collections import Counter

from glossmill.llm import urls

RULES = [urls.Rule("block", "net/")]


def name(i):
    out = ""
    for _ in range(5):
        i, k = divmod(i, 19)
        out += "bcdfghjklmnpqrstvwx"[k]
    return out


def test_words_beyond_the_first_twenty_thousand_split_a_url(spark):
    frequent = " ".join(name(i) for i in range(25_000))
    pages = [(i, "http://other.org/", f"<title>{frequent}</title>") for i in (1, 2)]
    pages += [(3, "http://zeaou.net/zeaouyiaoe", "<title>zeaou yiaoe</title>"), (4, "http://yiaoezeaou.com/", None), (5, "http://zeaouyiaoe.net/", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    matched = urls.match_rules(df, RULES).selectExpr("*", "page_id div 3 AS chunk")
    got = {r["page_id"]: r["tokens"] for r in urls.tokenized(matched, urls.dictionary(df, matched)).collect()}
    assert got[3] == ["h:zeaou", "h:net", "p:zeaou", "p:yiaoe"]
    assert got[4][:2] == ["h:yiaoe", "h:zeaou"] and got[5][:2] == ["h:zeaou", "h:yiaoe"]


def test_tokens_beyond_the_first_fifty_thousand_have_a_weight(spark):
    words = [name(i) for i in range(60_000)]
    pages = [(-1, "http://x.org/", "<title>" + " ".join([*words, "zeaou"]) + "</title>")]
    pages += [(i, f"http://a.net/{a}/{b}", None) for i, (a, b) in enumerate(zip(words, reversed(words), strict=True))]
    pages += [(100_000 + i, f"http://free.com/{'y' * (i + 2)}", None) for i in range(3)] + [(200_000, "http://q.net/zeaou", None), (200_001, "http://q.org/zeaou", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    matched = urls.match_rules(df, RULES).selectExpr("*", "page_id div 2048 AS chunk")
    found = urls.tokenized(matched, urls.dictionary(df, matched)).cache()
    counts = {r["token"]: (r["block"], r["allow"]) for r in urls.token_counts(found).collect()}
    assert len(counts) > 60_000 and counts["p:zeaou"] == (1, 0)
    assert sum(b for b, _ in counts.values()) == found.where("rule IS NOT NULL").selectExpr("sum(size(tokens)) AS n").collect()[0]["n"]


def test_words_of_any_length_and_names_that_are_no_compounds(spark):
    long = "q" * 30 + "z"
    pages = [(1, "http://spam.net/", f"<p>{long} tion</p><script>no words</script>"), (2, f"http://m.spamfarm.net/{long}tion", None), (3, "http://farm.org/", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    matched = urls.match_rules(df, RULES).selectExpr("*", "0L AS chunk")
    words = urls.dictionary(df, matched)
    assert {r["w"] for r in words.collect()} == {long, "tion", "spam", "farm", "net", "org", "m"}
    got = {r["page_id"]: r["tokens"] for r in urls.tokenized(matched, words).collect()}
    assert got[2] == ["h:m", "h:spam", "h:farm", "h:net", f"p:{long}", "p:tion"]


def test_verdicts_equal_brute_force(spark):
    """Viterbi over all words at once, and naive Bayes with the prior of the decided urls."""
    pages = [(i, f"http://{h}.{t}/{p}", "<b>good news cheap pills blog</b>") for i, (h, t, p) in enumerate([("cheappills", "net", "buy"), ("goodnews", "com", "read"), ("pillsblog", "net", "buypills"), ("newsblog", "org", "fr/x"), ("cheapnews", "org", "buy"), ("x", "org", ""), ("goodblog", "org", "fr/"), ("buypills", "com", "cheap")])]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rules = [urls.Rule("block", "net/"), urls.Rule("allow", "org/fr/")]
    got = {r["page_id"]: r for r in urls.filter_urls(df, rules).collect()}
    matched = urls.match_rules(df, rules).selectExpr("*", "0L AS chunk")
    s = urls.Segmenter({r["w"]: r["n"] for r in urls.dictionary(df, matched).collect()})
    rows = matched.collect()
    tokens = {r["page_id"]: s.tokens(r["host"], r["path"]) for r in rows}
    count = {v: Counter(t for r in rows if r["rule_verdict"] == v for t in tokens[r["page_id"]]) for v in ("block", "allow")}
    known = set(count["block"]) | set(count["allow"])
    n = {v: sum(c.values()) + len(known) for v, c in count.items()}
    urls_of = Counter(r["rule_verdict"] for r in rows)
    for r in rows:
        odds = math.log((urls_of["block"] + 1) / (urls_of["allow"] + 1)) + sum(math.log((count["block"][t] + 1) / n["block"]) - math.log((count["allow"][t] + 1) / n["allow"]) for t in tokens[r["page_id"]] if t in known)
        assert got[r["page_id"]]["verdict"] == (r["rule_verdict"] or ("block" if odds > 1e-9 else "allow"))
    assert {got[k]["verdict"] for k in (1, 4, 5, 7)} == {"allow", "block"}
