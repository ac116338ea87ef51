import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm import langid, quality, rules, urls
from glossmill.llm.queries import URL_RULES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls in any column, empty and letterless texts, repeated rows, a text of one long word.
ODD = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, " \n\t ", "de", "s", 4), (4, "12345 -- !!", None, None, 11), (None, "a null id has a text", "en", "s", 20), (5, "x" * 200_000, None, "s", 200_000), (6, "twice", "en", "s", 5), (6, "twice", "en", "s", 5)]
CLASHES = ["score", "held_out", "lang_pred", "predicted", "kept", "n_words", "t", "words", "h", "quality", "bad", "grow", "host", "path", "rule", "verdict", "block"]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(ODD, DOCS))


def test_languages_of_the_held_out(docs):
    got = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count() and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["held_out"] and r["lang"] is not None and re.search(r"[^\W\d_]", r["text"] or "")]
    assert sum(r["lang"] == r["lang_pred"] for r in known) >= 0.95 * len(known) > 0


def test_language_uses_the_text_alone(spark, docs):
    profiles = langid.fit(docs)
    some = docs.where("doc_id % 10 = 0")
    moved = some.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"), "n_chars")
    own = lambda d: sorted((r["doc_id"] % 1_000_000, r["lang_pred"], r["score"]) for r in langid.identify(d, profiles).collect())
    assert own(some) == own(moved)


def test_language_of_odd_rows(spark, docs, odd):
    profiles = langid.fit(docs)
    got = langid.identify(odd, profiles).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert all((by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0) for k in (1, 2, 3, 4)) and by[None]["lang_pred"] != "und"
    kept = langid.keep_identified(odd, profiles)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 5, 6} and kept.count() == 4
    none = spark.createDataFrame([], DOCS)
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}


def base(text):
    """The contract's counts, one by one."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_rule_statistics_equal_brute_force(spark, docs, odd):
    more = spark.createDataFrame([(10, "a b c d e a b c d e f", None, None, 1), (11, "a a a a a a a", None, None, 1), (12, "x\x85y \u00a0 z\x0bq\n\nl\nl\n l\nl", None, None, 1), (13, "#*$%&|<> 日本 𝒳", None, None, 1)], DOCS)
    every = docs.union(more).union(odd.select(*docs.columns))
    texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, *base(r["text"])) for r in every.collect()))
    got = rules.judge(clashing(every), rules.DecisionList())
    rows = got.collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[k] for k in names)) for r in rows) == texts
    for r in rows:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_rules_are_native_and_precise(spark, docs, labels, odd):
    learned = rules.learn(docs, labels)
    got = rules.judge(docs, learned)
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)
    judged = [(r["quality"], r["kept"]) for r in got.where(rules.held_out(F.col("doc_id"))).join(labels, "doc_id").where("quality IS NOT NULL AND NOT base_failed").collect()]
    good, bad = ([k for q, k in judged if q == x] for x in (1, 0))
    assert good and sum(good) >= 0.98 * len(good) and bad and sum(not k for k in bad) >= 0.8 * len(bad)
    assert len(learned.rules) >= 2
    assert rules.judge(odd, learned).count() == len(ODD)
    none = spark.createDataFrame([], DOCS)
    assert rules.learn(none, labels).rules == [] and rules.judge(none, learned).count() == 0
    assert rules.learn(docs, labels.limit(0)).rules == []


def words(r, n, upper=False, marks=""):
    own = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) + (r.choice(marks) if marks else "") for _ in range(n)]
    return " ".join(x.upper() if upper else x for x in own)


def test_a_list_of_several_rules_is_learned_and_applied(spark):
    """Three kinds of bad text, one of which only a conjunction tells from good ones."""
    r = random.Random(3)
    rows = []
    for i in range(1200):
        kind, n = i % 8, r.randrange(20, 60)
        text = {0: lambda: words(r, n, marks="#%"), 1: lambda: words(r, n, upper=True), 2: lambda: words(r, n * 8, marks="!"), 3: lambda: words(r, n, marks="!"), 4: lambda: words(r, n * 8)}.get(kind, lambda: words(r, n))()
        rows.append((i, text, int(kind not in (0, 1, 2))))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    learned = rules.learn(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert len(learned.rules) >= 3 and any(len(x) > 1 for x in learned.rules)
    got = {x["doc_id"]: x for x in rules.judge(table, learned).collect()}
    assert sum(got[i]["kept"] == bool(q) for i, _, q in rows if held(i)) >= 0.97 * sum(held(i) for i, _, _ in rows)
    features = {x["doc_id"]: x for x in rules.statistics(table, "doc_id").select("doc_id", *(F.expr(e).alias(f) for f, e in rules.FEATURES.items())).collect()}
    fits = lambda x, rule: all((x[f] >= t) if op == ">=" else (x[f] < t) for f, op, t in rule)
    assert all(got[i]["kept"] == (not got[i]["base_failed"] and not any(fits(features[i], rule) for rule in learned.rules)) for i, _, _ in rows)


def naive_score(net, text):
    """The forward pass, byte by byte."""
    raw = (text or "").encode()
    step = quality.CHUNK - quality.OVERLAP
    n = max(1, -(-(len(raw) - quality.OVERLAP) // step))
    raw += bytes(n * step + quality.OVERLAP - len(raw))
    pooled = []
    for c in range(n):
        own = raw[c * step : c * step + quality.CHUNK]
        act = [[sum(float(net.w["E"][k, own[p + k], f]) for k in range(quality.WIDTH)) for f in range(quality.FILTERS)] for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
        pooled.append([math.tanh(max(a[f] for a in act) * 0.5 + float(net.w["b"][f])) for f in range(quality.FILTERS)])
    cols = list(zip(*pooled, strict=True))
    z = [sum(c) / n for c in cols] + [max(c) for c in cols] + [min(c) for c in cols]
    hidden = [max(0.0, sum(z[i] * float(net.w["H"][i, j]) for i in range(len(z))) + float(net.w["h"][j])) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-sum(x * float(w) for x, w in zip(hidden, net.w["o"], strict=True)) - float(net.w["c"][0])))


def test_scores_equal_a_naive_forward_pass():
    net = quality.ByteConvNet(seed=2)
    net.w["b"][:] = np.linspace(-1, 1, quality.FILTERS)
    texts = ["", None, "short", "é" * 300, "text of several chunks " * 70, "x" * 512, "y" * 511, "z" * 961]
    assert np.allclose(net.scores(texts), [naive_score(net, t) for t in texts], atol=1e-5)


def test_gradients_equal_differences():
    net, r = quality.ByteConvNet(seed=4), np.random.default_rng(1)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    docs, y = [quality.chunks("abc def " * 30), quality.chunks("other words; " * 200), quality.chunks("")], np.array([1.0, 0.0, 1.0])

    def loss():
        out = 0.0
        for d, q in zip(docs, y, strict=True):
            p = net.head(net.joined(net.pooled(d).astype(np.float64), np.array([0]), np.array([len(d)])))[1][0]
            out -= (q * math.log(p) + (1 - q) * math.log(1 - p)) / len(docs)
        return out

    g = net.gradient(docs, y)
    for k, w in net.w.items():
        flat = w.reshape(-1)
        for i in r.choice(len(flat), min(6, len(flat)), replace=False) if k != "E" else [np.ravel_multi_index((2, ord("d"), 3), w.shape), np.ravel_multi_index((0, ord(" "), 7), w.shape), *np.argsort(-np.abs(g[k]).reshape(-1))[:4]]:
            was, step = flat[i], 1e-3
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * step) - g[k].reshape(-1)[i]) < 2e-3 * max(1.0, abs(g[k].reshape(-1)[i]) * 20), (k, i)


def test_training_sees_all_of_a_long_text(spark):
    """What tells good from bad stands once in a text of many chunks, beyond any few of them."""
    r = random.Random(6)
    rows = []
    for i in range(160):
        body = [words(r, 90) for _ in range(25)]
        if i % 2:
            body[r.randrange(25)] += " $$$@@@%%% $$$@@@%%% "
        rows.append((i, " ".join(body), 1 - i % 2))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    net = quality.fit(table, table.select("doc_id", "quality"))
    got = {x["doc_id"]: x["score"] for x in quality.score(table, net).collect()}
    own = [i for i in range(160) if held(i)]
    assert sum((got[i] > 0.5) == (i % 2 == 0) for i in own) >= 0.9 * len(own)


def test_the_training_sample_is_bounded_in_bytes(spark, docs, labels, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.ByteConvNet, "fit", lambda self, own, y: seen.append(own))
    quality.fit(docs, labels, most_bytes=50_000)
    quality.fit(docs, labels)
    assert 0 < len(seen[0]) < len(seen[1]) and sum(x.size for x in seen[0]) < 2 * 50_000 + 600 * len(seen[0])


def naive_language(text, profiles):
    """The bundle of a text's n-grams, one by one."""
    symbols, gap = [], True
    for c in " " + (text or "") + " ":
        s = ord(c.lower()[0]) if c.isalpha() else 0
        if s or not gap:
            symbols.append(s)
        gap = not s
    symbols = [0, *symbols, *([0] if symbols and symbols[-1] else [])]
    v = np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        v += np.roll(langid.letter_vector(a), 2) * 1.0 * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c)
    cos = profiles.prototypes @ v / np.linalg.norm(v)
    return profiles.languages[int(np.argmax(cos))], float(min(1, max(0, cos.max())))


def test_languages_equal_a_naive_bundle(docs):
    profiles = langid.fit(docs)
    texts = ["Hello, world: of the 3 things!", "über  die Straße\n\n", "日本語 の text", "a", "É", "x1y22z", *(r["text"] for r in docs.limit(5).collect())]
    for t in texts:
        lang, cos = profiles.predict(t)
        want = naive_language(t, profiles)
        assert lang == want[0] and abs(cos - want[1]) < 1e-6


def test_quality_of_the_held_out(spark, docs, labels, odd):
    net = quality.fit(docs, labels)
    got = quality.score(docs, net).join(labels, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"]) for r in got)
    judged = [(r["quality"], r["score"]) for r in got if r["held_out"] and r["quality"] is not None]
    good, bad = ([s for q, s in judged if q == k] for k in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.9 * len(good) * len(bad) > 0
    rows = quality.score(odd, net).collect()
    assert len(rows) == len(ODD) and len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    kept = quality.keep_good(odd, net, 0.0)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert quality.keep_good(odd, net, 1.1).count() == 0
    none = spark.createDataFrame([], DOCS)
    assert quality.score(none, net).count() == 0
    untrained = quality.fit(docs, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, untrained).collect())


def test_quality_sees_the_whole_text(docs, labels):
    net = quality.ByteConvNet()
    text = "plain words " * 4000
    assert net.scores([text])[0] != net.scores([text[:-40] + "$$$$ BUY NOW >>>> #### CLICK HERE !!!!!!"])[0]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def fits(host, path):
    own = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(own, key=lambda r: len(r.rule), default=None)


URLS = [None, "", "no scheme/net/", "http://", "http://net", "http://NET/", "http://a.Net/x?y#z", "https://www.EXAMPLE.net/en/1", "https://example.net/enx/", "https://notexample.com/de/1", "https://m.example.com/de/1#f", "https://example.com/de", "http://x.org/fr/?q=://b.net/", "http://x.org?/fr/", "http://ÄÖ.example.net/en/Ü", "a://b://net/x", "http://h/\n/p", "http://example.net\n/en/"]


def test_urls_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(10_000_000 + i, u, None) for i, u in enumerate(URLS)] + [(None, URLS[6], "<title>x")] * 2, pages.schema)
    every = pages.union(more)
    want = sorted(((r["page_id"] is None, r["page_id"] or 0, *(p := parts(r["url"])), getattr(fits(*p), "rule", "")) for r in every.collect()))
    got = urls.filter_urls(clashing(every), URL_RULES).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["host"], r["path"], r["rule"] or "") for r in got) == want
    for r in got:
        rule = fits(r["host"], r["path"])
        assert r["verdict"] in ("allow", "block") and (rule is None or r["verdict"] == rule.verdict)
    assert urls.filter_urls(every.limit(0), URL_RULES).count() == 0
    assert urls.filter_urls(more, []).where("rule IS NOT NULL").count() == 0


def test_names_are_split_into_words():
    s = urls.Segmenter({"spam": 5, "farm": 5, "far": 3, "blog": 9})
    assert s.split("spamfarm") == ["spam", "farm"] and s.split("") == [] and "".join(s.split("blogzzspam")) == "blogzzspam"
    assert s.tokens("Spam2farm".lower(), "/Blog-9") == ["h:spam", "h:0", "h:farm", "p:blog", "p:0"]
