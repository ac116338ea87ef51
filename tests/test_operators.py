"""Operators on small hand-made rows, with the rows they must give."""

import math

import pytest
from pyspark.sql import functions as F

from glossmill.functions import structure as S
from glossmill.functions import texts as A
from glossmill.operators import evaluation as E
from glossmill.operators import instructions as I
from glossmill.operators import mixture as M
from glossmill.operators import noise as N
from glossmill.operators import phrases as P
from glossmill.operators import ranking as R
from glossmill.operators import retrieval as K
from glossmill.operators import switching as W


def one(spark, column, **values):
    """A column's value over one row of string, array or map values."""
    row = spark.range(1).select(*(v.alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).collect()[0]["x"]


def text(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("t,want", [("Dr. X went. He left!  See Fig. 3? 一。二。", ["Dr. X went.", "He left!", "See Fig. 3?", "一。", "二。"]), ("one", ["one"]), ("  ", []), ("", []), (None, None)])
def test_sentences(spark, t, want):
    assert text(spark, S.sentences(F.col("t")), t) == want


@pytest.mark.parametrize("t", ["Dr. x went. He left!  Then (yes.) Z", "一。二。 三", "no end", "A.\nB. ", "a.b", " lead. x"])
def test_lossless(spark, t):
    got = text(spark, S.sentences_lossless(F.col("t")), t)
    assert "".join(got) == t and (t != "A.\nB. " or got == ["A.\n", "B. "])


QA = [
    ("<think>Q: x</think>Question 1: a?\nAnswer 1: b\nQuestion 2: c?\nAnswer: d\n", (None, [("a?", "b"), ("c?", "d")])),
    ("Sure\n\n\n**Question**: a\n**Answer**: b\n**Question 2**: c\nA: d\nmore", (None, [("a", "b"), ("c", "d\nmore")])),
    ("Question: a\nAnswer: b", ("headings", [])),
    ("</think>Q1: a\nQ2: b", ("answers", [])),
    ("</think>Q1: a\nQ2: b\nA2: c", (None, [("b", "c")])),
    ("Q1: a\nA: b\nQ2: c\nA: d", ("headings", [])),
    ("".join(f"Q{i}: a{i}\nA: b{i}\n" for i in range(5)), (None, [(f"a{i}", f"b{i}") for i in range(5)])),
    ("", ("headings", [])),
]
ASKED = [
    ("ja", "### 背景質問1：あ？\n### 回答1：い\n## 2. 問題：う\n#答案: え", (None, [("あ？", "い"), ("う", "え")])),
    ("ja", "質問：あ\n回答：い\n質問：う\n回答：え", ("headings", [])),
    ("ja", "</think>### 質問：あ\n### 質問：い\n", ("answers", [])),
    ("ja", "### 質問：. あ\n### 質問：い", ("headings", [])),
    ("zh", "# 提问 1：甲\n# 回答 1：乙\n# 提问 2：丙\n# 回答 2：丁", ("headings", [])),
    ("zh", "好\n\n\n# 提问 1：甲\n# 回答 1：乙\n# 问题2: 丙\n# 答案：丁", (None, [("甲", "乙"), ("丙", "丁")])),
    ("xx", "Q: a", None),
]


@pytest.mark.parametrize("lang,t,want", ASKED)
def test_qa_pairs_of_languages(spark, lang, t, want):
    got = text(spark, S.qa_pairs(F.col("t"), lang), t)
    assert (got and (got["reject"], [tuple(x) for x in got["qa"]])) == want


@pytest.mark.parametrize("t,want", QA)
def test_qa_pairs(spark, t, want):
    got = text(spark, S.qa_pairs(F.col("t")), t)
    assert (got["reject"], [tuple(x) for x in got["qa"]]) == want
    assert text(spark, S.qa_pairs(F.col("t")), None) is None


@pytest.mark.parametrize("t,want", [('{"title": "a", "abstract": "b\nc"}', ("a", "b\nc")), ("Title: a\nAbstract: b c", ("a", "b c")), ("none", None), (None, None)])
def test_translation(spark, t, want):
    got = text(spark, S.translation_parts(F.col("t")), t)
    assert (got and tuple(got)) == want


def test_tokens_there_and_back(spark):
    t = "Don't pay 1,200.50% (or 3) to x.y@z.org -- see https://a.b/c, U.S. well-known 日本."
    tokens = text(spark, S.word_tokens(F.col("t")), t)
    assert tokens == ["Don't", "pay", "1,200.50%", "(", "or", "3", ")", "to", "x.y@z.org", "--", "see", "https://a.b/c,", "U.S.", "well-known", "日", "本", "."]
    assert one(spark, S.detokenized(F.col("w")), w=F.array(*map(F.lit, ["a", ",", "(", "b", ")", "!", "“", "c", "”"]))) == "a, (b)! “c”"
    assert text(spark, S.word_tokens(F.col("t")), "") == [] and one(spark, S.detokenized(F.col("w")), w=F.array().cast("array<string>")) == ""


@pytest.mark.parametrize("t,want", [("", "Japanese"), (" ", "Japanese"), ("かな", "Japanese"), ("ab1", "English"), ("!?", "En-Punctuation"), ("。、", "Ja-Punctuation"), ("aé", "Other")])
def test_char_class(spark, t, want):
    assert text(spark, S.char_class(F.col("t")), t) == want


def test_located_and_replaced(spark):
    tokens = F.array(*map(F.lit, ["a", "zz", "b", "a", "b"]))
    assert [tuple(x) for x in text(spark, S.located(F.col("t"), tokens), "a b a")] == [("a", 0, 1), ("b", 2, 3), ("a", 4, 5)]
    recipe = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("code")) for a, b, c in [(0, 1, "long"), (2, 3, ""), (4, 6, "é")]))
    assert text(spark, S.spans_replaced(F.col("t"), recipe), "a b cd e") == "long  é e"


def test_greedy_spans_touching_counts_as_overlap(spark):
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(0, 5), (5, 7), (6, 9), (20, 30), (22, 23), (10, 20)]))
    assert [tuple(x) for x in one(spark, S.greedy_spans(F.col("s")), s=spans)] == [(0, 5), (6, 9), (20, 30)]


@pytest.mark.parametrize("tags,want", [([1, 2, 0, 1, 1], ["a b", "d", "e"]), ([0, 0, 0, 0, 0], ["none"]), ([2, 2, 0, 2, 1], ["a b", "d", "e"])])
def test_bio(spark, tags, want):
    assert one(spark, S.bio_entities(F.col("w"), F.col("t")), w=F.array(*map(F.lit, "abcde")), t=F.array(*map(F.lit, tags))) == want


def test_abbreviations(spark):
    got = text(spark, S.abbreviations(F.col("t")), "The world health organization (WHO) and a unit (ABC), none (x).")
    assert [tuple(x) for x in got] == [("WHO", "world health organization"), ("ABC", "and a unit")]


def test_scores(spark):
    a = lambda *xs: F.array(*(F.lit(float(x)) for x in xs))
    assert one(spark, S.argmin(F.col("l")), l=a(3, 1, 1, 2)) == 1
    assert one(spark, S.normalized_argmin(F.col("l"), F.col("n")), l=a(4, 3, 9), n=a(4, 1, 9)) == 0
    assert one(spark, S.normalized_argmin(F.col("l"), F.col("n")), l=a(4, 3, 9), n=a(4, 0, 9)) == 1
    assert one(spark, S.norm_losses(F.col("l"), F.col("n")), l=a(4, 3), n=a(4, 0)) is None
    items = F.array(*map(F.lit, "abcdefg"))
    assert one(spark, S.quartile_parts(F.col("s"), "12"), s=items) == list("abcd") and one(spark, S.quartile_parts(F.col("s"), "4"), s=items) == ["g"]
    assert [tuple(x) for x in one(spark, S.aligned(F.col("a"), F.col("b")), a=F.array(*map(F.lit, [1, 2, 3, 4])), b=F.array(*map(F.lit, [9, 2, 4])))] == [(1, 1), (3, 2)]
    got = one(spark, S.prefix_suffix(F.col("s"), F.lit("k")), s=items)
    assert (got["prefix"] + " " + got["suffix"]).split() == list("abcdefg") and got["prefix"] and got["suffix"]
    assert one(spark, S.prefix_suffix(F.col("s"), F.lit("k")), s=F.array(F.lit("a"))) is None


@pytest.mark.parametrize("tokens,want", [(["f", ":", " True", "x"], (True, -2.0)), (["f", ":", "false"], (False, -2.0)), (["f", ":", "true", "f", ":", "false"], None), (["f", "x", "true"], None), ([], None)])
def test_true_false(spark, tokens, want):
    w, p = F.array(*map(F.lit, tokens)).cast("array<string>"), F.transform(F.array(*map(F.lit, tokens)).cast("array<string>"), lambda _, i: -i.cast("double"))
    got = one(spark, S.true_false(F.col("w"), F.col("p"), ["f", ":"]), w=w, p=p)
    assert (got and tuple(got)) == want


def test_blocks_and_robust_json():
    assert A.first_block('} x {"a": "}{", "b": {"c": 1}} {"d": 2}') == '{"a": "}{", "b": {"c": 1}}'
    assert A.first_block('[ {"a": [1, "]"]} ] [2]', "[", "]") == '[ {"a": [1, "]"]} ]' and A.first_block("{ open") is None and A.first_block(None) is None
    assert A.first_block("{ {\"a\": 1}") == '{"a": 1}'
    assert A.robust_json('```json\n{"a": TRUE, "b": NULL, "c": "TRUE", "d": [None, False]}\n```') == '{"a": true, "b": null, "c": "TRUE", "d": [null, false]}'
    assert A.robust_json("nothing") is None and A.robust_json(None) is None and A.robust_json("{bad}") is None
    assert A.word_levenshtein("a b c".split(), "a x c d".split()) == 2 and A.word_levenshtein([], ["a"]) == 1


# --- order ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 50])
def test_global_places(spark, n):
    rows = spark.range(n).select((F.col("id") * 7 % 50).alias("k")).repartition(5)
    got = sorted((r["k"], r["place"]) for r in R.global_places(rows, F.col("k").desc()).collect())
    assert got == sorted((k, i + 1) for i, k in enumerate(sorted((i * 7 % 50 for i in range(n)), reverse=True)))


def test_overlap_order(spark):
    rows = spark.createDataFrame([(1, 0.5, False), (2, 0.9, True), (3, 0.5, False), (4, 0.7, False), (5, None, True)], "id int, o double, base boolean")
    hi, lo = R.overlap_order(rows, F.coalesce("o", F.lit(0.0)), F.col("base"), "id")
    order = lambda df: [r["id"] for r in df.orderBy("place").collect()]
    assert order(hi) == [2, 5, 4, 1, 3] and order(lo) == [2, 5, 3, 1, 4]


# --- noise ---------------------------------------------------------------------------------------------------------------
def test_word_noise_spares_the_first_token(spark):
    words = F.array(*(F.lit(f"w{i}") for i in range(200)))
    rows = spark.range(1).select(words.alias("w"))
    m, d, r = rows.select(N.mask(F.col("w"), F.lit(1), 0.5).alias("m"), N.delete(F.col("w"), F.lit(1), 0.5).alias("d"), N.replace(F.col("w"), F.lit(1), 1.0, F.array(F.lit("v"))).alias("r")).collect()[0]
    masked = [i for i, x in enumerate(m["tokens"]) if x == "<unk>"]
    assert 70 < len(masked) < 130 and 0 not in masked and [i for i, x in enumerate(m["labels"]) if x != N.PLAIN] == masked
    assert d["tokens"][0] == "w0" and 70 < len(d["tokens"]) < 130 and len(d["labels"]) == len(d["tokens"])
    for i, label in enumerate(d["labels"][1:], 1):
        assert (label == "<delete>") == (int(d["tokens"][i][1:]) != int(d["tokens"][i - 1][1:]) + 1)
    assert r["tokens"] == ["w0"] + ["v"] * 199


def test_reorders_displace_so_many(spark):
    rows = spark.createDataFrame([(i, [f"t{j}" for j in range(n)]) for i, n in enumerate([1, 2, 3, 5, 40])], "id int, w array<string>")
    for r in N.token_reorder(rows, "w", "id", 0.25).collect():
        n = len(r["w"]) - 1
        moved = sum(a != b for a, b in zip(r["w"], r["noisy"]))
        assert sorted(r["noisy"]) == sorted(r["w"]) and r["noisy"][0] == "t0" and moved == r["displaced"] == (min(n, max(int(n * 0.25), 2)) if n > 1 else 0)
    for r in N.sentence_reorder(rows, "w", "id", 0.5).collect():
        n = len(r["w"])
        assert sorted(r["noisy"]) == sorted(r["w"]) and r["displaced"] == (min(n, max(n // 2, 2)) if n > 1 else 0)
        assert all(abs(i - int(x[1:])) <= 3 for i, x in enumerate(r["noisy"]))


def test_word_syntax_keeps_displaced_words(spark):
    t = " ".join("w" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(60))
    got = N.word_syntax(spark.createDataFrame([(1, t), (2, None), (3, "one")], "id int, t string"), "t", "id", 0.3).collect()
    by = {r["id"]: r["noisy"] for r in got}
    assert by[2] is None and by[3] == "one"
    words = by[1].split()
    assert set(words) <= set(t.split()) and len(set(words)) == len(words) and 25 < len(words) < 56


def test_synonyms(spark):
    lexicon = spark.createDataFrame([("of the", "belonging to"), ("the", "le"), ("cat", "chat")], "phrase string, synonym string")
    rows = spark.createDataFrame([(1, "The cat, of the house of"), (2, "no match"), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: (r["noisy"], r["labels"], r["n_noise"]) for r in N.synonyms(rows, "id", "text", lexicon, 1.0, "s").collect()}
    new, old = "<synonym>", N.PLAIN
    assert got == {1: ("le chat, belonging to house of", [new] * 4 + [old] * 2, 3), 2: ("no match", [old] * 2, 0), 3: ("", [], 0), 4: (None, None, 0)}
    assert {(r["noisy"], tuple(r["labels"])) for r in N.synonyms(rows.where("id = 1"), "id", "text", lexicon, 0.0, "s").collect()} == {("The cat, of the house of", (old,) * 6)}


def test_rewrite(spark):
    s, r = F.array(*map(F.lit, "abc")), F.array(F.array(F.lit("A")), F.array().cast("array<string>"), F.array(F.lit("C1"), F.lit("C2")))
    got = spark.range(1).select(N.rewrite(s, r, F.lit(1), 1.0).alias("x")).collect()[0]["x"]
    assert got["sentences"][:2] == ["A", "b"] and got["sentences"][2] in ("C1", "C2") and got["labels"] == ["<rewrite>", N.PLAIN, "<rewrite>"]


def test_specs():
    assert N.parse_spec("retoken-4@3") == N.Spec("retoken", None, 4, 3, None) and N.parse_spec("rewrite@syntax-40") == N.Spec("rewrite", "syntax", 40, None, None)
    assert N.parse_spec("partial-12") == N.Spec("partial", None, None, None, "12") and N.parse_spec("none").kind == "none"
    for bad in ("mask", "partial-15", "nothing-3", "mask8", "rewrite@x-4"):
        with pytest.raises(ValueError):
            N.parse_spec(bad)


def test_dispatch(spark):
    rows = spark.createDataFrame([(1, ["a b c.", "d e.", "f g.", "h i."])], "id int, s array<string>").withColumn("r", F.transform("s", lambda x: F.array(F.upper(x))))
    got = lambda spec, **k: N.dispatch(rows, "id", "s", spec, rewrites="r", **k).collect()[0]["noisy"]
    assert got("none") == "a b c. d e. f g. h i." and got("partial-12") == "a b c. d e." and got("rewrite-100") == "A B C. D E. F G. H I." and got("mask-100") == "a" + " <unk>" * 8
    assert sorted(got("retoken-50@4").split()) == sorted("a b c. d e. f g. h i.".split()) and got("delete-100") == "a"
    assert set(got("rewrite@syntax-100").replace(".", " ").split()) <= set("ABCDEFGHI")


# --- switching -----------------------------------------------------------------------------------------------------------
def test_entity_aliases(spark):
    mentions = spark.createDataFrame([(1, "Cat", [("c1", 0.5, "cat"), ("c2", 0.9, "dog")]), (2, "x", [("c9", 1.0, "x")]), (3, "none", [])], "mention int, text string, cands array<struct<cui string, score double, name string>>")
    lexicon = spark.createDataFrame([("c1", ["chat", "the cat"]), ("c2", ["chien"])], "cui string, aliases array<string>")
    run = lambda **k: {r["mention"]: (r["cui"], r["code"]) for r in W.entity_aliases(mentions, lexicon, **k).collect()}
    assert run() == {1: ("c2", "chien")} and run(exact=True, alias="min_diff") == {1: ("c1", "the cat")} and run(exact=True, alias="max_diff") == {1: ("c1", "chat")}
    assert run(candidates="threshold", threshold=0.95) == {} and run(candidates="all", alias="min_diff") == {1: ("c1", "the cat")}
    with pytest.raises(ValueError):
        run(candidates="best")
    got = spark.range(1).select(W.good_aliases(F.array(*map(F.lit, ["ﾈｺ", "CAT", "chat", "cat (qualifier value)"])), F.lit("cat"), ["(qualifier"]).alias("x")).collect()[0]["x"]
    assert got == ["chat"]


def test_switch_entities(spark):
    docs = spark.createDataFrame([(1, "a cat sat on mats"), (2, "nothing")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, 2, 5, "CHAT"), (1, 2, 9, "long"), (1, 5, 9, "touch"), (1, 13, 17, "")], "doc_id int, start int, end int, code string")
    got = {(r["doc_id"], r["copy"]): (r["noisy"], len(r["recipe"])) for r in W.switch_entities(docs, spans, 1.0, copies=2).collect()}
    assert got == {(1, 0): ("a CHAT sat on ", 2), (1, 1): ("a CHAT sat on ", 2), (2, 0): ("nothing", 0), (2, 1): ("nothing", 0)}
    assert {r["noisy"] for r in W.switch_entities(docs, spans, 0.0).collect()} == {"a cat sat on mats", "nothing"}


def test_lemmas_and_index(spark):
    tokens = spark.createDataFrame([(1, 0, "Cats", "cat", "N"), (1, 1, "run", "run", "V"), (1, 2, "cat", "cat", "X")], "id int, pos int, raw string, lemma string, tag string")
    words = spark.createDataFrame([("cat", "N", "fra", "chat"), ("cat", "N", "eng", "CAT"), ("run", "N", "fra", "courir")], "lemma string, tag string, lang string, synonym string")
    assert [tuple(r) for r in W.lemma_codes(tokens, words).collect()] == [(1, 0, "Cats", "chat", "fra")]
    rows = spark.createDataFrame([(1, ["run", "of", "the", "mill"], ["V", "N", "N", "N"])], "id int, words array<string>, tags array<string>")
    entries = spark.createDataFrame([(["of"], "A"), (["of", "the"], "B"), (["run", "of"], "C"), (["mill", "x"], "D")], "words array<string>, code string")
    assert [tuple(r) for r in P.code_index(rows, entries).collect()] == [(1, 1, "B")]


def test_synonyms(spark):
    links = spark.createDataFrame([("w", p, s) for p, s in [(0, "a"), (0, "w"), (0, "+b"), (1, "a"), (1, "c+"), (1, "d"), (2, "e"), (3, "f")]], "word string, place int, synonym string")
    assert [tuple(r) for r in W.synonyms_until(links).collect()] == [("w", ["a", "b", "c", "d"])]
    words = spark.createDataFrame([(1, "big_cat", "eng"), (2, "lion", "eng"), (3, "猫_x", "jpn")], "wordid int, lemma string, lang string")
    senses = spark.createDataFrame([("s1", 1), ("s1", 2), ("s1", 3), ("s2", 1)], "synset string, wordid int")
    assert sorted((r[0], r[1], r[2]) for r in W.synset_expand(words, senses).collect()) == [(1, "eng", ["lion"]), (1, "jpn", ["猫_x"]), (2, "eng", ["big cat"]), (2, "jpn", ["猫_x"]), (3, "eng", ["big cat", "lion"])]


# --- instructions --------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def records(spark):
    rows = spark.createDataFrame([("d1", "T", "A b. C d.", ["A b.", "C d."], ["k1", "k2", "k3"], [("q1", "a1"), ("q2", "a2")], [("entail", "x", "y")], [("goal", "g"), ("result", "r")], ("A b. ", "so C")), ("d2", None, None, ["only"], [], None, [], [], None)], "docid string, title string, abstract string, sentences array<string>, keywords array<string>, qa array<struct<q string, a string>>, causal array<struct<relation string, a string, b string>>, gmrc array<struct<section string, text string>>, conclu struct<before string, conclusion string>")
    both = lambda f: lambda x: F.struct(f(x["q"]).alias("q"), f(x["a"]).alias("a"))
    for view, f in (("roman", F.upper), ("noisy", lambda c: F.regexp_replace(c, "C ", ""))):
        rows = rows.withColumns({f"{view}_title": f(F.col("title")), f"{view}_abstract": f(F.col("abstract")), f"{view}_sentences": F.transform("sentences", f), f"{view}_qa": F.transform("qa", both(f))})
    return rows.withColumns({"en_title": F.lit("ET"), "en_abstract": F.lit(None).cast("string")})


def texts_of(df):
    return sorted((r["docid"], r["text"]) for r in df.collect())


def test_builders(spark, records):
    fill = lambda kind, **sides: [t.format(**sides) for t in I.TEMPLATES[kind]]
    (d, t), = texts_of(I.summarization(records))
    assert d == "d1" and t in fill("summarization", a="A b. C d.", b="T")
    (_, t), = texts_of(I.completion(records, "noisy", "raw"))
    assert t in fill("completion", a="A b.", b="C d.")
    assert [x for _, x in texts_of(I.qa(records, "roman", "raw"))] and all(any(x in fill("qa", a=f"Q{k}", b=f"a{k}") for k in (1, 2)) for _, x in texts_of(I.qa(records, "roman", "raw")))
    assert texts_of(I.gmrc(records)) == [("d1", "Given: g\nThe result was: r"), ("d1", "Given: r\nThe goal was: g")]
    assert [r["type"] for r in I.causal(records).collect()] == ["causal-entail"] and texts_of(I.causal(records)) == [("d1", "If: x\nThen: y")]
    assert texts_of(I.text2key(records)) == [("d1", "Text: T. A b. C d.\nIts keywords: k1, k2, k3")]
    assert len(texts_of(I.romanization(records))) == 4 and texts_of(I.conclusion(records)) == [("d1", "What is to be concluded from this? A b. \nso C")]
    assert [x for _, x in texts_of(I.denoise(records))] and len(texts_of(I.denoise(records))) == 1
    r, = I.denoise(records, tuning=True).collect()
    assert (r["noise"], r["raw"]) == ("d.", "C d.") and "{noise}" in r["template"] and "{raw}" in r["template"]
    assert len(texts_of(I.medical_translation(records))) == 1 and texts_of(I.pure_text(records)) == [("d1", "A b. C d.")]


def test_braces_in_texts_stay(spark):
    got = spark.createDataFrame([("k", "{b} {a}", "x")], "k string, p string, q string").select(I.filled("qa", F.col("k"), a=F.col("p"), b=F.col("q")).alias("t")).collect()[0]["t"]
    assert "{b} {a}" in got and "x" in got


def test_instruction_dispatch(records):
    assert len(I.MODES) == 25 and {r["mode"] for r in I.dispatch(records, ["qa", "roman_qa", "gmrc"]).collect()} == {"qa", "roman_qa", "gmrc"}
    for bad in (["qa", "qa"], ["nothing"], []):
        with pytest.raises(ValueError):
            I.dispatch(records, bad)


# --- evaluation ----------------------------------------------------------------------------------------------------------
def test_votes_and_triples(spark):
    answers = spark.createDataFrame([("r1", True, -0.1), ("r1", True, -0.2), ("r1", True, 0.0), ("r2", True, -1.0), ("r2", False, 0.0), ("r3", True, 0.0), ("r3", True, 0.0), ("r3", True, 0.0)], "request_id string, factuality boolean, logprob double")
    triples = spark.createDataFrame([("r1", "en", "m1", "ss", "o", 0.4, 1), ("r1", "en", "m2", "ssssss", "oo", 0.5, 2), ("r3", "ja", "m1", "s", "o", 1.0, 3), ("r3", "ja", "m2", "s", "o", 0.0, 4), ("r4", "en", "m1", "s", "o", 0.0, 5), ("r4", "en", "m2", "long", "o", 0.1, 6)], "request_id string, lang string, model string, s string, o string, ratio double, triple int")
    assert sorted(map(tuple, E.best_triple(triples, "m2").collect())) == [("r1", 2), ("r3", 4), ("r4", 6)]
    got = sorted(tuple(r) for r in E.vote_triples(answers, triples, "m2").select("place", "request_id", "votes", "triple").collect())
    assert got == [(1, "r3", 3, 4), (2, "r1", 3, 2)]
    assert {r["request_id"]: round(r["confidence"], 6) for r in E.model_votes(answers).collect()}["r2"] == round(math.exp(-1), 6)


def test_bimatch(spark):
    args = spark.createDataFrame([(1, " Cat "), (1, ""), (2, "dog")], "request_id int, arg string")
    ents = spark.createDataFrame([(1, "the CAT", 0.6), (1, "ca", 0.59), (1, "", 1.0), (2, "cat", 1.0), (2, "do", 0.9)], "request_id int, alias string, score double")
    assert sorted(tuple(r) for r in E.bimatch(args, ents).collect()) == [(1, " Cat ", "the CAT"), (2, "dog", "do")]


def test_mcq(spark):
    items = spark.createDataFrame([(1, "a [BLANK]", "b [BLANK]?", "ans", ["x", "y", "z"]), (2, "a", "b [BLANK]", "ans", ["x", "y", "z"]), (3, "[BLANK] [BLANK]", "[BLANK]", "a", ["x", "y", "z"]), (4, "[BLANK]", "[BLANK]", "a", ["x", " ", "z"])], "id int, cloze string, paraphrase string, answer string, distractors array<string>")
    got = E.assemble_mcq(items).collect()
    assert sorted((r["id"], r["dataset"], r["question"]) for r in got) == [(1, "generalization", "b [BLANK]?"), (1, "memorization", "a [BLANK]")]
    assert all(r["options"][r["answer_idx"]] == "ans" and sorted(r["options"]) == ["ans", "x", "y", "z"] for r in got)
    assert text(spark, E.option_lines(F.array(F.lit("x"), F.lit("y"))), None) == "A. x\nB. y"


def test_demos(spark):
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(30)], "id int, text string")
    gallery = spark.createDataFrame([(i, f"t{i % 4}") for i in range(40)], "key int, text string")
    got = {r["id"]: r["demos"] for r in E.draw_demos(queries, gallery, 2).collect()}
    assert len(got) == 30 and all(len(d) == len(set(d)) <= 2 for d in got.values()) and len({tuple(d) for d in got.values()}) > 5
    prompts = {r["id"]: r["prompt"] for r in E.fewshot_prompts(queries, E.draw_demos(queries.where("id < 5"), gallery, 2)).collect()}
    assert prompts[7] == "q7" and prompts[3] == "\n\n".join([*got[3], "q3"])


def test_requests_and_padding(spark):
    ids = lambda *xs: F.array(*map(F.lit, xs))
    got = one(spark, E.score_request(F.col("c"), F.col("o"), 4), c=ids(1, 2, 3), o=ids(8, 9))
    assert (got["input_ids"], got["labels"]) == ([2, 3, 8, 9], [-100, -100, 8, 9])
    got = one(spark, E.score_request(F.col("c"), F.col("o"), 2), c=ids(1, 2, 3), o=ids(7, 8, 9))
    assert (got["input_ids"], got["labels"]) == ([8, 9], [8, 9])
    rows = spark.createDataFrame([(1, "a", [1, 2]), (2, "a", [3]), (3, "b", [])], "id int, b string, x array<int>")
    pads = lambda side: {r["id"]: (r["x"], r["attention_mask"]) for r in E.pad_batch(rows, "b", {"x": 0}, side).collect()}
    assert pads("right") == {1: ([1, 2], [1, 1]), 2: ([3, 0], [1, 0]), 3: ([], [])} and pads("left")[2] == ([0, 3], [0, 1])
    scored = E.token_losses(rows, "id", "x", lambda b: [[float(t) for t in x] for x in b], 2)
    assert {r["id"]: r["avg_loss"] for r in scored.collect()} == {1: 1.5, 2: 3.0, 3: None}
    assert one(spark, E.option_loss(F.col("l"), F.col("y")), l=F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), y=ids(-100, 5, 6)) == 6.0


def test_annotate(spark):
    texts = spark.createDataFrame([(1, "A  big Cat, a big cat house."), (2, "nothing"), (3, None)], "id int, text string")
    lexicon = spark.createDataFrame([("big cat", "ANIMAL"), ("cat", "PET"), ("cat house", "PLACE"), ("house", "THING")], "surface string, label string")
    got = sorted(tuple(r) for r in P.annotate(texts, lexicon).collect())
    assert got == [(1, 3, 10, "big Cat", "ANIMAL"), (1, 14, 21, "big cat", "ANIMAL"), (1, 22, 27, "house", "THING")]


# --- retrieval -----------------------------------------------------------------------------------------------------------
def test_knn_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "QUERY_BLOCK", 7)
    monkeypatch.setattr(K, "GALLERY_BLOCK", 11)
    import random

    r = random.Random(3)
    rows = [(i, [float(r.randrange(4)) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, [1.0, 1.0, 1.0]), (99, None)], "id int, vector array<float>")
    got = sorted((x["q"], x["rank"], x["g"]) for x in K.knn(df.where("id % 5 = 0"), df, 4).collect())
    want = []
    for q, v in rows[::5]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), g) for g, w in rows if g != q)[:4]
        want += [(q, i + 1, g) for i, (_, g) in enumerate(near)]
    assert got == sorted(want)
    assert K.knn(df.limit(0), df, 3).collect() == [] and len(K.knn(df.where("id = 1"), df.where("id < 3"), 9).collect()) == 2
    votes = K.vote(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "q int, g int"), spark.createDataFrame([(2, "b"), (3, "a"), (4, "b")], "id int, label string"))
    assert [tuple(x) for x in votes.collect()] == [(1, "b", 2)]


def test_pooled(spark):
    t = F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(8.0)), F.array(F.lit(9.0), F.lit(9.0)))
    assert one(spark, K.pooled(F.col("t"), F.col("m")), t=t, m=F.array(F.lit(1), F.lit(1), F.lit(0))) == pytest.approx([0.6, 0.8])
    assert one(spark, K.pooled(F.col("t"), F.col("m")), t=t, m=F.array(F.lit(0), F.lit(0), F.lit(0))) is None
    assert one(spark, K.cosine_percent(F.col("a"), F.col("b")), a=F.array(F.lit(0.6), F.lit(0.8)), b=F.array(F.lit(1.0), F.lit(0.0))) == pytest.approx(60)


# --- mixtures ------------------------------------------------------------------------------------------------------------
def test_heads_and_prefixes(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(10)], "pos int, doc int").repartition(4)
    assert sorted(tuple(r) for r in M.first_seen(rows, 2, "pos", "doc").collect()) == [(0, 1), (1, 2)]
    ids = rows.select(F.col("pos").alias("id"))
    assert sorted((r["id"], r["type"], r["place"]) for r in M.tuning_head(ids, 2, "id", ids.where("id > 4")).collect()) == [(5, "tuning", 1), (6, "tuning", 2)]
    texts = spark.createDataFrame([(1, "abcde1"), (2, "abcde2"), (3, "abcd"), (4, "abcdx9"), (5, None)], "id int, text string")
    assert sorted(tuple(r) for r in M.shared_prefixes(texts, 5, "id").collect()) == [(1, 1), (2, 1)]


def test_keys_beyond_a_hundred_million(spark):
    """First and last by keys of any size: no composite number."""
    rows = spark.createDataFrame([(1, 2, 10, "late"), (1, 1, 300_000_000, "first"), (2, 1, 5, "a"), (2, 1, 250_000_000, "b")], "s int, iter int, pos bigint, v string")
    got = sorted(tuple(r) for r in rows.groupBy("s").agg(F.min_by("v", F.struct("iter", "pos")), F.max_by("v", F.struct("iter", "pos"))).collect())
    assert got == [(1, "first", "late"), (2, "a", "b")]
