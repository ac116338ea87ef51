"""Headings, cues and sentence ends of Japanese, Chinese and English, by hand and against slow versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glossmill.functions import cues


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items())).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    "lang,text,want",
    [
        ("en", "Objective: a b. Methods: c. Results d", [("goal", "a b."), ("method", "c."), ("result", "d")]),
        ("en", "x [ Results ] r1 【Purpose】 p1", [("result", "r1"), ("goal", "p1")]),
        ("en", "Aim: a Methods: b Aim: c Result: d", [("method", "b Aim: c"), ("result", "d")]),
        ("en", "aim: no methods: no", []),
        ("en", "Patients and Methods: p. (Conclusion) c", [("method", "p."), ("conclu", "c")]),
        ("en", "Methods: only", []),
        ("ja", "【目的】あ。【方法】い。【結果】う。【考察】え。", [("goal", "あ。"), ("method", "い。"), ("result", "う。"), ("conclu", "え。")]),
        ("ja", "目　的：あ　対象と方法　い。結果、結論:う", [("goal", "あ"), ("method", "い。"), ("conclu", "う")]),
        ("ja", "結果は目的とする。方法も", []),
        ("ja", "（ 背景 ）あ「まとめ」い", [("goal", "あ"), ("conclu", "い")]),
        ("zh", "目的：甲。方法:乙。结果 丙。结论　丁", [("goal", "甲。"), ("method", "乙。"), ("result", "丙。"), ("conclu", "丁")]),
        ("zh", "[目的]甲[对象]乙[方法]:丙", [("goal", "甲[对象]乙"), ("method", ":丙")]),
        ("zh", "目的：甲。结果：乙。目的：丙。结论：丁", [("result", "乙。目的：丙。"), ("conclu", "丁")]),
        ("xx", "Aim: a Methods: b", None),
        ("en", "", []),
    ],
)
def test_sections(spark, lang, text, want):
    got = one(spark, cues.section_spans(F.col("t"), F.col("l")), t=text, l=lang)
    assert (got if got is None else [(x["section"], x["text"]) for x in got]) == want
    for x in got or []:
        assert text[x["pos"] - 1 :].startswith(x["heading"])


def test_nulls(spark):
    row = spark.createDataFrame([(None, "en", None), ("a", None, ["a"])], "t string, l string, s array<string>")
    got = row.select(cues.section_spans(F.col("t"), F.col("l")), cues.conclusion_split(F.col("t"), F.col("l")), cues.causal_pairs(F.col("s"), F.col("l")), cues.sentences_cjk(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None), (None, None, None, ["a"])]


def slow_headings(text, sections):
    """One pattern for each section, as alternatives of all words and forms."""
    out = []
    for label, words in sections.items():
        forms = [f for w in map(re.escape, words) for f in (rf"\[\s*{w}\s*\]", rf"\[\s*{w}\s*\]:", rf"【\s*{w}\s*】", rf"\(\s*{w}\s*\)", rf"（\s*{w}\s*）", rf"「\s*{w}\s*」", f"{w}:", f"{w}：", f"{w}　", f"{w} ")]
        found = list(re.finditer("|".join(forms), text))
        if len(found) == 1:
            out.append((found[0].start(), label, found[0].end()))
    return sorted(out)


@pytest.mark.parametrize("lang", ["en", "zh", "ja"])
def test_headings_equal_patterns(lang):
    rng = random.Random(lang)
    words = [w for own in cues.SECTIONS[lang].values() for w in own]
    signs = [*"[]【】()（）「」:： 　", "\n", "x", "あ", "结", "果"]
    for _ in range(3000):
        text = "".join(rng.choice(words) if rng.random() < 0.3 else rng.choice(signs) for _ in range(rng.randrange(1, 14)))
        assert cues.find_headings(text, cues.SECTIONS[lang]) == slow_headings(text, cues.SECTIONS[lang]), text


@pytest.mark.parametrize("lang", ["en", "zh", "ja"])
def test_every_conclusion_cue_is_found(spark, lang):
    rows = [(i, f"前x。{w}後") for i, w in enumerate(cues.CONCLUSIONS[lang])] + [(-1, cues.CONCLUSIONS[lang][0] + "後"), (-2, "none")]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", cues.conclusion_split(F.col("t"), F.lit(lang)).alias("x")).collect())
    assert got[-1] is None and got[-2] is None
    assert all(tuple(got[i]) == ("前x。", t[3:]) for i, t in rows if i >= 0)


@pytest.mark.parametrize("lang", ["en", "zh", "ja"])
def test_conclusions_equal_patterns(lang):
    rng = random.Random(lang)
    words = cues.CONCLUSIONS[lang]
    pattern = re.compile("|".join(map(re.escape, words)), re.I | re.A)
    for _ in range(2000):
        text = "".join(rng.choice(words) if rng.random() < 0.3 else rng.choice("xあ結、 ,") for _ in range(rng.randrange(1, 6)))
        text = text.upper() if rng.random() < 0.3 else text
        want = next((m.start() for m in pattern.finditer(text) if m.start()), None)
        own = tuple(map(cues.ascii_lower, words))
        assert next((h[0] for h in cues.apart(cues.hits(own, cues.ascii_lower(text))) if h[0]), None) == want, text


@pytest.mark.parametrize(
    "lang,parts,want",
    [
        ("ja", ["雨だ。", "したがって、行かない。", "さらに寒い。"], [(1, "entail", "雨だ。", "行かない。"), (2, "neutral", "したがって、行かない。", "寒い。")]),
        ("ja", ["雨だ。", "一方で、晴れ。"], [(1, "contradict", "雨だ。", "晴れ。"), (1, "neutral", "雨だ。", "で、晴れ。")]),
        ("zh", ["下雨。", "因此，不去。", "但是他去。"], [(1, "entail", "下雨。", "不去。"), (2, "contradict", "因此，不去。", "他去。")]),
        ("zh", ["甲。", "除此之外还有乙。"], [(1, "neutral", "甲。", "还有乙。")]),
        ("zh", ["因此在开头。"], []),
        ("en", ["It rains.", "THEREFORE, we stay.", "However we read."], [(1, "entail", "It rains.", "we stay."), (2, "contradict", "THEREFORE, we stay.", "we read.")]),
        ("en", ["It rains, but we go, but slowly.", "x, what's more, y"], [(0, "contradict", "It rains", "we go"), (1, "neutral", "x", "y")]),
        ("en", ["a!, so b", ", so c", "d, sob e", "f, so"], []),
        ("xx", ["a", "so b"], None),
    ],
)
def test_causal_pairs(spark, lang, parts, want):
    got = one(spark, cues.causal_pairs(F.col("s"), F.lit(lang)), s=parts)
    assert (got if got is None else [tuple(x) for x in got]) == want


@pytest.mark.parametrize("lang", ["en", "zh", "ja"])
def test_every_causal_cue_is_found(spark, lang):
    for relation, words in cues.RELATIONS[lang].items():
        rows = [(i, ["甲。", f"{w}、乙。"]) for i, w in enumerate(words)]
        got = spark.createDataFrame(rows, "i int, s array<string>").select("i", F.inline(cues.causal_pairs(F.col("s"), F.lit(lang)))).where(F.col("relation") == relation).collect()
        assert {r["i"] for r in got} == set(range(len(words)))


def test_lists_are_tables(spark):
    table = cues.cue_table(spark, cues.RELATIONS)
    assert cues.lists_of(table) == cues.RELATIONS
    own = table.where("lang = 'en'").selectExpr("lang", "label", "place", "replace(cue, 'so', 'alors') AS cue")
    got = one(spark, cues.causal_pairs(F.col("s"), F.lit("en"), cues.lists_of(own)), s=["a.", "Alors b.", "So c."])
    assert [tuple(x) for x in got] == [(1, "entail", "a.", "b.")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("彼は「行く。待て！」と言った。次。", ["彼は「行く。待て！」と言った。", "次。"]),
        ("本当か？！ はい。", ["本当か？！ ", "はい。"]),
        ("「閉じない。次。", ["「閉じない。", "次。"]),
        ("閉じ」だけ。次", ["閉じ」だけ。", "次"]),
        ("（甲。「乙。」丙。）丁。戊", ["（甲。「乙。」丙。）丁。", "戊"]),
        ("「甲（乙。」丙。）丁。", ["「甲（乙。」丙。）", "丁。"]),
        ("一行目\n二行目", ["一行目\n", "二行目"]),
        ("", []),
    ],
)
def test_cut_sentences(text, want):
    assert cues.cut_sentences(text) == want


def slow_cut(text):
    """Pairs by the same rule, looked up for each end anew."""
    pair, stack = {}, []
    for i, c in enumerate(text):
        if c in cues.OPENING:
            stack.append(i)
        elif c in cues.CLOSING:
            own = [k for k in stack[-8:] if text[k] == cues.OPENING[cues.CLOSING.index(c)]]
            if own:
                pair[own[-1]] = i
                stack = stack[: stack.index(own[-1])]
    out, start = [], 0
    for i, c in enumerate(text):
        if i < start or c not in cues.ENDS or any(a < i < b and not any(p < a < q for p, q in pair.items() if q < b and p < i < q) and a >= start for a, b in pair.items()):
            continue
        end = i + 1
        while end < len(text) and (text[end] in cues.ENDS + cues.CLOSING or text[end].isspace()):
            end += 1
        out.append(text[start:end])
        start = end
    return out + ([text[start:]] if start < len(text) else [])


def test_cuts_equal_a_slow_version():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("「」（）()。！xy \n") for _ in range(rng.randrange(0, 18)))
        got = cues.cut_sentences(text)
        assert "".join(got) == text and got == slow_cut(text), text


def test_a_megabyte_takes_a_second():
    began = time.process_time()
    for text in ("「" * 1_000_000, "」" * 1_000_000, "。" * 1_000_000, "「。」" * 300_000, "結" * 1_000_000, "[ " * 400_000):
        cues.cut_sentences(text)
        cues.find_headings(text, cues.SECTIONS["ja"])
    assert time.process_time() - began < 12


@pytest.mark.parametrize("name", ["inst_gmrc", "inst_causal", "inst_conclusion", "txt_causal_en", "txt_causal_zh_ja"])
def test_texts_go_to_python_once_in_small_batches(spark, name):
    from glossmill.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_steps_of_a_batch_hold_few_rows_and_bytes():
    import pyarrow as pa

    texts = pa.array(["x" * 10, None, "y" * (3 << 20), "", *["z" * 1000] * 200])
    lists = pa.array([["x" * 10, None], None, ["y" * (3 << 20)], [], *[["z" * 500] * 2] * 200])
    for values in (texts, lists, texts[1:], lists[1:]):
        cuts = list(cues._steps(values))
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(values)
        assert max(b - a for a, b in cuts) <= cues.STEP_ROWS and len(cuts) > 3
    assert list(cues._steps(texts[:0])) == []
