"""Records of all modes: a document is made where it lies."""

import re

import pytest

from glossmill.plans import bound_operators as B
from glossmill.plans.bound import Tables


@pytest.fixture
def tables(spark, tmp_path):
    texts = ["The dog, der Hund. It ran. So it did. ", "  ", None, "", "\n", "de la casa. Dr. Who came! 今日。明日。", "x", "la la. athe de_la der "]
    rows = [(i, "en", "s", 0, x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, source string, n_chars bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return Tables(spark, str(tmp_path))


def test_a_text_is_cut_once(tables):
    plan = B.records(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(", plan)) == 1


def test_bare_texts_are_all_that_is_shuffled(tables):
    plan = B.whole_records(tables)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    assert len(joins) == 1 and not any("ArrowEvalPython" in line for line in plan[joins[0] :])


def test_parts_are_those_of_the_single_steps(tables):
    got = {r["docid"]: r for r in B.whole_records(tables).collect()}
    assert set(got) == {0, 4, 5, 6, 7}
    assert (got[5]["en_title"], got[7]["en_abstract"], got[0]["en_title"]) == ("\n", "x", None)
    for r in B.records(tables).collect():
        assert all(got[r["docid"]][c] == r[c] for c in r.asDict())
    assert got[5]["noisy_sentences"] == ["casa.", "Dr. Who came!", "今日。", "明日。"] and got[7]["noisy_abstract"] == "la. athe de_la "
