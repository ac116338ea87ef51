"""Expressions that rows are read from are worked out once, not once for each field or filter."""

from glossmill.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_cut_once_before_they_are_rewritten(spark):
    assert plan(spark, "noise_rewrite").count("(?<=[.!?])") == 1


def test_places_after_a_pattern_are_sought_once(spark):
    assert plan(spark, "json_logprob_true_false").count("[fact,\":]") + plan(spark, "json_logprob_true_false").count("array(fact, \":)") <= 1
