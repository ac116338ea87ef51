"""Filters, joins, mixtures, noise, code switching, instructions, retrieval and evaluation on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cues as C
from ..functions import structure as S
from ..functions import texts as A
from ..operators import evaluation as E
from ..operators import instructions as I
from ..operators import mixture as M
from ..operators import noise as N
from ..operators import phrases as P
from ..operators import ranking as R
from ..operators import retrieval as K
from ..operators import switching as W
from ..operators import translation as B
from ..sources.files import scratch
from . import planted
from .bound import ORACLES, bind
from .bound_texts import _CLASSES as WORD_CLASSES
from .bound_texts import _U, PARTS, SENTENCES
from .planted import quoted


def uniform_sql(*parts: str) -> str:
    """uniform() in DuckDB."""
    return _U.format("concat_ws(':', " + ", ".join(parts) + ")")


# --- filters ------------------------------------------------------------------------------------------------------------

def _mentions():
    """Words as mentions, with as many candidates as the length modulo 3; every seventh letter count makes a blocked type."""
    return F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"), F.when(F.length(w) % 7 == 0, "T073").otherwise("T001").alias("tui"), (F.length(w) % 3).alias("cands")))


@bind(
    "filter_entity_dense",
    """WITH s AS (SELECT doc_id, lang, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN coalesce(list_sum(list_transform(list_filter(w, lambda x: length(x) % 7 <> 0), lambda x: length(x) % 3)), 0) ELSE len(list_filter(w, lambda x: length(x) % 7 <> 0 AND length(x) % 3 > 0)) END AS BIGINT) AS n FROM s)
    SELECT doc_id, n FROM c WHERE n > 2""",
)
def _(t):
    """Candidates of unblocked types in English, mentions with one elsewhere; more than two are dense."""
    good = F.filter(_mentions(), lambda m: (m["tui"] != "T073") & (m["cands"] > 0))
    cands = F.aggregate(good, F.lit(0), lambda a, m: a + m["cands"])
    n = F.when(F.col("lang") == "en", cands).otherwise(F.size(good)).cast("bigint")
    return t("documents").where("text IS NOT NULL").select("doc_id", n.alias("n")).where("n > 2")


#: Generations with a defect of each kind, and good ones.
GENERATED = """SELECT p_partkey, CASE p_partkey % 6
  WHEN 0 THEN '{"cloze": "a [BLANK]", "distractors": ["x", "y", "' || p_name || '"], "triple": {"subject": "s", "relation": "r", "object": "o"}}'
  WHEN 1 THEN '{"cloze": "none", "distractors": ["x", "y", "z"], "triple": {"subject": "s", "relation": "r", "object": "o"}}'
  WHEN 2 THEN '{"cloze": "a [BLANK]", "distractors": ["x", "y"], "triple": {"subject": "s", "relation": "r", "object": "o"}}'
  WHEN 3 THEN '{"cloze": "a [BLANK]", "distractors": ["x", "y", "z"], "triple": {"subject": "s", "relation": "r"}}'
  WHEN 4 THEN '{"cloze": "a [BLANK]", "distractors": ["x", "y", "z"], "triple": {"subject": "s", "relation": "r", "object": "o", "why": "w"}}'
  ELSE 'not JSON' END AS generation FROM part"""


@bind("filter_generation_contract", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'blank' WHEN 2 THEN 'distractors' WHEN 5 THEN 'unparsed' ELSE 'triple' END AS verdict FROM part")
def _(t):
    x = F.from_json("generation", "cloze string, distractors array<string>, triple map<string, string>")
    keys = F.array_sort(F.map_keys("x.triple"))
    verdict = (
        F.when(F.col("x").isNull() | F.col("x.cloze").isNull(), "unparsed")
        .when(~F.contains("x.cloze", F.lit(E.BLANK)), "blank")
        .when(F.coalesce(F.size("x.distractors"), F.lit(0)) != 3, "distractors")
        .when(F.coalesce(keys != F.array(*map(F.lit, ["object", "relation", "subject"])), F.lit(True)), "triple")
        .otherwise("ok")
    )
    return t.sql(GENERATED).select("p_partkey", x.alias("x")).select("p_partkey", verdict.alias("verdict"))


@bind("filter_exact_k_pairs", "SELECT conv_id FROM (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, CASE role WHEN 'user' THEN 'Q' WHEN 'assistant' THEN 'A' ELSE 'S' END) AS next FROM conversations) AS x GROUP BY conv_id HAVING count(*) FILTER (role = 'user' AND next = 'assistant') = 2 AND count(*) FILTER (role = 'system') = 0")
def _(t):
    """Conversations written as responses, with exactly two question-answer pairs."""
    head = F.when(F.col("role") == "user", "Question: ").when(F.col("role") == "assistant", "Answer: ").otherwise("System ")
    text = F.concat(head, F.regexp_replace(F.coalesce("text", F.lit("-")), r"\s+", " "))
    whole = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", text.alias("x")))), lambda y: y["x"]), "\n").alias("response"), F.count_if(F.col("role") == "system").alias("systems"))
    return whole.where((F.size(S.qa_pairs(F.col("response"), least={"en": 1})["qa"]) == 2) & (F.col("systems") == 0)).select("conv_id")


@bind("filter_min_sentences", f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM ({SENTENCES}) AS x WHERE len(s) > 3")
def _(t):
    return t("documents").select("doc_id", F.size(S.sentences(F.col("text"))).cast("bigint").alias("n")).where("n > 3")


# --- joins --------------------------------------------------------------------------------------------------------------
@bind("join_anti_eval_leak", "SELECT doc_id, source FROM documents WHERE doc_id IS NULL OR NOT EXISTS (SELECT 1 FROM benchmark WHERE item_id = doc_id)")
def _(t):
    return M.exclude(t("documents").select("doc_id", "source"), "doc_id", t("benchmark").select(F.col("item_id").alias("doc_id")))


@bind("join_parallel_corpora", "SELECT e.doc_id // 2 AS docid, e.doc_id AS en_id, o.doc_id AS other_id, o.lang FROM documents AS e, documents AS o WHERE e.doc_id // 2 = o.doc_id // 2 AND e.lang = 'en' AND o.lang <> 'en'")
def _(t):
    """Two documents of one docid, in English and in another language."""
    docs = t("documents").select(F.floor(F.col("doc_id") / 2).cast("bigint").alias("docid"), "doc_id", "lang")
    en = docs.where("lang = 'en'").select("docid", F.col("doc_id").alias("en_id"))
    return en.join(docs.where("lang <> 'en'").select("docid", F.col("doc_id").alias("other_id"), "lang"), "docid")


@bind(
    "join_positional_zip",
    """WITH a AS (SELECT conv_id, unnest(range(len(w))) AS pos, unnest(w) AS w FROM (SELECT conv_id, string_split(text, ' ') AS w FROM conversations WHERE turn = 0) AS x),
    b AS (SELECT conv_id, unnest(range(len(w))) AS pos, unnest(w) AS w FROM (SELECT conv_id, string_split(text, ' ') AS w FROM conversations WHERE turn = 1) AS x),
    c AS (SELECT conv_id FROM conversations WHERE turn = 0 AND text IS NOT NULL INTERSECT SELECT conv_id FROM conversations WHERE turn = 1 AND text IS NOT NULL)
    SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, CAST(coalesce(a.pos, b.pos) AS INT) AS pos, a.w AS first, b.w AS second FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos WHERE coalesce(a.conv_id, b.conv_id) IN (SELECT conv_id FROM c)""",
)
def _(t):
    """Two annotations of one id side by side, leaf by leaf; the shorter one is filled with nulls."""
    side = lambda k, name: t("conversations").where(F.col("turn") == k).where("text IS NOT NULL").select("conv_id", F.split("text", " ").alias(name))
    both = side(0, "a").join(side(1, "b"), "conv_id")
    return both.select("conv_id", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "x")).select("conv_id", "pos", F.col("x.a").alias("first"), F.col("x.b").alias("second"))


@bind(
    "join_lexicon_lemma_pos",
    "SELECT x.p_partkey, string_agg(DISTINCT y.word, '|' ORDER BY y.word) AS synonyms FROM part AS x JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS lemma, p_type AS pos, split_part(p_name, ' ', 2) AS word FROM part) AS y ON y.lemma = split_part(x.p_name, ' ', 1) AND y.pos = x.p_type GROUP BY x.p_partkey",
)
def _(t):
    """A part's first word and its type, as lemma and part of speech, with all second words known for them."""
    words = F.split("p_name", " ")
    tokens = t("part").select("p_partkey", words[0].alias("lemma"), F.col("p_type").alias("pos"))
    lexicon = t("part").groupBy(words[0].alias("lemma"), F.col("p_type").alias("pos")).agg(F.array_sort(F.collect_set(words[1])).alias("synonyms"))
    return tokens.join(lexicon, ["lemma", "pos"]).select("p_partkey", F.array_join("synonyms", "|").alias("synonyms"))


@bind("join_synset_expand", "SELECT w.s_suppkey AS wordid, CASE o.s_nationkey % 2 WHEN 0 THEN 'eng' ELSE 'jpn' END AS lang, string_agg(CASE o.s_nationkey % 2 WHEN 0 THEN replace(replace(o.s_name, '#', '_'), '_', ' ') ELSE replace(o.s_name, '#', '_') END, '|' ORDER BY CASE o.s_nationkey % 2 WHEN 0 THEN replace(replace(o.s_name, '#', '_'), '_', ' ') ELSE replace(o.s_name, '#', '_') END) AS synonyms FROM supplier AS w JOIN supplier AS o ON o.s_suppkey // 4 = w.s_suppkey // 4 AND o.s_suppkey <> w.s_suppkey GROUP BY ALL")
def _(t):
    """Suppliers as words, four of which share a synset."""
    words = t("supplier").select(F.col("s_suppkey").alias("wordid"), F.replace("s_name", F.lit("#"), F.lit("_")).alias("lemma"), F.when(F.col("s_nationkey") % 2 == 0, "eng").otherwise("jpn").alias("lang"))
    senses = words.select(F.floor(F.col("wordid") / 4).alias("synset"), "wordid")
    return W.synset_expand(words, senses).select("wordid", "lang", F.array_join("synonyms", "|").alias("synonyms"))


@bind(
    "join_substring_bimatch",
    """SELECT a.conv_id, a.arg, b.alias FROM (SELECT conv_id, left(text, 3) AS arg FROM conversations WHERE turn = 0) AS a
    JOIN (SELECT conv_id, unnest(list_distinct(string_split(text, ' '))) AS alias FROM conversations WHERE turn = 1) AS b ON a.conv_id = b.conv_id
    WHERE length(alias) % 10 >= 3 AND trim(arg) <> '' AND trim(alias) <> '' AND (strpos(lower(trim(arg)), lower(trim(alias))) > 0 OR strpos(lower(trim(alias)), lower(trim(arg))) > 0)""",
)
def _(t):
    """The first letters of a question, against the distinct words of its answer that score enough."""
    args = t("conversations").where("turn = 0").select(F.col("conv_id").alias("request_id"), F.substring("text", 1, 3).alias("arg"))
    words = t("conversations").where("turn = 1").select(F.col("conv_id").alias("request_id"), F.explode(F.array_distinct(F.split("text", " "))).alias("alias"))
    return E.bimatch(args, words.withColumn("score", (F.length("alias") % 10) * 2 / 10), 0.6).withColumnRenamed("request_id", "conv_id")


@bind(
    "join_interval_overlap",
    """WITH RECURSIVE t AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity, l_partkey, l_suppkey) AS INT) AS k, CAST(l_partkey % 60 AS INT) AS s, CAST(l_partkey % 60 + l_quantity AS INT) AS e FROM lineitem),
    walk AS (SELECT id, k, s, e, true AS free, [{'s': s, 'e': e}] AS kept FROM t WHERE k = 1
      UNION ALL SELECT t.id, t.k, t.s, t.e, len(list_filter(w.kept, lambda x: x.s <= t.e AND t.s <= x.e)) = 0,
        CASE WHEN len(list_filter(w.kept, lambda x: x.s <= t.e AND t.s <= x.e)) = 0 THEN list_append(w.kept, {'s': t.s, 'e': t.e}) ELSE w.kept END FROM walk AS w JOIN t ON t.id = w.id AND t.k = w.k + 1)
    SELECT id, k, s AS start, e AS "end" FROM walk WHERE free""",
)
def _(t):
    """An order's lines as spans, accepted greedily one after another."""
    rows = t.sql("SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity, l_partkey, l_suppkey) AS INT) AS k, CAST(l_partkey % 60 AS INT) AS start, CAST(l_partkey % 60 + l_quantity AS INT) AS end FROM lineitem")
    return W.greedy_columns(rows, "id", "k")


# --- aggregations -------------------------------------------------------------------------------------------------------
@bind(
    "agg_entity_f1_macro",
    """WITH s AS (SELECT g.conv_id, list_distinct(list_filter(string_split(lower(g.text), ' '), lambda x: length(x) % 5 = 0 AND x <> '')) AS gold, list_distinct(list_filter(string_split(lower(p.text), ' '), lambda x: length(x) % 5 = 0 AND x <> '')) AS said
      FROM conversations AS g JOIN conversations AS p ON p.conv_id = g.conv_id AND p.turn = 1 AND g.turn = 0 WHERE g.text IS NOT NULL AND p.text IS NOT NULL),
    f AS (SELECT CASE WHEN len(gold) = 0 THEN ['none'] ELSE gold END AS g, CASE WHEN len(said) = 0 THEN ['none'] ELSE said END AS p FROM s),
    h AS (SELECT len(list_intersect(g, p)) AS h, len(g) AS ng, len(p) AS np FROM f)
    SELECT round(avg(h / np), 6) AS p, round(avg(h / ng), 6) AS r, round(avg(CASE WHEN h = 0 THEN 0.0 ELSE 2.0 * h / (np + ng) END), 6) AS f1 FROM h""",
)
def _(t):
    """Words of five, ten, … letters as entities; a side without any says none."""
    own = lambda k, name: t("conversations").where(F.col("turn") == k).where("text IS NOT NULL").select("conv_id", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: (F.length(w) % 5 == 0) & (w != ""))).alias(name))
    filled = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("none")))
    rows = own(0, "g").join(own(1, "p"), "conv_id").select(filled("g").alias("g"), filled("p").alias("p"))
    hits = F.size(F.array_intersect("g", "p"))
    f1 = F.when(hits == 0, F.lit(0.0)).otherwise(2.0 * hits / (F.size("g") + F.size("p")))
    return rows.agg(F.round(F.avg(hits / F.size("p")), 6).alias("p"), F.round(F.avg(hits / F.size("g")), 6).alias("r"), F.round(F.avg(f1), 6).alias("f1"))


def _words_13a(text: str) -> str:
    out = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for x, y in B.ENTITIES.items():
        out = f"replace({out}, '{x}', '{y}')"
    out = f"(' ' || {out} || ' ')"
    for pattern, by in B.RULES:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"regexp_extract_all({out}, '\\S+')"


_GRAMS = " UNION ALL ".join(f"SELECT id, role, {n} AS n, {side} AS side, unnest(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))) AS g FROM w" for n in range(1, 5) for side, w in enumerate(("cw", "rw")))
_BLEU = "CASE WHEN h1 = 0 OR t4 = 0 THEN 0.0 ELSE 100 * CASE WHEN t1 < r THEN exp(1 - r / t1) ELSE 1 END * exp((" + " + ".join(f"ln(CASE WHEN h{n} = 0 THEN 1 / pow(2.0, {' + '.join(f'CAST(h{k} = 0 AS INT)' for k in range(1, n + 1))}) ELSE h{n} END / t{n})" for n in range(1, 5)) + ") / 4) END"


@bind(
    "agg_bleu_mean",
    f"""WITH c AS (SELECT row_number() OVER () AS id, role, text, regexp_replace(text, '([^\\p{{L}}])(the|and|is|to|der|que|et) ', '\\1', 'g') AS cand FROM conversations),
    w AS (SELECT id, role, {_words_13a("coalesce(cand, '')")} AS cw, {_words_13a("coalesce(text, '')")} AS rw FROM c),
    g AS (SELECT id, role, n, g, sum(1 - side) AS c, sum(side) AS r FROM ({_GRAMS}) AS x GROUP BY ALL),
    s AS (SELECT c.id, c.role, {", ".join(f"coalesce(sum(least(c, r)) FILTER (n = {n}), 0) AS h{n}, coalesce(sum(c) FILTER (n = {n}), 0) AS t{n}" for n in range(1, 5))}, coalesce(sum(r) FILTER (n = 1), 0) AS r FROM c LEFT JOIN g ON g.id = c.id GROUP BY c.id, c.role),
    a AS (SELECT role, round(avg({_BLEU}), 4) AS mean, count(*) AS n FROM s GROUP BY role),
    b AS (SELECT role, {", ".join(f"sum(h{n}) AS h{n}, sum(t{n}) AS t{n}" for n in range(1, 5))}, sum(r) AS r FROM s GROUP BY role)
    SELECT a.role, a.mean, a.n, round({_BLEU}, 4) AS corpus FROM a JOIN b ON b.role = a.role""",
)
def _(t):
    """Mean sentence BLEU and corpus BLEU, by role, of texts without some words against whole ones."""
    cand = F.regexp_replace("text", r"([^\p{L}])(the|and|is|to|der|que|et) ", "$1")
    counts = B.ngram_counts(t("conversations"), ["role"], B.words_13a(cand), B.words_13a(F.col("text")))
    rows = B.score(counts).where("role IS NOT NULL")
    both = B.summed(rows, "role", more=[F.round(F.avg("bleu"), 4).alias("mean"), F.count(F.lit(1)).alias("n")])  # one pass over the rows
    return B.score(both).select("role", "mean", "n", F.round("bleu", 4).alias("corpus"))


@bind(
    "agg_noise_rate",
    """WITH l AS (SELECT event_type AS dataset, CAST(event_id % 4 AS INT) AS iter, value, CASE WHEN event_type = 'click' OR (event_type = 'view' AND event_id % 2 = 0) THEN 1 ELSE 0 END AS noisy FROM events)
    SELECT dataset, iter, round(avg(noisy), 6) AS noise_rate, round(avg(value), 4) AS mean_loss, dataset <> 'view' AS constant FROM l GROUP BY dataset, iter""",
)
def _(t):
    """The share of noisy labels of each data set at each checkpoint, and whether all its checkpoints have the same."""
    noisy = (F.col("event_type") == "click") | ((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0))
    rows = t("events").select(F.col("event_type").alias("dataset"), (F.col("event_id") % 4).cast("int").alias("iter"), "value", F.array(F.when(noisy, "<noise>").otherwise(N.PLAIN)).alias("labels"))
    return N.noise_rates(rows, "dataset", "iter", "labels", "value")


@bind("agg_sentence_count", f"SELECT d.lang, CAST(sum(coalesce(greatest(len(s.s), 1), 1)) AS BIGINT) AS sentences FROM documents AS d LEFT JOIN (SELECT doc_id, min(s) AS s FROM ({SENTENCES}) AS x GROUP BY doc_id) AS s ON s.doc_id = d.doc_id GROUP BY d.lang")
def _(t):
    """A document without a text, or without a sentence, counts as one."""
    n = F.greatest(F.coalesce(F.when(F.col("text").isNotNull(), F.size(S.sentences(F.col("text")))), F.lit(1)), F.lit(1))
    return t("documents").groupBy("lang").agg(F.sum(n).cast("bigint").alias("sentences"))


# --- order and windows --------------------------------------------------------------------------------------------------
@bind("win_adjacent_sentences", f"WITH e AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS pos, unnest(s) AS sentence FROM ({SENTENCES}) AS x) SELECT doc_id, pos, sentence, lead(sentence) OVER (PARTITION BY doc_id ORDER BY pos) AS next_sentence FROM e")
def _(t):
    """Each sentence with the one after it, within the row."""
    pairs = S.let(S.sentences(F.col("text")), lambda s: F.transform(s, lambda x, i: F.struct(i.alias("pos"), x.alias("sentence"), F.get(s, i + 1).alias("next_sentence"))))
    return t("documents").where("text IS NOT NULL").select("doc_id", F.inline(pairs))


@bind("win_prev_throughput", "WITH b AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS seconds FROM events GROUP BY 1), r AS (SELECT hour, round(n / nullif(seconds, 0), 6) AS rate, row_number() OVER (ORDER BY hour) AS batch FROM b) SELECT batch, rate, lag(rate) OVER (ORDER BY batch) AS previous, coalesce(rate >= lag(rate) OVER (ORDER BY batch), true) AS faster FROM r")
def _(t):
    """Requests of an hour as a batch, its values as seconds: whether throughput grew against the batch before.

    A log has a row per batch, not per request; the window is over these.
    """
    log = t("events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("seconds"))
    rows = R.global_places(log.withColumn("rate", F.round(F.try_divide("n", "seconds"), 6)), F.col("hour"), name="batch").select("batch", "rate")
    before = rows.select((F.col("batch") + 1).alias("batch"), F.col("rate").alias("previous"))
    return rows.join(before, "batch", "left").select("batch", "rate", "previous", F.coalesce(F.col("rate") >= F.col("previous"), F.lit(True)).alias("faster"))


@bind(
    "sort_by_confidence",
    "WITH v AS (SELECT l_orderkey AS request_id, count(*) FILTER (l_returnflag = 'N') AS votes, round(coalesce(sum(exp(0 - l_discount)) FILTER (l_returnflag = 'N'), 0), 6) AS confidence FROM lineitem GROUP BY l_orderkey) SELECT row_number() OVER (ORDER BY confidence DESC, request_id) AS place, request_id, votes, confidence FROM v WHERE votes > 2",
)
def _(t):
    """All requests with more than two true votes, the surest first, over the whole table."""
    answers = t("lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_returnflag") == "N").alias("factuality"), (0 - F.col("l_discount")).alias("logprob"))
    rows = E.model_votes(answers).where("votes > 2").withColumn("confidence", F.round("confidence", 6))
    return R.global_places(rows, F.col("confidence").desc(), F.col("request_id")).select("place", "request_id", "votes", "confidence")


@bind(
    "sort_overlap_hi_lo",
    "SELECT doc_id, row_number() OVER (ORDER BY b, CASE b WHEN 0 THEN 0 ELSE -n_chars END, CASE b WHEN 0 THEN doc_id ELSE doc_id END) AS hi, row_number() OVER (ORDER BY b, CASE b WHEN 0 THEN 0 ELSE n_chars END, CASE b WHEN 0 THEN doc_id ELSE -doc_id END) AS lo FROM (SELECT doc_id, n_chars, CASE WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 0 ELSE 1 END AS b FROM documents) AS x",
)
def _(t):
    """Benchmark ids as base documents, the number of characters as overlap."""
    base = t("benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("base")).distinct()
    rows = t("documents").select("doc_id", "n_chars").join(base, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("base", F.lit(False)).alias("base"))
    hi, lo = R.overlap_order(rows, F.col("n_chars").cast("double"), F.col("base"), "doc_id")
    return hi.select("doc_id", F.col("place").alias("hi")).join(lo.select("doc_id", F.col("place").alias("lo")), "doc_id")


@bind("sample_demos_with_dedupe", None)
def _(t):
    """Three demonstrations for each item, drawn by place from all first turns and deduplicated by text."""
    gallery = t("conversations").where("turn = 0 AND text IS NOT NULL").groupBy(F.col("conv_id").alias("key")).agg(F.min("text").alias("text"))
    return E.draw_demos(t("benchmark").select(F.col("item_id").alias("id")), gallery, 3).select("id", F.posexplode("demos").alias("place", "demo"))


_DEMOS = f"""WITH g AS (SELECT text, row_number() OVER (ORDER BY conv_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT conv_id, min(text) AS text FROM conversations WHERE turn = 0 AND text IS NOT NULL GROUP BY conv_id) AS x),
    d AS (SELECT item_id, j, CAST(floor({uniform_sql("'demos'", "CAST(item_id AS VARCHAR)", "CAST(j AS VARCHAR)")} * (SELECT max(n) FROM g)) AS BIGINT) AS place FROM benchmark, range({{k2}}) AS r(j)),
    h AS (SELECT item_id, text, min(j) AS j FROM d JOIN g ON g.place = d.place GROUP BY item_id, text),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY j) AS i FROM h)"""


@bind("fewshot_prompt", _DEMOS.format(k2=8) + ", p AS (SELECT item_id, string_agg(text, chr(10) || chr(10) ORDER BY i DESC) AS demos FROM k WHERE i <= 4 GROUP BY item_id) SELECT b.item_id AS id, coalesce(p.demos || chr(10) || chr(10), '') || b.text AS prompt FROM benchmark AS b LEFT JOIN p ON p.item_id = b.item_id WHERE b.text IS NOT NULL")
def _(t):
    """Four demonstrations and the query's own text."""
    queries = t("benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("id"), "text")
    gallery = t("conversations").where("turn = 0 AND text IS NOT NULL").groupBy(F.col("conv_id").alias("key")).agg(F.min("text").alias("text"))
    return E.fewshot_prompts(queries, E.draw_demos(queries, gallery, 4))


ORACLES["sample_demos_with_dedupe"] = _DEMOS.format(k2=6) + " SELECT item_id AS id, CAST(count(*) OVER (PARTITION BY item_id) - i AS INT) AS place, text AS demo FROM k WHERE i <= 3"


# --- noise --------------------------------------------------------------------------------------------------------------
def _noise_oracle(seed: str, kind: str) -> str:
    hit = f"(pos > 0 AND {uniform_sql(f"'{seed}'", 'CAST(item_id AS VARCHAR)', 'CAST(pos AS VARCHAR)')} < 0.3)"
    word = {"mask": f"CASE WHEN {hit} THEN '<unk>' ELSE w END", "delete": "w", "replace": f"CASE WHEN {hit} THEN ['alpha', 'beta', 'gamma'][1 + CAST(floor({uniform_sql(f"'{seed}'", "'id'", 'CAST(item_id AS VARCHAR)', 'CAST(pos AS VARCHAR)')} * 3) AS INT)] ELSE w END"}[kind]
    where = f"WHERE NOT {hit}" if kind == "delete" else ""
    return f"WITH w AS (SELECT item_id, CAST(unnest(range(len(a))) AS INT) AS pos, unnest(a) AS w FROM (SELECT item_id, string_split(text, ' ') AS a FROM benchmark) AS x), n AS (SELECT item_id, sum(CASE WHEN {hit} THEN 1 ELSE 0 END) AS n FROM w GROUP BY item_id), o AS (SELECT item_id, string_agg({word}, ' ' ORDER BY pos) AS noisy FROM w {where} GROUP BY item_id) SELECT o.item_id, o.noisy, CAST(n.n AS BIGINT) AS n_noise FROM o JOIN n ON n.item_id = o.item_id"


@bind("noise_mask", _noise_oracle("mask", "mask"))
def _(t):
    x = N.mask(F.split("text", " "), F.col("item_id"), 0.3)
    return t("benchmark").select("item_id", x.alias("x")).select("item_id", F.array_join("x.tokens", " ").alias("noisy"), N.noise_rate(F.col("x.labels"))[0].cast("bigint").alias("n_noise"))


@bind("noise_delete", _noise_oracle("delete", "delete"))
def _(t):
    words = F.split("text", " ")
    x = N.delete(words, F.col("item_id"), 0.3)
    return t("benchmark").select("item_id", F.size(words).alias("n"), x.alias("x")).select("item_id", F.array_join("x.tokens", " ").alias("noisy"), (F.col("n") - F.size("x.tokens")).cast("bigint").alias("n_noise"))


@bind("noise_replace", _noise_oracle("replace", "replace"))
def _(t):
    x = N.replace(F.split("text", " "), F.col("item_id"), 0.3, F.array(*map(F.lit, ["alpha", "beta", "gamma"])))
    return t("benchmark").select("item_id", x.alias("x")).select("item_id", F.array_join("x.tokens", " ").alias("noisy"), N.noise_rate(F.col("x.labels"))[0].cast("bigint").alias("n_noise"))


@bind(
    "noise_rewrite",
    f"""WITH e AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS pos, unnest(s) AS x FROM ({SENTENCES}) AS q),
    h AS (SELECT *, {uniform_sql("'rewrite'", 'CAST(doc_id AS VARCHAR)', 'CAST(pos AS VARCHAR)')} < 0.4 AS hit, CAST(floor({uniform_sql("'rewrite'", "'which'", 'CAST(doc_id AS VARCHAR)', 'CAST(pos AS VARCHAR)')} * 2) AS INT) AS k FROM e)
    SELECT doc_id, string_agg(CASE WHEN NOT hit THEN x WHEN k = 0 THEN 'Again: ' || x ELSE 'So: ' || x END, '|' ORDER BY pos) AS noisy, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS n_noise FROM h GROUP BY doc_id""",
)
def _(t):
    """Two rewrites of each sentence."""
    rewrites = lambda s: F.transform(s, lambda y: F.array(F.concat(F.lit("Again: "), y), F.concat(F.lit("So: "), y)))

    def row(x: Column) -> Column:
        return F.struct(F.array_join(x["sentences"], "|").alias("noisy"), N.noise_rate(x["labels"])[0].cast("bigint").alias("n_noise"))

    def noisy(s: Column) -> Column:
        return F.when(F.size(s) > 0, S.let(N.rewrite(s, rewrites(s), F.col("doc_id"), 0.4), row))

    # the sentences are cut once for all that is made of them, and a generator keeps the filter on them above
    made = F.explode(F.array(S.let(S.sentences(F.col("text")), noisy)))
    return t("documents").select("doc_id", made.alias("x")).where("x IS NOT NULL").select("doc_id", "x.noisy", "x.n_noise")


#: Words with a synonym of their own language and of another one.
SYNONYMS = [
    ("the", "that", "le"), ("and", "plus", "et"), ("of", "from", "de"), ("in", "inside", "dans"), ("to", "toward", "vers"), ("with", "using", "avec"), ("that", "which", "que"), ("for", None, "pour"),
    ("as", "like", "comme"), ("from", "since", "depuis"), ("not", None, "pas"), ("der", "dieser", "the"), ("und", "sowie", "and"), ("von", "aus", "of"), ("mit", "samt", "with"), ("la", "cette", "the"),
    ("de", None, "of"), ("que", None, "that"), ("les", "ces", "the"), ("el", "ese", "the"), ("of the", "belonging to the", "du"), ("in the", "within the", "dans le"), ("to the", "toward the", "au"), ("de la", None, "of the"),
]


def synonym_table(t, k: int) -> DataFrame:
    return t.spark.createDataFrame([(x[0], x[k]) for x in SYNONYMS if x[k]], "phrase string, synonym string")


def _synonym_oracle(k: int, target: str) -> str:
    """Phrases by a walk from the left, longest first; then the text's words, with synonyms in the place of phrases."""
    listed = ", ".join(f"({quoted(x[0])}, {quoted(x[k])}, {len(x[0].split())})" for x in SYNONYMS if x[k])
    return f"""(WITH RECURSIVE w AS (SELECT item_id, CAST(unnest(range(len(a))) AS INT) AS i, unnest(a) AS w, a FROM (SELECT item_id, string_split(regexp_replace(text, '\\s', ' ', 'g'), ' ') AS a FROM benchmark WHERE text IS NOT NULL) AS x),
    v AS (SELECT item_id, i, w, a, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS place FROM w),
    d AS (SELECT * FROM (VALUES {listed}) AS d(p, synonym, n)),
    hit AS (SELECT item_id, i, n, place, synonym, regexp_extract(array_to_string(a[i + 1:i + n], ' '), '[.,;:!?)\\]]*$') AS tail FROM v, d WHERE i + n <= len(a) AND lower(regexp_replace(array_to_string(a[i + 1:i + n], ' '), '[.,;:!?)\\]]+$', '')) = p),
    best AS (SELECT *, row_number() OVER (PARTITION BY item_id, i ORDER BY n DESC) AS k FROM hit),
    walk AS (SELECT item_id, i, n FROM best WHERE k = 1 AND i = (SELECT min(i) FROM hit AS f WHERE f.item_id = best.item_id)
      UNION ALL SELECT walk.item_id, b.i, b.n FROM walk JOIN best AS b ON b.item_id = walk.item_id AND b.k = 1 AND b.i = (SELECT min(f.i) FROM hit AS f WHERE f.item_id = walk.item_id AND f.i >= walk.i + walk.n)),
    taken AS (SELECT b.* FROM walk JOIN best AS b ON b.item_id = walk.item_id AND b.i = walk.i AND b.k = 1 WHERE {uniform_sql(quoted(f"3:{target}"), "CAST(b.item_id AS VARCHAR)", "CAST(b.place AS VARCHAR)")} < 0.3)
    SELECT v.item_id, '{target}' AS target, string_agg(CASE WHEN t.i = v.i THEN t.synonym || t.tail WHEN t.i IS NULL THEN v.w END, ' ' ORDER BY v.i) AS noisy, count(t.i) FILTER (t.i = v.i) AS n_noise
    FROM v LEFT JOIN taken AS t ON t.item_id = v.item_id AND v.i >= t.i AND v.i < t.i + t.n GROUP BY v.item_id)"""


@bind("noise_synonym", f"SELECT item_id, target, noisy, CAST(n_noise AS INT) AS n_noise FROM (SELECT * FROM {_synonym_oracle(1, 'mono')} AS a UNION ALL SELECT * FROM {_synonym_oracle(2, 'multi')} AS b) AS x")
def _(t):
    """Words and phrases of a lexicon table, in a text's own language and in another one."""
    rows = t("benchmark").where("text IS NOT NULL").select("item_id", F.regexp_replace("text", r"\s", " ").alias("text"))
    parts = [N.synonyms(rows, "item_id", "text", synonym_table(t, k), 0.3, f"3:{target}").select("item_id", F.lit(target).alias("target"), "noisy", "n_noise") for k, target in ((1, "mono"), (2, "multi"))]
    return parts[0].unionByName(parts[1])


def _order_sql(n: str, steps: str, width: int, *seed: str) -> str:
    """permutation() in DuckDB, as a list of places from 0: runs are cut from the displaced places, then turned."""
    k = f"least({steps}, {n})"
    start = f"CAST(floor({uniform_sql(*seed, quoted('start'))} * ({n} - {k} + 1)) AS INT)"
    runs = f"CASE WHEN {k} % {width} = 1 AND {k} > {width} THEN {k} // {width} ELSE ({k} + {width} - 1) // {width} END"
    size = f"(CASE WHEN c = {runs} - 1 THEN {k} - c * {width} ELSE {width} END)"
    turned = f"flatten(list_transform(range({runs}), lambda c: list_transform(range({size}), lambda j: {start} + c * {width} + (j + 1 + CAST(floor({uniform_sql(*seed, quoted('turn'), 'CAST(c AS VARCHAR)')} * ({size} - 1)) AS INT)) % {size})))"
    return f"CASE WHEN {k} < 2 THEN range({n}) ELSE list_concat(list_concat(range({start}), {turned}), range({start} + {k}, {n})) END"


_STEPS = _order_sql("length(p_name)", "CAST(2 + p_partkey % 5 AS INT)", 3, "'steps'", "CAST(p_partkey AS VARCHAR)")


@bind("noise_permute_steps", f"SELECT p_partkey, CAST(least(length(p_name), 2 + p_partkey % 5) AS BIGINT) AS displaced, array_to_string(list_transform(o, lambda i: substring(p_name, CAST(i + 1 AS INT), 1)), '') AS noisy FROM (SELECT *, {_STEPS} AS o FROM part) AS x")
def _(t):
    """The letters of a name, of which exactly so many change places."""
    n, steps = F.length("p_name"), (2 + F.col("p_partkey") % 5).cast("int")
    rows = t("part").withColumn("o", N.permutation(n, steps, 3, "steps", F.col("p_partkey")))
    moved = F.size(F.filter(F.transform("o", lambda x, i: x - i), lambda d: d != 0)).cast("bigint")
    return rows.select("p_partkey", moved.alias("displaced"), F.array_join(F.transform("o", lambda i: F.substring("p_name", i + 1, F.lit(1))), "").alias("noisy"))


_WORDS_MOVED = _order_sql("(len(w) - 1)", "greatest(CAST(floor((len(w) - 1) * 0.3) AS INT), 2)", 8, "'reorder'", "CAST(item_id AS VARCHAR)")


@bind("noise_token_reorder", f"SELECT item_id, CAST(least(greatest(CAST(floor((len(w) - 1) * 0.3) AS INT), 2), len(w) - 1) AS INT) AS displaced, array_to_string(list_concat([w[1]], list_transform(o, lambda i: w[i + 2])), ' ') AS noisy FROM (SELECT *, {_WORDS_MOVED} AS o FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) AS x WHERE len(w) > 3) AS y")
def _(t):
    rows = t("benchmark").select("item_id", F.split("text", " ").alias("w")).where("size(w) > 3")
    return N.token_reorder(rows, "w", "item_id", 0.3).select("item_id", "displaced", F.array_join("noisy", " ").alias("noisy"))


_SENTENCES_MOVED = _order_sql("len(s)", "greatest(CAST(floor(len(s) * 0.5) AS INT), 2)", 3, "'sentences'", "CAST(doc_id AS VARCHAR)")


@bind("noise_sentence_reorder", f"SELECT doc_id, CAST(least(greatest(CAST(floor(len(s) * 0.5) AS INT), 2), len(s)) AS INT) AS displaced, array_to_string(list_transform(o, lambda i: s[i + 1]), '|') AS noisy FROM (SELECT *, {_SENTENCES_MOVED} AS o FROM ({SENTENCES}) AS x WHERE len(s) >= 2) AS y")
def _(t):
    rows = t("documents").select("doc_id", S.sentences(F.col("text")).alias("s")).where("size(s) >= 2")
    return N.sentence_reorder(rows, "s", "doc_id", 0.5).select("doc_id", "displaced", F.array_join("noisy", "|").alias("noisy"))


_SYNTAX = _order_sql("len(w)", "(CAST(floor(len(w) * 0.16) AS INT) + 1)", 4, "'syntax'", "CAST(item_id AS VARCHAR)")
_STAYS = f"list_filter(list_transform(range(len(w)), lambda i: CASE WHEN o[i + 1] <> i OR {uniform_sql(quoted('syntax'), quoted('gone'), 'CAST(item_id AS VARCHAR)', 'CAST(i AS VARCHAR)')} >= 0.16 THEN w[o[i + 1] + 1] END), lambda x: x IS NOT NULL)"
_JOINED = f"regexp_replace(regexp_replace(array_to_string({_STAYS}, ' '), ' ([.,!?;:%)\\]}}”’\\x27])', '\\1', 'g'), '([(\\[{{“‘\\x27]) ', '\\1', 'g')"


@bind("noise_word_syntax", f"SELECT item_id, {_JOINED} AS noisy FROM (SELECT *, {_SYNTAX} AS o FROM (SELECT item_id, regexp_extract_all(text, '{WORD_CLASSES}') AS w FROM benchmark WHERE text IS NOT NULL) AS x) AS y")
def _(t):
    """Tokens of which some change places and others go, joined again."""
    return N.word_syntax(t("benchmark").where("text IS NOT NULL"), "text", "item_id", 0.16).select("item_id", "noisy")


@bind("noise_dispatch")
def _(t):
    """One table of several noises by their names."""
    # a generator keeps the filter above it, so that a text is cut once
    cut = F.explode(F.array(S.sentences(F.col("text")))).alias("s")
    # and the one pass is dealt out, as a table may lie in few pieces
    texts = t("documents").select("doc_id", "text").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    rows = texts.select("doc_id", cut).where("size(s) > 0").withColumn("r", F.transform("s", lambda x: F.array(F.lower(x))))
    specs = ["none", "mask-8", "delete-8", "replace-16", "mono-30", "retoken-4@3", "resent-50", "syntax-16@8", "rewrite-40", "rewrite@syntax-40", "partial-12"]
    return N.dispatch(rows, "doc_id", "s", specs, vocabulary=F.array(F.lit("word"), F.lit("other")), rewrites="r", lexicon=synonym_table(t, 1))


# --- code switching -----------------------------------------------------------------------------------------------------

def _cands():
    """Each supplier's two words as mentions of three nations, with names of customers as their aliases."""
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(((F.col("s_nationkey") + i * 7) % 25).cast("string").alias("cui"), (((F.col("s_suppkey") + i) % 10) / 10).alias("score"), F.when(i == 1, F.col("s_name")).otherwise("other").alias("name")))


def _lexicon(t) -> DataFrame:
    return t("part").groupBy((F.col("p_partkey") % 25).cast("string").alias("cui")).agg(F.array_sort(F.collect_set("p_name")).alias("aliases"))


_ALIAS_ROWS = "c AS (SELECT s_suppkey, s_name, CAST((s_nationkey + i * 7) % 25 AS VARCHAR) AS cui, ((s_suppkey + i) % 10) / 10 AS score FROM supplier, range(3) AS r(i)), l AS (SELECT DISTINCT CAST(p_partkey % 25 AS VARCHAR) AS cui, p_name AS alias FROM part)"


@bind(
    "switch_entity_aliases",
    f"""WITH {_ALIAS_ROWS}, best AS (SELECT s_suppkey, s_name, first(cui ORDER BY score DESC, cui) AS cui FROM c GROUP BY s_suppkey, s_name),
    a AS (SELECT 'max_score/random' AS how, s_suppkey, b.cui, alias, {uniform_sql("'alias'", "'name'", 'CAST(s_suppkey AS VARCHAR)', 'alias')} AS k FROM best AS b JOIN l ON l.cui = b.cui
      UNION ALL SELECT 'threshold/min_diff' AS how, s_suppkey, c.cui, alias, 1.0 AS k FROM c JOIN l ON l.cui = c.cui WHERE score >= 0.8
      UNION ALL SELECT 'all/max_diff' AS how, s_suppkey, c.cui, alias, 1.0 AS k FROM c JOIN l ON l.cui = c.cui)
    SELECT how, s_suppkey AS mention, first(cui ORDER BY k, cui, alias) AS cui, first(alias ORDER BY k, cui, alias) AS code FROM a GROUP BY how, s_suppkey""",
)
def _(t):
    """Three of the strategies; no two of these names share a word, so all differ as much."""
    mentions = t("supplier").select(F.col("s_suppkey").alias("mention"), F.col("s_name").alias("text"), _cands().alias("cands"))
    out = None
    for cand, alias in (("max_score", "random"), ("threshold", "min_diff"), ("all", "max_diff")):
        part = W.entity_aliases(mentions, _lexicon(t), cand, alias).select(F.lit(f"{cand}/{alias}").alias("how"), "mention", "cui", "code")
        out = part if out is None else out.unionByName(part)
    return out


#: Words of six letters and more are entities, and so is every pair of words that begins at a word of five.
_SPANS = """e AS (SELECT item_id, unnest(list_concat(
      list_transform(list_filter(p, lambda x: length(x.w) >= 6), lambda x: {'s': x.p, 'e': x.p + length(x.w), 'c': '<' || x.w || '>'}),
      list_transform(list_filter(p, lambda x: length(x.w) = 5 AND x.nxt IS NOT NULL), lambda x: {'s': x.p, 'e': x.p + 6 + length(x.nxt), 'c': '<<' || x.nxt || '>>'}))) AS x FROM q)"""
_WORDS = """w AS (SELECT item_id, CAST(unnest(range(len(a))) AS INT) AS i, unnest(a) AS w FROM (SELECT item_id, string_split(text, ' ') AS a FROM benchmark WHERE text IS NOT NULL) AS x),
    v AS (SELECT item_id, i, w, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS place, lead(w) OVER (PARTITION BY item_id ORDER BY i) AS nxt FROM w),
    q AS (SELECT item_id, list({'w': w, 'p': place, 'nxt': nxt} ORDER BY i) AS p FROM v GROUP BY item_id)"""


def _entities(t) -> DataFrame:
    """item_id, start, end, code of the spans above, by the words' places."""
    words = F.split("text", " ")
    ends = F.aggregate(words, F.array(F.lit(0)), lambda a, w: F.array_append(a, F.element_at(a, -1) + F.length(w) + 1))
    rows = t("benchmark").where("text IS NOT NULL").select("item_id", words.alias("w"), ends.alias("ends")).select("item_id", "w", "ends", F.posexplode("w").alias("i", "word"))
    start, after = F.get("ends", F.col("i")), F.get("w", F.col("i") + 1)
    one = F.struct(start.alias("start"), (start + F.length("word")).alias("end"), F.concat(F.lit("<"), "word", F.lit(">")).alias("code"))
    two = F.struct(start.alias("start"), (start + 6 + F.length(after)).alias("end"), F.concat(F.lit("<<"), after, F.lit(">>")).alias("code"))
    x = F.when(F.length("word") >= 6, one).when((F.length("word") == 5) & after.isNotNull(), two)
    return rows.select("item_id", x.alias("x")).where("x IS NOT NULL").select("item_id", "x.start", "x.end", "x.code")


@bind(
    "switch_entities",
    f"""WITH RECURSIVE {_WORDS}, {_SPANS},
    r AS (SELECT item_id, x.s AS s, x.e AS e, x.c AS c, row_number() OVER (PARTITION BY item_id ORDER BY x.s, x.e, x.c) AS k FROM e),
    walk AS (SELECT item_id, CAST(0 AS BIGINT) AS k, -9 AS last, false AS free, 0 AS s, 0 AS e, '' AS c FROM q
      UNION ALL SELECT r.item_id, r.k, CASE WHEN r.s > walk.last THEN r.e ELSE walk.last END, r.s > walk.last, r.s, r.e, r.c FROM walk JOIN r ON r.item_id = walk.item_id AND r.k = walk.k + 1),
    kept AS (SELECT item_id, copy, s, e, c FROM walk, range(2) AS g(copy) WHERE free AND {uniform_sql("'switch'", 'CAST(item_id AS VARCHAR)', 'CAST(copy AS VARCHAR)', 'CAST(s AS VARCHAR)')} < 0.5),
    parts AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY item_id, copy ORDER BY s), 0) AS before FROM kept),
    joined AS (SELECT p.item_id, p.copy, string_agg(substring(b.text, p.before + 1, p.s - p.before) || p.c, '' ORDER BY p.s) AS head, max(p.e) AS last, count(*) AS n FROM parts AS p JOIN benchmark AS b ON b.item_id = p.item_id GROUP BY p.item_id, p.copy)
    SELECT b.item_id, CAST(g.copy AS INT) AS copy, CAST(coalesce(j.n, 0) AS BIGINT) AS replaced, coalesce(j.head || substring(b.text, j.last + 1), b.text) AS noisy FROM benchmark AS b CROSS JOIN range(2) AS g(copy) LEFT JOIN joined AS j ON j.item_id = b.item_id AND j.copy = g.copy WHERE b.text IS NOT NULL""",
)
def _(t):
    out = W.switch_entities(t("benchmark").where("text IS NOT NULL"), _entities(t), 0.5, "item_id", 2)
    return out.select("item_id", "copy", F.size("recipe").cast("bigint").alias("replaced"), "noisy")


@bind("txt_span_replace", "SELECT item_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) >= 6 THEN '<' || w || '>' ELSE w END), ' ') AS text FROM benchmark WHERE text IS NOT NULL")
def _(t):
    """Every word of six letters and more in brackets, by a recipe of spans."""
    spans = _entities(t).where(~F.startswith("code", F.lit("<<"))).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "code"))).alias("r"))
    rows = t("benchmark").where("text IS NOT NULL").join(spans, "item_id", "left")
    none = F.array().cast(dict(spans.dtypes)["r"])
    return rows.select("item_id", S.spans_replaced(F.col("text"), F.coalesce("r", none)).alias("text"))


_TAGGED = "SELECT item_id, pos, w, lower(w) AS lemma, CASE length(w) % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'V' ELSE 'X' END AS tag FROM w"


@bind(
    "switch_lemmas",
    f"""WITH w AS (SELECT item_id, CAST(unnest(range(len(a))) AS INT) AS pos, unnest(a) AS w FROM (SELECT item_id, string_split(text, ' ') AS a FROM benchmark) AS x), k AS ({_TAGGED}),
    d AS (SELECT * FROM (VALUES ('the', 'N', 'eng', 'that'), ('the', 'N', 'fra', 'le'), ('the', 'N', 'fra', 'la'), ('the', 'N', 'fra', 'The'), ('of', 'X', 'fra', 'de'), ('and', 'N', 'deu', 'und'), ('that', 'V', 'fra', 'que')) AS v(lemma, tag, lang, synonym) WHERE lower(synonym) <> lemma),
    h AS (SELECT k.item_id, k.pos, k.w, d.lang, d.synonym, {uniform_sql("'lemma'", "'lang'", 'CAST(item_id AS VARCHAR)', 'CAST(pos AS VARCHAR)', 'd.lang')} AS a, {uniform_sql("'lemma'", "'word'", 'CAST(item_id AS VARCHAR)', 'CAST(pos AS VARCHAR)', 'd.synonym')} AS b FROM k JOIN d ON d.lemma = k.lemma AND d.tag = k.tag WHERE k.tag IN ('N', 'V', 'A', 'R'))
    SELECT item_id AS id, pos, w AS raw, first(synonym ORDER BY a, lang, b, synonym) AS code, first(lang ORDER BY a, lang, b, synonym) AS lang FROM h GROUP BY item_id, pos, w""",
)
def _(t):
    words = t("benchmark").select(F.col("item_id").alias("id"), F.posexplode(F.split("text", " ")).alias("pos", "raw"))
    tag = F.when(F.length("raw") % 3 == 0, "N").when(F.length("raw") % 3 == 1, "V").otherwise("X")
    dictionary = t.spark.createDataFrame([("the", "N", "eng", "that"), ("the", "N", "fra", "le"), ("the", "N", "fra", "la"), ("the", "N", "fra", "The"), ("of", "X", "fra", "de"), ("and", "N", "deu", "und"), ("that", "V", "fra", "que")], "lemma string, tag string, lang string, synonym string")
    return W.lemma_codes(words.withColumn("lemma", F.lower("raw")).withColumn("tag", tag), dictionary)


@bind(
    "switch_legacy_code_index",
    """WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS a FROM benchmark WHERE text IS NOT NULL), e AS (SELECT item_id, CAST(unnest(range(len(a))) AS INT) AS pos, a FROM w),
    d AS (SELECT * FROM (VALUES (['of', 'the'], 'C2'), (['of'], 'C1'), (['the', 'the'], 'C3'), (['and', 'of', 'the'], 'C4'), (['that'], 'C5')) AS v(p, code)),
    h AS (SELECT item_id, pos, code, len(p) AS n FROM e JOIN d ON a[pos + 1:pos + len(p)] = p WHERE length(a[pos + 1]) <> 4)
    SELECT item_id AS id, pos, first(code ORDER BY n DESC, code) AS code FROM h GROUP BY item_id, pos""",
)
def _(t):
    """Words of four letters stand for verbs."""
    words = F.split(F.lower("text"), " ")
    tokens = t("benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("id"), words.alias("words"), F.transform(words, lambda w: F.when(F.length(w) == 4, "V").otherwise("N")).alias("tags"))
    entries = t.spark.createDataFrame([(["of", "the"], "C2"), (["of"], "C1"), (["the", "the"], "C3"), (["and", "of", "the"], "C4"), (["that"], "C5")], "words array<string>, code string")
    return P.code_index(tokens, entries)


@bind("lexicon_expand_synonyms", "WITH l AS (SELECT w.s_suppkey AS word, p.place, p.synonym FROM supplier AS w, (SELECT g // 2 AS place, g, CASE WHEN g % 3 = 0 THEN '+' ELSE '' END AS plus FROM range(12) AS r(g)) AS x, LATERAL (SELECT x.place, 'n' || CAST((w.s_suppkey + x.g) % 9 AS VARCHAR) AS synonym) AS p), f AS (SELECT word, synonym, min(place) AS place FROM l WHERE synonym <> 'n' || CAST(word % 9 AS VARCHAR) GROUP BY word, synonym), b AS (SELECT *, (SELECT count(*) FROM f AS g WHERE g.word = f.word AND g.place < f.place) AS before FROM f) SELECT word, string_agg(synonym, '|' ORDER BY synonym) AS synonyms FROM b WHERE before <= 3 GROUP BY word")
def _(t):
    """Six synsets of two names for each supplier; its own name and pluses are taken out."""
    rows = t("supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("g"))
    name = F.concat(F.lit("n"), ((F.col("k") + F.col("g")) % 9).cast("string"), F.when(F.col("g") % 3 == 0, F.lit("+")).otherwise(F.lit("")))
    own = rows.select("k", F.floor(F.col("g") / 2).alias("place"), name.alias("synonym"), F.concat(F.lit("n"), (F.col("k") % 9).cast("string")).alias("self"))
    return W.synonyms_until(own.select(F.concat_ws("#", "self", "k").alias("word"), "place", F.when(F.regexp_replace("synonym", r"\+", "") == F.col("self"), F.concat_ws("#", "self", "k")).otherwise(F.col("synonym")).alias("synonym"))).select(F.split_part("word", F.lit("#"), F.lit(2)).cast("bigint").alias("word"), F.array_join("synonyms", "|").alias("synonyms"))


@bind("lexicon_fetch", "SELECT n_nationkey AS cui, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'cached' ELSE 'fetched' END AS origin FROM nation")
def _(t):
    """Entries that a cache lacks are asked of a service (here a function) and kept; the rest come from the cache."""
    from ..operators import models

    cached = t("nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("cui"), F.col("n_name").alias("name"))
    asked = t("nation").select(F.col("n_nationkey").alias("cui"), F.concat(F.lit("name of "), "n_name").alias("prompt"))
    got = models.call_model(asked, "cui", "prompt", lambda prompts: [p.removeprefix("name of ") for p in prompts], done=cached)
    return cached.withColumn("origin", F.lit("cached")).unionByName(got.where("error IS NULL").select("cui", F.col("response").alias("name"), F.lit("fetched").alias("origin")))


# --- annotation ---------------------------------------------------------------------------------------------------------
@bind(
    "ner_annotate",
    """WITH RECURSIVE w AS (SELECT item_id, CAST(unnest(range(len(a))) AS INT) AS i, unnest(a) AS w, a FROM (SELECT item_id, string_split(regexp_replace(text, '\\s', ' ', 'g'), ' ') AS a FROM benchmark) AS x),
    v AS (SELECT item_id, i, w, a, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS place FROM w),
    d AS (SELECT * FROM (VALUES ('the', 'ART', 1), ('and', 'CONJ', 1), ('la', 'ART', 1), ('von', 'PREP', 1), ('of', 'PREP', 1), ('of the', 'PHRASE', 2), ('the the', 'TWICE', 2), ('and of the', 'LONG', 3)) AS d(p, label, n)),
    h AS (SELECT item_id, i, n, place, label, regexp_replace(array_to_string(a[i + 1:i + n], ' '), '[.,;:!?)\\]]+$', '') AS t, p FROM v, d WHERE i + n <= len(a)),
    hit AS (SELECT item_id, i, n, place, label, t FROM h WHERE lower(t) = p),
    best AS (SELECT *, row_number() OVER (PARTITION BY item_id, i ORDER BY n DESC) AS k FROM hit),
    walk AS (SELECT item_id, i, n FROM best WHERE k = 1 AND i = (SELECT min(i) FROM hit AS f WHERE f.item_id = best.item_id)
      UNION ALL SELECT walk.item_id, b.i, b.n FROM walk JOIN best AS b ON b.item_id = walk.item_id AND b.k = 1 AND b.i = (SELECT min(f.i) FROM hit AS f WHERE f.item_id = walk.item_id AND f.i >= walk.i + walk.n))
    SELECT b.item_id AS id, b.place AS start, CAST(b.place + length(b.t) AS INT) AS "end", b.t AS text, b.label FROM walk JOIN best AS b ON b.item_id = walk.item_id AND b.i = walk.i AND b.k = 1""",
)
def _(t):
    """Words and phrases of a small dictionary, with their places."""
    lexicon = t.spark.createDataFrame([("the", "ART"), ("and", "CONJ"), ("La", "ART"), ("von", "PREP"), ("of", "PREP"), ("no such phrase", "X"), ("of the", "PHRASE"), ("the the", "TWICE"), ("and of the", "LONG")], "surface string, label string")
    texts = t("benchmark").select(F.col("item_id").alias("id"), "text")
    return P.annotate(texts, lexicon)


# --- mixtures -----------------------------------------------------------------------------------------------------------
def _budget_oracle(rows: str, budget: int, tag: str) -> str:
    """Rows of (doc_id, tokens) in order, read again and again until the budget is met."""
    return f"SELECT doc_id, CAST(cycle AS INT) AS cycle, {tag} FROM (SELECT *, sum(tokens) OVER (PARTITION BY src ORDER BY cycle, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({rows}) AS r CROSS JOIN range(60) AS c(cycle)) AS x WHERE coalesce(before, 0) < {budget}"


@bind("win_budget_prefix", _budget_oracle("SELECT doc_id, n_chars AS tokens, 0 AS src FROM documents WHERE lang = 'de' AND n_chars IS NOT NULL", 1_000_000, "tokens"))
def _(t):
    """German documents in order until a million tokens are reached, from the start again if they do not suffice."""
    rows = t("documents").where("lang = 'de' AND n_chars IS NOT NULL").select("doc_id", F.col("n_chars").alias("tokens"))
    return M.budget_prefix(rows, "tokens", 1_000_000, "doc_id").select("doc_id", "cycle", "tokens")


#: Knowledge sources with their budgets: German, French and Spanish documents.
_BUDGETS = {"de": 300_000, "fr": 200_000, "es": 50_000}


@bind("mix_knowledge", " UNION ALL ".join(_budget_oracle(f"SELECT doc_id, n_chars AS tokens, 0 AS src FROM documents WHERE lang = '{lang}' AND n_chars IS NOT NULL AND NOT EXISTS (SELECT 1 FROM benchmark WHERE item_id = doc_id)", n, f"'{lang}' AS data_type") for lang, n in _BUDGETS.items()))
def _(t):
    """Budgeted sources without evaluation ids, each read cyclically."""
    held = t("benchmark").select(F.col("item_id").alias("doc_id"))
    docs = M.exclude(t("documents").where("n_chars IS NOT NULL"), "doc_id", held).select("doc_id", "lang", F.col("n_chars").alias("tokens"))
    return M.mix({lang: (docs.where(F.col("lang") == lang).drop("lang"), n) for lang, n in _BUDGETS.items()}, "tokens", "doc_id").select("doc_id", "cycle", "data_type")


@bind("mix_crosslingual", " UNION ALL ".join(_budget_oracle(rows, 150_000, f"'{tag}' AS data_type") for tag, rows in (("medical-fr", "SELECT doc_id, n_chars AS tokens, 0 AS src FROM documents WHERE lang = 'fr' AND n_chars IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM benchmark WHERE item_id = doc_id)"), ("science-es", "SELECT doc_id, n_chars AS tokens, 0 AS src FROM documents WHERE lang = 'es' AND n_chars IS NOT NULL"))))
def _(t):
    """The medical source is restricted to trained ids without evaluation ids; the other is not."""
    docs = t("documents").where("n_chars IS NOT NULL").select("doc_id", "lang", F.col("n_chars").alias("tokens"))
    trained, held = t("labels").where("doc_id IS NOT NULL").select("doc_id"), t("benchmark").select(F.col("item_id").alias("doc_id"))
    medical = M.exclude(M.restrict(docs.where("lang = 'fr'"), "doc_id", trained), "doc_id", held)
    return M.mix({"medical-fr": (medical.drop("lang"), 150_000), "science-es": (docs.where("lang = 'es'").drop("lang"), 150_000)}, "tokens", "doc_id").select("doc_id", "cycle", "data_type")


@bind("mix_tuning", "SELECT doc_id, 'tuning' AS type, place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS x WHERE place <= 200")
def _(t):
    """The first 200 instructions (the operator's own parameter) of labelled ids, tagged."""
    return M.tuning_head(t("documents").select("doc_id"), 200, "doc_id", t("labels").select("doc_id"))


@bind("verify_trained_docids", "SELECT o_custkey AS doc_id, min(pos) AS pos FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders) AS x WHERE pos <= 5000 GROUP BY o_custkey")
def _(t):
    """Distinct ids among the first 5,000 instructions (the operator's own parameter), in first-seen order."""
    return M.first_seen(t("orders").select("o_orderkey", F.col("o_custkey").alias("doc_id")), 5000, "o_orderkey", "doc_id")


@bind("verify_duplicate_prefix", "SELECT d.doc_id, CAST(count(DISTINCT e.doc_id) AS BIGINT) AS sharing FROM documents AS d JOIN documents AS e ON left(e.text, 40) = left(d.text, 40) AND e.doc_id <> d.doc_id WHERE length(d.text) >= 40 GROUP BY d.doc_id")
def _(t):
    """Documents whose first 40 characters also begin another document, and how many do."""
    return M.shared_prefixes(t("documents").select("doc_id", "text"), 40, "doc_id")


# --- facts and multiple choice --------------------------------------------------------------------------------------------
#: A line is a model's triple: its ratio is tax over eight hundredths, and the order's parity its language.
_TRIPLES = "SELECT l_orderkey AS request_id, CASE WHEN l_orderkey % 2 = 0 THEN 'en' ELSE 'ja' END AS lang, CAST(l_linenumber AS VARCHAR(9)) || ':' || CAST(l_partkey AS VARCHAR(20)) || ':' || CAST(l_suppkey AS VARCHAR(20)) || ':' || CAST(l_extendedprice AS VARCHAR(30)) AS model, CASE WHEN l_returnflag = 'N' THEN 'short' ELSE 'a longer subject' END AS s, CASE WHEN l_linestatus = 'O' THEN 'o' ELSE 'object' END AS o, l_tax / 0.08 AS ratio, l_partkey AS triple FROM lineitem"
_BEST = f"SELECT request_id, first(triple ORDER BY CASE WHEN lang = 'en' AND ratio < 0.5 THEN 1 ELSE 0 END, CASE WHEN lang <> 'en' THEN 0 WHEN ratio > 0 THEN (length(s) + length(o)) / ratio ELSE CAST('inf' AS DOUBLE) END, model) AS triple FROM ({_TRIPLES}) AS x WHERE lang = 'en' OR split_part(model, ':', 1) = '1' GROUP BY request_id"


def _triples(t) -> DataFrame:
    rows = t.sql(_TRIPLES.replace("CAST(l_extendedprice AS VARCHAR(30))", "format_string('%s', l_extendedprice)"))
    return rows.withColumn("own", F.split_part("model", F.lit(":"), F.lit(1)))


@bind("fact_best_triple", _BEST)
def _(t):
    rows = _triples(t)
    # the first line's model is the preferred one: its rows get the preferred name, with the rest as tie-break
    named = rows.withColumn("triple", F.struct("model", "triple")).where("lang = 'en' OR own = '1'")
    best = E.best_triple(named.withColumn("model", F.when(F.col("lang") == "en", F.col("model")).otherwise(F.lit("1"))).withColumn("ratio", F.col("ratio")), "1")
    ties = named.where("lang <> 'en'").groupBy("request_id").agg(F.min("triple").alias("first"))
    return best.join(ties, "request_id", "left").select("request_id", F.coalesce("first.triple", "triple.triple").alias("triple"))


@bind(
    "fact_vote_triples",
    f"""WITH v AS (SELECT l_orderkey AS request_id, count(*) FILTER (l_returnflag = 'N') AS votes, round(coalesce(sum(exp(0 - l_discount)) FILTER (l_returnflag = 'N'), 0), 6) AS confidence FROM lineitem GROUP BY l_orderkey), b AS ({_BEST.replace("split_part(model, ':', 1) = '1'", 'false')})
    SELECT row_number() OVER (ORDER BY confidence DESC, v.request_id) AS place, v.request_id, votes, confidence, coalesce(CAST(triple AS VARCHAR), 'none') AS triple FROM v LEFT JOIN b ON b.request_id = v.request_id WHERE votes > 2""",
)
def _(t):
    """Votes, the best triples and the order by confidence; other languages have no preferred model here, so no triple."""
    answers = t("lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_returnflag") == "N").alias("factuality"), (0 - F.col("l_discount")).alias("logprob"))
    return E.vote_triples(answers, _triples(t), "none").select("place", "request_id", "votes", "confidence", F.coalesce(F.col("triple").cast("string"), F.lit("none")).alias("triple"))


#: Items: a part's name with a blank, in two wordings; some lack a blank or have an empty distractor.
_ITEMS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'no gap' ELSE 'The part is [BLANK] and ' || p_type END AS cloze, 'Which ' || p_type || ' is it? [BLANK]' AS paraphrase, p_name AS answer, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'b' || p_brand END AS d1, 'c' || p_brand AS d2, 'd' || p_brand AS d3 FROM part"


@bind(
    "mcq_assemble",
    f"""WITH i AS ({_ITEMS}), g AS (SELECT * FROM i WHERE id % 5 <> 0 AND id % 7 <> 0 AND trim(answer) <> ''),
    o AS (SELECT id, unnest([0, 1, 2, 3]) AS k, unnest([answer, d1, d2, d3]) AS o FROM g),
    p AS (SELECT id, string_agg(o, '|' ORDER BY {uniform_sql("'options'", 'CAST(id AS VARCHAR)', 'CAST(k AS VARCHAR)')}, k) AS options, list(k ORDER BY {uniform_sql("'options'", 'CAST(id AS VARCHAR)', 'CAST(k AS VARCHAR)')}, k) AS ks FROM o GROUP BY id)
    SELECT g.id, 'memorization' AS dataset, cloze AS question, options, CAST(list_position(ks, 0) - 1 AS INT) AS answer_idx FROM g JOIN p ON p.id = g.id
    UNION ALL SELECT g.id, 'generalization' AS dataset, paraphrase AS question, options, CAST(list_position(ks, 0) - 1 AS INT) AS answer_idx FROM g JOIN p ON p.id = g.id""",
)
def _(t):
    items = t.sql(_ITEMS).withColumn("distractors", F.array("d1", "d2", "d3"))
    return E.assemble_mcq(items).withColumn("options", F.array_join("options", "|"))


# --- retrieval ----------------------------------------------------------------------------------------------------------
def _knn_oracle(k: int) -> str:
    dist = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) ** 2 + CAST(p[2] AS DOUBLE) ** 2 - 2 * CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    return f"SELECT q, g, k FROM (SELECT a.vec_id AS q, b.vec_id AS g, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({dist}, 6), b.vec_id) AS k FROM embeddings AS a JOIN embeddings AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) AS x WHERE k <= {k}"


def _vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@bind("knn_topk", _knn_oracle(5))
def _(t):
    """Every id divisible by 100 as a query, against all rows."""
    v = _vectors(t)
    return K.knn(v.where("id % 100 = 0"), v, 5).select("q", "g", F.col("rank").cast("bigint").alias("k"))


@bind("join_pair_gallery_knn", _knn_oracle(3))
def _(t):
    v = _vectors(t)
    return K.knn(v.where("id % 100 = 0"), v, 3).select("q", "g", F.col("rank").cast("bigint").alias("k"))


@bind("knn_vote", f"SELECT q, first(label ORDER BY n DESC, label) AS label, max(n) AS votes FROM (SELECT x.q, e.label, count(*) AS n FROM ({_knn_oracle(5)}) AS x JOIN embeddings AS e ON e.vec_id = x.g GROUP BY x.q, e.label) AS y GROUP BY q")
def _(t):
    """The label that most of a query's five neighbours have."""
    v = _vectors(t)
    return K.vote(K.knn(v.where("id % 100 = 0"), v, 5), t("embeddings").select(F.col("vec_id").alias("id"), "label"))


#: A vector of 64 as eight token vectors of eight, the first `1 + id % 8` of them unmasked.
_POOL = """WITH p AS (SELECT vec_id, i, avg(v) AS m FROM (SELECT vec_id, unnest(range(64)) % 8 AS i, unnest(range(64)) // 8 AS tok, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) AS x WHERE tok <= vec_id % 8 GROUP BY vec_id, i),
    n AS (SELECT vec_id, sqrt(sum(m * m)) AS norm FROM p GROUP BY vec_id), u AS (SELECT p.vec_id, i, m / norm AS m FROM p JOIN n ON n.vec_id = p.vec_id WHERE norm > 0)"""


@bind("knn_embed_pool", _POOL + " SELECT a.vec_id, round(100 * sum(a.m * b.m), 4) AS cosine FROM u AS a JOIN u AS b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY a.vec_id")
def _(t):
    """Pooled and normalised token vectors, and each one's cosine with the next row's."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i <= F.col("vec_id") % 8).cast("int"))
    rows = t("embeddings").select("vec_id", K.pooled(tokens, mask).alias("v"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("next"))
    return rows.join(other, "vec_id").select("vec_id", F.round(K.cosine_percent(F.col("v"), F.col("next")), 4).alias("cosine"))


@bind("knn_embed_batch", "SELECT item_id, CAST(length(text) AS BIGINT) AS n, CAST(length(replace(text, 'e', '')) AS BIGINT) AS others FROM benchmark WHERE text IS NOT NULL")
def _(t):
    """Texts through an encoder in batches; this one counts letters."""
    from ..operators import models

    rows = models.embed(t("benchmark").where("text IS NOT NULL"), "item_id", "text", lambda texts: [[float(len(x)), float(len(x.replace("e", "")))] for x in texts], batch=16)
    return rows.select("item_id", F.get("vector", F.lit(0)).cast("bigint").alias("n"), F.get("vector", F.lit(1)).cast("bigint").alias("others"))


# --- scoring ------------------------------------------------------------------------------------------------------------

def _ids():
    return F.transform(F.split("text", " "), lambda w: F.length(w))


@bind("score_request_build", "WITH w AS (SELECT item_id, list_transform(string_split(text, ' '), lambda x: length(x)) AS c FROM benchmark WHERE text IS NOT NULL), k AS (SELECT item_id, c[greatest(len(c) - 16, 1):] AS c FROM w) SELECT item_id, array_to_string(list_concat(c, [7, 8, 9]), ',') AS input_ids, repeat('-100,', len(c)) || '7,8,9' AS labels FROM k")
def _(t):
    """A context of words (by their lengths) and an option of three tokens, in 20 at most."""
    x = E.score_request(_ids(), F.array(*map(F.lit, [7, 8, 9])), 20)
    return t("benchmark").where("text IS NOT NULL").select("item_id", F.array_join(F.transform(x["input_ids"], lambda i: i.cast("string")), ",").alias("input_ids"), F.array_join(F.transform(x["labels"], lambda i: i.cast("string")), ",").alias("labels"))


@bind(
    "score_pad_batch",
    """WITH w AS (SELECT conv_id, turn, conv_id // 8 AS b, list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS VARCHAR)) AS c FROM conversations WHERE text IS NOT NULL AND turn < 2), m AS (SELECT *, max(len(c)) OVER (PARTITION BY b) - len(c) AS gap FROM w)
    SELECT 'right' AS side, conv_id, turn, array_to_string(c, ',') || repeat(',0', gap) AS input_ids, CAST(len(c) AS BIGINT) AS attended FROM m UNION ALL SELECT 'left' AS side, conv_id, turn, repeat('0,', gap) || array_to_string(c, ',') AS input_ids, CAST(len(c) AS BIGINT) AS attended FROM m""",
)
def _(t):
    """Batches of eight conversations, padded for scoring and for generating."""
    rows = t("conversations").where("text IS NOT NULL AND turn < 2").select("conv_id", "turn", F.floor(F.col("conv_id") / 8).alias("b"), _ids().alias("ids"))
    out = None
    for side in ("right", "left"):
        p = E.pad_batch(rows, "b", {"ids": 0}, side)
        part = p.select(F.lit(side).alias("side"), "conv_id", "turn", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("attended"))
        out = part if out is None else out.unionByName(part)
    return out


def _losses(batch: list[list[int]]) -> list[list[float]]:
    """Stands for a model: a token's loss is its id over ten."""
    return [[x / 10 for x in ids] for ids in batch]


@bind("score_token_loss", "SELECT item_id, round(avg(CAST(length(w) AS DOUBLE)) / 10, 6) AS avg_loss, CAST(count(*) AS BIGINT) AS n FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark WHERE text IS NOT NULL) AS x GROUP BY item_id")
def _(t):
    rows = E.token_losses(t("benchmark").where("text IS NOT NULL").select("item_id", _ids().alias("ids")), "item_id", "ids", _losses)
    return rows.select("item_id", F.round("avg_loss", 6).alias("avg_loss"), F.size("losses").cast("bigint").alias("n"))


@bind("score_loglik", "SELECT item_id, CAST(o AS INT) AS option_id, round((7 + o) / 10.0 + 0.9, 6) AS loss FROM benchmark, range(4) AS r(o) WHERE text IS NOT NULL")
def _(t):
    """Four options of two tokens for each context: the loss of an option is that of its own tokens."""
    opts = t("benchmark").where("text IS NOT NULL").select("item_id", _ids().alias("ctx"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("o"))
    req = opts.select(F.concat_ws(":", "item_id", "o").alias("key"), E.score_request(F.col("ctx"), F.array(F.col("o") + 7, F.lit(9)), 64).alias("x")).select("key", "x.input_ids", "x.labels")
    scored = E.token_losses(req, "key", "input_ids", _losses).join(req.select("key", "labels"), "key")
    part = lambda i, kind: F.split_part("key", F.lit(":"), F.lit(i)).cast(kind)
    return scored.select(part(1, "bigint").alias("item_id"), part(2, "int").alias("option_id"), F.round(E.option_loss(F.col("losses"), F.col("labels")), 6).alias("loss"))


@bind(
    "llm_response_parse",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, c_name AS asked, CAST(NULL AS VARCHAR) AS reject FROM events JOIN customer ON c_custkey = user_id WHERE event_id % 3 > 0 AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = user_id % 2 UNION ALL SELECT event_id, CAST(NULL AS VARCHAR) AS k, c_name AS asked, CASE WHEN event_id % 3 = 0 THEN 'unparsed' ELSE 'mismatch' END AS reject FROM events JOIN customer ON c_custkey = user_id WHERE event_id % 3 = 0 OR CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 <> user_id % 2",
)
def _(t):
    """Responses with their requests: parsed, checked against the request, and rejected otherwise."""
    answer = F.when(F.col("event_id") % 3 == 0, F.lit("I cannot say {")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Well: "), "props"))
    rows = t("events").select("event_id", "user_id", F.from_json(A.robust_json_column(answer), "k bigint").alias("x"))
    met = rows.join(t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("asked")), "user_id")
    reject = F.when(F.col("x").isNull(), "unparsed").when(F.col("x.k") % 2 != F.col("user_id") % 2, "mismatch")
    return met.select("event_id", F.when(reject.isNull(), F.col("x.k").cast("string")).alias("k"), "asked", reject.alias("reject"))


@bind("llm_rewrite_request", f"SELECT doc_id, 'Rewrite each sentence in five ways, as a JSON array: ' || CAST(to_json(s) AS VARCHAR) AS message FROM ({SENTENCES}) AS x WHERE len(s) > 0 AND NOT EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = x.doc_id AND l.toxic = 1)")
def _(t):
    """A document's sentences as a JSON array in a request; ids that failed before are skipped."""
    failed = t("labels").where("toxic = 1").select("doc_id")
    rows = M.exclude(t("documents").select("doc_id", S.sentences(F.col("text")).alias("s")).where("size(s) > 0"), "doc_id", failed)
    return rows.select("doc_id", F.concat(F.lit("Rewrite each sentence in five ways, as a JSON array: "), F.to_json("s")).alias("message"))


# --- instructions -------------------------------------------------------------------------------------------------------
def records(t) -> DataFrame:
    """Documents as records: the first sentence is the title, umlauts and accents are the native script."""
    return records_of(t("documents").where("text IS NOT NULL").select(F.col("doc_id").alias("docid"), F.col("text").alias("abstract")))


def records_of(texts: DataFrame) -> DataFrame:
    """Records of docid and abstract (not null); further columns stay."""
    roman = lambda c: F.translate(c, "äöüßéèêñóíç", "aouseeenoic")
    # the, de, der and la where no ASCII letter, digit or _ stands before (\b of SQL; that of Java knows all letters); the
    # first letter is asked for first, as what stands before every character is slow to look at
    noisy = lambda c: F.regexp_replace(c, r"[tdl](?<![0-9A-Za-z_][tdl])(?:(?<=t)he|(?<=d)er?|(?<=l)a) ", "")
    # a text of blanks alone has no sentence; a filter on the sentences would cut each text twice
    rows = texts.where(F.trim("abstract") != "").withColumn("sentences", S.sentences(F.col("abstract")))
    first = lambda c: F.get(c, F.lit(0))
    qa = lambda c: F.when(F.size(c) > 1, F.array(F.struct(first(c).alias("q"), F.get(c, F.lit(1)).alias("a"))))
    rows = rows.withColumns({"title": first("sentences"), "keywords": F.slice(F.array_distinct(S.word_tokens(first("sentences"))), 1, 5), "qa": qa("sentences")})
    lang = F.expr(planted.LANG.replace("doc_id", "docid"))
    rows = rows.withColumn("causal", C.causal_pairs(planted.cued(F.col("sentences"), F.col("docid"), lang), lang))
    for view, f in (("roman", roman), ("noisy", noisy)):
        rows = rows.withColumns({f"{view}_abstract": f(F.col("abstract")), f"{view}_sentences": F.transform("sentences", f)})
        own = f"{view}_sentences"  # title and qa are of sentences, in this view as well
        rows = rows.withColumns({f"{view}_title": first(own), f"{view}_qa": qa(own)})
    return rows


#: The same records in DuckDB.
RECORDS = f"rec AS (SELECT doc_id AS docid, s, s[1] AS title, text AS abstract FROM (SELECT x.doc_id, x.s, d.text FROM ({SENTENCES}) AS x JOIN (SELECT doc_id, min(text) AS text FROM documents GROUP BY doc_id) AS d ON d.doc_id = x.doc_id) AS y WHERE len(s) > 0)"
_ROMAN = "translate({0}, 'äöüßéèêñóíç', 'aouseeenoic')"
_NOISY = "regexp_replace({0}, '\\b(the|de|der|la) ', '', 'g')"


def template_sql(kind: str, key: str, **sides: str) -> str:
    """filled() in DuckDB."""
    out = []
    for t in I.TEMPLATES[kind]:
        text = "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        for name, x in sides.items():
            text = text.replace("{" + name + "}", f"' || {x} || '")
        out.append(text)
    pick = f"CAST(floor({uniform_sql("'template'", key)} * {len(out)}) AS INT)"
    return f"CASE {pick} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(out)) + " END"


_KEY, _KEY_I = "CAST(docid AS VARCHAR)", "concat_ws(':', CAST(docid AS VARCHAR), CAST(i AS VARCHAR))"


@bind("inst_summarization", f"WITH {RECORDS} SELECT docid, {template_sql('summarization', _KEY, a='abstract', b='title')} AS text, 'summarization' AS type FROM rec")
def _(t):
    return I.summarization(records(t))


_CUT = f"cut AS (SELECT *, 1 + CAST(floor({_U.format(_KEY)} * (len(s) - 1)) AS INT) AS i FROM rec WHERE len(s) >= 2)"


@bind("inst_completion", f"WITH {RECORDS}, {_CUT} SELECT docid, {template_sql('completion', _KEY, a="array_to_string(s[1:i], ' ')", b="array_to_string(s[i + 1:], ' ')")} AS text, 'completion' AS type FROM cut")
def _(t):
    return I.completion(records(t))


@bind("inst_conclusion", f"WITH {planted.concluded_oracle(planted.concluded(PARTS))}, h AS (SELECT doc_id AS docid, text AS abstract, n AS b FROM c) SELECT docid, {template_sql('conclusion', _KEY, a='left(abstract, b)', b='substring(abstract, b + 1)')} AS text, 'conclusion' AS type FROM h")
def _(t):
    """Texts with a conclusion's cue, in three languages."""
    x = C.conclusion_split(F.col("text"), F.col("lang"))
    return I.conclusion(t.sql(planted.concluded(PARTS)).select(F.col("doc_id").alias("docid"), x.alias("conclu")))


@bind("inst_qa", f"WITH {RECORDS}, x AS (SELECT docid, 0 AS i, abstract, s[1] AS q, s[2] AS a FROM rec WHERE len(s) > 1) SELECT docid, {template_sql('qa', _KEY_I, a='q', b='a')} AS text, 'qa' AS type FROM x UNION ALL SELECT docid, {template_sql('qa_context', _KEY_I, a='q', b='a', c='abstract')} AS text, 'qa_context' AS type FROM x")
def _(t):
    """Pairs without and with the abstract as their context."""
    return I.qa(records(t)).unionByName(I.qa_context(records(t)))


_KEYS = "array_to_string(k, ', ')"


def _keys_oracle(kind: str) -> str:
    from .bound_texts import _CLASSES

    distinct = f"(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(regexp_extract_all(rec.title, '{_CLASSES}')) AS w, unnest(range(1, 1 + len(regexp_extract_all(rec.title, '{_CLASSES}')))) AS i) AS y GROUP BY w ORDER BY i LIMIT 5) AS z)"
    return f"WITH {RECORDS}, kw AS (SELECT docid, title, abstract, {distinct} AS k FROM rec) SELECT docid, {template_sql(kind, _KEY, a="(title || '. ' || abstract)", b=_KEYS)} AS text, '{kind}' AS type FROM kw WHERE len(k) >= 3"


@bind("inst_text2key", _keys_oracle("text2key"))
def _(t):
    return I.text2key(records(t))


@bind("inst_key2text", _keys_oracle("key2text"))
def _(t):
    return I.key2text(records(t))


_CAUSAL = f"{planted.causal_oracle(SENTENCES)}, n AS (SELECT doc_id AS docid, relation, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY pos, kind, k) - 1 AS i FROM c)"


@bind("inst_causal", f"WITH {RECORDS}, {_CAUSAL} SELECT docid, CASE relation " + " ".join(f"WHEN '{r}' THEN {template_sql(f'causal-{r}', _KEY_I, a='a', b='b')}" for r in ("entail", "contradict", "neutral")) + " END AS text, 'causal-' || relation AS type FROM n")
def _(t):
    return I.causal(records(t))


_GMRC_KINDS = " ".join(f"WHEN '{x}' THEN {template_sql(f'gmrc-{x}', _KEY_I, a='a', b='b')}" for x in ("goal", "method", "result", "conclu"))


@bind(
    "inst_gmrc",
    f"""WITH {planted.sections_oracle(PARTS)}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM s),
    y AS (SELECT x.doc_id AS docid, x.i, x.section, x.text AS b, string_agg(z.text, ' ' ORDER BY z.i) AS a FROM o AS x JOIN o AS z ON z.doc_id = x.doc_id AND z.section <> x.section GROUP BY ALL)
    SELECT docid, CASE section {_GMRC_KINDS} END AS text, 'gmrc-' || section AS type FROM y""",
)
def _(t):
    """One instruction for each section of the abstracts with headings, in three languages."""
    spans = C.section_spans(F.col("abstract"), F.col("lang"))
    return I.gmrc(t.sql(planted.abstracts(PARTS)).select(F.col("doc_id").alias("docid"), spans.alias("gmrc")))


def _sides_oracle(given: str, wanted: str, kind: str) -> str:
    return f"WITH {RECORDS}, v AS (SELECT docid, list_concat([title], s) AS every FROM rec), e AS (SELECT docid, unnest(range(len(every))) AS i, unnest(every) AS x FROM v), y AS (SELECT docid, i, {given.format('x')} AS a, {wanted.format('x')} AS b FROM e) SELECT docid, {template_sql(kind, _KEY_I, a='a', b='b')} AS text, '{kind}' AS type FROM y"


@bind("inst_romanization", _sides_oracle("{0}", _ROMAN, "romanization") + " UNION ALL " + f"SELECT * FROM ({_sides_oracle(_ROMAN, '{0}', 'deromanization')}) AS z")
def _(t):
    """Both directions, for the title and each sentence."""
    return I.romanization(records(t)).unionByName(I.deromanization(records(t)))


@bind(
    "inst_medical_translation",
    f"WITH {RECORDS}, e AS (SELECT docid, title AS en_title, abstract AS en_abstract FROM rec WHERE docid % 2 = 0), y AS (SELECT rec.docid, 0 AS i, title AS a, en_title AS b FROM rec JOIN e ON e.docid + 1 = rec.docid UNION ALL SELECT rec.docid, 1 AS i, abstract AS a, en_abstract AS b FROM rec JOIN e ON e.docid + 1 = rec.docid) SELECT docid, {template_sql('translation', _KEY_I, a='a', b='b')} AS text, 'medical_translation' AS type FROM y",
)
def _(t):
    """Every other document is the translation of the next one; records without one are left out."""
    rec = records(t).select("docid", "title", "abstract")
    en = rec.where("docid % 2 = 0").select((F.col("docid") + 1).alias("docid"), F.col("title").alias("en_title"), F.col("abstract").alias("en_abstract"))
    return I.medical_translation(rec.join(en, "docid"))


def _bitext(t) -> DataFrame:
    rows = t.sql(PARTS).where("s1 <> '' AND s2 <> ''")
    return rows.select(F.col("doc_id").alias("docid"), F.col("s1").alias("native"), F.col("s2").alias("english"), F.translate("s1", "äöüßéèêñóíç", "aouseeenoic").alias("roman"))


@bind("inst_bitext_translation", f"SELECT doc_id AS docid, {template_sql('translation', 'CAST(doc_id AS VARCHAR)', a='s1', b='s2')} AS text, 'bitext_translation' AS type FROM ({PARTS}) AS p WHERE s1 <> '' AND s2 <> ''")
def _(t):
    return I.bitext_translation(_bitext(t))


@bind("inst_bitext_romanization", f"SELECT doc_id AS docid, {template_sql('romanization', 'CAST(doc_id AS VARCHAR)', a='s1', b=_ROMAN.format('s1'))} AS text, 'bitext_romanization' AS type FROM ({PARTS}) AS p WHERE s1 <> '' AND s2 <> ''")
def _(t):
    return I.bitext_romanization(_bitext(t))


@bind("inst_pure_text", f"WITH {RECORDS} SELECT docid, abstract AS text, 'pure_text' AS type FROM rec")
def _(t):
    return I.pure_text(records(t))


_DENOISED = f"v AS (SELECT docid, list_concat(s, CASE WHEN len(s) > 1 THEN [s[1], s[2]] ELSE [] END) AS every FROM rec), e AS (SELECT docid, unnest(range(len(every))) AS i, unnest(every) AS raw FROM v), y AS (SELECT docid, i, {_NOISY.format('raw')} AS noise, raw FROM e)"


@bind("inst_denoise", f"WITH {RECORDS}, {_DENOISED} SELECT docid, {template_sql('denoise', _KEY_I, a='noise', b='raw')} AS text, 'denoise' AS type FROM y WHERE noise <> raw UNION ALL SELECT docid, replace({template_sql('denoise', _KEY_I, a="'{noise}'", b="'{raw}'")}, '~', '~') || noise || raw AS text, 'tuning' AS type FROM y WHERE noise <> raw")
def _(t):
    """The training form, and the tuning form with its parts joined."""
    tuning = I.denoise(records(t), tuning=True)
    return I.denoise(records(t)).unionByName(tuning.select("docid", F.concat("template", "noise", "raw").alias("text"), F.lit("tuning").alias("type")))


@bind("inst_denoise_abstract", f"WITH {RECORDS}, y AS (SELECT docid, 0 AS i, {_NOISY.format('abstract')} AS noise, abstract AS raw FROM rec) SELECT docid, {template_sql('denoise', _KEY_I, a='noise', b='raw')} AS text, 'denoise' AS type FROM y WHERE noise <> raw")
def _(t):
    return I.denoise_abstract(records(t))


@bind("inst_select_view", f"WITH {RECORDS} SELECT docid, mode, CASE mode WHEN 'raw' THEN abstract WHEN 'roman' THEN {_ROMAN.format('abstract')} WHEN 'noisy2raw' THEN {_NOISY.format('abstract')} ELSE abstract END AS given, CASE mode WHEN 'roman' THEN {_ROMAN.format('title')} WHEN 'raw2roman' THEN {_ROMAN.format('title')} ELSE title END AS wanted FROM rec, (VALUES ('raw'), ('roman'), ('noisy2raw'), ('raw2roman')) AS v(mode)")
def _(t):
    """The two sides of a record that a mode selects."""
    out = None
    for mode in ("raw", "roman", "noisy2raw", "raw2roman"):
        given, wanted = I.views(mode)
        part = records(t).select("docid", F.lit(mode).alias("mode"), I.view("abstract", given).alias("given"), I.view("title", wanted).alias("wanted"))
        out = part if out is None else out.unionByName(part)
    return out


def whole_records(t) -> DataFrame:
    """Records with their conclusion, sections and English side: bare texts meet, then all of a document is made where it
    lies, so that neither records nor parts of them are shuffled."""
    lang = F.col("lang")
    texts = t("documents").where(F.trim("text") != "").select("doc_id", F.col("text").alias("body"))
    given = texts.where("doc_id % 2 = 0").select((F.col("doc_id") + 1).alias("_of"), F.col("body").alias("en_abstract"))
    both = texts.join(given.hint("merge"), F.col("doc_id") == F.col("_of"), "left").select("doc_id", "body", "en_abstract", *(F.expr(f"split_part(body, '. ', {k})").alias(f"s{k}") for k in range(1, 5)))
    kept = ("body", "en_abstract", "s1", "s2", "s3")
    headed = t.spark.sql(planted.abstracts("SELECT * FROM {both}", kept), both=both).select("doc_id", *kept, C.section_spans(F.col("abstract"), lang).alias("gmrc"))
    kept = ("body", "en_abstract", "gmrc")
    found = t.spark.sql(planted.concluded("SELECT * FROM {headed}", kept), headed=headed)
    found = found.select(F.col("doc_id").alias("docid"), F.col("body").alias("abstract"), "en_abstract", "gmrc", C.conclusion_split(F.col("text"), lang).alias("conclu"))
    return records_of(found).withColumn("en_title", F.get(S.sentences(F.col("en_abstract")), F.lit(0)))


@bind("inst_dispatch")
def _(t):
    """How many instructions of each type every mode makes."""
    path = scratch(t.spark)  # every mode reads the records
    whole_records(t).write.parquet(path)
    return I.dispatch(t.spark.read.parquet(path), sorted(I.MODES)).groupBy("mode", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("docid").alias("docids"))


def _dispatch_oracle() -> str:
    def rows(mode: str, kind: str, counts: str) -> str:
        return f"SELECT '{mode}' AS mode, '{kind}' AS type, n, d AS docids FROM {counts}"

    each = []
    for view in ("", "roman_", "noisy2raw_"):
        each += [rows(f"{view}summarization", "summarization", "a"), *(rows(f"{view}{x}", x, "two") for x in ("completion", "qa", "qa_context"))]
    each += [rows(x, x, "kw") for x in ("text2key", "key2text")]
    each += [rows(x, x, "sides") for x in ("romanization", "deromanization")]
    each += [rows(f"{view}medical_translation", "medical_translation", "med") for view in ("", "roman_")]
    each += [rows(f"{view}pure_text", "pure_text", "a") for view in ("", "roman_")]
    each += [rows("denoise", "denoise", "dn"), rows("denoise_abstract", "denoise", "da"), rows("conclusion", "conclusion", "cc")]
    each += ["SELECT 'causal', 'causal-' || relation, count(*), count(DISTINCT docid) FROM ca GROUP BY relation", "SELECT 'gmrc', 'gmrc-' || section, count(*), count(DISTINCT doc_id) FROM gm GROUP BY section"]
    return f"""WITH {RECORDS}, {_DENOISED},
    a AS (SELECT count(*) AS n, count(DISTINCT docid) AS d FROM rec), two AS (SELECT count(*) AS n, count(DISTINCT docid) AS d FROM rec WHERE len(s) >= 2),
    dn AS (SELECT count(*) AS n, count(DISTINCT docid) AS d FROM y WHERE noise <> raw), da AS (SELECT count(*) AS n, count(DISTINCT docid) AS d FROM rec WHERE {_NOISY.format('abstract')} <> abstract),
    kw AS (SELECT count(*) AS n, count(DISTINCT docid) AS d FROM ({_keys_oracle('text2key')}) AS q), sides AS (SELECT sum(len(s) + 1) AS n, count(DISTINCT docid) AS d FROM rec),
    med AS (SELECT 2 * count(*) AS n, count(DISTINCT docid) AS d FROM rec WHERE docid % 2 = 1 AND docid - 1 IN (SELECT docid FROM rec)),
    cc AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS d FROM (WITH {planted.concluded_oracle(planted.concluded(PARTS))} SELECT doc_id FROM c) AS q WHERE doc_id IN (SELECT docid FROM rec)),
    ca AS (SELECT * FROM (WITH {_CAUSAL} SELECT docid, relation FROM n) AS q),
    gm AS (SELECT * FROM (WITH {planted.sections_oracle(PARTS)} SELECT doc_id, section FROM s) AS q WHERE doc_id IN (SELECT docid FROM rec))
    {" UNION ALL ".join(each)}"""


ORACLES["inst_dispatch"] = _dispatch_oracle()
