"""The engine's relational plans, each stated once for Spark and for the oracle (see dialect.py).

A plan takes a dialect and returns SQL over the driver's tables, which play the roles of corpus records: documents are
abstracts and instructions (tokens = n_chars, type = source), lineitem holds option scores (request = order, loss =
extended price, valid tokens = quantity), orders are checkpoint observations (iteration = month, sample = customer),
conversations are message lists, labels are judgements, events are raw responses, part/supplier/nation are lexicons.
"""

from __future__ import annotations

from collections.abc import Callable

PLANS: dict[str, Callable] = {}


def plan(fn: Callable) -> Callable:
    PLANS[fn.__name__] = fn
    return fn


def sql(name: str, text: str) -> None:
    """A plan that both engines read alike."""
    PLANS[name] = lambda d, text=text: text


#: Options of a request in a fixed order, with the number of options and the right one.
OPTIONS = """opt AS (SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity, l_partkey, l_suppkey) - 1 AS option_id,
  l_extendedprice AS loss, l_quantity AS n_tok, count(*) OVER (PARTITION BY l_orderkey) AS n_opt FROM lineitem)"""


def predicted(d) -> str:
    """Raw and length-normalised prediction of each request; the first of equal losses wins."""
    return f"{OPTIONS}, pred AS (SELECT request_id, max(n_opt) AS n_opt, request_id % max(n_opt) AS answer, {d.first_by('option_id', 'loss', 'option_id')} AS raw, {d.first_by('option_id', 'loss / n_tok', 'option_id')} AS norm FROM opt GROUP BY request_id)"


#: An observation of each sample at each iteration.
SERIES = """series AS (SELECT o_custkey AS sample, month(o_orderdate) AS iter, o_orderpriority AS task, o_totalprice AS loss, o_orderkey AS pos,
  CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS correct FROM orders)"""

# --- projections -----------------------------------------------------------------------------------------------------
sql("proj_pick_lang", "SELECT o_orderkey AS docid, max(CASE WHEN lang = 'en' THEN content END) AS title_en, max(CASE WHEN lang = 'ja' THEN content END) AS title_ja FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'ja' END AS lang, o_orderpriority AS content FROM orders) AS x GROUP BY o_orderkey")
sql("proj_compose_docid", "SELECT doc_id, concat_ws('@@', source, CAST(doc_id AS VARCHAR(20))) AS docid FROM documents")
sql("proj_request_id_split", "SELECT doc_id, split_part(r, '_sentid:', 1) AS docid, CAST(split_part(r, '_sentid:', 2) AS INT) AS sentid FROM (SELECT doc_id, concat(source, '@@', CAST(doc_id AS VARCHAR(20)), '_sentid:', CAST(doc_id % 7 AS VARCHAR(20))) AS r FROM documents) AS x")
sql("proj_response_id_strip", "SELECT event_id, substring(concat('chatcmpl-', CAST(event_id AS VARCHAR(20))), 10) AS id FROM events")
sql("proj_model_attributes", "SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'medical' WHEN p_type LIKE '%BRASS%' THEN 'science' ELSE 'balanced' END AS train_domain, CASE WHEN p_name LIKE '%e' THEN 'en' ELSE 'ja' END AS train_lang FROM part")
sql("proj_task_attributes", "SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'en' WHEN url LIKE '%/de/%' THEN 'de' ELSE 'other' END AS lang, CASE WHEN url LIKE '%.html' THEN 'memorization' ELSE 'generalization' END AS type FROM pages")
sql("proj_task_label", "SELECT doc_id, CASE WHEN lang = source THEN lang ELSE concat(upper(lang), '-OOD') END AS label FROM documents")
sql("proj_transfer_label", "SELECT doc_id, CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN 'Memorization' WHEN lang = 'en' THEN 'Intralingual' WHEN doc_id % 2 = 0 THEN 'Interlingual' ELSE 'Other' END AS transfer FROM documents")
sql("proj_rename_alias", "SELECT c_custkey AS id, replace(replace(c_mktsegment, 'BUILDING', 'exp1'), 'MACHINERY', 'exp2') AS model FROM customer")
# --- filters ---------------------------------------------------------------------------------------------------------
sql("filter_score_threshold", "SELECT l_orderkey, l_partkey, l_discount FROM lineitem WHERE l_discount >= 0.07")
sql("filter_all_good", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
sql("filter_full_support", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
sql("filter_checkpoint_range", f"WITH {SERIES} SELECT sample, iter, pos FROM series WHERE NOT (iter > 0 AND iter <= 3)")
sql("filter_label_exclude", "SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
sql("filter_min_tokens", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 50")


@plan
def filter_subject_contains_any(d):
    return f"SELECT p_partkey FROM part WHERE {d.has(d.array(chr(39) + 'STEEL' + chr(39), chr(39) + 'TIN' + chr(39)), 'split_part(p_type, chr(32), 3)')} OR p_name LIKE '%blue%'"


@plan
def filter_type_prefix_blocklist(d):
    return f"SELECT p_partkey, p_type FROM part WHERE NOT {d.like('lower(p_type)', '^(eco|pro|f_)')}"


@plan
def filter_semantic_type_blocklist(d):
    return f"SELECT p_partkey FROM part WHERE {d.size(d.filter(d.split('p_type', ' '), 'x', 'x NOT IN (' + chr(39) + 'STEEL' + chr(39) + ', ' + chr(39) + 'TIN' + chr(39) + ')'))} > 0"


@plan
def filter_alias_charset(d):
    return f"SELECT p_partkey, p_name FROM part WHERE {d.like('p_name', '^[A-Za-z0-9 ]+$')}"


@plan
def filter_alias_patterns(d):
    return f"SELECT p_partkey FROM part WHERE NOT {d.like('p_name', '[･-ﾟ]')} AND lower(p_name) <> lower(p_brand) AND p_type NOT LIKE '%NICKEL%'"


@plan
def filter_nonlatin_leak(d):
    return f"SELECT doc_id FROM documents WHERE NOT {d.like('text', '[一-鿿]')} AND lang <> 'en'"


@plan
def filter_valid_mcq(d):
    q = "concat(text, CASE WHEN doc_id % 3 = 0 THEN ' [BLANK]' WHEN doc_id % 3 = 1 THEN ' [BLANK] [BLANK]' ELSE '' END)"
    return f"SELECT doc_id FROM (SELECT doc_id, {q} AS q FROM documents) AS x WHERE (length(q) - length(replace(q, '[BLANK]', ''))) / 7 = 1 AND q <> ''"


@plan
def filter_min_keywords(d):
    """Documents with three keywords or more: the words of their first line of capital letters; most have fewer."""
    return f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {d.size(d.split('substring(text, 1, 20)', ' '))} >= 3"


@plan
def filter_pattern_path(d):
    return "SELECT page_id FROM pages WHERE contains(url, 'ads-track') OR contains(url, '/fr/')"


# --- joins -----------------------------------------------------------------------------------------------------------
sql("join_inner_doc_response", "SELECT c.c_custkey AS docid, o.o_orderkey AS response FROM customer AS c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) AS o ON c.c_custkey = o.o_custkey")
sql("join_inner_translation", "SELECT a.doc_id, l.quality FROM documents AS a JOIN labels AS l ON a.doc_id = l.doc_id")
sql("join_semi_docids", "SELECT d.doc_id, d.lang FROM documents AS d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
sql("join_anti_done", "SELECT d.doc_id, d.lang FROM documents AS d WHERE NOT EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = d.doc_id)")
sql("join_intersect_models", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 5")
sql("join_lexicon_cui", "SELECT n.n_nationkey AS cui, count(DISTINCT s.s_name) AS aliases FROM nation AS n JOIN supplier AS s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey")
sql("join_span_token_class", "WITH t AS (SELECT l_orderkey AS id, l_linenumber * 10 AS s, l_linenumber * 10 + 7 AS e, l_extendedprice AS loss FROM lineitem), c AS (SELECT o_orderkey AS id, 15 AS s, 38 AS e, o_orderpriority AS class FROM orders) SELECT c.class, count(*) AS n, round(sum(t.loss), 2) AS loss FROM t JOIN c ON t.id = c.id AND NOT (t.e <= c.s OR t.s >= c.e) GROUP BY c.class")
sql("join_baseline_delta", f"WITH {SERIES}, m AS (SELECT task, iter, avg(correct) AS acc FROM series GROUP BY task, iter) SELECT a.task, a.iter, round(a.acc - b.acc, 6) AS delta FROM m AS a JOIN m AS b ON a.task = b.task AND b.iter = 1")
sql("join_rewrite_merge", "SELECT d.doc_id, c.text AS rewrite FROM documents AS d JOIN conversations AS c ON d.doc_id = c.conv_id AND c.turn = 0")
sql("join_rerun_override", "SELECT d.doc_id, coalesce(l.quality, -1) AS result FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id")
sql("join_human_vs_model", "SELECT l.doc_id, l.quality AS human, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS model FROM labels AS l JOIN documents AS d ON d.doc_id = l.doc_id")


@plan
def join_count_deficit(d):
    return f"WITH done AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey), need AS (SELECT c_custkey, n FROM done WHERE n < 8) SELECT c_custkey, copy FROM {d.unnest('need', d.numbers('n + 1', '8'), '_p', 'copy', 'c_custkey')} AS x"


# --- aggregations ----------------------------------------------------------------------------------------------------
sql("agg_count_by_key", "SELECT source, count(*) AS n FROM documents GROUP BY source")
sql("agg_count_distinct_keys", "SELECT count(DISTINCT source) AS n FROM documents")
sql("agg_lang_coverage_pct", "SELECT lang, count(DISTINCT source) AS n, round(1e2 * count(DISTINCT source) / (SELECT count(DISTINCT source) FROM documents), 4) AS pct FROM documents GROUP BY lang")
sql("agg_model_vote", "SELECT l_orderkey AS request_id, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS votes, round(sum(CASE WHEN l_returnflag = 'N' THEN exp(-l_discount) ELSE 0 END), 6) AS confidence FROM lineitem GROUP BY l_orderkey")


@plan
def agg_accuracy(d):
    return f"WITH {predicted(d)} SELECT n_opt, count(*) AS n, round(avg(CASE WHEN raw = answer THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(CASE WHEN norm = answer THEN 1e0 ELSE 0e0 END), 6) AS norm_accuracy FROM pred GROUP BY n_opt"


@plan
def agg_nli_accuracy(d):
    return f"WITH {OPTIONS}, p AS (SELECT request_id, {d.first_by('option_id', 'loss', 'option_id')} AS pred FROM opt WHERE n_opt >= 3 AND option_id < 3 GROUP BY request_id) SELECT round(avg(CASE WHEN pred = request_id % 3 THEN 1e0 ELSE 0e0 END), 6) AS accuracy, count(*) AS n FROM p"


sql("agg_mean_loss_sequence", "SELECT l_orderkey, round(avg(l_extendedprice), 4) AS mean_loss FROM lineitem GROUP BY l_orderkey")


@plan
def agg_pearson(d):
    return f"WITH {predicted(d)} SELECT round(corr(CAST(raw AS DOUBLE), CAST(answer AS DOUBLE)), 6) AS pearson FROM pred"


sql("agg_confusion", "SELECT CAST(sum(CASE WHEN h = 1 AND m = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN h = 0 AND m = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN h = 0 AND m = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN h = 1 AND m = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM (SELECT l.quality AS h, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS m FROM labels AS l JOIN documents AS d ON d.doc_id = l.doc_id) AS x")
sql("agg_quality_rates", "SELECT round(avg(CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END), 6) AS good, round(avg(CASE WHEN toxic = 0 THEN 1e0 ELSE 0e0 END), 6) AS clean, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1e0 ELSE 0e0 END), 6) AS all_good FROM labels")
sql("agg_score_histogram", "SELECT quality + toxic AS score, count(*) AS n, round(1e0 * count(*) / (SELECT count(*) FROM labels), 6) AS share FROM labels GROUP BY quality + toxic")
sql("agg_rubric_means", "SELECT round(avg(l_quantity), 4) AS a, round(avg(l_discount), 6) AS b, round(avg(l_tax), 6) AS c, round((avg(l_quantity) + avg(l_discount) + avg(l_tax)) / 3, 4) AS family FROM lineitem")
sql("agg_task_family_mean", "SELECT r.r_name AS family, round(avg(t.acc), 4) AS mean_acc FROM (SELECT c_nationkey, avg(c_acctbal) AS acc FROM customer GROUP BY c_nationkey) AS t JOIN nation AS n ON n.n_nationkey = t.c_nationkey JOIN region AS r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name")
sql("agg_trend_by_checkpoint", f"WITH {OPTIONS}, s AS (SELECT request_id, sum(loss) AS total, max(n_opt) AS n_opt, sum(CASE WHEN option_id = request_id % n_opt THEN loss ELSE 0 END) AS right_loss FROM opt WHERE n_opt > 1 GROUP BY request_id) SELECT month(o_orderdate) AS iter, o_orderpriority AS task, round(avg(right_loss), 3) AS right_loss, round(avg((total - right_loss) / (n_opt - 1)), 3) AS wrong_loss, round(sum(right_loss) / sum(total), 6) AS ratio, count(*) AS n FROM s JOIN orders ON o_orderkey = request_id GROUP BY month(o_orderdate), o_orderpriority")
sql("agg_loss_by_class", "SELECT event_type AS class, round(avg(value), 4) AS mean_loss, count(*) AS n FROM events GROUP BY event_type HAVING count(*) >= 100")
sql("agg_melt_losses", "SELECT event_type, 'min' AS kind, min(value) AS loss FROM events GROUP BY event_type UNION ALL SELECT event_type, 'max' AS kind, max(value) AS loss FROM events GROUP BY event_type")
sql("agg_pivot_loss", f"WITH {SERIES} SELECT iter, round(avg(CASE WHEN task = '1-URGENT' THEN loss END), 2) AS urgent, round(avg(CASE WHEN task = '2-HIGH' THEN loss END), 2) AS high, round(avg(CASE WHEN task = '5-LOW' THEN loss END), 2) AS low FROM series GROUP BY iter")


@plan
def agg_transition(d):
    first_last = f"{d.first_by('correct', 'iter', 'pos')} AS a, {d.last_by('correct', 'iter', 'pos')} AS b"
    return f"WITH {SERIES}, t AS (SELECT sample, {first_last} FROM series GROUP BY sample) SELECT round(avg(CASE WHEN a = 1 AND b = 0 THEN 1e0 ELSE 0e0 END), 6) AS forgotten, round(avg(CASE WHEN a = 0 AND b = 1 THEN 1e0 ELSE 0e0 END), 6) AS acquired, round(avg(CASE WHEN a = 1 AND b = 1 THEN 1e0 ELSE 0e0 END), 6) AS retained, round(avg(CASE WHEN a = 0 AND b = 0 THEN 1e0 ELSE 0e0 END), 6) AS unacquired FROM t"


@plan
def agg_acquired_filter(d):
    first_last = f"{d.first_by('correct', 'iter', 'pos')} AS a, {d.last_by('correct', 'iter', 'pos')} AS b"
    return f"WITH {SERIES}, t AS (SELECT sample, {first_last} FROM series GROUP BY sample) SELECT sample FROM t WHERE a = 0 AND b = 1"


sql("agg_token_total", "SELECT coalesce(lang, 'all') AS lang, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY ROLLUP(lang)")
sql("agg_set_equality_check", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) AS x) AS only_docs, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) AS y) AS only_labels")
sql("agg_corpus_lang_counts", "SELECT source, count(DISTINCT CASE WHEN lang = 'en' THEN doc_id END) AS en, count(DISTINCT CASE WHEN lang <> 'en' THEN doc_id END) AS other FROM documents GROUP BY source")
sql("agg_dedupe_option_result", "SELECT request_id, option_no, loss FROM (SELECT l_orderkey AS request_id, l_linenumber AS option_no, l_extendedprice AS loss, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_quantity, l_partkey) AS k FROM lineitem) AS x WHERE k = 1")
sql("dedupe_first_by_key", "SELECT md5(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")


@plan
def agg_entity_freq_surface(d):
    return f"SELECT p_brand AS cui, count(*) AS freq, {d.join_rows('p_name', '|', 'p_name')} AS surfaces FROM (SELECT DISTINCT p_brand, p_name FROM part) AS x GROUP BY p_brand"


@plan
def agg_lemma_pos_freq(d):
    return f"SELECT w AS lemma, count(*) AS freq FROM {d.unnest('part', d.split('p_name', ' '), '_p', 'w', 'p_partkey')} AS x GROUP BY w"


@plan
def agg_token_overlap(d):
    words = d.unnest("documents", d.distinct(d.split("lower(text)", " ")), "_p", "w", "doc_id")
    base = d.unnest("benchmark", d.distinct(d.split("lower(text)", " ")), "_p", "w", "item_id")
    return f"SELECT a.doc_id, round(avg(CASE WHEN b.w IS NULL THEN 0e0 ELSE 1e0 END), 6) AS overlap FROM {words} AS a LEFT JOIN (SELECT DISTINCT w FROM {base} AS y) AS b ON a.w = b.w GROUP BY a.doc_id"


# --- windows, order, sampling ----------------------------------------------------------------------------------------


@plan
def win_first_last_checkpoint(d):
    return f"WITH {SERIES} SELECT sample, {d.first_by('loss', 'iter', 'pos')} AS first_loss, {d.last_by('loss', 'iter', 'pos')} AS last_loss FROM series GROUP BY sample"


sql("win_answer_rank", f"WITH {OPTIONS}, r AS (SELECT request_id, option_id, n_opt, row_number() OVER (PARTITION BY request_id ORDER BY loss, option_id) AS rank FROM opt) SELECT request_id, rank FROM r WHERE option_id = request_id % n_opt")
sql("win_answer_loss_ratio", f"WITH {OPTIONS}, r AS (SELECT request_id, option_id, n_opt, loss / sum(loss) OVER (PARTITION BY request_id) AS ratio FROM opt) SELECT request_id, round(ratio, 6) AS ratio FROM r WHERE option_id = request_id % n_opt")


@plan
def win_min_point(d):
    return f"WITH {SERIES}, m AS (SELECT task, iter, avg(loss) AS loss FROM series GROUP BY task, iter) SELECT task, {d.first_by('iter', 'loss', 'iter')} AS iter, round(min(loss), 3) AS loss FROM m GROUP BY task"


@plan
def win_best_candidate(d):
    return f"SELECT l_orderkey AS mention, {d.last_by('l_partkey', 'l_extendedprice', 'l_partkey')} AS candidate FROM lineitem GROUP BY l_orderkey"


sql("topk_most_common", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20")
sql("limit_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
sql("clip_lines_per_source", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) AS x WHERE k <= 10")


@plan
def sample_seeded_shuffle_k(d):
    return f"SELECT doc_id FROM documents ORDER BY {d.u(chr(39) + '42:' + chr(39) + ' || CAST(doc_id AS VARCHAR(20))')}, doc_id LIMIT 100"


@plan
def sample_distinct_ids(d):
    return f"SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) AS x ORDER BY {d.u('CAST(l_orderkey AS VARCHAR(20))')}, l_orderkey LIMIT 25)"


@plan
def shuffle_options(d):
    u = d.u("concat(CAST(request_id AS VARCHAR(20)), ':', CAST(option_id AS VARCHAR(20)))")
    return f"WITH {OPTIONS} SELECT request_id, option_id, row_number() OVER (PARTITION BY request_id ORDER BY {u}, option_id) - 1 AS place, CASE WHEN option_id = request_id % n_opt THEN 1 ELSE 0 END AS is_answer FROM opt"


# --- sets ------------------------------------------------------------------------------------------------------------
sql("set_union_all_files", "SELECT doc_id AS id, 'documents' AS file FROM documents UNION ALL SELECT conv_id AS id, 'conversations' AS file FROM conversations")
sql("set_union_distinct_first", "SELECT id, file FROM (SELECT id, file, row_number() OVER (PARTITION BY id ORDER BY pri) AS k FROM (SELECT doc_id AS id, 'labels' AS file, 1 AS pri FROM labels UNION ALL SELECT doc_id AS id, 'documents' AS file, 2 AS pri FROM documents) AS x) AS y WHERE k = 1")
sql("set_intersect_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
sql("set_except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
sql("set_product", "SELECT m.lang AS model, t.r_name AS template, s.shot FROM (SELECT DISTINCT lang FROM documents) AS m CROSS JOIN region AS t CROSS JOIN (SELECT 0 AS shot UNION ALL SELECT 4 AS shot) AS s")


@plan
def set_jaccard_distance(d):
    a, b = d.distinct(d.split("lower(a.text)", " ")), d.distinct(d.split("lower(b.text)", " "))
    return f"SELECT conv_id, turn, round(1 - 1e0 * h / (x + y - h), 6) AS distance FROM (SELECT a.conv_id, a.turn, {d.size(d.both(a, b))} AS h, {d.size(a)} AS x, {d.size(b)} AS y FROM conversations AS a JOIN conversations AS b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) AS z"
