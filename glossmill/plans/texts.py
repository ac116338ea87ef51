"""Plans over texts, arrays and mixtures that are one statement for both engines (see catalog.py)."""

from __future__ import annotations

from .catalog import OPTIONS, plan, sql

Q = chr(39)


def lit(x: str) -> str:
    return Q + x + Q


# --- strings ---------------------------------------------------------------------------------------------------------
sql("txt_template_fill", "SELECT doc_id, replace(replace('Summarize {lang} text of {n} characters.', '{lang}', lang), '{n}', CAST(n_chars AS VARCHAR(20))) AS prompt FROM documents")
sql("txt_latex_row", "SELECT concat_ws(' & ', n_name, CAST(n_nationkey AS VARCHAR(20)), CAST(n_regionkey AS VARCHAR(20))) AS line FROM nation")


@plan
def txt_keyword_resplit(d):
    return f"SELECT p_partkey, kw FROM {d.unnest('part', d.split(d.sub('p_name', '[,./・、／]', ' '), ' '), '_p', 'kw', 'p_partkey')} AS x WHERE kw <> ''"


@plan
def txt_option_lines(d):
    return f"WITH {OPTIONS} SELECT request_id, {d.join_rows('concat(substring(' + lit('ABCDEFGHIJ') + ', CAST(option_id + 1 AS INT), 1), ' + lit('. ') + ', CAST(CAST(n_tok AS INT) AS VARCHAR(20)))', '; ', 'option_id')} AS lines FROM opt GROUP BY request_id"


@plan
def txt_first_line_trim(d):
    return f"SELECT conv_id, turn, lower(trim({d.at(d.split('text', chr(10)), '0')})) AS answer FROM conversations WHERE role = 'assistant'"


# --- arrays, maps, JSON ----------------------------------------------------------------------------------------------
sql("arr_wrong_mean", f"WITH {OPTIONS} SELECT request_id, round((sum(loss) - sum(CASE WHEN option_id = request_id % n_opt THEN loss ELSE 0 END)) / (max(n_opt) - 1), 4) AS wrong_mean FROM opt WHERE n_opt > 1 GROUP BY request_id")


@plan
def arr_explode_leaves(d):
    return "SELECT doc_id, 'title' AS path, lang AS leaf FROM documents UNION ALL SELECT doc_id, 'abstract' AS path, text AS leaf FROM documents"


@plan
def arr_nested_map(d):
    return f"SELECT p_partkey, {d.joined(d.map(d.split('p_name', ' '), 'w', 'upper(w)'), ' ')} AS name FROM part"


@plan
def arr_flatten_rewrites(d):
    return f"SELECT conv_id, {d.joined(d.collect('role', 'turn'), ',')} AS roles FROM conversations GROUP BY conv_id"


@plan
def map_by_language(d):
    return f"SELECT source, {d.join_rows('lang', ',', 'lang')} AS langs FROM (SELECT DISTINCT source, lang FROM documents) AS x GROUP BY source"


# --- mixtures, verification, retrieval, evaluation sets ---------------------------------------------------------------
sql("mix_repeat_weight", "SELECT source, CAST(round(sum(n_chars) * 1.5e0) AS BIGINT) AS tokens FROM documents GROUP BY source")


@plan
def sink_symlink_publish(d):
    shared = "(SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS n FROM lineitem WHERE l_quantity >= 1) AS shared"
    return f"SELECT l_orderkey AS experiment, slot, concat('data/', CAST(l_partkey AS VARCHAR(20))) AS path FROM {d.unnest(shared, d.numbers('0', 'n - 1'), '_p', 'slot', 'l_orderkey, l_partkey')} AS x"


@plan
def tokenize_count(d):
    return f"SELECT doc_id, {d.size(d.filter(d.split('text', ' '), 'w', 'w <> ' + lit('')))} AS num_tokens FROM documents"
