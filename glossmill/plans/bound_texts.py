"""Text, array and JSON operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cues as C
from ..functions import structure as S
from ..functions import texts as A
from ..operators.romanization import romanized
from . import planted
from .bound import bind

#: The first sentences of each document, as both engines read them.
PARTS = "SELECT doc_id, lang, text, split_part(text, '. ', 1) AS s1, split_part(text, '. ', 2) AS s2, split_part(text, '. ', 3) AS s3, split_part(text, '. ', 4) AS s4 FROM documents WHERE text IS NOT NULL"


@bind("txt_section_headings", f"WITH {planted.sections_oracle(PARTS)} SELECT doc_id, section, text FROM s")
def _(t):
    """Headings of all words and forms in three languages."""
    rows = t.sql(planted.abstracts(PARTS))
    return rows.select("doc_id", F.explode(C.section_spans(F.col("abstract"), F.col("lang"))).alias("x")).select("doc_id", "x.section", "x.text")


@bind("txt_conclusion_split", f"WITH {planted.concluded_oracle(planted.concluded(PARTS))} SELECT doc_id, left(text, n) AS before, substring(text, n + 1) AS conclusion FROM c")
def _(t):
    x = C.conclusion_split(F.col("text"), F.col("lang"))
    return t.sql(planted.concluded(PARTS)).select("doc_id", x.alias("x")).where("x IS NOT NULL").select("doc_id", "x.before", "x.conclusion")


_DUCK_SENTENCES = "list_filter(string_split(regexp_replace(regexp_replace({0}, '\\b(Dr|Mr|Mrs|Ms|Prof|Fig|No|vs|etc)\\.(\\s)', '\\1' || chr(2) || '\\2', 'g'), '([.!?]|' || chr(2) || '\\b\\B)\\s+|([。！？])', '\\1\\2' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"
#: Sentences in DuckDB: the full stops of abbreviations are hidden, ends are marked, and the text is cut at the marks.
SENTENCES = f"SELECT doc_id, list_transform({_DUCK_SENTENCES.format('text')}, lambda x: replace(x, chr(2), '.')) AS s FROM documents WHERE text IS NOT NULL"


@bind("txt_sentence_split", f"SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS pos, unnest(s) AS sentence FROM ({SENTENCES}) AS x")
def _(t):
    return t("documents").select("doc_id", F.posexplode(S.sentences(F.col("text"))).alias("pos", "sentence"))


#: Ends within quotations and asides, closed and not, as the parts a, b, c of words make them.
_QUOTED = {0: ["'「' || a || '。' || b || '！」と言う。'", "c || '？'"], 1: ["a || '。」'", "b || '（' || c || '。' || a || '）。'", "'（「' || b || '。」）' || c"], 2: ["'「' || a || '。'", "b || '！？'", "c || '）。'"]}
_QUOTED_TEXT = "CASE doc_id % 3 " + " ".join(f"WHEN {k} THEN {' || '.join(v)}" for k, v in _QUOTED.items()) + " END"
_QUOTED_PARTS = "CASE doc_id % 3 " + " ".join(f"WHEN {k} THEN [{', '.join(v)}]" for k, v in _QUOTED.items()) + " END"
_LETTERS = ", ".join(f"'x' || regexp_replace({s}, '[^\\p{{L}}]', '', 'g') AS {n}" for s, n in (("s1", "a"), ("s2", "b"), ("s3", "c")))


@bind("txt_sentence_split_cjk", f"SELECT doc_id, CAST(unnest(range(len(p))) AS INT) AS pos, unnest(p) AS sentence FROM (SELECT doc_id, {_QUOTED_PARTS} AS p FROM (SELECT doc_id, {_LETTERS} FROM ({PARTS}) AS q) AS r) AS s")
def _(t):
    """Japanese and Chinese ends do not cut within brackets that are closed."""
    letters = {n: F.concat(F.lit("x"), F.regexp_replace(s, r"[^\p{L}]", "")) for s, n in (("s1", "a"), ("s2", "b"), ("s3", "c"))}
    text = t.sql(PARTS).withColumns(letters).select("doc_id", F.expr(_QUOTED_TEXT).alias("text"))
    return text.select("doc_id", F.posexplode(C.sentences_cjk(F.col("text"))).alias("pos", "sentence"))


@bind("txt_sentence_split_lossless", "SELECT doc_id, CAST(1 + len(regexp_extract_all(regexp_replace(text, '[.!?][\"'')\\]]*\\s+$', ''), '[.!?][\"'')\\]]*\\s+|[。！？]')) - CASE WHEN regexp_replace(text, '[.!?][\"'')\\]]*\\s+$', '') LIKE '%。' THEN 1 ELSE 0 END AS BIGINT) AS n, true AS lossless FROM documents WHERE text <> ''")
def _(t):
    s = S.sentences_lossless(F.col("text"))
    return t("documents").where("text <> ''").select("doc_id", F.size(s).cast("bigint").alias("n"), (F.array_join(s, "") == F.col("text")).alias("lossless"))


def _causal(t, *langs: str) -> DataFrame:
    lang = F.expr(planted.LANG)
    rows = t("documents").where(lang.isin(list(langs))).select("doc_id", lang.alias("lang"), planted.cued(S.sentences(F.col("text")), F.col("doc_id"), lang).alias("s"))
    return rows.select("doc_id", F.inline(C.causal_pairs(F.col("s"), F.col("lang"))))


@bind("txt_causal_zh_ja", f"WITH {planted.causal_oracle(SENTENCES, ('zh', 'ja'))} SELECT doc_id, CAST(pos AS INT) AS pos, relation, a, b FROM c")
def _(t):
    """Sentences that begin with any cue of the two languages."""
    return _causal(t, "zh", "ja")


@bind("txt_causal_en", f"WITH {planted.causal_oracle(SENTENCES, ('en',))} SELECT doc_id, CAST(pos AS INT) AS pos, relation, a, b FROM c")
def _(t):
    """Cues at the beginning of a sentence, in any case, and within one after a comma."""
    return _causal(t, "en")


def _asked(n: int, answers: bool = True) -> str:
    """n questions with answers (or without), in a document's language, headed by its words."""
    q = planted.over(3)
    head = {
        "en": (f"CASE {q} % 2 WHEN 0 THEN 'Question {{k}}: ' ELSE '**Question**: ' END", f"CASE {q} % 2 WHEN 0 THEN 'Answer {{k}}: ' ELSE '**Answer**: ' END"),
        "zh": (f"'## {{k}}. ' || {planted.pick(S.QUESTIONS['zh'].split('|'), q)} || '：'", f"'# ' || {planted.pick(S.ANSWERS['zh'].split('|'), q)} || ' {{k}}: '"),
        "ja": (f"'### ' || CASE {q} % 2 WHEN 0 THEN '背景' ELSE '' END || {planted.pick(S.QUESTIONS['ja'].split('|'), q)} || '{{k}}：'", f"'###' || {planted.pick(S.ANSWERS['ja'].split('|'), q)} || '： '"),
    }
    each = []
    for lang, (question, answer) in head.items():
        rows = [f"{question.format(k=k)} || a || 'q{k}' || chr(10)" + (f" || {answer.format(k=k)} || b || 'a{k}' || chr(10)" if answers else "") for k in range(1, n + 1)]
        each.append(f"WHEN lang = '{lang}' THEN " + " || ".join(rows))
    return "CASE " + " ".join(each) + " END"


#: Responses as models give them: after thinking, in two blocks, plain with many and with few questions, with one, and without answers.
_RESPONSE = f"""CASE {planted.over(6)} % 6
  WHEN 0 THEN 'Question 1: none' || chr(10) || '</think>' || {_asked(2)} WHEN 1 THEN 'Sure.' || chr(10) || chr(10) || chr(10) || {_asked(3)}
  WHEN 2 THEN 'Here: ' || chr(10) || {_asked(5)} WHEN 3 THEN {_asked(2)} WHEN 4 THEN '</think>' || {_asked(1)} ELSE '</think>' || {_asked(2, False)} END"""


@bind(
    "txt_qa_parse",
    f"""WITH r AS (SELECT doc_id, lang, {planted.over(6)} % 6 AS form, b FROM (SELECT doc_id, {planted.LANG} AS lang, {_LETTERS} FROM ({PARTS}) AS q) AS x),
    n AS (SELECT *, CASE form WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN CASE WHEN lang = 'ja' THEN 2 ELSE 0 END ELSE 0 END AS pairs FROM r)
    SELECT doc_id, CASE WHEN form = 5 THEN 'answers' WHEN pairs = 0 THEN 'headings' END AS reject, CAST(pairs AS BIGINT) AS pairs, CASE WHEN pairs > 0 THEN b || 'a1' END AS first_answer, CASE WHEN pairs > 0 THEN b || 'a' || pairs END AS last_answer FROM n""",
)
def _(t):
    """Headings of three languages."""
    rows = t.sql(PARTS).withColumns({n: F.concat(F.lit("x"), F.regexp_replace(s, r"[^\p{L}]", "")) for s, n in (("s1", "a"), ("s2", "b"))})
    rows = rows.withColumn("lang", F.expr(planted.LANG)).withColumn("response", F.expr(_RESPONSE))
    x = rows.select("doc_id", S.qa_pairs(F.col("response"), F.col("lang")).alias("x"))
    answer = lambda i: F.try_element_at("x.qa", F.lit(i))["a"]
    return x.select("doc_id", "x.reject", F.size("x.qa").cast("bigint").alias("pairs"), answer(1).alias("first_answer"), answer(-1).alias("last_answer"))


#: Translations as JSON-like fields, as plain headings, and as neither.
TRANSLATED = f"""SELECT doc_id, s1, s2, CASE doc_id % 3 WHEN 0 THEN 'Here: {{"title": "' || s1 || '", "abstract": "' || s2 || '"}} done' WHEN 1 THEN 'Title: ' || s1 || chr(10) || 'Abstract: ' || s2 ELSE s1 END AS response FROM ({PARTS}) AS p WHERE s1 NOT LIKE '%"%' AND s2 NOT LIKE '%"%'"""


@bind("txt_translation_parse", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN s1 ELSE regexp_replace(s1, '^\\s+|\\s+$', '', 'g') END AS title, CASE WHEN doc_id % 3 = 0 THEN s2 ELSE regexp_replace(s2, '^\\s+', '') END AS abstract FROM ({TRANSLATED}) AS x WHERE doc_id % 3 < 2")
def _(t):
    x = t.sql(TRANSLATED).select("doc_id", S.translation_parts(F.col("response")).alias("x"))
    return x.where("x IS NOT NULL").select("doc_id", "x.title", "x.abstract")


_CLASSES = r"https?://[^\s]+|[A-Za-z0-9._]+@[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)+|[0-9]+(?:[.,][0-9]+)+%?|[0-9]+%?|(?:[A-Z]\.){2,}|\p{L}+(?:[''’]\p{L}+)+|\p{L}+(?:-\p{L}+)+|[\p{Han}\p{Hiragana}\p{Katakana}]|\p{L}+|\.\.\.|--+|[^\s\p{L}0-9]"


@bind("txt_word_tokenize", f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n_tokens, x[1] AS first_token, x[len(x)] AS last_token FROM (SELECT doc_id, regexp_extract_all(text, '{_CLASSES}') AS x FROM documents WHERE text IS NOT NULL) AS y")
def _(t):
    x = S.word_tokens(F.col("text"))
    return t("documents").where("text IS NOT NULL").select("doc_id", F.size(x).cast("bigint").alias("n_tokens"), F.get(x, F.lit(0)).alias("first_token"), F.try_element_at(x, F.lit(-1)).alias("last_token"))


@bind("txt_detokenize", r"SELECT item_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([a-z])\.([A-Z])', '\1. \2', 'g') AS text FROM benchmark WHERE regexp_matches(text, '^[\p{L} .,\n]*$') AND NOT regexp_matches(text, '^\s|\s$')")
def _(t):
    plain = t("benchmark").where(F.regexp_like("text", F.lit(r"^[\p{L} .,\n]*$")) & ~F.regexp_like("text", F.lit(r"^\s|\s$")))
    return plain.select("item_id", S.detokenized(S.word_tokens(F.col("text"))).alias("text"))


@bind("txt_char_class", "SELECT p_partkey, w, CASE WHEN regexp_matches(w, '^[a-z]+$') THEN 'English' WHEN w = '—' THEN 'Ja-Punctuation' WHEN w = '!?' THEN 'En-Punctuation' WHEN w IN ('日本', ' ') THEN 'Japanese' ELSE 'Other' END AS class FROM (SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), ['—', '!?', '日本', ' ', 'aé'])) AS w FROM part) AS x")
def _(t):
    words = F.concat(F.split("p_name", " "), F.array(*map(F.lit, ["—", "!?", "日本", " ", "aé"])))
    return t("part").select("p_partkey", F.explode(words).alias("w")).withColumn("class", S.char_class(F.col("w")))


@bind(
    "txt_locate_tokens",
    """WITH w AS (SELECT item_id, CAST(unnest(range(len(a))) AS INT) AS i, unnest(a) AS w FROM (SELECT item_id, string_split(text, ' ') AS a FROM benchmark) AS x),
    p AS (SELECT item_id, i, w, CAST(coalesce(sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM w)
    SELECT item_id, w AS token, start, CAST(start + length(w) AS INT) AS "end" FROM p WHERE w <> ''""",
)
def _(t):
    tokens = F.flatten(F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.array(w, F.lit("absent~"))))
    return t("benchmark").select("item_id", F.inline(S.located(F.col("text"), tokens)))


#: Kana for digits, with what they sound like: plain, with a small ya, doubled, and long.
_SOUNDS = [("きゃ", "kya"), ("しゅう", "shuu"), ("っち", "tchi"), ("ツ", "tsu"), ("ん", "n"), ("ふ", "fu"), ("コー", "koo"), ("じょ", "jo"), ("りょ", "ryo"), ("ヴ", "ヴ")]


def _spoken(number: str, k: int) -> str:
    out = f"CAST({number} AS VARCHAR(20))"
    for digit, x in enumerate(_SOUNDS):
        out = f"replace({out}, '{digit}', '{x[k]}')"
    return out


@bind("txt_romanize", f"SELECT o_orderkey, {_spoken('o_orderkey', 1)} AS text FROM orders")
def _(t):
    """Numbers written in kana, digit by digit, as they sound in Latin letters."""
    return t.sql(f"SELECT o_orderkey, {_spoken('o_orderkey', 0)} AS kana FROM orders").select("o_orderkey", A.romanize_column("kana").alias("text"))


#: Chinese words for the words of the parts' names, with their readings.
_CHINESE = {
    "ring": ("指环", "zhihuan"), "bolt": ("螺栓", "luoshuan"), "blue": ("蓝色", "lanse"), "cold": ("寒冷", "hanleng"), "new": ("崭新", "zhanxin"), "large": ("巨大", "juda"), "red": ("红色", "hongse"), "plate": ("板材", "bancai"),
    "rod": ("杆件", "ganjian"), "small": ("细小", "xixiao"), "gear": ("齿轮", "chilun"), "gizmo": ("器具", "qiju"), "anvil": ("铁砧", "tiezhen"), "hot": ("炎热", "yanre"), "old": ("陈旧", "chenjiu"), "widget": ("部件", "bujian"),
}


def _said(k: int, between: str) -> str:
    """A name's two words, a number, the second word and a full stop: in Chinese (0) or as they are read (1)."""
    word = lambda i: "CASE split_part(p_name, ' ', " + str(i) + ") " + " ".join(f"WHEN '{w}' THEN '{x[k]}'" for w, x in _CHINESE.items()) + " ELSE '' END"
    return f"{word(1)} || '{between}' || {word(2)} || '{between} A' || CAST(p_partkey AS VARCHAR(20)) || '，{between}' || {word(2)} || '。'"


@bind("txt_romanize_zh", f"SELECT p_partkey, {_said(1, ' ')} AS text FROM part WHERE length(p_name) > 0")
def _(t):
    """Words of two characters in a row; the lexicon has their characters, and pairs across words, with small weights."""
    words = [(w, r, 1000) for w, r in _CHINESE.values()]
    parts = [(c, f"x{i}", 2) for i, c in enumerate(sorted({c for w, _ in _CHINESE.values() for c in w}))]
    across = [(a[0][1] + b[0][0], "wrong", 3) for a in _CHINESE.values() for b in _CHINESE.values()]
    lexicon = t.spark.createDataFrame([*words, *parts, *across], "word string, reading string, weight int")
    rows = t.sql(f"SELECT p_partkey, {_said(0, '')} AS zh FROM part WHERE length(p_name) > 0")
    return romanized(rows, "zh", lexicon, "text").select("p_partkey", "text")


@bind("txt_nfkc", "SELECT item_id, text FROM benchmark")
def _(t):
    """Letters are written in full width first; normalised, the text is the same."""
    return t("benchmark").select("item_id", A.nfkc_column(F.translate("text", "abcdeABCDE,", "ａｂｃｄｅＡＢＣＤＥ，")).alias("text"))


#: A cloze of each text and an answer that is right in two cases of three.
CLOZES = "SELECT item_id, text, w, replace(text, w, '[BLANK]') AS cloze, CASE item_id % 3 WHEN 0 THEN w || 'x' ELSE w END AS answer FROM (SELECT item_id, text, split_part(text, ' ', 2) AS w FROM benchmark) AS x WHERE w <> ''"


@bind("txt_faithful_cloze", f"SELECT item_id, item_id % 3 <> 0 AS faithful FROM ({CLOZES}) AS x")
def _(t):
    return t.sql(CLOZES).select("item_id", F.contains(F.concat(F.lit("so: "), "text"), F.replace("cloze", F.lit("[BLANK]"), F.col("answer"))).alias("faithful"))


@bind("txt_blank_fill", "SELECT item_id, text AS filled, split_part(text, w, 1) AS context FROM (SELECT item_id, text, split_part(text, ' ', 2) AS w FROM benchmark) AS x WHERE w <> ''")
def _(t):
    return t.sql(CLOZES).select("item_id", F.replace("cloze", F.lit("[BLANK]"), F.col("w")).alias("filled"), F.substring_index("cloze", "[BLANK]", 1).alias("context"))


@bind(
    "txt_bio_to_spans",
    """WITH w AS (SELECT item_id, CAST(unnest(range(len(a))) AS INT) AS pos, unnest(a) AS w FROM (SELECT item_id, string_split(text, ' ') AS a FROM benchmark) AS x),
    g AS (SELECT item_id, pos, w, CASE WHEN length(w) % 5 = 1 THEN 1 WHEN length(w) % 5 = 2 THEN 2 ELSE 0 END AS tag FROM w),
    s AS (SELECT *, sum(CASE WHEN tag = 1 OR (tag = 2 AND before = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM (SELECT *, coalesce(lag(tag) OVER (PARTITION BY item_id ORDER BY pos), 0) AS before FROM g) AS y),
    e AS (SELECT item_id, run, string_agg(w, ' ' ORDER BY pos) AS entity FROM s WHERE tag > 0 GROUP BY item_id, run)
    SELECT b.item_id, coalesce(string_agg(e.entity, '|' ORDER BY e.run), 'none') AS entities FROM benchmark AS b LEFT JOIN e ON e.item_id = b.item_id GROUP BY b.item_id""",
)
def _(t):
    words = F.split("text", " ")
    tags = F.transform(words, lambda w: F.when(F.length(w) % 5 == 1, 1).when(F.length(w) % 5 == 2, 2).otherwise(0))
    return t("benchmark").select("item_id", F.array_join(S.bio_entities(words, tags), "|").alias("entities"))


@bind(
    "txt_edit_distance",
    """SELECT a.p_partkey, CAST(levenshtein(array_to_string(list_transform(a.w, lambda x: chr(CAST(64 + list_position(u, x) AS INT))), ''), array_to_string(list_transform(a.v, lambda x: chr(CAST(64 + list_position(u, x) AS INT))), '')) AS INT) AS distance
    FROM (SELECT x.p_partkey, string_split(x.p_name || ' ' || x.p_type, ' ') AS w, string_split(y.p_name || ' ' || y.p_type, ' ') AS v, list_distinct(string_split(x.p_name || ' ' || x.p_type || ' ' || y.p_name || ' ' || y.p_type, ' ')) AS u FROM part AS x JOIN part AS y ON y.p_partkey = x.p_partkey + 1) AS a""",
)
def _(t):
    pairs = t.sql("SELECT x.p_partkey, split(x.p_name || ' ' || x.p_type, ' ') AS a, split(y.p_name || ' ' || y.p_type, ' ') AS b FROM part AS x JOIN part AS y ON y.p_partkey = x.p_partkey + 1")
    return pairs.select("p_partkey", A.word_distance("a", "b").alias("distance"))


@bind(
    "abbrev_annotate",
    "SELECT doc_id, 'ABC' AS short, CASE WHEN doc_id % 2 = 0 THEN 'alpha beta gamma' ELSE 'gamma' END AS long FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'XY' AS short, 'extra yield' AS long FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0",
)
def _(t):
    """Each text is followed by abbreviations with their long forms; its own has none."""
    made = F.concat(F.translate("text", "()", "  "), F.when(F.col("doc_id") % 2 == 0, F.lit(". The alpha beta gamma (ABC) is. ")).otherwise(F.lit(". gamma (ABC) is. ")), F.when(F.col("doc_id") % 3 == 0, F.lit("An extra yield (XY).")).otherwise(F.lit("")))
    return t("documents").where("text IS NOT NULL").select("doc_id", F.inline(S.abbreviations(made)))


# --- arrays -------------------------------------------------------------------------------------------------------------
#: Losses and token counts of a request's options; some requests have an option without tokens.
_OPTIONS = "SELECT l_orderkey AS request_id, l_extendedprice AS loss, CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE l_quantity END AS n_tok, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity, l_partkey, l_suppkey) AS k FROM lineitem"


def _losses(t):
    every = t.sql(_OPTIONS).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("k", "loss", "n_tok"))).alias("o"))
    return every.select("request_id", F.transform("o", lambda x: x["loss"]).alias("losses"), F.transform("o", lambda x: x["n_tok"].cast("double")).alias("tokens"))


@bind("arr_argmin", f"SELECT request_id, CAST(first(k ORDER BY loss, k) - 1 AS INT) AS prediction FROM ({_OPTIONS}) AS x GROUP BY request_id")
def _(t):
    return _losses(t).select("request_id", S.argmin(F.col("losses")).alias("prediction"))


@bind("arr_norm_loss", f"SELECT request_id, CAST(CASE WHEN min(n_tok) = 0 THEN first(k ORDER BY loss, k) ELSE first(k ORDER BY loss / nullif(n_tok, 0), k) END - 1 AS INT) AS prediction, min(n_tok) = 0 AS raw FROM ({_OPTIONS}) AS x GROUP BY request_id")
def _(t):
    norm = S.norm_losses(F.col("losses"), F.col("tokens"))
    return _losses(t).select("request_id", S.normalized_argmin(F.col("losses"), F.col("tokens")).alias("prediction"), norm.isNull().alias("raw"))


@bind("arr_split_quartiles", f"SELECT doc_id, array_to_string(list_filter(s, lambda x, i: i > len(s) // 4 * 2 + least(len(s) % 4, 2)), '|') AS part34 FROM ({SENTENCES}) AS x")
def _(t):
    return t("documents").where("text IS NOT NULL").select("doc_id", F.array_join(S.quartile_parts(S.sentences(F.col("text")), "34"), "|").alias("part34"))


_U = "(CAST(('0x' || substr(md5({0}), 1, 8)) AS UBIGINT) / 4294967296.0)"


@bind("arr_prefix_suffix", f"WITH c AS (SELECT doc_id, s, 1 + CAST(floor({_U.format('CAST(doc_id AS VARCHAR)')} * (len(s) - 1)) AS INT) AS i FROM ({SENTENCES}) AS x WHERE len(s) >= 2) SELECT doc_id, array_to_string(s[1:i], ' ') AS prefix, array_to_string(s[i + 1:], ' ') AS suffix FROM c")
def _(t):
    return t("documents").select("doc_id", S.prefix_suffix(S.sentences(F.col("text")), F.col("doc_id")).alias("x")).where("x IS NOT NULL").select("doc_id", "x.prefix", "x.suffix")


@bind("join_token_id_align", "SELECT p_partkey, CAST(i - 1 AS INT) AS i, CAST(i AS INT) AS j FROM (SELECT p_partkey, unnest(range(1, CAST(length(p_name) AS BIGINT) + 1)) AS i FROM part) AS x")
def _(t):
    """The characters of a name, against the same with another one before them and one after."""
    a, b = F.split("p_name", ""), F.split(F.concat(F.lit("#"), "p_name", F.lit("!")), "")
    return t("part").select("p_partkey", F.inline(S.aligned(a, b)))


@bind("map_drop_zero_entries", "SELECT n_nationkey, md5('{\"key\":' || CAST(n_nationkey AS VARCHAR) || CASE WHEN n_regionkey = 0 THEN '' ELSE ',\"region\":' || CAST(n_regionkey AS VARCHAR) END || '}') AS recipe FROM nation WHERE n_nationkey > 0 UNION ALL SELECT n_nationkey, md5('{' || CASE WHEN n_regionkey = 0 THEN '' ELSE '\"region\":' || CAST(n_regionkey AS VARCHAR) END || '}') AS recipe FROM nation WHERE n_nationkey = 0")
def _(t):
    recipe = F.create_map(F.lit("key"), F.col("n_nationkey"), F.lit("none"), F.lit(0).cast("bigint"), F.lit("region"), F.col("n_regionkey"))
    return t("nation").select("n_nationkey", F.md5(F.to_json(F.map_filter(recipe, lambda _, v: v != 0))).alias("recipe"))


# --- JSON ---------------------------------------------------------------------------------------------------------------
@bind("json_first_block", "SELECT event_id, props AS block FROM events")
def _(t):
    return t("events").select("event_id", A.first_block_column(F.concat(F.lit("so } it is: "), "props", F.lit(' and {"k": 0}'))).alias("block"))


@bind("json_first_array_block", "SELECT event_id, '[' || props || ', [\"]\"]]' AS block FROM events")
def _(t):
    return t("events").select("event_id", A.first_array_column(F.concat(F.lit("] ["), "props", F.lit(', ["]"]] [1]'))).alias("block"))


#: Answers as models write them: fenced, with Python's and SQL's literals, with text around, and broken.
ANSWERS = """SELECT event_id, props, CASE event_id % 4
  WHEN 0 THEN '```json' || chr(10) || replace(props, '}', ', "ok": TRUE, "none": NULL}') || chr(10) || '```'
  WHEN 1 THEN 'The answer: ' || replace(props, '}', ', "ok": False, "said": "TRUE {"}') || ' as asked {'
  WHEN 2 THEN replace(props, '}', ', "ok": true}')
  ELSE replace(props, '}', '') END AS answer FROM events"""


@bind("json_robust_parse", f"SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 4 <> 1 AS ok, CASE WHEN event_id % 4 = 1 THEN 'TRUE {{' END AS said FROM ({ANSWERS}) AS x WHERE event_id % 4 < 3")
def _(t):
    x = t.sql(ANSWERS).select("event_id", F.from_json(A.robust_json_column("answer"), "k bigint, ok boolean, said string").alias("x"))
    return x.where("x IS NOT NULL").select("event_id", "x.k", "x.ok", "x.said")


@bind(
    "json_logprob_true_false",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'N' THEN 'true' WHEN 'R' THEN 'false' END AS value, CASE WHEN l_returnflag IN ('N', 'R') THEN 0 - l_discount END AS logprob FROM lineitem",
)
def _(t):
    """Tokens of an answer: the verdict stands after the pattern; for other flags both verdicts do, or none."""
    verdict = F.when(F.col("l_returnflag") == "N", " true").when(F.col("l_returnflag") == "R", "False").when(F.col("l_linenumber") % 2 == 0, "true").otherwise(" maybe")
    more = F.when(~F.col("l_returnflag").isin("N", "R") & (F.col("l_linenumber") % 2 == 0), "false").otherwise("}")
    tokens = F.array(F.lit("{"), F.lit("true"), F.lit('":'), verdict, F.lit("fact"), F.lit('":'), verdict, F.lit(","), F.lit("fact"), F.lit('":'), more)
    logs = F.array(*(F.lit(-9.0) if i != 6 else 0 - F.col("l_discount") for i in range(11)))
    said = F.explode(F.array(S.true_false(tokens, logs, ["fact", '":'])))  # a generator, so that it is not worked out for each field
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", said.alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("x.value").cast("string").alias("value"), "x.logprob")
