"""Registered queries: cleaning, quality, token budget, training sets, conversations, review."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import cleaning as C, text
from labelmill.operators import budget, conversations, quality, review, run_stats, sentences as learned, training
from labelmill.plans import views as V
from labelmill.plans.queries_text import sql_trim
from labelmill.plans.registry import query, rounded, table
from labelmill.session import spread

WORD, SPACE = text.WORD, text.SPACE
lit = lambda s: "'" + s.replace("'", "''") + "'"


def _sub(x, pattern, new, flags="g"):
    return f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, '{flags}')"


# DuckDB's expressions know neither look-around nor Unicode word boundaries. The SQL
# therefore marks each word with chr(1)..chr(2), matches marked words, and unmarks.
_mark = lambda x: f"regexp_replace({x}, '([{WORD}]+)', chr(1) || '\\1' || chr(2), 'g')"
_unmark = lambda x: f"replace(replace({x}, chr(1), ''), chr(2), '')"


def _marked_words(x, pairs):
    """Whole-word replacements; a pattern's parts are separate words."""
    x = _mark(x)
    for parts, new in pairs:
        x = f"regexp_replace({x}, '(?i)' || {parts}, {new}, 'g')"
    return _unmark(x)


_w = lambda word: f"chr(1) || {lit(word)} || chr(2)"


#: Put around every document for rules that the documents give nothing to do.
NOISE = " «Don't»  `stop´ – it's — we're ― 1,234 − 5k, 2 million  cats "


def _text_query(name, sql_of, step, source="documents", key="doc_id", column="text", noise=""):
    """``noise`` is put before and after each text, in both engines."""
    rows = f"(SELECT {key}, {lit(noise)} || {column} || {lit(noise)} AS {column} FROM {source})" if noise else source

    @query(name, f"SELECT {key}, {sql_of(column)} AS cleaned FROM {rows}" if sql_of else None)
    def _(spark, d):
        read = spread(table(spark, d, source)).select(key, column)
        if noise:
            read = read.withColumn(column, F.concat(F.lit(noise), column, F.lit(noise)))
        return read.select(key, step(F.col(column)).alias("cleaned"))


_text_query("c1_clean_html", None, C.clean_html, "pages", "page_id", "html")
_text_query("c2_fix_encoding", None, C.fix_encoding)
@query("c2_repair_encoding", "SELECT doc_id, text AS cleaned FROM documents")
def _(spark, d):
    """A third of the documents read once with a wrong character set, a third twice; every
    text comes back as it was."""
    docs = table(spark, d, "documents")
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    text, kind = F.col("text"), F.col("doc_id") % 3
    damaged = F.when(kind == 0, text).when(kind == 1, wrong(text)).otherwise(wrong(wrong(text)))
    return docs.select("doc_id", C.repair_encoding(damaged).alias("cleaned"))


_text_query("c3_normalize_unicode", None, C.normalize_unicode)
_text_query("c4_normalize_whitespace", lambda x: sql_trim(_sub(x, f"[{SPACE}]+", " ")), C.normalize_whitespace)
_text_query("c5_normalize_quotes", lambda x: f"translate({x}, '`´«»', {lit(chr(39) * 2 + chr(34) * 2)})", C.normalize_quotes, noise=NOISE)
_text_query("c6_normalize_dashes", lambda x: f"translate({x}, '–—―−', '----')", C.normalize_dashes, noise=NOISE)
_text_query("c7_squeeze_punctuation", lambda x: _sub(_sub(_sub(_sub(x, r"\.{3,}", "..."), "!{2,}", "!"), r"\?{2,}", "?"), "-{2,}", "--"), C.squeeze_punctuation)
_text_query("c8_fix_typos", lambda x: _marked_words(x, [(_w("teh"), "chr(1) || 'the' || chr(2)")] + [
    (f"{_w(w)} || '[{SPACE}]+' || {_w(w)}", _w(w)) for w in C.DOUBLED_WORDS]), C.fix_typos)
_URL = f"[^{SPACE}<>\"'{{}}|\\\\^`\\[\\]]+"
_text_query("c9_remove_urls", lambda x: _sub(x, f"https?://{_URL}|www\\.{_URL}", ""), C.remove_urls, "pages", "page_id", "html")


def _numbers_sql(x):
    x = _unmark(f"regexp_replace({_mark(x)}, chr(1) || '([\\p{{Nd}}]+)' || chr(2) || ',' || chr(1) || '([\\p{{Nd}}]{{3}})' || chr(2), chr(1) || '\\1\\2' || chr(2), 'g')")
    for unit, zeros in (("k", "000"), ("million", "000000")):
        x = f"regexp_replace({x}, '(?i)(\\p{{Nd}}+)[{SPACE}]*{unit}($|[^{WORD}])', '\\1{zeros}\\2', 'g')"
    return x


_text_query("c10_normalize_numbers", _numbers_sql, C.normalize_numbers, noise=NOISE)


def _contractions_sql(x):
    apostrophe = "chr(2) || '''' || chr(1)"
    y = _mark(x)
    for word, new in C.IRREGULAR_CONTRACTIONS.items():
        a, b = word.split("'")
        y = f"regexp_replace({y}, '(?i)' || chr(1) || '{a}' || {apostrophe} || '{b}' || chr(2), chr(1) || {lit(new)} || chr(2), 'g')"
    y = f"regexp_replace({y}, '(?i)' || chr(1) || '({'|'.join(C.IS_CONTRACTIONS)})' || {apostrophe} || 's' || chr(2), chr(1) || '\\1 is' || chr(2), 'g')"
    for ending, new in C.CONTRACTED_ENDINGS.items():
        a, b = ending.split("'")
        lead = f"'([{WORD}]){a}'"
        y = f"regexp_replace({y}, '(?i)' || {lead} || {apostrophe} || '{b}' || chr(2), '\\1{new}' || chr(2), 'g')"
    return _unmark(y)


_text_query("c11_expand_contractions", _contractions_sql, C.expand_contractions, noise=NOISE)
_text_query("c12_remove_special", lambda x: _sub(x, f"[^{WORD}{SPACE}.,!?;:()'\"/-]", ""), C.remove_special)
_text_query("c12_remove_special_all", lambda x: _sub(x, f"[^{WORD}{SPACE}]", ""), lambda c: C.remove_special(c, keep_basic=False))


def _fix_case_sql(x):
    calm = f"array_to_string(list_transform(regexp_extract_all({x}, '[{WORD}]+|[^{WORD}]+'), lambda t: CASE WHEN regexp_full_match(t, '[A-Z]{{4,}}') THEN substr(t, 1, 1) || lower(substr(t, 2)) ELSE t END), '')"
    cut = f"string_split(regexp_replace({calm}, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"
    up = "CASE WHEN substr(s, 1, 1) = 'ß' THEN 'SS' ELSE upper(substr(s, 1, 1)) END || substr(s, 2)"
    return f"array_to_string(list_transform(list_filter({cut}, lambda s: s <> ''), lambda s: {up}), ' ')"


_text_query("c13_fix_case", _fix_case_sql, C.fix_case)


@query("c14_squeeze_repeats", """WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
 runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch),
 pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c, g ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, c, g) AS n FROM runs)
 SELECT doc_id, string_agg(c, '' ORDER BY i) AS cleaned FROM pos WHERE c = chr(10) OR n < 4 OR k <= 2 GROUP BY doc_id""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", C.squeeze_repeats(F.col("text")).alias("cleaned"))


_text_query("c15_emoji_to_name", None, C.emoji_to_name)
_TOKENS = lambda x: f"regexp_extract_all({x}, '[{WORD}]+(?:''[{WORD}]+)?|[^{WORD}{SPACE}]')"
_STOP = ", ".join(lit(w) for w in C.STOPWORDS["english"])
_text_query("c16_remove_stopwords", lambda x: f"array_to_string(list_filter({_TOKENS(x)}, lambda t: lower(t) NOT IN ({_STOP})), ' ')", C.remove_stopwords)
_text_query("c17_stem", None, C.stem_text)


@query("c18_lemmatize", f"""WITH lem AS (SELECT DISTINCT lower(t) AS word, '*' || lower(t) AS lemma FROM (SELECT unnest({_TOKENS('text')}) AS t FROM benchmark) WHERE length(t) > 2),
 tok AS (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {_TOKENS('text')} AS t FROM documents))
 SELECT doc_id, string_agg(coalesce(lemma, t), ' ' ORDER BY i) AS cleaned FROM tok LEFT JOIN lem ON lower(t) = word GROUP BY doc_id""")
def _(spark, d):
    """The lemma table is made of the benchmark's words, marked with a star."""
    all_words = F.explode(F.transform(text.tokens(F.col("text")), F.lower)).alias("word")
    lemmas = table(spark, d, "benchmark").select(all_words).filter(F.length("word") > 2).distinct()
    lemmas = lemmas.withColumn("lemma", F.concat(F.lit("*"), "word"))
    out = C.lemmatize(spread(table(spark, d, "documents").select("doc_id", "text")), "text", lemmas, "doc_id")
    return out.select("doc_id", F.col("text").alias("cleaned"))


_text_query("c19_remove_punctuation", lambda x: f"translate({x}, {lit(C.PUNCTUATION)}, '')", C.remove_punctuation)


@query("c20_lower_upper", "SELECT doc_id, lower(text) AS low, replace(upper(replace(text, 'ß', 'SS')), 'ẞ', 'SS') AS up FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", C.STEPS["to_lowercase"](F.col("text")).alias("low"), C.STEPS["to_uppercase"](F.col("text")).alias("up"))


_LOWWORDS = f"regexp_extract_all(lower(regexp_replace(text, '[^{WORD}{SPACE}]', '', 'g')), '[^{SPACE}]+')"
_hits = ", ".join(f"len(list_filter(w, lambda t: t IN ({', '.join(lit(x) for x in p)}))) AS {lang}" for lang, p in C.LANGUAGE_PROFILES.items())
_LANG = f"""(SELECT *, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr'
  WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS detected FROM (SELECT doc_id, text, {_hits} FROM (SELECT doc_id, text, {_LOWWORDS} AS w FROM documents)))"""


@query("c21_detect_language", f"SELECT doc_id, detected, CASE WHEN detected = 'en' THEN text ELSE '' END AS kept FROM {_LANG}")
def _(spark, d):
    docs = spread(table(spark, d, "documents")).withColumn("detected", C.detect_language(F.col("text")))
    return docs.select("doc_id", "detected", F.when(F.col("detected") == "en", F.col("text")).otherwise("").alias("kept"))


_text_query("c21_filter_language", lambda x: f"(SELECT CASE WHEN detected = 'de' THEN l.text ELSE '' END FROM {_LANG} l WHERE l.doc_id = documents.doc_id)", lambda c: C.filter_language(c, "de"))
_text_query("c22_remove_digits", lambda x: _sub(x, r"\p{Nd}+", ""), C.remove_digits)
_text_query("c23_remove_single_chars", lambda x: _unmark(f"regexp_replace({_mark(x)}, chr(1) || '[{WORD}]' || chr(2), '', 'g')"), C.remove_single_chars)
_text_query("c24_strip_accents", None, C.strip_accents)
_text_query("c25_extra_spaces", lambda x: sql_trim(_sub(x, f"[{SPACE}]{{2,}}", " ")), C.extra_spaces, noise=NOISE)
_text_query("c26_sentence_join", lambda x: f"array_to_string(list_transform(string_split(regexp_replace({x}, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {sql_trim('s')}), ' ')", C.sentence_join)
@query("c26_abbreviations", """WITH t AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\\p{L}+(?:\\.\\p{L}+)*\\.?')) AS t FROM documents),
 c AS (SELECT lower(rtrim(t, '.')) AS word, count(*) FILTER (t LIKE '%.') AS stopped, count(*) FILTER (t NOT LIKE '%.') AS bare FROM t GROUP BY 1),
 r AS (SELECT sum(stopped) / (sum(stopped) + sum(bare)) AS r FROM c), s AS (SELECT *, CAST(length(replace(word, '.', '')) AS DOUBLE) AS size FROM c, r WHERE stopped > 0)
 SELECT word, stopped, bare, round(2 * ((stopped * ln(0.99) + bare * ln(1 - 0.99)) - (stopped * ln(r) + bare * ln(1 - r))) * exp(-size) * (length(word) - size + 1) * size ** (-bare), 6) AS score FROM s""")
def _(spark, d):
    """Evidence that a word of the documents is an abbreviation."""
    return rounded(learned.abbreviation_scores(spread(table(spark, d, "documents"))))


_WORDS = lambda x: f"regexp_extract_all({x}, '[^{SPACE}]+')"
_text_query("c27_drop_short_words", lambda x: f"array_to_string(list_filter({_WORDS(x)}, lambda t: length(t) >= 3), ' ')", lambda c: C.drop_short_words(c, 3))
_text_query("c27_drop_long_words", lambda x: f"array_to_string(list_filter({_WORDS(x)}, lambda t: length(t) <= 12), ' ')", lambda c: C.drop_long_words(c, 12))
_text_query("c28_domain_abbreviations", lambda x: _marked_words(x, [(_w(k), _w(v)) for k, v in C.DOSAGE_TERMS.items()]), C.expand_dosage_terms)


@query("c29_clean_text")
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return C.clean_text(docs, options={"remove_urls": True, "normalize_numbers": True, "fix_case": True, "remove_short_words": True})


@query("c29_clean_pages")
def _(spark, d):
    return C.clean_text(spread(table(spark, d, "pages").select("page_id", "html")), "html", options={"to_lowercase": True, "remove_punctuation": True})


def _profile_sql(x, prefix=""):
    valid = f"FILTER (length({x}) > 0)"
    mean = lambda e: f"round(coalesce(sum({e}) {valid} / CAST(nullif(count(*) {valid}, 0) AS DOUBLE), 0), 6)"
    cols = {
        "total_items": "count(*)", "valid_items": f"count(*) {valid}", "empty_items": f"count(*) - count(*) {valid}", "avg_length": mean(f"length({x})"),
        "avg_words": mean(f"len({_WORDS(x)})"), "avg_special_chars": mean(f"length(regexp_replace({x}, '[{WORD}{SPACE}]+', '', 'g'))"),
        "items_with_urls": f"count(*) FILTER (regexp_matches({x}, 'https?://[^{SPACE}]'))",
        "min_length": f"CAST(coalesce(min(length({x})) {valid}, 0) AS BIGINT)", "max_length": f"CAST(coalesce(max(length({x})) {valid}, 0) AS BIGINT)",
    }
    return ", ".join(f"{v} AS {prefix}{k}" for k, v in cols.items())


@query("c30_quality_profile", f"SELECT {_profile_sql('text')} FROM documents")
def _(spark, d):
    return rounded(quality.quality_profile(spread(table(spark, d, "documents").select("text")), "text"))


@query("c31_before_after", f"""WITH t AS (SELECT html AS a, {_sub('html', f'https?://{_URL}|www\\.{_URL}', '')} AS b FROM pages), p AS (SELECT {_profile_sql('a', 'before_')}, {_profile_sql('b', 'after_')},
  avg(length(a)) AS la, avg(length(b)) AS lb, avg(length(regexp_replace(a, '[{WORD}{SPACE}]+', '', 'g'))) AS sa, avg(length(regexp_replace(b, '[{WORD}{SPACE}]+', '', 'g'))) AS sb FROM t)
 SELECT * EXCLUDE (la, lb, sa, sb), round((lb - la) / la * 100, 6) AS avg_length_change, round((sb - sa) / sa * 100, 6) AS avg_special_chars_change,
 before_items_with_urls - after_items_with_urls AS urls_removed, after_empty_items - before_empty_items AS empty_change FROM p""")
def _(spark, d):
    pages = spread(table(spark, d, "pages").select("html")).select(F.col("html").alias("a"), C.remove_urls(F.col("html")).alias("b"))
    return rounded(quality.before_after(pages, "a", "b"))


@query("c32_backup_original", f"SELECT doc_id, text AS text_original, {sql_trim(_sub(sql_trim(_sub('text', f'[{SPACE}]+', ' ')), f'[{SPACE}]{{2,}}', ' '))} AS text FROM documents")
def _(spark, d):
    return C.clean_text(table(spark, d, "documents").select("doc_id", "text"), steps=["normalize_whitespace"], backup=True)


@query("e7_clean_for_display", f"SELECT doc_id, {sql_trim(_sub('text', f'[{SPACE}]+', ' '))} AS shown FROM documents")
def _(spark, d):
    from labelmill.operators.error_analysis import clean_for_display

    return table(spark, d, "documents").select("doc_id", clean_for_display(F.col("text")).alias("shown"))


@query("e8_missing_values", f"""SELECT row_index, coalesce(lower(final_answer) IN ('nan', 'null', 'none', '', 'n/a'), true) AS missing,
  CASE WHEN NOT coalesce(lower(final_answer) IN ('nan', 'null', 'none', '', 'n/a'), true) THEN trim(final_answer) END AS safe FROM ({V.JUDGED_SQL})""")
def _(spark, d):
    c = F.col("final_answer")
    return V.judged(spark, d).select("row_index", text.is_missing(c).alias("missing"), text.safe_text(c).alias("safe"))


# ---- token budget -------------------------------------------------------------------

SYSTEM, ASK = "You are a careful reader.", "Classify the text: {text} . Answer briefly"
_n = lambda x: f"len({_WORDS(x)})"
COUNTED = f"""WITH t AS (SELECT doc_id, source, lang, CAST(floor({_n('text')} * 1.3) AS BIGINT) AS text_tokens,
  CAST(floor({_n(lit(SYSTEM + ' Classify the text: ') + " || text || " + lit(' . Answer briefly'))} * 1.3) AS BIGINT) AS request_tokens FROM documents)"""
_counted = lambda spark, d: budget.count_tokens(spread(table(spark, d, "documents").select("doc_id", "text")), "text", SYSTEM, ASK)


@query("b1_count_tokens", f"{COUNTED} SELECT doc_id, text_tokens, request_tokens FROM t")
def _(spark, d):
    return _counted(spark, d).select("doc_id", "text_tokens", "request_tokens")


def _stat_sql(points):
    p = ", ".join(f"round(quantile_cont(tokens, {i / 100}), 6) AS p{i}" for i in points)
    return f"round(avg(tokens), 6) AS mean, round(stddev_pop(tokens), 6) AS std, min(tokens) AS min, max(tokens) AS max, {p}"


@query("b2_token_stats", f"""{COUNTED}, u AS (SELECT 'text' AS field, text_tokens AS tokens FROM t UNION ALL SELECT 'request', request_tokens FROM t)
 SELECT field, {_stat_sql(budget.TEXT_POINTS)}, round(quantile_cont(tokens, 0.75) - quantile_cont(tokens, 0.25), 6) AS iqr FROM u GROUP BY field""")
def _(spark, d):
    return rounded(budget.token_stats(_counted(spark, d)))


@query("b3_field_stats", f"""WITH u AS (SELECT 'text' AS field, CAST({_n('text')} AS BIGINT) AS tokens FROM documents UNION ALL SELECT 'source', CAST({_n('source')} AS BIGINT) FROM documents)
 SELECT field, {_stat_sql(budget.FIELD_POINTS)}, count(*) AS valid, (SELECT count(*) FROM documents) AS total FROM u WHERE tokens > 0 GROUP BY field""")
def _(spark, d):
    return rounded(budget.field_stats(spread(table(spark, d, "documents").select("text", "source")), ["text", "source"]))


@query("b4_budget_summary", f"""{COUNTED} SELECT CAST(sum(request_tokens) AS BIGINT) AS total_tokens, round(avg(request_tokens), 6) AS avg_tokens, count(*) FILTER (request_tokens > 1000) AS above_1000,
 count(*) FILTER (request_tokens > 2000) AS above_2000, count(*) FILTER (request_tokens > 4000) AS above_4000, CAST(0 AS BIGINT) AS missing_text FROM t""")
def _(spark, d):
    return rounded(budget.budget_summary(_counted(spark, d)))


@query("b5_request_prompt", "SELECT doc_id, 'Read: ' || text || ' now' AS with_slot, 'Read: ' || text AS with_field, 'Read this ' || text AS appended FROM documents")
def _(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", budget.user_prompt("Read: {text} now", "body", c).alias("with_slot"), budget.user_prompt("Read: {body}", "body", c).alias("with_field"),
        budget.user_prompt("Read this", "body", c).alias("appended"),
    )


_COST = "(strlen(text) // 4 + 10)"


@query("b6_estimate_tokens", f"SELECT conv_id, CAST(sum({_COST}) AS BIGINT) AS estimated_tokens, count(*) AS messages FROM conversations GROUP BY 1")
def _(spark, d):
    return budget.conversation_tokens(table(spark, d, "conversations"))


# ---- training sets ------------------------------------------------------------------

MAPPING = {"q1t0": "good", "q0t0": "weak"}
PREPARED = f"""SELECT doc_id, text, CASE label WHEN 'q1t0' THEN 'good' WHEN 'q0t0' THEN 'weak' ELSE label END AS label FROM ({V.TRAINING_SQL}) WHERE label IS NOT NULL AND text IS NOT NULL"""
_prepared = lambda spark, d: training.prepare_labels(V.training_rows(spark, d), "text", "label", MAPPING, ["doc_id"])
_HASH = "md5('42:' || CAST(doc_id AS VARCHAR))"


@query("d1_prepare_labels", PREPARED)
def _(spark, d):
    return _prepared(spark, d)


@query("d2_sample_balanced", f"""WITH t AS ({PREPARED}), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH}) AS i FROM t),
 s AS (SELECT doc_id, label FROM k WHERE i <= greatest(1, 60 // (SELECT count(DISTINCT label) FROM t))) SELECT doc_id, label FROM (SELECT *, row_number() OVER (ORDER BY {_HASH}) AS j FROM s) WHERE j <= 60""")
def _(spark, d):
    return training.sample_balanced(_prepared(spark, d).select("doc_id", "label"), "doc_id", "label", 60)


@query("d3_sample_proportional", f"""WITH t AS ({PREPARED}), c AS (SELECT label, greatest(1, CAST(floor(60 * (count(*) / CAST((SELECT count(*) FROM t) AS DOUBLE))) AS BIGINT)) AS q FROM t GROUP BY 1),
 k AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH}) AS i FROM t) SELECT doc_id, k.label FROM k JOIN c ON k.label = c.label WHERE i <= q""")
def _(spark, d):
    return training.sample_proportional(_prepared(spark, d).select("doc_id", "label"), "doc_id", "label", 60)


@query("d4_sample_random", f"WITH t AS ({PREPARED}) SELECT doc_id, label FROM (SELECT *, row_number() OVER (ORDER BY {_HASH}) AS i FROM t) WHERE i <= 50")
def _(spark, d):
    return training.sample_random(_prepared(spark, d).select("doc_id", "label"), "doc_id", 50)


SPLIT = f"WITH t AS ({PREPARED}), s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {_HASH}) <= floor((SELECT count(*) FROM t) * 0.2) THEN 'eval' ELSE 'train' END AS split FROM t)"
_split = lambda spark, d: training.train_eval_split(_prepared(spark, d), "doc_id", 0.2)


@query("d5_train_eval_split", f"{SPLIT} SELECT doc_id, split FROM s")
def _(spark, d):
    return _split(spark, d).select("doc_id", "split")


@query("d6_class_weights", f"""WITH t AS ({PREPARED}), n AS (SELECT CAST(count(*) AS DOUBLE) AS r, count(DISTINCT label) AS k FROM t)
 SELECT label, count(*) AS items, round(count(*) / max(r) * 100, 6) AS percentage, round(max(r) / (max(k) * count(*)), 6) AS weight FROM t, n GROUP BY label""")
def _(spark, d):
    return rounded(training.class_weights(_prepared(spark, d), "label"))


@query("d7_instruction_pairs", f"WITH t AS ({PREPARED}) SELECT doc_id, 'Judge: ' || text || ' Hint: ' || label AS instruction, label AS output FROM t")
def _(spark, d):
    return training.instruction_pairs(_prepared(spark, d), "Judge: {text} Hint: {control}", "text", "label").select("doc_id", "instruction", "output")


@query("d8_chat_text", f"WITH t AS ({PREPARED}) SELECT doc_id, '<|im_start|>user' || chr(10) || 'Judge: ' || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || label || '<|im_end|>' AS chat FROM t")
def _(spark, d):
    return training.chat_text(training.instruction_pairs(_prepared(spark, d), "Judge: {text}", "text", "label")).select("doc_id", "chat")


@query("d9_training_metadata", f"""{SPLIT}, c AS (SELECT label, count(*) AS n FROM s GROUP BY 1) SELECT (SELECT count(*) FROM s) AS total_samples, (SELECT count(*) FROM s WHERE split = 'train') AS training_samples,
 (SELECT count(*) FROM s WHERE split = 'eval') AS eval_samples, count(*) AS unique_labels, '{{' || string_agg('"' || label || '":' || n, ',' ORDER BY label) || '}}' AS label_distribution, '{{"epochs": 3}}' AS settings FROM c""")
def _(spark, d):
    return training.training_metadata(_split(spark, d), "split", "label", {"epochs": 3})


# ---- conversations ------------------------------------------------------------------

_ROWS = lambda spark, d: table(spark, d, "conversations")


@query("x1_build_conversation", """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS lines, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_content, count(*) AS message_count FROM conversations GROUP BY 1""")
def _(spark, d):
    b = conversations.build_conversation(_ROWS(spark, d))
    line = lambda m: F.concat(m["role"], F.lit(": "), m["content"])
    return b.select("conv_id", F.array_join(F.transform("messages", line), "\n").alias("lines"), "last_role", "last_content", "message_count")


@query("x1_last_message", "SELECT conv_id, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_content, count(*) AS message_count FROM conversations GROUP BY 1")
def _(spark, d):
    return conversations.last_message(_ROWS(spark, d))


def _chat(name):
    t = conversations.CHAT_TEMPLATES[name]
    q = lambda s: lit(s).replace("\n", "' || chr(10) || '")
    tail = f"CASE WHEN turn < last THEN {q(t['assistant'][1])} ELSE '' END"
    one = f"CASE role WHEN 'system' THEN {q(t['system'][0])} || text || {q(t['system'][1])} WHEN 'user' THEN {q(t['user'][0])} || text || {q(t['user'][1])} WHEN 'assistant' THEN {q(t['assistant'][0])} || text || {tail} ELSE '' END"

    @query(f"x2_format_chat_{name}", f"SELECT conv_id, {q(t['bos'])} || string_agg({one}, '' ORDER BY turn) AS chat FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id")
    def _(spark, d):
        return conversations.format_chat(_ROWS(spark, d), name)


for _name in conversations.CHAT_TEMPLATES:
    _chat(_name)

_BROKEN = """SELECT conv_id, turn, CASE (conv_id + turn) % 9 WHEN 0 THEN 'tool' WHEN 1 THEN 'robot' WHEN 2 THEN '' ELSE role END AS role, CASE WHEN (conv_id + turn) % 9 = 3 THEN '' ELSE text END AS text FROM conversations"""
_ERROR = f"""SELECT conv_id, turn, CASE WHEN role = '' THEN 'message role cannot be empty' WHEN role NOT IN ('system', 'user', 'assistant', 'tool', 'function') THEN 'invalid message role: ' || role
  WHEN text = '' THEN 'message content cannot be empty unless it has tool calls' WHEN role = 'tool' THEN 'tool messages must have a tool_call_id' END AS error FROM ({_BROKEN})"""


def _broken(spark, d):
    k = (F.col("conv_id") + F.col("turn")) % 9
    role = F.when(k == 0, "tool").when(k == 1, "robot").when(k == 2, "").otherwise(F.col("role"))
    return _ROWS(spark, d).withColumn("role", role).withColumn("text", F.when(k == 3, "").otherwise(F.col("text")))


@query("x3_validate_message", _ERROR)
def _(spark, d):
    return conversations.validate_messages(_broken(spark, d)).select("conv_id", "turn", "error")


@query("x4_validate_conversation", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM ({_ERROR}))
 SELECT conv_id, count(*) AS messages, 'message ' || min(pos) FILTER (error IS NOT NULL) || ': ' || arg_min(error, pos) FILTER (error IS NOT NULL) AS error FROM e GROUP BY 1""")
def _(spark, d):
    return conversations.validate_conversations(_broken(spark, d))


@query("x5_truncate_conversation", f"""WITH c AS (SELECT *, {_COST} AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations), l AS (SELECT conv_id, tokens AS spent FROM c WHERE pos = 1 AND role = 'system'),
 r AS (SELECT c.*, sum(tokens) OVER (PARTITION BY c.conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) + coalesce(spent, 0) AS s FROM c LEFT JOIN l ON c.conv_id = l.conv_id WHERE NOT (pos = 1 AND role = 'system'))
 SELECT conv_id, turn, role, text, tokens FROM r WHERE s <= 400 UNION ALL SELECT conv_id, turn, role, text, tokens FROM c WHERE pos = 1 AND role = 'system'""")
def _(spark, d):
    return conversations.truncate_conversations(_ROWS(spark, d), 400)


@query("x6_conversation_json", """SELECT conv_id, '[' || string_agg(CAST(json_object('role', role, 'content', text) AS VARCHAR), ',' ORDER BY turn) || ']' AS json, count(*) AS parsed_messages, arg_min(text, turn) AS first_text FROM conversations GROUP BY 1""")
def _(spark, d):
    j = conversations.build_conversation(_ROWS(spark, d)).select("conv_id", conversations.conversation_json(F.col("messages")).alias("json"))
    back = j.withColumn("m", conversations.conversation_from_json(F.col("json")))
    return back.select("conv_id", "json", F.size("m").cast("long").alias("parsed_messages"), F.col("m")[0]["content"].alias("first_text"))


@query("x7_text_content", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS content FROM conversations")
def _(spark, d):
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    null, c = F.lit(None).cast("string"), F.col("text")
    parts = F.when(F.col("turn") % 3 == 0, F.array(part("image_url", null), part("text", c), part("text", F.lit("later")))).when(
        F.col("turn") % 3 == 1, F.array(part("text", c))).otherwise(F.array(part("image_url", null)))
    return _ROWS(spark, d).select("conv_id", "turn", conversations.text_content(parts).alias("content"))


# ---- review -------------------------------------------------------------------------

VERDICTS = "SELECT doc_id AS row_index, quality = 1 AS verdict FROM labels"
_REVIEWED = f"SELECT d.doc_id, d.source, v.verdict FROM documents d LEFT JOIN ({VERDICTS}) v ON d.doc_id = v.row_index"


def _reviewed(spark, d):
    verdicts = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("verdict"))
    return review.apply_verdicts(table(spark, d, "documents"), verdicts, "doc_id")


@query("g1_apply_verdicts", _REVIEWED)
def _(spark, d):
    return _reviewed(spark, d).select("doc_id", "source", "verdict")


@query("g1_pending_reviews", f"SELECT doc_id FROM ({_REVIEWED}) WHERE verdict IS NULL")
def _(spark, d):
    return review.pending(_reviewed(spark, d)).select("doc_id")


@query("g2_verification_summary", f"""SELECT count(verdict) AS verified, count(*) AS total, count(*) FILTER (verdict) AS correct,
 round(count(*) FILTER (verdict) / CAST(count(verdict) AS DOUBLE) * 100, 6) AS accuracy FROM ({_REVIEWED})""")
def _(spark, d):
    return rounded(review.verification_summary(_reviewed(spark, d)))
