"""Registered queries: prompts, requests, replies, model calls, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.functions import parsing, requests, templates, text
from labelmill.operators import infer
from labelmill.plans import views as V
from labelmill.plans.registry import query, rounded, table

WORD, SPACE = text.WORD, text.SPACE
sql_trim = lambda x: f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"

# ---- prompts ------------------------------------------------------------------------

TEMPLATE = "Rate {TEXT} from {source} ({Lang}/{lang}), item {index} of {unknown}: {n_chars} {text}"
_docs = lambda spark, d: table(spark, d, "documents").withColumn("row_index", F.col("doc_id"))


@query("p1_render_prompt", """SELECT doc_id, 'Rate ' || text || ' from ' || source || ' ({Lang}/' || lang || '), item ' || doc_id || ' of {unknown}: ' || n_chars || ' ' || text AS prompt FROM documents""")
def _(spark, d):
    df = _docs(spark, d)
    return df.select("doc_id", templates.render_prompt(df.schema, TEMPLATE).alias("prompt"))


@query("p1_render_numbers", """SELECT o_orderkey, 'Order ' || o_orderkey || ' costs ' || printf('%.2f', o_totalprice) || ', open: ' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END
  || ', words: ' || array_to_string(string_split(o_orderpriority, '-'), ', ') AS prompt FROM orders""")
def _(spark, d):
    df = table(spark, d, "orders").withColumn("open", F.col("o_orderstatus") == "O").withColumn("words", F.split("o_orderpriority", "-"))
    return df.select("o_orderkey", templates.render_prompt(df.schema, "Order {o_orderkey} costs {O_TOTALPRICE}, open: {open}, words: {words}", "none", "none").alias("prompt"))


@query("p2_render_nested", "SELECT doc_id, lang || ' / ' || source || ' / lang: ' || lang || ', size: ' || n_chars || ' / ' || n_chars AS prompt FROM documents")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", "source", F.struct("lang", F.col("n_chars").alias("size")).alias("meta"))
    return df.select("doc_id", templates.render_prompt(df.schema, "{meta.lang} / {source} / {meta} / {size}").alias("prompt"))


@query("p3_placeholder_map", "SELECT doc_id, 'Review: ' || text || ' in ' || lang AS prompt FROM documents")
def _(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", templates.render_prompt(df.schema, "Review: {REVIEW} in {LANGUAGE}", placeholder_map={"REVIEW": "text", "LANGUAGE": "lang"}).alias("prompt"))


@query("p4_input_text", "SELECT doc_id, lang AS mapped, text AS from_template, source AS fallback FROM documents")
def _(spark, d):
    df = table(spark, d, "documents")
    pick = lambda t, **k: templates.input_text(df.schema, t, **k)
    return df.select(
        "doc_id", pick("{text}", mapped="lang", output_field="source").alias("mapped"), pick("See {TEXT}").alias("from_template"),
        pick("{other}", mapped="absent", fallback="source").alias("fallback"),
    )


@query("p5_ground_truth", f"SELECT doc_id, coalesce(CAST(quality AS VARCHAR), '') AS truth, '' AS unset FROM ({V.LABELLED_SQL})")
def _(spark, d):
    df = V.labelled(spark, d)
    return df.select("doc_id", templates.ground_truth(df.schema, "quality").alias("truth"), templates.ground_truth(df.schema, None).alias("unset"))


@query("p6_normalize_label", f"SELECT doc_id, {sql_trim('chr(9) || text || chr(10)')} AS label FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_label(F.concat(F.lit("\t"), "text", F.lit("\n"))).alias("label"))


@query("p7_build_messages", """SELECT doc_id, 'system' AS role_1, 'Be brief.' AS content_1, 'user' AS role_2, 'Q: ' || text AS content_2 FROM documents""")
def _(spark, d):
    m = requests.build_messages("Be brief.", F.concat(F.lit("Q: "), "text"))
    return table(spark, d, "documents").select("doc_id", m.alias("m")).select(
        "doc_id", F.col("m")[0]["role"].alias("role_1"), F.col("m")[0]["content"].alias("content_1"),
        F.col("m")[1]["role"].alias("role_2"), F.col("m")[1]["content"].alias("content_2"),
    )


PARAMS = {"temperature": 0.7, "max_tokens": 64, "top_p": 0.9, "n": 1, "repetition_penalty": 1.1, "seed": 7, "stop": ["END", "\n\n"], "enable_thinking": False, "guided_choice": ["a", "b"]}
_MESSAGES = "json_array(json_object('role', 'system', 'content', 'Be brief.'), json_object('role', 'user', 'content', text))"
_STOP = "json_array('END', chr(10) || chr(10))"
_messages = lambda: requests.build_messages("Be brief.", F.col("text"))


@query("p8_request_vllm", f"""SELECT doc_id, CAST(json_object('messages', {_MESSAGES}, 'stream', false, 'temperature', 0.7, 'max_tokens', 64, 'top_p', 0.9, 'n', 1, 'repetition_penalty', 1.1,
  'stop', {_STOP}, 'extra_body', json_object('chat_template_kwargs', json_object('enable_thinking', false)), 'guided_choice', json_array('a', 'b')) AS VARCHAR) AS request FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", requests.build_request("vllm", _messages(), PARAMS, flashinfer_safe=True).alias("request"))


@query("p9_request_llamacpp_flat", f"""SELECT doc_id, CAST(json_object('prompt', 'system: Be brief.' || chr(10) || 'user: ' || text || chr(10) || 'assistant: ', 'stream', false, 'temperature', 0.7, 'n_predict', 64,
  'top_p', 0.9, 'repeat_penalty', 1.1, 'seed', 7, 'stop', {_STOP}, 'n_choices', 1) AS VARCHAR) AS request FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", requests.build_request("llamacpp", _messages(), PARAMS).alias("request"))


@query("p9_request_llamacpp_chat", f"""SELECT doc_id, CAST(json_object('messages', {_MESSAGES}, 'stream', false, 'temperature', 0.7, 'n_predict', 64,
  'top_p', 0.9, 'repeat_penalty', 1.1, 'seed', 7, 'stop', {_STOP}, 'n_choices', 1, 'chat_format', 'chatml') AS VARCHAR) AS request FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", requests.build_request("llamacpp", _messages(), {**PARAMS, "chat_format": "chatml"}).alias("request"))


@query("p10_request_openai", f"""SELECT doc_id, CAST(json_object('model', 'm-1', 'messages', {_MESSAGES}, 'temperature', 0.7, 'max_tokens', 64, 'top_p', 0.9, 'seed', 7, 'stop', {_STOP}, 'n', 1) AS VARCHAR) AS request FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", requests.build_request("openai", _messages(), PARAMS, model="m-1").alias("request"))


@query("p11_chat_features", f"""SELECT doc_id, CAST(json_object('messages', {_MESSAGES}, 'stream', true, 'tools', json_array(json_object('type', 'function', 'function', json_object('name', 'look_up', 'description', 'finds'))),
  'tool_choice', 'auto', 'response_format', json_object('type', 'json_object'), 'stream_options', json_object('include_usage', true)) AS VARCHAR) AS request FROM documents""")
def _(spark, d):
    features = {
        "tools": [{"type": "function", "function": {"name": "look_up", "description": "finds"}}], "tool_choice": "auto",
        "response_format": {"type": "json_object"}, "stream": True, "stream_options": {"include_usage": True},
    }
    return table(spark, d, "documents").select("doc_id", requests.build_request("vllm", _messages(), features=features).alias("request"))


@query("p12_format_messages", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(json_object('role', role, 'content', text) AS VARCHAR)
  ELSE CAST(json_object('role', role, 'content', json_array(json_object('type', 'text', 'text', text)), 'name', 'n1') AS VARCHAR) END AS message FROM conversations""")
def _(spark, d):
    odd = F.col("turn") % 2 == 1
    part = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    m = F.struct(
        F.col("role"), F.col("text").alias("content"), F.when(odd, part).alias("parts"), F.when(odd, "n1").alias("name"),
        F.lit(None).cast("string").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"),
    )
    return table(spark, d, "conversations").withColumn("m", m).select("conv_id", "turn", requests.format_message(F.col("m"), True).alias("message"))


@query("p14_truncate_text", """SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short, CASE WHEN length(text) > 3 THEN '...' ELSE text END AS dots FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_text(F.col("text"), 100).alias("short"), text.truncate_text(F.col("text"), 3).alias("dots"))


@query("p15_nested_fields", "SELECT doc_id, lang AS got, CAST(NULL AS VARCHAR) AS absent, upper(source) AS written, n_chars AS kept, source AS created FROM documents")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.struct("lang", "source", "n_chars").alias("meta"))
    name, value = templates.nested_set(df.schema, "meta.source", F.upper("meta.source"))
    made, fresh = templates.nested_set(df.schema, "extra.deep.value", F.col("meta.source"))
    out = df.withColumn(made, fresh).withColumn(name, value)
    return out.select(
        "doc_id", templates.nested_get(out.schema, "meta.lang").alias("got"), templates.nested_get(out.schema, "meta.none.x").alias("absent"),
        F.col("meta.source").alias("written"), F.col("meta.n_chars").alias("kept"), F.col("extra.deep.value").alias("created"),
    )


@query("p16_predicates", f"""SELECT row_index, success, ground_truth <> '' AS has_truth, final_answer = ground_truth AS correct FROM ({V.results_sql()}) WHERE success""")
def _(spark, d):
    r = V.results(spark, d).filter("success")
    return r.select("row_index", "success", (F.col("ground_truth") != "").alias("has_truth"), (F.col("final_answer") == F.col("ground_truth")).alias("correct"))


# ---- replies ------------------------------------------------------------------------

def _bodies(spark, d):
    """Reply bodies of every kind: fine, with reasoning, an error, no choice, not JSON."""
    usage = F.struct(F.col("n_chars").alias("prompt_tokens"), F.lit(5).alias("completion_tokens"), (F.col("n_chars") + 5).alias("total_tokens"))
    message = lambda content, reasoning: F.struct(content.alias("content"), reasoning.alias("reasoning_content"))
    null = F.lit(None).cast("string")
    chat = lambda content, reasoning: F.to_json(F.struct(
        F.array(F.struct(message(content, reasoning).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), usage.alias("usage")))
    shapes = [
        chat(F.col("text"), null), chat(F.lit("yes"), F.col("text")), chat(null, F.col("text")),
        F.to_json(F.struct(F.struct(F.col("lang").alias("message")).alias("error"))), F.lit('{"choices": []}'), F.concat(F.lit('{"choices": ['), F.col("source")),
    ]
    return table(spark, d, "documents").select("doc_id", V._choose(F.col("doc_id") % 6, shapes).alias("body"))


@query("i4_decode_response", """SELECT doc_id, doc_id % 6 < 3 AS success,
  CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || chr(10) || 'yes' WHEN 2 THEN '<think>' || chr(10) || text || chr(10) || '</think>' ELSE '' END AS content,
  CASE doc_id % 6 WHEN 3 THEN lang WHEN 4 THEN 'no response choices returned' WHEN 5 THEN 'failed to decode response' ELSE '' END AS error,
  CASE WHEN doc_id % 6 < 3 THEN n_chars + 5 END AS total_tokens, CASE WHEN doc_id % 6 < 3 THEN 'stop' END AS finish_reason FROM documents""")
def _(spark, d):
    out = requests.decode_response(_bodies(spark, d), "body")
    return out.select("doc_id", "success", "content", "error", F.col("usage.total_tokens").alias("total_tokens"), "finish_reason")


@query("i5_merge_reasoning", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '<think>' || chr(10) || lang || chr(10) || '</think>' || chr(10) || chr(10) || text
  ELSE '<think>' || chr(10) || lang || chr(10) || '</think>' END AS content FROM documents""")
def _(spark, d):
    k = F.col("doc_id") % 3
    content, reasoning = F.when(k < 2, F.col("text")), F.when(k > 0, F.col("lang")).otherwise("")
    return table(spark, d, "documents").select("doc_id", requests.merge_reasoning(content, reasoning).alias("content"))


_H = "md5(doc_id{0} || chr(10) || coalesce(text, ''))"
_hex = lambda h, a, n: f"CAST('0x' || substr({h}, {a}, {n}) AS INTEGER)"


def _reply_sql(key):
    h = _H.format(key)
    return f"""{_hex(h, 5, 2)} % 10 <> 0 AS success, CASE WHEN {_hex(h, 5, 2)} % 10 = 0 THEN 'connection refused' ELSE '' END AS error,
  CASE WHEN {_hex(h, 5, 2)} % 10 = 0 THEN '' ELSE '<think>case ' || substr({h}, 1, 4) || '</think> Answer: ' || CASE {_hex(h, 1, 4)} % 2 WHEN 0 THEN '0' ELSE '1' END END AS reply,
  CAST({_hex(h, 7, 3)} AS BIGINT) AS response_time_ms"""


def _requests(spark, d):
    df = _docs(spark, d)
    return df.withColumn("request", requests.build_request("vllm", _messages(), {"temperature": 0.0})).select("row_index", "request")


@query("i1_infer", f"SELECT doc_id AS row_index, {_reply_sql('')} FROM documents")
def _(spark, d):
    return infer.infer(_requests(spark, d), infer.HashResponder()).select("row_index", "success", "error", F.col("raw_response").alias("reply"), "response_time_ms")


@query("i2_infer_repeat", f"SELECT doc_id AS row_index, CAST(n AS INTEGER) AS attempt_no, " + _reply_sql(" || ':' || n") + " FROM documents CROSS JOIN range(1, 4) AS k(n)")
def _(spark, d):
    out = infer.infer_repeat(_requests(spark, d), infer.HashResponder(), 3)
    return out.select("row_index", "attempt_no", "success", "error", F.col("response").alias("reply"), "response_time_ms")


@query("i2_infer_attempts", f"SELECT doc_id AS row_index, CAST(n AS INTEGER) AS attempt_no, " + _reply_sql(" || ':' || n") + " FROM documents CROSS JOIN range(1, 4) AS k(n)")
def _(spark, d):
    """The same attempts made inside one row, then listed."""
    out = infer.infer_attempts(_requests(spark, d), infer.HashResponder(), 3).select("row_index", F.explode("attempts").alias("a"))
    return out.select("row_index", "a.attempt_no", "a.success", "a.error", F.col("a.response").alias("reply"), "a.response_time_ms")


@query("i7_usage_summary", """SELECT count(*) FILTER (doc_id % 6 < 3) AS rows_with_usage, CAST(sum(n_chars) FILTER (doc_id % 6 < 3) AS BIGINT) AS prompt_tokens,
  CAST(5 * count(*) FILTER (doc_id % 6 < 3) AS BIGINT) AS completion_tokens, CAST(sum(n_chars + 5) FILTER (doc_id % 6 < 3) AS BIGINT) AS total_tokens FROM documents""")
def _(spark, d):
    return infer.usage_summary(requests.decode_response(_bodies(spark, d), "body"))


# ---- parsing ------------------------------------------------------------------------

RULES = parsing.ParsingRules(
    find=["positive", "negative", "src1", "de la"], default="none", map={"1": "good", "0": "bad", "positive": "pos"},
    thinking_tags="<think></think>", answer_patterns=[r"answer:\s*(\w+)", r"no group", r"(broken", r"classification:\s*(\w+)"],
)
THINK = f"""CASE WHEN instr(raw_response, '<think>') > 0 AND instr(substr(raw_response, instr(raw_response, '<think>') + 7), '</think>') > 0
  THEN {sql_trim("substr(substr(raw_response, instr(raw_response, '<think>') + 7), 1, instr(substr(raw_response, instr(raw_response, '<think>') + 7), '</think>') - 1)")} ELSE '' END"""
STRIPPED = r"regexp_replace(raw_response, '<think>[^\n]*?</think>', '', 'g')"
PARSE = f"WITH r AS ({V.RESPONSES_SQL}), s AS (SELECT *, {THINK} AS thinking_content, {sql_trim(STRIPPED)} AS body FROM r)"
_FIRST = r"""CASE WHEN regexp_matches(body, '(?i)answer:\s*(\w+)') THEN regexp_extract(body, '(?i)answer:\s*(\w+)', 1)
  WHEN regexp_matches(body, '(?i)classification:\s*(\w+)') THEN regexp_extract(body, '(?i)classification:\s*(\w+)', 1) END"""
_FIND = "CASE WHEN contains(lower(body), 'positive') THEN 'positive' WHEN contains(lower(body), 'negative') THEN 'negative' WHEN contains(lower(body), 'src1') THEN 'src1' WHEN contains(lower(body), 'de la') THEN 'de la' END"
_MAP = lambda x: f"CASE {x} WHEN '1' THEN 'good' WHEN '0' THEN 'bad' WHEN 'positive' THEN 'pos' ELSE {x} END"
_body = lambda: text.trim_ws(parsing.strip_thinking(F.col("raw_response"), RULES.thinking_tags))


@query("r2_extract_thinking", f"{PARSE} SELECT doc_id, thinking_content FROM s")
def _(spark, d):
    return V.responses(spark, d).select("doc_id", parsing.extract_thinking(F.col("raw_response"), "<think></think>").alias("thinking_content"))


@query("r3_strip_thinking", rf"""WITH r AS ({V.RESPONSES_SQL}) SELECT doc_id, {STRIPPED} AS stripped, regexp_replace(raw_response, '(?s)<think>.*?</think>', '', 'g') AS stripped_across FROM r""")
def _(spark, d):
    c, tags = F.col("raw_response"), "<think></think>"
    return V.responses(spark, d).select("doc_id", parsing.strip_thinking(c, tags).alias("stripped"), parsing.strip_thinking(c, tags, across_lines=True).alias("stripped_across"))


@query("r4_answer_patterns", f"{PARSE} SELECT doc_id, {_FIRST} AS answer FROM s")
def _(spark, d):
    return V.responses(spark, d).select("doc_id", parsing.match_patterns(_body(), parsing.usable_patterns(RULES)).alias("answer"))


_CLASSES = {"mixed": r"([*+\d]+)", "plus": r"a\++(b)", "digits": "x([[:digit:]]+)", "signs": "([[:punct:]&&]+)b", "bracket": r"([]\[^]+)"}
_CLASSED = ", ".join(f"CASE WHEN regexp_matches(body, '(?i){p}') THEN regexp_extract(body, '(?i){p}', 1) END AS {k}" for k, p in _CLASSES.items())


@query("r4_pattern_classes", f"SELECT doc_id, {_CLASSED} FROM (SELECT doc_id, text || ' 4*2+x' || doc_id || ' a++b [^&b' AS body FROM documents)")
def _(spark, d):
    """Escapes, members and named classes inside brackets, one pattern per column."""
    df = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" 4*2+x"), "doc_id", F.lit(" a++b [^&b")).alias("body"))
    one = lambda p: parsing.match_patterns(F.col("body"), parsing.usable_patterns(parsing.ParsingRules(answer_patterns=[p])))
    return df.select("doc_id", *[one(p).alias(k) for k, p in _CLASSES.items()])


@query("r5_find_keywords", f"""{PARSE} SELECT doc_id, {_FIND} AS answer, CASE WHEN contains(body, 'POSITIVE') THEN 'POSITIVE' END AS cased, CASE WHEN lower(body) = 'answer: 1' THEN 'answer: 1' END AS exact FROM s""")
def _(spark, d):
    df = V.responses(spark, d).withColumn("body", _body())
    b, low = F.col("body"), F.lower("body")
    rules = lambda **k: parsing.ParsingRules(**k)
    return df.select(
        "doc_id", parsing.find_keyword(b, low, RULES).alias("answer"),
        parsing.find_keyword(b, low, rules(find=["positive", "POSITIVE"], case_sensitive=True)).alias("cased"),
        parsing.find_keyword(b, low, rules(find=["answer: 1"], exact_match=True)).alias("exact"),
    )


@query("r6_wildcard", f"{PARSE} SELECT doc_id, CASE WHEN contains(lower(body), 'positive') THEN 'positive' WHEN body <> '' THEN body END AS answer FROM s")
def _(spark, d):
    df = V.responses(spark, d).withColumn("body", _body())
    return df.select("doc_id", parsing.find_keyword(F.col("body"), F.lower("body"), parsing.ParsingRules(find=["positive", "*", "never"])).alias("answer"))


@query("r7_map_answer", f"SELECT doc_id, {_MAP('q')} AS mapped FROM (SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'unknown') AS q FROM ({V.LABELLED_SQL}))")
def _(spark, d):
    q = F.coalesce(F.col("quality").cast("string"), F.lit("unknown"))
    return V.labelled(spark, d).select("doc_id", parsing.map_answer(q, RULES.map).alias("mapped"))


@query("r8_default_answer", f"{PARSE} SELECT doc_id, CASE WHEN contains(lower(body), 'positive') THEN 'positive' ELSE 'nothing' END AS final_answer, '' AS thinking_content FROM (SELECT *, {sql_trim('raw_response')} AS whole FROM s)")
def _(spark, d):
    return parsing.parse_responses(V.responses(spark, d), parsing.ParsingRules(find=["positive"], default="nothing")).select("doc_id", "final_answer", "thinking_content")


@query("r9_fallback_answer", f"WITH r AS ({V.RESPONSES_SQL}) SELECT doc_id, CASE WHEN raw_response = '' THEN 'broken' WHEN contains(lower(raw_response), 'answer') THEN 'answer' ELSE 'none' END AS final_answer FROM r")
def _(spark, d):
    df = V.responses(spark, d).withColumn("raw_response", F.nullif("raw_response", F.lit("")))
    return parsing.parse_responses(df, parsing.ParsingRules(find=["answer"], default="none", fallback="broken")).select("doc_id", "final_answer")


@query("r10_parse_responses", f"""{PARSE}, f AS (SELECT *, coalesce(nullif({_FIRST}, ''), {_FIND}) AS found FROM s) SELECT doc_id, coalesce({_MAP('found')}, 'none') AS final_answer, thinking_content FROM f""")
def _(spark, d):
    return parsing.parse_responses(V.responses(spark, d), RULES).select("doc_id", "final_answer", "thinking_content")


@query("p13_preview_prompts", "SELECT doc_id AS row_index, text AS input_text, 'Rate: ' || text AS prompt FROM documents WHERE doc_id < 3")
def _(spark, d):
    from labelmill.config import from_dict
    from labelmill.plans.labelling import preview

    job = from_dict({"provider": {"name": "vllm", "base_url": "http://model"}, "classification": {"template": {"user": "Rate: {text}"}}})
    return preview(_docs(spark, d), job)
