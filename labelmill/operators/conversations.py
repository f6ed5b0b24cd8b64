"""Conversations as rows of (conv_id, turn, role, text).

Checks, counts and truncation never gather a conversation. Rendering does, because its
result is one string per conversation; truncate first when conversations are unbounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labelmill import schema as S
from labelmill.operators.budget import message_tokens

# Chat markers per template (prefix and suffix of each role, first token).
CHAT_TEMPLATES = {
    "chatml": {
        "bos": "",
        "system": ("<|im_start|>system\n", "<|im_end|>\n"),
        "user": ("<|im_start|>user\n", "<|im_end|>\n"),
        "assistant": ("<|im_start|>assistant\n", "<|im_end|>\n"),
    },
    "llama2": {
        "bos": "<s>",
        "system": ("<s>[INST] <<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": ("", " [/INST] "),
        "assistant": ("", " </s><s>[INST] "),
    },
    "llama3": {
        "bos": "<|begin_of_text|>",
        "system": ("<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>"),
        "user": ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>"),
        "assistant": ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"),
    },
    "vicuna": {
        "bos": "",
        "system": ("", "\n\n"),
        "user": ("USER: ", "\n"),
        "assistant": ("ASSISTANT: ", "\n"),
    },
}
ROLES = ["system", "user", "assistant", "tool", "function"]

MESSAGES = T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("tool_call_id", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(S.TOOL_CALL)),
]))


def build_conversation(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """messages (role, content) in turn order, last message, count."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    out = messages.groupBy(conv).agg(ordered.alias("m"), F.count("*").alias("message_count"))
    pair = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))
    return out.select(
        conv, F.transform("m", pair).alias("messages"), F.try_element_at("m", F.lit(-1))["role"].alias("last_role"),
        F.try_element_at("m", F.lit(-1))["text"].alias("last_content"), "message_count",
    )


def last_message(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Only the last message and the count: aggregates, nothing is gathered."""
    last = F.max_by(F.struct("role", "text"), "turn")
    return messages.groupBy(conv).agg(last.alias("l"), F.count("*").alias("message_count")).select(
        conv, F.col("l.role").alias("last_role"), F.col("l.text").alias("last_content"), "message_count"
    )


def render_messages(messages: Column, template: str = "chatml") -> Column:
    """Chat text of an ordered (role, content) array; other roles are skipped.

    A final assistant message stays open: its suffix is left out.
    """
    t = CHAT_TEMPLATES.get(template.lower(), CHAT_TEMPLATES["chatml"])
    last = F.size(messages) - 1

    def one(m: Column, i: Column) -> Column:
        body = F.coalesce(m["content"], F.lit(""))
        close = F.when(i < last, F.lit(t["assistant"][1])).otherwise("")
        return (
            F.when(m["role"] == "system", F.concat(F.lit(t["system"][0]), body, F.lit(t["system"][1])))
            .when(m["role"] == "user", F.concat(F.lit(t["user"][0]), body, F.lit(t["user"][1])))
            .when(m["role"] == "assistant", F.concat(F.lit(t["assistant"][0]), body, close))
            .otherwise("")
        )

    return F.concat(F.lit(t["bos"]), F.array_join(F.transform(messages, one), ""))


def format_chat(messages: DataFrame, template: str = "chatml", conv: str = "conv_id") -> DataFrame:
    built = build_conversation(messages, conv)
    return built.select(conv, render_messages(F.col("messages"), template).alias("chat"))


def message_error(role: Column, content: Column, tool_calls: Column | None = None, tool_call_id: Column | None = None) -> Column:
    """What is wrong with a message, null if nothing is."""
    role = F.coalesce(role, F.lit(""))
    calls = F.lit(False) if tool_calls is None else (F.coalesce(F.size(tool_calls), F.lit(0)) > 0)
    no_id = F.lit(True) if tool_call_id is None else tool_call_id.isNull()
    return (
        F.when(role == "", "message role cannot be empty")
        .when(~role.isin(ROLES), F.concat(F.lit("invalid message role: "), role))
        .when((F.coalesce(content, F.lit("")) == "") & ~calls, "message content cannot be empty unless it has tool calls")
        .when((role == "tool") & no_id, "tool messages must have a tool_call_id")
    )


def validate_messages(messages: DataFrame) -> DataFrame:
    extra = {c: F.col(c) for c in ("tool_calls", "tool_call_id") if c in messages.columns}
    return messages.withColumn("error", message_error(F.col("role"), F.col("text"), **extra))


def validate_conversations(messages: DataFrame, conv: str = "conv_id", all_conversations: DataFrame | None = None) -> DataFrame:
    """First failing message of each conversation, with its 0-based position; null if valid.

    ``all_conversations`` lists the ids that must exist; those without messages are
    reported as empty.
    """
    checked = validate_messages(messages)
    bad = F.when(F.col("error").isNotNull(), F.col("turn"))
    out = checked.groupBy(conv).agg(F.min(bad).alias("_t"), F.min_by("error", bad).alias("_e"), F.count("*").alias("messages"))
    # The position counts the messages before the failing one; turns may have gaps.
    first_bad = out.filter("_t is not null").select(conv, F.col("_t").alias("_bad"))
    before = checked.join(first_bad, conv).filter(F.col("turn") < F.col("_bad")).groupBy(conv).agg(F.count("*").alias("_pos"))
    out = out.join(before, conv, "left")
    position = F.coalesce("_pos", F.lit(0)).cast("string")
    text = F.when(F.col("_t").isNotNull(), F.concat(F.lit("message "), position, F.lit(": "), F.col("_e")))
    out = out.select(conv, "messages", text.alias("error"))
    if all_conversations is not None:
        out = all_conversations.select(conv).distinct().join(out, conv, "left").select(
            conv, F.coalesce("messages", F.lit(0)).alias("messages"),
            F.when(F.col("messages").isNull(), "conversation cannot be empty").otherwise(F.col("error")).alias("error"),
        )
    return out


def truncate_conversations(messages: DataFrame, max_tokens: int, conv: str = "conv_id") -> DataFrame:
    """Keep a leading system message and the newest messages that fit the budget.

    A message costs at least 10, so no more than max_tokens / 10 of the newest can fit.
    Ranking to that depth first lets Spark drop older rows before the shuffle, so a
    huge conversation never reaches one task. The running sum then decides exactly.
    """
    cost = message_tokens(F.col("text"))
    rows = messages.withColumn("tokens", cost)
    first = F.min_by(F.struct("turn", "role", "tokens"), "turn").alias("f")
    lead = rows.groupBy(conv).agg(first).filter("f.role = 'system'").select(
        conv, F.col("f.turn").alias("_lead"), F.col("f.tokens").alias("_spent")
    )
    newest = Window.partitionBy(conv).orderBy(F.desc("turn"))
    depth = max(1, max_tokens // 10 + 1)
    recent = rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= depth)
    recent = recent.join(lead, conv, "left").filter(F.col("_lead").isNull() | (F.col("turn") != F.col("_lead")))
    run = F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    kept = recent.withColumn("_sum", run + F.coalesce("_spent", F.lit(0))).filter(F.col("_sum") <= max_tokens)
    system = rows.join(lead.select(conv, F.col("_lead").alias("turn")), [conv, "turn"], "left_semi")
    return kept.select(*messages.columns, "tokens").unionByName(system.select(*messages.columns, "tokens"))


def conversation_json(messages: Column) -> Column:
    return F.to_json(messages)


def conversation_from_json(text: Column) -> Column:
    return F.from_json(text, MESSAGES)


def text_content(parts: Column) -> Column:
    """Text of the first part of type text, '' if there is none."""
    texts = F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull())
    return F.coalesce(F.try_element_at(texts, F.lit(1))["text"], F.lit(""))
