"""Provider request bodies and reply bodies as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T, functions as F

from labelmill import schema as S
from labelmill.functions.text import bind

# Parameter -> name on the wire, per provider, in wire order.
_CHAT_PARAMETERS = {
    "vllm": {
        "temperature": "temperature",
        "max_tokens": "max_tokens",
        "min_tokens": "min_tokens",
        "top_p": "top_p",
        "top_k": "top_k",
        "min_p": "min_p",
        "n": "n",
        "repetition_penalty": "repetition_penalty",
        "presence_penalty": "presence_penalty",
        "frequency_penalty": "frequency_penalty",
        "seed": "seed",
        "stop": "stop",
        "stop_token_ids": "stop_token_ids",
        "bad_words": "bad_words",
        "include_stop_str_in_output": "include_stop_str_in_output",
        "ignore_eos": "ignore_eos",
        "logprobs": "logprobs",
        "prompt_logprobs": "prompt_logprobs",
        "truncate_prompt_tokens": "truncate_prompt_tokens",
        "skip_special_tokens": "skip_special_tokens",
        "spaces_between_special_tokens": "spaces_between_special_tokens",
        "enable_thinking": "extra_body",
        "guided_choice": "guided_choice",
        "guided_regex": "guided_regex",
        "guided_json": "guided_json",
        "guided_grammar": "guided_grammar",
        "guided_whitespace_pattern": "guided_whitespace_pattern",
        "guided_decoding_backend": "guided_decoding_backend",
        "max_logprobs": "max_logprobs",
        "echo": "echo",
        "best_of": "best_of",
        "use_beam_search": "use_beam_search",
        "length_penalty": "length_penalty",
        "early_stopping": "early_stopping",
    },
    "llamacpp": {
        "temperature": "temperature",
        "max_tokens": "n_predict",
        "min_tokens": "min_tokens",
        "top_p": "top_p",
        "top_k": "top_k",
        "min_p": "min_p",
        "repetition_penalty": "repeat_penalty",
        "presence_penalty": "presence_penalty",
        "frequency_penalty": "frequency_penalty",
        "seed": "seed",
        "stop": "stop",
        "mirostat": "mirostat",
        "mirostat_tau": "mirostat_tau",
        "mirostat_eta": "mirostat_eta",
        "tfs_z": "tfs_z",
        "typical_p": "typical_p",
        "n_keep": "n_keep",
        "penalize_nl": "penalize_nl",
        "n": "n_choices",
        "ignore_eos": "ignore_eos",
        "logprobs": "logprobs",
        "chat_format": "chat_format",
    },
    "openai": {
        "temperature": "temperature",
        "max_tokens": "max_tokens",
        "top_p": "top_p",
        "seed": "seed",
        "stop": "stop",
        "presence_penalty": "presence_penalty",
        "frequency_penalty": "frequency_penalty",
        "n": "n",
        "logprobs": "logprobs",
    },
}

PARAMETER_NAMES = sorted(
    {p for table in _CHAT_PARAMETERS.values() for p in table}
)

# Optional chat features, in wire order.
_FEATURES = ["tools", "tool_choice", "response_format", "stream", "stream_options"]


def literal(value) -> Column:
    """A Python value, lists and dicts included, as a typed literal."""
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(str(k)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)


def build_messages(system: str | Column, user: Column) -> Column:
    """The system and the user turn as an array of (role, content)."""
    first = system if isinstance(system, Column) else F.lit(system)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", first), turn("user", user))


def flat_prompt(messages: Column) -> Column:
    """The turns as ``role: text`` lines, ending where the assistant is to speak."""
    line = lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")), F.lit("\n"))
    return F.concat(F.array_join(F.transform(messages, line), ""), F.lit("assistant: "))


def _parameters(provider: str, params: dict, seed_allowed: bool) -> list[Column]:
    out = []
    for name, wire in _CHAT_PARAMETERS[provider].items():
        value = params.get(name)
        if value is None or value == [] or (name == "seed" and not seed_allowed):
            continue
        if wire == "extra_body":
            value = {"chat_template_kwargs": {name: value}}
        out.append(literal(value).alias(wire))
    return out


def build_request(
    provider: str,
    messages: Column,
    params: dict | None = None,
    model: str | None = None,
    features: dict | None = None,
    flashinfer_safe: bool = False,
) -> Column:
    """One JSON request body per row.

    Only given parameters are sent. The chat endpoint of the llama.cpp provider is used
    when a chat format is configured, otherwise its flat completion endpoint.
    """
    if provider not in _CHAT_PARAMETERS:
        raise ValueError(f"unsupported provider: {provider}")
    params = params or {}
    features = {k: (features or {})[k] for k in _FEATURES if (features or {}).get(k) not in (None, [])}
    if provider == "openai":
        head = [F.lit(model or "").alias("model"), messages.alias("messages")]
    elif provider == "llamacpp" and params.get("chat_format") is None:
        head = [flat_prompt(messages).alias("prompt"), F.lit(False).alias("stream")]
        features = {}
    else:
        head = [messages.alias("messages"), F.lit(features.pop("stream", False)).alias("stream")]
    body = head + _parameters(provider, params, seed_allowed=not (provider == "vllm" and flashinfer_safe))
    body += [literal(v).alias(k) for k, v in features.items()]
    return F.to_json(F.struct(*body))


def format_message(m: Column, has_parts: bool = False) -> Column:
    """One message as JSON: text content as a string, multi-part content as an array.

    ``m`` is a struct with role, content and optionally parts, name, tool_calls and
    tool_call_id; absent optional values are left out.
    """
    optional = [m["name"].alias("name"), m["tool_calls"].alias("tool_calls"), m["tool_call_id"].alias("tool_call_id")]
    text = F.to_json(F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), *optional))
    if not has_parts:
        return text
    parts = F.to_json(F.struct(m["role"].alias("role"), m["parts"].alias("content"), *optional))
    return F.when(m["parts"].isNull(), text).otherwise(parts)


def format_messages(messages: Column, has_parts: bool = False) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(messages, lambda m: format_message(m, has_parts)), ","), F.lit("]"))


_MESSAGE = T.StructType([
    T.StructField("content", T.StringType()),
    T.StructField("reasoning_content", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(S.TOOL_CALL)),
])
_BODY = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", _MESSAGE),
        T.StructField("finish_reason", T.StringType()),
    ]))),
    T.StructField("content", T.StringType()),
    T.StructField("usage", S.USAGE),
    T.StructField("error", T.StructType([T.StructField("message", T.StringType())])),
    T.StructField("_corrupt", T.StringType()),
])


def merge_reasoning(content: Column, reasoning: Column) -> Column:
    """Put separately returned reasoning in front of the content, inside think tags."""
    text = F.coalesce(content, F.lit(""))
    block = F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>"))
    return (
        F.when(F.coalesce(reasoning, F.lit("")) == "", text)
        .when(text == "", block)
        .otherwise(F.concat(block, F.lit("\n\n"), text))
    )


def decode(body: Column, provider: str = "vllm", completion: bool = False) -> Column:
    """A reply body as (content, success, error, tool_calls, usage, finish_reason).

    A body that is not JSON, an error message and a reply without choices are failures.
    The flat completion endpoint has its content at the top.
    """
    def read(b: Column) -> Column:
        no_choice = F.lit(False) if completion else (F.coalesce(F.size(b["choices"]), F.lit(0)) <= 0)
        error = (
            F.when(b.isNull() | b["_corrupt"].isNotNull(), "failed to decode response")
            .when(F.coalesce(b["error"]["message"], F.lit("")) != "", b["error"]["message"])
            .when(no_choice, "no response choices returned")
            .otherwise("")
        )
        choice = F.try_element_at(b["choices"], F.lit(1))
        if completion:
            content = F.coalesce(b["content"], F.lit(""))
        elif provider == "vllm":
            content = merge_reasoning(choice["message"]["content"], choice["message"]["reasoning_content"])
        else:
            content = F.coalesce(choice["message"]["content"], F.lit(""))
        ok = error == ""
        return F.struct(
            F.when(ok, content).otherwise("").alias("content"),
            ok.alias("success"),
            error.alias("error"),
            F.when(ok, choice["message"]["tool_calls"]).alias("tool_calls"),
            F.when(ok, b["usage"]).alias("usage"),
            F.when(ok, choice["finish_reason"]).alias("finish_reason"),
        )

    return bind(F.from_json(body, _BODY, {"columnNameOfCorruptRecord": "_corrupt"}), read)


def decode_response(df: DataFrame, body: str = "body", provider: str = "vllm", completion: bool = False) -> DataFrame:
    """Add the fields of ``decode`` as columns."""
    return df.withColumn("_d", decode(F.col(body), provider, completion)).select("*", "_d.*").drop("_d")
