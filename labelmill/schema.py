"""The canonical result table and the structs inside it."""

from __future__ import annotations

from pyspark.sql import types as T

TOOL_CALL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("function", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
    ])),
])

USAGE = T.StructType([
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
])

ATTEMPT = T.StructType([
    T.StructField("attempt_no", T.IntegerType()),
    T.StructField("response", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("response_time_ms", T.LongType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

CONSENSUS = T.StructType([
    T.StructField("final_answer", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("distribution", T.MapType(T.StringType(), T.LongType())),
])

RESULT = T.StructType([
    T.StructField("row_index", T.LongType()),
    T.StructField("input_text", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("final_answer", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("thinking_content", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("response_time_ms", T.LongType()),
    T.StructField("attempts", T.ArrayType(ATTEMPT)),
    T.StructField("consensus", CONSENSUS),
    T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
    T.StructField("usage", USAGE),
])

RESULT_COLUMNS = RESULT.fieldNames()
