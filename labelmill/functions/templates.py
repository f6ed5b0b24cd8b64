"""Prompt templates as one concat expression per template."""

from __future__ import annotations

import re

from pyspark.sql import Column, types as T, functions as F

from labelmill.functions.text import normalize_label

_SLOT = re.compile(r"\{([^{}]+)\}")

# Columns looked for, in this order, when no input column is configured.
INPUT_NAMES = ["REVIEW", "review", "TEXT", "text", "CONTENT", "content", "MESSAGE", "message"]


def plain(c: Column, dtype: T.DataType) -> Column:
    """A nested value as text."""
    if isinstance(dtype, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}: "), F.coalesce(plain(c[f.name], f.dataType), F.lit(""))) for f in dtype]
        return F.concat_ws(", ", *parts)
    if isinstance(dtype, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: plain(x, dtype.elementType)), ", ", "")
    if isinstance(dtype, T.MapType):
        entries = F.sort_array(F.map_entries(c)) if isinstance(dtype.keyType, T.AtomicType) else F.map_entries(c)
        item = lambda e: F.concat(e["key"].cast("string"), F.lit(": "), F.coalesce(plain(e["value"], dtype.valueType), F.lit("")))
        return F.array_join(F.transform(entries, item), ", ")
    return c.cast("string")


def slot_text(c: Column, dtype: T.DataType) -> Column:
    """A column as it appears in a prompt: floats get two decimals, null is empty."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = F.format_string("%.2f", c)
        return F.when(c.isNull(), F.lit("")).otherwise(text)
    return F.coalesce(plain(c, dtype), F.lit(""))


def _slots(schema: T.StructType, prefix: str = "", parent: str = "") -> dict[str, tuple[Column, T.DataType]]:
    """Every name a placeholder may use; outer columns win over bare nested names."""
    out: dict[str, tuple[Column, T.DataType]] = {}
    nested: dict[str, tuple[Column, T.DataType]] = {}
    for f in schema:
        path = f"{prefix}.{f.name}" if prefix else f.name
        quoted = f"`{f.name.replace('`', '``')}`"
        column = f"{parent}.{quoted}" if parent else quoted
        col = F.col(column)
        names = {f.name, path}
        for n in names:
            for form in (n, n.upper(), n.lower()):
                out.setdefault(form, (col, f.dataType))
        if isinstance(f.dataType, T.StructType):
            for k, v in _slots(f.dataType, path, column).items():
                nested.setdefault(k, v)
    for k, v in nested.items():
        out.setdefault(k, v)
    return out


def render_prompt(
    schema: T.StructType,
    template: str,
    text: str = "text",
    index: str = "row_index",
    placeholder_map: dict[str, str] | None = None,
) -> Column:
    """The template with every known ``{name}`` filled in, in a single pass.

    Unknown placeholders stay as they are, and substituted text is never expanded
    again, so a document that contains ``{label}`` is passed through unchanged.
    """
    slots = _slots(schema)
    for name, column in (placeholder_map or {}).items():
        if column in slots:
            slots[name] = slots[column]
    if text in slots:
        slots["text"] = slots[text]
    if index in slots:
        slots["index"] = slots[index]
    parts: list[Column] = []
    at = 0
    for m in _SLOT.finditer(template):
        if m.group(1) not in slots:
            continue
        if m.start() > at:
            parts.append(F.lit(template[at:m.start()]))
        parts.append(slot_text(*slots[m.group(1)]))
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def input_text(
    schema: T.StructType,
    template: str,
    mapped: str | None = None,
    output_field: str | None = None,
    fallback: str = "text",
) -> Column:
    """The column reported as a row's input, chosen from the schema at plan time."""
    names = {f.name: f.dataType for f in schema}
    for choice in (mapped, output_field):
        if choice and choice in names:
            return plain(F.col(choice), names[choice])
    for name in INPUT_NAMES:
        if "{" + name + "}" in template:
            for form in (name, name.lower(), name.upper()):
                if form in names:
                    return plain(F.col(form), names[form])
    return F.col(fallback).cast("string")


def ground_truth(schema: T.StructType, column: str | None) -> Column:
    """Trimmed label of the configured column, '' when absent, null or not configured."""
    if not column or column not in schema.fieldNames():
        return F.lit("")
    return F.coalesce(normalize_label(plain(F.col(column), schema[column].dataType)), F.lit(""))


def field_names(schema: T.StructType, prefix: str = "") -> list[str]:
    """All dotted field names, sorted."""
    out = []
    for f in schema:
        path = f"{prefix}.{f.name}" if prefix else f.name
        out.append(path)
        if isinstance(f.dataType, T.StructType):
            out.extend(field_names(f.dataType, path))
    return sorted(out)


def nested_get(schema: T.StructType, path: str) -> Column:
    """The value at a dotted path, null when the path does not exist."""
    here: T.DataType = schema
    for key in path.split("."):
        if not isinstance(here, T.StructType) or key not in here.fieldNames():
            return F.lit(None).cast("string")
        here = here[key].dataType
    return F.col(path)


def nested_set(schema: T.StructType, path: str, value: Column) -> tuple[str, Column]:
    """Top-level column name and its new value after writing ``value`` at a dotted path."""
    keys = path.split(".")

    def put(at: Column | None, here: T.DataType | None, rest: list[str]) -> Column:
        if not rest:
            return value
        key = rest[0]
        if not isinstance(here, T.StructType):
            return F.struct(put(None, None, rest[1:]).alias(key))
        inner = here[key].dataType if key in here.fieldNames() else None
        inner_col = at[key] if inner is not None else None
        whole = F.struct(*[at[f.name].alias(f.name) for f in here if f.name != key], put(inner_col, inner, rest[1:]).alias(key))
        return whole

    top = keys[0]
    known = top in schema.fieldNames()
    dtype = schema[top].dataType if known else None
    return top, put(F.col(top) if known else None, dtype, keys[1:])
