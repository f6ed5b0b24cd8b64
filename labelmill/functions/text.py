"""Small text expressions used everywhere.

Character classes are spelled out, so that the same regular expression means the same
thing whatever the engine's defaults for \\w, \\s and \\b are:

* WORD: letters, numbers and underscore of any script
* SPACE: everything that counts as white space in Unicode, control separators included
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
NOT_AFTER_WORD = f"(?<![{WORD}])"
NOT_BEFORE_WORD = f"(?![{WORD}])"

TRIM_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def any_case(word: str) -> str:
    """Pattern for a literal word in any case.

    Spelled-out classes let the engine reject a position by its first character, which
    a case-insensitive flag does not. The two letters with a third form get it.
    """
    third = {"s": "\u017f", "k": "\u212a"}
    out = ""
    for ch in word:
        forms = dict.fromkeys((ch.lower(), ch.upper(), third.get(ch.lower(), ch.lower())))
        out += f"[{''.join(forms)}]" if ch.isalpha() else ("\\" + ch if ch in "\\.[]{}()*+?^$|" else ch)
    return out


def whole_word(word: str) -> str:
    """Pattern for a whole word in any case; the check on the left comes after the
    letters, so that it only runs where the letters are there."""
    letters = any_case(word)
    return f"{letters}(?<![{WORD}]{letters}){NOT_BEFORE_WORD}"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim_ws(c: Column) -> Column:
    """Trim every kind of white space; plain ``trim`` removes the space only."""
    return F.trim(c, F.lit(TRIM_CHARS))


def normalize_label(c: Column) -> Column:
    """Labels are trimmed and keep their case; null stays null."""
    return trim_ws(c.cast("string"))


def collapse_ws(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"[{SPACE}]+", " "))


def word_count(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.regexp_count(c, F.lit(f"[^{SPACE}]+")))


def words(c: Column) -> Column:
    """White-space separated words as an array."""
    return F.regexp_extract_all(c, F.lit(f"([^{SPACE}]+)"), 1)


def tokens(c: Column) -> Column:
    """Words and single punctuation marks as an array, in text order."""
    return F.regexp_extract_all(c, F.lit(f"([{WORD}]+(?:'[{WORD}]+)?|[^{WORD}{SPACE}])"), 1)


def truncate_text(c: Column, limit: int, short_form: bool = True) -> Column:
    """Cut to ``limit`` characters, the last three being dots.

    ``short_form`` gives just the dots when the limit leaves no room for text.
    """
    if limit <= 3:
        if not short_form:
            raise ValueError("limit must be above 3")
        return F.when(F.length(c) > limit, F.lit("...")).otherwise(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def is_missing(c: Column) -> Column:
    """Null, NaN, or one of the words that stand for a missing value, tested untrimmed."""
    return c.isNull() | F.lower(c.cast("string")).isin("nan", "null", "none", "", "n/a")


def safe_text(c: Column) -> Column:
    """Trimmed text, null where the value is missing."""
    return F.when(~is_missing(c), trim_ws(c.cast("string")))
