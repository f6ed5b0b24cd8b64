"""Text cleaning steps as column expressions.

Every step leaves null and '' alone. All but six are built-in functions and stay in
generated code. The six that need Python's Unicode tables, an HTML tokenizer or a
stemmer run as Arrow batches, and only for the texts that need them: other rows send
a null across.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelmill.functions.text import (
    NOT_AFTER_WORD as NA, NOT_BEFORE_WORD as NB, SPACE, WORD, any_case, bind, collapse_ws, tokens, trim_ws, whole_word, words,
)
from labelmill.session import bound_batches, materialize

# Character maps, word lists and patterns of the cleaning steps.
QUOTES = {"`": "'", "´": "'", "«": '"', "»": '"'}
CURLY_QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'"}
DASHES = {"–": "-", "—": "-", "―": "-", "−": "-"}
DOUBLED_WORDS = ["and", "the", "is", "of", "to", "in", "for", "with", "on", "at", "but"]
TYPOS = {"teh": "the"}
URL_STOP = "<>\"'{}|\\\\^`\\[\\]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DOSAGE_TERMS = {
    "mg": "milligrams",
    "ml": "milliliters",
    "cc": "cubic centimeters",
    "bid": "twice daily",
    "tid": "three times daily",
    "qid": "four times daily",
    "prn": "as needed",
    "po": "by mouth",
    "iv": "intravenous",
    "im": "intramuscular",
}
IRREGULAR_CONTRACTIONS = {
    "won't": "will not",
    "can't": "cannot",
    "shan't": "shall not",
    "ain't": "are not",
    "let's": "let us",
    "y'all": "you all",
}
CONTRACTED_ENDINGS = {"n't": " not", "'re": " are", "'ll": " will", "'ve": " have", "'m": " am", "'d": " would"}
IS_CONTRACTIONS = ["it", "he", "she", "that", "this", "there", "here", "what", "where", "who", "how", "when"]
STOPWORDS = {
    "english": (
        "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his "
        "himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom "
        "this that that'll these those am is are was were be been being have has had having do does did doing a an the "
        "and but if or because as until while of at by for with about against between into through during before after "
        "above below to from up down in out on off over under again further then once here there when where why how all "
        "any both each few more most other some such no nor not only own same so than too very s t can will just don "
        "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
        "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
        "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
    ).split(),
}
LANGUAGE_PROFILES = {
    "en": "the of and to in is that it was for on are with as his they at be this from have or had by but not".split(),
    "fr": "le la les de des du et un une est que qui dans pour sur pas au avec ce se plus par il elle sont".split(),
    "de": "der die das und ist von den mit zu ein eine im dem nicht sich auf auch des es an als wird bei sind".split(),
    "es": "el los las y en que es por con para una su al lo como del se pero sus este ya entre cuando muy".split(),
}


def _some(c: Column, changed: Column) -> Column:
    """Leave null and '' alone."""
    return F.when(F.length(c) > 0, changed).otherwise(c)


def _chars(c: Column, mapping: dict[str, str]) -> Column:
    """Only texts with one of the characters are rewritten."""
    there = F.rlike(c, F.lit("[" + "".join(f"\\x{{{ord(k):x}}}" for k in mapping) + "]"))
    return F.when(there, F.translate(c, "".join(mapping), "".join(mapping.values()))).otherwise(c)


def normalize_whitespace(c: Column) -> Column:
    return collapse_ws(c)


def normalize_quotes(c: Column, curly: bool = False) -> Column:
    return _chars(c, {**QUOTES, **(CURLY_QUOTES if curly else {})})


def normalize_dashes(c: Column) -> Column:
    return _chars(c, DASHES)


def squeeze_punctuation(c: Column) -> Column:
    for pattern, new in ((r"\.{3,}", "..."), ("!{2,}", "!"), (r"\?{2,}", "?"), ("-{2,}", "--")):
        c = F.regexp_replace(c, pattern, new)
    return c


def replace_words(c: Column, mapping: dict[str, str]) -> Column:
    """Whole words, any case, one after the other."""
    for word, new in mapping.items():
        c = F.regexp_replace(c, whole_word(word), new)
    return c


_DOUBLED = f"(?iu)(?:^|[^{WORD}])([a-z\u017f]{{{min(map(len, DOUBLED_WORDS))},{max(map(len, DOUBLED_WORDS))}}})[{SPACE}]+\\1{NB}"


def fix_typos(c: Column) -> Column:
    """The chain of doubled words only runs for texts where a short word is doubled."""
    c = replace_words(c, TYPOS)
    out = c
    for w in DOUBLED_WORDS:
        letters = any_case(w)
        twice = f"{letters}(?<![{WORD}]{letters})[{SPACE}]+{letters}{NB}"
        out = F.regexp_replace(out, twice, w)
    return F.when(F.rlike(c, F.lit(_DOUBLED)), out).otherwise(c)


def remove_urls(c: Column) -> Column:
    rest = f"[^{SPACE}{URL_STOP}]+"
    return F.regexp_replace(c, f"https?://{rest}|www\\.{rest}", "")


def normalize_numbers(c: Column) -> Column:
    """Drop a thousands comma; write out k and million."""
    c = F.regexp_replace(c, f"(?=\\p{{Nd}}){NA}(\\p{{Nd}}+),(\\p{{Nd}}{{3}}){NB}", "$1$2")
    c = F.regexp_replace(c, f"(\\p{{Nd}}+)[{SPACE}]*{any_case('k')}{NB}", "$1000")
    return F.regexp_replace(c, f"(\\p{{Nd}}+)[{SPACE}]*{any_case('million')}{NB}", "$1000000")


def expand_contractions(c: Column) -> Column:
    """Irregular forms first, then 's after a pronoun, then regular endings.

    The long chain only runs for texts that contain an apostrophe.
    """
    out = replace_words(c, IRREGULAR_CONTRACTIONS)
    out = F.regexp_replace(out, f"(?iu){NA}({'|'.join(IS_CONTRACTIONS)})'s{NB}", "$1 is")
    for ending, new in CONTRACTED_ENDINGS.items():
        letters = any_case(ending)
        out = F.regexp_replace(out, f"{letters}(?<=[{WORD}]{letters}){NB}", new)
    return F.when(F.contains(c, F.lit("'")), out).otherwise(c)


def remove_special(c: Column, keep_basic: bool = True) -> Column:
    return F.regexp_replace(c, f"[^{WORD}{SPACE}" + (".,!?;:()'\"/-]" if keep_basic else "]"), "")


def fix_case(c: Column) -> Column:
    """Long ALL-CAPS words become Capitalised; each sentence starts with a capital."""
    pieces = F.regexp_extract_all(c, F.lit(f"([{WORD}]+|[^{WORD}]+)"), 1)
    calm = lambda w: F.when(F.rlike(w, F.lit("^[A-Z]{4,}$")), F.concat(F.substring(w, 1, 1), F.lower(F.substr(w, F.lit(2))))).otherwise(w)
    text = F.when(F.rlike(c, F.lit(f"{NA}[A-Z]{{4,}}{NB}")), F.array_join(F.transform(pieces, calm), "")).otherwise(c)
    sentences = F.filter(F.split(text, f"(?<=[.!?])[{SPACE}]+"), lambda s: s != "")
    start = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    return _some(c, F.array_join(F.transform(sentences, start), " "))


def squeeze_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\n])\1{3,}", "$1$1")


def remove_stopwords(c: Column, language: str = "english") -> Column:
    stop = STOPWORDS.get(language)
    if stop is None:
        return c
    keep = F.filter(tokens(c), lambda w: ~F.lower(w).isin(stop))
    return _some(c, F.array_join(keep, " "))


def remove_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def remove_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}+", "")


def remove_single_chars(c: Column) -> Column:
    return F.regexp_replace(c, f"{NA}[{WORD}]{NB}", "")


def extra_spaces(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"[{SPACE}]{{2,}}", " "))


def sentences(c: Column, abbreviations: list[str] = ()) -> Column:
    """Parts of a text that end with a full stop, a question or an exclamation mark before white
    space. The stop of a word in ``abbreviations`` (in lower case, as
    ``operators.sentences.abbreviations`` learns them) ends none."""
    known = "|".join(re.escape(a) for a in sorted(abbreviations))
    after = f"(?<!(?iu:(?:^|[^\\p{{L}}.])(?:{known})\\.))" if known else ""
    return F.transform(F.split(c, f"(?<=[.!?]){after}[{SPACE}]+"), trim_ws)


def sentence_join(c: Column, abbreviations: list[str] = ()) -> Column:
    return _some(c, F.array_join(sentences(c, abbreviations), " "))


def drop_short_words(c: Column, least: int = 2) -> Column:
    return _some(c, F.array_join(F.filter(words(c), lambda w: F.length(w) >= least), " "))


def drop_long_words(c: Column, most: int = 20) -> Column:
    return _some(c, F.array_join(F.filter(words(c), lambda w: F.length(w) <= most), " "))


def expand_dosage_terms(c: Column) -> Column:
    return replace_words(c, DOSAGE_TERMS)


# Windows-1252 reads 27 bytes of 0x80-0x9f as these characters.
_CP1252 = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def fix_encoding(c: Column) -> Column:
    """Undo one wrong decoding: text that is UTF-8 read as Latin-1 or Windows-1252.

    Whole texts only, and only when their bytes really are valid UTF-8.
    """
    bytes_as_text = _chars(c, _CP1252)
    suspect = F.rlike(bytes_as_text, F.lit("^[\\x00-\\xff]*$")) & F.rlike(bytes_as_text, F.lit("[\\xc2-\\xf4][\\x80-\\xbf]"))
    latin = F.when(suspect, bytes_as_text)
    return F.coalesce(F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string")), c)


#: Wrong readings that are undone, and how many of them in a row.
CODECS, MOST_STEPS = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437"), 3
# Code points of living scripts, ordinary punctuation, currency and pictographs.
_USUAL = [(0xA0, 0x17F), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0x1CD, 0x1DC), (0x218, 0x21B), (0x370, 0x52F), (0x590, 0x6FF), (0x900, 0xE7F), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x2122, 0x2122), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFF9F), (0x1F300, 0x1FAFF)]
_SPAN = re.compile(r"[^\x00-\x7f]{2,}")


def _bytes_of(text: str, codec: str) -> bytes | None:
    """The bytes that ``codec`` reads as ``text``; Windows-1252's free bytes are controls."""
    try:
        if codec != "cp1252":
            return text.encode(codec)
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else c.encode("cp1252") for c in text)
    except UnicodeEncodeError:
        return None


def _strangeness(text: str) -> int:
    """What a reading of a span costs. A letter costs about as much as the bytes that it takes,
    so that three letters are no dearer than the one that their bytes might spell; symbols,
    which the images of UTF-8's later bytes mostly are, cost more, controls and characters
    that texts hardly have most."""
    cost = 0
    for c in text:
        k = ord(c)
        if k < 0x80:
            cost += 1
        elif k < 0xA0:
            cost += 6
        elif k in (0x192, 0x2C6, 0x2DC) or not any(a <= k <= b for a, b in _USUAL):
            cost += 9
        elif not c.isalpha() and k < 0x3000:
            cost += 4
        else:
            cost += 2 if k < 0x250 else 3 if k < 0x800 else 6 if k < 0x10000 else 8
    return cost


@functools.lru_cache(maxsize=1 << 16)
def _repaired_span(span: str) -> str:
    """The cheapest reading of a span over all chains of at most MOST_STEPS wrong readings; of
    equal ones the shortest chain's."""
    best, cost, level, seen = span, _strangeness(span), [span], {span}
    for _ in range(MOST_STEPS):
        following = []
        for text in level:
            for codec in CODECS:
                raw = _bytes_of(text, codec)
                if raw is None:
                    continue
                try:
                    new = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if new not in seen:
                    seen.add(new)
                    following.append(new)
                    now = _strangeness(new)
                    if now < cost:
                        best, cost = new, now
        level = following
    return best


def repair_encoding(c: Column) -> Column:
    """Undo wrong decodings span by span, also several in a row and of different kinds.

    A span is a run of characters beyond ASCII: the images of UTF-8's bytes are such runs in
    all readings that are tried, so damage beside intact text is found too. Only texts with a
    span reach Python. Spans that no chain makes cheaper stay.
    """

    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _SPAN.sub(lambda m: _repaired_span(m[0]), x), na_action="ignore")

    return _only_where(repair, c, F.when(F.rlike(c, F.lit("[^\\x00-\\x7f]{2}")), c))


def _non_ascii(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit("[^\\x00-\\x7f]")), c)


def _only_where(udf, c: Column, needed: Column) -> Column:
    """Apply a Python step to the texts that need it; the others stay in the JVM."""
    bound_batches(SparkSession.getActiveSession())
    return F.coalesce(udf(needed), c)


class _Text(HTMLParser):
    """Collects character data; comments and declarations are not text."""

    def __init__(self, skip):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.depth = [], skip, 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skip

    def handle_endtag(self, tag):
        self.depth -= tag in self.skip and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def _html_text(markup: str, skip) -> str:
    p = _Text(skip)
    p.feed(markup)
    p.close()
    return "".join(p.out)


def clean_html(c: Column, skip_scripts: bool = True) -> Column:
    """Text content of markup, without separators; scripts, styles and templates optional."""
    skip = ("script", "style", "template") if skip_scripts else ()

    @F.pandas_udf("string")
    def strip(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _html_text(x, skip), na_action="ignore")

    return _only_where(strip, c, F.when(F.rlike(c, F.lit("[<&]")), c))


def normalize_unicode(c: Column) -> Column:
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return _only_where(nfkc, c, _non_ascii(c))


def strip_accents(c: Column) -> Column:
    @F.pandas_udf("string")
    def ascii_only(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFD", x).encode("ascii", "ignore").decode(), na_action="ignore")

    return _only_where(ascii_only, c, _non_ascii(c))


_EMOJI = "[☀-➿⬀-⯿\U0001f000-\U0001faff]"


def emoji_to_name(c: Column, delimiter: str = ":") -> Column:
    """Each emoji becomes its Unicode name, lower case with underscores."""
    pattern = re.compile(_EMOJI)

    def name(m: re.Match) -> str:
        n = unicodedata.name(m.group(), "")
        return delimiter + n.lower().replace(" ", "_") + delimiter if n else m.group()

    @F.pandas_udf("string")
    def rename(s: pd.Series) -> pd.Series:
        return s.map(lambda x: pattern.sub(name, x), na_action="ignore")

    java = "[\\u2600-\\u27bf\\u2b00-\\u2bff\\x{1f000}-\\x{1faff}]"
    return _only_where(rename, c, F.when(F.rlike(c, F.lit(java)), c))


def stem_text(c: Column) -> Column:
    """Porter stem of every token; a word is stemmed once per Python worker."""

    @F.pandas_udf("string")
    def stem_all(s: pd.Series) -> pd.Series:
        from labelmill.functions.stemming import stem

        return s.map(lambda x: " ".join(map(stem, _TOKEN.findall(x))), na_action="ignore")

    bound_batches(SparkSession.getActiveSession())
    return stem_all(c)


# The same tokens as ``text.tokens``; Python's classes are the ones spelled out there.
_TOKEN = re.compile(r"\w+(?:'\w+)?|[^\w\s]")


#: Words of a lemma table that are looked up in place, in chains of about ``_CHAIN``.
LEMMAS_IN_PLACE, _CHAIN = 200_000, 4


def _lemma_pieces(df: DataFrame, text: str, lemmas: DataFrame, words: int) -> DataFrame:
    """``df`` with ``_pieces``, the tokens' lemmas as (_at, w) in order, without a shuffle.

    The lemma table becomes one value, an array of small maps by the word's hash."""
    chains = max(1, words // _CHAIN)
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(chains)).cast("int")
    each = lemmas.filter("word is not null").groupBy("word").agg(F.collect_list(F.struct("lemma")).alias("found"))
    maps = each.groupBy(slot(F.col("word")).alias("i")).agg(F.collect_list(F.struct("word", "found")).alias("m"))
    all_slots = lemmas.sparkSession.range(chains).select(F.col("id").cast("int").alias("i")).join(maps, "i", "left")
    table = all_slots.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: F.map_from_entries(x["m"]))).scalar()

    def pieces(t: Column, i: Column) -> Column:
        low = F.lower(t)
        found = F.try_element_at(F.get(F.col("_lemmas"), slot(low)), low)
        one = F.array(F.struct(i.cast("int").alias("_at"), t.alias("w")))
        return F.when(found.isNull(), one).otherwise(F.transform(found, lambda f: F.struct(i.cast("int").alias("_at"), F.coalesce(f["lemma"], t).alias("w"))))

    return df.withColumn("_lemmas", table).withColumn("_pieces", F.flatten(F.transform(tokens(F.col(text)), pieces))).drop("_lemmas")


def lemmatize(df: DataFrame, text: str, lemmas: DataFrame, key: str) -> DataFrame:
    """Replace tokens by their lemma from a (word, lemma) table.

    A table of up to LEMMAS_IN_PLACE rows is looked up inside each text's row, so that no token
    is shuffled; a larger one by a join of the exploded tokens. Rows that share a key share
    their tokens, in both cases; only theirs are gathered.
    """
    lemmas = lemmas.select("word", "lemma")
    joined = lambda pieces: F.array_join(F.transform(F.sort_array(pieces), lambda p: p["w"]), " ")
    words = lemmas.count()
    if words > LEMMAS_IN_PLACE:
        each = df.select(key, F.posexplode(tokens(F.col(text))).alias("_at", "_t")).withColumn("word", F.lower("_t"))
        found = each.join(lemmas, "word", "left").groupBy(key).agg(joined(F.collect_list(F.struct("_at", F.coalesce("lemma", "_t").alias("w")))).alias("_joined"))
        out = df.join(found, key, "left")
    else:
        shared = materialize(df.select(key).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col(key).isNotNull() & (F.col("_n") > 1)).select(key), "shared-keys")
        several = _lemma_pieces(df.join(shared, key), text, lemmas, words).groupBy(key).agg(joined(F.flatten(F.collect_list("_pieces"))).alias("_several"))
        out = df.join(materialize(several, "shared-texts"), key, "left")
        own = F.when(F.col(key).isNotNull(), joined(F.col("_pieces")))
        out = _lemma_pieces(out, text, lemmas, words).withColumn("_joined", F.coalesce("_several", own)).drop("_several", "_pieces")
    # Texts without any token come out empty, as from the other token steps.
    return out.withColumn(text, _some(F.col(text), F.coalesce("_joined", F.lit("")))).drop("_joined")


def detect_language(c: Column, profiles: dict[str, list[str]] | None = None) -> Column:
    """Language whose frequent words make up most of the text; null if none occurs.

    A tie goes to the language listed first.
    """
    profiles = profiles or LANGUAGE_PROFILES

    def best(low: Column) -> Column:
        def score(rank: int, lang: str, profile: list[str]) -> Column:
            hits = F.size(F.filter(low, lambda w: w.isin(profile)))
            return F.struct(hits.alias("hits"), F.lit(-rank).alias("rank"), F.lit(lang).alias("lang"))

        return F.array_max(F.array(*[score(i, lang, p) for i, (lang, p) in enumerate(profiles.items())]))

    top = bind(words(F.lower(remove_special(c, keep_basic=False))), best)
    return bind(top, lambda b: F.when(b["hits"] > 0, b["lang"]))


def filter_language(c: Column, language: str = "en") -> Column:
    """Blank the texts of other languages."""
    return _some(c, F.when(detect_language(c) == language, c).otherwise(""))


STEPS = {
    "fix_encoding": fix_encoding,
    "clean_html": clean_html,
    "normalize_unicode": normalize_unicode,
    "normalize_whitespace": normalize_whitespace,
    "normalize_quotes": normalize_quotes,
    "normalize_dashes": normalize_dashes,
    "remove_extra_punctuation": squeeze_punctuation,
    "fix_common_typos": fix_typos,
    "remove_urls": remove_urls,
    "normalize_numbers": normalize_numbers,
    "expand_contractions": expand_contractions,
    "remove_special_characters": remove_special,
    "fix_case_issues": fix_case,
    "remove_repeated_characters": squeeze_repeats,
    "remove_emojis": lambda c: emoji_to_name(c, ""),
    "demojize_emojis": emoji_to_name,
    "remove_stopwords": remove_stopwords,
    "stem_text": stem_text,
    "remove_punctuation": remove_punctuation,
    "to_lowercase": F.lower,
    "to_uppercase": F.upper,
    "filter_language": filter_language,
    "remove_digits": remove_digits,
    "remove_single_characters": remove_single_chars,
    "normalize_accents": strip_accents,
    "remove_extra_spaces": extra_spaces,
    "extract_sentences": sentence_join,
    "remove_short_words": drop_short_words,
    "remove_long_words": drop_long_words,
    "clean_medical_text": expand_dosage_terms,
}

# Default steps, and the order in which options run after them.
DEFAULT_STEPS = [
    "fix_encoding", "clean_html", "normalize_unicode", "normalize_whitespace", "normalize_quotes", "normalize_dashes",
    "remove_extra_punctuation", "fix_common_typos", "expand_contractions", "remove_repeated_characters", "normalize_whitespace",
]
OPTION_ORDER = [
    "medical_domain", "remove_urls", "normalize_numbers", "remove_special_chars", "fix_case", "remove_emojis",
    "demojize_emojis", "remove_stopwords", "stem_text", "lemmatize_text", "remove_punctuation", "to_lowercase",
    "to_uppercase", "filter_language", "remove_digits", "remove_single_characters", "normalize_accents",
    "remove_short_words", "remove_long_words",
]
_OPTION_STEP = {
    "medical_domain": "clean_medical_text",
    "remove_special_chars": "remove_special_characters",
    "fix_case": "fix_case_issues",
}


def clean_text(
    df: DataFrame,
    column: str = "text",
    steps: list[str] | None = None,
    options: dict | None = None,
    lemmas: DataFrame | None = None,
    key: str | None = None,
    backup: bool = False,
) -> DataFrame:
    """Default or given steps, then the options switched on, then a last space clean-up.

    Unknown steps are ignored. Null and empty texts come out as ''. Each step is its
    own projection, so Catalyst keeps neighbouring built-in steps in one stage without
    repeating their text. ``backup`` keeps the input as ``<column>_original``.
    """
    options = options or {}
    out = df.withColumn(f"{column}_original", F.col(column)) if backup else df

    def run(frame: DataFrame, change) -> DataFrame:
        return frame.withColumn(column, change(F.col(column)))

    for name in DEFAULT_STEPS if steps is None else steps:
        if name in STEPS:
            out = run(out, STEPS[name])
    for name in OPTION_ORDER:
        if not options.get(name):
            continue
        if name == "lemmatize_text":
            if lemmas is None or key is None:
                raise ValueError("lemmatize_text needs a (word, lemma) table and a key column")
            out = lemmatize(out, column, lemmas, key)
        elif name == "remove_stopwords":
            out = run(out, lambda c: remove_stopwords(c, options.get("stopwords_language", "english")))
        elif name == "filter_language":
            out = run(out, lambda c: filter_language(c, options.get("target_language", "en")))
        elif name == "remove_short_words":
            out = run(out, lambda c: drop_short_words(c, options.get("min_word_length", 2)))
        elif name == "remove_long_words":
            out = run(out, lambda c: drop_long_words(c, options.get("max_word_length", 20)))
        else:
            out = run(out, STEPS[_OPTION_STEP.get(name, name)])
    return run(out, lambda c: F.coalesce(extra_spaces(c), F.lit("")))
