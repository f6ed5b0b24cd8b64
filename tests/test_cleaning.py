import itertools

import pytest
from pyspark.sql import functions as F

from labelmill.functions import cleaning as C
from labelmill.functions.stemming import stem
from labelmill.operators import budget, conversations, quality, training

CASES = [
    (C.clean_html, "<p>Hi &amp; <b>you</b></p><!-- no --><script>x()</script> &lt;3", "Hi & you <3"),
    (lambda c: C.clean_html(c, skip_scripts=False), "<style>p{}</style>a", "p{}a"),
    (C.clean_html, "plain", "plain"),
    (C.fix_encoding, "cafÃ© â€œxâ€\x9d", "café “x”"),
    (C.fix_encoding, "café naïve", "café naïve"),
    (C.fix_encoding, "日本 Ã©", "日本 Ã©"),
    (C.normalize_unicode, "ﬁne １２", "fine 12"),
    (C.normalize_whitespace, "  a\t\nb　c ", "a b c"),
    (C.normalize_quotes, "`a´ «b» “c”", "'a' \"b\" “c”"),
    (lambda c: C.normalize_quotes(c, curly=True), "“c” ‘d’", "\"c\" 'd'"),
    (C.normalize_dashes, "a–b—c―d−e", "a-b-c-d-e"),
    (C.squeeze_punctuation, "no!!! what?? wait..... a----b", "no! what? wait... a--b"),
    (C.fix_typos, "Teh cat and  and of of of éof of", "the cat and of of éof of"),
    (C.remove_urls, "see https://a.b/c?d=1 or www.x.y now", "see  or  now"),
    (C.normalize_numbers, "1,234 and 1,234,567; 5k, 5 K, 2 million 5km", "1234 and 1234,567; 5000, 5000, 2000000 5km"),
    (C.expand_contractions, "I can't, won't; it's he'll they've I'm John's", "I cannot, will not; it is he will they have I am John's"),
    (C.remove_special, "a#b, (c) é_1 <d>", "ab, (c) é_1 d"),
    (lambda c: C.remove_special(c, keep_basic=False), "a, b!", "a b"),
    (C.fix_case, "this is GREAT and OK.  next one? ÉCOLE", "This is Great and OK. Next one? ÉCOLE"),
    (C.squeeze_repeats, "soooo coool !!!!! \n\n\n\n", "soo coool !! \n\n\n\n"),
    (C.emoji_to_name, "ok 😀!", "ok :grinning_face:!"),
    (lambda c: C.emoji_to_name(c, ""), "😀", "grinning_face"),
    (C.remove_stopwords, "This is not the end, my friend", "end , friend"),
    (C.stem_text, "Running ponies happily", "run poni happili"),
    (C.remove_punctuation, "a.b,c!(d)", "abcd"),
    (C.remove_digits, "a1b٢c", "abc"),
    (C.remove_single_chars, "a bc d é fg", " bc   fg"),
    (C.strip_accents, "éàü ß x", "eau  x"),
    (C.extra_spaces, " a  b\nc ", "a b\nc"),
    (C.sentence_join, "One.  Two!\nThree", "One. Two! Three"),
    (C.drop_short_words, "a bb c ddd", "bb ddd"),
    (lambda c: C.drop_long_words(c, 3), "a bbbb ccc", "a ccc"),
    (C.expand_dosage_terms, "5 MG bid, mgx", "5 milligrams twice daily, mgx"),
    (C.detect_language, "der Hund und die Katze", "de"),
    (C.detect_language, "zzz", None),
    (C.filter_language, "the cat is in the house", "the cat is in the house"),
    (C.filter_language, "le chat et la souris", ""),
]


def test_steps(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(CASES)], "i int, t string")
    out = df.select(*[f(F.col("t")).alias(f"c{i}") for i, (f, _, _) in enumerate(CASES)], "i").collect()
    wrong = [(i, CASES[i][1], r[f"c{i}"], CASES[i][2]) for r in out for i in [r.i] if r[f"c{i}"] != CASES[i][2]]
    assert not wrong


def test_null_and_empty_are_left_alone(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    for name, step in C.STEPS.items():
        if name != "filter_language":
            assert [r[0] for r in df.select(step(F.col("t"))).collect()] == [None, ""], name
    assert [r[0] for r in C.clean_text(df, "t").collect()] == ["", ""]


def test_whole_chain(spark):
    df = spark.createDataFrame([("<p>I  can't   wait!!! teh END is NEAR</p>",)], "t string")
    out = C.clean_text(df, "t", options={"fix_case": True, "to_lowercase": True}, backup=True).first()
    assert out.t == "i cannot wait! the end is near" and out.t_original.startswith("<p>")
    assert C.clean_text(df, "t", steps=["unknown", "to_uppercase"]).first().t.startswith("<P>I CAN'T")
    with pytest.raises(ValueError, match="lemma"):
        C.clean_text(df, "t", options={"lemmatize_text": True})


def test_lemmas_are_looked_up_in_place(spark, monkeypatch):
    """Repeated and null keys, repeated and null lemmas, both ways; no token is shuffled in place."""
    rows = [(1, "Cats ran."), (1, "cats sat"), (2, "Dogs' ran, dogs ran"), (3, ""), (4, None), (5, " \t"), (None, "cats"), (6, "x " * 3000 + "ran")]
    lemmas = spark.createDataFrame([("cats", "cat"), ("ran", "run"), ("ran", "flee"), ("dogs", None), (None, "no")], "word string, lemma string")
    df = spark.createDataFrame(rows, "k int, t string")
    want = [(None, ""), (1, "cat cat flee run sat ."), (1, "cat cat flee run sat ."), (2, "Dogs ' flee run , dogs flee run"), (3, ""), (4, None), (5, ""), (6, "x " * 3000 + "flee run")]
    order = lambda out: sorted(map(tuple, out.collect()), key=lambda r: (r[0] or 0, r[1] or ""))
    out = C.lemmatize(df, "t", lemmas, "k")
    assert order(out) == want
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert order(C.lemmatize(df, "t", lemmas.limit(0), "k"))[3] == (2, "Dogs ' ran , dogs ran")
    monkeypatch.setattr(C, "LEMMAS_IN_PLACE", 0)
    assert order(C.lemmatize(df, "t", lemmas, "k")) == want


def test_costly_chains_run_where_they_change_something(spark):
    words = [f(w) for w in C.DOUBLED_WORDS for f in (str, str.upper, str.title)] + ["i\u017f"]
    texts = [f"{a}{w}\u2003 {w.lower()}{b}" for w in words for a in ("", "x ", ".") for b in ("", " y", ",")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(F.rlike("t", F.lit(C._DOUBLED))).count() == len(texts)
    assert df.filter(C.fix_typos(F.col("t")) == F.col("t")).count() == 0
    plain = spark.createDataFrame([("the cat and a dog",)], "t string").filter(F.rlike("t", F.lit(C._DOUBLED)))
    assert plain.count() == 0


def test_squeeze_repeats_against_brute_force(spark):
    texts = ["".join(p) for n in range(1, 8) for p in itertools.product("a\n", repeat=n)]
    want = ["".join(c * (2 if c != "\n" and len(g) > 3 else len(g)) for c, g in ((k, list(v)) for k, v in itertools.groupby(t))) for t in texts]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.squeeze_repeats(F.col("t"))).collect()
    assert [r[0] for r in got] == want


def test_porter():
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
        "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file",
        "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "operator": "oper",
        "feudalism": "feudal", "decisiveness": "decis", "triplicate": "triplic", "electrical": "electr", "hopefulness": "hope", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun",
        "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener",
    }
    assert {w: stem(w) for w in known} == known


def test_quality(spark):
    df = spark.createDataFrame([("a b! https://x.y",), ("",), (None,)], "t string")
    q = quality.quality_profile(df, "t").first()
    assert (q.total_items, q.valid_items, q.empty_items, q.avg_words, q.items_with_urls, q.max_length) == (3, 1, 2, 3.0, 1, 16)
    assert quality.quality_profile(df.limit(0), "t").first().avg_length == 0


def test_tokens(spark):
    df = spark.createDataFrame([("one two three",), (None,)], "t string")
    got = budget.count_tokens(df, "t", "sys", "Q: {t}").collect()
    assert [(r.text_tokens, r.request_tokens, r.text_missing) for r in got] == [(3, 6, False), (0, 2, True)]
    exact = budget.count_tokens(df, "t", "sys", "Q: {t}", tokenizer=len).first()
    assert (exact.text_tokens, exact.request_tokens) == (13, 3 + 16)
    assert budget.template_tokens("Say: {text} now", "t") == 2


def trained(spark, n=3000):
    hot = F.when(F.col("id") % 3 == 0, F.concat(F.lit("l"), (F.col("id") % 7).cast("string"))).otherwise("hot")
    return spark.range(n).select("id", hot.alias("label"))


def expected(df, quota):
    import hashlib

    groups = {}
    for r in df.collect():
        groups.setdefault(r.label, []).append((hashlib.md5(f"42:{r.id}".encode()).hexdigest(), r.id))
    return {i for k, v in groups.items() for _, i in sorted(v)[: quota(k, len(v), len(groups))]}


@pytest.mark.parametrize("parts", [1, 7])
def test_sampling_against_brute_force(spark, parts):
    df = trained(spark).repartition(parts)
    got = {r.id for r in training.sample_balanced(df, "id", "label", 800).collect()}
    assert got == expected(df, lambda k, n, g: 800 // g) and len(got) == 800
    assert training.sample_balanced(df, "id", "label", 5000).count() == 3000
    assert training.sample_random(df, "id", 0).count() == 0 and training.sample_random(df, "id", 10).count() == 10
    split = {r.split: r["count"] for r in training.train_eval_split(df, "id", 0.1).groupBy("split").count().collect()}
    assert split == {"train": 2700, "eval": 300}
    prop = training.sample_proportional(df, "id", "label", 30).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in prop}["hot"] == 20


def test_class_weights(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "l string")
    got = lambda w: {r.label: r.weight for r in training.class_weights(df, "l", w).collect()}
    assert got("balanced") == {"a": 0.75, "b": 1.5} and got(None) == {"a": 1.0, "b": 1.0}
    assert got([1, 2.5]) == {"a": 1.0, "b": 2.5} and got({"b": 3, "a": 1}) == {"a": 1.0, "b": 3.0}
    for bad in ([1.0], {"a": 1.0}, 5):
        with pytest.raises(ValueError):
            training.class_weights(df, "l", bad)


def conv(spark, turns):
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")


def test_conversations(spark):
    df = conv(spark, [("system", "s" * 40), ("user", "u" * 40), ("tool", "x"), ("assistant", "a" * 40)])
    chat = conversations.format_chat(df).first().chat
    assert chat.endswith("<|im_start|>assistant\n" + "a" * 40) and "x" not in chat.replace("<|", "")
    kept = lambda n: sorted(r.turn for r in conversations.truncate_conversations(df, n).collect())
    assert kept(1000) == [0, 1, 2, 3] and kept(50) == [0, 2, 3] and kept(45) == [0, 3] and kept(5) == [0]
    assert conversations.validate_conversations(df).first().error == "message 2: tool messages must have a tool_call_id"
    ids = spark.createDataFrame([(1,), (2,)], "conv_id bigint")
    got = {r.conv_id: r.error for r in conversations.validate_conversations(df, all_conversations=ids).collect()}
    assert got[2] == "conversation cannot be empty"


def test_tool_call_tokens(spark):
    df = spark.createDataFrame([("abcdefgh", [("1", "function", ("name", "arguments"))])], "text string, calls array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")
    assert df.select(budget.message_tokens(F.col("text"), F.col("calls"))).first()[0] == 12 + 1 + 2 + 20


def test_repair_encoding(spark):
    """Chains of wrong readings, mixed with intact text; clean text stays."""
    twice = lambda t, *codecs: t if not codecs else twice(t.encode("utf-8").decode(codecs[0]), *codecs[1:])
    texts = ["café “naïve” – über ß", "日本語 и русский", "Ελλάδα €5", "ñandú"]
    cases = [(t, t) for t in texts] + [(twice(t, "latin-1"), t) for t in texts] + [(twice(t, "latin-1", "latin-1"), t) for t in texts]
    cases += [(twice("ñandú é", "mac_roman"), "ñandú é"), (twice("Zażółć", "cp437"), "Zażółć"), (twice("é", "latin-1") + " 日本 " + twice("ü", "latin-1", "cp1252"), "é 日本 ü")]
    cases += [("É« É€ «Été»", "É« É€ «Été»"), ("Èèé Èèê", "Èèé Èèê"), ("Сёмка ёё", "Сёмка ёё"), (None, None), ("", ""), ("plain", "plain"), ("cafÃ© â€œxâ€\x9d", "café “x”")]
    df = spark.createDataFrame(cases, "dirty string, want string").withColumn("got", C.repair_encoding(F.col("dirty")))
    assert [r.got for r in df.collect()] == [w for _, w in cases]


def test_learned_abbreviations_end_no_sentence(spark):
    from labelmill.operators import sentences

    text = [f"Dr. Smith saw {n} cases, e.g. one of approx. {n} days. The case was closed. We saw Mr. Jones. He left the house." for n in range(60)]
    text += ["The days were long. Cases of this kind, z.B. one house, left us. One saw the days."] * 20 + ["Closed house, long ago, and us Jones: days left the case"] * 60 + [None, ""]
    docs = spark.createDataFrame([(t,) for t in text], "text string")
    known = sentences.abbreviations(docs)
    assert {"dr", "mr", "e.g", "z.b"} <= set(known) and not {"days", "house", "closed", "cases", "us"} & set(known)
    df = spark.createDataFrame([("Mr.  Jones left.  Dr. Smith, e.g. today. Why?\nThe mr. end. Amr. Next",)], "t string")
    got = df.select(C.sentences(F.col("t"), known).alias("s"), C.sentence_join(F.col("t"), known).alias("j")).first()
    assert got.s == ["Mr.  Jones left.", "Dr. Smith, e.g. today.", "Why?", "The mr. end.", "Amr.", "Next"] and got.j == " ".join(got.s)
    assert df.select(F.size(C.sentences(F.col("t")))).first()[0] == 10
