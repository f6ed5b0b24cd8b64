"""Operators on small tables: brute force, nulls, ties, repeats, empty tables, extra columns."""

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa

import pytest
from pyspark.sql import functions as F

from labelmill.llm import contamination, html_text, language, ngram_join, quality, sharding, substring, vectors, warc
from labelmill.llm.graph import components

SENTENCE = "the quick brown fox jumps over one lazy dog while many small birds sing in tall green trees near our old stone house today".split()
LONG = " ".join(f"w{i % 97}x{i // 97}" for i in range(300))


def documents(spark, extra=True):
    near = LONG.split()
    near[5] = "CHANGED"
    rows = [
        (1, LONG), (2, LONG), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (8, "Two  WORDS"), (9, " ".join(SENTENCE)), (10, "intro " + " ".join(SENTENCE) + " outro é"),
        (None, LONG.upper()), (11, "x" * 50_000), (12, " ".join(SENTENCE) + " " + " ".join(SENTENCE)), (7, "two words"), (13, "a b c d e f g " * 400),
    ]
    cols = "doc_id long, text string"
    if extra:  # names that operators use themselves
        rows = [(*r, 5, "z", None) for r in rows]
        cols += ", n_words long, score string, block binary"
    return spark.createDataFrame(rows, cols)


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (10, 9), (9, 11)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 10: 9, 11: 9} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_jaccard(spark):
    docs = documents(spark)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    want = set()
    for i, s in rows:
        reach, todo = [], [(i, s)]
        while todo:
            j, t = todo.pop()
            reach.append((j, t))
            todo += [x for x in rows if x not in reach and x not in todo and t and 100 * len(t & x[1]) >= 80 * len(t | x[1])]
        want.add((i, len(s), min((j for j, _ in reach if j is not None), default=None)))
    assert got == want
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_ngram_jaccard_group_of_near_copies(spark):
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        words = list(base)
        for j in rng.choice(200, rng.integers(1, 6), replace=False):
            words[j] = f"e{i}_{j}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:25] + [f"o{i}_{j}" for j in range(60)])) for i in range(60)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, root = {i: shingles(t) for i, t in rows}, {}
    for i in sets:
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                root[j] = i
                todo += [k for k in sets if k not in root and k not in todo and 100 * len(sets[j] & sets[k]) >= 80 * len(sets[j] | sets[k])]
    assert got == root


def test_ngram_jaccard_only_candidates_go_on(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"r{x}" for x in rng.integers(0, 1 << 40, 60 + i))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20)]  # copies alone are no partners
    for i in range(20, 60):  # from clear partners to clear strangers, around the threshold
        words = rows[i][1].split()
        words[: (i - 20) // 2] = [f"n{i}_{j}" for j in range((i - 20) // 2)]
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = ngram_join.document_sets(docs).localCheckpoint()
    passed = ngram_join.may_link(docs, sets, 1 << 20).select("row").distinct()
    got = {r.doc_id for r in sets.join(passed, "row").collect()}
    want = {i: shingles(t) for i, t in rows}
    partners = {i for i, a in want.items() for b in want.values() if a != b and 100 * len(a & b) >= 80 * len(a | b)}
    assert partners and partners <= got
    assert not got & ({i for i in range(20)} | {100 + i for i in range(20)})
    roots = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert roots == {i: min(j for j, b in want.items() if 100 * len(a & b) >= 80 * len(a | b)) for i, a in want.items()}


def test_ngram_jaccard_posted_bytes():
    """What the first pass sends for a shingle stays small however many blocks there are."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"r{x}" for x in rng.integers(0, 1 << 40, 300)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for blocks in (16, 4096):
        posted = ngram_join._seen([ngram_join._sampled(batch, 5)], blocks)
        assert sum(len(x) for c in posted.columns[1:] for x in c.to_pylist()) <= 8 * 200 * 296
    told = ngram_join._shared_counts(ngram_join._seen([ngram_join._sampled(batch, 5)], 16).to_pandas())
    assert not len(told)


def test_ngram_jaccard_passes_over_texts(spark):
    """Sets and the postings of sampled columns come from one pass; with the sum of their
    bytes and the second pass, every text is made three times."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return " ".join(f"w{j}" for j in range(i, i + 40))

    docs = spark.range(100).select(F.col("id").alias("doc_id"), text.asNondeterministic()(1000 * F.col("id")).alias("text"))
    rows = ngram_join._named_sets(docs, 5, 80).collect()
    assert len({r.root for r in rows}) == 100 and {r.n_shingles for r in rows} == {36}
    assert made.value <= 300


def test_ngram_jaccard_column_of_one_component():
    """A frequent column whose rows are nearly all of one component makes about as many pairs as rows."""
    m = 3000
    root = np.append(np.zeros(m, np.int64), 7)
    n, row, zero = np.full(m + 1, 40), np.arange(m + 1), np.zeros(m + 1, np.int64)
    pairs = [(x, y) for x, y, *_ in ngram_join._column_pairs(zero, row, zero, n, root, 80)]
    assert sum(len(x) for x, _ in pairs) == m
    columns = ngram_join.column_bits(np.arange(8, dtype=np.uint64))
    pdf = pd.DataFrame({"g": 5, "cls": row - 10, "n": n, "pos": zero, "root": root, "first_pos": zero, "last": 9, "bits": [columns] * (m + 1)})
    got = ngram_join._cross_pairs(80)(pdf)
    assert {tuple(x) for x in got.itertuples(index=False)} == {(i - 10, m - 10) for i in range(m)}
    sizes = pdf.assign(root=row, n=row + 1)  # each is paired with those of 100/80 of its size at most
    assert sum(len(x) for x, *_ in ngram_join._column_pairs(zero, row, zero, sizes["n"].to_numpy(), row, 80)) < m * m / 7
    many = np.repeat(np.arange(9), 500)  # more pairs than one batch holds
    whole = [(x, y) for x, y, *_ in ngram_join._column_pairs(np.zeros(4500, int), np.arange(4500), np.zeros(4500, int), np.full(4500, 9), many, 80)]
    assert len(whole) > 1 and len({p for x, y in whole for p in zip(x.tolist(), y.tolist()) if many[p[0]] != many[p[1]]}) == 36 * 500 * 500


def test_one_per_component_looks_up_grouped_rows_only(spark):
    """Rows without a near copy stay where they are, without a join; results are those of brute force."""
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"r{x}" for x in rng.integers(0, 1 << 40, 30))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(10)] + [(i, rows[i][1]) for i in range(5, 15)] + [(None, rows[20][1]), (None, "alone of all"), (3, " \t\n"), (3, " \t\n"), (4, None)]
    out = ngram_join.one_per_component(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([*rows[:40], (None, "alone of all"), (3, " \t\n"), (3, " \t\n"), (4, None)], key=str)
    branches = out._jdf.queryExecution().optimizedPlan().children()
    assert "Join" not in branches.apply(0).toString()


def test_substring_dedup(spark):
    docs = documents(spark).filter("doc_id is not null and not (doc_id = 7)")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.deduplicate(docs).collect()}
    seen, want = set(), {}
    for i, text in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        words = text.encode().split()
        keep = [True] * len(words)
        for p in range(len(words) - 19):
            w = tuple(words[p : p + 20])
            if w in seen:
                keep[p : p + 20] = [False] * 20
            seen.add(w)
        want[i] = (len(words), keep.count(False), b" ".join(w for w, k in zip(words, keep) if k).decode())
    assert got == want
    out = substring.deduplicate(documents(spark))
    assert out.count() == 15 and {"score", "block", "factors"} <= set(out.columns)
    assert out.filter("doc_id = 7").select("n_removed").distinct().count() == 1
    assert substring.deduplicate(documents(spark).limit(0)).count() == 0


def test_windows_around_one_phrase_are_told_apart():
    """300,000 different texts share a phrase, and so one block: none repeats another."""
    import pyarrow as pa

    n = 300_000
    texts = pa.array([f"a{i} b{i} c{i} d{i} e{i} f{i} the very same phrase of eight words here g{i} h{i} i{i} j{i} k{i} l{i}" for i in range(n)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), texts], names=["_id", "text"])
    posts = pa.Table.from_batches(substring._posts(batch, 20, 8, 1)).to_pandas()
    assert len(substring._block_factors(posts)) == 0


def test_factors_name_their_source(spark):
    docs = documents(spark).filter("doc_id in (1, 3, 10, 9)")
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    for r in substring.deduplicate(docs).collect():
        for f in r.factors:
            assert texts[r.doc_id][f.start : f.start + f.n_words] == texts[f.source_doc][f.source_start : f.source_start + f.n_words]
            assert (f.source_doc, f.source_start) < (r.doc_id, f.start) and f.n_words >= 20


def test_one_per_component_tells_rows_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a39", "other")
    rows = [(1, a), (1, a), (9, near), (9, c), (None, a), (None, b), (None, b), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS cls", "3 AS row")
    got = sorted(((r.doc_id, r.text) for r in ngram_join.one_per_component(docs).collect()), key=str)
    assert got == sorted([(1, a), (9, c), (None, b), (5, ""), (5, ""), (6, None)], key=str)


def test_decontaminate_rows_that_share_an_id(spark):
    leak, clean = " ".join(SENTENCE[:14]), " ".join(f"w{i}" for i in range(30))
    rows = [(1, leak), (1, clean), (None, leak), (None, clean), (None, leak)]
    out = contamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text, r.n_hit) for r in out.collect()), key=str) == sorted([(i, t, 14 if t == leak else 0) for i, t in rows], key=str)


def test_decontaminate(spark):
    items = [(1, " ".join(SENTENCE[:14])), (2, "Two Words"), (3, None), (4, "..."), (20, " ".join(SENTENCE[3:13])), (5, "q"), (1, "é")]
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination.decontaminate(documents(spark), spark.createDataFrame(items, "item_id long, text string")).collect()}
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for r in documents(spark).collect():
        words, hit, found = low(r.text), set(), set()
        for i, t in items:
            w = low(t)
            for k in range(max(1, len(w) - 9)) if w else ():
                win = w[k : k + 10]
                for p in range(len(words) - len(win) + 1):
                    if words[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(i))
        assert got[r.doc_id, len(words)] == (len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)), r.doc_id
    none = contamination.decontaminate(documents(spark), spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("contaminated").count() == 0 and none.count() == 15
    assert contamination.decontaminate(documents(spark).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_sharding(spark):
    out = sharding.shard(documents(spark), 4).toPandas()
    assert len(out) == 15 and (out["size"] >= 8).all()
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert out[out.doc_id.isin([1, 2])].shard.nunique() == 1 and out[out.doc_id.isin([4, 5])].shard.nunique() == 1
    assert sharding.shard(documents(spark).limit(0), 4).count() == 0


def test_differencing_keeps_sums_and_balances():
    rng = np.random.default_rng(1)
    sums = np.zeros((400, 24), np.int64)
    sums[:, 0] = rng.integers(10, 10_000, 400)
    to, total = sharding.difference(sums)
    again = np.zeros(24, np.int64)
    np.add.at(again, to[:, 0], sums[:, 0])
    assert (again == total).all() and total.max() - total.min() < 10_000 * 0.05
    assert all(sorted(row) == list(range(24)) for row in to)


def test_sharding_in_levels(spark):
    groups = spark.range(3000).selectExpr("id as grp", "pmod(xxhash64(id), 5000) + 10 as bytes")
    got = sharding.balanced_groups(groups, 8, chunk=100).join(groups, "grp").groupBy("shard").sum("bytes").toPandas()
    assert len(got) == 8 and got["sum(bytes)"].max() - got["sum(bytes)"].min() <= 20


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    rows = [(i, [float(x) for x in base[i % 30] + 0.04 * rng.standard_normal(16)], i % 2) for i in range(400)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 0), (503, [float("inf")] + [1.0] * 15, 0), (504, rows[0][1], None), (505, rows[0][1], 0), (506, [2 * x for x in rows[0][1]], 0), (507, [1.0, 2.0], 0), (None, rows[1][1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()}
    good = [(i, np.array(v), l) for i, v, l in rows if v is not None and l is not None and np.isfinite(v).all() and np.any(v)]
    links = {i: [] for i, *_ in rows}
    for i, v, l in good:
        for j, w, m in good:
            if i != j and l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].append(j)
    for i in links:
        reach, todo = {i}, [i]
        while todo:
            new = [x for x in links[todo.pop()] if x not in reach]
            reach |= set(new)
            todo += new
        least = min((x for x in reach if x is not None), default=None)
        assert got[i] == (len(links[i]), least, i == least), i
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_block_counts_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SIDE", 64)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in centre + 0.01 * rng.standard_normal(16)], 1) for i in range(300)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=4).toPandas()
    assert (got.n_links == 299).all() and (got.component_id == 0).all() and got.kept.sum() == 1


def dense_label(n, pairs, shared):
    """Vectors with mutual cosine ``shared``, the last ``pairs`` of them each with a partner
    at cosine 0.985: (rows, links)."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    v = unit(np.sqrt(shared) * unit(rng.standard_normal(64)) + np.sqrt(1 - shared) * unit(rng.standard_normal((n, 64))))
    away = rng.standard_normal((pairs, 64))
    away = unit(away - (away * v[-pairs:]).sum(1, keepdims=True) * v[-pairs:])
    v = np.concatenate((v, 0.985 * v[-pairs:] + np.sqrt(1 - 0.985**2) * away))
    return [(i, x.tolist(), 1) for i, x in enumerate(v)], (v @ v.T >= 0.98) & ~np.eye(len(v), dtype=bool)


@pytest.mark.parametrize("run", [2048, 64])
def test_vectors_of_a_dense_label(spark, monkeypatch, run):
    monkeypatch.setattr(vectors, "RUN", run)
    rows, links = dense_label(3000, 150, 0.95 if run == 2048 else 0.8)
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    assert links.sum() >= 300
    missed = int((links.sum(1) != got.n_links).sum())
    assert missed == 0 if run == 2048 else missed <= 2
    assert (got.kept == (got.component_id == got.index)).all()


def test_vectors_of_a_large_label_lose_no_link(spark, monkeypatch):
    """A small dense cloud in a large sparse label, whatever number of passes is estimated for it."""
    monkeypatch.setattr(vectors, "RUN", 64)
    monkeypatch.setattr(vectors, "passes_for", lambda *_: 1)
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    centre, away = unit(rng.standard_normal(64)), rng.standard_normal((200, 64))
    away = unit(away - (away @ centre)[:, None] * centre)
    v = np.concatenate((unit(rng.standard_normal((4000, 64))), np.sqrt(0.978) * centre + np.sqrt(1 - 0.978) * away))
    got = vectors.near_duplicates(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    links = (v @ v.T >= 0.98).sum(1) - 1
    assert links.sum() > 1000 and (got.n_links == links).all()


def test_far_blocks_are_not_compared(spark):
    """Two clouds of one label, three blocks each: no pair of blocks across them is left."""
    rows = [(1, q, [float(x) for x in (q // 3 + 0.01 * k + 0.001 * np.arange(vectors.DIRECTIONS))]) for q in range(6) for k in range(3)]
    near = vectors._near_blocks(spark.createDataFrame(rows, "root long, q long, place array<double>"), 0.98).collect()
    assert {r.q: sorted({(p.i, p.j) for p in r.pairs}) for r in near} == {q: sorted((min(q, o), max(q, o)) for o in range(q // 3 * 3, q // 3 * 3 + 3)) for q in range(6)} and {r.n for r in near} == {6}


def test_passes_follow_from_measured_prefixes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RUN", 64)
    passes = {}
    for shared in (0.0, 0.8):
        rows, _ = dense_label(3000, 1, shared)
        one = spark.createDataFrame(rows, "cls long, embedding array<double>, grp long").selectExpr("*", "64 as dim")
        passes[shared] = vectors.group_passes(one, vectors._group_means(one), vectors.WINDOW, vectors.THRESHOLD)[1]
    assert vectors.LEAST_PASSES <= passes[0.0] < passes[0.8] < 3000 / 64


def test_words_of_items_are_the_contract_s(spark):
    """Every code point of the first two planes stands in a word or parts words as in the contract's class."""
    from pyspark.sql import functions as F

    points = spark.createDataFrame([(f"a{chr(i)}a",) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000], "t string")
    as_said = F.regexp_extract_all(F.translate("t", contamination._UPPER, contamination._LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    assert points.filter(~contamination._words(F.col("t")).eqNullSafe(as_said)).count() == 0
    assert points.filter(F.regexp_count("t", F.lit(contamination.WORD)) != F.size(as_said)).count() == 0
    assert not contamination.WORD.startswith("[^")  # the complement's test of each letter against all ranges took most of the time


def test_language(spark):
    de, en = "der die und nicht werden schon über straße müssen haben", "the and with nothing shall often street through having"
    rows = [(i, " ".join(np.random.default_rng(i).permutation((de if i % 2 else en).split())) * 3, "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 %% 3", "x"), (4, de, "x"), (5, en * 2000, "x"), (6, "Die Straße", "x")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, filters).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["und", "und", "und", "de", "en", "de"] and all(0 <= s <= 1 for _, s in got.values())
    none = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    h = language.text_grams(["straße"])[0]
    assert (filters.languages_of(h) & np.uint64(1 << filters.languages.index("de"))).all()


@pytest.mark.parametrize("fold, rest", [(language.held_out, 3), (quality.held_out, 5)])
def test_folds(spark, fold, rest):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(50).selectExpr("id as doc_id").select("doc_id", fold().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % rest == (1 if rest == 3 else 0) for i in range(50)}


def test_quality(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    good = [" ".join(word() for _ in range(40)) + "." for _ in range(80)]
    bad = [" ".join(word() + "$$$" for _ in range(40)) for _ in range(80)]
    model = quality.fit(spark.createDataFrame([(t, 1) for t in good] + [(t, 0) for t in bad], "text string, label int"))
    rows = [(1, good[0], "s"), (2, bad[0], None), (3, None, "s"), (4, "", "s"), (5, bad[1] * 500, "s")]
    out = quality.score(spark.createDataFrame(rows, "doc_id long, text string, score string"), model)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[5].predicted == 0 and got[3].score == got[4].score and 0 <= got[3].score <= 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for rows in ([], [("a", 1)], [("a", 0)]):
        one = quality.fit(spark.createDataFrame(rows, "text string, label int"))
        assert quality.score(out.drop("score", "predicted"), one).count() == 5


PAGE = """<html><head><title>t</title><script>var a="</p><p>no";</script></head><body class="has-sidebar"><div class="menu"><a href=x>Home</a> <a>B</a></div><div id="content"><h1>Title &amp; more</h1>
<div class="text"><p>Long para one with words   and words that go on &eacute;.<p>Second<br>line  here
 x.<ul><li>a<li>b</ul></div><div class="comments"><p>Reader says hello and a lot more words than you would think</p></div></div><div class="cookie-notice">We use cookies</div><form>f</form><footer>f</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Title & more\nLong para one with words and words that go on é.\nSecond\nline here x.\na\nb"
    rows = [(1, PAGE, "u"), (2, None, "u"), (3, "", None), (4, "plain < text", "u"), (5, "<p>" + "word " * 200_000, "u"), (6, "<<<>>></p></div>", "u"), (7, "<!-- only", "u"), (8, "<div>" * 3000 + "deep", "u"), (1, PAGE, "u")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).toPandas()
    assert (got.n_chars == got.text.str.len()).all() and len(got) == 9
    by = dict(zip(got.page_id, got.text))
    assert by[2] == by[3] == by[7] == "" and by[4] == "plain < text" and by[5] == ("word " * 200_000).strip() and by[8] == "deep"


def test_html_open_head_and_form_around_the_page():
    text = "<div><p>" + "some words of text " * 9 + "</p><p>More of it.</p></div>"
    want = ("some words of text " * 9).strip() + "\nMore of it."
    for head in ("<head><title>t</title>", "<head><meta charset=x><style>a</style>", "<head><title>t</title></head>"):
        assert html_text.main_text(f"<html>{head}<body>{text}</body></html>") == want
        assert html_text.main_text(f"<html>{head}{text}</html>") == want
        framed = f"<body><form id=aspnet><label>Find</label><input><select><option>o</select>{text}<button>Go</button></form></body>"
        assert html_text.main_text(f"<html>{head}{framed}</html>") == want
    assert html_text.main_text("<head><title>t</title>plain") == "plain"
    assert html_text.main_text(f"<body>{text}<form><p>Send us a line</p><input></form></body>") == want


@pytest.mark.parametrize("frame", ["article", "main"])
def test_html_keeps_parts_of_the_article_with_ambiguous_names(frame):
    parts = ['<section id="discussion"><p>a one</p></section>', '<h2 id="related-work">b two</h2>', '<h2 id="comments-on-the-method">c three</h2>', '<div class="social-history"><p>d four</p></div>', '<section id="navigation"><p>e <a>5</a> five</p></section>']
    extra = '<div class="share"><a>Post</a></div><div class="related-posts"><a>Other</a> <a>More</a></div><div class="ad">Buy</div><div class="newsletter-signup">Join</div>'
    page = f"<body><{frame}><p>Start of it.</p>{''.join(parts)}{extra}</{frame}></body>"
    assert html_text.main_text(page) == "Start of it.\na one\nb two\nc three\nd four\ne 5 five"


@pytest.mark.parametrize("n, size", [(6, 500), (4, 300)])
def test_html_keeps_text_beside_the_densest_container(n, size):
    body = "".join(f"<p>{'w' * size}</p>" for _ in range(n))
    for last in (f"<div><p>{'e' * (size - 50)}</p></div>", "<ul><li>e</li><li>f <a>g</a> more</li></ul>", "bare <b>e</b> text and <a>one</a>"):
        got = html_text.main_text(f"<body><p>Start.</p><div>{body}</div>{last}<ul><li><a>Home</a></li><li><a>Up</a></li></ul><a>Top</a></body>").split("\n")
        want = [re.sub("<[^>]*>", "", x) for x in re.split("</li><li>", last)]
        assert got == ["Start.", *["w" * size] * n, *want], last


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (3, "http://é/", ""), (3, "http://é/", "")], "page_id long, url string, html string")
    resp = warc.responses(pages)
    out = warc.derivatives(resp)
    rows = out.collect()
    assert len(rows) == 8 and {r.warc_type for r in rows} == {"metadata", "conversion"}
    source = {r.source_key: r for r in resp.collect()}
    for r in rows:
        s = source[r.source_key]
        assert r.refers_to == s.record_id and r.target_uri == s.target_uri and r.content_length == len(r.block) and r.block_digest == warc.python_digest(bytes(r.block))
        if r.warc_type == "metadata":
            assert s.payload_digest in bytes(r.block).decode() and "source-http-Content-Type: text/html" in bytes(r.block).decode()
        else:
            assert bytes(r.block).decode() == html_text.main_text({1: PAGE}.get(r.source_key))
    back = warc.read_records(out.select(warc.serialized(out).alias("data"))).select(*warc.COLUMNS, "block")
    key = lambda r: (r.record_id, bytes(r.block))
    assert sorted(map(key, back.collect())) == sorted(map(key, rows))
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_character_sets_and_media_types(spark):
    block = lambda media, body: f"HTTP/1.1 200 OK\r\n{media}\r\n\r\n".encode() + body
    html = "<html><body><article><p>" + "Über die Straße ging es weiter, Schritt für Schritt. " * 12 + "</p></article></body></html>"
    want = html_text.main_text(html)
    cases = {
        "latin": (block("Content-Type: text/html; charset=ISO-8859-1", html.encode("latin-1")), want),
        "quoted": (block('content-type:text/html;charset="windows-1252"', html.encode("cp1252")), want),
        "utf8": (block("Content-Type: text/html; charset=utf-8", html.encode()), want),
        "untold": (block("Server: x", html.encode()), want),
        "unknown": (block("Content-Type: text/html; charset=no-such-set", html.encode()), want),
        "wrong": (block("Content-Type: text/html", html.encode("latin-1")), want.replace("Ü", "\ufffd").replace("ß", "\ufffd").replace("ü", "\ufffd")),
        "plain": (block("Content-Type: text/plain", b"if a<b and c>d then keep"), "if a<b and c>d then keep"),
        "pdf": (block("Content-Type: application/pdf", b"%PDF \xff\xfe"), None),
        "null": (None, ""),
    }
    rows = spark.createDataFrame([(k, "response", f"<{k}>", b) for k, (b, _) in cases.items()], "source_key string, warc_type string, record_id string, block binary")
    for c in ("target_uri", "warc_date", "payload_digest", "block_digest", "content_type"):
        rows = rows.selectExpr("*", f"cast(null as string) as {c}")
    out = warc.derivatives(rows.selectExpr("*", "0L as content_length", "1 as _head", "2 as _kind")).collect()
    assert {r.source_key for r in out if r.warc_type == "metadata"} == set(cases)
    assert {r.source_key: bytes(r.block).decode() for r in out if r.warc_type == "conversion"} == {k: w for k, (_, w) in cases.items() if w is not None}
    pdf = next(bytes(r.block).decode() for r in out if r.source_key == "pdf")
    assert "conversion-record-id" not in pdf and "source-http-Content-Type: application/pdf" in pdf


def test_warc_records_cut_short():
    whole = b"WARC/1.0\r\nWARC-Type:metadata\r\nContent-Length:3\r\n\r\nabc\r\n\r\n"
    assert [(r["warc_type"], r["block"]) for r in warc.parse_records(whole * 2 + whole[:-8])] == [("metadata", b"abc")] * 2
    assert warc.parse_records(whole[:30]) == [] and warc.parse_records(b"WARC/1.0\r\nA: b\r\n\r\nx") == [] and warc.parse_records(b"") == []
