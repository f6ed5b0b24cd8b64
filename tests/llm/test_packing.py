"""Packing: tokens, pieces and bins."""

import numpy as np
from hypothesis import given, settings, strategies as st

from labelmill.llm import packing


def _plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n\nx y", "it's we'll  go", "<|endoftext|> a b", "naïve é 12 345!!", "tab\tx y", "a b c", "x  y", "end.\nNew line $$$ %%%", "😀 😀a"]


def test_ids_equal_the_tokenizer():
    enc, tok = packing.ByteLevelEncoder(packing.tokenizer_path()), _plain()
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(ODD)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Z.\n\t'sé1 !", max_size=25), max_size=4))
def test_ids_of_any_text(texts):
    enc, tok = packing.encoder(packing.tokenizer_path()), _TOK
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


_TOK = _plain()


def test_cut_lengths():
    assert packing.cut_lengths(5, 4) == [1, 4]
    assert packing.cut_lengths(8, 4) == [4, 4]
    assert packing.cut_lengths(3, 4) == [3]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8), st.integers(0, 40))
def test_fullest_against_brute_force(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
    got = packing.fullest(counts, room)
    assert sum(k * n for k, n in got.items()) == max(sums)
    assert all(n <= counts[k] for k, n in got.items())


def test_plan_uses_every_piece_once():
    counts = {2048: 7, 1500: 11, 548: 13, 100: 40, 1: 3}
    used = dict.fromkeys(counts, 0)
    for times, content in packing.plan_bins(counts, 2048):
        assert sum(k * n for k, n in content.items()) <= 2048
        for k, n in content.items():
            used[k] += n * times
    assert used == counts


def test_pack_covers_documents(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "word " * 5000, "y"), (None, "z", "y"), (1, "a b c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = packing.pack(docs, capacity=64).toPandas()
    assert len(got[got.doc_id == 1]) == 2 and got[got.doc_id == 2].length.tolist() == [1]
    four = got[got.doc_id == 4].sort_values("piece")
    assert four.start.tolist() == [0, *np.cumsum(four.length)[:-1]] and (four.length[1:] == 64).all()
    for _, b in got.sort_values("offset").groupby("sequence_id"):
        assert b.offset.tolist() == [0, *np.cumsum(b.length)[:-1]] and b.length.sum() <= 64
    assert packing.pack(docs.limit(0)).count() == 0
