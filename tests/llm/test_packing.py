"""Packing: an exact round trip of ids and places, few sequences, odd input."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarsia.llm import packing

SCHEMA = "doc_id long, text string, piece string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(tokenizer, rows, got, limit=4096):
    want = []
    for doc, text in rows:
        ids = ids_of(tokenizer, text)
        want += [(doc, p, at, len(ids[at : at + limit]), zlib.crc32(np.array(ids[at : at + limit], "<u4").tobytes())) for p, at in enumerate(range(0, len(ids), limit))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(bins)


PARTS = st.one_of(st.text(max_size=8), st.sampled_from(["Hély's", "don't", "ÀÿØ÷×ß", "naïve,", "É", "e\u0301", "x\x1cy", "a\xa0b", " ", "\n", "<|endoftext|>", "foo!!", "İ", "ﬁ", "a.b", "3,4", "Ça_va", "``", "ab'll"]))


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=8).map("".join))
def test_words_by_themselves(text):
    words = packing._words(packing.default_vocabulary())
    assert np.frombuffer(words.ids(text), "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("group", [40_000, 30])
def test_given_table(spark, sf, tokenizer, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    monkeypatch.setattr(packing, "MERGE", 3)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = packing.pack_documents(df).collect()
    n = check(tokenizer, rows, got)
    big = [r.length for r in got]
    assert n <= 1.06 * max(math.ceil(sum(big) / 4096), sum(x > 2048 for x in big)) + 1


def test_items_that_fit_nowhere(spark, tokenizer, monkeypatch):
    """Pieces of more than half a sequence: groups stay bounded at every level, and nothing is lost."""
    monkeypatch.setattr(packing, "GROUP", 30)
    monkeypatch.setattr(packing, "MERGE", 3)
    whole = packing._packed

    def bounded(limit, full, last):
        pack = whole(limit, full, last)

        def checked(df):
            if len(df) > 60:
                raise ValueError(f"a group of {len(df)}")
            return pack(df)

        return checked

    monkeypatch.setattr(packing, "_packed", bounded)
    rows = [(i, "a " * (52 + i % 23)) for i in range(400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert check(tokenizer, rows, packing.pack_documents(df, limit=100).collect(), limit=100) == 400
    mixed = [(i, "a " * (55 if i % 2 else 30)) for i in range(400)]
    df = spark.createDataFrame([(*r, "x") for r in mixed], SCHEMA)
    assert check(tokenizer, mixed, packing.pack_documents(df, limit=100).collect(), limit=100) <= 215


def test_edges(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "word " * 9000), (5, "x" * 30_000), (6, "<|endoftext|> Ünï 12 it's")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    check(tokenizer, rows, packing.pack_documents(df, limit=1000).collect(), limit=1000)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_best_fit():
    at, offset = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert at.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]
