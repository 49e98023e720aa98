"""Alignment of two tokenizers, held against whole texts encoded by the libraries."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from trapline.llm import alignment
from trapline.llm.queries import BYTES_JSON, PIECES, tokenizer_path

SCHEMA = "doc_id long, text string, id string, n_a string, groups string, pair string"
A, B = tokenizer_path(BYTES_JSON), tokenizer_path(PIECES)
TEXTS = [
    None, "", " ", "  two  spaces ", "\n", "line\n\nafter\n", "it's don't we'll I'd", "tab\there \t x", "Ünïcode straße 🙂🙂", "a ▁ mark", "nul \x00 in",
    "<|endoftext|> and </s> <s> <0x0A>", "   \n  x", "x   \n\n   y", "nbsp\xa0 y  wide", "᠎ odd ​ blank﻿ x \x1c y", "word " * 5_000, "y" * 20_000,
    "same text twice", "same text twice", "1234567890 12,345.67 ===>> ///", "日本語のテキスト と English", "\r\n windows\r\n lines \r\n", "'s 't 're",
]


def plain(texts):
    """Groups and links of each text by the definition, and the counts of all pairs."""
    align = alignment.Aligner(A, B)
    found, counts = [], Counter()
    for text in texts:
        a = align.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = align.b.encode(text) if text else []
        bytes_a, bytes_b = [align.a_bytes[i] for i in a], [align.b_bytes[i] for i in b]
        if not text or b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, links, before = [], [], 0
        for end in common:
            ours = [a[i] for i, e in enumerate(ends_a) if before < e <= end] if len(a) < 3_000 else a[ends_a.index(before) + 1 if before else 0:ends_a.index(end) + 1]
            theirs = [b[i] for i, e in enumerate(ends_b) if before < e <= end] if len(a) < 3_000 else b[ends_b.index(before) + 1 if before else 0:ends_b.index(end) + 1]
            groups.append(f"{','.join(map(str, ours))}|{','.join(map(str, theirs))}")
            links.append((ours[-1], theirs[-1]))
            before = end
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [(n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups))
            for n_a, n_b, groups, links in found], counts


def rows_of(df):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("cache", [alignment.CACHE, 300])
def test_every_text_as_the_libraries_encode_it_whole(spark, monkeypatch, cache):
    monkeypatch.setattr(alignment, "CACHE", cache)
    rng = random.Random(4)
    letters = ["a", "the", "ing", " ", " ", "  ", "\n", "\t", "'s", "1", "é", "\xa0", ".", "🙂", "\r", "-"]
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want, counts = plain(texts)
    assert rows_of(alignment.align_texts(df, A, B)) == want
    found = alignment.link_counts(df, A, B)
    size = len(alignment.Aligner(A, B).b_bytes)
    assert {(k // size, k % size): n for k, n in zip(found.pairs.keys.tolist(), found.counts.tolist())} == dict(counts)
    table = alignment.pair_table(spark, found, B)
    assert {(r["a"], r["b"]): r["n"] for r in table.collect()} == dict(counts)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.orderBy("doc_id").collect()
    assert rows_of(alignment.align_texts(df, A, B)) == plain([r["text"] for r in rows])[0]


def test_nothing_to_align(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert alignment.align_texts(nothing, A, B).count() == 0
    nulls = spark.createDataFrame([(None, None, "x", "x", "x", "x"), (1, "", "x", "x", "x", "x")], SCHEMA)
    assert [r[1:] for r in alignment.align_texts(nulls, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_counts_of_another_corpus(spark):
    here = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    there = spark.createDataFrame([(1, "one three")], "doc_id long, text string")
    row = alignment.align_texts(here, A, B, counts=alignment.link_counts(there, A, B)).first()
    assert (row["n_links"], row["n_best"], row["count_sum"]) == (2, 1, 1)


def test_numbers_without_gaps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1_000, 100_000):
        keys = np.unique(rng.integers(0, 2**40, n))
        numbered = alignment.Numbered(keys)
        assert sorted(numbered.hash(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 2**40, 1_000), keys)
        assert (numbered.number(others) == -1).all() and (numbered.keys[numbered.number(keys)] == keys).all()


def test_vectors_are_added_as_a_tree(spark):
    parts = spark.range(0, 5_000, 1, 70).selectExpr("id % 31 * 7 AS pair", "id AS n")
    pairs = alignment.Numbered(np.arange(31) * 7)
    total = alignment.summed(parts, pairs)
    assert {int(k): int(total[i]) for i, k in enumerate(pairs.keys)} == {k * 7: sum(range(k, 5_000, 31)) for k in range(31)}


def test_bound_follows_the_vocabularies():
    bound = alignment.Aligner(A, B).pair_bound()
    assert 32_000 < bound < 1_000_000
