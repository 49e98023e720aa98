"""Fill-in-middle, held against plain cuts."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trapline.llm import infilling

SCHEMA = "doc_id long, text string, id string, n string, h1 string, output string"
TEXTS = [None, "", "\n", "one", "one\n", "a\nb\nc", "a\n\n\nb\n", "has <P> in it\nx", "<S>", "x<M", "<\nP>\nS>\n", "Ü🙂\n\x00\n\r\n", "line\n" * 30_000, "z" * 100_000, "twice\ntwice\n", "twice\ntwice\n"]


def units(text, unit):
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    if unit == "character":
        return list(text)
    if unit == "word":
        return re.findall(r"(?:\A\s+)?\S+\s*|\A\s+\Z", text)
    out, held = [], ""
    for i, c in enumerate(text):
        held += c
        if c == "\n" and (i == 0 or text[i - 1] == "\n"):
            out, held = [*out, held], ""
    return [*out, held] if held else out


def plain(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    parts = units(text, unit)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or h[2] % 100 >= rate or any(x in text for x in infilling.MARKS):
        return len(parts), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def held_against(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(2)
    moved = infilling.rearrange(df, **options).withColumn("back", infilling.restore(F.col("output"), F.col("form")))
    got = sorted(((r["id"], *r[1:6]) for r in moved.drop("back").collect()), key=repr)
    kind = {"unit": options.get("unit", "line"), "rate": options.get("rate", 100), "spm": options.get("spm_rate", 50)}
    assert got == sorted(((i, *plain(i, t, **kind)) for i, t in rows), key=repr)
    assert sorted(r["back"] for r in moved.collect()) == sorted(t or "" for _, t in rows)


@pytest.mark.parametrize("options", [{}, {"unit": "word"}, {"unit": "paragraph"}, {"unit": "character"}, {"rate": 40, "spm_rate": 0}, {"spm_rate": 100}])
def test_awkward_and_random_texts(spark, options):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab \n\t🙂") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    held_against(spark, [*enumerate(texts), (None, "no id\nhere"), (3, "id again\nx")], **options)


def test_empty_table(spark):
    assert infilling.rearrange(spark.createDataFrame([], SCHEMA)).count() == 0


def test_refused_options(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="unknown unit"):
        infilling.rearrange(df, unit="page")
    with pytest.raises(ValueError, match="overlap"):
        infilling.rearrange(df, marks=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError, match="overlap"):
        infilling.rearrange(df, marks=("ab", "bc", "<M>"))


def test_ranks_count(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 1_000):
        symbols = rng.integers(0, 5, n).astype(np.uint8)
        matrix = infilling.WaveletMatrix(symbols)
        places = np.arange(n + 1)
        for s in range(5):
            assert matrix.rank(s, places).tolist() == [0, *np.cumsum(symbols == s).tolist()]
