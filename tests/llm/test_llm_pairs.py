"""Near-duplicates, nearest neighbours and the pipeline, held against plain versions."""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trapline.llm import common, graph, hnsw, minhash, secrets
from trapline.llm.common import table

FOLDER, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def plain_classes(rows):
    """Class of each (id, text): smallest id over links of weighted Jaccard 0.8 or more, and equal texts."""
    texts = list(dict.fromkeys(t or "" for _, t in rows))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = sum((a & sets[j]).values())
            if shared and shared >= 0.8 * sum((a | sets[j]).values()) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    place = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        key = place[t or ""]
        if i is not None:
            least[key] = min(least.get(key, i), i)
    return sorted(((i, least.get(place[t or ""])) for i, t in rows), key=repr)


def near_copies(seed=4):
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    rows, n = [], 0
    for _ in range(8):
        base = words(int(rng.integers(30, 200)))
        for _ in range(int(rng.integers(1, 25))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(copy) // 25))):
                copy[rng.integers(len(copy))] = f"x{rng.integers(1000)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + i, " ".join(words(40))) for i in range(20)]
    return rows + [(900, None), (901, ""), (902, "..."), (903, "short one"), (904, "Short, one"), (None, "short one"), (905, rows[0][1]),
                   (905, rows[0][1]), (906, "la " * 3000), (907, "la " * 2900)]


@pytest.mark.parametrize("options", [{}, {"block_texts": 1, "n_pivots": 4}])
def test_classes(spark, options):
    rows = near_copies()
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, id string, tid string")
    got = sorted(((r.id, r.class_id) for r in minhash.classes(frame, **options).collect()), key=repr)
    assert got == plain_classes(rows)


def copies_and_strangers(near, far, seed=9):
    """Copies of one text, and texts that share much with it and are near to none."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 400, 150)]
    rows = []
    for i in range(near + far):
        copy = list(base)
        for at in rng.choice(150, 1 if i < near else 11, replace=False):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy)))
    return rows


def test_a_large_block_takes_no_rounds(spark, monkeypatch):
    rows = copies_and_strangers(60, 60)
    steps = []
    for module in (minhash, graph):
        store = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, store=store: steps.append(name) or store(df, name))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in minhash.classes(frame, block_texts=40, n_pivots=4).collect()}
    assert got == dict(plain_classes(rows)) == {i: 0 if i < 60 else i for i in range(120)}
    assert len(steps) < 25, steps


def test_the_stage_of_near_copies_takes_no_rounds(spark, monkeypatch):
    steps, store = [], minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, name: steps.append(name) or store(df, name))
    monkeypatch.setattr(minhash, "links", partial(minhash.links, block_texts=30, n_pivots=2))
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(copies_and_strangers(50, 40), "doc_id long, text string"), FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(50, 90)]
    assert len(steps) < 10, steps


def test_strangers_of_a_block_are_not_held_against_all(monkeypatch):
    rows = copies_and_strangers(500, 500)
    held, hold = [], minhash._Joined.hold
    monkeypatch.setattr(minhash._Joined, "hold", lambda self, x, others: held.append(len(others)) or hold(self, x, others))
    block = pa.table({"node": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    found = minhash._block_classes(5, 0.8)(block)
    assert found.column("root").to_pylist() == [0 if i < 500 else i for i in range(1000)]
    assert sum(held) < 100 * len(rows)


def test_one_of_each_class_stays(spark):
    rows = near_copies(7)
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = minhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({c for _, c in plain_classes(rows)}, key=repr)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = [f"w{x}" for x in rng.integers(0, 500, 400)]
    texts = [" ".join(a)]
    for n in (5, 15, 40):
        b = list(a)
        for i in rng.integers(0, len(b), n):
            b[i] = "zz"
        texts.append(" ".join(b + b[:50]))
    signed, _ = minhash.signatures(minhash.Shingles(pa.array(texts), 5), len(texts), 2000)
    for i in range(1, len(texts)):
        x, y = shingles(texts[0]), shingles(texts[i])
        exact = sum((x & y).values()) / sum((x | y).values())
        assert abs((signed[0] == signed[i]).mean() - exact) < 0.05


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 50), (201, 50)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 50: 50, 200: 50, 201: 50}


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))) * rng.uniform(0.5, 2, (3000, 1))
    x[1000:1400] = x[1000]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    awkward = [(5000, None, "x"), (5001, [0.0] * 16, "x"), (5002, [float("nan")] * 16, "x"), (5020, [1.0, None] * 8, "x"),
               (None, [1.0] * 16, "x"), (5040, [float("inf")] * 16, "x"), (5060, [1.0, 2.0], "x"), (5061, [3.0, -1.0], "x"), (0, rows[0][1], "x")]
    frame = spark.createDataFrame(rows + awkward, "vec_id long, embedding array<double>, node string")
    got: dict = {}
    for r in hnsw.search(frame, F.col("id") % 20 == 0, shard_rows=700).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(3000) if i % 20 == 0} | {5060}
    assert [v for _, v, _ in got[5060]] == [5061] and got[5060][0][2] == 1.0
    hits = 0
    for q in range(0, 3000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(3000), -scores))[:20]
        assert [n for n, _, _ in got[q]] == list(range(1, 21))
        hits += len(set(want.tolist()) & {v for _, v, _ in got[q]})
    assert hits / (150 * 20) >= 0.95
    assert {v for _, v, _ in got[1000]} <= set(range(1000, 1400)) or got[1000][0][2] >= x[1000] @ x[1000]


def test_empty(spark):
    texts = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(texts).count() == 0 and minhash.keep_one(texts).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.search(vectors, F.col("id") % 20 == 0).count() == 0


def test_pipeline_stages(spark):
    """Each stage's decision holds on what it was given; whole documents come out as they went in."""
    docs = table(spark, FOLDER, "documents")
    given = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    # The lexicon needs more labels than the smallest tables hold.
    toxic = {r.doc_id: r.toxic for r in table(spark, LABELLED, "labels").collect()}
    clean = stage["toxicity"](spark, table(spark, LABELLED, "documents"), LABELLED)
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    gone = [i for i in toxic if i not in left]
    assert sum(toxic[i] for i in gone) > 0.6 * sum(toxic.values()) and sum(1 - toxic[i] for i in gone) < 0.1 * len(toxic)
    rows = sorted(given.items())
    kept = stage["near duplicates"](spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in plain_classes(rows)})
    items = [shingles_of(r.text, 10) for r in table(spark, FOLDER, "benchmark").collect()]
    windows = set().union(*items)
    pure = stage["decontamination"](spark, docs, FOLDER)
    assert sorted(r.doc_id for r in pure.collect()) == [i for i, t in rows if not shingles_of(t, 10) & windows]
    masked = stage["secrets"](spark, docs, FOLDER)
    assert masked.columns == docs.columns
    assert secrets.findings_by_path(masked).where("findings is not null").count() == 0
    changed = {r.doc_id for r in masked.collect() if r.text != given[r.doc_id]}
    assert changed == {r.id for r in secrets.findings_by_path(docs).where("findings is not null").collect()}
    out = corpus_pipeline.run(spark, FOLDER)
    assert 0 < out.count() < len(given) and out.where("not agrees").count() == 0


PASSAGE = "these ten words and some more stand in the benchmark as one item"
ODD = [(1, None), (2, ""), (None, "a text without an id that is long enough for shingles"), (3, "said twice in the table with the same id and text"),
       (3, "said twice in the table with the same id and text"), (4, f"before {PASSAGE} after"), (5, "password = hunter2secret and so on"), (6, "word " * 30_000)]


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([*[(i, 0, 0) for i in range(1, 20) if i != 5], (1, 0, 0), (5, 1, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", PASSAGE), ("i2", None), ("i3", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stages_on_awkward_documents(spark, odd_folder):
    """Nulls, repeated rows, long texts, clashing names and no ``n_chars``."""
    names = ["_toxicity", "toxicity", "score", "id", "tid", "row", "text2", "class_id", "n_words", "spans"]
    docs = spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit("mine").alias(c) for c in names])
    stage = dict(corpus_pipeline.STAGES)
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, odd_folder)
        assert out.columns == docs.columns, name
        kept[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        assert all(r[c] == "mine" for r in out.collect() for c in names), name
        assert function(spark, docs.limit(0), odd_folder).count() == 0, name
    everything = sorted(ODD, key=repr)
    assert kept["toxicity"] == everything
    assert kept["near duplicates"] == sorted({(1, None), *[r for r in ODD if r[0] != 2 and r[0] != 1]}, key=repr)
    assert kept["decontamination"] == sorted((r for r in ODD if r[0] != 4), key=repr)
    assert [t for i, t in kept["secrets"] if i == 5] == ["[SECRET] and so on"] and len(kept["secrets"]) == len(ODD)
    assert [r for r in kept["secrets"] if r[0] != 5] == sorted((r for r in ODD if r[0] != 5), key=repr)
    encoded = stage["encoding"](spark, docs, odd_folder)
    assert encoded.count() == len(ODD) and encoded.where("not agrees").count() == 0
    assert sorted(r.n_tokens for r in encoded.where("doc_id in (1, 2)").collect()) == [1, 1]


def shingles_of(text, n):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_hashes_do_not_depend_on_slabs_or_batches(monkeypatch):
    texts = pa.array(["", None, "x" * 700 + " y", "é à " * 90, "a b c d e f g"])
    whole = common.Words(texts)
    monkeypatch.setattr(common, "SLAB", 64)
    common._powers_for.cache_clear()
    small = common.Words(texts)
    common._powers_for.cache_clear()
    assert (whole.hash == small.hash).all() and len(whole.hash) == 189
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    assert [p.num_rows for p in common.chunks(batch, "text", 1 << 20, 2)] == [2, 2, 1]
