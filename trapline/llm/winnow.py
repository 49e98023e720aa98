"""Benchmark decontamination by winnowing.

The k-gram with the smallest hash of every sliding window becomes a fingerprint.
A passage of ``window`` words has ``window - k + 1`` k-grams, and both sides choose
from them alike, so every shared passage of that length shares a fingerprint. A
fixed-size bitmap of the benchmark's fingerprints thins those of the corpus
before the shuffle; joined fingerprints are extended word by word, so results are
exact.

Defined cases: null and empty texts have no words; an item shorter than the
window, but with words, must occur whole; a null item id reads as ``null``;
repeated rows get the same result each; empty tables give empty results or
zeros. Only the named columns are read, others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trapline.llm import common
from trapline.session import materialise

BITMAP_BITS = 26  # 8 MB, whatever the benchmark's size
HIT = "struct<k:int,fp:long,pos:int,left:array<string>,mid:array<string>,right:array<string>>"


def _selected(hashes: np.ndarray, doc: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Places of the k-grams that are smallest in some window of ``width``; ties all count."""
    n = len(hashes) - width + 1
    if n <= 0:
        return common.EMPTY
    low = hashes[:n].copy()
    for j in range(1, width):
        np.minimum(low, hashes[j:j + n], out=low)
    whole = (doc[:n] == doc[width - 1:width - 1 + n]) & valid[width - 1:width - 1 + n]
    chosen = np.zeros(len(hashes), dtype=bool)
    for j in range(width):
        chosen[j:j + n] |= whole & (hashes[j:j + n] == low)
    return np.flatnonzero(chosen)


def _fingerprints(words: common.Words, window: int, k: int, short: list[int]):
    """(k, window, places, hashes): for whole windows, and for each length of short items."""
    hashes, valid = words.grams(k)
    at = _selected(hashes, words.doc[:len(hashes)], valid, window - k + 1)
    yield k, window, at, hashes[at]
    for n in short:
        hashes, valid = words.grams(n)
        at = np.flatnonzero(valid)
        yield n, n, at, hashes[at]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _hits(words: common.Words, window: int, k: int, short: list[int], kept) -> list[list[dict]]:
    """For each text, its fingerprints with the words around that one window can reach."""
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    for size, reach, at, hashes in _fingerprints(words, window, k, short):
        if kept is not None:
            slots = _slots(hashes)
            near = (kept[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0
            at, hashes = at[near], hashes[near]
        for i, h in zip(at.tolist(), hashes.astype(np.int64).tolist()):
            d = int(words.doc[i])
            lo, hi = int(words.first[d]), int(words.first[d + 1])
            out[d].append({
                "k": reach, "fp": h, "pos": i - lo, "left": words.words(max(lo, i - reach + size), i),
                "mid": words.words(i, i + size), "right": words.words(i + size, min(hi, i + reach))})
    return out


def _scanner(window: int, k: int, short: list[int], bitmap):
    def scan(batches):
        kept = None if bitmap is None else np.frombuffer(bitmap.value, dtype=np.uint8)
        fields = pa.list_(pa.struct([
            ("k", pa.int32()), ("fp", pa.int64()), ("pos", pa.int32()), ("left", pa.list_(pa.string())),
            ("mid", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
        for batch in batches:
            for part in common.chunks(batch, "text"):
                words = common.Words(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("tid"), pa.array(np.diff(words.first), pa.int64()),
                     pa.array(_hits(words, window, k, short, kept), fields)], ["id", "tid", "n_words", "hits"])

    return scan


def _scan(df: DataFrame, id_col: str, text_col: str, window: int, k: int, short: list[int], bitmap) -> DataFrame:
    kind = dict(df.dtypes)[id_col]
    text = common.text_of(text_col)
    return df.select(F.col(id_col).alias("id"), common.digest(text).alias("tid"), text.alias("text")).mapInArrow(
        _scanner(window, k, short, bitmap), f"id {kind}, tid binary, n_words long, hits array<{HIT}>")


def _bitmap(fingerprints: DataFrame):
    """The benchmark's fingerprints as a broadcast of ``2 ** BITMAP_BITS`` bits."""
    slot = F.shiftrightunsigned("fp", 64 - BITMAP_BITS)
    rows = (fingerprints.select(F.shiftright(slot, 5).alias("at"), slot.bitwiseAND(31).cast("int").alias("bit"))
            .groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    got = rows.toArrow()
    words = np.zeros(1 << (BITMAP_BITS - 5), dtype="<u4")
    words[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return fingerprints.sparkSession.sparkContext.broadcast(words.tobytes())


def _extend(batches):
    """The part of a document around a shared fingerprint that also stands in the item."""
    def same(a, b):
        n = 0
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        return n

    for batch in batches:
        keep, begin, end = [], [], []
        for i, r in enumerate(batch.drop_columns(["tid", "item"]).to_pylist()):
            if r["mid"] != r["i_mid"]:
                continue
            back = same(r["left"][::-1], r["i_left"][::-1])
            on = same(r["right"], r["i_right"])
            if back + len(r["mid"]) + on >= r["k"]:
                keep.append(i)
                begin.append(r["pos"] - back)
                end.append(r["pos"] + len(r["mid"]) + on)
        got = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [got.column("tid"), got.column("item"), pa.array(begin, pa.int32()), pa.array(end, pa.int32())],
            ["tid", "item", "begin", "end"])


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5):
    """(documents, spans): each row's ``id, tid, n_words``, and the hit word spans
    ``tid, item, begin, end`` of each distinct text ``tid``, by item."""
    items = materialise(_scan(benchmark, item_id, item_text, window, k, [], None).select("id", "n_words"), "item-sizes")
    short = [r[0] for r in items.where(F.col("n_words").between(1, window - 1)).select("n_words").distinct().collect()]
    # At most window - 1 lengths; short items yield only fingerprints of their own length.
    found = _scan(benchmark, item_id, item_text, window, k, sorted(short), None)
    item_hits = materialise(
        found.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("item"), "n_words", F.explode("hits").alias("h"))
        .where(F.col("h.k") == F.least(F.lit(window), "n_words"))
        .select("item", "h.k", "h.fp", F.col("h.left").alias("i_left"), F.col("h.mid").alias("i_mid"), F.col("h.right").alias("i_right"))
        .distinct(), "item-fingerprints")
    scanned = materialise(_scan(documents, id_col, text_col, window, k, sorted(short), _bitmap(item_hits.select("fp"))), "scanned")
    hits = (scanned.where(F.size("hits") > 0).select("tid", F.explode("hits").alias("h"))
            .select("tid", "h.*").distinct())
    spans = (hits.join(item_hits, ["k", "fp"])
             .select("tid", "item", "k", "pos", "left", "mid", "right", "i_left", "i_mid", "i_right")
             .mapInArrow(_extend, "tid binary, item string, begin int, end int"))
    return scanned.select("id", "tid", "n_words"), spans.distinct()


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: ``id, n_words, n_hit, n_items, items, contaminated``."""
    rows, spans = contamination(documents, benchmark, **options)
    spans = materialise(spans, "spans")
    order = Window.partitionBy("tid").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    lengths = (spans.select("tid", "begin", "end").distinct()
               .select("tid", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(before, F.lit(0)))).alias("n"))
               .groupBy("tid").agg(F.sum("n").alias("n_hit")))
    named = spans.groupBy("tid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = lengths.join(named, "tid")
    return rows.join(found, "tid", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def keep_clean(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, all columns kept, without those that hold any window of the benchmark."""
    _, spans = contamination(documents, benchmark, id_col=id_col, text_col=text_col, **options)
    hit = spans.select("tid").distinct()
    rows = documents.select(common.digest(common.text_of(text_col)).alias("tid"),
                            F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.join(hit, "tid", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
