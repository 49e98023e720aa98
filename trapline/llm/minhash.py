"""Near-duplicates by DartMinHash.

A text is the multiset of its five-word shingles. Every shingle owns an unbounded plane of
(weight, rank), cut into regions whose sides double. Hashing a shingle with a region gives the
darts in it: how many, and the weight, rank and coordinate of each. A text keeps
the darts below its own weights, and for each coordinate the one of least rank; two
texts agree in a coordinate with a chance equal to their weighted Jaccard
similarity. Ranks are taken region by region until every coordinate has a dart, so
the work is about k log k darts a text, however long.

Bands of coordinates give candidates: texts that share a bucket, directly or over
others, form a block. A block of bounded size is read by one task, which joins texts
into classes, exactly, on whole texts: a few texts are held against all, and then each
text against those that share one of its rarest shingles and are not in its class yet.
Near texts have so much in common that they must share one of these. Larger blocks are
never gathered: they are dealt into parts, every two parts are joined by one task, and
the classes found are put together. Both ways give the same classes.

Defined cases: a text of fewer than five words is one shingle; texts without words,
null ones among them, are classes of equal texts; equal rows share a class; a null id is kept (and
sorts last when a class takes its smallest id as its name); empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trapline.llm import common, graph
from trapline.session import materialise

BASE_RANK = 2.0 ** -12  # side of the first rank region; the sides after it double
SALT = np.uint64(0x632BE59BD9B4E019)
SKETCH_TEXTS = 256  # signed together: a text throws a few thousand darts at once


class Shingles:
    """Distinct shingles of a run of texts: ``doc``, ``hash`` and ``weight`` (occurrences), ordered by doc."""

    def __init__(self, texts: pa.Array, size: int):
        words = common.Words(texts)
        hashes, valid = words.grams(size)
        at = np.flatnonzero(valid)
        doc, value = words.doc[at], hashes[at]
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            joined = [" ".join(words.words(int(words.first[d]), int(words.first[d + 1]))) for d in short]
            data, bounds = common.flat_bytes(pa.array(joined))
            doc = np.concatenate([doc, short])
            value = np.concatenate([value, common.span_hashes(data, bounds[:-1], bounds[1:])])
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        self.doc, self.hash = doc[first], value[first]
        self.weight = np.diff(np.append(first, len(doc))).astype(float)
        self.total = np.bincount(self.doc, weights=self.weight, minlength=len(texts))


@lru_cache(maxsize=256)
def _counts(mean: float) -> np.ndarray:
    """Cumulative chances of a Poisson count."""
    chance, total, out = np.exp(-mean), 0.0, []
    for i in range(int(mean + 12 * mean ** 0.5 + 24)):
        total += chance
        out.append(total)
        chance *= mean / (i + 1)
    return np.array(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) * 2.0 ** -53


def _edges(i: int, base: float) -> tuple[float, float]:
    return (0.0, base) if i == 0 else (base * 2.0 ** (i - 1), base * 2.0 ** i)


def _region(shingles: Shingles, chosen: np.ndarray, across: int, up: int, k: int):
    """(doc, coordinate, rank, dart) of the darts in one region that lie below their shingles' weights."""
    left, right = _edges(across, 1.0)
    low, high = _edges(up, BASE_RANK)
    with np.errstate(over="ignore"):
        own = common.mix(shingles.hash[chosen] + SALT * np.uint64(1 + across * 64 + up))
    thrown = np.searchsorted(_counts((right - left) * (high - low) * k), _unit(own), side="right")
    hit = np.flatnonzero(thrown)
    dart_of = np.repeat(hit, thrown[hit])
    nth = np.arange(len(dart_of)) - np.repeat(np.cumsum(thrown[hit]) - thrown[hit], thrown[hit])
    with np.errstate(over="ignore"):
        dart = common.mix(own[dart_of] ^ (SALT * (nth.astype(np.uint64) + np.uint64(1))))
        weight = left + (right - left) * _unit(common.mix(dart + np.uint64(1)))
        rank = low + (high - low) * _unit(common.mix(dart + np.uint64(2)))
        coordinate = (common.mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
    at = chosen[dart_of]
    kept = weight < shingles.weight[at]
    return shingles.doc[at][kept], coordinate[kept], rank[kept], dart[kept]


def signatures(shingles: Shingles, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(dart of least rank by text and coordinate, whether the text has shingles at all)."""
    ranks = np.full((n_docs, k), np.inf)
    darts = np.zeros((n_docs, k), dtype=np.uint64)
    open_docs = shingles.total > 0
    has = open_docs.copy()
    up = 0
    while open_docs.any():
        chosen = np.flatnonzero(open_docs[shingles.doc])
        across = 0
        while len(chosen):
            doc, coordinate, rank, dart = _region(shingles, chosen, across, up, k)
            order = np.argsort(rank, kind="stable")[::-1]
            doc, coordinate, rank, dart = doc[order], coordinate[order], rank[order], dart[order]
            better = rank < ranks[doc, coordinate]
            doc, coordinate, rank, dart = doc[better], coordinate[better], rank[better], dart[better]
            # The last write to a place wins: the least rank.
            ranks[doc, coordinate] = rank
            darts[doc, coordinate] = dart
            across += 1
            chosen = chosen[shingles.weight[chosen] > _edges(across, 1.0)[0]]
        # All darts up to this rank are in: a text whose coordinates all have one is done.
        open_docs &= np.isinf(ranks).any(axis=1)
        up += 1
    return darts, has


def _banded(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part in common.chunks(batch, "text", 1 << 20, SKETCH_TEXTS):
                n = part.num_rows
                darts, has = signatures(Shingles(part.column("text"), size), n, bands * rows)
                keys = np.zeros((n, bands), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        keys = common.mix(keys * np.uint64(0x9E3779B97F4A7C15) + darts[:, r * bands:(r + 1) * bands])
                    keys = common.mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * SALT)
                listed = [row if ok else [] for row, ok in zip(keys.astype(np.int64).tolist(), has)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("tid"), pa.array(listed, pa.list_(pa.int64()))], ["id", "tid", "keys"])

    return run


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of so many places for each start, one run after the other."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _elements(block: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element) of a block's texts, and how many elements each has.

    The t-th occurrence of a shingle is an element of its own, so shared elements add up to the smaller weight.
    """
    docs, elements, totals, row = [], [], [], 0
    for batch in block.to_batches():
        for part in common.chunks(batch, "text"):
            s = Shingles(part.column("text"), size)
            times = s.weight.astype(np.int64)
            nth = _ranges(np.zeros(len(times), dtype=np.int64), times)
            with np.errstate(over="ignore"):
                elements.append(common.mix(np.repeat(s.hash, times) + nth.astype(np.uint64) * SALT))
            docs.append(np.repeat(s.doc + row, times).astype(np.int32))
            totals.append(s.total)
            row += part.num_rows
    return np.concatenate(docs), np.concatenate(elements), np.concatenate(totals)


class _Joined:
    """Classes of texts, given as their elements, that grow as texts are held against others.

    Texts are in the order of their lengths, elements in the order of their rarity; elements that only one text
    has are left out of the lists and counted in ``alone``.
    """

    def __init__(self, doc: np.ndarray, element: np.ndarray, total: np.ndarray, least: float):
        self.n, self.least = len(total), least
        self.by_length = np.argsort(total, kind="stable")
        place = np.empty(self.n, dtype=np.int64)
        place[self.by_length] = np.arange(self.n)
        self.total = total[self.by_length]
        order = np.argsort(element, kind="stable")
        doc, element = place[doc[order]], element[order]
        new = np.ones(len(element), dtype=bool)
        new[1:] = element[1:] != element[:-1]
        held = np.diff(np.append(np.flatnonzero(new), len(element)))
        rarity = np.empty(len(held), dtype=np.int32)
        rarity[np.argsort(held, kind="stable")] = np.arange(len(held), dtype=np.int32)
        shared = np.repeat(held > 1, held)
        self.alone = np.bincount(doc[~shared], minlength=self.n)
        ids, self.company = np.repeat(rarity, held)[shared], np.bincount(doc, weights=np.repeat(held - 1, held), minlength=self.n)
        doc = doc[shared]
        order = np.lexsort((ids, doc))
        self.ids = ids[order]
        self.first = np.searchsorted(doc[order], np.arange(self.n + 1))
        self.rare = np.clip(np.ceil(self.total / 4) - self.alone, 0, np.diff(self.first)).astype(np.int64)
        self.mark = np.zeros(len(held), dtype=bool)
        self.label = np.arange(self.n)

    def _shared(self, texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many of so many first elements of each text are marked."""
        if 4 * lengths.sum() > len(self.ids):
            upto = np.concatenate([[0], np.cumsum(self.mark[self.ids], dtype=np.int32)])
            return upto[self.first[texts] + lengths] - upto[self.first[texts]]
        upto = np.concatenate([[0], np.cumsum(self.mark[self.ids[_ranges(self.first[texts], lengths)]], dtype=np.int32)])
        ends = np.cumsum(lengths)
        return upto[ends] - upto[ends - lengths]

    def hold(self, x: int, others: np.ndarray) -> None:
        """Join a text to those of the others that are near it, by all their elements."""
        mine = self.ids[self.first[x]:self.first[x + 1]]
        self.mark[mine] = True
        near = lambda shared: (shared > 0) & (shared >= (self.least - 1e-12) * (self.total[x] + self.total[others] - shared))
        # The rarest quarter goes first: many that miss there could not be near if they shared all the rest.
        rare = self.rare[others]
        others = others[near(self.total[others] - self.alone[others] - rare + self._shared(others, rare))]
        others = others[near(self._shared(others, self.first[others + 1] - self.first[others]))]
        self.mark[mine] = False
        own = np.unique(np.append(self.label[others], self.label[x]))
        if len(own) > 1:
            self.label[np.isin(self.label, own)] = own[0]

    def hold_pivots(self, n_pivots: int) -> None:
        """Hold texts with the most company, each near to none of those before it, against all."""
        company = self.company.copy()
        for _ in range(n_pivots):
            x = int(np.argmax(company))
            if company[x] <= 0:
                break
            self.hold(x, np.arange(self.n))
            company[self.label == self.label[x]] = 0

    def hold_candidates(self, budget: int) -> None:
        """Hold texts against all those they could be near to and are not yet in a class with.

        Near texts share so many elements that one of them must be among the rarest few of the shorter text and
        among the rarest few of the longer one: as many as the text may have more than it shares.
        """
        n, least = self.n, self.least
        listed = np.diff(self.first)
        few = lambda share: np.clip(self.total - np.ceil(share * self.total - 1e-6) + 1 - self.alone, 0, listed).astype(np.int64)
        as_longer, as_shorter = few(least), few(2 * least / (1 + least))
        posted = np.repeat(np.arange(n), as_shorter)
        posts = np.sort(self.ids[_ranges(self.first[:-1], as_shorter)].astype(np.int64) * n + posted)
        shortest = np.searchsorted(self.total, least * self.total - 1e-6)
        # Texts of the largest class need not look at each other.
        inside = self.label == np.argmax(np.bincount(self.label, minlength=n))
        for rows, keys in ((np.flatnonzero(~inside), posts), (np.flatnonzero(inside), posts[~inside[posts % n]])):
            x = np.repeat(rows, as_longer[rows])
            wanted = self.ids[_ranges(self.first[rows], as_longer[rows])].astype(np.int64) * n
            begin = np.searchsorted(keys, wanted + shortest[x])
            many = np.searchsorted(keys, wanted + x) - begin
            read = np.concatenate([[0], np.cumsum(many)])
            ends = np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)) if len(x) else common.EMPTY
            at = 0
            while at < len(x):
                # Texts whose lists have about ``budget`` entries together.
                within = ends[(ends > at) & (read[ends] <= read[at] + budget)]
                to = int(within[-1] if len(within) else ends[np.searchsorted(ends, at, side="right")])
                pairs = np.unique(np.repeat(x[at:to], many[at:to]) * n + keys[_ranges(begin[at:to], many[at:to])] % n)
                left, right = pairs // n, pairs % n
                cuts = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else common.EMPTY
                for one, others in zip(left[cuts].tolist(), np.split(right, cuts[1:])):
                    others = others[self.label[others] != self.label[one]]
                    if len(others):
                        self.hold(one, others)
                at = to

    def labels(self) -> np.ndarray:
        """A number for each text that those of its class share, in the order the texts were given."""
        out = np.empty(self.n, dtype=np.int64)
        out[self.by_length] = self.label
        return out


def _block_classes(size: int, least: float, n_pivots: int = 32, budget: int = 1_000_000):
    """Classes of one block, by its shared elements."""
    def run(block: pa.Table) -> pa.Table:
        node = block.column("node").to_numpy()
        joined = _Joined(*_elements(block, size), least)
        joined.hold_pivots(n_pivots)
        if (joined.label != joined.label[0]).any():
            joined.hold_candidates(budget)
        label = joined.labels()
        least_node = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least_node, label, node)
        return pa.table({"node": node, "root": least_node[label]})

    return run


def links(sketched: DataFrame, texts: DataFrame, *, size: int = 5, least: float = 0.8, n_pivots: int = 32,
          block_texts: int = 32_768, block_chars: int = 40_000_000) -> DataFrame:
    """``node, root``: classes of the candidate texts under links of similarity ``least`` or more.

    ``sketched`` has ``node, keys``, ``texts`` has ``node, text``. Blocks up to the two bounds go to one task each; those
    beyond are dealt into parts of half a bound, and every two parts go to a task.
    """
    members = sketched.select("node", F.explode("keys").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last")
    blocks = graph.components(members.join(heads, "bucket").select(F.col("node").alias("a"), F.col("head").alias("b")))
    wanted = materialise(texts.join(blocks.withColumnRenamed("root", "block"), "node"), "candidate-texts")
    sizes = wanted.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    parts = F.greatest(F.ceil(F.col("n") / max(1, block_texts // 2)), F.ceil(F.col("chars") / max(1, block_chars // 2)))
    large = materialise(sizes.where((F.col("n") > block_texts) | (F.col("chars") > block_chars)).select("block", parts.alias("parts")), "large-blocks")
    resolve, result = _block_classes(size, least, n_pivots), "node long, root long"
    roots = wanted.join(large, "block", "left_anti").select("node", "text", "block").groupBy("block").applyInArrow(resolve, result)
    if large.isEmpty():
        return roots
    dealt = (wanted.join(large, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part <> other")
             .select("node", "text", "block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")))
    stars = dealt.groupBy("block", "low", "high").applyInArrow(resolve, result)
    return roots.unionByName(graph.components(stars.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def classes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8,
            bands: int = 42, rows: int = 6, **options) -> DataFrame:
    """One row per row of ``documents``: ``id, tid, class_id, class_tid, n_texts``.

    ``class_id`` is the smallest id of the class, ``class_tid`` the digest of a text that carries it, ``n_texts``
    the number of different texts in the class.
    With 42 bands of 6 a pair at 0.8 escapes all buckets with a chance of 3e-6.
    """
    kind = dict(documents.dtypes)[id_col]
    text = common.text_of(text_col)
    source = documents.select(F.col(id_col).alias("id"), common.digest(text).alias("tid"), text.alias("text"))
    sketched = materialise(source.mapInArrow(_banded(size, bands, rows), f"id {kind}, tid binary, keys array<long>"), "sketches")
    nodes = materialise(sketched.groupBy("tid").agg(F.min("id").alias("least_id"), F.first("keys").alias("keys"))
                        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = source.select("tid", "text").join(nodes.select("tid", "node"), "tid").select("node", "text").dropDuplicates(["node"])
    roots = links(nodes.select("node", "keys"), texts, size=size, least=least, **options)
    named = nodes.select("tid", "node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(
        F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "tid")).alias("best"), F.count("*").alias("n_texts"))
    by_text = named.join(best, "root").select("tid", F.col("best.least_id").alias("class_id"), F.col("best.tid").alias("class_tid"), "n_texts")
    return sketched.select("id", "tid").join(by_text, "tid").select("id", "tid", "class_id", "class_tid", "n_texts")


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, all columns kept, with one document of each class: the one with the smallest id."""
    found = classes(documents, id_col=id_col, text_col=text_col, **options)
    chosen = found.where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("tid") == F.col("class_tid"))).select("id", "tid").distinct()
    rows = documents.select(F.col(id_col).alias("id"), common.digest(common.text_of(text_col)).alias("tid"),
                            F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    matched = rows.join(chosen, rows["tid"].eqNullSafe(chosen["tid"]) & rows["id"].eqNullSafe(chosen["id"]), "left_semi")
    # Repeated rows of the kept document are copies of each other too.
    return matched.dropDuplicates(["tid"]).select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
