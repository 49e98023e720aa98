"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters and digits read as the
letters they stand for, everything else as spaces. An Aho-Corasick automaton finds
all terms in one pass. Hits inside an exception phrase do not count. The weighted
sum of hits is normalised by length and a logistic curve turns it into a score.

Terms and weights are learned here, from labelled texts: whole words and character
n-grams that stand in more of the toxic texts, weighted by the logarithm of how
much more; a text counts once for a term, however long it is. Every term that passes the
thresholds is kept. Counting runs on the cluster; only the lexicon, which the labelled
sample bounds, and three numbers for each of its texts come to the driver.

Defined cases: null and empty texts score as a text without hits; labels without a
text, null labels and null ids are not learned from; an id labelled twice is toxic if any
label says so; without both classes the lexicon is empty and every score is the share of toxic labels
(0 without labels); repeated rows give repeated results; empty tables give
empty results. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm import common
from trapline.session import materialise

# Look-alikes and what they are read as.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
EXCEPTIONS = ("trash can", "trash bag", "class clown", "clown fish", "idiot proof", "hate to say")


class _Folding(dict):
    """Character by character, filled as characters turn up; full-width forms read as plain ones."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            c = chr(code - 0xFEE0).lower()
        c = LOOKALIKES.get(c, c)
        self[code] = c if c.isalpha() else " "
        return self[code]


_FOLDING = _Folding()


def fold(text: str) -> str:
    return f" {text.lower().translate(_FOLDING)} "


@dataclass(frozen=True)
class Lexicon:
    """Weights by folded term; words have a space on either side, other terms match anywhere."""

    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.curve = np.array(lexicon.curve)
        self.automaton = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for term, weight in lexicon.weights.items():
            self.automaton.add_word(term, (len(term), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, float]:
        """Weight of words and of fragments by length, and the logarithm of all weight."""
        words = fragments = 0.0
        folded = fold(text)
        if len(self.automaton):
            hits = list(self.automaton.iter(folded))
            spared = [(end - value[0] + 1, end) for end, value in hits if value[1] is None]
            for end, (size, weight) in hits:
                if weight is None or any(a <= end - size + 1 and end <= b for a, b in spared):
                    continue
                if size > 1 and folded[end] == " " and folded[end - size + 1] == " ":
                    words += weight
                else:
                    fragments += weight
        length = max(60, len(folded)) / 100
        return words / length, fragments / length, math.log1p(words + fragments)

    def score(self, text: str) -> float:
        z = float(self.curve[0] + self.curve[1:] @ np.array(self.features(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _terms(text: str, n: int) -> set[str]:
    """The different words and n-grams of a text."""
    folded = fold(text)
    return {f" {w} " for w in folded.split()}.union(folded[i:i + n] for i in range(len(folded) - n + 1))


def _counted(n: int, flush: int = 100_000):
    """Texts by term and class, summed in the worker before they are shuffled."""
    def rows(sums):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())],
            ["term", "clean", "toxic"])

    def run(batches):
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for term in _terms(text, n):
                    sums.setdefault(term, [0, 0])[toxic] += 1
                if len(sums) > flush:
                    yield rows(sums)
                    sums = {}
        if sums:
            yield rows(sums)

    return run


def _fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, ...]:
    """Logistic regression by damped Newton steps, slightly held to small weights on the features' own scales."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(x)), x / scale])
    pull = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    loss = lambda b: np.logaddexp(0, x @ b).sum() - y @ (x @ b) + b @ pull @ b / 2
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ x + pull, x.T @ (y - p) - pull @ beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step /= 2
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), *(float(b) for b in beta[1:] / scale)


def learn(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          n: int = 7, sample_rows: int = 24_000, least_count: int = 5, least_weight: float = 1.2,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns from at most about ``sample_rows`` labelled texts outside the held-out fifth, drawn by a hash of the id.

    Terms come from three quarters of them, the curve from the rest, so that the
    curve sees terms as they do on new texts.
    """
    key = F.col("id")
    marked = (labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("toxic"))
              .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(key))
              .groupBy("id").agg(F.max("toxic").alias("toxic")))
    total, toxic = marked.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (toxic + 0.5) / (total + 1) if total else 0.0
    flat = (math.log(prior / (1 - prior)) if prior else -40.0, 0.0, 0.0, 0.0)
    if not 0 < toxic < total:
        return Lexicon({}, flat, exceptions)
    share = min(1.0, sample_rows / total)
    drawn = marked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    texts = materialise(
        documents.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text")).join(drawn, "id")
        .select("text", "toxic", (F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) == 0).alias("curve")), "labelled")
    counts = (texts.where(~F.col("curve")).select("text", "toxic").mapInArrow(_counted(n), "term string, clean long, toxic long")
              .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    counts = materialise(counts.where(F.col("toxic") >= least_count // 2), "terms")
    sizes = texts.where(~F.col("curve")).agg(
        F.sum(F.when(F.col("toxic") == 0, F.length("text")).otherwise(0)), F.sum(F.when(F.col("toxic") == 1, F.length("text")).otherwise(0))).first()
    in_clean, in_toxic = (max(1, s or 0) for s in sizes)
    weight = F.log((F.col("toxic") + 0.5) / F.lit(float(in_toxic))) - F.log((F.col("clean") + 0.5) / F.lit(float(in_clean)))
    chosen = (counts.where(F.col("toxic") >= least_count).select("term", weight.alias("weight")).where(F.col("weight") >= least_weight)
              .orderBy("term").collect())
    lexicon = Lexicon({r.term: r.weight for r in chosen}, flat, exceptions)
    matched = _with_features(texts.where("curve").select("text", "toxic"), lexicon).toArrow()
    x = np.column_stack([matched.column(c).to_numpy() for c in ("words", "fragments", "mass")])
    y = matched.column("toxic").to_numpy()
    if len(set(y.tolist())) < 2:
        return lexicon
    return Lexicon(lexicon.weights, _fit_curve(x, y), exceptions)


def _with_features(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            got = [matcher.features(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([g[i] for g in got], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], ["toxic", "words", "fragments", "mass"])

    return texts.mapInArrow(run, "toxic int, words double, fragments double, mass double")


def score(documents: DataFrame, lexicon: Lexicon, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1; an existing column of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)
    kept = [c for c in documents.columns if c != score_col]
    # The text travels once, inside its row.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    place = kept.index(text_col)

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            row = batch.column("row")
            for part in common.chunks(pa.RecordBatch.from_arrays([row, row.field(place)], ["row", "text"]), "text"):
                scores = [matcher.score(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    scored = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")
    return scored.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("score").alias(score_col))
