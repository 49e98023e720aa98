"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked tokens.

Each text with a space before it is encoded by a byte-level vocabulary (A) and by a
sentence-piece vocabulary (B). Byte offsets where tokens of both end cut the tokens into
groups, and the two tokens that end there are linked. Linked tokens end with the same bytes,
so one of them is a suffix of the other: ``pair_bound`` counts the id pairs for which that
holds, which bounds all tables below by the vocabularies, whatever the size of the corpus.

The first pass aligns every text and leaves, for each task, the linked pairs it met and how
often. The distinct pairs get a minimal perfect hash; tasks turn their pairs into dense
vectors of counts by that hash, which are summed as a tree. The hash, its keys (every lookup
is held against them) and the summed counts are broadcast, and the second pass aligns the
texts again and looks the counts up.

Neither vocabulary reaches across a space or line end that follows another character, so texts
are cut there, and each distinct stretch is aligned once a task as long as it stays among
the ``CACHE`` characters that a worker keeps. Vocabularies for which this does not hold are given whole texts.

Defined cases: texts null, empty, or whose tokens do not spell the text with the space before
it have no tokens and count nothing; a text of any length is aligned whole; repeated rows
give repeated results and count each time; of empty tables nothing comes, and no counts.
Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import common
from trapline.llm.bits import Bits
from trapline.session import materialise

SPACE = "▁"
CACHE = 160 << 20  # bytes of stretches, with their groups, that a worker keeps
RUN = 512  # new stretches encoded in one string
FAN_IN = 8  # vectors added by one task of the tree
#: White space of either library and characters close to it: none of them is taken for the end of a stretch.
_WIDE = r"\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANK = r"\t-\r\x1c-\x20" + _WIDE
OTHER_BLANK = r"\t\x0b-\r\x1c-\x1f" + _WIDE
CUTTABLE = re.compile(f"[^{BLANK}]\\Z")
STRETCH = f"(?:[{BLANK}]+[^{BLANK}]*|[^{BLANK}]+)(?:[{OTHER_BLANK}][{BLANK}]*[^{BLANK}]*)*"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next one beyond 255."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both vocabularies, and the groups and links of the stretches met lately."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        self.numerals = [str(i) for i in range(max(len(self.a_bytes), n))]
        self.lead = self.b.encode("\n")
        with open(a_path, encoding="utf-8") as f:
            before = json.load(f).get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        reaching = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.stretches = re.compile(STRETCH if plain and not reaching else "(?s).+")
        self.whole = self.stretches.pattern == "(?s).+"
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((0, 3), dtype=np.int64)  # tokens of A, tokens of B, links
        self.links: list[np.ndarray] = []
        self.unspelled: set[str] = set()
        self.held = 0

    def pair_bound(self) -> int:
        """How many id pairs have one token that ends with the other."""
        known_a, known_b = Counter(self.a_bytes), Counter(self.b_bytes)
        longer_a = sum(known_b[t[i:]] for t in self.a_bytes for i in range(len(t)))
        return longer_a + sum(known_a[t[i:]] for t in self.b_bytes for i in range(1, len(t)))

    def _encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both vocabularies for each text, none for a text that they do not spell."""
        ours = self.a.encode_batch_fast(texts, add_special_tokens=False)
        # The line end keeps the library's own leading space mark apart from the text; whole texts bring theirs.
        theirs = self.b.encode([t[1:] if self.whole else "\n" + t for t in texts], num_threads=1)
        out = []
        for text, x, y in zip(texts, ours, theirs):
            a, b, spelled = x.ids, y if self.whole else y[len(self.lead):], text.encode()
            same = b"".join([self.a_bytes[i] for i in a]) == spelled and b"".join([self.b_bytes[i] for i in b]) == spelled
            out.append((a, b) if same else ([], []))
        return out

    def learn(self, stretches: set[str], spell: bool) -> int:
        """Aligns the stretches not known; says how many slots were known before, none if the others had to go.

        Groups are spelled out only if wanted.
        """
        if self.held > CACHE:
            self.forget()
        before = len(self.facts)
        new = [s for s in stretches if s not in self.slot]
        joined = [] if self.whole else [s for s in new if CUTTABLE.search(s)]
        alone = new if self.whole else [s for s in new if not CUTTABLE.search(s)]
        runs = [joined[i:i + RUN] for i in range(0, len(joined), RUN)]
        encoded = list(zip(runs, self._encoded(["".join(r) for r in runs])))
        # What one stretch of a run does not spell says nothing of the others.
        alone += [s for run, (a, _) in encoded if not a for s in run]
        encoded = [(run, ids) for run, ids in encoded if ids[0]]
        for stretch, ids in zip(alone, self._encoded(alone)):
            if ids[0]:
                encoded.append(([stretch], ids))
            else:
                self.unspelled.add(stretch)
                self.slot[stretch] = -1
                self.held += 200 + len(stretch)
        if encoded:
            self._align([s for run, _ in encoded for s in run], *(np.array([i for _, ids in encoded for i in ids[k]], dtype=np.int64) for k in (0, 1)), spell)
        return before

    def _align(self, stretches: list[str], a: np.ndarray, b: np.ndarray, spell: bool) -> None:
        """Groups and links of stretches whose tokens stand one after another in ``a`` and ``b``."""
        stops = np.cumsum([len(s.encode()) for s in stretches])
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        met = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, met), np.searchsorted(ends_b, met)
        upto = np.searchsorted(met, stops)
        if len(met) <= upto[-1] or (met[upto] != stops).any():
            raise RuntimeError("a token reaches across the end of a stretch")
        self.links.append(a[last_a] * len(self.b_bytes) + b[last_b])
        counts = [np.diff(x, prepend=-1) for x in (last_a[upto], last_b[upto], upto)]
        first = len(self.facts)
        self.facts = np.concatenate([self.facts, np.column_stack(counts)])
        self.slot.update(zip(stretches, range(first, len(self.facts))))
        self.held += sum(map(len, stretches)) + 250 * len(stretches)
        if spell:
            a_text, b_text = [self.numerals[i] for i in a.tolist()], [self.numerals[i] for i in b.tolist()]
            groups, i, j = [], 0, 0
            for x, y in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
                groups.append(f"{a_text[i]}|{b_text[j]}" if x - i == y - j == 1 else f"{','.join(a_text[i:x])}|{','.join(b_text[j:y])}")
                i, j = x, y
            i = 0
            for x in (upto + 1).tolist():
                self.groups.append(";".join(groups[i:x]))
                self.held += len(self.groups[-1])
                i = x

    def split(self, texts: list[str], spell: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """Slots of the stretches of all texts, where each text's begin (plus the end), and what ``learn`` says.

        A text that its tokens do not spell has none.
        """
        parts = [self.stretches.findall(f" {t}") if t else [] for t in texts]
        before = self.learn({s for p in parts for s in p}, spell)
        if self.unspelled:
            parts = [p if self.unspelled.isdisjoint(p) else [] for p in parts]
        bounds = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=bounds[1:])
        return np.array([self.slot[s] for p in parts for s in p], dtype=np.int64), bounds, before


_LOADED: dict[tuple[str, str, bool], Aligner] = {}


def aligner(a_path: str, b_path: str, spell: bool) -> Aligner:
    """This worker's aligner; those that spell groups out and those that do not keep stretches of their own."""
    key = (a_path, b_path, spell)
    if key not in _LOADED:
        for other in list(_LOADED):
            del _LOADED[other]
        _LOADED[key] = Aligner(a_path, b_path)
    return _LOADED[key]


class PerfectHash:
    """Numbers a set of keys from 0 on without gaps.

    At each level a key has one place; keys alone at theirs stay there, the others go to the next level.
    """

    def __init__(self, keys: np.ndarray, spare: float = 1.6):
        self.levels: list[tuple[int, int, Bits]] = []
        self.size, rest = len(keys), keys.astype(np.uint64)
        first = 0
        while len(rest):
            width = max(2, int(spare * len(rest)))
            at = self._places(rest, len(self.levels), width)
            alone = np.bincount(at, minlength=width) == 1
            bits = Bits(alone)
            self.levels.append((first, width, bits))
            first += bits.set
            rest = rest[~alone[at]]

    @staticmethod
    def _places(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        return (common.mix(keys + common.mix(np.array([level + 1], dtype=np.uint64))) % np.uint64(width)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one that has no place; keys outside the set may get the number of another."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (first, width, bits) in enumerate(self.levels):
            at = self._places(keys[open_].astype(np.uint64), level, width)
            here = bits.at(at)
            out[open_[here]] = first + bits.ones(at[here])
            open_ = open_[~here]
        return out


class Numbered:
    """Distinct keys by their perfect hash; numbers are held against the keys."""

    def __init__(self, keys: np.ndarray):
        self.hash = PerfectHash(keys)
        self.keys = np.zeros(len(keys), dtype=np.int64)
        self.keys[self.hash(keys)] = keys

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for one that is not among them."""
        out = self.hash(keys)
        return np.where((out >= 0) & (self.keys[out] == keys), out, -1) if len(self.keys) else out


@dataclass
class LinkCounts:
    """Counts of linked pairs by their number, and whether a pair is the most frequent one of its B id."""

    pairs: Numbered
    counts: np.ndarray
    best: np.ndarray


def task_counts(df: DataFrame, a_path: str, b_path: str, *, text_col: str = "text") -> DataFrame:
    """``pair, n``: the linked pairs met by each task and how often; a pair comes once for every task."""
    def run(batches):
        align = aligner(a_path, b_path, False)
        met = np.zeros(len(align.facts), dtype=np.int64)  # how often each slot was met since stretches were last forgotten
        totals = np.zeros((2, 0), dtype=np.int64)

        def settled():
            links = np.concatenate([totals[0], *align.links])
            n = np.concatenate([totals[1], np.repeat(met, align.facts[:len(met), 2])])
            keys, place = np.unique(links[:len(n)][n > 0], return_inverse=True)
            out = np.zeros(len(keys), dtype=np.int64)
            np.add.at(out, place, n[n > 0])
            return np.stack([keys, out])

        for batch in batches:
            for part in common.chunks(batch, "text", 1 << 20):
                if align.held > CACHE:
                    totals, met = settled(), met[:0]
                with common.uncollected():
                    at, _, _ = align.split(part.column("text").to_pylist(), False)
                met = np.bincount(at, minlength=len(align.facts)) + np.pad(met, (0, len(align.facts) - len(met)))
        keys, counts = settled()
        for i in range(0, len(keys), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 65_536]), pa.array(counts[i:i + 65_536])], ["pair", "n"])

    return df.select(common.text_of(text_col).alias("text")).mapInArrow(run, "pair long, n long")


def summed(parts: DataFrame, pairs: Numbered) -> np.ndarray:
    """Dense counts of all pairs: a vector for each task, added ``FAN_IN`` at a time until one is left."""
    size = pairs.hash.size
    numbered = parts.sparkSession.sparkContext.broadcast(pairs)

    def dense(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            at = numbered.value.number(batch.column("pair").to_numpy())
            if (at < 0).any():
                raise KeyError("a pair without a number")
            np.add.at(total, at, batch.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    def add(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for held in batch.column("counts"):
                total += np.frombuffer(held.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors, left = parts.mapInArrow(dense, "counts binary"), parts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        vectors = vectors.repartition(left).mapInArrow(add, "counts binary")
    rows = vectors.collect()
    return np.frombuffer(rows[0]["counts"], dtype=np.int64) if rows else np.zeros(size, dtype=np.int64)


def link_counts(df: DataFrame, a_path: str, b_path: str, *, text_col: str = "text") -> LinkCounts:
    """Counts of all linked pairs of the corpus."""
    align = Aligner(a_path, b_path)
    parts = materialise(task_counts(df, a_path, b_path, text_col=text_col), "pairs")
    bound = align.pair_bound()
    rows = parts.select("pair").distinct().limit(bound + 1).toArrow()
    if rows.num_rows > bound:
        raise ValueError("tokens that end together must end with the same bytes")
    pairs = Numbered(np.sort(rows.column("pair").to_numpy()))
    counts = summed(parts, pairs)
    b = pairs.keys % len(align.b_bytes)
    most = np.zeros(len(align.b_bytes), dtype=np.int64)
    np.maximum.at(most, b, counts)
    return LinkCounts(pairs, counts, counts == most[b])


def pair_table(spark: SparkSession, found: LinkCounts, b_path: str) -> DataFrame:
    """``a, b, n, best`` for every linked pair."""
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    table = pa.table({"a": found.pairs.keys // size, "b": found.pairs.keys % size, "n": found.counts, "best": found.best})
    return spark.createDataFrame(table)


def align_texts(df: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                counts: LinkCounts | None = None) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each text.

    ``n_best`` counts the links whose pair is the most frequent one of its B id, ``count_sum`` adds
    the counts of all links. ``counts`` are those of the texts themselves unless given; a pair that
    given ones lack counts 0 and is not best.
    """
    found = df.sparkSession.sparkContext.broadcast(counts or link_counts(df, a_path, b_path, text_col=text_col))

    def run(batches):
        align, known = aligner(a_path, b_path, True), found.value
        facts = np.zeros((0, 5), dtype=np.int64)
        for batch in batches:
            for part in common.chunks(batch, "text", 1 << 20):
                with common.uncollected():
                    at, bounds, before = align.split(part.column("text").to_pylist(), True)
                facts = _looked_up(align, known, facts if before >= len(facts) else facts[:0])
                sums = np.zeros((len(at) + 1, 5), dtype=np.int64)
                np.cumsum(facts[at], axis=0, out=sums[1:])
                sums = sums[bounds[1:]] - sums[bounds[:-1]]
                groups = [align.groups[i] for i in at.tolist()]
                texts = [";".join(groups[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = [pa.array(sums[:, i]) for i in (0, 1, 2, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns, pa.array(texts, pa.string())], names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    source = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    return source.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, {', '.join(f'{n} long' for n in names[1:-1])}, groups string")


def _looked_up(align: Aligner, known: LinkCounts, facts: np.ndarray) -> np.ndarray:
    """``facts`` with a row for each new slot: tokens of A, of B, links, links that are best, sum of counts."""
    old, new = len(facts), len(align.facts) - len(facts)
    if not new:
        return facts
    added = align.facts[old:]
    links = np.concatenate(align.links)[align.facts[:old, 2].sum():] if old else np.concatenate(align.links)
    at = known.pairs.number(links)
    there = at >= 0
    owner, at = np.repeat(np.arange(new), added[:, 2])[there], at[there]
    best, total = np.zeros(new, dtype=np.int64), np.zeros(new, dtype=np.int64)
    np.add.at(best, owner, known.best[at])
    np.add.at(total, owner, known.counts[at])
    return np.concatenate([facts, np.column_stack([added, best, total])])
