"""Token counts by section, from one encoding of the whole document.

A document is encoded once; each token's character span is joined to the sections
it lies in by their ends, and a token that crosses a border is given out by a
stated rule: ``first`` (the section of its first character), ``last``, ``most``
(the largest share of characters, the earlier of equals) or ``share`` (parts by
characters). Counts of a document's sections always add up to its tokens.

A character split over several tokens counts, for each of them, as touched.
Defined cases: null and empty texts have no tokens and one empty section; ends
that fall short of the text get one more section for the rest; repeated rows give
repeated results; empty tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import common


class Encoder:
    """A byte-level merge vocabulary with the byte length of each of its tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The first character of each token and the one after its last."""
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        return char[starts], char[ends - 1] + 1


_LOADED: dict[str, Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, pattern)
    return _LOADED[path]


def allocate(begin: np.ndarray, end: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; ``section_ends`` ascend and the last one is the text's length."""
    n = len(section_ends)
    if not len(begin):
        return np.zeros(n)
    first = np.searchsorted(section_ends, begin, side="right").clip(max=n - 1)
    last = np.searchsorted(section_ends, end - 1, side="right").clip(max=n - 1)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float)
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float)
    within = first == last
    out = np.bincount(first[within], minlength=n).astype(float)
    for i in np.flatnonzero(~within):
        held = np.arange(first[i], last[i] + 1)
        stops = np.minimum(section_ends[held], end[i])
        parts = stops - np.maximum(np.concatenate([[begin[i]], section_ends[held[:-1]]]), begin[i])
        if rule == "share":
            out[held] += parts / (end[i] - begin[i])
        else:
            out[held[np.argmax(parts)]] += 1
    return out


def line_ends(text: str) -> list[int]:
    """Sections are lines with their line ends; a text that ends in one has no empty line after it."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return ends


def section_tokens(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
                   ends_col: str | None = None, rule: str = "first") -> DataFrame:
    """``id, n_tokens, n_sections, section_tokens``; sections are lines, or end where ``ends_col`` (array<int>) says."""
    if rule not in ("first", "last", "most", "share"):
        raise ValueError(f"unknown rule {rule}")

    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            for part in common.chunks(batch, "text", 8 << 20):
                totals, sections = [], []
                for text, given in zip(part.column("text").to_pylist(), part.column("ends").to_pylist()):
                    ends = line_ends(text) if ends_col is None else sorted({min(e, len(text)) for e in given or [] if e is not None and e > 0} | {len(text)})
                    begin, end = enc.spans(text)
                    totals.append(len(begin))
                    sections.append(allocate(begin, end, np.array(ends, dtype=np.int64), rule).tolist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(totals, pa.int64()), pa.array([len(s) for s in sections], pa.int64()),
                     pa.array(sections, pa.list_(pa.float64()))], ["id", "n_tokens", "n_sections", "section_tokens"])

    ends = F.col(ends_col) if ends_col else F.lit(None)
    source = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"), ends.cast("array<int>").alias("ends"))
    return source.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, n_tokens long, n_sections long, section_tokens array<double>")
