"""Fill-in-middle rearrangement of whole texts.

A text is cut into prefix, middle and suffix at two borders of its units and put
together again as ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle``
(spm). Characters fall into classes that also say what stood before them, and a
wavelet matrix over the classes of a run of texts answers how many characters of a
class stand before a place. Sums of such ranks over classes count the borders of any
kind of unit, and bisection on them finds both cuts of all texts of the run at once.

Units: ``line`` (a line with its line end), ``paragraph`` (up to an empty line's end),
``word`` (a word with the white space after it; white space at the beginning belongs to
the first word) and ``character``. Places are code points.

Defined cases: null and empty texts stay empty in the plain form, as does a text that
holds a mark; a null id draws like the empty string; a text of any length is cut whole;
repeated rows give repeated results; empty tables give empty results. Only the named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm import common
from trapline.llm.bits import Bits

MARKS = ("<P>", "<S>", "<M>")
OTHER, HEAD, SPACE, LINE, BLANK = range(5)
#: Classes whose characters end a unit, and classes whose characters begin one.
ENDS = {"line": (LINE, BLANK), "paragraph": (BLANK,), "character": (OTHER, HEAD, SPACE, LINE, BLANK)}
BEGINS = {"word": (HEAD,)}
SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


class WaveletMatrix:
    """Symbols bit by bit, each level sorted by the bit above; ``rank`` walks down once."""

    def __init__(self, symbols: np.ndarray, bits: int = 3):
        self.levels = []
        for shift in reversed(range(bits)):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How many of the first ``places`` symbols are ``symbol``."""
        begin, end = np.zeros(1, dtype=np.int64), places
        for shift, level in self.levels:
            ones_begin, ones_end = level.ones(begin), level.ones(end)
            if symbol >> shift & 1:
                begin, end = level.zeros + ones_begin, level.zeros + ones_end
            else:
                begin, end = begin - ones_begin, end - ones_end
        return end - begin

    def total(self, symbols: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, places) for s in symbols)

    def reach(self, symbols: tuple[int, ...], low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The least place from ``low`` to ``high`` before which ``wanted`` of the symbols stand, by bisection."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = self.total(symbols, middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each code point; texts begin at ``starts`` and see nothing of the one before."""
    feed, space = points == 10, np.isin(points, SPACES)
    first = np.zeros(len(points), dtype=bool)
    first[starts[starts < len(points)]] = True
    after_feed, after_space = np.ones(len(points), dtype=bool), np.ones(len(points), dtype=bool)
    after_feed[1:], after_space[1:] = feed[:-1], space[:-1]
    out = np.where(space, SPACE, np.where(after_space | first, HEAD, OTHER)).astype(np.uint8)
    out[feed] = np.where((after_feed | first)[feed], BLANK, LINE)
    return out


class Units:
    """Counts and borders of the units of a run of texts."""

    def __init__(self, texts: list[str], unit: str):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.symbols = classes(np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), self.starts[sizes > 0])
        self.matrix = WaveletMatrix(self.symbols)
        self.closing = unit in ENDS
        self.kinds = ENDS[unit] if self.closing else BEGINS[unit]
        self.before = self.matrix.total(self.kinds, self.starts)
        found = self.matrix.total(self.kinds, self.ends) - self.before
        if self.closing:
            last = np.zeros(len(texts), dtype=np.uint8)
            last[sizes > 0] = self.symbols[self.ends[sizes > 0] - 1]
            self.count = found + ((sizes > 0) & ~np.isin(last, self.kinds))
        else:
            self.count = np.where(sizes > 0, np.maximum(found, 1), 0)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The place in each text after its first ``k`` units."""
        at = self.matrix.reach(self.kinds, self.starts, self.ends, self.before + k + (not self.closing)) - (not self.closing)
        return np.where(k <= 0, 0, np.where(k >= self.count, self.ends - self.starts, at - self.starts))


def arrange(parts: tuple[str, str, str], form: str, marks: tuple[str, str, str]) -> str:
    prefix, middle, suffix = parts
    p, s, m = marks
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of seed and key."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def rearrange(df: DataFrame, *, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50,
              marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for each text.

    ``n`` counts units; of the texts ``rate`` in a hundred are rearranged, ``spm_rate`` in a
    hundred of these as spm. The sizes are null in the plain form, whose output is the text.
    """
    if unit not in ENDS and unit not in BEGINS:
        raise ValueError(f"unknown unit {unit}")
    if len(set(marks)) < 3 or any(a[i:] and b.startswith(a[i:]) for a in marks for b in marks for i in range(a == b, len(a))):
        raise ValueError("marks must not overlap one another")

    def run(batches):
        for batch in batches:
            for part in common.chunks(batch, "text", 4 << 20):
                texts = part.column("text").to_pylist()
                h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in range(1, 5))
                units = Units(texts, unit)
                a, b = h1 % (units.count + 1), h2 % (units.count + 1)
                first, second = units.cut(np.minimum(a, b)), units.cut(np.maximum(a, b))
                forms, outputs = [], []
                for i, text in enumerate(texts):
                    plain = not text or h3[i] % 100 >= rate or any(m in text for m in marks)
                    forms.append("plain" if plain else "spm" if h4[i] % 100 < spm_rate else "psm")
                    outputs.append(text if plain else arrange((text[:first[i]], text[first[i]:second[i]], text[second[i]:]), forms[-1], marks))
                none = np.array([f == "plain" for f in forms], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(units.count, pa.int64()), pa.array(forms, pa.string()),
                     pa.array(first, pa.int64(), mask=none), pa.array(second - first, pa.int64(), mask=none), pa.array(outputs, pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    source = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"), *draws(F.col(id_col), seed))
    return source.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form came from."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
