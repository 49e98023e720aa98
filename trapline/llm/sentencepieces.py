"""SentencePiece encoding and decoding for merge-type vocabularies.

Each stretch of a text that no piece can reach across is merged on its own: an
agenda of adjacent symbol pairs, ordered by score and then from the left, says
which pair joins next. The agendas of all new stretches of a batch advance together, each by
its first pair a turn, as arrays; a stretch of over ``LONG`` characters has a heap of its own.
Symbols that end up outside the vocabulary become byte
pieces. Every distinct stretch is also encoded by the sentencepiece library, and the ids
of every text are decoded by it as a whole, and the results are compared in the same Arrow batch.

Defined cases: null is the empty text, which has only the end id; a text of any
length is encoded whole (a stretch without any break costs n log n); repeated rows
give repeated results; empty tables give empty results. Only the named columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm import common

SPACE = "▁"
CACHE = 400_000  # distinct stretches of a generation; a Python worker keeps two
LONG = 64
RUN = 512  # new stretches that the library encodes in one string


class Vocabulary:
    """A merge-type model: pieces by score, byte pieces and the stretches merges stay in."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.cost = {self.pieces[i]: -self.library.get_score(i) for i in normal}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if self.library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.end = self.library.eos_id()
        # A stretch ends before a space mark that follows something else, and around line ends,
        # unless a piece spans such a place.
        spanning = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids if len(p) > 1)
        self.stretches = re.compile("(?s).+" if spanning else f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.whole = spanning
        self.lead = self.library.encode("\n")
        self._number_symbols()
        self.known: dict[str, tuple[tuple[int, ...], str, str]] = {}
        self.before: dict[str, tuple[tuple[int, ...], str, str]] = {}
        self.doubtful: set[str] = set()
        self.keep = CACHE

    def _number_symbols(self) -> None:
        """Numbers for all symbols a merge can meet, and which two of them join to which, as arrays."""
        symbols = [*self.ids, *sorted({c for p in self.ids for c in p} - set(self.ids))]
        self.symbols, number = symbols, {s: i for i, s in enumerate(symbols)}
        points = sorted((ord(s), i) for s, i in number.items() if len(s) == 1)
        self.points, self.point_symbols = (np.array(x, dtype=np.int64) for x in zip(*points))
        joins = sorted((number[p[:i]] * len(symbols) + number[p[i:]], number[p]) for p in self.ids for i in range(1, len(p))
                       if p[:i] in number and p[i:] in number)
        self.join_keys, self.join_symbols = (np.array(x, dtype=np.int64) for x in zip(*joins)) if joins else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))
        self.symbol_ids = np.array([self.ids.get(s, -1) for s in symbols] + [-1], dtype=np.int64)
        self.numbers = [*range(len(self.pieces)), -1]
        self.numerals = [str(i) for i in range(len(self.pieces))]
        self.texts = [p.replace(SPACE, " ") for p in self.pieces]
        self.symbol_cost = np.array([self.cost.get(s, np.inf) for s in symbols] + [np.inf])

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that two join to, or the number after the last where they do not."""
        key = left * len(self.symbols) + right
        at = np.searchsorted(self.join_keys, key).clip(max=len(self.join_keys) - 1)
        hit = (self.join_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.join_symbols[at], len(self.symbols))

    def _merge_together(self, stretches: list[str]) -> list[list[str]]:
        """Symbols of many stretches."""
        found, bounds, points = self._agendas(stretches)
        names = self.symbols
        spelled = [names[i] if i >= 0 else chr(points[-1 - i]) for i in found.tolist()]
        return [spelled[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _agendas(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all stretches, where each one's begin (plus the end), and the characters they came from.

        In every turn each stretch joins the cheapest of its pairs, the leftmost of equals.
        """
        sizes = np.array([len(s) for s in stretches], dtype=np.int64)
        points = np.frombuffer("".join(stretches).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        at = np.searchsorted(self.points, points).clip(max=len(self.points) - 1)
        # Characters that no piece holds are told apart by their place, from -1 down.
        symbol = np.where(self.points[at] == points, self.point_symbols[at], -1 - np.arange(len(points)))
        owner = np.repeat(np.arange(len(stretches)), sizes)
        none = len(self.symbols)
        join = np.full(len(symbol), none, dtype=np.int64)
        pairs = np.flatnonzero(owner[:-1] == owner[1:])
        join[pairs] = self._joined(symbol[pairs], symbol[pairs + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            cost = self.symbol_cost[join]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(cost, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
            rest = np.isfinite(best)[group]
            if not rest.all():
                done.append((owner[~rest], symbol[~rest]))
                # The last symbol of a stretch has no pair, so stretches can be taken out whole.
                owner, symbol, join, cost, best = owner[rest], symbol[rest], join[rest], cost[rest], best[group][rest]
            else:
                best = best[group]
            if not len(symbol):
                break
            cheap = np.flatnonzero(cost == best)
            cheap = cheap[np.concatenate([[True], owner[cheap[1:]] != owner[cheap[:-1]]])]
            symbol[cheap] = join[cheap]
            kept = np.ones(len(symbol), dtype=bool)
            kept[cheap + 1] = False
            place = np.cumsum(kept)[cheap] - 1
            owner, symbol, join = owner[kept], symbol[kept], join[kept]
            changed = np.zeros(len(owner) + 1, dtype=bool)
            changed[place] = changed[place - 1] = True  # the one before the first is beyond the last
            changed = np.flatnonzero(changed[:-1])
            join[changed] = none
            inside = changed[:-1] if changed[-1] == len(owner) - 1 else changed
            inside = inside[owner[inside] == owner[inside + 1]]
            join[inside] = self._joined(symbol[inside], symbol[inside + 1])
        owners, found = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(owners, kind="stable")
        return found[order], np.searchsorted(owners[order], np.arange(len(stretches) + 1)), points

    def _merge_short(self, stretch: str) -> list[str]:
        return self._merge_together([stretch])[0]

    def merge(self, stretches: list[str]) -> list[list[str]]:
        """The symbols that stay of each stretch."""
        return [self._merge_long(s) if len(s) > LONG else self._merge_short(s) for s in stretches]

    def encoded(self, stretches: list[str]) -> list[tuple[tuple[int, ...], str, str]]:
        """Ids of each stretch, spelled out, and the text they decode to."""
        out: list = [None] * len(stretches)
        short = [i for i, s in enumerate(stretches) if len(s) <= LONG]
        found, bounds, _ = self._agendas([stretches[i] for i in short])
        ids = self.symbol_ids[np.where(found < 0, len(self.symbols), found)]
        plain = np.minimum.reduceat(ids, bounds[:-1]) >= 0 if short else np.zeros(0, dtype=bool)
        ids = [self.numbers[i] for i in ids.tolist()]  # one object an id, however many stretches hold it
        numerals, texts = [self.numerals[i] for i in ids], [self.texts[i] for i in ids]
        for i, a, b, known in zip(short, bounds[:-1].tolist(), bounds[1:].tolist(), plain.tolist()):
            if known:
                out[i] = tuple(ids[a:b]), " ".join(numerals[a:b]), "".join(texts[a:b])
        for i, entry in enumerate(out):
            if entry is None:
                own = self.encode_stretch(stretches[i])
                out[i] = tuple(own), " ".join(map(str, own)), self.decode_ids(own)
        return out

    def _merge_long(self, stretch: str) -> list[str]:
        """The agenda as a heap over linked symbols; entries whose symbols have changed are skipped."""
        symbols: list[str] = list(stretch)
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        agenda: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols):
                cost = self.cost.get(symbols[i] + symbols[j])
                if cost is not None:
                    heapq.heappush(agenda, (cost, i, j, len(symbols[i]) + len(symbols[j])))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def ids_of(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                out += [self.byte_ids[b] for b in s.encode()] if self.byte_ids else [self.library.unk_id()]
            else:
                out.append(i)
        return out

    def encode_stretch(self, stretch: str) -> list[int]:
        return self.ids_of(self.merge([stretch])[0])

    def decode_ids(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out = b"".join([bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids])
        return out.decode("utf-8", "replace").replace(SPACE, " ")

    def _library_ids(self, stretches: list[str]) -> list[list[int]]:
        # The line end keeps the library's own leading space mark apart from the text.
        return [x[len(self.lead):] for x in self.library.encode(["\n" + s.replace(SPACE, " ") for s in stretches], num_threads=1)]

    def learn(self, stretches: set[str]) -> None:
        """Encodes the stretches not known yet and holds their ids against the library.

        Those met since the generation began stay; the generation before goes when a new one begins.
        """
        if len(self.known) > self.keep:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        known.update({s: before[s] for s in stretches if s not in known and s in before})
        new = [s for s in stretches if s not in known]
        own = self.encoded(new)
        for i in range(0, len(new), RUN):
            run, ids = new[i:i + RUN], [list(x[0]) for x in own[i:i + RUN]]
            # Strung together where a text may be cut; one that could be read otherwise there is looked at alone.
            safe = not self.whole and all(s[0] in (SPACE, "\n") and not s.endswith(SPACE) for s in run)
            if not safe or self._library_ids(["".join(run)])[0] != [x for part in ids for x in part]:
                self.doubtful |= {s for s, part, other in zip(run, ids, self._library_ids(run)) if part != other}
        known.update(zip(new, own))

    def encode(self, texts: list[str]) -> list[tuple[str, str, bool]]:
        """For each text its ids with the end id, spelled out, the text they decode to, and whether the library agrees."""
        split = [self.stretches.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn({s for parts in split for s in parts})
        known, out, whole, end = self.known, [], [], str(self.end)
        for parts in split:
            entries = [known[s] for s in parts]
            ids: list[int] = []
            for e in entries:
                ids += e[0]
            ids.append(self.end)
            whole.append(ids)
            spelled = " ".join([e[1] for e in entries])
            decoded = "".join([e[2] for e in entries])[1:]
            agrees = not self.doubtful or self.doubtful.isdisjoint(parts)
            out.append((f"{spelled} {end}" if spelled else end, decoded, agrees))
        theirs = self.library.decode(whole, num_threads=1) if whole else []
        return [(spelled, decoded, agrees and decoded == other) for (spelled, decoded, agrees), other in zip(out, theirs)]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str, row, schema: str, kinds: list, keep: int | None = None) -> DataFrame:
    def run(batches):
        vocab = vocabulary(path)
        vocab.keep = CACHE if keep is None else keep
        for batch in batches:
            for part in common.chunks(batch, "text", 1 << 20):
                with common.uncollected():
                    got = [row(*x) for x in vocab.encode(part.column("text").to_pylist())]
                columns = list(zip(*got)) if got else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *[pa.array(list(c), k) for c, (_, k) in zip(columns, kinds)]], ["id", *[n for n, _ in kinds]])
        if keep is not None:
            _LOADED.pop(path, None)

    source = df.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    return source.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, {schema}")


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, decoded, agrees``: ids with the end id, the text they decode to, and the library's verdict."""
    return _encoded(df, id_col, text_col, path, lambda spelled, decoded, ok: (list(map(int, spelled.split())), decoded, ok),
                    "ids array<int>, decoded string, agrees boolean",
                    [("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("agrees", pa.bool_())])


def encoded_digests(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: int | None = None) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256, agrees``, without moving the ids out of the worker.

    A generation has ``CACHE`` stretches, and a worker keeps two from task to task. Where workers hold the tables of
    other operators too, ``keep`` gives a smaller number, and nothing stays after a task.
    """
    def row(spelled, decoded, ok):
        return spelled.count(" ") + 1, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ok

    return _encoded(df, id_col, text_col, path, row,
                    "n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean",
                    [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("agrees", pa.bool_())], keep)
