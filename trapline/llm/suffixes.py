"""Removal of repeated byte strings by a distributed merge of sorted suffixes.

A byte goes if some string of ``length`` bytes over it also starts earlier: in a
document with a smaller id, or earlier in the same one. Positions are sampled by content
(the least hash of every window of ``length`` bytes), so equal strings are sampled at equal
places, and only samples whose first ``k`` bytes repeat can matter. Their suffixes,
each followed by the bytes before it, are sorted in every task and front-coded: an entry
holds the length of the prefix it shares with the entry before, and the rest.
The runs are exchanged by the first ``k`` bytes and merged by a loser
tree. All keys in the tree carry the length of the prefix they share with the last
output, the run's own front code says it for the next key, and bytes known to
be equal are never compared again. From the merged order and its prefix lengths
follow, for every string around a sample, its first occurrence and all later ones.

Samples of which more than ``hot`` exist are not gathered: their strings are hashed one
by one (128 bits) and their first occurrences found by a grouped minimum.
Copies of whole texts are settled by their digest and take no part.

Defined cases: null and empty texts lose nothing; texts shorter than ``length`` neither;
a null id sorts first; rows that repeat an id and a text get the same result; different
texts under one id are ordered by their digest; empty tables give empty results. Only the
named columns are read. The texts are kept bucketed in the warehouse, so that later
joins do not move them again; the table stays there until the warehouse is cleared.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trapline.llm import common
from trapline.session import materialise

BETWEEN = b"\xff"  # stands in no UTF-8 text
SCHEMA = "part int, run binary, node long, begin int, end int"


PART_SAMPLES = 65_536  # repeated samples that a part of the merge takes on average

def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def samples(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k bytes with the least hash in each string of ``length`` bytes; ties all count."""
    if len(data) < length:
        return common.EMPTY, np.zeros(0, np.uint64)
    hashes = common.span_hashes(data, np.arange(len(data) - k + 1), np.arange(k, len(data) + 1))
    width = length - k + 1
    least = _window_least(hashes, width)
    # A place is sampled if it equals the least of some window over it: the largest of those.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = ~_window_least(~padded, width)
    at = np.flatnonzero(hashes == most)
    return at, hashes[at]


def _anchors(length: int, k: int):
    """Samples of each text. Those met twice in a batch are sure to repeat; only one of them stands for their hash."""
    def run(batches):
        for batch in batches:
            for part in common.chunks(batch, "text", 4 << 20):
                node, place, value = [], [], []
                for n, text in zip(part.column("node").to_pylist(), part.column("text").to_pylist()):
                    at, hashes = samples(np.frombuffer(text.encode(), dtype=np.uint8), length, k)
                    node.append(np.full(len(at), n))
                    place.append(at)
                    value.append(hashes)
                node, place, value = (np.concatenate(x) for x in (node, place, value))
                _, first, back, count = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
                sure = count[back] > 1
                more = np.ones(len(value), dtype=bool)
                more[first] = False
                # The others need no further proof; a key of their own spreads them.
                apart = value.copy()
                apart[more] = common.mix(common.mix(node[more].astype(np.uint64)) + place[more].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(apart.astype(np.int64)), pa.array(value.astype(np.int64)), pa.array(node, pa.int64()), pa.array(place, pa.int32()),
                     pa.array(sure), pa.array(np.where(more, 0, count[back]), pa.int32())], ["key", "h", "node", "pos", "sure", "n"])

    return run


def _key(data: bytes, at: int, length: int, k: int) -> bytes:
    return data[at:at + length] + BETWEEN + data[max(0, at - length + k):at][::-1]


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, from the part already known to be equal on."""
    n = min(len(a), len(b))
    while known + 16 <= n and a[known:known + 16] == b[known:known + 16]:
        known += 16
    while known < n and a[known] == b[known]:
        known += 1
    return known


def pack(keys: list[bytes], first: list[int], node: list[int], pos: list[int]) -> bytes:
    """A sorted run, front-coded."""
    shared, rest, before = [], [], b""
    for key in keys:
        n = _shared(before, key, 0)
        shared.append(n)
        rest.append(key[n:])
        before = key
    parts = [np.array(shared, "<u2"), np.array([len(r) for r in rest], "<u2"), np.array(first, "<i8"), np.array(node, "<i8"), np.array(pos, "<i4")]
    raw = np.array([len(keys)], "<i8").tobytes() + b"".join(p.tobytes() for p in parts) + b"".join(rest)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(run: bytes):
    """(shared prefixes, rests, first, node, pos) of a packed run."""
    raw = zstandard.ZstdDecompressor().decompress(run)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in ("<u2", "<u2", "<i8", "<i8", "<i4"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    ends = at + np.cumsum(out[1].astype(np.int64))
    rests = [raw[e - s:e] for s, e in zip(out[1].tolist(), ends.tolist())]
    return out[0].tolist(), rests, *(x.tolist() for x in out[2:])


def merge(runs: list[tuple]):
    """(run, place in it, key, prefix shared with the output before), in order of keys, by a loser tree."""
    n = 1
    while n < len(runs):
        n *= 2
    keys: list[bytes | None] = [None] * n
    shared, place = [0] * n, [0] * n
    for r, run in enumerate(runs):
        if run[1]:
            keys[r] = run[1][0]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); a loser learns what it shares with the winner, the next output at that node."""
        x, y = keys[a], keys[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        known = _shared(x, y, shared[a])
        if known == len(x) or (known < len(y) and x[known] < y[known]):
            shared[b] = known
            return a, b
        shared[a] = known
        return b, a

    losers = [0] * n
    row = list(range(n))
    at = n
    while len(row) > 1:
        at //= 2
        played = [play(row[2 * i], row[2 * i + 1]) for i in range(at)]
        losers[at:2 * at] = [x[1] for x in played]
        row = [x[0] for x in played]
    top = row[0]
    while keys[top] is not None:
        key, i = keys[top], place[top]
        yield top, i, key, shared[top]
        place[top] = i = i + 1
        run = runs[top]
        if i < len(run[1]):
            shared[top] = run[0][i]
            keys[top] = key[:run[0][i]] + run[1][i]
        else:
            keys[top] = None
        at = (n + top) // 2
        while at:
            top, losers[at] = play(top, losers[at])
            at //= 2


def _runs(length: int, k: int, parts: int):
    """Sorted runs of the repeated samples of a batch, and what its equal keys already cover."""
    def run(batches):
        for batch in batches:
            entries = []
            for node, first, text, places in zip(*(batch.column(c).to_pylist() for c in ("node", "first", "text", "places"))):
                data = text.encode()
                entries += [(_key(data, at, length, k), first, node, at) for at in places]
            entries.sort()
            by_part: dict[int, list] = {}
            covers, before = [], None
            for entry in entries:
                # Entries of equal keys come in order of document and place: the first one stays.
                if entry[0] == before:
                    covers += _whole(entry, length, k)
                    continue
                before = entry[0]
                part = int.from_bytes(hashlib.blake2b(before[:k], digest_size=8).digest(), "big") % parts
                by_part.setdefault(part, []).append(entry)
            if by_part:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(by_part), pa.int32()), pa.array([pack(*map(list, zip(*x))) for x in by_part.values()], pa.binary()),
                     *[pa.nulls(len(by_part), t) for t in (pa.int64(), pa.int32(), pa.int32())]], names=SCHEMA_NAMES)
            if covers:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c[0] % parts for c in covers], pa.int32()), pa.nulls(len(covers), pa.binary()), *_columns(covers)], names=SCHEMA_NAMES)

    return run


SCHEMA_NAMES = ["part", "run", "node", "begin", "end"]


def _columns(covers: list[tuple]) -> list[pa.Array]:
    return [pa.array([c[i] for c in covers], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]


def _whole(entry: tuple, length: int, k: int) -> list[tuple]:
    """(node, begin, end) covered if the whole key stands earlier too."""
    key, _, node, at = entry
    ahead = min(length, len(key.split(BETWEEN, 1)[0]))
    back = len(key) - ahead - 1
    return [(node, at - back, at + ahead)] if ahead + back >= length else []


def later_strings(keys: list[bytes], shared: list[int], rank: np.ndarray, length: int, k: int) -> np.ndarray:
    """For keys in order, whether the string that begins l bytes before a key's sample stands earlier in another key.

    ``shared`` is the prefix each key shares with the one before. Rows are keys, columns l.
    """
    n, back = len(keys), length - k
    ahead = np.array([key.index(BETWEEN) for key in keys])
    behind = np.array([len(key) for key in keys]) - ahead - 1
    shared_now = np.array(shared)
    group = np.cumsum(shared_now < k)
    # Bytes before the samples, nearest first, in order within each group of equal beginnings.
    lead = np.zeros((n, 8 + back), dtype=np.uint8)
    lead[:, :8] = group.astype(">u8").view(np.uint8).reshape(n, 8)
    for i, key in enumerate(keys):
        lead[i, 8:8 + behind[i]] = np.frombuffer(key, np.uint8, behind[i], ahead[i] + 1)
    order = np.array(sorted(range(n), key=[row.tobytes() for row in lead].__getitem__))
    ordered = lead[order]
    prefix = np.full(n, -8)
    if n > 1:
        unequal = ordered[1:] != ordered[:-1]
        prefix[1:] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), 8 + back) - 8
    out = np.zeros((n, back + 1), dtype=bool)
    by_rank = np.argsort(rank, kind="stable")
    for l in range(back + 1):
        valid = (behind >= l) & (ahead >= length - l)
        if valid.sum() < 2:
            continue
        right = np.cumsum(shared_now < length - l)
        left = np.empty(n, dtype=np.int64)
        left[order] = np.cumsum(prefix < l)
        which = by_rank[valid[by_rank]]
        _, first = np.unique(right[which] * (n + 1) + left[which], return_index=True)
        later = np.ones(len(which), dtype=bool)
        later[first] = False
        out[which[later], l] = True
    return out


def _intervals(node: np.ndarray, pos: np.ndarray, later: np.ndarray, length: int) -> pa.Table:
    """Runs of l as byte intervals."""
    edge = np.diff(np.pad(later.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return pa.table({"node": pa.array(node[row], pa.int64()), "begin": pa.array(pos[row] - high + 1, pa.int32()),
                     "end": pa.array(pos[row] - low + length, pa.int32())})


def _merged(length: int, k: int, at_once: int = 50_000):
    """Covered intervals of one part: its runs merged, its settled ones passed on."""
    def settle(keys, shared, first, node, pos):
        first, node, pos = (np.array(x, dtype=np.int64) for x in (first, node, pos))
        rank = np.empty(len(keys), dtype=np.int64)
        rank[np.lexsort((pos, node, first))] = np.arange(len(keys))
        return _intervals(node, pos, later_strings(keys, shared, rank, length, k), length)

    def run(part: pa.Table) -> pa.Table:
        packed = part.column("run")
        out = [part.filter(packed.is_null()).select(["node", "begin", "end"])]
        runs = [unpack(x) for x in packed.drop_null().to_pylist()]
        covers: list[tuple] = []
        waiting: tuple[list, ...] = ([], [], [], [], [])  # keys, shared, first, node, pos
        group: list[tuple] = []
        last = None

        def close():
            # A lone key has nobody to share a string with.
            if len(group) > 1:
                for j, (key, n, entry) in enumerate(group):
                    for column, x in zip(waiting, (key, n if j else 0, *entry)):
                        column.append(x)
            group.clear()

        for r, i, key, n in merge(runs):
            entry = (runs[r][2][i], runs[r][3][i], runs[r][4][i])
            if key == last:
                held = group[-1]
                earlier, later = sorted([held[2], entry])
                covers += _whole((key, *later), length, k)
                group[-1] = (key, held[1], earlier)
                continue
            last = key
            if n < k:
                close()
                if len(waiting[0]) >= at_once:
                    out.append(settle(*waiting))
                    for column in waiting:
                        column.clear()
            group.append((key, n, entry))
        close()
        if waiting[0]:
            out.append(settle(*waiting))
        if covers:
            out.append(pa.table(_columns(covers), names=["node", "begin", "end"]))
        return pa.concat_tables([t.cast(pa.schema([("node", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])) for t in out])

    return run


def _strings(length: int, k: int):
    """Digest of every string around the given samples, with the first place it has in the batch, and where else it begins."""
    def run(batches):
        for batch in batches:
            for part in common.chunks(batch, "text", 1 << 20):
                rows = []
                for node, first, text, places in zip(*(part.column(c).to_pylist() for c in ("node", "first", "text", "places"))):
                    data = text.encode()
                    begins = sorted({b for at in places for b in range(max(0, at - length + k), min(at, len(data) - length) + 1)})
                    rows += [(hashlib.blake2b(data[b:b + length], digest_size=16).digest(), first, node, b) for b in begins]
                columns = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int32()))],
                    ["string", "first", "node", "begin"])

    return run


def _hot_covers(read: DataFrame, length: int, k: int) -> DataFrame:
    """As ``_merged``, for samples too frequent to be gathered."""
    strings = read.mapInArrow(_strings(length, k), "string binary, first long, node long, begin int")
    place = F.struct("first", "node", "begin")
    # Equal strings are joined with one row, their first place; a frequent string's rows may be split.
    least = strings.groupBy("string").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").select("string", "least")
    return strings.join(least, "string").where(place > F.col("least")).select(
        "node", "begin", (F.col("begin") + length).cast("int").alias("end"))


def _cut(batches):
    """What is left of each text: ``n_removed, n_spans`` and the kept bytes' digest."""
    for batch in batches:
        removed, runs, kept = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data = text.encode()
            merged: list[list[int]] = []
            for s in sorted((s["begin"], s["end"]) for s in spans or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, at = hashlib.sha256(), 0
            for begin, end in merged:
                digest.update(data[at:begin])
                at = end
            digest.update(data[at:])
            removed.append(sum(e - b for b, e in merged))
            runs.append(len(merged))
            kept.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("tid"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())],
            ["tid", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, k: int = 24, hot: int = 100_000):
    """(rows, texts, covers): ``rows`` has ``id, tid, n_bytes, first``; ``texts`` one row ``node, tid, first, text`` a
    distinct text; ``covers`` the bytes ``begin`` to ``end`` of a node that go."""
    spark = documents.sparkSession
    kind = documents.select(id_col).schema[0].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("ids must be whole numbers, as they say which string comes first")
    text = common.text_of(text_col)
    source = documents.select(F.col(id_col).alias("id"), common.digest(text).alias("tid"), text.alias("text"))
    rows = materialise(source.select("id", "tid", F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    order = F.coalesce(F.col("id").cast("long"), F.lit(-2 ** 63))
    # Nodes ascend with the first id and, of texts under one id, with the digest: what stays depends on neither layout nor run.
    firsts = rows.groupBy("tid").agg(F.min(order).alias("first")).orderBy("first", "tid")
    nodes = materialise(firsts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    name = f"trapline_texts_{uuid.uuid4().hex[:12]}"
    (source.select("tid", "text").join(nodes, "tid").dropDuplicates(["tid"]).select("tid", "node", "first", "text")
     .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "tid").saveAsTable(name))
    texts = spark.table(name)
    anchors = texts.select("node", "text").mapInArrow(_anchors(length, k), "key long, h long, node long, pos int, sure boolean, n int")
    among = Window.partitionBy("key")
    counted = materialise(anchors.withColumn("many", F.count("*").over(among)).withColumn("total", F.sum("n").over(among))
                          .where((F.col("many") > 1) | F.col("sure")).select("h", "node", "pos", "n", "total"), "repeated-samples")
    # Parts of the merge follow the samples, so that a part's size does not grow with them.
    parts = 8 + counted.count() // PART_SAMPLES
    # All samples of a hash go one way: a batch's representatives say which.
    frequent = counted.where((F.col("n") > 0) & (F.col("total") > hot)).select("h").distinct().withColumn("hot", F.lit(True))
    marked = counted.join(frequent, "h", "left").select("node", "pos", F.coalesce("hot", F.lit(False)).alias("hot"))
    found = materialise(marked.groupBy("node", "hot")
                        .agg(F.collect_list("pos").alias("places")).join(nodes.select("node", "tid"), "node"), "samples")
    read = found.select("tid", "hot", "places").join(texts, "tid").select("node", "first", "text", "places", "hot")
    covers = (read.where(~F.col("hot")).drop("hot").mapInArrow(_runs(length, k, parts), SCHEMA)
              .groupBy("part").applyInArrow(_merged(length, k), "node long, begin int, end int"))
    covers = covers.unionByName(_hot_covers(read.where("hot").drop("hot"), length, k))
    return rows, texts, covers


def remove_repeats(documents: DataFrame, **options) -> DataFrame:
    """One row per row: ``id, n_bytes, n_removed, n_spans, kept_sha256``."""
    length = options.get("length", 100)
    rows, texts, covers = repeated_bytes(documents, **options)
    spans = covers.groupBy("node").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    by_tid = spans.join(texts.select("node", "tid"), "node").select("tid", "spans")
    cut = (texts.select("tid", "first", "text").join(by_tid, "tid", "left").select("tid", "text", "spans")
           .mapInArrow(_cut, "tid binary, n_removed long, n_spans long, kept_sha256 string"))
    firsts = texts.select("tid", "first")
    joined = rows.join(cut, "tid").join(firsts, "tid")
    copied = (F.coalesce(F.col("id").cast("long"), F.lit(-2 ** 63)) > F.col("first")) & (F.col("n_bytes") >= length)
    return joined.select(
        "id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copied, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
