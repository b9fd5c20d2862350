"""Shared core of the two repeat finders: blocks of documents, sync points, and who repeats whom.

A *sequence* is a document's symbols (bytes, or names of words).  The question is which windows of
``window`` consecutive symbols also start earlier: in a document with a smaller id, or (``within``)
earlier in the same document.  Looking at every position would move many times the corpus, so
positions are thinned without losing any window:

* The *name* of the ``gram`` symbols at a position stands for them.  Among the grams inside a
  window the smallest names are its *sync points*: equal windows have them at equal places.
  About 2 / (window - gram + 2) of all positions are sync points of some window.
* The *context* of a sync point is all symbols of the windows around it.  Where every occurrence
  of a gram has one and the same context, each occurrence but the first is covered as a whole.
  Grams that occur once are done with.  Only grams with several contexts branch, and only their
  windows are looked at one by one (``Windows`` messages, the part that differs between finders).

Documents travel in blocks of about BLOCK_BYTES.  A block sends one message per distinct gram, so a
gram in a third of all documents is a message per block, not per document; messages are dealt to
buckets by hash, each bucket answers the blocks, and blocks apply the answers to their own text.

64-bit names stand for contents; windows are compared by one and a half of them (96 bits), inside
one block by two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ersa.llm.common import U64, mix, pair_name, store

BLOCK_BYTES = 2 << 20
#: Text bytes whose messages one bucket takes.
BUCKET_BYTES = 16 << 20
LAST = np.iinfo(np.int64).max
#: Positions worked on at a time: their arrays stay in the processor's cache.
CHUNK = 1 << 14
#: Blocks that look closer at one gram from which on the gram counts as hot (answer 2 instead of 1).
HOT_BLOCKS = 32


@dataclass(frozen=True)
class Shape:
    """Windows of ``window`` symbols, named through grams of ``gram`` symbols."""

    window: int
    gram: int
    within: bool

    @property
    def span(self) -> int:
        return self.window - self.gram

    @property
    def offsets(self) -> list[int]:
        """Offsets of grams that together cover a window: from 0 to ``span``, no two further apart than a gram."""
        steps = max(2, 2 * -(-self.span // (2 * self.gram)))
        return [self.span * i // steps for i in range(steps + 1)]


# ---- blocks -------------------------------------------------------------------------------

def write_blocks(docs: DataFrame, text_col: str, limit: int) -> DataFrame:
    """(block, size, data): documents with all their columns, packed as Arrow streams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col))
            sizes = np.array([len(t) if (t := column[i].as_buffer()) is not None else 0 for i in range(len(column))], dtype=np.int64)
            at, start = 0, 0
            ids, weights, data = [], [], []
            while start < batch.num_rows:
                at, total = start, 0
                while at < batch.num_rows and (at == start or total + sizes[at] <= limit):
                    total += int(sizes[at])
                    at += 1
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.slice(start, at - start))
                ids.append(base + k)
                weights.append(total)
                data.append(sink.getvalue().to_pybytes())
                k, start = k + 1, at
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(weights, pa.int64()), pa.array(data, pa.binary())],
                                             names=["block", "size", "data"])

    return store(docs.mapInArrow(run, "block long, size long, data binary"), "blocks", codec="uncompressed")


def read_block(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


# ---- sequences of one block ----------------------------------------------------------------

def _slide(x: np.ndarray, width: int, op: Callable, back: bool = False) -> np.ndarray:
    """op over x[i : i + width] for each i, or with ``back`` over x[i - width + 1 : i + 1] (fewer at the end of the array), by doubling."""
    done, out = 1, x
    while done < width and done < len(out):
        step = min(done, width - done)
        grown = np.empty_like(out)
        both = (grown[step:], grown[:step], out[:step]) if back else (grown[:-step], grown[-step:], out[-step:])
        op(out[:-step], out[step:], out=both[0])
        both[1][:] = both[2]
        out, done = grown, done + step
    return out


class Sequences:
    """The symbols of a block's documents, one after the other, with gram names and sync points.

    ``grams``: the name of the ``gram`` symbols from each position on (any value where they
    would leave the array); ``first``: where each document starts (n + 1 values); ``ids``: doc ids.
    """

    def __init__(self, shape: Shape, grams: np.ndarray, first: np.ndarray, ids: np.ndarray):
        self.shape, self.h, self.first, self.ids = shape, grams, first, ids
        n = len(grams)
        self.row = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(first))
        room = np.zeros(n + 1, dtype=np.int8)                  # +1 where valid window starts begin, -1 behind them
        whole = np.diff(first) >= shape.window
        np.add.at(room, first[:-1][whole], 1)
        np.add.at(room, first[1:][whole] - shape.window + 1, -1)
        self.valid = np.cumsum(room[:-1], dtype=np.int8).astype(bool)
        self.least, self.sync = self._sync_points()
        rows = self.row[self.sync]
        self.lo = np.maximum(self.sync - shape.span, first[rows])
        self.hi = np.minimum(self.sync + shape.window, first[rows + 1])
        self.names = grams[self.sync]
        self.contexts = self._contexts()
        self.docs = ids[rows]

    def _sync_points(self) -> tuple[np.ndarray, np.ndarray]:
        """The least gram of the window at each position, and the positions that are the least of some valid window."""
        n, span, grams = len(self.h), self.shape.span, self.h
        least, sync = np.empty(n, dtype=np.uint64), []
        for a in range(0, n, CHUNK):
            b, before = min(a + CHUNK, n), max(a - span, 0)
            least[a:b] = _slide(grams[a:b + span], span + 1, np.minimum)[:b - a]
            most = _slide(least[before:b] * self.valid[before:b], span + 1, np.maximum, back=True)[a - before:]
            at = np.flatnonzero(most == grams[a:b])
            sync.append(at[most[at] > 0] + a)
        return least, np.concatenate(sync) if sync else np.zeros(0, dtype=np.int64)

    def _contexts(self) -> np.ndarray:
        """Names of the contexts: of grams that overlap all along, and of where the context is cut."""
        p, last = self.sync, self.hi - self.shape.gram
        c = mix((p - self.lo).astype(np.uint64) * U64(1 << 20) + (self.hi - p).astype(np.uint64))
        ahead = self.shape.offsets
        for off in (*(-o for o in ahead[:0:-1]), *ahead):
            c = pair_name(c, self.h[np.maximum(p + off, self.lo) if off < 0 else np.minimum(p + off, last)])
        return c

    def window_names(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names of the windows that start at ``s``: of ranks at growing offsets, pair by pair."""
        parts = [self.h[s + o] for o in self.shape.offsets]
        other = reduce(lambda name, part: pair_name(part, name, 2), parts[:-1])
        return reduce(pair_name, parts), pair_name(parts[-1], other, 3)

    def windows_at(self, which: np.ndarray) -> np.ndarray:
        """Starts of the valid windows whose sync points are among ``sync[which]``, each once."""
        p = self.sync[which]
        name, row = self.h[p], self.row[p]
        starts = np.zeros(len(self.h), dtype=bool)
        for back in range(self.shape.span + 1):
            s = np.maximum(p - back, 0)          # p >= back tells where the array begins
            starts[s[(p >= back) & (self.least[s] == name) & self.valid[s] & (self.row[s] == row)]] = True
        return np.flatnonzero(starts)


def group_starts(sorted_key: np.ndarray) -> np.ndarray:
    if not len(sorted_key):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))


def pair_order(one: np.ndarray, two: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together, and where each pair starts in it; ``kind="stable"``: as they came."""
    if not len(one):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    both = pair_name(one, two)
    order = np.argsort(both, kind=kind)
    a, b, c = one[order], two[order], both[order]
    new = c[1:] != c[:-1]
    other = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    if (other & ~new).any():                     # two pairs under one name: sort by the pairs themselves
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        other = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(np.concatenate(([True], other)))


def earlier(keys: tuple[np.ndarray, np.ndarray], docs: np.ndarray, rows: np.ndarray, within: bool,
            least: np.ndarray | None = None) -> np.ndarray:
    """Per occurrence, in the order of their places, whether the same two keys occur under a smaller doc id (in the block, or
    ``least``, the smallest id known elsewhere), or (``within``) earlier in the same row."""
    order, starts = pair_order(*keys, kind="stable" if within else None)
    if not len(order):
        return np.zeros(0, dtype=bool)
    d = docs[order]
    out = d > np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(order))))
    if within:
        r = rows[order]
        again = r[1:] == r[:-1]
        again[starts[1:] - 1] = False
        out[1:] |= again
    back = np.empty_like(out)
    back[order] = out
    return back | (docs > least) if least is not None else back


def painted(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in a span [begin, end); both ascend, and no span is empty."""
    gap = begin[1:] > end[:-1]
    edges = np.empty(2 * (np.count_nonzero(gap) + 1 if len(begin) else 0) + 2, dtype=np.int64)
    edges[0], edges[-1] = 0, n
    if len(begin):
        edges[1:-1:2] = begin[np.concatenate(([True], gap))]
        edges[2:-1:2] = end[np.concatenate((gap, [True]))]
    return np.repeat(np.arange(len(edges) - 1) % 2 == 1, np.diff(edges))


# ---- messages ------------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    raw = b"".join([np.int64(len(arrays[0])).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        dtype = np.dtype(kind)
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * dtype.itemsize
    return out


def deal(block: int, buckets: int, key: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows (bucket, block, message) of one block: its arrays dealt by the hash of ``key``, sorted by key."""
    bucket = (mix(key) % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)      # short ones sort by digits
    order = np.argsort(key, kind="stable") if (key[1:] < key[:-1]).any() else np.arange(len(key))
    order = order[np.argsort(bucket[order], kind="stable")]
    starts = group_starts(bucket[order])
    out = []
    for i, a in enumerate(starts):
        part = order[a:starts[i + 1] if i + 1 < len(starts) else None]
        out.append((int(bucket[part[0]]), block, pack(key[part], *(x[part] for x in arrays))))
    return out


GRAM = ("<u8", "<u8", "<i8", "u1")              # name, context, smallest doc id, several contexts in the block
ANSWER = ("<u8", "<i8", "u1")                   # name, smallest doc id with the block's context, look closer (2: hot)
WINDOW = ("<u8", "<u4", "<i8")                  # two names (96 bits), smallest doc id
FOUND = ("<u8", "<i8")                          # first name, smallest doc id anywhere
MESSAGES = "bucket long, block long, data binary"


def gram_messages(block: int, buckets: int, q: Sequences) -> list[tuple]:
    order = np.argsort(q.names)
    names, contexts, docs = q.names[order], q.contexts[order], q.docs[order]
    starts = group_starts(names)
    if not len(starts):
        return []
    context = np.minimum.reduceat(contexts, starts)
    several = context != np.maximum.reduceat(contexts, starts)
    return deal(block, buckets, names[starts], context, np.minimum.reduceat(docs, starts), several.astype(np.uint8))


def answer_grams(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: tell blocks about their grams that occur elsewhere too, or branch."""
    parts = [unpack(b, *GRAM) for b in group["data"]]
    blocks = np.repeat(group["block"].to_numpy(), [len(p[0]) for p in parts])
    name, context, doc, several = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(name)
    starts = group_starts(name[order])
    size = np.diff(np.append(starts, len(name)))
    # a gram of one block, with one context there, is done with
    order = order[np.repeat(size > 1, size) | (several[order] > 0)]
    order = order[np.lexsort((doc[order], context[order], name[order]))]
    name, context, doc, several, blocks = name[order], context[order], doc[order], several[order], blocks[order]
    starts = group_starts(name)
    if not len(starts):
        return _answers(blocks, name, doc, several)
    size = np.diff(np.append(starts, len(name)))
    branch = (np.minimum.reduceat(context, starts) != np.maximum.reduceat(context, starts)) | (np.maximum.reduceat(several, starts) > 0)
    branch = np.repeat(branch, size)
    same = np.ones(len(name), dtype=bool)
    same[1:] = (name[1:] != name[:-1]) | (context[1:] != context[:-1]) | (several[1:] != several[:-1])
    heads = np.flatnonzero(same)
    least = np.repeat(doc[heads], np.diff(np.append(heads, len(name))))
    # a row whose context a smaller document has too is covered; the others of a branching gram look closer
    least = np.where(several > 0, LAST, least)
    closer = branch & ((several > 0) | (doc == least))
    hot = np.repeat(np.add.reduceat(closer.astype(np.int64), starts) > HOT_BLOCKS, size)
    return _answers(blocks, name, least, closer.astype(np.uint8) << hot.astype(np.uint8))


def _answers(blocks: np.ndarray, name: np.ndarray, *arrays: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((name, blocks))
    starts = group_starts(blocks[order])
    out = []
    for i, a in enumerate(starts):
        part = order[a:starts[i + 1] if i + 1 < len(starts) else None]
        out.append((int(blocks[part[0]]), pack(name[part], *(x[part] for x in arrays))))
    return pd.DataFrame(out, columns=["block", "data"]).astype({"block": "int64"})


def answer_windows(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket of windows: the smallest doc id of those that several blocks have."""
    parts = [unpack(b, *WINDOW) for b in group["data"]]
    blocks = np.repeat(group["block"].to_numpy(), [len(p[0]) for p in parts])
    one, two, doc = (np.concatenate(c) for c in zip(*parts))
    order, heads = pair_order(one, two)
    if not len(order):
        return _answers(blocks, one, doc)
    one, doc, blocks = one[order], doc[order], blocks[order]
    least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(one))))
    tell = doc > least
    return _answers(blocks[tell], one[tell], least[tell])


def merged(group: pd.DataFrame, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """All answers to one block, sorted by name."""
    if not len(group):
        return [np.zeros(0, np.dtype(k)) for k in kinds]
    arrays = [np.concatenate(c) for c in zip(*(unpack(b, *kinds) for b in group["data"]))]
    order = np.argsort(arrays[0], kind="stable")
    return [a[order] for a in arrays]


def look_up(names: np.ndarray, known: np.ndarray, *values: tuple[np.ndarray, int]) -> list[np.ndarray]:
    """For each (value, default), the values of ``names`` in the sorted ``known``."""
    if not len(known):
        return [np.full(len(names), default, dtype=value.dtype) for value, default in values]
    order = np.argsort(names)                    # neighbours look at the same places
    at = np.empty(len(names), dtype=np.int64)
    at[order] = np.minimum(np.searchsorted(known, names[order]), len(known) - 1)
    hit = known[at] == names
    return [np.where(hit, value[at], default) for value, default in values]


class Apply:
    """What the answers say about one block."""

    def __init__(self, q: Sequences, grams: pd.DataFrame):
        self.q = q
        name, least, closer = merged(grams, ANSWER)
        self.least, look = look_up(q.names, name, (least, LAST), (closer, 0))
        self.closer = np.flatnonzero(look)
        self.hot = name[closer == 2]
        self.whole = earlier((q.names, q.contexts), q.docs, q.row[q.sync], q.shape.within, self.least)
        # windows inside a covered context are settled; the first document that has one is not among them and speaks
        inside = painted(len(q.h), q.lo[self.whole], q.hi[self.whole] - q.shape.window + 1)
        starts = q.windows_at(self.closer)
        self.starts = starts[~inside[starts]]
        self.one, self.two = q.window_names(self.starts)
        self.window_docs = q.ids[q.row[self.starts]]

    def window_messages(self, block: int, buckets: int) -> list[tuple]:
        order, starts = pair_order(self.one, self.two)
        if not len(order):
            return []
        pick = order[starts]
        return deal(block, buckets, self.one[pick], self.two[pick].astype(np.uint32), np.minimum.reduceat(self.window_docs[order], starts))

    def covered(self, windows: pd.DataFrame) -> np.ndarray:
        """Per symbol, whether a window that starts earlier elsewhere covers it."""
        q, shape = self.q, self.q.shape
        one, least = merged(windows, FOUND)
        single = earlier((self.one, self.two), self.window_docs, q.row[self.starts], shape.within,
                         *look_up(self.one, one, (least, LAST)))
        n, starts = len(q.h), self.starts[single]
        return painted(n, q.lo[self.whole], q.hi[self.whole]) | painted(n, starts, starts + shape.window)


# ---- the passes ----------------------------------------------------------------------------

def buckets_for(total_bytes: int) -> int:
    return max(64, -(-total_bytes // BUCKET_BYTES))


def find(docs: DataFrame, text_col: str, sequences: Callable[[pa.Table], tuple], finish: Callable, schema: str,
         closer: tuple[Callable, Callable] | None = None) -> DataFrame:
    """Run the passes: ``sequences`` turns a block's table into (Sequences, anything else), ``finish``
    turns (table, sequences, else, covered) into result batches of ``schema``.

    ``closer``: (messages of an Apply, answers of a bucket) for branching grams, by default windows
    matched by their names.
    """
    send, answer = closer or (Apply.window_messages, answer_windows)
    blocks = write_blocks(docs, text_col, BLOCK_BYTES)
    total = blocks.agg(F.sum("size").alias("s")).first()["s"] or 0
    buckets = buckets_for(total)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, _ = sequences(read_block(batch.column(1)[i].as_py()))
                yield _message_batch(gram_messages(batch.column(0)[i].as_py(), buckets, q))

    grams = store(blocks.select("block", "data").mapInArrow(first, MESSAGES).groupBy("bucket")
                  .applyInPandas(answer_grams, "block long, data binary"), "grams", codec="uncompressed")

    def second(table: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, data in zip(table["block"], table["data"]):
            q, rest = sequences(read_block(data))
            out += send(Apply(q, told), int(block), buckets)
        return pd.DataFrame(out, columns=["bucket", "block", "data"]).astype({"bucket": "int64", "block": "int64"})

    by_block = blocks.select("block", "data").groupBy("block")
    windows = store(by_block.cogroup(grams.groupBy("block")).applyInPandas(second, MESSAGES).groupBy("bucket")
                    .applyInPandas(answer, "block long, data binary"), "windows", codec="uncompressed")
    told = grams.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))

    def third(table: pa.Table, messages: pa.Table) -> pa.Table:
        told = messages.to_pandas()
        parts = []
        for data in table.column("data").to_pylist():
            documents = read_block(data)
            q, rest = sequences(documents)
            covered = Apply(q, told[told["kind"] == 0]).covered(told[told["kind"] == 1])
            parts.append(finish(documents, q, rest, covered))
        return pa.concat_tables(parts)

    return blocks.select("block", "data").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(third, schema)


def _message_batch(rows: list[tuple]) -> pa.RecordBatch:
    bucket, block, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(block, pa.int64()), pa.array(data, pa.binary())],
                                      names=["bucket", "block", "data"])


def doc_ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers; a null id counts as the largest, so it never makes others repeats."""
    return column.cast(pa.int64()).fill_null(LAST).to_numpy().astype(np.int64)
