"""Best-fit-decreasing packing of token pieces into sequences of a fixed length.

Each document becomes its token ids and an end id, cut into pieces of at most ``seq_len``
tokens (cuts counted from the end, so only the first piece is shorter).  Pieces of one length
are interchangeable, and there are at most ``seq_len`` lengths, so best-fit decreasing runs on
the *histogram* of lengths: a segment tree over remaining capacities finds the tightest
capacity that still has an open bin in logarithmic time, and one step places a whole run of
equal pieces into a run of equal bins.  The histogram has at most ``seq_len`` rows and a step
adds at most two runs of bins, so the driver's share does not grow with the data.  The steps
form a table (length, rank range -> sequence ids, offset); a piece's rank among the pieces of
its length comes from a blocked count, so no length, however common, meets in one task.

Edge cases: a null text is empty; an empty text is the single end id; repeated rows are packed
as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ersa.llm.common import id_text, spark_salt, store

BLOCK_ROWS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_WITH_IDS = PIECES + ", ids array<int>"


# ---- best fit on runs of equal bins -------------------------------------------------------

class CapacityTree:
    """Segment tree over capacities 0..n: which hold an open bin; smallest such one >= x."""

    def __init__(self, n: int):
        self.leaves = 1 << max(0, n).bit_length()
        self.any = np.zeros(2 * self.leaves, dtype=bool)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = is_open
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:                                    # climb until a right sibling has an open bin
            if not i & 1 and self.any[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:                          # then down its leftmost open path
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], seq_len: int) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, first sequence id, pieces per sequence, offset).

    Pieces of a length take the ranks in order: piece ``rank`` goes to sequence
    ``first id + (rank - first rank) // per`` at ``offset + ((rank - first rank) % per) * length``.
    """
    tree = CapacityTree(seq_len)
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)    # capacity -> runs (first id, bins)
    steps: list[tuple[int, int, int, int, int, int]] = []
    next_id = 0

    def leave(capacity: int, first: int, bins: int) -> None:
        if bins and capacity:
            open_bins[capacity].append((first, bins))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, bins = seq_len, next_id, -(-left // (seq_len // length))
                next_id += bins
            else:
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            per = room // length
            full = min(bins, left // per)
            if full:
                steps.append((length, rank, rank + full * per, first, per, seq_len - room))
                leave(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < bins and left:                    # the last pieces only start one more bin
                steps.append((length, rank, rank + left, first + full, left, seq_len - room))
                leave(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(room, first + full, bins - full)
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


# ---- pieces -------------------------------------------------------------------------------

class ByteBpe:
    """Ids of the byte-level BPE in ``path`` (a tokenizers file with its rank file beside it).

    The rank file holds the same vocabulary; its encoder gives the same ids several times
    faster.  A text on which it gives up (huge runs of blanks), or that holds an added token
    (<|endoftext|>, which has an id of its own inside texts too), is encoded by the other library.
    """

    def __init__(self, path: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.path, self._slow = path, None
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]

    def ids(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return self.slow_ids(text)
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:                      # the encoder's panics are not Exceptions
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slow_ids(text)

    def slow_ids(self, text: str) -> np.ndarray:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bounds(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids: full pieces from the end, the first may be shorter."""
    first = n % seq_len or seq_len
    return [(0, min(first, n))] + [(s, seq_len) for s in range(first, n, seq_len)]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, seq_len: int = 1024, end_id: int = 2,
                 with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 (and the ids themselves)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            out: list[tuple] = []
            ids_out = []
            texts = batch.column(1)
            for doc, i in zip(batch.column(0).to_pylist(), range(len(texts))):
                ids = np.concatenate([bpe.ids(texts[i].as_py()).astype("<u4"), end])
                for k, (start, length) in enumerate(piece_bounds(len(ids), seq_len)):
                    part = ids[start:start + length]
                    out.append((doc, k, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            doc_id, piece, start, length, crc = zip(*out) if out else ((),) * 5
            cols = [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES_WITH_IDS if with_ids else PIECES)


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with ``rank``, its place among the pieces of its length (0, 1, ...).

    Rows are numbered inside blocks of about BLOCK_ROWS by content; a running sum over the
    blocks' counts, one row per block and length, turns that into a rank over the whole table.
    """
    blocks = max(1, -(-rows // BLOCK_ROWS))
    cut = pieces.withColumn("block", spark_salt("doc_id", "piece", "ids_crc32", n=blocks))
    inside = Window.partitionBy("block", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy("block", "length").agg(F.count("*").alias("n"))
               .select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return (cut.withColumn("at", F.row_number().over(inside)).join(offsets, ["block", "length"])
            .withColumn("rank", F.col("base") + F.col("at") - 1).drop("block", "at", "base"))


def place(pieces: DataFrame, plan: np.ndarray) -> DataFrame:
    """Sequence id and offset of every ranked piece, by binary search in the plan."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "rank")
    shared = pieces.sparkSession.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        span = int(steps[:, 2].max()) + 1 if len(steps) else 1
        keys = steps[:, 0] * span + steps[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            s = steps[np.searchsorted(keys, length * span + rank, side="right") - 1]
            i = rank - s[:, 1]
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in keep]
                + [pa.array(s[:, 3] + i // s[:, 4]), pa.array(s[:, 5] + i % s[:, 4] * length)],
                names=[*keep, "sequence_id", "offset"])

    return pieces.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, seq_len: int = 1024, tokenizer: str | None = None, end_id: int = 2,
         with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents; one row per piece with its sequence_id and offset (see the module's text)."""
    pieces = store(token_pieces(docs, tokenizer, seq_len, end_id, with_ids, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(ranked(pieces, sum(counts.values())), best_fit_plan(counts, seq_len))
