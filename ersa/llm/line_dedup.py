"""Repeated lines by two Bloom filters, with exact confirmation of the suspects.

A line's key is the line without the blanks (``[\\x20\\x09-\\x0D]``) at its ends, A-Z in lower case.  Keys
of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines
except in the document with the largest doc_id that holds them.

1. *Filters.*  Documents travel in blocks.  A block sends 64-bit hashes of its distinct keys to buckets of
   the hash space.  A bucket passes them through two Bloom filters: what meets the filter of hashes seen once
   enters the filter of hashes seen twice.  The hashes that hit the second filter go back to their blocks.
   The filters have ``filter_bits`` bits a hash, so a bucket is bounded and needs no broadcast at any size.
2. *Confirmation.*  Only lines with a suspected hash are sent on, by their 128-bit names, with the documents that
   hold them (a block needs to name no more than ``min_docs`` of them, its largest).  Spark counts distinct documents
   and takes the largest; a false positive of the filters is found out here.
3. *Choice.*  Confirmed names go back to the blocks that hold them, and blocks drop the lines.

A line in every document is one message a block in each step, not one a document.

Edge cases: a null or empty text is one empty line; a null doc_id is a document of its own that ranks below all
others; rows that share a doc_id are one document; a line that a document holds several times counts once and stays or
goes as a whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ersa.llm.common import U64, id_text, mix, store
from ersa.llm.repeats import _answers, _message_batch, buckets_for, deal, group_starts, read_block, unpack, write_blocks

#: Text bytes of one block.  Large, as a line that all blocks hold is one message a block.
BLOCK_BYTES = 8 << 20
FILTER_BITS = 12
PROBES = 4
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Stands for a null doc_id.
NO_ID = np.iinfo(np.int64).min


# ---- lines ---------------------------------------------------------------------------------

def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()                    # bytes.lower folds A-Z only


def line_name(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes that name the line's key; None for keys of fewer than ``min_chars`` code points."""
    key = line_key(line)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class Lines:
    """The lines of a block's documents and the names of those long enough."""

    def __init__(self, table: pa.Table, min_chars: int):
        self.ids = table.column("doc_id").cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
        self.lines = [(t or "").encode().split(b"\n") for t in table.column("text").to_pylist()]
        rows, places, names = [], [], []
        for r, lines in enumerate(self.lines):
            for k, line in enumerate(lines):
                name = line_name(line, min_chars)
                if name is not None:
                    rows.append(r)
                    places.append(k)
                    names.append(name)
        self.rows, self.places = np.array(rows, dtype=np.int64), np.array(places, dtype=np.int64)
        self.names = np.frombuffer(b"".join(names), dtype="<u8").reshape(-1, 2)
        self.docs = self.ids[self.rows] if len(rows) else np.zeros(0, dtype=np.int64)


# ---- the two filters -----------------------------------------------------------------------

class SeenTwice:
    """Bloom filters of hashes seen once and seen twice; never forgets a hash that was seen twice."""

    def __init__(self, expected: int, bits: int = FILTER_BITS):
        self.mask = U64((1 << max(6, int(expected * bits - 1).bit_length())) - 1)
        self.once = np.zeros(int(self.mask) + 1, dtype=bool)
        self.twice = np.zeros(int(self.mask) + 1, dtype=bool)

    def _bits(self, hashes: np.ndarray) -> np.ndarray:
        step = mix(hashes ^ U64(0xA5A5A5A5)) | U64(1)
        return np.stack([(mix(hashes) + U64(i) * step) & self.mask for i in range(PROBES)]).astype(np.int64)

    def add(self, hashes: np.ndarray, twice: np.ndarray) -> None:
        """Add distinct hashes; ``twice``: those that their sender has seen twice itself."""
        bits = self._bits(hashes)
        again = self.once[bits].all(axis=0) | twice
        self.twice[bits[:, again]] = True
        self.once[bits] = True

    def suspected(self, hashes: np.ndarray) -> np.ndarray:
        return self.twice[self._bits(hashes)].all(axis=0)


def hash_messages(block: int, buckets: int, q: Lines) -> list[tuple]:
    """The block's distinct hashes and whether two of its documents hold them."""
    hashes = q.names[:, 0]
    order = np.lexsort((q.docs, hashes))
    hashes, docs = hashes[order], q.docs[order]
    starts = group_starts(hashes)
    if not len(starts):
        return []
    several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts)
    return deal(block, buckets, hashes[starts], several.astype(np.uint8))


def suspects(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    """One bucket: the hashes of each block that the filter of hashes seen twice lets through."""
    parts = [unpack(b, "<u8", "u1") for b in group["data"]]
    seen = SeenTwice(sum(len(p[0]) for p in parts), bits)
    for hashes, several in parts:
        seen.add(hashes, several.astype(bool))
    hits = [p[0][seen.suspected(p[0])] for p in parts]
    return _answers(np.repeat(group["block"].to_numpy(), [len(h) for h in hits]), np.concatenate(hits))


def suspect_lines(q: Lines, told: list[bytes]) -> np.ndarray:
    """Indices of the lines with a suspected hash."""
    hashes = [unpack(b, "<u8")[0] for b in told]
    return np.flatnonzero(np.isin(q.names[:, 0], np.concatenate(hashes))) if hashes else np.zeros(0, dtype=np.int64)


# ---- the passes ----------------------------------------------------------------------------

def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text",
                filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text without the repeated lines)."""
    blocks = write_blocks(id_text(docs, id_col, text_col), "text", BLOCK_BYTES)
    buckets = buckets_for(blocks.agg(F.sum("size").alias("s")).first()["s"] or 0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _message_batch(hash_messages(block, buckets, Lines(read_block(data.as_py()), min_chars)))

    told = store(blocks.select("block", "data").mapInArrow(send, "bucket long, block long, data binary").groupBy("bucket")
                 .applyInPandas(lambda group: suspects(group, filter_bits), "block long, data binary"), "suspects", codec="uncompressed")

    def name(table: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for block, data in zip(table["block"], table["data"]):
            q = Lines(read_block(data), min_chars)
            which = suspect_lines(q, answers["data"].to_list())
            k1, k2, docs_ = q.names[which, 0], q.names[which, 1], q.docs[which]
            order = np.lexsort((-1 - docs_, k2, k1))             # largest document first (-1 - x falls as x grows, without overflow)
            k1, k2, docs_ = k1[order], k2[order], docs_[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            fresh = new.copy()
            fresh[1:] |= docs_[1:] != docs_[:-1]
            k1, k2, docs_, new = k1[fresh], k2[fresh], docs_[fresh], new[fresh]
            starts = np.flatnonzero(new)
            nth = np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new))))
            ok = nth < min_docs
            parts.append(pd.DataFrame({"block": np.full(int(ok.sum()), block, dtype=np.int64), "k1": k1[ok].view(np.int64),
                                       "k2": k2[ok].view(np.int64), "doc": docs_[ok], "first": new[ok]}))
        return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("block", "k1", "k2", "doc")} | {"first": np.zeros(0, bool)})

    by_block = blocks.select("block", "data").groupBy("block")
    named = store(by_block.cogroup(told.groupBy("block")).applyInPandas(name, "block long, k1 long, k2 long, doc long, first boolean"), "named")
    # distinct documents first, spread by document, so a hot line is counted in many tasks
    confirmed = named.select("k1", "k2", "doc").distinct() \
        .groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs)
    drop = named.where("first").select("block", "k1", "k2").join(confirmed.select("k1", "k2", "last"), ["k1", "k2"]).select("block", "k1", "k2", "last")

    def cut(table: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        out = {"doc_id": [], "n_lines": [], "n_dropped": [], "kept": []}
        last = dict(zip(zip(gone["k1"], gone["k2"]), gone["last"]))
        for data in table["data"]:
            documents = read_block(data)
            q = Lines(documents, min_chars)
            lost: dict[int, set[int]] = {}
            if last:
                names = q.names.view(np.int64).tolist()
                for r, k, d, pair in zip(q.rows.tolist(), q.places.tolist(), q.docs.tolist(), names):
                    if last.get((pair[0], pair[1]), d) != d:
                        lost.setdefault(r, set()).add(k)
            for r, lines in enumerate(q.lines):
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lost.get(r, ())))
                out["kept"].append(b"\n".join(x for k, x in enumerate(lines) if k not in lost[r]) if r in lost else b"\n".join(lines))
            out["doc_id"] += documents.column("doc_id").to_pylist()
        out["kept"] = [t.decode() for t in out["kept"]]
        out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
        return pd.DataFrame(out)

    return blocks.select("block", "data").groupBy("block").cogroup(drop.groupBy("block")) \
        .applyInPandas(cut, "doc_id long, n_lines long, n_dropped long, kept string")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM d),
lines AS (SELECT rid, doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM cut),
keyed AS (
  SELECT rid, coalesce(doc_id, -9223372036854775808) AS who, k, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, max(who) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT who) >= 3),
judged AS (SELECT rid, k, line, last IS NOT NULL AND last <> who AS gone FROM keyed LEFT JOIN held USING (key))
SELECT d.doc_id, j.n_lines, j.n_dropped, sha256(j.kept) AS kept_sha256
FROM d JOIN (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept
  FROM judged GROUP BY rid) j USING (rid)
"""
