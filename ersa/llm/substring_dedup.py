"""Repeated word passages by prefix-partitioned suffix trees.

A document's suffixes start at its words.  They are dealt to groups by prefixes: the prefix of
``GRAM`` words at a window's sync point (see ``repeats``) first.  A prefix with one continuation is
a path without branches: all its occurrences but the first are repeats as deep as the path goes,
and no tree is built.  Only prefixes with several continuations send their suffixes, as runs of
words; a prefix that branches in many blocks is extended to whole windows, so its suffixes spread
over groups.  Inside a group, prefixes are lengthened word by word until their
suffixes fit ``GROUP_ROWS``; each such part is sorted into its subtree, and internal nodes at least
``window`` words deep are the repeats.

So trees are built for branching prefixes only, and a window's first occurrence is answered by names where a prefix does not branch;
subtrees end at ``window`` words, as nothing asks for deeper nodes, and maximal repeats are given as the removed spans of a document,
not as strings.  Trees for all repeated prefixes would send every suffix of every copied passage and
build what the answer does not need.

A word is removed if a window of ``window`` words that covers it also starts earlier: under a smaller
doc_id, or earlier in the same document.  Windows are judged on the input.

Edge cases: a null text has no words; a null doc_id counts as the largest; rows with the same
doc_id do not remove each other; texts of fewer than ``window`` words stay; an empty table gives an
empty result; other columns are kept by ``dedup_documents`` and ignored by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ersa.llm.common import U64, doc_words, id_text, mix, pair_name
from ersa.llm.repeats import Apply, Sequences, Shape, _answers, doc_ids, find, group_starts, pack, unpack

GRAM = 8
#: Suffixes that one subtree sorts at once.
GROUP_ROWS = 200_000


def word_grams(names: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Names of the ``gram`` words from each word on, by doubling (gram is a power of two)."""
    n, step = len(names), 1
    out = np.concatenate([names, np.zeros(gram, dtype=np.uint64)])
    while step < gram:
        out = pair_name(out[:len(out) - step], out[step:])
        step *= 2
    return out[:n]


def column_grams(rows: np.ndarray, at: int, gram: int = GRAM) -> np.ndarray:
    """The same names, for column ``at`` of rows of words."""
    cols, step = [rows[:, at + i] for i in range(gram)], 1
    while step < gram:
        cols = [pair_name(cols[i], cols[i + step]) for i in range(len(cols) - step)]
        step *= 2
    return cols[0]


# ---- suffix messages -----------------------------------------------------------------------

class Words(Sequences):
    """Sequences that keep the words' own names."""

    def __init__(self, shape: Shape, names: np.ndarray, first: np.ndarray, ids: np.ndarray):
        super().__init__(shape, word_grams(names), first, ids)
        self.symbols = names


def suffix_messages(found: Apply, block: int, buckets: int) -> list[tuple]:
    """The block's distinct suffixes at branching prefixes, as runs of consecutive starts."""
    q, window = found.q, found.q.shape.window
    order = np.lexsort((found.starts, found.window_docs, found.two, found.one))
    one, two = found.one[order], found.two[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    pick = np.sort(order[new])
    starts, names = found.starts[pick], found.one[pick]
    if not len(starts):
        return []
    prefix, row = q.least[starts], q.row[starts]
    hot = np.isin(prefix, found.hot)
    begin = np.ones(len(starts), dtype=bool)
    begin[1:] = (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1]) | (prefix[1:] != prefix[:-1]) | hot[1:]
    head = np.flatnonzero(begin)
    size = np.diff(np.append(head, len(starts)))
    # every block hears of the same hot prefixes, so equal suffixes meet whichever way they are dealt
    bucket = (mix(np.where(hot, names, prefix)[head]) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, head, size = bucket[order], head[order], size[order]
    out = []
    cuts = group_starts(bucket)
    for i, a in enumerate(cuts):
        b = cuts[i + 1] if i + 1 < len(cuts) else len(bucket)
        words = [q.symbols[starts[h]:starts[h] + m + window - 1] for h, m in zip(head[a:b], size[a:b])]
        table = pack(size[a:b].astype(np.int64), q.ids[row[head[a:b]]])
        flat = pack(np.concatenate(words))
        out.append((int(bucket[a]), block, np.int64(len(table)).tobytes() + table + flat))
    return out


# ---- subtrees ------------------------------------------------------------------------------

def prefix_groups(rows: np.ndarray, depth: int = 0, limit: int = GROUP_ROWS) -> Iterator[np.ndarray]:
    """Row numbers split by their first words; prefixes grow only where a group exceeds ``limit``."""
    pending = [(np.arange(len(rows)), depth)]
    while pending:
        part, at = pending.pop()
        if len(part) <= limit or at == rows.shape[1]:
            yield part
            continue
        order = part[np.argsort(rows[part, at], kind="stable")]
        starts = group_starts(rows[order, at])
        small, held = [], 0
        for i, a in enumerate(starts):
            piece = order[a:starts[i + 1] if i + 1 < len(starts) else None]
            if len(piece) > limit:
                pending.append((piece, at + 1))
                continue
            if held + len(piece) > limit and small:
                yield np.concatenate(small)
                small, held = [], 0
            small.append(piece)
            held += len(piece)
        if small:
            yield np.concatenate(small)


def subtree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of ``rows`` as sorted suffixes and the depth (common words) between neighbours."""
    order = np.lexsort(rows.T[::-1])
    sorted_rows = rows[order]
    same = sorted_rows[1:] == sorted_rows[:-1]
    depth = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    return order, depth


def deep_nodes(rows: np.ndarray, window: int) -> Iterator[np.ndarray]:
    """For each internal node at least ``window`` words deep, the rows below it."""
    for part in prefix_groups(rows):
        order, depth = subtree(rows[part])
        inside = np.concatenate(([False], depth >= window, [False]))
        begins = np.flatnonzero(~inside[:-1] & inside[1:])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        for a, b in zip(begins, ends):
            yield part[order[a:b]]


def answer_suffixes(window: int):
    def answer(group: pd.DataFrame) -> pd.DataFrame:
        rows, docs, blocks = [], [], []
        for block, blob in zip(group["block"], group["data"]):
            cut = 8 + int(np.frombuffer(blob, np.int64, 1)[0])
            size, doc = unpack(blob[8:cut], "<i8", "<i8")
            flat = unpack(blob[cut:], "<u8")[0]
            begin = np.cumsum(size + window - 1) - (size + window - 1)
            at = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            rows.append(flat[at[:, None] + np.arange(window)[None, :]])
            docs.append(np.repeat(doc, size))
            blocks.append(np.full(len(at), block))
        rows, docs, blocks = np.concatenate(rows), np.concatenate(docs), np.concatenate(blocks)
        told, least = [], []
        for node in deep_nodes(rows, window):
            first = docs[node].min()
            later = node[docs[node] > first]
            told.append(later)
            least.append(np.full(len(later), first))
        if not told:
            return _answers(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        told, least = np.concatenate(told), np.concatenate(least)
        named = reduce(pair_name, (column_grams(rows[told], at) for at in _shape(window).offsets))
        return _answers(blocks[told], named, least)
    return answer


# ---- documents -----------------------------------------------------------------------------

def _sequences(shape: Shape):
    def sequences(table: pa.Table):
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        buf, starts, ends, names, first = doc_words(texts)
        return Words(shape, names, first, doc_ids(table.column("doc_id"))), (texts, starts, ends)
    return sequences


def _spans(mask: np.ndarray) -> list[list[int]]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).tolist()


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, removed (array of [start, end) word spans) and kept (remaining words, one space between)."""
    shape = _shape(window)

    def finish(table: pa.Table, q: Sequences, rest: tuple, covered: np.ndarray) -> pa.Table:
        removed, kept = [], []
        for text, a, b in zip(rest[0], q.first[:-1], q.first[1:]):
            words, mask = text.split(), covered[a:b]
            removed.append(_spans(mask))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(~mask)] if removed[-1] else words).decode())
        return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "n_words": pa.array(np.diff(q.first), pa.int64()),
                         "removed": pa.array(removed, pa.list_(pa.list_(pa.int64()))), "kept": pa.array(kept, pa.string())})

    return find(id_text(docs, id_col, text_col), "text", _sequences(shape), finish,
                "doc_id long, n_words long, removed array<array<long>>, kept string", (suffix_messages, answer_suffixes(window)))


def dedup_documents(docs: DataFrame, window: int = 20) -> DataFrame:
    """The documents with all their columns; repeated words are cut out of ``text`` (white space between
    the words that stay is as it was) and ``n_chars``, where there is one, is counted anew.

    No row is dropped: a text that repeats earlier ones as a whole becomes empty.
    """
    names = docs.columns

    def finish(table: pa.Table, q: Sequences, rest: tuple, covered: np.ndarray) -> pa.Table:
        texts, starts, ends = rest
        out, sizes = table.column("text").to_pylist(), []
        at = 0
        for i, (text, a, b) in enumerate(zip(texts, q.first[:-1], q.first[1:])):
            mask = covered[a:b]
            if mask.any():
                begin, end = starts[a:b] - at, ends[a:b] - at
                parts, stays = [], np.flatnonzero(~mask)
                if len(stays):
                    edge = np.flatnonzero(np.diff(stays) > 1)
                    for x, y in zip(np.append(0, edge + 1), np.append(edge, len(stays) - 1)):
                        tail = begin[stays[y] + 1] if y + 1 < len(stays) or stays[y] + 1 < len(mask) else len(text)
                        parts.append(text[begin[stays[x]]:tail])
                    parts[-1] = parts[-1].rstrip() if stays[-1] + 1 < len(mask) else parts[-1]
                out[i] = b"".join(parts).decode()
            at += len(text) + 1
        text = pa.array(out, table.schema.field("text").type)
        table = table.set_column(names.index("text"), table.schema.field("text"), text)
        if "n_chars" in names and pa.types.is_integer(table.schema.field("n_chars").type):
            field = table.schema.field("n_chars")
            counted = [n if t is None else len(t) for t, n in zip(out, table.column("n_chars").to_pylist())]
            table = table.set_column(names.index("n_chars"), field, pa.array(counted, field.type))
        return table

    return find(docs, "text", _sequences(_shape(window)), finish, docs.schema, (suffix_messages, answer_suffixes(window)))


def _shape(window: int) -> Shape:
    if window < 2 * GRAM - 2:
        raise ValueError(f"windows of fewer than {2 * GRAM - 2} words are not supported")
    return Shape(window, GRAM, within=True)
