"""Periodic runs of words by seeds on diagonals.

A run is a stretch of words with smallest period q (words q apart are identical) of at least ``exponent`` periods and
``min_words`` words that no neighbouring word extends.  On the diagonal of lag q it is a stretch of matches, words equal to the
word q behind, as long as the run less q.

*Seeds.*  Lags are cut into classes (2**(j-1), 2**j].  A run whose period lies in a class has at least a certain number k of
matches, the minimum guaranteed overlap, and k is no smaller than the period.  So the k-grams of the document are indexed, and
inside the run a k-gram comes again exactly q words later and not before: two nearer occurrences would make a divisor of q a period
too (Fine and Wilf).  Each occurrence therefore pairs with the next one only; a text full of repeats has as many pairs as words, not
their square, and the lag of a seed is the smallest period, never a multiple.

*Extension.*  Seeds of one lag are taken in order; a table of how far each lag has been covered suppresses those that lie on a
stretch already extended.  The words of a found stretch are compared at the end, so the names of grams only propose.

k-grams are named by doubling, and words whose gram occurs once in their document leave: most texts are
done after a few words.  Documents are independent, so the work is one pass over the scan without a shuffle.

Words are compared by 64-bit names.  Edge cases: a null or empty text has no words and no runs; fewer than ``min_words`` words hold no run;
rows are judged one by one, whatever their ids; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ersa.llm.common import doc_words, id_text, pair_name
from ersa.llm.repeats import group_starts

PIECE_BYTES = 2 << 20


# ---- seeds ---------------------------------------------------------------------------------

def lag_classes(longest: int, exponent: int, min_words: int) -> list[tuple[int, int, int]]:
    """(least lag, greatest lag, k) up to the lag that ``longest`` words can repeat ``exponent`` times; k does not fall."""
    out, low = [], 1
    while low * exponent <= longest:
        high = 1 << (low - 1).bit_length()
        out.append((low, high, min(max(min_words - q, (exponent - 1) * q) for q in range(low, min(high, low + min_words) + 1))))
        low = high + 1
    for i in range(len(out) - 2, -1, -1):
        out[i] = (*out[i][:2], min(out[i][2], out[i + 1][2]))
    return out


class Grams:
    """Names of the grams of growing length at the positions where the gram occurs again in its document."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = np.repeat(first[1:], np.diff(first))
        self.length = 1
        self.at = np.arange(len(words))                        # positions whose gram of ``length`` words may occur again
        self.names = pair_name(words, self.doc.astype(np.uint64))
        self._keep(self.at, self.names)

    def _keep(self, at: np.ndarray, names: np.ndarray) -> None:
        order = np.argsort(names, kind="stable")
        starts = group_starts(names[order])
        again = np.repeat(np.diff(np.append(starts, len(names))) > 1, np.diff(np.append(starts, len(names))))
        stay = np.sort(order[again])
        self.at, self.names = at[stay], names[stay]

    def _pairs(self, shift: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and names of the grams of ``length`` words, of two that start ``shift`` apart."""
        other = np.searchsorted(self.at, self.at + shift)
        other = np.minimum(other, max(len(self.at) - 1, 0))
        ok = (self.at + length <= self.end[self.at]) & (self.at[other] == self.at + shift)
        return self.at[ok], pair_name(self.names[ok], self.names[other[ok]], length)

    def grow(self, k: int) -> None:
        """Double the length while it stays within ``k`` words."""
        while 2 * self.length <= k and len(self.at):
            self._keep(*self._pairs(self.length, 2 * self.length))
            self.length *= 2

    def next_occurrences(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, words until the same ``k``-gram comes next), where it comes again."""
        at, names = self._pairs(k - self.length, k) if k > self.length else (self.at, self.names)
        order = np.argsort(names, kind="stable")               # by position within a name
        at, names = at[order], names[order]
        same = np.flatnonzero(names[1:] == names[:-1])
        return at[same], at[same + 1] - at[same]


# ---- extension -----------------------------------------------------------------------------

def extend(words: np.ndarray, lo: int, hi: int, at: int, lag: int, k: int) -> tuple[int, int]:
    """The longest stretch [a, b) around ``at`` with words equal to those ``lag`` behind, within the words [lo, hi)."""
    def matches(a: int, b: int) -> np.ndarray:
        return words[a:b] == words[a + lag:b + lag]

    a, b, step = at, min(at + k, hi - lag), 64
    if not matches(at, b).all():                             # the names agreed, the words do not
        return at, at
    while a > lo:
        ok = matches(max(lo, a - step), a)
        back = len(ok) if ok.all() else len(ok) - 1 - int(np.flatnonzero(~ok)[-1])
        a -= back
        if back < len(ok):
            break
        step *= 2
    step = 64
    while b < hi - lag:
        ok = matches(b, min(hi - lag, b + step))
        on = len(ok) if ok.all() else int(np.flatnonzero(~ok)[0])
        b += on
        if on < len(ok):
            break
        step *= 2
    return a, b


def find_in(words: np.ndarray, first: np.ndarray, exponent: int, min_words: int) -> np.ndarray:
    """Runs (document, start, length, period) of word names; documents begin at ``first`` (n + 1), starts count from there."""
    out = []
    grams = Grams(words, first)
    for low, high, k in lag_classes(int(np.diff(first).max(initial=0)), exponent, min_words):
        grams.grow(k)
        if not len(grams.at):
            break
        at, lag = grams.next_occurrences(k)
        near = (lag >= low) & (lag <= high)
        at, lag = at[near], lag[near]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # a seed right behind one of its lag lies on the same stretch
        head = np.ones(len(at), dtype=bool)
        head[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(at[head].tolist(), lag[head].tolist()):
            if i < covered.get(q, -1):
                continue
            doc = int(grams.doc[i])
            a, b = extend(words, int(first[doc]), int(first[doc + 1]), i, q, k)
            covered[q] = max(b, i + 1)
            length = b - a + q
            if a < b and length >= max(min_words, exponent * q):
                out.append((doc, a - int(first[doc]), length, q))
    runs = np.array(out, dtype=np.int64).reshape(-1, 4)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def repeated_words(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per word, whether a run contains it after the run's first period."""
    edge = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    begin = first[runs[:, 0]] + runs[:, 1]
    np.add.at(edge, begin + runs[:, 3], 1)
    np.add.at(edge, begin + runs[:, 2], -1)
    return np.cumsum(edge[:-1]) > 0


# ---- documents -----------------------------------------------------------------------------

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, strongest int, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", pa.int32()), ("collapsed", pa.string())])


def strongest(runs: np.ndarray) -> int | None:
    """Index of the run of greatest exponent; ties: smallest start, then period."""
    best = max(((Fraction(int(n), int(q)), -int(s), -int(q), i) for i, (s, n, q) in enumerate(runs.tolist())), default=None)
    return None if best is None else best[3]


def piece_runs(ids: list, texts: list[bytes], exponent: int, min_words: int) -> pa.RecordBatch:
    buf, starts, ends, names, first = doc_words(texts)
    runs = find_in(names, first, exponent, min_words)
    gone = repeated_words(runs, first)
    held = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    # words that stay, with the byte behind each as its blank
    edge = np.zeros(len(buf) + 1, dtype=np.int8)
    edge[starts[~gone]] += 1
    edge[ends[~gone] + 1] -= 1
    stays = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    flat = buf.copy()
    flat[ends] = 0x20
    flat, reach = flat[stays], np.concatenate(([0], np.cumsum(stays)))
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    kept, best, lists = [], [], []
    for i in range(len(texts)):
        a, b = int(reach[offsets[i]]), int(reach[offsets[i + 1]])
        kept.append(flat[a:max(a, b - 1)].tobytes().decode())
        own = runs[held[i]:held[i + 1], 1:]
        best.append(strongest(own))
        lists.append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(lists, pa.list_(_RUN)),
                                       pa.array(best, pa.int32()), pa.array(kept, pa.string())], schema=_ARROW)


def find_runs(docs: DataFrame, exponent: int = 4, min_words: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), strongest (index of the run of greatest exponent, null without runs) and collapsed
    (the words outside the repeats of runs, one space between)."""
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not supported")       # k would be less than the period

    limit = PIECE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, a, size = batch.column(0).to_pylist(), batch.column(1), 0, 0
            texts: list[bytes] = []
            for i in range(batch.num_rows):
                text = column[i].as_py().encode()
                if texts and size + len(text) > limit:
                    yield piece_runs(ids[a:i], texts, exponent, min_words)
                    a, size, texts = i, 0, []
                texts.append(text)
                size += len(text)
            if texts:
                yield piece_runs(ids[a:], texts, exponent, min_words)

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


# ---- the registered query's texts ----------------------------------------------------------

def planted(doc_id: int | None, text: str | None) -> str | None:
    """The text; if its id has a CRC-32 h divisible by 10, the words from the a-th on go round with period p,
    where g = h / 10, a = g mod n, p = 1 + (n - a) / (3 + g mod 8), all floored, for n words."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not text:
        return text
    words, g = text.encode().split(), h // 10           # bytes split at [\x20\x09-\x0D] only
    if not words:
        return text
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[i if i < a else a + (i - a) % p] for i in range(n)).decode()


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the runs of ``planted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts = [planted(i, t) for i, t in zip(ids.to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")
