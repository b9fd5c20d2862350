"""A quality classifier from compression: how much better one dictionary compresses a text.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled
bad.  A text is compressed with either, in chunks, so that the dictionary matters along the whole
text; the size difference over the sum of the sizes is its evidence.  A logistic curve over that
difference and the compression rate, fitted on other labelled texts with the classes weighted as
they occur, turns the evidence into a probability that the label is good.

Fitting reads a bounded sample: at most ``Sample.rows`` labelled documents of each class, those
with the smallest hash of doc_id, a third of them kept for the curve.  The others' whole texts are cut into pieces of PIECE
bytes, and at most ``Sample.pieces`` of a class, those with the smallest hash, go into its dictionary.  Scoring reads every whole text.  Only rows that the
caller's ``learn`` condition admits are learnt from, and a score depends on the text alone.

Edge cases: a null text is empty; an empty text compresses alike with both and gets the curve's
value at no difference; labels that contradict each other for one doc_id, or are null, are not
learnt from; with one class or no labels at all every score is that class's share (0.5 without
labels); repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ersa.llm.common import id_text, store

#: Bytes of a learning text that are one sample of a dictionary.
PIECE = 1_024
#: Bytes compressed at a time: short, so that the dictionary rather than the text itself is what helps.
CHUNK = 512
LEVEL = 3


@dataclass(frozen=True)
class Sample:
    """What fitting takes at most: labelled rows of each class, pieces of their texts for its dictionary, dictionary bytes."""

    rows: int = 1_500
    pieces: int = 20_000
    dictionary: int = 112_640


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)


class Scorer:
    """Compresses texts with both dictionaries."""

    def __init__(self, model: Model):
        import zstandard

        self.weights = np.array(model.weights)
        self.pair = []
        for raw in (model.good, model.bad):
            kwargs = {"level": LEVEL}
            if raw:
                kwargs["dict_data"] = zstandard.ZstdCompressionDict(raw)
                kwargs["dict_data"].precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(write_checksum=False, write_content_size=False, write_dict_id=False, **kwargs))

    def sizes(self, text: bytes) -> tuple[int, int]:
        good, bad = (sum(len(c.compress(text[i:i + CHUNK])) for i in range(0, len(text), CHUNK)) for c in self.pair)
        return good, bad

    def score(self, n: int, good: int, bad: int) -> float:
        z = float(np.dot(self.weights, features(n, good, bad)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(n: int, good: int, bad: int) -> np.ndarray:
    """1, the normalised size difference (positive: the good dictionary fits better), the log of the rate."""
    if not n:
        return np.array([1.0, 0.0, 0.0])
    return np.array([1.0, 20.0 * (bad - good) / (bad + good), math.log(min(1.0, (good + bad) / (2 * n)))])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A dictionary trained on the pieces, an eighth of them in size at most; the pieces themselves where the trainer
    finds nothing that they have in common."""
    import zstandard

    try:
        return zstandard.train_dictionary(max(256, min(size, sum(map(len, pieces)) // 8)), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: Sample = Sample(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Model:
    """Dictionaries and curve from the labelled documents that ``learn`` (over doc_id) admits."""
    known = (labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("y"))
             .where(F.col("y").isin(0, 1) & learn).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most"))
             .where(F.col("y") == F.col("most")).select("doc_id", "y"))
    pairs = id_text(docs, id_col, text_col).join(known, "doc_id")
    shares = {r["y"]: r["n"] for r in pairs.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        share = 0.5 if not shares else float(next(iter(shares)))
        return Model(b"", b"", (math.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0))
    # the ids are chosen first, so that only the chosen texts are gathered
    chosen = store(pairs.where("y = 0").select("doc_id", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample.rows)
                   .unionByName(pairs.where("y = 1").select("doc_id", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample.rows)), "labelled")
    picked = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")        # at most 2 * sample.rows ids
    curve_part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    whole = picked.where(~curve_part).groupBy("doc_id", "y").agg(F.min(F.encode("text", "UTF-8")).alias("t"))
    at = F.sequence(F.lit(0), F.ceil(F.octet_length("t") / PIECE).cast("int") - 1)
    pieces = whole.where(F.octet_length("t") > 0).select("doc_id", "y", "t", F.explode(at).alias("i")) \
        .select("doc_id", "y", "i", F.substring(F.col("t"), F.col("i") * PIECE + 1, F.lit(PIECE)).alias("piece"))

    def sampled(y: int) -> list[bytes]:                   # at most sample.pieces * PIECE bytes
        rows = pieces.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", "i"), "doc_id", "i").limit(sample.pieces).collect()
        return [bytes(r["piece"]) for r in rows]

    model = Model(*(_dictionary(sampled(y), sample.dictionary) for y in (1, 0)))
    measured = measure(picked.where(curve_part).select("doc_id", "text"), model)
    rows = measured.join(F.broadcast(chosen), "doc_id").select("doc_id", "n_bytes", "size_good", "size_bad", "y").distinct().orderBy("doc_id").collect()
    if len({r["y"] for r in rows}) < 2:
        return Model(model.good, model.bad, (0.0, 1.0, 0.0))
    x = np.stack([features(r["n_bytes"], r["size_good"], r["size_bad"]) for r in rows])
    y = np.array([r["y"] for r in rows], dtype=float)
    total = sum(shares.values())
    weight = np.where(y == 1, shares[1] / total / (y == 1).sum(), shares[0] / total / (y == 0).sum()) * len(y)
    return Model(model.good, model.bad, tuple(fit_curve(x, y, weight)))


def measure(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, size_good, size_bad and score of every whole text; a map over the scan."""
    shared = docs.sparkSession.sparkContext.broadcast(model)           # two dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = []
            for i in range(len(texts)):
                t = texts[i].as_py()
                good, bad = scorer.sizes(t)
                out.append((len(t), good, bad, scorer.score(len(t), good, bad)))
            n, good, bad, score = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(good, pa.int64()), pa.array(bad, pa.int64()), pa.array(score, pa.float64())],
                names=["doc_id", "n_bytes", "size_good", "size_bad", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, size_good long, size_bad long, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept for testing: crc32 of the id as text is 2 modulo 4 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score reaches ``threshold``), learnt without held-out rows."""
    model = fit(docs, labels, ~held_out(), sample)
    return measure(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                       (F.col("score") >= threshold).cast("int").alias("predicted"), "size_good", "size_bad")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: Sample = Sample(),
              train: DataFrame | None = None) -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns, scored in the same pass;
    learnt from ``train`` (by default ``docs``)."""
    model = fit(docs if train is None else train, labels, ~held_out(), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(at)
            keep = []
            for i in range(len(texts)):
                t = (texts[i].as_py() or "").encode()
                keep.append(scorer.score(len(t), *scorer.sizes(t)) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
