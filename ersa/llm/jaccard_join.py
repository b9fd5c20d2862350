"""N-gram Jaccard join over count vectors.

A document's tokens are its distinct ``gram``-word shingles.  Tokens are hashed into groups.  A
document's counts per group are a point; the overlap of two documents is at most the sum of the
coordinate minima of their points, so points (and boxes around points) whose minima are too small
cannot link.  Surviving pairs are verified on the token sets.

*Routing.*  Points are compared only where a link is possible.  A class holds the pairs whose larger set has a size
in a certain range; it deals tokens into groups, and two sets that link can differ in d groups at most, where d
follows from the sizes.  So of any d + 1 groups of a set one agrees in whole with the other set's, and it is enough
that each sends its d + 1 groups that come first in one order of group contents (most tokens first): the set whose last sent
group comes earlier finds an agreeing group among what the other has sent.  The contents of these groups are the keys under
which documents meet.  They are never empty and hold several tokens (a set with too few filled groups, as may happen to a
few tokens, sends single tokens, its prefix in the order of their hashes).  So no link is missed, documents that
have nothing in common do not meet, and a passage that a third of all documents share does not bring them together.

*Search.*  The points under a key form leaves of bounded size, ordered by size and coordinates, with
a box (the coordinate maxima and the smallest size) each: an R-tree of one level under the key.  Pairs
of leaves whose boxes allow a link are searched, point against point, by summed minima.

*Two rounds.*  First every point is compared with the smallest document under its key; verified
links give provisional components.  Only pairs across components are then searched, so a large
group of near copies is not expanded into its pairs.

The result is exact for 64-bit names of shingles.

Edge cases: a null text, or one without words, has no tokens and links with nothing; fewer words
than ``gram`` are one token; equal token sets always link; rows that share a doc_id are one node; a
null doc_id is its own component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ersa.llm.common import U64, doc_words, id_text, mix, pair_name, spark_salt, store
from ersa.llm.components import components
from ersa.llm.repeats import deal, group_starts, unpack

PIECE_BYTES = 2 << 20
DIMENSIONS = 128
LEAF = 512
#: Points of small keys that one group searches.
SEARCH_ROWS = 50_000
#: Pairs whose points are held against each other at once.
PAIRS_AT_ONCE = 8_000
#: Leaves of one size range under a key that are cut in one task.
LEAVES_AT_ONCE = 64
#: Tokens of the partners that meet one document's set in one row.
PARTNER_TOKENS = 200_000
#: Documents of one piece under one key from which the key is known to be shared and goes around its bucket.
HOT_IN_PIECE = 8


# ---- token sets ----------------------------------------------------------------------------

def token_sets(texts: list[bytes], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of many texts, sorted within each, and where each text's begin (n + 1)."""
    _, _, _, names, first = doc_words(texts, lower=True)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n)
    if len(names):
        out = np.full(len(names), U64(gram))
        padded = np.concatenate([names, np.zeros(gram, dtype=np.uint64)])
        left = np.repeat(first[1:], n) - np.arange(len(names))
        length = np.minimum(left, gram)
        for i in range(gram):                        # words past the text's end do not enter the name
            out = np.where(i < length, pair_name(out, padded[i:i + len(names)], i + 1), out)
        keep = (left >= gram) | ((n < gram)[doc] & (np.arange(len(names)) == first[:-1][doc]))
        names, doc = out[keep], doc[keep]
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    names, doc = names[new], doc[new]
    return names, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_names(tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each token set (0 for an empty one)."""
    out = []
    for salt in (3, 5):
        value = mix(tokens + U64(salt) * U64(0x9E3779B97F4A7C15))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value, dtype=np.uint64)])
        out.append(total[begin[1:]] - total[begin[:-1]])
    return out[0], out[1]


def count_vectors(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    group = (mix(tokens + U64(77)) % U64(DIMENSIONS)).astype(np.int64)
    return np.bincount(doc * DIMENSIONS + group, minlength=(len(begin) - 1) * DIMENSIONS).reshape(-1, DIMENSIONS)


# ---- keys ----------------------------------------------------------------------------------

#: Classes that a document sends keys for, beside its own: linked sizes n and 100 n / percent lie this many classes apart.
STEPS = 2


@cache
def size_classes(percent: int, limit: int = 1 << 40) -> np.ndarray:
    """Upper sizes of the classes of larger sets."""
    ratio, out = (100 / percent) ** (1 / STEPS), [0]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out, dtype=np.int64)


def class_groups(upper: np.ndarray, percent: int) -> np.ndarray:
    """Groups that a class deals tokens into: a few more than the tokens that its sets can differ in.

    Fewer groups hold more tokens each, so unrelated documents with a passage in common rarely have a group without
    tokens of their own; with more groups, those that are sent could be chosen better."""
    differ = 2 * upper * (100 - percent) // (100 + percent)
    return differ + differ * 15 // 100 + 2


def _first_of(doc: np.ndarray, order: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of ``order`` (sorted by document), the first ``most[d]`` entries of each document d."""
    sorted_doc = doc[order]
    starts = group_starts(sorted_doc)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[nth < most[sorted_doc]]


def group_keys(tokens: np.ndarray, begin: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, document index) of all groups that route documents (see the module's text)."""
    size = np.diff(begin)
    uppers = size_classes(percent)
    own = np.searchsorted(uppers, size)
    most = size * 100 // percent                       # the largest set that can link
    doc_of = np.repeat(np.arange(len(size)), size)
    where, value = mix(tokens + U64(1234567)), mix(tokens + U64(7654321))
    keys, docs = [], []
    shift = 0
    while True:
        sends = (size > 0) & (uppers[np.maximum(own + shift - 1, 0)] < most) | ((shift == 0) & (size > 0))
        if not sends.any():
            break
        upper = np.where(sends, uppers[own + shift], 1)
        # tokens that the set and one that it may link with in this class can differ in; none: only equal sets link
        differ = (size + np.minimum(upper, most)) * (100 - percent) // (100 + percent)
        sends &= differ > 0
        groups = class_groups(upper, percent)
        take = np.flatnonzero(sends[doc_of])
        d = doc_of[take]
        offset = np.concatenate(([0], np.cumsum(np.where(sends, groups, 0))))
        slot = offset[:-1][d] + (where[take] % groups[d].astype(np.uint64)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        starts = group_starts(slot[order])
        used = slot[order][starts]
        count = np.diff(np.append(starts, len(slot)))
        total = np.add.reduceat(value[take][order], starts) if len(starts) else np.zeros(0, dtype=np.uint64)
        doc = np.searchsorted(offset, used, side="right") - 1
        salt = (own[doc] + shift).astype(np.uint64) * U64(1 << 40) + (used - offset[doc]).astype(np.uint64)
        name = pair_name(total + count.astype(np.uint64), salt)
        pick = _first_of(doc, np.lexsort((name, -count, doc)), differ + 1)
        keys.append(name[pick])
        docs.append(doc[pick])
        # too few filled groups: sets of this kind meet under a token that both have in their prefix
        few = sends & (np.bincount(doc, minlength=len(size)) <= differ)
        if few.any():
            t = take[few[d]]
            pick = _first_of(doc_of, t[np.lexsort((where[t], doc_of[t]))], size - -(-size * percent // 100) + 1)
            keys.append(pair_name(where[pick], (own[doc_of[pick]] + shift).astype(np.uint64) + U64(1 << 62)))
            docs.append(doc_of[pick])
        shift += 1
    return (np.concatenate(keys), np.concatenate(docs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """(doc ids, texts) of a batch, about PIECE_BYTES at a time."""
    column, ids, texts, held = batch.column(1), [], [], 0
    for i, d in enumerate(batch.column(0).to_pylist()):
        t = column[i].as_py().encode()
        if texts and held + len(t) > PIECE_BYTES:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(d)
        texts.append(t)
        held += len(t)
    if texts:
        yield ids, texts


def shapes(docs: DataFrame, gram: int) -> DataFrame:
    """doc_id, n, two set names and the count vector of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _pieces(batch):
                tokens, begin = token_sets(texts, gram)
                one, two = set_names(tokens, begin)
                vectors = encode_counts(count_vectors(tokens, begin))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.diff(begin), pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.array(vectors, pa.binary())], names=["doc_id", "n", "s1", "s2", "counts"])
    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, counts binary")


def shared_keys(docs: DataFrame, gram: int, percent: int, buckets: int) -> DataFrame:
    """(key, doc_id) of every key that two documents have.

    A piece sends its keys to buckets; a key that many of its documents have is shared anyway: one of
    them stands for it in its bucket, and the others go to buckets of their own choice.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _pieces(batch):
                tokens, begin = token_sets(texts, gram)
                one, two = set_names(tokens, begin)
                ids = np.array([-1 if i is None else i for i in ids], dtype=np.int64)
                order = np.lexsort((ids, two, one))           # of equal sets, the smallest id speaks
                new = np.ones(len(order), dtype=bool)
                new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                speaks = np.zeros(len(ids), dtype=bool)
                speaks[order[new]] = True
                key, doc = group_keys(tokens, begin, percent)
                ok = speaks[doc]
                key, doc = key[ok], ids[doc[ok]]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                starts = group_starts(key)
                size = np.diff(np.append(starts, len(key)))
                hot = np.repeat(size >= HOT_IN_PIECE, size)
                head = np.zeros(len(key), dtype=bool)
                head[starts] = True
                rows = deal(0, buckets, key[~hot | head], doc[~hot | head], hot[~hot | head].astype(np.uint8))
                rest = hot & ~head
                if rest.any():
                    spread = pair_name(key[rest], doc[rest].astype(np.uint64))
                    rows += deal(1, buckets, spread, key[rest], doc[rest])
                bucket, kind, data = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int64()), pa.array(data, pa.binary())],
                                                 names=["bucket", "kind", "data"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        keys, docs = [], []
        around = [unpack(b, "<u8", "<u8", "<i8") for b in group.loc[group["kind"] == 1, "data"]]
        if around:
            keys += [p[1] for p in around]
            docs += [p[2] for p in around]
        parts = [unpack(b, "<u8", "<i8", "u1") for b in group.loc[group["kind"] == 0, "data"]]
        if parts:
            key, doc, hot = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(key, kind="stable")
            key, doc, hot = key[order], doc[order], hot[order]
            starts = group_starts(key)
            size = np.diff(np.append(starts, len(key)))
            shared = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | (np.maximum.reduceat(hot, starts) > 0)
            shared = np.repeat(shared, size)
            keys.append(key[shared])
            docs.append(doc[shared])
        if not keys:
            return pd.DataFrame({"key": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64)})
        return pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "doc_id": np.concatenate(docs)})

    return docs.mapInArrow(send, "bucket long, kind long, data binary").groupBy("bucket").applyInPandas(meet, "key long, doc_id long")


# ---- search --------------------------------------------------------------------------------

def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with which sets of these sizes link: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def bounded_pairs(left: tuple, right: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two leaves (sizes, points, components) whose summed minima allow a link."""
    (n, x, c), (m, y, d) = left, right
    out_i, out_j = [], []
    for i in range(len(n)):
        ok = np.flatnonzero((d != c[i]) & (100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])))
        if len(ok):
            ok = ok[overlap_bound(y[ok], x[i]) >= needed(n[i], m[ok], percent)]
            out_i.append(np.full(len(ok), i))
            out_j.append(ok)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


_WIDTHS = {1: "u1", 2: "<u2", 4: "<u4"}


def encode_counts(vectors: np.ndarray) -> list[bytes]:
    """Count vectors in the narrowest of 1, 2 or 4 bytes a count that holds them exactly."""
    most = vectors.max(axis=1, initial=0)
    one, two, four = vectors.astype("u1"), vectors.astype("<u2"), vectors.astype("<u4")
    return [(one if m < 1 << 8 else two if m < 1 << 16 else four)[i].tobytes() for i, m in enumerate(most)]


def decode_counts(blobs) -> np.ndarray:
    """The vectors, in the narrowest type that holds them all."""
    sizes = np.array([len(b) // DIMENSIONS for b in blobs], dtype=np.int64)
    out = np.zeros((len(blobs), DIMENSIONS), dtype=_WIDTHS.get(int(sizes.max(initial=1)), "<u4"))
    for width, kind in _WIDTHS.items():
        at = np.flatnonzero(sizes == width)
        if len(at):
            out[at] = np.frombuffer(b"".join([blobs[i] for i in at]), dtype=kind).reshape(-1, DIMENSIONS)
    return out


def overlap_bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of points, row by row."""
    return np.minimum(x, y).sum(axis=1, dtype=np.int64)


def _points(table: pd.DataFrame) -> tuple:
    return table["n"].to_numpy(), decode_counts(table["counts"].to_list()), table["c"].to_numpy()


def pairs_under_keys(key: np.ndarray, ids: np.ndarray, points: tuple, percent: int, step: int = PAIRS_AT_ONCE) -> np.ndarray:
    """Distinct id pairs (smaller first) under a common key that the bounds allow, for many small keys at once."""
    n, x, c = points
    order = np.lexsort((ids, key))
    key, ids, n, x, c = key[order], ids[order], n[order], x[order], c[order]
    starts = group_starts(key)
    size = np.diff(np.append(starts, len(key)))
    later = np.repeat(starts + size, size) - np.arange(len(key)) - 1            # rows of the key behind each row
    found, a = [np.zeros((0, 2), dtype=np.int64)], 0
    ends = np.cumsum(later)
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, side="right")))
        i = np.repeat(np.arange(a, b), later[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
        ok = (c[i] != c[j]) & (ids[i] != ids[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        ok = overlap_bound(x[i], x[j]) >= needed(n[i], n[j], percent)
        if ok.any():
            found.append(np.unique(np.stack([ids[i][ok], ids[j][ok]], axis=1), axis=0))
        a = b
    return np.unique(np.concatenate(found), axis=0)


def cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of documents under a common key, of different components, whose minima allow a link.

    ``members``: key, leader (the key's smallest document), doc_id, n, counts, c.  A key of at most LEAF points is one leaf; many such keys are
    searched together.  Leaves under a larger key hold about LEAF points, by size; pairs of leaves are
    formed on their boxes, and a pair of leaves is one group, so no key is one task.
    """
    spread = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo != hi")
    held = store(members.join(spread.select("key", "m"), "key"), "held")
    small = held.where(F.col("m") <= LEAF)
    groups = max(1, small.count() // SEARCH_ROWS)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs_under_keys(group["key"].to_numpy(), group["doc_id"].to_numpy(), _points(group), percent)
        return pd.DataFrame(pairs, columns=["a", "b"])

    # keys of one leader mostly have the same documents: searched together, their pairs come out once
    pairs = small.groupBy(spark_salt("leader", n=groups).alias("group")).applyInPandas(search, "a long, b long")
    large = held.where(F.col("m") > LEAF)
    # leaves: the key's points dealt to blocks by size range, and within a range that many share by id; each block cut into
    # runs of LEAF points
    ranged = large.withColumn("salt", F.floor(F.log2(F.col("n")) * 8).cast("int"))
    blocks = ranged.groupBy("key", "salt").agg(F.ceil(F.count("*") / (LEAF * LEAVES_AT_ONCE)).alias("blocks"))
    cut = ranged.join(blocks, ["key", "salt"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    order = Window.partitionBy("key", "salt", "block").orderBy("n", "counts", "doc_id")
    within = F.floor((F.row_number().over(order) - 1) / LEAF)
    leaves = store(cut.withColumn("leaf", F.col("block") * (1 << 32) + within).drop("block", "blocks"), "leaves")
    if leaves.isEmpty():
        return pairs.distinct()

    def box(group: pd.DataFrame) -> pd.DataFrame:
        n, x, _ = _points(group)
        return pd.DataFrame({"key": [int(group["key"].iloc[0])], "salt": [int(group["salt"].iloc[0])], "leaf": [int(group["leaf"].iloc[0])],
                             "least": [int(n.min())], "most": [int(n.max())], "corner": encode_counts(x.max(axis=0, keepdims=True))})

    boxes = leaves.groupBy("key", "salt", "leaf").applyInPandas(box, "key long, salt int, leaf long, least long, most long, corner binary")
    boxes = store(boxes, "boxes")
    left = boxes.select("key", *[F.col(c).alias("l_" + c) for c in ("salt", "leaf", "least", "most", "corner")])
    near = boxes.join(left, "key").where(
        (F.struct("l_salt", "l_leaf") <= F.struct("salt", "leaf")) & (F.col("most") * 100 >= F.col("l_least") * percent)
        & (F.col("l_most") * 100 >= F.col("least") * percent))

    def allow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            x, y = decode_counts(t["corner"].to_list()), decode_counts(t["l_corner"].to_list())
            ok = overlap_bound(x, y) >= needed(t["least"].to_numpy(), t["l_least"].to_numpy(), percent)
            yield t.loc[ok, ["key", "l_salt", "l_leaf", "salt", "leaf"]]

    pairs_of = near.mapInPandas(allow, "key long, l_salt int, l_leaf long, salt int, leaf long") \
        .withColumn("pair", F.xxhash64("key", "l_salt", "l_leaf", "salt", "leaf"))
    side = leaves.select("key", "salt", "leaf", "doc_id", "n", "counts", "c")
    a = pairs_of.select("pair", "key", F.col("l_salt").alias("salt"), F.col("l_leaf").alias("leaf")).join(side, ["key", "salt", "leaf"])
    b = pairs_of.select("pair", "key", "salt", "leaf").join(side, ["key", "salt", "leaf"])
    b = b.select(*[F.col(c).alias(c) for c in ("pair", "doc_id", "n", "counts", "c")])       # attributes of its own

    def search_two(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        i, j = bounded_pairs(_points(x), _points(y), percent)
        u, v = x["doc_id"].to_numpy()[i], y["doc_id"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    more = a.groupBy("pair").cogroup(b.groupBy("pair")).applyInPandas(search_two, "a long, b long")
    return pairs.unionByName(more).where("a != b").distinct()


# ---- verification --------------------------------------------------------------------------

def verify(pairs: DataFrame, docs: DataFrame, gram: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose token sets link, with their overlap and sizes."""
    asked = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _pieces(batch):
                names, begin = token_sets(texts, gram)
                sets = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(names.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), sets], names=["doc_id", "tokens"])

    sets = store(docs.join(asked, "doc_id", "left_semi").mapInArrow(tokens, "doc_id long, tokens array<long>"), "sets")
    # a document's set goes once to each row of partners, however many partners it has
    partners = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    rows = partners.groupBy("a").agg(F.ceil((F.sum(F.size("y")) + F.count("*")) / PARTNER_TOKENS).alias("rows"))
    dealt = partners.join(rows, "a").groupBy("a", F.pmod(F.xxhash64("b"), F.col("rows")).alias("row")) \
        .agg(F.collect_list(F.struct("b", "y")).alias("partners"))
    one = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    overlap = F.transform("partners", lambda p: F.struct(p["b"].alias("b"), F.size(p["y"]).alias("nb"), F.size(F.array_intersect(F.col("x"), p["y"])).alias("o")))
    counted = dealt.join(one, "a").select("a", F.size("x").alias("na"), F.explode(overlap).alias("p")).select("a", "p.b", "na", "p.nb", "p.o")
    return counted.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o")))


def jaccard_components(docs: DataFrame, gram: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included)."""
    rows = id_text(docs, id_col, text_col)
    known = rows.where("doc_id IS NOT NULL")
    sets = store(shapes(rows, gram), "shapes")
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    in_class = store(sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "s1", "s2").join(classes, ["s1", "s2"])
                     .select("doc_id", "rep").distinct(), "classes")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    buckets = max(64, total // (16 << 20))
    # equal sets are one point, the one with the smallest id
    keys = shared_keys(known, gram, percent, buckets).join(in_class, "doc_id").select("key", F.col("rep").alias("doc_id")).distinct()
    points = sets.where("n > 0").join(in_class.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi") \
        .select("doc_id", "n", "counts").distinct()
    crowd = keys.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("most")).where("leader != most").select("key", "leader")
    members = store(keys.join(crowd, "key"), "members")
    # round one: every point against the smallest under its key
    stars = members.where("doc_id != leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = store(verify(_bounded(stars, points, percent), known, gram, percent).select("a", "b"), "links")
    first = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # round two: across components only
    labelled = members.join(first.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left") \
        .withColumn("c", F.coalesce("component", "doc_id")).drop("component").join(points, "doc_id")
    tried = store(cross_pairs(labelled, percent).join(stars, ["a", "b"], "left_anti"), "pairs")
    more = store(verify(tried, known, gram, percent).select("a", "b"), "links")
    # rows that share a doc_id but not a token set join their classes
    shared_ids = in_class.join(in_class.groupBy("doc_id").count().where("count > 1").select("doc_id"), "doc_id", "left_semi") \
        .select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    edges = links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(shared_ids)
    final = components(edges)
    rep_of = in_class.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    return (sets.select("doc_id", F.col("n").alias("n_shingles")).join(rep_of, "doc_id", "left")
            .join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")))


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and summed minima allow a link."""
    p = points.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("x"))
    q = points.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("y"))
    near = pairs.join(p, "a").join(q, "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (decode_counts(batch.column(c).to_pylist()) for c in ("x", "y"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = overlap_bound(x, y) >= needed(na, nb, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return near.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long").distinct()
