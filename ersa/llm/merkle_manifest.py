"""A Merkle manifest of a dataset: an append log in postorder, with proofs.

Every document is a leaf.  The leaves of one tree (``by``, say the language) ascend by their id; while several
nodes remain, every two consecutive ones (the last alone, if the number is odd) become their digest.  The trees'
roots, ordered by name, are the leaves of a tree above them, whose root stands for the dataset.  A node's digest is the
SHA-256 (lower-case hex) of its children's digests as hex text.

*Log.*  Aligned builders take 2**BITS consecutive nodes each and write the subtree above them in completion order: a
node when its children are complete.  As builders are aligned, a node's place needs no index: ``position`` computes it from
the sizes of the subtrees completed before it, in a builder's page as in the log of the whole tree (``log``).  Builders of
the next layer take the roots of pages.  No page depends on the number of documents, and a tree of n leaves
has about log(n) / BITS layers.

*Proofs.*  A node's siblings are read from its page by their positions.  Pages hand the siblings of their root down
(``hand_down``), so a document meets its own page only, which brings all it needs up to the dataset's root.

Leaves get their numbers from a range partitioning with counts and offsets; no tree is one task.

Edge cases: nulls are told from empty values by the leaf's encoding; a null tree name is a tree of its own and comes first; null
ids come first in their tree; rows with one id are ordered by their leaf digest, so repeated rows are interchangeable; a tree of
one leaf has that leaf as its root, and a dataset of one tree that tree's root; no siblings give the digest of the empty
text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ersa.llm.common import store

#: A builder takes 2**BITS nodes.
BITS = 10
#: Leaves of one range partition while they are numbered.
RANGE_ROWS = 200_000


def hexdigest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- places in a log -----------------------------------------------------------------------

def steps(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` leaves."""
    return (n - 1).bit_length() if n > 1 else 0


def position(level: int, index: int, n: int) -> int:
    """The place, from 0, of a node in the postorder log of a tree with ``n`` leaves.

    Of the first k leaves, 2 k - popcount(k) complete nodes are made of whole pairs; nodes on the right
    edge that have fewer leaves than others of their level come last, level by level.
    """
    leaves = (index + 1) << level
    if leaves <= n:
        return 2 * (leaves - 1) - (leaves - 1).bit_count() + level
    whole_levels = (n & -n).bit_length()                 # levels whose last node is whole
    return 2 * n - n.bit_count() + level - whole_levels


def append_log(leaves: list[str], height: int) -> list[str]:
    """The digests of the subtree of ``height`` levels above ``leaves``, in completion order."""
    out, open_nodes = [], []                              # (level, digest) of nodes without a parent so far
    for leaf in leaves:
        level, digest = 0, leaf
        out.append(digest)
        while open_nodes and open_nodes[-1][0] == level and level < height:
            digest = hexdigest(open_nodes.pop()[1] + digest)
            level += 1
            out.append(digest)
        open_nodes.append((level, digest))
    level, digest = open_nodes.pop()
    while level < height:                                 # the right edge
        if open_nodes and open_nodes[-1][0] == level:
            digest = hexdigest(open_nodes.pop()[1] + digest)
        else:
            digest = hexdigest(digest)
        level += 1
        out.append(digest)
    return out


def siblings(nodes: list[str], m: int, height: int, index: int) -> list[tuple[bool, str | None]]:
    """Per level of a page, (whether the sibling is on the left, its digest or None)."""
    out = []
    for level in range(height):
        other = index ^ 1
        there = other << level < m
        out.append((bool(index & 1), nodes[position(level, other, m)] if there else None))
        index >>= 1
    return out


def write_path(path: list[tuple[bool, str | None]]) -> str:
    """A path as text: ``.`` without a sibling, ``<`` or ``>`` and the digest with one."""
    return "".join("." if s is None else ("<" if left else ">") + s for left, s in path)


def read_path(text: str) -> Iterator[tuple[bool, str | None]]:
    at = 0
    while at < len(text):
        if text[at] == ".":
            yield False, None
            at += 1
        else:
            yield text[at] == "<", text[at + 1:at + 65]
            at += 65


def fold(digest: str, path: list[tuple[bool, str | None]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, sibling in path:
        digest = hexdigest(digest if sibling is None else sibling + digest if left else digest + sibling)
    return digest


# ---- leaves --------------------------------------------------------------------------------

def leaf_digest(*fields: Column) -> Column:
    """The digest of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:``, its text."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` (tree, digest and the columns of ``order``) with rank (from 0) and n in their tree."""
    held = store(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    parts = held.count() // RANGE_ROWS + 1
    keys = ["tree", *[F.col(c).asc_nulls_first() for c in order], "digest", "row"]
    ranged = store(held.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("m"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0))) \
        .withColumn("n", F.sum("m").over(Window.partitionBy("tree"))).drop("m")
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*keys[1:])) - 1
    return store(ranged.join(offsets, ["tree", "part"]).withColumn("rank", inside + F.col("offset")).drop("part", "offset", "row"), "numbered")


# ---- builders ------------------------------------------------------------------------------

@dataclass
class Tree:
    """Layers of pages (tree, page, n, m, height, nodes), lowest first, and the roots (tree, digest)."""

    layers: list[DataFrame]
    roots: DataFrame
    bits: int


def build(leaves: DataFrame, bits: int) -> Tree:
    """The trees above numbered leaves (tree, rank, digest, n), by builders of 2**bits nodes."""
    layers, entries, layer = [], leaves.select("tree", "rank", "digest", "n"), 0
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0

    def builder(layer: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("rank")
            n, m = int(group["n"].iloc[0]), len(group)
            height = bits if n > 1 << (bits * (layer + 1)) else steps(m)      # all levels where the tree goes on above the page
            return pd.DataFrame({"tree": [group["tree"].iloc[0]], "page": [int(group["rank"].iloc[0]) >> bits], "n": [n], "m": [m],
                                 "height": [height], "nodes": ["".join(append_log(group["digest"].to_list(), height))]})
        return run

    while True:
        pages = store(entries.groupBy("tree", F.shiftright("rank", bits).alias("page"))
                      .applyInPandas(builder(layer), "tree string, page long, n long, m long, height int, nodes string"), "pages")
        layers.append(pages)
        if most <= 1 << (bits * (layer + 1)):
            break
        # trees that end on a lower layer pass their root on as a page of one node
        entries = pages.select("tree", F.col("page").alias("rank"), F.substring("nodes", -64, 64).alias("digest"), "n")
        layer += 1
    return Tree(layers, layers[-1].select("tree", F.substring("nodes", -64, 64).alias("digest")), bits)


def _nodes(text: str) -> list[str]:
    return [text[i:i + 64] for i in range(0, len(text), 64)]


def hand_down(pages: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """(tree, page, path, top) of the entries of ``pages``, given (tree, page, path, top) of the pages."""
    def run(page: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        out = {"tree": [], "page": [], "path": [], "top": []}
        for p in page.itertuples():
            nodes, path, top = _nodes(p.nodes), over["path"].iloc[0], over["top"].iloc[0]
            for i in range(p.m):
                out["tree"].append(p.tree)
                out["page"].append((p.page << bits) + i)
                out["path"].append(write_path(siblings(nodes, p.m, p.height, i)) + path)
                out["top"].append(top)
        return pd.DataFrame(out)
    return store(pages.groupBy("tree", "page").cogroup(above.groupBy("tree", "page"))
                 .applyInPandas(run, "tree string, page long, path string, top string"), "paths")


def page_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(tree, page, path, top) of the lowest pages, given (tree, path, top) of the trees."""
    own = F.col("tree").alias("tree")                     # an attribute of its own, as ``above`` may come from the pages
    paths = above.select(own, F.lit(0).cast("long").alias("page"), "path", "top")
    for pages in reversed(tree.layers[1:]):
        paths = hand_down(pages, paths, tree.bits)
    return paths


def log(tree: Tree) -> DataFrame:
    """(tree, position, level, index, digest) of every node, by its place in its tree's postorder log."""
    bits = tree.bits

    def rows_of(layer: int):
        def rows(group: pd.DataFrame) -> pd.DataFrame:
            out = []
            for p in group.itertuples():
                nodes = _nodes(p.nodes)
                for level in range(1 if layer else 0, p.height + 1):   # a page's lowest nodes are roots of the layer below
                    for i in range(-(-p.m >> level) if level else p.m):
                        high, index = level + layer * bits, (p.page << (bits - level)) + i
                        out.append((p.tree, position(high, index, p.n), high, index, nodes[position(level, i, p.m)]))
            return pd.DataFrame(out, columns=["tree", "position", "level", "index", "digest"])
        return rows

    schema = "tree string, position long, level int, index long, digest string"
    parts = [pages.groupBy("tree", "page").applyInPandas(rows_of(layer), schema) for layer, pages in enumerate(tree.layers)]
    return reduce(DataFrame.unionByName, parts)


# ---- the manifest --------------------------------------------------------------------------

def tree_name(column: Column) -> Column:
    """A name that sorts nulls first and is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


@dataclass
class Manifest:
    """Numbered leaves, the trees above them, the tree above the trees, and its root (None if empty)."""

    leaves: DataFrame
    trees: Tree
    top: Tree
    top_leaves: DataFrame
    root: str | None


def manifest(docs: DataFrame, fields: list[str], by: str, id_col: str, changed: dict[str, Column] | None = None,
             where: Column | None = None, bits: int = BITS) -> Manifest:
    """The manifest of ``docs``.  ``changed`` and ``where``: values to put in place of fields in some rows, to try proofs
    on leaves (column ``other``) that were tampered with."""
    names = {c: F.col(f"`{c}`") for c in fields}
    leaf = leaf_digest(*names.values())
    other = F.lit(None).cast("string") if where is None else F.when(where, leaf_digest(*({**names, **changed}).values()))
    rows = docs.select(tree_name(F.col(f"`{by}`")).alias("tree"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       leaf.alias("digest"), other.alias("other"))
    leaves = numbered(rows, ["doc_id"])
    trees = build(leaves, bits)
    top_leaves = numbered(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    top = build(top_leaves, bits)
    root = top.roots.first()                              # one row: a single tree
    return Manifest(leaves, trees, top, top_leaves, root["digest"] if root else None)


def prove(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every leaf."""
    root, bits = m.root or "", m.trees.bits
    over = hand_down(m.top.layers[0], page_paths(m.top, m.top.roots.select("tree", F.lit("").alias("path"), F.col("digest").alias("top"))), bits)
    of_trees = over.select(F.col("page").alias("rank"), "path").join(m.top_leaves.select("rank", F.col("name").alias("tree"), F.col("digest").alias("top")), "rank")
    pages = m.trees.layers[0].join(page_paths(m.trees, of_trees.select("tree", "path", "top")), ["tree", "page"])

    def run(group: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
        p = page.iloc[0]
        nodes, above = _nodes(p["nodes"]), list(read_path(p["path"]))
        proofs, folded = [], []
        for rank, digest, other in zip(group["rank"], group["digest"], group["other"]):
            path = siblings(nodes, int(p["m"]), int(p["height"]), int(rank) & ((1 << bits) - 1)) + above
            proofs.append(hexdigest("".join(s for _, s in path if s is not None)))
            folded.append(fold(other if isinstance(other, str) else digest, path))
        return pd.DataFrame({"doc_id": group["doc_id"].astype("Int64"), "leaf": group["digest"], "subroot": p["top"], "root": root, "proof_sha256": proofs,
                             "folded_root": folded, "verified": [f == root for f in folded]})

    by_page = m.leaves.withColumn("page", F.shiftright("rank", bits)).groupBy("tree", "page")
    return by_page.cogroup(pages.groupBy("tree", "page")).applyInPandas(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


DOCUMENT_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_proofs(docs: DataFrame, every: int = 7, bits: int = BITS) -> DataFrame:
    """Proofs of the documents, tried on leaves with n_chars + 1 where ``every`` divides the id's CRC-32."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(every)) == 0
    grown = F.col("n_chars").cast("decimal(20,0)") + 1
    return prove(manifest(docs, DOCUMENT_FIELDS, "lang", "doc_id", {"n_chars": grown}, hit, bits))


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_CRC = ("4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))")

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, sha256({' || '.join(_field(c) for c in DOCUMENT_FIELDS)}) AS leaf,
         CASE WHEN ({_CRC}) % 7 = 0 THEN sha256({' || '.join(_field('(n_chars::HUGEINT + 1)' if c == 'n_chars' else c) for c in DOCUMENT_FIELDS)}) END AS other
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, rank AS index, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT lang, level + 1, index // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY index)) FROM nodes WHERE n > 1 GROUP BY lang, level, index // 2),
subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, rank AS index, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, index // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY index)) FROM tops WHERE n > 1 GROUP BY level, index // 2),
folded AS (
  SELECT rid, lang, 0 AS level, rank AS index, n, '' AS proof, coalesce(other, leaf) AS digest FROM ranked
  UNION ALL
  SELECT rid, f.lang, f.level + 1, f.index // 2, (f.n + 1) // 2, proof || coalesce(s.digest, ''),
         sha256(CASE WHEN f.index % 2 = 1 THEN s.digest ELSE '' END || f.digest || CASE WHEN f.index % 2 = 0 THEN coalesce(s.digest, '') ELSE '' END)
  FROM folded f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.index = xor(f.index, 1) WHERE f.n > 1),
over AS (
  SELECT rid, 0 AS level, r.rank AS index, r.n, f.proof, f.digest FROM folded f JOIN subroots r ON r.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL
  SELECT rid, f.level + 1, f.index // 2, (f.n + 1) // 2, proof || coalesce(s.digest, ''),
         sha256(CASE WHEN f.index % 2 = 1 THEN s.digest ELSE '' END || f.digest || CASE WHEN f.index % 2 = 0 THEN coalesce(s.digest, '') ELSE '' END)
  FROM over f LEFT JOIN tops s ON s.level = f.level AND s.index = xor(f.index, 1) WHERE f.n > 1)
SELECT r.doc_id, r.leaf, u.digest AS subroot, t.digest AS root, sha256(o.proof) AS proof_sha256, o.digest AS folded_root, o.digest = t.digest AS verified
FROM ranked r JOIN over o ON o.rid = r.rid AND o.n = 1 JOIN subroots u ON u.lang IS NOT DISTINCT FROM r.lang JOIN tops t ON t.n = 1
"""
