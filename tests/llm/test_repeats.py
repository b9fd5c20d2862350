"""Byte and word repeat removal against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ersa.llm import queries, repeats, substring_dedup, suffix_dedup

LARGE = 2**63 - 1


def digest(mask, symbols, join):
    runs = int((np.diff(np.concatenate(([0], mask.astype(int), [0]))) == 1).sum())
    kept = join([s for s, m in zip(symbols, mask) if not m])
    return len(symbols), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()


def brute_bytes(rows, length=50):
    first, out = {}, []
    rows = [(LARGE if i is None else i, i, (t or "").encode()) for i, t in rows]
    for k, _, b in rows:
        for s in range(len(b) - length + 1):
            first[b[s:s + length]] = min(k, first.get(b[s:s + length], k))
    for k, i, b in rows:
        mask = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < k:
                mask[s:s + length] = True
        out.append((i, *digest(mask, [b[j:j + 1] for j in range(len(b))], b"".join)))
    return sorted(out, key=repr)


def brute_words(rows, window=20):
    rows = [(LARGE if i is None else i, n, i, (t or "").encode().split()) for n, (i, t) in enumerate(rows)]
    first, here, out = {}, {}, []
    for k, n, _, w in rows:
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            first[key] = min(k, first.get(key, k))
            here.setdefault((n, key), s)
    for k, n, i, w in rows:
        mask = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            key = tuple(w[s:s + window])
            if first[key] < k or here[n, key] < s:
                mask[s:s + window] = True
        a, b, _, d = digest(mask, w, b" ".join)
        out.append((i, a, b, d))
    return sorted(out, key=repr)


def got_bytes(df):
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")), F.size("removed"), F.sha2("kept", 256)).collect()), key=repr)


def got_words(df):
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(df).select(
        "doc_id", "n_words", lost, F.sha2(F.col("kept").cast("binary"), 256)).collect()), key=repr)


def passages(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "the", "of", "xx", "yyy", "é"]
    parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(15, 60))) for _ in range(12)]
    rows = []
    for i in range(200):
        p = []
        for _ in range(rnd.randint(0, 5)):
            q = rnd.choice(parts).split()
            if rnd.random() < 0.6:
                q[rnd.randrange(len(q))] = f"zz{rnd.randrange(50)}"
            p += q + [str(rnd.randrange(10**6)) for _ in range(rnd.choice([0, 0, 30]))]
        rows.append((i * 3 + rnd.randint(0, 2), rnd.choice([" ", "\n", "  "]).join(p) if i % 17 else rnd.choice([None, "", "a " * 400, "x" * 300])))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_random_passages(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(repeats, "HOT_BLOCKS", 2 + 30 * seed)
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_bytes(df) == brute_bytes(rows)
    assert got_words(df) == brute_words(rows)


def test_awkward_rows(awkward, empty):
    from tests.llm.conftest import awkward_rows
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert got_bytes(awkward) == brute_bytes(rows)
    assert got_words(awkward) == brute_words(rows)
    assert got_bytes(empty) == [] and got_words(empty) == []


@pytest.mark.parametrize("window", [14, 25, 50, 77])
def test_one_difference_at_any_place_of_a_long_window(spark, window):
    rnd = random.Random(window)
    rows = []
    for k in range(3):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(window)]
        rows.append((len(rows), " ".join(words)))
        for i in range(window):
            rows.append((len(rows), " ".join([*words[:i], "other", *words[i + 1:]])))
        rows.append((len(rows), " ".join(["before", *words, "behind"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    got = substring_dedup.remove_repeats(df, window).select("doc_id", "n_words", lost, F.sha2(F.col("kept").cast("binary"), 256))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_words(rows, window)


@pytest.mark.parametrize("length", [46, 73, 130])
def test_one_different_byte_at_any_place_of_a_long_string(spark, length):
    rnd = random.Random(length)
    base = "".join(rnd.choice("abcdefgh") for _ in range(length))
    rows = [(0, base)] + [(1 + i, base[:i] + "#" + base[i + 1:]) for i in range(length)] + [(500, "x" + base + "y"), (501, base[1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, length).select("doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("removed"), F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_bytes(rows, length)


def test_prefix_groups_split_until_they_fit():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (500, 20)).astype(np.uint64)
    rows[:200] = 7
    parts = list(substring_dedup.prefix_groups(rows, limit=20))
    assert sorted(np.concatenate(parts).tolist()) == list(range(500))
    assert all(len(p) <= 20 or (rows[p] == rows[p[0]]).all() for p in parts)
    nodes = [n for n in substring_dedup.deep_nodes(np.repeat(rows[200:300], 2, axis=0), 20)]
    assert nodes and all((np.repeat(rows[200:300], 2, axis=0)[n] == np.repeat(rows[200:300], 2, axis=0)[n[0]]).all() for n in nodes)


def test_documents_keep_columns_and_white_space(spark, clashing):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"{text}\n\nnew line", 9), (2, f"before\t{text} after\nlast", 9), (3, None, None), (4, text, 9)],
                               "doc_id long, text string, n_chars int")
    out = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.dedup_documents(df).collect()}
    first = f"{text}\n\nnew line"
    assert out[1][0] == first and out[2] == ("before\tafter\nlast", 17) and out[3] == (None, None) and out[4] == ("", 0)
    kept = substring_dedup.dedup_documents(clashing)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


def test_registered_queries_on_a_fixture(spark, tmp_path):
    rows = passages(5)[:80]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    one = queries.queries()["op1_suffix_dedup"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in one.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) == brute_bytes(rows)
    three = queries.queries()["op3_substring_dedup"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in three.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute_words(rows)


def literal_sync_points(shape, grams, first):
    sync = set()
    for a, b in zip(first[:-1], first[1:]):
        for s in range(a, b - shape.window + 1):
            inside = grams[s:s + shape.span + 1]
            sync |= {s + int(i) for i in np.flatnonzero(inside == inside.min())}
    return sorted(sync)


@pytest.mark.parametrize("chunk", [1, 7, 40, 1 << 14])
def test_names_and_sync_points_do_not_depend_on_the_chunk(monkeypatch, chunk):
    rng = np.random.default_rng(3)
    first = np.cumsum([0, 0, 49, 50, 51, 300, 1, 120, 0])
    buf = rng.integers(97, 99, first[-1]).astype(np.uint8)
    whole = suffix_dedup.byte_grams(buf)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    grams = suffix_dedup.byte_grams(buf)
    assert (grams == whole).all()
    names = {}
    for i in range(len(buf) - 23):
        assert names.setdefault(buf[i:i + 24].tobytes(), grams[i]) == grams[i]
    assert len(set(names.values())) == len(names)
    shape = repeats.Shape(50, 24, False)
    for some in (grams, grams % np.uint64(5)):                       # ties within windows, and the name 1 as the least
        some = some + np.uint64(1)
        q = repeats.Sequences(shape, some, first, np.arange(len(first) - 1))
        assert q.sync.tolist() == literal_sync_points(shape, some, first)
        starts = [s for a, b in zip(first[:-1], first[1:]) for s in range(a, b - 49)]
        assert q.windows_at(np.arange(len(q.sync))).tolist() == starts


def test_the_work_arrays_of_a_block_stay_small():
    buf = np.random.default_rng(4).integers(0, 255, 1 << 20).astype(np.uint8)
    suffix_dedup.byte_grams(buf[:100])
    tracemalloc.start()
    grams = suffix_dedup.byte_grams(buf)
    names = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    repeats.Sequences(repeats.Shape(50, 24, False), grams, np.array([0, len(buf)]), np.array([1]))
    points = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names < 12 * len(buf) and points < 32 * len(buf)          # names alone: 8 bytes a position


def test_equal_pairs_stand_together(monkeypatch):
    rng = np.random.default_rng(5)
    one, two = rng.integers(0, 6, 500).astype(np.uint64), rng.integers(0, 4, 500).astype(np.uint64)
    docs, rows = np.sort(rng.integers(0, 9, 500)), np.sort(rng.integers(0, 40, 500))
    keys = list(zip(one.tolist(), two.tolist()))
    smaller = [any(k == keys[i] and docs[j] < docs[i] for j, k in enumerate(keys)) for i in range(500)]
    here = [any(keys[j] == keys[i] and rows[j] == rows[i] for j in range(i)) for i in range(500)]
    for name in (repeats.pair_name, lambda a, b: a % np.uint64(2)):  # also where different pairs get one name
        monkeypatch.setattr(repeats, "pair_name", name)
        order, starts = repeats.pair_order(one, two)
        assert len(starts) == len(set(keys)) == len({keys[i] for i in order[starts]})
        assert repeats.earlier((one, two), docs, rows, False).tolist() == smaller
        assert repeats.earlier((one, two), docs, rows, True).tolist() == [a or b for a, b in zip(smaller, here)]


def test_painted_spans():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 40):
        begin = np.sort(rng.integers(0, 60, n))
        end = np.maximum.accumulate(begin + rng.integers(1, 9, n))
        mask = np.zeros(70, dtype=bool)
        for a, b in zip(begin, end):
            mask[a:b] = True
        assert (repeats.painted(70, begin, end) == mask).all()
