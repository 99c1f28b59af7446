"""Suffix removal, whitening and prefix tries against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import suffix_dedup as sd
from strandloom.llm.prefix_trie import end_lists, prefix_trie
from strandloom.llm.whitening import count_above, leading, whitened

WS = r"[^\x20\x09-\x0D]+"


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in rng.integers(0, words, n))


# --- op11 -----------------------------------------------------------------------------------------------------------------------------

def brute_spans(rows, length=50):
    """rows: (doc_id, text); doc_id null sorts last and is smaller than nothing."""
    order = [(2 ** 63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in order:
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, b in order:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < d:
                gone[p:p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((None if d == 2 ** 63 - 1 else d, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def spans_of(df):
    out = sd.repeated_spans(df)
    got = out.select(F.col("row.doc_id").alias("d"), "n_bytes", sd.n_removed(F.col("spans")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("k")).collect()
    return sorted([tuple(r) for r in got], key=str)


def suffix_rows():
    a = prose(1, 120)
    line = "a very common line that is said in nearly every one of the documents here"
    rows = [(1, a), (2, a), (3, a[:200] + "!" + a[200:]), (4, None), (5, ""), (6, "short"), (7, "x" * 49), (8, "x" * 50), (9, "x" * 300), (10, "ab" * 200), (11, "ab" * 200 + "c"),
            (12, prose(2, 30) + line), (12, prose(2, 30) + line), (12, prose(3, 30)), (None, a), (None, prose(5, 40)), (None, prose(5, 40)), (-5, a[100:180]), (13, "é" * 60 + "ü" * 60), (14, "z" + "é" * 60),
            (15, "\x00" * 80), (16, "\x00" * 60 + "q"), (17, prose(2, 30)[:51]), (18, "".join(reversed(a)))]
    return rows + [(100 + k, prose(50 + k, 8 + k % 5) + line + prose(90 + k, 6)) for k in range(40)]


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, monkeypatch, small):
    """Also with batches, chunks and buckets so small that texts are cut, triggers are hot and answers cross batches."""
    if small:
        for name, value in (("BATCH_BYTES", 700), ("CHUNK_BYTES", 96), ("BUCKET_ENTRIES", 40), ("HOT_PHRASES", 3)):
            monkeypatch.setattr(sd, name, value)
    rows = suffix_rows()
    df = spark.createDataFrame([(d, t, "clash", d) for d, t in rows], "doc_id long, text string, batch string, row long").repartition(3)
    assert spans_of(df) == brute_spans(rows)


def test_suffix_dedup_random(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_PHRASES", 6)
    monkeypatch.setattr(sd, "BATCH_BYTES", 3000)
    rng = np.random.default_rng(5)
    pool = [prose(s, 25, 3000) for s in range(12)] + ["a" * 70, "ab" * 40]
    rows = [(int(rng.integers(0, 90)), " ".join(p[int(rng.integers(0, 40)):len(p) - int(rng.integers(0, 40))] for p in rng.choice(pool, int(rng.integers(1, 5))))) for _ in range(120)]
    assert spans_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute_spans(rows)


def test_suffix_dedup_bounds(spark):
    """A long text, an empty table, kept texts and columns that come back."""
    long = prose(7, 120_000, 5000)
    rows = [(1, long), (2, "head of its own " + long[1000:500_000]), (3, long[70_000:70_060])]
    got = {r[0]: r for r in spans_of(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1][2] == 0 and got[2][2] >= 499_000 and got[3][1] == got[3][2] == 60
    empty = spark.createDataFrame([], "doc_id long, text string, kept int")
    assert sd.repeated_spans(empty).count() == 0
    back = sd.without_repeats(spark.createDataFrame([(1, "a" * 60, 7), (2, "b" + "a" * 60 + "c", 8)], "doc_id long, text string, kept int"))
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a" * 60, 7), (2, "bc", 8)]
    with pytest.raises(ValueError):
        sd.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), window=10)


# --- op12 -----------------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_counts_and_leading_values(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for x in rng.uniform(values[0] - 1, values[-1] + 1, 20):
        assert count_above(a, x) == (values > x).sum()
    spd = a @ a
    found, vectors = leading(spd, 8)
    want = np.sort(np.linalg.eigvalsh(spd))[::-1][:8]
    assert np.allclose(found, want[:len(found)], rtol=1e-10, atol=1e-9 * want[0]) and len(found) == min(8, n)
    assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-10) and np.allclose(spd @ vectors.T, vectors.T * found, atol=1e-8 * want[0])


def test_leading_values_repeated_and_rank():
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((20, 20)))
    m = (q * np.array([9.0, 9.0, 9.0, 4.0, 4.0 - 1e-9] + [0.0] * 15)) @ q.T
    m = (m + m.T) / 2
    values, vectors = leading(m, 8)
    assert np.allclose(values, [9, 9, 9, 4, 4], atol=1e-8) and np.allclose(vectors @ vectors.T, np.eye(5), atol=1e-8)
    assert len(leading(np.zeros((4, 4)), 3)[0]) == 0


def test_whitening_against_dense_solver(spark):
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    rows = [(k, [float(c) for c in v], "clash") for k, v in enumerate(x)]
    bad = [(900, None, "n"), (901, [1.0] * 11 + [None], "n"), (902, [float("nan")] * 12, "n"), (903, [float("inf")] * 12, "n")]
    rows += [(3, rows[3][1], "again")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, whitened string").repartition(5)
    got = whitened(df).select("row.vec_id", "component", "n", "deviation", F.col("whitened").alias("w"), "explained", "identity_error").collect()
    ints = [[int(np.floor(1024 * float(c))) + 100_000 for c in r[1]] for r in rows]
    n, s = len(ints), [sum(c) for c in zip(*ints)]
    dense = np.array(ints, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(dense.T @ dense / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    want = dense @ vectors / np.sqrt(values)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and got[0]["identity_error"] < 1e-8
    exact = {k: sum((n * c - t) ** 2 for c, t in zip(v, s)) for (k, _, _), v in zip(rows, ints)}
    assert all(r["deviation"] == exact[r["vec_id"]] for r in got)
    for c in range(8):
        mine = np.array([r["w"] for r in sorted((r for r in got if r["component"] == c + 1), key=lambda r: (r["vec_id"], r["deviation"]))])
        theirs = want[np.argsort([r[0] for r in rows], kind="stable"), c]
        assert np.allclose(mine, theirs, atol=1e-7) or np.allclose(mine, -theirs, atol=1e-7)
        assert abs(next(r["explained"] for r in got if r["component"] == c + 1) - values[c] / (dense ** 2).sum() * n) < 1e-9


def test_whitening_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0])], schema)).select("component").distinct().count() == 1
    with pytest.raises(Exception, match="different lengths"):
        whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], schema)).count()


# --- op13 -----------------------------------------------------------------------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(WS, node[-1][1])) if node else 0
        totals[node] = ((0 if children[node] else 1) + sum(totals[k][0] for k in children[node]), (len(members[node]) - 1) * words + sum(totals[k][1] for k in children[node]))
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("band", [1, 3, 32])
def test_prefix_trie(spark, band):
    rng = np.random.default_rng(2)
    rows = [(int(c), t, "user" if t % 2 == 0 else None, f"turn {int(rng.integers(0, 2))} of \t {t}") for c in range(0, 90) if c % 20 not in (0,) or c in (0, 40) for t in range(int(rng.integers(1, 7)))]
    rows += [(c, t, "user", f"long {t}") for c in (200, 201, 207) for t in range(70)] + [(c, 0, "system", "same hello") for c in range(300, 340)]
    rows += [(5, None, "user", None), (5, None, "user", None), (6, 1, "a", ""), (None, 1, "user", "nobody"), (-7, 0, "user", "minus"), (-7, 0, "user", "tie"), (-3, 0, "user", "minus")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, k1 string, at int").repartition(4)
    got = prefix_trie(df, band)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == brute_trie(rows)


def test_prefix_trie_empty(spark):
    assert prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_end_lists_in_pieces(spark):
    ids = [-9, -1, 0, 3, 4, 5, 8, 90, 1000]
    df = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 7)], "k1 long, k2 long, conv_id long")
    want = {(1, 2): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (1, 3): hashlib.sha256(b"7").hexdigest()}
    assert {(r[0], r[1]): r[2] for r in end_lists(df, id_bits=2).collect()} == want
