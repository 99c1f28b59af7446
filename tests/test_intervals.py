import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from strandloom.functions import ranks as rk
from strandloom.functions.genome import interval_dist
from strandloom.operators import intervals as iv

GOLDEN = [("a", "a", 0, 1.0), ("a", "b", 11, 1 / 11), ("b", "a", 11, 1 / 11), ("b", "b", 0, 1.0), ("b", "c", 1, 1.0), ("c", "b", 1, 1.0),
          ("c", "c", 0, 1.0), ("d", "d", 0, 1.0), ("d", "e", 1, 1.0), ("e", "d", 1, 1.0), ("e", "e", 0, 1.0), ("f", "f", 0, 1.0)]


def test_window_graph_golden(bed):
    out = iv.window_graph(bed, bed, 15, lambda l, r, d: {"dist": F.abs(d), "weight": F.when(d == 0, 1.0).otherwise(1 / F.abs(d))})
    assert [(s, t, d, round(w, 9)) for s, t, d, w in rows(out, "source", "target", "dist", "weight")] == [(s, t, d, round(w, 9)) for s, t, d, w in GOLDEN]


def random_bed(spark, n, seed, longest):
    r = random.Random(seed)
    data = []
    for i in range(n):
        s = r.randrange(0, 5000)
        data.append((f"chr{r.randrange(2)}", s, s + r.choice([0, 1, 5, 60, 300, longest]), f"n{i % 40}", ".", "+"))
    return spark.createDataFrame(data, "chrom string, chromStart long, chromEnd long, name string, score string, strand string"), data


def brute(x, y, w):
    out = []
    for c, s, e, n, *_ in x:
        for d, t, f, m, *_ in y:
            if c == d and s - w < f and t < e + w:
                out.append((n, m))
    return sorted(out)


def test_window_graph_random_matches_brute_force(spark):
    for seed, w, hot in ((1, 0, 10**6), (2, 37, 10**6), (3, 400, 5)):
        a, da = random_bed(spark, 150, seed, 3000)
        b, db = random_bed(spark, 120, seed + 10, 4500)
        got = rows(iv.overlap_pairs(a, b, w, ["name"], ["name"], hot_rows=hot))
        assert got == brute(da, db, w)


def test_distance_and_overlap_rule_agree(spark):
    a, da = random_bed(spark, 60, 5, 100)
    out = iv.window_graph(a, a, 50)
    assert out.where(F.abs("dist") > 50).count() == 0
    assert interval_dist(F.lit(0), F.lit(5), F.lit(5), F.lit(9)) is not None


@pytest.mark.parametrize("limit", [0, 10**6])
def test_merge_random(spark, monkeypatch, limit):
    monkeypatch.setattr(rk, "SMALL_ROWS", limit)
    a, data = random_bed(spark, 200, 7, 20)
    want = []
    for chrom in ("chr0", "chr1"):
        cur = None
        for s, e in sorted((s, e) for c, s, e, *_ in data if c == chrom):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                if cur:
                    want.append((chrom, *cur))
                cur = [s, e]
        want.append((chrom, *cur))
    assert rows(iv.merge_intervals(a), "chrom", "chromStart", "chromEnd") == sorted(tuple(w) for w in want)


def test_blacklist(spark, bed):
    black = spark.createDataFrame([("chr1", 25, 35), ("chr2", 20, 30)], "chrom string, chromStart long, chromEnd long")
    assert rows(iv.drop_overlapping(bed, black, ids=["name"]), "name") == [("a",), ("d",), ("e",), ("f",)]
