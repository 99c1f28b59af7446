"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

WS = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" + ("." if k % 9 == 8 else "") for k, x in enumerate(rng.integers(0, words, n)))


@pytest.fixture(scope="module")
def docs(spark):
    a = prose(1, 300)
    b = a.split(" ")
    near = " ".join(b[:150] + ["changed"] + b[151:])
    rows = [(1, a, "x"), (2, a, "y"), (3, near, None), (4, None, "x"), (5, "", "x"), (6, "one", "y"), (7, "two words", "z"), (8, prose(2, 60), "z"), (8, prose(2, 60), "z"),
            (9, prose(3, 40_000, 5000), "x"), (10, " \t\n ", "y"), (None, prose(4, 50), None), (11, "É ü  ñ\x1c ß " * 30, "x"), (12, prose(8, 100) + "\n" + prose(8, 100), "y")]
    return spark.createDataFrame([(d, t, "xx", s, len(t) if t else 0, 0, "clash") for d, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, start long, _n string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def collected(df):
    return [r.asDict() for r in df.collect()]


def brute_fingerprint(text):
    w = re.findall(WS, (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark, docs, empty):
    from strandloom.llm.simhash import deduplicated, near_duplicates

    rows = collected(docs)
    prints = [brute_fingerprint(r["text"]) for r in rows]
    roots = linked(prints)
    first = {x: min((r["doc_id"] for r, y in zip(rows, roots, strict=True) if x == y and r["doc_id"] is not None), default=None) for x in roots}
    want = Counter((r["doc_id"], f"{p:016x}", first[x]) for r, p, x in zip(rows, prints, roots, strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    assert got == want
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(first[x] for x in set(roots))
    assert near_duplicates(empty).count() == 0 and deduplicated(empty).count() == 0


def test_dense_links(spark):
    """Thousands of fingerprints a few bits from one another: hot postings are contracted and no link is lost."""
    from strandloom.llm.components import components
    from strandloom.llm.simhash import links

    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    prints = {centre}
    for _ in range(700):
        p = centre
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            p ^= 1 << int(b)
        prints.add(p)
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    prints |= {p ^ 7 << 61 for p in list(prints)[-40:]} | {p ^ (1 | 1 << 20 | 1 << 50) for p in list(prints)[-80:-40]}
    prints = sorted(prints)
    roots = linked(prints)
    want = {frozenset(p for p, y in zip(prints, roots, strict=True) if x == y) for x in roots}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = defaultdict(set)
    seen = set()
    for r in components(links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect():
        found[r.root].add(r.node % (1 << 64))
        seen.add(r.node % (1 << 64))
    got = {frozenset(v) for v in found.values()} | {frozenset([p]) for p in prints if p not in seen}
    assert got == want


def test_quality_rules(spark, docs, empty):
    from strandloom.llm.quality_rules import clean_lines, keep_good

    nav = "a | b | c | d\n" + "fine words here, in a line.\n" * 2 + "Click here now\n!!! ###"
    extra = spark.createDataFrame([(20, nav), (21, "WORD!! AND!! MORE!! " * 10), (22, "| ".join(f"w{i}" for i in range(50)))], "doc_id long, text string")
    got = {(r.doc_id, r.text): r for r in clean_lines(docs.select("doc_id", "text").union(extra)).collect()}
    for (_, text), r in got.items():
        w = re.findall(WS, text or "")
        g = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        rep = {p for i in range(len(w) - 7) if g[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if re.search(WS, x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(rep))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 20 or 100 * len(rep) > 30 * len(w))
    assert got[(20, nav)].cleaned == "fine words here, in a line.\nfine words here, in a line."
    assert not any(r.kept for (d, _), r in got.items() if d in (21, 22, 4, 5, 6, 7, 10))
    assert all(r.kept for (d, _), r in got.items() if d in (1, 2, 3, 8, 9))
    assert Counter(r.doc_id for r in keep_good(docs).collect())[8] == 2
    assert keep_good(empty).count() == 0


def test_long_navigation_lines(spark, tmp_path):
    """Lines of 1 MB, and short ones against the rule as one plain pattern."""
    from strandloom.llm.quality_rules import BARS, MENU, clean_lines

    entry = "(home|menu|log ?in|sign ?up|next|previous|back|search|contact|about us)"
    plain = re.compile(rf"([|>»][^|>»]*){{3,}}|^\s*{entry}(\s*[|/>,·-]?\s*{entry})*\s*$", re.A)
    rng = np.random.default_rng(5)
    parts = ["home", "log in", "login", "sign up", "about us", "next", " ", "  ", "|", ">", "»", "/", ",", "·", "-", "x", "logout"]
    short = sorted({"".join(parts[int(i)] for i in rng.integers(0, len(parts), k)) for k in rng.integers(1, 7, 3000)})
    matches = F.regexp_like("l", F.lit(BARS)) | F.regexp_like("l", F.lit(MENU))
    got = spark.createDataFrame([(x,) for x in short], "l string").select("l", matches.alias("bad")).collect()
    assert len(got) > 1000 and {r.bad for r in got} == {True, False} and all(r.bad == bool(plain.search(r.l)) for r in got)
    tail = "\n" + prose(6, 40)
    size = 1 << 20
    long = {1: "ab | cde | " * (size // 11), 2: "home " * (size // 5), 3: "home | log in > " * (size // 16), 4: "home " * (size // 5) + "x", 5: "a" + " | b" * 2 + " word" * (size // 5)}
    path = str(tmp_path / "long")
    spark.createDataFrame([(k, v + tail) for k, v in long.items()], "doc_id long, text string").write.parquet(path)
    cleaned = {r.doc_id: r.cleaned for r in clean_lines(spark.read.parquet(path)).select("doc_id", "cleaned").collect()}
    assert all(cleaned[k] == (tail[1:] if k < 4 else long[k] + tail) for k in long)


def test_clean_long_lines(spark):
    """A phrase or a few bars in a long line are no evidence against it; tables and quoted replies are no navigation."""
    from strandloom.llm.quality_rules import clean_lines

    text = prose(7, 3000, 5000)
    half = len(text) // 2
    stay = [text[:half] + " click here " + text[half:], text[:half] + " privacy policy " + text[half:], text[:half] + " a > b | c > d " + text[half:],
            "\n".join(f"> > > reply {k} to the letter." for k in range(30)), "\n".join(f"| row {k} | {k * k} | {k + 7} |" for k in range(30))]
    go = ["home > shoes > red shoes > sale", "| Home | Menu | About us | Contact |", "Shop | Prices and offers | Our team | News", "(c) 2020 Some Firm Inc. All rights reserved.",
          "By using this site you agree to our Privacy Policy and Terms of Use."]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(stay + [text + "\n" + x for x in go])], "doc_id long, text string")
    got = {r.doc_id: r for r in clean_lines(table).collect()}
    assert all(got[k].cleaned == x and got[k].kept for k, x in enumerate(stay))
    assert all(got[len(stay) + k].cleaned == text for k in range(len(go)))


def test_decontamination(spark, docs, empty):
    from strandloom.llm.decontaminate import contamination, decontaminated

    a = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", collected(docs.where("doc_id = 1"))[0]["text"].lower())
    long = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", collected(docs.where("doc_id = 9"))[0]["text"].lower())
    bench = [(1, " ".join(a[20:33])), (2, " ".join(a[40:70]) + " tail not there at all"), (3, " ".join(a[100:112]) + " x"), (4, "ONE"), (5, ""), (6, None), (7, " ".join(a[20:33])),
             (None, " ".join(a[200:220])), (8, " ".join(long[i] for i in range(30_000, 30_020))), (9, "two, words"), (1, " ".join(a[20:33]))]
    bdf = spark.createDataFrame(bench, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in bench:
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add(i)
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, bdf).collect())
    want = Counter()
    for d in collected(docs):
        w, hit, items = split(d["text"]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k:k + n]))):
                    hit |= set(range(k, k + n))
                    items |= {str(i) for i in x if i is not None}
        want[(d["doc_id"], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert got == want
    kept = decontaminated(docs, bdf)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 6, 7)").count() == 0
    assert contamination(empty, bdf).count() == 0 and decontaminated(docs, bdf.where("false")).count() == docs.count()


def test_long_texts_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from strandloom.llm import decontaminate as d

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, n)) for n in (30, 900, 40, 2500, 0, 13)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])

    def marks():
        rows = [r for b in d.fingerprints((3,), None)([batch]) for r in b.to_pylist()]
        return ({(r["key"], r["row_words"]) for r in rows if r["hash"] is None}, {(r["key"], r["size"], r["hash"], r["pos"]) for r in rows if r["hash"] is not None})

    whole = marks()
    for piece in (257, 1000):
        monkeypatch.setattr(d, "PIECE", piece)
        assert marks() == whole


def test_mixing(spark, docs, empty):
    from strandloom.llm.mixing import mix, mixture

    rows = collected(docs)
    size = Counter()
    for r in rows:
        size[r["source"]] += len(re.findall(WS, r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = dict.fromkeys(order, 0.0), set(order), float(sum(size.values()))
    while rest > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = sum(max(0.0, target[s] - 3 * size[s]) for s in open_)
        full = {s for s in open_ if target[s] >= 3 * size[s]}
        for s in full:
            target[s] = 3.0 * size[s]
        open_ -= full
    got = mix(docs).collect()
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(target[s] - 1.001 < taken[s] <= target[s] + 1e-6 for s in order)
    words = lambda df: Counter(w for r in df.collect() for w in [r.source] * len(re.findall(WS, r.text)))
    mixed = mixture(docs.where("doc_id <> 8"))
    plain = mix(docs.where("doc_id <> 8")).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert mixed.columns == docs.columns and words(mixed) == Counter({r.source: r.n for r in plain if r.n})
    assert mix(empty).count() == 0 and mixture(empty).count() == 0


def test_new_words_go_to_the_model(monkeypatch):
    """Words, also with symbols behind, skip the steps before the model; ids are those of the whole texts."""
    from strandloom.llm.queries import tokenizer_path
    from strandloom.llm.records import PieceEncoder

    enc = PieceEncoder(tokenizer_path("byte_bpe_50k.json"))
    plain, seen = enc.batch, []
    monkeypatch.setattr(enc, "batch", lambda pieces: seen.extend(pieces) or plain(pieces))
    texts = [" ".join(f"wo{chr(97 + i % 26)}r{chr(97 + i // 26)}éd{end}" for i in range(200)) for end in ("", "%%%", ".", "***")]
    odd = ["it's <|endoftext|>a<|endoftext|> b|>.", "", " \n x  ŉſ ª² Ǆ中 don't! 9a a9 _a_ a__b a', 'tis", "a\x1cb. c\x85d\u00a0e,"]
    assert [bytes(x) for x in enc.encode([*texts, *odd])] == plain([*texts, *odd])
    assert len(seen) < 60


def test_records(spark, docs, empty, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from strandloom.llm.records import tokenized

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = tokenized(docs, path("byte_bpe_50k.json"), path=f"file://{tmp_path}/records").orderBy("start").collect()
    want = Counter()
    for r in collected(docs):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert tokenized(empty, path("byte_bpe_50k.json")).count() == 0


def bitwise_crc32c(data):
    reg = 0xFFFFFFFF
    for byte in data:
        reg ^= byte
        for _ in range(8):
            reg = (reg >> 1) ^ (0x82F63B78 if reg & 1 else 0)
    return reg ^ 0xFFFFFFFF


def test_crc32c():
    from strandloom.llm.crc32c import crc32c

    got = crc32c(np.concatenate([np.frombuffer(b"\x00" * 32 + b"\xff" * 32 + bytes(range(32)) + b"ab", "<u2")]), np.array([16, 16, 16, 1]))
    assert [hex(x) for x in got] == ["0x8a9136aa", "0x62a8ab43", "0x46dd794e", hex(bitwise_crc32c(b"ab"))]


def test_sharding(spark, docs, empty, tmp_path):
    from strandloom.llm.sharding import shard, write_shards

    many = docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("shard", F.lit("old"))
    got = shard(many, 7, bucket_bytes=1 << 16).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter((r.doc_id, r.text, r.k) for r in got) == Counter((r.doc_id, r.text, r.k) for r in many.collect())
    path = write_shards(docs, f"{tmp_path}/shards", 3)
    assert spark.read.parquet(path).count() == docs.count()
    assert shard(empty).count() == 0


CLASHES = ["_t", "_w", "_l", "_s", "_k", "_no", "row", "_key", "_source", "_size", "_rest", "_epochs", "_copy", "_take", "_last", "_other", "_taken", "n_words", "lost", "kept", "cleaned", "base_failed", "fp", "size", "taken", "target"]


def test_stages_keep_clashing_columns(spark):
    """Extra columns of any name come back as they were."""
    from strandloom.llm.decontaminate import decontaminated
    from strandloom.llm.mixing import mixture
    from strandloom.llm.quality_rules import keep_good
    from strandloom.llm.simhash import deduplicated

    texts = [(k, prose(k, 40 + k), "xy"[k % 2]) for k in range(1, 7)]
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    df = spark.createDataFrame([(d, t, s, len(t), *[f"{c}-{d}" for c in CLASHES]) for d, t, s in texts], f"doc_id long, text string, source string, n_chars long, {names}")
    item = spark.createDataFrame([("i1", prose(3, 43))], "item_id string, text string")
    for out in (keep_good(df), deduplicated(df), decontaminated(df, item), mixture(df)):
        assert out.columns == df.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}-{r['doc_id']}" for r in got for c in CLASHES)


def test_mixture_meets_its_budgets_with_repeated_rows(spark):
    from strandloom.llm.mixing import mixture

    rows = [(1, prose(1, 10), s, str(i % 3)) for s in "xy" for i in range(100)] + [(k, prose(k, 7), "z", "0") for k in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    taken = Counter()
    for r in mixture(df).collect():
        taken[r["source"]] += len(re.findall(WS, r["text"]))
    total, sizes = 2000 + 38 * 7, {"x": 1000, "y": 1000, "z": 266}
    weights = {"x": 5.0, "y": 2.0, "z": 1.0}
    goal = {s: total * weights[s] / 8 for s in sizes}
    assert all(abs(taken[s] - min(goal[s], 3 * sizes[s])) < 1.01 for s in sizes), (taken, goal)
    again = Counter(tuple(r) for r in mixture(df.repartition(7)).collect())
    assert again == Counter(tuple(r) for r in mixture(df).collect())


def test_quality_twin_follows_the_line_rules(spark, tmp_path):
    """Lines on which the rule goes by shares, in the SQL twin as in the operator."""
    import duckdb

    from strandloom.llm.queries import OP5_SQL
    from strandloom.llm.quality_rules import clean_lines

    lines = ["home | about us | contact | search", "| cell one | cell two | cell three |", "| home | menu | search |", "> quoted reply with > more > marks", "a > b > c > d", "click here",
             prose(3, 80) + " click here " + prose(4, 60), "privacy policy and terms of use", prose(5, 40) + " | x > y | " + prose(6, 60), "word >>> !!! ###", "next previous back", "»»» ---", "all is well. all is well."]
    df = spark.createDataFrame([(k, "\n".join([prose(100 + k, 12)] * (k % 2) + [x] * n + [prose(200 + k, 25)])) for k, (x, n) in enumerate((x, n) for x in lines for n in (1, 3))], "doc_id long, text string")
    df.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(OP5_SQL).fetchall()
    got = clean_lines(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
