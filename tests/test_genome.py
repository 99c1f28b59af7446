import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from strandloom.functions import genome as g
from strandloom.sources import sinks, text


@pytest.fixture
def gtf(spark, tmp_path):
    p = tmp_path / "a.gtf"
    p.write_text('# head\n'
                 'chr1\ts\tgene\t11\t20\t.\t+\t.\tgene_id "A.1"; source "havana";\n'
                 'chr2\ts\tgene\t1\t10\t.\t-\t.\tgene_id "B.2"; source "havana";\n'
                 'chr2\ts\tgene\t11\t20\t.\t+\t.\tgene_id "C.1"; source "havana";\n')
    return text.read_gtf(spark, str(p))


def test_sites_and_expand_round_trip(bed):
    assert rows(g.expand(g.start_site(bed), 0, 9)) == rows(bed)
    assert rows(g.expand(g.end_site(bed), 9, 0)) == rows(bed)


def test_expand_clips_to_chromosome(spark, bed):
    lens = spark.createDataFrame([("chr1", 40), ("chr2", 40), ("chr3", 40)], "chrom string, length long")
    out = g.expand(bed, 1000, 1000, lens)
    assert rows(out, "chromStart", "chromEnd") == [(0, 40)] * 6
    assert rows(g.expand(bed, 0, 0, lens)) == rows(bed)


def test_expand_unknown_chromosome_is_an_error(spark, bed):
    lens = spark.createDataFrame([("chr1", 40)], "chrom string, length long")
    with pytest.raises(Exception, match="chromosome"):
        g.expand(bed, 5, 5, lens).collect()


def test_strand_rules(bed):
    one = bed.where("strand = '+'")
    assert g.start_site(one).count() == 4
    with pytest.raises(ValueError):
        g.start_site(one, strict=True)
    with pytest.raises(Exception, match="strand"):
        g.start_site(bed.withColumn("strand", F.lit("."))).collect()


def test_interval_dist(spark):
    df = spark.createDataFrame([(0, 10, 10, 20), (10, 20, 0, 10), (0, 10, 5, 6), (0, 10, 20, 30), (20, 30, 0, 10)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(g.interval_dist(*[F.col(x) for x in "abcd"])).collect()]
    assert got == [-1, 1, 0, -11, 11]


def test_rectify_bed_errors_and_defaults(spark, bed):
    with pytest.raises(ValueError):
        g.rectify_bed(bed.drop("chrom"))
    out = g.rectify_bed(bed.drop("name"))
    assert len(out.columns) == 12 and rows(out, "name") == [(".",)] * 6


def test_attributes(spark, gtf):
    out = g.split_attribute(gtf, ["gene_id", "source"])
    assert rows(out, "gene_id", "source") == [("A.1", "havana"), ("B.2", "havana"), ("C.1", "havana")]
    dup = spark.createDataFrame([('k "1"; x "y"; k "2"; level 3;',), ("none",)], "attribute string")
    assert rows(g.split_attribute(dup).select(F.col("attributes")["k"], F.size("attributes"))) == [("2", 2), (None, 0)]


def test_annotate_genes_with_version_trim(spark, gtf):
    feats = spark.createDataFrame([("A",), ("B",), ("C",)], "feature string")
    out = g.annotate_genes(feats, gtf, "gene_id", by_func=g.ens_trim_version)
    assert rows(out, "feature", "chrom", "chromStart", "chromEnd", "strand") == [
        ("A", "chr1", 10, 20, "+"), ("B", "chr2", 0, 10, "-"), ("C", "chr2", 10, 20, "+")]


def test_bed_round_trip(spark, bed, tmp_path):
    sinks.write_bed(bed, str(tmp_path / "x"), 6)
    assert rows(text.read_bed(spark, str(tmp_path / "x")).select(*bed.columns)) == rows(bed)
    with pytest.raises(ValueError):
        sinks.write_bed(bed, str(tmp_path / "y"), 2)


def test_fasta_nucleotide_content(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text("".join(f">chr{i} x\n" + "A" * 10 + "\n" + "T" * 10 + "\n" + "C" * 10 + "\n" + "G" * 10 + "\n" for i in (1, 2, 3)))
    chunks = text.read_fasta_chunks(spark, str(p), 16)
    b = spark.createDataFrame([("chr1", 5, 25, "p", "+"), ("chr2", 5, 25, "m", "-"), ("chr3", 0, 40, "w", "+")],
                              "chrom string, chromStart long, chromEnd long, name string, strand string")
    out = g.nucleotide_content(b, chunks, 16)
    assert rows(out, "name", "num_a", "num_c", "num_g", "num_t", "length") == [("m", 10, 0, 5, 5, 20), ("p", 5, 5, 0, 10, 20), ("w", 10, 10, 10, 10, 40)]


def test_bedmap(spark, tmp_path):
    p = tmp_path / "b.bed"
    lists = ["cell1;cell2;cell3", "cell3;cell2;cell2", "cell4", "cell5;cell3", "cell4", "cell1;cell3"]
    p.write_text("".join(f"chr1\t{i}\t{i + 1}\t{n}\t.\t+\t{c}\n" for i, (n, c) in enumerate(zip("abcdef", lists))) + "chr1\t9\t10\tg\t.\t+\t\n")
    m, f = text.read_bedmap(spark, str(p))
    want = {"cell1": [1, 0, 0, 0, 0, 1], "cell2": [1, 2, 0, 0, 0, 0], "cell3": [1, 1, 0, 1, 0, 1], "cell4": [0, 0, 1, 0, 1, 0], "cell5": [0, 0, 0, 1, 0, 0]}
    assert rows(m) == sorted((c, x, float(v)) for c, vs in want.items() for x, v in zip("abcdef", vs) if v)
    assert rows(f) == [(x,) for x in "abcdefg"]


def test_make_unique_and_prefer(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "id long, name string")
    assert rows(g.make_unique(df, "name", ["id"])) == [(1, "x"), (2, "x-1"), (3, "y"), (4, "x-2")]
    t = spark.createDataFrame([("k", "hg19", 1), ("k", "GRCh38", 2), ("k", "GRCh38", 3), ("j", "hg19", 4)], "t string, a string, i int")
    assert rows(g.prefer(t, "t", "a", ["GRCh38", "hg19"]), "i") == [(2,), (3,), (4,)]


def test_fasta_is_read_in_splits(spark, tmp_path):
    """Records over many splits, several in one, without letters, of one name, and in two files."""
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("ACGTN"), n))
    records = [("chr1", letters(5000)), ("chr2", letters(37)), ("empty", ""), ("chr3", letters(1)), ("chr1", letters(800)), ("chr4", letters(64))]
    fold = lambda name, seq: f">{name} some words\n" + "".join(seq[i:i + 60] + "\n" for i in range(0, len(seq), 60))
    (tmp_path / "a.fa").write_text("; a remark\n" + "".join(fold(*r) for r in records[:4]))
    (tmp_path / "b.fa").write_text("".join(fold(*r) for r in records[4:]).rstrip())
    want = sorted((name, i, seq[i * 64:i * 64 + 64]) for name, seq in records for i in range(-(-len(seq) // 64)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("97", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = text.read_fasta_chunks(spark, str(tmp_path), 64)
            assert sorted(tuple(r) for r in got.collect()) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_mtx_from_folders_of_parts(spark, tmp_path):
    """Matrix and name files in several parts, which are taken in the order of their names; the size line stands in the second one."""
    from strandloom.sources.text import read_mtx

    def put(name, *parts):
        (tmp_path / name).mkdir()
        for i, lines in enumerate(parts):
            (tmp_path / name / f"part-{i:05d}.txt").write_text("".join(f"{x}\n" for x in lines))
        return str(tmp_path / name)

    mtx = put("mtx", ["%%MatrixMarket matrix coordinate real general"], ["%", "4 3 4"], ["1 1 2", "2 3 4"], ["4 2 1.5", "3 3 7"])
    out = read_mtx(spark, mtx, put("barcodes", ["a"], ["b", "c"]), put("features", ["f\tx", "g\tx"], ["h\tx"], ["i\tx"]))
    assert sorted(tuple(r) for r in out.collect()) == [("a", "f", 2.0), ("b", "i", 1.5), ("c", "g", 4.0), ("c", "h", 7.0)]
