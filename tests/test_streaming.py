from helpers import rows
from pyspark.sql import functions as F

from strandloom.functions.genome import expand, start_site
from strandloom.operators.intervals import window_graph
from strandloom.streaming import per_batch


def test_column_functions_and_overlap_join_on_a_stream(spark, bed, tmp_path):
    for part in ("chr1", "chr2"):
        bed.where(F.col("chrom") == part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = expand(start_site(spark.readStream.schema(bed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), 0, 9)
    query = (per_batch(stream, lambda b: window_graph(b, bed, 0), str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = rows(spark.read.parquet(str(tmp_path / "out")), "source", "target")
    assert got == [(x, x) for x in "abcde"]
