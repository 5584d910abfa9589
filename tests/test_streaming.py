"""Genomes that arrive in batches give the vertices of all of them at once."""

from junctura.operators import junctions, windows
from junctura.streaming import arrivals


def test_batches_merge(spark, tmp_path):
    seqs = [(i, "ACGTTGCANNACGTACCATGA"[i:] + "ACGT" * (i % 3)) for i in range(9)]
    source = tmp_path / "in"
    whole = spark.createDataFrame(seqs, "seq_id long, seq string")
    whole.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = arrivals.start(stream, 5, str(tmp_path / "state"), str(tmp_path / "check"), availableNow=True)
    query.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    expected = key(junctions.vertices(windows.canonical(windows.definite(windows.kmers(whole, 5)))))
    assert len(list((tmp_path / "state").iterdir())) > 1
    assert key(arrivals.vertices(spark, str(tmp_path / "state"))) == expected
    arrivals.compact(spark, str(tmp_path / "state"), str(tmp_path / "less"))
    assert key(arrivals.vertices(spark, str(tmp_path / "less"))) == expected
