from strandweave.operators.statistics import collect
from strandweave.plans import queries
from strandweave.plans.trim import trim
from strandweave.streaming.trim import statistics, stream_of, trim_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    reads, spec = queries.synthetic(spark, SF), queries._flagship()
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    reads.repartition(3).write.parquet(source)
    run = lambda: trim_stream(stream_of(spark, source, files_per_batch=1), spec, out, str(tmp_path / "ck"), lambda w: w.trigger(availableNow=True)).awaitTermination()
    run()
    run()  # nothing new
    want = trim(reads, spec)
    got = spark.read.parquet(f"{out}/reads")
    cols = ["rid", "fate", "name", "sequence", "qualities"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    a, b = statistics(spark, spec, out), collect(want, spec)
    assert (a.n, a.fates, a.bp_out, a.lengths, a.with_adapters) == (b.n, b.fates, b.bp_out, b.lengths, b.with_adapters)
