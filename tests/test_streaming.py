from pyspark.sql import functions as F

from ionloom.streaming import spectra as T
from tests.compare import DATA


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    spark.read.parquet(f"{DATA}/train.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = T.read_spectra(spark, str(tmp_path / "in"), batch.schema)
    run(T.clean_only(stream).select("row_id"), "clean", "append")
    assert spark.table("clean").count() == T.clean_only(batch).count() > 0
    run(T.counts_by_time(stream, "acquired_at", "30 days", "4000 days", "instrument_type"), "counts", "complete")
    assert spark.table("counts").agg(F.sum("n")).first()[0] == batch.count()
    structures = spark.read.parquet(f"{DATA}/molecules.parquet").select("fp_index", F.col("exact_mass").alias("mass"))
    run(T.candidates(stream, structures), "candidates", "append")
    assert spark.table("candidates").count() == T.candidates(batch, structures).count() > 0
