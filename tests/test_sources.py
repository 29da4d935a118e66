import gzip
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.session import cut, drop_cuts
from ionloom.sources import readers, writers
from ionloom.sources.cache import computed_or_read, missing_rows

SDF = "one\n  made\n\n  2  1  0  0  0  0            999 V2000\nM  END\n> <ChEBI ID>\nCHEBI:1\n\n$$$$\ntwo\n  made\n\n  3  2  0  0  0  0            999 V2000\nM  END\n> <NAME>\nx\n\n$$$$\n"


def test_sdf(spark, tmp_path):
    with gzip.open(tmp_path / "a.sdf.gz", "wt") as f:
        f.write(SDF)
    rows = readers.sdf(spark, str(tmp_path / "a.sdf.gz"), "ChEBI ID", "NAME").collect()
    assert [tuple(r) for r in rows] == [("one", 2, 1, "CHEBI:1", None), ("two", 3, 2, None, "x")]


def test_zipped_sdf(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("structures.sdf", SDF)
    rows = readers.zipped_sdf(spark, str(tmp_path / "l.zip"), "structures.sdf", "NAME").collect()
    assert [tuple(r) for r in rows] == [("one", None), ("two", "x")]


def test_npz_parts_leave_out_unfinished(spark, tmp_path):
    np.savez(tmp_path / "part_0.npz", row_ids=np.array([3, 4]), embeddings=np.ones((2, 4), dtype=np.float16))
    (tmp_path / "part_1.tmp.npz").write_bytes(b"half")
    rows = readers.npz_parts(spark, str(tmp_path)).collect()
    assert sorted((r.row_id, r.embedding) for r in rows) == [(3, [1.0] * 4), (4, [1.0] * 4)]


def test_mass_parts_are_in_order(spark, tmp_path):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 37).cast("double").alias("mass"))
    writers.write_mass_parts(df, str(tmp_path / "pool"), "mass", 5)
    spans = spark.read.parquet(str(tmp_path / "pool")).groupBy(F.input_file_name().alias("f")).agg(F.min("mass").alias("a"), F.max("mass").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_resume_writes_only_missing_parts(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.range(10).withColumn("part", F.col("id") % 3)
    assert sorted(writers.write_missing(df.where("part < 2"), path, "part")) == [0, 1]
    assert writers.write_missing(df, path, "part") == [2]
    assert writers.write_missing(df, path, "part") == [] and spark.read.parquet(path).count() == 10


def test_csv_and_sql(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "i int, t string")
    writers.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.csv(spark, str(tmp_path / "c"), "i int, t string").collect())) == [(1, 'a "b", c'), (2, None)]
    writers.write_parquet(df, str(tmp_path / "p"))
    assert readers.sql_on_file(spark, str(tmp_path / "p"), "SELECT count(*) AS n FROM {file}").first().n == 2
    assert readers.parquet(spark, str(tmp_path / "p"), "t").columns == ["t"]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        writers.write_parquet(df, str(tmp_path / "p"))


def test_row_ids_and_blob(spark, tmp_path):
    spark.range(50, numPartitions=1).write.parquet(str(tmp_path / "r"))
    rows = readers.with_row_id(spark.read.parquet(str(tmp_path / "r"))).collect()
    assert all(r.id == r.row_id for r in rows)


def test_offset_blob_in_parts(spark, tmp_path):
    smiles = ["CO", "CCC", "", "N#N", "O=C=O", "[Na+].[Cl-]"]
    body = "".join(smiles).encode()
    np.save(tmp_path / "mass.npy", np.arange(6) + 0.5)
    np.save(tmp_path / "offsets.npy", np.cumsum([0] + [len(s) for s in smiles]))
    raw = b"#" * 128 + body
    for k, (a, b) in enumerate([(0, 100), (100, 131), (131, len(raw))]):
        (tmp_path / f"blob.npy.part_{k}").write_bytes(raw[a:b])
    for rows in (2, 100):
        got = readers.offset_blob(spark, str(tmp_path), rows=rows).orderBy("position").collect()
        assert [tuple(r) for r in got] == [(i, i + 0.5, s) for i, s in enumerate(smiles)]


def test_sdf_with_carriage_returns(spark, tmp_path):
    (tmp_path / "c.sdf").write_bytes(SDF.replace("\n", "\r\n").encode())
    rows = readers.sdf(spark, str(tmp_path / "c.sdf"), "ChEBI ID", "NAME").collect()
    assert [tuple(r) for r in rows] == [("one", 2, 1, "CHEBI:1", None), ("two", 3, 2, None, "x")]
    (tmp_path / "d.sdf").write_text("\n  made\n\n  2  1  0  0  0  0            999 V2000\nM  END\n\n$$$$\nno counts\n$$$$\n")
    assert [tuple(r) for r in readers.sdf(spark, str(tmp_path / "d.sdf")).collect()] == [("", 2, 1), ("no counts", None, None)]


def test_computed_once(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def compute():
        calls.append(1)
        return spark.range(5)

    assert missing_rows(spark, path, spark.range(3), "id").count() == 3
    assert computed_or_read(spark, path, compute).count() == computed_or_read(spark, path, compute).count() == 5 and len(calls) == 1
    assert [r.id for r in missing_rows(spark, path, spark.range(3, 8), "id").orderBy("id").collect()] == [5, 6, 7]
    (tmp_path / "cache" / "_SUCCESS").unlink()
    assert computed_or_read(spark, path, compute).count() == 5 and len(calls) == 2


def test_cuts_are_removed(spark):
    df = cut(spark.range(7))
    assert df.count() == 7 and df.inputFiles()
    path = df.inputFiles()[0].removeprefix("file://")
    drop_cuts(spark)
    assert not os.path.exists(path)
