"""Sources: structure files, CSV, part directories, arrays; all as DataFrames."""

from __future__ import annotations

import glob
import io
import re
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet file, directory or glob; only the columns asked for are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str, *columns: str) -> DataFrame:
    df = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"')
    return df.select(*columns) if columns else df


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows of one Parquet file numbered in file order; over several files the number is unique only with the file's name."""
    return df.select("*", F.col("_metadata.row_index").alias(name))


def sdf(spark: SparkSession, path: str, *properties: str) -> DataFrame:
    """One row per record of SDF text (plain or gzip): title, atoms, bonds and the named properties, NULL where missing.

    Records end with a line ``$$$$``, lines with LF or CR LF. The title stands three lines above the counts line; a record
    without one has NULL counts, and its first line that isn't blank as title.
    """
    records = spark.read.text(path, lineSep="\n$$$$").where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    lines = F.split(F.regexp_replace("value", r"\r", ""), "\n")
    is_counts = lambda x: x.rlike(r"V[23]000\s*$")
    counts = F.get(F.filter(lines, is_counts), 0)
    place = F.array_position(F.transform(lines, is_counts), True).cast("int")
    first = F.get(F.filter(lines, lambda x: F.trim(x) != ""), 0)
    title = F.trim(F.when(place > 3, F.get(lines, place - 4)).otherwise(first))
    number = lambda at: F.try_to_number(F.trim(F.substring(counts, at, 3)), F.lit("999")).cast("int")
    prop = lambda p: F.nullif(F.trim(F.regexp_extract(F.regexp_replace("value", r"\r", ""), rf"(?m)^>[^\n<]*<{re.escape(p)}>[^\n]*\n([^\n]*)", 1)), F.lit(""))
    return records.select(title.alias("title"), number(1).alias("atoms"), number(4).alias("bonds"), *[prop(p).alias(p) for p in properties])


def zipped_sdf(spark: SparkSession, path: str, member: str, *properties: str) -> DataFrame:
    """The records of an SDF member of zip archives, one task an archive, streamed record by record."""
    names = ["title", *properties]
    patterns = {p: re.compile(rf"^>[^\n<]*<{re.escape(p)}>[^\n]*\n([^\n]*)", re.M) for p in properties}

    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, io.TextIOWrapper(z.open(member), "utf-8", errors="replace") as f:
                    record, rows = [], []
                    for line in f:
                        if line.strip() != "$$$$":
                            record.append(line)
                            continue
                        text = "".join(record)
                        found = [m[1].strip() if (m := patterns[p].search(text)) else None for p in properties]
                        rows.append([record[0].strip() if record else "", *found])
                        record = []
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def npz_parts(spark: SparkSession, path: str, ids: str = "row_ids", vectors: str = "embeddings") -> DataFrame:
    """(row_id, embedding) of finished array parts (``*.npz``); half-written ``*.tmp.npz`` parts are left out."""

    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    rows, x = z[ids], z[vectors].astype(np.float32)
                for lo in range(0, len(rows), 10_000):
                    yield pd.DataFrame({"row_id": rows[lo : lo + 10_000].astype(np.int64), "embedding": list(x[lo : lo + 10_000])})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return files.where(~F.col("path").endswith(".tmp.npz")).select("content").mapInPandas(read, "row_id bigint, embedding array<float>")


def offset_blob(spark: SparkSession, folder: str, masses: str = "mass.npy", offsets: str = "offsets.npy", parts: str = "blob.npy.part_*", header: int = 128, rows: int = 200_000) -> DataFrame:
    """(position, mass, smiles) of a mass-sorted blob in array files that all executors can read under ``folder``.

    The blob may lie in parts, cut anywhere, with ``header`` bytes before its first; ``offsets`` has one entry more than
    ``masses``. Every task reads the bytes of its ``rows`` structures; nothing goes through the driver. Write the result
    with ``write_mass_parts``.
    """
    count = np.load(f"{folder}/{masses}", mmap_mode="r").shape[0]

    def read(batches):
        m, o = (np.load(f"{folder}/{n}", mmap_mode="r") for n in (masses, offsets))
        files = [np.memmap(p, dtype=np.uint8, mode="r") for p in sorted(glob.glob(f"{folder}/{parts}"))]
        starts = np.cumsum([0] + [len(f) for f in files])
        for b in batches:
            for k in b.column(0).to_pylist():
                lo, hi = k * rows, min(count, (k + 1) * rows)
                cut = np.asarray(o[lo : hi + 1]).astype(np.int64)
                first, last = int(cut[0]) + header, int(cut[-1]) + header
                raw = b"".join(f[max(first, s) - s : min(last, e) - s].tobytes() for f, s, e in zip(files, starts, starts[1:]) if first < e and last > s)
                text = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer((cut - cut[0]).astype(np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(np.asarray(m[lo:hi], dtype=float)), text], names=["position", "mass", "smiles"])

    chunks = max(1, -(-count // rows))
    return spark.range(0, chunks, 1, chunks).mapInArrow(read, "position bigint, mass double, smiles string")


def sql_on_file(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``query`` with {file} standing for the Parquet file or directory."""
    return spark.sql(query.replace("{file}", f"parquet.`{path}`"))
