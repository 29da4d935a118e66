"""Applying a trained network to spectra: weights are given, training isn't done here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are made dense together.
BATCH = 512


def load_layers(path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers of a network in an array file (w0, b0, w1, b1, ...), each as (weights (inputs, outputs), bias)."""
    with np.load(path, allow_pickle=False) as z:
        layers = [(z[f"w{i}"].astype(np.float32), z[f"b{i}"].astype(np.float32)) for i in range(len(z.files) // 2)]
    for (a, b), (c, _) in zip(layers, layers[1:]):
        if a.shape[1] != c.shape[0] or b.shape != (a.shape[1],):
            raise ValueError(f"layers of {a.shape} and {c.shape} don't fit")
    return layers


def dense_inputs(peaks: pa.ListArray, features: pa.ListArray, width: int) -> np.ndarray:
    """(rows, width + features) of a batch: the largest value of each bin, then the features; a null list has none."""
    n = len(peaks)
    size = np.asarray(peaks.value_lengths().fill_null(0))
    flat = peaks.flatten()
    bins, values = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    row = np.repeat(np.arange(n), size)
    ok = (bins >= 0) & (bins < width)
    rest = np.asarray(features.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(n, -1)
    x = np.zeros((n, width + rest.shape[1]), dtype=np.float32)
    np.maximum.at(x, (row[ok], bins[ok].astype(np.int64)), values[ok].astype(np.float32))
    x[:, width:] = rest
    return x


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0)
    w, b = layers[-1]
    return 1 / (1 + np.exp(-(x @ w + b)))


def predict(df: DataFrame, ident: str, layers: list[tuple[np.ndarray, np.ndarray]], *, peaks: str = "peaks", features: str = "features", width: int = 10_000) -> DataFrame:
    """(ident, probabilities): a feed-forward network over binned peaks (largest value a bin) and features.

    ``peaks``: array<struct<bin, v>>, ``features``: array<double>, of one length: metadata, and for a combined model the
    columns of ``vectors.embedding_columns`` behind them. Peaks stay sparse until BATCH rows are made dense here. Hidden
    layers take the positive part, the last the logistic function. The input width must be that of the first weights.
    """
    held = df.sparkSession.sparkContext.broadcast(layers)
    if layers[0][0].shape[0] <= width:
        raise ValueError(f"weights take {layers[0][0].shape[0]} inputs; {width} are bins alone")

    def run(batches):
        net = held.value
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                y = forward(dense_inputs(part.column(1), part.column(2), width), net).astype(float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "probabilities"])

    kind = dict(df.dtypes)[ident]
    out = df.select(F.col(ident).alias("id"), F.col(peaks).alias("p"), F.col(features).alias("f")).mapInArrow(run, f"id {kind}, probabilities array<double>")
    return out.withColumnRenamed("id", ident)
