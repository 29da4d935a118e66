import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions.vectors import embedding_columns
from ionloom.operators.model import load_layers, predict

SCHEMA = "id bigint, peaks array<struct<bin:int,v:double>>, meta array<double>, u array<double>"


def test_combined_model(spark, tmp_path):
    rng = np.random.default_rng(1)
    width, sizes = 20, [20 + 2 + 3 + 1, 5, 4]
    layers = [(rng.standard_normal((a, b)).astype(np.float32), rng.standard_normal(b).astype(np.float32)) for a, b in zip(sizes, sizes[1:])]
    np.savez(tmp_path / "net.npz", **{f"{k}{i}": x for i, pair in enumerate(layers) for k, x in zip("wb", pair)})
    rows = [(1, [(3, 0.5), (3, 0.9), (19, 0.1), (25, 9.0), (-1, 9.0)], [1.0, 0.5], [0.1, 0.2, 0.3]), (2, [], [0.0, 0.0], None), (3, None, [0.0, 1.0], [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows * 400, SCHEMA).withColumn("features", F.concat("meta", embedding_columns(F.col("u"), 3, 2.0)))
    got = {r.id: r.probabilities for r in predict(df, "id", load_layers(str(tmp_path / "net.npz")), width=width).collect()}
    for i, peaks, meta, u in rows:
        x = np.zeros(26, dtype=np.float32)
        for b, v in peaks or []:
            if 0 <= b < width:
                x[b] = max(x[b], v)
        x[20:22] = meta
        if u:
            x[22:25], x[25] = 2 * np.array(u), 1
        y = np.maximum(x @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1]
        assert np.allclose(got[i], 1 / (1 + np.exp(-y)), atol=1e-6)
    with pytest.raises(ValueError):
        predict(df, "id", layers, width=26)
