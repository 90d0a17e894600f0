"""Growth of the operations that a larger run had stopped."""

import numpy as np

from corpusmill.llm import vectors
from tests.llm.test_round_3 import plain_links


def test_blocks_grow_with_the_vectors():
    """A vector goes to about as many blocks at six times the rows."""
    blocks = [-(-n // vectors.block_rows(n, 64)) for n in (10_000, 100_000, 615_000)]
    assert blocks == [3, 16, 19] and vectors.block_rows(615_000, 1 << 20) == vectors.BLOCK


def test_single_precision_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x[:100] + rng.normal(size=(100, 8)).astype(np.float32) * np.float32(0.1)]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.near_vectors(df, block=50)
    assert got.schema["embedding"].dataType.simpleString() == "array<float>"
    assert sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in got.collect()), key=repr) == plain_links(rows, 0.9)
