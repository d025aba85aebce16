"""Links of vectors do not depend on where Arrow batches end."""

import numpy as np

from roadloom.llm import lattice


def test_small_batches_lose_no_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    x = np.concatenate((base, base + 1e-6 * rng.normal(size=base.shape)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows in (1, 2, 3, 7):
            spark.conf.set(name, rows)
            got = {r.vec_id: r for r in lattice.embedding_links(df).collect()}
            assert [got[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()
            assert [got[i].component_id for i in range(len(x))] == [i % 150 for i in range(len(x))]
    finally:
        spark.conf.set(name, before)
