"""Late interaction: the matrix of tokens by tokens is bounded, whatever the chunks and queries have."""

import numpy as np

from corpusquery.operators import dense


def test_tokens_by_tokens_are_bounded(spark, monkeypatch):
    r = np.random.default_rng(2)
    docs = [(i, r.normal(size=(n, 4)).tolist()) for i, n in enumerate([3, 1, 70, 8, 8, 8, 2, 9, 33, 1] * 6)]
    most, found = [0], {}
    column = spark.createDataFrame(docs, "chunk_id long, embeddings array<array<double>>")

    def caught(vectors, asked, prepared, score, size, k, digits):
        block = asked.collect()
        rows = vectors.toArrow()
        real, sizes = dense._matrix, []
        monkeypatch.setattr(dense, "_matrix", lambda c, *a: (sizes.append(len(c)), real(c, *a))[1])
        queries = prepared(block)
        found["scores"] = score(rows["embeddings"].combine_chunks(), queries)
        found["ids"], found["asked"] = rows["chunk_id"].to_pylist(), [x.query_id for x in block]
        most[0] = max(sizes) * len(queries[1])

    monkeypatch.setattr(dense, "_searched", caught)
    monkeypatch.setattr(dense, "CELLS", 1 << 10)
    dense.maxsim_search(column, column.filter("chunk_id % 20 = 0 OR chunk_id % 20 = 2").withColumnRenamed("chunk_id", "query_id"))
    assert most[0] <= 1 << 10
    unit = {i: np.array(v) / np.linalg.norm(v, axis=1, keepdims=True) for i, v in docs}
    want = np.array([[(unit[q] @ unit[i].T).max(axis=1).sum() for q in found["asked"]] for i in found["ids"]])
    assert np.allclose(found["scores"], want, atol=1e-12)
