"""How many pairs are reranked exactly, and vectors of any length."""

import numpy as np
import pandas as pd
import pytest

from gridtally.llm import neighbours


def coded(x):
    class Rows:
        def mapInPandas(self, encode, schema):
            return pd.concat(encode(iter([pd.DataFrame({"vec_id": np.arange(len(x)), "vector": list(x)})])))

    return neighbours.build_index(Rows(), {x.shape[1]: x.mean(axis=0)})


@pytest.mark.parametrize("length", [1.0, 1e-7, 1e7])
def test_vectors_without_clusters_are_mostly_ruled_out(monkeypatch, length):
    """Before, a third of all pairs was added up and sorted, as each chunk set its own first level."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x *= length / np.linalg.norm(x, axis=1)[:, None]
    codes = coded(x)
    sorted_pairs, lexsort = [], np.lexsort
    monkeypatch.setattr(neighbours.np, "lexsort", lambda keys: sorted_pairs.append(len(keys[0])) or lexsort(keys))
    found = neighbours._search_block(codes[::20], codes, x.mean(axis=0), 20, 256, neighbours.EPSILON, neighbours.SEED)
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :20]
    hit = sum(len(set(found.vec_id[found.query_id == i * 20]) & set(row.tolist())) for i, row in enumerate(true))
    assert hit / 6000 >= 0.999
    if length >= 1:
        assert sum(sorted_pairs) < 0.1 * 300 * 6000
