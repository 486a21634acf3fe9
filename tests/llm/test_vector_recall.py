"""Recall of the pivot index on pairs at the cosine limit when there are many pivots."""

import numpy as np
import pytest

from dossier.llm import vector_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n_pivots", [64, 256, 1024, 4096])
def test_border_line_pairs_meet(spark, n_pivots):
    r = np.random.default_rng(11)
    pivots, a, other = (unit(r.normal(size=(n, 64))) for n in (n_pivots, 600, 600))
    aside = unit(other - (other * a).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.9**2) * aside
    classes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.vstack([a, b]))], "c long, v array<double>")
    near = {x.c: set(x.pivots) for x in vector_dedup.postings(classes, pivots).collect()}
    met = sum(len(near[k] & near[k + 600]) >= 2 for k in range(600)) / 600
    print(n_pivots, met)
    assert met >= 0.97
