"""Searches of an M-tree by many queries side by side: as one by one, and with few calls."""

import sys

import numpy as np

from tallyspark.llm import metric_tree


def test_queries_visit_pages_together(monkeypatch):
    monkeypatch.setattr(metric_tree, "HELD", 2_000)
    rng = np.random.default_rng(7)
    v = np.floor(rng.normal(size=(3_000, 12)) * 64)
    v[2_000:2_200] = v[0]
    norm = (v**2).sum(1).max()
    tree = metric_tree.Tree.bulk_load(np.arange(len(v)), metric_tree.lifted(v, norm))
    at = np.arange(0, 3_000, 10)
    q = np.concatenate([v[at], np.zeros((len(at), 1))], 1)
    calls = [0]
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call" and frame.f_code.co_name == "visit")))
    try:
        query, d, ids = tree.search_all(q, norm, 20, at, np.full(len(at), np.inf))
    finally:
        sys.setprofile(None)
    assert calls[0] < 40 * len(tree.leaf) < len(at) * len(tree.leaf)
    for k, i in enumerate(at):
        mine = query == k
        got = sorted(zip((np.rint(((q[k] ** 2).sum() + norm - d[mine] ** 2) / -2)).astype(int).tolist(), ids[mine].tolist()))[:20]
        product = -(v @ v[i]).astype(int)
        assert got == [(int(product[j]), int(j)) for j in np.lexsort((np.arange(len(v)), product)) if j != i][:20]
