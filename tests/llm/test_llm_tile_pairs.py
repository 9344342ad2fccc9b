"""Sets that share many keys are named as a pair once, in the first key that both have."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from roadflow.llm import parity_join as P


def _tiles(lists: dict[int, list[int]], folds: dict[int, np.ndarray], size: int) -> pa.RecordBatch:
    rows = [(key, 0, 0, 0, sid, sid, size, folds[sid].tobytes(), sorted(keys))
            for key in sorted({k for keys in lists.values() for k in keys})
            for sid, keys in lists.items() if key in keys]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows]) for i in range(9)],
        ["key", "one", "two", "side", "sid", "root", "size", "fold", "keys"])


def test_each_pair_once_and_none_lost():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 4, np.uint64)
    folds = {i: base ^ (np.uint64(1) << np.uint64(i)) for i in range(40)}  # all near one another
    lists = {i: sorted(r.choice(np.arange(-30, 30), 12, replace=False).tolist()) for i in folds}
    batch = _tiles(lists, folds, 200)
    meet = {(a, b) for a in lists for b in lists if a < b and set(lists[a]) & set(lists[b])}
    every = [p for b in P.tile_pairs(85, False)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(every) == len(set(every)) and set(every) == meet
    some = [p for b in P.tile_pairs(85, True)(iter([batch])) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(some) == len(set(some)) and set(some) <= meet
    assert {i for p in some for i in p} == {i for p in meet for i in p}  # every set has a partner


def test_earlier_keys():
    bits = P.earlier_keys(5, [[1, 3, 5], [3, 5, 9], [1, 2, 5], [5]])
    both = [[bool((a & b).any()) for b in bits] for a in bits]
    assert both == [[True, True, True, False], [True, True, False, False], [True, False, True, False], [False] * 4]
    assert not P.earlier_keys(5, [[5], [5, 6]]).any()
