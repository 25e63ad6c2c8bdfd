"""Pairs of long lists: each is given by one list."""

import numpy as np
import pyarrow as pa

from cadenza.llm import lists as L


def cell(sig, held):
    """A cell of the list `sig`; `held` has the lists of each node."""
    nodes = [v for v in sorted(held) if sig in held[v]]
    keys = [(sorted(held[v]) + [(1 << 63) - 1] * 8)[:8] for v in nodes]
    k = len(nodes)
    zero = pa.array(np.zeros(k, dtype=np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(k, sig)), zero, zero, pa.array(nodes, pa.int64()), pa.array(np.full(k, 100, dtype=np.int32)), pa.array(nodes, pa.int64()),
        zero, pa.array([bytes(L.MAP_BITS // 8)] * k, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
    ], names=["sig", "bi", "bj", "node", "n", "component", "block", "small", "keys"])


def given(held):
    """Pairs given by the cells of all lists, each a task of its own."""
    out = []
    for sig in sorted(set().union(*held.values())):
        for batch in L.cells(iter([cell(sig, held)])):
            out += list(zip(batch["u"].to_pylist(), batch["v"].to_pylist()))
    return out


def test_sets_of_many_common_lists_give_each_pair_once():
    held = {v: set(range(10, 40)) for v in range(30)}
    pairs = given(held)
    assert len(pairs) == len(set(pairs)) == 30 * 29 // 2


def test_no_pair_is_lost_beyond_the_carried_keys():
    rng = np.random.default_rng(3)
    held = {v: set(rng.choice(200, 25, replace=False).tolist()) for v in range(60)}
    pairs = given(held)
    want = {(u, v) for u in held for v in held if u < v and held[u] & held[v]}
    assert set(pairs) == want
    assert len(pairs) < sum(len(held[u] & held[v]) for u, v in want)
