"""Fields of records that are looked up together: the same sums as one by one, in few tables."""

import numpy as np
import pyarrow as pa
import pytest

from xrdlake.operators import closeness as C
from xrdlake.operators.geochem import field_weights

WEIGHTS = field_weights("composite")


def records(rng, n):
    words = lambda k: pa.array([None if rng.random() < 0.1 else list(rng.choice(list("abcdefgh"), rng.integers(0, k + 1), replace=False)) for _ in range(n)], pa.list_(pa.string()))
    some = lambda: pa.array([None if rng.random() < 0.2 else str(rng.integers(0, 4)) for _ in range(n)])
    columns = {f"t_{k}": words(m) for k, m in zip(C.SETS, (2, 1, 1, 3, 1, 0, 1, 4), strict=True)} | {k: some() for k in (*C.TIMES, "class")}
    columns |= {k: pa.array(rng.random(n)) for k in ("si_al", "clay_fraction")}
    return pa.table(columns | {"vector": pa.array([None if rng.random() < 0.1 else rng.random(3) for _ in range(n)], pa.list_(pa.float64()))})


def one_by_one(a, b):
    total = np.zeros((a.num_rows, b.num_rows))
    for k in C.SETS:
        left, right = ([frozenset(v or ()) for v in t.column(f"t_{k}").to_pylist()] for t in (a, b))
        total += WEIGHTS[k] * np.array([[len(u & v) / max(len(u | v), 1) for v in right] for u in left])
    for k in C.TIMES:
        left, right = (t.column(k).to_pylist() for t in (a, b))
        total += WEIGHTS[k] * np.array([[u is not None and u == v for v in right] for u in left])
    return total


@pytest.mark.parametrize(("kept", "tables"), [(4_000_000, 4), (900, 11), (20, 11), (0, 0)])
def test_sums_of_fields(monkeypatch, kept, tables):
    monkeypatch.setattr(C, "KEPT", kept)
    rng = np.random.default_rng(7)
    a, b = records(rng, 90), records(rng, 130)
    blocks = C.Blocks(a, b, WEIGHTS, 0.45, "cosine")
    assert len(blocks.joint) <= tables and all(j.table.size <= kept for j in blocks.joint)
    assert np.abs(blocks.words(slice(0, 64)) - one_by_one(a, b)[:64]).max() < 1e-6
    assert np.abs(blocks.words(slice(64, 128)) - one_by_one(a, b)[64:]).max() < 1e-6
