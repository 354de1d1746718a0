from __future__ import annotations

import numpy as np
import pyarrow as pa

from roadweave.llm import toxicity


def test_rows_of_a_fit_come_in_the_order_of_their_terms():
    rng = np.random.default_rng(1)
    rows = [(rng.choice([-(2**31), -5, -1, 0, 3, 300, 2**31 - 1], rng.integers(0, 4)).tolist(), bool(rng.integers(2))) for _ in range(300)]
    x, y = toxicity._in_order(pa.array([t for t, _ in rows], pa.list_(pa.int32())), np.array([v for _, v in rows]))
    assert [(t.tolist(), bool(v)) for t, v in zip(x, y)] == sorted(rows)
