"""Near-duplicate lists and estimates over whole batches (F1, F2)."""
import time

import numpy as np
import pyarrow as pa

from featurelab.llm import near_dedup as nd


def _batch(rng, n_docs, space):
    sketches = [np.sort(rng.choice(space, rng.integers(1, 129), replace=False)).astype(np.int32) for _ in range(n_docs)]
    n = np.array([len(s) if len(s) < 128 else 128 + int(rng.integers(0, 900)) for s in sketches])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n_docs)), pa.array(n), pa.array(sketches, pa.list_(pa.int32()))], names=["rep", "n", "sketch"])
    return sketches, n, batch


def test_lists_put_crowded_values_last():
    sketches, n, batch = _batch(np.random.default_rng(5), 60, 4000)
    last = np.arange(0, 4000, 3, dtype=np.int32)
    for crowded in (last, np.empty(0, np.int32)):
        want = []
        for rep in range(10, 50):
            need = min(len(sketches[rep]), nd.shared_at_least(int(n[rep]), 128, 85))
            late = set(crowded.tolist())
            order = sorted(sketches[rep].tolist(), key=lambda v: (v in late, v))
            want += [(rep, int(n[rep]), len(order), need, place, v) for place, v in enumerate(order[:len(order) - need + 1])]
        got = nd._prefix_rows(batch.slice(10, 40), crowded, 128, 85).to_pydict()
        assert sorted(zip(*(got[c] for c in ("rep", "n", "size", "need", "place", "value")))) == want


def test_a_document_costs_no_pass_over_the_crowded_values():
    _, _, batch = _batch(np.random.default_rng(6), 2000, 1 << 20)
    began = time.perf_counter()
    rows = nd._prefix_rows(batch, np.arange(0, 4_000_000, 4, dtype=np.int32), 128, 85)
    assert rows.num_rows >= 2000 and time.perf_counter() - began < 3  # a pass for each takes minutes


def test_estimates_of_a_batch_are_those_of_its_pairs():
    def one(x, y, k, t):
        union = sorted(set(x) | set(y))
        full = max(len(x), len(y)) >= k
        m = min(k, len(union)) if full else len(union)
        both = len(set(x) & set(y) & set(union[:m]))
        return both >= t * m - (nd._SIGMAS * (m * t * (1 - t)) ** 0.5 if full else 0.0) - 1

    rng = np.random.default_rng(7)
    for k in (16, 128):
        left = [np.sort(rng.integers(0, 3 * k, rng.integers(0, k + 1))).tolist() for _ in range(400)]  # values may repeat
        right = [sorted((x + rng.integers(0, 3 * k, 3).tolist())[int(rng.integers(0, 9)):])[:k] for x in left]
        want = [one(x, y, k, 0.85) for x, y in zip(left, right)]
        got = nd._estimate(k, 85)(pa.array(left, pa.list_(pa.int32())), pa.array(right, pa.list_(pa.int32())))
        assert got.tolist() == want and 0 < sum(want) < 400
