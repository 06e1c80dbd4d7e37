"""Copies of a common passage don't go to one bucket."""

import numpy as np
import pyarrow as pa
import pytest

from retentia.llm import common as C
from retentia.llm import windows


@pytest.mark.parametrize("any_place", [False, True])
def test_settled_rows_are_spread(monkeypatch, any_place):
    monkeypatch.setattr(windows, "SETTLED_ROWS", 10, raising=False)
    spec, parts, n = windows.Spec(words=False, width=100, spread=30, any_place=any_place), 16, 400
    line = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(100))  # one window: one run
    cut = np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts), np.zeros(parts - 1, np.uint64)
    batch = pa.RecordBatch.from_pydict({"k": list(range(n)), "tag": [1] * n, "text": [line] * n})
    sizes, rows = np.zeros(parts, int), []
    blobs = list(windows.find_runs(spec, *cut)([batch]))
    for b in blobs:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist(), strict=True):
            got = C.unpacked(blob, *windows.KINDS)
            sizes[part] += len(got[0])
            rows += got[2].tolist()
    assert sorted(rows) == list(range(n))
    assert sizes.max() < n / 3
    closed = [k for out in windows.sort_buckets(spec, *cut)(blobs) for k, kind in zip(out.column("k").to_pylist(), out.column("kind").to_pylist(), strict=True) if kind == windows.CLOSED]
    assert sorted(closed) == list(range(0 if any_place else 1, n))
