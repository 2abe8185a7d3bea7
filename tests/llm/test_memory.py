"""What Python workers keep between tasks, as it is part of an executor's memory."""

import numpy as np
import pyarrow as pa

from tidemark.llm import common, textvec


def test_workers_give_back_what_tasks_freed(spark):
    """A task frees 200 MB around a few pieces that stay; the worker that waits for the next task doesn't keep them."""

    def use(batches):
        import sys

        for batch in batches:
            held = [b"x" * 50_000 for _ in range(4000)]
            sys.tidemark_test_kept = held[::100] + held[-1:]
            del held
            yield batch

    def resident(batches):
        from pathlib import Path

        for batch in batches:
            kb = next(int(line.split()[1]) for line in Path("/proc/self/status").read_text().splitlines() if line.startswith("RssAnon"))
            yield pa.RecordBatch.from_pydict({"id": pa.array([kb] * len(batch), pa.int64())})

    rows = spark.range(0, 8, 1, 4)
    assert common.map_batches(rows, use, "id long").count() == 8
    assert max(r.id for r in common.map_batches(rows, resident, "id long").collect()) < 150_000


def test_hashes_need_small_tables(monkeypatch):
    """A worker keeps tables of a few MB, and hashes are the same in blocks of any size, also of spans longer than a block."""
    text = " ".join(["word"] * 100_000 + ["x" * 700_000, "ünd"] + [f"w{i}" for i in range(200_000)])
    column = pa.array([text, None, "", "a b", text[::-1]])
    hashes, rows = textvec.word_hashes(column)
    assert sum(x.nbytes for x in textvec._powers(textvec._BLOCK + 1)) <= 8 << 20
    for block in (1 << 12, 1 << 22):
        monkeypatch.setattr(textvec, "_BLOCK", block)
        again, same = textvec.word_hashes(column)
        assert np.array_equal(again, hashes) and np.array_equal(same, rows)
