"""What a Python process takes beside the batch that it is given does not grow with the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from airflux.llm import hyperminhash


def peak(run, batch: pa.RecordBatch) -> tuple[float, list[pa.RecordBatch]]:
    """MB taken at most, Arrow's own memory aside."""
    out = list(run(iter([batch])))
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most, out


def test_signatures_take_little():
    words = np.random.default_rng(5).integers(0, 5000, 400_000)
    texts = [" ".join(f"w{w}" for w in words[k : k + 400]) for k in range(0, len(words), 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts), pa.array(range(1000))], names=["doc_id", "text", "text_hash"])
    most, out = peak(lambda b: hyperminhash.signed_batches(b, 5), batch)
    assert batch.nbytes > 2e6 and most < 15
    alone = [x for k in range(1000) for x in hyperminhash.signed_batches(iter([batch.slice(k, 1)]), 5)]
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches(alone))


def test_pairs_take_little():
    rows = np.random.default_rng(6).integers(1, 9000, (10_000, hyperminhash.BUCKETS)).astype(np.uint16)
    other = np.where(np.random.default_rng(7).random(rows.shape) < np.linspace(0, 1, 10_000)[:, None], rows, rows + 1).astype(np.uint16)
    n, names = pa.array([900] * 10_000), pa.array(range(10_000))
    packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (rows, other)]
    batch = pa.RecordBatch.from_arrays([names, names, n, n, *packed], names=["a", "b", "na", "nb", "ra", "rb"])
    most, out = peak(lambda b: hyperminhash.near_batches(b, 80), batch)
    assert most < 15
    kept = pa.Table.from_batches(out).column("a").to_pylist()
    alone = [x.column(0)[0].as_py() for k in range(0, 10_000, 50) for x in hyperminhash.near_batches(iter([batch.slice(k, 1)]), 80) if x.num_rows]
    assert alone == [k for k in kept if k % 50 == 0] and 0 < len(kept) < 10_000
