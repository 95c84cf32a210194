"""Python memory of the steps that every text passes: bounded by a slice of the text, not by the batch."""

import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from studylantern.llm import bagminhash, bwt, packing, phrases


class Captured:
    """Stands for a frame: takes the function of mapInArrow."""

    def select(self, *columns):
        return self

    selectExpr = select

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


STEPS = {
    "sketches": (lambda d: bagminhash.sketches(d), ["doc_id", "text"]),
    "phrases": (lambda d: phrases.block_rows(d), ["k", "text"]),
    "bwt": (lambda d: bwt.block_rows(d), ["doc_id", "k", "text"]),
    "packing": (lambda d: packing.cut_pieces(d, public_tokenizers.path("word_bpe_49k.json")), ["doc_id", "text"]),
}


@pytest.mark.parametrize("name", STEPS)
def test_a_large_batch_takes_little_memory(spark, name):
    step, columns = STEPS[name]
    run, n = step(Captured()), 2000
    texts = pa.array([" ".join(str((i * 31 + j * j) % 9973) for j in range(400)) for i in range(n)])  # about 4 MB
    batch = pa.RecordBatch.from_arrays([texts if c == "text" else pa.array(range(n), pa.int64()) for c in columns], columns)
    for _ in run(iter([batch.slice(0, 2)])):  # loads what is kept
        pass
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in run(iter([batch]))) >= n
        assert tracemalloc.get_traced_memory()[1] < 110e6
    finally:
        tracemalloc.stop()
