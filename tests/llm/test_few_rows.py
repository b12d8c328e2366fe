import pyarrow as pa

from stridegrid.llm.common import ROWS_AT_ONCE, few_rows, trimmed


def test_batches_are_worked_on_in_few_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([[i] * (i % 3) for i in range(1000)])], names=["x"])
    parts = list(few_rows(iter([batch])))
    assert max(p.num_rows for p in parts) == ROWS_AT_ONCE and [v for p in parts for v in p.column("x").to_pylist()] == batch.column("x").to_pylist()
    assert [b.num_rows for b in trimmed(few_rows)(iter([batch]))] == [p.num_rows for p in parts]
