import pyarrow as pa


def batches(partition, partitions):
    yield pa.RecordBatch.from_pydict({"i": pa.array([partition, partition + 10], pa.int64()), "s": ["a", "b"]})
