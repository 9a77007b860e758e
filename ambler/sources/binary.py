"""Binary edge files as a Spark data source: 12-byte little-endian records (int32, int32, float32).

A file is cut into ranges of whole records, a task each; a task reads its range in blocks and
decodes them by columns, so there is no Python object for an edge. A writer's task writes a file
under a hidden name, which the commit on the driver gives its own; files of tasks that are lost or
repeated are never seen. Stores are those that Arrow opens: local or shared folders, HDFS, S3, GCS.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "binary_edges"
RECORD_BYTES = 12
#: Records of a task's range, and of a block in memory.
PART_RECORDS, BLOCK_RECORDS = 1 << 22, 1 << 18


def arrow_opens(path: str) -> bool:
    return re.match(r"^(/|(file|hdfs|s3|gs|gcs):)", path) is not None


def _register() -> type[DataSource]:
    """The source's class, made here so that it travels to tasks by value."""

    def opened(path):
        from pyarrow import fs

        return (fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)) if re.match(r"^(/|file:)", path) else fs.FileSystem.from_uri(path)

    def record():
        import numpy as np

        return np.dtype([("src", "<i4"), ("dst", "<i4"), ("weight", "<f4")])

    class Range(InputPartition):
        def __init__(self, file, start, size):
            self.file, self.start, self.size = file, start, size

    class Message(WriterCommitMessage):
        def __init__(self, hidden, final):
            self.hidden, self.final = hidden, final

    class Reader(DataSourceReader):
        def __init__(self, path, records):
            self.path, self.records = path, records

        def partitions(self):
            from pyarrow import fs

            store, path = opened(self.path)
            info = store.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith((".", "_"))]
            broken = [f.path for f in files if f.size % RECORD_BYTES]
            if broken:
                raise ValueError(f"a last record is cut in {broken[0]}")
            each = self.records * RECORD_BYTES
            return [Range(f.path, at, min(each, f.size - at)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, each)] or [Range(None, 0, 0)]

        def read(self, partition):
            import numpy as np
            import pyarrow as pa

            if not partition.size:
                return
            store, _ = opened(self.path)
            with store.open_input_file(partition.file) as f:
                f.seek(partition.start)
                left = partition.size
                while left:
                    data = f.read(min(left, BLOCK_RECORDS * RECORD_BYTES))
                    left -= len(data)
                    e = np.frombuffer(data, record())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e["src"])), pa.array(np.ascontiguousarray(e["dst"])), pa.array(e["weight"].astype(np.float64))], ["src", "dst", "weight"])

    class Writer(DataSourceArrowWriter):
        def __init__(self, path, overwrite):
            self.path, self.overwrite = path, overwrite

        def write(self, iterator):
            import uuid

            import numpy as np

            store, path = opened(self.path)
            store.create_dir(path, recursive=True)
            name = f"part-{uuid.uuid4().hex}.data"
            with store.open_output_stream(f"{path}/.{name}") as f:
                for b in iterator:
                    e = np.empty(b.num_rows, record())
                    for k, c in enumerate(("src", "dst", "weight")):
                        e[c] = b.column(k).to_numpy(zero_copy_only=False)
                    f.write(e.tobytes())
            return Message(f"{path}/.{name}", f"{path}/{name}")

        def commit(self, messages):
            from pyarrow import fs

            store, path = opened(self.path)
            if self.overwrite:
                for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                    if f.is_file and not f.base_name.startswith("."):
                        store.delete_file(f.path)
            for m in messages:
                if m is not None:
                    store.move(m.hidden, m.final)

        def abort(self, messages):
            store, _ = opened(self.path)
            for m in messages:
                if m is not None:
                    store.delete_file(m.hidden)

    class BinaryEdges(DataSource):
        @classmethod
        def name(cls):
            return NAME

        def schema(self):
            return "src int, dst int, weight double"

        def reader(self, schema):
            return Reader(self.options["path"], int(self.options.get("records", PART_RECORDS)))

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], overwrite)

    return BinaryEdges


def register(spark: SparkSession) -> None:
    spark.dataSource.register(_register())
