"""The journal as a streaming source: offsets are event ids, and only the days between two offsets are read.

    spark.dataSource.register(JournalSource)
    spark.readStream.format("journal").schema(DDL).option("path", "/data/journal").option("after", an_id).load()

A batch holds the events with ids after one offset, up to another. A task reads one file and hands its rows on as Arrow batches. The
folder is opened with pyarrow's file systems (local and mounted paths, hdfs, s3, gs).
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, TimestampType

from skarn.operators.journal import millis_of


def day_of(event_id: str) -> str:
    return dt.datetime.fromtimestamp(millis_of(event_id) / 1000, dt.UTC).strftime("%Y-%m-%d")


class Files(InputPartition):
    def __init__(self, path: str, after: str, upto: str):
        self.path, self.after, self.upto = path, after, upto


class JournalReader(DataSourceStreamReader):
    """Offsets: {"id": the last event read}, empty before the first."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.after, self.names = options["path"], options.get("after", ""), schema.names
        self.kinds = {f.name: pa.timestamp("us", "UTC") if isinstance(f.dataType, TimestampType) else to_arrow_type(f.dataType) for f in schema.fields}

    def _days(self) -> list[str]:
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.startswith("day="))

    def _files(self, folder: str) -> list[str]:
        fs = self._fs()
        return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and f.base_name.endswith(".parquet"))

    def _fs(self):
        return pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()

    def initialOffset(self) -> dict:
        return {"id": self.after}

    def latestOffset(self) -> dict:
        """The greatest id: from the files' statistics of the newest day that has events."""
        fs = self._fs()
        for folder in reversed(self._days()):
            greatest = ""
            for path in self._files(folder):
                meta = pq.read_metadata(path, filesystem=fs)
                at = meta.schema.to_arrow_schema().names.index("id")
                for g in range(meta.num_row_groups):
                    stats = meta.row_group(g).column(at).statistics
                    most = stats.max if stats is not None and stats.has_min_max else pc.max(pq.read_table(path, columns=["id"], filesystem=fs)["id"]).as_py()
                    greatest = max(greatest, most or "")
            if greatest:
                return {"id": max(greatest, self.after)}
        return {"id": self.after}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (day_of(start["id"]) if start["id"] else ""), (day_of(end["id"]) if end["id"] else "")
        if start["id"] >= end["id"]:
            return []
        return [Files(f, start["id"], end["id"]) for folder in self._days() if first <= folder.rpartition("day=")[2] <= last for f in self._files(folder)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        wanted = (ds.field("id") > partition.after) & (ds.field("id") <= partition.upto)
        data = ds.dataset(partition.path, filesystem=self._fs(), format="parquet")
        there = [c for c in self.names if c in data.schema.names]  # a file of other events may lack some fields
        for batch in data.to_batches(columns=there, filter=wanted):
            if batch.num_rows:
                columns = {c: batch.column(c).cast(kind, safe=False) if c in there else pa.nulls(batch.num_rows, kind) for c, kind in self.kinds.items()}
                yield pa.RecordBatch.from_pydict(columns)

    def commit(self, end: dict) -> None:
        """Nothing is kept beside the query's own checkpoint."""


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return JournalReader(self.options, schema)
