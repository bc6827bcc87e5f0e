"""A stream over a table's Parquet files: rows in the order of the files, a bounded number in each batch, dealt over many tasks.

An offset is a number of rows from the first.  A batch is the rows between two offsets, cut into slices that tasks read by row
groups; the driver reads the files' footers and no rows.

    spark.readStream.format("brindle_feed").schema(...).option("rowsPerBatch", ...).option("rowsPerTask", ...).load(path)

A source isn't told where a restarted stream stood, and this one mustn't begin again: with the option `checkpoint`, the stream's
checkpoint folder, it goes on behind the last offset that the stream's own log has.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from brindle.sources.parts import filesystem, names_in


class Rows(InputPartition):
    """Rows first to last - 1 of a file."""

    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


def logged_offset(checkpoint: str, source: int) -> int:
    """The furthest offset that a stream's log has for a source; 0 for a new stream."""
    fs, where = filesystem(checkpoint)
    batches = [x for x in names_in(fs, f"{where}/offsets") if x.rsplit("/", 1)[1].isdigit()]
    if not batches:
        return 0
    last = max(batches, key=lambda x: int(x.rsplit("/", 1)[1]))
    lines = fs.open_input_stream(last).read().decode().split("\n")[2:]  # behind the version and the batch's settings
    return json.loads(lines[source])["rows"] if source < len(lines) and lines[source] != "-" else 0


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema):
        import pyarrow.parquet as pq

        self.uri, self.schema = options["path"], schema
        fs, where = filesystem(self.uri)
        self.files = [x for x in names_in(fs, where) if x.endswith(".parquet")]
        self.ends = list(accumulate(pq.read_metadata(x, filesystem=fs).num_rows for x in self.files))
        self.batch, self.task = int(options["rowsPerBatch"]), int(options.get("rowsPerTask", 1 << 17))
        self.at = logged_offset(options["checkpoint"], int(options.get("source", 0))) if "checkpoint" in options else 0

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        """Asked for once before each batch."""
        self.at = min(self.at + self.batch, self.ends[-1] if self.ends else 0)
        return {"rows": self.at}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        self.at, out, row = max(self.at, end["rows"]), [], start["rows"]
        while row < end["rows"]:
            k = bisect_right(self.ends, row)
            before = self.ends[k - 1] if k else 0
            upto = min(end["rows"], self.ends[k], row + self.task)
            out.append(Rows(self.files[k], row - before, upto - before))
            row = upto
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = filesystem(self.uri)
        schema, first, last = to_arrow_schema(self.schema), partition.first, partition.last
        with pq.ParquetFile(partition.path, filesystem=fs) as file:
            ends = list(accumulate(file.metadata.row_group(g).num_rows for g in range(file.num_row_groups)))
            groups = [g for g, end in enumerate(ends) if end > first and (ends[g - 1] if g else 0) < last]
            at = ends[groups[0] - 1] if groups and groups[0] else 0
            for batch in file.iter_batches(row_groups=groups, columns=schema.names):
                part = batch.slice(max(0, first - at), max(0, min(batch.num_rows, last - at) - max(0, first - at)))
                at += batch.num_rows
                if part.num_rows:
                    yield pa.Table.from_batches([part.select(schema.names)]).cast(schema).combine_chunks().to_batches()[0]

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brindle_feed"

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
