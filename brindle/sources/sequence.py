"""A source written in Python: arithmetic sequences."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Piece(InputPartition):
    def __init__(self, start: int, end: int, step: int):
        super().__init__((start, end, step))
        self.start, self.end, self.step = start, end, step


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.count, self.step, self.parts = int(options.get("count", 0)), int(options.get("step", 1)), int(options.get("parts", 4))

    def partitions(self) -> list[Piece]:
        edges = [self.count * i // self.parts for i in range(self.parts + 1)]
        return [Piece(a, b, self.step) for a, b in zip(edges, edges[1:])]

    def read(self, partition: Piece) -> Iterator[tuple[int, int]]:
        for i in range(partition.start, partition.end):
            yield i, i * partition.step


class SequenceSource(DataSource):
    """spark.read.format("sequence").option("count", 10).option("step", 3).load()"""

    @classmethod
    def name(cls) -> str:
        return "sequence"

    def schema(self) -> str:
        return "i bigint, value bigint"

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SequenceSource)
