"""A source and sink written in Python: Parquet parts that a manifest makes visible.

Each task writes one part under a name of its own.  Only when all tasks have ended does the driver write a manifest with the
names of the parts, and only what a manifest names is read: a failed task, a failed write or a task that runs twice leaves
nothing that can be seen, and remove_unseen() deletes what such tasks left.  A stream's manifest has the number of its batch, so that a batch that is run again takes the place of
what it wrote before: each batch counts once.

    df.write.format("brindle_parts").mode("append").save(path)
    spark.read.format("brindle_parts").schema(df.schema).load(path)
    stream.writeStream.format("brindle_parts").option("path", path).option("checkpointLocation", ...).start()
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

MANIFESTS = "_manifests"


def filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else FileSystem.from_uri("file://" + uri)


def names_in(fs, folder: str) -> list[str]:
    from pyarrow.fs import FileSelector

    return sorted(x.path for x in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if x.is_file)


def manifests(fs, where: str) -> list[str]:
    return [x for x in names_in(fs, f"{where}/{MANIFESTS}") if x.endswith(".json")]


def remove_unseen(path: str) -> int:
    """Deletes parts that no manifest names, as killed tasks leave them; how many.  Not while something writes there."""
    fs, where = filesystem(path)
    seen = {p["name"] for m in manifests(fs, where) for p in json.loads(fs.open_input_stream(m).read())}
    unseen = [x for x in names_in(fs, where) if x.rsplit("/", 1)[1] not in seen]
    for x in unseen:
        fs.delete_file(x)
    return len(unseen)


@dataclass
class Part(WriterCommitMessage):
    """What a task tells the driver: the name of its file, and no rows."""

    name: str
    rows: int


class Slice(InputPartition):
    """Some row groups of a part."""

    def __init__(self, path: str, groups: list[int]):
        super().__init__((path, groups))
        self.path, self.groups = path, groups


class PartsWriting:
    """What the writers of tables and of streams share.  Tasks get a copy of it."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        import pyarrow.parquet as pq

        fs, where = filesystem(self.path)
        fs.create_dir(where, recursive=True)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in batches:
                out = out or pq.ParquetWriter(f"{where}/{name}", batch.schema, filesystem=fs)
                out.write_batch(batch)
                rows += batch.num_rows
            if out:
                out.close()
        except BaseException:
            if out:
                fs.delete_file(f"{where}/{name}")
            raise
        return Part(name if out else "", rows)

    def publish(self, manifest: str, messages: list[Part | None]) -> None:
        fs, where = filesystem(self.path)
        fs.create_dir(f"{where}/{MANIFESTS}", recursive=True)
        parts = [{"name": m.name, "rows": m.rows} for m in messages if m and m.name]
        new = f"{where}/{MANIFESTS}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as out:
            out.write(json.dumps(parts).encode())
        earlier = manifests(fs, where) if self.overwrite else []
        fs.move(new, f"{where}/{MANIFESTS}/{manifest}.json")  # from here on the parts can be seen
        for path in earlier:
            gone = json.loads(fs.open_input_stream(path).read())
            fs.delete_file(path)
            for part in gone:
                fs.delete_file(f"{where}/{part['name']}")

    def remove(self, messages: list[Part | None]) -> None:
        fs, where = filesystem(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{where}/{m.name}")


class PartsWriter(PartsWriting, DataSourceArrowWriter):
    def commit(self, messages: list[Part | None]) -> None:
        self.publish(f"write-{uuid.uuid4().hex}", messages)

    def abort(self, messages: list[Part | None]) -> None:
        self.remove(messages)


class PartsStreamWriter(PartsWriting, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Part | None], batchId: int) -> None:
        self.publish(f"batch-{batchId:012d}", messages)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        self.remove(messages)


class PartsReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.path, self.schema, self.rows = options["path"], schema, int(options.get("rowsPerTask", 1 << 20))

    def partitions(self) -> list[Slice]:
        import pyarrow.parquet as pq

        fs, where = filesystem(self.path)
        out = []
        for path in manifests(fs, where):
            for part in json.loads(fs.open_input_stream(path).read()):
                own, held = [], 0
                about = pq.read_metadata(f"{where}/{part['name']}", filesystem=fs)  # of a file, not its rows
                for g in range(about.num_row_groups):
                    own.append(g)
                    held += about.row_group(g).num_rows
                    if held >= self.rows or g == about.num_row_groups - 1:
                        out.append(Slice(part["name"], own))
                        own, held = [], 0
        return out or [Slice("", [])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        fs, where = filesystem(self.path)
        schema = to_arrow_schema(self.schema)
        with pq.ParquetFile(f"{where}/{partition.path}", filesystem=fs) as file:
            for batch in file.iter_batches(row_groups=partition.groups, columns=schema.names):
                yield batch.select(schema.names).cast(schema)


class PartsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brindle_parts"

    def reader(self, schema) -> PartsReader:
        return PartsReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> PartsStreamWriter:
        return PartsStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PartsSource)
