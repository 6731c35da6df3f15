"""A data source in Python over Parquet tables, for batch and streams, and its sink.

Reading: a partition is a row group of a file. Filters are pushed down: a row group whose statistics rule a filter out is no
partition at all, and rows that a filter drops never leave the reader. As a stream, the offset is the number of row groups
read, in order of files; new files come after those there are. Writing: tasks write files of their own; the rows are there
when the job's commit has written the list of its files, and files of failed tasks and jobs are deleted or never listed.

Paths are what pyarrow's file systems take; driver and executors must both reach them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

NAME, COMMITTED = "row_groups", "_committed"
_COMPARED = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The Parquet files of a path, in the order of their commits and names. A folder with commits has what they list."""
    system, at = _opened(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.is_file)
    commits = [n for n in names if n.rpartition("/")[2].startswith(COMMITTED)]
    if not commits:
        return [n for n in names if n.endswith(".parquet")]
    return [f"{at}/{n}" for c in commits for n in json.loads(system.open_input_stream(c).readall())]


@dataclass
class RowGroup(InputPartition):
    file: str
    group: int

    def __init__(self, file: str, group: int):
        super().__init__(group)
        self.file, self.group = file, group


def _groups(path: str) -> list[RowGroup]:
    system, _ = _opened(path)
    return [RowGroup(f, g) for f in _files(path) for g in range(pq.read_metadata(f, filesystem=system).num_row_groups)]


@dataclass(frozen=True)
class _Condition:
    """A pushed filter: on a column's statistics, and on rows."""

    column: str
    kind: str
    value: Any

    def possible(self, low: Any, high: Any) -> bool:
        if self.kind == "in":
            return any(low <= v <= high for v in self.value)
        return {"==": lambda: low <= self.value <= high, ">": lambda: high > self.value, ">=": lambda: high >= self.value, "<": lambda: low < self.value, "<=": lambda: low <= self.value}[self.kind]()

    def expression(self) -> pc.Expression:
        x = pc.field(self.column)
        if self.kind == "in":
            return x.isin(list(self.value))
        if self.kind == "not null":
            return x.is_valid()
        return {"==": x == self.value, ">": x > self.value, ">=": x >= self.value, "<": x < self.value, "<=": x <= self.value}[self.kind]


def _read(path: str, part: RowGroup, conditions: list[_Condition], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    system, _ = _opened(path)
    with pq.ParquetFile(part.file, filesystem=system) as file:
        for batch in file.iter_batches(row_groups=[part.group]):
            for c in conditions:
                batch = pa.Table.from_batches([batch]).filter(c.expression()).combine_chunks().to_batches()
                batch = batch[0] if batch else None
                if batch is None:
                    break
            if batch is not None and len(batch):
                yield batch.select(types.names).cast(types)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: Any):
        self.path, self.conditions = path, []
        self.types = to_arrow_schema(schema)
        self.plain = {f.name for f in self.types if not pa.types.is_nested(f.type) and not pa.types.is_floating(f.type)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in self.plain:
                yield f  # Spark's own filter stays
            elif type(f) in _COMPARED and f.value is not None:
                self.conditions.append(_Condition(column, _COMPARED[type(f)], f.value))
            elif isinstance(f, In) and None not in f.value:
                self.conditions.append(_Condition(column, "in", tuple(f.value)))
            elif isinstance(f, IsNotNull):
                self.conditions.append(_Condition(column, "not null", None))
            else:
                yield f

    def partitions(self) -> list[RowGroup]:
        system, _ = _opened(self.path)
        found = []
        for file in _files(self.path):
            meta = pq.read_metadata(file, filesystem=system)
            columns = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                if all(self._possible(meta.row_group(g).column(columns[c.column]).statistics, c) for c in self.conditions):
                    found.append(RowGroup(file, g))
        return found

    @staticmethod
    def _possible(statistics: Any, condition: _Condition) -> bool:
        if condition.kind == "not null" or statistics is None or not statistics.has_min_max:
            return statistics is None or condition.kind != "not null" or statistics.null_count is None or statistics.num_values > 0
        try:
            return condition.possible(statistics.min, statistics.max)
        except TypeError:  # statistics of another kind than the value
            return True

    def read(self, partition: RowGroup | None) -> Iterator[pa.RecordBatch]:
        # Spark asks once for None where there is no partition
        return _read(self.path, partition, self.conditions, self.types) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: Any):
        self.path, self.types = path, to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"groups": 0}

    def latestOffset(self) -> dict:
        return {"groups": len(_groups(self.path))}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        return _groups(self.path)[start["groups"] : end["groups"]]

    def read(self, partition: RowGroup | None) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, [], self.types) if partition else iter(())

    def commit(self, end: dict) -> None:
        """Files stay: others may read them."""


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        name, rows, out = f"{self.job}-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in batches:
                out = out or pq.ParquetWriter(f"{at}/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += len(batch)
        except BaseException:
            if out:
                out.close()
                system.delete_file(f"{at}/{name}")
            raise
        if out:
            out.close()
        return _Written(name if out else "", rows)

    def _of_this_job(self) -> dict[str, str]:
        system, at = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return {f.path.rpartition("/")[2]: f.path for f in found if f.path.rpartition("/")[2].startswith(self.job)}

    def commit(self, messages: list[_Written | None]) -> None:
        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        names = sorted(m.name for m in messages if m and m.name)
        for name, path in self._of_this_job().items():  # what attempts of tasks left that didn't count
            if name not in names:
                system.delete_file(path)
        earlier = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.rpartition("/")[2].startswith(COMMITTED))
        number = int(earlier[-1].rpartition("-")[2]) + 1 if earlier else 0
        old = [n for c in earlier for n in json.loads(system.open_input_stream(c).readall())] if self.overwrite else []
        with system.open_output_stream(f"{at}/.{self.job}") as out:
            out.write(json.dumps(names).encode())
        system.move(f"{at}/.{self.job}", f"{at}/{COMMITTED}-{number:012d}")  # from now on the rows are there
        if self.overwrite:
            for c in earlier:
                system.delete_file(c)
            for n in old:
                system.delete_file(f"{at}/{n}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _opened(self.path)
        for path in self._of_this_job().values():
            system.delete_file(path)


class RowGroups(DataSource):
    """`format("row_groups")`: load(path), as a stream too, and save(path) in modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> Any:
        system, _ = _opened(self.options["path"])
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Parquet file in {self.options['path']}")
        return from_arrow_schema(pq.read_schema(files[0], filesystem=system).remove_metadata(), prefer_timestamp_ntz=True)

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], schema)

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def use(spark: SparkSession) -> None:
    """Registers the source in a session and lets Spark push filters to Python sources."""
    spark.dataSource.register(RowGroups)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_row_groups(spark: SparkSession, path: str) -> DataFrame:
    use(spark)
    return spark.read.format(NAME).load(path)
