"""Spark data sources for bar files: one CSV per symbol to write, landed files to read.

Both register under a name of their own.  Files are reached through ``pyarrow.fs``, so
a path may be a local or shared folder or any address that library knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, StructType

from tidemark.sources.sinks import file_symbol

FILE_COLUMN = "file_symbol"
ABOVE, BELOW = (GreaterThan, GreaterThanOrEqual, EqualTo), (LessThan, LessThanOrEqual, EqualTo)
PLAIN = (StringType, BooleanType, IntegralType, FloatType, DoubleType, DecimalType, DateType)
MOVES = 16  # files renamed at a time
TASK_BYTES, FILE_COST = 64 << 20, 1 << 18  # what a task reads, and what opening a file counts for
LANDED = "Symbol string, Date date, Open double, High double, Low double, Close double, Volume double"


def _files(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def _cell(value) -> str:
    if value is None:
        return ""
    text = str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def _texts(column) -> list[str]:
    """The cells of an Arrow column of a plain type; each value is spelled once, numbers of a fraction singly."""
    import pyarrow as pa

    if pa.types.is_floating(column.type):
        spelled = [repr(x) for x in column.fill_null(0.0).to_numpy(zero_copy_only=False).tolist()]
        if column.null_count:
            spelled = ["" if gone else x for x, gone in zip(spelled, column.is_null().to_pylist())]
        return spelled
    coded = column.dictionary_encode()
    values = [*map(_cell, coded.dictionary.to_pylist()), ""]
    return [values[i] for i in coded.indices.fill_null(len(values) - 1).to_pylist()]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SymbolFileWriter(DataSourceWriter):
    """Every task stages its files below a folder of this job; the commit renames them.

    Rows come grouped by file, so a task holds one open file and one row.  Attempts
    stage under names of their own: a failed or repeated task leaves nothing behind.
    """

    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.fieldNames()
        self.at = self.names.index(FILE_COLUMN)
        self.shown = [i for i in range(len(self.names)) if i != self.at]
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        return self._stage((row[self.at], ",".join(_cell(row[i]) for i in self.shown) + "\n") for row in rows)

    def _stage(self, runs: Iterable[tuple[str, str]]) -> Written:
        """Write lines that come with the name of their file."""
        system, root = _files(self.path)
        attempt = f"{root}/_staged-{self.job}/{uuid.uuid4().hex}"
        system.create_dir(attempt)
        header = ",".join(_cell(self.names[i]) for i in self.shown) + "\n"
        done: list[tuple[str, str]] = []
        current, out = None, None
        try:
            for name, lines in runs:
                if out is None or name != current:
                    if out is not None:
                        out.close()
                    current = name
                    staged = f"{attempt}/{len(done)}.csv"
                    out = system.open_output_stream(staged, buffer_size=1 << 20)
                    done.append((staged, f"{root}/{current}.csv"))
                    out.write(header.encode())
                out.write(lines.encode())
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        staged = f"{root}/_staged-{self.job}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _files(self.path)
        system.create_dir(root)
        targets = [t for m in messages if m is not None for _, t in m.files]
        if len(set(targets)) < len(targets):
            self._clear(system, root)
            raise ValueError("rows of one file came from several tasks; write through write_symbol_files")
        moves = (f for m in messages if m is not None for f in m.files)
        with ThreadPoolExecutor(MOVES) as pool:
            for _ in pool.map(lambda f: system.move(*f), moves):
                pass
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_files(self.path))


class SymbolBatchWriter(SymbolFileWriter, DataSourceArrowWriter):
    """The same files from Arrow batches, for plain types: a column is spelled at once, a file's rows are joined at once."""

    def write(self, batches: Iterator) -> Written:
        return self._stage(run for batch in batches for run in self._runs(batch))

    def _runs(self, batch) -> Iterator[tuple[str, str]]:
        import pyarrow.compute as pc

        if not batch.num_rows:
            return
        lines = list(map(",".join, zip(*[_texts(batch.column(i)) for i in self.shown])))
        files, start = pc.run_end_encode(batch.column(self.at)), 0
        for name, end in zip(files.values.to_pylist(), files.run_ends.to_pylist()):
            yield name, "\n".join(lines[start:end]) + "\n"
            start = end


class SymbolFiles(DataSource):
    """``format("symbol_files")``: one ``<symbol>.csv`` per value of ``file_symbol``."""

    @classmethod
    def name(cls) -> str:
        return "symbol_files"

    def writer(self, schema: StructType, overwrite: bool) -> SymbolFileWriter:
        plain = len(schema) > 1 and all(isinstance(f.dataType, PLAIN) for f in schema)
        return (SymbolBatchWriter if plain else SymbolFileWriter)(self.options["path"], schema)


def write_symbol_files(df: DataFrame, path: str, symbol: str = "Symbol", order: Sequence[str] = ("Date",)) -> None:
    """One CSV with header per symbol, named by the symbol without suffix and index mark.

    One file has one writer, so a symbol's rows meet in one task, where they are sorted
    (the sort spills) and streamed row by row; memory does not grow with the symbol.
    Symbols that share a file name share the file.  A null symbol raises; ``/`` in a
    name becomes ``_``.  A file of the same name is replaced, other files stay.
    """
    df.sparkSession.dataSource.register(SymbolFiles)
    named = F.replace(file_symbol(f"`{symbol}`"), F.lit("/"), F.lit("_"))
    checked = F.coalesce(named, F.raise_error("a symbol is null, its file has no name").cast("string"))
    out = df.withColumn(FILE_COLUMN, checked)
    out = out.repartition(FILE_COLUMN).sortWithinPartitions(FILE_COLUMN, *[F.col(f"`{c}`") for c in order])
    out.write.format("symbol_files").mode("append").save(path)


@dataclass
class LandedFiles(InputPartition):
    paths: list[str]


class LandedReader(DataSourceReader):
    """Lists ``<day>.csv`` files, keeps those the pushed day filters allow, deals them to tasks by size."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.lower: list[tuple[str, bool]] = []
        self.upper: list[tuple[str, bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Day bounds choose the files and are still applied to their rows by Spark."""
        for f in filters:
            if isinstance(f, (*BELOW, *ABOVE)) and f.attribute == ("Date",) and f.value is not None:
                day = str(f.value)[:10]
                if isinstance(f, ABOVE):
                    self.lower.append((day, isinstance(f, GreaterThan)))
                if isinstance(f, BELOW):
                    self.upper.append((day, isinstance(f, LessThan)))
            yield f

    def _wanted(self, day: str) -> bool:
        above = all(day > d if strict else day >= d for d, strict in self.lower)
        return above and all(day < d if strict else day <= d for d, strict in self.upper)

    def partitions(self) -> list[LandedFiles]:
        from pyarrow import fs

        system, root = _files(self.path)
        found = system.get_file_info(fs.FileSelector(root))
        kept = [f for f in found if f.is_file and f.base_name.endswith(".csv") and self._wanted(f.base_name[:-4])]
        parts, room = [LandedFiles([])], TASK_BYTES
        for f in sorted(kept, key=lambda f: f.base_name):
            cost = f.size + FILE_COST
            if cost > room and parts[-1].paths:
                parts.append(LandedFiles([]))
                room = TASK_BYTES
            parts[-1].paths.append(f"{root}/{f.base_name}")
            room -= cost
        return parts

    def read(self, partition: LandedFiles):
        import pyarrow as pa
        from pyarrow import csv
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self.schema)
        system, _ = _files(self.path)
        options = csv.ConvertOptions(
            column_types=target, include_columns=target.names, include_missing_columns=True, strings_can_be_null=True
        )
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                for batch in csv.open_csv(stream, convert_options=options):
                    yield pa.RecordBatch.from_arrays(batch.columns, schema=target)


class LandedBars(DataSource):
    """``format("landed_bars")``: a provider that delivers one file of bars per day."""

    @classmethod
    def name(cls) -> str:
        return "landed_bars"

    def schema(self) -> str:
        return LANDED

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(self.options["path"], schema)


def provider_scan(spark: SparkSession, path: str, provider: type[DataSource] = LandedBars, **options) -> DataFrame:
    """Bars of a provider, any registered data source; filters on ``Date`` reach its planning."""
    spark.dataSource.register(provider)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(provider.name()).options(**options).load(path)
