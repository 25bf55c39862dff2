"""A data source of its own for two exchange formats: `larkspur_csv`, semicolon-separated quoted text with an exact header, and `larkspur_json`, an array
of objects with the headers that a server should send along.

    register(spark)
    spark.read.format("larkspur_csv").schema("id long, name string").load(folder)
    df.write.format("larkspur_json").option("maxAge", 300).mode("overwrite").save(folder)

Reading: each file is a partition, streamed record by record (a quoted field may hold separators, quotes and line ends) and handed on in batches of bounded
bytes. With the option `pushdown`,
comparisons of a column with a value are tested on a record before it leaves the reader. Spark 4.1 keeps the
files and the pushed filters of its first use with what was loaded: load anew after a write, and, with this option, for other filters. Writing: tasks write parts under a name of their attempt;
the driver's commit gives those that count their final names and writes the manifest last, so a reader sees all of a write or nothing. An aborted write
removes its parts. Files are reached through Arrow's file systems, so paths may be local, HDFS or object stores.
"""

from __future__ import annotations

import csv
import dataclasses
import datetime
import decimal
import hashlib
import io
import json
import operator
import uuid
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

MANIFEST = "_manifest.json"
#: Characters of text and records that a batch of the reader holds, about. Spark's own batches of rows from Python are counted in rows only.
BATCH_CHARS, BATCH_ROWS = 2 << 20, 10_000
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def files_at(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def to_text(v) -> str:
    """A value as the formats write it; null is the empty field, and so are empty texts in CSV (JSON tells them apart)."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


def from_text(text, kind: T.DataType):
    """A field as a value of a column's type; empty and null fields are null."""
    if text is None or text == "":
        return None
    if isinstance(kind, T.BooleanType):
        return text if isinstance(text, bool) else {"true": True, "false": False}[text.lower()]
    if isinstance(kind, T.IntegralType):
        return int(text)
    if isinstance(kind, T.FractionalType):
        return decimal.Decimal(str(text)) if isinstance(kind, T.DecimalType) else float(text)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(text)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime.fromisoformat(text)
    return str(text)


@dataclasses.dataclass
class File(InputPartition):
    path: str


@dataclasses.dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int
    digest: str


class Reader(DataSourceReader):
    """The committed files of a folder, or one file."""

    def __init__(self, schema: T.StructType, options: dict):
        self.columns, self.path, self.tests = schema, options["path"].rstrip("/"), []

    def partitions(self) -> list[File]:
        system, at = files_at(self.path)
        if system.get_file_info(at).is_file:
            return [File(self.path)]
        with system.open_input_stream(f"{at}/{MANIFEST}") as f:
            return [File(f"{self.path}/{p}") for p in json.loads(f.read())["parts"]]

    def passes(self, row: tuple) -> bool:
        for i, f in self.tests:
            v = row[i]
            ok = v is None if isinstance(f, IsNull) else v is not None and (isinstance(f, IsNotNull) or (v in f.value if isinstance(f, In) else COMPARE[type(f)](v, f.value)))
            if not ok:
                return False
        return True

    def read(self, partition: File) -> Iterator:
        """Arrow batches of the records that pass."""
        system, at = files_at(partition.path)
        with system.open_input_stream(at) as raw:
            held, size = [], 0
            for row in self.records(raw, partition.path):
                if self.passes(row):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, str))
                    if size >= BATCH_CHARS or len(held) >= BATCH_ROWS:
                        yield self.batch(held)
                        held, size = [], 0
            if held:
                yield self.batch(held)

    def batch(self, rows: list[tuple]):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        zoned = [i for i, f in enumerate(self.columns) if isinstance(f.dataType, T.TimestampType)]  # times without a zone are of the machine's, as in rows
        columns = [[v and v.astimezone(datetime.timezone.utc) for v in c] if i in zoned else list(c) for i, c in enumerate(zip(*rows, strict=True))]
        return pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(self.columns))


class CsvReader(Reader):
    def records(self, raw, path: str) -> Iterator[tuple]:
        csv.field_size_limit(2**31 - 1)  # whole texts; the module's own limit is 131,072 characters
        rows = csv.reader(io.TextIOWrapper(io.BufferedReader(raw), "utf-8-sig", newline=""), delimiter=";", strict=True)
        header = next(rows, [])
        if header != self.columns.names:
            raise ValueError(f"{path}: columns are {header}, not {self.columns.names}")
        kinds = [f.dataType for f in self.columns]
        for n, row in enumerate(rows, 2):
            if len(row) != len(kinds):
                raise ValueError(f"{path}: record {n} has {len(row)} fields, not {len(kinds)}")
            yield tuple(from_text(x, k) for x, k in zip(row, kinds, strict=True))


class JsonReader(Reader):
    def records(self, raw, path: str) -> Iterator[tuple]:
        """One object per line between the brackets, as the writer leaves them. An empty text is a text, only null is none."""
        for line in io.TextIOWrapper(io.BufferedReader(raw), "utf-8"):
            line = line.strip().rstrip(",")
            if line not in ("[", "]", "[]", ""):
                held = json.loads(line)
                yield tuple(v if isinstance(f.dataType, T.StringType) and isinstance(v, str) else from_text(v, f.dataType) for f in self.columns for v in (held.get(f.name),))


class Pushed:
    """A reader that takes filters."""

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        names = {f.name: (i, f.dataType) for i, f in enumerate(self.columns)}
        for f in filters:
            at = names.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if at is None or isinstance(at[1], (T.FloatType, T.TimestampType)) or not isinstance(f, (*COMPARE, In, IsNull, IsNotNull)):
                yield f  # left to Spark
            else:
                self.tests.append((at[0], f))


class PushedCsvReader(Pushed, CsvReader):
    pass


class PushedJsonReader(Pushed, JsonReader):
    pass


class Writer(DataSourceWriter):
    """Parts, then final names, then the manifest."""

    suffix = ""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names, self.path, self.overwrite, self.options, self.run = schema.names, options["path"].rstrip("/"), overwrite, {k.lower(): v for k, v in options.items()}, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Part:
        system, at = files_at(self.path)
        system.create_dir(at, recursive=True)
        name = f"_{self.run}-{uuid.uuid4().hex}{self.suffix}"
        digest, n = hashlib.sha256(), 0
        with system.open_output_stream(f"{at}/{name}") as out:
            for n, text in self.lines(rows):  # noqa: B007
                data = text.encode()
                digest.update(data)
                out.write(data)
        return Part(name, n, digest.hexdigest())

    def commit(self, messages: list) -> None:
        system, at = files_at(self.path)
        old = self._held(system, at)
        parts, kept = [], [] if self.overwrite else old.get("parts", [])
        for i, m in enumerate(x for x in messages if x is not None):
            final = f"part-{self.run}-{i:05d}{self.suffix}"
            system.move(f"{at}/{m.path}", f"{at}/{final}")
            parts.append(final)
        manifest = {"parts": kept + parts, "rows": sum(m.rows for m in messages if m is not None) + (0 if self.overwrite else old.get("rows", 0))} | self.headers(messages)
        with system.open_output_stream(f"{at}/_next-{self.run}") as out:
            out.write(json.dumps(manifest).encode())
        system.move(f"{at}/_next-{self.run}", f"{at}/{MANIFEST}")
        for p in old.get("parts", []) if self.overwrite else []:
            system.delete_file(f"{at}/{p}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, at = files_at(self.path)
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.run}-"):
                system.delete_file(f.path)

    def _held(self, system, at: str) -> dict:
        if not system.get_file_info(f"{at}/{MANIFEST}").is_file:
            return {}
        with system.open_input_stream(f"{at}/{MANIFEST}") as f:
            return json.loads(f.read())

    def headers(self, messages: list) -> dict:
        return {}


class CsvWriter(Writer):
    suffix = ".csv"

    def lines(self, rows: Iterator) -> Iterator[tuple[int, str]]:
        def record(values: list) -> str:
            out = io.StringIO()
            csv.writer(out, delimiter=";", lineterminator="\r\n").writerow(values)
            return out.getvalue()

        yield 0, record(self.names)
        for n, row in enumerate(rows, 1):
            yield n, record([to_text(v) for v in row])


class JsonWriter(Writer):
    suffix = ".json"

    def lines(self, rows: Iterator) -> Iterator[tuple[int, str]]:
        yield 0, "["
        n = 0
        for n, row in enumerate(rows, 1):
            values = {c: v if v is None or isinstance(v, (bool, int, float, str)) else to_text(v) for c, v in zip(self.names, row, strict=True)}
            yield n, ("\n" if n == 1 else ",\n") + json.dumps(values, ensure_ascii=False)
        yield n, "\n]\n"

    def headers(self, messages: list) -> dict:
        """What a server should send with the parts: a tag that changes with the content, and how long caches may keep it."""
        tag = hashlib.sha256("".join(sorted(m.digest for m in messages if m is not None)).encode()).hexdigest()[:32]
        age, stale = int(self.options.get("maxage", 60)), int(self.options.get("stalewhilerevalidate", 0))
        return {"headers": {"content-type": "application/json; charset=utf-8", "etag": f'"{tag}"', "cache-control": f"public, max-age={age}" + (f", stale-while-revalidate={stale}" if stale else "")}}


class Csv(DataSource):
    reads, pushed, writes = CsvReader, PushedCsvReader, CsvWriter

    @classmethod
    def name(cls) -> str:
        return "larkspur_csv"

    def reader(self, schema: T.StructType) -> Reader:
        asked = next((v for k, v in self.options.items() if k.lower() == "pushdown"), "false")
        return (self.pushed if str(asked).lower() == "true" else self.reads)(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return self.writes(schema, self.options, overwrite)


class Json(Csv):
    reads, pushed, writes = JsonReader, PushedJsonReader, JsonWriter

    @classmethod
    def name(cls) -> str:
        return "larkspur_json"


def register(spark) -> None:
    """Make both formats known to a session, and let it push filters down to loads that ask for it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Csv, Json):
        spark.dataSource.register(source)
