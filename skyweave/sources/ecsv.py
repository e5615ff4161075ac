"""Tables of text whose header says names and types (A15): a data source `ecsv` that reads and writes them.

A file begins with comment lines that hold a version, `delimiter: ` where it is not a space, and one line for each
column, `- {name: ra, unit: deg, datatype: float64}`; a line of names follows, then rows. Fields with the delimiter, quotes or
nothing in them stand in double quotes; an empty field is null.

    spark.dataSource.register(EcsvSource)
    spark.read.format("ecsv").load(path); df.write.format("ecsv").mode("overwrite").save(folder)

A file is read in splits of bytes, so that a large one is shared by many tasks: a split has the lines that begin in it.
Paths must be files or folders that driver and executors share. `read_ecsv` reads the same files from any store that
Spark reads, by its own text scan.
"""

from __future__ import annotations

import csv
import glob
import os
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

SPLIT = 32 << 20
#: Types as headers name them (fixed values); unsigned ones take the next larger type.
TYPES = {
    "bool": BooleanType(), "int8": ByteType(), "uint8": ShortType(), "int16": ShortType(), "uint16": IntegerType(), "int32": IntegerType(),
    "uint32": LongType(), "int64": LongType(), "float32": FloatType(), "float64": DoubleType(), "string": StringType(),
}
_ENTRY = re.compile(r"""^-\s*\{(.*)\}\s*$""")
_PAIR = re.compile(r"""(\w+)\s*:\s*('(?:[^']|'')*'|"(?:[^"\\]|\\.)*"|[^,{}]+)""")


def parse_header(lines: list[str]) -> tuple[StructType, str]:
    """Schema and delimiter of the comment lines of a file."""
    fields, delimiter = [], " "
    for line in lines:
        text = line.lstrip("#").strip()
        entry = _ENTRY.match(text)
        if entry:
            told = {k: v.strip().strip("'\"") for k, v in _PAIR.findall(entry.group(1))}
            if told.get("datatype") not in TYPES:
                raise ValueError(f"no type for {told}")
            fields.append(StructField(told["name"], TYPES[told["datatype"]], True, {"unit": told["unit"]} if "unit" in told else {}))
        elif text.startswith("delimiter:"):
            delimiter = text.split(":", 1)[1].strip().strip("'\"") or " "
    if not fields:
        raise ValueError("no columns in the header")
    return StructType(fields), delimiter


def header(schema: StructType) -> str:
    names = {type(t): n for n, t in TYPES.items() if not n.startswith("u")}
    if any(type(f.dataType) not in names for f in schema.fields):
        raise ValueError("only flags, numbers and texts can be written")
    rows = [f"# - {{name: '{f.name}'{', unit: ' + repr(f.metadata['unit']) if 'unit' in f.metadata else ''}, datatype: {names[type(f.dataType)]}}}" for f in schema.fields]
    return "\n".join(["# %ECSV 1.0", "# ---", "# datatype:", *rows, " ".join(_quoted(f.name) for f in schema.fields), ""])


def _quoted(value) -> str:
    if value is None:
        return '""'
    text = repr(value) if isinstance(value, float) else str(value)
    if not text or re.search(r"""[\s"#]""", text):
        if "\n" in text or "\r" in text:
            raise ValueError("a field may not hold a line break")
        return '"' + text.replace('"', '""') + '"'
    return text


def _value(text: str, kind):
    if text == "":
        return None
    if isinstance(kind, BooleanType):
        return text.lower() in ("true", "1")
    if isinstance(kind, StringType):
        return text
    return float(text) if isinstance(kind, FloatType | DoubleType) else int(text)


def _local(path: str) -> str:
    """A path of this machine, of which Spark may have made file:/ or file:///."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _files(path: str) -> list[str]:
    path = _local(path)
    found = sorted(glob.glob(f"{path}/*.ecsv")) if os.path.isdir(path) else [path]
    if not found:
        raise ValueError(f"no files in {path}")
    return found


def _head(path: str) -> tuple[list[str], int]:
    """Comment lines, and the byte at which rows begin."""
    lines = []
    with open(path, "rb") as f:
        for line in f:
            if not line.startswith(b"#"):
                return lines, f.tell() if line.strip() else f.tell() + len(f.readline())
            lines.append(line.decode())
    return lines, os.path.getsize(path)


@dataclass
class Bytes(InputPartition):
    path: str
    begin: int
    end: int


class EcsvReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int):
        self.path, self.schema, self.split = path, schema, split

    def partitions(self):
        out = []
        for path in _files(self.path):
            begin, size = _head(path)[1], os.path.getsize(path)
            out += [Bytes(path, at, min(at + self.split, size)) for at in range(begin, size, self.split)]
        return out or [Bytes("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        lines, begin = _head(partition.path)
        held, delimiter = parse_header(lines)
        place = {f.name: k for k, f in enumerate(held.fields)}
        want = [(place[f.name], f.dataType) for f in self.schema.fields]

        def owned(f):
            f.seek(max(begin, partition.begin - 1))
            if partition.begin > begin:
                f.readline()  # the end of a line that began before
            while f.tell() < partition.end:
                line = f.readline()
                if line.strip():
                    yield line.decode()

        with open(partition.path, "rb") as f:
            for row in csv.reader(owned(f), delimiter=delimiter, skipinitialspace=delimiter == " "):
                yield tuple(_value(row[k], kind) for k, kind in want)


@dataclass
class Written(WriterCommitMessage):
    path: str


class EcsvWriter(DataSourceWriter):
    """A file for each task, under a name that is not read until the job is done."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = _local(path), schema, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        name = f"{self.path}/part-{task.partitionId():05d}-{self.job}.{task.taskAttemptId()}"
        with open(name, "w", encoding="utf-8") as f:
            f.write(header(self.schema))
            for row in iterator:
                f.write(" ".join(_quoted(v) for v in row) + "\n")
        return Written(name)

    def commit(self, messages):
        if self.overwrite:
            for old in glob.glob(f"{self.path}/*.ecsv"):
                os.remove(old)
        for m in messages:
            os.replace(m.path, m.path.rsplit(".", 1)[0] + ".ecsv")

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class EcsvSource(DataSource):
    @classmethod
    def name(cls):
        return "ecsv"

    def schema(self):
        return parse_header(_head(_files(self.options["path"])[0])[0])[0]

    def reader(self, schema):
        return EcsvReader(self.options["path"], schema, int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite):
        return EcsvWriter(self.options["path"], schema, overwrite)


def read_ecsv(spark: SparkSession, path: str) -> DataFrame:
    """The same tables by Spark's own scan: types from the header of the first file, rows by its CSV reader."""
    comments = spark.read.text(path).where("value LIKE '#%'").limit(10_000)  # a header, of a file's width
    schema, delimiter = parse_header(list(dict.fromkeys(r["value"] for r in comments.collect())))
    rows = spark.read.option("comment", "#").option("header", True).option("sep", delimiter).option("escape", '"').option("nullValue", "").schema(schema).csv(path)
    return rows
