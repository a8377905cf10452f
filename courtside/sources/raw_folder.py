"""Raw documents in a folder, one a line, by tournament and day: a sink, and a data source that reads only the tournaments and days asked for.

The layout is <root>/tournament=<name>/day=<date>/<files>; a missing name or day has Spark's own name for it. The source has a fixed schema, and takes
equality, membership, ranges and null checks of tournament and day from the plan, so that other folders are neither listed nor opened. Other filters stay with Spark.
"""
from __future__ import annotations

import datetime
import io
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

SCHEMA = "tournament string, day date, file string, body string"
#: Fixed value: Spark's name of a folder whose value is null.
MISSING = "__HIVE_DEFAULT_PARTITION__"
#: Files of a day are read by one task up to so many bytes; rows go to Spark in batches of so many characters or lines.
SPLIT, BATCH_CHARS, BATCH_LINES = 128 << 20, 4 << 20, 4096


def write_bodies(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes (tournament, day, body): JSON bodies, whose line ends are only space between tokens and become blanks. Days are spread by size, so a day that holds much of all rows is many files and tasks; null bodies become empty lines."""
    lines = rows.select("tournament", "day", F.translate(F.coalesce("body", F.lit("")), "\r\n", "  ").alias("value"))
    lines.hint("rebalance", "tournament", "day").write.mode(mode).partitionBy("tournament", "day").text(path)


def _holds(f: Filter, value) -> bool:
    """Whether a filter takes a value; comparisons never take null."""
    match f:
        case IsNull():
            return value is None
        case EqualNullSafe():
            return value == f.value
        case _ if value is None:
            return False
        case IsNotNull():
            return True
        case EqualTo():
            return value == f.value
        case In():
            return value in f.value
        case GreaterThan():
            return value > f.value
        case GreaterThanOrEqual():
            return value >= f.value
        case LessThan():
            return value < f.value
        case LessThanOrEqual():
            return value <= f.value


TAKEN = (IsNull, IsNotNull, EqualNullSafe, EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


@dataclass
class Day(InputPartition):
    """Files of one tournament and day."""

    tournament: str | None
    day: datetime.date | None
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.filters = root, {"tournament": [], "day": []}

    def pushFilters(self, filters):  # noqa: N802 (Spark's name)
        for f in filters:
            own = isinstance(f, TAKEN) and len(f.attribute) == 1 and self.filters.get(f.attribute[0])
            if own is None or own is False:
                yield f
            else:
                own.append(f)

    def _folders(self, fs, at: str, column: str, value_of):
        """(value, path) of the folders of a column that its filters take."""
        from pyarrow.fs import FileSelector, FileType

        for x in sorted(fs.get_file_info(FileSelector(at)), key=lambda x: x.path):
            if x.type == FileType.Directory and x.base_name.startswith(f"{column}="):
                text = unquote(x.base_name.split("=", 1)[1])
                value = None if text == MISSING else value_of(text)
                if all(_holds(f, value) for f in self.filters[column]):
                    yield value, x.path

    def partitions(self):
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, root = FileSystem.from_uri(self.root)
        out = []
        for tournament, at in self._folders(fs, root, "tournament", str):
            for day, path in self._folders(fs, at, "day", datetime.date.fromisoformat):
                files = sorted((x.path, x.size) for x in fs.get_file_info(FileSelector(path)) if x.type == FileType.File and x.base_name[0] not in "._")
                task, size = [], 0
                for name, n in files:
                    if task and size + n > SPLIT:
                        out.append(Day(tournament, day, task))
                        task, size = [], 0
                    task.append(name)
                    size += n
                if task:
                    out.append(Day(tournament, day, task))
        return out or [Day(None, None, [])]

    def read(self, partition: Day):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.root)
        schema = pa.schema([("tournament", pa.string()), ("day", pa.date32()), ("file", pa.string()), ("body", pa.string())])

        def batch(name, lines):
            n = len(lines)
            return pa.RecordBatch.from_arrays([pa.array([x] * n, t) for x, t in ((partition.tournament, pa.string()), (partition.day, pa.date32()), (name, pa.string()))] + [pa.array(lines, pa.string())], schema=schema)

        for path in partition.files:
            name, lines, chars = path.rsplit("/", 1)[-1], [], 0
            with io.TextIOWrapper(fs.open_input_stream(path), "utf-8", errors="replace", newline="\n") as text:
                for line in text:
                    lines.append(line.rstrip("\n"))
                    chars += len(line)
                    if chars >= BATCH_CHARS or len(lines) >= BATCH_LINES:
                        yield batch(name, lines)
                        lines, chars = [], 0
            if lines:
                yield batch(name, lines)


class RawFolder(DataSource):
    """Format `raw_folder`; its one option is the path, a URI of any file system that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return "raw_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_raw(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """tournament, day, file, body of a folder that write_bodies wrote, or (kind `table`) of a Parquet table of the same columns.

    The kind is the session's `courtside.documents` unless given, and `folder` where that isn't set. In both, filters of tournament and day reach the scan.
    """
    kind = kind or spark.conf.get("courtside.documents", "folder")
    if kind == "table":
        return spark.read.parquet(path).select("tournament", "day", "file", "body")
    if kind != "folder":
        raise ValueError(f"courtside.documents is folder or table, not {kind}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawFolder)
    return spark.read.format("raw_folder").load(path)


def slice_of(rows: DataFrame, since: datetime.date | None = None, until: datetime.date | None = None, tournaments: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Documents from `since` to `until` (both included) of some tournaments; limit: only so many, the newest days first, then by tournament and body."""
    if since is not None:
        rows = rows.where(F.col("day") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("day") <= F.lit(until))
    if tournaments is not None:
        rows = rows.where(F.col("tournament").isin(tournaments))
    return rows if limit is None else rows.orderBy(F.desc("day"), "tournament", "body").limit(limit)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV files with a header of these columns in this order; quotes are doubled, empty text and null stay apart."""
    rows.select(*columns).write.option("header", True).option("escape", '"').option("emptyValue", '""').option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of write_csv; a file whose header is not the schema's is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').option("emptyValue", "").option("nullValue", None).csv(path)
