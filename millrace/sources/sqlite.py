"""Tables of SQLite files, read by many tasks.

``spark.read.format("sqlite").option("path", ..).option("table", ..)``. Options: ``rows_per_task`` (100,000),
``columns`` (comma-joined, all). The driver and the executors open the file, read-only, at the same path.

A table is cut by ranges of rowid, whatever gaps they have, and each task asks for its range alone. Comparisons, nulls and
beginnings of texts that a query filters by are pushed into what SQLite is asked; texts compare by bytes there as they do in Spark.

Defined results: SQLite lets any value be in any column; texts are taken for numbers only if the column holds numbers, and a value
that its column's kind can't hold is an error that names the row; a table without rowid, or a view, is one task; an empty table
gives no row; nulls are nulls.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
ARROW = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path.removeprefix('file:'))}?mode=ro&immutable=1", uri=True)


def kind_of(declared: str) -> str:
    """The column's kind by the words of its declaration, as SQLite itself decides its affinity."""
    up = declared.upper()
    if "INT" in up:
        return "long"
    if any(w in up for w in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return "string"
    if not up or "BLOB" in up:
        return "binary" if up else "string"
    return "double"


@dataclass
class Range(ds.InputPartition):
    """Rows whose rowid is from ``first`` to ``last``; all of them if there is no rowid."""

    first: int | None
    last: int | None


class SqliteReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.rows = int(options.get("rows_per_task", 100_000))
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes what SQLite decides as Spark does, and gives back the rest."""
        kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        for f in filters:
            asked = self._asked(f, kinds)
            if asked is None:
                yield f
            else:
                self.where.append(asked[0])
                self.values += asked[1]

    @staticmethod
    def _asked(f: ds.Filter, kinds: dict[str, str]) -> tuple[str, list] | None:
        path = getattr(f, "attribute", ())
        if len(path) != 1 or kinds.get(path[0]) not in ("bigint", "string"):
            return None  # numbers with a fraction may be kept as texts or whole numbers
        name = quoted(path[0]) + (" collate binary" if kinds[path[0]] == "string" else "")
        plain = lambda v: isinstance(v, (int, str)) and not isinstance(v, bool)
        if type(f) in COMPARED and plain(f.value):
            return f"{name} {COMPARED[type(f)]} ?", [f.value]
        if isinstance(f, ds.In) and all(map(plain, f.value)) and len(f.value) < 500:
            return f"{name} in ({', '.join('?' * len(f.value))})", list(f.value)
        if isinstance(f, ds.IsNull):
            return f"{quoted(path[0])} is null", []
        if isinstance(f, ds.IsNotNull):
            return f"{quoted(path[0])} is not null", []
        if isinstance(f, ds.StringStartsWith):
            return f"substr({quoted(path[0])}, 1, {len(f.value)}) = ? collate binary", [f.value]
        return None

    def partitions(self) -> list[ds.InputPartition]:
        with opened(self.path) as db:
            try:
                first, last = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Range(None, None)]
            if first is None:
                return [Range(0, -1)]
            if not isinstance(first, int):
                return [Range(None, None)]  # a view has no numbers
            n = db.execute(f"select count(*) from {quoted(self.table)}").fetchone()[0]
        tasks = max(1, -(-n // self.rows))
        step = -(-(last - first + 1) // tasks)
        return [Range(at, min(at + step - 1, last)) for at in range(first, last + 1, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema]
        where, values = list(self.where), list(self.values)
        if partition.first is not None:
            where.append("rowid between ? and ?")
            values += [partition.first, partition.last]
        text = f"select {', '.join(map(quoted, names))} from {quoted(self.table)}" + (f" where {' and '.join(where)}" if where else "")
        kinds = {"bigint": "long"}
        with opened(self.path) as db:
            rows = db.execute(text, values)
            while some := rows.fetchmany(10_000):
                columns = []
                for k, field in enumerate(self.schema):
                    kind = field.dataType.simpleString()
                    columns.append(_column([r[k] for r in some], kinds.get(kind, kind), field.name))
                yield pa.RecordBatch.from_arrays(columns, names)


def _column(values: list, kind: str, name: str) -> pa.Array:
    if kind == "string":
        values = [v if v is None or isinstance(v, str) else v.decode() if isinstance(v, bytes) else str(v) for v in values]
    elif kind == "binary":
        values = [v.encode() if isinstance(v, str) else v for v in values]
    elif kind == "double":
        values = [float(v) if isinstance(v, int) else v for v in values]
    wrong = next((v for v in values if v is not None and not isinstance(v, {"string": str, "binary": bytes, "double": float, "long": int}[kind])), None)
    if wrong is not None:
        raise ValueError(f"column {name} holds {wrong!r}, which is no {kind}")
    return pa.array(values, ARROW[kind])


class SqliteSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        with opened(self.options["path"]) as db:
            held = db.execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        if not held:
            raise ValueError(f"no table {self.options['table']}")
        spark = {"long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(), "string": T.StringType()}
        every = {name: T.StructField(name, spark[kind_of(declared or "")]) for _, name, declared, *_ in held}
        return T.StructType([every[c] for c in wanted or every])

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return SqliteReader(dict(self.options), schema)


def snapshot(spark: SparkSession, path: str, table: str, columns: tuple[str, ...] = (), rows_per_task: int = 100_000):
    """A table of a SQLite file as a DataFrame."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("table", table).option("rows_per_task", rows_per_task)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()
