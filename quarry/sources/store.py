"""Versioned Parquet tables and their catalogue.

A table is a list of immutable Parquet folders and files. Appending adds a folder; changing rows writes the files that
hold them anew and leaves the others. A statement takes effect when the catalogue's next revision, a JSON file with its
number in its name, is put in place by a rename that fails if the name is taken: of two sessions that begin with one
revision, one succeeds and the other has a conflict, and a crash leaves the old revision or the new one, never none.
A reader sees the folders of the catalogue that it loaded. Running transactions and statements leave a mark, and what is
younger than the oldest mark, or belongs to its revision, is no garbage. All files go through Spark's own file systems.
"""

from __future__ import annotations

import copy
import json
import re
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.lexer import SqlError

#: Hidden column: a number for each row, rising with insertion.
ROW = "_row"
#: Old revisions of the catalogue that stay, and the age in seconds at which a mark is that of a dead session.
REVISIONS, STALE = 20, 24 * 3600
#: File systems whose rename isn't atomic by itself (the local one, in tests) get help within a process.
_publishing = threading.Lock()


@dataclass
class Column:
    name: str
    declared: str
    nullable: bool = True
    default: str | None = None  # MySQL expression
    auto: bool = False
    on_update: str | None = None
    comment: str = ""
    collation: str | None = None


@dataclass
class Index:
    name: str
    columns: list[str]
    unique: bool = False
    primary: bool = False
    comment: str = ""


@dataclass
class ForeignKey:
    name: str
    columns: list[str]
    parent: str
    parent_columns: list[str]
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass
class Check:
    name: str
    text: str
    enforced: bool = True


@dataclass
class Table:
    name: str
    columns: list[Column]
    indexes: list[Index] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)
    next_row: int = 0
    next_auto: int = 1
    comment: str = ""
    external: str | None = None
    rows: int | None = None  # None where it was never counted

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SqlError(f"(1054) unknown column {name} in {self.name}")

    def keys(self) -> list[Index]:
        """Unique keys, the primary one first."""
        return sorted((i for i in self.indexes if i.unique), key=lambda i: not i.primary)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.declared)) for c in self.columns] + [T.StructField(ROW, T.LongType())])


@dataclass
class View:
    name: str
    sql: str
    columns: list[str] = field(default_factory=list)


def base_type(declared: str) -> str:
    return re.match(r"[A-Za-z]+\d?", declared.strip())[0].upper()


def arguments(declared: str) -> list[str]:
    m = re.search(r"\((.*)\)", declared, re.S)
    return [x.strip() for x in m[1].split(",")] if m else []


def spark_type(declared: str) -> T.DataType:
    kind = base_type(declared)
    if kind in ("TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER", "INT1", "INT2", "INT3", "INT4"):
        return T.IntegerType()
    if kind in ("BIGINT", "INT8", "SERIAL", "BIT", "YEAR"):
        return T.LongType()
    if kind in ("FLOAT", "DOUBLE", "REAL"):
        return T.DoubleType()
    if kind in ("DECIMAL", "NUMERIC", "DEC", "FIXED"):
        a = [int(x) for x in arguments(declared)] or [10]
        if a[0] > 38:
            raise SqlError("decimals have 38 digits at most here")
        return T.DecimalType(a[0], a[1] if len(a) > 1 else 0)
    if kind in ("BOOL", "BOOLEAN"):
        return T.BooleanType()
    if kind == "DATE":
        return T.DateType()
    if kind in ("DATETIME", "TIMESTAMP"):
        return T.TimestampNTZType()
    return T.StringType()


def declared_type(kind: T.DataType) -> str:
    """For columns that come from a query."""
    names = {T.IntegerType: "INT", T.ShortType: "INT", T.ByteType: "INT", T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.FloatType: "DOUBLE", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "DATETIME", T.TimestampType: "DATETIME"}
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    return names.get(type(kind), "TEXT")


def length_of(declared: str) -> int | None:
    """The most characters that a value may have."""
    kind, a = base_type(declared), arguments(declared)
    if kind in ("CHAR", "NCHAR"):
        return int(a[0]) if a else 1
    if kind in ("VARCHAR", "NVARCHAR", "CHARACTER", "NATIONAL", "BINARY", "VARBINARY"):
        return int(a[0]) if a else 255
    return None


class Catalogue:
    """Databases with their tables and views, as one statement or transaction sees them."""

    def __init__(self) -> None:
        self.revision = 0
        self.databases: dict[str, dict[str, Table | View]] = {}

    def copy(self) -> Catalogue:
        return copy.deepcopy(self)

    def found(self, database: str, name: str) -> Table | View | None:
        if database.lower() not in self.databases:
            raise SqlError(f"(1049) unknown database {database}")
        return self.databases[database.lower()].get(name.lower())

    def table(self, database: str, name: str) -> Table:
        t = self.found(database, name)
        if not isinstance(t, Table):
            raise SqlError(f"(1146) table {database}.{name} doesn't exist")
        return t

    def tables(self, database: str) -> list[Table]:
        return [t for t in self.databases[database.lower()].values() if isinstance(t, Table)]

    def to_json(self) -> str:
        told = {d: [{"kind": type(t).__name__, **asdict(t)} for t in ts.values()] for d, ts in self.databases.items()}
        return json.dumps({"revision": self.revision, "databases": told})

    @classmethod
    def from_json(cls, text: str) -> Catalogue:
        told, out = json.loads(text), cls()
        out.revision = told["revision"]
        for d, ts in told["databases"].items():
            held = out.databases[d] = {}
            for t in ts:
                kind = t.pop("kind")
                if kind == "View":
                    held[t["name"].lower()] = View(**t)
                    continue
                for part, made in (("columns", Column), ("indexes", Index), ("foreign", ForeignKey), ("checks", Check)):
                    t[part] = [made(**x) for x in t[part]]
                held[t["name"].lower()] = Table(**t)
        return out


class Store:
    """The catalogue file and the tables' folders below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.passing: list[str] = []  # folders that are of no use after the statement

    def hold(self, table: Table, rows: DataFrame) -> DataFrame:
        """Rows of a running statement, written once; later steps read them several times, and no lost executor takes them along."""
        self.passing.append(folder := self.write(table, rows))
        return self.spark.read.schema(table.schema()).parquet(folder)

    def keep(self, rows: DataFrame, name: str, by: str | None = None, sorted_groups: bool = False) -> DataFrame:
        """The same for rows that aren't a table's. by: a column whose values get a folder each. sorted_groups: one group at a time is in memory."""
        self.passing.append(folder := f"{self.root}/data/{name}-{uuid.uuid4().hex}")
        hashed = "spark.sql.execution.useObjectHashAggregateExec"
        before = self.spark.conf.get(hashed)
        try:
            if sorted_groups:
                self.spark.conf.set(hashed, "false")
            rows.write.parquet(folder, partitionBy=by)
        finally:
            if sorted_groups:
                self.spark.conf.set(hashed, before)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def sweep(self) -> None:
        """After a statement."""
        for folder in self.passing:
            p, fs = self._fs(folder)
            fs.delete(p, True)
        self.passing.clear()

    def compact(self, table: Table) -> int:
        """One folder instead of several; the number of those it took the place of."""
        before = len(table.folders)
        if before > 1:
            self.replace(table, self.read(table))
        return before if before > 1 else 0

    def marks(self) -> list[tuple[int, int, object]]:
        """(revision, time, path) of what runs. Those of dead sessions go."""
        p, fs = self._fs(f"{self.root}/running")
        out = []
        for status in fs.listStatus(p) if fs.exists(p) else []:
            if status.getModificationTime() < (time.time() - STALE) * 1000:
                fs.delete(status.getPath(), False)
            else:
                out.append((int(status.getPath().getName().partition("-")[0]), status.getModificationTime(), status.getPath()))
        return out

    def begin(self, catalogue: Catalogue) -> str:
        """A mark that work which begins with this catalogue is under way."""
        path = f"{self.root}/running/{catalogue.revision}-{uuid.uuid4().hex}"
        p, fs = self._fs(path)
        fs.create(p, False).close()
        return path

    def end(self, mark: str | None) -> None:
        if mark:
            p, fs = self._fs(mark)
            fs.delete(p, False)

    def collect_garbage(self, *catalogues: Catalogue) -> int:
        """Remove the folders that no table has any more: not in these catalogues, and not of anything that still runs."""
        marks = self.marks()
        held = [*catalogues, *(c for r in {r for r, _, _ in marks} if (c := self.load(r)) is not None)]
        oldest = min((t for _, t, _ in marks), default=None)
        used = {self.folder_name(f) for c in held for ts in c.databases.values() for t in ts.values() if isinstance(t, Table) for f in t.folders}
        p, fs = self._fs(f"{self.root}/data")
        gone = 0
        for status in fs.listStatus(p) if fs.exists(p) else []:
            if status.getPath().getName() not in used and (oldest is None or status.getModificationTime() < oldest):
                gone += fs.delete(status.getPath(), True)
        return gone

    def folder_name(self, path: str) -> str:
        """The name below data of a table's folder, or of the folder of one of its files."""
        return path[len(f"{self.root}/data/") :].partition("/")[0]

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def revisions(self) -> list[int]:
        p, fs = self._fs(self.root)
        found = [re.fullmatch(r"catalogue-(\d+)\.json", x.getPath().getName()) for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(m[1]) for m in found if m)

    def load(self, revision: int | None = None) -> Catalogue | None:
        """The newest catalogue, or that of a revision, if it is still there."""
        there = self.revisions()
        if revision is None:
            if not there:
                return Catalogue()
            revision = there[-1]
        elif revision not in there:
            return None
        p, fs = self._fs(f"{self.root}/catalogue-{revision}.json")
        stream = fs.open(p)
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return Catalogue.from_json(text)

    def publish(self, catalogue: Catalogue) -> None:
        """Put the next revision in place, unless another session has done so since this catalogue was loaded."""
        conflict = SqlError("(1213) the tables were changed by another session; try again")
        new = catalogue.revision + 1
        source, fs = self._fs(f"{self.root}/writing-{uuid.uuid4().hex}.json")
        fs.mkdirs(source.getParent())
        stream = fs.create(source, True)
        stream.write(bytearray(json.dumps({**json.loads(catalogue.to_json()), "revision": new}).encode()))
        stream.close()
        target, _ = self._fs(f"{self.root}/catalogue-{new}.json")
        context = self.spark.sparkContext
        hadoop, gateway = context._jvm.org.apache.hadoop.fs, context._gateway
        if_absent = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        if_absent[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            with _publishing:
                there = self.revisions()
                if there and there[-1] >= new:
                    raise conflict
                try:
                    hadoop.FileContext.getFileContext(source.toUri(), context._jsc.hadoopConfiguration()).rename(source, target, if_absent)
                except Exception as e:
                    raise (conflict if "FileAlreadyExists" in str(e) else e) from None
        finally:
            fs.delete(source, False)
        catalogue.revision = new
        least = min([new - REVISIONS, *(r for r, _, _ in self.marks())])
        for r in there:
            if r < least:
                old, _ = self._fs(f"{self.root}/catalogue-{r}.json")
                fs.delete(old, False)

    def copy_to(self, other: Store, catalogue: Catalogue) -> int:
        """This catalogue's tables, written by the executors below the other root and published there; the number of tables."""
        there = other.load()
        new = catalogue.copy()
        new.revision = there.revision
        mark = other.begin(there)
        try:
            held = [t for ts in new.databases.values() for t in ts.values() if isinstance(t, Table)]
            for t in held:
                if t.folders:
                    t.folders = [other.write(t, self.read(t))]
            other.publish(new)
        finally:
            other.end(mark)
        return len(held)

    def count(self, table: Table) -> int:
        """As kept in the catalogue, else by Parquet's footers."""
        return table.rows if table.rows is not None and not table.external else self.read(table).count()

    def size(self, table: Table) -> int:
        """Bytes of the table's files."""
        out = 0
        for path in [table.external] if table.external else table.folders:
            p, fs = self._fs(path)
            out += fs.getContentSummary(p).getLength()
        return out

    def read(self, table: Table) -> DataFrame:
        if table.external:
            return self.spark.read.parquet(table.external)
        if not table.folders:
            return self.spark.createDataFrame([], table.schema())
        return self.spark.read.schema(table.schema()).parquet(*table.folders)

    def write(self, table: Table, rows: DataFrame) -> str:
        """A new folder with these rows."""
        folder = f"{self.root}/data/{table.name}-{uuid.uuid4().hex}"
        rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema())).write.parquet(folder)
        return folder

    def append(self, table: Table, rows: DataFrame) -> int:
        """Add rows; each gets its number. The count of rows."""
        numbered = rows.withColumn(ROW, F.monotonically_increasing_id() + table.next_row)
        folder = self.write(table, numbered)
        count, last = self.spark.read.schema(table.schema()).parquet(folder).agg(F.count(F.lit(1)), F.max(ROW)).first()
        before = 0 if not table.folders else table.rows
        table.rows = None if before is None else before + count
        if count:
            table.folders.append(folder)
            table.next_row = last + 1
        return count

    def rewrite(self, table: Table, ids: DataFrame, changed: DataFrame | None) -> None:
        """The files that hold the rows of these numbers anew, without them; the changed rows besides. Other files stay."""
        there = self.read(table).select(ROW, F.col("_metadata.file_path").alias("_file"))
        hit = {r["_file"].rpartition("/")[2] for r in there.join(ids, ROW, "left_semi").select("_file").distinct().collect()}
        kept: list[str] = []
        touched: list[str] = []
        for path in table.folders:
            p, fs = self._fs(path)
            files = [f"{path}/{x.getPath().getName()}" for x in fs.listStatus(p) if x.getPath().getName().endswith(".parquet")] if fs.getFileStatus(p).isDirectory() else [path]
            own = [f for f in files if f.rpartition("/")[2] in hit]
            touched += own
            kept += [path] if not own else [f for f in files if f not in own]
        rows = self.spark.read.schema(table.schema()).parquet(*touched).join(ids, ROW, "left_anti") if touched else None
        if changed is not None:
            rows = changed if rows is None else rows.unionByName(changed.select(*rows.columns))
        if rows is not None:
            folder = self.write(table, rows)
            if changed is not None or not self.spark.read.schema(table.schema()).parquet(folder).isEmpty():
                kept.append(folder)
        table.folders = kept

    def replace(self, table: Table, rows: DataFrame) -> None:
        """All rows anew; rows keep their numbers, rows without one get it."""
        folder = self.write(table, rows.withColumn(ROW, F.coalesce(ROW, F.monotonically_increasing_id() + table.next_row)))
        table.rows, last = self.spark.read.schema(table.schema()).parquet(folder).agg(F.count(F.lit(1)), F.max(ROW)).first()
        table.folders = [folder] if last is not None else []
        table.next_row = max(table.next_row, (last or 0) + 1)
