"""A session: MySQL-dialect statements over Spark.

    session = Session(spark, root="/shared/warehouse")
    session.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    session.sql("INSERT INTO t VALUES (1, 10), (2, 20)").affected
    session.sql("SELECT id, v / 0 AS x FROM t").show()

Queries come back as lazy DataFrames, other statements as a ``Done``. Parquet tables that exist already are attached
read-only (``attach``), and pruning and pushdown reach their files.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import jsonfn, scalar
from quarry.operators import folding
from quarry.operators.changes import Changes
from quarry.plans import metadata
from quarry.plans.lexer import SqlError, statements, tokens
from quarry.plans.statements import Parser
from quarry.plans.translate import Context, Translator, collation, quoted, translate
from quarry.sources.store import ROW, Catalogue, Column, Index, Store, Table, View, base_type, declared_type, spark_type

VERSION = "8.0.0-quarry"
DEFAULT_COLLATION = "utf8mb4_general_ci"


def scratch(spark: SparkSession) -> str:
    """A folder of its own where driver and executors share one (spark.checkpoint.dir), else, as in tests, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/quarry-tables-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise SqlError("spark.checkpoint.dir, the folder that driver and executors share, is not set")
    return "file://" + tempfile.mkdtemp(prefix="quarry-tables-")


@dataclass
class Done:
    """What a statement that isn't a query did."""

    affected: int = 0
    last_insert_id: int = 0


class Session:
    def __init__(self, spark: SparkSession, root: str | None = None, database: str = "quarry", collation_name: str = DEFAULT_COLLATION, time_zone: str = "UTC"):
        self.spark = spark
        self.store = Store(spark, root or scratch(spark))
        self.database, self.collation, self.time_zone = database, collation_name, time_zone
        self.foreign_checks, self.last_insert_id = True, 0
        self.variables: dict[str, object] = {"version": VERSION, "autocommit": 1, "collation_connection": collation_name, "time_zone": time_zone, "foreign_key_checks": 1, "tx_isolation": "REPEATABLE-READ", "transaction_isolation": "REPEATABLE-READ"}
        self.attached: dict[str, Table | str] = {}  # a path until the table is first used
        self.mark: str | None = None
        self.open: Catalogue | None = None
        self.savepoints: list[tuple[str, Catalogue]] = []
        self.now: Catalogue | None = None
        self.views: list[str] = []
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "1000")
        spark.conf.set("spark.sql.session.timeZone", time_zone)

    # names

    @property
    def ignores_case(self) -> bool:
        return collation(self.collation) == "UTF8_LCASE"

    def attach(self, name: str, path: str) -> None:
        """A Parquet table as a read-only table of every database."""
        self.attached[name.lower()] = path

    def attached_table(self, name: str) -> Table | None:
        found = self.attached.get(name.lower())
        if isinstance(found, str):
            schema = self.spark.read.parquet(found).schema
            found = self.attached[name.lower()] = Table(name, [Column(f.name, declared_type(f.dataType)) for f in schema], external=found)
        return found

    def catalogue(self) -> Catalogue:
        """As the running statement or transaction sees it."""
        if self.now is not None:
            return self.now
        if self.open is not None:
            return self.open
        found = self.store.load()
        found.databases.setdefault(self.database.lower(), {})
        return found

    def find(self, database: str | None, name: str) -> Table | View:
        catalogue = self.catalogue()
        found = catalogue.found(database or self.database, name)
        if found is None and database is None:
            found = self.attached_table(name)
        if found is None:
            raise SqlError(f"(1146) table {database or self.database}.{name} doesn't exist")
        return found

    def relation(self, database: str | None, name: str) -> str:
        """How Spark's SQL names a table or view."""
        if (database or self.database).lower() == "information_schema":
            return self.registered(f"info_{name.lower()}", metadata.information_schema(self, name))
        found = self.find(database, name)
        if isinstance(found, View):
            return self.view_text(found, database)
        held = self.store.read(found)
        label = hashlib.md5(repr((found.external, found.folders, found.name, self.store.root, self.collation)).encode(), usedforsecurity=False).hexdigest()[:16]
        if self.ignores_case:
            by = {c.name.lower(): c.collation for c in found.columns}
            held = held.select(*(F.col(f"`{f.name}`").cast("string collate UTF8_LCASE").alias(f.name) if isinstance(f.dataType, T.StringType) and collation(by.get(f.name.lower()) or self.collation) == "UTF8_LCASE" else F.col(f"`{f.name}`") for f in held.schema))
        return self.registered(f"t_{found.name.lower()}_{label}", held if self.hidden else held.drop(ROW))

    hidden = False

    def registered(self, name: str, df: DataFrame) -> str:
        name = re.sub(r"\W", "_", name) + ("_h" if self.hidden else "")
        df.createOrReplaceTempView(f"quarry_{name}")
        return f"quarry_{name}"

    def view_text(self, view: View, database: str | None) -> str:
        key = f"{database or self.database}.{view.name}".lower()
        if key in self.views:
            raise SqlError(f"(1462) view {view.name} refers to itself")
        self.views.append(key)
        before = self.hidden, self.database
        self.hidden, self.database = False, database or self.database  # a view's tables are those of its own database
        try:
            text = translate(view.sql, self.context(view.sql))
        finally:
            self.views.pop()
            self.hidden, self.database = before
        if view.columns:
            return f"(SELECT * FROM ({text}) AS v({', '.join(map(quoted, view.columns))}))"
        return f"({text})"

    def documents(self, text: str | None):
        """Which columns (by qualifier, if any, and name) hold JSON, judged by the tables that the statement names."""
        catalogue = self.catalogue()
        tables = {t.name.lower(): t for t in catalogue.tables(self.database)} if self.database.lower() in catalogue.databases else {}
        by: dict[str, list[Table]] = {}
        words = [x for x in tokens(text)] if text else []
        for k, word in enumerate(words):
            if (t := tables.get(word.text.lower())) is None or word.kind not in ("name", "word"):
                continue
            after = [x for x in words[k + 1 : k + 3] if x.kind in ("name", "word")]
            named = after[1:] if after and after[0].text.upper() == "AS" else after[:1]
            for name in {word.text.lower(), *(x.text.lower() for x in named)}:
                by.setdefault(name, []).append(t)
        seen = {id(t): t for ts in by.values() for t in ts}.values() if text else tables.values()

        def document(name: str, qualifier: str | None = None) -> bool:
            kinds = [base_type(c.declared) for t in (by.get(qualifier.lower(), seen) if qualifier else seen) for c in t.columns if c.name.lower() == name.lower()]
            return bool(kinds) and all(k == "JSON" for k in kinds)

        return document

    def context(self, text: str | None = None) -> Context:
        user = scalar.literal("quarry@localhost")
        functions = {"VERSION": scalar.literal(VERSION), "DATABASE": scalar.literal(self.database), "SCHEMA": scalar.literal(self.database), "USER": user, "CURRENT_USER": user, "SESSION_USER": user, "CONNECTION_ID": "1L", "LAST_INSERT_ID": f"{self.last_insert_id}L"}
        return Context(self.relation, self.variables, functions, self.ignores_case, self.documents(text))

    # statements

    def script(self, text: str) -> list[DataFrame | Done]:
        """All statements of a script, one after another."""
        return [self.sql(s) for s in statements(text)]

    def restore(self, text: str) -> list[Done | DataFrame]:
        """A dump's script in one transaction, without its settings and locks."""
        self.sql("BEGIN")
        try:
            out = [self.sql(s) for s in statements(text) if not re.match(r"(?i)(set|lock|unlock)\b", s)]
        except Exception:
            self.sql("ROLLBACK")
            raise
        self.sql("COMMIT")
        return out

    def translated(self, sql: str, args: list[object] | None = None) -> str:
        return translate(sql, self.context(sql), args)

    def sql(self, text: str, args: list[object] | None = None) -> DataFrame | Done:
        parsed = Parser(text, self.context(), args).statement()
        if parsed["do"] == "query":
            return self.query(text, args)
        if args:
            text = bound(text, args)
        parser = Parser(text, self.context())
        parsed = parser.statement()
        parser.end()
        return getattr(self, f"_{parsed.pop('do')}")(**parsed)

    def query(self, text: str, args: list[object] | None = None) -> DataFrame:
        spark_sql = self.translated(text, args)
        if "quarry_json" in spark_sql:
            jsonfn.register(self.spark)
        return self.spark.sql(spark_sql)

    def changing(self, work) -> Done:
        """Run work(catalogue) on a copy of the catalogue, and publish it if all went well."""
        self.now = self.catalogue().copy()
        mark = None if self.open is not None else self.store.begin(self.now)
        try:
            out = work(self.now)
            if self.open is not None:
                self.open = self.now
            else:
                self.store.publish(self.now)
        finally:
            self.now = None
            self.store.sweep()
            self.store.end(mark)
        return out if isinstance(out, Done) else Done(out or 0)

    def table(self, name: tuple[str | None, str]) -> Table:
        database, own = name
        if self.now is not None and self.now.found(database or self.database, own) is None and own.lower() in self.attached:
            raise SqlError(f"table {own} is attached read-only")
        return self.catalogue().table(database or self.database, own)

    def place(self, name: tuple[str | None, str]) -> dict:
        database = (name[0] or self.database).lower()
        if database not in self.now.databases:
            raise SqlError(f"(1049) unknown database {database}")
        return self.now.databases[database]

    # databases, tables, views

    def _create_database(self, name: str, maybe: bool) -> Done:
        def work(c: Catalogue) -> None:
            if name.lower() in c.databases and not maybe:
                raise SqlError(f"(1007) database {name} exists")
            c.databases.setdefault(name.lower(), {})

        return self.changing(work)

    def _drop_database(self, name: str, maybe: bool) -> Done:
        def work(c: Catalogue) -> None:
            if c.databases.pop(name.lower(), None) is None and not maybe:
                raise SqlError(f"(1008) database {name} doesn't exist")

        return self.changing(work)

    def _use(self, name: str) -> Done:
        if name.lower() not in self.catalogue().databases and name.lower() != "information_schema":
            raise SqlError(f"(1049) unknown database {name}")
        self.database = name
        return Done()

    def _create_table(self, table, maybe, columns, indexes, foreign, checks, comment, like, query) -> Done:
        def work(c: Catalogue) -> int:
            held = self.place(table)
            if table[1].lower() in held:
                if maybe:
                    return 0
                raise SqlError(f"(1050) table {table[1]} exists")
            if like:
                old = self.table(like)
                held[table[1].lower()] = Table(table[1], list(old.columns), list(old.indexes), [], list(old.checks), comment=old.comment)
                held[table[1].lower()] = Catalogue.copy(c).databases[(table[0] or self.database).lower()][table[1].lower()]
                return 0
            rows = self.query(query) if query else None
            there = {x.name.lower() for x in columns}
            more = [Column(f.name, declared_type(f.dataType)) for f in rows.schema if f.name.lower() not in there] if rows is not None else []
            made = Table(table[1], [*columns, *more], indexes, foreign, checks, comment=comment)
            self.settle(made)
            held[table[1].lower()] = made
            if rows is None:
                return 0
            return self.changes(c, table).insert(made, self.in_order(rows.select(*(F.col(f"`{x.name}`") if x.name.lower() in {n.lower() for n in rows.columns} else F.lit(None).alias(x.name) for x in made.columns))))

        return self.changing(work)

    def settle(self, table: Table) -> None:
        """A definition that holds together: distinct names, keys over columns that are there, primary keys not null."""
        seen: set[str] = set()
        for c in table.columns:
            if c.name.lower() in seen:
                raise SqlError(f"(1060) duplicate column {c.name}")
            seen.add(c.name.lower())
            spark_type(c.declared)
        taken: dict[str, int] = {}
        for i in table.indexes:
            for name in i.columns:
                c = table.column(name)
                if i.primary:
                    c.nullable = False
            n = taken[i.name.lower()] = taken.get(i.name.lower(), 0) + 1
            if n > 1:
                if i.primary:
                    raise SqlError("(1068) more than one primary key")
                i.name = f"{i.name}_{n}"
        for k, key in enumerate(table.foreign, 1):
            key.name = key.name or f"{table.name}_fk_{k}"
            for name in key.columns:
                table.column(name)
            parent = table if key.parent.lower() == table.name.lower() else self.catalogue().found(self.database, key.parent)
            if parent is None and self.foreign_checks:
                raise SqlError(f"(1824) referenced table {key.parent} doesn't exist")

    def _drop(self, view, maybe, tables) -> Done:
        def work(c: Catalogue) -> None:
            going = {t[1].lower() for t in tables}
            for name in tables:
                held = self.place(name)
                found = held.get(name[1].lower())
                if found is None or isinstance(found, View) != view:
                    if maybe:
                        continue
                    raise SqlError(f"(1051) unknown {'view' if view else 'table'} {name[1]}")
                if not view and self.foreign_checks:
                    for t in held.values():
                        if isinstance(t, Table) and t.name.lower() not in going and any(k.parent.lower() == name[1].lower() for k in t.foreign):
                            raise SqlError(f"(3730) table {name[1]} is referenced by a foreign key of {t.name}")
                del held[name[1].lower()]

        return self.changing(work)

    def _create_view(self, table, columns, query, replace, maybe) -> Done:
        def work(c: Catalogue) -> None:
            held = self.place(table)
            old = held.get(table[1].lower())
            if old is not None and not (replace and isinstance(old, View)):
                if maybe:
                    return
                raise SqlError(f"(1050) table {table[1]} exists")
            held[table[1].lower()] = View(table[1], query, columns)
            found = self.query(f"SELECT * FROM {'.'.join(quoted(x) for x in table if x)}")  # refuses cycles and unknown names
            if len({n.lower() for n in found.columns}) < len(found.columns):
                raise SqlError("(1060) duplicate column names in the view")

        return self.changing(work)

    def _rename(self, pairs) -> Done:
        def work(c: Catalogue) -> None:
            for old, new in pairs:
                self.rename(old, new)

        return self.changing(work)

    def rename(self, old, new) -> None:
        source, target = self.place(old), self.place(new)
        if new[1].lower() in target:
            raise SqlError(f"(1050) table {new[1]} exists")
        t = source.pop(old[1].lower(), None)
        if t is None:
            raise SqlError(f"(1146) table {old[1]} doesn't exist")
        t.name = new[1]
        target[new[1].lower()] = t
        for other in source.values():
            for k in getattr(other, "foreign", []):
                if k.parent.lower() == old[1].lower():
                    k.parent = new[1]

    def _truncate(self, table) -> Done:
        def work(c: Catalogue) -> None:
            t = self.table(table)
            if self.foreign_checks and [x for x, _ in self.changes(c, table).children(t) if x is not t]:
                raise SqlError(f"(1701) table {t.name} is referenced by a foreign key")
            t.folders, t.next_auto, t.rows = [], 1, 0

        return self.changing(work)

    def _alter(self, table, actions) -> Done:
        def work(c: Catalogue) -> None:
            t = self.table(table)
            rows = self.store.read(t)
            source = {x.name.lower(): F.col(f"`{x.name}`") for x in t.columns}
            changed = False
            for what, *how in actions:
                if what == "rename":
                    self.rename((table[0], t.name), how[0])
                elif what == "comment":
                    t.comment = how[0]
                elif what == "add_index":
                    t.indexes.append(how[0])
                elif what == "add_foreign":
                    t.foreign.append(how[0])
                elif what == "add_check":
                    t.checks.append(how[0])
                elif what == "default":
                    t.column(how[0]).default = how[1]
                elif what == "rename_index":
                    self.index(t, how[0]).name = how[1]
                elif what == "drop_index":
                    t.indexes.remove(self.index(t, how[0]))
                elif what in ("drop_foreign", "drop_constraint"):
                    kept = ([k for k in t.foreign if k.name.lower() != how[0].lower()], [k for k in t.checks if k.name.lower() != how[0].lower()])
                    if (len(kept[0]), len(kept[1])) == (len(t.foreign), len(t.checks)):
                        raise SqlError(f"(1091) no constraint {how[0]}")
                    t.foreign, t.checks = kept
                else:
                    changed = True
                    self.alter_column(t, source, what, how)
            self.settle(t)
            if changed and t.folders:
                rows = rows.select(*(source[x.name.lower()].cast(spark_type(x.declared)).alias(x.name) for x in t.columns), ROW)
                self.store.replace(t, rows)
            if t.folders and (changed or any(a[0].startswith("add_") for a in actions)):
                rows, changes = self.store.read(t), self.changes(c, table)
                changes.check_rows(t, rows)
                changes.check_keys(t, rows, None)
                changes.check_parents(t, rows)

        return self.changing(work)

    def index(self, table: Table, name: str) -> Index:
        for i in table.indexes:
            if i.name.lower() == name.lower():
                return i
        raise SqlError(f"(1091) no index {name}")

    def alter_column(self, t: Table, source: dict, what: str, how: list) -> None:
        if what == "add":
            new, place = how
            if any(c.name.lower() == new.name.lower() for c in t.columns):
                raise SqlError(f"(1060) duplicate column {new.name}")
            default = self.default_text(new)
            source[new.name.lower()] = F.expr(default) if default != "NULL" or new.nullable else F.lit({T.StringType: ""}.get(type(spark_type(new.declared)), 0))
            t.columns.append(new)
            self.move(t, new, place)
        elif what == "drop":
            old = t.column(how[0])
            if len(t.columns) == 1:
                raise SqlError("(1090) a table keeps one column at least")
            if any(re.search(rf"\b{re.escape(how[0])}\b", k.text, re.I) for k in t.checks):
                raise SqlError(f"(3959) a check constraint uses column {how[0]}")
            if any(how[0].lower() in map(str.lower, k.columns) for k in t.foreign):
                raise SqlError(f"(1828) column {how[0]} is part of a foreign key")
            t.columns.remove(old)
            for i in list(t.indexes):
                i.columns = [x for x in i.columns if x.lower() != how[0].lower()]
                if not i.columns:
                    t.indexes.remove(i)
        else:
            name = how[0]
            new, place = (how[1], how[2]) if what == "change" else (None, ("last", None))
            old = t.column(name)
            made = new or Column(**{**vars(old), "name": how[1]})
            at = t.columns.index(old)
            t.columns[at] = made
            source[made.name.lower()] = source[name.lower()]
            for i in [*t.indexes, *t.foreign]:
                i.columns = [made.name if x.lower() == name.lower() else x for x in i.columns]
            if place[0] != "last":
                self.move(t, made, place)

    def move(self, t: Table, column: Column, place: tuple[str, str | None]) -> None:
        if place[0] == "last":
            return
        t.columns.remove(column)
        t.columns.insert(0 if place[0] == "first" else t.columns.index(t.column(place[1])) + 1, column)

    # rows

    def changes(self, catalogue: Catalogue, table: tuple[str | None, str]) -> Changes:
        return Changes(self.store, catalogue, table[0] or self.database, lambda text: Translator(text, self.context()).condition(), self.foreign_checks, lambda c: collation(c.collation or self.collation) == "UTF8_LCASE")

    def default_text(self, c: Column) -> str:
        """Spark's text for a column's default."""
        return Translator(c.default, self.context()).expression().text if c.default is not None else "NULL"

    def in_order(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(ROW, F.monotonically_increasing_id())

    def _insert(self, table, replace, ignore, columns, rows, query, update) -> Done:
        def work(c: Catalogue) -> Done:
            t = self.table(table)
            named = columns or [x.name for x in t.columns]
            for n in named:
                t.column(n)
            source = self.value_rows(t, named, rows) if rows is not None else self.query(query)
            if len(source.columns) != len(named):
                raise SqlError("(1136) column count doesn't match value count")
            source = self.in_order(source.toDF(*(f"c{k}" for k in range(len(named)))))
            first = t.next_auto
            place = {n.lower(): f"c{k}" for k, n in enumerate(named)}
            made, given = [], None
            for x in t.columns:
                kind = spark_type(x.declared)
                own = F.col(place[x.name.lower()]) if x.name.lower() in place else None
                if x.auto:
                    own = F.lit(None) if own is None else F.when(own.cast("bigint") != 0, own)
                    given = x
                elif own is None:
                    own = F.expr(self.default_text(x))
                made.append(own.cast(kind).alias(x.name))
            out = source.select(*made, ROW)
            if given is not None:
                out, t.next_auto = self.numbered(t, out, given, first)
            mode = "replace" if replace else "update" if update else "ignore" if ignore else ""
            count = self.changes(c, table).insert(t, out, mode, (lambda u, hit, key: self.upsert(c, table, u, hit, key, update)) if update else None, self.step(t, update) if update else None)
            if given is not None and t.next_auto > first:
                self.last_insert_id = first
            return Done(count, self.last_insert_id)

        return self.changing(work)

    def numbered(self, t: Table, rows: DataFrame, auto: Column, first: int) -> tuple[DataFrame, int]:
        """AUTO_INCREMENT values, in order: counts of each partition (one row for each), then the place within it."""
        rows = self.changes(self.now, (None, t.name)).held(t, rows)
        missing = rows.where(F.col(auto.name).isNull()).withColumn("_p", F.shiftright(ROW, 33))  # a row's number begins with its partition
        counts = missing.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
        total = counts.agg(F.sum("_n")).first()[0] or 0
        w = Window.partitionBy("_p").orderBy(ROW)
        filled = missing.join(before, "_p").withColumn(auto.name, (F.lit(first) + F.col("_before") + F.row_number().over(w) - 1).cast(spark_type(auto.declared))).drop("_p", "_before")
        most = rows.agg(F.max(auto.name)).first()[0]
        return rows.where(F.col(auto.name).isNotNull()).unionByName(filled), max(first + total, (most or 0) + 1)

    def value_rows(self, t: Table, named: list[str], rows: list[list[str]]) -> DataFrame:
        texts = []
        for r in rows:
            if len(r) != len(named):
                raise SqlError("(1136) column count doesn't match value count")
            texts.append([self.default_text(t.column(n)) if x.strip().upper() == "DEFAULT" else f"CAST({Translator(x, self.context()).expression().text} AS {spark_type(t.column(n).declared).simpleString()})" for n, x in zip(named, r, strict=True)])
        if any("quarry_json" in x for r in texts for x in r):
            jsonfn.register(self.spark)
        if not named:
            return self.spark.range(len(rows)).select()
        if any("SELECT" in x or "quarry_" in x for r in texts for x in r):
            return self.spark.sql(" UNION ALL ".join("SELECT " + ", ".join(f"{x} AS c{k}" for k, x in enumerate(r)) for r in texts))
        return self.spark.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(r)})" for r in texts))

    def assigned(self, t: Table, rows: DataFrame, alias: str, pairs: list[tuple[str, str]], replaced: dict[str, str] | None = None) -> DataFrame:
        """rows with the columns set from left to right, each seeing those before it."""
        columns = rows.columns
        if any(c.on_update for c in t.columns):
            done = {n.lower() for n, _ in pairs}
            pairs = [*pairs, *((c.name, c.on_update) for c in t.columns if c.on_update and c.name.lower() not in done)]
        for n, (name, text) in enumerate(pairs):
            c = t.column(name)
            rows.createOrReplaceTempView(view := f"quarry_step_{n % 2}_{id(rows)}")
            context = self.context()
            context.replaced = replaced or {}
            made = self.default_text(c) if text.strip().upper() == "DEFAULT" else Translator(text, context).expression().text
            if "quarry_json" in made:
                jsonfn.register(self.spark)
            own = ", ".join(f"CAST({made} AS {spark_type(c.declared).simpleString()}) AS {quoted(x)}" if x.lower() == c.name.lower() else f"{quoted(alias)}.{quoted(x)}" for x in columns)
            rows = self.spark.sql(f"SELECT {own} FROM {view} AS {quoted(alias)}")
        return rows

    def step(self, t: Table, update) -> folding.Step | None:
        """How an upsert makes a row of `_old` and `_new`; None where that isn't an expression of these alone."""
        keys = {x.lower() for k in t.keys() for x in k.columns}
        now = {x.name.lower(): f"`_old`.{quoted(x.name)}" for x in t.columns}
        assigned: dict[str, str] = {}
        done = {n[1].lower() for n, _ in update}
        for name, text in [*((n[1], e) for n, e in update), *((x.name, x.on_update) for x in t.columns if x.on_update and x.name.lower() not in done)]:
            c = t.column(name)
            if name.lower() in keys or any(x.text.upper() == "SELECT" for x in tokens(text)):
                return None
            context = self.context()
            context.replaced, context.columns = {x.name.lower(): f"`_new`.{quoted(x.name)}" for x in t.columns}, now
            made = self.default_text(c) if text.strip().upper() == "DEFAULT" else Translator(text, context).expression().text
            if "quarry_" in made:
                return None
            assigned[c.name] = made
            now = {**now, name.lower(): f"CAST({made} AS {spark_type(c.declared).simpleString()})"}
        parse = self.spark._jsparkSession.sessionState().sqlParser().parseExpression
        return folding.Step(", ".join(f"{scalar.literal(x.name)}, {now[x.name.lower()]}" for x in t.columns), assigned, parse)

    def upsert(self, c: Catalogue, table, t: Table, hit: DataFrame, key: Index, update) -> int:
        """Old rows that have the key of a new one, changed; VALUES(x) is the new row's."""
        renamed = hit.select(*(F.col(f"`{x.name}`").alias(f"_new_{x.name}") for x in t.columns))
        old = self.store.read(t)
        on = None
        for n in key.columns:
            a, b = F.col(f"`{n}`"), F.col(f"`_new_{n}`")
            same = F.lower(a) == F.lower(b) if isinstance(spark_type(t.column(n).declared), T.StringType) and collation(t.column(n).collation or self.collation) == "UTF8_LCASE" else a == b
            on = same if on is None else on & same
        rows = old.join(renamed, on)
        made = self.assigned(t, rows, t.name, [(n[1], text) for n, text in update], {x.name.lower(): quoted(f"_new_{x.name}") for x in t.columns})
        return self.changes(c, table).update(t, made.select(*(f"`{x.name}`" for x in t.columns), ROW), {n[1].lower() for n, _ in update})

    def sources(self, source: str) -> tuple[str, dict[str, Table]]:
        """Spark's text of the FROM of a change, with row numbers in sight, and the tables by the names that they go by."""
        parser = Parser(source, self.context())
        by: dict[str, Table] = {}
        relation = parser.context.relation

        def seen(database: str | None, name: str) -> str:
            found = self.catalogue().found(database or self.database, name)
            if isinstance(found, Table):
                by[parser.all[parser.at - 1].text.lower()] = found  # the last token read is the alias, or else the name
            return relation(database, name)

        parser.context.relation = seen
        self.hidden = True
        try:
            text = parser.sources()
            parser.end()
        finally:
            self.hidden = False
        return text, by

    def hits(self, source: str, where: str | None, columns: str, order: str | None = None, limit: int | None = None) -> DataFrame:
        text = f"SELECT {columns} FROM {source}"
        if where:
            text += f" WHERE {Translator(where, self.context()).condition()}"
        if order:
            t = Translator(order, self.context())
            text += f" ORDER BY {', '.join(t.listed(t.order_item))}"
        if limit is not None:
            text += f" LIMIT {limit}"
        if "quarry_json" in text:
            jsonfn.register(self.spark)
        return self.spark.sql(text)

    def target(self, by: dict[str, Table], name: str) -> tuple[str, Table]:
        if name.lower() in by:
            return name, by[name.lower()]
        for alias, t in by.items():
            if t.name.lower() == name.lower():
                return alias, t
        raise SqlError(f"(1109) unknown table {name} in a change")

    def _update(self, source, set, where, order, limit) -> Done:  # noqa: A002
        def work(c: Catalogue) -> int:
            text, by = self.sources(source)
            if not by:
                raise SqlError("(1146) no such table")
            changes = self.changes(c, (None, ""))
            if len(by) == 1 and " JOIN " not in text:
                (alias, t), = by.items()
                order_text = order or (f"{quoted(alias)}.{quoted(ROW)}" if limit is not None else None)
                rows = self.hits(text, where, ", ".join(f"{quoted(alias)}.{quoted(x)}" for x in [*(k.name for k in t.columns), ROW]), order_text, limit)
                return changes.update(t, self.assigned(t, self.plain(t, rows), alias, [(n[1], x) for n, x in set]), {n[1].lower() for n, _ in set})
            count = 0
            jobs: dict[str, list[tuple[str, str]]] = {}
            for (qualifier, name), expression in set:
                alias = qualifier or next((a for a, t in by.items() if any(x.name.lower() == name.lower() for x in t.columns)), name)
                jobs.setdefault(self.target(by, alias)[0], []).append((name, expression))
            made = []
            for alias, pairs in jobs.items():
                _, t = self.target(by, alias)
                new = {n.lower(): Translator(e, self.context()).expression().text for n, e in pairs}
                own = [f"CAST({new[x.name.lower()]} AS {spark_type(x.declared).simpleString()}) AS {quoted(x.name)}" if x.name.lower() in new else f"{quoted(alias)}.{quoted(x.name)}" for x in t.columns]
                others = [f"{quoted(a)}.{quoted(ROW)}" for a in by if a.lower() != alias.lower()]
                first = f"row_number() OVER (PARTITION BY {quoted(alias)}.{quoted(ROW)} ORDER BY {', '.join(others) or '1'}) AS _n"
                rows = self.hits(text, where, ", ".join([*own, f"{quoted(alias)}.{quoted(ROW)}", first])).where(f"_n = 1 AND {quoted(ROW)} IS NOT NULL").drop("_n")
                if limit is not None:
                    rows = rows.orderBy(ROW).limit(limit)
                made.append((t, changes.held(t, self.plain(t, rows)), new.keys()))
            for t, rows, names in made:
                count += changes.update(t, rows, names)
            return count

        return self.changing(work)

    def plain(self, t: Table, rows: DataFrame) -> DataFrame:
        """Without collations, as the table's files have it."""
        return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in t.schema()))

    def _delete(self, source, targets, where, order, limit) -> Done:
        def work(c: Catalogue) -> int:
            text, by = self.sources(source)
            changes = self.changes(c, (None, ""))
            if targets and limit is not None:
                raise SqlError("LIMIT can't be used with several tables")
            found = [self.target(by, n[1]) for n in targets] if targets else [next(iter(by.items()))]
            ids = []
            for alias, t in found:
                row = f"{quoted(alias)}.{quoted(ROW)}"
                order_text = order or (row if limit is not None else None)
                hit = self.hits(text, where, row, order_text, limit).where(f"{quoted(ROW)} IS NOT NULL")
                ids.append((t, self.store.keep(hit.distinct(), "hit")))
            children_first = sorted(ids, key=lambda x: -self.rank(x[0]))
            return sum(changes.delete(t, hit) for t, hit in children_first)

        return self.changing(work)

    def rank(self, t: Table, depth: int = 0) -> int:
        """How far below its farthest ancestor a table is."""
        if depth > 32:
            raise SqlError("foreign keys form a cycle")
        parents = [self.catalogue().found(self.database, k.parent) for k in t.foreign if k.parent.lower() != t.name.lower()]
        return max((1 + self.rank(p, depth + 1) for p in parents if isinstance(p, Table)), default=0)

    # transactions and settings

    def _begin(self) -> Done:
        if self.open is not None:
            self._commit()
        self.open = self.catalogue().copy()
        self.mark = self.store.begin(self.open)
        self.savepoints = []
        return Done()

    def closed(self) -> None:
        self.open, self.savepoints = None, []
        self.store.end(self.mark)
        self.mark = None

    def _commit(self) -> Done:
        if self.open is not None:
            try:
                self.store.publish(self.open)
            finally:
                self.closed()
        return Done()

    def _rollback(self) -> Done:
        self.closed()
        return Done()

    def _savepoint(self, name: str) -> Done:
        if self.open is not None:
            self.savepoints = [(n, c) for n, c in self.savepoints if n.lower() != name.lower()] + [(name, self.open.copy())]
        return Done()

    def saved(self, name: str) -> int:
        for k, (n, _) in enumerate(self.savepoints):
            if n.lower() == name.lower():
                return k
        raise SqlError(f"(1305) no savepoint {name}")

    def _rollback_to(self, name: str) -> Done:
        k = self.saved(name)
        self.open = self.savepoints[k][1].copy()
        self.savepoints = self.savepoints[: k + 1]
        return Done()

    def _release(self, name: str) -> Done:
        self.savepoints = self.savepoints[: self.saved(name)]
        return Done()

    def _set(self, pairs) -> Done:
        for name, text in pairs:
            if name == "autocommit":
                if str(text).strip().upper() in ("0", "OFF", "FALSE"):
                    self._begin()
                else:
                    self._commit()
            if re.fullmatch(r"[\w+:/-]+", str(text)) and not str(text).isdigit():
                value: object = str(text)
            else:
                value = self.spark.sql(f"SELECT {Translator(text, self.context()).expression().text} AS v").first()["v"]
            self.variables[name] = value
            if name in ("collation_connection", "collation"):
                self.collation = str(value)
            elif name == "time_zone":
                self.time_zone = str(value)
                self.spark.conf.set("spark.sql.session.timeZone", "UTC" if str(value).upper() == "SYSTEM" else str(value))
            elif name == "foreign_key_checks":
                self.foreign_checks = str(value).strip().upper() not in ("0", "OFF", "FALSE")
        return Done()

    def _nothing(self, **_) -> Done:
        return Done()

    # maintenance

    def _compact(self, tables) -> Done:
        def work(c: Catalogue) -> int:
            held = [self.table(t) for t in tables] if tables else [t for d in c.databases for t in c.tables(d)]
            return sum(self.store.compact(t) for t in held)

        return self.changing(work)

    def _gc(self) -> Done:
        own = [] if self.open is None else [self.open, *(c for _, c in self.savepoints)]
        return Done(self.store.collect_garbage(self.store.load(), *own))

    def _backup(self, path: str) -> Done:
        """The published tables, as a root of its own below path."""
        return Done(self.store.copy_to(Store(self.spark, path), self.store.load()))

    def _restore(self, path: str) -> Done:
        """The tables of a backup in place of the present ones."""
        if self.open is not None:
            raise SqlError("(1192) a transaction is open")
        backup = Store(self.spark, path)
        if not backup.revisions():
            raise SqlError(f"there is no backup at {path}")
        return Done(backup.copy_to(self.store, backup.load()))

    # metadata

    def _show(self, text: str) -> DataFrame:
        return metadata.show(self, text)

    def _describe(self, table, column) -> DataFrame:
        out = metadata.columns(self, table)
        return out.where(F.lower("Field") == column.lower()) if column else out

    def _explain(self, query: str) -> DataFrame:
        return metadata.explain(self, query)

    def _export(self, name: str, path: str) -> Done:
        return Done(metadata.export(self, name, path))


def bound(text: str, args: list[object]) -> str:
    """The statement with literals for its parameters."""
    from quarry.plans.translate import as_literal

    out, at, left = [], 0, list(args)
    for t in tokens(text):
        if t.kind == "param":
            if not left:
                raise SqlError("too few arguments for the statement's parameters")
            out += [text[at : t.start], as_literal(left.pop(0))]
            at = t.end
    if left:
        raise SqlError("more arguments than the statement has parameters")
    return "".join([*out, text[at:]])
