"""INSERT, UPDATE and DELETE as plans: read a version, compute the next, check it, write it.

Each function works on the statement's copy of the catalogue. Only rows that are new or changed are checked; an append
writes no old row again. Checks are queries that must come back empty: one pass for all conditions on single rows, one
join for each key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import jsonfn
from quarry.operators import folding
from quarry.plans.lexer import SqlError
from quarry.sources.store import ROW, Catalogue, Index, Store, Table, arguments, base_type, length_of, spark_type

MOST_DEPTH = 32
#: Sides of a join with fewer rows than this go to every executor; they are counted first.
FEW = 10_000
#: Where an upsert's rows have to be folded one by one, so many bytes of one key's are in one pass.
FOLD = 16 << 20


def small(rows: DataFrame) -> DataFrame:
    """For a join's side: broadcast if a count says that it is small."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def names(columns: list[str]) -> list[str]:
    return [f"k{k}" for k in range(len(columns))]


class Changes:
    """Changes of one statement. evaluate: the text of a MySQL condition, for Spark, over the table's own columns."""

    def __init__(self, store: Store, catalogue: Catalogue, database: str, evaluate, foreign_checks: bool = True, ignores_case=lambda column: True):
        self.store, self.catalogue, self.database, self.evaluate, self.foreign_checks = store, catalogue, database, evaluate, foreign_checks
        self.ignores_case = ignores_case

    # keys

    def folded(self, table: Table, column: str) -> SparkColumn:
        """Keys are equal as the column's collation has it."""
        c = table.column(column)
        text = isinstance(spark_type(c.declared), T.StringType)
        return F.lower(F.col(f"`{column}`")) if text and self.ignores_case(c) else F.col(f"`{column}`")

    def key_columns(self, table: Table, columns: list[str], prefix: str) -> list[SparkColumn]:
        return [self.folded(table, c).alias(f"{prefix}{k}") for k, c in enumerate(columns)]

    def keyed(self, rows: DataFrame, table: Table, columns: list[str], *more: str) -> DataFrame:
        """The key of each row, as k0, k1, ..., where all of it is known."""
        out = rows.select(*self.key_columns(table, columns, "k"), *more)
        return out.where(reduce(lambda a, b: a & b, (F.col(f"k{k}").isNotNull() for k in range(len(columns)))))

    # checks

    def conditions(self, table: Table) -> list[tuple[SparkColumn, str]]:
        out: list[tuple[SparkColumn, str]] = []
        for c in table.columns:
            x = F.col(f"`{c.name}`")
            if not c.nullable:
                out.append((x.isNull(), f"(1048) column {c.name} cannot be null"))
            if most := length_of(c.declared):
                out.append((F.char_length(x) > most, f"(1406) data too long for column {c.name}"))
            if base_type(c.declared) == "ENUM":
                allowed = [a.strip().strip("'\"").lower() for a in arguments(c.declared)]
                out.append((~F.lower(x).isin(allowed), f"(1265) {c.name} is none of the enumerated values"))
            if base_type(c.declared) == "JSON":
                out.append((F.expr(f"quarry_json_valid(array(`{c.name}`)) = 0"), f"(3140) invalid JSON text in column {c.name}"))
        for check in table.checks:
            if check.enforced:
                out.append((F.expr(f"NOT ({self.evaluate(check.text)})"), f"(3819) check constraint {check.name} is violated"))
        return out

    def check_rows(self, table: Table, rows: DataFrame) -> None:
        found = self.conditions(table)
        if not found:
            return
        if any(base_type(c.declared) == "JSON" for c in table.columns):
            jsonfn.register(self.store.spark)
        message = F.coalesce(*(F.when(bad, F.lit(text)) for bad, text in found))
        if bad := rows.select(message.alias("m")).where("m is not null").first():
            raise SqlError(bad["m"])

    def check_keys(self, table: Table, new: DataFrame, old: DataFrame | None, touched: set[str] | None = None) -> None:
        """New rows' keys are unlike each other's and the old rows'. touched: the columns that a change sets, if known."""
        for key in table.keys():
            if touched is not None and not touched & set(map(str.lower, key.columns)):
                continue
            mine = self.keyed(new, table, key.columns)
            twice = mine.groupBy(*names(key.columns)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
            if not twice and old is not None:
                twice = self.keyed(old, table, key.columns).join(small(mine), names(key.columns), "left_semi").first()
            if twice:
                raise SqlError(f"(1062) duplicate entry {'-'.join(str(v) for v in twice[: len(key.columns)])!r} for key {table.name}.{key.name}")

    def check_parents(self, table: Table, rows: DataFrame, touched: set[str] | None = None) -> None:
        if not self.foreign_checks:
            return
        for key in table.foreign:
            if touched is not None and not touched & set(map(str.lower, key.columns)):
                continue
            parent = self.catalogue.table(self.database, key.parent)
            children = self.keyed(rows, table, key.columns).distinct()
            there = rows if parent is table and not table.folders else self.store.read(parent)
            if parent is table:
                there = there.select(*key.parent_columns).unionByName(rows.select(*key.parent_columns))
            parents = self.keyed(there, parent, key.parent_columns)
            if children.join(parents, names(key.columns), "left_anti").first():
                raise SqlError(f"(1452) a foreign key constraint fails: {table.name}.{key.name or key.columns[0]} has no such row in {key.parent}")

    def children(self, table: Table) -> list[tuple[Table, object]]:
        return [(t, k) for t in self.catalogue.tables(self.database) for k in t.foreign if k.parent.lower() == table.name.lower()]

    # inserting

    def insert(self, table: Table, rows: DataFrame, mode: str = "", update=None, step: folding.Step | None = None) -> int:
        """rows: the table's columns, and ROW with their order in the statement. mode: ignore, replace or update."""
        old = self.store.read(table)
        if mode and table.keys():
            kept = self.held(table, rows)
            if step and len(table.keys()) == 1:
                return self.insert_or_fold(table, kept, step)
            return {"ignore": self.insert_new, "replace": self.insert_instead, "update": self.insert_or_update}[mode](table, kept, old, update)
        self.check_rows(table, rows)
        self.check_keys(table, rows, old if table.folders else None)
        self.check_parents(table, rows)
        return self.store.append(table, rows)

    def held(self, table: Table, rows: DataFrame) -> DataFrame:
        return self.store.hold(table, rows)

    def firsts(self, table: Table, rows: DataFrame, key: Index, last: bool = False) -> DataFrame:
        """The first (or last) row of each key; rows whose key isn't known all stay."""
        known = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in key.columns))
        w = Window.partitionBy(*self.key_columns(table, key.columns, "k"), F.when(~known, F.col(ROW))).orderBy(F.desc(ROW) if last else F.col(ROW))
        return rows.withColumn("_n", F.when(known, F.row_number().over(w)).otherwise(1)).where("_n = 1").drop("_n")

    def matching(self, table: Table, rows: DataFrame, others: DataFrame, key: Index, how: str) -> DataFrame:
        """rows that have (left_semi) or lack (left_anti) a partner with the same key."""
        k = names(key.columns)
        mine = rows.withColumns(dict(zip([f"_{x}" for x in k], [self.folded(table, c) for c in key.columns], strict=True)))
        theirs = self.keyed(others, table, key.columns).distinct()
        on = reduce(lambda a, b: a & b, (mine[f"_{x}"] == theirs[x] for x in k))
        return mine.join(theirs, on, how).drop(*(f"_{x}" for x in k))

    def insert_new(self, table: Table, rows: DataFrame, old: DataFrame, _) -> int:
        for key in table.keys():
            rows = self.matching(table, self.firsts(table, rows, key), old, key, "left_anti")
        return self.insert(table, rows)

    def insert_instead(self, table: Table, rows: DataFrame, old: DataFrame, _) -> int:
        for key in table.keys():
            rows = self.firsts(table, rows, key, last=True)
        rows = self.held(table, rows)
        gone = None
        for key in table.keys():
            hit = self.matching(table, old, rows, key, "left_semi").select(ROW)
            gone = hit if gone is None else gone.unionByName(hit)
        removed = self.delete(table, gone.distinct())
        return removed + self.insert(table, rows)

    def turns(self, table: Table, rows: DataFrame) -> DataFrame:
        """rows with _turn, their place among those that they are connected with by equal keys, of whichever key."""
        if len(table.keys()) == 1:
            key = table.keys()[0]
            known = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in key.columns))
            turn = Window.partitionBy(*self.key_columns(table, key.columns, "k"), F.when(~known, F.col(ROW))).orderBy(ROW)
            return rows.withColumn("_turn", F.row_number().over(turn))
        label = "_of"
        known = {key.name: reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in key.columns)) for key in table.keys()}
        marked = rows.withColumn(label, F.col(ROW))
        while True:
            least = marked
            for key in table.keys():
                same = Window.partitionBy(*self.key_columns(table, key.columns, "k"), F.when(~known[key.name], F.col(ROW)))
                least = least.withColumn(label, F.when(known[key.name], F.min(label).over(same)).otherwise(F.col(label)))
            least = self.store.keep(least, "turns")
            if least.agg(F.sum(F.col(label).cast("decimal(38,0)"))).first() == marked.agg(F.sum(F.col(label).cast("decimal(38,0)"))).first():
                break
            marked = least
        return marked.withColumn("_turn", F.row_number().over(Window.partitionBy(label).orderBy(ROW))).drop(label)

    def insert_or_update(self, table: Table, rows: DataFrame, old: DataFrame, update) -> int:
        """Rows with new keys go in, others change the row that has the first of their keys; rows that meet on a key take turns."""
        turns = self.turns(table, rows)
        count = 0
        most = turns.agg(F.max("_turn")).first()[0] or 0
        for k in range(1, most + 1):
            now = rows if most == 1 else self.held(table, turns.where(F.col("_turn") == k).drop("_turn"))
            for other in table.keys():
                there = self.store.read(table)
                hit = self.held(table, self.matching(table, now, there, other, "left_semi"))
                if hit.isEmpty():
                    continue
                now = self.held(table, self.matching(table, now, there, other, "left_anti"))
                count += update(table, hit, other)
            if not now.isEmpty():
                count += self.insert(table, now)
        return count

    def insert_or_fold(self, table: Table, rows: DataFrame, step: folding.Step) -> int:
        """An upsert on a table's only key: the rows of a key are folded in their order, onto the old row or the first of them."""
        key = table.keys()[0]
        known = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in key.columns))
        k = names(key.columns)
        by = dict(zip(k, [self.folded(table, c) for c in key.columns], strict=True))
        own = [F.col(f"`{c.name}`") for c in table.columns]
        marked = rows.withColumns({**by, "_alone": F.when(~known, F.col(ROW))})
        there = self.store.read(table).select(*(c.alias(n) for n, c in by.items()), F.struct(*own).alias("_there"), F.col(ROW).alias("_at"))
        there = there.join(marked.select(*k).distinct(), k, "left_semi")
        news = marked.select(*k, "_alone", F.struct(*own).alias("_new"), F.col(ROW).alias("_seq"), F.lit(None).cast("bigint").alias("_at"))
        olds = there.select(*k, F.lit(None).cast("bigint").alias("_alone"), F.col("_there").alias("_new"), F.lit(-1).cast("bigint").alias("_seq"), "_at")
        made = folding.run(news.unionByName(olds), [*k, "_alone"], {c.name: spark_type(c.declared) for c in table.columns}, step)
        if made is not None:
            made = self.store.keep(made.select("row", "_at", "_seq", "_n"), "folded")
        else:
            made = self.fold_in_turns(marked, there, k, own, step)
        changed, fresh = (made.where(c).select("row.*", F.coalesce("_at", "_seq").alias(ROW)) for c in ("_at IS NOT NULL", "_at IS NULL"))
        self.update(table, changed, {c.name.lower() for c in table.columns} - set(map(str.lower, key.columns)))
        self.insert(table, fresh)
        return made.agg(F.sum("_n")).first()[0] or 0

    def fold_in_turns(self, marked: DataFrame, there: DataFrame, k: list[str], own: list[SparkColumn], step: folding.Step) -> DataFrame:
        """The same for any assignments: FOLD bytes of each key at a time, from the row that the turn before left."""
        order = Window.partitionBy(*k, "_alone").orderBy(ROW)
        read = [c for c in marked.columns if c in step.reads("_new")]
        texts = [c for c in read if isinstance(marked.schema[c].dataType, T.StringType)]
        size = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) for c in texts), F.lit(32 + 16 * len(read)).cast("bigint"))
        marked = marked.withColumn("_size", size)
        marked = marked.withColumn("_turn", F.floor((F.sum("_size").over(order) - F.col("_size")) / FOLD))
        marked = self.store.keep(marked.withColumn("_last", F.max("_turn").over(Window.partitionBy(*k, "_alone"))), "turns", "_turn")
        turns = sorted(r["_turn"] for r in marked.select("_turn").distinct().collect())
        out, state = [], None
        for turn in turns:
            rows = F.sort_array(F.collect_list(F.struct(ROW, *(f"`{c}`" for c in read)))).alias("_rows")
            groups = marked.where(F.col("_turn") == turn).groupBy(*k, "_alone").agg(rows, F.max("_last").alias("_last"), F.count(F.lit(1)).alias("_more"), *([F.min_by(F.struct(*own), ROW).alias("_head")] if state is None else []))
            if state is None:
                met = groups.join(there, k, "left").withColumns({"_n": F.lit(0), "_seq": F.expr(f"_rows[0].{ROW}")})
                start, rest = "CASE WHEN _at IS NULL THEN _head ELSE _there END", "CASE WHEN _at IS NULL THEN slice(_rows, 2, size(_rows)) ELSE _rows END"
            else:
                met = groups.join(state.select(*k, "row", "_at", "_seq", "_n"), k)
                start, rest = "row", "_rows"
            folded = F.expr(f"aggregate({rest}, {start}, (`_old`, `_new`) -> named_struct({step.text}))")
            state = self.store.keep(met.select(*k, folded.alias("row"), "_at", "_seq", (F.col("_n") + F.col("_more")).alias("_n"), "_last"), "folded", sorted_groups=True)
            out.append(state.where(F.col("_last") == turn))
        return reduce(DataFrame.unionByName, out) if out else there.where("false").select(F.col("_there").alias("row"), "_at", F.col("_at").alias("_seq"), F.lit(0).alias("_n"))

    # changing

    def update(self, table: Table, changed: DataFrame, touched: set[str] | None = None, depth: int = 0) -> int:
        """changed: whole new rows, by their number. touched: the columns that may differ from before; only their keys are checked."""
        changed = self.held(table, changed)
        count = changed.count()
        if not count:
            return 0
        if touched is not None:
            touched = {c.lower() for c in touched} | {c.name.lower() for c in table.columns if c.on_update}
        self.check_rows(table, changed)
        old = self.store.read(table)
        ids = small(changed.select(ROW))
        self.check_keys(table, changed, old.join(ids, ROW, "left_anti"), touched)
        if any(touched is None or touched & set(map(str.lower, k.parent_columns)) for _, k in self.children(table)):
            self.follow(table, old.join(ids, ROW, "left_semi"), changed, depth)
        self.store.rewrite(table, ids, changed)
        self.check_parents(table, changed, touched)
        return count

    def delete(self, table: Table, ids: DataFrame, depth: int = 0) -> int:
        """The rows of these numbers, and what follows from it."""
        old = self.store.read(table)
        ids = ids.distinct()
        gone = self.held(table, old.join(small(ids), ROW, "left_semi"))
        count = gone.count()
        if not count:
            return 0
        self.store.rewrite(table, small(gone.select(ROW)), None)
        table.rows = None if table.rows is None else table.rows - count
        self.follow(table, gone, None, depth)
        return count

    def follow(self, table: Table, before: DataFrame, after: DataFrame | None, depth: int) -> None:
        """Foreign keys' actions for rows that are gone, or whose key has changed."""
        if not self.foreign_checks:
            return
        if depth >= MOST_DEPTH:
            raise SqlError("(3008) foreign key actions are nested too deeply")
        for child, key in self.children(table):
            k = names(key.columns)
            gone = self.keyed(before, table, key.parent_columns, ROW)
            if after is not None:
                gone = gone.join(self.keyed(after, table, key.parent_columns, ROW), [*k, ROW], "left_anti")
            rows = self.store.read(child)
            mine = rows.withColumns(dict(zip([f"_{x}" for x in k], [self.folded(child, c) for c in key.columns], strict=True)))
            gone = gone.withColumnRenamed(ROW, "_parent")
            on = reduce(lambda a, b: a & b, (mine[f"_{x}"] == gone[x] for x in k))
            hit = mine.join(gone, on)
            if not hit.limit(1).count():
                continue
            action = key.on_delete if after is None else key.on_update
            if action in ("RESTRICT", "NO ACTION", "SET DEFAULT"):
                raise SqlError(f"(1451) a foreign key constraint fails: rows of {child.name} refer to this row of {table.name}")
            if action == "SET NULL":
                new = hit.select(*(F.lit(None).alias(c) if c.lower() in {x.lower() for x in key.columns} else F.col(f"`{c}`") for c in rows.columns))
                self.update(child, new, None, depth + 1)
            elif after is None:
                self.delete(child, hit.select(ROW), depth + 1)
            else:
                moved = after.select(F.col(ROW).alias("_parent"), *(F.col(f"`{p}`").alias(f"_new{n}") for n, p in enumerate(key.parent_columns)))
                place = {c.lower(): n for n, c in enumerate(key.columns)}
                new = hit.join(moved, "_parent").select(*(F.col(f"_new{place[c.lower()]}").alias(c) if c.lower() in place else F.col(f"`{c}`") for c in rows.columns))
                checks, self.foreign_checks = self.foreign_checks, False
                try:
                    self.update(child, new, None, depth + 1)
                finally:
                    self.foreign_checks = checks
