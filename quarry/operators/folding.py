"""How the rows of one key change its row one after another, read from an upsert's assignments.

The row that a step starts from follows from running aggregates over the rows before it, where each column that the
assignments read is itself unassigned, or assigned one of

    g                                      the row before's g
    c + g, g + c, c - g                    a running sum; exact for whole numbers and decimals, in the rows' order for doubles
    GREATEST(c, g), LEAST(c, g)            a running extreme
    IF(p, g, c), IF(p, c, g), IFNULL(g, c)   the last g for which p held

with p and g of the new row and of columns that are already known so. Then no row has to wait for the one before, and a
key's rows need no memory. Every step is still computed, so what fails in one of them fails the statement.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
EXTREMES = (T.IntegerType, T.LongType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampNTZType)


@dataclass(frozen=True)
class Shape:
    """What an assignment does to its column. when: a condition that has to hold (set), or must not (keep)."""

    kind: str
    value: str
    when: str = ""
    reads: frozenset[str] = frozenset()  # columns of the old row


@dataclass
class Step:
    """text: the fields of the row that `_old` and `_new` make. assigned: the expressions of the columns that change, before their cast."""

    text: str
    assigned: dict[str, str]
    parse: Callable
    refs: dict[str, set[tuple[str, str]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.refs = {c: references(self.parse(x)) for c, x in self.assigned.items()}

    def reads(self, side: str) -> set[str]:
        return {c for found in self.refs.values() for s, c in found if s == side}

    def levels(self) -> list[dict[str, Shape]] | None:
        """The assigned columns that the step reads, by what they depend on; None where one isn't of a known shape."""
        left = [c for c in self.assigned if c in self.reads("_old")]
        shapes = {c: shape(self.parse, c, self.assigned[c]) for c in left}
        if None in shapes.values():
            return None
        out: list[dict[str, Shape]] = []
        while left:
            now = {c: shapes[c] for c in left if not shapes[c].reads & set(left)}
            if not now:
                return None
            out.append(now)
            left = [c for c in left if c not in now]
        return out


def children(node) -> list:
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


def kind(node) -> str:
    return node.getClass().getSimpleName()


def named(node) -> tuple[str, ...]:
    parts = node.nameParts()
    return tuple(parts.apply(i) for i in range(parts.size()))


def references(node) -> set[tuple[str, str]]:
    """(`_old` or `_new`, column) of all that an expression reads."""
    if kind(node) == "UnresolvedAttribute":
        return {named(node)[:2]}
    return {r for c in children(node) for r in references(c)}


def shape(parse: Callable, column: str, text: str) -> Shape | None:
    own = ("_old", column)
    node = parse(text)

    def is_own(x) -> bool:
        return kind(x) == "UnresolvedAttribute" and named(x) == own

    def piece(x) -> str:
        return f"({text[x.origin().startIndex().get() : x.origin().stopIndex().get() + 1]})"

    def made(what: str, value, when=None) -> Shape | None:
        found = references(value) | (references(when) if when is not None else set())
        if own in found:
            return None
        if any(not parse(piece(x)).equals(x) for x in (value, when) if x is not None):
            return None
        return Shape(what, piece(value), piece(when) if when is not None else "", frozenset(c for s, c in found if s == "_old"))

    if own not in references(node):
        return Shape("last", text, "", frozenset(c for s, c in references(node) if s == "_old"))
    parts = children(node)
    if kind(node) in ("Add", "Subtract"):
        a, b = parts[:2]
        if is_own(a):
            return made("sum" if kind(node) == "Add" else "minus", b)
        return made("sum", a) if is_own(b) and kind(node) == "Add" else None
    if kind(node) == "UnresolvedFunction" and named(node)[-1].lower() == "coalesce" and len(parts) == 2 and is_own(parts[1]):
        found = made("set", parts[0])
        return found and Shape("set", found.value, f"({found.value} IS NOT NULL)", found.reads)
    if kind(node) == "CaseWhen" and len(parts) == 3:
        when, a, b = parts
        if is_own(b):
            return made("set", a, when)
        if is_own(a):
            return made("keep", b, when)
        if kind(b) == "UnresolvedFunction" and (name := named(b)[-1].lower()) in ("greatest", "least") and len(children(b)) == 2:
            x, y = children(b)
            nulls = f"CASE WHEN {piece(x)} IS NULL OR {piece(y)} IS NULL THEN NULL ELSE {name}({piece(x)}, {piece(y)}) END"
            if parse(nulls).equals(node) and is_own(x) != is_own(y):
                return made(name, y if is_own(x) else x)
    return None


def sum_type(column: T.DataType, value: T.DataType) -> T.DataType | None:
    """What holds a running sum without loss; None where steps would round."""
    digits = (WHOLE[type(value)], 0) if type(value) in WHOLE else (value.precision, value.scale) if isinstance(value, T.DecimalType) else None
    if type(column) in (T.IntegerType, T.LongType):
        return T.LongType() if type(value) in WHOLE else None
    if isinstance(column, T.DoubleType):
        return column if digits or isinstance(value, T.DoubleType) else None
    if isinstance(column, T.DecimalType) and digits and digits[1] <= column.scale:
        most = max(column.precision - column.scale, digits[0] - digits[1]) + column.scale + 1
        return T.DecimalType(most, column.scale) if most <= 28 else None
    return None


def run(rows: DataFrame, by: list[str], types: dict[str, T.DataType], step: Step) -> DataFrame | None:
    """One row for each key: `row` after all steps, `_at`, `_seq` of the first row, `_n` new rows; None if only turns will do.

    rows: the columns by, `_new` (a whole row), `_seq` (its order, -1 for the row that was there) and `_at` (the latter's number).
    """
    levels = step.levels()
    if levels is None:
        return None
    ansi = rows.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"
    order = Window.partitionBy(*by).orderBy("_seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stay = {c: f"_stay{n}" for n, c in enumerate(types) if c not in step.assigned}
    rows = rows.withColumns({"_first": F.row_number().over(order) == 1, **{name: F.first(f"_new.`{c}`").over(before) for c, name in stay.items()}})
    known: dict[str, SparkColumn] = {c: F.col(name) for c, name in stay.items()}

    def old() -> SparkColumn:
        return F.struct(*(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()))

    for level in levels:
        rows = rows.withColumn("_old", old())
        for c, s in level.items():
            to, own, name = types[c], F.col(f"_new.`{c}`"), f"_run{len(known)}"
            value, first = F.expr(s.value), F.col("_first")
            given = rows.select(value.alias("x")).schema["x"].dataType
            if s.kind in ("sum", "minus"):
                if (held := sum_type(to, given)) is None:
                    return None
                value = value.cast(held)
                rows = rows.withColumn(name, F.when(first, own.cast(held)).otherwise(-value if s.kind == "minus" else value))
                # where a step overflows it fails by itself, so that what follows doesn't matter
                seen = (F.try_sum if ansi else F.sum)(name).over(before)
            elif s.kind in ("greatest", "least"):
                if not isinstance(to, EXTREMES) or not (given == to or type(to) in WHOLE and WHOLE.get(type(given), 99) <= WHOLE[type(to)]):
                    return None
                rows = rows.withColumn(name, F.when(first, own).otherwise(value.cast(to)))
                seen = (F.max if s.kind == "greatest" else F.min)(name).over(before)
            elif s.kind == "last":
                rows = rows.withColumn(name, F.when(first, own).otherwise(value.cast(to)))
                seen = F.last(name).over(before)
            else:
                value = F.struct(value.cast(to).alias("x"))
                held = F.when(F.expr(s.when), value) if s.kind == "set" else F.when(F.expr(s.when), F.lit(None)).otherwise(value)
                rows = rows.withColumn(name, F.when(first, F.struct(own.alias("x"))).otherwise(held))
                seen = F.last(name, ignorenulls=True).over(before)["x"]
            if s.kind in ("sum", "minus", "greatest", "least"):
                seen = F.when(~F.max(F.col(name).isNull()).over(before), seen)  # a null stays one
            rows = rows.withColumn(f"{name}_", seen.cast(to))
            known[c] = F.col(f"{name}_")
    made = F.when(F.col("_first"), F.col("_new")).otherwise(F.expr(f"named_struct({step.text})"))
    rows = rows.withColumn("_old", old()).withColumn("_made", made)
    return rows.groupBy(*by).agg(F.max_by("_made", "_seq").alias("row"), F.max("_at").alias("_at"), F.min("_seq").alias("_seq"), F.count(F.when(F.col("_seq") >= 0, 1)).alias("_n"))
