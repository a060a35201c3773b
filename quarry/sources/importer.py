"""Tables of a running MySQL server, through Spark's JDBC source (the server's driver must be on the class path)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.session import Session
from quarry.sources.store import Column, Table, declared_type


def read(session: Session, url: str, table: str, key: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """One table; with a numeric key it is read in so many parts at once, each a range of keys."""
    found = session.spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if key and parts > 1:
        low, high = session.spark.read.format("jdbc").options(url=url, query=f"SELECT MIN({key}) a, MAX({key}) b FROM {table}", **options).load().first()
        if low is not None and high > low:
            found = found.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return found.load()


def import_tables(session: Session, tables: dict[str, DataFrame]) -> int:
    """Frames, from JDBC or any other source, as new tables of the session's database; the number of rows."""

    def work(catalogue) -> int:
        held, count = catalogue.databases[session.database.lower()], 0
        for name, rows in tables.items():
            made = Table(name, [Column(f.name, declared_type(f.dataType), f.nullable) for f in rows.schema])
            held[name.lower()] = made
            count += session.store.append(made, rows)
        return count

    return session.changing(work).affected


def import_database(session: Session, url: str, names: list[str], **options: str) -> int:
    return import_tables(session, {n: read(session, url, n, **options) for n in names})
