"""The catalogue's revisions, garbage beside running work, and rewriting only files that hold changed rows."""

import pytest

from quarry.plans.lexer import SqlError
from quarry.session import Session


@pytest.fixture
def two(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    a = Session(spark, root)
    a.script("CREATE TABLE t (k INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 1), (2, 2)")
    return a, Session(spark, root)


def rows(session, text="SELECT k, v FROM t ORDER BY k"):
    return [tuple(r) for r in session.sql(text).collect()]


def test_garbage_collection_spares_an_open_transaction(two):
    a, b = two
    a.script("BEGIN; INSERT INTO t VALUES (3, 3); UPDATE t SET v = 9 WHERE k = 1")
    a.sql("GC MVCC")
    b.sql("GC MVCC")
    assert rows(a) == [(1, 9), (2, 2), (3, 3)]
    a.sql("COMMIT")
    assert rows(a) == rows(b) == [(1, 9), (2, 2), (3, 3)]
    b.sql("GC MVCC")
    assert rows(a) == [(1, 9), (2, 2), (3, 3)]


def test_garbage_collection_spares_a_savepoint_and_the_revision_of_a_reader(two):
    a, b = two
    a.script("BEGIN; INSERT INTO t VALUES (3, 3); SAVEPOINT s; UPDATE t SET v = 0")
    b.sql("BEGIN")
    Session(a.spark, a.store.root).script("DELETE FROM t WHERE k = 2; GC MVCC")
    a.script("GC MVCC; ROLLBACK TO s")
    assert rows(a) == [(1, 1), (2, 2), (3, 3)]
    assert rows(b) == [(1, 1), (2, 2)]
    a.sql("ROLLBACK")
    b.sql("ROLLBACK")


def test_two_publishers_of_one_revision(two):
    a, b = two
    a.script("BEGIN; INSERT INTO t VALUES (3, 3)")
    b.script("BEGIN; INSERT INTO t VALUES (4, 4)")
    a.sql("COMMIT")
    with pytest.raises(SqlError, match="1213"):
        b.sql("COMMIT")
    assert rows(a) == rows(b) == [(1, 1), (2, 2), (3, 3)]


def test_a_crash_between_the_steps_of_publishing_leaves_the_old_revision(two, monkeypatch, tmp_path):
    a, b = two
    before = a.store.revisions()
    held = a.store.load()
    held.revision -= 1  # as of a session that was too slow
    with pytest.raises(SqlError, match="1213"):
        a.store.publish(held)
    (tmp_path / "w" / "writing-dead.json").write_text("{half")
    assert a.store.revisions() == before
    assert rows(b) == [(1, 1), (2, 2)]
    b.sql("INSERT INTO t VALUES (5, 5)")
    assert rows(a)[-1] == (5, 5)


def test_old_revisions_go(two, monkeypatch):
    a, _ = two
    monkeypatch.setattr("quarry.sources.store.REVISIONS", 2)
    for k in range(4):
        a.sql(f"INSERT INTO t VALUES ({10 + k}, 0)")
    assert len(a.store.revisions()) == 3
    assert len(rows(a)) == 6


def test_only_files_with_changed_rows_are_written_anew(two):
    a, _ = two
    a.sql("INSERT INTO t VALUES (3, 3)")
    first, second = a.store.load().table("quarry", "t").folders
    a.sql("UPDATE t SET v = 30 WHERE k = 3")
    kept = a.store.load().table("quarry", "t").folders
    assert first in kept and second not in kept
    a.sql("DELETE FROM t WHERE k = 2")
    a.sql("GC MVCC")
    assert rows(a) == [(1, 1), (3, 30)]
    a.sql("COMPACT TABLE t")
    a.sql("GC MVCC")
    assert rows(a) == [(1, 1), (3, 30)]
    a.sql("DELETE FROM t WHERE k > 0")
    assert rows(a) == []
