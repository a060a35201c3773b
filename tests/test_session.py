"""Statements with MySQL's semantics: predicates, changes, constraints, transactions, definitions, metadata."""

import pytest

from quarry.plans.lexer import SqlError, statements, tokens
from quarry.session import Done, Session


@pytest.fixture
def db(spark):
    return Session(spark)


def got(db, text, args=None):
    out = db.sql(text, args)
    return out if isinstance(out, Done) else [tuple(r) for r in out.collect()]


@pytest.fixture
def users(db):
    db.script("""
        CREATE TABLE users (id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(10) NOT NULL, age INT DEFAULT 7, email VARCHAR(20) UNIQUE, CONSTRAINT sane CHECK (age < 200));
        INSERT INTO users (name, age, email) VALUES ('Ann', 30, 'a@x'), ('bob', NULL, 'b@x'), ('Cy', DEFAULT, NULL);
    """)
    return db


def test_lexer():
    assert [t.text for t in tokens("SELECT 'it''s', \"a\\nb\" -- x\n, `q``t` # y\n, 1.5e3 /* z */")] == ["SELECT", "it's", ",", "a\nb", ",", "q`t", ",", "1.5e3", ""]
    assert statements("SELECT 1; /*!40101 SET x = 1 */; ;SELECT ';'") == ["SELECT 1", "SET x = 1", "SELECT ';'"]
    with pytest.raises(SqlError):
        tokens("SELECT 'open")


def test_no_table(db):
    assert got(db, "SELECT 7 / 2 AS a, 5 / 0 AS b, 5 % 0 AS c, 7 DIV 2 AS d, NULL <=> NULL AS e, 1 IN (2, NULL) AS f, NOT NULL AS g") == [(3.5, None, None, 3, True, None, None)]
    assert got(db, "SELECT IF('0', 1, 2) AS a, IF('', 1, 2) AS b, IF(0.0, 1, 2) AS c, GREATEST(1, NULL) AS d, LENGTH('é') AS e, CHAR_LENGTH('é') AS f") == [(1, 2, 2, None, 2, 1)]
    assert got(db, "SELECT SUBSTRING('hello', 0) AS a, SUBSTRING('hello', -3, 2) AS b, LPAD('x', 3, '') AS c, TRIM('\t x ') AS d, LOCATE('L', 'hello') AS e") == [("", "ll", None, "x", 0)]
    assert got(db, "SELECT TRUNCATE(-1.59, 1) AS a, ROUND(2.5) AS b, SQRT(-1) AS c, LOG(1, 5) AS d, SIGN(-3) AS e")[0][1:] == (3, None, None, -1)
    assert got(db, "SELECT ? + ? AS s, ? AS t", [1, 2, "it's"]) == [(3, "it's")]
    assert got(db, "SELECT DATABASE(), VERSION() = @@version") == [("quarry", True)]
    with pytest.raises(SqlError):
        db.sql("SELECT LEFT('a')")
    with pytest.raises(SqlError):
        db.sql("SELECT ?", [])
    with pytest.raises(SqlError):
        db.sql("SELECT 1 FROM nowhere")


def test_case_does_not_matter(users):
    assert got(users, "SELECT id FROM users WHERE name = 'ANN'") == [(1,)]
    assert got(users, "SELECT id FROM users WHERE name LIKE '%B' ORDER BY 1") == [(2,)]
    users.sql("SET NAMES utf8mb4 COLLATE utf8mb4_bin")
    assert got(users, "SELECT id FROM users WHERE name = 'ANN'") == []


def test_insert(users):
    assert users.sql("INSERT INTO users (name) VALUES ('x'), ('y')") == Done(2, 4)
    assert got(users, "SELECT id, name, age FROM users WHERE id > 3 ORDER BY id") == [(4, "x", 7), (5, "y", 7)]
    users.sql("INSERT INTO users SET name = 'z', id = 50")
    assert users.sql("INSERT INTO users (name) SELECT name FROM users WHERE id = 1").last_insert_id == 51
    for bad in ("('dup', 1, 'A@X')", "('a name that is too long', 1, NULL)", "(NULL, 1, NULL)", "('old', 300, NULL)"):
        with pytest.raises(SqlError):
            users.sql(f"INSERT INTO users (name, age, email) VALUES {bad}")
    with pytest.raises(SqlError):
        users.sql("INSERT INTO users (name) VALUES ('a', 'b')")
    assert got(users, "SELECT COUNT(*) FROM users") == [(7,)]


def test_insert_modes(users):
    assert users.sql("INSERT IGNORE INTO users (name, email) VALUES ('d', 'A@X'), ('n', 'n@x'), ('m', 'N@x')").affected == 1
    assert users.sql("REPLACE INTO users (id, name, email) VALUES (1, 'R', 'n@x')").affected == 3
    assert got(users, "SELECT id, name, email FROM users ORDER BY id") == [(1, "R", "n@x"), (2, "bob", "b@x"), (3, "Cy", None)]
    users.sql("INSERT INTO users (id, name, age) VALUES (1, 'q', 1), (9, 'nine', 9), (9, 'w', 5) ON DUPLICATE KEY UPDATE age = VALUES(age) + 100, name = CONCAT(name, age)")
    assert got(users, "SELECT id, name, age FROM users WHERE id IN (1, 9) ORDER BY id") == [(1, "R101", 101), (9, "nine105", 105)]


def test_update(users):
    assert users.sql("UPDATE users SET age = age + 1, name = CONCAT(name, age) WHERE id = 1").affected == 1
    assert got(users, "SELECT name, age FROM users WHERE id = 1") == [("Ann31", 31)]  # from left to right
    assert users.sql("UPDATE users SET age = (SELECT MAX(age) FROM users) ORDER BY id DESC LIMIT 2").affected == 2
    assert got(users, "SELECT id, age FROM users ORDER BY id") == [(1, 31), (2, 31), (3, 31)]
    with pytest.raises(SqlError):
        users.sql("UPDATE users SET email = 'same'")
    with pytest.raises(SqlError):
        users.sql("UPDATE users SET age = 999")


def test_update_join_takes_the_first_match(users):
    users.script("CREATE TABLE d (uid INT, delta INT); INSERT INTO d VALUES (1, 5), (1, 9), (3, 2)")
    assert users.sql("UPDATE users u JOIN d ON d.uid = u.id SET u.age = d.delta").affected == 2
    assert got(users, "SELECT id, age FROM users ORDER BY id") == [(1, 5), (2, None), (3, 2)]


def test_delete(users):
    assert users.sql("DELETE FROM users ORDER BY id LIMIT 1").affected == 1
    users.script("CREATE TABLE d (uid INT); INSERT INTO d VALUES (2), (2), (8)")
    assert users.sql("DELETE u, d FROM users u JOIN d ON d.uid = u.id").affected == 3
    assert got(users, "SELECT id FROM users") == [(3,)]
    assert got(users, "SELECT uid FROM d") == [(8,)]
    users.sql("TRUNCATE TABLE users")
    assert got(users, "SELECT COUNT(*) FROM users") == [(0,)]


def test_foreign_keys(db):
    db.script("""
        CREATE TABLE p (k INT PRIMARY KEY); INSERT INTO p VALUES (1), (2), (3), (4);
        CREATE TABLE c (k INT PRIMARY KEY, p INT, FOREIGN KEY (p) REFERENCES p (k) ON DELETE CASCADE ON UPDATE CASCADE);
        CREATE TABLE g (k INT PRIMARY KEY, c INT, FOREIGN KEY (c) REFERENCES c (k) ON DELETE SET NULL);
        CREATE TABLE r (p INT, FOREIGN KEY (p) REFERENCES p (k));
        INSERT INTO c VALUES (10, 1), (20, 2), (30, NULL); INSERT INTO g VALUES (100, 10), (200, 20); INSERT INTO r VALUES (4);
    """)
    with pytest.raises(SqlError, match="1452"):
        db.sql("INSERT INTO c VALUES (40, 9)")
    with pytest.raises(SqlError, match="1451"):
        db.sql("DELETE FROM p WHERE k = 4")
    db.sql("DELETE FROM p WHERE k = 1")
    assert got(db, "SELECT * FROM g ORDER BY k") == [(100, None), (200, 20)]
    db.sql("UPDATE p SET k = 22 WHERE k = 2")
    assert got(db, "SELECT * FROM c ORDER BY k") == [(20, 22), (30, None)]
    with pytest.raises(SqlError, match="3730"):
        db.sql("DROP TABLE p")
    db.sql("SET foreign_key_checks = 0")
    db.sql("DELETE FROM p WHERE k = 4")
    assert got(db, "SELECT p FROM r") == [(4,)]


def test_transactions(users):
    users.script("BEGIN; DELETE FROM users WHERE id = 1; SAVEPOINT a; DELETE FROM users")
    other = Session(users.spark, users.store.root)
    assert got(other, "SELECT COUNT(*) FROM users") == [(3,)]
    assert got(users, "SELECT COUNT(*) FROM users") == [(0,)]
    users.sql("ROLLBACK TO a")
    other.sql("INSERT INTO users (name) VALUES ('first')")
    with pytest.raises(SqlError, match="1213"):
        users.sql("COMMIT")
    assert got(users, "SELECT COUNT(*) FROM users") == [(4,)]


def test_a_failed_statement_changes_nothing(users):
    with pytest.raises(SqlError):
        users.sql("INSERT INTO users (name, email) VALUES ('ok', 'new@x'), ('bad', 'a@x')")
    assert got(users, "SELECT COUNT(*) FROM users") == [(3,)]


def test_views(users):
    users.script("CREATE VIEW v (a, b) AS SELECT id, UPPER(name) FROM users; CREATE VIEW w AS SELECT b FROM v WHERE a > 1")
    assert got(users, "SELECT b FROM w ORDER BY b") == [("BOB",), ("CY",)]
    with pytest.raises(SqlError, match="1462"):
        users.sql("CREATE OR REPLACE VIEW v AS SELECT b FROM w")
    with pytest.raises(SqlError):
        users.sql("CREATE TABLE v (a INT)")
    users.sql("DROP VIEW w, v")
    with pytest.raises(SqlError):
        users.sql("SELECT * FROM v")


def test_alter(users):
    users.sql("ALTER TABLE users ADD COLUMN city VARCHAR(9) DEFAULT 'Rome' AFTER id, RENAME COLUMN name TO nick, MODIFY age BIGINT, DROP INDEX email")
    assert got(users, "SELECT * FROM users WHERE id = 1") == [(1, "Rome", "Ann", 30, "a@x")]
    users.sql("INSERT INTO users (nick, email) VALUES ('x', 'a@x')")
    with pytest.raises(SqlError, match="1062"):
        users.sql("ALTER TABLE users ADD UNIQUE KEY again (email)")
    with pytest.raises(SqlError, match="3959"):
        users.sql("ALTER TABLE users DROP COLUMN age")
    users.sql("RENAME TABLE users TO people")
    users.sql("CREATE INDEX by_city ON people (city)")
    assert [r[2] for r in got(users, "SHOW INDEX FROM people")] == ["PRIMARY", "by_city"]


def test_metadata(users, tmp_path):
    assert got(users, "SHOW TABLES") == [("users",)]
    assert [r[:4] for r in got(users, "DESCRIBE users")] == [("id", "int", "NO", "PRI"), ("name", "varchar(10)", "NO", ""), ("age", "int", "YES", ""), ("email", "varchar(20)", "YES", "UNI")]
    assert "CONSTRAINT `sane` CHECK (age < 200)" in got(users, "SHOW CREATE TABLE users")[0][1]
    assert got(users, "SELECT CONSTRAINT_TYPE FROM information_schema.table_constraints ORDER BY 1") == [("CHECK",), ("PRIMARY KEY",), ("UNIQUE",)]
    assert got(users, "SELECT COUNT(*) FROM information_schema.routines") == [(0,)]
    plan = users.sql("EXPLAIN SELECT id FROM users WHERE age > 3")
    assert len(plan.columns) == 12 and "Filter" in plan.first()["Extra"]
    users.sql(f"EXPORT DATABASE quarry TO 'file://{tmp_path}/dump'")
    dump = "\n".join(p.read_text() for d in ("definitions", "data/users") for p in sorted((tmp_path / "dump" / d).glob("part-*")))
    copy = Session(users.spark)
    copy.restore(dump)
    assert got(copy, "SELECT * FROM users ORDER BY id") == got(users, "SELECT * FROM users ORDER BY id")


def test_like_and_as(users):
    users.script("CREATE TABLE l LIKE users; CREATE TABLE s AS SELECT id, age / 2 AS half FROM users")
    assert got(users, "SELECT COUNT(*) FROM l") == [(0,)]
    assert got(users, "SELECT half FROM s WHERE id = 1") == [(15.0,)]


def test_maintenance(users, spark):
    from pathlib import Path

    users.sql("INSERT INTO users (name) VALUES ('x')")
    assert users.sql("COMPACT TABLE users").affected == 2
    data = Path(users.store.root.removeprefix("file://")) / "data"
    assert users.sql("GC MVCC").affected == 2
    assert len(list(data.iterdir())) == 1
    assert got(users, "SELECT COUNT(*) FROM users") == [(4,)]


def test_import_of_frames(db, spark):
    from quarry.sources.importer import import_tables

    assert import_tables(db, {"n": spark.range(5).withColumnRenamed("id", "k")}) == 5
    assert got(db, "SELECT SUM(k) FROM n") == [(10,)]
