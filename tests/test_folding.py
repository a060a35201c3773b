"""Upserts whose rows meet on one key: as if done one after another, in a number of passes that doesn't follow the rows."""

import random

import pytest

from quarry.operators import changes, folding
from quarry.session import Session
from quarry.sources.store import Store

UPDATE = """n = n + VALUES(n), total = total + n, d = VALUES(d) + d, m = m - VALUES(m), best = IF(VALUES(ts) > ts, VALUES(best), best),
    ts = GREATEST(ts, VALUES(ts)), low = LEAST(VALUES(low), low), held = IFNULL(VALUES(held), held), firm = IF(VALUES(n) < 0, firm, VALUES(firm)),
    was = now, now = VALUES(now), parity = IF(n % 2 = 0, 'even', CONCAT('odd', n))"""
COLUMNS = ("k", "n", "total", "d", "m", "best", "ts", "low", "held", "firm", "was", "now", "parity", "other")


@pytest.fixture
def db(spark):
    return Session(spark)


def made(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path := f"{tmp_path}/new")
    return path


def passes(monkeypatch) -> list[str]:
    seen, keep = [], Store.keep
    monkeypatch.setattr(Store, "keep", lambda self, rows, name, *a, **b: (seen.append(name), keep(self, rows, name, *a, **b))[1])
    return seen


def greatest(f, a, b):
    return None if a is None or b is None else f(a, b)


def plus(a, b):
    return None if a is None or b is None else a + b


def after(old: dict, new: dict) -> dict:
    r = dict(old)
    r["n"] = plus(r["n"], new["n"])
    r["total"] = plus(r["total"], r["n"])
    r["d"] = plus(new["d"], r["d"])
    r["m"] = None if new["m"] is None or r["m"] is None else r["m"] - new["m"]
    if None not in (new["ts"], r["ts"]) and new["ts"] > r["ts"]:
        r["best"] = new["best"]
    r["ts"] = greatest(max, r["ts"], new["ts"])
    r["low"] = greatest(min, r["low"], new["low"])
    r["held"] = r["held"] if new["held"] is None else new["held"]
    if not (new["n"] is not None and new["n"] < 0):
        r["firm"] = new["firm"]
    r["was"], r["now"] = r["now"], new["now"]
    r["parity"] = "even" if r["n"] is not None and r["n"] % 2 == 0 else None if r["n"] is None else f"odd{r['n']}"
    return r


@pytest.mark.parametrize("in_turns", [False, True])
def test_every_shape_is_as_one_by_one(db, spark, tmp_path, monkeypatch, in_turns):
    draw = random.Random(5)

    def row(at):
        some = lambda x: None if draw.random() < 0.002 else x
        k = draw.choice([0, 0, 0, 1, 1, 2, 3, at + 10])
        return (at, k, some(draw.randint(-3, 9)), draw.randint(0, 9), some(draw.choice([0.1, 1e16, -1e16, 3.7])), draw.randint(-99, 99), f"b{at}", some(draw.randint(0, 10**6)), draw.randint(-(10**6), 0),
                draw.choice([None, None, f"h{at}"]), draw.choice([None, f"f{at}"]), f"w{at}", f"x{at}", f"p{at}", f"o{at}")

    rows = [row(at) for at in range(2000)]
    db.attach("src", made(spark, tmp_path, rows, "at INT, k INT, n INT, total BIGINT, d DOUBLE, m INT, best STRING, ts INT, low INT, held STRING, firm STRING, was STRING, now STRING, parity STRING, other STRING"))
    db.sql("CREATE TABLE t (k INT PRIMARY KEY, n INT, total BIGINT, d DOUBLE, m DECIMAL(12,2), best VARCHAR(9), ts INT, low INT, held VARCHAR(9), firm VARCHAR(9), was VARCHAR(9), now VARCHAR(9), parity VARCHAR(20), other VARCHAR(9))")
    start = [(0, 5, 7, 0.3, 1, "start", 3, 4, None, "a", "b", "c", "d", "e"), (-1, 5, 7, 0.3, 1, "start", 3, 4, None, "a", "b", "c", "d", "e")]
    db.sql("INSERT INTO t VALUES " + ", ".join(f"({', '.join('NULL' if v is None else repr(v) for v in r)})" for r in start))
    want = {r[0]: dict(zip(COLUMNS, r, strict=True)) for r in start}
    for r in rows:
        new = dict(zip(COLUMNS, r[1:], strict=True))
        want[new["k"]] = after(want[new["k"]], new) if new["k"] in want else new
    if in_turns:
        monkeypatch.setattr(folding.Step, "levels", lambda self: None)
        monkeypatch.setattr(changes, "FOLD", 30_000)
    seen = passes(monkeypatch)
    assert db.sql(f"INSERT INTO t SELECT {', '.join(COLUMNS)} FROM src ORDER BY at ON DUPLICATE KEY UPDATE {UPDATE}").affected == 2000
    assert seen == ["folded"] if not in_turns else seen[0] == "turns" and seen.count("folded") > 3
    assert sorted(tuple(r) for r in db.sql("SELECT * FROM t").collect()) == sorted(tuple(r.values()) for r in want.values())


def test_a_hot_key_takes_one_pass(db, spark, tmp_path, monkeypatch):
    spark.range(0, 30_000, 1, 3).selectExpr("id AS at", "CAST(id % 2 AS INT) AS k").write.parquet(path := f"{tmp_path}/hot")
    db.attach("src", path)
    db.sql("CREATE TABLE t (k INT PRIMARY KEY, n BIGINT, at BIGINT)")
    seen = passes(monkeypatch)
    assert db.sql("INSERT INTO t SELECT k, 1, at FROM src ORDER BY at ON DUPLICATE KEY UPDATE n = n + 1, at = VALUES(at)").affected == 30_000
    assert len(seen) == 1
    assert sorted(tuple(r) for r in db.sql("SELECT * FROM t").collect()) == [(0, 15_000, 29_998), (1, 15_000, 29_999)]


def test_other_assignments_go_on_in_few_turns(db, spark, tmp_path, monkeypatch):
    spark.range(0, 30_000, 1, 3).selectExpr("id AS at", "CAST(id % 2 AS INT) AS k", "CAST(id % 7 AS INT) AS n").write.parquet(path := f"{tmp_path}/hot")
    db.attach("src", path)
    db.sql("CREATE TABLE t (k INT PRIMARY KEY, n INT, note VARCHAR(200))")
    seen = passes(monkeypatch)
    assert db.sql("INSERT INTO t SELECT k, n, REPEAT('x', 100) FROM src ORDER BY at ON DUPLICATE KEY UPDATE n = (n * 3 + VALUES(n)) % 1009").affected == 30_000
    assert seen == ["turns", "folded"]
    want = {}
    for at in range(30_000):
        want[at % 2] = (want[at % 2] * 3 + at % 7) % 1009 if at % 2 in want else at % 7
    assert sorted(tuple(r) for r in db.sql("SELECT k, n FROM t").collect()) == sorted(want.items())


def test_a_step_that_overflows_fails(db):
    db.sql("CREATE TABLE t (k INT PRIMARY KEY, n INT, b BIGINT)")
    with pytest.raises(Exception, match="OVERFLOW"):
        db.sql("INSERT INTO t VALUES (1, 2000000000, 0), (1, 2000000000, 0), (1, -2000000000, 0) ON DUPLICATE KEY UPDATE n = n + VALUES(n)")
    with pytest.raises(Exception, match="OVERFLOW"):
        db.sql("INSERT INTO t VALUES (1, 0, 9000000000000000000), (1, 0, 9000000000000000000), (1, 0, -9000000000000000000) ON DUPLICATE KEY UPDATE b = b + VALUES(b)")
    db.sql("INSERT INTO t VALUES (1, 0, 9000000000000000000), (1, 0, NULL), (1, 0, 9000000000000000000), (1, 0, 9000000000000000000) ON DUPLICATE KEY UPDATE b = b + VALUES(b)")
    assert [tuple(r) for r in db.sql("SELECT * FROM t").collect()] == [(1, 0, None)]


def test_no_rows(db):
    db.script("CREATE TABLE t (k INT PRIMARY KEY, n INT); INSERT INTO t VALUES (1, 2)")
    for assignment in ("n = n + VALUES(n)", "n = n * VALUES(n)"):
        assert db.sql(f"INSERT INTO t SELECT k, n FROM t WHERE k > 5 ON DUPLICATE KEY UPDATE {assignment}").affected == 0
    assert [tuple(r) for r in db.sql("SELECT * FROM t").collect()] == [(1, 2)]


def test_shapes(db):
    db.sql("CREATE TABLE t (k INT PRIMARY KEY, n INT, x VARCHAR(9))")
    known = {
        "n + 1": ("sum", "(1)"), "VALUES(n) * 2 + n": ("sum", "(`_new`.`n` * 2)"), "n - (VALUES(n) - 1)": ("minus", "(`_new`.`n` - 1)"), "VALUES(n)": ("last", "`_new`.`n`"),
        "GREATEST(n, VALUES(n) + 1)": ("greatest", "(`_new`.`n` + 1)"), "LEAST(VALUES(n), n)": ("least", "(`_new`.`n`)"), "COALESCE(VALUES(n), n)": ("set", "(`_new`.`n`)"),
        "IF(VALUES(x) = '`_old`.`n`', 7, n)": ("set", "(7)"), "CASE WHEN VALUES(n) > 1 THEN n ELSE 8 END": ("keep", "(8)"),
    }
    for text, what in known.items():
        step = db.step(db.table((None, "t")), [((None, "n"), text), ((None, "x"), "IF(n > 3, 'a', 'b')")])
        found = folding.shape(step.parse, "n", step.assigned["n"])
        assert (found.kind, found.value) == what
    for text in ("n * 2", "1 - n", "n + n", "n + VALUES(n) + 1", "IF(n > 1, VALUES(n), n)", "GREATEST(n, VALUES(n), 3)", "COALESCE(n, VALUES(n))", "-n"):
        step = db.step(db.table((None, "t")), [((None, "n"), text)])
        assert step.levels() is None
