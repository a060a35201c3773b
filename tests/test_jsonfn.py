import pytest

from quarry.functions import jsonfn as j
from quarry.session import Session


def test_paths():
    doc = '{"a": [1, {"b": "x", "c d": null}], "e": 5}'
    assert j.json_extract(doc, "$.a[1].b") == '"x"'
    assert j.json_extract(doc, '$.a[1]."c d"') == "null"
    assert j.json_extract(doc, "$.q") is None
    assert j.json_extract(doc, "$.a[*]", "$.e") == '[1,{"b":"x","c d":null},5]'
    assert j.json_extract("5", "$[0]") == "5"
    for bad in ("a", "$.", "$[x]", "$.a b"):
        with pytest.raises(j.JsonError):
            j.parse_path(bad)


def test_edits():
    assert j.FUNCTIONS["JSON_SET"][0]('{"a":1}', "$.b", "2", "$.a", '"x"') == '{"a":"x","b":2}'
    assert j.FUNCTIONS["JSON_SET"][0]("5", "$[1]", "6") == "[5,6]"
    assert j.FUNCTIONS["JSON_INSERT"][0]("[1]", "$[0]", "9", "$[7]", "8") == "[1,8]"
    assert j.FUNCTIONS["JSON_REPLACE"][0]('{"a":{"b":1}}', "$.a.b", "null", "$.c", "1") == '{"a":{"b":null}}'
    assert j.json_remove("[1,[2,3]]", "$[1][0]") == "[1,[3]]"
    with pytest.raises(j.JsonError, match="3153"):
        j.json_remove("[]", "$")
    with pytest.raises(j.JsonError, match="3149"):
        j.json_remove("[]", "$[*]")


def test_kinds():
    kinds = {"null": "NULL", "true": "BOOLEAN", "1": "INTEGER", "9223372036854775808": "UNSIGNED INTEGER", "1.5": "DOUBLE", '"s"': "STRING", "[]": "ARRAY", "{}": "OBJECT"}
    assert {k: j.json_type(k) for k in kinds} == kinds
    assert (j.json_depth("{}"), j.json_depth("[[1]]"), j.json_length("[1,2]"), j.json_length("5")) == (1, 3, 2, 1)
    assert (j.json_valid("{"), j.json_valid("NaN"), j.json_valid(" [1] ")) == (0, 0, 1)
    with pytest.raises(j.JsonError, match="3158"):
        j.json_object(None, "1")
    with pytest.raises(j.JsonError, match="3157"):
        j.load("[" * 101 + "]" * 101)


def test_in_sql(spark):
    db = Session(spark)
    db.script("CREATE TABLE t (id INT, body JSON); INSERT INTO t VALUES (1, '{\"n\": 9007199254740993, \"s\": \"é\"}'), (2, NULL)")
    assert [tuple(r) for r in db.sql("SELECT JSON_EXTRACT(body, '$.n') AS n, body->>'$.s' AS s, JSON_ARRAY(body) AS a FROM t ORDER BY id").collect()] == [("9007199254740993", "é", '[{"n":9007199254740993,"s":"é"}]'), (None, None, "[null]")]
    with pytest.raises(ValueError, match="3140"):
        db.sql("INSERT INTO t VALUES (3, '{')")


ODD = [
    None, "", " ", "{", "{}", "[]", "[1", "null", "true", " false ", "5", "-0", "01", "1.50", "1e3", "NaN", "'x'", '"x"', '"a\\nb"', '"a\tb"', '"\\ud800"', "1 2", "1,2", "1],[2",
    '{"k":1} x', '{"k":1,"k":2}', '{"k":null}', '{"k":{"z":1,"b":[2,{}],"k":"q"}}', ' {"z" : [1, 2] , "k" : "é"} ', '{"k":1.0}', '{"k":12345678901234567890}', '{"k":[1,2,3]}', '{"K":1}', '{"k":{"k":{"k":true}}}',
    '{"k":0.5}', '{"k":-12.0625}', '{"k":0.0001}', '{"k":0.00001}', '{"k":3.10}', '{"k":100.5}', '{"k":0.12345678901234567}', '{"k":123456789012345.5}', '{"k":1234567890123456789.5}', '{"k":[0.1,2,1.0]}', '{"k":1.5e3}',
    '{"\U0001f600":1,"￮":2}', '[{"k":1}]', "[" * 101 + "]" * 101, '{"k":"' + "long " * 5000 + '"}', '1,"\u0001"]', '1,"\\u0001"]', "﻿{}",
]
CALLS = {
    "JSON_EXTRACT(d, '$')": lambda d: j.json_extract(d, "$"),
    "JSON_EXTRACT(d, '$.k')": lambda d: j.json_extract(d, "$.k"),
    "JSON_EXTRACT(JSON_EXTRACT(d, '$.k'), '$.k')": lambda d: (lambda x: None if x is None else j.json_extract(x, "$.k"))(j.json_extract(d, "$.k")),
    "d->>'$.k'": lambda d: (lambda x: None if x is None else j.json_unquote(x))(j.json_extract(d, "$.k")),
    "JSON_VALID(d)": j.json_valid,
    "JSON_TYPE(d)": j.json_type,
    "JSON_TYPE(JSON_EXTRACT(d, '$.k'))": lambda d: (lambda x: None if x is None else j.json_type(x))(j.json_extract(d, "$.k")),
    "JSON_LENGTH(d)": j.json_length,
    "JSON_LENGTH(d, '$.k')": lambda d: j.json_length(d, "$.k"),
    "JSON_KEYS(d)": j.json_keys,
    "JSON_KEYS(d, '$.k')": lambda d: j.json_keys(d, "$.k"),
    "JSON_DEPTH(d)": j.json_depth,
}


@pytest.mark.parametrize("collation", ["utf8mb4_bin", "utf8mb4_general_ci"])
def test_variants_agree_with_functions(spark, tmp_path, collation):
    db = Session(spark, collation_name=collation)
    spark.createDataFrame(list(enumerate(ODD)), "n int, d string").write.parquet(f"{tmp_path}/odd")
    db.attach("odd", f"{tmp_path}/odd")
    for text, made in CALLS.items():
        checked = text == "JSON_VALID(d)"
        out = db.sql(f"SELECT n, {text} AS x FROM odd" if checked else f"SELECT n, {text} AS x FROM (SELECT n, IF(JSON_VALID(d), d, NULL) AS d FROM odd) t").collect()
        wanted = {k: None if d is None or not (checked or j.json_valid(d)) else made(d) for k, d in enumerate(ODD)}
        assert {r["n"]: r["x"] for r in out} == wanted, text


def test_variants_serve_plain_documents(spark, tmp_path):
    db = Session(spark)
    spark.createDataFrame([('{"k":"x"}',)], "d string").write.parquet(f"{tmp_path}/plain")
    db.attach("plain", f"{tmp_path}/plain")
    assert "try_variant_get" in db.translated("SELECT JSON_EXTRACT(d, '$.k') AS x FROM plain")
    with pytest.raises(Exception, match="3141"):
        spark.createDataFrame([('{"k":',)], "d string").write.mode("append").parquet(f"{tmp_path}/plain")
        db.sql("SELECT JSON_EXTRACT(d, '$.k') AS x FROM plain").collect()
