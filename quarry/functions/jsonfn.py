"""JSON functions over text documents: object keys in order, 64-bit integers exact, JSON null other than SQL NULL.

Spark's own JSON functions unquote strings, keep argument order and can't edit, so these are Arrow-batched Python UDFs.
Documents and scalars are told apart by the front end: arguments that are not documents come as JSON text already.

Reading a column at a literal path of member names, the common case, stays in the JVM (``Held``): documents that Spark's
variants hold exactly as these functions do are read as variants, and Python sees nulls in their place; only the others,
with fractions, escapes and the like, or no JSON at all, are left to the UDFs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalar import literal

MOST_LEGS, MOST_PATH, MOST_DEPTH = 100, 4096, 100
MISSING = object()
_HALF = re.compile("[\ud800-\udfff]")
_LEG = re.compile(r"""\s*(?:\.\s*(?:(\*)|"((?:[^"\\]|\\.)*)"|([^\W\d][\w$]*))|\[\s*(?:(\*)|(\d+))\s*\])""")


class JsonError(ValueError):
    """With MySQL's error number."""

    def __init__(self, code: int, text: str):
        super().__init__(f"({code}) {text}")
        self.code = code


def dump(value: object) -> str:
    """Halves of surrogate pairs stay escaped: they are no text."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def depth(value: object) -> int:
    if isinstance(value, dict):
        return 1 + max(map(depth, value.values()), default=0)
    if isinstance(value, list):
        return 1 + max(map(depth, value), default=0)
    return 1


def no_constant(text: str) -> object:
    raise ValueError(text)


def load(text: str) -> object:
    try:
        value = json.loads(text, parse_constant=no_constant)
    except (ValueError, RecursionError):
        raise JsonError(3141, "invalid JSON text") from None
    if depth(value) > MOST_DEPTH:
        raise JsonError(3157, "the JSON document is too deep")
    return value


def parse_path(path: str) -> list[tuple[str, object]]:
    if len(path.encode()) > MOST_PATH or not path.lstrip().startswith("$"):
        raise JsonError(3143, "invalid JSON path expression")
    at, legs = path.index("$") + 1, []
    while path[at:].strip():
        m = _LEG.match(path, at)
        if not m:
            raise JsonError(3143, "invalid JSON path expression")
        if m[1] or m[4]:
            legs.append(("members" if m[1] else "cells", None))
        elif m[5]:
            legs.append(("cell", int(m[5])))
        else:
            legs.append(("member", json.loads(f'"{m[2]}"') if m[2] is not None else m[3]))
        at = m.end()
    if len(legs) > MOST_LEGS:
        raise JsonError(3143, "the JSON path has too many legs")
    return legs


def wild(legs: list[tuple[str, object]]) -> bool:
    return any(kind in ("members", "cells") for kind, _ in legs)


def found(value: object, legs: list[tuple[str, object]]) -> list[object]:
    now = [value]
    for kind, what in legs:
        step: list[object] = []
        for v in now:
            if kind == "member" and isinstance(v, dict) and what in v:
                step.append(v[what])
            elif kind == "members" and isinstance(v, dict):
                step += [v[k] for k in sorted(v)]
            elif kind == "cell" and (isinstance(v, list) or what == 0):
                whole = v if isinstance(v, list) else [v]
                step += whole[what : what + 1]
            elif kind == "cells" and isinstance(v, list):
                step += v
        now = step
    return now


def edited(value: object, legs: list[tuple[str, object]], new: object, there: bool, absent: bool) -> object:
    """With new at the path, where something is there (if ``there``) or its parent is (if ``absent``). MISSING removes."""
    if not legs:
        return new if there and new is not MISSING else value
    (kind, what), rest = legs[0], legs[1:]
    if kind == "member" and isinstance(value, dict):
        if what in value:
            if not rest and new is MISSING:
                return {k: v for k, v in value.items() if k != what}
            return {**value, what: edited(value[what], rest, new, there, absent)}
        return {**value, what: new} if absent and not rest else value
    if kind == "cell":
        whole = value if isinstance(value, list) else [value]
        if what < len(whole):
            if not rest and new is MISSING:
                return whole[:what] + whole[what + 1 :] if isinstance(value, list) else value
            made = edited(whole[what], rest, new, there, absent)
            return [*whole[:what], made, *whole[what + 1 :]] if isinstance(value, list) else made
        if absent and not rest:
            return [*whole, new]
    return value


def fixed_path(path: str) -> list[tuple[str, object]]:
    legs = parse_path(path)
    if wild(legs):
        raise JsonError(3149, "wildcards are not allowed in this path")
    return legs


def json_object(*parts: str | None) -> str:
    out = {}
    for k, v in zip(parts[::2], parts[1::2], strict=True):
        if k is None:
            raise JsonError(3158, "JSON documents may not contain NULL member names")
        key = load(k)
        out[key if isinstance(key, str) else dump(key)] = None if v is None else load(v)
    return dump(out)


def json_array(*parts: str | None) -> str:
    return dump([None if v is None else load(v) for v in parts])


def json_extract(doc: str, *paths: str) -> str | None:
    value, legs = load(doc), [parse_path(p) for p in paths]
    out = [v for x in legs for v in found(value, x)]
    if not out:
        return None
    return dump(out if len(legs) > 1 or wild(legs[0]) else out[0])


def json_unquote(text: str) -> str:
    if len(text) > 1 and text[0] == text[-1] == '"':
        value = load(text)
        return _HALF.sub("\ufffd", value) if isinstance(value, str) else text
    return text


def json_quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def json_valid(text: str) -> int:
    try:
        load(text)
    except JsonError:
        return 0
    return 1


def json_type(doc: str) -> str:
    value = load(doc)
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "BOOLEAN"
    if isinstance(value, int):
        return "INTEGER" if value < 2**63 else "UNSIGNED INTEGER" if value < 2**64 else "DOUBLE"
    return {float: "DOUBLE", str: "STRING", list: "ARRAY", dict: "OBJECT"}[type(value)]


def one(doc: str, path: str | None) -> object:
    out = found(load(doc), fixed_path(path)) if path is not None else [load(doc)]
    return out[0] if out else MISSING


def json_depth(doc: str) -> int:
    return depth(load(doc))


def json_length(doc: str, path: str | None = None) -> int | None:
    value = one(doc, path)
    return None if value is MISSING else len(value) if isinstance(value, (list, dict)) else 1


def json_keys(doc: str, path: str | None = None) -> str | None:
    value = one(doc, path)
    return dump(sorted(value)) if isinstance(value, dict) else None


def json_contains_path(doc: str, how: str, *paths: str) -> int:
    if how.lower() not in ("one", "all"):
        raise JsonError(3154, "the second argument must be 'one' or 'all'")
    value = load(doc)
    return int((any if how.lower() == "one" else all)(bool(found(value, parse_path(p))) for p in paths))


def _edit(there: bool, absent: bool) -> Callable[..., str]:
    def run(doc: str, *parts: str | None) -> str:
        value = load(doc)
        for path, new in zip(parts[::2], parts[1::2], strict=True):
            value = edited(value, fixed_path(path), None if new is None else load(new), there, absent)
        return dump(value)

    return run


def json_remove(doc: str, *paths: str) -> str:
    value = load(doc)
    for path in paths:
        legs = fixed_path(path)
        if not legs:
            raise JsonError(3153, "the path $ can't be removed")
        value = edited(value, legs, MISSING, True, False)
    return dump(value)


#: Name: (function, fewest and most arguments, result type, which arguments may be null, which are values and not text).
#: Values come as JSON text: odd ones, even ones from the second, all.
FUNCTIONS: dict[str, tuple[Callable[..., object], int, int, str, bool, str]] = {
    "JSON_OBJECT": (json_object, 0, 999, "string", True, "all"),
    "JSON_ARRAY": (json_array, 0, 999, "string", True, "all"),
    "JSON_EXTRACT": (json_extract, 2, 999, "string", False, ""),
    "JSON_UNQUOTE": (json_unquote, 1, 1, "string", False, ""),
    "JSON_QUOTE": (json_quote, 1, 1, "string", False, ""),
    "JSON_VALID": (json_valid, 1, 1, "bigint", False, ""),
    "JSON_TYPE": (json_type, 1, 1, "string", False, ""),
    "JSON_DEPTH": (json_depth, 1, 1, "bigint", False, ""),
    "JSON_LENGTH": (json_length, 1, 2, "bigint", False, ""),
    "JSON_KEYS": (json_keys, 1, 2, "string", False, ""),
    "JSON_CONTAINS_PATH": (json_contains_path, 3, 999, "bigint", False, ""),
    "JSON_SET": (_edit(True, True), 3, 999, "string", True, "edits"),
    "JSON_INSERT": (_edit(False, True), 3, 999, "string", True, "edits"),
    "JSON_REPLACE": (_edit(True, False), 3, 999, "string", True, "edits"),
    "JSON_REMOVE": (json_remove, 2, 999, "string", False, ""),
}


def by_row(name: str, rows: Iterable[tuple]) -> list[object]:
    made, _, _, _, nulls, kind = FUNCTIONS[name]
    out = []
    for r in rows:
        needed = r if not nulls else (r[0], *r[1::2]) if kind == "edits" else ()
        out.append(None if any(x is None for x in needed) else made(*r))
    return out


def _bound(name: str) -> Callable[[pa.Array], pa.Array]:
    _, least, _, kind, _, values = FUNCTIONS[name]
    made = pa.string() if kind == "string" else pa.int64()

    def run(args: pa.Array) -> pa.Array:
        if least and values != "all" and pc.list_element(args, 0).null_count == len(args):
            return pa.nulls(len(args), made)
        return pa.array(by_row(name, args.to_pylist()), made)

    run.__annotations__ = {"args": pa.Array, "return": pa.Array}
    return run


def register(spark: SparkSession) -> None:
    """All of them as SQL functions: quarry_json_...(array of texts)."""
    for name, (_, _, _, kind, _, _) in FUNCTIONS.items():
        spark.udf.register(f"quarry_{name.lower()}", F.arrow_udf(_bound(name), kind))


#: What keeps a text out of variants: exponents, fractions that a double would show otherwise (long, small, ending in 0), numbers
#: beyond 64 bits, escapes, characters beyond 16 bits.
_ODD = literal(r"[0-9][eE]|\.[0-9]*0(?![0-9])|0\.000|[0-9]{19}|(?=[0-9]*\.)[0-9.]{17}|\\|[^\x{0}-\x{FFFF}]")
#: An element after the document, which no text without escapes can hold, shows that all of the text was one document.
_AFTER = literal(',"\\u0001"]')


@dataclass(frozen=True)
class Held:
    """The value at a path of member names in a column of documents. slow: the same by the UDFs, null where variants serve."""

    column: str
    path: str = ""
    slow: str = ""

    @property
    def whole(self) -> str:
        return f"try_parse_json(concat('[', {self.column}, {_AFTER}))"

    @property
    def plain(self) -> str:
        """Whether the document can be read as a variant."""
        brackets = f"char_length({self.column}) - char_length(translate({self.column}, '[{{', ''))"
        return f"coalesce(try_variant_get({self.whole}, '$[1]', 'string') = '\\u0001' AND NOT ({self.column} RLIKE {_ODD}) AND {brackets} < {MOST_DEPTH}, FALSE)"

    @property
    def rest(self) -> str:
        return self.slow or f"(CASE WHEN {self.plain} THEN NULL ELSE {self.column} END)"

    @property
    def text(self) -> str:
        return f"to_json(try_variant_get({self.whole}, '$[0]{self.path}', 'variant'))"

    def at(self, path: str) -> Held | None:
        """path: a literal's text in Spark SQL; None unless it is made of plain names."""
        m = re.fullmatch(r"'\$((?:\.[A-Za-z_][A-Za-z0-9_]*)*)'", path)
        return m and Held(self.column, self.path + m[1], f"quarry_json_extract(array({self.rest}, {path}))")

    def call(self, name: str) -> str | None:
        """A function of the value, None if there is no other way than the UDF."""
        x = self.text
        if name == "JSON_VALID" and self.path:
            return None
        made = {
            "JSON_EXTRACT": x,
            "JSON_VALID": "1L",
            "JSON_TYPE": f"(CASE left({x}, 1) WHEN '{{' THEN 'OBJECT' WHEN '[' THEN 'ARRAY' WHEN '\"' THEN 'STRING' WHEN 'n' THEN 'NULL' WHEN 't' THEN 'BOOLEAN' WHEN 'f' THEN 'BOOLEAN' ELSE if({x} IS NULL, NULL, if(contains({x}, '.'), 'DOUBLE', 'INTEGER')) END)",
            "JSON_LENGTH": f"CAST(CASE left({x}, 1) WHEN '{{' THEN array_size(json_object_keys({x})) WHEN '[' THEN json_array_length({x}) ELSE if({x} IS NULL, NULL, 1) END AS BIGINT)",
            "JSON_KEYS": f"(CASE WHEN left({x}, 1) = '{{' THEN to_json(array_sort(json_object_keys({x}))) END)",
            "JSON_UNQUOTE": f"(CASE WHEN left({x}, 1) = '\"' THEN try_variant_get({self.whole}, '$[0]{self.path}', 'string') ELSE {x} END)",
        }.get(name)
        if made is None:
            return None
        slow = self.rest if name == "JSON_EXTRACT" else f"quarry_{name.lower()}(array({self.rest}))"
        return f"(CASE WHEN {self.plain} THEN {made} ELSE {slow} END)"
