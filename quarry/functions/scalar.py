"""Scalar functions with MySQL's semantics, as Spark SQL text: one entry for each name, over the texts of the arguments."""

from __future__ import annotations

import re
from collections.abc import Callable

from quarry.plans.lexer import SqlError

#: Spark's type of a wall-clock time.
WALL = "TIMESTAMP_NTZ"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def truth(x: str) -> str:
    """What MySQL takes as true: numbers other than 0, non-empty strings. The type is known to the optimizer, so one branch is left."""
    return f"(CASE WHEN typeof({x}) = 'boolean' THEN CAST({x} AS STRING) = 'true' WHEN typeof({x}) LIKE 'string%' THEN char_length(CAST({x} AS STRING)) > 0 ELSE try_cast(CAST({x} AS STRING) AS DOUBLE) <> 0 END)"


def all_known(name: str) -> Callable[..., str]:
    """Spark skips nulls here, MySQL doesn't."""
    return lambda *a: f"(CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {name}({', '.join(a)}) END)"


def plain(name: str, kind: str = "") -> Callable[..., str]:
    return lambda *a: f"CAST({name}({', '.join(a)}) AS {kind})" if kind else f"{name}({', '.join(a)})"


def substring(s: str, pos: str, length: str | None = None) -> str:
    start = f"greatest(CAST({pos} AS INT), -char_length({s}))"
    cut = f"substring({s}, {start})" if length is None else f"substring({s}, {start}, greatest(CAST({length} AS INT), 0))"
    return f"(CASE WHEN {pos} = 0 THEN '' ELSE {cut} END)"


def padded(name: str) -> Callable[..., str]:
    return lambda s, n, p: f"(CASE WHEN {n} < 0 OR {n} > 1000000 OR ({p} = '' AND {n} > char_length({s})) THEN NULL ELSE {name}({s}, {n}, {p}) END)"


def truncate(x: str, d: str) -> str:
    """For literal places the remainder goes, which is exact for decimals."""
    if re.fullmatch(r"\d+", d):
        return f"round({x} - {x} % {f'0.{"0" * (int(d) - 1)}1BD' if int(d) else '1'}, {d})"
    return f"(sign({x}) * floor(abs({x}) * pow(10D, {d})) / pow(10D, {d}))"


def whole(sign: str) -> Callable[[str], str]:
    """CEIL and FLOOR, of the argument's type: decimals lose no digits."""
    return lambda x: f"round({x} + pmod(-({x}), 1), 0)" if sign == "+" else f"round({x} - pmod({x}, 1), 0)"


def now(places: str = "0") -> str:
    """The wall-clock time with so many digits of a second."""
    if not re.fullmatch("[0-6]", places):
        raise SqlError("(1426) a time has 0 to 6 digits of a second")
    return f"CAST(date_format(localtimestamp(), 'yyyy-MM-dd HH:mm:ss{'.' + 'S' * int(places) if int(places) else ''}') AS {WALL})"


def log(*a: str) -> str:
    if len(a) == 1:
        return f"ln({a[0]})"
    return f"(CASE WHEN {a[0]} <= 0 OR {a[0]} = 1 OR {a[1]} <= 0 THEN NULL ELSE ln({a[1]}) / ln({a[0]}) END)"


def first_byte(s: str) -> str:
    return f"CAST(coalesce(conv(nullif(substring(hex(encode({s}, 'UTF-8')), 1, 2), ''), 16, 10), if(({s}) IS NULL, NULL, '0')) AS BIGINT)"


#: MySQL's format letters, as Spark's patterns.
DATE_LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "M": "MMMM", "b": "MMM", "d": "dd", "e": "d", "j": "DDD", "H": "HH",
    "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "W": "EEEE",
    "a": "EEE", "T": "HH:mm:ss", "r": "hh:mm:ss a",
}


def date_format(d: str, fmt: str) -> str:
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", fmt, re.S)
    if not m:
        raise SqlError("DATE_FORMAT needs a literal format")
    wall = f"CAST({d} AS {WALL})"
    parts = []
    for letter, other in re.findall(r"%(.)|([^%]+|%$)", re.sub(r"\\(.)", r"\1", m[1]), re.S):
        if letter == "w":
            parts.append(f"CAST(dayofweek({wall}) - 1 AS STRING)")
        elif letter in DATE_LETTERS and letter:
            parts.append(f"date_format({wall}, '{DATE_LETTERS[letter]}')")
        else:
            parts.append(literal(letter or other))
    return f"concat({', '.join(parts)})" if parts else "''"


UNITS = {"MICROSECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR"}


def interval(amount: str, unit: str) -> str:
    unit = unit.upper().removesuffix("S") if unit.upper() not in UNITS else unit.upper()
    n = f"CAST({amount} AS INT)"
    made = {
        "MICROSECOND": f"make_dt_interval(0, 0, 0, {amount} / 1000000)",
        "SECOND": f"make_dt_interval(0, 0, 0, {amount})",
        "MINUTE": f"make_dt_interval(0, 0, {n})",
        "HOUR": f"make_dt_interval(0, {n})",
        "DAY": f"make_dt_interval({n})",
        "WEEK": f"make_dt_interval(7 * {n})",
        "MONTH": f"make_ym_interval(0, {n})",
        "QUARTER": f"make_ym_interval(0, 3 * {n})",
        "YEAR": f"make_ym_interval({n})",
    }
    if unit not in made:
        raise SqlError(f"unknown unit {unit}")
    return made[unit]


def shifted(d: str, step: str, sign: str) -> str:
    return f"(CAST({d} AS {WALL}) {sign} {step})"


def wall(name: str) -> Callable[[str], str]:
    return lambda d: f"CAST({name}(CAST({d} AS {WALL})) AS BIGINT)"


def day(d: str) -> str:
    return f"CAST({d} AS DATE)"


#: Name: (fewest arguments, most, text).
FUNCTIONS: dict[str, tuple[int, int, Callable[..., str]]] = {
    "COALESCE": (1, 99, plain("coalesce")),
    "IFNULL": (2, 2, plain("coalesce")),
    "NULLIF": (2, 2, lambda a, b: f"(CASE WHEN {a} = {b} THEN NULL ELSE {a} END)"),  # Spark's own loses sight of the collation
    "ISNULL": (1, 1, lambda x: f"(({x}) IS NULL)"),
    "GREATEST": (2, 99, all_known("greatest")),
    "LEAST": (2, 99, all_known("least")),
    "CONCAT": (1, 99, plain("concat")),
    "CONCAT_WS": (2, 99, plain("concat_ws")),
    "LOWER": (1, 1, plain("lower")),
    "LCASE": (1, 1, plain("lower")),
    "UPPER": (1, 1, plain("upper")),
    "UCASE": (1, 1, plain("upper")),
    "LENGTH": (1, 1, plain("octet_length", "BIGINT")),
    "OCTET_LENGTH": (1, 1, plain("octet_length", "BIGINT")),
    "CHAR_LENGTH": (1, 1, plain("char_length", "BIGINT")),
    "CHARACTER_LENGTH": (1, 1, plain("char_length", "BIGINT")),
    "TRIM": (1, 1, lambda s: f"regexp_replace({s}, '(?U)^\\\\s+|\\\\s+$', '')"),
    "LTRIM": (1, 1, plain("ltrim")),
    "RTRIM": (1, 1, plain("rtrim")),
    "LEFT": (2, 2, plain("left")),
    "RIGHT": (2, 2, plain("right")),
    "SUBSTRING": (2, 3, substring),
    "SUBSTR": (2, 3, substring),
    "MID": (2, 3, substring),
    "REPLACE": (3, 3, lambda s, a, b: f"replace(exact({s}), exact({a}), exact({b}))"),
    "REVERSE": (1, 1, plain("reverse")),
    "REPEAT": (2, 2, plain("repeat")),
    "SPACE": (1, 1, plain("space")),
    "LPAD": (3, 3, padded("lpad")),
    "RPAD": (3, 3, padded("rpad")),
    "LOCATE": (2, 3, lambda a, s, p="1": f"CAST(locate(exact({a}), exact({s}), {p}) AS BIGINT)"),
    "INSTR": (2, 2, lambda s, a: f"CAST(instr(exact({s}), exact({a})) AS BIGINT)"),
    "ASCII": (1, 1, first_byte),
    "ABS": (1, 1, plain("abs")),
    "CEIL": (1, 1, whole("+")),
    "CEILING": (1, 1, whole("+")),
    "FLOOR": (1, 1, whole("-")),
    "SQRT": (1, 1, lambda x: f"(CASE WHEN {x} < 0 THEN NULL ELSE sqrt({x}) END)"),
    "LN": (1, 1, plain("ln")),
    "LOG2": (1, 1, plain("log2")),
    "LOG10": (1, 1, plain("log10")),
    "LOG": (1, 2, log),
    "EXP": (1, 1, plain("exp")),
    "SIGN": (1, 1, plain("sign", "BIGINT")),
    "ROUND": (1, 2, plain("round")),
    "TRUNCATE": (2, 2, truncate),
    "MOD": (2, 2, plain("try_mod")),
    "POW": (2, 2, plain("pow")),
    "POWER": (2, 2, plain("pow")),
    "PI": (0, 0, plain("pi")),
    "NOW": (0, 1, now),
    "CURRENT_TIMESTAMP": (0, 1, now),
    "LOCALTIMESTAMP": (0, 1, now),
    "CURDATE": (0, 0, lambda: "current_date()"),
    "CURRENT_DATE": (0, 0, lambda: "current_date()"),
    "DATE": (1, 1, day),
    "YEAR": (1, 1, wall("year")),
    "MONTH": (1, 1, wall("month")),
    "DAY": (1, 1, wall("day")),
    "DAYOFMONTH": (1, 1, wall("day")),
    "QUARTER": (1, 1, wall("quarter")),
    "HOUR": (1, 1, wall("hour")),
    "MINUTE": (1, 1, wall("minute")),
    "SECOND": (1, 1, wall("second")),
    "DAYOFYEAR": (1, 1, wall("dayofyear")),
    "DAYOFWEEK": (1, 1, wall("dayofweek")),
    "WEEKDAY": (1, 1, wall("weekday")),
    "DATEDIFF": (2, 2, lambda a, b: f"CAST(datediff({day(a)}, {day(b)}) AS BIGINT)"),
    "LAST_DAY": (1, 1, lambda d: f"last_day({day(d)})"),
    "DATE_FORMAT": (2, 2, date_format),
    "MONTHNAME": (1, 1, lambda d: f"date_format(CAST({d} AS {WALL}), 'MMMM')"),
    "DAYNAME": (1, 1, lambda d: f"date_format(CAST({d} AS {WALL}), 'EEEE')"),
}
#: Functions whose result is a condition.
CONDITIONS = {"ISNULL"}


def call(name: str, args: list[str], exact: Callable[[str], str]) -> str | None:
    """Spark SQL for a call, or None if the name isn't known. exact: compares by code point whatever the session's collation."""
    found = FUNCTIONS.get(name.upper())
    if found is None:
        return None
    least, most, made = found
    if not least <= len(args) <= most:
        raise SqlError(f"wrong number of arguments for {name}")
    if name.upper() in ("REPLACE", "LOCATE", "INSTR"):
        args = [exact(a) if name.upper() != "LOCATE" or k < 2 else a for k, a in enumerate(args)]
        return re.sub(r"\bexact\(", "(", made(*args))
    return made(*args)
