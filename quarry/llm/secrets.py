"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Base kinds, leftmost and non-overlapping for each kind: ``assign`` (a name such as password or api_key, then a value of
8 or more characters), ``access`` (AKIA and more capitals and digits, 16 or more), ``hex`` (32 or more digits 0-9a-f).

The battery adds kind ``random``. Candidates come from runs of ``[A-Za-z0-9+/_=-]``: their parts between ``=`` (which
counts as padding at the end of a run), of ``SHORTEST`` or more characters. For each the encoding is inferred, the
smallest of the known alphabets that has all its characters; where none has, the pieces between ``+`` and ``/`` and those
between ``-`` and ``_`` are candidates. Words of one case joined by ``_`` before a ``=`` are names and no candidates.
Decimal digits alone are none either: a long number (an identifier, a time, a measurement) is as even as a drawn key,
and no text either, so both tests would call every such number a secret. Two things are asked:

* Does it look drawn at random from that alphabet? Chi-squared of the alphabet's uniformity (symbols in as many bins as
  the length can bear), the runs above and below the alphabet's middle, and the serial correlation of neighbours. The
  smallest of the three p-values, times three, is the battery's. Benjamini and Hochberg's rule over those of the
  document's candidates that pass the other test tells which are *not* random, with a share of ``REJECT`` wrongly so.
* Could it be text? The likelihood under a model of text characters, over that under the uniform alphabet, bounds the
  p-value of "this is text" (Markov's inequality for likelihood ratios), and falls with each further character: short
  runs can't reach what long ones do. Benjamini and Hochberg's rule over the document's candidates holds the expected
  share of false discoveries under ``FALSE_SHARE``.

A random span inside a base span adds nothing and is left out. Offsets are code points, ends exclusive.

Defined results: null text is empty; nothing found gives the digest of the empty string and empty spans. Whole texts
are scanned, one at a time.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tidy, trim

KINDS = ("assign", "access", "hex", "random")
SHORTEST, REJECT, FALSE_SHARE = 20, 0.001, 0.01

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are whole: a match starts where the run does
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_NAME = re.compile(r"[A-Z]+(_+[A-Z]+)+|[a-z]+(_+[a-z]+)+")
_PART, _PIECES = re.compile(r"[^=]+"), (re.compile(r"[^+/]+"), re.compile(r"[^_-]+"))
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings by size of their alphabet.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_SETS = [(name, frozenset(a), {c: k for k, c in enumerate(a)}) for name, a in ALPHABETS.items()]
#: Natural logarithms of the characters' shares in text: lower-case letters by rough rank of use, the rest seldom.
_TEXT = {c: math.log(0.94 * w / 100) for c, w in zip("etaoinshrdlcumwfgypbvkjxqz", (12.5, 9, 8, 7.5, 7, 7, 6.3, 6, 6, 4.2, 4, 2.8, 2.8, 2.4, 2.4, 2.2, 2, 2, 1.9, 1.5, 1, 0.8, 0.2, 0.2, 0.15, 0.15), strict=True)}
_TEXT |= {c: math.log(0.03 / 26) for c in _UPPER} | {c: math.log(0.02 / 10) for c in _DIGITS} | {c: math.log(0.01 / 5) for c in "+/_=-"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


def infer(run: str) -> tuple[str, dict[str, int]] | None:
    there = set(run)
    return next(((name, place) for name, letters, place in _SETS if there <= letters), None)


def chi2_p(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by Wilson and Hilferty's normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(places: list[int], k: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation of symbols below k."""
    n = len(places)
    bins = max(2, min(k, n // 5))
    size = [len(range(-(-b * k // bins), -(-(b + 1) * k // bins))) / k * n for b in range(bins)]
    seen = [0] * bins
    for p in places:
        seen[p * bins // k] += 1
    uniform = chi2_p(sum((o - e) ** 2 / e for o, e in zip(seen, size, strict=True)), bins - 1)
    high = [p >= k / 2 for p in places]
    up = sum(high)
    down = n - up
    if up and down and n > 2:
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        count = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        runs = two_sided((count - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    middle = sum(places) / n
    spread = sum((p - middle) ** 2 for p in places)
    serial = two_sided(sum((a - middle) * (b - middle) for a, b in zip(places, places[1:], strict=False)) / spread * math.sqrt(n)) if spread else 0.0
    return uniform, runs, serial


def candidates(text: str) -> Iterator[tuple[int, int, int, dict[str, int] | None]]:
    """(start, end, end with padding, alphabet or None) of what the battery is to test; pieces may overlap."""
    for m in _RUN.finditer(text):
        last = m.start() + len(m[0].rstrip("="))
        for part in _PART.finditer(text, m.start(), last):
            s, e = part.span()
            if e - s < SHORTEST or (e < last and _NAME.fullmatch(part[0])):
                continue
            found = [(s, e)] if infer(part[0]) else [p.span() for pieces in _PIECES for p in pieces.finditer(text, s, e) if len(p[0]) >= SHORTEST]
            for x, y in found:
                known = infer(text[x:y])
                yield x, y, m.end() if y == last else y, known[1] if known and known[0] != "decimal" else None


def discoveries(p: list[float], share: float) -> int:
    """How many of the smallest p-values Benjamini and Hochberg's rule takes, for this share of false ones."""
    return max((k for k, x in enumerate(sorted(p), 1) if x <= share * k / len(p)), default=0)


def random_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates that are random rather than text; those that overlap are one."""
    if max(map(len, text.split()), default=0) < SHORTEST:
        return []
    tried = []
    for s, e, padded, place in candidates(text):
        run = text[s:e]
        ratio = -len(run) * math.log(len(place)) - sum(map(_TEXT.__getitem__, run)) if place else 0.0
        tried.append((math.exp(-ratio) if ratio > 0 else 1.0, s, e, padded, place))
    tried.sort(key=lambda x: x[0])
    found = discoveries([p for p, *_ in tried], FALSE_SHARE)
    out: list[tuple[int, int, str]] = []
    tested = [(min(1.0, 3 * min(battery([place[c] for c in text[s:e]], len(place)))), s, padded) for _, s, e, padded, place in tried[:found] if place]
    taken = [(s, padded) for _, s, padded in sorted(tested)[discoveries([p for p, *_ in tested], REJECT) :]]
    for s, e in sorted(taken):
        if out and s < out[-1][1]:
            s, e = out[-1][0], max(e, out.pop()[1])
        out.append((s, e, "random"))
    return out


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans; each by start, then kind as in KINDS."""
    text = text or ""
    by = lambda x: (x[0], KINDS.index(x[2]))
    base = sorted(base_spans(text), key=by)
    more = [r for r in random_spans(text) if not any(s <= r[0] and r[1] <= e for s, e, _ in base)]
    return base, sorted(base + more, key=by)


def shown(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in found)


def scan(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans for docs (columns doc_id and text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, told = [[], [], []], [], []
            for t in b.column(1):
                base, whole = spans(t.as_py())
                for c, kind in zip(counts, KINDS, strict=False):
                    c.append(sum(x[2] == kind for x in base))
                digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                told.append(shown(whole))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(told, pa.string())], schema=schema)

    return docs.mapInArrow(tidy(work), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redacted(text: str, found: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each span, or overlapping spans together, replaced by the mark."""
    out, at = [], 0
    for s, e, _ in sorted(found):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the secrets in the text column replaced; null texts stay null, all rows and other columns stay."""
    scanned = F.pandas_udf(_redact, "string")
    return docs.withColumn(text, scanned(F.col(f"`{text}`")))


def _redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from (b.map(lambda t: redacted(t, spans(t)[1]) if t else t) for b in batches)
    trim()
