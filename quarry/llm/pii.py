"""Personal data: keyed surrogates of the same type, gender, script and format.

Found are e-mail, IPv4 and IPv6 addresses, account numbers (IBAN, by their check digits), card numbers (13 to 19 digits),
social security numbers, telephone numbers, and names after a title. Each value's surrogate depends on the key and the value alone, so a value has the same surrogate
wherever it stands, in any document and on any executor (coreference), without a table of values.

* Digits, letters and octets go through a keyed permutation of all values of their format (a Feistel network with cycle
  walking, shifted so that no value stays itself): two values of one format never share a surrogate, which no check
  afterwards has to find. Letters of any script become others of the same case and block. Case, punctuation,
  spacing, the top-level domain, a leading country code, a card's first digit and whether check digits are right are kept.
* Latin, Cyrillic and Greek names are made of syllables of the script, given names with an ending for the title's gender;
  names in other scripts go through the permutation of their letters. Given names and
  surnames have surrogates of their own, so "Mr John Smith" and "Mr Smith" still name one person. Two names could get
  one surrogate by chance: ``clashes`` counts the names of the whole table, takes so many syllables that about one clash
  is to be expected whatever their number (so its result is small, and every executor can have it), and keys all but the
  first of a clash anew, again and again until each name has a surrogate of its own that isn't a name itself.

Names are told by title, and gender by title, so only values with a clear type are replaced.

Defined results: null text stays null and has no entities; texts without entities stay as they are. Repeated rows get
equal results. Whole texts are read, one at a time.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Tables, tidy

KEY = b"quarry surrogates"
ROUNDS = 8
#: Syllables of given names and surnames at least; a key of ``again`` that holds how many more there are.
GIVEN, FAMILY = 5, 6
MORE = ("", "", True)

_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_IP = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\w.]*\d)", re.A)
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", re.A)
_IBAN = re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A)
_CARD = re.compile(r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])", re.A)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
_PHONE = re.compile(r"(?<![\w+.])(?!\d{4}-\d\d-\d\d(?!\d))(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w.-]*\d)", re.A)
#: Titles and their gender.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f", "Dr": "n", "Prof": "n"}
_NAME = re.compile(r"\b(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")(\.?[  ])([^\W\d_a-zа-яα-ω][^\W\d_]+(?:[  -][^\W\d_a-zа-яα-ω][^\W\d_]+){0,2})")
#: Consonants, vowels and endings for men's, women's and other given names, by script.
SCRIPTS = {
    "latin": ("bcdfghjklmnprstvz", "aeiou", {"m": "o", "f": "a", "n": "e"}),
    "cyrillic": ("бвгдзклмнпрстфх", "аеиоу", {"m": "й", "f": "я", "n": "е"}),
    "greek": ("βγδζθκλμνπρστφχ", "αεηιο", {"m": "ς", "f": "α", "n": "ε"}),
}


def number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest())


def network(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The place of value in a keyed permutation of the numbers below size, or back from there."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    low = (1 << half) - 1
    while True:
        left, right = value >> half, value & low
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ number(key, tweak, size, r, left) & low, left
            else:
                left, right = right, left ^ number(key, tweak, size, r, right) & low
        value = left << half | right
        if value < size:
            return value


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """Another number below size, by a keyed permutation that leaves none where it is: a shift between network and back."""
    if size < 2:
        return value
    shift = 1 + number(key, tweak, size, "shift") % (size - 1)
    return network((network(value, size, key, tweak) + shift) % size, size, key, tweak, True)


def _radix(c: str) -> tuple[int, int]:
    if "0" <= c <= "9":
        return 10, ord(c) - 48
    if "a" <= c <= "z":
        return 26, ord(c) - 97
    if "A" <= c <= "Z":
        return 26, ord(c) - 65
    return 1, 0


@lru_cache(4096)
def alphabet(c: str) -> str:
    """The characters that may stand for one: letters or digits of its block and kind; itself alone for others."""
    kind = unicodedata.category(c)
    if kind[0] not in "LN" or c.isascii() and not c.isalnum():
        return c
    first = ord(c) & ~0x7F
    return "".join(x for x in map(chr, range(first, first + 0x80)) if unicodedata.category(x) == kind and (c.isascii() or len(x.casefold()) == 1))


def like_any(text: str, key: bytes, tweak: str) -> str:
    """Another text with characters of the same blocks and kinds."""
    value, size = 0, 1
    sets = [alphabet(c) for c in text]
    for c, letters in zip(text, sets, strict=True):
        value, size = value * len(letters) + letters.find(c) % len(letters), size * len(letters)
    pattern = "".join(letters[0] for letters in sets)
    value = permuted(value, size, key, f"{tweak}\x1f{pattern}")
    out = []
    for letters in reversed(sets):
        value, place = divmod(value, len(letters))
        out.append(letters[place])
    return "".join(reversed(out))


def like(text: str, key: bytes, tweak: str) -> str:
    """Another text with digits for digits, and plain Latin letters of the same case for such letters."""
    value, size = 0, 1
    for c in text:
        radix, place = _radix(c)
        value, size = value * radix + place, size * radix
    pattern = "".join("0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in text)
    value = permuted(value, size, key, f"{tweak}\x1f{pattern}")
    out = []
    for c in reversed(pattern):
        radix, _ = _radix(c)
        value, place = divmod(value, radix)
        out.append(chr(ord(c) + place) if radix > 1 else c)
    return "".join(reversed(out))


def check_digit(digits: str) -> int:
    """Luhn's, for the digits before it."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (k % 2 == 0))
        total += d - 9 * (d > 9)
    return -total % 10


def refill(pattern: str, digits: str) -> str:
    """The pattern with its digits replaced, one after another."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in pattern)


def email(value: str, key: bytes) -> str:
    local, _, domain = value.rpartition("@")
    name, _, top = domain.rpartition(".")
    return f"{like_any(local, key, f'local:{domain.lower()}')}@{like_any(name.lower(), key, f'domain:{top}')}.{top}"


def ip(value: str, key: bytes) -> str:
    whole = 0
    for part in value.split("."):
        whole = whole << 8 | int(part)
    whole = permuted(whole, 1 << 32, key, "ip")
    return ".".join(str(whole >> s & 255) for s in (24, 16, 8, 0))


def ip6(value: str, key: bytes) -> str:
    """Groups of the same length; the zeros of '::' stay."""
    return like_hex(value, key)


def like_hex(value: str, key: bytes) -> str:
    digits = [c for c in value if c != ":"]
    if not digits:
        return value
    made = permuted(int("".join(digits), 16), 16 ** len(digits), key, f"ip6:{re.sub('[0-9A-Fa-f]', 'x', value)}")
    left = iter(f"{made:0{len(digits)}x}")
    return "".join(c if c == ":" else next(left).upper() if value.upper() == value else next(left) for c in value)


def iban_rest(text: str) -> int:
    """What the check asks of an account number, its first four characters last: 1 if it is right."""
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(value: str, key: bytes) -> str:
    plain = value.replace(" ", "")
    body = like(plain[4:], key, f"iban:{plain[:2]}")
    left = iter(f"{plain[:2]}{98 - iban_rest(body + plain[:2] + '00'):02d}{body}")
    return "".join(c if c == " " else next(left) for c in value)


def card(value: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", value)
    off = (int(digits[-1]) - check_digit(digits[:-1])) % 10
    body = digits[0] + like(digits[1:-1], key, f"card:{digits[0]}")
    return refill(value, body + str((check_digit(body) + off) % 10))


def phone(value: str, key: bytes) -> str:
    code = re.match(r"\+\d{1,3}(?=\D)", value)
    start = code.end() if code else 0
    digits = re.sub(r"\D", "", value[start:])
    return value[:start] + refill(value[start:], like(digits, key, f"phone:{value[:start]}"))


def script_of(word: str) -> str | None:
    """latin, cyrillic or greek; None for others."""
    if all("Ѐ" <= c <= "ӿ" for c in word):
        return "cyrillic"
    if all("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in word):
        return "greek"
    return "latin" if any(c < "ɐ" or "Ḁ" <= c <= "ỿ" for c in word) else None


def name_part(word: str, gender: str, given: bool, key: bytes, attempt: int = 0, more: int = 0) -> str:
    """The surrogate of a name's word. more: syllables beyond the fewest."""
    script = script_of(word)
    if script is None:
        return like_any(word, key, f"{'given' if given else 'family'}:{gender if given else ''}:{attempt}")
    consonants, vowels, ends = SCRIPTS[script]
    told = number(key, "given" if given else "family", gender if given else "", word.casefold(), attempt)
    out = []
    for _ in range((GIVEN if given else FAMILY) + more):
        told, c = divmod(told, len(consonants))
        told, v = divmod(told, len(vowels))
        out.append(consonants[c] + vowels[v])
    made = "".join(out) + (ends[gender] if given else "")
    return made.upper() if word.isupper() else made[0].upper() + made[1:]


def name_keys(title: str, name: str) -> list[tuple[str, str, bool]]:
    """(word, gender, given) for each word of a name; the last is the surname."""
    words = re.split("[  -]", name)
    return [(w, TITLES[title], k < len(words) - 1) for k, w in enumerate(words)]


def right_iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_rest(plain[4:] + plain[:4]) == 1


def right_ip6(value: str) -> bool:
    try:
        return ipaddress.ip_address(value).version == 6 and sum(c != ":" for c in value) >= 4
    except ValueError:
        return False


def entities(text: str) -> list[tuple[int, int, str, re.Match]]:
    """(start, end, kind, match), in order, without overlaps; the kinds that say most come first."""
    tried: list[tuple[str, re.Pattern]] = []
    if "@" in text:
        tried.append(("email", _EMAIL))
    if re.search(r"\d{2}", text):
        tried += [("ip", _IP), ("iban", _IBAN), ("card", _CARD), ("ssn", _SSN), ("phone", _PHONE)]
    if "::" in text or text.count(":") > 6:
        tried.append(("ip6", _IP6))
    tried.append(("name", _NAME))
    found: list[tuple[int, int, str, re.Match]] = []
    for kind, pattern in tried:
        for m in pattern.finditer(text):
            s, e = m.span(3) if kind == "name" else m.span()
            if kind == "iban" and not right_iban(m[0]) or kind == "ip6" and not right_ip6(m[0]):
                continue
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            found.append((s, e, kind, m))
    out: list[tuple[int, int, str, re.Match]] = []
    rank = {k: n for n, (k, _) in enumerate(tried)}
    taken: list[tuple[int, int]] = []
    for x in sorted(found, key=lambda x: (rank[x[2]], x[0])):
        if len(found) == 1 or all(x[1] <= s or e <= x[0] for s, e in taken):
            taken.append(x[:2])
            out.append(x)
    return sorted(out, key=lambda x: x[:2])


def surrogate(kind: str, m: re.Match, key: bytes, again: dict[tuple[str, str, bool], int]) -> str:
    if kind == "name":
        parts = re.split("([  -])", m[3])
        for k, (word, gender, given) in enumerate(name_keys(m[1], m[3])):
            more = [again[MORE]] if again.get(MORE) else []
            parts[2 * k] = name_part(word, gender, given, key, again.get((word.casefold(), gender if given else "", given), 0), *more)
        return "".join(parts)
    made = {"email": email, "ip": ip, "ip6": ip6, "iban": iban, "card": card, "phone": phone}
    return made[kind](m[0], key) if kind in made else refill(m[0], like(re.sub(r"\D", "", m[0]), key, kind))


def replaced(text: str, key: bytes = KEY, again: dict | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities' spans in the original."""
    out, at = [], 0
    found = entities(text)
    for s, e, kind, m in found:
        out += [text[at:s], surrogate(kind, m, key, again or {})]
        at = e
    return "".join([*out, text[at:]]), [x[:3] for x in found]


def name_words(docs: DataFrame) -> DataFrame:
    """The distinct words (word, gender, given) of the names in docs; casefolded, the gender for given names only."""
    schema = pa.schema([("word", pa.string()), ("gender", pa.string()), ("given", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for t in b.column(0):
                for m in _NAME.finditer(t.as_py() or ""):
                    rows |= {(word.casefold(), gender if given else "", given) for word, gender, given in name_keys(m[1], m[3])}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sorted(rows), strict=True), schema, strict=True)], schema=schema)

    return docs.select("text").mapInArrow(tidy(work), "word string, gender string, given boolean").distinct()


def clashes(docs: DataFrame, key: bytes = KEY, more: int | None = None) -> dict[tuple[str, str, bool], int]:
    """The names keyed anew, with their attempts, and under MORE how many syllables are added. more: only for tests."""
    tables = Tables(docs.sparkSession, "names")
    words = tables.keep(name_words(docs), "words")
    if more is None:  # so many that the square of the number of names is no more than that of surrogates: some 0.5 clashes
        fewest = min(len(c) * len(v) for c, v, _ in SCRIPTS.values())
        more = max(0, math.ceil(2 * math.log(max(2, words.count()), fewest)) - GIVEN)
    again: dict[tuple[str, str, bool], int] = {MORE: more}
    fields = "word string, gender string, given boolean, surrogate string"
    schema = pa.schema([("word", pa.string()), ("gender", pa.string()), ("given", pa.bool_()), ("surrogate", pa.string())])
    while True:

        def work(batches: Iterator[pa.RecordBatch], now: dict = dict(again)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                made = [name_part(w, g, given, key, now.get((w, g, given), 0), *([more] if more else [])).casefold() for w, g, given in rows]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], schema=schema)

        told = words.mapInArrow(tidy(work), fields)
        # of those that share a surrogate the first keeps it, unless it is its own name or that of another in the table
        real = words.select("given", F.col("word").alias("surrogate")).distinct()
        taken = told.join(real, ["given", "surrogate"], "left_semi").select("word", "gender", "given")
        groups = told.groupBy("given", "surrogate").agg(F.min(F.struct("word", "gender")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        later = told.join(groups, ["given", "surrogate"]).where(F.struct("word", "gender") != F.col("first")).select("word", "gender", "given")
        found = [tuple(r) for r in taken.unionByName(later).distinct().collect()]
        if not found:
            break
        for name in found:
            again[name] = again.get(name, 0) + 1
    tables.drop("words")
    return again


def surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities and spans (kind:start:end in the original) of docs (doc_id, text)."""
    again = clashes(docs, key)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64()), ("spans", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts, spans = [], [], []
            for t in b.column(1):
                text = t.as_py()
                made, found = replaced(text, key, again) if text else (text, [])
                texts.append(made)
                counts.append(len(found))
                spans.append(",".join(f"{kind}:{s}:{e}" for s, e, kind in found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(work), "doc_id bigint, text string, n_entities bigint, spans string")
