"""Personal data replaced by format-preserving pseudonyms.

Values are found by pattern and validated (Luhn for cards, mod 97 for IBANs, the calendar for dates, number plans for
phones, octet ranges for addresses). Phones, social security numbers, addresses and dates are ranked in their format, and the
rank is permuted by a keyed Feistel network over exactly that many values (cycle walking); cards, IBANs and e-mail addresses are
permuted character by character, each within its class, by a Feistel network over the characters' halves. Checks are
recomputed and the format stays. So equal values get equal pseudonyms in every document, different values different
ones, and who holds the key can invert them.

Edge cases: a null text stays null with no findings; texts without findings are returned unchanged; values that fail
validation are left alone; overlapping findings resolve to the leftmost, then the earlier kind; very long texts and
values cost in proportion to their length; repeated rows each get a row; an empty table gives an empty result; extra columns
pass through, but for one with the result's name, whose place it takes.
"""

from __future__ import annotations

import calendar
import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewarden.llm.common import others as kept
from gatewarden.llm.common import table

ROUNDS = 8
#: The registered query's; operators take the key as an argument, in production from a secret store.
KEY = b"gatewarden demonstration key"
#: Longest value whose pseudonym a process remembers.
SHORT = 200
KINDS = ("email", "iban", "ssn", "card", "phone", "ip", "date")


def _root(n: int) -> int:
    """Least a with a * a >= n, 1 at least."""
    return max(1, isqrt(max(n - 1, 0)) + (n > 1))


def _mixer(key: bytes, tweak: str) -> Callable[[int, bytes, int], bytes]:
    """Keyed pseudo-random bytes of a round and what it mixes in, as many as asked for."""
    salted = hashlib.blake2b(tweak.encode(), key=key[:64], digest_size=32).digest()
    return lambda r, data, size: hashlib.shake_256(salted + bytes([r]) + data).digest(size)


def permute(x: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of range(size): an alternating Feistel network over a * b >= size values, walked until the
    value is in range again."""
    if size < 2:
        return x
    a = _root(size)
    b = -(-size // a)
    mixed, width = _mixer(key, f"{tweak}|{size}"), (size.bit_length() + 7) // 8 + 8

    def mix(r: int, v: int) -> int:
        return int.from_bytes(mixed(r, v.to_bytes(width, "big"), width), "big")

    while True:
        left, right = divmod(x, b)  # left below a, right below b
        for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if r % 2 == 0:
                left = (left + sign * mix(r, right)) % a
            else:
                right = (right + sign * mix(r, left)) % b
        x = left * b + right
        if x < size:
            return x


def permute_digits(digits: list[int], radixes: list[int], key: bytes, tweak: str, inverse: bool = False) -> list[int]:
    """A keyed permutation of digits, each of its own radix: a Feistel network over the two halves, in which every digit of
    one half is shifted by bytes that the other half gives. The work grows with the number of digits only, and all
    results are in range, so nothing is walked."""
    mixed, half = _mixer(key, f"{tweak}|{','.join(map(str, radixes))}"), len(digits) // 2
    parts, sizes = [digits[:half], digits[half:]], [radixes[:half], radixes[half:]]
    for r in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        here = r % 2
        stream = mixed(r, bytes(parts[1 - here]), 8 * len(parts[here]))
        shifts = [int.from_bytes(stream[8 * i : 8 * i + 8], "big") for i in range(len(parts[here]))]
        parts[here] = [(d - s if inverse else d + s) % n for d, s, n in zip(parts[here], shifts, sizes[here], strict=True)]
    return parts[0] + parts[1]


def _ranked(digits: list[tuple[int, int]]) -> tuple[int, int]:
    """Rank and size of (value, radix) digits."""
    x, size = 0, 1
    for v, radix in digits:
        x, size = x * radix + v, size * radix
    return x, size


def _unranked(x: int, radixes: list[int]) -> list[int]:
    out = []
    for radix in reversed(radixes):
        x, v = divmod(x, radix)
        out.append(v)
    return out[::-1]


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _by_class(text: str, key: bytes, tweak: str, inverse: bool, first: str = "") -> str:
    """ASCII letters and digits permuted together, each within its class; the rest stays. ``first``: digits that the
    first digit may be, if not all."""
    sets, free = [], []
    for i, c in enumerate(text):
        kind = next((s for s in (_LOWER, _UPPER, _DIGIT) if c in s), None)
        if kind:
            kind = first if first and not free and kind is _DIGIT else kind
            free.append(i)
            sets.append(kind)
    digits = permute_digits([s.index(text[i]) for i, s in zip(free, sets, strict=True)], [len(s) for s in sets], key, tweak, inverse)
    out = list(text)
    for i, s, v in zip(free, sets, digits, strict=True):
        out[i] = s[v]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit after ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _refilled(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in _DIGIT else c for c in value)


def _card(value: str, key: bytes, inverse: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    if luhn(digits[:-1]) != int(digits[-1]) or digits[0] == "0":
        return None
    new = _by_class(digits[:-1], key, "card", inverse, first="123456789")
    return _refilled(value, new + str(luhn(new)))


def _phone(value: str, key: bytes, inverse: bool) -> str | None:
    digits = re.sub(r"\D", "", value)
    country, own = digits[:-10], digits[-10:]
    if own[0] in "01" or own[3] in "01":
        return None
    radixes = [8, 10, 10, 8, 10, 10, 10, 10, 10, 10]
    shifts = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
    x, size = _ranked([(int(c) - s, r) for c, s, r in zip(own, shifts, radixes, strict=True)])
    new = "".join(str(v + s) for v, s in zip(_unranked(permute(x, size, key, "phone", inverse), radixes), shifts, strict=True))
    return _refilled(value, country + new)


def _ssn(value: str, key: bytes, inverse: bool) -> str | None:
    a, b, c = (int(x) for x in value.split("-"))
    areas = [x for x in range(1, 900) if x != 666]
    if a not in areas or not b or not c:
        return None
    x, size = _ranked([(areas.index(a), len(areas)), (b - 1, 99), (c - 1, 9999)])
    i, j, k = _unranked(permute(x, size, key, "ssn", inverse), [len(areas), 99, 9999])
    return f"{areas[i]:03d}-{j + 1:02d}-{k + 1:04d}"


def _ip(value: str, key: bytes, inverse: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts) or not 1 <= int(parts[0]) <= 223:
        return None
    # Each octet keeps its number of digits, so the text keeps its length.
    ranges = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts]
    ranges[0] = {1: (1, 9), 2: (10, 90), 3: (100, 124)}[len(parts[0])]
    x, size = _ranked([(int(p) - low, n) for p, (low, n) in zip(parts, ranges, strict=True)])
    widths = "".join(str(len(p)) for p in parts)
    new = _unranked(permute(x, size, key, f"ip{widths}", inverse), [n for _, n in ranges])
    return ".".join(str(v + low) for v, (low, _) in zip(new, ranges, strict=True))


_FIRST_DAY, _LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def _date(value: str, key: bytes, inverse: bool) -> str | None:
    """ISO dates and day/month/year or month/day/year; where both readings are valid, day first. Widths stay, so a
    format without leading zeros is permuted among the dates of its own widths."""
    sep = re.search(r"\D", value)[0]
    parts = value.split(sep)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
    y, m, d = (int(parts[i]) for i in order)
    if order[0] == 2 and m > 12 >= d:
        order, m, d = (2, 0, 1), d, m
    if not 1900 <= y <= 2099 or not 1 <= m <= 12 or not 1 <= d <= calendar.monthrange(y, m)[1]:
        return None
    months, days = parts[order[1]], parts[order[2]]
    x = date(y, m, d).toordinal() - _FIRST_DAY
    tweak = f"date{sep}{len(parts[0])}{len(months)}{len(days)}{order}"
    while True:
        x = permute(x, _LAST_DAY - _FIRST_DAY + 1, key, tweak, inverse)
        new = date.fromordinal(x + _FIRST_DAY)
        same_width = (len(months) == 2 or new.month < 10) and (len(days) == 2 or new.day < 10)
        # Ambiguous dates stay ambiguous or clear as they are read again, so that the reading is the same.
        reread = order != (2, 0, 1) or new.day > 12
        if same_width and reread:
            break
    out = [""] * 3
    out[order[0]] = f"{new.year:04d}"
    out[order[1]] = f"{new.month:0{len(months)}d}"
    out[order[2]] = f"{new.day:0{len(days)}d}"
    return sep.join(out)


def _iban(value: str, key: bytes, inverse: bool) -> str | None:
    def check(country: str, rest: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97

    flat = value.replace(" ", "")
    if not 15 <= len(flat) <= 34 or check(flat[:2], flat[4:]) != int(flat[2:4]):
        return None
    rest = _by_class(flat[4:], key, f"iban{flat[:2]}", inverse)
    it = iter(f"{flat[:2]}{check(flat[:2], rest):02d}{rest}")
    return "".join(c if c == " " else next(it) for c in value)


def _email(value: str, key: bytes, inverse: bool) -> str | None:
    """The local part and the domain's labels before the last two are permuted within their characters' classes."""
    local, domain = value.rsplit("@", 1)
    labels = domain.split(".")
    head, tail = ".".join(labels[:-2]), ".".join(labels[-2:])
    return _by_class(local + "@" + head, key, "email", inverse) + ("." if head else "") + tail


#: Patterns in the order of KINDS; a match that its function refuses is no finding.
_PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])",
    "ip": r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![\w-]|[./][0-9])",
}
_FUNCTIONS = {"email": _email, "iban": _iban, "ssn": _ssn, "card": _card, "phone": _phone, "ip": _ip, "date": _date}
_COMPILED = {k: re.compile(_PATTERNS[k]) for k in KINDS}
_ANY_DIGIT = re.compile("[0-9]")


def pseudonym(kind: str, value: str, key: bytes, inverse: bool = False) -> str | None:
    """What stands for a value, or with ``inverse`` the value again; None if it is no valid one of its kind."""
    return (_remembered if len(value) <= SHORT else _pseudonym)(kind, value, key, inverse)


def _pseudonym(kind: str, value: str, key: bytes, inverse: bool) -> str | None:
    return _FUNCTIONS[kind](value, key, inverse)


_remembered = lru_cache(maxsize=100_000)(_pseudonym)


def findings(text: str | None, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) without overlaps, in order."""
    if not text:
        return []
    kinds = [k for k in KINDS if k != "email"] if _ANY_DIGIT.search(text) else []
    kinds += ["email"] * ("@" in text)
    found = []
    for k in kinds:
        for m in _COMPILED[k].finditer(text):
            if (new := pseudonym(k, m[0], key)) is not None:
                found.append((m.start(), KINDS.index(k), m.end(), k, new))
    out, end = [], 0
    for start, _, stop, k, new in sorted(found):
        if start >= end:
            out.append((start, stop, k, new))
            end = stop
    return out


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", to: str | None = "pii") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and, unless ``to`` is None, an array of what was replaced: kind, start, end
    (code points of the text as it was)."""
    fields = kept(docs, *([to] if to is not None else []))
    names = [f.name for f in fields]
    at = names.index(text)
    docs = docs.select(*[F.col(f"`{n}`") for n in names])
    if to is not None:
        fields.append(T.StructField(to, T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>")))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(at)]
            found = [findings(x, key) for x in texts]
            columns = list(batch.columns)
            if any(found):
                columns[at] = pa.array([replaced(x, f) if f else x for x, f in zip(texts, found, strict=True)], pa.string())
            if to is not None:
                columns.append(pa.array([[{"kind": k, "start": a, "end": b} for a, b, k, _ in f] for f in found], arrow))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def _of_kind(kind: str):  # noqa: ANN202
    return lambda x: x["kind"] == kind


def op4(spark, sf_dir: str) -> DataFrame:
    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    counts = [F.size(F.filter("pii", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", *counts, "pii")
