"""Personal data (operator 5): format-preserving pseudonyms from a keyed Feistel permutation.

Values are found by pattern and then validated (card and account checksums, ranges of dates, network
addresses and identity numbers). A value becomes its rank among all values of its format; a keyed
Feistel network permutes the ranks, and the result is written back in the same format, checksum and
separators included. Equal values get equal pseudonyms in every document and every run with the same
key, different values stay different, and no value keeps its own form where its format has another.

Found: payment cards (Luhn), IBANs (mod 97), telephone numbers, US social security numbers, IPv4
addresses, calendar dates, e-mail addresses (the part before @), and credentials (access key ids, values
given to password, secret, token or api key).

Defined cases: null texts stay null, empty ones empty, both with no values; texts of any length are
searched whole; repeated rows give repeated results; an empty table gives an empty table; input columns
are carried along, and one with the name of an output column is replaced.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.common import packed, tidy, unpacked

ROUNDS = 8
DEFAULT_KEY = b"replace this key"
#: Characters of a secret that one permutation takes.
PIECE = 200
#: Characters of an IBAN, by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of 0..n-1 without fixed points, for any n from 2 on.

    Balanced Feistel on the next even number of bits, walked until it falls inside n, gives F; the
    permutation is F^-1(F(x) + 1), one cycle through all values.
    """

    def __init__(self, n: int, key: bytes, tweak: str):
        self.n = n
        self._half = max(1, ((n - 1).bit_length() + 1) // 2)
        self._mask = (1 << self._half) - 1
        self._bytes = (self._half + 7) // 8
        self._key = hashlib.sha256(key + b"\0" + tweak.encode() + b"\0" + str(n).encode()).digest()

    def _mix(self, number: int, x: int) -> int:
        digest = hashlib.shake_256(self._key + bytes([number]) + x.to_bytes(self._bytes, "big"))
        return int.from_bytes(digest.digest(self._bytes), "big") & self._mask

    def _rounds(self, x: int, order: range, back: bool) -> int:
        left, right = x >> self._half, x & self._mask
        for r in order:
            if back:
                left, right = right ^ self._mix(r, left), left
            else:
                left, right = right, left ^ self._mix(r, right)
        return left << self._half | right

    def _walk(self, x: int, back: bool) -> int:
        order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        while True:
            x = self._rounds(x, order, back)
            if x < self.n:
                return x

    def __call__(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The next valid value on the cycle of ``x``, which must be valid itself."""
        if self.n < 2:
            return x
        while True:
            x = self._walk((self._walk(x, False) + 1) % self.n, True)
            if valid(x):
                return x

    def inverse(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        if self.n < 2:
            return x
        while True:
            x = self._walk((self._walk(x, False) - 1) % self.n, True)
            if valid(x):
                return x


DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _alphabet(c: str, is_hex: bool) -> str | None:
    if is_hex and c in HEX:
        return HEX
    return next((a for a in (DIGITS, LOWER, UPPER) if c in a), None)


class Pseudonyms:
    """Pseudonyms under one key; ``back`` restores the values."""

    def __init__(self, key: bytes = DEFAULT_KEY, back: bool = False):
        self._key, self._back = key, back
        self._made: dict[tuple[str, int], Permutation] = {}

    def _move(self, kind: str, x: int, n: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        if (kind, n) not in self._made:
            if len(self._made) > 10_000:
                self._made = {}
            self._made[kind, n] = Permutation(n, self._key, kind)
        permutation = self._made[kind, n]
        return permutation.inverse(x, valid) if self._back else permutation(x, valid)

    def characters(self, kind: str, value: str, is_hex: bool = False, valid: Callable[[str], bool] | None = None) -> str:
        """Letters and digits permuted within their classes; every other character stays."""
        sets = [_alphabet(c, is_hex) for c in value]
        rank, n = 0, 1
        for c, a in zip(value, sets, strict=True):
            if a:
                rank, n = rank * len(a) + a.index(c), n * len(a)

        def shown(x: int) -> str:
            out = []
            for c, a in zip(reversed(value), reversed(sets), strict=True):
                if a:
                    x, k = divmod(x, len(a))
                    c = a[k]
                out.append(c)
            return "".join(reversed(out))

        form = "".join("-" if a is None else str(len(a)) for a in sets)
        return shown(self._move(f"{kind} {form}", rank, n, (lambda x: valid(shown(x))) if valid else lambda _: True))

    def number(self, kind: str, value: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        """The digits permuted, separators kept; ``valid`` sees the digits alone."""
        digits = "".join(c for c in value if c.isdigit())
        width = len(digits)
        moved = self._move(f"{kind} {width}", int(digits), 10**width, lambda x: valid(f"{x:0{width}d}"))
        fresh = iter(f"{moved:0{width}d}")
        return "".join(next(fresh) if c.isdigit() else c for c in value)

    def card(self, value: str) -> str:
        at = max(i for i, c in enumerate(value) if c.isdigit())
        moved = self.number("card", value[:at], lambda d: d[0] != "0")
        return moved + _luhn_digit("".join(c for c in moved if c.isdigit())) + value[at + 1 :]

    def iban(self, value: str) -> str:
        body = self.characters("iban", value[4:])
        return value[:2] + f"{98 - _mod97(body.replace(' ', '') + value[:2] + '00'):02d}" + body

    def address(self, value: str) -> str:
        """Each part keeps its number of digits."""
        parts = value.split(".")
        spans = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts]
        rank, n = 0, 1
        for part, (low, width) in zip(parts, spans, strict=True):
            rank, n = rank * width + int(part) - low, n * width
        x = self._move("address " + str([len(p) for p in parts]), rank, n)
        out = []
        for low, width in reversed(spans):
            x, k = divmod(x, width)
            out.append(str(low + k))
        return ".".join(reversed(out))

    def date(self, value: str, order: str) -> str:
        """``order``: ymd, dmy, or mdy for dates that can only be read month first."""
        separator = re.sub(r"\d", "", value)[0]
        texts = dict(zip(order, value.split(separator), strict=True))
        parts = {c: int(t) for c, t in texts.items()}
        day = datetime.date(parts["y"], parts["m"], parts["d"]).toordinal()

        short = [c for c in "md" if len(texts[c]) == 1]  # parts of one digit stay so

        def fits(x: int) -> bool:
            fresh = datetime.date.fromordinal(FIRST_DAY + x)
            if "m" in short and fresh.month > 9 or "d" in short and fresh.day > 9:
                return False
            return order != "mdy" or fresh.day > 12

        moved = datetime.date.fromordinal(
            FIRST_DAY + self._move(f"date {order}" + "".join(short), day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, fits)
        )
        shown = {"y": f"{moved.year:04d}"} | {
            c: f"{n:0{len(texts[c])}d}" for c, n in (("m", moved.month), ("d", moved.day))
        }
        return separator.join(shown[c] for c in order)


def _luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _date_order(value: str) -> str | None:
    a, b, c = map(int, re.split(r"\D", value))
    if len(re.split(r"\D", value)[0]) == 4:
        tries = [("ymd", a, b, c)]
    else:
        tries = [("dmy", c, b, a), ("mdy", c, a, b)]
    for order, y, m, d in tries:
        if 1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]:
            return order
    return None


def _social(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _card_ok(m: re.Match) -> bool:
    digits = "".join(c for c in m[0] if c.isdigit())
    return digits[0] != "0" and len(set(digits)) > 1 and _luhn_digit(digits[:-1]) == digits[-1]


def _phone(p: Pseudonyms, m: re.Match) -> str:
    prefix = m["country"] or ""
    rest = m[0][len(prefix) :]
    first = _leading(next(c for c in rest if c.isdigit()))
    kind = "phone" + prefix + (first if first in "01" else "")
    return prefix + p.number(kind, rest, lambda d: _leading(d[0]) == first)


def _leading(digit: str) -> str:
    """0 and 1 stay what they are, others change among themselves."""
    return digit if digit in "01" else "2"


def _phone_ok(m: re.Match) -> bool:
    shown = m[0][len(m["country"] or "") :]
    rest = [c for c in shown if c.isdigit()]
    # three groups of four after a 1 are years or part of an account
    groups = not m["country"] and rest[0] == "1" and re.fullmatch(r"[0-9]{4}(?:[ .-][0-9]{4}){2}", shown)
    return not groups and 7 <= len(rest) <= 12


def _secret(p: Pseudonyms, m: re.Match) -> str:
    value = m["value"]
    is_hex = re.fullmatch(r"[0-9a-f]+", value) is not None
    at = m.start("value") - m.start()
    # long values in pieces, each by a permutation of its own
    pieces = [
        p.characters(f"secret {i}" if i else "secret", value[i : i + PIECE], is_hex) for i in range(0, len(value), PIECE)
    ]
    return m[0][:at] + "".join(pieces) + m[0][at + len(value) :]


def _ibans(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches with the right check digits: of the length of their country, or as long as they match."""
    at = 0
    while m := pattern.search(text, at):
        at = m.start() + 1
        ends = [m.end()]
        if m[0][:2] in IBAN_LENGTHS:
            places = [i for i, c in enumerate(m[0], m.start()) if c != " "]
            if len(places) >= IBAN_LENGTHS[m[0][:2]]:
                ends.insert(0, places[IBAN_LENGTHS[m[0][:2]] - 1] + 1)
        for end in ends:
            short = pattern.fullmatch(text, m.start(), end)
            if short and not (text[end : end + 1].isalnum() or text[end : end + 1] == "_") and _mod97(
                (short[0][4:] + short[0][:4]).replace(" ", "")
            ) == 1:
                yield short
                at = end
                break


@dataclass(frozen=True)
class Kind:
    """``hint``: a character that every such value holds (a digit where empty)."""

    name: str
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    replace: Callable[[Pseudonyms, re.Match], str]
    hint: str = ""
    find: Callable[[re.Pattern, str], Iterator[re.Match]] = re.Pattern.finditer


#: Of values that overlap, the first counts; of values that begin together, the first of these kinds.
KINDS = (
    Kind("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?=@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,})"),
         lambda m: True, lambda p, m: p.characters("email", m[0]), "@"),
    Kind("secret", re.compile(r"(?i:\b(?:password|passwd|secret|token|api[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?P<value>[A-Za-z0-9+/_.~-]{8,})"),
         lambda m: any(c.isdigit() for c in m["value"]), _secret),
    Kind("key", re.compile(r"\b(?:AKIA|ASIA)(?P<value>[A-Z0-9]{16})\b"), lambda m: True, _secret),
    Kind("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b"),
         lambda m: True, lambda p, m: p.iban(m[0]), find=_ibans),
    Kind("card", re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])"),
         _card_ok, lambda p, m: p.card(m[0])),
    Kind("address", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[\w])"),
         lambda m: True, lambda p, m: p.address(m[0])),
    Kind("date", re.compile(r"(?<![\w/.-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?!(?!T[0-9]{2})[\w/-])"),
         lambda m: _date_order(m[0]) is not None, lambda p, m: p.date(m[0], _date_order(m[0]))),
    Kind("social", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
         lambda m: _social(m[0].replace("-", "")), lambda p, m: p.number("social", m[0], _social)),
    Kind("phone", re.compile(r"(?<![\w.+-])(?:(?P<country>\+[0-9]{1,3})[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-])"),
         _phone_ok, _phone),
    Kind("e164", re.compile(r"(?<![\w.+-])(?P<country>\+(?:[17]|[2-9][0-9]))[0-9]{7,13}(?![\w-])"), lambda m: True, _phone, "+"),
)
ANY_DIGIT = re.compile(r"[0-9]")


def pseudonymised(text: str | None, names: Pseudonyms) -> tuple[str | None, int]:
    """The text with every value replaced, and the number of values."""
    if not text:
        return text, 0
    digits, found = ANY_DIGIT.search(text) is not None, []
    for order, kind in enumerate(KINDS):
        if (kind.hint in text) if kind.hint else digits:
            found += [(m.start(), order, m.end(), kind, m) for m in kind.find(kind.pattern, text) if kind.valid(m)]
    if not found:
        return text, 0
    parts, at, n = [], 0, 0
    for start, _, end, kind, m in sorted(found, key=lambda x: x[:2]):
        if start >= at:  # else it overlaps a value that begins before it
            parts += [text[at:start], kind.replace(names, m)]
            at, n = end, n + 1
    return "".join([*parts, text[at:]]), n


def pseudonymise(
    docs: DataFrame, text: str = "text", count: str | None = "n_values", key: bytes = DEFAULT_KEY, back: bool = False,
) -> DataFrame:
    """Replace the values of ``text``; ``count`` adds their number. ``back`` undoes it, with the same key.

    The pseudonym of a value is found again by the same patterns, so the way back needs no table.
    """
    packs = docs.select(packed(docs), F.col(text).alias("t"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in source:
            done = [pseudonymised(t, names) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                ["row", "t", "n"],
            )

    schema = T.StructType([packs.schema["row"], T.StructField("t", T.StringType()), T.StructField("n", T.LongType())])
    new = {text: F.col("t")} | ({count: F.col("n")} if count else {})
    return unpacked(packs.mapInArrow(tidy(run), schema), docs.columns, **new)
