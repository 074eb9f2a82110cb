"""Personal data: validated numbers and dates get format-preserving pseudonyms from a keyed Feistel network."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratched, text_slices, texts_of

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
ROUNDS = 8
#: Days that dates are permuted among.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


class Feistel:
    """Keyed permutations of 0..n-1 for any n, one for each label; no number stays in its place if n > 1."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, label: str, n: int, turn: int, value: int, most: int) -> int:
        said = f"{label}|{n}|{turn}|{value}".encode()
        keyed = hashlib.blake2b(said, key=self.key[:64]).digest()
        return int.from_bytes(hashlib.shake_256(keyed).digest(most.bit_length() // 8 + 9), "big") % most

    def _walk(self, label: str, n: int, x: int, back: bool) -> int:
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        turns = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        while True:  # cycle walking: a * b is hardly above n
            left, right = divmod(x, b)
            for t in turns:
                sign = -1 if back else 1
                if t % 2:
                    right = (right + sign * self._round(label, n, t, left, b)) % b
                else:
                    left = (left + sign * self._round(label, n, t, right, a)) % a
            x = left * b + right
            if x < n:
                return x

    def swap(self, label: str, n: int, x: int, back: bool = False) -> int:
        """x's pseudonym: one step along a keyed cycle through all numbers. back: from the pseudonym."""
        if n < 2:
            return x
        step = -1 if back else 1
        return self._walk(label, n, (self._walk(label, n, x, False) + step) % n, True)


def _classes(text: str, hexadecimal: bool) -> list[str]:
    """Of each character the alphabet that it stays in; empty: it stays as it is."""
    letters = [c for c in text if c.isalnum()]
    if hexadecimal and all(c in HEX for c in letters):
        return [HEX if c in HEX else "" for c in text]
    return [next((a for a in (DIGITS, LOWER, UPPER) if c in a), "") for c in text]


def permute_text(feistel: Feistel, label: str, text: str, back: bool = False, hexadecimal: bool = False) -> str:
    """Letters and digits permuted together within their classes; all else stays. On demand, hexadecimal stays hexadecimal."""
    classes = _classes(text, hexadecimal)
    x = 0
    n = math.prod(len(a) for a in classes if a)
    for c, a in zip(text, classes, strict=True):
        if a:
            x = x * len(a) + a.index(c)
    x = feistel.swap(f"{label}:{''.join('x' if not a else 'h' if a is HEX else a[0] for a in classes)}", n, x, back)
    out = []
    for c, a in zip(reversed(text), reversed(classes), strict=True):
        if a:
            x, k = divmod(x, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


# Detectors: (kind, pattern, validator and pseudonym maker). Patterns are bounded, so a long run costs no more than its length.


def _spread(template: str, plain: str) -> str:
    """plain's characters in the places of template's letters and digits."""
    given = iter(plain)
    return "".join(next(given) if c.isalnum() else c for c in template)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    plain = "".join(c for c in text if c.isdigit())
    if not 13 <= len(plain) <= 19 or luhn_digit(plain[:-1]) != plain[-1] or len(set(plain)) == 1:
        return None
    body = permute_text(f, "card", plain[:-1], back)
    return _spread(text, body + luhn_digit(body))


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = permute_text(f, "iban" + plain[:2], plain[4:], back)
    return _spread(text, f"{plain[:2]}{98 - _iban_rest(plain[:2] + '00' + body):02d}{body}")


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    """Area 001-899 but 666, group 01-99, serial 0001-9999."""
    area, group, serial = (int(x) for x in text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x = f.swap("ssn", 898 * 99 * 9999, x, back)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    x = f.swap("ip", 1 << 32, int.from_bytes(bytes(parts), "big"), back)
    return ".".join(map(str, x.to_bytes(4, "big")))


@lru_cache(maxsize=1)
def _late_days() -> list[int]:
    """The days after the twelfth of their month."""
    return [d for d in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(d).day > 12]


def _date(f: Feistel, text: str, back: bool) -> str | None:
    """Year first, or day.month.year, or month/day/year, or day-month-year; four-digit years. Where the last two are no dates, the other way
    round: then the day is above 12, in the pseudonym too, so that it's read the same way."""
    sep = next(c for c in text if not c.isdigit())
    parts = text.split(sep)
    orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0)] if sep == "." else [(2, 0, 1), (2, 1, 0)] if sep == "/" else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
            break
        except ValueError:
            continue
    else:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    if order == orders[0]:
        new = datetime.date.fromordinal(FIRST_DAY + f.swap("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY, back))
    else:
        late = _late_days()
        new = datetime.date.fromordinal(late[f.swap("late date", len(late), bisect.bisect_left(late, day), back)])
    padded = all(len(p) > 1 for p in parts)
    shown = [""] * 3
    for i, v in zip(order, (new.year, new.month, new.day), strict=True):
        shown[i] = f"{v:02d}" if padded else str(v)
    return sep.join(shown)


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    """The country code stays."""
    cut = re.match(r"\+\d{1,3}(?=[ (.\-])|\+\d", text)
    head = cut[0] if cut else ""
    if not 7 <= sum(c.isdigit() for c in text[len(head) :]) <= 14:
        return None
    return head + permute_text(f, "phone", text[len(head) :], back)


def _secret(f: Feistel, text: str, back: bool) -> str | None:
    """What follows a name and a sign of equality, or a known prefix."""
    cut = re.match(r"AKIA|ghp_|sk-|xox[a-z]-|[A-Za-z_]+\s{0,2}[:=]\s{0,2}[\"']?", text)
    return cut[0] + permute_text(f, "secret", text[cut.end() :], back, hexadecimal=True)


def _email(f: Feistel, text: str, back: bool) -> str | None:
    """The last two labels of the domain stay."""
    labels = text.split(".")
    tail = "." + ".".join(labels[-2:]) if "@" not in ".".join(labels[-2:]) else text[text.index("@") :]
    return permute_text(f, "email", text[: len(text) - len(tail)], back) + tail


EMAIL_LEFT, EMAIL_RIGHT = re.compile(r"[\w.%+\-]{1,64}\Z"), re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])|[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}")
DETECTORS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("secret", re.compile(r"(?i:(?:password|passwd|pwd|token|secret|api_?key|access_?key)\b\s{0,2}[:=]\s{0,2})(?:\"[^\s\"]{8,200}(?=\")|'[^\s']{8,200}(?=')|[\"']?[A-Za-z0-9+/_\-]{8,200})"), _secret),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abp]-[A-Za-z0-9\-]{10,72})(?![A-Za-z0-9])"), _secret),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("card", re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"), _card),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"), _ip),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _ssn),
    ("date", re.compile(r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/-]|\.\d)"), _date),
    ("phone", re.compile(r"\+\d{1,3}(?:[ .\-]\(?\d{1,4}\)?){3,6}(?!\d)|\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{2,4}[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4})?(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"), _phone),
)


#: Characters of the IBANs of countries.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26, "UA": 29,
}


def _ends(kind: str, m: re.Match) -> list[int]:
    """Where a match may end: as found, or for IBANs and phones, which may have taken in what follows them, before any of its later groups;
    first where the country's IBANs end."""
    if kind not in ("iban", "phone"):
        return [m.end()]
    ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] in " .-")]
    size = IBAN_SIZES.get(m[0][:2]) if kind == "iban" else None
    return sorted(ends, key=lambda e: len(m[0][: e - m.start()].replace(" ", "")) != size) if size else ends


def find(text: str, feistel: Feistel, back: bool = False) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, kind, pseudonym) in order, without overlap; at an overlap the kind that is listed first counts."""
    found: list[tuple[int, int, str, str]] = []
    starts, ends = [], []  # of the spans taken, in order; they don't overlap

    def add(start: int, end: int, kind: str, new: str | None) -> None:
        at = bisect.bisect_left(starts, end)
        if new is not None and (not at or ends[at - 1] <= start):
            starts.insert(at, start)
            ends.insert(at, end)
            found.append((start, end, kind, new))

    at = text.find("@")
    while at >= 0:
        left, right = EMAIL_LEFT.search(text, max(0, at - 64), at), EMAIL_RIGHT.match(text, at + 1)
        if left and right:
            add(left.start(), right.end(), "email", _email(feistel, text[left.start() : right.end()], back))
        at = text.find("@", at + 1)
    if HAS_DIGIT.search(text) or HAS_NAME.search(text):
        for kind, pattern, make in DETECTORS:
            at = 0
            while m := pattern.search(text, at):
                at = m.start() + 1 if kind == "iban" else m.end()
                for end in _ends(kind, m):
                    new = make(feistel, text[m.start() : end], back)
                    if new is not None:
                        add(m.start(), end, kind, new)
                        at = end
                        break
    return sorted(found)


HAS_DIGIT, HAS_NAME = re.compile(r"\d"), re.compile(r"(?i)password|passwd|pwd|token|secret|key|sk-|ghp_|xox|AKIA")


def replace(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    out, end = [], 0
    for a, b, _, new in spans:
        out += text[end:a], new
        end = b
    return "".join([*out, text[end:]])


@scratched
def pseudonymize(df: DataFrame, key: bytes, text: str = "text", spans: str | None = "pii") -> DataFrame:
    """df with its text pseudonymized and a column `spans`: array of (start, end, kind, pseudonym), offsets in code points of the old text.

    Numbers and dates count only if they are valid: cards by Luhn, IBANs modulo 97, addresses by range, social security
    numbers by their rules, dates by the calendar; pseudonyms are valid too. Equal values get equal pseudonyms in every row
    and run with the same key, and pseudonymize with back=True in find() undoes them. Null text stays null, with no spans;
    repeated rows are treated alike; an empty table gives no rows; other columns stay, one named like `spans` is replaced.
    """
    kept = [c for c in df.columns if c not in (text, spans)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    name = spans or "__pii"
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{text}` string", f"`{name}` array<struct<start:int,end:int,kind:string,pseudonym:string>>"])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in text_slices(batches, text):
            old = batch.column(text)
            found = [find(t, feistel) for t in texts_of(batch, text)]
            new = [None if t is None else replace(t, s) if s else t for t, s in zip(old.to_pylist(), found, strict=True)]
            rows = [[{"start": a, "end": b, "kind": k, "pseudonym": p} for a, b, k, p in s] for s in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(new, pa.string()), pa.array(rows, span_type)], [*kept, text, name])

    out = df.select(*kept, F.col(text)).mapInArrow(run, schema)
    return out if spans else out.drop(name)
