"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their kind's validation are replaced by a keyed permutation of
their own format: a Feistel network over the numbers of that format (cycle walking where a
format is not all of a range). So an equal value gets the same pseudonym in every document,
different values stay different, the new value is again valid (Luhn and IBAN check digits,
calendar dates, telephone and social security rules), and whoever has the key can invert it.

Kinds: ``email`` (letters and digits of the local part), ``iban``, ``ip`` (IPv4), ``date``
(year-month-day, and day or month first with ``/`` or ``.``; 1900 to 2099), ``ssn``, ``phone``
(ten digits, with or without country code) and ``card`` (13 to 19 digits, Luhn).

Where the longest match of a kind fails its validation, shorter ones inside it that end at
separators are tried (IBAN by their country's length, cards of 13 to 19 digits, the longest
first), and the search goes on inside it. A date may be followed by ``T`` and a time.

Defined results: null text stays null, empty text empty; a value that fails its validation is
left as it is; repeated rows give equal results; each row is replaced by itself, without any
shuffle. Spans are code points of the original text, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b
from itertools import chain
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame

from mathloom.llm import common

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
#: For tests and examples; give your own secret key in production.
EXAMPLE_KEY = b"example key, replace in production"
FIND = re.compile(
    r"""(?<![0-9A-Za-z])(?:(?P<stamp>[0-9]{4}-[0-9]{2}-[0-9]{2})(?=T[0-9]{2}:?[0-9]{2})|(?:
    (?P<email>(?<![.+_%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})
    |(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)
    |(?P<ip>(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9]))
    |(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})
    |(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9]))
    |(?P<phone>(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{11,13})
    |(?P<card>[0-9](?:[ -]?[0-9]){12,18})
    )(?![0-9A-Za-z]))""",
    re.X | re.A,
)
#: What may be a card or hold one, and its groups of digits; a card that is cut out of more has
#: at least so many digits in each group but its last.
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}", re.A)
DIGITS, GROUP = re.compile(r"[0-9]+", re.A), 3
RUN = re.compile(r"[0-9](?:[ -]?[0-9]){12,63}", re.A)
#: Length of an IBAN by country.
IBAN = {
    k: n
    for n, of in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for k in of.split()
}
#: Texts without any of these hold nothing that FIND could match.
WORTH = re.compile(r"[0-9]{3}|@|[0-9][./][0-9]", re.A)
EPOCH, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of the numbers below ``n``, another one for each ``tweak``."""

    ROUNDS = 8

    def __init__(self, key: bytes) -> None:
        self.key = blake2b(key).digest()

    def _round(self, i: int, tweak: str, half: int, mod: int) -> int:
        told = f"{i}|{tweak}|{half}".encode()
        return int.from_bytes(blake2b(told, key=self.key, digest_size=16 + mod.bit_length() // 8).digest(), "big") % mod

    def _once(self, x: int, n: int, tweak: str, back: bool) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(x, b)
        for i in range(self.ROUNDS)[:: -1 if back else 1]:
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(i, tweak, left, b)) % b
            else:
                left = (left + sign * self._round(i, tweak, right, a)) % a
        return left * b + right

    def permute(self, x: int, n: int, tweak: str, allowed: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of ``x``, walked on until it is below ``n`` and allowed, as ``x`` is."""
        if n < 2:
            return x
        while True:
            x = self._once(x, n, tweak, back)
            if x < n and allowed(x):
                return x


def luhn(digits: str) -> bool:
    return check_digit(digits[:-1]) == digits[-1]


def check_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def refill(pattern: str, chars: str) -> str:
    """``pattern`` with its letters and digits replaced by ``chars``, in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def radices(text: str) -> list[tuple[str, int]]:
    return [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) for c in text]


class Pseudonyms:
    def __init__(self, key: bytes = EXAMPLE_KEY) -> None:
        self.feistel = Feistel(key)
        self.cached = lru_cache(1 << 16)(self._replace)

    def __call__(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value of a kind; None if it isn't valid."""
        return self.cached(kind, value, False)

    def invert(self, kind: str, value: str) -> str | None:
        return self._replace(kind, value, True)

    def _replace(self, kind: str, value: str, back: bool) -> str | None:
        return getattr(self, f"_{kind}")(value, back)

    def _mixed(self, text: str, tweak: str, back: bool) -> str:
        """Letters stay letters of their case, digits digits."""
        kinds = radices(text)
        x = 0
        for c, (base, r) in zip(text, kinds, strict=True):
            x = x * r + ord(c) - ord(base)
        x = self.feistel.permute(x, prod(r for _, r in kinds), tweak + "".join(b for b, _ in kinds), back=back)
        out = []
        for base, r in reversed(kinds):
            x, d = divmod(x, r)
            out.append(chr(ord(base) + d))
        return "".join(reversed(out))

    def _email(self, value: str, back: bool) -> str | None:
        local, _, host = value.partition("@")
        return refill(local, self._mixed("".join(c for c in local if c.isalnum()), "email", back)) + "@" + host

    def _iban(self, value: str, back: bool) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self._mixed(plain[4:], "iban" + plain[:2], back)
        check = 98 - mod97(body + plain[:2] + "00")
        return refill(value, f"{plain[:2]}{check:02d}{body}")

    def _ip(self, value: str, back: bool) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self.feistel.permute(x, 1 << 32, "ip", back=back).to_bytes(4, "big")))

    def _date(self, value: str, back: bool) -> str | None:
        mark = "-" if "-" in value else "/" if "/" in value else "."
        a, b, c = value.split(mark)
        if mark == "-":
            order = "ymd"
        else:
            order = "dmy" if mark == "." or int(a) > 12 else "mdy"
        of = dict(zip(order, (a, b, c), strict=True))
        try:
            day = date(int(of["y"]), int(of["m"]), int(of["d"])).toordinal() - EPOCH
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None

        def written(x: int) -> str:
            d = date.fromordinal(EPOCH + x)
            got = {"y": str(d.year), "m": str(d.month).zfill(len(of["m"])), "d": str(d.day).zfill(len(of["d"]))}
            return mark.join(got[k] for k in order)

        def alike(x: int) -> bool:
            got = written(x)
            return len(got) == len(value) and [len(p) for p in got.split(mark)] == [len(a), len(b), len(c)] and (mark != "/" or (int(got.split(mark)[0]) > 12) == (order == "dmy"))

        return written(self.feistel.permute(day, DAYS, f"date{order}{mark}{len(a)}{len(b)}", alike, back))

    def _digits(self, value: str, tweak: str, fine: Callable[[str], bool], back: bool) -> str | None:
        digits = "".join(c for c in value if c.isdigit())
        if not fine(digits):
            return None
        n = len(digits)
        x = self.feistel.permute(int(digits), 10**n, f"{tweak}{n}", lambda x: fine(str(x).zfill(n)), back)
        return refill(value, str(x).zfill(n))

    def _ssn(self, value: str, back: bool) -> str | None:
        return self._digits(value, "ssn", lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000", back)

    def _phone(self, value: str, back: bool) -> str | None:
        """The last ten digits are permuted, the country code stays."""
        cut = len(value)
        seen = 0
        while seen < 10:
            cut -= 1
            seen += value[cut].isdigit()
        own = self._digits(value[cut:], "phone", lambda d: d[0] > "1" and d[3] > "1", back)
        return None if own is None else value[:cut] + own

    def _card(self, value: str, back: bool) -> str | None:
        digits = "".join(c for c in value if c.isdigit())
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        n = len(digits) - 2
        x = self.feistel.permute(int(digits[1:-1]), 10**n, f"card{n}", back=back)
        body = digits[0] + str(x).zfill(n)
        return refill(value, body + check_digit(body))


def shorter(text: str, m: re.Match, stop: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what may be valid inside or around a match that isn't."""
    start, end = m.span()
    if m.lastgroup == "iban":
        length = IBAN.get(text[start : start + 2])
        for cut in range(end - 1, start, -1):
            if text[cut] == " " and (length is None or cut - start - text.count(" ", start, cut) == length):
                yield "iban", start, cut
    if m.lastgroup in ("phone", "card") and (run := RUN.match(text, start, stop)):
        groups = [g.span() for g in DIGITS.finditer(text, *run.span())]
        cards = []
        for i, (s, _) in enumerate(groups):
            n = 0
            for a, e in groups[i:]:
                n += e - a
                if 13 <= n <= 19 and not text[e : e + 1].isalnum():
                    cards.append((-n, s, e))
                if n > 19 or e - a < GROUP:
                    break
        for _, s, e in sorted(cards):
            yield "card", s, e


def found(text: str, names: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values of a text."""
    return list(spans_of(text, names, 0, len(text))) if WORTH.search(text) else []


def spans_of(text: str, names: Pseudonyms, at: int, stop: int) -> Iterator[tuple[int, int, str, str]]:
    while m := FIND.search(text, at, stop):
        kind = "date" if m.lastgroup == "stamp" else m.lastgroup
        tried = [(kind, *m.span())]
        if kind in ("phone", "iban") and CARD.fullmatch(m.group()):
            tried.append(("card", *m.span()))
        at = m.start() + 1
        for kind, start, end in chain(tried, shorter(text, m, stop)):
            new = names(kind, text[start:end])
            if new is not None:
                # what a value inside the match left before it
                yield from spans_of(text, names, at, start)
                yield start, end, kind, new
                at = end
                break


def pseudonymised(text: str, names: Pseudonyms) -> tuple[str, list[tuple[int, int, str, str]]]:
    spans = found(text, names)
    parts, at = [], 0
    for start, end, _, new in spans:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]]), spans


def pseudonyms(documents: DataFrame, key: bytes = EXAMPLE_KEY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, text with pseudonyms, n_found, and spans as kind:start:end, comma-joined."""
    spec = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts, counts, spans = [], [], []
                for text in batch.column(len(keep)):
                    value = text.as_py()
                    new, got = (None, []) if value is None else pseudonymised(value, names)
                    texts.append(new)
                    counts.append(len(got))
                    spans.append(",".join(f"{k}:{s}:{e}" for s, e, k, _ in got))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(spans, pa.string())], names=[*keep, "text", "n_found", "spans"])

    return common.map_arrow(documents.select(*keep, "text"), run, ", ".join([*spec, "text string, n_found bigint, spans string"]))
