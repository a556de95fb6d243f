"""Format-preserving pseudonyms for personal data.

Values are found by form and then validated: card numbers by their check digit, IBANs by theirs,
dates by the calendar, addresses by their octets, social security numbers by their areas.  A valid
value is ranked among the values of its format, the rank goes through a keyed Feistel permutation
of that many numbers (cycle walking keeps it inside), and the result is written in the same format:
separators, case, length, country prefix and check digits stay right.  The permutation depends on
the key and the kind alone, so equal values get equal pseudonyms in all documents, however they are
punctuated, and the holder of the key can undo them.  Dates are permuted as days whatever their form, those up to
the twelfth of a month among themselves; telephone numbers without their country code, which is told by
its digits.  Secrets are hexadecimal, or letters, digits, _ and - with a digit and a letter, after a name for one.
Anything that does not validate stays.
Dates are year, month, day with - or /, also before the time of an ISO timestamp, and day, month, year
or month, day, year with -, / or full stops (there the day first).  Dates with the names of months, with
years of two digits or without separators are not sought.

A null text stays null, an empty one empty.  Repeated rows change alike.  An empty table gives no
rows; other columns stay as they are.  Values inside longer runs of digits or letters are not values.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import map_batches, strings

ROUNDS, KEY = 8, b"an example key; pass your own"
KINDS = ("email", "phone", "card", "ip", "date", "ssn", "iban", "secret")
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_CASED = {c: _LOWER for c in _LOWER} | {c: _LOWER.upper() for c in _LOWER.upper()} | {c: "0123456789" for c in "0123456789"}
_ALPHABETS = {c: _LOWER for c in _LOWER} | {c: "0123456789" for c in "0123456789"}

_NUMBERS = re.compile(
    r"""
      (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
    | (?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?=T[0-9]{2}:?[0-9]{2})|(?!\w|[./-][0-9]))|(?:[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?!\w|[./-][0-9])))
    | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w|-[0-9]))
    | (?P<phone>(?<![\w+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4} | \+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,3})(?!\w|[.-][0-9])
        | (?<![\w(])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?!\w|-[0-9]) | (?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?!\w|-[0-9]))
    | (?P<card>(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}(?P<gap2>[ -])[0-9]{6}(?P=gap2)[0-9]{5})(?!\w|-[0-9]))
    | (?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w))
    | (?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z]))
    | (?P<token>(?<![\w-])(?=[\w-]*[0-9])(?=[\w-]*[A-Za-z])[A-Za-z0-9_-]{16,128}(?![\w-]))
    """,
    re.VERBOSE,
)
_NAMED = re.compile(r"(?i:token|secret|key|password|passwd|credential)s?[\"']?\s*[=:]\s*[\"']?$")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_DIGIT = re.compile("[0-9]")
#: Country codes of two digits; 1 and 7 have one digit, all others three.
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


class Pseudonyms:
    """The permutations of one key."""

    def __init__(self, key: bytes = KEY, inverse: bool = False):
        self._key, self._inverse = blake2b(key).digest(), inverse
        self._known: dict[tuple[str, str], str] = {}

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A permutation of 0..n-1 that depends on the key and the tweak."""
        if n < 2:
            return x
        h = max(1, ((n - 1).bit_length() + 1) // 2)
        size, mask, tweaked = (h + 7) // 8, (1 << h) - 1, f"{tweak}/{n}/".encode()
        width = min(64, size)

        def f(k: int, r: int) -> int:
            out, i = b"", 0
            while len(out) < size:
                out += blake2b(tweaked + bytes([k, i % 256]) + r.to_bytes(size, "big"), key=self._key, digest_size=width).digest()
                i += 1
            return int.from_bytes(out[:size], "big") & mask

        while True:
            left, right = x >> h, x & mask
            for k in reversed(range(ROUNDS)) if self._inverse else range(ROUNDS):
                left, right = (right ^ f(k, left), left) if self._inverse else (right, left ^ f(k, right))
            x = left << h | right
            if x < n:
                return x

    def string(self, value: str, alphabets: Callable[[str], str | None], tweak: str) -> str:
        """Letters and digits permuted as one number; characters without an alphabet stay."""
        sets = [alphabets(c) for c in value]
        rank, n = 0, 1
        for c, s in zip(value, sets, strict=True):
            if s:
                rank, n = rank * len(s) + s.index(c), n * len(s)
        rank, out = self.permute(rank, n, tweak), []
        for c, s in zip(reversed(value), reversed(sets), strict=True):
            if s:
                rank, i = divmod(rank, len(s))
                c = s[i]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, value: str, tweak: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        """Decimal strings of one length; walks on until the result is valid, as the value is."""
        out = value
        while True:
            out = str(self.permute(int(out), 10 ** len(value), tweak)).zfill(len(value))
            if valid(out):
                return out

    def of(self, kind: str, value: str) -> str | None:
        """The pseudonym of a value, or None if it is not valid."""
        if (found := self._known.get((kind, value))) is None:
            found = getattr(self, f"_{kind}")(value)
            if len(self._known) < 100_000:
                self._known[kind, value] = found or ""
        return found or None

    def _email(self, value: str) -> str | None:
        local, _, domain = value.rpartition("@")
        host, dot, top = domain.rpartition(".")
        lower = self.string(f"{local}@{host}".lower(), _ALPHABETS.get, "email")
        return "".join(c.upper() if o.isupper() else c for c, o in zip(lower, f"{local}@{host}", strict=True)) + dot + top

    def _phone(self, value: str) -> str | None:
        own = "".join(re.findall("[0-9]", value))
        keep = 0
        if value[0] == "+":
            keep = 1 if own[0] in "17" else 2 if own[:2] in _TWO_DIGITS else 3
        if not 6 <= len(own) - keep <= 14:
            return None
        return _refill(value, own[:keep] + self.digits(own[keep:], "phone"))

    def _card(self, value: str) -> str | None:
        own = re.sub(r"\D", "", value)
        if not luhn(own) or not own.strip("0"):
            return None
        body = self.digits(own[:-1], "card", lambda x: bool(x.strip("0")))
        return _refill(value, body + next(d for d in "0123456789" if luhn(body + d)))

    def _ip(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        return ".".join(map(str, self.permute(int.from_bytes(bytes(octets), "big"), 2**32, "ip").to_bytes(4, "big")))

    def _date(self, value: str) -> str | None:
        sep = re.search(r"\D", value)[0]
        parts = value.split(sep)
        y, m, d = (int(x) for x in (parts if len(parts[0]) == 4 else reversed(parts)))
        either = sep != "." and len(parts[0]) < 4  # the month may stand first
        if either and m > 12 >= d:
            m, d, swapped = d, m, True
        else:
            swapped = False
        try:
            at = date(y, m, d).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= at <= LAST_DAY:
            return None
        # days up to the twelfth stay among themselves: then any form is read back as the same date
        late = date.fromordinal(at).day > 12
        while True:
            at = self.permute(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date") + FIRST_DAY
            new = date.fromordinal(at)
            if (new.day > 12) == late:
                break
        day, month = (new.month, new.day) if swapped else (new.day, new.month)
        wide = all(len(x) == 2 for x in parts if len(x) < 4)
        form = "{:02d}" if wide else "{}"
        return sep.join([f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"]) if len(parts[0]) == 4 else sep.join([form.format(day), form.format(month), f"{new.year:04d}"])

    def _ssn(self, value: str) -> str | None:
        own = value.replace("-", "")
        return _refill(value, self.digits(own, "ssn", social)) if social(own) else None

    def _iban(self, value: str) -> str | None:
        own = value.replace(" ", "")
        if len(own) < 15 or _mod97(own[4:] + own[:4]) != 1:
            return None
        body = self.string(own[4:].lower(), _ALPHABETS.get, f"iban{own[:2]}").upper()
        return _refill(value, own[:2] + f"{98 - _mod97(body + own[:2] + '00'):02d}" + body, r"\w")

    def _secret(self, value: str) -> str | None:
        if not re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", value):
            return self.string(value, _CASED.get, "token")
        alphabet = "0123456789ABCDEF" if re.search("[A-F]", value) else "0123456789abcdef"
        return self.string(value, lambda c: alphabet, "secret")

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it had."""
        counts = dict.fromkeys(KINDS, 0)
        spans: list[tuple[int, int, str]] = []
        at = text.find("@")
        while at >= 0:
            if (left := _LOCAL.search(text, max(0, at - 64), at)) and (right := _DOMAIN.match(text, at + 1, at + 256)):
                spans.append((left.start(), right.end(), "email"))
            at = text.find("@", at + 1)
        if _DIGIT.search(text):
            taken = iter([*spans, (len(text), len(text), "")])
            near = next(taken)
            for m in _NUMBERS.finditer(text):
                while near[1] <= m.start() and near[2]:
                    near = next(taken)
                if m.end() <= near[0] and (not (m.group("secret") or m.group("token")) or _NAMED.search(text, max(0, m.start() - 40), m.start())):
                    spans.append((*m.span(), next((k for k in KINDS[1:] if m.group(k)), "secret")))
        if not spans:
            return text, counts
        out, end = [], 0
        for a, b, kind in sorted(spans):
            if a >= end and (new := self.of(kind, text[a:b])):
                out += [text[end:a], new]
                end = b
                counts[kind] += 1
        return "".join([*out, text[end:]]), counts


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def social(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(form: str, characters: str, places: str = r"\d") -> str:
    """form with its places filled anew."""
    it = iter(characters)
    return re.sub(places, lambda _: next(it), form)


def pseudonymise(docs: DataFrame, key: bytes = KEY, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """docs with the text replaced, and n_pii and n_<kind> in place of columns of these names."""
    added = ["n_pii", *(f"n_{k}" for k in KINDS)]
    docs = docs.drop(*added)
    schema = docs.limit(0).withColumns({c: F.lit(0).cast("int") for c in added}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key, inverse)
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts, counts = [], []
            for text in strings(batch.column(i)):
                new, n = (None, dict.fromkeys(KINDS, 0)) if text is None else own.replace(text)
                texts.append(new)
                counts.append([sum(n.values()), *n.values()])
            columns = list(batch.columns)
            columns[i] = pa.array(texts, pa.string())
            columns += [pa.array([c[k] for c in counts], pa.int32()) for k in range(len(added))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

    return map_batches(docs, run, schema)


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
