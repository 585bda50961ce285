"""Personal data replaced by format-preserving pseudonyms.

Values that pass their format's check (Luhn digits, IBAN remainder, calendar dates, number plans, octets) are permuted by a keyed
Feistel network within the set of all values of the same format, by walking the cycle until the result is such a value again.
The map is one to one and depends on the key only, so equal values stay linked across documents, and with the key it can be
undone. Texts go through one Arrow function; nothing is shuffled.

Defined results: a null text stays null, an empty one empty, with counts of 0; a text without personal data is returned as it
is; overlapping finds go to the kind named first in ``KINDS``; repeated rows get equal results; an empty table gives an empty
result; other columns are carried along. Time grows with the length of a text, long runs of numbers included. Undoing gives the
text back but where a new value makes another find together with its neighbours (a date behind bare digits, say).
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.common import shielded

#: Kinds in order of precedence, with the shape of each.
KINDS = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![\w-])"),
    "secret": re.compile(r"(?<=[=:])(?P<gap>\s*[\"']?)(?P<value>(?=[A-Za-z0-9_-]*[0-9])[A-Za-z0-9_-]{16,})"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![\w.-])(?:[0-9][ -]?){12,18}[0-9](?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "date": re.compile(r"(?<![\w/.-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![\w/-])"),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"),
    "phone": re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}(?:[ .-][0-9]{3,4}){1,2}(?![\w]|[.-][0-9])|(?<![\w.])\+[0-9]{8,15}(?!\w)"),
}
#: Lengths of IBANs by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, HR=21, HU=28,
    IE=22, IL=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22, MK=19, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, XK=20,
)
_ANY = re.compile("[0-9@]")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _draw(key: bytes, tweak: bytes, turn: int, value: int, bits: int) -> int:
    raw = hashlib.blake2b(value.to_bytes((value.bit_length() + 7) // 8 or 1, "big"), key=key, salt=bytes([turn]) + tweak[:15], digest_size=64).digest()
    while 8 * len(raw) < bits:
        raw += hashlib.blake2b(raw, key=key, digest_size=64).digest()
    return int.from_bytes(raw, "big") & ((1 << bits) - 1)


def feistel(value: int, size: int, key: bytes, tweak: bytes, *, undo: bool = False, rounds: int = 8) -> int:
    """A keyed permutation of the numbers below ``size``: a balanced Feistel network on the next even number of bits, walked
    until the result is below ``size``."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for turn in reversed(range(rounds)) if undo else range(rounds):
            if undo:
                a, b = b ^ _draw(key, tweak, turn, a, half), a
            else:
                a, b = b, a ^ _draw(key, tweak, turn, b, half)
        value = a << half | b
        if value < size:
            return value


#: Digits permuted as one number; longer values go in chunks of as many.
_CHUNK = 64


def _mixed(parts: list[tuple[int, int]], key: bytes, tweak: bytes, undo: bool) -> list[int]:
    """Digits of mixed bases (digit, base), permuted as one number. Of more than ``_CHUNK`` digits each chunk is permuted by a
    key of its own, drawn from the chunk before it as permuted, so time is in proportion to length."""
    if len(parts) > _CHUNK:
        out: list[int] = []
        drawn = b""
        for c in range(0, len(parts), _CHUNK):
            chunk = parts[c : c + _CHUNK]
            new = _mixed(chunk, key, tweak[:7] + drawn, undo)
            permuted = [p[0] for p in chunk] if undo else new
            drawn = hashlib.blake2b(bytes(permuted) + drawn, key=key, digest_size=8).digest()
            out += new
        return out
    size = reduce(lambda n, p: n * p[1], parts, 1)
    if size < 2:
        return [p[0] for p in parts]
    value = feistel(reduce(lambda n, p: n * p[1] + p[0], parts, 0), size, key, tweak, undo=undo)
    out = []
    for _, base in reversed(parts):
        value, digit = divmod(value, base)
        out.append(digit)
    return out[::-1]


def _like_characters(text: str, key: bytes, tweak: bytes, undo: bool) -> str:
    """ASCII digits, small and capital letters permuted within their kinds; all else stays."""
    starts = [ord("0") if "0" <= c <= "9" else ord("a") if "a" <= c <= "z" else ord("A") if "A" <= c <= "Z" else 0 for c in text]
    at = [i for i, s in enumerate(starts) if s]
    digits = _mixed([(ord(text[i]) - starts[i], 10 if starts[i] == ord("0") else 26) for i in at], key, tweak, undo)
    out = list(text)
    for i, d in zip(at, digits, strict=True):
        out[i] = chr(starts[i] + d)
    return "".join(out)


def _put_digits(shape: str, digits: str) -> str:
    source = iter(digits)
    return "".join(next(source) if "0" <= c <= "9" else c for c in shape)


def luhn_digit(payload: str) -> str:
    """The check digit that makes a number of these digits valid."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(payload)))
    return str(-total % 10)


def _email(value: str, key: bytes, undo: bool) -> str:
    head, _, top = value.rpartition(".")
    return _like_characters(head, key, b"email", undo) + "." + top


def _secret(value: str, key: bytes, undo: bool) -> str:
    if re.fullmatch("[0-9a-f]+", value):
        return "".join("0123456789abcdef"[d] for d in _mixed([(int(c, 16), 16) for c in value], key, b"hex", undo))
    return _like_characters(value, key, b"secret", undo)


def _iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _iban(value: str, key: bytes, undo: bool) -> str | None:
    compact = value.replace(" ", "")
    if _iban_rest(compact) != 1:
        return None
    body = _like_characters(compact[4:], key, compact[:2].encode() + b"iban", undo)
    check = 98 - _iban_rest(compact[:2] + "00" + body)
    source = iter(f"{compact[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(source) for c in value)


def _is_card(value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(value: str, key: bytes, undo: bool) -> str | None:
    if not _is_card(value):
        return None
    digits = re.sub("[^0-9]", "", value)
    middle = digits[1:-1]
    new = feistel(int(middle), 10 ** len(middle), key, b"card" + bytes([len(digits)]), undo=undo)
    payload = digits[0] + str(new).zfill(len(middle))
    return _put_digits(value, payload + luhn_digit(payload))


def _ssn(value: str, key: bytes, undo: bool) -> str | None:
    area, group, serial = (int(x) for x in value.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    a, g, s = _mixed([(area - 1 - (area > 666), 898), (group - 1, 99), (serial - 1, 9999)], key, b"ssn", undo)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{s + 1:04d}"


def _date(value: str, key: bytes, undo: bool) -> str | None:
    mark = next(c for c in value if not c.isdigit())
    parts = value.split(mark)
    a, b, c = (int(p) for p in parts)
    order = "ymd" if len(parts[0]) == 4 else "dmy" if a > 12 or mark == "." else "mdy"
    named = dict(zip(order, (a, b, c), strict=True))
    try:
        day = datetime.date(named["y"], named["m"], named["d"]).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    padded = all(len(p) == 2 or len(p) == 4 for p in parts)
    number = day - _FIRST_DAY
    while True:
        number = feistel(number, _LAST_DAY - _FIRST_DAY + 1, key, b"date", undo=undo)
        new = datetime.date.fromordinal(number + _FIRST_DAY)
        fields = {"y": new.year, "m": new.month, "d": new.day}
        written = [str(fields[o]) if o == "y" else f"{fields[o]:02d}" if padded else str(fields[o]) for o in order]
        # the result must be read in the same order of fields, and written with the same padding
        same_order = order != "dmy" or mark == "." or new.day > 12
        same_padding = padded or any(len(w) == 1 for w in written)
        if same_order and same_padding:
            return mark.join(written)


def _ip(value: str, key: bytes, undo: bool) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or (o[0] == "0" and o != "0") for o in octets):
        return None
    new = feistel(int.from_bytes(bytes(int(o) for o in octets), "big"), 1 << 32, key, b"ip", undo=undo)
    return ".".join(map(str, new.to_bytes(4, "big")))


def _phone(value: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub("[^0-9]", "", value)
    if not 7 <= len(digits) <= 15 or len(digits) < 9 and not value.startswith(("+", "(")):
        return None
    local = digits
    if value.startswith("+"):
        code = re.match(r"\+([0-9]{1,3})[ .(-]", value)
        local = digits[len(code[1]) :] if code else digits[1:]
    head = digits[: len(digits) - len(local)]
    def planned(number: str) -> bool:
        return head in ("", "1") and len(number) == 10 and number[0] >= "2" and number[3] >= "2"

    if planned(local):
        parts = [(int(c) - 2, 8) if i in (0, 3) else (int(c), 10) for i, c in enumerate(local)]
        new = "".join(str(d + 2) if i in (0, 3) else str(d) for i, d in enumerate(_mixed(parts, key, b"plan", undo)))
    else:
        new = local
        while new is local or planned(new):  # stays outside the number plan, so the map is one to one
            new = "".join(map(str, _mixed([(int(c), 10) for c in new], key, b"phone", undo)))
    return _put_digits(value, head + new)


_PERMUTE: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone}


def _iban_cuts(run: str) -> Iterator[tuple[int, int]]:
    """Ends of an IBAN that starts the run: by its country's length, else at spaces, longest first."""
    ends = [i for i in range(15, len(run) + 1) if i == len(run) or run[i] == " "]
    length = IBAN_LENGTHS.get(run[:2])
    first = [e for e in ends if e - run.count(" ", 0, e) == length]
    yield from ((0, e) for e in first + [e for e in reversed(ends) if e not in first and 15 <= e - run.count(" ", 0, e) <= 34])


def _card_cuts(run: str) -> Iterator[tuple[int, int]]:
    """Parts of a run of digit groups that may be cards: one long group, the usual groupings, then groups of four or more."""
    groups = [m.span() for m in re.finditer("[0-9]+", run)]
    sizes = [e - s for s, e in groups]
    shapes = [(i, i + 1) for i, n in enumerate(sizes) if 13 <= n <= 19]
    shapes += [(i, i + len(u)) for u in ([4] * 4, [4, 6, 5], [4, 4, 4, 4, 3]) for i in range(len(sizes)) if sizes[i : i + len(u)] == u]
    shapes += [(i, j) for n in (5, 4, 3, 2) for i in range(len(sizes) - n + 1) for j in [i + n] if min(sizes[i:j]) >= 4 and 13 <= sum(sizes[i:j]) <= 19]
    yield from ((groups[i][0], groups[j - 1][1]) for i, j in dict.fromkeys(shapes))
    if 13 <= sum(sizes) <= 19:
        yield 0, len(run)


#: Kinds whose shape may take in neighbours: the longest run, the parts of it to try in turn, and the check of a part.
_RUNS: dict[str, tuple[re.Pattern[str], Callable[[str], Iterator[tuple[int, int]]], Callable[[str], bool]]] = {
    "iban": (re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"), _iban_cuts, lambda v: _iban_rest(v.replace(" ", "")) == 1),
    "card": (re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,}(?![\w-])"), _card_cuts, _is_card),
}


class _Cuts:
    """The parts of a run that may be values, those tried first in front, and which of them are valid now. Valid parts that
    overlap none tried before them are chosen. A change of a chosen part is judged by the parts that overlap it alone: the
    choice stays if all chosen are valid and every other valid one overlaps a chosen one that is tried before it."""

    def __init__(self, cuts: list[tuple[int, int]], valid: Callable[[int, int], bool]) -> None:
        self.cuts, self.valid = cuts, valid
        self.by_start = sorted((s, i) for i, (s, _) in enumerate(cuts))
        self.longest = max((e - s for s, e in cuts), default=0)
        self.chosen: list[tuple[int, int, int]] = []
        for i, (s, e) in enumerate(cuts):
            if valid(s, e) and not self._blocked(s, e, i):
                bisect.insort(self.chosen, (s, e, i))

    def _blocked(self, start: int, end: int, rank: int) -> bool:
        """Whether a chosen part tried before this one overlaps it."""
        at = bisect.bisect_left(self.chosen, (end,))
        while at and self.chosen[at - 1][1] > start:
            at -= 1
            if self.chosen[at][2] < rank:
                return True
        return False

    def stays(self, start: int, end: int, rank: int) -> bool:
        """Whether the choice is still the same after this chosen part has changed."""
        if not self.valid(start, end):
            return False
        first, last = (bisect.bisect_left(self.by_start, (at,)) for at in (start - self.longest + 1, end))
        for s, i in self.by_start[first:last]:
            e = self.cuts[i][1]
            if i != rank and e > start and self.valid(s, e) and not self._blocked(s, e, i):
                return False
        return True


class _Finds:
    """Ranges of a text that don't overlap, in order."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, str]] = []

    def free(self, start: int, end: int) -> bool:
        """Whether no range overlaps this one: the neighbours in order tell."""
        i = bisect.bisect_left(self.rows, (start,))
        return not (i and self.rows[i - 1][1] > start) and not (i < len(self.rows) and self.rows[i][0] < end)

    def add(self, row: tuple[int, int, str]) -> None:
        bisect.insort(self.rows, row)


def _run_finds(kind: str, text: str, found: _Finds, key: bytes, undo: bool) -> Iterator[tuple[int, int, str]]:
    pattern = _RUNS[kind][0]
    at = 0
    while m := pattern.search(text, at):
        run, base = m[0], m.start()
        # a match may end inside a word
        if kind == "iban" and text[m.end() : m.end() + 1].isalnum():
            run = run[: max(run.rfind(" "), 0)]

        _, cut, check = _RUNS[kind]
        letters, size = list(run), len(run)

        def admits(s: int, e: int, letters: list[str] = letters, size: int = size) -> bool:
            # a part of a run of digits begins like a card's number
            return (kind == "iban" or (s, e) == (0, size) or letters[s] in "23456") and check("".join(letters[s:e]))

        cuts = _Cuts([(s, e) for s, e in cut(run) if found.free(base + s, base + e)], admits)
        parts = cuts.chosen
        if not parts:
            # a failed IBAN may hide one that starts later in its run; a run of digits was searched whole
            at = base + 1 if kind == "iban" else m.end()
            continue
        # one part after the other, each walked until the run is read in the same way again, so that it can be undone in reverse
        for s, e, rank in reversed(parts) if undo else parts:
            while True:
                letters[s:e] = _PERMUTE[kind]("".join(letters[s:e]), key, undo)
                if cuts.stays(s, e, rank):
                    break
        yield from ((base + s, base + e, "".join(letters[s:e])) for s, e, _ in parts)
        at = base + parts[-1][1]


def pseudonyms(text: str, key: bytes, *, undo: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms for personal data, and how many of each kind."""
    counts = dict.fromkeys(KINDS, 0)
    if not _ANY.search(text):
        return text, counts
    found = _Finds()
    for kind, pattern in KINDS.items():
        if kind in _RUNS:
            more = list(_run_finds(kind, text, found, key, undo))
            for row in more:
                found.add(row)
            counts[kind] += len(more)
            continue
        for m in pattern.finditer(text):
            start, end = m.span("value") if kind == "secret" else m.span()
            if not found.free(start, end):
                continue
            new = _PERMUTE[kind](text[start:end], key, undo)
            if new is not None:
                found.add((start, end, new))
                counts[kind] += 1
    if not found.rows:
        return text, counts
    out, at = [], 0
    for start, end, new in found.rows:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), counts


def _replace(key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str | None] = []
            counts: list[dict[str, int]] = []
            for text in batch.column(0).to_pylist():
                new, n = (None, dict.fromkeys(KINDS, 0)) if text is None else pseudonyms(text, key)
                texts.append(new)
                counts.append(n)
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), *columns], names=[*batch.schema.names[1:], "__new", *(f"n_{k}" for k in KINDS)])

    return run


@shielded(text_col="text")
def pseudonymize(docs: DataFrame, key: bytes, *, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and n_<kind> for each kind."""
    own = {f"n_{k}" for k in KINDS}
    columns = [c for c in docs.columns if c.lower() not in own]
    carried = [c for c in columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("__new", T.StringType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS)])
    done = docs.select(text_col, *carried).mapInArrow(_replace(key), schema)
    return done.select(*(done["__new"].alias(c) if c == text_col else done[c] for c in columns), *(f"n_{k}" for k in KINDS))
