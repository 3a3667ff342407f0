"""Personal data replaced by keyed, type-consistent surrogates.

1. Detection gives the distinct entities (kind, canonical form) of the whole corpus, reduced before they are shuffled.
2. Addresses and numbers go through a keyed permutation of all strings of their format (a Feistel network over their
   letters and digits, walked along one secret cycle), so a first draw never gives two originals one surrogate, and none
   itself; kind, script, case, punctuation, length, country codes and checksums stay.  Names are built from syllables:
   a family name by itself, a given name by its family and the gender that titles say, so "Mr. John Smith", "Mr Smith"
   and "Smith" stay one person.
3. Collisions are looked for over the whole corpus: a surrogate that is itself an original, or one that two originals
   got (names, and later draws).  Losers are drawn again, and what can grow grows with each draw: a local part by two
   characters, a family name by a syllable, a given name by a second one.  A number has to keep its format; where a
   format's originals are so dense that no free number is found in LAST draws, all of that format keep their first draw:
   a permutation, so distinct and never themselves, though one may be another's original.  So the search always ends.
   Only the exceptions have to be told to the rewriting tasks, everything else follows from the key.
"""

from __future__ import annotations

import hashlib
import os
import re
import secrets
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import drop_table, pieces, texts, write_table

#: Titles that say the gender of the name behind them.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"], "u": ["Dr", "Prof"]}
#: Surrogate names by script and gender.
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"],
    ("latin", "f"): ["Alma", "Berta", "Clara", "Diana", "Elsa", "Flora", "Greta", "Helena", "Irene", "Julia", "Katja", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "u"): ["Alex", "Billie", "Charlie", "Dana", "Eden", "Frankie", "Gale", "Jamie", "Kim", "Lee", "Morgan", "Noel", "Quinn", "Robin", "Sam", "Toni"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Ирина", "Ксения"],
    ("cyrillic", "u"): ["Саша", "Женя", "Валя", "Шура"],
    ("greek", "m"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
    ("greek", "f"): ["Άννα", "Βασιλική", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία"],
    ("greek", "u"): ["Φώτη", "Χάρη"],
}
#: Beginnings, vowels and ends of the syllables that family names are built from, by script.
SYLLABLES = {"latin": ("bdfghklmnprstvwz", "aeiou", "lmnrst"), "cyrillic": ("бвгдзклмнпрст", "аеиоу", "лмнрст"), "greek": ("βγδζκλμνπρστ", "αεηιου", "λμνρς")}
#: Letters that a letter of an address may become, by script.
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Draws after the first; what grows has more than 64 bits of the key's digest by then and is not looked at again.
LAST = 12
ROUNDS = 8
#: Where a session or the environment names the key of the registered query and the pipeline.
KEY_CONF, KEY_ENV = "spark.siltstone.pii.key", "SILTSTONE_PII_KEY"


def _upper_class() -> str:
    """All upper-case letters as a character class; ``re`` has none."""
    spans: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if chr(code).isupper():
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"


_UPPER = _upper_class()
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_TITLE = "|".join(sorted(_GENDER, key=len, reverse=True))
#: North American numbers, other international ones in any grouping, area codes with two groups, and national numbers in
#: pairs or behind a trunk zero.
_PHONES = [
    r"(?<![\w+])\+1(?:[ .()/-]{0,2}\d){10}(?!\w)",
    r"(?<![\w+])\+[1-9](?:[ .()/-]{0,2}\d){7,14}(?!\w)",
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d-])",
    r"(?<![\w+])(?<!\d[ .-])(?:0[1-9](?:[ .-]\d{2}){4}|[6-9]\d{2}(?:[ .-]\d{2}){3}|[89]\d[ .-]\d{3}(?:[ .-]\d{2}){2}|0[1-9]\d{0,3}[ /-]\d{5,9})(?!\w)(?![ .-]\d)",
]
#: Country codes by their first digits.
_COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")
#: In order of precedence: where two overlap, the one that starts first stays, of equal starts the earlier kind.
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "card": re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)(?!\.\d)"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    "phone": re.compile("|".join(_PHONES)),
    "name": re.compile(rf"(?<!\w)(?:{_TITLE})\.?\x20(?:{_UPPER}[^\W\d_]+(?:[-'][^\W\d_]+)*)(?:\x20{_UPPER}[^\W\d_]+)?"),
}
#: Kinds whose surrogates keep their format for good.
FIXED = ("ssn", "card", "ip", "phone")
_WORD = re.compile(rf"(?<!\w){_UPPER}[^\W\d_]+(?:[-'][^\W\d_]+)*(?!\w)")
_DIGIT = re.compile(rb"[0-9]")
_TITLE_BYTES = re.compile("|".join(rf"{t}\.?\x20" for t in sorted(_GENDER, key=len, reverse=True)).encode())


# --- what is there


def detect(text: str | None, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) in code points, by start; an untitled mention of a name that has its title
    elsewhere in the text is of kind ``mention``."""
    if not text:
        return []
    raw = text.encode() if raw is None else raw
    kinds = []
    if b"@" in raw:
        kinds.append("email")
    if _DIGIT.search(raw):
        kinds += ["ssn", "card", "ip", "phone"]
    if _TITLE_BYTES.search(raw):
        kinds.append("name")
    found = [(m.start(), order, m.end(), kind) for order, kind in enumerate(kinds) for m in PATTERNS[kind].finditer(text)]
    out, end = [], 0
    for start, _, stop, kind in sorted(found):
        if start >= end:
            out.append((start, stop, kind))
            end = stop
    people = People(text, out)
    return sorted([*out, *_mentions(text, out, people.known)]) if people.known else out


def name_parts(original: str) -> tuple[str, str | None, str, str]:
    """Title with its dot, given name (None: there is none), family name, and the ``'s`` behind it."""
    title, *names = original.split(" ")
    family = names[-1].removesuffix("'s")
    return title, names[0] if len(names) > 1 else None, family, names[-1][len(family) :]


class People:
    """The titled names of one text: ``known`` untitled forms, and the gender that any title says of a full name."""

    def __init__(self, text: str, found: list[tuple[int, int, str]]):
        self.known: set[str] = set()
        self.genders: dict[tuple[str, str], str] = {}
        for start, end, kind in found:
            if kind == "name":
                title, given, family, _ = name_parts(text[start:end])
                self.known.add(family)
                if given:
                    self.known.add(f"{given} {family}")
                    said, key = _GENDER[title.rstrip(".")], (given.lower(), family.lower())
                    if self.genders.get(key, "u") == "u":
                        self.genders[key] = said

    def entity(self, given: str, family: str) -> str:
        """The canonical form of a full name."""
        return f"{self.genders.get((given.lower(), family.lower()), 'u')}:{given.lower()} {family.lower()}"


def _mentions(text: str, found: list[tuple[int, int, str]], known: set[str]) -> Iterator[tuple[int, int, str]]:
    starts = [start for start, _, _ in found]
    words = [m.span() for m in _WORD.finditer(text)]
    k = 0
    while k < len(words):
        start, step = words[k][0], 1
        for n in (2, 1):
            if k + n > len(words) or (n == 2 and text[words[k][1] : words[k + 1][0]] != " "):
                continue
            said = text[start : words[k + n - 1][1]].removesuffix("'s")
            stop, at = start + len(said), bisect_right(starts, start)
            if said in known and (at == 0 or found[at - 1][1] <= start) and (at == len(found) or found[at][0] >= stop):
                yield start, stop, "mention"
                step = n
                break
        k += step


def canonical(kind: str, original: str) -> str:
    """What makes two mentions the same entity: case for addresses and names, punctuation for numbers."""
    if kind in ("email", "family"):
        return original.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in original.split("."))
    digits = "".join(str(int(c)) for c in original if c.isdecimal())
    return f"+{digits}" if kind == "phone" and original.startswith("+") else digits


def entities(text: str, found: list[tuple[int, int, str]]) -> set[tuple[str, str]]:
    """(kind, canonical form) of all that is found; a name is its family, and a full name under ``name``."""
    out, people = set(), People(text, found)
    for start, end, kind in found:
        if kind == "name":
            _, given, family, _ = name_parts(text[start:end])
            out.add(("family", family.lower()))
            if given:
                out.add(("name", people.entity(given, family)))
        elif kind != "mention":  # its titled name is there too
            out.add((kind, canonical(kind, text[start:end])))
    return out


# --- keyed drawing


def _stream(key: bytes, data: str, n: int) -> list[int]:
    """``n`` 32-bit numbers that follow from the key and ``data``."""
    out, block = b"", 0
    while len(out) < 4 * n:
        out += hashlib.blake2b(f"{block}:{data}".encode(), key=key).digest()
        block += 1
    return [int.from_bytes(out[4 * k : 4 * k + 4], "big") for k in range(n)]


def _key(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def _feistel(key: bytes, tag: str, values: list[int], radix: list[int], back: bool) -> list[int]:
    halves, sizes = [values[0::2], values[1::2]], [radix[0::2], radix[1::2]]
    for t in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        one, other = t % 2, 1 - t % 2
        pad = _stream(key, f"{tag}:{t}:{halves[other]}", len(halves[one]))
        halves[one] = [(v - p if back else v + p) % r for v, p, r in zip(halves[one], pad, sizes[one], strict=True)]
    out = [0] * len(values)
    out[0::2], out[1::2] = halves
    return out


def _next(key: bytes, tag: str, values: list[int], radix: list[int]) -> list[int]:
    """The list of values behind this one on a secret cycle through all lists with these radixes."""
    at = _feistel(key, tag, values, radix, False)
    for k in range(len(at) - 1, -1, -1):
        at[k] = (at[k] + 1) % radix[k]
        if at[k]:
            break
    return _feistel(key, tag, at, radix, True)


@cache
def _letters(char: str) -> str:
    """The letters that a lower-case letter may become, itself among them: its alphabet, or its neighbours of one kind."""
    for alphabet in ALPHABETS.values():
        if char in alphabet:
            return alphabet
    cased = char.lower() != char.upper()
    alike = lambda c: c.isalpha() and c.lower() == c and (len(c.upper()) == 1 and c.upper().lower() == c and c.upper() != c if cased else c.upper() == c)
    block = [c for c in map(chr, range(ord(char) & ~63, (ord(char) & ~63) + 64)) if alike(c)]
    return "".join(block) if char in block else char


def _spell(key: bytes, tag: str, text: str) -> str:
    """``text`` (lower case) with letters and digits permuted in their alphabets; all else stands."""
    sets = ["0123456789" if c.isdecimal() else _letters(c) if c.isalpha() else c for c in text]
    text = "".join(str(int(c)) if c.isdecimal() else c for c in text)
    moved = [k for k, s in enumerate(sets) if len(s) > 1]
    if not moved:
        return text
    shape = "".join(s[0] if len(s) > 1 else s for s in sets)
    new = _next(key, f"{tag}:{shape}", [sets[k].index(text[k]) for k in moved], [len(sets[k]) for k in moved])
    out = list(text)
    for k, v in zip(moved, new, strict=True):
        out[k] = sets[k][v]
    return "".join(out)


def _walk(key: bytes, tag: str, values: list[int], radix: list[int], keeps: Callable[[list[int]], bool]) -> list[int]:
    """The next list on the cycle of which ``keeps`` says what it says of ``values``; a permutation of each side."""
    side = keeps(values)
    new = _next(key, tag, values, radix)
    while keeps(new) != side:
        new = _next(key, tag, new, radix)
    return new


def script_of(char: str) -> str:
    code = ord(char.lower())
    return "cyrillic" if 0x400 <= code < 0x530 else "greek" if 0x370 <= code < 0x400 else "latin"


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def _valid_ssn(v: list[int]) -> bool:
    area = 100 * v[0] + 10 * v[1] + v[2]
    return 0 < area < 900 and area != 666 and (v[3] or v[4]) and any(v[5:])


def shape(kind: str, same: str) -> str:
    """The format of a number: what its permutation keeps."""
    if kind == "card":
        return f"{len(same)}:{same[0]}:{_luhn(same) == 0}"
    if kind == "ssn":
        return str(bool(_valid_ssn([int(c) for c in same])))
    if kind == "ip":
        return str(all(0 < int(x) < 255 for x in same.split(".")))
    if kind == "phone":
        code, rest = _phone_parts(same)
        return f"{code}:{len(rest)}:{rest[:1] == '0'}"
    return ""


def _phone_parts(same: str) -> tuple[str, str]:
    """What stays (plus sign, country code, trunk zero) and the digits behind it."""
    digits = same.removeprefix("+")
    code = len(_COUNTRY.match(digits)[0]) if same.startswith("+") else int(digits[:1] == "0")
    return same[: len(same) - len(digits) + code], digits[code:]


def _number(key: bytes, kind: str, same: str, tag: str) -> str:
    """The surrogate of a number's canonical form."""
    tag = f"{tag}:{shape(kind, same)}"
    if kind == "ip":
        parts = [int(x) for x in same.split(".")]
        if all(0 < x < 255 for x in parts):
            return ".".join(str(x + 1) for x in _next(key, tag, [x - 1 for x in parts], [254] * 4))
        return ".".join(map(str, _walk(key, tag, parts, [256] * 4, lambda v: all(0 < x < 255 for x in v))))
    digits = [int(c) for c in same if c != "+"]
    text = lambda v: "".join(map(str, v))
    if kind == "ssn":
        return text(_walk(key, tag, digits, [10] * 9, lambda v: bool(_valid_ssn(v))))
    if kind == "card":
        first = same[0]
        if _luhn(same) == 0:  # a valid number stays one
            new = first + text(_next(key, tag, digits[1:-1], [10] * (len(digits) - 2)))
            return new + str((10 - _luhn(new + "0")) % 10)
        return first + text(_walk(key, tag, digits[1:], [10] * (len(digits) - 1), lambda v: _luhn(first + text(v)) == 0))
    code, rest = _phone_parts(same)
    if not rest:
        return same
    zero = rest[0] == "0"  # a leading zero stays, other first digits stay others
    values, radix = [int(c) for c in rest], [10] * len(rest)
    values, radix = (values[1:], radix[1:]) if zero else ([values[0] - 1, *values[1:]], [9, *radix[1:]])
    new = _next(key, tag, values, radix) if values else []
    return code + ("0" + text(new) if zero else str(new[0] + 1) + text(new[1:]))


def _cased(new: str, like: str) -> str:
    return new.upper() if len(like) > 1 and like.isupper() else new.capitalize() if like[:1].isupper() else new


def surrogate(key: bytes, kind: str, same: str, attempt: int = 0) -> str:
    """The canonical surrogate of an entity at its ``attempt``."""
    key, tag = _key(key), f"{kind}:{attempt}"
    if kind == "email":
        local, _, domain = same.partition("@")
        *labels, top = domain.split(".")
        last = next((c for c in reversed(local) if c.isalnum()), "a")
        tail = "0123456789" if last.isdecimal() else _letters(last) if len(_letters(last)) > 1 else ALPHABETS["latin"]
        grown = "".join(tail[x % len(tail)] for x in _stream(key, f"{tag}:{same}", 2 * attempt))
        # One site for all addresses of a domain.
        return f"{_spell(key, tag, local)}{grown}@{'.'.join([_spell(key, 'domain', '.'.join(labels)), top])}"
    if kind == "family":
        out = []
        for k, part in enumerate(re.split(r"([-'])", same)):
            if k % 2 or not part:
                out.append(part)
                continue
            sets = SYLLABLES[script_of(part[0])]
            numbers = _stream(key, f"{tag}:{k}:{same}", 3 * (2 + (attempt if k == 0 else 0)))
            out.append("".join(sets[j % 3][x % len(sets[j % 3])] for j, x in enumerate(numbers)))
        return "".join(out)
    if kind == "name":
        gender, _, full = same.partition(":")
        given, _, family = full.partition(" ")
        pool = [x for x in GIVEN[script_of(given[0]), gender] if x.lower() != given]
        return "-".join(pool[x % len(pool)] for x in _stream(key, f"{tag}:{same}", 1 + attempt)) + "|" + family
    return _number(key, kind, same, tag)


def written(kind: str, original: str, new: str) -> str:
    """A canonical surrogate in the spelling of one mention: its case or its punctuation."""
    if kind == "email":
        local, _, rest = new.partition("@")
        said = original.partition("@")[0]
        return "".join(b.upper() if k < len(said) and said[k].isupper() else b for k, b in enumerate(local)) + "@" + rest if len(said) <= len(local) else new
    if kind == "family":
        parts, like = re.split(r"([-'])", new), re.split(r"([-'])", original)
        return "".join(p if k % 2 else _cased(p, like[k] if k < len(like) else "") for k, p in enumerate(parts))
    if kind == "ip":
        return new
    left = iter(new.removeprefix("+"))
    return "".join(next(left) if c.isdecimal() else c for c in original)


# --- over the corpus

#: Given the key, kind, canonical form and attempt: the canonical surrogate.
Drawer = Callable[[bytes, str, str, int], str]


def _entities(docs: DataFrame) -> DataFrame:
    """(kind, same): the distinct entities of all texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            seen: set[tuple[str, str]] = set()
            for raw in texts(batch):
                text = raw.decode() if raw else ""
                seen |= entities(text, detect(text, raw))
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in seen], "same": [s for _, s in seen]}, schema=pa.schema([("kind", pa.string()), ("same", pa.string())]))

    return docs.select("text").mapInArrow(run, "kind string, same string").distinct()


def _drawn(found: DataFrame, key: bytes, draw: Drawer) -> DataFrame:
    """Adds ``new``, the canonical surrogate at each entity's attempt, and the ``shape`` of numbers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            kind, same, attempt = (batch.column(c).to_pylist() for c in ("kind", "same", "attempt"))
            new = [draw(key, k, s, a) for k, s, a in zip(kind, same, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "same", "attempt")), pa.array([shape(k, s) for k, s in zip(kind, same, strict=True)], pa.string()), pa.array(new, pa.string())], names=["kind", "same", "attempt", "shape", "new"])

    return found.select("kind", "same", "attempt").mapInArrow(run, "kind string, same string, attempt int, shape string, new string")


def attempts(docs: DataFrame, key: bytes, draw: Drawer = surrogate, last: int = LAST) -> DataFrame:
    """(kind, same, attempt) of the entities that need another draw than the first, over the whole corpus."""
    current = write_table(_drawn(_entities(docs).withColumn("attempt", F.lit(0)), key, draw), "entities")
    for k in range(last + 1):
        taken = current.groupBy("kind", "new").agg(F.min(F.struct("attempt", "same")).alias("owner"), F.count("*").alias("n"))
        shared = current.join(taken.where("n > 1"), ["kind", "new"]).where("same <> owner.same").select("kind", "same", "shape")
        originals = current.select("kind", F.col("same").alias("new"))
        aliased = current.join(originals, ["kind", "new"], "left_semi").select("kind", "same", "shape")
        again = write_table(shared.union(aliased).distinct(), "collisions")
        if again.isEmpty():
            break
        if k < last:
            turn = F.when(F.col("again"), F.lit(1)).otherwise(F.lit(0))
            step = current.join(again.select("kind", "same", F.lit(True).alias("again")), ["kind", "same"], "left").withColumn("attempt", F.col("attempt") + turn)
        else:  # what grows is distinct by now; numbers of a full format keep their permutation
            full = again.where(F.col("kind").isin(*FIXED)).select("kind", "shape", F.lit(True).alias("full")).distinct()
            step = current.join(full, ["kind", "shape"], "left").withColumn("attempt", F.when(F.col("full"), F.lit(0)).otherwise(F.col("attempt")))
        before, current = current, write_table(_drawn(step, key, draw), "entities")
        drop_table(before), drop_table(again)
    return current.where("attempt > 0").select("kind", "same", "attempt")


class Rewriter:
    """Texts with surrogates in place of what was found; ``again``: attempts by (kind, canonical form)."""

    def __init__(self, key: bytes, draw: Drawer = surrogate):
        self.key, self.draw, self.memo = key, draw, {}

    def new(self, kind: str, same: str, again: dict[tuple[str, str], int]) -> str:
        at = kind, same, again.get((kind, same), 0)
        if at not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[at] = self.draw(self.key, *at)
        return self.memo[at]

    def rewrite(self, text: str, found: list[tuple[int, int, str]], again: dict[tuple[str, str], int]) -> str:
        out, at, people = [], 0, People(text, found)
        for start, end, kind in found:
            original = text[start:end]
            if kind in ("name", "mention"):
                title, given, family, tail = name_parts(original if kind == "name" else f"- {original}")
                said = [title] if kind == "name" else []
                if given:
                    said.append(self.new("name", people.entity(given, family), again).partition("|")[0])
                new = " ".join([*said, written("family", family, self.new("family", family.lower(), again))]) + tail
            else:
                new = written(kind, original, self.new(kind, canonical(kind, original), again))
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]])


def pseudonymise(docs: DataFrame, key: bytes, max_broadcast: int = 200_000, report: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns and rows stay, null and empty texts as they are.

    ``key``: whoever has it can link surrogates to originals, so it belongs in no source.  ``report`` adds __n_entities
    (long) and __spans ("kind:start:end" of the original, code points, comma-joined).  The exceptions of the collision
    check are broadcast if there are at most ``max_broadcast``, else joined to the texts that have them; repeated rows
    and texts get the same replacements; texts of any length are read whole; an empty table gives no rows; other columns
    pass through under any name but those two.  No input makes the search for surrogates fail."""
    if not key:
        raise ValueError("surrogates need a key")
    exceptions = attempts(docs, key)
    few = exceptions.limit(max_broadcast + 1).count() <= max_broadcast
    again = {(r["kind"], r["same"]): r["attempt"] for r in exceptions.toLocalIterator()} if few else {}
    shared = docs.sparkSession.sparkContext.broadcast(again)
    source = docs if few else _with_attempts(docs, exceptions)
    fields = [*docs.schema.fields, *([T.StructField("__n_entities", T.LongType()), T.StructField("__spans", T.StringType())] if report else [])]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        writer = Rewriter(key)
        for batch in pieces(batches):
            new, counts, spans = [], [], []
            own = batch.column("__again").to_pylist() if "__again" in batch.schema.names else None
            for k, raw in enumerate(texts(batch)):
                text = None if raw is None else raw.decode()
                found = detect(text, raw)
                known = shared.value if own is None else {(x["kind"], x["same"]): x["attempt"] for x in own[k] or []}
                new.append(writer.rewrite(text, found, known) if found else text)
                counts.append(len(found))
                spans.append(",".join(f"{'name' if kind == 'mention' else kind}:{a}:{b}" for a, b, kind in found))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "__again"} | {"text": pa.array(new, pa.string())}
            if report:
                columns |= {"__n_entities": pa.array(counts, pa.int64()), "__spans": pa.array(spans, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return source.mapInArrow(run, T.StructType(fields))


def _with_attempts(docs: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Each row with the exceptions of its own entities; texts are keyed by their SHA-256, so repeated ones share a key."""
    keyed = docs.withColumn("__key", F.sha2(F.coalesce("text", F.lit("")), 256))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            rows = {"__key": [], "kind": [], "same": []}
            for key, raw in zip(batch.column("__key").to_pylist(), texts(batch), strict=True):
                text = raw.decode() if raw else ""
                for kind, same in sorted(entities(text, detect(text, raw))):
                    rows["__key"].append(key), rows["kind"].append(kind), rows["same"].append(same)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(n, pa.string()) for n in rows]))

    met = keyed.select("__key", "text").mapInArrow(run, "__key string, kind string, same string").distinct().join(exceptions, ["kind", "same"])
    own = met.groupBy("__key").agg(F.collect_list(F.struct("kind", "same", "attempt")).alias("__again"))
    return keyed.join(own, "__key", "left").drop("__key")


def key_of(spark: SparkSession) -> bytes:
    """The key that the session's or the environment's setting names; without one, a fresh key for this run alone."""
    named = spark.conf.get(KEY_CONF, None) or os.environ.get(KEY_ENV)
    return named.encode() if named else secrets.token_bytes(32)


def op6_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, the new text, n_entities and spans of every document; see :func:`pseudonymise`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key_of(spark), report=True).select("doc_id", "text", F.col("__n_entities").alias("n_entities"), F.col("__spans").alias("spans"))
