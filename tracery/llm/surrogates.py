"""PII: each detected entity gets a keyed surrogate of its own type, format, script and gender.

A surrogate is a keyed permutation of the entity's format: the entity's characters, each within its own
alphabet (digits, vowels, consonants, hexadecimal digits, ...), are one number of a mixed radix, and a
Feistel network permutes those numbers. So one entity has one surrogate everywhere, however it is spaced
or capitalised, and two entities never share one. A shift inside the permutation leaves no entity as it
was. A check over the corpus re-keys those whose surrogate is another real entity, until none is left.
Names are entities word by word. A listed given name after a title stands for another listed one of its
gender; other given names become double ones of the title's gender and surnames double surnames, where they
are in Latin letters; names in other scripts keep their script.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import run_arrow, stored

# Honorifics and given names by gender, in natural order.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "M", "Señor", "Sr"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"]
OPEN_TITLES = ["Dr", "Prof"]
MALE_NAMES = ["Adam", "Alexander", "Andrew", "Anthony", "Antonio", "Benjamin", "Carlos", "Charles", "Christian", "Daniel", "David", "Edward", "Felix", "Francisco", "Frank", "George", "Hans", "Henri", "Jack", "Jacques", "James", "Jean", "John", "José", "Juan", "Jürgen", "Klaus", "Louis", "Luis", "Manuel", "Mark", "Martin", "Michael", "Miguel", "Nicolas", "Oliver", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "Tim", "William", "Wolfgang"]
FEMALE_NAMES = ["Alice", "Amanda", "Ana", "Andrea", "Angela", "Anna", "Barbara", "Carla", "Carmen", "Catherine", "Charlotte", "Christine", "Claire", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Françoise", "Greta", "Heidi", "Helena", "Isabel", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda", "Lisa", "Lucía", "Margaret", "Maria", "Marie", "Mary", "Monika", "Nathalie", "Nicole", "Olivia", "Patricia", "Pilar", "Sabine", "Sarah", "Sofia", "Sophie", "Susan", "Ursula"]
SURNAMES = ["Alonso", "Andersen", "Bauer", "Becker", "Bennett", "Bernard", "Blanc", "Bonnet", "Braun", "Carter", "Castro", "Clarke", "Cooper", "Cruz", "Delgado", "Dubois", "Durand", "Evans", "Faure", "Ferrari", "Fischer", "Fontaine", "Fuchs", "Garnier", "Girard", "Gomez", "Gray", "Hansen", "Harris", "Hartmann", "Herrera", "Hoffmann", "Hughes", "Jensen", "Keller", "Klein", "Kowalski", "Lambert", "Lange", "Larsen", "Leroy", "Lopez", "Marchand", "Mason", "Mercier", "Molina", "Moreau", "Morgan", "Neumann", "Nielsen", "Novak", "Ortega", "Parker", "Perrin", "Ramos", "Reyes", "Richter", "Romano", "Rossi", "Schmitt", "Schulz", "Turner", "Vogel", "Wagner"]
LISTS = {"name": SURNAMES, "male": MALE_NAMES, "female": FEMALE_NAMES, "given": [*MALE_NAMES, *FEMALE_NAMES]}
# Alphabets whose characters are exchanged among themselves.
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöùúûü", "çñýÿß", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"]
HEX = "0123456789abcdef"

_TITLE = "|".join(sorted({*MALE_TITLES, *FEMALE_TITLES, *OPEN_TITLES}, key=len, reverse=True))
_NAME = r"[^\W\d_a-z](?:[^\W\d_]|(?!['’]s(?!\w))['’-](?=[^\W\d_]))+"
KINDS: dict[str, str] = {
    "email": r"(?<![\w.+-])[\w.+-]*\w@(?:\w(?:[\w-]*\w)?\.)+[^\W\d_]{2,24}(?!\w)",
    "secret": r"(?<![A-Za-z0-9])(?:(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "assigned": r"(?<=[\"'])(?<=[=:]\s[\"']|.[=:][\"'])[A-Za-z0-9+/_=-]{16,}(?=[\"'])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w]|-\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.+-])0\d{2,4}[ -]\d{3,4}[ -]?\d{3,4}(?![\w-])",
    "passport": r"(?<!\w)(?i:passport|reisepass|passeport|pasaporte)(?:\s+(?i:no|nr|number|nummer|numéro|número))?[.:]?\s+([A-Z]{0,2}\d{6,9}|[A-Z0-9]*\d[A-Z0-9]{7,8})(?!\w)",
    "name": rf"(?<!\w)(?:{_TITLE})\.?\s+{_NAME}(?:\s+{_NAME})?",
}
#: Kinds that need a digit, and what else a text must hold for a kind to be looked for.
NUMERIC = ("iban", "ipv4", "ipv6", "ssn", "card", "phone", "passport")
#: What stands before four numbers that are a version and no address, or before a number that is a card's whatever its last digit.
VERSION = re.compile(r"(?i)(?:\bv|\bver|version|release|build|revision)[ .:=]*\Z")
CARD = re.compile(r"(?i)\b(?:card|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta)\W+(?:\w+\W+){0,2}\Z")
MARKS: dict[str, list[str]] = {
    "email": ["@"], "secret": [*"0123456789", "sk-", "sk_", "pk-", "pk_", "ghp", "gho", "xox", "AKIA"], "assigned": ['="', "='", '= "', "= '", ':"', ":'", ': "', ": '"],
    "name": [t + end for t in (*MALE_TITLES, *FEMALE_TITLES, *OPEN_TITLES) for end in (" ", ".", "\n", "\t")],
}


#: Words among which the repeats of a name are looked for; a possessive's ending is none of its letters.
REPEAT = re.compile(rf"(?<!\w){_NAME}(?!\w)")
#: From this tweak on, and where no character can be exchanged, names and the local parts of emails become new syllables.
FREE = 6


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    return {k: re.compile(p) for k, p in KINDS.items()}


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a whole text, left to right; the kind listed first wins an overlap.

    A name that stands after a title is "untitled" wherever else it or one of its words stands, in the same
    letters or in capitals.
    """
    text = text or ""
    taken: list[tuple[int, int, str]] = []
    digits = any(d in text for d in "0123456789")
    for kind, pattern in _patterns().items():
        if not (digits if kind in NUMERIC else any(m in text for m in MARKS[kind])):
            continue
        starts, new = [a for a, _, _ in taken], []
        for m in pattern.finditer(text):
            a, b = m.span(1) if kind == "passport" else m.span()
            k = bisect_left(starts, b)  # what is taken does not overlap, so one neighbour tells
            if not (k and taken[k - 1][1] > a) and _real(kind, text, a, b):
                new.append((a, b, kind))
        taken = sorted(taken + new) if new else taken
    names = [text[a:b].split()[1:] for a, b, kind in taken if kind == "name"]
    return sorted(taken + _repeats(text, names, taken)) if names else taken


def _real(kind: str, text: str, a: int, b: int) -> bool:
    """Whether what looks like an entity is one: cards have a check digit or are called so, versions are no addresses."""
    if kind == "card":
        return luhn(canonical(kind, text[a:b])) or bool(CARD.search(text, max(0, a - 40), a))
    if kind == "ipv4":
        return not VERSION.search(text, max(0, a - 12), a)
    return True


def _repeats(text: str, names: list[list[str]], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Where names and their words stand outside what is taken."""
    forms = [f for ws in names for f in (ws, [w.upper() for w in ws])]
    whole, single = {tuple(ws) for ws in forms}, {w for ws in forms for w in ws}
    starts = [a for a, _, _ in taken]
    out: list[tuple[int, int, str]] = []
    words: list[str] = []  # of the last one in out
    for m in REPEAT.finditer(text):
        k = bisect_left(starts, m.end())
        if m[0] not in single or k and taken[k - 1][1] > m.start():
            continue
        if out and len(words) == 1 and (words[0], m[0]) in whole and text[out[-1][1] : m.start()].isspace():
            out[-1] = (out[-1][0], m.end(), "untitled")
            words.append(m[0])
        else:
            out.append((m.start(), m.end(), "untitled"))
            words = [m[0]]
    return out


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    twice = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in twice) % 10 == 0


class Permutation:
    """Keyed permutation of strings that keeps each character in its alphabet, without a fixed point."""

    def __init__(self, key: bytes, tweak: str):
        self.key = hashlib.blake2b(tweak.encode(), key=key, digest_size=32).digest()

    def _prf(self, size: int, *parts: object) -> int:
        seed = repr(parts).encode()
        need = size.bit_length() // 8 + 9
        out = b"".join(hashlib.blake2b(seed + bytes([k & 255, k >> 8]), key=self.key).digest() for k in range(-(-need // 64)))
        return int.from_bytes(out[:need], "big") % size

    def number(self, x: int, radices: list[int]) -> int:
        """The image of x, a number of these radices."""
        size = 1
        for r in radices:
            size *= r
        if size < 2:
            return x
        left = 1
        for r in radices[: len(radices) // 2]:
            left *= r
        right = size // left
        shape = tuple(radices)
        shift = 1 + self._prf(size - 1, "shift", shape)
        if left < 2:
            return (x + shift) % size
        a, b = x // right, x % right
        for k in range(9, -1, -1):  # back, a step on, and forth again: no number maps to itself
            if k % 2:
                b = (b - self._prf(right, k, shape, a)) % right
            else:
                a = (a - self._prf(left, k, shape, b)) % left
        y = (a * right + b + shift) % size
        a, b = y // right, y % right
        for k in range(10):
            if k % 2:
                b = (b + self._prf(right, k, shape, a)) % right
            else:
                a = (a + self._prf(left, k, shape, b)) % left
        return a * right + b

    def text(self, s: str, alphabets: list[str] = ALPHABETS) -> str:
        """The image of s; characters of no alphabet stay."""
        home = {c: a for a in alphabets for c in a}
        at = [k for k, c in enumerate(s) if c in home]
        x, radices = 0, []
        for k in at:
            a = home[s[k]]
            radices.append(len(a))
            x = x * len(a) + a.index(s[k])
        y = self.number(x, radices)
        out = list(s)
        for k in reversed(at):
            a = home[s[k]]
            out[k] = a[y % len(a)]
            y //= len(a)
        return "".join(out)


def _refit(shape: str, letters: str) -> str:
    """letters in the capitals and spacing of shape: both have equally many letters and digits."""
    new = (c for c in letters if c.isalnum())
    out = []
    for c in shape:
        if c.isalnum():
            x = next(new, c)
            up = x.upper()
            out.append(up if c.isupper() and len(up) == 1 else x)
        else:
            out.append(c)
    return "".join(out)


def canonical(kind: str, text: str) -> str:
    """What mentions of one entity have in common: case, spacing and punctuation do not count where they vary."""
    if kind in ("card", "phone", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "iban":
        return text.replace(" ", "")
    if kind in ("secret", "assigned", "passport"):
        return text
    if kind == "name":
        return " ".join(unicodedata.normalize("NFC", w).casefold() if w.lower() != w.casefold() else unicodedata.normalize("NFC", w).lower() for w in text.split()[1:])
    return text.lower()


def _gender(title: str) -> str:
    title = title.rstrip(".")
    return "m" if title in MALE_TITLES else "f" if title in FEMALE_TITLES else ""


def _given(word: str, gender: str, p: Permutation) -> str | None:
    for own, names in (("m", MALE_NAMES), ("f", FEMALE_NAMES)):
        low = [n.lower() for n in names]
        if word in low and gender in ("", own):
            return low[p.number(low.index(word), [len(low)])]
    return None


def _invented(kind: str, entity: str, p: Permutation, parts: int) -> str:
    """A name of several listed ones, no two neighbours of them equal, picked by a keyed hash of the entity."""
    listed, at = LISTS[kind], []
    for k in range(parts):
        n = len(listed) - (k > 0)
        x = p._prf(n, "listed", k, entity)
        at.append(x + (k > 0 and x >= at[-1]))
    return "-".join(listed[k].lower() for k in at)


def _syllables(entity: str, p: Permutation, tweak: int) -> str:
    """Letters picked by a keyed hash of the whole entity, more of them at higher tweaks."""
    n = max(2, -(-len(entity) // 2), tweak - FREE + 2)
    return "".join(ALPHABETS[a][p._prf(len(ALPHABETS[a]), "syllable", k, a, entity)] for k in range(n) for a in (2, 1))


def surrogate(kind: str, entity: str, key: bytes, tweak: int = 0) -> str:
    """The surrogate of a canonical entity, canonical itself."""
    p = Permutation(key, f"{'digits' if kind in ('phone', 'ssn') else kind}/{tweak}")
    if kind == "card":
        if luhn(entity):
            body = p.text(entity[:-1])
            return body + next(d for d in "0123456789" if luhn(body + d))
        while True:  # a walk within the numbers without a check digit
            entity = p.text(entity)
            if not luhn(entity):
                return entity
    if kind == "ipv4":
        octets = [int(x) for x in entity.split(".")]
        x = p.number(int.from_bytes(bytes(octets), "big"), [256] * 4)
        return ".".join(str(b) for b in x.to_bytes(4, "big"))
    if kind == "ipv6":
        return p.text(entity, [HEX])
    if kind in LISTS:
        if all(ord(c) < 0x250 for c in entity) and tweak < 2 * FREE:
            return _invented(kind, entity, p, 2 if tweak < FREE else 3)
        new = p.text(entity)
        return _syllables(entity, p, tweak) if tweak >= FREE or new == entity else new
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        host, _, top = domain.rpartition(".")
        new = p.text(local)
        if tweak >= FREE or new == local:
            new = _syllables(local, p, tweak)
        return f"{new}@{Permutation(key, f'domain/{tweak}').text(host)}.{top}"
    if kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", entity):
        return p.text(entity, [HEX if entity == entity.lower() else HEX.upper()])
    if kind in ("secret", "assigned", "iban", "passport"):
        kept = {"iban": 2}.get(kind, 0) or next((len(x) for x in ("AKIA", "sk-", "pk-", "sk_", "pk_", "ghp_", "gho_") if entity.startswith(x)), 0)
        return entity[:kept] + p.text(entity[kept:], ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])
    if kind == "phone" and len(entity) > 10:  # the country's code stays
        return entity[:-10] + p.text(entity[-10:])
    return p.text(entity)


def _roles(mention: str, key: bytes) -> list[tuple[str, str, str | None]]:
    """(kind, canonical word, the listed name it becomes or None) of each word of a name after a title."""
    title, *words = mention.split()
    low, gender = [canonical("name", f"x {w}") for w in words], _gender(title)
    if len(low) == 1:
        return [("name", low[0], None)]
    first = _given(low[0], gender, Permutation(key, "name/0"))
    return [({"m": "male", "f": "female"}.get(gender, "given"), low[0], first), *(("name", w, None) for w in low[1:])]


def _images(mention: str, key: bytes, tweaks: dict[tuple[str, str], int]) -> tuple[tuple[str, ...], list[str]]:
    """The canonical words of a name after a title, and their surrogates."""
    roles = _roles(mention, key)
    return tuple(w for _, w, _ in roles), [given or surrogate(kind, w, key, tweaks.get((kind, w), 0)) for kind, w, given in roles]


def _renamed(words: list[str], images: list[str]) -> list[str]:
    """The surrogates in the capitals of the words they stand for."""
    out = []
    for w, new in zip(words, images, strict=True):
        if sum(map(str.isalnum, w)) == sum(map(str.isalnum, new)) and len(w) == len(new):
            out.append(_refit(w, new))
        else:
            out.append(new.upper() if w.isupper() else "-".join(x.capitalize() for x in new.split("-")))
    return out


def replaced(kind: str, text: str, key: bytes, tweak: int = 0) -> str:
    """A mention's replacement, in the mention's own format, for all kinds but names."""
    new = surrogate(kind, canonical(kind, text), key, tweak)
    if kind in ("card", "phone", "ssn", "iban"):
        return _refit(text, new)
    if kind in ("email", "ipv6") and text != text.lower():
        return _refit(text, new) if sum(map(str.isalnum, text)) == sum(map(str.isalnum, new)) else new
    return new


def rewrite(text: str | None, key: bytes, tweaks: dict[tuple[str, str], int] | None = None) -> tuple[str | None, int]:
    """(text with every entity replaced, number of entities)."""
    found = find(text)
    if not found:
        return text, 0
    tweaks = tweaks or {}
    whole: dict[tuple[str, ...], list[str]] = {}
    single: dict[str, str] = {}
    for a, b, kind in found:
        if kind == "name":
            words, images = _images(text[a:b], key, tweaks)
            whole.setdefault(words, images)
            for w, new in zip(words, images, strict=True):
                single.setdefault(w, new)
    out, at = [], 0
    for a, b, kind in found:
        mention = text[a:b]
        if kind in ("name", "untitled"):
            parts = re.split(r"(\s+)", mention)
            own = parts[0 if kind == "untitled" else 2 :: 2]
            if kind == "name":  # one person has one name in a document, whatever the title
                words, images = _images(mention, key, tweaks)
                images = whole.get(words, images)
            else:
                low = tuple(canonical("name", f"x {w}") for w in own)
                images = whole.get(low) or [single[w] for w in low]
            parts[0 if kind == "untitled" else 2 :: 2] = _renamed(own, images)
            new = "".join(parts)
        else:
            new = replaced(kind, mention, key, tweaks.get((kind, canonical(kind, mention)), 0))
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), len(found)


def _keyed(text: str | None, key: bytes) -> set[tuple[str, str]]:
    """(kind, entity) of what a text mentions and a keyed permutation replaces: names word by word, without listed ones."""
    out = set()
    for a, b, kind in find(text):
        if kind == "name":
            out |= {(role, w) for role, w, given in _roles(text[a:b], key) if given is None}
        elif kind != "untitled":
            out.add((kind, canonical(kind, text[a:b])))
    return out


def _entities(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = set().union(*(_keyed(t, key) for t in batch.column(0).to_pylist() if t))
        rows = [(kind, x, new) for kind, x in sorted(seen) if (new := surrogate(kind, x, key)) != x]  # no letter or digit to exchange: signs alone
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "entity", "surrogate"])


def _rekey(batches: Iterator[pa.RecordBatch], key: bytes, tweak: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, entity = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        new = [surrogate(k, x, key, tweak) for k, x in zip(kind, entity, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], ["kind", "entity", "surrogate"])


def collisions(texts: DataFrame, key: bytes, rounds: int = 64) -> DataFrame:
    """Entities that need another tweak (kind, entity, tweak): their surrogate is a real entity of the corpus or one of two.

    An entity once settled keeps its surrogate; the newer one is keyed anew, until none collides. Fails if
    some still do after all rounds.
    """
    spark = texts.sparkSession
    columns = "kind string, entity string, surrogate string"
    left, _ = stored(run_arrow(texts, _entities, columns, key=key).distinct(), "entities")
    listed = spark.createDataFrame([("name", canonical("name", f"x {n}")) for n in (*MALE_NAMES, *FEMALE_NAMES)], "kind string, surrogate string")
    taken = left.select("kind", F.col("entity").alias("surrogate")).union(listed)
    fixed = spark.createDataFrame([], "kind string, entity string, tweak int")
    for tweak in range(1, rounds + 1):
        firsts = left.groupBy("kind", "surrogate").agg(F.min("entity").alias("keeper"))
        bad = left.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "entity").union(
            left.join(firsts, ["kind", "surrogate"]).where("entity <> keeper").select("kind", "entity")
        ).distinct()
        bad, _ = stored(bad, "rekeyed")
        if not bad.limit(1).count():
            out, _ = stored(fixed, "tweaks")
            return out
        taken = taken.union(left.join(bad, ["kind", "entity"], "left_anti").select("kind", "surrogate"))
        left, _ = stored(run_arrow(bad, partial(_rekey, key=key, tweak=tweak), columns), "entities")
        fixed, _ = stored(fixed.join(bad, ["kind", "entity"], "left_anti").union(bad.withColumn("tweak", F.lit(tweak))), "tweaks")
    raise RuntimeError(f"{bad.count()} entities have no surrogate of their own after {rounds} rounds")


def _rewrite(batches: Iterator[pa.RecordBatch], key: bytes, tweaks: dict, last: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new, n = [], []
        for t in batch.column(batch.num_columns - 1).to_pylist():
            text, k = rewrite(t, key, tweaks)
            new.append(text)
            n.append(k)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.string()), pa.array(n, pa.int32())], [*batch.schema.names, "n_entities"])


def session_key(spark: SparkSession) -> bytes:
    """The session's secret (spark.tracery.surrogates.key), or else one of this call's own, which nobody can undo."""
    given = spark.conf.get("spark.tracery.surrogates.key", None)
    return given.encode() if given else secrets.token_bytes(32)


def surrogates(docs: DataFrame, key: bytes, text: str = "text", bound: int = 50_000) -> DataFrame:
    """docs with the entities of its text column replaced, and n_entities added at the end.

    key is a secret of at most 64 bytes: who has it can undo the surrogates. The work on a text grows with its
    length, however many entities it holds; where patterns tie for a place the kind listed first takes it.

    All other columns stay as they are, whatever their names but n_entities, which is replaced. A null text
    stays null with 0 entities, an empty one empty; repeated rows get the same replacement; no rows give no
    rows. The entities that collide go to the tasks when they are at most `bound`; else the text column is
    matched with the table of them by a join on the entities of each text.
    """
    own = docs.select(*[c for c in docs.columns if c not in (text, "n_entities")], F.col(text).cast("string").alias(text))
    tweaks = collisions(own.select(text), key)
    schema = T.StructType([*own.schema.fields, T.StructField("n_entities", T.IntegerType())])
    few = tweaks.limit(bound + 1).collect()
    if len(few) <= bound:
        return run_arrow(own, _rewrite, schema, key=key, tweaks={(r.kind, r.entity): r.tweak for r in few}, last=True)
    return _rewrite_joined(own, text, key, tweaks, schema)


def _mentions(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [sorted(f"{kind} {x}" for kind, x in _keyed(t, key)) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.string()))], [*batch.schema.names, "_mentions"])


def _rewrite_own(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new, n = [], []
        for t, own in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            tweaks = {tuple(x["m"].split(" ", 1)): x["tweak"] for x in own or [] if x["tweak"]}
            text, k = rewrite(t, key, tweaks)
            new.append(text)
            n.append(k)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(new, pa.string()), pa.array(n, pa.int32())], [*batch.schema.names[:-1], "n_entities"])


def _rewrite_joined(own: DataFrame, text: str, key: bytes, tweaks: DataFrame, schema: T.StructType) -> DataFrame:
    """As surrogates, with the colliding entities joined to the distinct texts that mention them."""
    found, _ = stored(run_arrow(own.select(text).distinct(), _mentions, T.StructType([T.StructField(text, T.StringType()), T.StructField("_mentions", T.ArrayType(T.StringType()))]), key=key), "mentions")
    known = tweaks.select(F.concat_ws(" ", "kind", "entity").alias("m"), "tweak")
    digest = F.sha2(F.col(text), 256)
    each = found.select(digest.alias("_text"), F.explode("_mentions").alias("m")).join(known, "m")
    by_text = each.groupBy("_text").agg(F.collect_list(F.struct("m", "tweak")).alias("_own"))
    joined = own.withColumn("_text", digest).join(by_text, "_text", "left").select(*own.columns, "_own")
    return run_arrow(joined, _rewrite_own, schema, key=key)
