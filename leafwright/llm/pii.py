"""Operator 7, PII: keyed surrogates that keep type, format, script and gender.

Each entity is replaced by the image of its characters under a keyed permutation of
all strings of its format: digits stay digits, letters stay letters of their script,
case and kind, punctuation stays. Every letter and decimal digit of Unicode is in a
class of two or more, so no value is its own surrogate. A permutation has no
collisions, so distinct entities stay distinct, and it depends on the key alone, so an
entity has the same surrogate in every text: coreference holds over the corpus without
a shuffle. ``checked`` confirms on the result that no two values share a surrogate. A
name is found by the title before it, and its words are then replaced wherever the
text has them.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_stage
from ..sources.tables import load
from .common import slices, without

#: Setting that holds the key, the same for all texts whose entities are to correspond.
KEY = "spark.leafwright.pii.key"

# Given names by gender and script, each list a set that is permuted.
GIVEN = {
    ("f", "latin"): "Anna Maria Sophie Laura Julia Emma Clara Elena Lucia Carmen Isabel Marie Claire Camille Alice Mary Linda Susan Karen Sarah Emily Jane".split(),
    ("m", "latin"): "John James Robert Michael David Thomas Peter Paul Mark Hans Karl Otto Jean Pierre Louis Jacques Juan Carlos Luis Pedro Miguel Daniel".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Андрей Дмитрий Алексей Николай Михаил".split(),
}
#: Titles that a name follows, by gender.
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]}

# Small letters by script and kind; capitals follow from them.
_KINDS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çñ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
]
#: Of a character: its class, the class that stands for both cases, and its place; of a class: its characters.
_PLACE: dict[str, tuple[str, str, int]] = {}
_MEMBERS: dict[str, str] = {}
#: Letters end below this code point.
_LAST = 0x32400


def _put(name: str, fold: str, members: str) -> None:
    _MEMBERS[name] = members
    _PLACE.update((c, (name, fold, i)) for i, c in enumerate(members))


def _pair(name: str, small: str) -> None:
    _put(f"{name} small", name, small)
    _put(f"{name} capital", name, "".join(c.upper() for c in small))


_put("digit", "digit", "0123456789")
for _kind in _KINDS:
    _pair(_kind, _kind)


@lru_cache(maxsize=1)
def _rest() -> None:
    """Classes of all other letters and digits: by script, case and category; scripts of one letter share one."""
    pairs, others = {}, {}
    for c in map(chr, range(0x80, _LAST)):
        kind = unicodedata.category(c)
        if c in _PLACE or not (kind[0] == "L" or kind == "Nd"):
            continue
        name = unicodedata.name(c, "OTHER")
        script = re.split(r"[ -]", name)[0]
        if kind == "Nd":
            others.setdefault(name.rpartition(" ")[0], []).append(c)
        elif kind == "Ll" and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c and c.upper() not in _PLACE:
            pairs.setdefault(script, []).append(c)
        elif not (kind == "Lu" and len(c.lower()) == 1 and c.lower() != c and c.lower().upper() == c and c.lower() not in _PLACE):
            others.setdefault(f"{script} {kind}", []).append(c)
    alone = [c for k in [k for k, v in pairs.items() if len(v) == 1] for c in (pairs[k][0], pairs.pop(k)[0].upper())]
    alone += [c for k in [k for k, v in others.items() if len(v) == 1] for c in others.pop(k)]
    for k, v in pairs.items():
        _pair(f"{k} pairs", "".join(v))
    for k, v in {**others, "alone": alone}.items():
        _put(k, k, "".join(v))


def _class(c: str) -> tuple[str, str, int] | None:
    """Class, folded class and place of a character; None of what is neither letter nor digit."""
    if c not in _PLACE and ord(c) >= 0x80:
        _rest()
    return _PLACE.get(c)


class Permutation:
    """A keyed permutation, without fixed points, of mixed-radix numbers."""

    def __init__(self, key: bytes, tweak: str, radices: tuple[int, ...]):
        half = len(radices) // 2
        self.a, self.b = prod(radices[:half]), prod(radices[half:])
        self.n = self.a * self.b
        self.head = hashlib.sha512(key).digest(), f"{tweak}|{radices}".encode()
        self.step = 1 + self._hash(99, 0) % (self.n - 1) if self.n > 1 else 0

    def _hash(self, i: int, x: int) -> int:
        size = (max(self.a, self.b).bit_length() + 7) // 8 + 8
        seed = hashlib.blake2b(self.head[1] + f"|{i}|{x}".encode(), key=self.head[0]).digest()
        return int.from_bytes(seed if size <= 64 else hashlib.shake_256(seed).digest(size), "big")

    def _run(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(8)) if back else range(8):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._hash(i, left)) % self.b
            else:
                left = (left + sign * self._hash(i, right)) % self.a
        return left * self.b + right

    def __call__(self, x: int) -> int:
        """The permutation conjugated with a shift: a bijection that moves every number."""
        return self._run((self._run(x, False) + self.step) % self.n, True)


@lru_cache(maxsize=4096)
def _permutation(key: bytes, tweak: str, radices: tuple[int, ...]) -> Permutation:
    return Permutation(key, tweak, radices)


def _digits(x: int, radices: tuple[int, ...]) -> list[int]:
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def _number(ds: list[int], radices: tuple[int, ...]) -> int:
    x = 0
    for d, r in zip(ds, radices, strict=True):
        x = x * r + d
    return x


def permute_text(key: bytes, tweak: str, text: str, fixed: set[int] = frozenset(), bad=None) -> str:
    """``text`` with its letters and digits, but for the places in ``fixed``, permuted in their classes.

    Upper and lower case of a letter move alike. Results for which ``bad`` holds are
    permuted on, which keeps the map one-to-one on texts for which it doesn't.
    """
    placed = [(i, *k) for i, c in enumerate(text) if i not in fixed and (k := _class(c))]
    if not placed:
        return text
    radices = tuple(len(_MEMBERS[k]) for _, k, _, _ in placed)
    p = _permutation(key, f"{tweak}|{'|'.join(fold for _, _, fold, _ in placed)}", radices)
    x = _number([d for _, _, _, d in placed], radices)
    for _ in range(1000):
        x = p(x)
        out = list(text)
        for (i, k, _, _), d in zip(placed, _digits(x, radices), strict=True):
            out[i] = _MEMBERS[k][d]
        if not bad or not bad("".join(out)):
            return "".join(out)
    raise ValueError("no surrogate of this format")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(key: bytes, text: str) -> str:
    """A valid number's surrogate is valid, an invalid one's is not."""
    digits = [c for c in text if c.isdigit()]
    if not luhn("".join(digits)):
        return permute_text(key, "card", text, bad=lambda t: luhn("".join(c for c in t if c.isdigit())))
    new = permute_text(key, "card", "".join(digits[:-1]))
    new += next(c for c in "0123456789" if luhn(new + c))
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _ip(key: bytes, text: str) -> str:
    radices = (256,) * 4
    return ".".join(map(str, _digits(_permutation(key, "ip", radices)(_number([int(x) for x in text.split(".")], radices)), radices)))


def _email(key: bytes, text: str) -> str:
    end = text.rindex(".")  # the top domain stays
    return permute_text(key, "email", text, fixed=set(range(end, len(text))))


def _phone(key: bytes, text: str) -> str:
    """The country's code stays."""
    m = re.match(r"\+\d{1,3}(?=\D)", text)
    return permute_text(key, "phone", text, fixed=set(range(m.end())) if m else set())


_KNOWN = {n: (g, s) for (g, s), ns in GIVEN.items() for n in ns}


def _name(key: bytes, gender: str, text: str) -> str:
    """Word by word, so that a surname alone and in full move alike."""

    def word(w: str) -> str:
        if w in _KNOWN:
            names = GIVEN[_KNOWN[w]]
            p = _permutation(key, f"given|{_KNOWN[w]}", (len(names),))
            return names[p(names.index(w))]
        # the ending, which shows gender, stays; a known name is no one else's surrogate
        return permute_text(key, "name", w, fixed={len(w) - 1} if len(w) > 2 else set(), bad=_KNOWN.__contains__)

    return re.sub(rf"{_LETTER}+", lambda m: m[0] if m[0] in _PARTICLES else word(m[0]), text)


#: A letter with its marks; the small ones, which begin no name.
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f])"
_SMALL = "".join(c for c in map(chr, range(0x80, 0x2000)) if c.islower())
_CAPITAL = rf"[^\W\d_a-z{_SMALL}]"
#: Small words inside names, which stay.
_PARTICLES = set("von van vom zu zum zur der den dem de del della di da do dos das du des la le las los ter ten bin ibn al el y e af av d l".split())
_PARTICLE = rf"(?:(?:{'|'.join(sorted(_PARTICLES - {'d', 'l'}, key=len, reverse=True))})[ \t\u00a0]{{1,3}}|[dl]['’])"
# an apostrophe joins what follows, but for endings as in Smith's
_NAME_WORD = rf"(?:{_CAPITAL}\.(?!\w\w)|{_CAPITAL}{_LETTER}*(?:(?:[\-\u2010\u2011]|['’](?!(?:s|d|ll|ve|re|m|t)\b)){_LETTER}+)*)"
_NAME = rf"{_PARTICLE}*{_NAME_WORD}(?:[ \t\u00a0]{{0,3}}(?<=[ \t\u00a0.]){_PARTICLE}*{_NAME_WORD})*"
#: Degrees between a title and a name, which stay.
_DEGREE = r"(?:(?:Dr|Prof|Professor|Doktor|Doctor|Dipl|Ing)\b\.?[\s\-]{1,3})*"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_ENTITY = re.compile(
    rf"""
    (?P<email>(?<![\w.%+\-])[\w.%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{{2,}})
  | (?P<iban>\b[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{3,7}}(?:\ ?[A-Z0-9]{{1,3}})?\b)
  | (?P<ip>(?<!\d)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))
  | (?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
  | (?P<phone>(?<!\w)(?:\+\d{{1,3}}[\ .\-]?)?\(\d{{2,4}}\)[\ .\-]?\d{{3,4}}[\ .\-]?\d{{3,4}}(?!\w)
      |\+\d{{1,3}}(?:[\ .\-]\d{{2,4}}){{2,5}}(?!\w)|\+\d{{8,15}}(?!\w)|(?<![\w.\-])\d{{3}}[.\-\ ]\d{{3}}[.\-\ ]\d{{4}}(?![\w\-]))
  | (?P<card>(?<!\w)(?<!\d\.)(?:\d{{13,19}}|\d{{4}}(?P<gap>[\ \-])\d{{4}}(?P=gap)\d{{4}}(?P=gap)\d{{1,7}}|3[47]\d{{2}}[\ \-]\d{{6}}[\ \-]\d{{5}})(?!\w))
  | (?:\b(?P<title>{_TITLE})(?:\.\s{{0,3}}|\s{{1,3}}){_DEGREE}(?P<name>{_NAME}))
    """,
    re.X,
)
_RUN = re.compile(rf"(?<![\w]){_LETTER}+(?:[\-\u2010\u2011'’]{_LETTER}+)*(?![\w])")
_PART = re.compile(rf"{_LETTER}+")
_MAY = re.compile(r"[0-9@]")
_FEMALE = set(TITLES["f"])
KINDS = ["email", "phone", "card", "ip", "iban", "ssn", "name"]


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[str, int, int, str, str]]]:
    """``text`` with surrogates, and its entities: kind, start, end, value, surrogate."""
    if not text or not (_MAY.search(text) or any(t in text for t in _TITLE.split("|"))):
        return text, []
    out, at, found = [], 0, []
    for m in _ENTITY.finditer(text):
        kind = next(k for k in KINDS if m[k] is not None)
        value, (start, end) = m[kind], m.span(kind)
        if kind == "card" and sum(map(str.isdigit, value)) != 16 and not luhn("".join(c for c in value if c.isdigit())):
            continue
        if kind == "email":
            new = _email(key, value)
        elif kind == "phone":
            new = _phone(key, value)
        elif kind == "card":
            new = _card(key, value)
        elif kind == "ip":
            new = _ip(key, value)
        elif kind == "name":
            new = _name(key, "f" if m["title"] in _FEMALE else "m", value)
        else:
            new = permute_text(key, kind, value, fixed={0, 1} if kind == "iban" else set())
        found.append((kind, start, end, value, new))
    found = _mentions(key, text, found)
    for _, start, end, _, new in found:
        out += [text[at:start], new]
        at = end
    return ("".join([*out, text[at:]]), found) if found else (text, [])


def _mentions(key: bytes, text: str, found: list[tuple[str, int, int, str, str]]) -> list[tuple[str, int, int, str, str]]:
    """``found``, in order, with the bare mentions of its names' words between them; single letters are none."""
    words = {w for f in found if f[0] == "name" for w in (*re.findall(_NAME_WORD, f[3]), *re.findall(rf"{_LETTER}+", f[3])) if len(w.rstrip(".")) > 1 and w not in _PARTICLES}
    if not words:
        return found
    # runs of letters, hyphens and apostrophes are looked up, whole and then by their parts
    more, at = [], 0
    for start, end in [*((f[1], f[2]) for f in found), (len(text), len(text))]:
        for m in _RUN.finditer(text, at, start):
            spans = [m.span()] if m[0] in words else [p.span() for p in _PART.finditer(text, *m.span()) if p[0] in words]
            more += [("name", a, b, text[a:b], _name(key, "", text[a:b])) for a, b in spans]
        at = end
    return sorted([*found, *more], key=lambda f: f[1])


_drawn: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key that the setting ``KEY`` holds; without one, a random key of this application, which ends with it."""
    told = spark.conf.get(KEY, None)
    return told.encode() if told else _drawn.setdefault(spark.sparkContext.applicationId, os.urandom(32))


def pseudonymise(df: DataFrame, text: str = "text", key: bytes | None = None) -> DataFrame:
    """``df`` with surrogates in ``text``, and ``entities``: kind, start, end (code points of the old text), value, surrogate.

    ``key`` is by default the session's, see :func:`key_of`. A null or empty text stays as
    it is. Texts of any length are read whole, in time that grows with them alone. Rows are
    independent, so repeated ones have equal results. An empty table gives no rows.
    ``entities`` holds what it replaces and is to be kept as secret as the input.
    """
    key = key or key_of(df.sparkSession)
    df = without(df, "entities")
    at, names = df.columns.index(text), df.columns
    entity = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [replace(t, key) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array([m[0] for m in made], pa.string())
            rows = [[dict(zip(("kind", "start", "end", "value", "surrogate"), e, strict=True)) for e in m[1]] for m in made]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(rows, entity)], [*names, "entities"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "entities array<struct<kind:string,start:int,end:int,value:string,surrogate:string>>"])
    return df.mapInArrow(run, schema)


def collisions(df: DataFrame) -> DataFrame:
    """Surrogates (kind, surrogate, n) that stand for several values: none, as they are permuted."""
    e = df.select(F.explode("entities").alias("e")).select("e.kind", "e.value", "e.surrogate").distinct()
    return e.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked(df: DataFrame) -> DataFrame:
    """The table of :func:`pseudonymise`, written, once no surrogate in it stands for several values and none for itself."""
    made = write_stage(df, "surrogates")
    if collisions(made).limit(1).count() or made.where("exists(entities, e -> e.value = e.surrogate)").limit(1).count():
        raise RuntimeError("surrogates collide")
    return made


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their personal data, and counts by kind."""
    docs = checked(pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text")))
    count = lambda k: F.expr(f"cast(size(filter(entities, e -> e.kind = '{k}')) as bigint)").alias(f"n_{k}")
    spans = F.expr("array_join(transform(entities, e -> concat(e.kind, ':', e.start, ':', e.end)), ',')").alias("spans")
    return docs.select("doc_id", "text", *map(count, KINDS), spans)
