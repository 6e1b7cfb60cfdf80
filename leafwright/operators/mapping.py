"""Titles found on pages: normal forms, fragments, fuzzy scores, and the mappers of outlines to pages.

Scores compare strings by longest matching blocks, which no built-in function does, so
they run in Arrow batches; a mapper's cursor is sequential, so a document's titles and
pages meet in one row, whose size is a document's. A title is scored only on pages that
bounds leave: what has no part of it, and too few pairs of letters, has no score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from itertools import zip_longest
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.registry import query
from ..sources.derived import TOC, page_text, toc_items

# What opens a numbered title, in text and in its normal form.
PREFIXES = (
    r"(?i)^(?:part|chapter|section)\s*0*\d{1,3}(?:[.:：\-、\s]+)?",
    r"^(?:第\s*)?[0-9一二三四五六七八九十百千]{1,4}[章节篇部]\s*[.:：\-、\s]*",
    r"^(?:[0-9一二三四五六七八九十百千]{1,4})(?:[.)、．。\-\s]+)",
)
BARE_PREFIX = r"^(?:第?[一二三四五六七八九十百千万零]+[章节篇部]?|[0-9]{1,3}(?:[.、．]\d+)*)"
_SPLIT = re.compile(r"[\s:：;；,，、/\\|()\[\]{}<>《》“”\"'‘’\-–—]+")
_MARKER = re.compile(r"(?:part|chapter|section)\d{1,3}|\d{1,3}(?:\.\d{1,3})*")
_NO_ALNUM = re.compile(r"[\W_]+")
_NO_LATIN = bytes(i for i in range(256) if not chr(i).isalnum())
_NUMERALS = "一二三四五六七八九十百千万零〇"
#: What any of marker_patterns() needs: at a line's start, or after a gap within it.
_MARKS = re.compile(rf"\s*(?:chapter|part|section|第|[{_NUMERALS}]|\d{{1,3}}\s*[.．、])", re.I)
_GAP_MARK = re.compile(r"\s\s\d")
#: The same within a text's lines, wherever in them.
_ANY_MARK = re.compile(rf"(?:chapter|part|section)\s*\d|第|[{_NUMERALS}\d]\s*[、.．]", re.I)
#: What numbers a title, by marker_patterns()'s four kinds.
_WORD_MARK = re.compile(r"\s*(chapter|part|section)\s*0*(\d{1,3})\b", re.I)
_PART_MARK = re.compile(rf"\s*第\s*([{_NUMERALS}\d]{{1,6}})\s*([章节篇部])")
_NUMERAL_MARK = re.compile(rf"\s*([{_NUMERALS}]{{1,6}})\s*[、.．]\s*")
_DIGIT_MARK = re.compile(r"\s*(\d{1,3})(?:[.)、．]\s*|\s+)")
_LEADING = re.compile(r"(?:part|chapter|section)\d{1,3}|\d{1,3}(?:\.\d{1,3})*")
_TAG = re.compile(r"<[^>]+>")
_FRONT, _BARE_FRONT = [re.compile(p) for p in PREFIXES], re.compile(BARE_PREFIX)
#: Scores: the least that counts as found, what ends a search, and what a marker alone gives.
FOUND, SURE, MARKED, LISTED = 0.58, 0.95, 0.82, 0.78
#: The least likeness of lines and of windows; what a window can give at most, as one of 24 characters or fewer differs in one.
ALIKE, SIMILAR, WINDOW_MOST = 0.84, 0.86, 0.74
_CODES = 1 << 16


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def title_form(text: Column) -> Column:
    """FN02: compatibility forms and capitals folded; letters and digits only. Plain ASCII never leaves the JVM."""
    folded = F.when(text.rlike(r"[^\x00-\x7f]"), _nfkc(text)).otherwise(text)
    return F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}]+", "")


def strip_prefix(text: Column) -> Column:
    """FN05: a title without part, chapter or number in front."""
    for p in PREFIXES:
        text = F.regexp_replace(text, p, "")
    return text


def title_fragments(title: Column) -> Column:
    """MAP02: stretches of 18 and 24 characters of a title's form, with and without its prefix; four characters at least."""
    form, bare = title_form(title), title_form(strip_prefix(title))
    short = F.when((bare != "") & (bare != form), bare).otherwise(F.regexp_replace(form, BARE_PREFIX, ""))

    def cut(v: Column) -> Column:
        n = F.char_length(v)
        mid = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - 9)
        many = F.array(F.substring(v, 1, 18), F.substring(v, 1, 24), F.right(v, F.lit(18)), F.substring(v, mid + 1, F.lit(18)))
        return F.when(n <= 18, F.array(v)).otherwise(many)

    return F.filter(F.array_distinct(F.concat(cut(form), cut(short))), lambda x: F.char_length(x) >= 4)


@lru_cache(maxsize=65_536)
def normal(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).lower()
    try:  # Latin letters, as most texts have no others, go by a table
        return text.encode("latin-1").translate(None, _NO_LATIN).decode("latin-1")
    except UnicodeEncodeError:
        return _NO_ALNUM.sub("", text)


def _cut(front: re.Pattern, text: str) -> str:
    m = front.match(text)
    return text[m.end() :] if m else text


def bare(text: str) -> str:
    for p in _FRONT:
        text = _cut(p, text)
    return text


@lru_cache(maxsize=65_536)
def variants(text: str) -> tuple[str, ...]:
    """A title's forms, whole and without its prefix."""
    form, cut = normal(text), bare(text)
    short = form if cut is text else normal(cut)
    return tuple(v for v in ((form,) if short == form else (form, short)) if v)


@lru_cache(maxsize=4096)
def fragments(title: str) -> list[str]:
    form, short = normal(title), normal(bare(title))
    if not short or short == form:
        short = _cut(_BARE_FRONT, form)
    out: dict[str, None] = {}
    for v in (form, short):
        mid = max(0, len(v) // 2 - 9)
        out.update(dict.fromkeys([v] if len(v) <= 18 else [v[:18], v[:24], v[-18:], v[mid : mid + 18]]))
    return [v for v in out if len(v) >= 4]


def plain_score(title: str, line: str) -> float:
    """The score of a line's form that is a title's or holds it."""
    n, m = len(title), len(line)
    if not n or not m:
        return 0.0
    if title == line:
        return 1.0
    if n >= 4 and title in line:
        return 0.98
    if 2 <= n < 4 and line.startswith(title) and m <= n + 12:
        return 0.92
    return 0.0


@lru_cache(maxsize=65_536)
def line_score(title: str, line: str) -> float:
    """How well a line's form is a title's: the same, holding it, or nearly the same."""
    n, m = len(title), len(line)
    if (score := plain_score(title, line)) or min(n, m) < 8 or 2.0 * min(n, m) / (n + m) < ALIKE:
        return score
    if 2.0 * (Counter(title) & Counter(line)).total() / (n + m) < ALIKE:
        return 0.0
    like = SequenceMatcher(None, title, line).ratio()
    if like < ALIKE:
        return 0.0
    if like < 0.9:
        return ALIKE + (like - ALIKE) * 1.5
    if min(n, m) < 14 and any("㐀" <= c <= "鿿" for c in title + line):
        # short ideographic titles that differ in front are different ones
        need = max(2, min(4, min(n, m) // 3))
        if title[:need] != line[:need]:
            return 0.0
    return min(0.98, 0.96 + (like - 0.9) * 0.2)


@lru_cache(maxsize=4096)
def _word_mark(word: str, number: str) -> tuple[re.Pattern, float]:
    return re.compile(rf"^\s*{word}\s*0*{number}\b", re.I | re.M), MARKED


@lru_cache(maxsize=4096)
def _part_mark(number: str, part: str) -> tuple[re.Pattern, float]:
    return re.compile(rf"^\s*第\s*{number}\s*{part}", re.M), MARKED


@lru_cache(maxsize=4096)
def _numeral_mark(number: str) -> tuple[re.Pattern, float]:
    return re.compile(rf"^\s*{number}\s*[、.．]", re.M), MARKED


@lru_cache(maxsize=4096)
def _digit_mark(number: str) -> tuple[re.Pattern, float]:
    return re.compile(rf"(?:^|\s{{2,}}){number}\s*[.．、]\s*(?:\d{{1,2}}[)）]|[A-Za-z一-鿿])", re.M), MARKED


@lru_cache(maxsize=4096)
def marker_patterns(title: str) -> tuple[tuple[re.Pattern, float], ...]:
    """MAP05: patterns of lines that carry the title's number, with the score each gives; one of each number is made once."""
    kinds = ((_WORD_MARK, _word_mark), (_PART_MARK, _part_mark), (_NUMERAL_MARK, _numeral_mark), (_DIGIT_MARK, _digit_mark))
    return tuple(make(*m.groups()) for kind, make in kinds if (m := kind.match(title)))


@lru_cache(maxsize=4096)
def segments(title: str) -> list[str]:
    """MAP03: the parts of a title between punctuation, and its marker."""
    text = _TAG.sub(" ", unicodedata.normalize("NFKC", title).lower())
    parts = [p for p in map(normal, _SPLIT.split(text)) if p and p not in ("chapter", "part", "section") and (len(p) >= 4 or _MARKER.fullmatch(p))]
    m = _LEADING.match(normal(text))
    return list(dict.fromkeys([*([m[0]] if m and m[0] not in parts else []), *parts]))


def segment_score(title: str, page: str) -> float:
    """MAP03: a title whose parts a page's form holds with other text between; parts out of order count less."""
    parts, at, places = segments(title), 0, {}
    for p in parts:
        i = page.find(p, at)
        i = page.find(p) if i < 0 else i
        if i >= 0:
            places[p], at = i, i + len(p)
    if len(parts) < 2 or len(places) < 2:
        return 0.0
    marks = {p for p in parts if _MARKER.fullmatch(p)}
    words = [p for p in parts if p not in marks]
    hit = sum(p in places for p in words)
    share = hit / max(1, len(words))
    if marks:
        if not marks & places.keys() or hit < max(1, min(2, len(words))):
            return 0.0
        score = 0.82 + min(0.1, share * 0.1)
    else:
        if hit < 2 or share < 0.5:
            return 0.0
        score = 0.72 + min(0.18, share * 0.18)
    order = list(places.values())
    return round(min(0.92, score if order == sorted(order) else min(score, 0.78)), 4)


def window_score(title: str, page: str, windows: int = 24) -> float:
    """MAP04: the best likeness of a fragment without digits to windows spread over a page's form."""
    best = 0.0
    for f in fragments(title):
        last = len(page) - len(f)
        if len(f) < 10 or last < 0 or re.search(r"\d", f):
            continue
        starts = list(range(0, last + 1, max(1, last // windows)))[:windows]
        for at in dict.fromkeys([*starts, last]):
            best = max(best, SequenceMatcher(None, f, page[at : at + len(f)]).ratio())
    return likeness_score(best)


def likeness_score(best: float) -> float:
    return min(0.9, 0.58 + (best - SIMILAR) * 1.6) if best >= SIMILAR else 0.0


def fragment_score(hits: int, parts: int, longest: int) -> float:
    return min(0.95, 0.58 + min(0.32, hits / parts * 0.24) + min(0.1, longest / 200))


def heading_score(title: str, text: str) -> float:
    """The best of a page's first twelve lines, lower ones a little less; without the title's marker not enough to count."""
    marks, best = marker_patterns(title), 0.0
    for i, line in enumerate([x.strip() for x in text.splitlines() if x.strip()][:12]):
        pairs = [(a, b) for a in variants(title) for b in variants(line)]
        score = max((plain_score(a, b) for a, b in pairs), default=0.0)
        if score < 0.98:  # what is nearly the same has no more
            score = max((line_score(a, b) for a, b in pairs), default=0.0)
        if score and marks and not any(p.search(line) for p, _ in marks):
            score = min(score, 0.57)
        best = max(best, round(max(0.0, score - min(0.04, i * 0.003)), 4) if score else 0.0)
    return best


def title_score(title: str | None, text: str | None) -> float:
    """MAP01: how surely a page shows a title, 0 to 1, by the best of all tiers."""
    title, text = title or "", text or ""
    form, page = normal(title), normal(text)
    if not form or not page:
        return 0.0
    found = [heading_score(title, text)]
    if found[0] >= SURE:
        return found[0]
    found.append(segment_score(title, page))
    if len(form) >= 4 and form in page:
        found.append(0.9)
    if 2 <= len(form) < 4 and form in map(normal, text.splitlines()):
        found.append(0.92)
    parts = fragments(title)
    hits = [p for p in parts if p in page]
    if hits:
        found.append(fragment_score(len(hits), len(parts), max(map(len, hits))))
    else:
        found.append(window_score(title, page))
    return max(found)


def position(title: str, text: str) -> tuple[int | None, int, bool] | None:
    """MAP06: (line, offset, whether that is near the page's top) of the first line that shows the title."""
    at = before = 0
    for i, line in enumerate(text.splitlines()):
        if line.strip():
            pairs = [(a, b) for a in variants(title) for b in variants(line.strip())]
            if any(line_score(a, b) >= FOUND or (len(a) >= 4 and a in b) for a, b in pairs):
                return i, at, i <= 2 and before <= 1 and at <= 160
            before += 1
        at += len(line) + 1
    at = normal(text).find(normal(title)) if normal(title) else -1
    return (None, at, at <= 80) if at >= 0 else None


class Pages(dict):
    """{page: text} of a document in order, with what searches for many titles share: each distinct text is worked on once."""

    def __init__(self, texts: dict[int, str]):
        super().__init__(sorted(texts.items()))
        self.numbers, at = list(self), {}
        for i, t in enumerate(self.values()):
            at.setdefault(t or "", []).append(i)
        self.texts, self.at = list(at), list(at.values())
        self._held: dict[str, list[int]] = {}
        self._windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, texts: dict[int, str]) -> Pages:
        return texts if isinstance(texts, cls) else cls(texts)

    def first(self, t: int, low: int) -> int | None:
        """The first place of a text from the place ``low``."""
        at = self.at[t]
        k = bisect_left(at, low)
        return at[k] if k < len(at) else None

    @cached_property
    def forms(self) -> list[str]:
        return [normal(t) for t in self.texts]

    @cached_property
    def joined(self) -> tuple[str, list[int]]:
        return _joined(self.forms)

    def holding(self, part: str) -> list[int]:
        """The texts whose form holds a part."""
        if part not in self._held:
            self._held[part] = _holding(*self.joined, part)
        return self._held[part]

    @cached_property
    def _lines(self) -> tuple[list[str], list[list[int]], tuple[str, list[int]], tuple[list[int], np.ndarray], list[tuple[int, int]], dict[int, frozenset]]:
        """Forms of the first twelve lines, the texts of each, the forms' lengths, and their first and last places."""
        of: dict[str, list[int]] = {}
        for k, text in enumerate(self.texts):
            for v in dict.fromkeys([v for x in _first_lines(text) for v in variants(x)]):
                of.setdefault(v, []).append(k)
        forms = list(of)
        spans = [(min([self.at[t][0] for t in ts]), max([self.at[t][-1] for t in ts])) for ts in of.values()]
        lengths = [len(v) for v in forms]
        return forms, list(of.values()), _joined(forms), (lengths, np.array(lengths, dtype=np.int64)), spans, {}

    def showing(self, form: str) -> set[int]:
        """The texts of which one of the first lines is a title's form or holds it."""
        forms, of, joined, *_ = self._lines
        some = _holding(*joined, form) if len(form) > 1 else [k for k, v in enumerate(forms) if v == form]
        return {t for k in some for t in of[k]}

    @cached_property
    def _marked(self) -> list[tuple[int, list[str]]]:
        """The texts with lines among the first that may carry a number, and these."""
        found = ((k, [x for x in _first_lines(text) if _MARKS.match(x) or _GAP_MARK.search(x)]) for k, text in enumerate(self.texts))
        return [x for x in found if x[1]]

    def marked(self, patterns: tuple[tuple[re.Pattern, float], ...]) -> set[int]:
        """The texts of which one of the first lines carries a title's number."""
        return {k for k, lines in self._marked if any(p.search(x) for x in lines for p, _ in patterns)}

    def near(self, form: str, low: int, high: int) -> set[int]:
        """The texts of places from ``low``, before ``high``, and some others, of which one of the first lines may be nearly a title's form.

        Of two strings with s characters in all, like blocks have 0.42 s or more in each, so at most
        0.16 s + 1 blocks, and so all but as many of the pairs of letters in them.
        """
        forms, of, _, lengths, spans, pairs = self._lines
        n, some = len(form), []
        if n >= 8:
            # so long are lines of which the shorter one's characters are enough
            least, most = max(8, n * ALIKE / (2 - ALIKE) - 1e-6), n * (2 - ALIKE) / ALIKE + 1e-6
            at = range(len(forms)) if len(forms) < 64 else np.flatnonzero((lengths[1] >= least) & (lengths[1] <= most)).tolist()
            at = [k for k in at if least <= lengths[0][k] <= most and spans[k][0] < high and spans[k][1] >= low]
            own = [form[i : i + 2] for i in range(n - 1)] if at else []
            for k in at:
                v = forms[k]
                if k not in pairs:
                    pairs[k] = frozenset(v[i : i + 2] for i in range(len(v) - 1))
                if sum(map(pairs[k].__contains__, own)) >= (1.5 * ALIKE - 1) * (n + len(v)) - 1 - 1e-6:
                    some.append(k)
        return {t for k in some for t in of[k]}

    @cached_property
    def _pairs(self) -> np.ndarray:
        codes = _codes(self.joined[0])
        return (codes[:-1] * 31 + codes[1:]) % _CODES

    @cached_property
    def _last(self) -> np.ndarray:
        return np.array([at[-1] for at in self.at])

    def windows(self, n: int, windows: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """Where window_score's windows of ``n`` characters begin in the joined forms, and the text of each."""
        if n not in self._windows:
            starts, owner = [], []
            for k, (form, at) in enumerate(zip(self.forms, self.joined[1], strict=True)):
                last = len(form) - n
                if last >= 0:
                    some = {*range(0, last + 1, max(1, last // windows))[:windows], last}
                    starts += [at + i for i in some]
                    owner += [k] * len(some)
            self._windows[n] = np.array(starts, dtype=np.int64), np.array(owner, dtype=np.int64)
        return self._windows[n]

    def window_ratios(self, parts: list[str], low: int, but: set | dict) -> dict[int, float]:
        """The best likeness of parts to windows of each text from the place ``low``, if similar enough to count.

        A window with m of n characters alike has them in 2 (n - m) + 1 blocks at most, and so all but as
        many of their pairs of letters.
        """
        out: dict[int, float] = {}
        for f in parts:
            n = len(f)
            if n < 10 or re.search(r"\d", f):
                continue
            starts, owner = self.windows(n)
            if not len(starts):
                continue
            same = ceil(SIMILAR * n - 1e-6)
            own, has = _codes(f), np.zeros(_CODES, dtype=bool)
            has[(own[:-1] * 31 + own[1:]) % _CODES] = True
            before = np.concatenate(([0], np.cumsum(has[self._pairs], dtype=np.int32)))
            enough = (before[starts + n - 1] - before[starts] >= same - 2 * (n - same) - 1) & (self._last[owner] >= low)
            text, letters = self.joined[0], Counter(f)
            for i in np.flatnonzero(enough).tolist():
                k, at = int(owner[i]), int(starts[i])
                if k not in but:
                    window = text[at : at + n]
                    if (letters & Counter(window)).total() >= same and (like := SequenceMatcher(None, f, window).ratio()) >= SIMILAR:
                        out[k] = max(out.get(k, 0.0), like)
        return out

    @cached_property
    def numbered(self) -> list[int]:
        """The texts with a line that may carry a number."""
        return [k for k, text in enumerate(self.texts) if _ANY_MARK.search(text)]

    @cached_property
    def shown(self) -> dict[int | None, list[str]]:
        """Texts as markers are looked for: the first sixteen lines without blank ones, and all lines."""
        lines = [t.splitlines() for t in self.texts]
        return {16: ["\n".join([x for x in some[:16] if x.strip()]) for some in lines], None: ["\n".join(some) for some in lines]}


def _first_lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip()][:12]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _joined(forms: list[str]) -> tuple[str, list[int]]:
    """Forms in one string, a line each, and where each begins."""
    starts, at = [], 0
    for v in forms:
        starts.append(at)
        at += len(v) + 1
    return "\n".join(forms), starts


def _holding(text: str, starts: list[int], part: str) -> list[int]:
    out, i = [], text.find(part)
    while i >= 0:
        k = bisect_right(starts, i)
        out.append(k - 1)
        i = text.find(part, starts[k]) if k < len(starts) else -1
    return out


def marker_page(title: str, texts: dict[int, str], start: int) -> tuple[int, float] | None:
    """MAP05: the first page from ``start`` with a line that carries the title's number, near its top at first."""
    patterns, pages = marker_patterns(title), Pages.of(texts)
    tries = [(patterns, 16, MARKED), ([p for p in patterns if "{2,}" in p[0].pattern], None, LISTED)]
    low = bisect_left(pages.numbers, start)
    at = sorted([(i, k) for k in pages.numbered if (i := pages.first(k, low)) is not None]) if patterns and pages.numbered else []
    for some, lines, score in tries:
        for i, k in at if some else ():
            if any(p.search(pages.shown[lines][k]) for p, _ in some):
                return pages.numbers[i], score
    return None


def title_page(title: str, texts: dict[int, str], start: int) -> tuple[int, float] | None:
    """The first page from ``start`` that surely shows the title, else the best that does.

    This is the best title_score of all these pages; the tiers go only to texts that can have a score by them.
    """
    title = title or ""
    pages, form = Pages.of(texts), normal(title)
    low = bisect_left(pages.numbers, start)
    if not form or low >= len(pages):
        return None
    found: dict[int, float] = {}
    marks, forms = marker_patterns(title), variants(title)
    # of a numbered title, lines without its number do not count
    marked = pages.marked(marks) if marks else None
    if marked is None or marked:
        own = lambda some: sorted((i, t) for t in some if pages.forms[t] and (marked is None or t in marked) and (i := pages.first(t, low)) is not None)
        sure = None
        for i, t in own({t for v in forms for t in pages.showing(v)}):
            found[t] = heading_score(title, pages.texts[t])
            if found[t] >= SURE:
                sure = i, t
                break
        for i, t in own({t for v in forms for t in pages.near(v, low, sure[0] if sure else len(pages))} - found.keys()):
            if sure and i > sure[0]:
                break
            found[t] = heading_score(title, pages.texts[t])
            if found[t] >= SURE:
                sure = i, t
                break
        if sure:  # the other tiers stay below
            return pages.numbers[sure[0]], found[sure[1]]

    def put(t: int, score: float) -> None:
        if score > found.get(t, 0.0):
            found[t] = score

    parts = segments(title)
    if len(parts) >= 2:
        own_marks = [p for p in parts if _MARKER.fullmatch(p)]
        if own_marks:  # without one of them there is no score
            some = {t for p in own_marks for t in pages.holding(p)}
        else:
            some = [t for t, n in Counter([t for p in parts for t in pages.holding(p)]).items() if n >= 2]
        for t in some:
            if pages.at[t][-1] >= low:
                put(t, segment_score(title, pages.forms[t]))
    parts = fragments(title)
    hits: dict[int, list[str]] = {}
    for p in parts:  # what holds 24 characters holds the first 18 of them
        for t in pages.holding(p) if len(p) <= 18 or pages.holding(p[:18]) else ():
            hits.setdefault(t, []).append(p)
    if len(form) >= 4:
        for t in pages.holding(form) if hits else ():  # a form has fragments, and what holds it holds these
            put(t, 0.9)
    elif len(form) >= 2:
        for t in pages.holding(form):
            if form in map(normal, pages.texts[t].splitlines()):
                put(t, 0.92)
    for t, some in hits.items():
        put(t, fragment_score(len(some), len(parts), max(map(len, some))))
    found = {t: s for t, s in found.items() if s >= FOUND and pages.at[t][-1] >= low}
    if max(found.values(), default=0.0) < WINDOW_MOST:
        for t, like in pages.window_ratios(parts, low, hits).items():
            put(t, likeness_score(like))
    best = min(((-s, pages.first(t, low)) for t, s in found.items()), default=None)
    return (pages.numbers[best[1]], -best[0]) if best else None


def map_items(items: list[tuple[str, str]], texts: dict[int, str], start: int = 1, infer: bool = True) -> list[tuple[int | None, str, float]]:
    """MAP07: (page, source, confidence) of each (title, catalog); a catalog's search goes on from its last hit.

    Main titles not found by text are looked for by their markers. With ``infer``, main
    titles still without a page get that of the last one found before them, else the next.
    """
    out: list = []
    texts, cursor = Pages.of(texts), {}
    for title, catalog in items:
        at = cursor.get(catalog, start)
        hit, source = (title_page(title, texts, at), "title_search") if title.strip() else (None, "")
        if hit is None and catalog == "main" and title.strip():
            hit, source = marker_page(title, texts, at), "outline_marker"
        if hit:
            cursor[catalog] = hit[0]
        out.append((hit[0], source, round(hit[1], 4)) if hit else (None, "unmapped", 0.0))
    if infer:
        known = [(i, m[0]) for i, m in enumerate(out) if m[0] is not None and items[i][1] == "main"]
        for i, (page, _, _) in enumerate(out):
            if page is None and items[i][1] == "main" and known:
                near = [p for k, p in known if k < i][-1:] or [known[0][1]]
                out[i] = near[0], "neighbor_inference", 0.45
    return out


def override_printed(items: list[tuple[str, str, int | None]], texts: dict[int, str], start: int = 1) -> list[tuple[int | None, str, float]]:
    """MAP13: pages from printed numbers, given up for a page that shows the title by 0.75 or more.

    A hit before the printed page does not move a title that its printed page shows too.
    """
    out: list = []
    texts, cursor = Pages.of(texts), {}
    for title, catalog, printed in items:
        at = cursor.get(catalog, start)
        hit, source = title_page(title, texts, at) if title.strip() else None, "title_search"
        if printed is None and hit is None and catalog == "main" and title.strip():
            hit, source = marker_page(title, texts, at), "outline_marker"
        if printed is not None and hit and (hit[1] < 0.75 or (hit[0] < printed and printed in texts and title_page(title, {printed: texts[printed]}, printed))):
            hit = None
        out.append((hit[0], source, round(hit[1], 4)) if hit else (printed, "printed_page_offset" if printed is not None else "unmapped", 0.0))
        if out[-1][0] is not None:
            cursor[catalog] = hit[0] if hit else max(at, out[-1][0])
    return out


def map_skeleton(items: list[tuple[str, int | None]], texts: dict[int, str], start: int = 1) -> tuple[str, float, list[int]]:
    """MAP09: (strategy, quality, pages): pages as given if they are in order, else by titles, else spread evenly."""
    n, last = len(items), max(texts, default=1)
    given = [p for _, p in items]
    if n and all(p is not None and 1 <= p <= last for p in given) and given == sorted(given):
        return "existing", 1.0, given
    flat = {p: re.sub(r"\s+", "", t).lower() for p, t in texts.items()}
    found: list[int | None] = []
    at = start
    for title, _ in items:
        head = re.sub(r"\s+", "", title).lower()
        hit = next((p for p, t in flat.items() if p >= at and head[:80] in t), None) if len(head) >= 4 else None
        at = hit or at
        found.append(hit)
    spread = lambda k: [min(last, min(start, last) + i * max(1, (last - min(start, last) + 1) // max(1, k))) for i in range(k)]
    quality = sum(p is not None for p in found) / max(1, n)
    if quality < 0.5:
        return "uniform_after_toc", 0.35 if n else 0.0, spread(n)
    rest = iter(spread(found.count(None)))
    pages, low = [], start
    for p in found:
        p = next(rest) if p is None else p
        low = max(low, p)
        pages.append(low)
    return "title_search", quality, pages


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def by_row(documents: DataFrame, columns: str, make: Callable[..., Iterable[tuple]], doc: str = "doc_id") -> DataFrame:
    """Rows of ``columns`` that ``make`` gives for the columns after the document of each row, in Arrow batches."""
    fields = [pa.field(doc, pa.int64()), *(pa.field(c.split()[0], _ARROW[c.split()[1]]) for c in columns.split(", "))]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, batch.num_rows, 64):
                for key, *values in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    out += ((key, *r) for r in make(*values))
                if len(out) > 4096:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    return documents.mapInArrow(run, f"{doc} long, {columns}")


def gathered(rows: DataFrame, first: str, name: str, doc: str = "doc_id") -> DataFrame:
    """A document's rows in one, by ``first`` in order."""
    return rows.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(first, *(c for c in rows.columns if c not in (doc, first))))).alias(name))


def page_texts(pages: list[dict] | None) -> Pages:
    return Pages({p["page"]: p["text"] or "" for p in pages or ()})


def listed_pages(lists: list[list[str | None]]) -> dict[int, str]:
    """{page: text} of lists of pages from 1, as page_texts() has them: of equal pages the last text counts; none where null."""
    if len(lists) == 1:
        return {i: t for i, t in enumerate(lists[0], 1) if t is not None}
    return {i: max(some) for i, ts in enumerate(zip_longest(*lists), 1) if (some := [t for t in ts if t is not None])}


def _by_document(items: DataFrame, pages: DataFrame, columns: str, make: Callable[[list[dict], Pages], Iterable[tuple]], doc: str = "doc_id") -> DataFrame:
    """``make(items in order, {page: text})`` for each document: rows of ``columns`` after the document.

    Items and pages meet in one grouping, so that texts move once.
    """
    item = F.struct("ord", *(c for c in items.columns if c not in (doc, "ord")))
    left = items.select(doc, item.alias("item"))
    right = pages.where("page is not null").select(doc, F.struct("page", "text").alias("one_page"))
    both = left.unionByName(right, allowMissingColumns=True).groupBy(doc)
    both = both.agg(*[F.sort_array(F.collect_list(c)).alias(name) for c, name in (("item", "items"), ("one_page", "pages"))]).where("size(items) > 0")
    return by_row(both, columns, lambda rows, texts: make(rows, page_texts(texts)), doc)


def score_titles(pairs: DataFrame, title: str = "title", text: str = "text", tiers=title_score, name: str = "score") -> DataFrame:
    """``pairs`` with the score of each title on its text."""

    @F.pandas_udf("double")
    def score(t: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([round(tiers(a or "", b or ""), 6) for a, b in zip(t, x, strict=True)])

    return pairs.withColumn(name, score(title, text))


def map_outline(items: DataFrame, pages: DataFrame, infer: bool = True) -> DataFrame:
    """MAP07 over documents: items (doc_id, ord, title, catalog) with page, source and confidence."""

    def make(rows: list[dict], texts: Pages) -> Iterator[tuple]:
        found = map_items([(r["title"] or "", r["catalog"]) for r in rows], texts, 1, infer)
        yield from ((r["ord"], *f) for r, f in zip(rows, found, strict=True))

    return _by_document(items.select("doc_id", "ord", "title", "catalog"), pages, "ord int, page int, source string, confidence double", make)


def map_sections(items: DataFrame, pages: DataFrame) -> DataFrame:
    """MAP11: each section kind of a draft mapped by itself; with the share of its titles found by text."""

    def make(rows: list[dict], texts: Pages) -> Iterator[tuple]:
        for kind in sorted({r["kind"] for r in rows if r["kind"] is not None}):
            part = [r for r in rows if r["kind"] == kind]
            found = map_items([(r["title"] or "", "main" if kind == "main_toc" else kind) for r in part], texts)
            rate = round(sum(s == "title_search" for _, s, _ in found) / len(found), 4)
            yield from ((kind, r["ord"], p, s, rate) for r, (p, s, _) in zip(part, found, strict=True))

    return _by_document(items.select("doc_id", "ord", "title", "kind"), pages, "kind string, ord int, page int, source string, match_rate double", make)


def verify_mapping(items: DataFrame, pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """MAP10: the share of items with a page, less for pages out of order or range, capped where they collapse."""
    w = W.partitionBy(doc).orderBy("ord")
    d = items.where("page is not null").withColumn("down", F.coalesce((F.col("page") < F.lag("page").over(w)).cast("int"), F.lit(0)))
    total = items.groupBy(doc).agg(F.count(F.lit(1)).alias("items"))
    d = d.groupBy(doc).agg(F.count(F.lit(1)).alias("mapped"), F.max("down").alias("down"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.countDistinct("page").alias("unique"))
    d = total.join(d, doc, "left").join(pages.groupBy(doc).agg(F.max("page").alias("last")), doc)
    order, inside = F.coalesce(F.col("down") == 0, F.lit(True)), F.coalesce((F.col("lo") >= 1) & (F.col("hi") <= F.col("last")), F.lit(True))
    ratio = F.coalesce(F.col("mapped") / F.col("items"), F.lit(0.0))
    score = ratio * F.when(order, 1.0).otherwise(0.6) * F.when(inside, 1.0).otherwise(0.6)
    flat = F.coalesce((F.col("mapped") >= 8) & (F.col("unique") <= F.greatest(F.lit(1), F.expr("mapped div 4"))), F.lit(False))
    return d.select(doc, order.alias("monotone"), inside.alias("in_range"), flat.alias("collapsed"), F.round(F.when(flat, F.least(score, F.lit(0.35))).otherwise(score), 4).alias("score"))


_PL = r"[^\p{L}\p{N}]+"
_FORM = lambda x: rf"regexp_replace(lower({x}), '{_PL}', '', 'g')"
_PREFIXED = "CASE ord % 4 WHEN 0 THEN 'Chapter ' || (ord + 1) || ': ' WHEN 1 THEN (ord + 1) || '. ' WHEN 2 THEN '第' || (ord + 1) || '章 ' ELSE '' END"
_STRIP = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '{PREFIXES[0]}', ''), '{PREFIXES[1]}', ''), '{PREFIXES[2]}', '')"
_LONG = f"lt AS (SELECT ti.doc_id, ti.ord, {_PREFIXED} || array_to_string(string_split(text, ' ')[1:9], ' ') AS title FROM ti JOIN pg USING (doc_id, page))"


def long_titles(spark, folder: str) -> DataFrame:
    """Titles of nine words, with prefixes of several kinds, and the pages they are of.

    These are toc_items() joined with the pages: each page as often as its document's id comes, none without an id.
    Without the text, only titles move.
    """
    words = F.array_join(F.slice(F.split("text", " "), 1, 9), " ")
    j = toc_items(spark, folder, "text").where("doc_id is not null").withColumn("title", F.concat(F.expr(_PREFIXED), words))
    same = F.count(F.lit(1)).over(W.partitionBy("doc_id", "page"))
    return j.withColumn("__n", same).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).drop("__n")


@query("fn02_title_form", f"WITH {TOC} SELECT doc_id, ord, {_FORM('title')} AS form FROM ti")
def _fn02(spark, d):
    return toc_items(spark, d).select("doc_id", "ord", title_form(F.col("title")).alias("form"))


@query("fn05_bare", f"WITH {TOC}, {_LONG} SELECT doc_id, ord, {_STRIP('title')} AS bare FROM lt")
def _fn05(spark, d):
    return long_titles(spark, d).select("doc_id", "ord", strip_prefix(F.col("title")).alias("bare"))


_CUT = lambda v: f"CASE WHEN length({v}) <= 18 THEN [{v}] ELSE [{v}[1:18], {v}[1:24], right({v}, 18), {v}[greatest(0, length({v}) // 2 - 9) + 1:greatest(0, length({v}) // 2 - 9) + 18]] END"


@query("map02_fragments", rf"""WITH {TOC}, {_LONG}, f AS (SELECT doc_id, ord, {_FORM('title')} AS n, {_FORM(_STRIP('title'))} AS o FROM lt),
w AS (SELECT doc_id, ord, n, CASE WHEN o <> '' AND o <> n THEN o ELSE regexp_replace(n, '{BARE_PREFIX}', '') END AS s FROM f),
l AS (SELECT doc_id, ord, {_CUT('n')} || {_CUT('s')} AS l FROM w)
SELECT doc_id, ord, array_to_string(list_filter(l, lambda x, i: length(x) >= 4 AND list_position(l, x) = i), '|') AS fragments FROM l""")
def _map02(spark, d):
    return long_titles(spark, d).select("doc_id", "ord", F.array_join(title_fragments(F.col("title")), "|").alias("fragments"))


@query("map01_title_score")
def _map01(spark, d):
    return score_titles(long_titles(spark, d)).select("doc_id", "ord", "score")


@query("map03_segment_score")
def _map03(spark, d):
    j = long_titles(spark, d).withColumn("text", F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")))
    return score_titles(j.withColumn("title", F.regexp_replace("title", " ", " - ")), tiers=segment_score).select("doc_id", "ord", "score")


@query("map04_window_score")
def _map04(spark, d):
    """A letter in five of the title is another one."""
    j = long_titles(spark, d).withColumn("text", F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")))
    return score_titles(j.withColumn("title", F.regexp_replace("title", "e([^e]*)e", "a$1e")), tiers=window_score).select("doc_id", "ord", "score")


@query("map05_marker_page")
def _map05(spark, d):
    def make(rows: list[dict], texts: Pages):
        hits = ((r["ord"], marker_page(r["title"], texts, 1)) for r in rows)
        yield from ((o, *h) for o, h in hits if h)

    pages = page_text(spark, d).withColumn("text", F.concat(F.lit("Chapter "), F.expr("page div 3 + 1"), F.lit("\n"), "text"))
    return _by_document(long_titles(spark, d).select("doc_id", "ord", "title"), pages, "ord int, page int, score double", make)


@query("map06_position")
def _map06(spark, d):
    def make(rows: list[dict], texts: Pages):
        for r in rows:
            if at := position(r["title"], "one line before\n" * (r["ord"] % 3) + texts[r["page"]]):
                yield r["ord"], *at

    return _by_document(long_titles(spark, d).select("doc_id", "ord", "title", "page"), page_text(spark, d), "ord int, line int, at int, near_top boolean", make)


@query("map07_mapper")
def _map07(spark, d):
    t = long_titles(spark, d).withColumn("catalog", F.expr("if(ord % 5 = 4, 'table', 'main')"))
    return map_outline(t, page_text(spark, d))


@query("map09_skeleton")
def _map09(spark, d):
    def make(rows: list[dict], texts: Pages):
        strategy, quality, pages = map_skeleton([(r["title"], None) for r in rows], texts)
        yield from ((r["ord"], p, strategy, quality) for r, p in zip(rows, pages, strict=True))

    return _by_document(toc_items(spark, d).select("doc_id", "ord", "title"), page_text(spark, d), "ord int, page int, strategy string, quality double", make)


@query("map10_verify", f"""WITH {TOC}, m AS (SELECT doc_id, ord, CASE WHEN ord % 4 <> 3 THEN CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 AND ord = 2 THEN page - 5 ELSE page END END AS page FROM ti),
o AS (SELECT *, coalesce((page < lag(page) OVER (PARTITION BY doc_id ORDER BY ord))::INT, 0) AS down FROM m WHERE page IS NOT NULL),
a AS (SELECT doc_id, count(*) AS mapped, max(down) AS down, min(page) AS lo, max(page) AS hi, count(DISTINCT page) AS u FROM o GROUP BY 1),
t AS (SELECT doc_id, count(*) AS items FROM ti GROUP BY 1), l AS (SELECT doc_id, max(page) AS last FROM pg GROUP BY 1),
s AS (SELECT *, coalesce(down = 0, true) AS monotone, coalesce(lo >= 1 AND hi <= last, true) AS in_range, coalesce(mapped >= 8 AND u <= greatest(1, mapped // 4), false) AS collapsed FROM t LEFT JOIN a USING (doc_id) JOIN l USING (doc_id)),
k AS (SELECT *, coalesce(mapped / items, 0) * CASE WHEN monotone THEN 1.0 ELSE 0.6 END * CASE WHEN in_range THEN 1.0 ELSE 0.6 END AS s0 FROM s)
SELECT doc_id, monotone, in_range, collapsed, round(CASE WHEN collapsed THEN least(s0, 0.35) ELSE s0 END, 4)::DOUBLE AS score FROM k""")
def _map10(spark, d):
    page = F.expr("if(ord % 4 != 3, case when doc_id % 3 = 0 then 1 when doc_id % 3 = 1 and ord = 2 then page - 5 else page end, null)")
    return verify_mapping(toc_items(spark, d).withColumn("page", page), page_text(spark, d))


@query("map11_sections")
def _map11(spark, d):
    t = toc_items(spark, d).withColumn("kind", F.expr("if(ord % 3 = 2, 'table_catalog', 'main_toc')"))
    return map_sections(t, page_text(spark, d))


@query("map13_overrides")
def _map13(spark, d):
    def make(rows: list[dict], texts: Pages):
        found = override_printed([(r["title"], "main", r["page"] + 1) for r in rows], texts)
        yield from ((r["ord"], *f) for r, f in zip(rows, found, strict=True))

    return _by_document(long_titles(spark, d).select("doc_id", "ord", "title", "page"), page_text(spark, d), "ord int, page int, source string, confidence double", make)
