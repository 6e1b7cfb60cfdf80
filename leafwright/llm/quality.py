"""Operator 5, quality rules: distribution divergence against language references.

Two histograms of a document, of its characters' classes and of the common words
among its words, are compared with those of its language by the Jensen-Shannon
distance (base 2, so from 0 to 1). A document far from its language goes. Guards leave
the verdict out where a text is too short to have a shape. A language's reference is
the sum over all its documents that the base rules pass.

The base rules stand before it: too few words, or too many in repeated windows. Texts
are read once: counts and histograms are written as a table, from which references
and verdicts follow.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_stage
from ..sources.tables import load
from .common import fresh, slices, without

# Frequent function words of the languages that have a reference.
COMMON = {
    "en": "the of and to in a is that it for on was as with be by are this at from or an have not he his but which they you were all has had".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
#: Characters of symbols, as the base rule counts them.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
#: Guards: the fewest characters, and words, whose histogram is judged.
MIN_CHARS, MIN_HIST_WORDS = 200, 60
#: Farthest from the reference that a document stays: the labelled clean documents at sf0.1 lie within 0.31 and 0.46
#: (99 in 100 within 0.16 and 0.31), most labelled junk beyond 0.33 in one of the two.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.33, 0.5

#: Accented letters are Latin ones beyond ASCII, and foreign those of other scripts.
CLASSES = "lower upper accented foreign digit space newline point symbol other".split()
_INDEX = {w: i for i, w in enumerate(WORDS)}
_STRIP = ".,;:!?\"'()"
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def char_class(c: str) -> int:
    """The index in ``CLASSES`` of a character."""
    kind = unicodedata.category(c)
    if c in "#*$%&|<>=+/\\^_~`@[]{}":
        return 8
    if c == "\n":
        return 6
    if c.isascii() and c.isalpha():
        return 0 if c.islower() else 1
    if kind[0] in "LM":
        return 2 if "LATIN" in unicodedata.name(c, "") or kind == "Mn" else 3
    if kind[0] == "N":
        return 4
    if c in "\t\v\f\r" or kind[0] == "Z":
        return 5
    return 7 if kind[0] == "P" else 9


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    return np.array([9 if 0xD800 <= i < 0xE000 else char_class(chr(i)) for i in range(0x10000)], np.int8)


def char_classes(text: str) -> np.ndarray:
    """Counts of the character classes; what lies beyond the basic plane is foreign or other."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    basic = codes < 0x10000
    counts = np.bincount(_table()[codes[basic]], minlength=len(CLASSES))
    for c, n in zip(*np.unique(codes[~basic], return_counts=True), strict=True):
        counts[char_class(chr(c))] += n
    return counts


def common_words(words: list[str]) -> np.ndarray:
    """Counts of the common words, then of all others, and last of words without a letter or digit."""
    counts = np.zeros(len(WORDS) + 2, np.int64)
    for w, n in Counter(words).items():
        at = _INDEX.get(w.strip(_STRIP).lower(), -1)
        if at < 0:
            at = len(WORDS) + (not any(map(str.isalnum, w)))
        counts[at] += n
    return counts


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    width = 1
    while width < window:  # ids of windows twice as wide, exactly
        step = min(width, window - width)
        pairs = ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        width += step
    again = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
    lines = [x for x in text.split("\n") if _SPACE.sub("", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        words,
    )


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean".split(", ")
_NAMES = [*(f.split()[0] for f in _FIELDS), "char_distance", "word_distance", "kept"]
_KINDS = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), *[pa.list_(pa.int32())] * 2]


def profile(text: str | None) -> tuple:
    """The base fields of a text, its code points, and its two histograms; null is read as empty."""
    text = text or ""
    n, chars, symbols, lines, repeated, words = base_counts(text)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    return n, chars, symbols, lines, repeated, failed, len(text), char_classes(text), common_words(words)


def js_distance(p: str, q: str) -> Column:
    """The square root of the Jensen-Shannon divergence, in bits, of a histogram of counts ``p`` and shares ``q``."""
    total = f"aggregate({p}, 0L, (s, x) -> s + x)"
    part = "if(x > 0, x * log2(2 * x / (x + y)), 0D) + if(y > 0, y * log2(2 * y / (x + y)), 0D)"
    sums = f"aggregate(zip_with(transform({p}, v -> v / n), {q}, (x, y) -> {part}), 0D, (s, x) -> s + x)"
    far = f"transform(array({total}), n -> sqrt(greatest(0D, {sums} / 2)))[0]"
    return F.expr(f"if({total} > 0 and exists({q}, y -> y > 0), {far}, 0D)")


def references(profiled: DataFrame, lang: str, failed: str, bins: dict[str, int]) -> DataFrame:
    """A row for each language: for each of the histograms ``bins`` the shares of its sum over the rows that have not ``failed``.

    The languages are those of ``COMMON`` and one for all others: a handful of rows of fixed length.
    Bins are summed as rows, so that the plan does not grow with their number.
    """
    passed = profiled.where(~F.col(failed)).select(F.col(lang).alias("language"), F.posexplode(F.concat(*bins)).alias("bin", "count"))
    sums = passed.where("count > 0").groupBy("language", "bin").agg(F.sum("count").alias("count"))
    refs = sums.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("sums"))

    def share(first: int, n: int) -> Column:
        counts = F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: F.coalesce(F.col("sums")[i], F.lit(0)))
        whole = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c), F.lit(1)).cast("double")
        return F.transform(counts, lambda c: c / whole)

    firsts = accumulate(bins.values(), initial=0)
    shares = [share(first, n).alias(f"{h}_shares") for first, (h, n) in zip(firsts, bins.items(), strict=False)]
    return refs.select("language", *shares)


def score_quality(df: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """``df`` with the base counts, both distances and ``kept``; without ``keep_text`` less its texts.

    Null and empty texts fail the base rules. A null or unknown language is compared
    with the documents of such languages. Distances are null under the guards, and 0
    where a language has no document that passes the base rules. Repeated rows count
    as often as they come; texts of any length are read whole. An empty table gives no
    rows.
    """
    df = without(df, *_NAMES)
    language, length, chars, words = fresh(df, "__language", "__length", "__chars", "__words")
    names = df.columns
    at = names.index(text)
    stay = [i for i in range(len(names)) if keep_text or i != at]
    made = [*(f.split()[0] for f in _FIELDS), length, chars, words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [profile(t) for t in b.column(at).to_pylist()]
            arrays = [pa.array([r[j] for r in rows], t) for j, t in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in stay), *arrays], [*(names[i] for i in stay), *made])

    fields = [df.schema.fields[i] for i in stay]
    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *_FIELDS, f"{length} long", f"{chars} array<int>", f"{words} array<int>"]
    profiled = df.mapInArrow(run, ", ".join(schema))
    d = write_stage(profiled.withColumn(language, F.when(F.col(lang).isin(*COMMON), F.col(lang)).otherwise("other")), "profiles")
    refs = references(d, language, "base_failed", {chars: len(CLASSES), words: len(WORDS) + 2})
    d = d.join(F.broadcast(refs), F.col(language) == F.col("language"), "left")
    far = lambda h, q, enough: F.when(enough, F.coalesce(js_distance(h, q), F.lit(0.0)))
    d = d.withColumn("char_distance", far(chars, f"{chars}_shares", F.col(length) >= MIN_CHARS))
    d = d.withColumn("word_distance", far(words, f"{words}_shares", F.col("n_words") >= MIN_HIST_WORDS))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    d = d.withColumn("kept", ~F.col("base_failed") & near)
    return d.select(*(names[i] for i in stay), *_NAMES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged; see :func:`score_quality`."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score_quality(docs, keep_text=False).select("doc_id", *_NAMES)
