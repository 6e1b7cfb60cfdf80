"""Operator 9, byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until a leaf is short, leaves are encoded, and neighbours joined up
the tree. A join re-encodes a window round the boundary that grows on either side
until it ends at a sync point, white space that follows a letter or digit, and the
tokens of the halves have a boundary there too. No match of the pattern runs over a
sync point, as all its alternatives admit white space only where they begin or are
nothing else; and what matches from there on does not depend on what came before. So
both encodings break there and tokens outside the window are those of the whole text.
A window that finds none grows to the end of its side, so joins are exact for texts
without white space too.

Joining is associative with the empty text as its unit, whence the tree. Decoding
concatenates the bytes of halves.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load
from .common import slices, without

#: Characters of a leaf, and of a join's first window on either side.
LEAF, WINDOW = 512, 64
_SYNC = re.compile(r"(?<=[^\W_])[ \n]")


class TreeCodec:
    """Encoder and decoder for one vocabulary: ``ranks`` is the text of a .tiktoken file."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self._plain = tiktoken.Encoding("leaf", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._width = {i: len(b) for b, i in table.items()}
        self._leaf = leaf

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self._leaf:
            return self._plain.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """The tokens of text[lo:hi], from those of its halves."""
        size = WINDOW
        while True:
            start, end = self._before(text, lo, mid, size), self._after(text, mid, hi, size)
            size *= 2
            if start is None or end is None:
                continue
            drop = len(left) if start == lo else self._covering(reversed(left), text[start:mid])
            skip = len(right) if end == hi else self._covering(right, text[mid:end])
            if drop is not None and skip is not None:
                return left[: len(left) - drop] + self._plain.encode_ordinary(text[start:end]) + right[skip:]

    def _covering(self, ids, part: str) -> int | None:
        """How many of ``ids`` are the bytes of ``part``; None where no token ends with it."""
        need = len(part.encode("utf-8", "surrogatepass"))
        n = 0
        for i in ids:
            if need <= 0:
                break
            need -= self._width[i]
            n += 1
        return n if need == 0 else None

    @staticmethod
    def _before(text: str, lo: int, mid: int, size: int) -> int | None:
        """The last sync point in ``size`` characters before ``mid``, or ``lo`` where these reach it."""
        if mid - size <= lo:
            return lo
        found = None
        for found in _SYNC.finditer(text, mid - size, mid):
            pass
        return found.start() if found and found.start() > mid - size else None

    @staticmethod
    def _after(text: str, mid: int, hi: int, size: int) -> int | None:
        """The first sync point after ``mid``, past one of the right half's own characters, or ``hi``."""
        if mid + size >= hi:
            return hi
        found = _SYNC.search(text, mid + 1, mid + size)
        return found.start() if found else None

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self._leaf:
            return self._plain.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """The ranks file at ``path`` and its pattern; by default the public 50k byte-level one."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


_codecs: dict = {}


def codec_of(shared) -> TreeCodec:
    """A worker's codec for a broadcast vocabulary, made once."""
    ranks, pattern = shared.value
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = TreeCodec(ranks, pattern)
    return _codecs[key]


def _mapped(df: DataFrame, fields: list[tuple[str, str, pa.DataType]], path: str | None, one) -> DataFrame:
    """``df`` with ``fields``, made by ``one(codec, value)`` from its first column of the call."""
    df = without(df, *[f[0] for f in fields])
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))  # a file of about 1 MB, whatever the corpus
    name = df.columns.index(one.reads)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for b in slices(batches, 128):
            rows = [one(codec, v) for v in b.column(name).to_pylist()]
            made = [pa.array([r[j] for r in rows], f[2]) for j, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*names, *[f[0] for f in fields]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"{n} {t}" for n, t, _ in fields)])
    return df.mapInArrow(run, schema)


def _reads(column: str, f):
    f.reads = column
    return f


def encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with ``ids`` and ``n_tokens``; null and empty texts have no tokens.

    Texts of any length are encoded whole. Rows are independent, so repeated ones have
    equal results, and an empty table gives no rows. The table's other columns stay, but
    for those named as the results.
    """
    fields = [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "long", pa.int64())]
    return _mapped(df, fields, path, _reads(text, lambda c, t: (x := c.encode(t or ""), len(x))))


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the bytes of an array of ids; null ids give no bytes, an empty table no rows."""
    return _mapped(df, [("decoded", "binary", pa.binary())], path, _reads(ids, lambda c, x: (c.decode(x or []),)))


def digest(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the digests of its texts' ids and of the bytes these decode to; rows as for :func:`encode`."""

    def one(codec: TreeCodec, value: str | None) -> tuple:
        ids = codec.encode(value or "")
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(df, fields, path, _reads(text, one))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as digests."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
