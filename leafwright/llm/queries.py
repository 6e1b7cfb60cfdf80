"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_bpe
from .chat import op3_chat
from .fingerprints import op6_fingerprints
from .licenses import op2_licenses
from .mixing import OP8_SQL, op8_mixing
from .neardup import OP4_SQL, op4_neardup
from .pii import op7_pii
from .quality import op5_quality
from .secrets import OP10_SQL, op10_secrets
from .sharding import op1_sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_licenses, op3_chat, op4_neardup, op5_quality, op6_fingerprints, op7_pii, op8_mixing, op9_bpe, op10_secrets)
}

ORACLES: dict[str, str] = {"op4_neardup": OP4_SQL, "op8_mixing": OP8_SQL, "op10_secrets": OP10_SQL}
