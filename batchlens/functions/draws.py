"""Reproducible draws: a hash of what a row *is*, never of where it lies.

``rand(seed)`` depends on the partition a row happens to sit in, so it changes
with the cluster, a repartition or a retried task.  These draws do not, and the
same digits come out of any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 4294967296  # 2^32: eight hex digits


def hash_text(*parts) -> Column:
    """md5, in hex, of the parts joined by ``|``; non-columns are literals."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def _word(digest: Column, index: int) -> Column:
    return F.conv(F.substring(digest, 8 * index + 1, 8), 16, 10).cast("bigint")


def uniform_draw(*parts) -> Column:
    """A number in [0, 1)."""
    return _word(hash_text(*parts), 0) / F.lit(float(_WORD))


def gaussian_draw(*parts) -> Column:
    """A standard normal number, from two words of the hash (Box and Muller)."""
    digest = hash_text(*parts)
    a = (_word(digest, 0) + 1) / F.lit(float(_WORD + 1))
    b = (_word(digest, 1) + 1) / F.lit(float(_WORD + 1))
    return F.sqrt(F.lit(-2.0) * F.ln(a)) * F.cos(F.lit(2.0) * F.pi() * b)
