"""Turn ids: ``D<session>:<turn>`` in all the ways people write it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that show nothing: spaces of any script, controls, zero-width marks.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}]"
_FULL_WIDTH = "".join(chr(0xFF10 + i) for i in range(10))


def is_blank(text: Column) -> Column:
    """True for null and for text without a visible character."""
    return F.coalesce(F.length(F.regexp_replace(text, INVISIBLE, "")) == 0, F.lit(True))


def turn_numbers(text: Column) -> Column:
    """``struct<session bigint, turn bigint>`` named by an id, null if it names none.

    Read are two numbers with something that is neither letter nor digit between them, with or
    without a leading D, in any case, spacing, separator or digit width. Numbers beyond 18 digits
    count as unreadable.
    """
    seen = F.translate(text, _FULL_WIDTH, "0123456789")
    pattern = r"^[^\p{L}\p{N}]*(?:[DdＤｄ][^\p{L}\p{N}]*)?([0-9]{1,18})[^\p{L}\p{N}]+([0-9]{1,18})[^\p{L}\p{N}]*$"
    session = F.regexp_extract(seen, pattern, 1)
    turn = F.regexp_extract(seen, pattern, 2)
    return F.when(
        session != "",
        F.struct(session.try_cast("bigint").alias("session"), turn.try_cast("bigint").alias("turn")),
    )
