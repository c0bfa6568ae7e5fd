"""Text functions as column expressions; Python only where the engine has no function (NFKC)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from dialoom.functions import rules


def strip(x: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squashed(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def signature(x: Column) -> Column:
    """Lower-case squashed text; null counts as empty."""
    return F.lower(squashed(F.coalesce(x, F.lit(""))))


def has_any(text: Column, marks: Iterable[str]) -> Column:
    """The lower-case text contains one of the marks; null contains none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(low, F.lit(mark))
    return found


def level_label(x: Column, fallback: str | None = None) -> Column:
    """'Level n' of any text that names a level 0 to 3, else the fallback."""
    digit = F.regexp_extract(F.lower(x), r"level\D*([0-3])", 1)
    return F.when(digit != "", F.concat(F.lit("Level "), digit)).otherwise(F.lit(fallback))


def _looked_up(x: Column, aliases: dict[str, str]) -> Column:
    out = x
    for key, value in aliases.items():
        out = F.when(x == key, F.lit(value)).otherwise(out)
    return out


def reasoning(x: Column) -> Column:
    """Lower case, separators as -, known other names replaced; null stays null."""
    plain = F.translate(F.lower(strip(x)), "_ ", "--")
    return _looked_up(plain, {k: v for k, v in rules.REASONING_ALIASES.items() if "_" not in k})


def enum_token(x: Column, fallback: str | None, aliases: dict[str, str] | None = None) -> Column:
    """Token of an enum entry: lower case, words joined by _; blank and null give the fallback."""
    words = F.regexp_replace(F.translate(F.lower(strip(x)), "-_", "  "), r"(?U)\s+", " ")
    token = F.replace(_looked_up(words, aliases or {}), F.lit(" "), F.lit("_"))
    return F.when(x.isNull() | (strip(x) == ""), F.lit(fallback)).otherwise(token)


def leak_labels(x: Column) -> Column:
    """Labels of the rules by which a voice description gives the hidden state away, in order."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(x, F.lit("")).rlike(rf"(?i)\b({words})\b"), F.lit(label)) for label, words in rules.LEAK_RULES.items()])
    )


def unmangled(x: Column) -> Column:
    """Damaged characters put right (before compatibility normalisation)."""
    for bad, good in rules.MOJIBAKE:
        x = F.replace(x, F.lit(bad), F.lit(good))
    return x


@F.pandas_udf(StringType())
def nfkc(batch: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, which the engine lacks."""
    return batch.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _finished_voice(y: Column) -> Column:
    """Fallback wording and tidied commas and blanks."""
    for pattern, to in rules.VOICE_FALLBACK:
        y = F.regexp_replace(y, "(?i)" + pattern, to)
    y = F.regexp_replace(y, r"(?i)\ba hint of\b", "")
    y = F.regexp_replace(y, r"(?i)\bslight\b", "slightly")
    y = F.regexp_replace(F.regexp_replace(y, r"\s+,", ","), r",\s*,", ", ")
    return F.regexp_replace(F.regexp_replace(y, r"\s{2,}", " "), r"^[ ,]+|[ ,]+$", "")


def with_voice_reworded(rows: DataFrame, column: str, rewording: Iterable[tuple[str, str]] = tuple(rules.VOICE_REWORDING)) -> DataFrame:
    """The rows with a voice description reworded by ordered rules, whole words in any case.

    A rule that cannot apply costs a look only; the fallback wording runs a second time where the first
    still leaks. Each pass is a projection of its own, so that no rule is evaluated twice.
    """
    x = F.col(column)
    for words, to in rewording:
        x = F.regexp_replace(x, rf"(?i)\b{words}\b", to)
    once = rows.withColumn("__once", _finished_voice(x))
    again = once.withColumn("__leaks", F.size(leak_labels(F.col("__once"))) > 0)
    return again.withColumn(column, F.when(F.col("__leaks"), _finished_voice(F.col("__once"))).otherwise(F.col("__once"))).drop("__once", "__leaks")


def slug(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z0-9_-]+", "-"), r"^-+|-+$", ""))


def event_slug(x: Column, fallback: str = "event") -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(plain == "", F.lit(fallback)).otherwise(plain)


def safe_name(x: Column) -> Column:
    """Name for a folder: other than letters, digits, - and _ become _."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "_")


def short_hash(*parts: Column, length: int = 12) -> Column:
    joined = F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha1(F.encode(joined, "UTF-8")), 1, length)


def shortened(x: Column, limit: int = 240) -> Column:
    flat = squashed(F.coalesce(x, F.lit("")))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def options_block(options: Column) -> Column:
    """'A. first' and so on, one a line; empty for no options, a null option is written None."""
    lines = F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), F.coalesce(x, F.lit("None"))))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def answer_key(x: Column) -> Column:
    """Comparable form of an answer: fences and option letters off, JSON answers unpacked, squashed."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(strip(x), r"(?i)^```(?:json)?", "")), r"```$", ""))
    readable = F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull()
    inner = F.when(readable, F.coalesce(F.get_json_object(bare, "$.answer"), bare)).otherwise(bare)
    return F.lower(squashed(F.regexp_replace(inner, r"^[A-Z][).:\-]\s*", "")))


def utc_time(x: Column) -> Column:
    """Timestamp (without zone, UTC) of an ISO text; one without offset counts as UTC, other text is null."""
    local = F.replace(F.substring(x, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    offset = F.regexp_extract(x, "([+-][0-9]{2}:[0-9]{2})$", 1)
    minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int")
    shift = F.make_dt_interval(mins=F.when(offset == "", 0).otherwise(F.when(F.startswith(offset, F.lit("-")), -minutes).otherwise(minutes)))
    return F.when(x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"), local - shift)


def tokens(x: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-case text."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def judge_scores(x: Column) -> Column:
    """The judge's partial scores as struct; what cannot be read counts as zero with verdict parse_error."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(strip(x), r"(?i)^```(?:json)?", "")), r"```$", ""))
    names = [*rules.JUDGE_WEIGHTS, "final_score"]
    readable = F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull()
    fields = [F.when(readable, F.coalesce(F.get_json_object(bare, f"$.{n}").try_cast("double"), F.lit(0.0))).otherwise(0.0).alias(n) for n in names]
    verdict = F.when(readable, F.coalesce(F.get_json_object(bare, "$.verdict"), F.lit("unknown"))).otherwise("parse_error")
    return F.struct(*fields, verdict.alias("verdict"))
