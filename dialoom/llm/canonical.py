"""Free entries mapped to a canonical list: a partition-based pigeonhole join, in SQL only.

Reference strings come from the canonical list itself. The canonical spelling of each value and parts of
its name, in their order, are some; others are derived from its words and those of its description: parts
of the name in any rotation, its first words as initials, pairs of words of name and description, all cut
to their first 3 to 5 letters, with up to two words replaced by a word of the same meaning
(``THESAURUS``, a parameter, may be empty). A derived string that two values of a field share stands for
neither.

Entries are brought to a compact form (look-alike letters, decorations and separators removed). A
reference string of length L may be written with up to k(L) edits; cut into k + 1 segments, at least
one segment stands unchanged in the entry, shifted by at most k. So both sides join on equality of
(field, L, segment number, segment text), and only those few candidates are verified with
``levenshtein``. Entries that are near no spelled name meet the derived strings in the same way, with
their words cut to 5 letters and fewer edits allowed. What no candidate verifies is found by
anti-join and kept as 'unmatched'. All of it works on distinct entries, counted before the shuffle and
written once; values that are canonical already take part in no join.

Defined cases: null and blank entries, and exact canonical values, give no row; ties go to the
smaller distance, then to the name first in order; a null description adds no words; an empty
reference list leaves everything unmatched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dialoom.session import checkpoint

FIELDS = ("reasoning_structure", "question_type", "content_type")

#: Words of the same meaning, one for one (a parameter; recall without it is in the README).
THESAURUS = [
    ("implicit", "hidden"), ("long", "old"), ("long", "distant"), ("near", "recent"), ("emotion", "feeling"), ("instant", "now"), ("instant", "current"),
    ("direct", "immediate"), ("direct", "straight"), ("trajectory", "evolution"), ("choose", "choice"), ("retrieval", "recall"), ("alone", "only"), ("removed", "no"),
    ("multi", "many"), ("multi", "several"), ("multi", "n"), ("multi", "2"), ("multi", "two"), ("single", "one"), ("single", "1"), ("no", "zero"), ("no", "0"), ("step", "hop"), ("hop", "step"),
]
#: Words that tell nothing about which value is meant.
FILLERS = ("a", "an", "the", "of", "or", "to", "in", "at", "and", "also", "that", "has", "be", "each", "other", "from", "given", "between", "over", "time", "right", "question", "call", "form")

#: Letters drawn alike, one for one (fixed values).
LOOKALIKES = ("аеорсхуіѕјкмтвнáàâäãåéèêëíìîïóòôöõúùûüñçýοαειρυκντ０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
              "aeopcxyisjkmtbhaaaaaaeeeeiiiiooooouuuuncyoaeipukvt0123456789abcdefghijklmnopqrstuvwxyz")
INVISIBLE = r"[\\s\\p{Z}\\p{Cc}\\p{Cf}]"

#: Edits allowed by length: of a canonical spelling, and of a derived one.
ALLOWED = "CASE WHEN {L} <= 2 THEN 0 WHEN {L} <= 3 THEN 1 WHEN {L} <= 7 THEN 2 WHEN {L} <= 9 THEN 3 WHEN {L} <= 24 THEN 4 ELSE 6 END"
ALLOWED_DERIVED = "CASE WHEN {L} <= 4 THEN 0 WHEN {L} <= 7 THEN 1 WHEN {L} <= 12 THEN 2 ELSE 3 END"
#: Letters to which words are cut, and the most edits any length allows.
CUTS, CUT, MOST, SPREAD = (3, 4, 5), 5, 6, 16

#: What the plain form leaves out, in order: (pattern, replacement with $1 for its group).
PLAIN_RULES = [
    (r"\p{Cf}", ""),
    (r"^[^a-z0-9]*(type|prob|probably|maybe|perhaps|likely|class|category|label|value)[ ]*[.:=]+[ ]*", ""),
    (r"[ ]*[(\[]?(checked|verified|reviewed|confirmed|v[0-9]+)[)\]]?[^a-z0-9]*$", ""),
    (r"([a-z])0", "$1o"),
    (r"0([a-z]{2})", "o$1"),
]


def plain(x: str) -> str:
    """SQL of the plain form: lower case, look-alikes folded, marks and remarks of annotators removed."""
    out = f"translate(lower({x}), '{LOOKALIKES[0]}', '{LOOKALIKES[1]}')"
    for pattern, to in PLAIN_RULES:
        out = "regexp_replace({}, '{}', '{}')".format(out, pattern.replace("\\", "\\\\"), to)
    return out


def _words(x: str) -> str:
    """Words without plural ends and fillers; a filler of 4 letters or more may be misspelt by an edit for each 4."""
    fillers = f"array({', '.join(map(repr, FILLERS))})"
    known = f"exists({fillers}, f -> if(length(f) < 4, w = f, levenshtein(w, f) <= length(f) div 4))"
    return f"transform(filter(split({x}, '[^a-z0-9]+'), w -> w <> '' AND NOT {known}), w -> if(length(w) > 3, regexp_replace(w, 's$', ''), w))"


def _braced(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")


_FORMS = f"""
SELECT field_name, entry, array_join(words, '') AS form, array_join(transform(words, w -> substring(w, 1, {CUT})), '') AS short
FROM (SELECT field_name, entry, {_words("plain")} AS words FROM (SELECT field_name, entry, {_braced(plain("entry"))} AS plain FROM {{entries}}))
"""

_NAMED = f"""
WITH named AS (
  SELECT field_name, canonical_value, {_words("lower(canonical_value)")} AS name, {_words("lower(coalesce(description, ''))")} AS about FROM {{canon}}
), names AS (
  SELECT field_name, canonical_value, name AS seq FROM named
  UNION ALL
  SELECT field_name, canonical_value, concat(array(concat(substring(get(name, 0), 1, 1), substring(get(name, 1), 1, 1))), slice(name, 3, size(name)))
  FROM named WHERE size(name) >= 3
), parts AS (
  SELECT field_name, canonical_value, filter(seq, (w, i) -> shiftright(m, i) % 2 = 1) AS seq
  FROM (SELECT *, explode(sequence(1, shiftleft(1, least(size(seq), 12)) - 1)) AS m FROM names WHERE size(seq) > 0)
  UNION ALL SELECT field_name, canonical_value, seq FROM names
)"""  # fmt: skip
_UNIQUE = "SELECT field_name, min(canonical_value) AS canonical_value, form FROM {made} WHERE length(form) >= 3 GROUP BY field_name, form HAVING count(DISTINCT canonical_value) = 1"



def _replaced(source: str) -> str:
    """Common table ``twice``: sequences of ``source`` with none to two words replaced ({same} maps words to others)."""
    others = "flatten(transform(seq, w -> transform(coalesce({same}[w], array()), o -> transform(seq, v -> if(v = w, o, v)))))"
    step = f"SELECT field_name, canonical_value, about, explode(concat(array(seq), {others})) AS seq"
    # few rows that become many: spread before, so that no task does it all
    return f"once AS ({step} FROM (SELECT /*+ REPARTITION({SPREAD}) */ * FROM {source})), twice AS ({step} FROM once)"


def _map(pairs: list[tuple[str, str]]) -> str:
    """SQL of the map from each word to the words that may stand for it."""
    others: dict[str, list[str]] = {}
    for word, other in pairs:
        others.setdefault(word, []).append(other)
    return "map(" + ", ".join(f"'{w}', array({', '.join(map(repr, os))})" for w, os in others.items()) + ")" if others else "CAST(map() AS map<string, array<string>>)"


#: Parts of names in their order, written out, that stand for one value alone.
_PARTS = f"""{_NAMED}, plainly AS (SELECT field_name, canonical_value, 0 AS about, seq FROM parts), {_replaced("plainly")}
, made AS (SELECT field_name, canonical_value, array_join(seq, '') AS form FROM twice) {_UNIQUE.format(made="made")}"""

#: Strings derived from a value's name and description, words cut, that stand for it alone.
_DERIVED = f"""{_NAMED}, phrases AS (
  SELECT field_name, canonical_value, seq, 0 AS about FROM parts
  UNION ALL
  SELECT field_name, canonical_value, slice(about, i + 1, 3), 1 FROM (SELECT *, explode(sequence(0, size(about) - 3)) AS i FROM named WHERE size(about) >= 3)
), rotated AS (
  SELECT DISTINCT field_name, canonical_value, about, concat(slice(seq, r + 1, size(seq)), slice(seq, 1, r)) AS seq
  FROM (SELECT *, explode(sequence(0, size(seq) - 1)) AS r FROM phrases WHERE size(seq) > 0)
), related AS (
  SELECT field_name, canonical_value, explode(about) AS x, array_union(name, about) AS others FROM named
), sequences AS (
  SELECT field_name, canonical_value, about, seq FROM rotated
  UNION SELECT field_name, canonical_value, 1, array(x) FROM related
  UNION SELECT field_name, canonical_value, 1, array(x, y) FROM (SELECT *, explode(others) AS y FROM related) WHERE x <> y
  UNION SELECT field_name, canonical_value, 1, array(y, x) FROM (SELECT *, explode(others) AS y FROM related) WHERE x <> y
), {_replaced("sequences")}, cut AS (
  SELECT DISTINCT field_name, canonical_value, array_join(transform(seq, w -> substring(w, 1, c)), '') AS form
  FROM (SELECT *, explode(slice(array{CUTS}, 1 + about, 3)) AS c FROM twice)
)
{_UNIQUE.format(made="cut")}"""  # fmt: skip


def _near(allowed: str) -> str:
    """(field_name, form, best) of the forms within the allowed edits of a reference string; best is (distance, canonical_value)."""
    return f"""
WITH sized AS (
  SELECT *, length(form) AS size, {allowed.format(L="length(form)")} AS k FROM {{accepted}}
), segments AS (
  SELECT field_name, canonical_value, form, size, k, i,
         substring(form, i * size div (k + 1) + 1, (i + 1) * size div (k + 1) - i * size div (k + 1)) AS segment
  FROM (SELECT *, explode(sequence(0, k)) AS i FROM sized)
), lengths AS (
  SELECT field_name, form, size, k FROM (
    SELECT field_name, form, size, {allowed.format(L="size")} AS k
    FROM (SELECT field_name, form, explode(sequence(greatest(length(form) - {MOST}, 1), length(form) + {MOST})) AS size FROM {{forms}})
  ) WHERE abs(length(form) - size) <= k
), probes AS (
  SELECT DISTINCT field_name, form, size, i, substring(form, start + shift, width) AS segment FROM (
    SELECT field_name, form, size, i, i * size div (k + 1) + 1 AS start,
           (i + 1) * size div (k + 1) - i * size div (k + 1) AS width, explode(sequence(-k, k)) AS shift
    FROM (SELECT *, explode(sequence(0, k)) AS i FROM lengths)
  ) WHERE start + shift >= 1 AND start + shift + width - 1 <= length(form)
), candidates AS (
  SELECT DISTINCT p.field_name, p.form, s.canonical_value, s.form AS accepted, s.k
  FROM probes p JOIN segments s ON p.field_name = s.field_name AND p.size = s.size AND p.i = s.i AND p.segment = s.segment
)
SELECT field_name, form, min(struct(levenshtein(form, accepted, k) AS distance, canonical_value)) AS best
FROM candidates WHERE levenshtein(form, accepted, k) >= 0 GROUP BY field_name, form
"""  # fmt: skip


def strange_entries(spark: SparkSession, qa: DataFrame, canon: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(qa_key, field_name, entry): the fields in long form, without blank and canonical entries.

    The canonical list is one that people write (tens of rows), so it goes to every task.
    """
    pairs = ", ".join(f"'{f}', {f}" for f in fields)
    return spark.sql(
        f"""SELECT /*+ BROADCAST(c) */ l.* FROM (SELECT qa_key, stack({len(fields)}, {pairs}) AS (field_name, entry) FROM {{qa}}) l
        LEFT ANTI JOIN {{canon}} c ON l.field_name = c.field_name AND l.entry = c.canonical_value
        WHERE l.entry IS NOT NULL AND regexp_replace(l.entry, '{_braced(INVISIBLE)}', '') <> ''""",
        qa=qa,
        canon=canon,
    )


def resolve_entries(spark: SparkSession, strange: DataFrame, canon: DataFrame, thesaurus: list[tuple[str, str]] | None = None) -> DataFrame:
    """(field_name, entry, canonical_value) of each distinct entry."""
    run = lambda sql, **tables: spark.sql(sql, **tables)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the probes are many for each form: no fewer tasks than that
    forms = checkpoint(run(_FORMS, entries=strange.select("field_name", "entry").distinct()))
    same = _map(THESAURUS if thesaurus is None else thesaurus)
    plainly = run(f"SELECT DISTINCT field_name, canonical_value, array_join({_words('lower(canonical_value)')}, '') AS form FROM {{canon}}", canon=canon)
    whole = forms.where("form <> ''").select("field_name", "form").distinct().repartition(parts, "form")
    near = checkpoint(run(
        "SELECT field_name, form, min_by(best.canonical_value, struct(best.distance, derived, best.canonical_value)) AS canonical_value FROM (SELECT *, 0 AS derived FROM {a} UNION ALL SELECT *, 1 FROM {b}) GROUP BY field_name, form",
        a=run(_near(ALLOWED), accepted=plainly, forms=whole), b=run(_near(ALLOWED_DERIVED), accepted=run(_PARTS.replace("{same}", same), canon=canon), forms=whole),
    ))
    rest = checkpoint(run("SELECT f.* FROM {forms} f LEFT ANTI JOIN {near} n ON f.field_name = n.field_name AND f.form = n.form", forms=forms, near=near))
    short = rest.where("short <> ''").selectExpr("field_name", "short AS form").distinct().repartition(parts, "form")
    derived = run(_near(ALLOWED_DERIVED), accepted=run(_DERIVED.replace("{same}", same), canon=canon), forms=short)
    return run(
        """SELECT f.field_name, f.entry, n.canonical_value FROM {forms} f JOIN {near} n ON f.field_name = n.field_name AND f.form = n.form
        UNION ALL
        SELECT r.field_name, r.entry, coalesce(d.best.canonical_value, 'unmatched')
        FROM {rest} r LEFT JOIN {derived} d ON r.field_name = d.field_name AND r.short = d.form""",
        forms=forms, near=near, rest=rest, derived=derived,
    )


def entries_resolved(spark: SparkSession, qa: DataFrame, canon: DataFrame, thesaurus: list[tuple[str, str]] | None = None) -> DataFrame:
    """(qa_key, field_name, entry, canonical_value) of every entry that is not exactly canonical."""
    canon = spark.sql("SELECT field_name, canonical_value, min(description) AS description FROM {canon} WHERE canonical_value IS NOT NULL GROUP BY ALL", canon=canon)
    strange = strange_entries(spark, qa, canon)
    resolved = checkpoint(resolve_entries(spark, strange, canon, thesaurus))
    return strange.join(resolved.hint("merge"), ["field_name", "entry"]).select("qa_key", "field_name", "entry", "canonical_value")


def canonical_values(spark: SparkSession, qa: DataFrame, canon: DataFrame, thesaurus: list[tuple[str, str]] | None = None) -> DataFrame:
    """(qa_key, field_name, canonical_value) of every entry that is not exactly canonical."""
    return entries_resolved(spark, qa, canon, thesaurus).drop("entry")
