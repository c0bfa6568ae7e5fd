"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import abuse, balanced, canonical, defects, neardup, packing, tokens
from dialoom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.like_pairs(table(spark, sf_dir, "qa"), "qa_key", ["question_text", "gold_answer"])
    return pairs.select(F.col("id_a").alias("qa_key_a"), F.col("id_b").alias("qa_key_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(table(spark, sf_dir, "qa"), "qa_key", ["question_text", "gold_answer"])
    return found.select(F.col("id").alias("qa_key"), "group_id", "n_links")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_values(spark, table(spark, sf_dir, "qa"), table(spark, sf_dir, "canonical_values"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per field and canonical value that free entries stand for."""
    return p2_found(spark, sf_dir).groupBy("field_name", "canonical_value").agg(F.count("*").alias("n_rows"))


def _plan_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("qa", "canonical_values", "sample_targets")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced.shortages(spark, *_plan_tables(spark, sf_dir))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced.balanced_sample(spark, *_plan_tables(spark, sf_dir))[0]


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, allocation, _ = balanced.balanced_sample(spark, *_plan_tables(spark, sf_dir))
    return balanced.balance_report(sample, allocation)


def p4_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and drawn rows of each category of each balanced field."""
    sample, _, expected = balanced.balanced_sample(spark, *_plan_tables(spark, sf_dir))
    return balanced.residuals(sample, expected)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.defective_answers(table(spark, sf_dir, "qa"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by question type as entered."""
    types = table(spark, sf_dir, "qa").select("qa_key", F.coalesce("question_type", F.lit("unknown")).alias("question_type"))
    found = p6_found(spark, sf_dir).join(types, "qa_key")
    return found.groupBy("question_type", "defect").agg(F.count("*").alias("n_rows"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers_filled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = abuse.fitted(abuse.reviewed_sample(documents, table(spark, sf_dir, "review_labels")))
    return abuse.scored_documents(documents, model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.source_rates(_scored(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_report, p4_found, p4_sample, p4_report, p4_residuals, p6_found, p6_report, p7_ids, p8_containers, p8_report, p9_found, p9_scores, p9_rates)}
_PAIRS = r"""
WITH w AS (
  SELECT qa_key, list_distinct(regexp_extract_all(lower(concat_ws(' ', question_text, gold_answer)), '[\p{L}\p{N}]+')) AS words FROM qa
), x AS (SELECT qa_key, words, len(words) AS n FROM w WHERE len(words) > 0),
t AS (SELECT qa_key, n, unnest(words) AS word FROM x),
common AS (SELECT a.qa_key AS qa_key_a, b.qa_key AS qa_key_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
           FROM t a JOIN t b ON a.word = b.word AND a.qa_key < b.qa_key WHERE 5 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL)
SELECT qa_key_a, qa_key_b FROM common WHERE 5 * k >= 3 * (na + nb - k)
"""

_FILLERS = "['a', 'an', 'the', 'of', 'or', 'to', 'in', 'at', 'and', 'also', 'that', 'has', 'be', 'each', 'other', 'from', 'given', 'between', 'over', 'time', 'right', 'question', 'call', 'form']"
_SAME = """('implicit', 'hidden'), ('long', 'old'), ('long', 'distant'), ('near', 'recent'), ('emotion', 'feeling'), ('instant', 'now'), ('instant', 'current'), ('direct', 'immediate'),
  ('direct', 'straight'), ('trajectory', 'evolution'), ('choose', 'choice'), ('retrieval', 'recall'), ('alone', 'only'), ('removed', 'no'), ('multi', 'many'), ('multi', 'several'), ('multi', 'n'),
  ('multi', '2'), ('multi', 'two'), ('single', 'one'), ('single', '1'), ('no', 'zero'), ('no', '0'), ('step', 'hop'), ('hop', 'step')"""


def _cut_up(x: str) -> str:
    kept = f"[w FOR w IN regexp_split_to_array({x}, '[^a-z0-9]+') IF w <> '' AND len([f FOR f IN {_FILLERS} IF CASE WHEN length(f) < 4 THEN w = f ELSE levenshtein(w, f) <= length(f) // 4 END]) = 0]"
    return f"[CASE WHEN length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END FOR w IN {kept}]"


def _swapped(source: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM {source} UNION SELECT field_name, canonical_value, about, [CASE WHEN v = word THEN other ELSE v END FOR v IN seq] FROM (SELECT *, unnest(seq) AS w FROM {source}) JOIN same ON w = word)"


_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    translate(lower(entry), 'аеорсхуіѕјкмтвнáàâäãåéèêëíìîïóòôöõúùûüñçýοαειρυκντ０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', 'aeopcxyisjkmtbhaaaaaaeeeeiiiiooooouuuuncyoaeipukvt0123456789abcdefghijklmnopqrstuvwxyz'),
    '\p{Cf}', '', 'g'), '^[^a-z0-9]*(type|prob|probably|maybe|perhaps|likely|class|category|label|value)[ ]*[.:=]+[ ]*', '', 'g'),
    '[ ]*[(\[]?(checked|verified|reviewed|confirmed|v[0-9]+)[)\]]?[^a-z0-9]*$', '', 'g'), '([a-z])0', '\1o', 'g'), '0([a-z]{2})', 'o\1', 'g')"""
_ONLY = "SELECT field_name, min(canonical_value) AS canonical_value, form FROM {0} WHERE length(form) >= 3 GROUP BY field_name, form HAVING count(DISTINCT canonical_value) = 1"

_ENTRIES = f"""
WITH entries AS (
  SELECT qa_key, f.field_name, CASE f.field_name WHEN 'reasoning_structure' THEN reasoning_structure WHEN 'question_type' THEN question_type ELSE content_type END AS entry
  FROM qa, (SELECT unnest(['reasoning_structure', 'question_type', 'content_type']) AS field_name) f
), strange AS (
  SELECT DISTINCT field_name, entry FROM entries e
  WHERE entry IS NOT NULL AND regexp_replace(entry, '[\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]', '', 'g') <> ''
    AND NOT EXISTS (SELECT 1 FROM canonical_values c WHERE c.field_name = e.field_name AND c.canonical_value = e.entry)
), forms AS (
  SELECT field_name, entry, array_to_string(words, '') AS form, array_to_string([left(w, 5) FOR w IN words], '') AS short
  FROM (SELECT field_name, entry, {_cut_up("plain")} AS words FROM (SELECT field_name, entry, {_PLAIN} AS plain FROM strange))
), same(word, other) AS (VALUES {_SAME}
), named AS (
  SELECT field_name, canonical_value, {_cut_up("lower(canonical_value)")} AS name, {_cut_up("lower(coalesce(description, ''))")} AS about FROM canonical_values
), names AS (
  SELECT field_name, canonical_value, name AS seq FROM named
  UNION ALL SELECT field_name, canonical_value, list_concat([left(name[1], 1) || left(name[2], 1)], name[3:]) FROM named WHERE len(name) >= 3
), parts AS (
  SELECT field_name, canonical_value, 0 AS about, [seq[i] FOR i IN range(1, len(seq) + 1) IF (m >> (i - 1)) & 1 = 1] AS seq
  FROM (SELECT *, unnest(range(1, 1 << len(seq))) AS m FROM names)
), phrases AS (
  SELECT * FROM parts
  UNION ALL SELECT field_name, canonical_value, 1, about[i:i + 2] FROM (SELECT *, unnest(range(1, len(about) - 1)) AS i FROM named WHERE len(about) >= 3)
), pairs AS (SELECT field_name, canonical_value, x, y FROM (SELECT *, unnest(list_distinct(list_concat(name, about))) AS y FROM (SELECT *, unnest(about) AS x FROM named)) WHERE x <> y
), sequences AS (
  SELECT field_name, canonical_value, about, list_concat(seq[r + 1:], seq[1:r]) AS seq FROM (SELECT *, unnest(range(0, len(seq))) AS r FROM phrases)
  UNION SELECT field_name, canonical_value, 1, [x] FROM (SELECT *, unnest(about) AS x FROM named)
  UNION SELECT field_name, canonical_value, 1, [x, y] FROM pairs UNION SELECT field_name, canonical_value, 1, [y, x] FROM pairs
), {_swapped("sequences", "s1")}, {_swapped("s1", "s2")}, {_swapped("parts", "p1")}, {_swapped("p1", "p2")}
, cut AS (SELECT DISTINCT field_name, canonical_value, array_to_string([left(w, c) FOR w IN seq], '') AS form FROM (SELECT *, unnest(range(3 + about, 6)) AS c FROM s2)
), written AS (SELECT field_name, canonical_value, array_to_string(seq, '') AS form FROM p2
), reference AS (
  SELECT field_name, canonical_value, array_to_string(name, '') AS form, 0 AS kind FROM named
  UNION ALL SELECT field_name, canonical_value, form, 1 FROM ({_ONLY.format("written")})
  UNION ALL SELECT field_name, canonical_value, form, 2 FROM ({_ONLY.format("cut")})
), allowed AS (
  SELECT *, CASE WHEN kind = 0 THEN CASE WHEN n <= 2 THEN 0 WHEN n <= 3 THEN 1 WHEN n <= 7 THEN 2 WHEN n <= 9 THEN 3 WHEN n <= 24 THEN 4 ELSE 6 END
            ELSE CASE WHEN n <= 4 THEN 0 WHEN n <= 7 THEN 1 WHEN n <= 12 THEN 2 ELSE 3 END END AS k
  FROM (SELECT *, length(form) AS n FROM reference)
), near AS (
  SELECT f.field_name, f.form, first(a.canonical_value ORDER BY levenshtein(f.form, a.form), a.kind, a.canonical_value) AS canonical_value
  FROM (SELECT DISTINCT field_name, form FROM forms WHERE form <> '') f JOIN allowed a ON f.field_name = a.field_name AND a.kind < 2 AND abs(length(f.form) - a.n) <= a.k
  WHERE levenshtein(f.form, a.form) <= a.k GROUP BY ALL
), derived AS (
  SELECT f.field_name, f.short, first(a.canonical_value ORDER BY levenshtein(f.short, a.form), a.canonical_value) AS canonical_value
  FROM (SELECT DISTINCT field_name, short FROM forms f WHERE short <> '' AND NOT EXISTS (SELECT 1 FROM near n WHERE n.field_name = f.field_name AND n.form = f.form)) f
  JOIN allowed a ON f.field_name = a.field_name AND a.kind = 2 AND abs(length(f.short) - a.n) <= a.k
  WHERE levenshtein(f.short, a.form) <= a.k GROUP BY ALL
), resolved AS (
  SELECT f.field_name, f.entry, coalesce(n.canonical_value, d.canonical_value, 'unmatched') AS canonical_value
  FROM forms f LEFT JOIN near n ON f.field_name = n.field_name AND f.form = n.form LEFT JOIN derived d ON f.field_name = d.field_name AND f.short = d.short
)
"""

_AVAILABLE = """
, categories AS (
  SELECT e.field_name, coalesce(r.canonical_value, e.entry) AS category FROM entries e LEFT JOIN resolved r ON e.field_name = r.field_name AND e.entry = r.entry
  UNION ALL SELECT 'memory_level', memory_level FROM qa
), counts AS (SELECT field_name, category, count(*) AS n FROM categories GROUP BY ALL
), plans AS (
  SELECT t.*, coalesce(c.n, 0) AS available, CAST(greatest(coalesce(t.min_rows, 0), (coalesce(t.target_pct, 0) * t.sample_size + 99) // 100) AS BIGINT) AS wanted
  FROM sample_targets t LEFT JOIN counts c ON t.field_name = c.field_name AND t.category = c.category WHERE t.category IS NOT NULL
)
"""
_SHORT = _AVAILABLE + "SELECT plan_id, category FROM plans WHERE available < wanted"

# whole shares, the largest remainders, then minimums and what there is; at last single rows are taken from or given to the categories furthest from their share
_REPORT = _AVAILABLE + """, quotas AS (
  SELECT *, sample_size * CAST(target_pct AS DOUBLE) / sum(CAST(target_pct AS DOUBLE)) OVER (PARTITION BY plan_id) AS quota, row_number() OVER (PARTITION BY plan_id ORDER BY category) AS place FROM plans
), rounded AS (
  SELECT *, floor(quota) + CASE WHEN row_number() OVER (PARTITION BY plan_id ORDER BY floor(quota) - quota, place) <= sample_size - sum(floor(quota)) OVER (PARTITION BY plan_id) THEN 1 ELSE 0 END AS share, least(coalesce(min_rows, 0), available) AS least_rows FROM quotas
), bounded AS (SELECT *, CAST(greatest(least(share, available), least_rows) AS BIGINT) AS got FROM rounded
), off AS (SELECT *, CAST(sum(got) OVER (PARTITION BY plan_id) - sample_size AS BIGINT) AS over FROM bounded
), units AS (
  SELECT plan_id, category, place, got - quota - j AS priority, over FROM (SELECT *, unnest(range(0, got - least_rows)) AS j FROM off WHERE over > 0)
  UNION ALL SELECT plan_id, category, place, quota - got - j, over FROM (SELECT *, unnest(range(0, least(available - got, -over))) AS j FROM off WHERE over < 0)
), moved AS (
  SELECT plan_id, category, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY priority DESC, place) AS r FROM units) WHERE r <= abs(over) GROUP BY ALL
), allocated AS (SELECT o.*, got - CASE WHEN over > 0 THEN 1 ELSE -1 END * CAST(coalesce(n, 0) AS BIGINT) AS allocated FROM off o LEFT JOIN moved m ON o.plan_id = m.plan_id AND o.category = m.category)
SELECT plan_id, category, sample_size, target_pct, min_rows, wanted, available, allocated, allocated AS drawn, CAST(0 AS BIGINT) AS residual,
       greatest(wanted - allocated, 0) AS missing, greatest(wanted - available, 0) AS shortage FROM allocated
"""

# word sets with their smallest row, links between different sets, and whatever can be reached by links
_GROUPS = r"""
WITH RECURSIVE w AS (
  SELECT qa_key, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', question_text, gold_answer)), '[\p{L}\p{N}]+'))) AS words FROM qa
), c AS (SELECT qa_key, words, CASE WHEN len(words) > 0 THEN min(qa_key) OVER (PARTITION BY words) ELSE qa_key END AS rep FROM w),
t AS (SELECT rep, len(words) AS n, unnest(words) AS word FROM c WHERE qa_key = rep AND len(words) > 0),
common AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM t a JOIN t b ON a.word = b.word AND a.rep <> b.rep WHERE 5 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 5 * k >= 3 * (na + nb - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
g AS (SELECT a AS rep, min(b) AS low FROM reach GROUP BY ALL), m AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY ALL)
SELECT qa_key, least(c.rep, coalesce(low, c.rep)) AS group_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN g USING (rep) LEFT JOIN m USING (rep)
"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": _PAIRS,
    "p1_groups": _GROUPS,
    "p2_found": _ENTRIES + "SELECT e.qa_key, e.field_name, r.canonical_value FROM entries e JOIN resolved r ON e.field_name = r.field_name AND e.entry = r.entry",
    "p2_report": _ENTRIES
    + "SELECT e.field_name, r.canonical_value, count(*) AS n_rows FROM entries e JOIN resolved r ON e.field_name = r.field_name AND e.entry = r.entry GROUP BY ALL",
    "p4_found": _ENTRIES + _SHORT,
    "p4_report": _ENTRIES + _REPORT,
}
