"""Ranking of history for a query: BM25, letter-group cosine, hybrid, and the two-level selection.

Corpora are long tables (corpus, doc, text); queries name the corpus they search. Both scores come
from posting joins on (corpus, token): work grows with the matching postings, never with all
pairs of a query and a document of other corpora, and documents without a common token get 0 by a
left join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from dialoom.functions.text import squashed, tokens
from dialoom.operators import searching
from dialoom.operators.prefix import salted_join
from dialoom.operators.searching import K1, B
from dialoom.operators.turns import parted

PART_QUERIES = 4096


def _postings(rows: DataFrame, keys: list[str], terms: Column, name: str) -> DataFrame:
    return rows.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias(name))


def _grams(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Counts of the letter groups of three; a shorter text is its only group, an empty one has none."""
    flat = rows.select(*keys, F.lower(squashed(F.coalesce("text", F.lit("")))).alias("__flat")).where("__flat <> ''")
    # the places are exploded first, so that the flattened text is computed once a row
    places = flat.select(*keys, "__flat", F.explode(F.sequence(F.lit(1), F.greatest(F.length("__flat") - 2, F.lit(1)))).alias("__i"))
    return places.select(*keys, F.substring("__flat", F.col("__i"), F.lit(3)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias(name))


def bm25(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, corpus, doc, bm25): queries(query_id, corpus, text) against documents(corpus, doc, text).

    A token that the query has twice counts twice; scores of documents without a match are 0.
    """
    docs = documents.select("corpus", "doc", tokens(F.col("text")).alias("__t")).withColumn("len", F.size("__t"))
    stats = docs.groupBy("corpus").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    tf = docs.select("corpus", "doc", "len", F.explode("__t").alias("term")).groupBy("corpus", "doc", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("corpus", "term").agg(F.count("*").alias("df"))
    qtf = _postings(queries, ["query_id", "corpus"], tokens(F.col("text")), "qtf")
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0)))
    hits = (
        qtf.join(df, ["corpus", "term"]).join(stats, "corpus").join(tf, ["corpus", "term"])
        .groupBy("query_id", "corpus", "doc").agg(F.sum(F.col("qtf") * idf * F.col("tf") * (K1 + 1) / F.greatest(norm, F.lit(1e-9))).alias("bm25"))
    )
    return _with_all(queries, documents, hits, "bm25")


def trigram_cosine(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, corpus, doc, cosine) of letter-group counts; 0 where either is empty or nothing is shared."""
    d = _grams(documents, ["corpus", "doc"], "d")
    q = _grams(queries, ["query_id", "corpus"], "q")
    dn = d.groupBy("corpus", "doc").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("dn"))
    qn = q.groupBy("query_id", "corpus").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dots = q.join(d, ["corpus", "term"]).groupBy("query_id", "corpus", "doc").agg(F.sum(F.col("q") * F.col("d")).alias("dot"))
    hits = dots.join(dn, ["corpus", "doc"]).join(qn, ["query_id", "corpus"]).select("query_id", "corpus", "doc", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("cosine"))
    return _with_all(queries, documents, hits, "cosine")


def _with_all(queries: DataFrame, documents: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    pairs = queries.select("query_id", "corpus").join(documents.select("corpus", "doc"), "corpus")
    return pairs.join(hits, ["query_id", "corpus", "doc"], "left").select("query_id", "corpus", "doc", F.coalesce(name, F.lit(0.0)).alias(name))


def _searchable(queries: DataFrame, turns: DataFrame, terms: str) -> tuple[DataFrame, DataFrame]:
    """Queries and turns with one row per term: a hash leads the keys, it spreads and sorts better than names that begin alike; the names decide."""
    group = ["conversation_id", "session"]
    cut = tokens if terms == "tokens" else _gram_list
    keyed = lambda rows, *keys: rows.select(*keys, F.explode("__terms").alias("term")).withColumn("h", F.xxhash64(*group, "term"))
    asked, said = queries.withColumn("__terms", cut(F.col("text"))), turns.withColumn("__terms", cut(F.col("text")))
    return keyed(asked, *group, "query_id", "upto"), keyed(said.withColumn("len", F.size("__terms")), *group, "pos", "len")


def bm25_upto(queries: DataFrame, turns: DataFrame) -> DataFrame:
    """(query_id, pos, bm25) of the turns of a query's session up to its place that share a token with it.

    ``turns`` (conversation_id, session, pos from 1, text), ``queries`` (query_id, conversation_id, session,
    upto, text). Every turn is cut up once, whoever searches it: the corpus of a query is the postings of
    its session up to its place, so document counts are the postings that a join finds, and lengths are
    running totals. Turns that share nothing score 0 and do not come out.
    """
    group = ["conversation_id", "session"]
    q, d = _searchable(queries, turns, "tokens")
    q = q.groupBy("h", *group, "term", "query_id", "upto").agg(F.count("*").alias("m"))
    d = d.groupBy("h", *group, "term", "pos", "len").agg(F.count("*").alias("n"))
    hits = q.join(d, ["h", *group, "term"]).where("pos <= upto")
    found = hits.groupBy("query_id", "term", "upto", "m", *group).agg(F.collect_list(F.struct("pos", "n", "len")).alias("p"))  # no more than a session's turns
    so_far = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    means = turns.select(*group, F.col("pos").alias("upto"), F.avg(F.size(tokens(F.col("text")))).over(so_far).alias("avg_len"))
    each = found.join(means, [*group, "upto"]).select("query_id", "upto", "avg_len", "m", F.size("p").alias("df"), F.explode("p").alias("p")).select("*", "p.*")
    idf = F.log1p((F.col("upto") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("n") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0)))
    return each.groupBy("query_id", "pos").agg(F.sum(F.col("m") * idf * F.col("n") * (K1 + 1) / F.greatest(norm, F.lit(1e-9))).alias("bm25"))


def cosine_upto(queries: DataFrame, turns: DataFrame) -> DataFrame:
    """(query_id, pos, cosine) of letter-group counts, for the same corpora.

    The product of two counts is the number of pairs of occurrences, so occurrences are joined as they are.
    """
    group = ["conversation_id", "session"]
    q, d = _searchable(queries, turns, "groups")
    dots = q.join(d.drop("len").hint("shuffle_hash"), ["h", *group, "term"]).where("pos <= upto").groupBy("query_id", *group, "pos").agg(F.count("*").alias("dot"))
    dn = turns.select(*group, "pos", F.sqrt(_equal_pairs(_gram_list(F.col("text")))).alias("dn"))
    qn = queries.select("query_id", F.sqrt(_equal_pairs(_gram_list(F.col("text")))).alias("qn"))
    return dots.join(dn, [*group, "pos"]).join(qn, "query_id").select("query_id", "pos", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("cosine"))


def _gram_list(text: Column) -> Column:
    """Letter groups of three, as often as they occur; a shorter text is its only group, an empty one has none."""
    flat = F.lower(squashed(F.coalesce(text, F.lit(""))))
    # an empty match before every three characters; beyond the basic plane characters are counted one by one
    groups = F.regexp_extract_all(flat, F.lit("(?s)(?=(...))"), F.lit(1))
    places = F.sequence(F.lit(1), F.greatest(F.length(flat) - 2, F.lit(1)))
    return (
        F.when(flat == "", F.array().cast("array<string>")).when(F.length(flat) < 3, F.array(flat))
        .when(flat.rlike("[\\x{10000}-\\x{10FFFF}]"), F.transform(places, lambda i: F.substring(flat, i, F.lit(3)))).otherwise(groups)
    )


def _equal_pairs(terms: Column) -> Column:
    """Sum of the squared counts of the entries of a list: along the sorted list the k-th of a run adds 2k - 1."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), (acc["total"] + 2 * run - 1).alias("total"))

    return F.aggregate(F.sort_array(terms), start, step, lambda acc: acc["total"])


def _flat(*parts: Column) -> Column:
    return F.lower(squashed(F.concat_ws(" ", *parts)))


def _searches(rows: DataFrame) -> DataFrame:
    """Packed turns and queries as ``searching`` reads them: flattened texts, queries with the place of their anchor."""
    names = ["session", "turn"]
    told = rows.withColumn("places", F.transform("said", lambda x: F.struct(*[x[c].alias(c) for c in names])))
    upto = lambda a: F.array_position("places", F.struct(*[a[c].alias(c) for c in names])).cast("int")
    found = told.withColumn("named", F.filter(F.transform("named", lambda a: F.struct(a.alias("a"), upto(a).alias("upto"))), lambda x: x["upto"] > 0)).where(F.size("named") > 0)
    spoken = lambda x: _flat(x["a"]["question_text"], F.get("said", x["upto"] - 1)["text"], x["a"]["options"])
    queries = F.transform("named", lambda x: F.struct(x["a"]["query_id"].alias("query_id"), x["upto"].alias("upto"), spoken(x).alias("text")))
    lines = F.transform("said", lambda x: F.struct(*[x[c].alias(c) for c in ("session", "turn", "dia_id")], _flat(x["speaker"], x["text"], x["voice_style"]).alias("text")))
    long = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x["text"]))
    return found.select(lines.alias("turns"), queries.alias("asked")).withColumn("chars", long("turns") + long("asked"))


SAID = ("session", "turn", "dia_id", "speaker", "text", "voice_style")
ASKED = ("query_id", "session", "turn", "question_text", "options")


def local_top(turns: DataFrame, questions: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, turn, rank, score): the first ``k`` turns of the anchor's session up to the anchor, by the hybrid of both scores, ties by place.

    ``turns`` have the columns ``SAID``, ``questions`` those of ``ASKED`` (session and turn of the anchor), both
    with conversation_id. A session is packed with its turns and its queries, and searched in one row.
    """
    keys = ["conversation_id", "session"]
    held = turns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*SAID))).alias("said"))
    asked = questions.groupBy(*keys).agg(F.collect_list(F.struct(*ASKED)).alias("named"))
    schema = StructType().add("query_id", questions.schema["query_id"].dataType).add("turn", turns.schema["turn"].dataType).add("rank", IntegerType()).add("score", DoubleType())
    return _searches(held.join(asked.hint("merge"), keys)).mapInArrow(searching.local_top(k, to_arrow_schema(schema)), schema)


def min_max(value: Column, over: Window) -> Column:
    """Scaled to 0..1 within the group; a flat group is 0 if not positive, else 1."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high - low < 1e-9, F.when(high <= 0, 0.0).otherwise(1.0)).otherwise((value - low) / (high - low))


def hybrid(queries: DataFrame, documents: DataFrame, sparse: float = 0.5, dense: float = 0.5) -> DataFrame:
    """(query_id, corpus, doc, bm25, cosine, score): weighted sum of both scores scaled per query."""
    both = bm25(queries, documents).join(trigram_cosine(queries, documents), ["query_id", "corpus", "doc"])
    each = Window.partitionBy("query_id")
    return both.withColumn("score", sparse * min_max(F.col("bm25"), each) + dense * min_max(F.col("cosine"), each))


def top(ranked: DataFrame, k: int, *ties: Column | str) -> DataFrame:
    """The first k documents of each query, ties by the given columns."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def session_first(turns: DataFrame, questions: DataFrame, sessions_kept: int = 2, windows_kept: int = 4, radius: int = 2) -> DataFrame:
    """Turns chosen by session and then by window: (query_id, pos, dia_id).

    Sessions of the whole history up to the anchor are ranked first; windows (a turn with ``radius`` turns
    around it, none after the anchor) of other sessions count only where the chosen sessions have none.
    Columns as in ``local_top``. Turns and questions of a conversation come to Python as rows in order, once
    for each part of its questions; no row and no task of the engine holds a conversation, and its history is
    never multiplied by questions.
    """
    wanted, parts = parted(questions, "query_id", PART_QUERIES)
    flat = lambda c: _flat(F.col(c))
    columns = lambda is_query, *rest: ["conversation_id", "__part", "session", "turn", F.lit(is_query).alias("__is_query"), *[c.alias(n) for c, n in zip(rest, ("query_id", "dia_id", "head", "body", "tail"), strict=True)]]
    kind = questions.schema["query_id"].dataType
    heard = salted_join(turns.select("conversation_id", *SAID), parts, ["conversation_id"], F.struct("session", "turn"))
    heard = heard.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    said = heard.select(*columns(False, F.lit(None).cast(kind), F.col("dia_id"), flat("speaker"), flat("text"), flat("voice_style")))
    asked = wanted.select(*columns(True, F.col("query_id"), F.lit(None).cast("string"), flat("question_text"), F.lit(None).cast("string"), flat("options")))
    keys = ["conversation_id", "__part"]
    rows = said.union(asked).repartition(*keys).sortWithinPartitions(*keys, "session", "turn", "__is_query")
    schema = StructType().add("query_id", kind).add("pos", LongType()).add("dia_id", StringType())
    return rows.mapInArrow(searching.sorted_session_first(sessions_kept, windows_kept, radius, to_arrow_schema(schema)), schema)
