"""The turn table: flattening, latest version, order, windows and context spans.

Everything that the order of a conversation decides is computed without a window over whole
conversations: turns are numbered within their session, sessions carry the number of turns before
them (running totals in blocks of sessions), and the sum is the place in the history. A conversation
that holds a third of all rows is therefore many small groups, not one task. Contexts are kept as spans (first and last place), and
turned into rows only where a caller asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.ids import turn_numbers
from dialoom.functions.text import unmangled
from dialoom.operators.prefix import before, salted_join

BLOCK, PART_ANCHORS, LIST, SPREAD = 2048, 4096, 128, 8
TURN = "struct<speaker:string,dia_id:string,timestamp:string,turn_index_global:int,text:string,audio_id:string,voice_style:string,modality_available:array<string>>"


def flattened(raw: DataFrame) -> DataFrame:
    """Turns of nested conversation documents (column ``value``: JSON text), one row each.

    Sessions sit under keys ``session_<n>`` with a sibling ``session_<n>_date_time``. Of turns with
    the same id the last one counts; turns without an id are kept apart with a null id.
    """
    doc = raw.select(F.monotonically_increasing_id().alias("doc"), F.from_json("value", "map<string,string>").alias("m"))
    sessions = doc.select("doc", F.col("m")["conversation_id"].alias("conversation_id"), "m", F.explode("m").alias("k", "v")).where(
        F.col("k").rlike("^session_[0-9]+$")
    )
    rows = sessions.select(
        "doc", "conversation_id", F.regexp_extract("k", "([0-9]+)$", 1).cast("bigint").alias("session"),
        F.col("m")[F.concat("k", F.lit("_date_time"))].alias("session_date_time"),
        F.posexplode(F.from_json("v", f"array<{TURN}>")).alias("array_pos", "t"),
    ).select("doc", "conversation_id", "session", "session_date_time", "array_pos", "t.*")
    last = Window.partitionBy("doc", "dia_id").orderBy(F.desc("session"), F.desc("array_pos"))
    ranked = rows.withColumn("__r", F.when(F.col("dia_id").isNotNull(), F.row_number().over(last)).otherwise(1))
    return ranked.where("__r = 1").drop("__r", "doc")


def latest(conversation: DataFrame) -> DataFrame:
    """One row per conversation, session and turn: the version that arrived last, if it is not deleted."""
    rows = conversation.withColumn("__n", turn_numbers(F.col("dia_id"))).where("conversation_id is not null and __n is not null")
    rows = rows.withColumn("session", F.col("__n.session")).withColumn("turn", F.col("__n.turn"))
    newest = Window.partitionBy("conversation_id", "session", "turn").orderBy(
        F.desc_nulls_last("ingested_at"), F.desc(F.coalesce("is_deleted", F.lit(False))), F.asc_nulls_last("text"), F.asc_nulls_last("speaker")
    )
    kept = rows.withColumn("__r", F.row_number().over(newest)).where("__r = 1 and not coalesce(is_deleted, false)")
    return kept.select(
        "conversation_id", "session", "turn",
        F.format_string("D%d:%d", "session", "turn").alias("dia_id"),
        "speaker", "spoken_at", F.col("turn_index_global").cast("bigint").alias("turn_index"),
        unmangled(F.col("text")).alias("text"), F.nullif(F.trim("voice_style"), F.lit("")).alias("voice_style"),
        F.nullif(F.trim("audio_id"), F.lit("")).alias("audio_id"), "modality_available",
    )


def sessions(turns: DataFrame) -> DataFrame:
    """Sessions with their number of turns and the turns and sessions of the conversation before them."""
    sizes = turns.groupBy("conversation_id", "session").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return before(sizes, ["conversation_id"], "session", {"turns_before": F.col("n_turns"), "sessions_before": F.lit(1).cast("bigint")})


def ordered(turns: DataFrame) -> DataFrame:
    """Turns with session_pos and history_pos (from 1) and the number of turns of their session."""
    inside = Window.partitionBy("conversation_id", "session").orderBy("turn")
    placed = turns.withColumn("session_pos", F.row_number().over(inside).cast("bigint"))
    return placed.join(sessions(turns).select("conversation_id", "session", "n_turns", "turns_before", "sessions_before"), ["conversation_id", "session"]).withColumn(
        "history_pos", F.col("turns_before") + F.col("session_pos")
    )


def tumbling_windows(placed: DataFrame, size: int = 2) -> DataFrame:
    """Windows of ``size`` turns inside each session; the last one may be short."""
    return placed.groupBy("conversation_id", "session", F.floor((F.col("session_pos") - 1) / size).alias("window_no")).agg(
        F.count("*").alias("n_turns"), F.min("history_pos").alias("first_pos"), F.max("history_pos").alias("last_pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("history_pos", "dia_id"))), lambda s: s["dia_id"]), " ").alias("dia_ids"),
    )


def framed(placed: DataFrame, before: int, after: int, *columns: Column) -> DataFrame:
    """Rows (conversation_id, center_pos, member columns) of the frame around every place.

    Each turn is sent to the places whose frame holds it, so the shuffle key is (conversation,
    place) and no task sees a whole conversation; frames cross sessions. Places behind the last turn
    come out too: a frame counts where ``at_center`` holds for one of its rows.
    """
    return placed.select(
        "conversation_id", "history_pos", *columns,
        F.explode(F.sequence(F.greatest(F.col("history_pos") - after, F.lit(1)), F.col("history_pos") + before)).alias("center_pos"),
    )


def at_center() -> Column:
    """Aggregate: the frame has a turn at its centre."""
    return F.max(F.col("history_pos") == F.col("center_pos"))


def sliding_windows(placed: DataFrame, radius: int = 2) -> DataFrame:
    """The centred window of every turn: its turns in order."""
    return (
        framed(placed, radius, radius, F.col("dia_id"))
        .groupBy("conversation_id", "center_pos")
        .agg(at_center().alias("__at"), F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("history_pos", "dia_id"))), lambda s: s["dia_id"]), " ").alias("dia_ids"))
        .where("__at").drop("__at")
    )


def index_gaps(placed: DataFrame) -> DataFrame:
    """Turns whose global index is not the one before plus one, by a join of neighbouring places."""
    before = placed.select("conversation_id", (F.col("history_pos") + 1).alias("history_pos"), F.col("turn_index").alias("index_before"))
    return (
        placed.join(before, ["conversation_id", "history_pos"], "left")
        .withColumn("expected", F.coalesce("index_before", F.lit(0)) + 1)
        .where("turn_index is null or turn_index <> expected")
        .select("conversation_id", "dia_id", "turn_index", "expected")
    )


def filled_index(placed: DataFrame) -> DataFrame:
    """Missing global indexes filled by counting on from the last explicit one, session by session.

    The last explicit index of earlier sessions is a running maximum over one row per session, taken
    in blocks.
    """
    inside = Window.partitionBy("conversation_id", "session").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    given = F.last(F.when(F.col("turn_index").isNotNull(), F.struct("turn_index", "history_pos")), ignorenulls=True)
    local = placed.withColumn("__here", given.over(inside))
    ends = placed.where("turn_index is not null").groupBy("conversation_id", "session").agg(
        F.max_by(F.struct("turn_index", "history_pos"), "history_pos").alias("__end")
    )
    all_ends = placed.select("conversation_id", "session").distinct().join(ends, ["conversation_id", "session"], "left")
    latest_end = F.when(F.col("__end").isNotNull(), F.struct(F.col("session").alias("s"), F.col("__end").alias("e")))
    carried = before(all_ends, ["conversation_id"], "session", maxima={"__last": latest_end}).withColumn("__before", F.col("__last.e"))
    anchor = F.coalesce("__here", "__before")
    return local.join(carried.select("conversation_id", "session", "__before"), ["conversation_id", "session"]).select(
        "conversation_id", "dia_id", "turn_index",
        F.coalesce(anchor["turn_index"] + F.col("history_pos") - anchor["history_pos"], F.col("history_pos")).alias("filled_index"),
    )


def context_spans(anchors: DataFrame, placed: DataFrame) -> DataFrame:
    """Spans of the contexts up to each anchor (columns conversation_id, session, turn of ``anchors``).

    n_full and n_local count the turns up to and including the anchor in the history and in the
    session; n_prior counts those strictly before; n_windows counts the tumbling windows of two that
    lie strictly before (session by session).
    """
    size = placed.groupBy("conversation_id", "session").agg(F.count("*").alias("n"))
    windows = before(size, ["conversation_id"], "session", {"windows_before": F.ceil(F.col("n") / 2)})
    at = placed.select("conversation_id", "session", "turn", "session_pos", "history_pos", "dia_id")
    return (
        anchors.join(at, ["conversation_id", "session", "turn"])
        .join(windows.select("conversation_id", "session", "windows_before"), ["conversation_id", "session"])
        .withColumn("n_full", F.col("history_pos"))
        .withColumn("n_local", F.col("session_pos"))
        .withColumn("n_prior", F.col("history_pos") - 1)
        .withColumn("n_windows", F.col("windows_before") + F.ceil((F.col("session_pos") - 1) / 2))
        .drop("windows_before")
    )


def parted(anchors: DataFrame, key: str, size: int = PART_ANCHORS) -> tuple[DataFrame, DataFrame]:
    """Anchors with their ``__part``, and (conversation_id, __parts): parts of about ``size`` anchors of a conversation."""
    parts = anchors.groupBy("conversation_id").agg(F.ceil(F.count("*") / size).cast("int").alias("__parts"))
    marked = salted_join(anchors, parts, ["conversation_id"], F.col(key))
    return marked.withColumn("__part", F.pmod(F.xxhash64(key), F.col("__parts")).cast("int")).drop("__parts"), parts


def per_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """A copy of the rows of a conversation for each ``__part`` of its anchors; none where nothing is asked."""
    copies = salted_join(rows, parts, ["conversation_id"], F.col("history_pos"))
    return copies.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")


def packed(turns: DataFrame, parts: DataFrame, said: Column) -> DataFrame:
    """(conversation_id, __part, __turns): the turns of a conversation as one sorted list of ``said``, a copy for each part of its anchors."""
    asked = turns.join(parts.hint("merge"), "conversation_id", "left_semi").groupBy("conversation_id").agg(F.sort_array(F.collect_list(said)).alias("__turns"))
    return asked.join(parts.hint("merge"), "conversation_id").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")


def prefix_rows(anchors: DataFrame, placed: DataFrame, key: str, *carried: str) -> DataFrame:
    """The turns up to each anchor (columns key, conversation_id, history_pos of ``anchors``), one row each, with the columns ``carried`` of the anchor.

    A conversation is cut into tiles, of ``BLOCK`` places and of about ``PART_ANCHORS`` anchors: lists of
    ``LIST`` neighbouring anchors are sent to the blocks up to the last of them, a turn to the parts of its
    conversation. The join of a tile takes list by list past its turns, and the rows of a turn and a list are
    written where they arise. What is shuffled grows with anchors and turns, not with the contexts; the
    output has all rows of these, but the same few anchors recur turn after turn, which files keep as
    repeats. ``context_spans`` has the contexts as spans.
    """
    block = lambda pos: F.floor((pos - 1) / BLOCK)
    wanted, parts = parted(anchors.where("history_pos > 0").select(key, *carried, "conversation_id", "history_pos"), key)
    asked = wanted.groupBy("conversation_id", "__part").agg(F.sort_array(F.collect_list(F.struct(F.col("history_pos").alias("__pos"), key, *carried))).alias("__all"))
    begins = F.explode(F.sequence(F.lit(1), F.size("__all"), F.lit(LIST)))
    lists = asked.select("conversation_id", "__part", "__all", begins.alias("__i")).select("conversation_id", "__part", F.slice("__all", F.col("__i"), F.lit(LIST)).alias("__anchors"))
    last = F.element_at("__anchors", -1)["__pos"]
    sent = lists.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), block(last))))
    there = per_part(placed, parts).withColumn("__block", block(F.col("history_pos")))
    # both sides grow with the data, so neither is broadcast; the turns of a tile are held while the lists pass by.
    # A tile is small and what it writes is large: sizes of the shuffle must not decide how many tiles a task gets
    tile = ["conversation_id", "__part", "__block"]
    many = SPREAD * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sent.repartition(many, *tile).hint("merge").join(there.repartition(many, *tile), tile)
    each = met.select(*placed.columns, F.explode("__anchors").alias("__a")).where(F.col("history_pos") <= F.col("__a.__pos"))
    return each.select(*placed.columns, *[F.col("__a")[c].alias(c) for c in (key, *carried)])


def retrieval_candidates(anchors: DataFrame, placed: DataFrame, key: str, size: int = 2) -> DataFrame:
    """Windows of ``size`` turns strictly before each anchor, session by session, the last of a session may be short.

    Columns key, session, window_no (in the session), item_no and the turn.
    """
    place = F.col("session_pos") - 1
    numbered = placed.withColumn("window_no", F.floor(place / size)).withColumn("item_no", F.pmod(place, F.lit(size)))  # once a turn, not once a row
    return prefix_rows(anchors.withColumn("history_pos", F.col("history_pos") - 1), numbered, key)


def span_rows(spans: DataFrame, placed: DataFrame, key: str, last: int) -> DataFrame:
    """Turns of each span, the ``last`` ones up to the anchor: equality join on (conversation, place)."""
    wanted = spans.select(key, "conversation_id", F.explode(F.sequence(F.greatest(F.col("history_pos") - (last - 1), F.lit(1)), F.col("history_pos"))).alias("history_pos"))
    return wanted.join(placed, ["conversation_id", "history_pos"])
