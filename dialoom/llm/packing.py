"""Filling fixed-capacity containers with texts: best-two-fit over token counts.

Items longer than a capacity are cut into full containers and a rest; everything else stays whole.
A container is filled greedily with the largest item that fits; then its smallest item is taken out
if two unpacked items fit the widened gap more tightly. Sizes are small integers, so a bin works on
the set of sizes still unpacked (a bit mask), not on the items.

Items are packed in rounds. In each, they are spread evenly over groups of about ``GROUP_ITEMS``
by a hash (fewer groups where a group would not fill ``GROUP_CONTAINERS`` containers), and each group
is packed alone in one task. Full containers (``FULL_SHARE`` of the capacity or more) are final and
the items of the others go up to a next round with fewer groups. Where less than half of a group's
items found a full container, sizes do not combine and repacking gains nothing: there all containers
more than half full are final, which leaves one at most to go up. Either way a round leaves at most
half of the items or an eighth of the room, so rounds end with one group. The rules look at one group
at a time and are the same at every size of the data.

Defined cases: null and empty texts have size 0 and take no room: they join the fullest container of
their group, or share one where nothing else is left;
a text of a multiple of the capacity fills its containers exactly; repeated texts are items each;
null, zero or negative capacities are left out; an empty table packs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.tokens import token_count
from dialoom.session import checkpoint

GROUP_ITEMS = 20_000
GROUP_CONTAINERS, FULL_SHARE = 8, 0.98
PACKED = "kind string, capacity int, doc_id bigint, part int, tokens int, container string, fill int, final boolean"


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item indexes; every size is between 1 and the capacity."""
    waiting: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        waiting.setdefault(sizes[i], []).append(i)
    mask = 0
    for s in waiting:
        mask |= 1 << s

    def largest(room: int) -> int:
        return (mask & ((1 << (room + 1)) - 1)).bit_length() - 1

    def take(size: int) -> int:
        nonlocal mask
        items = waiting[size]
        item = items.pop()
        if not items:
            del waiting[size]
            mask ^= 1 << size
        return item

    bins: list[list[int]] = []
    while mask:
        held: list[tuple[int, int]] = []
        room = capacity
        while room and (size := largest(room)) > 0:
            held.append((size, take(size)))
            room -= size
        if room and mask and held:
            small = held[-1][0]  # filled from large to small
            gap, best, pair = room + small, small, None
            rest = mask & ((1 << (gap // 2 + 1)) - 1)
            while rest:
                a = rest.bit_length() - 1
                rest ^= 1 << a
                if 2 * a > gap:
                    continue
                b = largest(gap - a)
                if b == a and len(waiting[a]) < 2:
                    b = (mask & ((1 << a) - 1)).bit_length() - 1
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == gap:
                        break
            if pair:
                _, item = held.pop()
                waiting.setdefault(small, []).append(item)
                mask |= 1 << small
                held.extend((s, take(s)) for s in pair)
        bins.append([item for _, item in held])
    return bins


def placed(sizes: list[int], capacity: int, last: bool) -> list[tuple[list[int], int, bool]]:
    """Containers of one group as (item indexes, fill, final)."""
    empty = [i for i, size in enumerate(sizes) if size == 0]
    real = [i for i, size in enumerate(sizes) if size]
    held = [[real[i] for i in b] for b in pack([sizes[i] for i in real], capacity)]
    fills = [sum(sizes[i] for i in b) for b in held]
    full = [f >= FULL_SHARE * capacity for f in fills]
    poor = 2 * sum(len(b) for b, ok in zip(held, full) if ok) < len(real)
    final = [last or ok or (poor and 2 * f > capacity) for ok, f in zip(full, fills)]
    if empty:
        fullest = max(range(len(held)), key=fills.__getitem__, default=None)
        if fullest is None or (not final[fullest] and 2 * len(empty) > len(sizes)):
            held.append(empty)
            fills.append(0)
            final.append(True)
        else:
            held[fullest] = held[fullest] + empty
    return list(zip(held, fills, final))


def _pack_group(round_no: int, single: frozenset[str]):
    """``single``: the kinds that are left with one group."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True]).reset_index(drop=True)
        kind, capacity, group = items.kind.iat[0], int(items.capacity.iat[0]), int(items.group.iat[0])
        name, fill, final = [""] * len(items), [0] * len(items), [False] * len(items)
        for b, (held, used, done) in enumerate(placed(items.tokens.tolist(), capacity, kind in single)):
            for i in held:
                name[i], fill[i], final[i] = f"{round_no}-{group}-{b}", used, done
        items["container"], items["fill"], items["final"] = name, fill, final
        return items[["kind", "capacity", "doc_id", "part", "tokens", "container", "fill", "final"]]

    return run


def items(documents: DataFrame, containers: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(kind, capacity, doc_id, part, tokens): one row per item and capacity; full cuts are their own containers."""
    sized = documents.select("doc_id", F.coalesce(token_count(F.col("text"), vocabulary), F.lit(0)).alias("size"))
    kinds = [
        (r["container_kind"], int(r["capacity_tokens"]))
        for r in containers.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").where("container_kind is not null").distinct().orderBy("capacity_tokens", "container_kind").toLocalIterator()
    ]
    return sized.withColumn(
        "c", F.explode(F.array(*[F.struct(F.lit(k).cast("string").alias("kind"), F.lit(c).alias("capacity")) for k, c in kinds]))
        if kinds else F.lit(None).cast("struct<kind:string,capacity:int>")
    ).where("c is not null").select("c.kind", "c.capacity", "doc_id", "size").select(
        "kind", "capacity", "doc_id",
        F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("size") / F.col("capacity")).cast("int"), F.lit(1)))).alias("part"),
        "size",
    ).withColumn("tokens", F.least("capacity", F.col("size") - (F.col("part") - 1) * F.col("capacity")).cast("int")).drop("size")


def _waiting(items: DataFrame) -> list[tuple[str, int, int, int]]:
    """(kind, capacity, items, tokens) of what is not packed yet: one row per kind of container."""
    counts = items.groupBy("kind", "capacity").agg(F.count("*").alias("n"), F.sum("tokens").alias("total"))
    return [tuple(r) for r in counts.toLocalIterator()]


def containers_filled(documents: DataFrame, containers: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(container_kind, capacity_tokens, container_id, doc_id, part, tokens): every item in its container."""
    everything = checkpoint(items(documents, containers, vocabulary))
    full = everything.where("tokens = capacity").select(
        "kind", "capacity", "doc_id", "part", "tokens",
        F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"),
    )
    done = [full]
    columns = ["kind", "capacity", "doc_id", "part", "tokens", "container"]
    waiting, round_no = everything.where("tokens < capacity"), 0
    while sizes := _waiting(waiting):
        groups = {k: max(1, min(-(-n // GROUP_ITEMS), total // (GROUP_CONTAINERS * capacity))) for k, capacity, n, total in sizes}
        per_kind = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])[F.col("kind")]
        group = F.pmod(F.xxhash64("doc_id", "part", F.lit(round_no)), per_kind)
        packed = checkpoint(
            waiting.select("kind", "capacity", "doc_id", "part", "tokens", group.alias("group"))
            .groupBy("kind", "capacity", "group")
            .applyInPandas(_pack_group(round_no, frozenset(k for k, n in groups.items() if n == 1)), PACKED)
        )
        done.append(packed.where("final").select(*columns))
        waiting, round_no = packed.where("not final").select(*columns[:5]), round_no + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(
        F.col("kind").alias("container_kind"), F.col("capacity").alias("capacity_tokens"),
        F.col("container").alias("container_id"), "doc_id", "part", "tokens",
    )


def fill_report(filled: DataFrame) -> DataFrame:
    """Containers, items and share of unused room per kind."""
    per = filled.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("n"))
    return per.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_items"), F.sum("used").alias("tokens"),
        F.round(1 - F.sum("used") / (F.count("*") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )
