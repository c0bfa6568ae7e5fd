"""Near-duplicate rows: a prefix join of word sets, followed from one word in common to the next.

A row is its set of words. Identical sets are one class first, so a group of copies costs one row.
The words of a set are put in one order, rare ones first. Two sets of likeness ``limit`` or more miss
few words of each other, so their first word in common is among the first few of both (``_cut``): a
set is sent under each of those, and every pair meets under its first word in common. Nothing is left
to chance. The words of a common template are frequent and come late, so its rows do not meet because
of it; those of a rare template do. A bucket is not looked at pair by pair: it is cut into bands of sizes, since the sizes
of both sides say how many words may be missing, and a large group is cut again by the second, third
and fourth word in common, as long as that leaves it fewer pairs. Words are told by 16 bits here, which
can only let more pairs through. A bitmap of ``CELLS`` hash cells of all words travels with each entry:
a word in both sets sets a cell in both, unless it hides behind another word of its cell, which bounds
the likeness from above; what is left is verified on the word sets exactly.

Entries of one word lie in one task; a word that is rare enough for the order to put it first is one
of few rows. Sets of more than ``LONG`` words are compared within their buckets by bitmap alone.
``signatures`` and ``chunk_keys`` (b-bit min-hash) are kept for estimates; the join does not use them.

All joins whose sides grow with the data are sort-merge joins by hint: the size that the planner
sees before the keys are exploded says nothing, so no side may be broadcast because of it.

Defined cases: a null text adds no word; rows without any word are like none; identical rows are
pairs; the order of the two keys of a pair is the smaller first; extra columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.session import checkpoint

POSITIONS, WIDTH, ERRORS, BITS, CELLS = 64, 4, 1, 16, 192
# hash cells of the word counts; words that a pair is followed along; words of a set with codes; pairs met one by one; largest set of a band by its smallest
ORDER, LEVELS, LONG, SMALL, BAND = 1 << 18, 4, 256, 2048, 1.2
# at a time: pairs, next words, entries; numbers of 16 bits before the codes of an entry
PAIRS, ENTRIES, BUCKETS, HEAD = 1 << 20, 1 << 20, 1 << 17, 6 + CELLS // 16


def words(columns: Sequence[str]) -> Column:
    """Distinct lower-cased runs of letters and digits of several columns, as sorted hashes."""
    text = F.lower(F.concat_ws(" ", *columns))
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.sort_array(F.transform(runs, lambda w: F.xxhash64(w)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (rows x POSITIONS, of BITS bits) and bitmap of hash cells (rows x longs) of word sets.

    ``flat`` holds the words of all sets one after the other, ``starts`` where each set begins.
    """
    seeds = _mix(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    symbols = np.empty((len(starts), POSITIONS), np.uint64)
    with np.errstate(over="ignore"):
        mixed = _mix(flat.view(np.uint64))
        for p in range(POSITIONS):
            h = (mixed ^ seeds[p]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xCA5A826395121157)
            symbols[:, p] = _mix(np.minimum.reduceat(h, starts)) >> np.uint64(64 - BITS)
    return symbols, bitmaps(mixed, starts).view(np.int64)


def bitmaps(mixed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bitmap of hash cells (rows x longs) of sets of mixed words."""
    cell = mixed % np.uint64(CELLS)
    bits = np.zeros((len(mixed), CELLS // 64), np.uint64)
    bits[np.arange(len(mixed)), cell // np.uint64(64)] = np.uint64(1) << cell % np.uint64(64)
    return np.bitwise_or.reduceat(bits, starts, axis=0)


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys (rows x keys): for each chunk and each place of its errors the symbols left, side by side."""
    keys = []
    for c in range(POSITIONS // WIDTH):
        for kept in itertools.combinations(range(WIDTH), WIDTH - ERRORS):
            key = np.full(len(symbols), len(keys), np.uint64)
            for j in kept:
                key = key << np.uint64(BITS) | symbols[:, c * WIDTH + j]
            keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def _cut(n: np.ndarray, limit: tuple[int, int]) -> np.ndarray:
    """How many words of a set of n may be missing from any set whose likeness is ``limit`` (numerator, denominator) or more."""
    return n - -(-limit[0] * n // limit[1])


def _entries(order: np.ndarray, limit: tuple[int, int]):
    """A set goes under each of its first words; ``order`` has how often a word of a hash cell occurs."""
    at = lambda sizes: np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                sets = part.column("words")
                offsets = sets.offsets.to_numpy().astype(np.int64)
                starts, n = offsets[:-1] - offsets[0], np.diff(offsets)
                flat = sets.flatten().to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    mixed = _mix(flat.view(np.uint64))
                cells = bitmaps(mixed, starts)
                hidden = n - np.bitwise_count(cells).sum(1, dtype=np.int64)  # words that share a cell with another
                # words lie in the order of their hashes, which decides between equally frequent ones
                rank = np.argsort(np.repeat(np.arange(len(n)), n) << 40 | order[(mixed & np.uint64(len(order) - 1)).astype(np.int64)], kind="stable")
                mixed = mixed[rank]
                codes = (mixed >> np.uint64(24)).astype(np.uint16)
                sent = _cut(n, limit) + 1
                row, pos = np.repeat(np.arange(len(n)), sent), at(sent)
                tail = np.where(n <= LONG, np.minimum(n, sent + LEVELS - 1), 0)[row]
                tail = np.maximum(tail - pos - 1, 0)
                sizes = HEAD + tail
                ends = np.cumsum(sizes)
                out = np.empty(ends[-1] if len(ends) else 0, np.uint16)
                head = np.empty((len(row), HEAD // 2), np.int32)
                head[:, 0], head[:, 1], head[:, 2] = n[row], pos, hidden[row]
                head[:, 3:] = np.ascontiguousarray(cells[row]).view(np.int32)
                out[(ends - sizes)[:, None] + np.arange(HEAD)] = head.view(np.uint16)
                out[np.repeat(ends - sizes + HEAD, tail) + at(tail)] = codes[np.repeat(starts[row] + pos + 1, tail) + at(tail)]
                packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.concatenate(([0], 2 * ends)).astype(np.int32)), pa.py_buffer(out)])
                keys = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)[starts[row] + pos]
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("rep").take(pa.array(row)), packed], ["key", "rep", "packed"])

    return entries


def _together(key: np.ndarray) -> np.ndarray:
    """Places of the keys in their order, without groups of one entry."""
    order = np.argsort(key)
    group = key[order] >> 2
    same = group[1:] == group[:-1]
    return order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(key) else order


def _sides(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins, sizes, entries of side 2 and pairs of the groups of ordered keys."""
    starts = np.flatnonzero(np.diff(key >> 2, prepend=-1))
    sizes = np.diff(starts, append=len(key))
    second = np.add.reduceat(key & 3 == 2, starts, dtype=np.int64)
    return starts, sizes, second, np.where(key[starts] & 3 == 0, sizes * (sizes - 1) // 2, (sizes - second) * second)


class _Bucket:
    """Sets that share a word, from their packed entries, and the pairs of them that may be alike."""

    def __init__(self, packed: pa.Array, limit: tuple[int, int]):
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // 2
        self.data = np.frombuffer(packed.buffers()[2], np.uint16)
        head = np.ascontiguousarray(self.data[offsets[:-1, None] + np.arange(HEAD)]).view(np.int32)
        self.n, self.pos, self.hidden = (head[:, i].astype(np.int64) for i in range(3))
        self.cells = [np.ascontiguousarray(x) for x in np.ascontiguousarray(head[:, 3:]).view(np.uint64).T]
        self.tail = offsets[:-1] + HEAD
        self.limit, self.found = limit, []

    def all_pairs(self, level: int, row: np.ndarray, pos: np.ndarray, many: np.ndarray, first: np.ndarray) -> None:
        """Entry i meets the ``many[i]`` entries from ``first[i]`` on; keeps what bitmaps and the places of word number ``level`` in common allow to be alike."""
        cells, hidden, n = [c[row] for c in self.cells], self.hidden[row].astype(np.int32), self.n[row].astype(np.int32)
        after = (n - pos + level).astype(np.int32)  # a word before the shared one is missing from the other set, but for those shared before
        some = np.flatnonzero(many)
        many, first = many[some], first[some]
        ends, i = np.cumsum(many), 0
        while i < len(many):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            m = many[i:j]
            y = np.arange(ends[j - 1] - done) + np.repeat(first[i:j] - (ends[i:j] - m - done), m)
            each = lambda v, k=some[i:j], m=m: np.repeat(v[k], m)
            shared = np.bitwise_count(each(cells[0]) & cells[0][y])
            for c in cells[1:]:
                shared += np.bitwise_count(each(c) & c[y])
            both = each(n) + n[y]
            need = -(-self.limit[0] * both // sum(self.limit))
            kept = np.flatnonzero(shared + np.minimum(each(hidden), hidden[y]) >= need)
            x, y, need = each(np.arange(len(row)))[kept], y[kept], need[kept]
            kept = (after[x] > need) & (after[y] > need)
            x, y = row[x[kept]], row[y[kept]]
            x, y = np.minimum(x, y), np.maximum(x, y)
            self.found.append(np.stack([x, y], 1)[x != y])
            i = j

    def across(self, level: int, group: np.ndarray, row: np.ndarray, pos: np.ndarray, some: np.ndarray, others: np.ndarray) -> None:
        """Each of ``some`` meets those of ``others`` that lie in its group; groups are in order."""
        if some.any():
            g, o = group[some], group[others]
            first = np.searchsorted(o, g, "left")
            none = np.zeros(len(o), np.int64)
            many = np.searchsorted(o, g, "right") - first
            self.all_pairs(level, np.concatenate([row[some], row[others]]), np.concatenate([pos[some], pos[others]]), np.concatenate([many, none]), np.concatenate([first + len(g), none]))

    def within(self, level: int, key: np.ndarray, row: np.ndarray, pos: np.ndarray) -> None:
        """All pairs of the groups."""
        starts, sizes, second, _ = _sides(key)
        side, here = key & 3, np.arange(len(key))
        ends = np.repeat(starts + sizes, sizes)
        first = np.where(side == 0, here + 1, ends - np.repeat(second, sizes))
        self.all_pairs(level, row, pos, np.where(side == 2, 0, ends - first), first)

    def walk(self, level: int, key: np.ndarray, row: np.ndarray, pos: np.ndarray, lim: np.ndarray) -> None:
        """Pairs of entries (in order of key: group * 4 + side) that have ``level`` words in common, the last one at ``pos``.

        Side 0 meets itself, side 1 meets side 2; at most ``lim`` words of a set may be missing from the
        other. A large group is cut by the next word in common, unless that leaves it more than half its pairs.
        """
        _, sizes, _, number = _sides(key)
        split = np.repeat((number > SMALL) & (level < LEVELS), sizes)
        easy = ~split & np.repeat(number > 0, sizes)
        if easy.any():
            self.within(level, key[easy], row[easy], pos[easy])
        if not split.any():
            return
        key, row, pos, lim = key[split], row[split], pos[split], lim[split]
        group, n = key >> 2, self.n[row]
        # sets so small that the words shared so far are all they need
        self.across(level, group, row, pos, 2 * self.limit[0] * n <= level * sum(self.limit), self.limit[0] * n <= level * sum(self.limit))
        # sets without codes
        self.across(level, group, row, pos, n > LONG, self.limit[1] * n > self.limit[0] * LONG)
        many = np.where(n <= LONG, np.minimum(n - 1, lim + level) - pos, 0)
        going = many > 0
        if not going.any():
            return
        key, row, pos, lim, many = key[going], row[going], pos[going], lim[going], many[going]
        ends = np.cumsum(many)
        group = np.cumsum(np.diff(key >> 2, prepend=-1) != 0)
        key = group << 2 | key & 3
        i = 0
        while i < len(many):  # whole groups, as many as memory holds; the codes of one that is larger are taken in parts
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + ENTRIES, "right")))
            if j < len(many) and group[j] == group[j - 1]:
                j = int(np.searchsorted(group, group[j - 1], "right" if group[i] == group[j - 1] else "left"))
            parts = -(-int(ends[j - 1] - done) // (2 * ENTRIES))
            for p in range(parts):
                after, each, places = self.next_words(key[i:j], row[i:j], pos[i:j], many[i:j], p, parts)
                if parts == 1 and len(after):
                    _, sizes, _, left = _sides(after)
                    low = int(group[i])
                    kept = np.bincount((after[np.cumsum(sizes) - 1] >> 18) - low, left, int(group[j - 1]) - low + 1)
                    dense = 2 * kept > _sides(key[i:j])[3]
                    if dense.any():
                        mine = dense[group[i:j] - low]
                        self.within(level, key[i:j][mine], row[i:j][mine], pos[i:j][mine])
                        rest = ~dense[(after >> 18) - low]
                        after, each, places = after[rest], each[rest], places[rest]
                if len(after):
                    self.walk(level + 1, after, row[i:j][each], places, lim[i:j][each])
            i = j

    def next_words(self, key: np.ndarray, row: np.ndarray, pos: np.ndarray, many: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the groups by next word, in order, with the entry and the place of the word."""
        step = max(1, len(many) if parts == 1 else 65536)
        keys, froms, places = [], [], []
        for k in range(0, len(many), step):
            m = many[k : k + step]
            each = np.repeat(np.arange(k, k + len(m)), m)
            place = np.arange(len(each)) - np.repeat(np.cumsum(m) - m - pos[k : k + step] - 1, m)
            code = self.data[place + np.repeat((self.tail[row] - self.pos[row] - 1)[k : k + step], m)].astype(np.int64)
            if parts > 1:
                mine = code % parts == part
                each, place, code = each[mine], place[mine], code[mine]
            keys.append((key[each] & ~3) << 16 | code << 2 | key[each] & 3)
            froms.append(each)
            places.append(place)
        key, each, place = np.concatenate(keys), np.concatenate(froms), np.concatenate(places)
        order = _together(key)
        return key[order], each[order], place[order]

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets of a bucket are met by bands of their size: the sizes of both sides say how many words may be missing."""
        bucket = np.cumsum(np.diff(keys, prepend=keys[:1] - 1) != 0)
        edges = [1]
        while edges[-1] <= int(self.n.max(initial=1)):
            edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
        edges = np.array(edges)
        band = np.searchsorted(edges, self.n, "right") - 1
        cut, each = _cut(self.n, self.limit), np.arange(len(keys))
        taken = []
        for d in itertools.count():
            any_left = False
            for sign in (0,) if d == 0 else (1, 2):  # as the smaller side, as the larger side
                other = band + d if sign == 1 else band - d
                there = (other >= 0) & (other < len(edges) - 1)
                low, high = edges[np.where(there, other, 0)], edges[np.where(there, other, 0) + 1] - 1
                there &= (self.limit[0] * self.n <= self.limit[1] * high) & (self.limit[0] * low <= self.limit[1] * self.n)
                any_left |= bool(there.any())
                lim = np.minimum(self.n - -(-self.limit[0] * (self.n + low) // sum(self.limit)), cut)
                i = each[there & (self.pos <= lim)]
                taken.append((((bucket[i] * len(edges) + np.minimum(band, other)[i]) * len(edges) + d) << 2 | sign, i, lim[i]))
            if not any_left:
                break
        key, rows, lim = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = _together(key)
        rows = rows[order]
        if len(rows):
            self.walk(1, key[order], rows, self.pos[rows], lim[order])
        both = np.concatenate(self.found) if self.found else np.empty((0, 2), np.int64)
        one = np.unique(both[:, 0] * len(keys) + both[:, 1])
        return one // max(1, len(keys)), one % max(1, len(keys))


def _meet(limit: tuple[int, int]):
    """Pairs of entries (in order of their keys) that may be alike; whole buckets are looked at together."""

    def looked(held: list[pa.RecordBatch], upto: int | None) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
        table = pa.Table.from_batches(held).combine_chunks()
        rest = table.slice(upto).to_batches() if upto is not None else []
        table = table.slice(0, upto) if upto is not None else table
        x, y = _Bucket(table["packed"].chunk(0), limit).pairs(table["key"].to_numpy().astype(np.int64))
        a, b = (table["rep"].take(pa.array(i)).combine_chunks() for i in (x, y))
        low = pc.less(a, b)
        found = pa.Table.from_arrays([pc.if_else(low, a, b), pc.if_else(low, b, a)], ["rep_a", "rep_b"])
        return found.combine_chunks(), rest

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BUCKETS and batch.num_rows:
                last = batch.column("key")[-1].as_py()
                keys = np.concatenate([b.column("key").to_numpy() for b in held])
                begin = int(np.searchsorted(keys, last, "left"))
                if begin:
                    found, held = looked(held, begin)
                    rows = len(keys) - begin
                    yield from found.to_batches()
        if rows:
            yield from looked(held, None)[0].to_batches()

    return meet


def word_order(sets: DataFrame) -> np.ndarray:
    """How often the words of each of ``ORDER`` hash cells occur, whatever the number of words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER, np.int64)
        for batch in batches:
            flat = batch.column("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            with np.errstate(over="ignore"):
                total += np.bincount((_mix(flat) & np.uint64(ORDER - 1)).astype(np.int64), minlength=ORDER)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])

    found = sets.select("words").mapInArrow(counted, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order = np.zeros(ORDER, np.int64)
    order[found["cell"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(order, (1 << 40) - 1)


def word_classes(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(id, class_a, class_b): rows of one word set share the two halves of its 128-bit key."""
    # asked of the text, not of the words: a filter on them would cut them out twice
    some = rows.where(F.concat_ws(" ", *columns).rlike(r"[\p{L}\p{N}]"))
    keyed = some.select(F.col(key).alias("id"), words(columns).alias("words"))
    return keyed.select(
        "id", F.xxhash64("words").alias("class_a"), F.xxhash64(F.lit(7), "words").alias("class_b"), "words"
    )


def class_table(members: DataFrame) -> DataFrame:
    """One row per word set: its class, smallest id, number of copies and words (written once)."""
    return checkpoint(
        members.groupBy("class_a", "class_b").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("words").alias("words")
        )
    )


def like_classes(sets: DataFrame, numerator: int = 3, denominator: int = 5) -> DataFrame:
    """(rep_a, rep_b) of different word sets whose likeness is at least numerator / denominator."""
    kind = sets.schema["rep"].dataType.simpleString()
    entries = sets.select("rep", "words").mapInArrow(_entries(word_order(sets), (numerator, denominator)), f"key int, rep {kind}, packed binary")
    met = entries.repartition("key").sortWithinPartitions("key").mapInArrow(_meet((numerator, denominator)), f"rep_a {kind}, rep_b {kind}")
    candidates = met.distinct()
    wa = sets.select(F.col("rep").alias("rep_a"), F.col("words").alias("wa"))
    wb = sets.select(F.col("rep").alias("rep_b"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    either = F.size("wa") + F.size("wb") - both
    verified = candidates.join(wa.hint("merge"), "rep_a").join(wb.hint("merge"), "rep_b")
    return verified.where(both * denominator >= either * numerator).select("rep_a", "rep_b")


def like_pairs(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(id_a, id_b), smaller first: every pair of rows of likeness 3/5 or more."""
    members = checkpoint(word_classes(rows, key, columns))  # words are cut out once
    sets = class_table(members)
    links = like_classes(sets)
    named = members.select("id", "class_a", "class_b").join(sets.select("class_a", "class_b", "rep").hint("merge"), ["class_a", "class_b"])
    reps = checkpoint(named.select("id", "rep"))
    left, right = reps.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), reps.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = links.join(left.hint("merge"), "rep_a").join(right.hint("merge"), "rep_b")
    copies = left.join(right.hint("merge"), F.col("rep_a") == F.col("rep_b")).where("x < y")
    pairs = across.select("x", "y").unionByName(copies.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(id, group_id, n_links): every row with the smallest id of its group of linked rows.

    ``n_links`` counts the other word sets linked to the row's own. Components of the links between
    classes by label propagation with shortcuts; each round is checkpointed, the number of rounds
    is logarithmic in the length of the longest chain.
    """
    members = checkpoint(word_classes(rows, key, columns))
    sets = class_table(members)
    links = checkpoint(like_classes(sets))
    edges = links.unionByName(links.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
    labels = checkpoint(edges.groupBy(F.col("rep_a").alias("rep")).agg(F.min("rep_b").alias("m"), F.count("*").alias("n_links")).select("rep", F.least("rep", "m").alias("label"), "n_links"))
    while True:
        told = labels.select(F.col("rep").alias("rep_b"), "label").hint("merge")
        heard = edges.join(told, "rep_b").groupBy(F.col("rep_a").alias("rep")).agg(F.min("label").alias("heard"))
        near = labels.join(heard.hint("merge"), "rep").select("rep", F.least("label", "heard").alias("near"), F.col("label").alias("old"), "n_links")
        jump = near.select(F.col("rep").alias("near"), F.col("near").alias("far")).hint("merge")
        after = checkpoint(near.join(jump, "near", "left").select("rep", F.least("near", "far").alias("label"), "old", "n_links"))
        changed = after.where("label < old").limit(1).count()
        labels = after.select("rep", "label", "n_links")
        if not changed:
            break
    classes = sets.select("class_a", "class_b", "rep").join(labels.hint("merge"), "rep", "left")
    named = members.select("id", "class_a", "class_b").join(classes.hint("merge"), ["class_a", "class_b"])
    found = named.select("id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    wordless = rows.select(F.col(key).alias("id"), words(columns).alias("w")).where(F.size("w") == 0)
    return found.unionByName(wordless.select("id", F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links")))
