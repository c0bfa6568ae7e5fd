"""Token ids of whole texts with a public byte-level tokenizer, by prefix dynamic programming.

For every prefix of a piece's bytes exactly one token can come last in its encoding: the token that
ends there, follows a prefix whose own last token it may follow (the two bytes strings together
encode to just these two tokens), and is its own encoding. Storing that token per prefix gives the
encoding by walking back, makes appending exact without touching earlier prefixes (``Growing``), and
lets an edited text be encoded again from the edit only (``Codec.edit``). Candidates that end at a position come from an
Aho-Corasick automaton over the vocabulary, so a piece of any length takes time linear in it.

Texts are cut into pieces by the vocabulary's own pattern first; pieces repeat, so their ids are
kept in a bounded cache of each worker. The vocabulary is a file whose path is a parameter; it is
read once per worker and never shipped with the plan.

Defined cases: null, empty and absent text have an empty list of ids; strings of special tokens are
ordinary text; rows are never dropped, repeated rows are encoded each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a worker keeps; beyond it the cache starts anew (speed only, never results).
CACHED_PIECES = 200_000
#: Byte length beyond which a piece is not kept in the cache.
CACHED_LENGTH = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PrefixTable:
    """The last token of every prefix of one growing byte string."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.data, self.last = codec, bytearray(), []

    def append(self, more: bytes) -> None:
        """Encode further bytes; the table of the earlier prefixes stays as it is."""
        start = len(self.data)
        self.data += more
        self.codec.fill(bytes(self.data), self.last, start)

    def cut(self, length: int) -> None:
        """Keep only the first ``length`` bytes."""
        del self.data[length:]
        del self.last[length:]

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Edit the bytes [start, stop): prefixes before the edit are kept, the rest is encoded again."""
        tail = bytes(self.data[stop:])
        self.cut(start)
        self.append(new + tail)

    def ids(self) -> list[int]:
        return self.codec.walk(self.last, len(self.data))


class Codec:
    """A byte-level vocabulary with ranks as merge order."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import ahocorasick
        import regex

        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pieces = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging in rank order of a short byte string (at most two tokens long)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 30))
            joined = parts[best] + parts[best + 1]
            if joined not in self.ranks:
                break
            parts[best : best + 2] = [joined]
        return [self.ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, before: int, token: int) -> bool:
        pair = (before, token)
        if (known := self.follows.get(pair)) is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            known = self.follows[pair] = self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return known

    def fill(self, data: bytes, last: list[int], start: int) -> None:
        """Extend ``last`` from ``start`` to the end: the one valid last token of each prefix."""
        at = start
        # a token that ends after ``start`` may begin before it
        begin = max(0, start - self.longest)
        options: list[tuple[int, int]] = []
        where = start

        def settle() -> None:
            for token, size in options:
                before = where + 1 - size
                if before < 0:
                    continue
                if self.stands(token) and (before == 0 or self.may_follow(last[before - 1], token)):
                    last.append(token)
                    return
            raise ValueError("the vocabulary lacks single bytes")

        for end, (token, size) in self.automaton.iter(data[begin:].decode("latin-1")):
            end += begin
            if end < at:
                continue
            if end != where:
                settle()
                options = []
                where = end
            options.append((token, size))
        if len(data) > start:
            settle()

    def walk(self, last: list[int], end: int) -> list[int]:
        ids = []
        while end > 0:
            token = last[end - 1]
            ids.append(token)
            end -= len(self.bytes_of[token])
        return ids[::-1]

    def piece(self, piece: str) -> tuple[int, ...]:
        known = self.cache.get(piece)
        if known is None:
            data = piece.encode("utf-8", "surrogatepass")
            token = self.ranks.get(data)
            if token is not None and self.stands(token):
                known = (token,)
            else:
                last: list[int] = []
                self.fill(data, last, 0)
                known = tuple(self.walk(last, len(data)))
            if len(piece) <= CACHED_LENGTH:
                if len(self.cache) >= CACHED_PIECES:
                    self.cache.clear()
                self.cache[piece] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        piece = self.piece
        for part in self.pieces.findall(text):
            ids.extend(piece(part))
        return ids

    def edit(self, text: str, ids: list[int], new: str) -> list[int]:
        """Ids of ``new`` from those of ``text``: only the pieces between the common ends are encoded again."""
        old_parts, new_parts = self.pieces.findall(text), self.pieces.findall(new)
        head = 0
        while head < min(len(old_parts), len(new_parts)) and old_parts[head] == new_parts[head]:
            head += 1
        tail = 0
        while tail < min(len(old_parts), len(new_parts)) - head and old_parts[-1 - tail] == new_parts[-1 - tail]:
            tail += 1
        kept = sum(len(self.piece(p)) for p in old_parts[:head])
        end = sum(len(self.piece(p)) for p in old_parts[len(old_parts) - tail :])
        middle = [i for p in new_parts[head : len(new_parts) - tail] for i in self.piece(p)]
        return ids[:kept] + middle + (ids[len(ids) - end :] if end else [])


class Growing:
    """A text that grows at its end; what cannot change any more is neither split nor encoded again.

    How far a piece of the pattern goes is settled by at most ``AHEAD`` characters behind it, so pieces that
    end before that are final. The last piece keeps its table of prefixes and is extended in it.
    """

    AHEAD = 3

    def __init__(self, codec: Codec) -> None:
        self.codec, self.final, self.open = codec, [], ""
        self.piece, self.table = "", PrefixTable(codec)

    def append(self, more: str) -> None:
        self.open += more
        at = 0
        for part in self.codec.pieces.findall(self.open):
            if at + len(part) > len(self.open) - self.AHEAD:
                break
            self.final.extend(self._encoded(part))
            at += len(part)
        self.open = self.open[at:]

    def _encoded(self, part: str) -> list[int]:
        if not (self.piece and part.startswith(self.piece)):
            self.piece, self.table = "", PrefixTable(self.codec)
        self.table.append(part[len(self.piece) :].encode("utf-8", "surrogatepass"))
        self.piece = part
        return self.table.ids()

    def ids(self) -> list[int]:
        """Ids of the whole text so far."""
        parts = self.codec.pieces.findall(self.open)
        return [*self.final, *(i for p in parts[:-1] for i in self.codec.piece(p)), *(self._encoded(parts[-1]) if parts else [])]


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def token_ids(text: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Column of the ids (array<int>) of a text column."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(vocabulary, pattern)
        for batch in batches:
            yield pd.Series([c.encode(t) for t in batch], dtype=object)

    return encode(text)


def token_count(text: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Column of the number of ids of a text column; the ids stay in the worker."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(vocabulary, pattern)
        for batch in batches:
            yield pd.Series([len(c.encode(t)) for t in batch], dtype="int32")

    return count(text)


def encoded(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""
    return documents.select("doc_id", F.coalesce(token_ids(F.col("text"), vocabulary, pattern), F.array().cast("array<int>")).alias("ids"))
