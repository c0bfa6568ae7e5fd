"""BM25 and letter-group cosine of texts packed side by side, in Arrow batches.

A search is cut out of rows that hold a corpus and its queries: the terms of a text never leave the
process that cut them, so what is shuffled are the texts, once. Documents stand in groups, numbered from
1; a query searches the first ones of a group and, in a second one, documents of its own. Texts come in
flattened: lower case, runs of white space as one blank.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa

K1, B = 1.2, 0.75
CHARS, HITS = 1_000_000, 2_000_000
#: A conversation of more sessions is searched by postings. Queries at a time there, in its windows, and else; sessions, windows, rows, scores, turns and places of letters at a time.
LONG, MANY, NEAR, FEW, DOCS, WINDOWS, ROWS, CELLS, LINES, PLACES = 256, 1024, 8, 32, 256, 4096, 20_000, 16_000_000, 10_000, 2_000_000
TABLE = 1 << 21  # letter groups that are numbered by a table, else by sorting
_TOKEN = re.compile("[a-z0-9]+")


def _letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and letter group of three, as often as they occur; a shorter text is its only group."""
    sizes = np.array([len(x) for x in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the end of the text
    size = sizes[owner]
    after = np.concatenate([codes, np.zeros(2, np.int64)])
    gram = codes | np.where(left > 1, after[1:-1], 0) << 21 | np.where(left > 2, after[2:], 0) << 42
    kept = (left > 2) | ((size < 3) & (left == size))
    return owner[kept], gram[kept]


def _words(known: dict[str, int]) -> Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]]:
    def cut(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [_TOKEN.findall(x) for x in texts]
        terms = [known.setdefault(w, len(known)) for x in each for w in x]
        return np.repeat(np.arange(len(texts)), [len(x) for x in each]), np.array(terms, np.int64)

    return cut


def _bags(texts: Sequence[str], cut: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Owner, term and count of the different terms of each text, some texts at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHARS):
            size += len(texts[end])
            end += 1
        owner, term = cut(texts[at:end])
        values, place = np.unique(term, return_inverse=True)
        both, count = np.unique(owner * max(len(values), 1) + place, return_counts=True)
        yield at + both // max(len(values), 1), values[both % max(len(values), 1)], count
        at = end


def _matches(queries: Sequence[str], docs: Sequence[str], group: np.ndarray, cut: Callable) -> tuple:
    """Counts of the queries' terms, the documents' counts of those terms by group and term, sums and squared sums of all counts."""
    bags = list(_bags(queries, cut))
    qo, qt, qn = (np.concatenate(x) for x in zip(*bags, strict=True)) if bags else (np.empty(0, np.int64),) * 3
    wanted, qt = np.unique(qt, return_inverse=True)
    total, square, found = np.zeros(len(docs)), np.zeros(len(docs)), []
    for do, dt, dn in _bags(docs, cut):
        total += np.bincount(do, dn, len(docs))
        square += np.bincount(do, dn * dn, len(docs))
        if len(wanted):
            place = np.minimum(np.searchsorted(wanted, dt), len(wanted) - 1)
            kept = wanted[place] == dt
            found.append((do[kept], place[kept], dn[kept]))
    do, dt, dn = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    key = group[do] * max(len(wanted), 1) + dt
    order = np.argsort(key, kind="stable")
    return qo, qt, qn, max(len(wanted), 1), key[order], do[order], dn[order], total, square


def scores(queries: Sequence[str], docs: Sequence[str], group: np.ndarray, pos: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first pair of each query, bm25, cosine) of every pair of a query and a document that it searches.

    ``asked`` has for each of its entries the group of each query and how many of its documents it
    searches; the pairs of a query follow each other by entry and place. Documents are in order of group and place.
    """
    sizes = [upto for _, upto in asked]
    n_docs = np.sum(sizes, 0)
    first = np.concatenate([[0], np.cumsum(n_docs)])
    starts = [first[:-1] + np.sum(sizes[:k], 0) if k else first[:-1] for k in range(len(asked))]
    bm25, dots = np.zeros(first[-1]), np.zeros(first[-1])
    doc_of = np.zeros(first[-1], np.int64)
    head = np.searchsorted(group, np.arange(group[-1] + 2 if len(group) else 1))
    for (g, upto), start in zip(asked, starts, strict=True):
        inside = np.arange(upto.sum()) - np.repeat(np.cumsum(upto) - upto, upto)
        doc_of[np.repeat(start, upto) + inside] = np.repeat(head[np.where(upto > 0, g, 0)], upto) + inside

    def hits(found: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row of the query's term, pair and document's count, some queries at a time."""
        qo, qt, _, width, key, do, dn, _, _ = found
        bounds = [(np.searchsorted(key, g[qo] * width + qt), np.searchsorted(key, g[qo] * width + qt, "right")) for g, _ in asked]
        many = np.concatenate([[0], np.cumsum(np.sum([hi - lo for lo, hi in bounds], 0))]) if len(qo) else np.zeros(1, np.int64)
        ends = np.flatnonzero(np.diff(qo, append=-1) != 0) + 1  # a query's terms stay together
        at = 0
        while at < len(qo):
            fit = ends[many[ends] <= many[at] + HITS]
            end = int(fit[-1]) if len(fit) and fit[-1] > at else int(ends[ends > at][0])
            rows, pairs, counts = [], [], []
            for (_, upto), start, (lo, hi) in zip(asked, starts, bounds, strict=True):
                n = (hi - lo)[at:end]
                row = np.repeat(np.arange(at, end), n)
                post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:end], n)
                place = pos[do[post]]
                kept = place <= upto[qo[row]]
                row, post, place = row[kept], post[kept], place[kept]
                rows.append(row), pairs.append(start[qo[row]] + place - 1), counts.append(dn[post])
            yield np.concatenate(rows), np.concatenate(pairs), np.concatenate(counts)
            at = end

    words = _matches(queries, docs, group, _words({}))
    qo, qn, lengths = words[0], words[2], words[7]
    mean = np.maximum(np.add.reduceat(np.append(lengths[doc_of], 0.0), first[:-1]) / np.maximum(n_docs, 1), 1.0) if len(n_docs) else n_docs
    for row, pair, n in hits(words):
        low = row.min() if len(row) else 0
        df = np.bincount(row - low)[row - low] if len(row) else row
        q = qo[row]
        norm = n + K1 * (1 - B + B * lengths[doc_of[pair]] / mean[q])
        worth = qn[row] * np.log1p((n_docs[q] - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / np.maximum(norm, 1e-9)
        np.add.at(bm25, pair, worth)
    groups = _matches(queries, docs, group, _letters)
    own = np.sqrt(np.bincount(groups[0], groups[2] * groups[2], len(queries)))
    for row, pair, n in hits(groups):
        np.add.at(dots, pair, groups[2][row] * n)
    size = np.repeat(own, n_docs) * np.sqrt(groups[8])[doc_of] if len(doc_of) else dots
    return first, bm25, np.divide(dots, size, out=np.zeros(len(dots)), where=size > 0)


def best(first: np.ndarray, bm25: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, its pair counted from 0, rank, score) of the first ``k`` pairs by the mean of both scores scaled to 0..1, ties by place."""
    n = np.diff(first)
    query = np.repeat(np.arange(len(n)), n)
    score = np.zeros(len(bm25))
    some = np.flatnonzero(n)
    for x in (bm25, cosine):
        low, high = np.zeros(len(n)), np.zeros(len(n))
        if len(some):
            low[some], high[some] = np.minimum.reduceat(x, first[some]), np.maximum.reduceat(x, first[some])
        span = high - low
        flat = np.where(high <= 0, 0.0, 1.0)
        score += 0.5 * np.where(span[query] < 1e-9, flat[query], (x - low[query]) / np.where(span < 1e-9, 1.0, span)[query])
    score = np.floor(score * 1e9 + 0.5) / 1e9  # scores that differ by the order of additions only are ties
    order = np.lexsort((np.arange(len(score)), -score, query))
    rank = np.arange(len(score)) - first[query] + 1
    kept = rank <= k
    return query[kept], order[kept] - first[query[kept]], rank[kept], score[order[kept]]


def _parts(batches: Iterator[pa.RecordBatch], size: str) -> Iterator[list[dict]]:
    """Rows of the batches, as many at a time as have ``CHARS`` characters."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            end, chars = at, 0
            while end < batch.num_rows and (end == at or chars < CHARS):
                chars += batch.column(size)[end].as_py()
                end += 1
            yield batch.slice(at, end - at).to_pylist()
            at = end


def local_top(k: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (turns: turn and text in order; asked: query_id, upto and text) to (query_id, turn, rank, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches, "chars"):
            asked = [(i, a) for i, r in enumerate(rows) for a in r["asked"]]
            sizes = np.array([len(r["turns"]) for r in rows], np.int64)
            group = np.repeat(np.arange(len(rows)), sizes)
            pos = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            of, upto = np.array([i for i, _ in asked], np.int64), np.array([a["upto"] for _, a in asked], np.int64)
            pairs = scores([a["text"] for _, a in asked], [t["text"] for r in rows for t in r["turns"]], group, pos, [(of, upto)])
            query, at, rank, score = best(*pairs, k)
            ids, turns = [asked[i][1]["query_id"] for i in query], [rows[asked[i][0]]["turns"][j]["turn"] for i, j in zip(query, at, strict=True)]
            yield pa.RecordBatch.from_pydict({"query_id": ids, "turn": turns, "rank": rank.astype(np.int32), "score": score}, schema=schema)

    return run


class _History:
    """The turns of a conversation and its queries, cut up once: a document is a range of turns.

    Turns are one text with a blank between them, so the letter groups and words of a document are
    those of a range of places. Counts are dense, for some documents at a time; their products are exact.
    """

    def __init__(self, lines: Sequence[str], queries: Sequence[str]):
        n = np.array([len(x) for x in lines], np.int64)
        self.begin = np.cumsum(n + (n > 0)) - n - (n > 0)
        self.end = self.begin + np.where(n > 0, n, -1)
        texts = [" ".join(x for x in lines if x), *queries]
        sizes = np.array([len(x) for x in texts], np.int64)
        self.asked_end = np.cumsum(sizes)[1:]
        self.asked_begin = self.asked_end - sizes[1:]
        self.short = {x: i for i, x in enumerate(dict.fromkeys(x for x in queries if 0 < len(x) < 3))}
        self.text = "".join(texts)
        del texts
        self._cut()
        known: dict[str, int] = {}
        many, parts = [], [np.zeros(0, np.int32)]
        for i in range(0, len(lines), LINES):
            each = [_TOKEN.findall(x) for x in lines[i : i + LINES]]
            many.extend(len(x) for x in each)
            parts.append(np.array([known.setdefault(w, len(known)) for x in each for w in x], np.int32))
        self.words = np.concatenate(parts)
        self.at = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        self.n_words = max(len(known), 1)
        both = [(i * self.n_words + known[w]) for i, x in enumerate(queries) for w in _TOKEN.findall(x) if w in known]
        key, self.times = np.unique(np.array(both, np.int64), return_counts=True)
        self.asker, self.term = key // self.n_words, key % self.n_words

    def _cut(self) -> None:
        """Number the letter group at every place of the text, a slice at a time."""
        codes = lambda i: np.frombuffer(self.text[i : i + CHARS + 2].ljust(min(len(self.text) - i, CHARS) + 2).encode("utf-32-le"), np.uint32)
        places = range(0, len(self.text), CHARS)
        there = np.zeros(max([32, *[int(codes(i).max()) for i in places]]) + 1, bool)
        there[32] = True
        for i in places:
            there[codes(i)] = True
        index = np.cumsum(there) * there
        base = int(index.max()) + 1

        def slices() -> Iterator[tuple[int, np.ndarray]]:
            for i in places:
                x = index[codes(i)]
                yield i, x[:-2] + base * (x[1:-1] + base * x[2:])

        if base**3 <= TABLE:
            table = np.zeros(base**3, bool)
            for _, x in slices():
                table[x] = True
            kinds, number = np.flatnonzero(table), np.empty(base**3, np.int32)
            number[kinds] = np.arange(len(kinds))
        else:
            kinds = np.zeros(0, np.int64)
            for _, x in slices():
                kinds = np.union1d(kinds, x)
        width = len(kinds)
        self.groups = np.empty(len(self.text), np.uint16 if width < 1 << 16 else np.int32)
        for i, x in slices():
            self.groups[i : i + len(x)] = number[x] if base**3 <= TABLE else np.searchsorted(kinds, x)
        self.n_groups, self.width = width, width + len(self.short) + 1  # texts of less than three characters are their only group

    def fits(self, longest: int) -> None:
        """Whole numbers are exact below 2**24 in single precision."""
        most = max(longest, int((self.asked_end - self.asked_begin).max(initial=0)))
        self.kind = np.float32 if most * most < 1 << 24 else np.float64

    def _bags(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        bag = _counted(self.groups, begin, end - 2, self.width)
        for i in np.flatnonzero((end - begin == 1) | (end - begin == 2)).tolist():
            bag[i, self.n_groups + self.short.get(self.text[begin[i] : end[i]], len(self.short))] += 1
        return bag.astype(self.kind)

    def asked(self, a: int, b: int) -> np.ndarray:
        return self._bags(self.asked_begin[a:b], self.asked_end[a:b])

    def groups_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Counts of the letter groups of the documents of turns ``low`` to before ``high``."""
        return self._bags(self.begin[low], self.end[high - 1])

    def words_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _counted(self.words, self.at[low], self.at[high], self.n_words)

    def length(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.at[high] - self.at[low]).astype(float)

    def terms(self, a: int, b: int) -> slice:
        return slice(int(np.searchsorted(self.asker, a)), int(np.searchsorted(self.asker, b)))

    def top(self, a: int, asked: np.ndarray, low: np.ndarray, high: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
        """For the queries from ``a``: the first ``k`` documents of those that each holds (-1: no more)."""
        bags, terms = self.groups_of(low, high), self.terms(a, a + len(asked))
        query, term, times = self.asker[terms] - a, self.term[terms], self.times[terms]
        n_docs, length = held.sum(1), self.length(low, high)
        mean = np.maximum((held @ length) / np.maximum(n_docs, 1), 1.0)
        n = self.words_of(low, high).T[term].astype(float)
        worth = times * _rare(n_docs[query], ((n > 0) & held[query]).sum(1))
        norm = n + (K1 * (1 - B + B * length / mean[:, None]))[query]
        bm25 = np.zeros(held.shape)
        if len(query):
            first = np.flatnonzero(np.diff(query, prepend=-1))
            bm25[query[first]] = np.add.reduceat(worth[:, None] * n * (K1 + 1) / np.maximum(norm, 1e-9), first)
        return _first(bm25, _cosine(asked @ bags.T, _squares(asked)[:, None], _squares(bags)), held, k)


def _counted(values: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Counts of the values of each range of places, a row for each."""
    n = np.maximum(end - begin, 0)
    if n.sum() > PLACES:  # long sessions: slice by slice
        out = np.zeros((len(n), width), np.int64)
        for i, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            for x in range(b, e, PLACES):
                out[i] += np.bincount(values[x : min(x + PLACES, e)], minlength=width)
        return out
    at = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
    return np.bincount(np.repeat(np.arange(len(n)) * width, n) + values[at], minlength=len(n) * width).reshape(len(n), width)


def _rare(n_docs: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.log1p((n_docs - df + 0.5) / (df + 0.5))


def _squares(bags: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", bags, bags).astype(float)


def _cosine(dots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt(a) * np.sqrt(b)
    return np.divide(dots, size, out=np.zeros(size.shape), where=size > 0)


def _first(bm25: np.ndarray, cosine: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """Columns of the first ``k`` by the mean of both scores scaled to 0..1 in a row, ties by column; as ``best``."""
    score = np.zeros(held.shape)
    for x in (bm25, cosine):
        low, high = (f(np.where(held, x, empty), 1, keepdims=True) for f, empty in ((np.min, np.inf), (np.max, -np.inf)))
        flat = high - low < 1e-9
        score += 0.5 * np.where(flat, high > 0, (x - low) / np.where(flat, 1.0, high - low))
    score = np.where(held, np.floor(score * 1e9 + 0.5) / 1e9, -np.inf)
    out, rows = np.full((len(score), k), -1), np.arange(len(score))
    for i in range(min(k, score.shape[1])):
        at = score.argmax(1)
        out[:, i] = np.where(score[rows, at] > -np.inf, at, -1)
        score[rows, at] = -np.inf
    return out


def _sessions(h: _History, starts: np.ndarray, upto: np.ndarray, whole: np.ndarray, kept: int, a: int, asked: np.ndarray) -> np.ndarray:
    """The best sessions of some queries; of its own session a query knows the turns up to its place."""
    n = int(whole.max())
    ends, of = np.unique(upto, return_inverse=True)
    low = np.concatenate([starts[:n], starts[np.searchsorted(starts, ends) - 1]])
    held = np.concatenate([np.arange(n) < whole[:, None], np.arange(len(ends)) == of[:, None]], 1)
    best = h.top(a, asked, low, np.concatenate([starts[1 : n + 1], ends]), held, kept)
    return np.where(best >= n, whole[:, None], best)


class _Postings:
    """Words and squares of the sessions of a long conversation."""

    def __init__(self, h: _History, starts: np.ndarray, last: int):
        self.n, self.low, self.high = last, starts[:last], starts[1 : last + 1]
        self.length = h.length(self.low, self.high)
        doc = np.repeat(np.arange(last), self.length.astype(np.int64))
        self.key, count = np.unique(h.words[: len(doc)] * max(last, 1) + doc, return_counts=True)
        self.doc, self.count = self.key % max(last, 1), count.astype(float)
        self.squares = np.concatenate([np.zeros(0), *[_squares(h.groups_of(self.low[i : i + DOCS], self.high[i : i + DOCS])) for i in range(0, last, DOCS)]])
        self.total = np.concatenate([[0.0], np.cumsum(self.length)])

    def top(self, h: _History, starts: np.ndarray, upto: np.ndarray, whole: np.ndarray, kept: int, a: int, asked: np.ndarray) -> np.ndarray:
        """As ``_sessions``: products block by block of sessions, words by their postings up to the place of a query."""
        dots = np.empty((len(asked), int(whole.max()) + 1), h.kind)
        for i in range(0, dots.shape[1] - 1, DOCS):
            j, know = min(i + DOCS, dots.shape[1] - 1), int(np.searchsorted(whole, i, "right"))  # earlier queries end before these sessions
            dots[know:, i:j] = asked[know:] @ h.groups_of(self.low[i:j], self.high[i:j]).T
        own = h.groups_of(starts[whole], upto)
        dots[np.arange(len(asked)), whole] = np.einsum("ij,ij->i", asked, own)
        mine, squares = _squares(own), _squares(asked)
        heard, said = h.words_of(starts[whole], upto), h.length(starts[whole], upto)
        out = np.empty((len(asked), kept), np.int64)
        for j, n in enumerate(whole.tolist()):
            terms = h.terms(a + j, a + j + 1)
            term, times, local = h.term[terms], h.times[terms], heard[j, h.term[terms]]
            low, high = np.searchsorted(self.key, term * max(self.n, 1)), np.searchsorted(self.key, term * max(self.n, 1) + n)
            worth = times * _rare(n + 1, high - low + (local > 0)) * (K1 + 1)
            base = K1 * (1 - B + B * np.append(self.length[:n], said[j]) / max((self.total[n] + said[j]) / (n + 1), 1.0))
            bm25 = np.zeros(n + 1)
            for x, i, k in zip(worth.tolist(), low.tolist(), high.tolist(), strict=True):  # a session is once among the postings of a word
                doc, count = self.doc[i:k], self.count[i:k]
                bm25[doc] += x * count / (count + base[doc])
            bm25[n] = (worth * local / np.maximum(local + base[n], 1e-9)).sum()
            cosine = _cosine(dots[j, : n + 1], squares[j], np.append(self.squares[:n], mine[j]))
            out[j] = _first(bm25[None], cosine[None], np.ones((1, n + 1), bool), kept)
        return out


def _context(said: list[tuple[int, str, str]], asked: list[tuple], sessions_kept: int, windows_kept: int, radius: int) -> Iterator[tuple[object, int, str]]:
    """(query_id, pos, dia_id) of a conversation's turns (session, dia_id, text) for its queries (query_id, upto, text)."""
    asked = sorted(asked, key=lambda x: x[1])
    lines, texts = [x[2] for x in said], [x[2] for x in asked]
    h = _History(lines, texts)
    session = [x[0] for x in said]
    starts = np.array([i for i in range(len(said)) if not i or session[i] != session[i - 1]] + [len(said)], np.int64)
    upto = np.array([x[1] for x in asked], np.int64)
    whole = np.searchsorted(starts, upto) - 1  # sessions before the query's own
    frame = min(2 * radius, len(said) - 1)
    h.fits(int(max((h.end[starts[1:] - 1] - h.begin[starts[:-1]]).max(), (h.end[frame:] - h.begin[: len(said) - frame]).max())))
    long = len(starts) > LONG
    far = _Postings(h, starts, int(whole.max())) if long else None
    many = min(MANY, CELLS // len(starts) + 1) if long else FEW
    for a in range(0, len(asked), many):
        b = min(a + many, len(asked))
        bags = h.asked(a, b)
        best = (far.top if far else _sessions)(h, starts, upto[a:b], whole[a:b], sessions_kept, a, bags)
        step = NEAR if long else FEW
        for c in range(a, b, step):
            yield from _windows(h, lines, said, asked[c : min(c + step, b)], c, bags[c - a : c - a + step], starts, whole[c:b], best[c - a : c - a + step].tolist(), windows_kept, radius)


def _windows(h: _History, lines: list[str], said: list, asked: list, a: int, bags: np.ndarray, starts: np.ndarray, whole: np.ndarray, sessions: list, kept: int, radius: int) -> Iterator[tuple[object, int, str]]:
    """The best windows around a turn, of those that begin in a chosen session, or of all if none does."""
    chosen = []
    for j, (_, upto, _) in enumerate(asked):
        centers: set[int] = set()
        for s in sessions[j]:
            if s >= 0:
                begin, end = int(starts[s]), upto if s == whole[j] else int(starts[s + 1])
                centers.update(range(begin + radius if begin else 0, min(end + radius, upto)))
        chosen.append(sorted(centers) or list(range(upto)))
    span = lambda c, upto: (max(c - radius, 0), min(c + radius + 1, upto))
    found: list[list[int]] = [[] for _ in asked]
    small = [j for j, c in enumerate(chosen) if len(c) <= WINDOWS]
    docs = {x: i for i, x in enumerate(sorted({(c, span(c, asked[j][1])[1]) for j in small for c in chosen[j]}))}
    if docs:
        held = np.zeros((len(asked), len(docs)), bool)
        for j in small:
            held[j, [docs[c, span(c, asked[j][1])[1]] for c in chosen[j]]] = True
        center = [c for c, _ in docs]
        low, high = np.array([max(c - radius, 0) for c in center], np.int64), np.array([x for _, x in docs], np.int64)
        for j, row in enumerate(h.top(a, bags, low, high, held, kept).tolist()):
            found[j] = [center[i] for i in row if i >= 0]
    for j in set(range(len(asked))) - set(small):  # too many for dense counts
        texts = [" ".join(x for x in lines[slice(*span(c, asked[j][1]))] if x) for c in chosen[j]]
        n = len(texts)
        _, at, _, _ = best(*scores([asked[j][2]], texts, np.zeros(n, np.int64), np.arange(n) + 1, [(np.zeros(1, np.int64), np.array([n]))]), kept)
        found[j] = [chosen[j][i] for i in at.tolist()]
    for (query, upto, _), centers in zip(asked, found, strict=True):
        for p in sorted({p for c in centers for p in range(*span(c, upto))}):
            yield query, p + 1, said[p][1]


def _written(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def session_first(sessions_kept: int, windows_kept: int, radius: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (turns: a conversation in order with session, dia_id and text; asked: query_id, upto and text) to (query_id, pos, dia_id).

    The best sessions of the history up to the place of a query come first, then the best windows around
    a turn, of those that begin in a chosen session, or of all if none does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = (r for batch in batches for r in batch.to_pylist())
        each = (([(t["session"], t["dia_id"], t["text"]) for t in r["turns"]], [(x["query_id"], x["upto"], x["text"]) for x in r["asked"]]) for r in packed)
        yield from _written((x for said, asked in each if asked for x in _context(said, asked, sessions_kept, windows_kept, radius)), schema)

    return run


def sorted_session_first(sessions_kept: int, windows_kept: int, radius: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """As ``session_first``, of rows in order of conversation, part, session, turn: a turn (query_id null; dia_id, and
    speaker, text and voice as ``head``, ``body``, ``tail``), then the queries that it anchors (question, null and options)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple[list, list]]:
            said: list[tuple[int, str, str]] = []
            asked: list[tuple] = []
            now = last = body = None
            for batch in batches:
                for conversation, part, session, turn, is_query, query, dia, head, text, tail in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if (conversation, part) != now:
                        if asked:
                            yield said, asked
                        now, said, asked, last = (conversation, part), [], [], None
                    if not is_query:
                        said.append((session, dia, " ".join(x for x in (head, text, tail) if x)))
                        last, body = (session, turn), text
                    elif last == (session, turn):  # else there is no such turn
                        asked.append((query, len(said), " ".join(x for x in (head, body, tail) if x)))
            if asked:
                yield said, asked

        yield from _written((x for said, asked in conversations() for x in _context(said, asked, sessions_kept, windows_kept, radius)), schema)

    return run
