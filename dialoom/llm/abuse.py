"""Abusive, hateful or sexual content: a counterfactual-regularised sentence classifier.

Texts are undisguised first (look-alike letters, zero-width marks, spaced, stretched and starred
words), cut into sentences, and a logistic model over hashed words, word pairs and letter groups
scores each sentence; the document's score is the highest. The model is
trained on general labelled sentences and on reviewers' verdicts. For each labelled sentence that names a
group the same sentence with other groups, all other words kept, is a counterfactual, and the squared
difference of the two scores is penalised, so that no group's name carries weight; the names are words
like any other, none is masked. Verdicts are a bounded sample of whole documents: which of their
sentences they mean is found from the odds of word pairs between judged and cleared documents.

Training is on the driver over at most ``LABELLED_DOCUMENTS`` documents; scoring is a narrow map
over all rows, whole texts, and the model (fixed size) goes with the plan.

Defined cases: null, empty and blank texts score 0; extra columns are ignored; repeated rows
are scored each; contradicting verdicts leave a document out of training; without any verdict the
labelled sentences alone train the model.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import abuse_seed as seed

LABELLED_DOCUMENTS = 3000
DIMENSIONS = 1 << 18
THRESHOLD, SURE, ODDS, EVIDENCE = 0.5, 0.9, 1.0, 0.8
#: Other groups a labelled sentence is paired with, and what the squared difference of the scores weighs.
COUNTERFACTUALS, COUNTERFACTUAL_WEIGHT = 3, 2.0
#: Sentences of more words are also read in overlapping windows of so many words.
LONG_SENTENCE, WINDOW = 16, 12
#: Not trained: a sentence of which the model knows nothing is harmless.
BIAS = -2.0

_ALIKE = "аеорсхуіѕјкмтвнοαειρυκντ"
_LOOKALIKE = str.maketrans(_ALIKE, "aeopcxyisjkmtbhoaeipukvt")
_MAYBE_ALIKE = re.compile(f"[^\\W\\d_]*[{_ALIKE}][^\\W\\d_]*")
_LATIN_LETTER = re.compile("[a-z]")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿︎️]")
_SPLITTING = re.compile("(?<=[a-z])[֐-׿؀-ۿऀ-෿฀-๿぀-ヿ㐀-鿿가-힯\U0001f000-\U0001ffff☀-➿]+(?=[a-z])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ \-._*]){2,}[^\W\d_](?![^\W_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_STARRED = re.compile(r"[^\W\d_]+[*#%]+[^\W\d_]+|[^\W\d_][*#]{2,}")
_MAYBE_LEET = re.compile(r"[a-z][0-9@$+]|[0-9@$+][a-z@$+]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)]*\s+|[\n\r]+")
_SPEAKER = re.compile(r"^[^\S\n\r]*(?:D\d+:\d+\s+\w+\s+-\s+|\[\w+\]\s*|[A-Z]\w+:\s+)", re.M)
_SAID = re.compile(r"^\s*(?:d\d+:\d+\s+\w+\s+-\s+|\[\w+\]\s*|\w+:\s+)")
_LEET = str.maketrans("013457@$+!", "oieastasti")
_LEETED = re.compile(r"(?<![\w@$+])(?=[\w@$+!]*[a-z@$+])(?=[\w@$+!]*[0134579@$+!])[a-z0-9@$+!]+[a-z0-9@$+]")
_LEXICON = sorted({*seed.INSULTS, *seed.ADJECTIVES, "fuck", "fucking", "shit", "mouth", "trash", "sex", "naked", "nudes", "horny", "tits", "animals", "vermin",
                   "filthy", "scum", "kill", "breed", "disease", "gueule", "fresse", "puta", "mierda", "salope", "connard", "arschloch", "idiota", "cock", "body", "blood", "cage"})


def _unstar(word: str) -> str:
    """A starred word as the known word of its length with the same visible letters."""
    pattern = re.compile("".join("." if ch in "*#%" else re.escape(ch) for ch in word) + r"\Z")
    return next((w for w in _LEXICON if pattern.match(w)), word)


def _folded(m: re.Match) -> str:
    """Look-alike letters as the Latin ones: in words of mixed script, and in words made of nothing else."""
    word = m[0]
    mixed = _LATIN_LETTER.search(word) or (len(word) > 2 and all(ch in _ALIKE for ch in word))
    return word.translate(_LOOKALIKE) if mixed else word


def undisguised(text: str) -> str:
    """Lower-case text with the usual disguises taken off; words of other scripts stay."""
    text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text).replace("â€™", "'")).replace("’", "'").lower()
    if not text.isascii():
        text = _SPLITTING.sub("", _MAYBE_ALIKE.sub(_folded, text))
    text = _SPACED.sub(lambda m: re.sub(r"[ \-._*]", "", m[0]), text)
    if "*" in text or "#" in text or "%" in text:
        text = _STARRED.sub(lambda m: _unstar(m[0]), text)
    if _MAYBE_LEET.search(text):
        text = _LEETED.sub(lambda m: m[0].translate(_LEET), text)
    return _STRETCHED.sub(r"\1", text)


def sentences(text: str) -> list[str]:
    """Undisguised sentences, speaker marks left out."""
    return [p for s in _SENTENCE.split(undisguised(_SPEAKER.sub("", text))) if (p := _SAID.sub("", s).strip())]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def _pair(a, b):
    """Place of a pair of words by their hashes, of numbers or of arrays."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) & (DIMENSIONS - 1)


def _word_features(word: str) -> list[int]:
    groups = [word[i : i + 4] for i in range(len(word) - 3)] if len(word) >= 5 and word[0] != "<" else []
    return [_hash(g) & (DIMENSIONS - 1) for g in ("w" + word, *("c" + g for g in groups))]


def _words(sentence: str) -> list[str]:
    """Words of an undisguised sentence; numbers are one symbol, a word still starred is another at the end."""
    words = ["<num>" if w.isdigit() else w for w in _WORD.findall(sentence)]
    if words and "*" in sentence and _STARRED.search(sentence):
        words.append("<starred>")
    return words


def windows(words: list[str]) -> list[list[str]]:
    """Overlapping windows of a long sentence: a passage may lack the marks that would set it apart."""
    if len(words) <= LONG_SENTENCE:
        return []
    return [words[i : i + WINDOW] for i in range(0, len(words) - WINDOW // 2, WINDOW // 2)]


def word_pairs(words: list[str]) -> list[int]:
    marked = [_hash("<s>"), *map(_hash, words), _hash("</s>")]
    return [_pair(a, b) for a, b in zip(marked, marked[1:])]


def features(words: list[str]) -> list[int]:
    """Hashed words with their letter groups, and pairs of words, each as often as it occurs."""
    if not words:
        return []
    return [f for w in words for f in _word_features(w)] + word_pairs(words)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.weights = np.asarray(self.weights, float)
        self._forget()

    def _forget(self) -> None:
        self.place = {"<s>": 0, "</s>": 1}
        self.hashes, self.sums, self.counts = [_hash("<s>"), _hash("</s>")], [0.0, 0.0], [0, 0]

    def _learn(self, word: str) -> int:
        found = _word_features(word)
        self.hashes.append(_hash(word))
        self.sums.append(float(self.weights[found].sum()))
        self.counts.append(len(found))
        at = self.place[word] = len(self.place)
        return at

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Score of each list of words, or of its worst window, all of them at once.

        Sums over the features of a word are kept; sums over sentences and windows are differences of
        running totals, a window having two pairs of its own at its ends.
        """
        if len(self.place) > 200_000:
            self._forget()
        place, learn = self.place, self._learn
        flat: list[int] = []
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for words in texts:
            flat.append(0)
            for w in words:
                at = place.get(w)
                flat.append(learn(w) if at is None else at)
            flat.append(1)
        ids = np.asarray(flat, np.int64)
        hashes = np.asarray(self.hashes, np.uint64)[ids]
        with np.errstate(over="ignore"):
            joined = self.weights[_pair(hashes[:-1], hashes[1:]).astype(np.int64)] if len(ids) else np.zeros(0)
        word = np.r_[0.0, np.cumsum(np.asarray(self.sums)[ids])]
        count = np.r_[0, np.cumsum(np.asarray(self.counts)[ids])]
        pair = np.r_[0.0, np.cumsum(joined)]
        first = np.cumsum(sizes + 2) - sizes - 1  # place of the first word of each text
        best = self._logistic(word[first + sizes] - word[first], pair[first + sizes] - pair[first - 1], count[first + sizes] - count[first] + sizes + 1)
        best[sizes == 0] = 0.0
        step = WINDOW // 2
        n_windows = np.where(sizes > LONG_SENTENCE, -((step - sizes) // step), 0)
        of = np.repeat(np.arange(len(texts)), n_windows)
        begin = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * step
        end = np.minimum(begin + WINDOW, first[of] + sizes[of])
        with np.errstate(over="ignore"):
            edges = self.weights[_pair(np.uint64(self.hashes[0]), hashes[begin]).astype(np.int64)] + self.weights[_pair(hashes[end - 1], np.uint64(self.hashes[1])).astype(np.int64)]
        inner = self._logistic(word[end] - word[begin], pair[end - 1] - pair[begin] + edges, count[end] - count[begin] + end - begin + 1)
        np.maximum.at(best, of, inner)
        return best

    def _logistic(self, words: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + (words + pairs) / np.sqrt(n), -30, 30)))

    def score(self, sentence: str) -> float:
        return float(self.scores([_words(sentence)])[0])

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts: of each the highest of its sentences; a sentence that comes again is scored once."""
        known: dict[str, int] = {}
        rows, cols = [], []
        for i, text in enumerate(texts):
            if text and text.strip():
                for s in sentences(text):
                    rows.append(i)
                    cols.append(known.setdefault(s, len(known)))
        out = np.zeros(len(texts))
        if rows:
            np.maximum.at(out, rows, self.scores([_words(s) for s in known])[cols])
        return out

    def document(self, text: str | None) -> float:
        return float(self.documents([text])[0])


def _filled(template: str, rng: np.random.Generator) -> str:
    """The template with all slots filled but that of the group."""

    def pick(values: list[str]) -> str:
        return values[int(rng.integers(len(values)))]

    def slot(m: re.Match) -> str:
        return {"w": lambda: pick(seed.INSULTS), "a": lambda: pick(seed.ADJECTIVES), "n": lambda: pick(seed.NAMES).lower(), "o": lambda: pick(seed.THINGS),
                "p": lambda: pick(seed.PLACES), "t": lambda: pick(seed.OCCASIONS), "g": lambda: m[0]}[m[1]]()

    return re.sub(r"\{(\w)\}", slot, template)


def labelled_sentences(copies: int = 6, rng_seed: int = 5) -> tuple[list[tuple[str, int]], list[tuple[str, str]]]:
    """Labelled sentences, and pairs that differ in the group they name only."""
    rng, groups = np.random.default_rng(rng_seed), np.random.default_rng([rng_seed, 1])
    rows: list[tuple[str, int]] = []
    pairs: list[tuple[str, str]] = []
    for label, block in ((1, seed.ABUSIVE), (0, seed.HARMLESS)):
        for template in filter(None, block.split("\n")):
            for _ in range(copies if "{" in template else 2):
                text = _filled(template, rng)
                if "{g}" in text:
                    first, *others = (text.replace("{g}", seed.IDENTITY_TERMS[i]) for i in groups.choice(len(seed.IDENTITY_TERMS), 1 + COUNTERFACTUALS, replace=False))
                    pairs.extend((first, other) for other in others)
                    text = first
                rows.append((text, label))
    return rows, pairs


def _matrix(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    feats = [features(t) for t in texts]  # lists of words
    lengths = np.array([len(f) for f in feats])
    rows = np.repeat(np.arange(len(texts)), lengths)
    cols = np.array([c for f in feats for c in f], dtype=np.int64)
    return rows, cols, 1 / np.sqrt(np.maximum(lengths, 1))


def train(rows: list[tuple[list[str], int]], pairs: list[tuple[list[str], list[str]]], epochs: int = 80, ridge: float = 2e-5) -> Model:
    """Logistic regression with the counterfactual penalty on paired scores (full-batch AdaGrad)."""
    r, c, norm = _matrix([t for t, _ in rows])
    y = np.array([label for _, label in rows], float)
    w = np.ones(len(rows))
    for label in (0.0, 1.0):
        w[y == label] *= len(rows) / 2 / max(w[y == label].sum(), 1e-9)
    ra, ca, na = _matrix([a for a, _ in pairs])
    rb, cb, nb = _matrix([b for _, b in pairs])
    theta, bias = np.zeros(DIMENSIONS), BIAS
    square = np.full(DIMENSIONS, 1e-8)

    def z(rr: np.ndarray, cc: np.ndarray, nn: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rr, theta[cc], n) * nn + bias

    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(z(r, c, norm, len(rows)), -30, 30)))
        error = w * (p - y) / len(rows)
        grad = np.bincount(c, (error * norm)[r], DIMENSIONS) + ridge * theta
        if pairs:
            gap = COUNTERFACTUAL_WEIGHT * (z(ra, ca, na, len(pairs)) - z(rb, cb, nb, len(pairs))) / len(pairs)
            grad += np.bincount(ca, (gap * na)[ra], DIMENSIONS) - np.bincount(cb, (gap * nb)[rb], DIMENSIONS)
        square += grad**2
        theta -= 0.5 * grad / np.sqrt(square)
    return Model(theta, bias)


def reviewed_sample(documents: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, verdict) of at most LABELLED_DOCUMENTS documents on which the reviewers agree."""
    agreed = (
        labels.where("is_abusive in (0, 1)").groupBy("doc_id")
        .agg(F.min("is_abusive").alias("low"), F.max("is_abusive").alias("high"))
        .where("low = high").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_DOCUMENTS)
    )
    rows = documents.join(F.broadcast(agreed), "doc_id").where("text is not null").select("doc_id", "text", "high").orderBy("doc_id")
    return [(r["text"], r["high"]) for r in rows.toLocalIterator()]


def pair_odds(pairs: list[list[int]], of: np.ndarray, verdicts: np.ndarray) -> np.ndarray:
    """Mean log odds of the word pairs of each sentence between documents judged abusive and cleared ones."""
    sizes = np.fromiter(map(len, pairs), np.int64, len(pairs))
    row = np.repeat(np.arange(len(pairs)), sizes)
    place = np.fromiter((p for ps in pairs for p in ps), np.int64, int(sizes.sum()))
    once = np.unique(of[row] * DIMENSIONS + place)  # a pair counts once for a document
    judged, at = verdicts[once // DIMENSIONS], once % DIMENSIONS
    bad, good = (np.bincount(at[judged == v], minlength=DIMENSIONS) for v in (1, 0))
    odds = np.log((bad + 0.5) / ((verdicts == 1).sum() + 1)) - np.log((good + 0.5) / ((verdicts == 0).sum() + 1))
    odds[bad + good < 2] = 0.0
    return np.bincount(row, odds[place], len(pairs)) / np.maximum(sizes, 1)


def fitted(reviewed: list[tuple[str, int]], rounds: int = 2) -> Model:
    """The model of the general sentences, taught by the reviewers' verdicts on whole documents.

    Verdicts do not name the sentence and are noisy. In a document judged abusive the sentence with the
    most evidence is a positive if that is enough (``EVIDENCE``): the log odds of its word pairs between
    judged and cleared documents, and the score of the model so far. All sentences of cleared documents
    are negatives, but for those that the model (``SURE``) or the odds (``ODDS``) hold for abusive.
    """
    base, pairs = labelled_sentences()
    base = [(_words(t), label) for t, label in base]
    pairs = [(_words(a), _words(b)) for a, b in pairs]
    model = train(base, pairs)
    parts = [[list(w) for w in dict.fromkeys(map(tuple, map(_words, sentences(text)))) if w] for text, _ in reviewed]
    flat = [p for ps in parts for p in ps]
    if not flat:
        return model
    verdicts = np.array([v for _, v in reviewed])
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    odds = pair_odds([list(set(word_pairs(w))) for w in flat], of, verdicts)
    for _ in range(rounds):
        scored = model.scores(flat)
        evidence = odds + 2 * scored - 1
        worst = pd.Series(evidence).groupby(of).idxmax().to_numpy()
        abusive = worst[(verdicts[of[worst]] == 1) & (evidence[worst] > EVIDENCE)]
        harmless = np.flatnonzero((verdicts[of] == 0) & (scored < SURE) & (odds < ODDS))
        model = train([*base, *((flat[i], 0) for i in harmless), *((flat[i], 1) for i in abusive)], pairs)
    return model


def scored_documents(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, score) of every row."""
    held = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*held.value)
        for batch in batches:
            yield pd.Series(np.concatenate([m.documents(batch.iloc[i : i + 1000].tolist()) for i in range(0, len(batch), 1000)]) if len(batch) else np.zeros(0))

    return documents.select("doc_id", "source", score("text").alias("score"))


def source_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, abusive documents and their share per source."""
    return scored.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("score") >= threshold).alias("n_abusive"),
        F.round(F.avg((F.col("score") >= threshold).cast("double")), 6).alias("rate"),
    )
