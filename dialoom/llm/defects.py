"""Defective answers: empty, truncated, refusal, copy of the question, other language.

Row by row, prompt and answer are tokenised and aligned. A refusal is an answer that, outside quoted
speech, aligns with a refusal template (longest common subsequence within a short window). A copy is
an answer most of whose shingles and of whose tokens, in order, are found in the question. The
language of a text is that of its function words and script.

Whether a sentence breaks off is learnt from the whole corpus: every answer is reduced to a skeleton
(function words and frequent words stay, others become W, names N, numbers #), and for each context of 3 to 9 skeleton
tokens it is counted how often an answer ends there and how often it goes on. An answer without a
final mark is truncated if the longest context that is known well enough goes on, or if its last
word is only known as the beginning of other words. Answers of two or three tokens have contexts
only where they end in a function word: a bare name or noun is an answer ('At Stone Road'). Counts are aggregated per partition and then by
key; only the bounded list of frequent words (at most mean length / share) reaches the driver.

Defined cases: null, blank, sign and placeholder answers are 'empty'; JSON text counts as what it
encodes; a null question has no copies and no language; one defect a row, in the order empty,
refusal, copy, language, truncated; repeated rows are judged each.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.session import checkpoint

FREQUENT_SHARE = 0.03
LONGEST, SHORTEST, SUPPORT, END_SHARE = 9, 3, 5, 0.15
START, FACTOR = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: Letters by which the beginnings of words are joined; longer ones are compared in full.
KEYED = 40

#: Answers that stand for no answer (fixed values).
PLACEHOLDERS = {"n a", "na", "none", "null", "nil", "nan", "empty", "no answer", "tbd", "todo", "to do", "to be determined", "not available",
                "no response", "undefined", "missing", "blank", "not applicable", "no answer given"}

#: Ways to decline, contractions written out (fixed values).
REFUSALS = [
    "i am not able to answer", "i am not able to", "i am unable to", "i cannot help", "i cannot assist", "i cannot provide", "i cannot discuss",
    "i cannot answer", "i cannot comment", "i cannot respond", "i cannot share", "i cannot reply", "i cannot say anything", "i will not answer", "i will not be answering",
    "i will not respond", "i would prefer not to", "i prefer not to", "i would rather not", "i have to refuse", "i must decline", "i must refuse", "i have to decline",
    "i refuse", "i decline", "i will leave this unanswered", "answering would go against", "my guidelines do not let", "my guidelines do not allow",
    "guidelines do not let me", "i do not have permission", "i am not allowed to", "i am not permitted to", "request cannot be completed", "request declined",
    "request denied", "not something i can comment on", "not something i can", "inappropriate for me to", "no comment", "off limits for me", "withheld by policy",
    "assistant declined to", "assistant refused to", "not going to answer that", "let us talk about something else", "as an automated assistant i",
    "as a language model i", "as an ai i", "against my policy", "cannot comply with", "unable to comply with", "content removed by policy",
    "je ne peux pas répondre", "je ne peux pas vous aider", "je ne peux pas aider", "je ne suis pas en mesure", "je refuse de répondre", "je préfère ne pas répondre",
    "je ne souhaite pas répondre", "je ne répondrai pas", "impossible pour moi de répondre",
    "dabei kann ich nicht helfen", "kann ich nicht beantworten", "kann ich nicht helfen", "kann ich leider nicht", "ich kann das nicht beantworten", "ich kann nicht antworten",
    "ich kann diese frage nicht", "ich kann dazu nichts sagen", "dazu kann ich nichts sagen", "ich möchte nicht antworten", "darauf möchte ich nicht", "ich darf nicht",
    "ich kann ihnen nicht helfen", "ich kann dir nicht helfen", "ich muss ablehnen", "ich werde nicht antworten",
    "no puedo responder", "no puedo ayudar", "no puedo contestar", "no puedo ayudarte con", "no puedo ayudarle con", "prefiero no responder", "prefiero no contestar", "no voy a responder",
    "me niego a responder", "no me es posible responder", "no estoy autorizado",
    "non posso rispondere", "non posso aiutarti", "non posso aiutare", "preferisco non rispondere", "mi rifiuto di rispondere",
    "não posso responder", "não posso ajudar", "prefiro não responder", "recuso me a responder",
    "ik kan niet antwoorden", "ik kan hier niet mee helpen", "не могу ответить", "не могу помочь", "я отказываюсь",
]
UNSPACED_REFUSALS = re.compile("无法回答|不能回答|无法提供|无法协助|不便回答|拒绝回答|お答えできません|回答できません|答えられません|お手伝いできません|답변할 수 없|도와드릴 수 없")

CONTRACTIONS = {"can't": "cannot", "won't": "will not", "i'm": "i am", "i'd": "i would", "i'll": "i will", "don't": "do not",
                "let's": "let us", "isn't": "is not", "couldn't": "could not", "wouldn't": "would not", "doesn't": "does not",
                "cant": "cannot", "wont": "will not", "dont": "do not", "im": "i am", "isnt": "is not", "couldnt": "could not", "wouldnt": "would not", "doesnt": "does not"}

#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the and of is was that by for in to with not they it he she his her their them this these never more than before after when which who why what how had has have did does been being from but or so yet only at on as because rather while both by then an a",
    "fr": "le la les un une des du de et est était que qui ne pas plus pour dans sur avec sans car mais ou où plutôt bien avant reste malgré avait au aux ce cette ces il elle ils elles se sent depuis rien a tout changé pourquoi quelle quel leur son sa ses jours",
    "de": "der die das den dem des ein eine einen einem einer und ist war nicht dass weil aber oder auch als mehr eher aus vor von mit für auf bei hatte hat sie er es ihr wurde wird seit bleibt trotz lange vorher wenn nach warum welche was sich im zum zur nichts",
    "es": "el los las un una unos y es era que no más para en con sin por pero o muy fue había porque desde hace se lo sus su al del sigue pesar mucho antes cuando qué quién cómo nada de la todo siente ha días",
    "it": "il lo gli un uno una e è era che non più per nel nella con senza ma anche perché aveva dopo prima quando quindi di della del dei delle si sente molto nulla sarebbe alla fine nessuno dei due poi da questo questa cosa ha",
    "pt": "o os as um uma e é era que não mais para em com sem por mas muito foi porque desde quem quando então aquilo isso disso ao à no na do da dos das ninguém diz depois fica ficou nada ele ela seu sua tinha podia",
    "nl": "de het een en is was dat niet meer voor in met zonder maar ook als omdat had na voordat toen van op bij zijn haar hij zij ze er nog heeft werd dan waarom wat wie aan door te om",
    "pl": "i w na nie się że jest był była to z do o jak ale po przez dla od za tak czy który która jego jej już tylko ponieważ",
    "sv": "och att det är som en ett på för med inte av den till var han hon men från hade om eftersom när sig efter",
    "tr": "ve bir bu için ile çok değil ama daha gibi kadar sonra önce çünkü olan olarak hiç ne o da de mi",
}
_KNOWN = {lang: frozenset(ws.split()) for lang, ws in FUNCTION_WORDS.items()}
_LANGUAGES_OF: dict[str, list[str]] = {}
for _lang, _words in _KNOWN.items():
    for _w in _words:
        _LANGUAGES_OF.setdefault(_w, []).append(_lang)
_SCRIPTS = [("ja", "぀-ヿ"), ("zh", "㐀-鿿"), ("ko", "가-힯"), ("ru", "Ѐ-ӿ"), ("ar", "؀-ۿ"),
            ("el", "Ͱ-Ͽ"), ("he", "֐-׿"), ("hi", "ऀ-ॿ"), ("th", "฀-๿")]
_SCRIPT_RX = [(lang, re.compile(f"[{chars}]")) for lang, chars in _SCRIPTS]

_BEYOND_LATIN = re.compile("[Ͱ-\uffff]")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[^\w\s]")
_QUOTED = re.compile(r"\"[^\"]*(?:\"|$)|“[^”]*(?:”|$)|«[^»]*(?:»|$)|„[^“”]*(?:[“”]|$)|「[^」]*(?:」|$)")
_MAYBE_QUOTED = re.compile("[\"“«„「]")
_CLOSED = re.compile(r"[.!?。！？؟।]+[\"'”’»)\]}\s​﻿]*$")
_ELLIPSIS = re.compile(r"(\.\.\.+|…)[\"'”’»)\]\s]*$")
_HANGING = re.compile(r"[,;:(\[{\-–—„“«&/]\s*$|[(\[“«„][^)\]”»]{0,12}$|\s[\"'(][^\s\"')]{0,12}$")


def unwrapped(text: str | None) -> str:
    """The answer that a text holds: JSON text counts as what it encodes, full quotes are taken off."""
    text = (text or "").strip()
    while text[:1] in ('"', "{", "["):  # every layer taken off makes the text shorter
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            break
        if isinstance(value, dict):
            value = value.get("answer", next((v for v in value.values() if isinstance(v, str)), ""))
        if isinstance(value, list):
            value = " ".join(str(v) for v in value if v is not None)
        inner = "" if value is None else str(value).strip()
        if len(inner) >= len(text):
            break
        text = inner
    return text


def is_empty(text: str) -> bool:
    inner = " ".join(w.lower() for w in re.findall(r"[^\W_]+", text))
    return not inner or inner in PLACEHOLDERS


def plain_tokens(text: str) -> list[str]:
    """Lower-case words with contractions written out."""
    words = _WORD.findall(text.lower().replace("’", "'"))
    if CONTRACTIONS.keys().isdisjoint(words):
        return words
    out: list[str] = []
    for w in words:
        written = CONTRACTIONS.get(w)
        out.extend(written.split()) if written else out.append(w)
    return out


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table at once as the bits of a number."""
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full  # a zero bit is a step of the row
    for x in a:
        step = row & at.get(x, 0)
        row = ((row + step) | (row - step)) & full
    return len(b) - row.bit_count()


_TEMPLATES = [t.split() for t in REFUSALS]
_TEMPLATE_AT = {id(t): t for t in _TEMPLATES}
_TEMPLATE_SET = {id(t): frozenset(t) for t in _TEMPLATES}
_BY_TOKEN: dict[str, list[list[str]]] = {}
for _t in _TEMPLATES:
    for _w in sorted(set(_t)):
        _BY_TOKEN.setdefault(_w, []).append(_t)


def is_refusal(text: str) -> bool:
    """Aligned with a template outside quotes: all tokens of a short one, all but one of a longer one."""
    if UNSPACED_REFUSALS.search(text):
        return True
    bare = _QUOTED.sub(" , ", text) if _MAYBE_QUOTED.search(text) else text
    tokens = plain_tokens(bare)
    if not tokens:
        return False
    places: dict[str, list[int]] = {}
    for i, w in enumerate(tokens):
        places.setdefault(w, []).append(i)
    have: dict[int, int] = {}
    for w in places:
        for t in _BY_TOKEN.get(w, ()):
            have[id(t)] = have.get(id(t), 0) + 1
    for at, n in have.items():
        t = _TEMPLATE_AT[at]
        need = len(t) - (len(t) >= 5)
        distinct = need - (len(set(t)) < len(t))
        if n < distinct:
            continue
        for w in set(t[:2]):
            for i in places.get(w, ()):
                window = tokens[i : i + len(t) + 2]
                if len(_TEMPLATE_SET[at].intersection(window)) >= distinct and lcs(t, window) >= need:
                    return True
    return False


def is_copy(question: list[str], answer: list[str]) -> bool:
    """Only repeats the question: the same words, else shingle containment, then the order of the tokens."""
    if answer and answer == question:
        return True
    if len(answer) < 5 or not question:
        return False
    q3 = set(zip(question, question[1:], question[2:]))
    a3 = list(zip(answer, answer[1:], answer[2:]))
    inside = sum(s in q3 for s in a3) / max(1, len(a3))
    if inside < 0.4:
        return False
    if len(answer) < 0.35 * len(question) and len(answer) < 9:
        return False
    if inside >= 0.8:
        return True
    return lcs(answer, question) >= 0.75 * len(answer)


def language(text: str) -> tuple[str | None, float]:
    """Language and how far it leads (0 to 1), from script and function words; None if nothing tells."""
    if _BEYOND_LATIN.search(text):
        letters = sum(ch.isalpha() for ch in text)
        for lang, rx in _SCRIPT_RX:
            if len(rx.findall(text)) > 0.3 * max(letters, 1):
                return lang, 1.0
    tokens = _LETTERS.findall(text.lower())
    hits: dict[str, int] = {}
    for w in tokens:
        for lang in _LANGUAGES_OF.get(w, ()):
            hits[lang] = hits.get(lang, 0) + 1
    if not hits:
        return None, 0.0
    best = max(hits, key=hits.get)
    n = hits.pop(best)
    second = max(hits.values(), default=0)
    if n < 2 or n == second:
        return None, 0.0
    return best, (n - second) / max(4, len(tokens))


def other_language(question: str, answer: str) -> bool:
    """The answer is in another language than the question; quoted words do not count."""
    bare = re.sub(r"\([^)]*\)", " ", _QUOTED.sub(" ", answer))
    lang, lead = language(bare)
    if lang is None or lead < 0.08:
        return False
    asked, asked_lead = language(re.sub(r"\([^)]*\)", " ", _QUOTED.sub(" ", question)))
    return asked is not None and asked_lead > 0.02 and asked != lang


def stays_open(text: str) -> bool:
    """A quotation or bracket is opened and not closed."""
    return text.count('"') % 2 == 1 or any(text.count(a) > text.count(b) for a, b in ("()", "[]", "“”", "«»"))


def judged(question: str | None, answer: str | None) -> tuple[str | None, list[str] | None, bool]:
    """(defect, tokens, closed): the defect where the row itself tells, else its tokens for the corpus."""
    text = unwrapped(answer)
    if is_empty(text):
        return "empty", None, True
    if is_refusal(text):
        return "refusal", None, True
    if question:
        q, a = plain_tokens(question), plain_tokens(text)
        if is_copy(q, a):
            return "copy", None, True
        if other_language(question, text):
            return "language", None, True
    if _ELLIPSIS.search(text) or (not _CLOSED.search(text) and (_HANGING.search(text) or stays_open(text))):
        return "truncated", None, True
    return None, _TOKEN.findall(text), bool(_CLOSED.search(text))


JUDGED = "qa_key bigint, defect string, tokens array<string>, closed boolean"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k, *judged(q, a)) for k, q, a in batch.itertuples(index=False)]
        yield pd.DataFrame(rows, columns=["qa_key", "defect", "tokens", "closed"], dtype=object)


def skeleton(tokens: list[str], frequent: set[str]) -> list[str]:
    out = []
    for t in tokens:
        low = t.lower().replace("’", "'")
        if not t[0].isalnum() or low in frequent or low in _LANGUAGES_OF:
            out.append(low)
        elif t.isdigit():
            out.append("#")
        else:
            out.append("N" if t[0].isupper() else "W")
    return out


def context_hashes(bodies: list[list[int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, row, place, hash) of the contexts of each length that end at each token of each row.

    ``bodies`` are the codes of skeleton tokens; a mark of the start stands before each row and counts
    as a token. Places count from 1. All rows of a batch are hashed together, one length after the other.
    """
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    row = np.repeat(np.arange(len(bodies)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = np.full(len(row), START, np.uint64)
    code[place > 0] = np.fromiter(itertools.chain.from_iterable(bodies), np.uint64, len(row) - len(bodies))
    h = code.copy()
    with np.errstate(over="ignore"):
        for n in range(2, LONGEST + 1):
            # the context one longer takes in the token before it
            h[n - 1 :] = h[n - 1 :] * FACTOR + code[: len(code) - n + 1]
            if n >= SHORTEST:
                ok = place >= max(n - 1, 1)
                yield n, row[ok], place[ok], h[ok].view(np.int64)


def _body(tokens: list[str], closed: bool) -> list[str]:
    """Tokens without the marks that close the last sentence."""
    end = len(tokens)
    while closed and end and not tokens[end - 1][0].isalnum():
        end -= 1
    return tokens[:end]


def _coder(frequent: set[str]):
    """Codes of the skeleton tokens of a list of tokens; what a token becomes is kept by the worker."""
    known: dict[str, int] = {}

    def codes(tokens: list[str]) -> list[int]:
        out = []
        for t in tokens:
            c = known.get(t)
            if c is None:
                if len(known) > 200_000:
                    known.clear()
                c = known[t] = xxhash.xxh3_64_intdigest(skeleton([t], frequent)[0])
            out.append(c)
        return out

    return codes


def _count(frequent: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _coder(frequent)
        for batch in batches:
            closed = batch["closed"].to_numpy(bool)
            bodies = [codes(_body(t, c)) for t, c in zip(batch["tokens"].map(list), closed)]
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            for _, row, place, h in context_hashes(bodies):
                last = place == sizes[row]
                going, ends = ~last, last & closed[row]
                context, where = np.unique(h[going | ends], return_inverse=True)
                kinds = ends[going | ends]
                n_ends = np.bincount(where, kinds, len(context)).astype(np.int64)
                yield pd.DataFrame({"context": context, "n_going": np.bincount(where, minlength=len(context)) - n_ends, "n_ends": n_ends})

    return run


def _suspects(frequent: set[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _coder(frequent)
        for batch in batches:
            tokens = batch["tokens"].map(list).tolist()
            keys = batch["qa_key"].to_numpy()
            last = np.array([t[-1].lower() if t[-1].isalpha() else None for t in tokens], dtype=object)
            yield pd.DataFrame({"qa_key": keys, "n": 0, "context": pd.Series([None] * len(keys), dtype="Int64"), "last": last})
            asked = np.array([len(t) > 3 or skeleton(t[-1:], frequent)[0] in _LANGUAGES_OF for t in tokens], bool)
            bodies = [codes(t[-LONGEST:]) for t in tokens]
            whole = np.array([len(t) < LONGEST for t in tokens], bool)  # only these reach back to their start
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
            for n, row, place, h in context_hashes(bodies):
                ok = (place == sizes[row]) & asked[row] & (whole[row] | (n <= place))
                yield pd.DataFrame({"qa_key": keys[row[ok]], "n": n, "context": pd.Series(h[ok], dtype="Int64"), "last": last[row[ok]]})

    return run


def _breaking_off(judged_rows: DataFrame) -> DataFrame:
    """qa_key of the answers without a final mark whose end the corpus does not know as one."""
    left = judged_rows.where("defect is null and size(tokens) > 0").select("qa_key", "tokens", "closed")
    total = left.count()
    spoken = left.select(F.explode(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(1)))).alias("t"))
    used = spoken.where(F.col("t").rlike(r"^\p{L}")).groupBy(F.lower("t").alias("w")).agg(F.count("*").alias("n"))
    frequent = {r["w"] for r in used.where(F.col("n") >= FREQUENT_SHARE * total).select("w").toLocalIterator()}
    counts = (
        left.select("tokens", "closed")
        .mapInPandas(_count(frequent), "context bigint, n_going bigint, n_ends bigint")
        .groupBy("context").agg(F.sum("n_going").alias("n_going"), F.sum("n_ends").alias("n_ends"))
    )
    asked = checkpoint(left.where("not closed").select("qa_key", "tokens").mapInPandas(_suspects(frequent), "qa_key bigint, n int, context bigint, last string"))
    known = asked.where("n > 0").join(counts, "context").where(F.col("n_going") + F.col("n_ends") >= SUPPORT)
    going_on = (
        known.groupBy("qa_key")
        .agg(F.max_by("n_going", "n").alias("g"), F.max_by("n_ends", "n").alias("e"))
        .where(F.col("e") < END_SHARE * (F.col("g") + F.col("e")))
        .select("qa_key")
    )
    lasts = asked.where("n = 0 and last is not null").select("qa_key", "last")
    often = used.where("n >= 3 and length(w) >= 3")
    short = often.select(
        F.explode(F.transform(F.sequence(F.lit(2), F.least(F.length("w") - 1, F.lit(KEYED))), lambda i: F.substring("w", F.lit(1), i))).alias("last"), "n"
    )
    # a beginning longer than that meets the words that share its first KEYED letters
    key = lambda c: F.substring(c, 1, KEYED).alias("key")
    cut_long = lasts.where(F.length("last") > KEYED).select("last", key("last")).distinct()
    long = cut_long.join(often.where(F.length("w") > KEYED).select("w", "n", key("w")), "key").where(F.startswith("w", "last") & (F.col("w") != F.col("last"))).select("last", "n")
    beginnings = short.unionByName(long).groupBy("last").agg(F.max("n").alias("longer"))
    whole = used.select(F.col("w").alias("last"), F.col("n").alias("itself"))
    cut_words = (
        lasts.join(beginnings, "last").join(whole, "last", "left")
        .where(F.coalesce("itself", F.lit(0)) * 50 < F.col("longer")).select("qa_key")
    )
    return going_on.unionByName(cut_words).distinct()


def defective_answers(qa: DataFrame) -> DataFrame:
    """(qa_key, defect) of every defective row."""
    rows = checkpoint(qa.select("qa_key", "question_text", "gold_answer").mapInPandas(_judge, JUDGED))
    told = rows.where("defect is not null").select("qa_key", "defect")
    return told.unionByName(_breaking_off(rows).select("qa_key", F.lit("truncated").alias("defect")))
