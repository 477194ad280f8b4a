"""Toxicity by a weighted lexicon.

Words are folded (homoglyphs and digits that stand for letters become one letter; marks and invisible signs go), a lexicon of words and
word beginnings is learned with weights from labelled documents, and Aho-Corasick finds its entries. Entries that
are part of an exception phrase, a word or two words in a row that clean documents rather hold, don't count. The sum is normalised by length and
turned into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import kept, map_rows, remainder

# Characters that are read as a Latin letter, by that letter. l, 1 and i become one letter.
_READ_AS = {
    "a": "а α ɑ ᴀ ꭺ 4 @", "b": "в β ь ʙ ᏼ 8", "c": "с ϲ ᴄ ꮯ", "d": "ԁ ᴅ đ ꭰ", "e": "е ε ҽ ᴇ ꭼ 3", "f": "ꜰ ẝ", "g": "г ց ɡ ɢ ꮐ", "h": "һ հ н ʜ ꮋ ħ", "i": "і ι ı ɪ ӏ l ʟ ł ꮮ 1 ! |", "j": "ј ϳ ᴊ ꭻ",
    "k": "к κ ᴋ ꮶ", "m": "м ᴍ ꮇ", "n": "п η ո ɴ", "o": "о ο օ ᴏ ø σ 0", "p": "р ρ ᴘ ꮲ", "q": "ԛ գ", "r": "ʀ ꭱ", "s": "ѕ ꜱ ꮪ 5 $", "t": "т τ ᴛ ꭲ 7", "u": "υ ս ᴜ", "v": "ѵ ν ᴠ ꮩ", "w": "ԝ ω ᴡ ꮃ", "x": "х χ", "y": "у γ ү ʏ", "z": "ᴢ ꮓ",
}
ALIKE = str.maketrans({sign: letter for letter, signs in _READ_AS.items() for sign in signs.split()})
#: Combining marks and signs without width.
UNSEEN = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufe00-\ufe0f\ufeff]")
#: A word with signs that may stand for letters inside it; such signs at its ends are trimmed away.
WORD = re.compile(r"[^\W_](?:[\w@$!|'’]*[^\W_])?|[$@][^\W_]+")


def fold(text: str | None) -> list[str]:
    """Folded words of a text: NFKD without marks and unseen signs, lower case, look-alikes as one letter. Numbers stay as they are."""
    if not text:
        return []
    if not text.isascii():
        text = UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return [w if w.isdigit() else w.translate(ALIKE) for w in WORD.findall(text.lower())]


def entries_of(word: str, shortest: int = 3, longest: int = 8) -> list[str]:
    """The lexicon entries that a word could match: its beginnings, and itself (with a space at the end)."""
    return [" " + word[:k] for k in range(shortest, min(longest, len(word)) + 1)] + [f" {word} "]


def phrase_of(words: list[str]) -> str:
    """Words in a row, each with a space on both sides."""
    return " " + "  ".join(words) + " "


@dataclass
class Lexicon:
    """weights: entry to weight; exceptions: phrases (as phrase_of makes them) in which entries don't count; bias and slopes of the logistic. All of it is learned from a
    bounded sample, so its size is bounded."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    bias: float = -4.0
    slopes: tuple[float, float] = (1.0, 1.0)
    _automaton = None

    def automaton(self):
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for e, w in self.weights.items():
                made.add_word(e, (len(e), w))
            for e in self.exceptions:
                made.add_word(e, (len(e), None))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}

    def matched(self, words: list[str]) -> dict[int, float]:
        """Weights of the longest entries that words begin with, without words inside exceptions, by their places in phrase_of(words)."""
        if not words or not self.weights:
            return {}
        best: dict[int, tuple[int, float]] = {}
        free: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(phrase_of(words)):
            at = end - n + 1
            if w is None:
                free.append((at, end))
            elif at not in best or best[at][0] < n:
                best[at] = (n, w)
        for a, b in free:
            for at in [x for x in best if a <= x < b]:
                del best[at]
        return {at: w for at, (_, w) in best.items()}

    def contexts(self, words: list[str]) -> set[str]:
        """The phrases of one or two words in a row that hold a match."""
        places = self.matched(words)
        found, at = set(), 0
        for k, w in enumerate(words):
            if at in places:
                found |= {phrase_of(words[a:b]) for a, b in ((k, k + 1), (k - 1, k + 1), (k, k + 2)) if a >= 0 and b <= len(words)}
            at += len(w) + 2
        return found

    def features(self, text: str | None) -> tuple[float, float]:
        words = fold(text)
        total = sum(self.matched(words).values())
        return math.log1p(total), math.log1p(100 * total / (len(words) + 20))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.bias + self.slopes[0] * a + self.slopes[1] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, sample: int = 40_000) -> DataFrame:
    """Rows (text, toxic) of at most `sample` labelled documents outside the held-out remainder: those whose ids hash lowest. The bound is the
    classifier's documented sample; being bounded, the chosen labels may be broadcast. Of rows of one id the smallest text counts."""
    fit = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder("doc_id", modulus) != held_out))
    chosen = fit.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    met = slim.join(F.broadcast(kept(chosen, "labels")), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return met.select("text", (F.col("toxic") > 0).alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 40_000, min_support: float = 0.01, min_ratio: float = 6.0, min_gain: float = 0.08, min_clean: int = 3) -> Lexicon:
    """A lexicon from labelled documents. Without both kinds of labels it has no entries, and every score is the share of toxic labels (0 without labels).

    An entry is kept if toxic documents hold it often enough (min_support) and more often than others (min_ratio), and if it tells enough of them (min_gain: its
    likelihood ratio statistic for each toxic document; chosen on a part of the training labels under a lexicon from the rest). Around the matches of the entries in clean documents, words
    and phrases of two words that at least min_clean of those hold, at twice the rate of toxic ones or more, become exceptions; a phrase is left out if one of its
    words is an exception already. Labels of unknown documents, null labels and null ids are passed over; of several labels of one document the larger counts; null texts are empty.
    """
    seen = kept(labelled(docs, labels, sample=sample), "fit")
    counts = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(True, 0), counts.get(False, 0)
    if not n1 or not n0:
        return Lexicon({}, bias=30.0 if n1 else -30.0)

    def mentions(part, wanted=None):
        found: Counter = Counter()
        for text in part["text"]:
            every = {e for w in set(fold(text)) for e in entries_of(w)}
            found.update(every if wanted is None else every & wanted)
        yield {"entry": list(found), "n": list(found.values())}

    toxic, clean = seen.filter("toxic").select("text"), seen.filter("NOT toxic").select("text")
    support = max(2, math.ceil(min_support * n1))
    rows = map_rows(toxic, mentions, "entry string, n long", slices=10_000).groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= support)
    # A text holds few entries, and each one here is in at least min_support of the toxic texts: their number is bounded by the texts' length over min_support.
    in_toxic = {r.entry: r.n for r in rows.collect()}
    sent = seen.sparkSession.sparkContext.broadcast(frozenset(in_toxic))
    rows = map_rows(clean, lambda part: mentions(part, sent.value), "entry string, n long", slices=10_000)
    in_clean = {r.entry: r.n for r in rows.groupBy("entry").agg(F.sum("n").alias("n")).collect()}

    def ratio(e: str) -> float:
        return (in_toxic[e] + 0.1) / (n1 + 1) * (n0 + 1) / (in_clean.get(e, 0) + 0.5)

    def gain(e: str) -> float:
        a, b, n = in_toxic[e], in_clean.get(e, 0), n1 + n0
        cells = ((a, a + b, n1), (b, a + b, n0), (n1 - a, n - a - b, n1), (n0 - b, n - a - b, n0))
        return 2 * sum(k * math.log(k * n / (row * column)) for k, row, column in cells if k > 0) / n1

    # A beginning gives way to a longer one that is in as many toxic documents.
    telling = {e for e in in_toxic if ratio(e) >= min_ratio and gain(e) >= min_gain}
    shadowed = {e[:k] for e in telling for k in range(2, len(e)) if e[:k] in telling and in_toxic[e[:k]] <= 1.05 * in_toxic[e] and not e.endswith(" ")}
    weights = {e: round(math.log(ratio(e)), 6) for e in sorted(telling - shadowed)}
    entries = Lexicon(weights)

    def around(part):
        found: Counter = Counter((t, p) for text, t in zip(part["text"], part["toxic"]) for p in entries.contexts(fold(text)))
        yield {"toxic": [t for t, _ in found], "phrase": [p for _, p in found], "n": list(found.values())}

    rows = map_rows(seen, around, "toxic boolean, phrase string, n long", slices=10_000)
    by_kind = [F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col("n"))), F.lit(0)) for t in (False, True)]
    rates = rows.groupBy("phrase").agg(by_kind[0].alias("clean"), by_kind[1].alias("toxic"))
    # Found in the bounded sample only: at most three phrases for each of its matches, and each in min_clean texts.
    fair = rates.filter((F.col("clean") >= min_clean) & ((F.col("clean") + 0.5) / (n0 + 1) >= 2 * (F.col("toxic") + 0.5) / (n1 + 1)))
    phrases = {r.phrase for r in fair.select("phrase").collect()}
    single = {p for p in phrases if len(p.split()) == 1}
    lexicon = Lexicon(weights, tuple(sorted(single | {p for p in phrases if single.isdisjoint(phrase_of([w]) for w in p.split())})))

    def features(part):
        pairs = Counter((t, *(round(x, 2) for x in lexicon.features(text))) for text, t in zip(part["text"], part["toxic"]))
        yield {"toxic": [p[0] for p in pairs], "a": [p[1] for p in pairs], "b": [p[2] for p in pairs], "n": list(pairs.values())}

    # Rounded features: at most as many rows as the sample has, in practice a few thousand.
    table = map_rows(seen, features, "toxic boolean, a double, b double, n long").groupBy("toxic", "a", "b").agg(F.sum("n").alias("n")).collect()
    lexicon.bias, lexicon.slopes = _logistic(np.array([(r.a, r.b) for r in table]), np.array([r.toxic for r in table], dtype=float), np.array([r.n for r in table], dtype=float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.5) -> tuple[float, tuple[float, float]]:
    """Bias and slopes of a logistic regression by Newton's steps; slopes are kept from going below 0."""
    m, use = np.column_stack([np.ones(len(x)), x]), [0, 1, 2]
    while True:
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
            g = (m.T @ (n * (y - p)) - ridge * np.array([0, 1, 1]) * w)[use]
            h = ((m * (n * p * (1 - p))[:, None]).T @ m + ridge * np.diag([1e-6, 1, 1]))[np.ix_(use, use)]
            step = np.linalg.solve(h, g)
            w[use] += step
            if np.abs(step).max() < 1e-9:
                break
        if (w[1:] >= 0).all():
            return float(w[0]), (float(w[1]), float(w[2]))
        use = [k for k in use if k == 0 or w[k] >= 0]


def score_texts(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row, repeated rows included; null is scored as empty, a null id isn't held out; an empty table gives no rows."""

    def rows(part):
        scores = [lexicon.score(t) for t in part["text"]]
        yield {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return map_rows(slim, rows, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay. Null and empty texts are scored as texts without matches; null ids and repeated rows are
    rows like any other; an empty table stays empty."""

    def rows(part):
        stay = [i for i, t in enumerate(part["text"]) if lexicon.score(t) < threshold]
        yield {c: [x[i] for i in stay] for c, x in part.items()}

    return map_rows(docs, rows, docs.schema)
