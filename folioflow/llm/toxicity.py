"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text.

Folding lower-cases, maps homoglyphs of other scripts and accented letters to
Latin letters, digits and signs inside words to the letters they stand for,
and drops what is left between words. The lexicon is learned: folded words and
stems (word beginnings) more frequent in toxic labelled rows get the logarithm
of how much more frequent they are as weight. Words also seen in clean rows get
exception phrases, word pairs that hold them and occur in clean rows only. A
text's matched weight, exceptions taken away, is normalised by its length and
turned into a probability by a logistic curve.

Learning uses at most ``fit_rows`` labelled rows, those with the smallest
hashes of doc_id (two labels of one doc_id are two rows); exact repeats of a
text with one label count once.

Scale: the sample's ids (at most fit_rows) are broadcast to one scan that
counts words next to the data; the lexicon has at most LEXICON entries.
Applying is one map over the documents, without a shuffle.

Defined results: a null or empty text has no match and gets the curve's lowest
score; if nothing could be learned every score is 0. Repeated rows get equal
scores. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, staged

#: Labelled rows to learn from; most words in the lexicon and phrases beside it.
FIT_ROWS, LEXICON, PHRASES = 20_000, 2000, 500
#: A lexicon term needs so many toxic rows, such a share of them, and such log odds; letters of stems.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS, STEM = 5, 0.01, 1.5, (5, 9)

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʀ": "r", "ѡ": "w", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}

_WORD = re.compile(r"[^\s]+")
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_INNER = re.compile(r"[^a-z]+")


def _letters() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1 and k.upper() not in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if plain.isascii() and plain.isalpha():
            table.setdefault(code, plain)
    table |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    table |= {code: None for code in [0xAD, *range(0x300, 0x370), *range(0x200B, 0x2010), 0x2060, 0xFEFF]}
    return table


_LETTERS = _letters()
_SUBSTITUTES = str.maketrans(SUBSTITUTES)


def fold_word(word: str) -> str:
    """A folded word of a to z; substitutes count only beside letters."""
    word = _EDGE.sub("", word)
    if not word.isalpha():
        if any(c.isalpha() for c in word):
            word = word.translate(_SUBSTITUTES)
        word = _INNER.sub("", word)
    return word


def fold_text(text: str | None) -> str:
    """Folded words, each between two blanks' edges: `` one two ``."""
    text = (text or "").translate(_LETTERS).lower() if not (text or "").isascii() else (text or "").lower()
    words = [w if w.isalpha() else fold_word(w) for w in text.split()]
    return f" {' '.join(w for w in words if w)} "


def terms_of(word: str) -> list[str]:
    """A word as a lexicon entry, and its stems, which end in a star."""
    return [word, *(word[:k] + "*" for k in range(STEM[0], min(len(word), STEM[1] + 1)))]


class Lexicon:
    """Weights of words and stems, exception phrases and the logistic curve."""

    def __init__(self, words: dict[str, float], phrases: dict[str, float], curve: tuple[float, ...] = ()):
        self.words, self.phrases, self.curve = words, phrases, curve
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def _built(self):  # noqa: ANN202
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k, v in self.words.items():
                text = f" {k[:-1]}" if k.endswith("*") else f" {k} "
                self.automaton.add_word(text, (len(text), v))
            for k, v in self.phrases.items():
                self.automaton.add_word(f" {k} ", (len(k) + 2, -v))
            self.automaton.make_automaton()
        return self.automaton

    def features(self, text: str | None) -> tuple[float, ...]:
        """Matched weight less exceptions, the same by length in two ways, and the length's logarithm.

        Of all entries that match at a word the longest one counts.
        """
        folded = fold_text(text)
        n = max(1, folded.count(" ") - 1)
        best: dict[int, tuple[int, float]] = {}
        less = 0.0
        for end, (size, weight) in self._built().iter(folded) if self.words else ():
            if weight < 0:
                less += weight
            elif size > best.get(end - size, (0, 0.0))[0]:
                best[end - size] = (size, weight)
        total = max(0.0, sum(w for _, w in best.values()) + less)
        return total / 10, total / math.sqrt(n), 10 * total / (n + 20), math.log1p(n) / 5

    def score(self, text: str | None) -> float:
        if not self.words or not self.curve:
            return 0.0
        at = self.curve[-1] + sum(c * x for c, x in zip(self.curve, self.features(text), strict=False))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, at))))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, ...]:
    """Coefficients, and the offset last, of a slightly shrunk logistic regression, by Newton steps."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(w)) * 1e-2
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def count_terms(texts: list[str | None], among: set[str] | None = None) -> tuple[dict[str, list[int]], int]:
    """Texts and places that hold each term, and the number of words; only terms of ``among`` if given."""
    out: dict[str, list[int]] = {}
    total = 0
    for text in texts:
        seen: set[str] = set()
        words = fold_text(text).split()
        total += len(words)
        for w in words:
            for t in terms_of(w):
                if among is None or t in among:
                    own = out.setdefault(t, [0, 0])
                    own[1] += 1
                    if t not in seen:
                        seen.add(t)
                        own[0] += 1
    return out, total


def _counted(texts: DataFrame, among: set[str] | None = None) -> DataFrame:
    """term, texts, places over all rows of ``texts``; the empty term counts texts and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = count_terms(batch.column(0).to_pylist(), among)
            found[""] = [batch.num_rows, words]
            cols = [pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["term", "texts", "places"])

    got = texts.select("text").mapInArrow(run, "term string, texts long, places long")
    return got.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("places").alias("places"))


def weights(bad: dict[str, tuple[int, int]], good: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log rates of terms in toxic against clean texts, for terms with enough of both support and odds."""
    n, words = bad[""]
    m, others = good[""]
    found = {}
    for t, (texts, places) in bad.items():
        if t and texts >= LEAST_ROWS and texts >= LEAST_SHARE * n:
            c_texts, c_places = good.get(t, (0, 0))
            odds = math.log((texts + 0.5) / (n - texts + 0.5)) - math.log((c_texts + 0.5) / (m - c_texts + 0.5))
            rate = math.log((places + 0.5) / (words + 1)) - math.log((c_places + 0.5) / (others + 1))
            if odds >= LEAST_ODDS and rate > 0:
                found[t] = rate
    return dict(sorted(found.items(), key=lambda kv: (-kv[1], kv[0]))[:LEXICON])


def _pairs(sample: DataFrame, words: set[str]) -> DataFrame:
    """Word pairs that hold a word of ``words``, with their toxic and clean rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = fold_text(text).split()
                for pair in {f"{a} {b}" for a, b in zip(own, own[1:], strict=False) if a in words or b in words}:
                    rows.setdefault(pair, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*rows], pa.string()), pa.array([r[1] for r in rows.values()], pa.int64()), pa.array([r[0] for r in rows.values()], pa.int64())], ["term", "toxic", "clean"])

    got = sample.mapInArrow(run, "term string, toxic long, clean long")
    return got.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, held_out_of: int = 5, held_out: int = 0) -> Lexicon:
    """Learn from at most ``fit_rows`` labelled rows outside the held-out fold."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), held_out_of) != held_out))
    chosen = chosen.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)  # at most fit_rows narrow rows: safe to broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text").distinct()
    sample = staged(sample)
    rows = lambda frame: {r["term"]: (r["texts"], r["places"]) for r in frame.collect()}
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    # Terms of a LEAST_SHARE of the texts: at most 1 / LEAST_SHARE times as many as a text has on average.
    n = toxic.count()
    likely = _counted(toxic).where((F.col("term") == "") | (F.col("texts") >= max(LEAST_ROWS, LEAST_SHARE * n)))
    bad = rows(likely) if n >= LEAST_ROWS else {}
    good = rows(_counted(clean, {*bad})) if bad else {}
    if not bad.get("", (0, 0))[0] or not good.get("", (0, 0))[0]:
        return Lexicon({}, {})
    words = weights(bad, good)
    phrases: dict[str, float] = {}
    if mixed := {t for t in words if not t.endswith("*") and t in good}:
        held = _pairs(sample, mixed).where((F.col("toxic") == 0) & (F.col("clean") >= 5)).orderBy(F.desc("clean"), "term").limit(PHRASES).collect()
        phrases = {r["term"]: max(words.get(w, 0.0) for w in r["term"].split()) for r in held}
    lexicon = Lexicon(words, phrases)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [f"x{k}" for k in range(len(lexicon.features("")))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shared.value.features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), *(pa.array([v[k] for v in x], pa.float64()) for k in range(len(names)))], ["y", *names])

    points = sample.mapInArrow(run, "y double, " + ", ".join(f"{c} double" for c in names))
    # Ids that several documents share could give more rows than labels; then those with the smallest hashes stay.
    points = points.orderBy(F.xxhash64("y", *names), "y", *names).limit(fit_rows).toPandas().sort_values(["y", *names])
    lexicon.curve = logistic(points[names].to_numpy(), points["y"].to_numpy())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of every row."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double")
