"""Language identification by rank-order profiles.

A language's profile lists its most frequent character n-grams (one to three
letters, with word edges) in order of frequency. A document's own most
frequent n-grams are ranked alike; the out-of-place distance to a language is
the sum of rank differences, with a fixed penalty for n-grams that the profile
lacks. The nearest language wins.

Profiles are learned from at most ``fit_rows`` documents per language, those
with the smallest hashes of doc_id; counts of all their n-grams are summed.

Scale: the sample's ids (languages x fit_rows) are counted and, if few,
broadcast to one scan that reads their texts; profiles are languages x PROFILE entries. Applying
is one map over the documents, without a shuffle; memory follows one text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing could be learned. Ties between n-grams are broken
by code points, ties between languages by name. Repeated rows get equal
results. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, small_side, staged

UNDETERMINED = "und"
#: Ranks kept of a language and of a document; documents per language to learn from.
PROFILE, TOP, FIT_ROWS = 1000, 400, 1000
_OTHER = re.compile(r"[\W\d_]+")
#: Number signs that the pattern lets through (fractions, raised and circled digits, numerals), and whether a code point is one.
_SIGNS = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_OTHER_OR_SIGN, _IS_SIGN = re.compile(rf"[\W\d_{_SIGNS}]+"), np.zeros(0x110000, bool)
_IS_SIGN[[ord(c) for c in _SIGNS]] = True
_BITS = np.uint64(21)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (21 bits a letter, a blank marks a word's edge) and how often each occurs."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), "<u4")
    if not words.isascii() and _IS_SIGN[c].any():
        words = _OTHER_OR_SIGN.sub(" ", words).strip()
        if not words:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        c = np.frombuffer(f" {words} ".encode("utf-32-le"), "<u4")
    c = c.astype(np.uint64)
    letter = c != 32
    two = c[:-1] << _BITS | c[1:]
    three = two[:-1] << _BITS | c[2:]
    # A blank may start or end an n-gram but not stand inside one, and not alone.
    keys = np.concatenate((c[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]))
    return np.unique(keys, return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent keys, in order."""
    if len(keys) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        held = counts >= least
        keys, counts = keys[held], counts[held]
    return keys[np.lexsort((keys, -counts))][:top]


class Profiles:
    """Ranks of all profiles' n-grams, one row per n-gram and one column per language."""

    def __init__(self, by_language: dict[str, np.ndarray]):
        self.languages = sorted(by_language)
        self.keys = np.unique(np.concatenate([np.empty(0, np.uint64), *by_language.values()]))
        self.penalty = PROFILE
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int32)
        for k, name in enumerate(self.languages):
            self.ranks[np.searchsorted(self.keys, by_language[name]), k] = np.arange(len(by_language[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and a score: how much nearer it is than the others, as odds."""
        own = ranked(*ngram_counts(text), TOP)
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.keys, own)
        at[at < len(self.keys)] = np.where(self.keys[at[at < len(self.keys)]] == own[at < len(self.keys)], at[at < len(self.keys)], len(self.keys))
        ranks = self.ranks[at]
        off = np.where(ranks < 0, self.penalty, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.penalty)).sum(axis=0)
        far = off / (len(own) * self.penalty)
        best = int(far.argmin())
        weight = np.exp(-20.0 * (far - far[best]))
        return self.languages[best], float(1.0 / weight.sum())


def training_rows(docs: DataFrame, held_out_of: int = 5, held_out: int = 0) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), held_out_of) != held_out))


def fit(train: DataFrame, fit_rows: int = FIT_ROWS) -> Profiles:
    """Learn profiles from rows of (doc_id, text, lang), at most ``fit_rows`` of each language."""
    first = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = train.select("lang", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("_h"))
    # Of a frequent language only about 3 * fit_rows rows, by another hash, come to the window.
    counts = small_side(staged(train.groupBy("lang").agg(F.count("*").alias("_c"))))
    share = F.pmod(F.xxhash64("_h"), F.lit(1 << 20)) * F.col("_c") < F.lit(3 * fit_rows * (1 << 20))
    ids = ids.join(counts, "lang").where(share)
    ids = ids.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= fit_rows).select("lang", "doc_id").distinct()
    sample = train.select("lang", "doc_id", "text").join(small_side(staged(ids)), ["lang", "doc_id"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, {})
                for k, n in zip(*(x.tolist() for x in ngram_counts(text)), strict=True):
                    own[k] = own.get(k, 0) + n
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.uint64()).cast(pa.int64(), safe=False), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])

    grams = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = grams.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= PROFILE).orderBy("lang", "_r").toPandas()
    return Profiles({lang: g["gram"].to_numpy().astype(np.int64).view(np.uint64) for lang, g in rows.groupby("lang")})


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, lang_pred string, score double")
