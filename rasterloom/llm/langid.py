"""Language identification by rank-order profiles of letter n-grams.

A profile lists a language's most frequent n-grams of 1 to 3 letters (words padded on both sides) by
rank. A document's own list is compared to each profile: each of its n-grams is out of place by the
difference of ranks, or by the profile's length if the profile lacks it. The least sum wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import texts

#: N-grams of a profile.
PROFILE = 300
#: Labelled documents a language that the profiles are counted on, about; drawn by a hash of the id.
SAMPLE = 1500
#: Stands for a word's edge in codes of n-grams; no letter has this code point.
EDGE = 1
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter (Unicode category L)."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text's words, 21 bits a character: letters, and pairs and triples that may begin or end at a word's edge."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    own = letters()[points]
    keep = own.copy()
    keep[1:] |= own[:-1]
    edge = np.full(1, EDGE, np.uint64)
    x = np.concatenate([edge, np.where(own, points, EDGE)[keep].astype(np.uint64), edge])
    letter = x != EDGE
    two = x[:-1] << np.uint64(21) | x[1:]
    three = two[:-1] << np.uint64(21) | x[2:]
    return np.concatenate([x[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def ranked(text: str, most: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first, equal ones by code."""
    codes, times = np.unique(ngrams(text), return_counts=True)
    if len(codes) > most:
        least = np.partition(times, len(times) - most)[len(times) - most]
        own = times >= least
        codes, times = codes[own], times[own]
    return codes[np.argsort(-times, kind="stable")][:most]


class Profiles:
    """Rank of every n-gram in every language's profile."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int = PROFILE):
        """rows: language, n-gram, rank from 0."""
        self.most = most
        self.languages = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.languages)}
        self.codes = np.unique(np.array([r[1] for r in rows], np.uint64))
        self.ranks = np.full((len(self.codes) + 1, len(at)), -1, np.int64)
        for lang, code, rank in rows:
            self.ranks[np.searchsorted(self.codes, np.uint64(code)), at[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - out-of-place distance as a share of the largest); equal distances go to the first name."""
        own = ranked(text, self.most) if text else np.zeros(0, np.uint64)
        if not len(own) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at = np.where(at < len(self.codes), at, 0)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, self.most, np.abs(theirs - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.most * len(own)))


def learn(labelled: DataFrame, sample: int = SAMPLE, most: int = PROFILE) -> Profiles:
    """Profiles from rows (doc_id, text, lang); rows without lang or text are left out.

    Each language is counted on about `sample` rows, drawn by a hash of the id, or on all if it has fewer.
    Counting is a map over the scan with one combined row per partition, language and n-gram.
    """
    labelled = labelled.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    share: Column = F.lit(False)
    for lang, n in sizes.items():
        share = share | ((F.col("lang") == lang) & (draw < min(1 << 20, -(-(sample << 20) // n))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(np.unique(ngrams(text), return_counts=True))
            for lang, parts in held.items():
                if len(parts) > 1:
                    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    held[lang] = [(codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64))]
        for lang, [(codes, times)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(times)], ["lang", "code", "times"])

    counts = labelled.where(share).select("lang", "text").mapInArrow(count, "lang string, code long, times long").groupBy("lang", "code").agg(F.sum("times").alias("times"))
    best = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("times"), "code")) - 1).where(F.col("rank") < most)
    return Profiles([(r.lang, r.code, r["rank"]) for r in best.select("lang", "code", "rank").collect()], most)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """The columns in keep, lang_pred and score (0 to 1) of each row; only text decides.

    A null text, or one without a letter, is `und` with score 0; without any profile all are. Rows are
    independent: repeated rows repeat, and an empty table gives none. A narrow map over the scan.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(t) for t in texts(batch)]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "lang_pred string, score double"
    return docs.select(*keep, *["text"] * ("text" not in keep)).mapInArrow(run, schema)
