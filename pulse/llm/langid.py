"""Language identification by n-gram filters with one bit for each language.

Every language has a Bloom filter of the n-grams (four bytes of the lower-cased
text, runs of non-letters as one blank) that are common in it. The filters are
stored across: slot i holds bit i of all filters as one word, so two look-ups
and an AND give the mask of all languages that contain an n-gram. A text's
counts per language are corrected for each filter's rate of false positives;
the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import claim, in_small_batches, lean, slices, stored

UNKNOWN = "und"
GRAM = 4
SLOT_BITS = 20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLOCK_BYTES = 1 << 20
#: The model is fitted on about so many documents of each language, chosen by a hash of their id.
SAMPLE_PER_LANGUAGE = 2000
DRAWS = 1 << 62  # so fine that a sample's share is never rounded to none
#: and keeps so many n-grams of a language at most, the most common first.
GRAMS_PER_LANGUAGE = 50_000
#: An n-gram counts for a language if at least this part of its sampled documents holds it, and this part of the highest such share.
LEAST_SHARE, LEAST_OF_BEST = 0.003, 0.25

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def fold(text: str) -> np.ndarray:
    """Bytes of a text, framed by blanks, with each run of ASCII non-letters as one blank."""
    raw = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8") + b" ", np.uint8)]
    blank = raw == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    return raw[keep]


def grams(folded: np.ndarray) -> np.ndarray:
    if len(folded) < GRAM:
        return np.empty(0, np.uint64)
    n = len(folded) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out |= folded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def slots(g: np.ndarray) -> list[np.ndarray]:
    return [((g * np.uint64(m)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in MULTIPLIERS]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    words: list[np.ndarray]  # one for each 64 languages: the slots' masks
    false_rate: np.ndarray
    fallback: int

    def counts(self, folded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams of each text, and of those in each language's filter."""
        size = np.array([max(0, len(f) - GRAM + 1) for f in folded])
        out = np.zeros((len(folded), len(self.languages)), np.int64)
        full = np.flatnonzero(size)
        if len(full):
            all_grams = np.concatenate([grams(folded[i]) for i in full])
            starts = np.concatenate(([0], np.cumsum(size[full])))[:-1]
            at = slots(all_grams)
            for w, word in enumerate(self.words):
                mask = word[at[0]] & word[at[1]]
                for k in range(min(64, len(self.languages) - 64 * w)):
                    out[full, 64 * w + k] = np.add.reduceat(((mask >> mask.dtype.type(k)) & mask.dtype.type(1)).astype(np.int32), starts)
        return size, out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        folded = [fold(t) for t in texts]
        for a, b in slices([len(f) for f in folded], BLOCK_BYTES):
            size, hits = self.counts(folded[a:b])
            for i in range(b - a):
                if not self.languages or not has_letter(texts[a + i]):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                share = np.clip((hits[i] / max(size[i], 1) - self.false_rate) / (1 - self.false_rate), 0, 1)
                total = share.sum()
                k = int(share.argmax()) if total > 0 else self.fallback
                names.append(self.languages[k])
                scores.append(float(share[k] / total) if total > 0 else 0.0)
        return names, scores


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the languages of docs; rows without text or language teach nothing, an empty table gives a model that knows none."""
    known = in_small_batches(docs).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    totals = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], [], np.zeros(0), 0)
    limits = F.lit(0).cast("long")
    for name, n in totals.items():
        limits = F.when(F.col(lang_col) == name, F.lit(min(DRAWS, DRAWS * per_language // n)).cast("long")).otherwise(limits)
    sample = known.where(F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(DRAWS)) < limits).select(lang_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            sizes = pa.compute.binary_length(batch.column(1)).to_pylist()
            for a, b in slices(sizes, BLOCK_BYTES):
                by: dict[str, list[np.ndarray]] = {}
                for lang, x in zip(langs[a:b], batch.column(1).slice(a, b - a), strict=True):
                    by.setdefault(lang, []).append(np.unique(grams(fold(x.as_py()))))
                for lang, found in by.items():
                    g, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    found = stored(sample.mapInArrow(lean(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sampled = {name: min(n, per_language) for name, n in totals.items()}
    shares: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name in languages:
        top = found.where((F.col("lang") == name) & (F.col("n") >= LEAST_SHARE * sampled[name]))
        rows = top.orderBy(F.desc("n"), "gram").limit(GRAMS_PER_LANGUAGE).select("gram", "n").toArrow()
        shares[name] = rows.column("gram").to_numpy(), rows.column("n").to_numpy() / sampled[name]
    every, at = np.unique(np.concatenate([g for g, _ in shares.values()]), return_inverse=True)
    highest = np.zeros(len(every))
    np.maximum.at(highest, at, np.concatenate([s for _, s in shares.values()]))
    words = []
    for w in range(0, len(languages), 64):
        group = languages[w : w + 64]
        kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(group) <= bits)
        word = np.zeros(1 << SLOT_BITS, kind)
        for k, name in enumerate(group):
            g, s = shares[name]
            g = g[s >= LEAST_OF_BEST * highest[np.searchsorted(every, g)]].astype(np.uint64)
            for at in slots(g):
                word[at] |= kind(1 << k)
        words.append(word)
    full = np.concatenate([[np.count_nonzero(word & word.dtype.type(1 << k)) for k in range(min(64, len(languages) - 64 * w))] for w, word in enumerate(words)])
    return Model(languages, words, (full / (1 << SLOT_BITS)) ** len(MULTIPLIERS), max(range(len(languages)), key=lambda i: (totals[languages[i]], -i)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' columns with lang_pred and score (replaced if docs has them).

    A null text or one without a letter is ``und`` with score 0. A text none
    of whose n-grams is known gets the most common language with score 0; ties
    go to the name that sorts first. Rows are judged one by one.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid", dict)
        for batch in batches:
            sizes = [n or 0 for n in pa.compute.binary_length(batch.column(at)).to_pylist()]
            for a, b in slices(sizes, BLOCK_BYTES):
                part = batch.slice(a, b - a)
                langs, scores = model.predict([x or "" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*names).mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id"):
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2; false for rows without id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def teaching(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
