"""Language identification by words first, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestfold.llm.tables import small_batches

LONGEST = 5
#: A word begins with a letter; the marks that go with letters, as vowel signs do, are part of it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNDETERMINED = "und"
#: So many languages are broadcast with their numbers of rows; above, texts meet them in a shuffled join.
BROADCAST_LANGS = 100_000


class Model:
    """Per-language log frequencies of words, and of character n-grams for words not seen.

    A known word adds its own log frequencies. An unseen word adds the mean log frequencies of its
    longest n-grams of which any was seen: five characters, then four, down to one. Where not even
    a single character was seen, it adds nothing.
    """

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        self.words = self._table({lang: counts[lang] for lang in self.langs})
        self.grams = []
        for n in range(LONGEST, 0, -1):
            by = {}
            for lang in self.langs:
                by[lang] = c = Counter()
                for word, k in counts[lang].items():
                    for g in grams(word, n):
                        c[g] += k
            self.grams.append((n, self._table(by)))

    def _table(self, counts: dict[str, Counter]) -> tuple[dict[str, int], np.ndarray]:
        names = {w: i for i, w in enumerate(sorted({w for c in counts.values() for w in c}))}
        rows = np.empty((len(names), len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            c, total = counts[lang], sum(counts[lang].values()) + 0.1 * len(names)
            rows[:, j] = math.log(0.1 / max(total, 1))
            for w, k in c.items():
                rows[names[w], j] = math.log((k + 0.1) / total)
        return names, rows

    def unseen(self, word: str) -> np.ndarray:
        for n, (names, rows) in self.grams:
            found = [names[g] for g in grams(word, n) if g in names]
            if found:
                return rows[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None, cache: dict[str, np.ndarray]) -> tuple[str, float]:
        """The language and its share of the softmax over tempered sums; ``und``, 0 without a letter."""
        words = words_of(text)
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        names, rows = self.words
        found = [names.get(w, -1) for w in words]
        at = np.array(found)
        sums = rows[at[at >= 0]].sum(axis=0, dtype=np.float64)
        for w, i in zip(words, found, strict=True) if (at < 0).any() else ():
            if i < 0:
                if (v := cache.get(w)) is None:
                    if len(cache) >= 200_000:
                        cache.clear()
                    v = cache[w] = self.unseen(w)
                sums += v
        z = (sums - sums.max()) / math.sqrt(len(words))
        shares = np.exp(z) / np.exp(z).sum()
        best = int(sums.argmax())
        return self.langs[best], float(shares[best])


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case, alike for learning and for prediction."""
    return WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    text = f" {word} " if n > 1 else word
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def held_out(key: Column, of: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of == rest, F.lit(False))


def sampled(labelled: DataFrame, each: int) -> DataFrame:
    """About ``each`` rows of every lang, all of those with fewer: the rows with the smallest hashes of their id."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / float(1 << 52)
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes
    return labelled.join(sizes, "lang").where(share < each / F.col("_n")).drop("_n")


def fit(labelled: DataFrame, each: int = 2_000) -> Model:
    """A model from (doc_id, text, lang).

    ``each`` bounds the rows that it learns from, language by language; of those, every word counts,
    for words and for n-grams, so what the driver gets follows the vocabulary of those rows. Rows with a null id, text or lang teach nothing. A language is named by
    every row, so there are few; without rows the model says ``und``.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b["lang"], b["text"], strict=True):
                found.update((lang, w) for w in words_of(text))
            yield pd.DataFrame([(lang, w, k) for (lang, w), k in found.items()], columns=["lang", "word", "k"])

    words = sampled(rows, each).select("lang", "text").mapInPandas(part, "lang string, word string, k long")
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, word, k in words.groupBy("lang", "word").agg(F.sum("k")).collect():
        counts[lang][word] = k
    return Model(counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held-out flag untouched, lang_pred, score) row by row, for whole texts.

    ``docs`` needs doc_id, held_out and text. A null text, or one without a letter, is ``und`` with
    score 0. Repeated rows are each predicted.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cache = shared.value, {}
        for b in batches:
            said = [model.predict(t, cache) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "lang_pred": [s for s, _ in said], "score": [p for _, p in said]})

    return docs.select("doc_id", "held_out", "text").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
