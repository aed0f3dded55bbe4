"""Language identification against a plain reimplementation, and words with combining marks."""

import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nestfold.llm import langid


def plain_words(text):
    """Letters with the letters and marks that follow them."""
    out, word = [], ""
    for c in (text or "").lower():
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and word:
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out + ([word] if word else [])


def plain_scores(rows, text):
    """{lang: sum of log frequencies}: words first, then n-grams of 5 to 1 characters."""
    langs = sorted({lang for _, lang in rows})
    words = {lang: Counter(w for t, of in rows if of == lang for w in plain_words(t)) for lang in langs}

    def chances(counts, item):
        total_names = len({x for c in counts.values() for x in c})
        return {lang: math.log((counts[lang][item] + 0.1) / max(sum(counts[lang].values()) + 0.1 * total_names, 1)) for lang in langs}

    def pieces(word, n):
        padded = f" {word} " if n > 1 else word
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    sums = dict.fromkeys(langs, 0.0)
    for w in plain_words(text):
        if any(c[w] for c in words.values()):
            for lang, x in chances(words, w).items():
                sums[lang] += x
            continue
        for n in (5, 4, 3, 2, 1):
            counts = {lang: Counter() for lang in langs}
            for lang in langs:
                for known, k in words[lang].items():
                    for g in pieces(known, n):
                        counts[lang][g] += k
            seen = [g for g in pieces(w, n) if any(c[g] for c in counts.values())]
            if seen:
                for lang in langs:
                    sums[lang] += sum(chances(counts, g)[lang] for g in seen) / len(seen)
                break
    return sums


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    vocabulary = {"aa": ["the", "then", "İstanbul", "naïve", "Ünder"], "bb": ["der", "dem", "ünter", "strasse"], "cc": ["में", "है", "की", "हिन्दी", "के"]}
    return [(" ".join(rng.choice(v) for _ in range(rng.randint(1, 12))), lang) for _ in range(12) for lang, v in vocabulary.items()]


def test_against_a_plain_reimplementation(spark, rows):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)] + [(None, "the", "aa"), (99, None, "aa"), (98, "der", None)], "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, each=10**6)
    asked = ["the der", "thenx derr unter", "में हिन्दीx", "ISTANBUL İSTANBUL", "q w", "की, the. है!", "123 !", "", None, "naïveté und strass", "zzz"]
    found = langid.predict(spark.createDataFrame([(i, False, t) for i, t in enumerate(asked)], "doc_id long, held_out boolean, text string"), model)
    for r in found.collect():
        text = asked[r["doc_id"]]
        words = plain_words(text)
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = plain_scores(rows, text)
        best = max(sorted(sums), key=lambda x: sums[x])
        share = 1 / sum(math.exp((s - sums[best]) / math.sqrt(len(words))) for s in sums.values())
        assert r["lang_pred"] == best and r["score"] == pytest.approx(share, rel=1e-3), text


def test_marks_belong_to_words():
    assert langid.words_of("हिन्दी में है́! é́t") == ["हिन्दी", "में", "है́", "é́t"]
    assert langid.words_of("́ 12 ½") == [] == langid.words_of(None)


def test_bound_on_rows_is_by_language(spark, rows):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows * 30)], "doc_id long, text string, lang string")
    few = langid.sampled(docs, 100).groupBy("lang").agg(F.count("*").alias("n")).collect()
    assert all(60 < r["n"] < 140 for r in few) and langid.sampled(docs, 10**6).count() == docs.count()
