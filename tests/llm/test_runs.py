"""Periodic runs against brute force, over whole documents and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.llm import queries, runs
from nestfold.llm.tables import texts


def slow_runs(words, least=12):
    """(start, length, period) of every run, each period tried at every place."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def slow_collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(rng, letters, n):
    words = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.7:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 2))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_against_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(60):
        docs = [[str(w).encode() for w in periodic(rng, range(letters), rng.randint(0, 130))] for _ in range(rng.randint(1, 4))]
        numbers, of = [], []
        for k, d in enumerate(docs):
            of.append(len(numbers))
            numbers += [int(w) for w in d] + [letters + k]
        found = runs.runs_of(np.array(numbers, np.int64), max(map(len, docs))).tolist()
        expected = [[a + s, a + s + n, p] for a, d in zip(of, docs, strict=True) for s, n, p in slow_runs(d)]
        assert found == expected
        assert runs.runs_of(np.array(numbers, np.int64), max(map(len, docs)), plain=True).tolist() == expected


def test_a_wrong_hash_is_noticed(monkeypatch):
    monkeypatch.setattr(runs, "_FIELDS", ((5, 3), (3, 2)))
    rng = random.Random(4)
    words = periodic(rng, range(3), 90) + [rng.randrange(3) for _ in range(60)]
    assert runs.runs_of(np.array(words, np.int64), 150).tolist() == [[s, s + n, p] for s, n, p in slow_runs(words)]


def test_find_and_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    letters = ["a", "b", "Ünï", "é", "ça"]
    rows = [(i, "\t ".join(periodic(rng, letters, rng.randint(0, 200))) if i % 2 else " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 300))), "x") for i in range(80)]
    rows += [(100, None, "x"), (101, "", "x"), (102, " \n ", "x"), (103, "one", "x"), (104, "same " * 3000, "x"), (105, "a b " * 7, "x"), (None, "a " * 50, "x"), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    by_id = {i: (t or "").encode().split() for i, t, _ in rows if i is not None}
    plain = {r["doc_id"]: r for r in runs.find(texts(docs)).collect()}
    assert set(plain) == set(by_id)
    for i, words in by_id.items():
        found = slow_runs(words) if i != 104 else [(0, 3000, 1)]
        assert [tuple(r) for r in plain[i]["runs"]] == found, i
        assert plain[i]["collapsed"].encode() == slow_collapsed(words, found) and plain[i]["n_words"] == len(words)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for i, words in by_id.items():
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        found = slow_runs(words) if i != 104 else [(0, 3000, 1)]
        best = min(((-n, s, p) for s, n, p in found), default=None)
        told = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        want = (len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(slow_collapsed(words, found)).hexdigest())
        assert tuple(got[i])[1:] == want, i
    assert set(got) == set(by_id) and changed > 3
    none = docs.where(F.lit(False))
    assert runs.find(none).count() == 0
    with pytest.raises(ValueError):
        runs.find(none, 6)
