"""URL filters: list rules first, then logistic regression on hashed character n-grams.

The model is fitted on the driver from a small labelled URL table, which is a parameter; it never
sees the table that it judges. Host and path have n-grams of their own, each normalised by itself, so
a long path does not thin out what the host says.

The table used by default follows from ``data/url_words.csv``: words that were written down for it by
kind of site (what public block lists sort by: adult, gambling, pharmacy spam, phishing, malware, piracy,
link spam, advertising; and ordinary sites), without a look at the tables that are judged; what was known
of them beforehand is told in the README. Each word is put into hosts with neutral paths, and into paths of neutral hosts, short and long.
"""

from __future__ import annotations

import csv
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a rule is a host and the start of a path, written together.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
WORDS = Path(__file__).parent / "data" / "url_words.csv"
#: Where a word is put: the word's own part is {w}; {n} is its number, {o} another word of no meaning.
HOSTS = ("https://{w}.com/", "https://www.{w}.net/en/{n}", "http://{w}-{o}.org/index.html", "https://the{w}.info/page/{n}?id={n}", "https://m.{w}{n}.com/{o}/{o}", "https://{o}.{w}.co.uk/{o}/{n}/{o}-{o}.html")
PATHS = ("https://www.{o}.com/{w}", "https://{o}.net/{w}/{n}", "https://{o}.org/{o}/{w}-{o}/index.html", "http://{o}.example.com/{o}/{n}/{o}/{w}.html")
NEUTRAL = ("site", "page", "home", "main", "item", "view", "list", "web", "portal", "info", "blue", "delta", "north", "alpha", "online", "world")
SIZES = (3, 4, 5)
DIMS = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last to be put on top is the longest
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def words() -> list[tuple[str, int]]:
    """The words of the data file and their labels."""
    with WORDS.open(newline="") as f:
        return [(w, int(r["label"])) for r in csv.DictReader(f) for w in r["words"].split()]


def labelled_urls(of: Sequence[tuple[str, int]]) -> list[tuple[str, int]]:
    """Labelled urls of labelled words; the neutral parts are the same for both labels."""
    out = []
    for n, (word, label) in enumerate(sorted(of, key=lambda x: zlib.crc32(x[0].encode()))):
        for k, template in enumerate((*HOSTS, *PATHS)):
            o = NEUTRAL[(7 * n + 3 * k) % len(NEUTRAL)]
            out.append((template.format(w=word, n=10 + (37 * n + k) % 990, o=o), label))
    return out


def grams(text: str, kind: str) -> list[int]:
    """Feature numbers of the character n-grams of a host (kind h) or path (p)."""
    text = f"^{text}$"
    return [zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % DIMS for n in SIZES for i in range(len(text) - n + 1)]


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values): counts of n-grams over their norm, of host and path apart."""
    at, values = [], []
    for text, kind in ((host, "h"), (path, "p")):
        i, n = np.unique(np.array(grams(text, kind), np.int64), return_counts=True)
        at.append(i)
        values.append(n / max(np.sqrt((n * n).sum()), 1e-9))
    return np.concatenate(at), np.concatenate(values)


def split(url: str) -> tuple[str, str]:
    """Host and path of one url, as ``host_of`` and ``path_of`` find them."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), slash + path


def fit(labelled: Sequence[tuple[str, int]], steps: int = 200, rate: float = 4.0, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient descent on the mean logistic loss; both labels count alike, however many rows each has."""
    x = np.zeros((len(labelled), DIMS), np.float32)
    for row, (url, _) in zip(x, labelled, strict=True):
        at, values = features(*split(url))
        np.add.at(row, at, values)
    used = np.flatnonzero(x.any(axis=0))
    x, y = x[:, used], np.array([v for _, v in labelled], np.float32)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    w, b = np.zeros(len(used), np.float32), 0.0
    for _ in range(steps):
        wrong = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        w -= rate * (x.T @ wrong + l2 * w)
        b -= rate * float(wrong.sum())
    out = np.zeros(DIMS)
    out[used] = w
    return out, b


@cache
def default_model() -> tuple[np.ndarray, float]:
    return fit(labelled_urls(words()))


def block_chance(model: tuple[np.ndarray, float], host: str, path: str) -> float:
    at, values = features(host, path)
    return float(1 / (1 + np.exp(-(model[0][at] @ values + model[1]))))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, int]] | None = None, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, block_score (0 to 1) and verdict.

    Row by row: repeated rows and null ids stay as they are. A url that is null or has no ``://``
    has empty host and path, fits no rule, and is judged by the model on those. Columns of
    ``pages`` that have the names of the new ones are replaced. ``labelled`` is (url, 1 to block or 0
    to allow); by default that of the data file.
    """
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(default_model() if labelled is None else fit(labelled))

    @F.pandas_udf("double")
    def block_score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights, start = model.value
        side = {"h": {}, "p": {}}  # what a host or path adds; kept up to a bound

        def adds(kind: str, text: str) -> float:
            have = side[kind]
            if (v := have.get(text)) is None:
                if len(have) >= 50_000:
                    have.clear()
                at, n = np.unique(np.array(grams(text, kind), np.int64), return_counts=True)
                v = have[text] = float(weights[at] @ n) / max(np.sqrt((n * n).sum()), 1e-9)
            return v

        for hosts, paths in parts:
            z = np.array([adds("h", h) + adds("p", p) for h, p in zip(hosts, paths, strict=True)], float) + start
            yield pd.Series(1 / (1 + np.exp(-z)))

    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": rule, "_said": said, "block_score": block_score("host", "path")})
    return scored.withColumn("verdict", F.coalesce("_said", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))).drop("_said")


def held_out_accuracy(folds: int = 5) -> float:
    """The share of right verdicts for urls of words that a model has not seen, each fold of words held out in turn."""
    every = words()
    fold = lambda w: zlib.crc32(b"fold" + w.encode()) % folds
    right = total = 0
    for k in range(folds):
        model = fit(labelled_urls([x for x in every if fold(x[0]) != k]))
        for url, label in labelled_urls([x for x in every if fold(x[0]) == k]):
            right += (block_chance(model, *split(url)) >= 0.5) == bool(label)
            total += 1
    return right / total
