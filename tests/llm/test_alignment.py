"""Tokens of two tokenizers against a plain alignment of whole documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from nestfold.llm import alignment, queries
from nestfold.llm.tables import texts
from nestfold.storage import written

FILES = alignment.Files(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "tokenizer", "Überraschung", "naïve", "日本語", "<|endoftext|>", "<s>", "x1y2", "aaaaaaa", "🙂", "  ", "\n", "it's", "1234567"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    made += [None, "", " ", "a", "▁ not spelled", "the " * 4000, "\x00\x01 é", "<0x41>", made[0], made[0]]
    return [*enumerate(made), (None, "no id"), (3, made[3])]


def spelled():
    """The bytes of all ids, from the vocabularies themselves."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    whole, m = Tokenizer.from_file(FILES.byte_level), SentencePieceProcessor(model_file=FILES.pieces)
    whole.encode_special_tokens = True
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    a = {i: bytes(letters[c] for c in t) for t, i in whole.get_vocab().items()}
    b = {i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())}
    return whole, m, a, b


def plain(by_id):
    """{id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)}, token by token."""
    whole, m, a_bytes, b_bytes = spelled()
    links, groups, sizes = {}, {}, {}
    for i, text in by_id.items():
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = m.encode(text) if text else []
        if b"".join(a_bytes[x] for x in a) != (" " + (text or "")).encode() or b"".join(b_bytes[x] for x in b) != (" " + (text or "")).encode():
            a = b = []
        sizes[i], links[i], groups[i] = (len(a), len(b)), [], []
        x = y = x_end = y_end = 0
        left, right = [], []
        while x < len(a) or y < len(b):
            if x_end <= y_end and x < len(a):
                new_x = x_end + len(a_bytes[a[x]])
                left.append((x, x_end, new_x))
                x_end, x = new_x, x + 1
            else:
                new_y = y_end + len(b_bytes[b[y]])
                right.append((y, y_end, new_y))
                y_end, y = new_y, y + 1
            if x_end == y_end:
                links[i] += [(a[p], b[q]) for p, s, e in left for q, t, u in right if s < u and t < e]
                groups[i].append(",".join(str(a[p[0]]) for p in left) + "|" + ",".join(str(b[q[0]]) for q in right))
                left, right = [], []
    count = Counter(pair for found in links.values() for pair in set(found))
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    return {i: (*sizes[i], len(groups[i]), len(found), sum(count[x] == best[x[0]] for x in found), sum(count[x] for x in found), ";".join(groups[i])) for i, found in links.items()}


def test_alignment_against_a_plain_one(spark, rows, tmp_path):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, groups string, key int").repartition(4)
    expected = plain({i: t for i, t in rows if i is not None})
    assert expected[3][2] > 3 and expected[[i for i, t in rows if t and t.startswith("▁")][0]][:4] == (0, 0, 0, 0)
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(texts(docs), FILES).collect()}
    assert found == expected
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_token_alignment(spark, str(tmp_path)).collect()}
    assert got == {i: (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for i, r in expected.items()}
    assert alignment.align(texts(docs.where(F.lit(False))), FILES).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_counts_are_sorted_shards(spark, parts, monkeypatch):
    monkeypatch.setattr(alignment, "_MERGE", 50)
    monkeypatch.setattr(alignment, "_HELD", 100)
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 40, 5000) << 32 | rng.integers(0, 20, 5000)
    partial = written(spark.createDataFrame([(int(k), 1) for k in keys], "key long, n long").repartition(5), "partial")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    made = alignment.shards(partial, 40)
    listed = [(r["key"], r["n"]) for r in alignment.counts(partial).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    values, n = np.unique(keys, return_counts=True)
    assert listed == list(zip(values.tolist(), n.tolist(), strict=True))
    assert (made.look_up(values) == n).all() and len(made.paths) <= parts
    assert made.best.tolist() == [int(n[values >> 32 == a].max()) for a in range(40)]
