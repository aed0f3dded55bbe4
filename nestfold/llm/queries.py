"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.llm import alignment, decontamination, graph_search, imatch, kd_shards, langid, packing, quality, runs, simhash, suffix_dedup, url_filter, warc
from nestfold.llm.tables import table, texts
from nestfold.storage import new_path, written


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``documents``, null ids too; null and empty texts are scored on features of 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = langid.held_out(F.col("doc_id"), 3, 1)
    found = written(quality.featured(docs, "doc_id"), "quality-features")
    scored = quality.scored(found, quality.learned(found, labels.where(~held)), "doc_id")
    return scored.select("doc_id", langid.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row an id (see ``tables``); null text is empty; a single document is its own next."""
    return imatch.compared(texts(table(spark, sf_dir, "documents")))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, span (from 0), first_word, last_word (the word after), source_doc_id: repeated passages of 50 words or more."""
    found = suffix_dedup.spans(texts(table(spark, sf_dir, "documents")))
    each = found.select("doc_id", F.posexplode("spans").alias("span", "s"))
    return each.select("doc_id", "span", F.col("s.first").alias("first_word"), F.col("s.last").alias("last_word"), F.col("s.source").alias("source_doc_id"))


def op4_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a row an id (see ``tables``); null html is empty; of equal payloads the smallest page_id is the response."""
    pages = texts(table(spark, sf_dir, "pages"), "page_id", "html", "url")
    path = new_path(spark, "warc")
    warc.write(warc.payloads(pages), path, segment=16 << 10)
    back = warc.reassembled(warc.read(spark, path))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id: a row an id (see ``tables``); texts without words have fingerprint 0 and link like others."""
    found = simhash.near_duplicates(texts(table(spark, sf_dir, "documents")))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, matched, n_shingles, containment: each document with an item of which it has 0.8 of the 5-word shingles; none for documents or items without words."""
    return decontamination.contained(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def _vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row a piece; a null or empty text is the one id 0."""
    return packing.packed(texts(table(spark, sf_dir, "documents")), **_vocabulary())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row of ``documents``, null ids too; ``und`` and 0 for null text and text without a letter; of equal sums the first lang by name."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    return langid.predict(docs, langid.fit(docs.where("NOT held_out").select("doc_id", "text", "lang")))


def op9_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row an id (see ``tables``), under the law ``bytes``; equal texts are in one shard unless they outweigh it."""
    return kd_shards.shard(texts(table(spark, sf_dir, "documents")), 8)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score: a row for each row of ``pages``, null ids and urls too; of rules that fit the longest wins."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")


def _with_a_period(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by the crc32 of their id, made periodic from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    return words[:a] + (words[a : a + 1 + (n - a) // (3 + g % 8)] * (3 + g % 8 + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256: a row an id (see ``tables``); without a run four nulls and hashes of no runs; null and empty texts have no words."""
    found = runs.find(texts(table(spark, sf_dir, "documents")), 12, _with_a_period)
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("best", runs.longest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found of each vector whose id is divisible by 20; none for vectors that take no part (see ``graph_search.fit_vectors``); of a repeated id the smallest vector counts."""
    vectors = written(graph_search.fit_vectors(table(spark, sf_dir, "embeddings")), "fit-vectors")
    return graph_search.search(graph_search.index(vectors), vectors.where("vec_id % 20 = 0"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row an id (see ``tables``); zeros and '' for null and empty texts and those whose tokens do not spell them."""
    import public_tokenizers

    path = public_tokenizers.path
    files = alignment.Files(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = alignment.align(texts(table(spark, sf_dir, "documents")), files)
    return found.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_ranking, op2_imatch_fingerprints, op3_suffix_array_dedup, op4_warc_reassembly, op5_simhash_near_dedup,
        op6_benchmark_decontamination, op7_pattern_packing, op8_language_id, op9_kd_tree_sharding, op10_url_filter,
        op11_periodic_runs, op12_graph_search, op13_token_alignment,
    )
}

_WORDS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
ORACLE_SQL = {
    "op4_warc_reassembly": """
        WITH p AS (SELECT page_id, encode(min(coalesce(html, ''))) AS html FROM pages WHERE page_id IS NOT NULL GROUP BY page_id),
        d AS (SELECT page_id, octet_length(html) AS n, sha256(html) AS digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS head FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND head < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND head < page_id THEN head END AS refers_to
        FROM f""",
    "op6_benchmark_decontamination": f"""
        WITH i AS (SELECT item_id, {_WORDS.format("min(text)")} AS w FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
        s AS (SELECT item_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE [array_to_string(w[k : k + 4], ' ') FOR k IN range(1, len(w) - 3)] END)) AS shingle FROM i WHERE len(w) > 0),
        n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
        d AS (SELECT doc_id, {_WORDS.format("min(coalesce(text, ''))")} AS w FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
        t AS (SELECT DISTINCT doc_id, unnest(flatten([[array_to_string(w[k : k + m - 1], ' ') FOR k IN range(1, len(w) - m + 2)] FOR m IN [1, 2, 3, 4, 5]])) AS shingle FROM d),
        m AS (SELECT doc_id, item_id, count(*) AS matched FROM t JOIN s USING (shingle) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, matched, n AS n_shingles, matched / n AS containment
        FROM m JOIN n USING (item_id) WHERE matched >= ceil(0.8 * n - 1e-9)""",
}
