"""I-Match fingerprints over several randomised lexicon subsets.

The lexicon is the terms whose inverse document frequency lies in a band, counted over all documents.
A fingerprint hashes the sorted distinct in-band terms of a text once for each subset of it:

- WIDE subsets that overlap: each keeps a random 7/8 of the lexicon, so every term of a text is in
  most of them. Texts that differ in one in-band term agree in about one of eight of these.
- SUBSETS disjoint subsets at each of LEVELS densities, drawn so thin for a text's size that an edit
  leaves some of them as they were. The densities are for the text's own size, a half and a quarter
  of that, so any two texts of like size have densities in common.

The likeness of two fingerprints is the share of equal hashes, among the disjoint subsets of which
either has a term, at the densities that both have; all wide subsets, which hash the same terms again
and again, count as one more. It is 1 only if they all agree too.

The band's rare end is a share of all documents, so with m distinct terms in a document on average
the lexicon has at most m / rare terms, however many documents there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestfold.storage import written

WIDE, SUBSETS, LEVELS = 8, 32, 3
#: So many lexicon terms may be broadcast (8 bytes each); above, they meet documents in a shuffled join.
BROADCAST_ROWS = 4_000_000


def term_hashes(text: Column) -> Column:
    """The distinct hashes of the lower-cased runs of letters and digits."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w)))


def idf_bounds(n: int, common: float, rare: float) -> tuple[float, float]:
    """The least and greatest document frequency whose idf = ln(n / df) is from ln(1 / common) to ln(1 / rare)."""
    return rare * n, common * n


def lexicon(docs: DataFrame, common: float = 0.2, rare: float = 0.0005) -> DataFrame:
    """(h): the term hashes of (text) in the idf band, over all documents."""
    low, high = idf_bounds(docs.count(), common, rare)
    df = docs.select(F.explode(term_hashes(F.col("text"))).alias("h")).groupBy("h").count()
    return df.where(F.col("count").between(low, max(high, 1.0))).select("h")


def _longs(values: list[int]) -> Column:
    """A constant array, folded once by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def neighbours(docs: DataFrame, ranges_each: int = 8) -> DataFrame:
    """(range, guest, doc_id, next_id, text, next_text): texts dealt by ranges of ids, each beside the next one.

    The one shuffle is by range, ``ranges_each`` of them for each partition. A range's first document
    is also the guest at the end of the range before (the first range's: of the last), so that every
    document but the guests finds its next in its own range. What the driver holds is two ids a range.
    """
    spark = docs.sparkSession
    wanted = ranges_each * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], max(10_000, 10 * wanted))).first()[0] if wanted > 1 else []
    bounds = [-(1 << 63), *sorted({c for c in cuts or []} - {-(1 << 63)})]
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, (len(bounds) - 1).bit_length())))])
    search = lambda at, step: F.when(F.get(_longs(bounds), at + step) <= F.col("doc_id"), at + step).otherwise(at)
    placed = docs.withColumn("range", F.aggregate(steps, F.lit(0), search))  # of the last bound up to the id
    firsts = dict(placed.groupBy("range").agg(F.min("doc_id")).collect())
    used = sorted(firsts)
    before = {r: used[i - 1] for i, r in enumerate(used)}
    every = range(len(bounds))
    first, previous = _longs([firsts.get(r, 0) for r in every]), _longs([before.get(r, 0) for r in every]).cast("array<int>")
    own = F.struct("range", F.lit(False).alias("guest"))
    twice = F.array(own, F.struct(F.get(previous, F.col("range")).alias("range"), F.lit(True).alias("guest")))
    at = F.explode(F.when(F.get(first, F.col("range")) == F.col("doc_id"), twice).otherwise(F.array(own)))
    rows = placed.select("doc_id", "text", at.alias("at")).select("at.*", "doc_id", "text")
    order = Window.partitionBy("range").orderBy("guest", "doc_id")
    return rows.select("*", F.lead("doc_id").over(order).alias("next_id"), F.lead("text").over(order).alias("next_text"))


def edited(docs: DataFrame) -> DataFrame:
    """(range, guest, doc_id, next_id, n_chars, text, edited): the edit replaces the last quarter by the next document's start; a guest has none."""
    sized = neighbours(docs).withColumn("n_chars", F.length("text").cast("long"))
    keep, need = "cast(n_chars - floor(n_chars / 4) as int)", "cast(floor(n_chars / 4) as int)"
    made = F.expr(f"concat(substring(text, 1, {keep}), substring(next_text, 1, {need}))")
    return sized.select("range", "guest", "doc_id", "next_id", "n_chars", "text", F.when(F.col("guest"), "").otherwise(made).alias("edited"))


def _level(terms: Column) -> Column:
    """How often a document's terms halve before there is at most one for each subset, out-of-band terms included."""
    return F.greatest(F.ceil(F.log2(F.greatest(F.size(terms), F.lit(1)) / SUBSETS)), F.lit(0)).cast("int")


def _wide(terms: Column) -> Column:
    """A 64-bit hash for each wide subset: of the terms of which three bits of their own, subset by subset, are not all 0."""
    kept = lambda k: F.filter(terms, lambda h: F.shiftrightunsigned(h, 3 * k + 40 - 3 * WIDE).bitwiseAND(F.lit(7)) != 0)
    return F.array(*[F.xxhash64(kept(k)) for k in range(WIDE)])


def _thin(terms: Column, level: Column) -> Column:
    """For each disjoint subset at a density of 2^-level, 32 bits, not 0, of the hash of its terms, or 0 without any."""
    rest = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
    drawn = F.filter(terms, lambda h: F.shiftrightunsigned(h, 45).bitwiseAND(rest) == 0)

    def one(k):
        return lambda mine: F.when(F.size(mine) > 0, F.pmod(F.xxhash64(mine), F.lit((1 << 32) - 1)) + 1).otherwise(F.lit(0).cast("long"))

    def of(at):
        subset = lambda k: F.filter(at, lambda h: h.bitwiseAND(F.lit(SUBSETS - 1).cast("long")) == k)
        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long")), lambda k: F.get(F.transform(F.array(subset(k)), one(k)), F.lit(0)))

    # what is drawn is bound once, as the element of an array of one
    return F.flatten(F.transform(F.array(drawn), of))


def _fingerprint(terms: str, level: str, plain: str) -> Column:
    """struct(level, wide, hashes, plain) of sorted terms: plain, of the text itself, only where no term is in the band."""
    none = F.size(terms) == 0
    each = F.concat(*[_thin(F.col(terms), F.col(level) + i) for i in range(LEVELS)])
    empty = F.array().cast("array<bigint>")
    return F.struct(
        F.when(none, -1).otherwise(F.col(level)).alias("level"),
        F.when(none, empty).otherwise(_wide(F.col(terms))).alias("wide"),
        F.when(none, empty).otherwise(each).alias("hashes"),
        F.when(none, F.col(plain)).otherwise(F.lit(0).cast("long")).alias("plain"),
    )


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints as structs. Without an in-band term in either: 1 if the texts' hashes are equal, else 0."""
    up = b["level"] - a["level"]
    size = (LEVELS - F.abs(up)) * SUBSETS
    x = F.slice(a["hashes"], F.greatest(up, F.lit(0)) * SUBSETS + 1, size)
    y = F.slice(b["hashes"], F.greatest(-up, F.lit(0)) * SUBSETS + 1, size)
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v)
    both = total(F.zip_with(x, y, lambda p, q: F.when((p == q) & (p != 0), 1).otherwise(0)))
    any_ = total(F.zip_with(x, y, lambda p, q: F.when((p != 0) | (q != 0), 1).otherwise(0)))
    wide = total(F.zip_with(a["wide"], b["wide"], lambda p, q: F.when(p == q, 1).otherwise(0)))
    share = (both + wide / WIDE) / (any_ + 1)
    return F.when((a["level"] < 0) | (b["level"] < 0), (a == b).cast("double")).when(F.abs(up) >= LEVELS, 0.0).otherwise(share)


def text_of(fp: Column) -> Column:
    """A fingerprint as a string: its level, 16 hex digits for each wide subset and 8 for each other; or ``t`` and the text's hash."""
    digits = lambda c, n: F.array_join(F.transform(c, lambda v: F.lower(F.lpad(F.hex(v), n, "0"))), "")
    plain = F.concat(F.lit("t"), digits(F.array(fp["plain"]), 16))
    return F.when(fp["level"] < 0, plain).otherwise(F.concat(F.lpad(fp["level"].cast("string"), 2, "0"), digits(fp["wide"], 16), digits(fp["hashes"], 8)))


def fingerprints(docs: DataFrame, common: float = 0.2, rare: float = 0.0005) -> DataFrame:
    """(range, guest, doc_id, n_chars, edited_sha256, fp, edited_fp) of (doc_id, text), one row per id and one per guest.

    Equal texts have equal fingerprints. Empty texts, and texts without a term in the band, have a
    fingerprint of their text alone. Rows stay where ``neighbours`` dealt them: no more shuffle
    follows if the lexicon is broadcast.
    """
    words = written(lexicon(docs, common, rare), "lexicon")
    near = F.broadcast(words) if words.count() <= BROADCAST_ROWS else words
    made = edited(docs).select(
        "range", "guest", "doc_id", "n_chars",
        F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256)).alias("sha"), F.xxhash64("text").alias("p0"), F.xxhash64("edited").alias("p1"),
        term_hashes(F.col("text")).alias("t0"), term_hashes(F.col("edited")).alias("t1"),
    )
    made = made.withColumns({"l0": _level(F.col("t0")), "l1": _level(F.col("t1"))})
    each = F.concat(
        F.transform("t0", lambda h: F.struct(F.lit(0).alias("v"), h.alias("h"))),
        F.transform("t1", lambda h: F.struct(F.lit(1).alias("v"), h.alias("h"))),
    )
    keys = ["range", "guest", "doc_id", "n_chars", "sha", "p0", "p1", "l0", "l1"]
    terms = made.select(*keys, F.explode_outer(each).alias("t")).select(*keys, "t.v", "t.h")
    met = terms.join(near.withColumn("known", F.lit(True)), "h", "left")
    mine = lambda v: F.sort_array(F.collect_list(F.when(F.col("known") & (F.col("v") == v), F.col("h"))))
    kept = met.groupBy(*keys).agg(mine(0).alias("k0"), mine(1).alias("k1"))
    return kept.select("range", "guest", "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), _fingerprint("k0", "l0", "p0").alias("fp"), _fingerprint("k1", "l1", "p1").alias("edited_fp"))


def compared(docs: DataFrame, common: float = 0.2, rare: float = 0.0005) -> DataFrame:
    """Fingerprints as strings, and their likeness to the edited text's and to the next document's."""
    order = Window.partitionBy("range").orderBy("guest", "doc_id")
    met = fingerprints(docs, common, rare).withColumn("next_fp", F.lead("fp").over(order)).where("NOT guest")
    return met.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
