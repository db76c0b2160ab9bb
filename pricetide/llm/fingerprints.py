"""Document fingerprints: I-Match over randomised lexicon subsets of several densities."""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import lower_ascii, range_of, word_array, written

#: A term is kept if it occurs in this share of the documents, from and to (and in two documents at least).
BAND = (1 / 500, 1 / 20)
#: Random draws of the lexicon, and densities of each draw: 1/4, 1/8, ... of the terms, as powers of 1/2.
DRAWS, DENSITIES = 8, tuple(range(2, 10))
SUBSETS = DRAWS * len(DENSITIES)
#: Lexicons of up to so many terms are broadcast; a larger one is joined by shuffling.
BROADCAST_TERMS = 2_000_000
#: Documents of one range in which a document's successor is looked up.
RANGE_ROWS = 1_000
MOST_RANGES = 10_000
EMPTY = "----"


def _terms(text: Column) -> Column:
    return F.array_distinct(word_array(lower_ascii(text)))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """Rows (term, digest, depths) of the terms within the band of document frequencies.

    `depths` says for each draw in how many of its nested subsets the term is, from the densest on. A band that is bounded below by a share of the documents holds at
    most (distinct terms of a document) / share terms, however many documents there are.
    """
    total = docs.count()
    least, most = max(2, ceil(total * band[0])), total * band[1]
    df = docs.select(F.explode(_terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = df.where((F.col("df") >= least) & (F.col("df") <= max(2, most)))
    depths = []
    for draw in range(DRAWS):
        bits = F.xxhash64("term", F.lit(f"draw {draw}"))
        depths.append(sum(((F.pmod(bits, F.lit(1 << d)) == 0).cast("int") for d in DENSITIES), F.lit(0)))
    return kept.select("term", F.xxhash64("term").alias("digest"), F.array(*depths).alias("depths"))


def fingerprint(texts: DataFrame, terms: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Columns `keys`, `whole` and `subsets` of the column `text`; `keys` must tell the rows apart.

    A set of distinct terms gets the exclusive or of its terms' digests, which stands for the digest of the
    sorted list: it is the same for the same terms in any order. `whole` is that of all kept terms (hex), or
    of all terms after a `~` where none is kept; `subsets` has 16 bits per subset, -1 for an empty one.
    """
    # A text in the row would be copied for each of its terms, so it ends here.
    rows = texts.select(*keys, F.explode_outer(_terms(F.col("text"))).alias("term"))
    met = rows.join(F.broadcast(terms) if small else terms, "term", "left")
    digest = F.col("digest").bitwiseAND(F.lit(0xFFFF)).cast("int")
    subsets = []
    for draw in range(DRAWS):
        for depth in range(1, len(DENSITIES) + 1):
            inside = F.element_at("depths", draw + 1) >= depth
            subsets.append(F.coalesce(F.bit_xor(F.when(inside, digest)), F.lit(-1)))
    kept = F.lower(F.lpad(F.hex(F.bit_xor("digest")), 16, "0"))
    other = F.concat(F.lit("~"), F.lower(F.lpad(F.hex(F.bit_xor(F.xxhash64("term"))), 16, "0")))
    return met.groupBy(*keys).agg(
        F.coalesce(kept, F.when(F.count("term") > 0, other), F.lit("")).alias("whole"), F.array(*subsets).alias("subsets")
    )


def as_text(whole: Column, subsets: Column) -> Column:
    parts = F.transform(
        subsets, lambda s: F.when(s < 0, EMPTY).otherwise(F.lower(F.lpad(F.hex(s.cast("long")), 4, "0")))
    )
    return F.concat(whole, F.lit(":"), F.array_join(parts, ""))


def likeness(whole_a: Column, a: Column, whole_b: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the share of equal subsets among those that are not empty on both sides."""
    alike, shown = [], []
    for i in range(1, SUBSETS + 1):
        x, y = F.element_at(a, i), F.element_at(b, i)
        shown.append(F.when((x >= 0) | (y >= 0), 1).otherwise(0))
        alike.append(F.when((x >= 0) & (x == y), 1).otherwise(0))
    equal = (whole_a == whole_b) & (a == b)
    part = F.coalesce(reduce(add, alike) / F.nullif(reduce(add, shown), F.lit(0)), F.lit(0.0))
    return F.when(equal, F.lit(1.0)).otherwise(part)


def with_next(docs: DataFrame) -> DataFrame:
    """Columns id, tie, text of `docs` with `next_id`, `next_tie`, `next_text` of the next lower id.

    `range` and `place` number the rows, so they tell equal rows apart.

    After the lowest id comes the highest. Ranges of ids are window partitions; each also gets the first
    document of the range below, so that its last one finds its successor. Equal ids are ordered by a digest
    of the text (`tie`), NULL ids come last. The driver sees one id per range.
    """
    rows = docs.count()
    wanted = max(1, min(MOST_RANGES, ceil(rows / RANGE_ROWS)))
    bounds = []
    if wanted > 1:
        cuts = docs.select("id").approxQuantile("id", [i / wanted for i in range(1, wanted)], 0.1 / wanted)
        bounds = sorted({int(cut) for cut in cuts})
    where = F.coalesce(range_of(F.col("id"), bounds), F.lit(0)).cast("int")
    ranged = docs.withColumn("range", where)
    heads = ranged.groupBy("range").agg(F.max("id").alias("id")).where("id IS NOT NULL").orderBy("range").collect()
    guards = [(head.id, heads[(i + 1) % len(heads)].range) for i, head in enumerate(heads)]
    order = [F.col("guard"), F.col("id").desc_nulls_last(), F.col("tie")]
    ranged = ranged.withColumn("guard", F.lit(False))
    if guards:
        ends = docs.sparkSession.createDataFrame(guards, "id long, range int")
        # One row per range, MOST_RANGES at most.
        ranged = ranged.unionByName(docs.join(F.broadcast(ends), "id").withColumn("guard", F.lit(True)))
    in_order = Window.partitionBy("range").orderBy(*order)
    following = F.lead(F.struct("id", "tie", "text")).over(in_order)
    found = ranged.withColumn("next", following).withColumn("place", F.row_number().over(in_order)).where("NOT guard")
    return found.select(
        "range", "place", "id", "tie", "text", F.col("next.id").alias("next_id"), F.col("next.tie").alias("next_tie"),
        F.coalesce("next.text", F.lit("")).alias("next_text"),
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents, and of the same with their second half replaced by the next document's begin.

    One row per row of `docs`: `doc_id`, `n_chars` (code points), `edited_sha256`, `fingerprint`,
    `edited_fingerprint`, `near_edited` and `near_next` (likeness, 0 to 1, to the edited text's fingerprint
    and to the next document's). A NULL text is an empty one. The next document is the one with the next lower
    id; the highest follows the lowest. A single document is its own successor. Where all ids are NULL, the
    last one's successor is empty. Rows that agree in id and text are alike.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = written(lexicon(texts), "lexicon")
    small = terms.count() <= BROADCAST_TERMS
    pairs = with_next(texts.withColumn("tie", F.xxhash64("text")))
    chars = F.length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), chars - half), F.substring(F.col("next_text"), F.lit(1), half))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), edited.alias("text"))
    )
    both = pairs.select("range", "place", "id", "tie", "next_id", "next_tie", chars.cast("long").alias("n_chars"), F.inline(sides))
    both = both.withColumn("sha", F.when(F.col("side") == 1, F.sha2("text", 256)))
    keys = ["range", "place", "id", "tie", "next_id", "next_tie", "n_chars", "side", "sha"]
    prints = written(fingerprint(both, terms, keys, small), "prints")

    own = prints.where("side = 0").drop("side", "sha")
    changed = prints.where("side = 1").selectExpr("range", "place", "sha", "whole AS e_whole", "subsets AS e_subsets")
    following = prints.where("side = 0").groupBy(F.col("id").alias("f_id"), F.col("tie").alias("f_tie"))
    following = following.agg(F.first("whole").alias("f_whole"), F.first("subsets").alias("f_subsets"))
    after = F.col("next_id").eqNullSafe(F.col("f_id")) & (F.col("next_tie") == F.col("f_tie"))
    joined = own.join(changed, ["range", "place"]).join(following, after, "left")
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("whole"), F.col("subsets")).alias("fingerprint"),
        as_text(F.col("e_whole"), F.col("e_subsets")).alias("edited_fingerprint"),
        likeness(F.col("whole"), F.col("subsets"), F.col("e_whole"), F.col("e_subsets")).alias("near_edited"),
        F.coalesce(
            likeness(F.col("whole"), F.col("subsets"), F.col("f_whole"), F.col("f_subsets")), F.lit(0.0)
        ).alias("near_next"),
    )
