"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import Hashes, bounded_batches, components, tokens, written

#: Shingle hashes have 63 bits; those below this bound (0.3 of them) are compared first.
REGION = (1 << 63) * 3 // 10
#: Most prefix tokens that a pair may be asked to share.
MOST_SHARED = 16
#: Postings in the shortest prefix from which a longer one pays.
COST_STEP = 256
#: Members from which a class is first looked at as a whole.
LARGE_CLASS = 8
#: Bits per id of the filter that keeps rows without a candidate out of shuffles, and its bits at most (16 MB).
FILTER_SHARE, MOST_BITS = 32, 1 << 27

SET_SCHEMA = "id long, n long, d1 long, d2 long, low array<long>"


def shingle_set(text: str | None, hashes: Hashes, width: int = 5) -> np.ndarray:
    """Sorted 63-bit hashes of the distinct shingles; a shorter text is one shingle, an empty one has none."""
    words = tokens(text)
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), len(words)) >> 1], np.uint64)
    ids, last = hashes.of(words), len(words) - width + 1
    mixed = np.zeros(last, np.uint64)
    for i in range(width):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + last]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(1))


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                items = shingle_set(text, hashes, width)
                low = items[: np.searchsorted(items, np.uint64(REGION))].astype(np.int64)
                digest = xxhash.xxh3_128_intdigest(items.tobytes())
                rows.append((key, len(items), digest >> 65, digest & ((1 << 63) - 1), low))
            frame = pd.DataFrame(rows, columns=["id", "n", "d1", "d2", "low"])
            yield frame.astype({"id": "Int64"})

    return run


def _whole_sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for batch in batches:
            sets = [shingle_set(text, hashes, width).astype(np.int64) for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "tokens": sets})

    return run


def _similar(width: int, percent: int):
    """Pairs with both texts in, those that are similar out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, kept = Hashes(), {}
        for batch in batches:
            rows = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                if kept.get("id") != a:  # a pivot's pairs often follow one another
                    kept = {"id": a, "text": x, "set": shingle_set(x, hashes, width)}
                left = kept["set"] if kept["text"] == x else shingle_set(x, hashes, width)
                right = shingle_set(y, hashes, width)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                if shared and 100 * shared >= percent * (len(left) + len(right) - shared):
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return run


def _among(rows: DataFrame, ids: DataFrame, key: str = "id", inside: bool = True) -> DataFrame:
    """The rows whose key may be among `ids` (long), a written table: all that are, and few others; or else all other rows.

    A bitmap of the ids' hashes only saves shuffling rows that the join behind it drops. It has FILTER_SHARE bits for
    each id and MOST_BITS at most, and is broadcast as words of 64 bits. NULL is not among the ids.
    """
    wanted = FILTER_SHARE * max(1, ids.count())  # from the footers
    bits = F.lit(min(MOST_BITS, max(64, 1 << (wanted - 1).bit_length())))
    marks = ids.select(F.pmod(F.xxhash64("id"), bits).alias("at")).selectExpr("at DIV 64 AS _filter_word", "shiftleft(1L, cast(at % 64 AS int)) AS bit")
    words = marks.groupBy("_filter_word").agg(F.bit_or("bit").alias("_filter_bits"))  # MOST_BITS / 64 rows at most
    number = F.col(key).cast("long")
    at = F.when(number.isNotNull(), F.pmod(F.xxhash64(number), bits)).otherwise(-64)
    met = rows.withColumn("_filter_at", at).join(F.broadcast(words), F.expr("_filter_at DIV 64 = _filter_word"), "inner" if inside else "left")
    found = F.expr("coalesce(shiftright(_filter_bits, cast(_filter_at % 64 AS int)) & 1, 0) = 1")
    return met.where(found if inside else ~found).drop("_filter_at", "_filter_word", "_filter_bits")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is not in `ids` (one column of `id_col`); rows without an id stay.

    Only rows that the bitmap cannot tell apart from dropped ones are shuffled.
    """
    named = written(ids.select(F.col(id_col).cast("long").alias("id")), "filter-ids")
    dropped = named.select(F.col("id").alias(id_col))
    maybe = _among(docs, named, id_col).join(dropped, id_col, "left_anti").select(*docs.columns)
    return _among(docs, named, id_col, inside=False).unionByName(maybe)


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough."""
    texts = _among(docs, written(pairs.selectExpr("explode(array(a, b)) AS id").distinct(), "filter-ids"))
    full = pairs.join(texts.selectExpr("id AS b", "text AS text_b"), "b").join(
        texts.selectExpr("id AS a", "text AS text_a"), "a"
    )
    return full.select("a", "b", "text_a", "text_b").mapInPandas(_similar(width, percent), "a long, b long")


def _shortest(percent: int) -> Column:
    """Length of the prefix of which two similar sets share at least one token, in any order of all tokens."""
    return F.expr(f"n - cast(ceil({percent} * n / 100) AS bigint) + 1")


def _survivors(sets: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """Representatives (id, n, n_alone) that may have a similar set.

    A token of one set only matches nothing. Let such tokens come first in the order: a set with as many of
    them as its shortest prefix is long has no similar set. Here the tokens of the region are looked at.
    """
    alone = (
        sets.selectExpr("id", "explode(low) AS token")
        .groupBy("token")
        .agg(F.count("*").alias("df"), F.min("id").alias("id"))
        .where("df = 1")
        .groupBy("id")
        .agg(F.count("*").alias("n_alone"))
    )
    reps = copies.where("id = rep").select("id", "n").distinct()
    found = reps.join(alone, "id", "left").withColumn("n_alone", F.coalesce("n_alone", F.lit(0)))
    return found.where(F.col("n_alone") < _shortest(percent))


def _stars(low: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, pivot) of each set with the least edited set (fewest tokens of its own) that shares a token."""
    rows = low.select("id", "n", F.explode("low").alias("token"), F.expr("1000 * n_alone DIV n").alias("own"))
    pivots = rows.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct("own", "id", "n")).alias("p"))
    pairs = rows.join(pivots.where("df > 1").selectExpr("token", "p.id AS pivot", "p.n AS np"), "token")
    near = pairs.where(f"id <> pivot AND 100 * least(n, np) >= {percent} * greatest(n, np)")
    both = near.selectExpr("least(id, pivot) AS a", "greatest(id, pivot) AS b", "pivot")
    return both.groupBy("a", "b").agg(F.min("pivot").alias("pivot"))


def _pivot_classes(star_links: DataFrame, stars: DataFrame) -> DataFrame:
    """Rows (id, component): the pivot that a set is linked with, or that pivot's pivot.

    Sets of one class are linked with each other by way of pivots. Classes may be smaller than components;
    then pairs within a component are looked at that need not be.
    """
    links = star_links.join(stars, ["a", "b"])
    to = links.selectExpr("if(pivot = a, b, a) AS id", "pivot").groupBy("id").agg(F.min("pivot").alias("pivot"))
    to = written(to, "pivots")
    over = to.select(F.col("id").alias("pivot"), F.col("pivot").alias("next"))
    return to.join(over, "pivot", "left").select("id", F.coalesce("next", "pivot").alias("component"))


def _cross_pairs(whole: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """Pairs (a, b) of sets (id, n, class, tokens) of different classes that may be similar.

    A token that occurs in one class only matches nothing. A set needs at least percent * n others. Those
    that fall short leave, which makes more tokens unmatched, so this is done a few times over.
    The order of tokens: unmatched ones, then by frequency. `need` grows with the postings that the
    shortest prefix meets, and the prefix by as many tokens: two similar sets share at least
    least(need, need) tokens of their prefixes. Pairs whose matched tokens cannot suffice are not made. Pairs
    with a member of a large class are found by differences instead.
    """
    first = whole
    for turn in range(rounds):
        rows = whole.select("id", "n", "class", F.explode("tokens").alias("token"))
        shared = (
            rows.groupBy("token")
            .agg(F.count("*").alias("df"), F.min("class").alias("c1"), F.max("class").alias("c2"))
            .where("c1 <> c2")
            .select("token", "df")
        )
        met = written(rows.join(shared, "token"), "met")
        matched = met.groupBy("id").agg(F.count("*").alias("k"))
        kept = matched.join(whole.select("id", "n"), "id").where(f"100 * k >= {percent} * n").select("id", "k")
        met = met.join(kept, "id")
        if turn < rounds - 1:
            whole = met.groupBy("id", "n", "class").agg(F.collect_list("token").alias("tokens"))
    of_set = Window.partitionBy("id")
    base = _shortest(percent)
    rank = F.row_number().over(of_set.orderBy("df", "token"))
    placed = met.withColumn("place", F.col("n") - F.col("k") + rank)
    cost = F.sum(F.when(F.col("place") <= base, F.col("df")).otherwise(0)).over(of_set)
    most = F.least(F.lit(MOST_SHARED), F.col("n") - base + 1)
    need = F.least(most, F.lit(1) + F.floor(F.log2(F.lit(1) + cost / COST_STEP)))
    prefixes = placed.withColumn("need", need).where(F.col("place") < base + F.col("need"))
    prefixes = written(prefixes.select("id", "n", "class", "k", "need", "token"), "prefixes")
    sizes = prefixes.select("id", "class", "n").distinct().groupBy("class")
    large = sizes.agg(F.count("*").alias("members"), F.min("n").alias("n_least"), F.max("n").alias("n_most"))
    large = written(large.where(f"members >= {LARGE_CLASS}").drop("members"), "large-classes")

    small = prefixes.join(large.select("class"), "class", "left_anti")
    left = small.selectExpr("token", "id AS a", "n AS na", "k AS ka", "need AS la", "class AS ca")
    right = small.selectExpr("token", "id AS b", "n AS nb", "k AS kb", "need AS lb", "class AS cb")
    enough = F.expr(f"100 * least(ka, kb) >= {percent} * (na + nb - least(ka, kb))")
    among_small = left.join(right, (left.token == right.token) & F.expr("a < b AND ca <> cb") & enough)
    pairs = (
        among_small.groupBy("a", "b")
        .agg(F.count("*").alias("shared"), F.first(F.least("la", "lb")).alias("least"))
        .where("shared >= least")
        .select("a", "b")
    )
    with_large = _pairs_with_large(first, met.select("id", "n", "class", "token"), large, percent)
    return pairs.unionByName(with_large.selectExpr("least(a, b) AS a", "greatest(a, b) AS b")).distinct()


def _pairs_with_large(whole: DataFrame, met: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be similar, b in a large class and a outside it.

    Most members of a large class differ from its pivot by a few edits, so their tokens tell little, but their
    differences from the pivot do. With D(x) the tokens that x or the pivot has alone, x and y differ in
    |D(x)| + |D(y)| - 2 |D(x) & D(y)| tokens, and similar sets differ in few. A set that is not similar to the
    pivot therefore shares differences with every similar member, and a prefix of the differences suffices:
    tokens that the pivot lacks come first, as they are rare. Where the set is similar to the pivot, that pair
    is enough.
    """
    least, most = 100 - percent, 100 + percent  # similar: most * differences <= least * (n + n)
    in_large = met.join(large, "class").groupBy("token", "class").agg(
        F.first("n_least").alias("n_least"), F.first("n_most").alias("n_most")
    )
    seen = met.join(in_large.withColumnRenamed("class", "other"), "token").where("class <> other")
    seen = seen.groupBy("id", "other", "n_least", "n_most").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    near = seen.where(f"100 * k >= {percent} * (n + n_least - k)").select("id", "other", "n_most")
    pivots = whole.join(large.select(F.col("class").alias("id")), "id").selectExpr(
        "id AS other", "n AS np", "tokens AS pivot"
    )
    sets = whole.select("id", "n", "tokens")

    def differing(ids: DataFrame) -> DataFrame:
        own = ids.join(sets, "id").join(pivots, "other")
        alone = [F.array_sort(F.array_except("tokens", "pivot")), F.array_sort(F.array_except("pivot", "tokens"))]
        return own.withColumn("differs", F.concat(*alone)).withColumn("d", F.size("differs")).drop("tokens", "pivot")

    outside = written(differing(near), "outside")
    to_pivot = outside.where(f"{most} * d <= {least} * (n + np)").selectExpr("id AS a", "other AS b")
    outside = outside.where(f"{most} * d > {least} * (n + np)")
    kept = met.select("id", "class").distinct().join(large.select("class"), "class").where("id <> class")
    inside = differing(kept.withColumnRenamed("class", "other"))

    def prefix(rows: DataFrame, shared: str) -> DataFrame:
        """Tokens of which two sets share one if they share at least `shared` differences."""
        short = F.col("d") - F.greatest(F.lit(1), F.expr(f"cast(ceil({shared}) AS int)")) + 1
        token = F.explode(F.slice("differs", F.lit(1), F.greatest(short, F.lit(0)))).alias("token")
        return rows.select("id", "other", "n", "d", token)

    left = prefix(outside, f"(d - floor({least} * (n + n_most) / {most})) / 2")
    right = prefix(inside, f"(d + {least} * (np - n) / {most}) / 2")
    left = left.selectExpr("id AS a", "other", "token", "n AS na", "d AS da")
    right = right.selectExpr("id AS b", "other", "token", "n AS nb", "d AS db")
    possible = f"{most} * abs(da - db) <= {least} * (na + nb)"
    met_again = left.join(right, ["other", "token"]).where(possible).select("a", "b").distinct()
    return to_pivot.unionByName(met_again)


def _with_rows(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per row of `sets`, each with the class (component_id, rep_id) of its id, or as its own."""
    return sets.select("id", "n").join(classes, "id", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("rep_id", "id").alias("rep_id"),
    )


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Classes of documents whose shingle sets have a Jaccard similarity of `percent` or more.

    One row per row of `docs`: `doc_id`, `n_shingles`, `component_id` (smallest id reachable by links, itself
    included) and `rep_id` (smallest id with the same set). Links inside a class are not listed: a large group
    of near copies has too many. NULL and empty texts have no shingles and no links. Rows that share an id are
    one document; if their texts differ, it is linked by the longest one (then the greatest). A NULL id gets a
    NULL component. Other columns of `docs` are not read.

    Equal sets are one node. First the sets that share no token with others, or too few, drop out. The rest
    are compared with the least edited set of each token: a large group of near copies becomes one class by
    that, without pairs within it. Then adaptive prefixes over whole sets find the pairs of different
    classes, and these are compared as well, so no class is missed.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = written(docs.mapInPandas(_sets(width), SET_SCHEMA), "shingles")
    nodes = sets.where("id IS NOT NULL AND n > 0")
    slim = nodes.select("id", "n", "d1", "d2")
    reps = slim.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    copies = written(slim.join(reps, ["n", "d1", "d2"]).select("id", "n", "rep"), "reps")
    ambiguous = copies.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    if not ambiguous.isEmpty():
        longest = F.max_by("text", F.struct(F.length("text"), "text")).alias("text")
        classes = jaccard_join(docs.where("id IS NOT NULL").groupBy("id").agg(longest), "id", "text", width, percent)
        return _with_rows(sets, classes.selectExpr("doc_id AS id", "component_id", "rep_id"))
    survivors = written(_survivors(nodes, copies, percent), "survivors")
    low = _among(nodes.select("id", "low"), survivors.select("id"))
    low = written(low.dropDuplicates(["id"]).join(survivors, "id"), "low")

    stars = written(_stars(low, percent), "stars")
    star_links = written(_verified(docs, stars.select("a", "b"), width, percent), "star-links")
    classes = _pivot_classes(star_links, stars)

    in_class = low.join(classes, "id", "left").withColumn("class", F.coalesce("component", "id"))
    rows = in_class.select("id", "class", F.explode("low").alias("token"))
    tokens_of = rows.groupBy("token").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).where("c1 <> c2")
    mixed = rows.join(tokens_of, "token").select("id").distinct()
    short = in_class.where(F.size("low") < _shortest(percent)).select("id")
    unsure = mixed.unionByName(short).distinct()
    # Pivots of classes with such members are needed too: other members are told by their differences from them.
    pivots = unsure.join(classes, "id").select(F.col("component").alias("id"))
    open_ids = written(unsure.unionByName(pivots).distinct(), "open")
    whole = _among(docs, open_ids).mapInPandas(_whole_sets(width), "id long, tokens array<long>")
    whole = whole.dropDuplicates(["id"]).join(open_ids, "id").join(in_class.select("id", "n", "class"), "id")
    cross = _cross_pairs(written(whole, "whole"), percent).join(stars, ["a", "b"], "left_anti")
    cross_links = written(_verified(docs, written(cross, "cross"), width, percent), "cross-links")

    # Links are between representatives, the smallest ids of their copies, so the copies follow them.
    found = components(star_links.unionByName(cross_links), "all").withColumnRenamed("id", "rep_id")
    info = copies.groupBy("id").agg(F.min("rep").alias("rep_id")).join(found, "rep_id", "left")
    return _with_rows(sets, info.withColumn("component_id", F.coalesce("component", "rep_id")))
