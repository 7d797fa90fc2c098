"""Greedy first claims on two keys.

Rows come in an order and each wants two keys.  A row is accepted when no earlier accepted row holds
either key; otherwise it is turned away.  (A turned-away row holds nothing, so the first row of a key
is not always the one accepted.)

Rows whose keys nobody else wants are left out first, by hashes of the keys, so only the others are
shuffled whole. Rows that want the same pair of keys are reduced to the first of them before any shuffle: the others
can never be accepted.  Pairs whose keys nobody else wants are accepted at once.  The rest, the
contested pairs, depend on each other: a pair is accepted exactly if all *earlier* pairs that share
a key with it are turned away.

They are settled in rounds, each stored in the shared folder.  A round accepts the front, the pairs
that are first for both keys, and drops all that share a key with an accepted pair.  From the second
round on it also follows chains: an undecided pair with one undecided earlier neighbour is the
opposite of that neighbour, so along a run of such pairs acceptance alternates.  Pointers to the
neighbour, with the parity of the way, are doubled until they reach the head of the chain; where the
head is in the front, the whole chain is decided.  A chain of any length takes a logarithmic number
of steps; only pairs with several undecided earlier neighbours wait for the front.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from emberline.session import cut_lineage

def _first_in_both(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose first row is the first of both keys.

    Joined on key and position together, so that a key wanted by very many pairs is not one group.
    """
    leading = pairs
    for key in (a, b):
        leaders = pairs.groupBy(key).agg(F.min("first").alias("first"))
        leading = leading.join(leaders, [key, "first"], "left_semi")
    return leading


def _without(pairs: DataFrame, taken: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.join(taken.select(a), a, "left_anti").join(taken.select(b), b, "left_anti")


def _chained(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """first, up, odd: the pairs with exactly one earlier neighbour, that neighbour, and that they are opposites.

    Such a pair is the second of one key and the first of the other. Of a key only its first two
    pairs are looked at; the rank filter is a group limit, so each task sends on two rows of a key.
    """
    places = []
    for key in (a, b):
        rank = F.row_number().over(Window.partitionBy(key).orderBy("first"))
        two = pairs.select(key, "first").withColumn("_rank", rank).where("_rank <= 2").groupBy(key).agg(
            F.min("first").alias("_low"), F.max("first").alias("_next"), F.count("*").alias("_n"))
        places.append(two.where("_n = 2").select(F.col("_next").alias("first"), F.col("_low").alias("up")))
    second_a, second_b = places
    leads_b = pairs.groupBy(b).agg(F.min("first").alias("first")).select("first")
    leads_a = pairs.groupBy(a).agg(F.min("first").alias("first")).select("first")
    links = second_a.join(leads_b, "first", "left_semi").unionByName(second_b.join(leads_a, "first", "left_semi"))
    return links.withColumn("odd", F.lit(True))


def _heads(links: DataFrame) -> DataFrame:
    """first, up, odd: where each chain of links ends, and the parity of the way, by pointer doubling."""
    chains = cut_lineage(links.withColumn("moved", F.lit(True)))
    while not chains.where("moved").isEmpty():
        above = chains.select(F.col("first").alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"))
        chains = cut_lineage(chains.join(above, "up", "left").select(
            "first", F.coalesce("_up", "up").alias("up"),
            (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"), F.col("_up").isNotNull().alias("moved")))
    return chains


def _settle(contested: DataFrame, a: str, b: str) -> DataFrame:
    """The accepted pairs of the contested ones (a stored table)."""
    accepted = []
    undecided = contested
    while not undecided.isEmpty():
        winners = _first_in_both(undecided, a, b)
        if accepted:
            # Beyond the first round, chains that hang on an accepted pair are decided along their whole length.
            heads = _heads(_chained(undecided, a, b))
            even = heads.where("NOT odd").join(winners.select(F.col("first").alias("up")), "up", "left_semi").select("first")
            winners = winners.unionByName(undecided.join(even, "first", "left_semi"))
        winners = cut_lineage(winners)
        accepted.append(winners)
        undecided = cut_lineage(undecided.join(winners.select(a), a, "left_anti").join(winners.select(b), b, "left_anti"))
    return reduce(DataFrame.unionByName, accepted) if accepted else undecided


def _in_company(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The rows one of whose keys another row has as well (and a few more, where hashes are equal), stored."""
    hashed = rows.withColumns({"_hash_a": F.xxhash64(a), "_hash_b": F.xxhash64(b)})
    hashes = hashed.select("_hash_a", "_hash_b")

    def met_twice(name: str) -> DataFrame:
        twice = hashes.groupBy(name).agg(F.count("*").alias("_rows")).where("_rows > 1").select(name)
        return hashes.join(twice, name, "left_semi").select("_hash_a", "_hash_b")

    some = met_twice("_hash_a").unionByName(met_twice("_hash_b")).distinct()
    return cut_lineage(hashed.join(some, ["_hash_a", "_hash_b"], "left_semi").drop("_hash_a", "_hash_b"))


def turned_away(rows: DataFrame, a: str, b: str, first: tuple[str, ...]) -> DataFrame:
    """The rows that are not accepted, with ``holder_a`` and ``holder_b``.

    A holder is the accepted row of that key if it comes earlier than this row, else null; it is a
    struct of the columns named in ``first``, which begin with the order columns.  Every row is
    either returned here or accepted.
    """
    rows = _in_company(rows, a, b)
    here = F.struct(*first)
    # Mentioned three times below, shuffled once: Spark reuses the exchange within the one query.
    pairs = rows.groupBy(a, b).agg(F.min(here).alias("first"), F.count("*").alias("rows"))

    def wanted_twice(key: str) -> DataFrame:
        return pairs.groupBy(key).agg(F.count("*").alias("_pairs")).where("_pairs > 1").select(key)

    shared_a, shared_b = wanted_twice(a), wanted_twice(b)
    flagged = (
        pairs.join(shared_a.withColumn("_shared_a", F.lit(True)), a, "left")
        .join(shared_b.withColumn("_shared_b", F.lit(True)), b, "left")
    )
    contested = F.col("_shared_a").isNotNull() | F.col("_shared_b").isNotNull()
    # Pairs of a single row whose keys nobody else wants need no further look.
    in_question = cut_lineage(flagged.where(contested | (F.col("rows") > 1)).select(
        a, b, "first", contested.alias("contested")))
    accepted = in_question.where("NOT contested").drop("contested").unionByName(
        _settle(in_question.where("contested").drop("contested"), a, b))

    def holder(key: str, name: str) -> DataFrame:
        return accepted.select(key, F.col("first").alias(name))

    judged = (
        rows.join(in_question.select(a, b), [a, b], "left_semi")
        .join(holder(a, "holder_a"), a, "left")
        .join(holder(b, "holder_b"), b, "left")
        .withColumn("_here", here)
    )
    is_holder = F.col("_here").eqNullSafe(F.col("holder_a"))
    return judged.where(~is_holder).withColumns({
        name: F.when(F.col(name) < F.col("_here"), F.col(name)) for name in ("holder_a", "holder_b")
    }).drop("_here")
