"""One-to-one join by stable marriage.

Both sides rank by one symmetric distance, ties by key, so there is one stable match, the greedy one by (distance, woman,
man). Lists of the nearest free partners are made for both sides, equal vectors (a team) sharing one. The r-th of a team
and its partner are matched if each stands r-th in the other's list and the team's members before do so likewise:
for r = 1 these are pairs nearest to each other, and a whole run of a team is matched at once. The matched leave the
lists; when a round finds no pair, all that are still free are searched again with lists twice as long, until one
side is used up. Distances are compared to 12 digits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.operators.knn import BLOCK, search
from vectide.sources.folder import forget, written


def _kept(df: DataFrame) -> DataFrame:
    return written(df, "match")


def _side(rows: DataFrame) -> DataFrame:
    team = F.concat_ws("-", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector"))
    return _kept(rows.filter("vector IS NOT NULL").select(F.col("key").cast("long").alias("key"), "vector", team.alias("team")))


def _lists(own: DataFrame, others: DataFrame, k: int, kind: str) -> DataFrame:
    """(own, other, key, d): for each team of own its k nearest rows of others, and their team."""
    teams = own.groupBy("team").agg(F.min("key").alias("query_id"), F.first("vector").alias("vector"))
    near = search(teams, others, k, kind, block=max(1, BLOCK * 256 // max(k, 256))).select("query_id", "key", F.round("distance", 12).alias("d"), "distance")
    return near.join(teams.select("query_id", F.col("team").alias("own")), "query_id").join(others.select("key", F.col("team").alias("other")), "key").select("own", "other", "key", "d", "distance")


def _nth(df: DataFrame, name: str, by: str, *order: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def _pairs(his: DataFrame, hers: DataFrame, men: DataFrame, k: int) -> DataFrame:
    """(man, woman, distance) that the rule above matches; his (own, other, key, ...) and hers are lists of the free."""
    front = _nth(men.select("team", "key"), "at_m", "team", "key").filter(F.col("at_m") <= k).select(F.col("key").alias("man"), "at_m")
    # all free women of a team before a listed one are listed too
    seen = _nth(his.select(F.col("other").alias("w"), F.col("key").alias("woman")).distinct(), "at_w", "w", "woman").select("woman", "at_w")
    a = _nth(his, "r", "own", "d", "key").select(F.col("own").alias("m"), F.col("other").alias("w"), F.col("key").alias("woman"), "r", "distance").join(seen, "woman")
    b = _nth(hers, "r", "own", "d", "key").select(F.col("own").alias("w"), F.col("other").alias("m"), F.col("key").alias("man"), "r").join(front, "man", "left")
    both = a.join(b, ["m", "w", "r"])
    runs = [_nth(both.filter(f"{at} = r"), "n", team, "r").filter("n = r").select("man", "woman", "distance") for at, team in (("at_m", "m"), ("at_w", "w"))]
    return runs[0].unionByName(runs[1]).dropDuplicates(["man", "woman"])


def stable_match(men: DataFrame, women: DataFrame, kind: str = "cos", proposals: int | None = None) -> DataFrame:
    """(left_key, right_key, distance) from (key, vector) tables; all of the smaller side are matched.

    proposals: the length of the first lists; the result doesn't depend on it."""
    men, women, matched = _side(men), _side(women), None
    while True:
        m, n = men.count(), women.count()
        if not m or not n:
            none = men.sparkSession.createDataFrame([], "man long, woman long, distance double")
            forget(men, women)
            return (matched if matched is not None else none).select(F.col("man").alias("left_key"), F.col("woman").alias("right_key"), "distance")
        proposals = max(1, min(max(m, n), proposals or math.ceil(math.log(max(n, 2))) + 4))
        his = _kept(_lists(men, women, proposals, kind))
        hers = _kept(_lists(women.join(his.select("key").distinct(), "key", "left_semi"), men, proposals, kind))
        fresh = True
        while True:
            both = _kept(_pairs(his, hers, men, proposals))
            if both.isEmpty():
                if not fresh:
                    break
                # only if a distance differs by the direction it was computed in: the least pair by itself
                first = men.groupBy(F.col("team").alias("own")).agg(F.min("key").alias("man"))
                both = _kept(his.join(first, "own").orderBy("d", "key", "man").limit(1).select("man", F.col("key").alias("woman"), "distance"))
            fresh = False
            matched = both if matched is None else matched.unionByName(both)
            gone_m, gone_w = both.select(F.col("man").alias("key")), both.select(F.col("woman").alias("key"))
            before = men, his, women, hers
            men, his = _kept(men.join(gone_m, "key", "left_anti")), _kept(his.join(gone_w, "key", "left_anti"))
            women, hers = _kept(women.join(gone_w, "key", "left_anti")), _kept(hers.join(gone_m, "key", "left_anti"))
            forget(*before)
        forget(his, hers)
        proposals *= 2
