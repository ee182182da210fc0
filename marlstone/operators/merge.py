"""Merging pages into others: accepted pairs to one last target each, and links that follow.

Pairs name a page and the page it goes into, which may itself go into a third one. Chains are followed to their end by doubling: each
round every page looks up where the page that it points to points, so the rounds grow with the logarithm of the longest chain.
Pages that point at each other in a circle all go into the least of the circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.workspace import materialize


def redirects(pairs: DataFrame) -> DataFrame:
    """(source, target): for each page that goes into another the last page of its chain.

    pairs is (source, target, score). Of several targets of a source the one with the best score counts, then the least; a
    page is never its own source, and the least page of a circle stays.
    """
    clean = pairs.where("source <> target AND source IS NOT NULL AND target IS NOT NULL")
    best = clean.groupBy("source", "target").agg(F.max("score").alias("score")).groupBy("source").agg(F.min_by("target", F.struct(-F.col("score"), "target")).alias("at"))
    # at: where the walk has come; least: the least page on the way, the start included and the end not
    walk = materialize(best.select("source", "at", F.col("source").alias("least")), "merge-walk")
    sources, steps = walk.count(), 1
    while steps <= sources:
        ahead = walk.select(F.col("source").alias("at"), F.col("at").alias("on"), F.col("least").alias("met"))
        moved = walk.join(ahead, "at", "left").select("source", F.coalesce("on", "at").alias("at"), F.least("least", "met").alias("least"), F.col("on").isNotNull().alias("went"))
        moved = materialize(moved, "merge-walk")
        walk, steps = moved.select("source", "at", "least"), 2 * steps
        if moved.where("went").isEmpty():
            break
    # who still stands on a source after as many steps as there are sources is in a circle, whose least page the walk has met
    circle = walk.select(F.col("source").alias("at"), F.col("least").alias("stays"))
    out = walk.join(circle, "at", "left").select("source", F.coalesce("stays", "at").alias("target"))
    return out.where("source <> target")


def redirect_links(links: DataFrame, moved: DataFrame) -> DataFrame:
    """(src, dst) with both ends where they went, each once, none of a page to itself; moved is (source, target)."""
    to = lambda c: moved.select(F.col("source").alias(c), F.col("target").alias(f"{c}_now"))
    out = links.join(to("src"), "src", "left").join(to("dst"), "dst", "left")
    return out.select(F.coalesce("src_now", "src").alias("src"), F.coalesce("dst_now", "dst").alias("dst")).where("src <> dst").distinct()
