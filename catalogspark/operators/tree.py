"""The navigation tree: walk, search, cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, written


def walk_down(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every node reached from the seed rows: id, title, parent_id, path, title_path, depth.

    One equi-join per level; each level is checkpointed, so no level is computed twice and the plan
    stays flat however deep the tree is.  A node already on its own path (a cycle) ends the walk.
    """
    edges = nodes.select("id", "title", "parent_id")
    level = seeds.select(
        "id", "title", "parent_id", F.array("id").alias("path"), F.array("title").alias("title_path"),
        F.lit(0).alias("depth"))
    levels = []
    while True:
        level = cut_lineage(level)
        if level.isEmpty():
            break
        levels.append(level)
        above = level.select(F.col("id").alias("parent_id"), "path", "title_path", "depth")
        level = (edges.join(above, "parent_id").filter(~F.array_contains("path", F.col("id")))
                 .select("id", "title", "parent_id",
                         F.concat("path", F.array("id")).alias("path"),
                         F.concat("title_path", F.array("title")).alias("title_path"),
                         (F.col("depth") + 1).alias("depth")))
    return reduce(DataFrame.unionByName, levels) if levels else level


def hierarchy(navigation: DataFrame) -> DataFrame:
    """The tree below the roots.  Rows with a missing parent and cycles are not part of it."""
    return walk_down(navigation, navigation.filter(F.col("parent_id").isNull()))


def in_display_order(tree: DataFrame, collation: str | None = None) -> DataFrame:
    """Each node before its children, siblings by title; a collation such as UNICODE sorts as people do."""
    titles = F.col("title_path") if collation is None else F.transform("title_path", lambda t: F.collate(t, collation))
    return tree.orderBy(titles, "path")


def display_positions(tree: DataFrame, collation: str | None = None) -> DataFrame:
    """id, position: the place of each node in display order, from 1.

    A global sort numbers its partitions in order.  A node's place is that within its partition after the nodes of all
    partitions before; only the counts, one row per partition, are put in order together.
    """
    placed = F.monotonically_increasing_id()  # the partition's number above 33 bits of the place in it
    ordered = written(in_display_order(tree, collation).select("id", placed.alias("_at")), "ordered").select(
        "id", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    before = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_of"), F.expr(
        "coalesce(sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_before"))
    return ordered.join(before, F.col("_part") == F.col("_of")).select(
        "id", (F.col("_before") + F.col("_place") + 1).cast("long").alias("position"))


def search_tree(tree: DataFrame, term: str) -> DataFrame:
    """Nodes that match or lead to a match; a match without matches below keeps its whole subtree."""
    matches = tree.filter(F.lower("title").contains(term.lower())).select("id", "path")
    above = matches.select(F.explode("path").alias("id")).distinct()
    inner = matches.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("id")).distinct()
    deepest = matches.select("id").join(inner, "id", "left_anti")
    below = (tree.select("id", F.explode("path").alias("ancestor"))
             .join(deepest.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id"))
    return tree.join(above.unionByName(below).distinct(), "id", "left_semi")


def cascade_delete(navigation: DataFrame, categories: DataFrame, products: DataFrame, doomed: DataFrame
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete navigation rows (ids in `doomed`), all rows below them, and their categories; products
    of a deleted category stay, without category."""
    seeds = navigation.join(doomed.select("id"), "id", "left_semi")
    gone = walk_down(navigation, seeds).select("id").distinct()
    kept_navigation = navigation.join(gone, "id", "left_anti")
    gone_nav = gone.withColumnRenamed("id", "navigation_id")
    kept_categories = categories.join(gone_nav, "navigation_id", "left_anti")
    lost = (categories.join(gone_nav, "navigation_id", "left_semi")
            .select(F.col("id").alias("category_id"), F.lit(True).alias("_lost")))
    kept_products = (products.join(lost, "category_id", "left")
                     .withColumn("category_id", F.when(F.col("_lost").isNull(), F.col("category_id"))).drop("_lost"))
    return kept_navigation, kept_categories, kept_products
