"""Closure, expansion and counts of the category tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.session import cut_lineage


def closure(categories: DataFrame, deepest: int = 100) -> DataFrame:
    """(ancestor_id, descendant_id, depth) of every node with itself and all nodes above it, at any depth.

    A step is made for each level until none is left; a tree of more than ``deepest`` levels is taken for a cycle.
    """
    up = categories.where(F.col("parent_id").isNotNull()).select(F.col("category_id").alias("node"), "parent_id")
    reach = categories.select(F.col("category_id").alias("ancestor_id"), F.col("category_id").alias("descendant_id"), F.lit(0).alias("depth"))
    result = reach
    for depth in range(1, deepest + 1):
        reach = reach.join(up, F.col("ancestor_id") == F.col("node")).select(
            F.col("parent_id").alias("ancestor_id"), "descendant_id", F.lit(depth).alias("depth")
        )
        if reach.isEmpty():
            return result
        result = result.unionByName(reach)
    raise ValueError(f"the category tree has a cycle or more than {deepest} levels")


def expansion(categories: DataFrame) -> DataFrame:
    """(category_id, member_id): what a chosen category stands for when pricing.

    Level 1 stands for everything below it, level 2 for itself and its children, level 3 for itself.
    """
    level = categories.select(F.col("category_id").alias("ancestor_id"), "level")
    pairs = closure(categories).join(level, "ancestor_id")
    childless = (F.col("level") == 1) & (F.col("depth") == 0)
    return pairs.where(~childless).select(F.col("ancestor_id").alias("category_id"), F.col("descendant_id").alias("member_id"))


def with_ancestors(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows with a category_id gain its name and level and the names of parent and grandparent."""
    node = categories.select("category_id", "name", "level", "parent_id")
    parent = categories.select(F.col("category_id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("parent_id").alias("grandparent_id"))
    grand = categories.select(F.col("category_id").alias("grandparent_id"), F.col("name").alias("grandparent_name"))
    return rows.join(node, "category_id").join(parent, "parent_id", "left").join(grand, "grandparent_id", "left")


def siblings(categories: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """Nodes with the same parent and level, largest first; third-level nodes also get their parent if it has products."""
    from pyspark.sql import Window as W

    node = categories.where("level > 1 AND parent_id IS NOT NULL").select("category_id", "parent_id", "level")
    other = node.select(F.col("category_id").alias("sibling_id"), "parent_id", "level").join(
        counts.withColumnRenamed("category_id", "sibling_id"), "sibling_id", "left"
    ).withColumn("n", F.coalesce("n", F.lit(0)))
    # only the largest of a parent can become siblings, so the pairs stay small for a parent of any size
    top = other.withColumn("rn", F.row_number().over(W.partitionBy("parent_id", "level").orderBy(F.desc("n"), "sibling_id"))).where(F.col("rn") <= limit + 1)
    same = node.join(top.drop("rn"), ["parent_id", "level"]).where(F.col("category_id") != F.col("sibling_id")).select("category_id", "sibling_id", "n")
    above = node.where("level = 3").join(counts.where("n > 0").withColumnRenamed("category_id", "parent_id"), "parent_id").select(
        "category_id", F.col("parent_id").alias("sibling_id"), "n"
    )
    w = W.partitionBy("category_id").orderBy(F.desc("n"), "sibling_id")
    return same.unionByName(above).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def local_siblings(requests: DataFrame, categories: DataFrame, counts: DataFrame, local: DataFrame, limit: int) -> DataFrame:
    """The requests (leader, category_id, further columns) with (sibling_id, n): siblings with offers around the place, most offers first.

    ``counts`` (category_id, n) are those of all products, which decide whether the parent is shown; ``local`` (leader, category_id, n).
    A group of siblings around a leader is one row with its largest members, which a request cuts its own from; rows of
    (request, sibling) come out of the last step and are never shuffled.
    """
    from pyspark.sql import Window as W

    node = categories.where("level > 1 AND parent_id IS NOT NULL").select("category_id", "parent_id", "level")
    shown = counts.where("n > 0").select(F.col("category_id").alias("parent_id"))
    above = node.where("level = 3").select("parent_id", "level").distinct().join(shown, "parent_id", "left_semi")
    # what a category is in a group: one of its members, or the parent that is shown beside them
    roles = node.withColumn("own", F.lit(0)).unionByName(above.select(F.col("parent_id").alias("category_id"), "parent_id", "level", F.lit(1).alias("own")))
    group = ["leader", "parent_id", "level"]
    near = local.where("n > 0").withColumnRenamed("category_id", "sibling_id").join(roles.withColumnRenamed("category_id", "sibling_id"), "sibling_id")
    place = F.row_number().over(W.partitionBy(*group, "own").orderBy(F.desc("n"), "sibling_id"))
    entry = F.struct((-F.col("n")).alias("m"), "sibling_id")
    lists = near.withColumn("rn", place).where(F.col("rn") <= limit + 1).groupBy(*group).agg(
        F.collect_list(F.when(F.col("own") == 0, entry)).alias("members"), F.collect_list(F.when(F.col("own") == 1, entry)).alias("above")
    )
    lists = cut_lineage(lists)

    def met(rows: DataFrame) -> DataFrame:
        joined = rows.join(node, "category_id").join(lists, group)
        others = F.concat(F.filter("members", lambda s: s["sibling_id"] != F.col("category_id")), "above")
        return joined.select(*rows.columns, others.alias("others"))

    def shown_of(rows: DataFrame) -> DataFrame:
        first = F.explode(F.slice(F.array_sort("others"), 1, limit)).alias("s")
        return rows.select(*requests.columns, first).select(*requests.columns, "s.sibling_id", (-F.col("s.m")).alias("n"))

    several = cut_lineage(node.groupBy("category_id").count().where("count > 1").select("category_id"))
    if several.isEmpty():
        return shown_of(met(requests))
    # an id that stands at several places of the tree has the siblings of all of them
    keys = ["leader", "category_id"]
    merged = met(requests.join(several, "category_id", "left_semi").select(*keys).distinct()).groupBy(*keys).agg(F.flatten(F.collect_list("others")).alias("others"))
    alone = met(requests.join(several, "category_id", "left_anti"))
    return shown_of(alone).unionByName(shown_of(requests.join(merged, keys)))


def alternative_offers(categories: DataFrame, offers: DataFrame, per_category: int, groups: int) -> DataFrame:
    """Cheapest offers of the siblings (third level) or children (second level) of every category."""
    from pyspark.sql import Window as W

    w = W.partitionBy("other_id").orderBy(F.col("sales_price").asc_nulls_last(), "offer_id")
    cheap = offers.select(F.col("category_id").alias("other_id"), "offer_id", "sales_price").withColumn("rn", F.row_number().over(w))
    cheap = cheap.where(F.col("rn") <= per_category)
    sizes = cheap.groupBy("other_id").agg(F.count(F.lit(1)).alias("n"))
    leaf = categories.where("level = 3 AND parent_id IS NOT NULL").select(F.col("category_id").alias("other_id"), "parent_id").join(sizes, "other_id")
    # per parent only the first groups + 1 can be shown for any of its children
    best = leaf.withColumn("gr", F.row_number().over(W.partitionBy("parent_id").orderBy(F.desc("n"), "other_id"))).where(F.col("gr") <= groups + 1).drop("gr")
    for_leaf = categories.where("level = 3").select("category_id", "parent_id").join(best, "parent_id").where(F.col("category_id") != F.col("other_id"))
    for_group = categories.where("level = 2").select("category_id", F.col("category_id").alias("parent_id")).join(best, "parent_id")
    shown = for_leaf.select("category_id", "other_id", "n").unionByName(for_group.select("category_id", "other_id", "n"))
    shown = shown.withColumn("gr", F.row_number().over(W.partitionBy("category_id").orderBy(F.desc("n"), "other_id"))).where(F.col("gr") <= groups)
    return shown.join(cheap, "other_id").select("category_id", "other_id", "offer_id")


def tiles(categories: DataFrame, offers: DataFrame, limit: int) -> DataFrame:
    """Top-level categories by distinct priced offers below them."""
    roots = categories.where("level = 1").select(F.col("category_id").alias("ancestor_id"))
    per = offers.where(F.col("sales_price").isNotNull()).groupBy(F.col("category_id").alias("descendant_id")).agg(F.count(F.lit(1)).alias("n"))
    below = closure(categories).where("depth > 0").join(roots, "ancestor_id").join(per, "descendant_id")
    return below.groupBy(F.col("ancestor_id").alias("category_id")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "category_id").limit(limit)


def drop_containing_names(names: DataFrame) -> DataFrame:
    """Names that do not strictly contain another name of the list."""
    from offerloom.operators.scoring import containing_words

    low = names.select("name", F.lower("name").alias("word"))
    needles = low.select(F.col("word").alias("needle")).distinct()
    longer = containing_words(needles, low.select("word").distinct()).where(F.length("word") > F.length("needle")).select("word").distinct()
    return low.join(longer, "word", "left_anti").select("name")


class OfferPages:
    """Pages of the offers of every category subtree, cheapest first, where any page costs the same.

    Offers are dealt into blocks of neighbouring (price, id); counts per leaf and block, added up the
    tree, tell which blocks hold a page. Only their offers are ranked, so that neither a window over
    a subtree nor the rows before the page are needed.
    """

    def __init__(self, categories: DataFrame, offers: DataFrame) -> None:
        priced = offers.where(F.col("sales_price").isNotNull() & F.col("category_id").isNotNull()).select("category_id", "sales_price", "offer_id")
        self.categories = categories
        self.tree = cut_lineage(closure(categories).select("ancestor_id", "descendant_id"))
        self.rows = cut_lineage(priced.repartitionByRange("sales_price", "offer_id").withColumn("block", F.spark_partition_id()))
        per_leaf = self.rows.groupBy(F.col("category_id").alias("descendant_id"), "block").agg(F.count(F.lit(1)).alias("n"))
        self.counts = cut_lineage(self.tree.join(per_leaf, "descendant_id").groupBy(F.col("ancestor_id").alias("category_id"), "block").agg(F.sum("n").alias("n")))

    def totals(self) -> DataFrame:
        """(category_id, total) of the categories with offers below them."""
        return self.counts.groupBy("category_id").agg(F.sum("n").alias("total"))

    def page(self, offset: int, limit: int) -> DataFrame:
        """(category_id, sales_price, offer_id, rn) of the offers ``offset`` + 1 to ``offset`` + ``limit``."""
        from pyspark.sql import Window as W

        before = F.sum("n").over(W.partitionBy("category_id").orderBy("block")) - F.col("n")
        blocks = self.counts.withColumn("before", before).where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        leaves = blocks.select(F.col("category_id").alias("ancestor_id"), "block", "before").join(self.tree, "ancestor_id")
        held = self.rows.withColumnRenamed("category_id", "descendant_id").join(leaves, ["descendant_id", "block"])
        place = F.row_number().over(W.partitionBy("ancestor_id", "block").orderBy("sales_price", "offer_id"))
        ranked = held.withColumn("rn", F.col("before") + place).where((F.col("rn") > offset) & (F.col("rn") <= offset + limit))
        return ranked.select(F.col("ancestor_id").alias("category_id"), "sales_price", "offer_id", "rn")

    def heads(self, offset: int, limit: int) -> DataFrame:
        """(category_id, total, has_more, subcategories): what stands above a page; sub-categories by name, with their totals."""
        totals = self.totals()
        child = self.categories.where("parent_id IS NOT NULL").join(totals, "category_id").select(F.col("parent_id").alias("category_id"), F.struct("name", "total").alias("c"))
        below = child.groupBy("category_id").agg(F.array_sort(F.collect_list("c")).alias("below"))
        named = F.array_join(F.transform("below", lambda c: F.concat(c["name"], F.lit(":"), c["total"].cast("string"))), "|")
        return totals.join(below, "category_id", "left").select(
            "category_id", "total", (F.lit(offset + limit) < F.col("total")).cast("int").alias("has_more"), F.coalesce(named, F.lit("")).alias("subcategories")
        )


def count_check(categories: DataFrame, counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Second-level counts next to what direct labels and children add up to."""
    direct = labels.groupBy("category_id").agg(F.count(F.lit(1)).alias("direct"))
    child = categories.where("level = 3").select("category_id", "parent_id").join(counts, "category_id")
    child = child.groupBy(F.col("parent_id").alias("category_id")).agg(F.sum("n").alias("below"))
    group = categories.where("level = 2").select("category_id").join(counts.withColumnRenamed("n", "counted"), "category_id")
    return group.join(direct, "category_id", "left").join(child, "category_id", "left").select(
        "category_id", "counted", (F.coalesce("direct", F.lit(0)) + F.coalesce("below", F.lit(0))).alias("expected")
    )


def group_check(categories: DataFrame, counts: DataFrame) -> DataFrame:
    """(parent_id, category_id, parent_n, n, ok): a group has at least the products of each child."""
    child = categories.where("parent_id IS NOT NULL").select("category_id", "parent_id").join(counts, "category_id")
    return child.join(counts.select(F.col("category_id").alias("parent_id"), F.col("n").alias("parent_n")), "parent_id").select(
        "parent_id", "category_id", "parent_n", "n", (F.col("parent_n") >= F.col("n")).cast("int").alias("ok")
    )


def local_check(local: DataFrame, counts: DataFrame, factor: float = 1.5, slack: int = 5) -> DataFrame:
    """(location_id, category_id, local_n, global_n, ok): offers around a place do not exceed the products by more than factor and slack."""
    return local.join(counts, "category_id").select(
        "location_id", "category_id", F.col("offers").alias("local_n"), F.col("n").alias("global_n"), (F.col("offers") <= F.floor(F.col("n") * factor) + slack).cast("int").alias("ok")
    )


def orphans(categories: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes below level 1 without a parent one level up."""
    up = parents.select(F.col("category_id").alias("parent_id"), (F.col("level") + 1).alias("level"))
    return categories.where("level > 1").join(up, ["parent_id", "level"], "left_anti").select("category_id", "level")
