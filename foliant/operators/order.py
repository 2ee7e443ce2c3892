"""The hierarchy as numbers: two for each record turn "stands under" into a comparison.

pre is the place of a record when parents come before their children and children follow in reading order; last is the place of the last record
under it. So x stands under y if y.pre < x.pre <= y.last. Records whose way up ends in a cycle have no numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import ranked, stored
from .search import _links, ancestry, roots

#: Levels up to which records are sorted by their whole paths.
PATHS = 64


def order_labels(records: DataFrame) -> DataFrame:
    """(id, pre, last) of all records.

    Shallow hierarchies are sorted by the paths from the root, which hold as much as the closure does. Deep ones are walked round: each record is
    entered and left once, and doubling pointers along that tour give the places, in as many rounds as the logarithm of the size of the largest tree.
    """
    depths = stored(roots(records).filter("depth IS NOT NULL"), "depths")
    deepest = depths.agg(F.max("depth")).first()[0]
    rows = records.select("id", "seq").join(depths.select("id"), "id", "left_semi")
    return by_paths(records, rows) if deepest is None or deepest <= PATHS else by_tour(records, rows)


def by_paths(records: DataFrame, rows: DataFrame) -> DataFrame:
    above = stored(ancestry(records, ids=rows.select("id")), "above")
    step = F.struct("distance", "seq", "ancestor_id")
    paths = above.join(rows.select(F.col("id").alias("ancestor_id"), "seq"), "ancestor_id").groupBy("id").agg(F.sort_array(F.collect_list(step), asc=False).alias("up"))
    none = F.array().cast("array<struct<seq:bigint,id:string>>")
    up = F.transform("up", lambda x: F.struct(x["seq"].alias("seq"), x["ancestor_id"].alias("id")))
    path = F.array_append(F.coalesce(up, none), F.struct(F.col("seq").cast("bigint").alias("seq"), "id"))
    placed = ranked(rows.join(paths, "id", "left").select("id", path.alias("path")), "path", name="pre", kind="long").select("id", "pre")
    under = above.groupBy(F.col("ancestor_id").alias("id")).agg(F.count("*").alias("n"))
    return placed.join(under, "id", "left").select("id", "pre", (F.col("pre") + F.coalesce("n", F.lit(0))).alias("last"))


def by_tour(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Entering a record leads to its first child, or out of it; leaving it, to its next sibling or out of its parent. Ranges of one sort tell siblings, so no parent's children meet in one task."""
    ups = rows.join(_links(records), "id", "left").select("id", "seq", F.coalesce("up", F.lit("")).alias("up"))
    lined = ranked(ups, "up", "seq", "id", name="n", kind="long").select("id", "seq", "up", "n")
    after = lined.select((F.col("n") - 1).alias("n"), F.col("id").alias("sibling"), F.col("up").alias("its"))
    first = lined.filter("up <> ''").groupBy(F.col("up").alias("id")).agg(F.min_by("id", "n").alias("child"))
    whole = lined.join(after, "n", "left").join(first, "id", "left")
    enter, leave = (lambda x: F.concat(F.lit("<"), x)), (lambda x: F.concat(F.lit(">"), x))
    onward = F.when(F.col("its") == F.col("up"), enter(F.col("sibling"))).when(F.col("up") != "", leave(F.col("up"))).otherwise("")
    steps = whole.select(enter(F.col("id")).alias("id"), F.when(F.col("child").isNotNull(), enter(F.col("child"))).otherwise(leave(F.col("id"))).alias("parent_id"))
    tour = stored(steps.unionByName(whole.select(leave(F.col("id")).alias("id"), onward.alias("parent_id"))), "tour")
    left = roots(tour).select(F.substring("id", 2, 1 << 30).alias("id"), (F.substring("id", 1, 1) == "<").alias("enters"), "depth")
    both = left.groupBy("id").agg(F.max(F.when(F.col("enters"), F.col("depth"))).alias("a"), F.max(F.when(~F.col("enters"), F.col("depth"))).alias("b"))
    # the tour within a record takes two steps for each record under it
    placed = ranked(both, F.desc("a"), name="pre", kind="long")
    return placed.select("id", "pre", (F.col("pre") + F.expr("(a - b - 1) div 2")).alias("last"))


def under(labels: DataFrame, ident: str) -> DataFrame:
    """The numbers of the records under one: a range, which files sorted by pre are read by."""
    here = labels.filter(F.col("id") == ident).select("pre", "last").first()
    return labels.filter((F.col("pre") > here["pre"]) & (F.col("pre") <= here["last"])) if here else labels.limit(0)


def preceding(rows: DataFrame, at: str, count: str) -> DataFrame:
    """(at, upto): the sum of a count over all rows up to each place. Places are sorted by ranges; what is carried over is one sum a range."""
    part = "__order_part"
    lined = stored(rows.select(at, count).repartitionByRange(at).sortWithinPartitions(at).withColumn(part, F.spark_partition_id()), "lined")
    sums = lined.groupBy(part).agg(F.sum(count).alias("n"))
    before = sums.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    return lined.join(F.broadcast(before), part).select(at, (F.sum(count).over(Window.partitionBy(part).orderBy(at)) + F.col("before")).alias("upto"))


def with_ancestors(labels: DataFrame, some: DataFrame) -> DataFrame:
    """(id) of the given records (id) and all above them: those whose range holds one. Ranges are told by counts of the given records up to their ends."""
    given = some.select("id").distinct().withColumn("given", F.lit(1))
    rows = labels.join(given, "id", "left").select("id", "pre", "last", F.coalesce("given", F.lit(0)).alias("given"))
    counts = stored(preceding(rows, "pre", "given").join(rows, "pre"), "counts")
    ends = counts.select(F.col("pre").alias("last"), F.col("upto").alias("at_end"))
    return counts.join(ends, "last").filter(F.col("at_end") > F.col("upto") - F.col("given")).select("id")


def extremes(values: DataFrame, group: str, at: str, value: str, asked: DataFrame) -> DataFrame:
    """asked (first, upto, and others) with the least and the greatest value (least, most) among the rows (group, at, value) whose at lies in that range; at counts up
    without gaps, and a range lies within one group.

    Extremes of 1, 2, 4, ... rows on are a table each, made from the former one joined with itself; two of them cover any range. So a range costs two equi-joins
    however long it is.
    """
    level = stored(values.select(F.col(group).alias("g"), F.col(at).alias("at"), F.col(value).alias("least"), F.col(value).alias("most"), F.lit(0).alias("k")), "extremes")
    levels, size = level, 1
    while True:
        ahead = level.select("g", (F.col("at") - size).alias("at"), F.col("least").alias("l"), F.col("most").alias("m"))
        level = stored(level.join(ahead, ["g", "at"]).select("g", "at", F.least("least", "l").alias("least"), F.greatest("most", "m").alias("most"), (F.col("k") + 1).alias("k")), "extremes")
        if not level.limit(1).count():
            break
        levels, size = levels.unionByName(level), 2 * size
    length = F.col("upto") - F.col("first") + 1
    rows = asked.filter("upto >= first").withColumn("k", F.floor(F.log2(length.cast("double"))).cast("int"))
    rows = rows.withColumn("second", F.col("upto") - F.expr("shiftleft(1L, k)") + 1)
    one = levels.select(F.col("k").alias("k"), F.col("at").alias("first"), F.col("least").alias("l1"), F.col("most").alias("m1"))
    two = levels.select(F.col("k").alias("k"), F.col("at").alias("second"), F.col("least").alias("l2"), F.col("most").alias("m2"))
    out = rows.join(one, ["k", "first"]).join(two, ["k", "second"])
    return out.select(*asked.columns, F.least("l1", "l2").alias("least"), F.greatest("m1", "m2").alias("most"))
