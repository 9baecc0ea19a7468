"""Ancestry of commits: what a merge brought in, without a closure of the history.

Every commit has one main parent, so main parents form a forest; other parents are extra edges, one or so a
merge. Along the forest all walks are by exact distance: a table of each power of two holds one row a commit.
The longest line of main parents is the trunk, numbered from its root. A commit enters the trunk at the first
trunk commit that reaches it; what a trunk commit reaches is then what has entered up to its number, which
needs no rows. Only what a commit reaches beside that, its own branch, is listed.

Tables have at most a row for each commit and power of two, and one for each merge off the trunk and commit of
the branches that meet there; results have a row for each commit that a merge brought in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.lineage import cut


@dataclass
class Forest:
    """jumps[k]: (hash, up), the ancestor 2**k main parents up; extra: (hash, parent); depth: (hash, depth), 0 at a root."""

    jumps: list[DataFrame]
    extra: DataFrame
    depth: DataFrame


def forest(parents: DataFrame) -> Forest:
    """From (hash, parent) and, where known, nth: the main parent is the first one, else the least name."""
    known = parents if "nth" in parents.columns else parents.select("hash", "parent", F.row_number().over(Window.partitionBy("hash").orderBy("parent")).alias("nth"))
    least = Window.partitionBy("hash")
    edges = cut(known.groupBy("hash", "parent").agg(F.min("nth").alias("nth")).withColumn("main", F.col("nth") == F.min("nth").over(least)).select("hash", "parent", "main"))
    main = edges.filter("main").select("hash", F.col("parent").alias("up"))
    ids = edges.select("hash").union(edges.select("parent")).distinct()
    # where so many steps lead, or the root before that, and how many steps it was
    step = cut(ids.join(main, "hash", "left").select("hash", F.coalesce("up", "hash").alias("up"), F.col("up").isNotNull().cast("long").alias("steps")))
    jumps, length = [], 1
    while step.filter(F.col("steps") == length).limit(1).count():
        jumps.append(step.filter(F.col("steps") == length).select("hash", "up"))
        onward = step.select(F.col("hash").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"))
        step = cut(step.join(onward, "up").select("hash", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps")))
        length *= 2
    return Forest(jumps, edges.filter("NOT main").select("hash", "parent"), step.select("hash", F.col("steps").alias("depth")))


def upward(rows: DataFrame, jumps: list[DataFrame], by: list[str]) -> DataFrame:
    """rows (by, hash) and all their ancestors along the forest: steps of every power of two, largest first."""
    for jump in reversed(jumps):
        both = F.explode(F.array_compact(F.array("hash", "up")))
        rows = rows.join(jump, "hash", "left").select(*by, both.alias("hash")).distinct()
    return rows


def reachable(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, hash): all ancestors of each tip, itself included; a row for each tip and ancestor at most."""
    trees = forest(parents)
    found, n = cut(tips.select("tip", F.col("tip").alias("hash")).distinct()), -1
    while found.count() > n:
        n = found.count()
        side = found.join(trees.extra, "hash").select("tip", F.col("parent").alias("hash"))
        found = cut(upward(found.union(side).distinct(), trees.jumps, ["tip"]))
    return found


def spread(values: DataFrame, jumps: list[DataFrame], down: bool, column: str) -> DataFrame:
    """values (hash, column) carried along the forest: the least to all ancestors, or the greatest to all descendants."""
    pair = lambda c: F.struct(F.col(c).alias("hash"), F.col(column))
    for jump in jumps:
        hop = jump.toDF("hash", "to") if down else jump.toDF("to", "hash")
        both = F.explode(F.array(pair("hash"), pair("to"))).alias("x")
        least = F.min(column) if down else F.max(column)
        values = values.join(hop, "hash", "left").select(both).select("x.*").filter("hash IS NOT NULL").groupBy("hash").agg(least.alias(column))
    return values


def settled(start: DataFrame, step, column: str) -> DataFrame:
    """start with ``step`` applied until its values no longer change; they only fall or only rise."""
    total = lambda df: tuple(df.agg(F.count(column), F.sum(column)).first())
    now = cut(start)
    seen = total(now)
    while True:
        now = cut(step(now))
        if (new := total(now)) == seen:
            return now
        seen = new


def feature_commits(parents: DataFrame, merges: DataFrame) -> DataFrame:
    """(merge, hash): the commits that each merge (merge, main_parent, tip) brought in: what its tip reaches and its main parent doesn't."""
    trees = forest(parents)
    head = trees.depth.agg(F.max(F.struct("depth", "hash"))["hash"].alias("hash")).filter("hash IS NOT NULL")
    trunk = cut(upward(head, trees.jumps, []).join(trees.depth, "hash").select("hash", F.col("depth").alias("place")))
    beside = cut(trees.depth.select("hash").join(trunk, "hash", "left_anti"))
    jumps = []
    for jump in trees.jumps:  # of commits beside the trunk to such ones; what leaves the trunk by more steps isn't needed
        inner = cut(jump.join(beside, "hash", "left_semi").join(beside.select(F.col("hash").alias("up")), "up", "left_semi").select("hash", "up"))
        if not inner.limit(1).count():
            break
        jumps.append(inner)
    extra = trees.extra
    # where commits beside the trunk enter it: the least number of what reaches them
    into = extra.join(beside.select(F.col("hash").alias("parent")), "parent", "left_semi")
    from_trunk = into.join(trunk, "hash").groupBy(F.col("parent").alias("hash")).agg(F.min("place").alias("enters"))
    nowhere = beside.select("hash", F.lit(None).cast("long").alias("enters"))
    begin = spread(nowhere.union(from_trunk).groupBy("hash").agg(F.min("enters").alias("enters")), jumps, True, "enters")

    def entered(now):
        handed = into.join(now, "hash").select(F.col("parent").alias("hash"), "enters")
        return spread(now.union(handed).groupBy("hash").agg(F.min("enters").alias("enters")), jumps, True, "enters")

    enters = settled(begin, entered, "enters")
    everywhere = cut(enters.union(trunk.select("hash", F.col("place").alias("enters"))))
    # merges on the trunk, of the trunk: what enters there but the merge itself
    of = lambda df, name: df.select(F.col("hash").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "hash"))
    case = ["merge", "main_parent", "tip"]
    only = extra.groupBy(F.col("hash").alias("merge")).agg(F.when(F.count("*") == 1, F.min("parent")).alias("only"))  # the one other parent
    marked = cut(merges.select(*case).distinct().join(of(trunk, "merge"), "merge", "left").join(of(trunk, "main_parent"), "main_parent", "left").join(only, "merge", "left"))
    plain = F.coalesce((F.col("merge_place") == F.col("main_parent_place") + 1) & (F.col("only") == F.col("tip")), F.lit(False))
    at_place = marked.filter(plain).select("merge", F.col("merge_place").alias("enters")).join(everywhere, "enters").filter("hash <> merge").select("merge", "hash")
    if not marked.filter(~plain).limit(1).count():
        return at_place
    # how far up the trunk commits beside it reach: the greatest number of what they reach
    all_parents = (trees.jumps[0].select("hash", F.col("up").alias("parent")) if trees.jumps else extra.limit(0)).union(extra)
    own = all_parents.join(beside, "hash", "left_semi").join(trunk.withColumnRenamed("hash", "parent"), "parent").groupBy("hash").agg(F.max("place").alias("top"))
    begin = spread(beside.join(own, "hash", "left").select("hash", "top"), jumps, False, "top")

    def reached(now):
        handed = into.join(now.withColumnRenamed("hash", "parent"), "parent").join(beside, "hash", "left_semi").select("hash", "top")
        return spread(now.union(handed).groupBy("hash").agg(F.max("top").alias("top")), jumps, False, "top")

    top = settled(begin, reached, "top").union(trunk.select("hash", F.col("place").alias("top")))
    top = cut(top.select("hash", F.coalesce("top", F.lit(-1).cast("long")).alias("top")))
    # the others: what has entered between the two reaches, and the tip's own branch, without the main parent's own branch
    rest = cut(marked.filter(~plain).select(*case).join(of(top, "main_parent"), "main_parent", "left").join(of(top, "tip"), "tip", "left").fillna(-1, ["main_parent_top", "tip_top"]))
    between = rest.filter("tip_top > main_parent_top").select(*case, F.explode(F.sequence(F.col("main_parent_top") + 1, "tip_top")).alias("enters")).join(everywhere, "enters").select(*case, "hash")
    tips = rest.select(F.col("tip").alias("start"), F.col("tip_top").alias("start_top")).union(rest.select("main_parent", "main_parent_top")).distinct()
    branch = own_branches(tips, enters, jumps, into)
    tip_side = rest.join(branch.withColumnRenamed("start", "tip"), "tip").filter("enters IS NULL OR enters > main_parent_top").select(*case, "hash")
    main_side = rest.join(branch.withColumnRenamed("start", "main_parent"), "main_parent").select(*case, "hash")
    others = between.union(tip_side).join(main_side, [*case, "hash"], "left_anti").select("merge", "hash")
    return at_place.union(others).distinct()


def own_branches(tips: DataFrame, enters: DataFrame, jumps: list[DataFrame], into: DataFrame) -> DataFrame:
    """(start, hash, enters): commits beside the trunk that each start reaches and the trunk up to its top doesn't."""
    new = lambda rows: rows.join(enters, "hash").filter("enters IS NULL OR enters > start_top")
    some = jumps if tips.limit(1).count() else []
    found, n = cut(new(tips.select("start", "start_top", F.col("start").alias("hash"))).select("start", "start_top", "hash")), -1
    while (count := found.count()) > n:
        n = count
        side = found.join(into, "hash").select("start", "start_top", F.col("parent").alias("hash"))
        wide = upward(found.union(side).distinct(), some, ["start", "start_top"])
        found = cut(new(wide).select("start", "start_top", "hash"))
    return found.join(enters, "hash").select("start", "hash", "enters")
