"""Dependency graphs: edges, degrees, ranks, cycles, orders, collapses. Vertices are (id), edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.lineage import cut
from gneiss.functions.ranking import numbered

DAMPING, ROUNDS, CUT_EVERY = 0.85, 20, 5
#: Files naming a type, and files declaring it, that are paired at once.
TILE = 2048


def clean(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Different edges between known, different vertices."""
    some = edges.select("src", "dst").filter("src <> dst").distinct()
    return some.join(vertices.select(F.col("id").alias("src")), "src", "left_semi").join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """From files (path, stem, module, ordinal) and imports (path, name): edges by whole name, else by the last part.

    Of files with one stem or module, the last one wins.
    """
    names = files.select(F.explode(F.array("stem", "module")).alias("name"), "path", "ordinal").filter("name <> ''")
    target = names.groupBy("name").agg(F.max(F.struct("ordinal", "path"))["path"].alias("to"))
    tail = F.regexp_extract("name", r"([^.]*)$", 1)
    wanted = imports.select("path", "name", tail.alias("tail"))
    whole = target.select(F.col("name"), F.col("to").alias("to_whole"))
    part = target.select(F.col("name").alias("tail"), F.col("to").alias("to_part"))
    found = wanted.join(whole, "name", "left").join(part, "tail", "left").select(F.col("path").alias("src"), F.coalesce("to_whole", "to_part").alias("dst"))
    return found.filter("dst IS NOT NULL AND src <> dst").distinct()


def type_edges(tokens: DataFrame, types: DataFrame, least: int = 4) -> DataFrame:
    """From tokens (package, path, token) and types (package, path, name): an edge where a file names another's type.

    Of a common name every file that names it meets every file that declares it, so the edges grow by the product.
    Both sides of a name are dealt in tiles of about TILE files, so that they are made by many tasks. Only edges to
    a file with several types can be found twice; those are made different, the others are not shuffled.
    """
    key = ["package", "token"]
    tiles = lambda c: F.ceil(F.count("*") / TILE).cast("int").alias(c)
    named = types.filter(F.length("name") >= least).select("package", F.col("name").alias("token"), F.col("path").alias("dst")).distinct()
    named = cut(named.withColumn("alone", F.count("*").over(Window.partitionBy("dst")) == 1))
    naming = tokens.filter(F.length("token") >= least).select("package", "token", F.col("path").alias("src"))
    naming = cut(naming.join(named.groupBy(*key).agg(tiles("across")).hint("merge"), key).distinct())
    down = naming.groupBy(*key, "across").agg(tiles("down"))
    left = naming.join(down.drop("across").hint("merge"), key).withColumn("row", F.pmod(F.hash("src"), F.col("down")))
    left = left.select(*key, "src", "row", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("col"))
    right = named.join(down.hint("merge"), key).withColumn("col", F.pmod(F.hash("dst"), F.col("across")))
    right = right.select(*key, "dst", "alone", "col", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("row"))
    meet = lambda some: left.join(some.hint("merge"), [*key, "row", "col"]).filter("src <> dst").select("src", "dst")
    return meet(right.filter("alone")).union(meet(right.filter("NOT alone")).distinct())


def interop_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges of a mixed project: bridging headers to what they import, Swift files to the bridging header,
    and files that import a generated ``-Swift.h`` header to it."""
    header = files.filter("path LIKE '%-Bridging-Header.h'").select(F.col("path").alias("header"), "package")
    stems = files.filter("path LIKE '%.h'").select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("path").alias("dst"))
    out = header.join(imports.withColumnRenamed("path", "header"), "header").join(stems, "name").select(F.col("header").alias("src"), "dst")
    swift = files.filter("path LIKE '%.swift'").select(F.col("path").alias("src"), "package").join(header, "package").select("src", F.col("header").alias("dst"))
    objc = imports.filter("path RLIKE '[.]mm?$' AND name LIKE '%-Swift.h'").select(F.col("path").alias("src"), "name")
    generated = objc.join(stems, "name").select("src", "dst")
    return out.unionByName(swift).unionByName(generated).filter("src <> dst").distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return vertices.select("id").join(into, "id", "left").join(out, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, score) after a fixed number of rounds; what vertices without out-edges hold is not handed on."""
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("score"))
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    weighted = cut(edges.join(out, "src").select("src", "dst", "out"))
    ids = cut(vertices.select("id"))
    ranks = ids.select("id", F.lit(1.0 / n).alias("score"))
    for i in range(1, rounds + 1):
        given = weighted.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("score") / F.col("out")).alias("given"))
        ranks = ids.join(given, F.col("id") == F.col("dst"), "left").select("id", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("given", F.lit(0.0))).alias("score"))
        if i % CUT_EVERY == 0:
            ranks = cut(ranks)
    return ranks


def hotspots(ranks: DataFrame, k: int = 15) -> DataFrame:
    return ranks.orderBy(F.round("score", 12).desc(), "id").limit(k)


def contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, steps) between vertices that don't lie inside a line, and (id, root, steps) of those that do.

    Inside a line is what has one edge in and one out. Its root, the first vertex before it that doesn't, is found
    by steps of doubled length; rings that nothing enters have no root and are left out.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("at"))
    walk = cut(into.join(out, "id").filter("n = 1 AND out = 1").select("id", "at", F.lit(1).cast("long").alias("steps")))
    most, length = walk.count(), 1
    inner = walk.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
    while length <= most and not walk.join(inner, "at", "left_semi").isEmpty():
        walk = cut(walk.join(inner, "at", "left").select("id", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        inner = walk.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"))
        length *= 2
    inside = walk.select("id")
    rooted = walk.join(inside.select(F.col("id").alias("at")), "at", "left_anti").select("id", F.col("at").alias("root"), "steps")
    outer = edges.join(inside.select(F.col("id").alias("dst")), "dst", "left_anti")
    from_ring = walk.join(rooted.select("id"), "id", "left_anti").select(F.col("id").alias("src"), F.lit(True).alias("ring"))
    ends = outer.join(rooted.withColumnRenamed("id", "src"), "src", "left").join(from_ring, "src", "left").filter("ring IS NULL")
    return ends.groupBy(F.coalesce("root", "src").alias("src"), "dst").agg(F.max(F.coalesce("steps", F.lit(0)) + 1).alias("steps")), rooted


def levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): how many edges the longest way to each vertex has; null on and behind cycles.

    Vertices are done once all before them are, a round for each step of the graph whose lines are contracted.
    """
    short, rooted = contracted(cut(edges.select("src", "dst")))
    short, rooted = cut(short), cut(rooted)
    own = vertices.select("id")
    into = short.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    # what lies inside a line isn't waited for; a ring without an entry stays without a level
    single = _inside(edges).select("id")
    state = cut(own.join(single, "id", "left_anti").join(into, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("waits"), F.lit(0).cast("long").alias("most"), F.lit(None).cast("long").alias("level")))
    free = F.col("level").isNull() & (F.col("waits") == 0)
    while not (ready := state.filter(free)).isEmpty():
        done = short.join(ready.select(F.col("id").alias("src"), F.col("most").alias("at")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.max(F.col("at") + F.col("steps")).alias("far"))
        state = cut(state.join(done, "id", "left").select("id", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), F.greatest("most", F.coalesce("far", F.lit(0))).alias("most"), F.when(free, F.col("most")).otherwise(F.col("level")).alias("level")))
    inner = rooted.join(state.select(F.col("id").alias("root"), "level"), "root").select("id", (F.col("level") + F.col("steps")).alias("level"))
    named = state.select("id", "level").union(inner)
    return own.join(named, "id", "left").select("id", F.col("level").cast("int").alias("level"))


def _inside(edges: DataFrame) -> DataFrame:
    """Vertices with one edge in and one out."""
    once = lambda end: edges.groupBy(F.col(end).alias("id")).count().filter("count = 1").select("id")
    return once("src").intersect(once("dst"))


def has_cycle(leveled: DataFrame) -> bool:
    return not leveled.filter("level IS NULL").isEmpty()


def topological_order(leveled: DataFrame) -> DataFrame | None:
    """(id, level, position), or None if there is a cycle."""
    return None if has_cycle(leveled) else numbered(leveled.select("id", "level"), [F.col("level"), F.col("id")])


def learning_path(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, place, category): what depends on nothing first; in a cyclic graph by few out-edges."""
    leveled = levels(vertices, edges)
    d = degrees(vertices, edges)
    order = topological_order(leveled)
    if order is None:
        return d.select("id", F.col("out_degree").alias("place"), F.lit("Cycle Context").alias("category"))
    category = F.when(F.col("out_degree") == 0, "Fundamental").when(F.col("in_degree") == 0, "Entry Point").otherwise("Core Logic")
    return order.join(d, "id").select("id", (-F.col("position")).alias("place"), category.alias("category"))


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): vertices that reach each other share a component, named by its least id.

    Colouring, forward and backward: each vertex takes the greatest key that reaches it, then, inside its colour,
    the greatest key that it reaches; where both are one, it lies in that key's component and is done. Keys are
    hashed anew each round, so lines fall apart in some log rounds, and a colour's own colour is taken at each
    step, so colours travel by doubling. Vertices without edges in or out are done at once.
    """
    rest, found, turn = cut(vertices.select("id").distinct()), [], 0
    inner = cut(clean(edges, rest))
    while not rest.isEmpty():
        busy = inner.select(F.col("src").alias("id")).intersect(inner.select(F.col("dst").alias("id")))
        found.append(rest.join(busy, "id", "left_anti").select("id", F.col("id").alias("root")))
        keyed = cut(busy.select("id", F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), F.col("id").alias("id")).alias("key")))
        if keyed.isEmpty():
            break
        inner = cut(clean(inner, keyed))
        forward = _greatest(keyed, inner)
        of = lambda end: forward.select(F.col("id").alias(end), F.col("color").alias(f"{end}_color"))  # noqa: B023, E731  called at once
        inner = cut(inner.join(of("src"), "src").join(of("dst"), "dst").filter("src_color = dst_color").select("src", "dst"))
        backward = _greatest(keyed, inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        both = forward.join(backward.withColumnRenamed("color", "back"), "id")
        found.append(both.filter("color = back").select("id", F.col("color.id").alias("root")))
        rest = cut(both.filter("color <> back").select("id"))
        inner, turn = cut(clean(inner, rest)), turn + 1
    rooted = found[0] if found else rest.select("id", F.col("id").alias("root"))
    for some in found[1:]:
        rooted = rooted.union(some)
    rooted = cut(rooted)
    return rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def _greatest(keyed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, color): the greatest key of what reaches each vertex, itself included."""
    colors = keyed.select("id", F.col("key").alias("color"))
    while True:
        handed = edges.join(colors.select(F.col("id").alias("src"), "color"), "src").select(F.col("dst").alias("id"), "color")
        best = colors.union(handed).groupBy("id").agg(F.max("color").alias("color"))
        # what reaches the vertex that reaches this one reaches this one
        further = best.join(colors.select(F.col("id").alias("via"), F.col("color").alias("more")), F.col("color.id") == F.col("via"))
        grown = further.select("id", F.greatest("color", "more").alias("color"))
        new = cut(grown.join(colors.withColumnRenamed("color", "old"), "id").select("id", "color", (F.col("color") != F.col("old")).alias("changed")))
        if new.filter("changed").isEmpty():
            return new.select("id", "color")
        colors = new.select("id", "color")


def condensed(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, members, level): strong components, their sizes, and the level of each among the others."""
    named = cut(strong_components(vertices, edges))
    of = lambda end: named.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
    between = clean(edges, vertices).join(of("src"), "src").join(of("dst"), "dst").filter("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct()
    heads = named.groupBy("component").agg(F.count("*").alias("members"))
    leveled = levels(heads.select(F.col("component").alias("id")), between).withColumnRenamed("id", "component")
    return named.join(heads, "component").join(leveled, "component").select("id", "component", "members", "level")


def collapsed(edges: DataFrame, group_of: DataFrame) -> DataFrame:
    """(a, b, connections): undirected links between the groups (id, grp) of different vertices."""
    a = group_of.select(F.col("id").alias("src"), F.col("grp").alias("ga"))
    b = group_of.select(F.col("id").alias("dst"), F.col("grp").alias("gb"))
    both = edges.join(a, "src").join(b, "dst").filter("ga <> gb")
    return both.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.count("*").alias("connections"))


def penetration(imports: DataFrame, packages: DataFrame, k: int = 20) -> DataFrame:
    """The k local packages that most files of other packages import: (name, files, packages)."""
    local = packages.select(F.col("package").alias("name")).distinct()
    found = imports.join(local, "name").filter("name <> package")
    return found.groupBy("name").agg(F.countDistinct("path").alias("files"), F.countDistinct("package").alias("packages")).orderBy(F.col("files").desc(), "name").limit(k)


def spread(seeds: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, depth): seeds at 0, then what refers to them (edges src -> dst), at most so many rounds."""
    found = frontier = seeds.select("id", F.lit(0).alias("depth"))
    for depth in range(1, rounds + 1):
        # nodes grow with the graph, so none of these are broadcast
        step = edges.join(frontier.select(F.col("id").alias("dst")).hint("merge"), "dst").select(F.col("src").alias("id")).distinct()
        frontier = step.join(found.select("id").hint("merge"), "id", "left_anti").select("id", F.lit(depth).alias("depth"))
        found = found.unionByName(frontier)
    return found


def chain_depths(parent_of: DataFrame) -> DataFrame:
    """(id, depth): how many known parents lie above each child (id, parent); a cycle ends the chain.

    One parent a child. Steps are doubled each round, so a chain of any length takes some log2 of it. On a
    cycle, or above one, a chain ends before the first node that it would meet again.
    """
    known = cut(parent_of.select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth")))
    most = known.count() + 1  # no chain without a cycle is longer
    met = known.select(F.col("id").alias("at")).hint("merge")  # names grow with the graph, so none of these are broadcast
    jumps, step = known, 1
    while True:
        up = jumps.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        further = jumps.join(up.hint("merge"), "at", "left").select("id", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        further = cut(further)
        if step > most or further.join(met, "at", "left_semi").isEmpty():
            break
        jumps, step = further, 2 * step
    # a chain that still has a parent after so many steps runs into a cycle
    endless = further.join(met, "at", "left_semi").select("id", "at")
    plain = further.join(endless.select("id").hint("merge"), "id", "left_anti").select("id", F.col("depth").cast("int").alias("depth"))
    return plain if endless.isEmpty() else plain.unionByName(_into_cycles(known, endless.select("id")))


def _into_cycles(known: DataFrame, some: DataFrame) -> DataFrame:
    """Depths of the chains that run into a cycle: different nodes on the way, the start itself left out."""
    out = frontier = cut(some.join(known.select("id", "at"), "id").select("id", "at", F.array("id").alias("seen")))
    out = frontier.filter("NOT array_contains(seen, at)").select("id", F.lit(1).alias("depth"))
    depth, above = 1, known.select(F.col("id").alias("at"), F.col("at").alias("next"))
    while True:
        frontier = frontier.filter("NOT array_contains(seen, at)").join(above, "at").select("id", F.col("next").alias("at"), F.array_append("seen", F.col("at")).alias("seen"))
        frontier = cut(frontier.filter("NOT array_contains(seen, at)"))
        if frontier.isEmpty():
            return some.join(out.groupBy("id").agg(F.max("depth").alias("depth")), "id", "left").select("id", F.coalesce("depth", F.lit(1)).alias("depth"))
        depth += 1
        out = out.unionByName(frontier.select("id", F.lit(depth).alias("depth")))


def declaration_graph(declarations: DataFrame, tokens: DataFrame, most: int = 100, least: int = 4) -> DataFrame:
    """package, src, dst: which classes and actors name which types of their package, by name, once each.

    declarations: package, path, name, kind, score; of large packages the types of the best scored files.
    tokens: package, path, token.
    """
    from gneiss.functions.windows import top_per

    some = declarations.filter(F.col("kind").isin("class", "struct", "enum", "actor") & (F.length("name") >= least))
    some = top_per(some, ["package"], [F.col("score").desc(), F.col("path").desc(), F.col("name")], most)
    sources = some.filter(F.col("kind").isin("class", "actor")).select("package", "path", F.col("name").alias("src"))
    targets = some.select("package", F.col("name").alias("token")).distinct()
    named = sources.join(tokens.select("package", "path", "token").distinct(), ["package", "path"]).join(targets, ["package", "token"])
    return named.filter("src <> token").select("package", "src", F.col("token").alias("dst")).distinct()
