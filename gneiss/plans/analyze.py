"""A whole analysis: sources to result tables. Nothing is computed until a table is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.lineage import cut
from gneiss.functions.ranking import numbered
from gneiss.functions.text import identifiers, stem
from gneiss.operators import architecture, constructs, graph, history, packages, parse, patterns, security, style, traffic
from gneiss.plans.config import Config
from gneiss.sources import files as files_source
from gneiss.sources import history as history_source



def code_tables(texts: DataFrame, project: DataFrame, paths: DataFrame, config: Config, listed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables from source texts (file_path, text), project texts and all paths (rel_path).

    With a listing and a cache named in the config, only files that changed since are parsed again.
    """
    texts = cut(texts.dropDuplicates(["file_path"]))
    parsed = cut(files_source.cached(listed, texts, parse.parsed, config.cache) if config.cache and listed is not None else parse.parsed(texts))
    scan = cut(constructs.scanned(texts))
    placed = parsed.join(parse.packages(parsed.select("file_path"), paths), "file_path")
    placed = cut(placed)
    decls, imports = cut(parse.declarations(parsed)), parse.imports(parsed)
    nodes = numbered(placed, [F.col("file_path")], "ordinal").select("file_path", stem(F.col("file_path")).alias("stem"), F.col("module_name").alias("module"), F.col("ordinal"), F.col("package_name").alias("package"))
    out = {"files": placed, "declarations": decls, "imports": imports}
    swift = texts.filter("file_path LIKE '%.swift'").join(nodes.select("file_path", "package"), "file_path")
    tokens = swift.select("package", F.col("file_path").alias("path"), F.explode(identifiers(F.col("text"))).alias("token"))
    types = decls.filter("kind <> 'extension'").join(nodes.select("file_path", "package"), "file_path").select("package", F.col("file_path").alias("path"), "name")
    by_path = nodes.withColumnRenamed("file_path", "path")
    named = imports.withColumnRenamed("file_path", "path").select("path", "name")
    edges = graph.import_edges(by_path, named).unionByName(graph.type_edges(tokens, types)).unionByName(graph.interop_edges(by_path, named))
    vertices = nodes.select(F.col("file_path").alias("id"))
    edges = cut(graph.clean(edges, vertices))
    ranks = cut(graph.pagerank(vertices, edges))
    scored = decls.join(nodes.select("file_path", "package"), "file_path").join(ranks, F.col("file_path") == F.col("id")).select("package", F.col("file_path").alias("path"), "name", "kind", "score")
    out["declaration_graph"] = graph.declaration_graph(scored, tokens)
    out |= {"vertices": vertices, "edges": edges, "ranks": ranks, "degrees": graph.degrees(vertices, edges), "hotspots": graph.hotspots(ranks, config.hotspots)}
    out["learning_path"] = graph.learning_path(vertices, edges).orderBy("place", "id").limit(config.learning_path)
    out["package_graph"] = graph.collapsed(edges, nodes.filter("package <> ''").select(F.col("file_path").alias("id"), F.col("package").alias("grp")))
    lined = security.lines(texts, *style.LOOKED_AT)
    out |= {f"security_{k}": v for k, v in security.analyze(texts, project, config.compat, config.limit("hits_per_file")).items()}
    out["style"] = style.analyze(lined, decls)
    out["patterns"] = patterns.detect(scan)
    for name, found in (("structure", constructs.structures(scan)), ("algorithm", constructs.algorithms(scan)), ("constant", constructs.constants(scan))):
        out |= {f"{name}s": constructs.grouped(found), f"{name}_occurrences": found}
    out |= {"complexity_time": constructs.worst(scan, "time"), "complexity_space": constructs.worst(scan, "space"), "complexity_health": constructs.health(scan), "collection_usage": constructs.collection_usage(scan)}
    with_module = texts.join(placed.select("file_path", F.coalesce(F.nullif("module_name", F.lit("")), "package_name").alias("module")), "file_path")
    out["traffic"] = traffic.entries(with_module)
    out["layers"] = architecture.layer_totals(placed)
    own = placed.filter(~packages.is_infrastructure(F.col("file_path")))
    own_decls = decls.join(own.select("file_path"), "file_path", "left_semi")
    out["roles"] = architecture.role_stats(own, own_decls)
    out["architecture"] = architecture.patterns(own, own_decls)
    out |= {"letters": architecture.letters(own, own_decls), "pattern_letters": architecture.pattern_letters(own, own_decls)}
    out["components"] = architecture.components(texts.sparkSession, imports)
    out["packages"] = packages.major(packages.totals(placed, decls))
    out["package_categories"] = packages.categories(placed, imports, decls)
    out["import_classes"] = packages.classified(imports, placed)
    out["penetration"] = graph.penetration(imports.join(placed.select("file_path", F.col("package_name").alias("package")), "file_path").withColumnRenamed("file_path", "path"), placed.filter("package_name <> ''").select(F.col("package_name").alias("package")))
    out["notes"] = packages.notes_by_module(placed)
    out |= {"longest_functions": packages.longest(parsed), "biggest_types": packages.longest(parsed, "biggest_type")}
    return out


def history_tables(blocks: DataFrame, refs: DataFrame, merged: DataFrame, as_of: int, known: DataFrame | None = None, config: Config | None = None) -> dict[str, DataFrame]:
    """Tables from a log's blocks and refs; as_of is the time that ages are counted to."""
    commits, touched = cut(history_source.commits(blocks)), cut(history_source.commit_files(blocks))
    config = config or Config()
    known = known if known is not None else touched.select("path").distinct()
    stats = history.author_stats(commits)
    files = history.files_modified(touched, known)
    out = {"commits": commits, "authors": stats, "file_history": history.file_history(touched), "churn": history.churn(touched)}
    both = history.merged_authors(stats.select("author", "commits"), files)
    out["team"] = history.team(both)
    out["weekdays"] = history.weekdays(commits.select(F.date_from_unix_date((F.col("ts") / 86400).cast("int")).alias("day")))
    out["reverts"] = history.reverts(commits)
    out["conventional"] = history.conventional(commits)
    out["compliance"] = history.compliance(commits)
    out["tags"] = history.tags(refs)
    out["branches"] = history.branch_counts(refs, merged)
    out["stale"] = history.stale(refs.filter("kind = 'head'"), F.lit(as_of))
    merges = cut(history_source.merges(commits, config.limit("timed_merges")))
    brought = history.feature_commits(history_source.parents(commits), merges)
    out["merge_timing"] = history.merge_timing(history.merge_times(commits, merges, brought))
    return out


def branching(spark: SparkSession, root: str, tables: dict[str, DataFrame], refs: DataFrame, as_of: int, config: Config) -> DataFrame:
    """Scores of the branching models of a local repository."""
    merges_of = lambda branch, most: history_source.commits(history_source.log_text(spark, root, branch, most=most, merges_only=True))
    subjects = lambda branch: merges_of(branch, config.limit("compared_merges")).select("subject").filter("subject <> ''")
    names = history.ref_names(refs.filter("kind <> 'tag'"))
    found = lambda some: next((r["name"] for r in names.filter(some).orderBy("name").limit(1).collect()), None)
    integration = found(F.col("name").isin(*history.INTEGRATION))
    # a branch that is known from a remote only is asked for by the name it has there
    at = lambda name: name if history_source.head(root, name) else f"origin/{name}"
    main = subjects("HEAD")
    dual = history.dual_merges(main, subjects(at(integration)) if integration and history_source.head(root, at(integration)) else main.limit(0))
    environments = names.filter(F.col("name").rlike(history.ENVIRONMENT)).orderBy("name")
    if (most := config.limit("environments")) is not None:
        environments = environments.limit(most)
    # the names are one per environment; each is asked for merges until one has some
    cascades = any(history_source.head(root, at(r["name"])) and merges_of(at(r["name"]), config.limit("cascade_merges")).filter("subject <> ''").limit(1).count() for r in environments.collect())
    return history.branching_scores(history.branching_features(tables["commits"], refs, tables["merge_timing"], dual, cascades, F.lit(as_of)))


def analyze(spark: SparkSession, root: str, config: Config | None = None, as_of: int | None = None) -> dict[str, DataFrame]:
    """All tables of a repository; those of its history only where there is one."""
    config = config or Config()
    listed = cut(files_source.listing(spark, root))
    texts = files_source.sources(spark, root, config)
    project = cut(files_source.project_texts(spark, root, config.exclude))
    out = code_tables(texts, project, listed.select("rel_path"), config, listed)
    libraries = spark.createDataFrame([(n,) for n in files_source.LIBRARIES], "name string")
    out |= {"assets": architecture.asset_totals(files_source.assets(listed)), "heavy_types": files_source.heavy_types(listed), "shaders": files_source.shaders(listed, config.exclude), "vendored": files_source.vendored(listed, libraries), "metadata": files_source.metadata(project, texts, config.limit("version_files"))}
    if "://" not in root and (commit := history_source.head(root)):
        blocks = cut(history_source.log_text(spark, root, commit))
        now = as_of if as_of is not None else blocks.select(F.max(F.split(F.split("block", "\n")[0], "\t")[3].try_cast("long"))).first()[0]
        refs = cut(history_source.refs(spark, root))
        out |= history_tables(blocks, refs, history_source.merged(spark, root), now, out["files"].select(F.col("file_path").alias("path")), config)
        out["branching"] = branching(spark, root, out, refs, now, config)
        out["files"] = history.enriched(out["files"].withColumnRenamed("file_path", "path"), out["file_history"]).withColumnRenamed("path", "file_path")
        out["author_packages"] = packages.author_packages(out["files"].filter("top_authors IS NOT NULL"))
        hits = cut(out["security_violations"])
        lines = hits.filter("line_no > 0").select(F.col("file_path").alias("path"), F.col("line_no").alias("line"))
        out["security_violations"] = security.with_authors(hits, cut(history_source.blame(lines, root)))
    return out


def evolution(spark: SparkSession, root: str, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshots (hash, ts, files, est_lines) back in time, and the growth between the first and the last."""
    config = config or Config()
    commits = cut(history_source.commits(history_source.log_text(spark, root)))
    last = commits.agg(F.max("ts")).first()[0] or 0
    picked = cut(history.sampled(commits, config.interval_days * 86400, last - config.months * 30 * 86400))
    trees = history_source.trees(picked, root)
    per = trees.filter(F.col("path").rlike(r"\.(" + "|".join(config.extensions) + ")$")).groupBy("hash").agg(F.count("*").alias("files"))
    snapshots = picked.join(per, "hash", "left").fillna(0, ["files"]).withColumn("est_lines", F.col("files") * 50).orderBy("ts")
    return snapshots, history.growth(snapshots)
