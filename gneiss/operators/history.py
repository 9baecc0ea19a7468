"""Version history: author, file, branch and message statistics over commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.windows import top_per
from gneiss.operators.ancestry import feature_commits, reachable  # noqa: F401  part of the history's operators


def author_stats(commits: DataFrame) -> DataFrame:
    """From (author, name, ts, added): commits, first and last time, latest name and added lines of each author."""
    return commits.groupBy("author").agg(
        F.count("*").alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(F.struct("ts", "name"))["name"].alias("name"), F.sum("added").alias("loc_added")
    )


def file_history(touched: DataFrame, authors: int = 3, messages: int = 5) -> DataFrame:
    """From (path, author, ts, ord, subject): changes, first and last change, top authors, first messages in log order.

    A time of 0 is unknown and doesn't count as first or last.
    """
    known = F.when(F.col("ts") > 0, F.col("ts"))
    base = touched.groupBy("path").agg(F.count("*").alias("changes"), F.min(known).alias("first_ts"), F.max(known).alias("last_ts"))
    per = touched.groupBy("path", "author").count()
    top = top_per(per, ["path"], [F.col("count").desc(), F.col("author")], authors)
    top = top.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "author")))["author"].alias("top_authors"))
    said = top_per(touched.select("path", "ord", "subject"), ["path"], [F.col("ord")], messages)
    said = said.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "subject")))["subject"].alias("recent_messages"))
    return base.join(top, "path", "left").join(said, "path", "left")


def files_modified(touched: DataFrame, files: DataFrame) -> DataFrame:
    """How many of the known files (path) each author has changed."""
    return touched.join(files.select("path"), "path", "left_semi").groupBy("author").agg(F.countDistinct("path").alias("files_modified"))


def merged_authors(by_log: DataFrame, by_files: DataFrame) -> DataFrame:
    """Authors that either side knows, with zeros where one side doesn't."""
    both = by_log.join(by_files, "author", "full_outer")
    return both.select("author", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("files_modified", F.lit(0)).alias("files_modified"))


def enriched(files: DataFrame, history: DataFrame) -> DataFrame:
    """files with their history, 0 changes where there is none."""
    return files.join(history, "path", "left").withColumn("changes", F.coalesce("changes", F.lit(0)))


def weekdays(commits: DataFrame) -> DataFrame:
    """Commits by weekday, 0 is Sunday. Takes ``day`` (a date)."""
    return commits.groupBy((F.dayofweek("day") - 1).alias("weekday")).agg(F.count("*").alias("commits"))


def peak_weekday(histogram: DataFrame) -> DataFrame:
    return histogram.orderBy(F.col("commits").desc(), "weekday").limit(1)


def stale(refs: DataFrame, as_of: Column, days: int = 90, k: int = 10, protected: tuple[str, ...] = ()) -> DataFrame:
    """The k refs (name, ts) that were left longest ago, over ``days`` before ``as_of`` seconds."""
    age = F.floor((as_of - F.col("ts")) / 86400).cast("long")
    return refs.filter(~F.col("name").isin(*protected) if protected else F.lit(True)).withColumn("days", age).filter(F.col("days") > days).orderBy(F.col("days").desc(), "name").limit(k)


def branch_counts(refs: DataFrame, merged: DataFrame, protected: tuple[str, ...] = ("main", "master", "develop", "development", "HEAD")) -> DataFrame:
    """One row: local, remote and merged branches, and the deepest name."""
    names = refs.withColumn("depth", F.size(F.split("name", "/")))
    counts = names.agg(F.count_if(F.col("kind") == "head").alias("local_branches"), F.count_if(F.col("kind") == "remote").alias("remote_branches"), F.max(F.when(F.col("kind") == "head", F.col("depth"))).alias("max_depth"))
    done = merged.filter(~F.col("name").isin(*protected)).agg(F.count("*").alias("merged_branches"))
    return counts.join(done)  # one row by one row


def ref_names(refs: DataFrame) -> DataFrame:
    """Branch names without their remote, HEAD left out, once each."""
    return refs.select(F.regexp_replace("name", "^origin/", "").alias("name")).filter("name NOT LIKE '%/HEAD' AND name NOT IN ('HEAD', '')").distinct()


def reverts(commits: DataFrame) -> DataFrame:
    """One row: commits that take others back, all commits, and the rate."""
    back = F.lower("subject").rlike("revert|rollback")
    return commits.agg(F.count_if(back).alias("reverts"), F.count("*").alias("commits")).withColumn("rate", F.when(F.col("commits") > 0, F.col("reverts") / F.col("commits")).otherwise(0.0))


# fixed values: types of conventional subjects
TYPES = ("feat", "fix", "docs", "chore", "refactor", "test", "style", "ci", "build", "perf", "revert")


def prefix_pattern(types: tuple[str, ...] = TYPES) -> str:
    return "^(" + "|".join(types) + r")(\([^)]+\))?!?:\s"


def conventional(commits: DataFrame, k: int = 6, types: tuple[str, ...] = TYPES) -> DataFrame:
    """The k most used prefixes of conventional subjects."""
    prefix = F.regexp_extract("subject", prefix_pattern(types), 1)
    return commits.select(prefix.alias("prefix")).filter("prefix <> ''").groupBy("prefix").count().orderBy(F.col("count").desc(), "prefix").limit(k)


def compliance(commits: DataFrame, samples: int = 5, types: tuple[str, ...] = TYPES) -> DataFrame:
    """One row: the share of conventional subjects, and the first few others (by ord)."""
    fits = F.col("subject").rlike(prefix_pattern(types))
    other = commits.filter(~fits & (F.col("subject") != "")).orderBy("ord").limit(samples)
    said = other.agg(F.array_sort(F.collect_list(F.struct("ord", "subject")))["subject"].alias("samples"))
    return commits.filter("subject <> ''").agg((F.count_if(fits) / F.greatest(F.count("*"), F.lit(1))).alias("compliance")).join(said)


def tags(refs: DataFrame) -> DataFrame:
    """One row: tags, those that are versions, and the newest version."""
    version = F.col("name").rlike(r"^v?[0-9]+\.[0-9]+\.[0-9]+")
    parts = F.transform(F.regexp_extract_all("name", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    newest = F.max(F.when(version, F.struct(parts.alias("p"), F.col("name").alias("n"))))["n"]
    return refs.filter("kind = 'tag'").agg(F.count("*").alias("tags"), F.count_if(version).alias("version_tags"), newest.alias("latest"))


def churn(touched: DataFrame, k: int = 25) -> DataFrame:
    """The k files changed most."""
    return touched.groupBy("path").agg(F.count("*").alias("changes")).orderBy(F.col("changes").desc(), "path").limit(k)


def team(authors: DataFrame, k: int = 15) -> DataFrame:
    """The k authors of most commits, then most files."""
    return authors.orderBy(F.col("commits").desc(), F.col("files_modified").desc(), "author").limit(k)


def merge_timing(merges: DataFrame) -> DataFrame:
    """One row of means, each over its sane range: lifetime and time to merge in days, delay in hours; 0 if none."""
    within = lambda c, most: F.coalesce(F.avg(F.when((F.col(c) >= 0) & (F.col(c) < most), F.col(c))), F.lit(0.0)).alias(c)
    return merges.agg(within("lifetime_days", 365), within("time_to_merge_days", 730), within("delay_hours", 8760))


def merge_times(commits: DataFrame, merges: DataFrame, brought: DataFrame) -> DataFrame:
    """lifetime_days, time_to_merge_days and delay_hours of each merge (merge, ts) from the commits it brought in (merge, hash)."""
    spans = brought.join(commits.select("hash", F.col("ts").alias("at")), "hash").groupBy("merge").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    both = merges.join(spans, "merge")
    return both.select("merge", ((F.col("last") - F.col("first")) / 86400).alias("lifetime_days"), ((F.col("ts") - F.col("first")) / 86400).alias("time_to_merge_days"), ((F.col("ts") - F.col("last")) / 3600).alias("delay_hours"))


def dual_merges(main: DataFrame, other: DataFrame, least: int = 2) -> DataFrame:
    """One row: whether so many merge subjects stand on both branches."""
    return main.select("subject").intersect(other.select("subject")).agg((F.count("*") >= least).alias("dual_merges"))


# fixed values: names of branches that tell a branching model
INTEGRATION = ("develop", "dev", "devel", "development", "integration", "next")
RELEASE, HOTFIX = r"^(release|rel|releases)/", r"^(hotfix[/-]|hf/)"
ENVIRONMENT = r"^(staging|stage|production|prod|preprod|preview|qa)($|[/-])"


def branching_features(commits: DataFrame, refs: DataFrame, timing: DataFrame, dual: DataFrame, cascades: bool, as_of: Column, protected: tuple[str, ...] = ("main", "master", "HEAD")) -> DataFrame:
    """The row of evidence for ``branching_scores``; the age of the main branch counts from its first commit."""
    name = F.col("name")
    names = ref_names(refs.filter("kind <> 'tag'")).agg(
        F.coalesce(F.bool_or(name.isin(*INTEGRATION)), F.lit(False)).alias("has_integration"), F.count_if(name.rlike(RELEASE)).alias("releases"), F.count_if(name.rlike(HOTFIX)).alias("hotfixes"),
        F.count_if(name.rlike(ENVIRONMENT) & ~name.isin(*protected, *INTEGRATION)).alias("env_branches"),
    )
    merged = F.count_if(F.size("parents") > 1)
    days = F.greatest((as_of - F.min("ts")) / 86400, F.lit(1.0))
    main = commits.agg(F.count("*").alias("main_commits"), F.coalesce(merged / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0)).alias("merge_ratio"), F.coalesce(merged / days, F.lit(0.0)).alias("merges_per_day"))
    return main.join(names).join(timing.select("lifetime_days")).join(dual).withColumn("cascades", F.lit(cascades))  # one row each


MODELS = ("Gitflow", "Trunk-Based", "GitHub Flow", "GitLab Flow", "OneFlow")


def branching_scores(features: DataFrame) -> DataFrame:
    """(model, score, share) from one row of evidence; no row if the main branch has few commits.

    features: main_commits, has_integration, releases, hotfixes, dual_merges, merge_ratio, lifetime_days,
    merges_per_day, env_branches, cascades.
    """
    ratio, life, rate = F.col("merge_ratio"), F.col("lifetime_days"), F.col("merges_per_day")
    integration, releases, hotfixes = F.col("has_integration"), F.col("releases") > 0, F.col("hotfixes") > 0
    env, cascades = F.col("env_branches") > 0, F.col("cascades")
    plain = ~integration & ~releases & ~cascades
    # fixed values: what each piece of evidence adds to each model
    evidence = [
        (integration, (40, -20, -10, 0, 0)),
        (releases, (25, 0, 0, 0, 0)),
        (hotfixes, (18, 0, 0, 0, 5)),
        (F.col("dual_merges"), (35, 0, 0, 0, 0)),
        (ratio > 0.7, (15, 0, 0, 0, 0)),
        ((ratio > 0) & (ratio < 0.2), (0, 20, 0, 0, 5)),
        (ratio.between(0.3, 0.7), (0, 0, 5, 8, 0)),
        ((life > 0) & (life < 1), (0, 25, 8, 0, 0)),
        ((life >= 1) & (life < 3), (0, 8, 20, 8, 0)),
        (life >= 3, (15, 0, 0, 0, 0)),
        (rate > 3, (0, 30, 0, 0, 0)),
        ((rate > 1) & (rate <= 3), (0, 8, 20, 8, 0)),
        ((rate > 0) & (rate < 0.5), (10, 0, 0, 0, 5)),
        (env & cascades, (0, 0, 0, 50, 0)),
        (env & ~cascades, (0, 0, -10, 20, 0)),
        (plain, (0, 0, 0, 0, 8)),
        (plain & ~hotfixes, (0, 0, 15, 0, 0)),
    ]
    scores = []
    for i, model in enumerate(MODELS):
        total = F.lit(0.0)
        for fits, points in evidence:
            if points[i]:
                total = total + F.when(fits, float(points[i])).otherwise(0.0)
        scores.append(F.struct(F.lit(model).alias("model"), F.greatest(total, F.lit(0.0)).alias("score")))
    rows = features.filter("main_commits > 5").select(F.explode(F.array(*scores)).alias("s")).select("s.model", "s.score")
    total = F.sum("score").over(_all())
    return rows.withColumn("share", F.when(total > 0, F.col("score") / total).otherwise(0.0))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # five rows


def sampled(commits: DataFrame, every: int, since: int | None = None) -> DataFrame:
    """For instants each ``every`` seconds back from the last commit, the nearest commit (hash, ts), once each.

    Each commit is compared with the two instants around it only, so nothing is crossed.
    """
    last = F.lit(commits.agg(F.max("ts")).first()[0])
    back = (last - F.col("ts")) / every
    steps = F.array_distinct(F.array(F.floor(back), F.ceil(back)))
    near = commits.select("hash", "ts", F.explode(steps).alias("step"))
    if since is not None:
        near = near.filter(last - F.col("step") * every >= since)
    gap = F.abs(F.col("ts") - (last - F.col("step") * every))
    best = near.groupBy("step").agg(F.min(F.struct(gap.alias("gap"), "ts", "hash")).alias("b"))
    return best.select("b.hash", "b.ts").distinct()


def replayed(changes: DataFrame) -> DataFrame:
    """(path, ts, ord, delta) where a path comes or goes, from changes (path, ts, ord, gone) in any order.

    What is there stays until it goes: a change of a present path, or the end of an absent one, is none.
    """
    order = Window.partitionBy("path").orderBy("ts", "ord")
    there, before = ~F.col("gone"), F.coalesce(~F.lag("gone").over(order), F.lit(False))
    return changes.withColumn("delta", there.cast("long") - before.cast("long")).filter("delta <> 0").select("path", "ts", "ord", "delta")


def as_of(deltas: DataFrame, begin: int, every: int, steps: int) -> DataFrame:
    """(ts, files): how many paths there are at ``begin`` and each of so many steps after it, from (ts, delta).

    Each change counts from the first instant that isn't before it; changes are summed per instant, then
    instants run up, so one pass gives all snapshots.
    """
    step = F.greatest(F.ceil((F.col("ts") - begin) / every), F.lit(0))
    per = deltas.groupBy(step.alias("step")).agg(F.sum("delta").alias("delta")).filter(F.col("step") <= steps)
    all_steps = deltas.sparkSession.range(steps + 1).select(F.col("id").alias("step"))
    upto = Window.partitionBy(F.lit(0)).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row per instant
    return all_steps.join(per, "step", "left").select((F.col("step") * every + begin).alias("ts"), F.coalesce(F.sum("delta").over(upto), F.lit(0)).alias("files"))


def growth(snapshots: DataFrame) -> DataFrame:
    """One row: first and last number of files, and the net growth in per cent."""
    first, last = F.min(F.struct("ts", "files"))["files"], F.max(F.struct("ts", "files"))["files"]
    return snapshots.agg(first.alias("first_files"), last.alias("last_files")).withColumn("growth", F.when(F.col("first_files") > 0, 100.0 * (F.col("last_files") - F.col("first_files")) / F.col("first_files")).otherwise(0.0))
