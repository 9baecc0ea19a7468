"""Version history as tables, read from git on the executors, a range of commits or a lot of files at a time.

The driver asks for numbers only: the commit that is meant, how many it has before it, the refs. Logs are read
through a partitioned data source, each partition a range of the log; trees and blame run where the rows of
commits and paths are. The repository's folder must be visible to all executors. A git call that fails raises
``GitError``, with what git said.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MARK = "__COMMIT__"
LOG = f"{MARK}%n%H%x09%ae%x09%an%x09%at%x09%P%x09%s"
#: Commits of one partition of the log; seconds that one call may take.
COMMITS, TIMEOUT = 20_000, 3600
#: Lines of a file up to which blame asks for them one by one; of more, the whole file is blamed.
FEW_LINES = 400


class GitError(RuntimeError):
    """A git call that failed."""


def git(root: str, *args: str) -> str:
    """Output of a git command; an error where it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", timeout=TIMEOUT, check=False)
    if done.returncode:
        raise GitError(f"git {' '.join(args[:3])} in {root}: {done.stderr.strip()[:500]}")
    return done.stdout


def git_lines(root: str, *args: str) -> Iterator[str]:
    """Lines of a git command's output as they come; an error at their end where it failed."""
    with subprocess.Popen(["git", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace") as run:
        yield from (line.rstrip("\n") for line in run.stdout)
        said = run.stderr.read()
    if run.returncode:
        raise GitError(f"git {' '.join(args[:3])} in {root}: {said.strip()[:500]}")


def head(root: str, name: str = "HEAD") -> str | None:
    """The commit that a name means; None where the folder has no history."""
    done = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}"], capture_output=True, text=True, timeout=TIMEOUT, check=False)
    return done.stdout.strip() or None


def blocks_of(lines: Iterator[str]) -> Iterator[str]:
    """The text of each commit of a log: its head line, then a line per file."""
    block: list[str] | None = None
    for line in lines:
        if line == MARK:
            if block:
                yield "\n".join(block)
            block = []
        elif block is not None and line:  # an empty line parts commits
            block.append(line)
    if block:
        yield "\n".join(block)


class Range(InputPartition):
    def __init__(self, skip: int, count: int):
        self.skip, self.count = skip, count


class LogReader(DataSourceReader):
    """Partitions are ranges of the log of one fixed commit, so a repeated task reads the same rows."""

    def __init__(self, options):
        self.root, self.merges = options["path"], options.get("merges") == "true"
        self.commit = head(self.root, options.get("commit", "HEAD"))
        if self.commit is None:
            raise GitError(f"{self.root} has no commit {options.get('commit', 'HEAD')}")
        self.size, self.most = int(options.get("commits", COMMITS)), options.get("most")
        self.kinds = ["--merges"] if self.merges else []

    def partitions(self):
        n = int(git(self.root, "rev-list", "--count", *self.kinds, self.commit))
        n = min(n, int(self.most)) if self.most is not None else n
        return [Range(at, min(self.size, n - at)) for at in range(0, n, self.size)] or [Range(0, 0)]

    def read(self, partition):
        if partition.count:
            numbers = [] if self.merges else ["--numstat"]
            lines = git_lines(self.root, "log", *self.kinds, *numbers, f"--skip={partition.skip}", f"--max-count={partition.count}", f"--pretty=format:{LOG}", self.commit)
            for i, block in enumerate(blocks_of(lines)):
                yield partition.skip + i, block


class GitLog(DataSource):
    """Format ``git_log``: ord and block of each commit. Options: path, commit, commits (per partition), most (None: all), merges."""

    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return "ord long, block string"

    def reader(self, schema):
        return LogReader(self.options)


def log_text(spark: SparkSession, root: str, commit: str = "HEAD", commits_per_partition: int = COMMITS, most: int | None = None, merges_only: bool = False) -> DataFrame:
    """The log with numbers of lines (of merges: without), a row per commit, newest first: ord, block."""
    spark.dataSource.register(GitLog)
    some = spark.read.format("git_log").option("path", root).option("commit", commit).option("commits", commits_per_partition).option("merges", str(merges_only).lower())
    return (some if most is None else some.option("most", most)).load()


def commits(blocks: DataFrame) -> DataFrame:
    """hash, author, name, ts, parents, subject, added of each commit; those without a time are left out."""
    lines = F.split("block", "\n")
    cells = F.split(lines[0], "\t")
    numbers = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.coalesce(F.split(x, "\t")[0].try_cast("long"), F.lit(0)))
    added = F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = blocks.filter(F.size(cells) >= 6).select(
        "ord", cells[0].alias("hash"), cells[1].alias("author"), cells[2].alias("name"), cells[3].try_cast("long").alias("ts"), F.filter(F.split(cells[4], " "), lambda p: p != "").alias("parents"),
        F.array_join(F.slice(cells, F.lit(6), F.size(cells)), "\t").alias("subject"), added.alias("added"),
    )
    return rows.filter("ts > 0")


def commit_files(blocks: DataFrame) -> DataFrame:
    """ord, hash, author, ts, subject, path and added lines (null: binary) of each file of each commit."""
    lines = F.split("block", "\n")
    top = F.split(lines[0], "\t")
    rows = blocks.select("ord", top[0].alias("hash"), top[1].alias("author"), F.coalesce(top[3].try_cast("long"), F.lit(0)).alias("ts"), F.array_join(F.slice(top, F.lit(6), F.size(top)), "\t").alias("subject"), F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("line"))
    cells = F.split("line", "\t")
    return rows.filter(F.size(cells) == 3).select("ord", "hash", "author", "ts", "subject", cells[2].alias("path"), cells[0].try_cast("long").alias("added"))


def parents(commit_rows: DataFrame) -> DataFrame:
    """hash, parent and its number, the main parent's first."""
    return commit_rows.select("hash", F.posexplode("parents").alias("nth", "parent"))


def merges(commit_rows: DataFrame, k: int | None = None) -> DataFrame:
    """merge, main_parent, tip and times of all merges, or of the last k."""
    two = commit_rows.filter("size(parents) = 2")
    if k is not None:
        two = two.orderBy(F.col("ts").desc(), "hash").limit(k)
    return two.select(F.col("hash").alias("merge"), F.col("parents")[0].alias("main_parent"), F.col("parents")[1].alias("tip"), "ts")


def refs(spark: SparkSession, root: str) -> DataFrame:
    """name, kind (head, remote, tag) and time of every ref."""
    rows = []
    for line in git(root, "for-each-ref", "--format=%(refname)%09%(creatordate:unix)").splitlines():
        name, _, ts = line.partition("\t")
        for prefix, kind in (("refs/heads/", "head"), ("refs/remotes/", "remote"), ("refs/tags/", "tag")):
            if name.startswith(prefix):
                rows.append((name.removeprefix(prefix), kind, int(ts) if ts.isdigit() else 0))
    return spark.createDataFrame(rows, "name string, kind string, ts long")


def merged(spark: SparkSession, root: str) -> DataFrame:
    names = [x.strip().removeprefix("* ") for x in git(root, "branch", "--merged").splitlines()]
    return spark.createDataFrame([(n,) for n in names if n], "name string")


def main_branch(root: str) -> str:
    return git(root, "rev-parse", "--abbrev-ref", "HEAD").strip() or "main"


def over_rows(rows: DataFrame, schema: str, make) -> DataFrame:
    """What make(row) yields for each row, on the executors: rows of the schema, in small batches."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        made: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True) if made else [[]] * len(kinds), kinds.types, strict=True)], names=kinds.names)
        for batch in batches:
            for row in batch.to_pylist():
                for one in make(row):
                    made.append(one)
                    if len(made) == 10_000:
                        yield flush()
                        made.clear()
        yield flush()

    return rows.mapInArrow(run, schema)


def trees(picked: DataFrame, root: str) -> DataFrame:
    """hash and path of every file of the given commits (hash), each listed on an executor."""
    hashes = picked.select("hash").distinct()
    return over_rows(hashes, "hash string, path string", lambda r: ((r["hash"], p) for p in git_lines(root, "ls-tree", "-r", "--name-only", r["hash"])))


def parse_blame(lines) -> Iterator[tuple[int, str]]:
    """(line, author) from porcelain blame; a commit's author is given only once."""
    authors: dict[str, str] = {}
    commit, line = "", 0
    for row in lines:
        cells = row.split(" ")
        if row.startswith("\t"):
            yield line, authors.get(commit, "")
        elif row.startswith("author "):
            authors[commit] = row[7:]
        elif len(cells) >= 3 and len(cells[0]) >= 40 and cells[2].isdigit():
            commit, line = cells[0], int(cells[2])


def intervals(path: str, authored) -> Iterator[tuple[str, int, int, str]]:
    """Runs of lines that follow each other and have one author: path, first, last, author."""
    first = last = 0
    by = None
    for line, author in sorted(authored):
        if author == by and line == last + 1:
            last = line
            continue
        if by is not None:
            yield path, first, last, by
        first, last, by = line, line, author
    if by is not None:
        yield path, first, last, by


def blame(lines: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """path, first, last, author: intervals of the authors of the given lines (path, line), a git call per file, on the executors.

    Of a file with many lines asked for the whole is blamed, since a command line is bounded.
    """
    per = lines.filter("line > 0").groupBy("path").agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias("lines"))
    per = per.repartition(partitions or lines.sparkSession.sparkContext.defaultParallelism, "path")

    def one(row):
        if not any(git_lines(root, "ls-tree", "--name-only", "HEAD", "--", row["path"])):
            return  # not committed, so nobody's
        asked = [x for n in row["lines"] for x in ("-L", f"{n},{n}")] if len(row["lines"]) <= FEW_LINES else []
        yield from intervals(row["path"], parse_blame(git_lines(root, "blame", "--porcelain", *asked, "--", row["path"])))

    return over_rows(per, "path string, first int, last int, author string", one)
