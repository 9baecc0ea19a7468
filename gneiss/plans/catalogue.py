"""Queries over the driver's tables, each with the DuckDB SQL that must give the same rows.

The tables stand in for a repository: documents are files, events are commits (user = author, k = file),
the order chain between nations is a dependency graph, part names are type names, conversations are
ordered lines. Queries go through the operators that real repositories use, but for a few plain ones (unions, differences, flags).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.functions.windows import chunked, frame, parity, previous, running, top_per
from gneiss.operators import architecture, graph, history, matching, packages, security, style, traffic

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql: the DuckDB equivalent."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# inputs


def files(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", F.lit("repo"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "lang", "source", "text", "n_chars", path.alias("path"))


def lines(spark, d) -> DataFrame:
    return files(spark, d).select("doc_id", "lang", "source", F.posexplode(T.lines_of(F.col("text"))).alias("line_no", "line"))


LINES_SQL = """lines AS (
    SELECT doc_id, lang, source, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line
    FROM (SELECT doc_id, lang, source, parts, unnest(range(1, len(parts) + 1)) AS i
          FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents))
)"""


def commits(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("user_id").alias("author"), T.epoch_seconds(F.col("ts")).alias("ts"), F.to_date("ts").alias("day"), F.col("event_type"), k.alias("k"), "value")


COMMITS_SQL = """commits AS (
    SELECT event_id, user_id AS author, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(ts AS DATE) AS day, event_type,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value
    FROM events
)"""


def touched(spark, d) -> DataFrame:
    c = commits(spark, d)
    return c.select(F.concat(F.lit("file"), F.col("k").cast("string")).alias("path"), "author", "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("subject"), "k", "day")


def nation_pairs(spark, d) -> DataFrame:
    """Customer nation, supplier nation and the number of lines between them."""
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    j = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c.select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s.select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("src", "dst").agg(F.count("*").alias("n"))


def edges(spark, d) -> DataFrame:
    """Each nation's five heaviest targets."""
    pairs = nation_pairs(spark, d).filter("src <> dst")
    return top_per(pairs, ["src"], [F.col("n").desc(), F.col("dst")], 5).select("src", "dst")


def vertices(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))


PAIRS_SQL = """pairs AS (
    SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY ALL
)"""
EDGES_SQL = PAIRS_SQL + """, edges AS (
    SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM pairs WHERE src <> dst) WHERE r <= 5
)"""

# security-like queries

SECRET = r'(?i)(^|[^A-Za-z0-9_])(password|passwd|secret|apikey|api_key|authkey|token|privatekey|private_key|clientsecret|appsecret)[ \t]*[=:][ \t]*"([^"]{8,})"'
HEX = r'=[ \t]*"([0-9a-fA-F]{32,})"'
LICENSE = "(?i)licen[sc]e"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
# a small table of checks: id, category, priority, pattern
CHECKS = [(1, "insecureDataStorage", "high", SECRET), (2, "privacy", "medium", MAIL), (3, "supplyChain", "low", LICENSE), (4, "cryptography", "high", HEX)]
#: What every match of a pattern holds: a cheap test before the regular expression.
NEEDLES = {SECRET: '"', MAIL: "@"}


def fits(pattern: str, column: str = "line") -> Column:
    c = F.col(column)
    if pattern == HEX:
        return c.contains('"') & c.contains("=") & c.rlike(pattern)
    return c.contains(NEEDLES[pattern]) & c.rlike(pattern) if pattern in NEEDLES else c.rlike(pattern)


def check_dim(spark) -> DataFrame:
    return spark.createDataFrame([(i, c, p, security.MULTIPLIERS[p]) for i, c, p, _ in CHECKS], "check_id int, category string, priority string, multiplier double")


def text_hits(spark, d) -> DataFrame:
    """One row per line and check that fits it; one pass over the lines."""
    ids = F.filter(F.array(*(F.when(fits(p), F.lit(i)) for i, _, _, p in CHECKS)), lambda x: x.isNotNull())
    return lines(spark, d).select("doc_id", "lang", "line_no", F.explode(ids).alias("check_id"))


HITS_SQL = LINES_SQL + ", hits AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, line_no, {i} AS check_id FROM lines WHERE regexp_matches(line, '{p}')" for i, _, _, p in CHECKS) + ")"
DIM_SQL = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{p}', CAST({security.MULTIPLIERS[p]} AS DOUBLE))" for i, c, p, _ in CHECKS) + ") t(check_id, category, priority, multiplier))"


@query(f"""WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '{SECRET}') THEN 'keyword' ELSE 'hex' END AS rule
    FROM lines WHERE regexp_matches(line, '{SECRET}') OR regexp_matches(line, '{HEX}')""")
def secret_lines(spark, d):
    keyword = fits(SECRET)
    return lines(spark, d).filter(keyword | fits(HEX)).select("doc_id", "line_no", F.when(keyword, "keyword").otherwise("hex").alias("rule"))


@query(f"""WITH {HITS_SQL}, per AS (SELECT doc_id, lang, check_id, least(count(*), 2) AS n FROM hits GROUP BY ALL)
    SELECT lang, check_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS files FROM per GROUP BY lang, check_id""")
def secret_file_caps(spark, d):
    return security.totals(text_hits(spark, d).withColumnRenamed("doc_id", "file_path"), ["lang", "check_id"], 2)


@query(f"""WITH {HITS_SQL}, {DIM_SQL}, per AS (SELECT doc_id, lang, check_id, least(count(*), 100) AS n FROM hits GROUP BY ALL),
    t AS (SELECT lang, category, sum(n * multiplier) AS weighted FROM per JOIN dim USING (check_id) GROUP BY ALL),
    f AS (SELECT lang, count(*) AS files FROM documents GROUP BY lang)
    SELECT lang, category, round(weighted / files, 6) AS density, round((weighted / files) / (weighted / files + 2), 6) AS risk FROM t JOIN f USING (lang)""")
def risk_score_by_lang(spark, d):
    counted = security.totals(text_hits(spark, d).withColumnRenamed("doc_id", "file_path"), ["lang", "check_id"]).drop("files")
    n = files(spark, d).groupBy("lang").agg(F.count("*").alias("files"))
    found = security.densities(counted.join(F.broadcast(check_dim(spark)), "check_id").join(n, "lang"), ["lang", "category"], F.col("files"))
    return found.select("lang", "category", F.round("density", 6).alias("density"), F.round("risk", 6).alias("risk"))


@query(f"""WITH {HITS_SQL}, {DIM_SQL}, per AS (SELECT doc_id, check_id, least(count(*), 100) AS n FROM hits GROUP BY ALL),
    t AS (SELECT check_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS files FROM per GROUP BY check_id)
    SELECT check_id, category, priority, coalesce(total, 0) AS total, coalesce(files, 0) AS files FROM dim LEFT JOIN t USING (check_id)""")
def check_totals_priority(spark, d):
    hits = text_hits(spark, d).withColumnRenamed("doc_id", "file_path")
    return security.check_results(hits, check_dim(spark)).select("check_id", "category", "priority", "total", "files")


@query(f"""WITH {LINES_SQL}, f AS (SELECT doc_id, lang, bool_or(regexp_matches(line, '{LICENSE}')) AS lic, bool_or(regexp_matches(line, '{MAIL}')) AS mail FROM lines GROUP BY ALL)
    SELECT lang, count(*) FILTER (lic) AS licensed, count(*) FILTER (mail) AS mailed, count(*) FILTER (lic AND mail) AS both_flags, count(*) FILTER (lic AND NOT mail) AS only_license FROM f GROUP BY lang""")
def license_or_mail_flags(spark, d):
    flags = lines(spark, d).groupBy("doc_id", "lang").agg(F.bool_or(fits(LICENSE)).alias("lic"), F.bool_or(fits(MAIL)).alias("mail"))
    lic, mail = F.col("lic"), F.col("mail")
    return flags.groupBy("lang").agg(F.count_if(lic).alias("licensed"), F.count_if(mail).alias("mailed"), F.count_if(lic & mail).alias("both_flags"), F.count_if(lic & ~mail).alias("only_license"))


@query(f"""SELECT d.doc_id, d.lang FROM documents d WHERE regexp_matches(text, '{LICENSE}') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT -1, s FROM (VALUES ('no-cobol'), ('no-en')) v(s) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE 'no-' || lang = s)""")
def cooccurrence_absence(spark, d):
    docs, labels = files(spark, d), table(spark, d, "labels")
    unlabelled = docs.filter(F.col("text").rlike(LICENSE)).join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "lang")
    wanted = spark.createDataFrame([("no-cobol",), ("no-en",)], "lang string")
    absent = wanted.join(docs.select(F.concat(F.lit("no-"), "lang").alias("lang")).distinct(), "lang", "left_anti")
    return unlabelled.unionByName(absent.select(F.lit(-1).cast("long").alias("doc_id"), "lang"))


# history


@query(f"""WITH {COMMITS_SQL} SELECT author, count(*) AS commits, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(event_type, (ts, event_type)) AS name, round(sum(value), 4) AS loc_added FROM commits GROUP BY author""")
def author_stats(spark, d):
    c = commits(spark, d).select("author", F.col("event_type").alias("name"), "ts", F.col("value").alias("added"))
    return history.author_stats(c).withColumn("loc_added", F.round("loc_added", 4))


TOUCHED_SQL = COMMITS_SQL + ", touched AS (SELECT 'file' || k AS path, author, ts, event_id AS ord, event_type AS subject, k, day FROM commits)"


@query(f"""WITH {TOUCHED_SQL}, b AS (SELECT path, count(*) AS changes, min(ts) AS first_ts, max(ts) AS last_ts FROM touched GROUP BY path),
    a AS (SELECT path, string_agg(CAST(author AS VARCHAR), ',' ORDER BY r) AS top_authors FROM (SELECT path, author, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, author) AS r FROM touched GROUP BY path, author) WHERE r <= 3 GROUP BY path),
    m AS (SELECT path, string_agg(subject, ',' ORDER BY ord) AS recent_messages FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) AS r FROM touched) WHERE r <= 5 GROUP BY path)
    SELECT path, changes, first_ts, last_ts, top_authors, recent_messages FROM b LEFT JOIN a USING (path) LEFT JOIN m USING (path)""")
def file_history(spark, d):
    h = history.file_history(touched(spark, d))
    return h.withColumn("top_authors", F.array_join(F.transform("top_authors", lambda a: a.cast("string")), ",")).withColumn("recent_messages", F.array_join("recent_messages", ","))


KNOWN_SQL = "known AS (SELECT DISTINCT 'file' || s_suppkey AS path FROM supplier)"


def known_files(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.concat(F.lit("file"), F.col("s_suppkey").cast("string")).alias("path"))


@query(f"WITH {TOUCHED_SQL}, {KNOWN_SQL} SELECT author, count(DISTINCT path) AS files_modified FROM touched SEMI JOIN known USING (path) GROUP BY author")
def author_files_modified(spark, d):
    return history.files_modified(touched(spark, d), known_files(spark, d))


@query(f"""WITH {COMMITS_SQL}, a AS (SELECT author, count(*) AS commits FROM commits GROUP BY author), b AS (SELECT c_custkey AS author, count(o_orderkey) AS files_modified FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
    SELECT coalesce(a.author, b.author) AS author, coalesce(commits, 0) AS commits, coalesce(files_modified, 0) AS files_modified FROM a FULL JOIN b ON a.author = b.author""")
def author_outer_merge(spark, d):
    by_log = commits(spark, d).groupBy("author").agg(F.count("*").alias("commits"))
    by_files = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_custkey").alias("author")).agg(F.count("*").alias("files_modified"))
    return history.merged_authors(by_log, by_files)


@query(f"WITH {COMMITS_SQL} SELECT CAST(dayofweek(day) AS INTEGER) AS weekday, count(*) AS commits FROM commits GROUP BY weekday")
def weekday_histogram(spark, d):
    return history.weekdays(commits(spark, d))


@query(f"WITH {COMMITS_SQL} SELECT CAST(dayofweek(day) AS INTEGER) AS weekday, count(*) AS commits FROM commits GROUP BY weekday ORDER BY commits DESC, weekday LIMIT 1")
def peak_weekday(spark, d):
    return history.peak_weekday(history.weekdays(commits(spark, d)))


AS_OF = 1711929600  # 2024-04-01


@query(f"""WITH {COMMITS_SQL}, r AS (SELECT 'user/' || author AS name, max(ts) AS ts FROM commits GROUP BY author)
    SELECT name, ts, CAST(floor(({AS_OF} - ts) / 86400) AS BIGINT) AS days FROM r WHERE floor(({AS_OF} - ts) / 86400) > 60 ORDER BY days DESC, name LIMIT 10""")
def stale_authors(spark, d):
    refs = commits(spark, d).groupBy(F.concat(F.lit("user/"), F.col("author").cast("string")).alias("name")).agg(F.max("ts").alias("ts"))
    return history.stale(refs, F.lit(AS_OF), 60)


@query(f"""WITH {COMMITS_SQL}, s AS (SELECT CASE WHEN k % 4 = 0 THEN 'fix' WHEN k % 4 = 1 THEN 'feat(' || event_type || ')' ELSE event_type END || CASE WHEN k % 5 = 0 THEN ' ' ELSE ': ' END || k AS subject FROM commits)
    SELECT regexp_extract(subject, '^(fix|feat|view|error)(\\([^)]+\\))?!?:\\s', 1) AS prefix, count(*) AS count FROM s WHERE regexp_matches(subject, '^(fix|feat|view|error)(\\([^)]+\\))?!?:\\s') GROUP BY prefix ORDER BY count DESC, prefix LIMIT 6""")
def conventional_mix(spark, d):
    k = F.col("k")
    head = F.when(k % 4 == 0, F.lit("fix")).when(k % 4 == 1, F.concat(F.lit("feat("), "event_type", F.lit(")"))).otherwise(F.col("event_type"))
    subject = F.concat(head, F.when(k % 5 == 0, " ").otherwise(": "), k.cast("string"))
    return history.conventional(commits(spark, d).select(subject.alias("subject")), types=("fix", "feat", "view", "error"))


@query(f"WITH {COMMITS_SQL} SELECT count(*) FILTER (event_type = 'error') AS reverts, count(*) AS commits, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS rate FROM commits")
def revert_rate(spark, d):
    c = commits(spark, d).select(F.when(F.col("event_type") == "error", "Revert it").otherwise("add").alias("subject"))
    return history.reverts(c).withColumn("rate", F.round("rate", 9))


@query(f"WITH {TOUCHED_SQL} SELECT path, count(*) AS changes FROM touched GROUP BY path ORDER BY changes DESC, path LIMIT 25")
def churn_topk(spark, d):
    return history.churn(touched(spark, d))


@query(f"WITH {TOUCHED_SQL} SELECT author, count(*) AS commits, count(DISTINCT path) AS files_modified FROM touched GROUP BY author ORDER BY commits DESC, files_modified DESC, author LIMIT 15")
def team_topk(spark, d):
    return history.team(touched(spark, d).groupBy("author").agg(F.count("*").alias("commits"), F.countDistinct("path").alias("files_modified")))


@query(f"""WITH {TOUCHED_SQL} SELECT author, path, n FROM (SELECT author, path, count(*) AS n, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, path) AS r FROM touched GROUP BY author, path) WHERE r <= 3""")
def top_modules_per_author(spark, d):
    per = touched(spark, d).groupBy("author", "path").agg(F.count("*").alias("n"))
    return top_per(per, ["author"], [F.col("n").desc(), F.col("path")], 3)


@query("SELECT d.doc_id, coalesce(l.n, 0) AS changes, coalesce(l.q, -1) AS quality FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id)")
def file_enrichment_left(spark, d):
    hist = table(spark, d, "labels").groupBy(F.col("doc_id").alias("path")).agg(F.count("*").alias("changes"), F.max("quality").alias("quality"))
    return history.enriched(files(spark, d).select(F.col("doc_id").alias("path")), hist).withColumnRenamed("path", "doc_id").withColumn("quality", F.coalesce("quality", F.lit(-1)))


STEP = 3 * 86400


@query(f"""WITH {COMMITS_SQL}, t AS (SELECT (SELECT max(ts) FROM commits) - s * {STEP} AS target, s FROM range(0, 20) r(s)),
    b AS (SELECT s, arg_min((ts, event_id), (abs(ts - target), ts, event_id)) AS c FROM t, commits WHERE abs(ts - target) < {STEP} GROUP BY s)
    SELECT DISTINCT c[2] AS hash, c[1] AS ts FROM b""".replace("c[2]", "struct_extract(c, 2)").replace("c[1]", "struct_extract(c, 1)"))
def snapshot_nearest(spark, d):
    return history.sampled(commits(spark, d).select(F.col("event_id").alias("hash"), "ts"), STEP).select("hash", "ts")


@query(f"""WITH {COMMITS_SQL}, s AS (SELECT day, count(DISTINCT k) AS files FROM commits GROUP BY day)
    SELECT arg_min(files, day) AS first_files, arg_max(files, day) AS last_files, round(100.0 * (arg_max(files, day) - arg_min(files, day)) / arg_min(files, day), 6) AS growth FROM s""")
def daily_growth(spark, d):
    s = commits(spark, d).groupBy(F.col("day").alias("ts")).agg(F.countDistinct("k").alias("files"))
    return history.growth(s).withColumn("growth", F.round("growth", 6))


@query("""WITH m AS (SELECT date_diff('day', o_orderdate, l_shipdate) AS a, l_quantity AS b, l_linenumber * 24.0 AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT round(coalesce(avg(a) FILTER (a >= 0 AND a < 365), 0), 6) AS lifetime_days, round(coalesce(avg(b) FILTER (b >= 0 AND b < 730), 0), 6) AS time_to_merge_days, round(coalesce(avg(c) FILTER (c >= 0 AND c < 8760), 0), 6) AS delay_hours FROM m""")
def merge_timing(spark, d):
    m = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    m = m.select(F.datediff("l_shipdate", "o_orderdate").alias("lifetime_days"), F.col("l_quantity").alias("time_to_merge_days"), (F.col("l_linenumber") * 24.0).alias("delay_hours"))
    out = history.merge_timing(m)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("SELECT count(*) >= 2 AS dual_merges FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def dual_merge_intersection(spark, d):
    a = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("subject"))
    b = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("subject"))
    return history.dual_merges(a, b)


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{LICENSE}') UNION SELECT doc_id FROM documents WHERE regexp_matches(text, '{MAIL}')")
def evidence_union(spark, d):
    f = files(spark, d)
    return f.filter(F.col("text").rlike(LICENSE)).select("doc_id").union(f.filter(F.col("text").rlike(MAIL)).select("doc_id")).distinct()


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def reported_except(spark, d):
    return table(spark, d, "part").select("p_partkey").exceptAll(table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("p_partkey")).distinct())


# graph


@query(f"WITH {PAIRS_SQL} SELECT DISTINCT src, dst FROM pairs WHERE src <> dst AND dst IN (SELECT s_nationkey FROM supplier) AND src IN (SELECT s_nationkey FROM supplier)")
def edge_dedupe(spark, d):
    known = table(spark, d, "supplier").select(F.col("s_nationkey").alias("id")).distinct()
    return graph.clean(nation_pairs(spark, d), known)


@query(f"WITH {EDGES_SQL} SELECT n_nationkey AS id, (SELECT count(*) FROM edges WHERE dst = n_nationkey) AS in_degree, (SELECT count(*) FROM edges WHERE src = n_nationkey) AS out_degree FROM nation")
def degrees(spark, d):
    return graph.degrees(vertices(spark, d), edges(spark, d))


def _pagerank_sql(edges_sql: str, rounds: int = graph.ROUNDS) -> str:
    steps = ["n AS MATERIALIZED (SELECT count(*) AS n FROM nation)", "w AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o FROM edges)", "r0 AS (SELECT n_nationkey AS id, 1.0::DOUBLE / n AS score FROM nation, n)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT v.n_nationkey AS id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * coalesce(g, 0) AS score FROM nation v CROSS JOIN n LEFT JOIN (SELECT dst, sum(score / o) AS g FROM w JOIN r{i - 1} ON id = src GROUP BY dst) t ON t.dst = v.n_nationkey)")
    return f"WITH {edges_sql}, " + ", ".join(steps)


DAG_SQL = EDGES_SQL.replace("WHERE r <= 5", "WHERE r <= 5 AND src < dst")


def dag(spark, d) -> DataFrame:
    return edges(spark, d).filter("src < dst")


@query(_pagerank_sql(DAG_SQL) + " SELECT id, round(score, 9) AS score FROM r20")
def pagerank_nations(spark, d):
    return graph.pagerank(vertices(spark, d), dag(spark, d)).withColumn("score", F.round("score", 9))


@query(_pagerank_sql(EDGES_SQL) + " SELECT id, round(score, 9) AS score FROM r20 ORDER BY round(score, 12) DESC, id LIMIT 10")
def hotspots_topk(spark, d):
    return graph.hotspots(graph.pagerank(vertices(spark, d), edges(spark, d)), 10).withColumn("score", F.round("score", 9))


LEVELS_SQL = DAG_SQL + """, l AS (SELECT n_nationkey AS id, CAST(coalesce(max(depth), 0) AS INTEGER) AS level FROM nation LEFT JOIN paths ON node = n_nationkey GROUP BY n_nationkey)"""
PATHS_SQL = "paths(node, depth) AS (SELECT n_nationkey, 0 FROM nation UNION SELECT dst, depth + 1 FROM paths JOIN edges ON src = node)"


def _levels_sql(select: str) -> str:
    return f"WITH RECURSIVE {DAG_SQL}, {PATHS_SQL}, l AS (SELECT n_nationkey AS id, CAST(coalesce(max(depth), 0) AS INTEGER) AS level FROM nation LEFT JOIN paths ON node = n_nationkey GROUP BY n_nationkey) {select}"


@query(_levels_sql("SELECT id, level, row_number() OVER (ORDER BY level, id) AS position FROM l"))
def topo_levels(spark, d):
    return graph.topological_order(graph.levels(vertices(spark, d), dag(spark, d)))


@query(_levels_sql("""SELECT id, -row_number() OVER (ORDER BY level, id) AS place, CASE WHEN id NOT IN (SELECT src FROM edges) THEN 'Fundamental' WHEN id NOT IN (SELECT dst FROM edges) THEN 'Entry Point' ELSE 'Core Logic' END AS category FROM l"""))
def learning_path(spark, d):
    return graph.learning_path(vertices(spark, d), dag(spark, d))


@query(f"WITH {EDGES_SQL} SELECT least(a.n_regionkey, b.n_regionkey) AS a, greatest(a.n_regionkey, b.n_regionkey) AS b, count(*) AS connections FROM edges JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2")
def package_graph(spark, d):
    return graph.collapsed(edges(spark, d), table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("grp")))


@query("""WITH i AS (SELECT l_orderkey AS path, s_nationkey AS name, c_nationkey AS package FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
    SELECT name, count(DISTINCT path) AS files, count(DISTINCT package) AS packages FROM i WHERE name <> package AND name IN (SELECT DISTINCT c_nationkey FROM customer) GROUP BY name ORDER BY files DESC, name LIMIT 20""")
def penetration(spark, d):
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    i = li.select("l_orderkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    i = i.select(F.col("l_orderkey").alias("path"), F.col("s_nationkey").alias("name"), F.col("c_nationkey").alias("package"))
    return graph.penetration(i, c.select(F.col("c_nationkey").alias("package")))


@query("""WITH tok AS (SELECT DISTINCT lang AS package, doc_id AS path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM documents),
    names AS (SELECT DISTINCT lang AS package, doc_id AS path, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') AS name FROM documents)
    SELECT DISTINCT t.path AS src, n.path AS dst FROM tok t JOIN names n ON t.package = n.package AND t.token = n.name WHERE length(n.name) >= 4 AND length(token) >= 4 AND t.path <> n.path""")
def token_join_edges(spark, d):
    f = files(spark, d)
    tokens = f.select(F.col("lang").alias("package"), F.col("doc_id").alias("path"), F.explode(T.identifiers(F.col("text"), ascii_only=True)).alias("token"))
    types = f.select(F.col("lang").alias("package"), F.col("doc_id").alias("path"), F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]*", 0).alias("name"))
    return graph.type_edges(tokens, types)


IMPORTS_SQL = "f AS (SELECT p_partkey AS path, split_part(p_name, ' ', 2) AS stem, p_brand AS module FROM part), i AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'Lib.' || split_part(p_name, ' ', 2) ELSE p_brand END AS name FROM part)"


@query(f"""WITH {IMPORTS_SQL}, t AS (SELECT name, max(path) AS target FROM (SELECT stem AS name, path FROM f UNION ALL SELECT module, path FROM f) GROUP BY name)
    SELECT DISTINCT i.path AS src, coalesce(a.target, b.target) AS dst FROM i LEFT JOIN t a ON a.name = i.name LEFT JOIN t b ON b.name = regexp_extract(i.name, '[^.]*$') WHERE coalesce(a.target, b.target) IS NOT NULL AND coalesce(a.target, b.target) <> i.path""")
def import_fallback_join(spark, d):
    p = table(spark, d, "part")
    word = F.split("p_name", " ")[1]
    f = p.select(F.col("p_partkey").alias("path"), word.alias("stem"), F.col("p_brand").alias("module"), F.col("p_partkey").alias("ordinal"))
    i = p.select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Lib."), word)).otherwise(F.col("p_brand")).alias("name"))
    return graph.import_edges(f, i)


@query("""WITH t AS (SELECT DISTINCT lang AS package, doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM documents),
    n AS (SELECT lang AS package, doc_id, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') AS name FROM documents),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY doc_id DESC, name) AS r FROM n WHERE length(name) >= 4) WHERE r <= 100),
    s AS (SELECT package, doc_id, name FROM c WHERE doc_id % 3 = 0)
    SELECT DISTINCT s.package, s.name AS src, c.name AS dst FROM s JOIN t ON s.doc_id = t.doc_id AND s.package = t.package JOIN c ON c.package = s.package AND c.name = t.token WHERE c.name <> s.name""")
def declaration_graph(spark, d):
    """A type per document, every third a class; classes name others, structs are named only."""
    f = files(spark, d).withColumn("name", F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]*", 0))
    decls = f.select(F.col("lang").alias("package"), F.col("doc_id").alias("path"), "name", F.when(F.col("doc_id") % 3 == 0, "class").otherwise("struct").alias("kind"), F.col("doc_id").alias("score"))
    tokens = f.select(F.col("lang").alias("package"), F.col("doc_id").alias("path"), F.explode(T.identifiers(F.col("text"), 1, ascii_only=True)).alias("token"))
    return graph.declaration_graph(decls, tokens).select("package", "src", "dst")


@query("SELECT n_nationkey AS id, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 7 AS BIGINT) AS chunk FROM nation")
def chunks(spark, d):
    return chunked(vertices(spark, d), [F.col("id")], 7)


@query("SELECT p_partkey, p_name FROM part WHERE split_part(p_name, ' ', 1) NOT IN ('red', 'old')")
def vendored_anti(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("repo/"), F.replace("p_name", F.lit(" "), F.lit("/"))).alias("file_path"))
    names = spark.createDataFrame([("red",), ("old",)], "name string")
    return packages.without_vendored(p, names).select("p_partkey", "p_name")


# rules

SUFFIXES = [("t", "short"), ("lt", "pair"), ("bolt", "fastener"), ("ring", "ring"), ("r", "end"), ("ear", "gear-like"), ("widget", "widget"), ("o", "vowel")]
SUFFIX_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SUFFIXES) + ") t(suffix, label))"


@query(f"WITH {SUFFIX_SQL} SELECT p_partkey, arg_max(suffix, length(suffix)) AS suffix, arg_max(label, length(suffix)) AS label FROM part JOIN rules ON ends_with(p_name, suffix) GROUP BY p_partkey")
def suffix_rule_longest(spark, d):
    rules = spark.createDataFrame(SUFFIXES, "suffix string, label string")
    return matching.longest_suffix(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), rules, ["p_partkey"])


TOKEN_RULES = [(1, "Red Widget", ["red", "widget"], ["big"], []), (2, "Widget", ["widget"], [], []), (3, "Hot", ["hot"], ["gear"], []), (4, "Small In Context", ["small"], [], ["ring", "bolt"]), (5, "Small", ["small"], [], []), (6, "Blue Bolt", ["blue", "bolt"], [], [])]


def _token_rule_sql() -> str:
    show = lambda a: "[" + ", ".join(f"'{x}'" for x in a) + "]::VARCHAR[]"
    return "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {show(t)}, {show(b)}, {show(c)})" for i, n, t, b, c in TOKEN_RULES) + ") v(ordinal, label, tokens, blockers, context))"


@query(f"""WITH {_token_rule_sql()}, n AS (SELECT p_partkey, string_split(p_name, ' ') AS have FROM part)
    SELECT p_partkey, ordinal, label FROM (SELECT p_partkey, ordinal, label, row_number() OVER (PARTITION BY p_partkey ORDER BY len(tokens) DESC, length(array_to_string(tokens, '')) DESC, ordinal) AS r
    FROM n JOIN rules ON list_has_all(have, tokens) AND NOT list_has_any(have, blockers) AND (len(context) = 0 OR list_has_any(have, context))) WHERE r = 1""")
def token_rule_specificity(spark, d):
    rules = spark.createDataFrame(TOKEN_RULES, "ordinal int, label string, tokens array<string>, blockers array<string>, context array<string>")
    return matching.token_rules(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), rules, ["p_partkey"])


CONSTANT_SQL = "consts AS (SELECT p_partkey * 1000 + 70000 AS value, p_brand AS label FROM part)"


@query(f"""WITH {CONSTANT_SQL}, named AS (SELECT value, string_agg(DISTINCT label, ' / ' ORDER BY label) AS label FROM consts GROUP BY value),
    toks AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) // 1000 * 1000 AS value FROM orders) SELECT o_orderkey, value, label FROM toks JOIN named USING (value) WHERE value >= 65536""")
def numeric_constants(spark, d):
    consts = table(spark, d, "part").select((F.col("p_partkey") * 1000 + 70000).alias("value"), F.col("p_brand").alias("label"))
    toks = table(spark, d, "orders").select("o_orderkey", (F.floor(F.floor("o_totalprice") / 1000) * 1000).cast("long").alias("value"), F.lit(False).alias("is_hex"))
    return matching.constants(toks, consts).select("o_orderkey", "value", "label")


LAYER_PATH_SQL = "CASE doc_id % 7 WHEN 0 THEN '/repo/api/' WHEN 1 THEN '/repo/Models/' WHEN 2 THEN '/repo/x/' WHEN 3 THEN '/repo/storage/' WHEN 4 THEN '/repo/utils/' WHEN 5 THEN '/repo/config/' ELSE '/repo/auth/' END || source || CASE doc_id % 5 WHEN 0 THEN 'View' WHEN 1 THEN 'ViewModel' WHEN 2 THEN 'Tests' WHEN 3 THEN 'Client' ELSE 'Thing' END || '.swift'"


def layered(spark, d) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("api", "Models", "x", "storage", "utils", "config", "auth"))), (F.col("doc_id") % 7 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("View", "ViewModel", "Tests", "Client", "Thing"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/repo/"), folder, F.lit("/"), "source", kind, F.lit(".swift"))
    return files(spark, d).select("doc_id", path.alias("file_path"), F.size(T.lines_of(F.col("text"))).alias("line_count"), "lang")


LAYER_SQL = """CASE WHEN ends_with(n, 'tests') THEN 'Tests' WHEN contains(p, '/api/') OR ends_with(n, 'client') THEN 'API / Networking'
    WHEN contains(p, '/models/') OR ends_with(n, 'model') THEN 'Models' WHEN ends_with(n, 'view') THEN 'UI / Views' WHEN contains(p, '/storage') THEN 'Persistence'
    WHEN contains(p, '/auth') THEN 'Auth' WHEN contains(p, '/util') THEN 'Utilities' WHEN contains(p, '/config') THEN 'Config' ELSE 'Core' END"""


@query(f"""WITH f AS (SELECT lower({LAYER_PATH_SQL}) AS p, len(string_split(text, chr(10))) AS c FROM documents), g AS (SELECT p, c, regexp_extract(p, '([^/]*)[.]swift$', 1) AS n FROM f)
    SELECT {LAYER_SQL} AS layer, count(*) AS files, CAST(sum(c) AS BIGINT) AS lines FROM g GROUP BY layer""")
def layer_classifier(spark, d):
    return architecture.layer_totals(layered(spark, d))


@query("SELECT p_brand AS package, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS lines, " + ", ".join(f"count(*) FILTER (p_type = '{t}') AS n_{t.lower()}" for t in ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")) + " FROM part GROUP BY p_brand")
def package_kinds_pivot(spark, d):
    kinds = dict(zip(("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"), packages.KINDS, strict=True))
    p = table(spark, d, "part")
    of = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    found = packages.totals(
        p.select(F.col("p_partkey").alias("file_path"), F.col("p_brand").alias("package_name"), F.col("p_size").alias("line_count")),
        p.select(F.col("p_partkey").alias("file_path"), of[F.col("p_type")].alias("kind")),
    )
    return found.select("package", "files", "lines", *(F.col(k).alias(f"n_{t.lower()}") for t, k in kinds.items()))


@query(f"""WITH {LINES_SQL} SELECT source AS module, count(*) FILTER (regexp_matches(line, '{LICENSE}')) AS todo, count(*) FILTER (regexp_matches(line, '{MAIL}')) AS fixme FROM lines GROUP BY source
    HAVING count(*) FILTER (regexp_matches(line, '{LICENSE}') OR regexp_matches(line, '{MAIL}')) > 0 ORDER BY todo + fixme DESC, module LIMIT 50""")
def todo_density(spark, d):
    per = lines(spark, d).groupBy("doc_id", F.col("source").alias("package_name")).agg(F.count_if(F.col("line").rlike(LICENSE)).alias("todo_count"), F.count_if(F.col("line").rlike(MAIL)).alias("fixme_count"))
    return packages.notes_by_module(per)


# windows


@query("SELECT conv_id, turn, role, lag(role) OVER w AS last_role, coalesce(lag(role) OVER w = role, false) AS repeated FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context_lag(spark, d):
    last = previous(F.col("role"), ["conv_id"], "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", last.alias("last_role"), F.coalesce(last == F.col("role"), F.lit(False)).alias("repeated"))


def _frame_sql(first: int, last: int) -> str:
    bound = lambda n: f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING" if n > 0 else "CURRENT ROW"
    return f"SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {bound(first)} AND {bound(last)}), ' ') AS context FROM conversations"


def _framed(spark, d, first, last):
    return table(spark, d, "conversations").select("conv_id", "turn", frame(F.col("role"), ["conv_id"], "turn", first, last).alias("context"))


@query(_frame_sql(0, 2))
def lookahead_window(spark, d):
    return _framed(spark, d, 0, 2)


@query(_frame_sql(-4, 5))
def symmetric_window(spark, d):
    return _framed(spark, d, -4, 5)


PAGE_LINES_SQL = "pl AS (SELECT page_id, i AS line_no, parts[i] AS line FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, string_split(html, '>') AS parts FROM pages)))"


def page_lines(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", ">", -1)).alias("at", "line")).select("page_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


@query(f"""WITH {PAGE_LINES_SQL}, m AS (SELECT page_id, line_no, length(line) - length(replace(line, '"', '')) AS marks FROM pl)
    SELECT page_id, count(*) FILTER (odd) AS inside, count(*) AS lines FROM (SELECT page_id, sum(marks) OVER (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) % 2 = 1 AS odd FROM m) GROUP BY page_id""")
def running_parity(spark, d):
    marks = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = parity(marks, ["page_id"], "line_no")
    return page_lines(spark, d).select("page_id", odd.alias("odd")).groupBy("page_id").agg(F.count_if("odd").alias("inside"), F.count("*").alias("lines"))


@query(f"""WITH {PAGE_LINES_SQL}, m AS (SELECT page_id, line_no, (length(line) - length(replace(line, chr(123), ''))) - (length(line) - length(replace(line, chr(125), ''))) AS net FROM pl)
    SELECT page_id, CAST(max(depth) AS BIGINT) AS deepest, CAST(arg_max(depth, line_no) AS BIGINT) AS final FROM (SELECT page_id, line_no, sum(net) OVER (PARTITION BY page_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS depth FROM m) GROUP BY page_id""")
def brace_depth_max(spark, d):
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    depth = running((count("{") - count("}")).cast("long"), ["page_id"], "line_no")
    per = page_lines(spark, d).select("page_id", "line_no", depth.alias("depth"))
    return per.groupBy("page_id").agg(F.max("depth").alias("deepest"), F.max_by("depth", "line_no").alias("final"))


EXTENTS_SQL = "ext AS (SELECT l_orderkey AS file, min(l_linenumber) AS s, max(l_linenumber) AS e, l_returnflag AS name FROM lineitem GROUP BY l_orderkey, l_returnflag), pts AS (SELECT DISTINCT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)"


@query(f"""WITH {EXTENTS_SQL} SELECT p.file, p.line, coalesce(arg_min(name, (e - s, name)), '(top level)') AS symbol FROM pts p LEFT JOIN ext x ON p.file = x.file AND p.line BETWEEN s + 1 AND e GROUP BY p.file, p.line""")
def range_join_innermost(spark, d):
    li = table(spark, d, "lineitem")
    ext = li.groupBy(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("name")).agg((F.min("l_linenumber") + 1).alias("s"), F.max("l_linenumber").alias("e"))
    pts = li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line")).distinct()
    return matching.innermost(pts, ext, ["file"], "line", "s", "e", "name").select("file", "line", "symbol")


# urls


@query("""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '://([^/?#:]*)', 1) AS host,
    regexp_extract(url, '://[^/?#:]*:([0-9]+)', 1) AS port, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages""")
def url_parts(spark, d):
    parts = T.url_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in parts.items()))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS proto, regexp_extract(url, '://([^/?#:]*)', 1) AS uri, page_id % 3 AS module FROM pages),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri, proto, module ORDER BY page_id) AS r FROM u) WHERE r = 1)
    SELECT proto, uri, count(*) AS sites, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS calls FROM f GROUP BY proto, uri""")
def traffic_grouped(spark, d):
    parts = T.url_parts(F.col("url"))
    u = table(spark, d, "pages").select("page_id", parts["scheme"].alias("proto"), parts["host"].alias("uri"), (F.col("page_id") % 3).alias("module"))
    first = top_per(u, ["uri", "proto", "module"], [F.col("page_id")], 1)
    found = traffic.grouped(first.select(F.lit("out").alias("direction"), "proto", "uri", F.col("page_id").alias("file_path"), F.lit(1).alias("line"), "module"))
    return found.select("proto", "uri", "sites", F.array_join(F.transform("calls", lambda c: c["file_path"].cast("string")), ",").alias("calls"))


# scores

STYLE_SQL = {
    "classes": "count(*) FILTER (p_type = 'ECONOMY')", "structs": "count(*) FILTER (p_type = 'SMALL')", "protocols": "count(*) FILTER (p_type = 'MEDIUM')", "enums": "count(*) FILTER (p_type = 'PROMO')",
    "generics": "count(*) FILTER (p_size < 5)", "conform_one": "count(*) FILTER (p_size BETWEEN 5 AND 14)", "conform_many": "count(*) FILTER (p_size BETWEEN 15 AND 19)", "extended": "count(*) FILTER (p_size = 20)",
    "associated": "count(*) FILTER (p_size = 21)", "opaque": "count(*) FILTER (p_size = 22)", "composed": "count(*) FILTER (p_size = 23)", "finals": "count(*) FILTER (p_type = 'ECONOMY' AND p_size > 25)",
    "enum_payloads": "count(*) FILTER (p_type = 'PROMO' AND p_size > 40)", "depth_sum": "count(*) FILTER (p_size = 30) * 2", "depth_count": "count(*) FILTER (p_size = 30)", "overrides": "count(*) FILTER (p_size = 31)",
    "root_objects": "count(*) FILTER (p_size = 32)", "implemented": "count(*) FILTER (p_size IN (20, 33))",
}


@query(f"""WITH c AS (SELECT {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in STYLE_SQL.items())} FROM part),
    s AS (SELECT least(4 * protocols / (classes + structs), 1) AS density, least(generics / greatest(floor((classes + structs) / 5), 1), 1) AS generic, conform_many / (conform_one + conform_many) AS breadth,
        least(extended / implemented, 1) AS defaults, least(associated / greatest(floor(protocols / 4), 1), 1) AS assoc, least(opaque / protocols, 1) AS opaq, least(composed / greatest(floor(protocols / 2), 1), 1) AS comp,
        structs / (classes + structs) AS struct_ratio, least(finals, classes) / classes AS final_ratio, least(enum_payloads / greatest(floor(enums * 0.3), 1), 1) AS payload,
        1 - least(greatest(depth_sum / depth_count - 1, 0) / 4, 1) AS depth, greatest(1 - overrides / (classes * 3), 0) AS override, greatest(1 - root_objects / classes, 0) AS roots FROM c),
    t AS (SELECT .25 * density + .15 * generic + .20 * breadth + .15 * defaults + .10 * assoc + .10 * opaq + .05 * comp AS protocol_score, .45 * struct_ratio + .30 * final_ratio + .25 * payload AS value_score, .40 * depth + .35 * override + .25 * roots AS inheritance_score FROM s)
    SELECT round(protocol_score, 6) AS protocol_score, round(value_score, 6) AS value_score, round(inheritance_score, 6) AS inheritance_score,
        CAST(floor(least(greatest((.55 * protocol_score + .30 * value_score + .15 * inheritance_score) * 100, 0), 100)) AS INTEGER) AS total FROM t""")
def style_scores(spark, d):
    p = table(spark, d, "part")
    kind = lambda k: F.count_if(F.col("p_type") == k)
    size = lambda *n: F.count_if(F.col("p_size").isin(*n))
    counts = p.agg(
        kind("ECONOMY").alias("classes"), kind("SMALL").alias("structs"), kind("MEDIUM").alias("protocols"), kind("PROMO").alias("enums"),
        F.count_if(F.col("p_size") < 5).alias("generics"), F.count_if(F.col("p_size").between(5, 14)).alias("conform_one"), F.count_if(F.col("p_size").between(15, 19)).alias("conform_many"), size(20).alias("extended"),
        size(21).alias("associated"), size(22).alias("opaque"), size(23).alias("composed"), F.count_if((F.col("p_type") == "ECONOMY") & (F.col("p_size") > 25)).alias("finals"),
        F.count_if((F.col("p_type") == "PROMO") & (F.col("p_size") > 40)).alias("enum_payloads"), (size(30) * 2).alias("depth_sum"), size(30).alias("depth_count"), size(31).alias("overrides"), size(32).alias("root_objects"), size(20, 33).alias("implemented"),
    )
    return style.scores(counts).select(F.round("protocol_score", 6).alias("protocol_score"), F.round("value_score", 6).alias("value_score"), F.round("inheritance_score", 6).alias("inheritance_score"), "total")


@query(f"""WITH {COMMITS_SQL}, f AS (SELECT count(*) AS c, bool_or(event_type = 'view') AS integration, count(DISTINCT k) FILTER (k % 10 = 0) AS releases, count(*) FILTER (k % 17 = 3) AS hotfixes,
        count(*) FILTER (event_type = 'error') / count(*) AS ratio, count(*) / count(DISTINCT author) / 30.0 AS life, count(*) FILTER (event_type = 'error') / 30.0 AS rate FROM commits),
    s AS (SELECT unnest([{{'model': 'Gitflow', 'score': 40.0 + 25 + 18 + 35 + CASE WHEN ratio > .7 THEN 15 ELSE 0 END + CASE WHEN life >= 3 THEN 15 ELSE 0 END + CASE WHEN rate > 0 AND rate < .5 THEN 10 ELSE 0 END}},
        {{'model': 'Trunk-Based', 'score': greatest(-20.0 + CASE WHEN ratio > 0 AND ratio < .2 THEN 20 ELSE 0 END + CASE WHEN life > 0 AND life < 1 THEN 25 WHEN life >= 1 AND life < 3 THEN 8 ELSE 0 END + CASE WHEN rate > 3 THEN 30 WHEN rate > 1 THEN 8 ELSE 0 END, 0)}},
        {{'model': 'GitHub Flow', 'score': greatest(-10.0 + CASE WHEN ratio BETWEEN .3 AND .7 THEN 5 ELSE 0 END + CASE WHEN life > 0 AND life < 1 THEN 8 WHEN life >= 1 AND life < 3 THEN 20 ELSE 0 END + CASE WHEN rate > 1 AND rate <= 3 THEN 20 ELSE 0 END, 0)}},
        {{'model': 'GitLab Flow', 'score': 0.0 + CASE WHEN ratio BETWEEN .3 AND .7 THEN 8 ELSE 0 END + CASE WHEN life >= 1 AND life < 3 THEN 8 ELSE 0 END + CASE WHEN rate > 1 AND rate <= 3 THEN 8 ELSE 0 END}},
        {{'model': 'OneFlow', 'score': 5.0 + CASE WHEN ratio > 0 AND ratio < .2 THEN 5 ELSE 0 END + CASE WHEN rate > 0 AND rate < .5 THEN 5 ELSE 0 END}}]) AS x FROM f)
    SELECT x.model AS model, CAST(x.score AS DOUBLE) AS score, round(x.score / sum(x.score) OVER (), 6) AS share FROM s""")
def branching_scores(spark, d):
    c = commits(spark, d)
    error, n = F.count_if(F.col("event_type") == "error"), F.count("*")
    feats = c.agg(
        n.alias("main_commits"), F.bool_or(F.col("event_type") == "view").alias("has_integration"), F.countDistinct(F.when(F.col("k") % 10 == 0, F.col("k"))).alias("releases"), F.count_if(F.col("k") % 17 == 3).alias("hotfixes"),
        F.lit(True).alias("dual_merges"), (error / n).alias("merge_ratio"), (n / F.countDistinct("author") / 30.0).alias("lifetime_days"), (error / 30.0).alias("merges_per_day"), F.lit(0).alias("env_branches"), F.lit(False).alias("cascades"),
    )
    return history.branching_scores(feats).withColumn("share", F.round("share", 6))


ROLE_SQL = f"f AS (SELECT doc_id, lower({LAYER_PATH_SQL}) AS p, len(string_split(text, chr(10))) AS c FROM documents), g AS (SELECT doc_id, p, c, regexp_extract(p, '([^/]*)[.]swift$', 1) AS n FROM f)"
ROLES_SQL = ROLE_SQL + """, r AS (SELECT 'model' AS role, * FROM g WHERE ends_with(n, 'model') OR contains(p, '/models/') UNION ALL SELECT 'view', * FROM g WHERE ends_with(n, 'view')
    UNION ALL SELECT 'viewModel', * FROM g WHERE ends_with(n, 'viewmodel'))"""


@query(f"WITH {ROLES_SQL} SELECT role, count(*) AS files, CAST(sum(c) AS BIGINT) AS lines FROM r GROUP BY role")
def role_stats(spark, d):
    f = layered(spark, d).withColumn("imports", F.array().cast("array<string>"))
    none = spark.createDataFrame([], "file_path string, name string, kind string")
    return architecture.role_stats(f, none).filter("files > 0").select("role", "files", "lines")


@query(f"""WITH {ROLES_SQL}, t AS (SELECT count(*) FILTER (role = 'viewModel') AS vm, count(*) FILTER (role = 'model') AS m, count(*) FILTER (role = 'view') AS v FROM r)
    SELECT 'MVVM' AS pattern, round(CAST(CASE WHEN v >= 20 AND vm < greatest(1, v // 100) THEN 0 ELSE least(.40 + .20 + .15 + .15, 1) END AS DOUBLE), 6) AS score FROM t WHERE vm >= 3 AND m >= 2""")
def arch_threshold_topk(spark, d):
    f = layered(spark, d).withColumn("imports", F.array().cast("array<string>"))
    none = spark.createDataFrame([], "file_path string, name string, kind string")
    return architecture.patterns(f, none).select("pattern", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT lang AS ext, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents)
    SELECT ext, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS largest FROM a GROUP BY ext""")
def asset_totals(spark, d):
    assets = files(spark, d).select(F.col("doc_id").cast("string").alias("rel_path"), F.col("doc_id").alias("ord"), F.col("lang").alias("ext"), F.col("n_chars").alias("size_bytes"))
    return architecture.asset_totals(assets)


@query(f"""WITH {EDGES_SQL}, s AS (SELECT 7 AS id), a AS (SELECT DISTINCT src AS id FROM edges JOIN s ON dst = id WHERE src NOT IN (SELECT id FROM s)),
    b AS (SELECT DISTINCT src AS id FROM edges JOIN a ON dst = id WHERE src NOT IN (SELECT id FROM s) AND src NOT IN (SELECT id FROM a))
    SELECT id, 0 AS depth FROM s UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b""")
def fixpoint_two_rounds(spark, d):
    return graph.spread(vertices(spark, d).filter("id = 7"), edges(spark, d))


@query(f"""WITH RECURSIVE {DAG_SQL}, par AS (SELECT src AS id, min(dst) AS parent FROM edges GROUP BY src), ch(id, top, depth) AS (SELECT id, parent, 1 FROM par UNION ALL SELECT ch.id, par.parent, depth + 1 FROM ch JOIN par ON ch.top = par.id)
    SELECT id, CAST(max(depth) AS INTEGER) AS depth FROM ch GROUP BY id""")
def inheritance_depth(spark, d):
    parent = dag(spark, d).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))
    return graph.chain_depths(parent)


@query("""WITH v AS (SELECT l_suppkey AS file, l_returnflag AS symbol, l_linenumber AS ord, l_orderkey AS line, CAST(floor(l_quantity / 10) AS INTEGER) AS o FROM lineitem),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, symbol ORDER BY o DESC, line, ord) AS r FROM v) WHERE r = 1)
    SELECT file, symbol, line, o AS worst_order, CAST(round(100.0 * count(*) FILTER (o < 5) OVER () / count(*) OVER ()) AS INTEGER) AS health FROM b""")
def complexity_worst(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("symbol"), F.col("l_linenumber").alias("ord"), F.col("l_orderkey").alias("line"), F.floor(F.col("l_quantity") / 10).cast("int").alias("worst_order"))
    worst = top_per(v, ["file", "symbol"], [F.col("worst_order").desc(), F.col("line"), F.col("ord")], 1)
    health = worst.agg(F.round(100.0 * F.count_if(F.col("worst_order") < 5) / F.count("*")).cast("int").alias("health"))
    return worst.join(F.broadcast(health)).select("file", "symbol", "line", "worst_order", "health")


def hot_churn(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: rank of each nation in the order graph times how often its customers order."""
    ranks = graph.pagerank(vertices(spark, d), edges(spark, d))
    churn: Column = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("changes"))
    out = ranks.join(churn, "id", "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
    return out.select("id", F.round("score", 9).alias("score"), "changes", F.round(F.col("score") * F.col("changes"), 6).alias("heat")).orderBy(F.col("heat").desc(), "id")
