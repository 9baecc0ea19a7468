"""The subpackage's queries: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bitslice, bpe, infill, kmtree, mixing, pii, quality, resampling, simhash, substring, toxicity, urls, warc
from gneiss.llm.common import read_table

#: Where the public vocabulary file lies; a parameter, the file is never part of this repository.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.deduplicated(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pii.find(docs).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*(k.name for k in pii.KINDS if k.base)))
    return spans.select("doc_id", *(count(k.name) for k in pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(read_table(spark, sf_dir, "pages")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return bitslice.search(bitslice.build(vectors), vectors.filter("vec_id % 50 = 0"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary_path(), decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    return quality.judge(docs, quality.fit(docs, labels), ["doc_id"])


def op11_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return kmtree.search(kmtree.build(vectors), vectors.filter("vec_id % 20 = 0"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(read_table(spark, sf_dir, "documents"))
    output = F.col("output")
    digests = [F.sha2(output, 256).alias("output_sha256"), F.sha2(infill.restore(output, F.col("form")), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {
    "op1_substring": op1_substring,
    "op2_urls": op2_urls,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_tree": op11_tree,
    "op12_resampling": op12_resampling,
    "op13_infill": op13_infill,
}

#: Patterns of the base kinds as RE2 reads them.
_PII_SQL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "secret": r"[A-Za-z0-9_-]{20,}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}


def _near(kind: str) -> str:
    return f"regexp_matches(near, '{next(k.context for k in pii.KINDS if k.name == kind)}')"


_PII_HOLDS = {
    "email": "true",
    "ip": r"len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (len(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
    "card": """len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(regexp_replace(m, '[^0-9]', '', 'g')) + 1),
        lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT)
                       ELSE (2 * CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT)) % 10 + CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT) // 5 END)) % 10 = 0""",
    "phone": "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
    "secret": f"len(regexp_replace(m, '[^0-9]', '', 'g')) >= 4 AND len(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= 4 AND {_near('secret')}",
    "ssn": f"NOT regexp_matches(m, '^(000|666|9)') AND NOT regexp_matches(m, '-00-') AND NOT ends_with(m, '-0000') AND {_near('ssn')}",
    "iban": f"({_near('iban')} OR map({list(pii.IBAN_LENGTHS)}, {list(pii.IBAN_LENGTHS.values())})[m[:2]] = len(replace(m, ' ', ''))) AND " + """len(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1""",
}


def _pii_sql() -> str:
    kinds = list(_PII_SQL)
    parts = [
        f"""SELECT doc_id, {n} AS k, '{k}' AS kind, ms[i] AS m, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda p: len(p))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: len(p))), 0) AS BIGINT) AS s,
                lower(right(ps[i], 40) || chr(10) || left(ps[i + 1], 40)) AS near
            FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM
                (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}') AS ms, string_split_regex(coalesce(text, ''), '{p}') AS ps FROM documents))
        """
        for n, (k, p) in enumerate(_PII_SQL.items())
    ]
    holds = " ".join(f"WHEN '{k}' THEN {_PII_HOLDS[k]}" for k in kinds)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""
        WITH spans AS ({' UNION ALL '.join(parts)}), kept AS (SELECT *, kind || ':' || s || ':' || (s + len(m)) AS span FROM spans WHERE CASE kind {holds} END),
        per AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY k, s) AS spans, string_agg(span, ',' ORDER BY k, s) FILTER (kind IN ('email', 'ip', 'card', 'phone')) AS base FROM kept GROUP BY doc_id)
        SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN per USING (doc_id)
    """


def _urls_sql() -> str:
    """The template tree as SQL: one step of common tables for each level."""
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    longest = sorted(urls.RULES, key=lambda r: -len(r.text))
    by = lambda field: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, field)}'" for r in longest) + " END"
    steps, tree = [], "t0"
    for level in range(1, 5):  # paths of the tables have two or three segments; deeper ones would need more steps
        b, k, c, p, a, w, t = (f"{x}{level}" for x in "bkcpawt")
        steps.append(f"""
            {b} AS (SELECT *, parts[{level}] AS branch, greatest(len(parts) - {level}, 0) || ':' || regexp_replace(regexp_replace(coalesce(parts[{level + 1}], ''), '[0-9]+', '#', 'g'), '[^#.]+', 'a', 'g') AS kind FROM {tree}),
            {k} AS (SELECT host, template, branch, kind, count(*) AS ck, CAST(sum(blocked) AS BIGINT) AS cb, CAST(sum(allowed) AS BIGINT) AS ca FROM {b} WHERE branch IS NOT NULL GROUP BY ALL),
            {c} AS (SELECT host, template, branch, CAST(sum(ck) AS BIGINT) AS c, CAST(sum(cb) AS BIGINT) AS cb, CAST(sum(ca) AS BIGINT) AS ca FROM {k} GROUP BY ALL),
            {p} AS (SELECT *, count(*) FILTER (c * {urls.FEW} < n) OVER (PARTITION BY host, template) > {urls.FEW} AS variable FROM
                (SELECT *, CAST(sum(c) OVER q AS BIGINT) AS n, first_value(branch) OVER r AS anchor, first_value(c) OVER r AS a, first_value(cb) OVER r AS ab, first_value(ca) OVER r AS aa
                 FROM {c} WINDOW q AS (PARTITION BY host, template), r AS (PARTITION BY host, template ORDER BY c DESC, branch))),
            {a} AS (SELECT host, template, kind, ck AS ak, a FROM {k} JOIN {p} USING (host, template, branch) WHERE branch = anchor),
            {w} AS (SELECT host, template, branch, template || '/' || CASE WHEN variable AND c * {urls.FEW} < n THEN '*'
                    WHEN n > c AND (branch = anchor OR terms + (a - met) * c / a <= kinds + own - 1 + {urls.Z} * sqrt(2 * (kinds + own - 1)) + 1e-9
                        AND coalesce(abs(cb / nullif(cb + ca, 0) - ab / nullif(ab + aa, 0))
                            / sqrt(greatest((cb + ab) / nullif(cb + ca + ab + aa, 0) * (1 - (cb + ab) / nullif(cb + ca + ab + aa, 0)), 0.01) * (1 / nullif(cb + ca, 0) + 1 / nullif(ab + aa, 0))) < {urls.Z}, true)) THEN '~'
                    ELSE branch END AS longer
                FROM {p} JOIN (SELECT {k}.host, {k}.template, {k}.branch, sum(power(ck * sqrt({p}.a / c) - coalesce(ak, 0) * sqrt(c / {p}.a), 2) / (ck + coalesce(ak, 0))) AS terms,
                        CAST(sum(coalesce(ak, 0)) AS BIGINT) AS met, count(*) FILTER (ak IS NULL) AS own
                    FROM {k} JOIN {p} ON {k}.host = {p}.host AND {k}.template = {p}.template AND {k}.branch = {p}.branch
                    LEFT JOIN {a} ON {k}.host = {a}.host AND {k}.template = {a}.template AND {k}.kind = {a}.kind GROUP BY ALL) USING (host, template, branch)
                JOIN (SELECT host, template, count(*) AS kinds FROM {a} GROUP BY ALL) USING (host, template)),
            {t} AS (SELECT b.host, b.path, parts, blocked, allowed, coalesce(longer, b.template) AS template FROM {b} b LEFT JOIN {w} w ON b.host = w.host AND b.template = w.template AND b.branch = w.branch)""")
        tree = t
    return f"""
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        u AS (SELECT *, {by("text")} AS rule, {by("verdict")} AS by_rule FROM p),
        t0 AS (SELECT DISTINCT host, path, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN x IN ('*', '~') THEN '%' || x ELSE x END) AS parts,
            CAST(coalesce(by_rule = 'block', false) AS INT) AS blocked, CAST(coalesce(by_rule = 'allow', false) AS INT) AS allowed, '' AS template FROM u),
        {",".join(steps)},
        o AS (SELECT (coalesce(sum(blocked), 0) + 1.0) / (coalesce(sum(blocked), 0) + coalesce(sum(allowed), 0) + 2.0) AS overall FROM {tree}),
        h AS (SELECT host, (sum(blocked) + {urls.SMOOTH} * any_value(overall)) / (sum(blocked) + sum(allowed) + {urls.SMOOTH}) AS share FROM {tree}, o GROUP BY host),
        l AS (SELECT host, template, count(*) AS n, sum(blocked) AS tb, sum(allowed) AS ta FROM {tree} GROUP BY ALL),
        j AS (SELECT host, template, tb + ta >= {urls.COVERED} * n AND (tb + {urls.SMOOTH} * share) / (tb + ta + {urls.SMOOTH}) >= {urls.THRESHOLD} AS rejected FROM l JOIN h USING (host))
        SELECT page_id, u.host, u.path, rule, coalesce(by_rule, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
        FROM u JOIN {tree} t ON u.host = t.host AND u.path = t.path JOIN j ON j.host = t.host AND j.template = t.template
    """


ORACLE_SQL: dict[str, str] = {
    "op1_substring": r"""
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
        f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
        gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (s) WHERE first < doc_id) GROUP BY doc_id),
        o AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN gone USING (doc_id))
        SELECT doc_id, len(ws) AS n_words, len(gone) AS n_removed,
               sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
        FROM o
    """,
    "op2_urls": _urls_sql(),
    "op3_pii": _pii_sql(),
    "op8_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')) AS h
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source
        ), w AS (
            SELECT *, CAST([5, 2, 1][(r - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget FROM s
        ), l AS (
            SELECT *, cap / weight AS ratio, (budget - coalesce(sum(cap) OVER low, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER low, 0)) AS level
            FROM w WINDOW low AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT *, CASE WHEN ratio <= level THEN cap ELSE weight * (SELECT arg_min(level, (ratio, r)) FROM l WHERE ratio > level) END AS target FROM l
        ), o AS (
            SELECT d.doc_id, size, h, r, source_size, target, budget, pass,
                   (pass * source_size + sum(size) OVER (PARTITION BY r, pass ORDER BY h ROWS UNBOUNDED PRECEDING)) / weight AS finish
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) p(pass)
        ), c AS (
            SELECT *, sum(size) OVER (ORDER BY finish, h, r, pass ROWS UNBOUNDED PRECEDING) <= budget AS taken FROM o
        )
        SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN taken THEN size ELSE 0 END) AS BIGINT) AS taken
        FROM c GROUP BY doc_id, h, r, size, source_size, target
    """,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h
            FROM pages
        ), d AS (
            SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last,
                   list_transform(range(0, 160, 5), lambda b:
                       ((strpos('0123456789abcdef', h[b // 4 + 1]) - 1) * 16 + strpos('0123456789abcdef', h[b // 4 + 2]) - 1) >> (3 - b % 4) & 31) AS five
            FROM p
        )
        SELECT page_id, payload_bytes, list_aggregate(list_transform(five, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v + 1]), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < last THEN last END AS refers_to
        FROM d
    """,
    "op12_resampling": r"""
        WITH tbl AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(i, i + 9), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tbl
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS content, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        ), w AS (
            SELECT r, unnest(ws) AS w FROM d
        ), b AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
        ), v AS (
            SELECT w, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x), 2), lambda i:
                    CAST((strpos('0123456789ABCDEF', x[i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 2]) - 1 AS BIGINT))),
                lambda c, byte: xor(c >> 8, tbl[(xor(c, byte) & 255) + 1]))) % 10000 AS bucket
            FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM w UNION SELECT w FROM b)), tbl
        ), g AS (
            SELECT range AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t
            FROM range(10000) LEFT JOIN (SELECT bucket, count(*) AS s FROM w JOIN v USING (w) GROUP BY bucket) ws ON ws.bucket = range
            LEFT JOIN (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY bucket) bs ON bs.bucket = range
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + CAST(10000 AS DOUBLE)) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + CAST(10000 AS DOUBLE))))) AS BIGINT) AS gain FROM g
        ), per AS (
            SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN v USING (w) JOIN gains USING (bucket) GROUP BY r
        ), scored AS (
            SELECT r, doc_id, content, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM d LEFT JOIN per USING (r)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, content) AS nth, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND nth <= 10 * n // 100 THEN nth END AS rank FROM ranked
    """,
    "op13_infill": """
        WITH h AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, list_transform(range(4), lambda i: CAST('0x' || sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[8 * i + 1:8 * i + 8] AS BIGINT)) AS h FROM documents
        ), c AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ), p AS (
            SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM c
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM p
    """,
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5
    """,
}
