"""Queries over a repository planted from the driver's tables: one source file per part, with known constructs.

Each file gets one of a list of snippets by its part's key, so what the operators must find is known from the
key alone; the DuckDB SQL works it out from the part table, never from the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import cut
from gneiss.operators import constructs, graph, history, packages, parse, patterns, security, style, traffic
from gneiss.plans.catalogue import query, table
from gneiss.rules import names


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


#: Files planted in one task: keys are few bytes, so a split of the table holds far more of them than a task should parse.
FILES_PER_TASK = 5000


def dealt(rows: DataFrame, key: str, per_task: int = FILES_PER_TASK) -> DataFrame:
    """rows dealt by their key to tasks of about so many rows, however few bytes they have."""
    return rows.repartition(max(1, -(-rows.count() // per_task)), key)


def planted(spark, d, snippets: list[tuple[str, str]]) -> DataFrame:
    """(file_path, text): file k of a part's key has snippet k % n; ``{k}`` in it is the key.

    Files are dealt by their path, where each has one of its own, so that what groups by it shuffles no further.
    """
    k = F.col("p_partkey")
    at = (k % len(snippets) + 1).cast("int")
    pick = lambda i: F.replace(F.element_at(F.array(*(F.lit(s[i]) for s in snippets)), at), F.lit("{k}"), k.cast("string"))
    named = table(spark, d, "part").select("p_partkey", pick(0).alias("file_path"))
    return dealt(named, "file_path" if all("{k}" in path for path, *_ in snippets) else "p_partkey").select("file_path", pick(1).alias("text"))


# security checks: (path, text, what is found as (check, line))

SECRET = "04dbebab91ab85687d33eeaaf9ac699e"
CHECKED = [
    ("src/C{k}.swift", 'let password = "Zq8!kkPw27"', [(1, 1), (26, 1)]),
    ("src/C{k}.swift", 'UserDefaults.standard.set(a, forKey: "authState")', [(2, 1)]),
    ("src/CryptoBox{k}.swift", "let n = arc4random()", [(3, 1)]),
    ("src/C{k}.swift", "let n = arc4random_uniform(6)", [(4, 1)]),
    ("src/C{k}.swift", "let data = try! load()", [(5, 1)]),
    ("src/C{k}.swift", "use(cart!.total)", [(6, 1)]),
    ("src/C{k}.swift", "let cell = view as! Cell", [(7, 1)]),
    ("src/C{k}.swift", "DispatchQueue.main.sync { go() }", [(8, 1)]),
    ("src/C{k}.swift", "// first\nvar store: Store!", [(6, 2), (9, 2)]),
    ("src/C{k}.swift", "app.openURL(target)", [(10, 1)]),
    ("src/C{k}.swift", 'print("the token is", t)', [(11, 1)]),
    ("src/C{k}.swift", "sqlite3_open(path, &db)", [(12, 1)]),
    ("src/C{k}.swift", "let store = WKWebsiteDataStore.default()", [(14, 1)]),
    ("src/C{k}.swift", "fatalError()", [(15, 1)]),
    ("src/C{k}.swift", "strcpy(a, b)", [(16, 1)]),
    ("src/C{k}.swift", "let way = kCCAlgorithmDES", [(17, 1)]),
    ("src/C{k}.swift", "let page = UIWebView()", [(18, 1)]),
    ("src/P{k}/Package.swift", '.package(url: "http://git.host.org/x.git", from: "1.0.0")', [(19, 1), (29, 1)]),
    ("src/P{k}/Package.swift", 'dependencies: [.package(path: x, .branch("main"))]', [(20, 1)]),
    ("src/C{k}.swift", "var raw: UnsafeRawPointer", [(21, 1)]),
    ("src/C{k}.swift", "let held = Unmanaged<Node>.take()", [(22, 1)]),
    ("src/C{k}.swift", "CC_MD5(data, n, &out)", [(23, 1)]),
    ("src/C{k}.swift", "let mode = kCCOptionECBMode", [(24, 1)]),
    ("src/C{k}.swift", "let iv = [1, 2, 3]", [(25, 1)]),
    ("src/C{k}.swift", f'let digest = "{SECRET}"', [(1, 1), (26, 1)]),
    ("src/C{k}.swift", "a()\nlet mode = kCCModeCBC\nlet more = kCCModeCBC", [(27, 2)]),
    ("src/C{k}.swift", "CCKeyDerivationPBKDF(a, b, c, d, e, 1000, g)", [(28, 1)]),
    ("src/C{k}.swift", 'let base = "http://shop.org/v1"', [(29, 1)]),
    ("src/C{k}.swift", "policy.validatesDomainName = false", [(30, 1)]),
    ("src/C{k}.swift", "func a(didReceive challenge: C) {\n    done(.useCredential, c)\n}", [(31, 2)]),
    ("src/C{k}.swift", "func a(didReceive challenge: C) {\n    SecTrustEvaluateWithError(t, e)\n    done(.useCredential, c)\n}", []),
    ("src/C{k}.swift", 'web.evaluateJavaScript("go(\\(x))")', [(33, 1)]),
    ("src/C{k}.swift", 'r.set("Bearer abc", for: "Authorization")', [(34, 1)]),
    ("src/C{k}.swift", "c.allowsArbitraryLoads = true", [(35, 1)]),
    ("src/C{k}.swift", "let a = kSecAttrAccessibleAlways", [(36, 1)]),
    ("src/C{k}.swift", "SecTrustEvaluate(t, &r)", [(37, 1)]),
    ("src/C{k}.swift", "ctx.evaluatePolicy(p)", [(38, 1)]),
    ("src/C{k}.swift", "ctx.evaluatePolicy(p)\nlet s = kSecAttrAccessControl", []),
    ("src/C{k}.swift", 'db.run("SELECT * FROM t WHERE n = \\(name)")', [(39, 1)]),
    ("src/C{k}.swift", "let c = Coder(requiringSecureCoding: false)", [(40, 1)]),
    ("src/C{k}.swift", 'let up = "../etc"', [(41, 1)]),
    ("src/C{k}.swift", "let p = Process()", [(42, 1)]),
    ("src/C{k}.swift", "import FLEX", [(43, 1)]),
    ("src/C{k}.swift", "let s = UIPasteboard.general.string", [(46, 1)]),
    ("src/C{k}.swift", "func copyText() {\n    let s = UIPasteboard.general.string", []),
    ("src/C{k}.swift", "let id = device.identifierForVendor", [(47, 1)]),
    ("src/C{k}.swift", "SentrySDK.start(o)", [(49, 1)]),
    ("src/C{k}.swift", "let p = FileProtectionType.none", [(51, 1)]),
    ("src/C{k}.swift", "Thread.sleep(until: t)", [(52, 1)]),
    ("src/C{k}.swift", "NotificationCenter.default.addObserver(a)", [(53, 1)]),
    ("src/C{k}.swift", "memcpy(a, b, n)", [(54, 1)]),
    ("src/C{k}.swift", "x.assumingMemoryBound(to: Int.self)", [(55, 1)]),
    ("src/C{k}.m", "objc_msgSend(a, b);", [(56, 1)]),
    ("src/C{k}.swift", 'let k = "AKIA' + "Q" * 16 + '"', [(57, 1)]),
    ("src/C{k}.swift", "// -----BEGIN RSA PRIVATE KEY-----", [(58, 1)]),
    ("src/C{k}.swift", 'let r = NSRegularExpression(pattern: "(a+)+")', [(59, 1)]),
    ("src/C{k}.swift", "d.write(to: f)", [(61, 1)]),
    ("src/C{k}.swift", 'let h = "<b >\\(name)"', [(62, 1)]),
    ("src/C{k}.swift", 'os_log("pin %@", p)', [(63, 1)]),
    ("src/Tests/C{k}Tests.swift", "let data = try! load()", []),
    ("src/C{k}.swift", "// let n = arc4random()", []),
    ("src/C{k}.swift", "let fine = 1", []),
]
_FOUND = sql_list([";".join(f"{c}:{n}" for c, n in found) for _, _, found in CHECKED]).replace("''", "NULL")
_PATHS = sql_list([p for p, _, _ in CHECKED])
HITS_SQL = f"""hits AS (
    SELECT replace(path, '{{k}}', CAST(p_partkey AS VARCHAR)) AS file_path, CAST(string_split(h, ':')[1] AS INT) AS check_id, CAST(string_split(h, ':')[2] AS INT) AS line_no
    FROM (SELECT p_partkey, {_PATHS}[p_partkey % {len(CHECKED)} + 1] AS path, unnest(string_split({_FOUND}[p_partkey % {len(CHECKED)} + 1], ';')) AS h FROM part)
)"""


def check_hits(spark, d) -> DataFrame:
    files = planted(spark, d, CHECKED)
    lined = security.lines(files, *security.LOOKED_AT)
    return security.line_hits(lined).unionByName(security.database_hits(lined)).unionByName(security.challenge_hits(files))


@query(f"WITH {HITS_SQL} SELECT file_path, check_id, line_no FROM hits")
def planted_checks(spark, d):
    """Line, file and fold checks: each on a line that it must find, and on some that it must not."""
    return check_hits(spark, d).select("file_path", "check_id", "line_no")


_TABLE = ", ".join(f"({c.id}, '{c.category}', {security.MULTIPLIERS[c.priority]})" for c in security.CHECKS)
_WEIGHTS = ", ".join(f"('{c}', {w})" for c, w in security.WEIGHTS.items())
_SCORES_SQL = f"""WITH {HITS_SQL}, checks AS (SELECT * FROM (VALUES {_TABLE}) AS t(check_id, category, multiplier)), weights AS (SELECT * FROM (VALUES {_WEIGHTS}) AS t(category, weight)),
    totals AS (SELECT check_id, CAST(sum(least(n, 100)) AS BIGINT) AS total, count(*) AS files FROM (SELECT check_id, file_path, count(*) AS n FROM hits GROUP BY ALL) GROUP BY check_id),
    results AS (SELECT check_id, category, multiplier, coalesce(total, 0) AS total, coalesce(files, 0) AS files FROM checks LEFT JOIN totals USING (check_id)),
    swift AS (SELECT greatest(count(*), 1) AS n FROM part WHERE ends_with({_PATHS}[p_partkey % {len(CHECKED)} + 1], '.swift')),
    cats AS (SELECT category, weight, coalesce(sum(total * multiplier), 0) / any_value(n) AS density FROM weights LEFT JOIN results USING (category), swift GROUP BY category, weight)"""


@query(_SCORES_SQL + " SELECT check_id, category, total, files FROM results")
def planted_check_results(spark, d):
    """Totals of every check, hits capped by file and summed."""
    return security.check_results(check_hits(spark, d), security.check_table(spark)).select("check_id", "category", "total", "files")


@query(_SCORES_SQL + " SELECT category, density, density / (density + 2) AS risk, CAST(round(density / (density + 2) * weight) AS BIGINT) AS points FROM cats")
def planted_categories(spark, d):
    """Weighted, saturating scores of the categories."""
    results = security.check_results(check_hits(spark, d), security.check_table(spark))
    swift = planted(spark, d, CHECKED).filter("file_path LIKE '%.swift'").count()
    return security.category_scores(results, swift, security.weight_table(spark))


@query(_SCORES_SQL + """, total AS (SELECT greatest(0, least(1000, CAST(sum(round(density / (density + 2) * weight)) AS BIGINT))) AS score FROM cats)
    SELECT score, CASE WHEN score < 200 THEN 'hardened' WHEN score < 500 THEN 'minor' WHEN score < 800 THEN 'elevated' ELSE 'critical' END AS band FROM total""")
def planted_security_index(spark, d):
    """The one score of a project and its band."""
    return security.total_score(planted_categories(spark, d))


PROJECT = [
    ("conf/I{k}/Info.plist", "<dict>\n<key>NSAllowsArbitraryLoads</key>\n<true/>\n</dict>", [(32, 2)]),
    ("conf/I{k}/Info.plist", "<key>NSAllowsArbitraryLoads</key>\n<false/>", []),
    ("conf/I{k}/Info.plist", "<key>UIFileSharingEnabled</key>\n<true/>", [(50, 1)]),
    ("conf/I{k}/Info.plist", "<key>clientSecret</key>\n\n<string>abcdefghijkl</string>", [(13, 3)]),
    ("conf/I{k}/Info.plist", "<key>NSCameraUsageDescription</key>\n<string>we look</string>", [(48, 1)]),
    ("conf/A{k}.xcconfig", "API_KEY = 0123456789\nNAME = shop", [(13, 1)]),
    ("conf/A{k}.xcconfig", "API_KEY = $(OTHER_KEY)", []),
    ("conf/E{k}/.env", "NAME=x\nTOKEN=8f7a6b5c4d\nSECRET=changeme", [(60, 2)]),
]
_PROJECT = f"""SELECT replace({sql_list([p for p, _, _ in PROJECT])}[p_partkey % {len(PROJECT)} + 1], '{{k}}', CAST(p_partkey AS VARCHAR)) AS file_path,
    CAST(string_split(h, ':')[1] AS INT) AS check_id, CAST(string_split(h, ':')[2] AS INT) AS line_no
    FROM (SELECT p_partkey, unnest(string_split({sql_list([';'.join(f'{c}:{n}' for c, n in f) for _, _, f in PROJECT]).replace("''", 'NULL')}[p_partkey % {len(PROJECT)} + 1], ';')) AS h FROM part)"""


@query(_PROJECT + " UNION ALL SELECT 'Project-wide', 44, 0 UNION ALL SELECT 'Project-wide', 45, 0")
def planted_project_checks(spark, d):
    """Checks on property lists, build settings and environment files, and on what a whole project lacks."""
    sources = planted(spark, d, [("src/C{k}.swift", "let fine = 1")])
    return security.project_hits(sources, planted(spark, d, PROJECT)).select("file_path", "check_id", "line_no")


# algorithms by their shape

SHAPES = {
    "Sieve of Eratosthenes": "var p = 2\nwhile p * p <= n {\nfor q in stride(from: p * p, through: n, by: p) {\nflags[q] = false\n}\np += 1\n}",
    "Euclidean GCD": "var (a, b) = (x, y)\nwhile b != 0 {\n(a, b) = (b, a % b)\n}\nreturn a",
    "Dijkstra": "for e in g[u] {\nif dist[u] + e.weight < dist[e.to] {\ndist[e.to] = dist[u] + e.weight\n}\n}",
    "Kahn (Topological Sort)": "while !ready.isEmpty {\nlet u = ready.removeFirst()\nfor v in g[u] { indegree[v] -= 1 }\n}",
    "Union–Find (Disjoint Set)": "if parent[x] != x {\nparent[x] = find(parent[x])\n}\nreturn parent[x]",
    "Heapify": "while true {\nlet c = 2 * i + 1\nif c >= n { break }\nif a[c] > a[i] { a.swapAt(c, i) }\ni = c\n}",
    "Quicksort": "let pivot = a[0]\nlet l = {f}(a.filter { $0 < pivot })\nlet r = {f}(a.filter { $0 > pivot })\nreturn l + [pivot] + r",
    "Merge Sort": "let m = a.count / 2\nlet left = {f}(Array(a[..<m]))\nlet right = {f}(Array(a[m...]))\nreturn joined(left, right)",
    "Binary Search": "while low <= high {\nlet mid = low + (high - low) / 2\nif a[mid] < x { low = mid + 1 } else { high = mid - 1 }\n}",
    "Bubble Sort": "for i in 0..<n {\nfor j in 0..<n - i {\nif a[j] > a[j + 1] { a.swapAt(j, j + 1) }\n}\n}",
    "Insertion Sort": "for i in 1..<n {\nvar j = i\nwhile j > 0 && a[j - 1] > x {\na[j] = a[j - 1]\nj -= 1\n}\na[j] = x\n}",
    "Breadth-First Search": "while !line.isEmpty {\nlet u = line.removeFirst()\nfor v in g[u] where !visited.contains(v) { visited.insert(v) }\n}",
    "Depth-First Search": "visited.insert(u)\nfor v in g[u] where !visited.contains(v) {\n{f}(v)\n}",
    "Floyd's Cycle Detection": "while fast?.next != nil {\nslow = slow?.next\nfast = fast?.next?.next\nif slow === fast { return true }\n}",
    "Backtracking (DFS)": "for c in choices {\npath.append(c)\n{f}(path)\npath.removeLast()\n}",
    "Kadane (Max Subarray)": "for x in a {\ncur = max(x, cur + x)\nbest = max(best, cur)\n}",
    "Prefix Sum": "for i in 1..<n {\nsums[i] += sums[i - 1]\n}\nreturn sums[n - 1]",
    "Fisher–Yates Shuffle": "for i in stride(from: n - 1, to: 0, by: -1) {\nlet j = Int.random(in: 0...i)\na.swapAt(i, j)\n}",
    "Binary Exponentiation": "while e > 0 {\nif e & 1 == 1 { r *= b }\nb *= b\ne >>= 1\n}",
    "Matrix Multiplication": "for i in 0..<n {\nfor j in 0..<n {\nfor k in 0..<n {\nc[i][j] += a[i][k] * b[k][j]\n}\n}\n}",
    "Bresenham Line": "while x < x1 {\nplot(x, y)\nif error > 0 { y += 1; error -= 2 * dx }\nerror += 2 * dy\nx += 1\n}",
    "Exponential Backoff": "while failed {\nwait(retryDelay)\nretryDelay *= 2\ntries += 1\n}",
    "Manual Reference Counting": "lock.lock()\nretainCount += 1\nlock.unlock()\nreturn self",
    "Memoized Recursion (DP)": "if let known = memo[n] { return known }\nlet r = {f}(n - 1) + {f}(n - 2)\nmemo[n] = r\nreturn r",
    "Levenshtein Distance": "for i in 1...n {\nfor j in 1...m {\nd[i][j] = min(d[i-1][j], min(d[i][j-1], d[i-1][j-1])) + 1\n}\n}",
    "Alpha–Beta Pruning": "for m in moves {\nalpha = max(alpha, -{f}(m, -beta, -alpha))\nif alpha >= beta { break }\n}",
    "Two-Pointer Technique": "while l < r {\nif s[l] != s[r] { return false }\nl += 1\nr -= 1\n}",
    "": "let total = items.count + other.count\nreturn total * factor",
}
SHAPED = [("src/A{k}.swift", f"// no. {{k}}\nfunc q{{k}}z(_ x: Int) {{\n{body.replace('{f}', 'q{k}z')}\n}}") for body in SHAPES.values()]
_NEST = [2, 1, 1, 2, 0, 1, 0, 0, 1, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 3, 1, 1, 0, 0, 2, 1, 1, 0]


@query(f"SELECT 'src/A' || p_partkey || '.swift' AS file_path, 'q' || p_partkey || 'z' AS symbol, 2 AS line, label FROM (SELECT p_partkey, {sql_list(SHAPES)}[p_partkey % {len(SHAPES)} + 1] AS label FROM part) WHERE label <> ''")
def planted_fingerprints(spark, d):
    """Each of the 27 algorithms from the shape of a function whose name tells nothing."""
    return constructs.algorithms(constructs.scanned(planted(spark, d, SHAPED), "functions", "types")).select("file_path", "symbol", "line", "label")


@query(f"SELECT 'src/A' || p_partkey || '.swift' AS file_path, 'q' || p_partkey || 'z' AS name, 2 AS start, {sql_list([3 + b.count(chr(10)) + 1 for b in SHAPES.values()])}[p_partkey % {len(SHAPES)} + 1] AS end_line, {sql_list(_NEST)}[p_partkey % {len(SHAPES)} + 1] AS nest FROM part")
def planted_functions(spark, d):
    """Range and nest of loops of every function."""
    return constructs.each(constructs.scanned(planted(spark, d, SHAPED), "functions"), "functions").select("file_path", "name", "start", F.col("end").alias("end_line"), "nest")


# algorithms and structures by their names

_RULES = [r for r in names.algorithm_rules() if not r[4] and not r[5]]
NAMED = [("src/N{k}.swift", "func " + "".join(w.capitalize() if i else w for i, w in enumerate(tokens)) + "() { go() }") for _, _, _, tokens, _, _ in _RULES]


@query(f"SELECT 'src/N' || p_partkey || '.swift' AS file_path, {sql_list([t.split()[1].partition('(')[0] for _, t in NAMED])}[p_partkey % {len(NAMED)} + 1] AS symbol, {sql_list([r[1] for r in _RULES])}[p_partkey % {len(NAMED)} + 1] AS label FROM part")
def planted_algorithm_names(spark, d):
    """Functions named with the words of each rule that needs no context."""
    return constructs.algorithms(constructs.scanned(planted(spark, d, NAMED), "functions", "types")).select("file_path", "symbol", "label")


_SUFFIXES = names.structure_rules()
_BODY = " ".join(f"var {w}: Int" for strong, _ in names.EVIDENCE.values() for w in strong[:1]) + " var concat: Int; var split: Int"
BUILT = [("src/S{k}.swift", f"// type\nfinal class Own{{k}}{suffix} {{\n{_BODY}\n}}") for suffix, _, _ in _SUFFIXES]


@query(f"""SELECT 'src/S' || p_partkey || '.swift' AS file_path, 'Own' || p_partkey || {sql_list([s for s, _, _ in _SUFFIXES])}[p_partkey % {len(BUILT)} + 1] AS name, 2 AS line,
    {sql_list([label for _, label, _ in _SUFFIXES])}[p_partkey % {len(BUILT)} + 1] AS label, {sql_list([c for _, _, c in _SUFFIXES])}[p_partkey % {len(BUILT)} + 1] AS category FROM part""")
def planted_structure_names(spark, d):
    """Types named with the ending of each rule, with words in their bodies that prove the ambiguous ones."""
    return constructs.named_structures(constructs.scanned(planted(spark, d, BUILT), "types")).select("file_path", "name", "line", "label", "category")


_AMBIGUOUS = [(suffix, label) for suffix, label, _ in _SUFFIXES if suffix in names.EVIDENCE]
MIXED = [(p, t) for suffix, _ in _AMBIGUOUS for p, t in (("src/S{k}.swift", f"struct Own{{k}}{suffix} {{\nvar size: Int\n}}"), ("src/S{k}.swift", f"struct Own{{k}}{suffix} {{\n{_BODY}\n}}"))]


@query(f"""SELECT 'Own' || p_partkey || {sql_list([s for s, _ in _AMBIGUOUS])}[p_partkey % {len(MIXED)} // 2 + 1] AS name, {sql_list([label for _, label in _AMBIGUOUS])}[p_partkey % {len(MIXED)} // 2 + 1] AS label
    FROM part WHERE p_partkey % 2 = 1""")
def planted_structures_unproven(spark, d):
    """Ambiguous endings with and without a word of proof in one repository: only the proven ones are found."""
    return constructs.named_structures(constructs.scanned(planted(spark, d, MIXED), "types")).select("name", "label")


LINKED = [
    ("src/L{k}.swift", "class Twig{k} {\nvar left: Twig{k}?\nvar right: Twig{k}?\n}"),
    ("src/L{k}.swift", "class Ring{k} {\nvar next: Ring{k}?\nvar prev: Ring{k}?\n}"),
    ("src/L{k}.swift", "class Bead{k} {\nvar next: Bead{k}?\n}"),
    ("src/L{k}.swift", "class Bough{k} {\nvar parts: [Bough{k}] = []\n}"),
    ("src/L{k}.swift", "class Odd{k} {\nvar other: Odd{k}?\n}"),
    ("src/L{k}.swift", "indirect enum Term{k} { \ncase add(Term{k}, Term{k})\ncase one(Int)\n}"),
    ("src/L{k}.swift", "class Link{k} {\nvar next: Link{k}?\n}\nstruct Holds{k} {\nvar link: Link{k}\n}\nstruct Outer{k} {\nvar holds: Holds{k}\n}\nstruct Far{k} {\nvar outer: Outer{k}\n}"),
    ("src/L{k}.swift", "struct Plain{k} {\nvar size: Int\n}"),
]
_LINKED = [["Twig:1:Binary Tree Node"], ["Ring:1:Doubly Linked Node"], ["Bead:1:Singly Linked Node"], ["Bough:1:Tree Node (self collection)"], ["Odd:1:Self-Referential Type"], ["Term:1:Recursive Enum"],
           ["Link:1:Singly Linked Node", "Holds:4:Embeds Linked Structure (direct)", "Outer:7:Embeds Linked Structure (nested)"], []]


@query(f"""SELECT 'src/L' || p_partkey || '.swift' AS file_path, string_split(x, ':')[1] || p_partkey AS name, CAST(string_split(x, ':')[2] AS INT) AS line, string_split(x, ':')[3] AS label
    FROM (SELECT p_partkey, unnest(string_split({sql_list([';'.join(x) for x in _LINKED]).replace("''", 'NULL')}[p_partkey % {len(LINKED)} + 1], ';')) AS x FROM part)""")
def planted_linked(spark, d):
    """Types that refer to themselves, by shape, and types that embed them, at most two steps away."""
    scan = cut(constructs.scanned(planted(spark, d, LINKED), "types"))  # read twice, scanned once
    return constructs.linked_structures(scan, constructs.named_structures(scan)).select("file_path", "name", "line", "label")


# constants, loops and collections

_NUMBERS = [*((f"0x{v:X}", label) for v, label in constructs.CONSTANTS), *((str(v), label) for v, label in constructs.CONSTANTS if v >= 65536)]
_TEXTS = [(f'"{t}"', label) for t, label in constructs.TEXT_CONSTANTS]
CONSTANT = [("src/K{k}.swift", f"func seed{{k}}() {{\nlet a = 12 + 65537\nlet b = {v}\n}}") for v, _ in [*_NUMBERS, *_TEXTS]] + [("src/K{k}.swift", "// 0x67452301\nlet c = 4129")]
_LABELS = [label for _, label in [*_NUMBERS, *_TEXTS]] + [""]


@query(f"SELECT 'src/K' || p_partkey || '.swift' AS file_path, 3 AS line, 'seed' || p_partkey AS symbol, label FROM (SELECT p_partkey, {sql_list(_LABELS)}[p_partkey % {len(CONSTANT)} + 1] AS label FROM part) WHERE label <> ''")
def planted_constants(spark, d):
    """Each known constant, as hexadecimal, decimal or text, with the function around it."""
    return constructs.constants(constructs.scanned(planted(spark, d, CONSTANT), "numbers", "literals", "functions")).select("file_path", "line", "symbol", "label")


LOOPED = [
    ("src/O{k}.swift", "func w{k}() {\nfor a in x {\nfor b in y {\nuse(a, b)\n}\n}\n}"),
    ("src/O{k}.swift", "func w{k}() {\nwhile go {\nlet s = x.sorted()\n}\n}"),
    ("src/O{k}.swift", "func w{k}() {\nx.forEach { a in\nx.forEach { b in\nfor c in z {\nuse(c)\n}\n}\n}\n}"),
    ("src/O{k}.swift", "func w{k}() {\nfor a in x {\nif a > 1 {\nlet l = [1, 2]\n}\n}\n}"),
    ("src/O{k}.swift", "func w{k}() {\nfor a in x {\nuse(a)\n}\n}"),
    ("src/O{k}.swift", "func w{k}() {\nuse(1)\n}"),
]
_TIME, _SPACE = ["2:3:nested for loop", "2:3:.sorted() inside loop", "3:4:nested for loop", "", "", ""], ["", "2:3:allocates array inside loop", "", "2:4:allocates collection literal inside loop", "", ""]


def _worst_sql(expected: list[str]) -> str:
    return f"""SELECT 'src/O' || p_partkey || '.swift' AS file_path, 'w' || p_partkey AS symbol, CAST(string_split(x, ':')[1] AS INT) AS "order", CAST(string_split(x, ':')[2] AS INT) AS line, string_split(x, ':')[3] AS reason
        FROM (SELECT p_partkey, {sql_list(expected)}[p_partkey % {len(LOOPED)} + 1] AS x FROM part) WHERE x <> ''"""


@query(_worst_sql(_TIME))
def planted_time(spark, d):
    """The worst nested or linear work of every function."""
    return constructs.worst(constructs.scanned(planted(spark, d, LOOPED), "findings"), "time").select("file_path", "symbol", "order", "line", "reason")


@query(_worst_sql(_SPACE))
def planted_space(spark, d):
    """The worst allocation in a loop of every function."""
    return constructs.worst(constructs.scanned(planted(spark, d, LOOPED), "findings"), "space").select("file_path", "symbol", "order", "line", "reason")


@query(f"""SELECT count(*) FILTER (i < 5) AS scopes, CAST(round(100.0 * (count(*) FILTER (i < 5) - count(*) FILTER (i < 3)) / count(*) FILTER (i < 5)) AS INT) AS time_health,
    CAST(round(100.0 * (count(*) FILTER (i < 5) - count(*) FILTER (i IN (1, 3))) / count(*) FILTER (i < 5)) AS INT) AS space_health FROM (SELECT p_partkey % {len(LOOPED)} AS i FROM part)""")
def planted_health(spark, d):
    """Per cent of looping functions without findings."""
    return constructs.health(constructs.scanned(planted(spark, d, LOOPED), "findings", "scopes"))


USED = [("src/U{k}.swift", "let a: [Int] = b"), ("src/U{k}.swift", "let d: [String: Int] = e"), ("src/U{k}.swift", "let s = Set(x) // Set"), ("src/U{k}.swift", "let z = x.lazy.map"), ("src/U{k}.swift", "struct G: Sequence, IteratorProtocol {"), ("src/U{k}.swift", 'let t = "Array Set"'),
    ("src/U{k}.swift", "let a: [Array<Int>] = b"), ("src/U{k}.swift", "func f() -> [String: Dictionary<Int, Int>] { }")]


@query(f"SELECT count(*) FILTER (i = 0) + 2 * count(*) FILTER (i = 6) AS \"array\", count(*) FILTER (i = 1) + 2 * count(*) FILTER (i = 7) AS dictionary, count(*) FILTER (i = 2) AS \"set\", 2 * count(*) FILTER (i = 4) AS sequence, count(*) FILTER (i = 3) AS lazy FROM (SELECT p_partkey % {len(USED)} AS i FROM part)")
def planted_collections(spark, d):
    """How often each kind of collection is named outside comments and strings."""
    return constructs.collection_usage(constructs.scanned(planted(spark, d, USED), "stripped"))


STRIPPED = [
    ("src/X{k}.swift", 'let a = "x // y" // tail\nlet b = 1', ["let a =  ", "let b = 1"]),
    ("src/X{k}.swift", "a /* one /* two */ still */ b\nc", ["a  b", "c"]),
    ("src/X{k}.swift", 'let t = """\nfunc no() { }\n"""\nlet e = "q\\"r" + z', ["let t = ", "", "", "let e =  + z"]),
    ("src/X{k}.swift", "// all\n/* b */", ["", ""]),
]


@query(f"""SELECT 'src/X' || p_partkey || '.swift' AS file_path, string_split({sql_list(['|'.join(x) for _, _, x in STRIPPED])}[p_partkey % 4 + 1], '|') AS stripped FROM part""")
def planted_stripped(spark, d):
    """Lines without comments and strings, their numbers kept."""
    return constructs.scanned(planted(spark, d, [s[:2] for s in STRIPPED]), "stripped").select("file_path", "stripped")


# parsed files, packages

PARSED = [
    ("Packages/M{k}/Sources/M{k}/A{k}.swift", "import Foundation\nimport struct Other{k}.Price\n\n/// Holds {k}.\n/// Twice.\npublic final class A{k}: Base {\n    // TODO: one\n    // FIXME: two\n    func long{k}() {\n        a()\n        b()\n    }\n    func short() { c() }\n}\nstruct B{k} { let x = 1 }\n"),
    ("Packages/Shared/Sources/Shared/P{k}.swift", "import Combine\nprotocol P{k} {\n    var f: Int { get }\n}\nextension P{k} {\n    func g() { }\n}\nactor Q{k} { }\nenum E{k} {\n    case a\n    // TODO: x\n}"),
    ("App/Legacy{k}.m", '#import <UIKit/UIKit.h>\n#import "Own{k}.h"\n@import CoreData;\n@interface Legacy{k} : NSObject\n@end\n'),
]
_LONG, _BIG = ["struct_pack(name := 'long' || k, n := 4)", "struct_pack(name := 'g', n := 1)", "NULL"], ["struct_pack(name := 'A' || k, n := 9)", "struct_pack(name := 'E' || k, n := 4)", "NULL"]


def _by(k: str, cases: list[str]) -> str:
    return f"CASE {k} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


_PARSED = f"""SELECT k, {_by('k', ["'Packages/M' || k || '/Sources/M' || k || '/A' || k || '.swift'", "'Packages/Shared/Sources/Shared/P' || k || '.swift'", "'App/Legacy' || k || '.m'"])} AS file_path,
    {_by('k', ['15', '12', '6'])} AS line_count, {_by('k', ["['Foundation', 'Other' || k || '.Price']", "['Combine']", "['CoreData', 'Own' || k, 'UIKit']"])} AS imports,
    {_by('k', ["'Holds ' || k || '. Twice.'", "''", "''"])} AS description, {_by('k', ['1', '1', '0'])} AS todo_count, {_by('k', ['1', '0', '0'])} AS fixme_count,
    {_by('k', ["'M' || k", "'Shared'", "''"])} AS package_name, {_by('k', _LONG)} AS longest, {_by('k', _BIG)} AS biggest FROM (SELECT p_partkey AS k FROM part)"""


@query(f"SELECT file_path, line_count, imports, description, todo_count, fixme_count, longest.name AS longest_function, longest.n AS longest_lines, biggest.name AS biggest_type, biggest.n AS biggest_lines FROM ({_PARSED})")
def planted_parse(spark, d):
    """Imports, description, notes, lines, longest function and biggest type of every file."""
    p = parse.parsed(planted(spark, d, PARSED))
    return p.select("file_path", "line_count", "imports", "description", "todo_count", "fixme_count", F.col("longest_function.name").alias("longest_function"), F.col("longest_function.line_count").alias("longest_lines"), F.col("biggest_type.name").alias("biggest_type"), F.col("biggest_type.line_count").alias("biggest_lines"))


_DECLS = [["A:class:6", "B:struct:15"], ["P:protocol:2", "P:extension:5", "Q:actor:8", "E:enum:9"], ["Legacy:class:4"]]


@query(f"""SELECT file_path, string_split(x, ':')[1] || k AS name, string_split(x, ':')[2] AS kind, CAST(string_split(x, ':')[3] AS INT) AS line
    FROM (SELECT file_path, k, unnest(string_split({sql_list([';'.join(x) for x in _DECLS])}[k % 3 + 1], ';')) AS x FROM ({_PARSED}))""")
def planted_declarations(spark, d):
    """Declarations of every file, with kind and line."""
    return parse.declarations(parse.parsed(planted(spark, d, PARSED))).select("file_path", "name", "kind", "line")


def placed(spark, d) -> DataFrame:
    return homes(planted(spark, d, PARSED))


def homes(files: DataFrame) -> DataFrame:
    """Parsed files with their packages; parsed once, as paths are read for the folders too."""
    return located(cut(parse.parsed(files)))


def located(p: DataFrame) -> DataFrame:
    """Parsed files, written before, with their packages."""
    return parse.packages(p, p.select(F.col("file_path").alias("rel_path")))


@query(f"SELECT file_path, package_name, CASE package_name WHEN '' THEN 'Unknown' ELSE 'SwiftPM' END AS build_system FROM ({_PARSED})")
def planted_packages(spark, d):
    """Package and build system of every file, from its path."""
    return placed(spark, d).select("file_path", "package_name", "build_system")


@query(f"""SELECT coalesce(nullif(package_name, ''), 'App') AS package, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(CASE k % 3 WHEN 1 THEN 0 ELSE 1 END) AS BIGINT) AS "class",
    count(*) FILTER (k % 3 = 0) AS struct, count(*) FILTER (k % 3 = 1) AS enum, count(*) FILTER (k % 3 = 1) AS protocol, count(*) FILTER (k % 3 = 1) AS actor FROM ({_PARSED}) GROUP BY package_name""")
def planted_package_totals(spark, d):
    """Files, lines and declarations by kind of every package."""
    p = cut(parse.parsed(planted(spark, d, PARSED)))
    return packages.totals(located(p), parse.declarations(p)).select("package", "files", "lines", "class", "struct", "enum", "protocol", "actor")


@query(f"""SELECT module, todo, fixme FROM (SELECT coalesce(nullif(package_name, ''), 'App') AS module, CAST(sum(todo_count) AS BIGINT) AS todo, CAST(sum(fixme_count) AS BIGINT) AS fixme FROM ({_PARSED}) GROUP BY ALL)
    WHERE todo + fixme > 0 ORDER BY todo + fixme DESC, module LIMIT 50""")
def planted_notes(spark, d):
    """The modules with most notes of things to do."""
    return packages.notes_by_module(placed(spark, d))


@query(f"""SELECT file_path, longest.name AS name, longest.n AS line_count FROM ({_PARSED}) WHERE longest IS NOT NULL ORDER BY longest.n DESC, file_path LIMIT 20""")
def planted_longest(spark, d):
    """The longest functions of all files."""
    return packages.longest(parse.parsed(planted(spark, d, PARSED))).select("file_path", "name", "line_count")


@query(f"""SELECT name, CASE WHEN name IN ('Foundation', 'Combine', 'CoreData', 'UIKit') THEN 'apple' ELSE 'external' END AS class FROM (SELECT DISTINCT unnest(imports) AS name FROM ({_PARSED}))""")
def planted_import_classes(spark, d):
    """What every imported name is: the platform's or from outside."""
    p = cut(parse.parsed(planted(spark, d, PARSED)))
    return packages.classified(parse.imports(p), located(p))  # imports don't need the packages


# one name of every kind, and names that only look like the platform's
IMPORTED = [
    ("SnapKit", "external"), ("PromiseKit", "external"), ("CorePlot", "external"), ("MetalPetal", "external"), ("GRPCServices", "external"), ("GoogleMobileAdsUI", "external"), ("AVMetrics", "external"),
    ("AdSupport", "apple"), ("MetalFX", "apple"), ("TipKit", "apple"), ("WalletPasses", "apple"), ("os.signpost", "apple"), ("UIKit.UIView", "apple"), ("sqlite3", "apple"), ("MobileCoreServices", "apple"), ("ARKit", "apple"),
    ("SpringBoardServices", "private"), ("FrontBoard.Scene", "private"), ("BaseBoard", "private"), ("TCC", "private"), ("UIKitCore", "private"),
    ("pthread", ""), ("sys", ""), ("lua", ""), ("Lua", "external"), ("Mod{k}", "local"), ("File{k}", ""), ("Far{k}", "external"),
]


@query(f"""SELECT DISTINCT replace(x.n, '{{k}}', CAST(p_partkey AS VARCHAR)) AS name, x.c AS class FROM (SELECT p_partkey, unnest({sql_list([f"{n}:{c}" for n, c in IMPORTED])}) AS s FROM part),
    LATERAL (SELECT string_split(s, ':')[1] AS n, string_split(s, ':')[2] AS c) x WHERE x.c <> '' AND (p_partkey % {len(IMPORTED)} = list_position({sql_list([n for n, _ in IMPORTED])}, x.n) - 1)""")
def planted_import_lists(spark, d):
    """Public, private, local and outside names, told by the fixed lists and the project's own names."""
    files = planted(spark, d, [("Packages/Mod{k}/Sources/Mod{k}/File{k}.swift", f"import {n}\nlet a = 1") for n, _ in IMPORTED])
    p = cut(parse.parsed(files))
    return packages.classified(parse.imports(p), located(p))


# design patterns: name of the pattern, category, text

DESIGNS = [
    ("Builder", "creational", "class Cart{k}Builder { }"), ("Adapter", "structural", "class Cart{k}Adapter { }"), ("Decorator", "structural", "struct Cart{k}Decorator { }"), ("Facade", "structural", "class Cart{k}Facade { }"),
    ("Proxy", "structural", "class Cart{k}Proxy { }"), ("Composite", "structural", "class Cart{k}Composite { }"), ("Bridge", "structural", "class Cart{k}Bridge { }"), ("Flyweight", "structural", "class Cart{k}Flyweight { }"),
    ("Front Controller", "structural", "class Cart{k}FrontController { }"), ("Object Pool", "structural", "class Cart{k}Pool {\nfunc acquire() { }\n}"), ("Caching", "structural", "class Cart{k}Cache { }"), ("Delegation", "behavioral", "protocol Cart{k}Delegate { func f() }"),
    ("Strategy", "behavioral", "class Cart{k}Strategy { }"), ("Chain of Resp.", "behavioral", "class Cart{k}Handler {\nvar next: Other?\n}"), ("Mediator", "behavioral", "class Cart{k}Mediator { }"), ("Visitor", "behavioral", "class Cart{k}Visitor { }"),
    ("Memento", "behavioral", "struct Cart{k}Memento { }"), ("Memento", "behavioral", "struct Cart{k}Snapshot { }"), ("Specification", "behavioral", "struct Cart{k}Specification { }"), ("Singleton", "creational", "class Cart{k} {\nstatic let shared = 1\n}"),
    ("Prototype", "creational", "class Cart{k} {\nfunc clone() { }\n}"), ("Multiton", "creational", "class Cart{k} {\nstatic var instances: [Int] = a\n}"), ("Lazy Initialization", "creational", "class Cart{k} {\nlazy var a = b\n}"),
    ("Read–Write Lock", "concurrency", "let q = DispatchQueue(x)\nq.async(flags: .barrier)"), ("Thread Pool", "concurrency", "let q = OperationQueue()\nq.maxConcurrentOperationCount = 4"), ("Fluent Interface", "structural", "class Cart{k} {\nfunc a() -> Self { }\nfunc b() -> Self { }\n}"),
    ("Iterator", "behavioral", "struct Cart{k}: IteratorProtocol { }"), ("Template Method", "behavioral", "class Cart{k} {\nfunc templateMethod() { }\n}"), ("Null Object", "behavioral", "class NullCart{k} { }"), ("Monitor Object", "concurrency", "actor Cart{k} { }"),
    ("Extension", "structural", "extension Cart{k} { }"), ("Abstract Factory", "creational", "protocol Cart{k}Factory { func f() }"), ("Marker", "structural", "protocol Cart{k} { }"), ("Dependency Injection", "creational", "import Swinject\nlet a = 1"),
    ("Observer", "behavioral", "class Cart{k} {\n@Published var a = 1\n}"), ("Interpreter", "behavioral", "class Cart{k}Interpreter { }"), ("Command", "behavioral", "class Cart{k}Command { }"), ("", "", "class Cart{k} { }"),
]


@query(f"""SELECT name, category, count(*) AS count, min('src/D' || p_partkey || '.swift') AS example_path, name IN ({', '.join(f"'{x}'" for x in patterns.IDIOMS)}) AS is_idiom
    FROM (SELECT p_partkey, {sql_list([n for n, _, _ in DESIGNS])}[p_partkey % {len(DESIGNS)} + 1] AS name, {sql_list([c for _, c, _ in DESIGNS])}[p_partkey % {len(DESIGNS)} + 1] AS category FROM part) WHERE name <> '' GROUP BY name, category""")
def planted_patterns(spark, d):
    """Design patterns by names and marks, with the first file of each."""
    files = planted(spark, d, [("src/D{k}.swift", t) for _, _, t in DESIGNS])
    return patterns.detect(constructs.scanned(files, "stripped", "declarations"))


# traffic: text, then direction, uri, port, protocol, format of what is found

CALLED = [
    ('app.get("/carts/{k}") { r in }', [("in", "/carts/{k}", "", "REST", "JSON")]),
    ("let l = NWListener(using: .tcp, on: 8{k})", [("in", ":8{k}", "8{k}", "TCP", "")]),
    ('let u = "https://shop.org:8443/v{k}" // json', [("out", "https://shop.org:8443/v{k}", "8443", "REST", "JSON")]),
    ('let u = "wss://feed.org/{k}"', [("out", "wss://feed.org/{k}", "", "WebSocket", "")]),
    ('let grpc = "http://rpc.org/{k}" + "https://two.org/{k}/x"', [("out", "http://rpc.org/{k}", "", "gRPC", ""), ("out", "https://two.org/{k}/x", "", "gRPC", "")]),
    ('let c = NWConnection(host: "h{k}.org", port: 99)', [("out", "h{k}.org:99", "99", "TCP", "")]),
    ("let m = NWPathMonitor()", []),
    ('/*\nlet u = "https://gone.org/{k}"\n*/\n// "https://gone.org/{k}"', []),
]


@query(f"""SELECT string_split(x, '|')[1] AS direction, string_split(x, '|')[2] AS uri, string_split(x, '|')[3] AS port, string_split(x, '|')[4] AS proto, string_split(x, '|')[5] AS data_fmt, 'src/T' || p_partkey || '.swift' AS file_path, 1 AS line
    FROM (SELECT p_partkey, unnest(string_split(replace({sql_list([';'.join('|'.join(y) for y in x) for _, x in CALLED]).replace("''", 'NULL')}[p_partkey % 8 + 1], '{{k}}', CAST(p_partkey % 999 AS VARCHAR)), ';')) AS x FROM part)""")
def planted_traffic(spark, d):
    """Routes, listeners, urls and sockets in lines that aren't comments; numbers repeat beyond 999 parts, so each module has its own."""
    files = planted(spark, d, [("src/T{k}.swift", t) for t, _ in CALLED])
    short = F.regexp_extract("file_path", "T([0-9]+)", 1).cast("long") % 999
    files = files.withColumn("module", F.col("file_path")).withColumn("text", F.regexp_replace("text", F.regexp_extract("file_path", "T([0-9]+)", 1), short.cast("string")))
    return traffic.entries(files).filter("uri <> 'NWPathMonitor'").select("direction", "uri", "port", "proto", "data_fmt", "file_path", "line")


# style

STYLED = [
    "protocol Able{k} {\n    associatedtype Item\n    func f()\n}\nextension Able{k} {\n    func g() { a() }\n}",
    "final class Plain{k} {\n    var a = 1\n}",
    "struct Value{k} {\n    func f<T: Able>(_ t: T) { }\n}",
    "enum Way{k} {\n    case one(Int)\n    case two\n}",
    "class Root{k}: NSObject {\n}\nclass Leaf{k}: Root{k} {\n    override func go() { }\n}",
    "struct Both{k}: Able0, Able6 {\n    var x: some Able0\n    typealias Y = Able0 & Able6\n}",
]


@query("""WITH p AS (SELECT p_partkey % 6 AS i, p_partkey AS k FROM part), c AS (SELECT count(*) FILTER (i = 0) AS n0, count(*) FILTER (i = 1) AS n1, count(*) FILTER (i = 2) AS n2, count(*) FILTER (i = 3) AS n3,
        count(*) FILTER (i = 4) AS n4, count(*) FILTER (i = 5) AS n5, count(*) FILTER (k IN (0, 6)) AS six, count(*) FILTER (k = 0) AS zero FROM p)
    SELECT n1 + 2 * n4 AS classes, n2 + n5 AS structs, n0 AS protocols, n3 AS enums, n2 AS generics, n1 AS finals, n3 AS enum_payloads, n4 AS overrides, n4 AS root_objects, n0 AS extended, n0 AS associated, n5 AS composed,
        n5 * zero AS opaque, six AS implemented, 0 AS conform_one, six AS conform_many, n1 + n2 + 2 * n4 - n4 - n4 + n4 + n4 AS conform_none, 2 * n4 AS depth_sum, n4 AS depth_count FROM c""")
def planted_style(spark, d):
    """Counts of protocol, value and inheritance features; one protocol that many types conform to."""
    files = planted(spark, d, [("src/Y{k}.swift", t) for t in STYLED])
    counts = style.count(security.lines(files, *style.LOOKED_AT), parse.declarations(parse.parsed(files, "declarations")))
    return counts.select("classes", "structs", "protocols", "enums", "generics", "finals", "enum_payloads", "overrides", "root_objects", "extended", "associated", "composed", "opaque", "implemented", "conform_one", "conform_many", "conform_none", "depth_sum", "depth_count")


# history: a main line of commits, one per supplier, which merges a side branch of three commits every fifth


def main_line(spark, d) -> DataFrame:
    """(hash, parent, ts): main commits m<k>, and sides s<k>_1 to s<k>_3 that leave the line at m<k-3>."""
    k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    line = k.select(name("m", F.col("k")).alias("hash"), F.when(F.col("k") > 1, name("m", F.col("k") - 1)).alias("parent"), (F.col("k") * 86400).alias("ts"))
    side = k.filter("k % 5 = 0 AND k > 0").select("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("i"))
    of = F.concat(F.lit("s"), F.col("k").cast("string"), F.lit("_"))
    side = side.select(F.concat(of, F.col("i").cast("string")).alias("hash"), F.when(F.col("i") == 1, name("m", F.col("k") - 3)).otherwise(F.concat(of, (F.col("i") - 1).cast("string"))).alias("parent"), ((F.col("k") - 3) * 86400 + F.col("i") * (3600 + F.col("k") % 7 * 600)).alias("ts"))
    return line.union(side)


def merges(spark, d) -> DataFrame:
    k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).filter("k % 5 = 0 AND k > 0")
    name = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    return k.select(name("m", F.col("k")).alias("merge"), name("m", F.col("k") - 1).alias("main_parent"), F.concat(name("s", F.col("k")), F.lit("_3")).alias("tip"), (F.col("k") * 86400).alias("ts"))


def brought(spark, d) -> DataFrame:
    tips = merges(spark, d).select(F.col("merge").alias("hash"), F.col("tip").alias("parent"))
    return history.feature_commits(main_line(spark, d).select("hash", "parent").filter("parent IS NOT NULL").union(tips), merges(spark, d))


@query("SELECT 'm' || s_suppkey AS merge, 's' || s_suppkey || '_' || i AS hash FROM supplier, unnest([1, 2, 3]) AS t(i) WHERE s_suppkey % 5 = 0 AND s_suppkey > 0")
def planted_feature_commits(spark, d):
    """The commits that each merge brought in: ancestors of its side that aren't its main line's."""
    return brought(spark, d)


@query("""SELECT avg(CAST(2 * pace AS DOUBLE) / 86400) AS lifetime_days, avg(CAST(3 * 86400 - pace AS DOUBLE) / 86400) AS time_to_merge_days, avg(CAST(3 * 86400 - 3 * pace AS DOUBLE) / 3600) AS delay_hours
    FROM (SELECT 3600 + s_suppkey % 7 * 600 AS pace FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey > 0)""")
def planted_merge_times(spark, d):
    """Means of lifetime, time to merge and delay, from the commits that merges brought in."""
    return history.merge_timing(history.merge_times(main_line(spark, d), merges(spark, d), brought(spark, d)))


REFS = [("feature/a/x{k}", "head"), ("release/{k}", "head"), ("origin/fix-{k}", "remote"), ("v1.{k}.0", "tag"), ("note-{k}", "tag")]


def refs(spark, d) -> DataFrame:
    files = planted(spark, d, REFS)
    return files.select(F.col("file_path").alias("name"), F.col("text").alias("kind"))


@query("""SELECT count(*) FILTER (i IN (0, 1)) AS local_branches, count(*) FILTER (i = 2) AS remote_branches, CASE WHEN count(*) FILTER (i = 0) > 0 THEN 3 ELSE 2 END AS max_depth, count(*) FILTER (i = 1) AS merged_branches
    FROM (SELECT p_partkey % 5 AS i FROM part)""")
def planted_branches(spark, d):
    """Local, remote and merged branches, and the deepest name."""
    return history.branch_counts(refs(spark, d), refs(spark, d).filter("name LIKE 'release/%'").unionByName(spark.createDataFrame([("main", "head")], "name string, kind string")))


@query("SELECT count(*) AS tags, count(*) FILTER (p_partkey % 5 = 3) AS version_tags, 'v1.' || max(p_partkey) FILTER (p_partkey % 5 = 3) || '.0' AS latest FROM part WHERE p_partkey % 5 >= 3")
def planted_tags(spark, d):
    """Tags, versions among them, and the newest version by number."""
    return history.tags(refs(spark, d))


@query("SELECT 'm' || s_suppkey AS id, CAST(s_suppkey - 1 AS INT) AS depth FROM supplier WHERE s_suppkey > 1")
def planted_chain(spark, d):
    """Depth of each class below the root of one long chain of parents."""
    return graph.chain_depths(main_line(spark, d).filter("hash LIKE 'm%' AND parent IS NOT NULL").select(F.col("hash").alias("id"), "parent"))


# graph between files


@query("""SELECT DISTINCT 'App/S' || a.p_partkey || '.swift' AS src, 'App/Legacy-Bridging-Header.h' AS dst FROM part a
    UNION ALL SELECT 'App/Legacy-Bridging-Header.h', 'App/Old' || p_partkey || '.h' FROM part
    UNION ALL SELECT 'App/Use' || p_partkey || '.m', 'App/App-Swift.h' FROM part""")
def planted_interop(spark, d):
    """Edges of a mixed project: Swift to its bridging header, that to what it imports, Objective-C to the generated header."""
    k = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"))
    path = lambda a, b: k.select(F.concat(F.lit(a), "k", F.lit(b)).alias("path"))
    fixed = spark.createDataFrame([("App/Legacy-Bridging-Header.h",), ("App/App-Swift.h",)], "path string")
    files = path("App/S", ".swift").union(path("App/Old", ".h")).union(path("App/Use", ".m")).union(fixed).withColumn("package", F.lit("App"))
    imports = k.select(F.lit("App/Legacy-Bridging-Header.h").alias("path"), F.concat(F.lit("Old"), "k", F.lit(".h")).alias("name")).union(k.select(F.concat(F.lit("App/Use"), "k", F.lit(".m")), F.lit("App-Swift.h")))
    return graph.interop_edges(files, imports)
