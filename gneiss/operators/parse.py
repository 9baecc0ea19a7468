"""Source files to rows: imports, declarations, extents, notes; one Arrow pass per whole file, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import extension, module_of

SPACE = " \t             　"
IMPORT_KINDS = {"struct", "class", "enum", "protocol", "func", "var", "let", "typealias"}
DECLARATION = re.compile(r"(?:(?:public|internal|private|fileprivate|open) )?(?:final )?(?:nonisolated )?(class|struct|enum|protocol|actor|extension) ([\w.]*)")
# fixed values: words after a keyword that aren't names
NOT_NAMES = set((
    "func", "var", "let", "subscript", "init", "deinit", "typealias", "case", "where", "if", "guard", "switch", "for", "while", "return", "throw", "try",
)) | {""}
FUNCTION = re.compile(r"func (\w+)")
OBJC_IMPORT = re.compile(r'^[ \t]*#(?:import|include)[ \t]*[<"]([^>"]+)[>"]', re.M)
OBJC_MODULE = re.compile(r"^[ \t]*@import[ \t]+([\w.]+)", re.M)
OBJC_TYPE = re.compile(r"^[ \t]*@(?:interface|protocol)[ \t]+(\w+)", re.M)

SCHEMA = (
    "file_path string, line_count int, imports array<string>, description string, todo_count int, fixme_count int, "
    "declarations array<struct<name:string,kind:string,line:int>>, longest_function struct<name:string,start_line:int,line_count:int>, "
    "biggest_type struct<name:string,kind:string,start_line:int,line_count:int>"
)


class Span:
    """The longest of the brace-balanced spans that don't lie in one another."""

    def __init__(self):
        self.open: dict | None = None
        self.best: dict | None = None

    def start(self, number: int, **named) -> None:
        if self.open is None:
            self.open = {**named, "start_line": number, "depth": 0}

    def feed(self, number: int, line: str) -> None:
        if self.open is None:
            return
        self.open["depth"] += line.count("{") - line.count("}")
        if self.open["depth"] <= 0 and "}" in line:
            size = number - self.open["start_line"] + 1
            if self.best is None or size > self.best["line_count"]:
                self.best = {k: v for k, v in self.open.items() if k != "depth"} | {"line_count": size}
            self.open = None


def parse_swift(text: str, whole: bool = True) -> dict:
    """What SCHEMA names of one file; not whole: its lines, imports and declarations, and nothing else is worked out."""
    lines = re.split(r"\r\n|\n|\r", text)
    if lines and lines[-1] == "":
        lines.pop()
    out: dict = {"imports": [], "declarations": [], "description": "", "todo_count": 0, "fixme_count": 0, "line_count": len(lines)}
    functions, types, doc, scope = Span(), Span(), [], 0
    for number, raw in enumerate(lines, 1):
        line = raw.strip(SPACE)
        if line.startswith("import "):
            rest = line[7:].split(" ", 1)
            token = rest[1] if len(rest) == 2 and rest[0] in IMPORT_KINDS else rest[0]
            if name := re.match(r"[\w.]*", token)[0]:
                out["imports"].append(name)
            doc = []
            continue
        if (m := DECLARATION.match(line)) and m[2] not in NOT_NAMES and scope == 0:
            out["declarations"].append({"name": m[2], "kind": m[1], "line": number})
            out["description"] = out["description"] or " ".join(doc)
            if whole and m[1] != "extension":
                types.start(number, name=m[2], kind=m[1])
        if not line.startswith("//"):
            scope = max(scope + line.count("{") - line.count("}"), 0)
            if whole and "func " in line and (f := FUNCTION.search(line)):
                functions.start(number, name=f[1])
        if not whole:
            continue
        functions.feed(number, line)
        types.feed(number, line)
        if line.startswith("///"):
            doc.append(line[3:].strip(SPACE))
        elif line:
            doc = []
        out["todo_count"] += "// TODO" in line or "// MARK: TODO" in line
        out["fixme_count"] += "// FIXME" in line
    return out | {"longest_function": functions.best, "biggest_type": types.best}


def parse_objc(text: str) -> dict:
    names = [p.split("/", 1)[0] if "/" in p else p.removesuffix(".h") for p in OBJC_IMPORT.findall(text)]
    found = sorted({n for n in names if n} | set(OBJC_MODULE.findall(text)))
    decls = [{"name": m[1], "kind": "class", "line": text.count("\n", 0, m.start()) + 1} for m in OBJC_TYPE.finditer(text)]
    return {"imports": found, "declarations": decls, "description": "", "todo_count": 0, "fixme_count": 0, "line_count": text.count("\n") + 1, "longest_function": None, "biggest_type": None}


#: Columns that need no look at documentation, notes and extents.
BRIEF = ("file_path", "line_count", "imports", "declarations")


def parsed(files: DataFrame, *wanted: str) -> DataFrame:
    """From (file_path, text): file_path and the wanted columns of SCHEMA (none named: all), one row per .swift, .h, .m or .mm file; other files go."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(SCHEMA)
    if wanted:
        schema = T.StructType([schema[c] for c in ("file_path", *wanted)])
    arrow, whole = to_arrow_schema(schema), not wanted or not set(wanted) <= set(BRIEF)

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = parse_swift(text or "", whole) if path.endswith(".swift") else parse_objc(text or "")
                rows.append({"file_path": path, **made})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    ext = extension(F.col("file_path"))
    return files.filter(ext.isin("swift", "h", "m", "mm")).select("file_path", "text").mapInArrow(run, schema)


def declarations(p: DataFrame) -> DataFrame:
    return p.select("file_path", F.posexplode("declarations").alias("ordinal", "d")).select("file_path", "ordinal", "d.name", "d.kind", "d.line")


def imports(p: DataFrame) -> DataFrame:
    return p.select("file_path", F.posexplode("imports").alias("ordinal", "name"))


# packages


def ancestors(path: Column, most: int = 64) -> Column:
    """The folders above a path, nearest first, with their depth."""
    parts = F.split(path, "/")
    n = F.least(F.size(parts) - 1, F.lit(most))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"))).otherwise(F.array().cast("array<string>"))


# fixed values: manifests, and which counts where a folder holds several
MANIFESTS = (("Package.swift", 1, "SwiftPM"), ("BUILD", 2, "Bazel"), ("BUILD.bazel", 2, "Bazel"), ("Project.swift", 3, "Tuist"))


def manifests(listing: DataFrame) -> DataFrame:
    """dir and build_system of every folder with a manifest, from all paths of the project (rel_path)."""
    listing = listing.filter(F.col("rel_path").rlike("(^|/)(" + "|".join(re.escape(m) for m, _, _ in MANIFESTS) + ")$"))  # few of all files
    name = F.regexp_extract("rel_path", "([^/]*)$", 1)
    kinds = F.create_map(*(x for m, rank, system in MANIFESTS for x in (F.lit(m), F.struct(F.lit(rank).alias("rank"), F.lit(system).alias("system")))))
    held = listing.select(F.regexp_replace("rel_path", "/?[^/]*$", "").alias("dir"), kinds[name].alias("kind")).filter("kind IS NOT NULL")
    return held.groupBy("dir").agg(F.min("kind")["system"].alias("build_system"))


def nearest_manifest(files: DataFrame, listing: DataFrame) -> DataFrame:
    """file_path, home (the nearest folder above with a manifest; '' is the root) and build_system; null for none.

    Each file's folders are joined by equality with those that hold manifests, and the deepest one wins.
    """
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))
    each = files.select("file_path", F.explode(above).alias("a")).select("file_path", "a.depth", "a.dir")
    best = each.join(manifests(listing), "dir").groupBy("file_path").agg(F.max(F.struct("depth", "dir", "build_system")).alias("m"))
    return files.select("file_path").join(best, "file_path", "left").select("file_path", F.col("m.dir").alias("home"), F.col("m.build_system").alias("build_system"))


def packages(files: DataFrame, listing: DataFrame) -> DataFrame:
    """files (file_path and others) with package_name, build_system and module_name, from all paths of the project (rel_path).

    In order: a binary framework, Packages/<name>, the folder above the last Sources that holds a manifest,
    the nearest of ten ancestors with a header of its own name below a repository root. Folders are looked up once,
    however many files they hold, and only those meet that hold a header, a manifest or a root.
    """
    parts = F.split("file_path", "/")
    framework = F.regexp_extract("file_path", r"(?:^|/)([^/]+)\.xcframework(?:/|$)", 1)
    framework = F.when(framework != "", framework).otherwise(F.regexp_extract("file_path", r"(?:^|/)([^/]+)\.framework(?:/|$)", 1))
    named = F.regexp_extract("file_path", r"(?:^|/)Packages/([^/]+)/", 1)
    back = F.array_position(F.reverse(parts), "Sources").cast("int")
    above = F.when((back > 0) & (F.size(parts) - back > 0), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - back), "/"))
    folder = F.when(F.size(parts) > 1, F.regexp_replace("file_path", "/[^/]*$", ""))
    base = files.select(*files.columns, framework.alias("_framework"), named.alias("_named"), above.alias("_root"), folder.alias("_folder"))
    # umbrella headers: the nearest ancestor D with D/D.h, if no root lies at or below it
    dir, name = F.regexp_replace("rel_path", "/?[^/]*$", ""), F.regexp_extract("rel_path", "([^/]*)$", 1)
    path = F.col("rel_path")
    header = F.when(path.endswith(".h"), name == F.concat(F.regexp_extract(dir, "([^/]*)$", 1), F.lit(".h"))).otherwise(False)
    stop = (path == "Package.swift") | path.endswith("/Package.swift")
    root = F.rtrim(F.regexp_replace(F.regexp_extract("rel_path", r"^((?:[^/]+/)*)(?:\.git|[^/]+\.xcodeproj)/", 1), "/$", ""))
    mark = lambda where, umbrella, stop: F.struct(where.alias("dir"), umbrella.alias("umbrella"), stop.alias("stop"))
    held = F.when(header | stop, mark(dir, header, stop))
    within = F.when(path.rlike(r"(^|/)(\.git|[^/]+\.xcodeproj)/"), mark(root, F.lit(False), F.lit(True)))
    marks = listing.select(F.explode(F.array_compact(F.array(held, within))).alias("m")).select("m.*")  # both from one look at a path
    marks = marks.groupBy("dir").agg(F.bool_or("umbrella").alias("umbrella"), F.bool_or("stop").alias("stop"))
    folders = base.select("_folder").filter("_folder IS NOT NULL").distinct()
    up = folders.select("_folder", F.posexplode(F.slice(ancestors(F.concat("_folder", F.lit("/x"))), 1, 10)).alias("i", "dir")).join(marks, "dir")
    near = up.groupBy("_folder").agg(F.min(F.when(F.col("umbrella") & ~F.col("stop"), F.struct("i", "dir"))).alias("u"), F.min(F.when(F.col("stop"), F.col("i"))).alias("s"))
    near = near.filter("u IS NOT NULL AND (s IS NULL OR u.i < s)").select("_folder", F.regexp_extract(F.col("u.dir"), "([^/]*)$", 1).alias("_header"))
    out = base.join(manifests(listing).toDF("_root", "_system"), "_root", "left").join(near, "_folder", "left")
    by_root = F.when(F.col("_system").isNotNull(), F.regexp_extract("_root", "([^/]*)$", 1))
    package = F.coalesce(F.nullif("_framework", F.lit("")), F.nullif("_named", F.lit("")), by_root, F.col("_header"), F.lit(""))
    system = F.when(F.col("_framework") != "", "Unknown").when(F.col("_named") != "", "SwiftPM").otherwise(F.coalesce("_system", F.lit("Unknown")))
    return out.select(*files.columns, package.alias("package_name"), system.alias("build_system")).withColumn("module_name", module_of(F.col("file_path"), F.col("package_name")))
