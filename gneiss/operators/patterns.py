"""Design patterns: ends of declared names, and marks in a file's stripped lines, joined and counted.

A mark is a regular expression over single lines or a test over a file. A file's marks and declarations tell,
in its own row, of patterns (name, category); these are then counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import cut
from gneiss.operators.constructs import not_own_scanner

# fixed values: what marks a file, as patterns over its lines
LINE_MARKS = {
    "singleton": r"static (?:let|var) (?:shared|instance(?!\w))",
    "copies": r"func (?:copy|clone)\(\)|[:,] NSCopying",
    "observes": r"NotificationCenter\.default|\.addObserver\((?:self|forName)|\.publisher\(for:",
    "executes": r"func (?:execute\(|run\(\)|call\(\))",
    "command_protocol": r"protocol Command(?: \{|:|able)|[:,] Command(?: \{|,)",
    "invokes": r": \[Command\]|\[any Command\]|commands\.forEach",
    "calls_execute": r"\.execute\(\)",
    "iterates": r"[:,] IteratorProtocol|func next\(\) ->",
    "pools": r"func (?:acquire|release|checkout|checkin|borrow|reuse|recycle|returnObject|returnToPool)\(",
    "chains": r"(?:var|let) (?:next|successor):",
    "template": r"func templateMethod",
    "state_protocol": r"protocol State(?: \{|:|Protocol)",
    "state_conforms": r"[:,] State(?: \{|,|Protocol)",
    "interprets": r"func interpret\(",
    "multiton": r"static (?:var|let) instances(?:: \[| ?= ?\[)",
    "lazy": r"lazy var ",
    "publishes": r"@Published|[:,] ObservableObject|import Combine",
    "injects": r"import Swinject",
}
# fixed values: pattern, category, end of the name, kinds (empty: all but extensions), mark that the file needs
BY_NAME = (
    ("Builder", "creational", "Builder", "", ""), ("Adapter", "structural", "Adapter", "", ""), ("Decorator", "structural", "Decorator", "", ""), ("Facade", "structural", "Facade", "", ""), ("Proxy", "structural", "Proxy", "", ""),
    ("Composite", "structural", "Composite", "", ""), ("Bridge", "structural", "Bridge", "", ""), ("Flyweight", "structural", "Flyweight", "", ""), ("Front Controller", "structural", "FrontController", "", ""),
    ("Object Pool", "structural", "Pool", "class struct actor", "pools"), ("Caching", "structural", "Cache", "class struct actor", ""), ("Delegation", "behavioral", "Delegate", "protocol", ""), ("Strategy", "behavioral", "Strategy", "", ""),
    ("Chain of Resp.", "behavioral", "Handler", "", "chains"), ("Mediator", "behavioral", "Mediator", "", ""), ("Visitor", "behavioral", "Visitor", "", ""), ("Memento", "behavioral", "Memento", "class struct", ""),
    ("Memento", "behavioral", "Snapshot", "class struct", ""), ("Specification", "behavioral", "Specification", "", ""),
)
# fixed values: pattern, category, mark whose files are counted
BY_MARK = (
    ("Singleton", "creational", "singleton"), ("Prototype", "creational", "copies"), ("Multiton", "creational", "multiton"), ("Lazy Initialization", "creational", "lazy"), ("Read–Write Lock", "concurrency", "barrier"),
    ("Double-Checked Locking", "concurrency", "double_check"), ("Thread Pool", "concurrency", "thread_pool"), ("Fluent Interface", "structural", "fluent"), ("Iterator", "behavioral", "iterates"), ("Template Method", "behavioral", "template"),
)
#: A factory's name, where no factory of the project is a protocol.
FACTORY = "Factory Method"
IDIOMS = ("Lazy Initialization", "Extension", "Monitor Object")
CATEGORIES = ("creational", "structural", "concurrency", "behavioral")


def tested(path: Column) -> Column:
    return path.endswith(".swift") & ~path.contains("/Tests/") & ~path.contains("/Test/")


def marks(lines: Column, text: Column) -> dict[str, Column]:
    """Whether a file has each mark, from its stripped lines and from these as one text.

    No pattern of a mark spans lines, so the whole text is tried once. Nor need modifiers be taken off first:
    what fits a line's rest fits the line.
    """
    has = lambda p: text.rlike(p)
    out = {m: has(p) for m, p in LINE_MARKS.items()} | {
        "barrier": text.contains("DispatchQueue") & text.contains(".barrier"),
        "double_check": text.contains("os_unfair_lock") & (F.regexp_count(text, F.lit("== nil")) > 1),
        "thread_pool": text.contains("OperationQueue") & text.contains("maxConcurrentOperationCount") & ~has("maxConcurrentOperationCount ?= ?1"),
        "fluent": F.size(F.filter(lines, lambda x: x.contains("func ") & x.contains("-> Self"))) > 1,
    }
    out["invokes"] = out["invokes"] | (text.contains("var commands") & out["calls_execute"])
    return out


def evidence(scan: DataFrame) -> DataFrame:
    """name, category, how and path of everything in files (file_path, stripped, declarations) that tells of a pattern.

    how: ``sure``, which counts; ``maybe``, which counts where the pattern is proven in the project and nothing is sure;
    ``proof``. It is told in the file's row, so nothing is shuffled.
    """
    own = scan.filter(tested(F.col("file_path"))).select("file_path", "stripped", F.coalesce("declarations", F.array()).alias("declarations"))
    own = own.withColumn("text", F.array_join("stripped", "\n"))
    looked = not_own_scanner(F.col("file_path"))
    found = {m: F.coalesce(looked & c, F.lit(False)).alias(m) for m, c in marks(F.col("stripped"), F.col("text")).items()}
    empty = F.coalesce(F.regexp_extract_all("text", F.lit(r"protocol\s+(\w+)[^{}]*\{\s*\}"), F.lit(1)), F.array())  # protocols with an empty body
    files = own.select("file_path", "declarations", empty.alias("empty"), *found.values())
    one = lambda fits, name, category, how="sure": F.when(fits, F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), F.lit(how).alias("how")))
    col = F.col

    def declared(d: Column) -> Column:
        name, kind = d["name"], d["kind"]
        other = kind != "extension"
        cases = []
        for pattern, category, end, kinds, mark in BY_NAME:
            fits = other & name.endswith(end)
            if kinds:
                fits = fits & kind.isin(*kinds.split())
            cases.append(one(fits & col(mark) if mark else fits, pattern, category))
        factory = other & name.endswith("Factory")
        typed = kind.isin("class", "struct", "protocol") & (name.contains("Command") | (name.rlike("Action|Operation|Task") & col("executes")))
        return F.array_compact(F.array(
            *cases,
            one(name.rlike("^Null[A-Z]") & kind.isin("class", "struct", "enum"), "Null Object", "behavioral"),
            one(kind == "actor", "Monitor Object", "concurrency"),
            one(~other, "Extension", "structural"),
            one((kind == "protocol") & F.array_contains("empty", name), "Marker", "structural"),
            one(factory, FACTORY, "creational"),
            one(factory & (kind == "protocol"), FACTORY, "creational", "proof"),
            one(typed, "Command", "behavioral"),
        ))

    injects = lambda d: d["name"].rlike("(ServiceLocator|DIContainer|Injector)$") & d["kind"].isin("class", "struct", "protocol", "actor")
    primary = col("executes") | col("command_protocol") | col("invokes")
    # what many things of a file tell of counts once
    whole = F.array_compact(F.array(
        *(one(col(m), name, category) for name, category, m in BY_MARK),
        one(F.exists("declarations", injects) | col("injects"), "Dependency Injection", "creational"),
        one(col("observes") | col("publishes"), "Observer", "behavioral"),
        one(F.exists("declarations", lambda d: (d["kind"] != "extension") & d["name"].endswith("Interpreter")) | col("interprets"), "Interpreter", "behavioral"),
        one(col("state_conforms"), "State", "behavioral", "maybe"),
        one(col("state_protocol"), "State", "behavioral", "proof"),
        one(primary | col("calls_execute"), "Command", "behavioral", "maybe"),  # types by name come first, else files
        one(primary, "Command", "behavioral", "proof"),
    ))
    told = F.concat(whole, F.flatten(F.transform("declarations", declared)))
    return files.select(F.explode(told).alias("p"), F.col("file_path").alias("path")).select("p.*", "path")


def detect(scan: DataFrame, declarations: DataFrame | None = None) -> DataFrame:
    """name, category, count, example_path, is_idiom; by category, most first.

    From scanned files with their declarations, in one pass, or with declarations from elsewhere (file_path, name, kind).
    """
    if declarations is not None:
        per = declarations.filter(tested(F.col("file_path"))).groupBy("file_path").agg(F.collect_list(F.struct("name", "kind")).alias("declarations"))
        scan = scan.select("file_path", "stripped").join(per, "file_path", "full")
    how = lambda x: F.col("how") == x
    first = lambda x: F.min(F.when(how(x), F.col("path"))).alias(f"{x}_path")
    told = evidence(scan).groupBy("name", "category").agg(F.count_if(how("sure")).alias("sure"), F.count_if(how("maybe")).alias("maybe"), F.bool_or(how("proof")).alias("proven"), first("sure"), first("maybe"))
    sure = F.col("sure") > 0
    name = F.when((F.col("name") == FACTORY) & F.col("proven"), "Abstract Factory").otherwise(F.col("name"))
    found = told.filter(sure | (F.col("proven") & (F.col("maybe") > 0))).select(name.alias("name"), "category", F.when(sure, F.col("sure")).otherwise(F.col("maybe")).alias("count"), F.when(sure, F.col("sure_path")).otherwise(F.col("maybe_path")).alias("example_path"))
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return cut(found).withColumn("is_idiom", F.col("name").isin(*IDIOMS)).orderBy(order, F.col("count").desc(), "name")
