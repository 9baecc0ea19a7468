"""Code style: counts of protocol, value and inheritance features, and the score they make."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import cut
from gneiss.functions.text import is_comment, trim
from gneiss.operators import graph

COUNTS = ("classes", "structs", "protocols", "enums", "generics", "conform_one", "conform_many", "extended", "associated", "opaque", "composed", "finals", "enum_payloads", "depth_sum", "depth_count", "overrides", "root_objects", "implemented")


def capped(n: Column, d: Column | int, empty: float) -> Column:
    """n / d, at most 1; the given value where d is 0."""
    d = F.lit(d) if isinstance(d, int) else d
    return F.when(d > 0, F.least(n / d, F.lit(1.0))).otherwise(empty)


def scores(counts: DataFrame) -> DataFrame:
    """One row of counts with the 13 sub-scores, the three category scores and the total in per cent."""
    c = {k: F.col(k) for k in COUNTS}
    n, p = c["classes"] + c["structs"], c["protocols"]
    least1 = lambda x: F.greatest(x, F.lit(1))
    sub = {
        "protocol_density": F.when(n > 0, F.least(4 * p / n, F.lit(1.0))).otherwise(F.when(p > 0, 1.0).otherwise(0.0)),
        "constrained_generics": F.when(n > 0, F.least(c["generics"] / least1(F.floor(n / 5)), F.lit(1.0))).otherwise(0.5),
        "conformance_breadth": capped(c["conform_many"], c["conform_one"] + c["conform_many"], 0.0),
        "default_implementations": capped(c["extended"], c["implemented"], 0.0),
        "associated_types": F.least(c["associated"] / least1(F.floor(p / 4)), F.lit(1.0)),
        "opaque_protocols": capped(c["opaque"], p, 0.0),
        "composition": F.least(c["composed"] / least1(F.floor(p / 2)), F.lit(1.0)),
        "struct_ratio": capped(c["structs"], n, 0.5),
        "final_ratio": capped(F.least(c["finals"], c["classes"]), c["classes"], 0.5),
        "enum_payload": F.when(c["enums"] > 0, F.least(c["enum_payloads"] / least1(F.floor(c["enums"] * 0.3)), F.lit(1.0))).otherwise(0.5),
        "inheritance_depth": 1 - F.least(F.greatest(F.when(c["depth_count"] > 0, c["depth_sum"] / c["depth_count"]).otherwise(1.0) - 1, F.lit(0.0)) / 4, F.lit(1.0)),
        "override_density": F.when(c["classes"] > 0, F.greatest(1 - c["overrides"] / (c["classes"] * 3), F.lit(0.0))).otherwise(0.5),
        "root_objects_score": F.when(c["classes"] > 0, F.greatest(1 - c["root_objects"] / c["classes"], F.lit(0.0))).otherwise(0.5),
    }
    out = counts.withColumns(sub)
    # fixed values: weights of the sub-scores in their category, and of the categories
    protocol = {"protocol_density": 0.25, "constrained_generics": 0.15, "conformance_breadth": 0.20, "default_implementations": 0.15, "associated_types": 0.10, "opaque_protocols": 0.10, "composition": 0.05}
    value = {"struct_ratio": 0.45, "final_ratio": 0.30, "enum_payload": 0.25}
    inheritance = {"inheritance_depth": 0.40, "override_density": 0.35, "root_objects_score": 0.25}
    weighted = lambda w: sum((F.col(k) * x for k, x in w.items()), F.lit(0.0))
    out = out.withColumns({
        "protocol_score": F.when(p > 0, weighted(protocol)).otherwise(weighted({"protocol_density": 0.60, "constrained_generics": 0.40})),
        "value_score": weighted(value),
        "inheritance_score": weighted(inheritance),
    })
    total = F.col("protocol_score") * 0.55 + F.col("value_score") * 0.30 + F.col("inheritance_score") * 0.15
    return out.withColumn("total", F.floor(F.least(F.greatest(total * 100, F.lit(0.0)), F.lit(100.0))).cast("int"))


# fixed values: patterns of declarations
CLASS = r"^\s*((?:(?:public|internal|private|fileprivate|open|final)\s+)*)class\s+([A-Z]\w*)(?:\s*<[^>]+>)?\s*(?::\s*([^\{]+))?"
STRUCT = r"^\s*(?:(?:public|internal|private|fileprivate)\s+)*struct\s+[A-Z]\w*(?:\s*<[^>]+>)?\s*(?::\s*([^\{]+))?"
CONSTRAINED = r"\bfunc\s+\w+\s*<[^>]*:\s*[A-Z]|\bwhere\s+\w+\s*:\s*[A-Z]"


# fixed values: a line with none of these has no feature
SAID = ("class", "struct", "extension ", "some", "override ", "associatedtype ", "case ", "&", "func", "where")
#: The columns of lines (see security.lines) that are looked at.
LOOKED_AT = ("raw", "code", "after5")


def conformances(clause: Column) -> Column:
    """The names of a conformance list, up to its where clause."""
    head = F.split(F.concat(clause, F.lit(" ")), r"\swhere\s")[0]
    return F.filter(F.transform(F.split(head, ","), lambda x: F.regexp_extract(F.trim(x), r"^([^\s<]+)", 1)), lambda x: x != "")


def count(lined: DataFrame, declarations: DataFrame) -> DataFrame:
    """The one row of counts from lines (see security.lines) and declarations (file_path, name, kind).

    Classes and protocols are counted by name, other kinds by occurrence. ``extra`` counts are informational.
    Lines are looked at once: one that may have a feature becomes a row of its flags and of the names it uses, and
    all names meet the declared ones in one join.
    """
    # how each declared name is used, one row a name
    of = lambda kind: F.col("kind") == kind
    swift = declarations.filter("file_path LIKE '%.swift'").groupBy("name")
    roles = cut(swift.agg(F.bool_or(of("class")).alias("is_class"), F.bool_or(of("protocol")).alias("is_protocol"), *(F.count_if(of(k)).alias(a) for k, a in (("struct", "structs"), ("enum", "enums"), ("actor", "actors")))))
    named = F.col("name").isNotNull()
    kinds = roles.agg(F.count_if(named & F.col("is_class")).alias("classes"), F.count_if(named & F.col("is_protocol")).alias("protocols"), *(F.coalesce(F.sum(a), F.lit(0)).alias(a) for a in ("structs", "enums", "actors")))
    raw, code, t = F.col("raw"), F.col("code"), F.col("t")
    said = functools.reduce(lambda a, b: a | b, (raw.contains(w) for w in SAID))  # before any pattern, so these are tried once and on few lines
    rows = lined.filter(F.col("file_path").endswith(".swift") & said & ~is_comment(raw)).select("raw", "code", "after5", trim(raw).alias("t"))
    is_class, is_struct = raw.contains("class") & raw.rlike(CLASS), raw.contains("struct") & raw.rlike(STRUCT)
    listed = F.when(is_class, conformances(F.regexp_extract("raw", CLASS, 3))).when(is_struct, conformances(F.regexp_extract("raw", STRUCT, 1)))
    filled = F.exists(F.transform(F.split("after5", "\n"), trim), lambda x: (x != "") & (x != "}") & ~x.startswith("//"))
    marked = rows.select(
        is_class.alias("class"),
        F.when(is_class, F.regexp_extract("raw", CLASS, 2)).alias("child"),
        (is_class & F.regexp_extract("raw", CLASS, 1).contains("final")).alias("final"),
        listed.alias("listed"),
        F.when(t.startswith("extension "), F.struct(F.regexp_extract("raw", r"^\s*extension\s+(\w+)", 1).alias("name"), filled.alias("filled"))).alias("extension"),
        F.when(code.contains("some"), F.regexp_extract_all("code", F.lit(r"\bsome\s+(\w+)"), F.lit(1))).alias("some"),
        t.startswith("override ").alias("override"),
        t.startswith("associatedtype ").alias("associated"),
        (t.startswith("case ") & t.rlike(r"^case (?!\.|let|var).*\(")).alias("payload"),
        (code.contains("&") & code.rlike(r"\b[A-Z]\w*\s*&\s*[A-Z]\w*")).alias("composed"),
        code.rlike(CONSTRAINED).alias("generic"),
    )
    marked = cut(marked)
    plain = marked.agg(
        F.count_if("override").alias("overrides"),
        F.count_if("associated").alias("associated"),
        F.count_if("payload").alias("enum_payloads"),
        F.count_if("composed").alias("composed"),
        F.count_if("generic").alias("generics"),
        F.count_if("final").alias("finals"),
        F.count_if(F.size("listed") == 0).alias("alone"),
    )
    # what types list, what extensions extend, and what ``some`` stands before
    use = lambda of, name, first=F.lit(False), filled=F.lit(False): F.struct(F.lit(of).alias("of"), name.alias("name"), first.alias("first"), filled.alias("filled"))
    lists = (
        F.transform("listed", lambda x, i: use("type", x, i == 0)),
        F.when(F.col("extension").isNotNull(), F.array(use("extension", F.col("extension.name"), filled=F.col("extension.filled")))),
        F.transform("some", lambda x: use("some", x)),
    )
    uses = F.flatten(F.array_compact(F.array(*lists)))
    each = marked.select("class", "child", F.size("listed").alias("n"), F.explode(uses).alias("u")).select("class", "child", "n", "u.*")
    each = each.join(roles.filter("is_class OR is_protocol").select("name", "is_class", "is_protocol").hint("merge"), "name", "left")  # both grow with the project
    each = cut(each.select("name", "class", "child", "n", "of", "first", "filled", F.coalesce("is_class", F.lit(False)).alias("is_class"), F.coalesce("is_protocol", F.lit(False)).alias("is_protocol")))
    of = lambda use: F.col("of") == use
    first, own = of("type") & F.col("first"), F.col("class") & (F.col("name") == "NSObject")
    parent = F.col("class") & (own | F.col("is_class") | ~F.col("is_protocol"))
    n = F.when(first, F.col("n") - F.when(parent, 1).otherwise(0))
    totals = each.agg(
        F.count_if(n == 0).alias("conform_none"),
        F.count_if(n == 1).alias("types_one"),
        F.count_if(n >= 2).alias("types_many"),
        F.count_if(first & own).alias("root_objects"),
        F.count_if(of("extension")).alias("extensions"),
        F.count_if(of("extension") & F.col("is_protocol") & F.col("filled")).alias("extended"),
        F.count_if(of("some") & F.col("is_protocol")).alias("opaque"),
        F.count_if(of("some") & ~F.col("is_protocol")).alias("opaque_framework"),
    )
    met = each.filter(of("type") & F.col("is_protocol")).groupBy("name").agg(F.count("*").alias("n"))
    met = met.agg(F.count_if(F.col("n") == 1).alias("conform_one"), F.count_if(F.col("n") >= 2).alias("conform_many"), F.count("*").alias("implemented"))
    above = each.filter(first & F.col("class") & F.col("is_class") & (F.col("name") != F.col("child"))).groupBy(F.col("child").alias("id")).agg(F.max("name").alias("parent"))
    depths = graph.chain_depths(above).agg(F.coalesce(F.sum(F.col("depth") + 1), F.lit(0)).alias("depth_sum"), F.count("*").alias("depth_count"), F.coalesce(F.max(F.col("depth") + 1), F.lit(1)).alias("max_depth"))
    out = kinds
    for part in (totals, met, depths, plain):
        out = out.join(part)  # one row by one row
    return out.withColumn("conform_none", F.col("conform_none") + F.col("alone")).drop("alone")


def analyze(lined: DataFrame, declarations: DataFrame) -> DataFrame:
    return scores(count(lined, declarations))
