"""Rule tables joined with names and lines: longest suffix, token sets, innermost ranges, overlapping arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import name_tokens


def longest_suffix(names: DataFrame, rules: DataFrame, key: list[str], name: str = "name", kept: list[str] | None = None) -> DataFrame:
    """names with the label of the longest rule (suffix, label) that they end with; rows without one go.

    Names are exploded to their suffixes and joined by equality with the rules, a fixed table that is broadcast,
    so no row meets every rule and the names, which grow, stay where they are. kept: further columns of the names.
    """
    n = F.length(name)
    rest = kept or []
    ends = names.select(*key, *rest, F.explode(F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col(name), i, n)))).alias("suffix"))
    found = ends.join(F.broadcast(rules.select("suffix", "label")), "suffix")
    best = found.groupBy(*key).agg(F.max(F.struct(F.length("suffix").alias("n"), "suffix", "label")).alias("b"), *(F.first(c).alias(c) for c in rest))
    return best.select(*key, F.col("b.suffix").alias("suffix"), F.col("b.label").alias("label"), *rest)


def token_rules(names: DataFrame, rules: DataFrame, key: list[str], name: str = "name") -> DataFrame:
    """names with their most specific rule: most tokens, then longest joined text, then first ordinal.

    rules: ordinal, label, tokens, blockers, context (arrays; context empty: none needed). A rule fits if the
    name has all its tokens, or holds them joined if they are several; none of its blockers; some context.
    The rules are a fixed table, which is broadcast; names are read once and never broadcast.
    """
    rules = rules.withColumn("joined", F.array_join("tokens", ""))
    # what a rule is met by: all of its tokens, or its joined text if it has several
    by_token = rules.select("ordinal", F.explode(F.array_distinct("tokens")).alias("term"), F.size(F.array_distinct("tokens")).alias("need"), F.lit(False).alias("whole"))
    by_text = rules.filter("size(tokens) > 1").select("ordinal", F.col("joined").alias("term"), F.lit(1).alias("need"), F.lit(True).alias("whole"))
    lengths = [r[0] for r in by_text.select(F.length("term")).distinct().collect()]  # of a fixed table
    cut = names.select(*key, name_tokens(F.col(name)).alias("cut")).select(*key, F.array_distinct("cut").alias("have"), F.array_join("cut", "").alias("all"))
    none = F.array().cast("array<string>")

    def pieces(n: int):
        """All substrings of n letters."""
        starts = F.sequence(F.lit(1), F.length("all") - n + 1)
        return F.when(F.length("all") >= n, F.transform(starts, lambda i: F.substring(F.col("all"), i, F.lit(n)))).otherwise(none)

    parts = F.array_distinct(F.flatten(F.array(*map(pieces, sorted(lengths))))) if lengths else none
    marked = lambda terms, whole: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(whole).alias("whole")))
    each = cut.select(*key, "have", F.explode(F.concat(marked(F.col("have"), False), marked(parts, True))).alias("t")).select(*key, "have", "t.term", "t.whole")
    met = each.join(F.broadcast(by_token.union(by_text)), ["term", "whole"]).groupBy(*key, "ordinal", "whole", "need").agg(F.count("*").alias("count"), F.first("have").alias("have")).filter("count = need")
    found = met.join(F.broadcast(rules), "ordinal").filter(~F.arrays_overlap("have", "blockers") & ((F.size("context") == 0) | F.arrays_overlap("have", "context")))
    order = F.struct((-F.size("tokens")).alias("tokens"), (-F.length("joined")).alias("joined"), "ordinal", "label")
    return found.groupBy(*key).agg(F.min(order).alias("b")).select(*key, "b.ordinal", "b.label")


def innermost(points: DataFrame, ranges: DataFrame, key: list[str], at: str, first: str, last: str, label: str, default: str = "(top level)") -> DataFrame:
    """points with the label of the shortest range of the same key around them, else the default.

    Key and point together must tell points apart; of equally short ranges the first label in order wins.
    """
    inside = points.join(ranges, key).filter((F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last)))
    best = inside.groupBy(*key, at).agg(F.min(F.struct((F.col(last) - F.col(first)).alias("span"), F.col(label).alias("label")))["label"].alias("symbol"))
    return points.join(best, [*key, at], "left").withColumn("symbol", F.coalesce("symbol", F.lit(default)))


def located(points: DataFrame, ranges: DataFrame, key: list[str], at: str, first: str, last: str, width: int = 64) -> DataFrame:
    """points with the further columns of the range of the same key that holds them, null where none does; ranges of a key don't overlap.

    Ranges are dealt to buckets of ``width`` and joined by equality, so one key's points and ranges spread over many tasks.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    more = [c for c in ranges.columns if c not in (*key, first, last)]
    wide = ranges.select(*(F.col(c).alias(f"_{c}") for c in ranges.columns), F.explode(F.sequence(bucket(first), bucket(last))).alias("_bucket"))
    marked = points.withColumn("_at", bucket(at))
    same = F.col("_at") == F.col("_bucket")
    for c in key:
        same = same & (F.col(c) == F.col(f"_{c}"))
    found = marked.join(wide, same & (F.col(at) >= F.col(f"_{first}")) & (F.col(at) <= F.col(f"_{last}")), "left")
    return found.select(*points.columns, *(F.col(f"_{c}").alias(c) for c in more))


def runs(rows: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """(key, first, last, value): rows of a key whose places follow each other and hold one value, as one interval."""
    order = Window.partitionBy(*key).orderBy(at)
    new = ~((F.col(at) == F.lag(at).over(order) + 1) & F.col(value).eqNullSafe(F.lag(value).over(order)))
    numbered = rows.withColumn("_run", F.sum(F.coalesce(new, F.lit(True)).cast("long")).over(order))
    return numbered.groupBy(*key, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.first(value).alias(value)).drop("_run")


def overlapping(rules: DataFrame, rule_items: str, items: DataFrame, item: str) -> DataFrame:
    """rules any of whose items (an array) occurs, with those that do as ``matched``."""
    each = rules.select("*", F.explode(rule_items).alias("_item")).join(items.select(F.col(item).alias("_item")).distinct(), "_item")
    keys = [c for c in rules.columns if c != rule_items]
    return each.groupBy(*keys).agg(F.array_sort(F.collect_set("_item")).alias("matched"))


def constants(tokens: DataFrame, table: DataFrame, fixed: bool = False) -> DataFrame:
    """tokens (value, is_hex, ...) with the labels of equal values in (value, label, category); decimals below 65536 say too little.

    fixed: the table doesn't grow and is broadcast, so that a value that very many tokens have stays spread.
    """
    named = table.groupBy("value").agg(F.array_join(F.array_sort(F.collect_set("label")), " / ").alias("label"))
    return tokens.filter((F.col("value") >= 65536) | F.col("is_hex")).join(F.broadcast(named) if fixed else named, "value")
