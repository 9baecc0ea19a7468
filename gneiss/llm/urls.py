"""URL filters: fixed rules by host and path, and for the rest a tree of path templates per host.

The tree is grown level by level over the different (host, path): the segments of those that share a
template so far are its branches.

* A branch is rare if it holds less than one in FEW of its parent's paths. Where more than FEW are rare, the
  segment is variable there and the rare branches become one wildcard, ``*``.
* The others are held against the largest branch by two tests of two samples: whether what follows has the
  same kinds of segments (chi square), and whether the labelled paths are blocked as often (two proportions;
  no labels on either side: no evidence against). Branches that pass both are one with it, ``~``.

A template is rejected if at least COVERED of its paths are labelled and their blocked share, smoothed
towards its host's and the whole table's, reaches THRESHOLD. So unlabelled branches are judged with labelled
siblings that are like them, and a template of which little is known is allowed. Labelled are the urls that a
rule fits; for these the rule's verdict stands. Copies of a url don't change any verdict.

All counts are grouped sums formed before the shuffle; urls themselves are only joined with their
templates. One round per level, until no template has two paths left. Defined results: a null url, or one
without ``://``, has an empty host and path and is judged like any other; empty segments don't count;
repeated rows and ids are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import write_shared


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path: it fits the host and its subdomains where the path starts so

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))
FEW, Z, SMOOTH, COVERED, THRESHOLD = 12, 1.96, 2.0, 0.5, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """The segments of a path; those that read like a mark of the tree are escaped."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.isin("*", "~"), F.concat(F.lit("%"), s)).otherwise(s))


def kind_after(parts: Column, level: int) -> Column:
    """What follows a level: how many segments, and the next one with digits as '#' and other runs as 'a'."""
    after = F.greatest(F.size(parts) - level, F.lit(0))
    following = F.when(after > 0, F.element_at(parts, F.least(F.lit(level + 1), F.size(parts)))).otherwise(F.lit(""))
    return F.concat(after.cast("string"), F.lit(":"), F.regexp_replace(F.regexp_replace(following, "[0-9]+", "#"), "[^#.]+", "a"))


def templates(paths: DataFrame) -> DataFrame:
    """From the different (host, path, blocked, allowed): host, path, template, purity and whether it is rejected."""
    live = write_shared(paths.select("host", "path", segments(F.col("path")).alias("parts"), "blocked", "allowed", F.lit("").alias("template")), "url-level")
    tree_row = ("host", "path", "blocked", "allowed")
    done, level = [live.filter("size(parts) = 0").select(*tree_row, "template")], 0
    live = live.filter("size(parts) > 0")
    while not live.isEmpty():
        level += 1
        live = live.withColumn("branch", F.element_at("parts", level)).withColumn("kind", kind_after(F.col("parts"), level))
        kinds = live.groupBy("host", "template", "branch", "kind").agg(F.count("*").alias("ck"), F.sum("blocked").alias("cb"), F.sum("allowed").alias("ca"))
        named = write_shared(longer(write_shared(kinds, "url-kinds")), "url-branches")
        grown = write_shared(live.drop("kind").join(named, ["host", "template", "branch"]).select(*tree_row, "parts", F.col("longer").alias("template"), "alone"), "url-level")
        # what has ended, or is alone under its template, is named to its end
        ended = F.col("alone") | (F.size("parts") <= level)
        rest = F.concat(F.col("template"), F.concat_ws("", F.transform(F.slice("parts", level + 1, 1 << 30), lambda s: F.concat(F.lit("/"), s))))
        done.append(grown.filter(ended).select(*tree_row, rest.alias("template")))
        live = grown.filter(~ended).drop("alone")
    tree = write_shared(functools.reduce(DataFrame.union, done), "url-tree")
    total = tree.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("allowed"), F.lit(0)).alias("a")).first()
    overall = (total["b"] + 1.0) / (total["b"] + total["a"] + 2.0)
    share = lambda b, a, prior: (b + SMOOTH * prior) / (b + a + SMOOTH)
    hosts = tree.groupBy("host").agg(F.sum("blocked").alias("hb"), F.sum("allowed").alias("ha"))
    hosts = hosts.select("host", share(F.col("hb"), F.col("ha"), F.lit(overall)).alias("host_share"))
    leaves = tree.groupBy("host", "template").agg(F.count("*").alias("n"), F.sum("blocked").alias("tb"), F.sum("allowed").alias("ta"))
    judged = leaves.join(hosts, "host").withColumn("purity", share(F.col("tb"), F.col("ta"), F.col("host_share")))
    rejected = (F.col("tb") + F.col("ta") >= COVERED * F.col("n")) & (F.col("purity") >= THRESHOLD)
    judged = judged.select("host", "template", "purity", rejected.alias("rejected"))
    return tree.join(judged, ["host", "template"]).select("host", "path", "template", "purity", "rejected")


def longer(kinds: DataFrame) -> DataFrame:
    """From the counts of (host, template, branch, kind): the template that each branch goes on as, and whether one path alone has it."""
    node = ["host", "template"]
    children = kinds.groupBy(*node, "branch").agg(F.sum("ck").alias("c"), F.sum("cb").alias("cb"), F.sum("ca").alias("ca"))
    largest = F.min(F.struct((-F.col("c")).alias("less"), "branch", F.col("cb").alias("b"), F.col("ca").alias("a"))).alias("top")
    parents = children.groupBy(*node).agg(F.sum("c").alias("n"), largest)
    parents = parents.select(*node, "n", F.col("top.branch").alias("anchor"), (-F.col("top.less")).alias("a"), F.col("top.b").alias("ab"), F.col("top.a").alias("aa"))
    children = children.join(parents, node).withColumn("rare", F.col("c") * FEW < F.col("n"))
    variable = children.groupBy(*node).agg((F.count_if("rare") > FEW).alias("variable"))
    # chi square of a branch's kinds against the anchor's; kinds that only the anchor has are added in one term
    anchors = kinds.join(parents, node).filter("branch = anchor").select(*node, "kind", F.col("ck").alias("ak"))
    b, a, ak = F.col("c"), F.col("a"), F.coalesce("ak", F.lit(0))
    term = F.pow(F.col("ck") * F.sqrt(a / b) - ak * F.sqrt(b / a), F.lit(2)) / (ak + F.col("ck"))
    sums = kinds.select(*node, "branch", "kind", "ck").join(anchors, [*node, "kind"], "left").join(children.select(*node, "branch", "c", "a"), [*node, "branch"])
    sums = sums.groupBy(*node, "branch").agg(F.sum(term).alias("terms"), F.sum(ak).alias("met"), F.count_if(F.col("ak").isNull()).alias("own"))
    both = children.join(sums, [*node, "branch"]).join(variable, node).join(anchors.groupBy(*node).agg(F.count("*").alias("kinds")), node)
    chi, freedom = F.col("terms") + (a - F.col("met")) * b / a, (F.col("kinds") + F.col("own") - 1).cast("double")
    alike = chi <= freedom + Z * F.sqrt(2 * freedom) + 1e-9
    n, m = F.col("cb") + F.col("ca"), F.col("ab") + F.col("aa")
    pooled = F.try_divide(F.col("cb") + F.col("ab"), n + m)
    apart = F.abs(F.try_divide(F.col("cb"), n) - F.try_divide(F.col("ab"), m))
    z = apart / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.01)) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m)))
    like = (F.col("c") < F.col("n")) & ((F.col("branch") == F.col("anchor")) | alike & F.coalesce(z < Z, F.lit(True)))
    name = F.when(F.col("variable") & F.col("rare"), "*").when(like, "~").otherwise(F.col("branch"))
    named = both.select(*node, "branch", "c", F.concat(F.col("template"), F.lit("/"), name).alias("longer"))
    of_new = named.groupBy(*node, "longer").agg((F.sum("c") == 1).alias("alone"))
    return named.drop("c").join(of_new, [*node, "longer"])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page's url."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    paths = urls.select("host", "path").distinct()
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    marked = paths.select("host", "path", F.coalesce(verdict == "block", F.lit(False)).cast("int").alias("blocked"), F.coalesce(verdict == "allow", F.lit(False)).cast("int").alias("allowed"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = urls.select("page_id", "host", "path", text.alias("rule"), verdict.alias("by_rule")).join(templates(marked), ["host", "path"], "left")
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "template", "purity")
