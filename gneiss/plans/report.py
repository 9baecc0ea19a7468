"""Result tables to Markdown, one HTML page and graph JSON. Only bounded results reach the driver."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 50
SECTIONS = (
    ("Project", ("metadata", "layers", "packages", "package_categories", "components", "import_classes", "vendored")),
    ("Architecture", ("architecture", "pattern_letters", "letters", "roles", "package_graph", "declaration_graph", "hotspots", "learning_path", "penetration")),
    ("Constructs", ("patterns", "structures", "algorithms", "constants", "complexity_health", "complexity_time", "complexity_space", "collection_usage")),
    ("Security", ("security_score", "security_categories", "security_results", "security_violations")),
    ("Style", ("style",)),
    ("Traffic", ("traffic",)),
    ("History", ("team", "churn", "branches", "branching", "merge_timing", "conventional", "compliance", "tags", "reverts", "weekdays", "stale", "author_packages")),
    ("Notes", ("notes", "longest_functions", "biggest_types", "assets", "heavy_types", "shaders")),
)


def rows(df: DataFrame, most: int = MOST_ROWS) -> tuple[list[str], list[list[str]]]:
    got = df.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else json.dumps([x.asDict() if hasattr(x, "asDict") else x for x in v[:5]], ensure_ascii=False, default=str) if isinstance(v, list) else str(v)
    return df.columns, [[show(v) for v in r] for r in got]


def markdown(tables: dict[str, DataFrame], title: str = "Repository report") -> str:
    out = [f"# {title}", ""]
    for section, names in SECTIONS:
        some = [n for n in names if n in tables]
        if some:
            out += [f"## {section}", ""]
        for n in some:
            head, body = rows(tables[n])
            cell = lambda s: s.replace("|", "\\|").replace("\n", " ")
            out += [f"### {n.replace('_', ' ')}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in body), ""]
    return "\n".join(out)


def graph_json(tables: dict[str, DataFrame], most: int = 500) -> str:
    """Nodes by rank and the links between them."""
    nodes = tables["ranks"].orderBy(F.round("score", 12).desc(), "id").limit(most)
    ids = nodes.select("id")
    links = tables["edges"].join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    to_text = lambda df, cols: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols))))).first()[0]
    return '{"nodes":' + to_text(nodes, ["id", "score"]) + ',"links":' + to_text(links, ["src", "dst"]) + "}"


def page(tables: dict[str, DataFrame], path: str, title: str = "Repository report") -> None:
    """One HTML file with all tables, the graph's JSON and the Markdown embedded."""
    text = markdown(tables, title)
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>body{{font:14px sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 6px;text-align:left}}</style></head><body><h1>{html.escape(title)}</h1>"]
    for section, names in SECTIONS:
        some = [n for n in names if n in tables]
        if some:
            parts.append(f"<h2>{section}</h2>")
        for n in some:
            head, body = rows(tables[n])
            parts.append(f"<h3>{html.escape(n.replace('_', ' '))}</h3><table><tr>" + "".join(f"<th>{html.escape(h)}</th>" for h in head) + "</tr>")
            parts += ["<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in r) + "</tr>" for r in body]
            parts.append("</table>")
    if "ranks" in tables:
        parts.append(f"<script type='application/json' id='graph'>{graph_json(tables).replace('</', '<' + chr(92) + '/')}</script>")
    parts.append(f"<script type='text/markdown' id='markdown'>{html.escape(text)}</script></body></html>")
    Path(path).write_text("".join(parts), encoding="utf-8")


def evolution_lines(snapshots: DataFrame, growth: DataFrame) -> list[str]:
    out = [f"{r['ts']}  {r['hash'][:10]}  {r['files']} files  about {r['est_lines']} lines" for r in snapshots.collect()]
    g = growth.first()
    return [*out, f"net growth {g['growth'] or 0:.1f} %"]
