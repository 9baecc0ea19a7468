"""Scalar expressions on source text, paths, urls and versions; all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\t\p{Zs}]+"


def trim(c: Column) -> Column:
    """Strip tabs and Unicode space separators from both ends."""
    return F.regexp_replace(c, rf"^{SPACES}|{SPACES}$", "")


def lines_of(text: Column) -> Column:
    """The lines of a text, a trailing empty one included."""
    return F.split(text, "\n", -1)


def line_count(text: Column, extension: Column) -> Column:
    """Lines of a file: Swift counts no empty line after the last newline, the others do."""
    n = F.size(lines_of(text))
    return F.when((extension == "swift") & (text.endswith("\n") | (text == "")), n - 1).otherwise(n)


def is_comment(line: Column) -> Column:
    return F.ltrim(F.regexp_replace(line, rf"^{SPACES}", "")).rlike(r"^(//|\*|/\*)")


def calls(code: Column, callee: str) -> Column:
    """Whether code calls a function, not one whose name only ends alike. callee: name with its parenthesis."""
    quoted = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in callee)
    return code.contains(callee) & code.rlike(rf"(?<![\p{{L}}\p{{N}}_]){quoted}")


def identifiers(text: Column, least: int = 4, ascii_only: bool = False) -> Column:
    """Distinct identifiers of at least so many characters."""
    pattern = "[A-Za-z_][A-Za-z0-9_]*" if ascii_only else r"[\p{L}_][\p{L}\p{N}_]*"
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda t: F.length(t) >= least)


def name_tokens(name: Column) -> Column:
    """A camelCase or snake_case name cut into lower-case tokens, acronyms and numbers apart; ASCII."""
    cut = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|[^A-Za-z0-9]+"
    return F.filter(F.split(F.lower(F.regexp_replace(name, cut, " ")), " "), lambda t: t != "")


def body_tokens(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)\.([^.]*)$", 1))


def parent(path: Column) -> Column:
    """The folder a path lies in, by name."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def module_of(path: Column, package: Column) -> Column:
    """The component after the last ``Sources``, else the package."""
    parts = F.split(path, "/")
    back = F.array_position(F.reverse(parts), "Sources")
    inside = (back > 1) & (back - 1 < F.size(parts))
    return F.when(inside & (back > 2), F.try_element_at(parts, F.size(parts) - back.cast("int") + 2)).otherwise(package)


def display_path(path: Column) -> Column:
    """The last three components."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), "/")


def snippet(line: Column, most: int = 100) -> Column:
    t = trim(line)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


def module_badge(path: Column, module: Column) -> Column:
    return F.coalesce(F.nullif(module, F.lit("")), parent(path))


def scene_group(path: Column) -> Column:
    """The component after ``Scenes``, null if there is none."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "Scenes").cast("int")
    return F.when((at > 0) & (at + 1 < F.size(parts)), F.try_element_at(parts, at + 1))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def file_size(size: Column) -> Column:
    """Bytes as B, whole KB, or MB with one digit; halves go to the even digit."""
    kb = F.format_string("%.0f KB", F.bround(size / 1024, 0))
    mb = F.format_string("%.1f MB", F.bround(size / 1024**2, 1))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, kb).otherwise(mb)


def big_o(order: Column, kind: Column) -> Column:
    """The label of a polynomial order, e.g. O(n³)."""
    glyphs = F.translate(order.cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    return F.when(order <= 0, "O(1)").when(order == 1, "O(n)").otherwise(F.concat(F.lit("O(n"), glyphs, F.lit(")")))


def encyclopedia_url(name: Column) -> Column:
    """The article of a name: its words joined by underscores, a bracketed remark left out, percent-encoded."""
    slug = F.replace(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", "")), F.lit(" "), F.lit("_"))
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.url_encode(slug))


def source_link(path: Column, line: Column, host: str | None = None) -> Column:
    """A link that opens a line in an editor, or in a repository host's file view."""
    if host:
        return F.concat(F.lit(host.rstrip("/") + "/"), path, F.lit("#L"), line.cast("string"))
    return F.concat(F.lit("vscode://file/"), path, F.lit(":"), line.cast("string"))


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host, port ('' if not given) and path of a url."""
    return {
        "scheme": F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
        "host": F.regexp_extract(url, r"://([^/?#:]*)", 1),
        "port": F.regexp_extract(url, r"://[^/?#:]*:([0-9]+)", 1),
        "path": F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1),
    }


def version_key(version: Column) -> Column:
    """A dotted version as numbers, for ordering."""
    return F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("long")
