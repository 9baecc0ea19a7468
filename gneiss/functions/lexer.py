"""Comments and strings taken out of source text, line numbers kept."""

from __future__ import annotations

import re

OPENING = re.compile(r'//[^\n]*|/\*|"""|"')
COMMENT = re.compile(r"/\*|\*/")
TRIPLE = re.compile(r'\\[^\n]|"""')
SINGLE = re.compile(r'((?:\\[^\n]|[^"\\\n]|\\(?=\n|\Z))*)("?)')


def strip(text: str) -> tuple[list[str], list[list[str]]]:
    """The lines of a text without comments and strings, and the one-line string literals of each line.

    Block comments nest, triple-quoted strings span lines, an unterminated string ends with its line.
    """
    kept: list[str] = []
    literals: dict[int, list[str]] = {}
    at, line = 0, 0
    while True:
        m = OPENING.search(text, at)
        part = text[at : m.start() if m else len(text)]
        kept.append(part)
        line += part.count("\n")
        if not m:
            break
        mark, at = m[0], m.end()
        if mark == "/*":
            depth = 1
            while depth:
                c = COMMENT.search(text, at)
                if not c:
                    at = len(text)
                    break
                depth += 1 if c[0] == "/*" else -1
                at = c.end()
        elif mark == '"""':
            c = TRIPLE.search(text, at)
            while c and c[0] != '"""':
                c = TRIPLE.search(text, c.end())
            at = c.end() if c else len(text)
        elif mark == '"':
            c = SINGLE.match(text, at)
            if c[2]:
                literals.setdefault(line, []).append(c[1])
            at = c.end()
        gone = text.count("\n", m.start(), at)
        kept.append("\n" * gone)
        line += gone
    lines = "".join(kept).split("\n")
    return lines, [literals.get(i, []) for i in range(len(lines))]


def words(text: str) -> set[str]:
    return set(re.findall(r"[^\W_]+", text))
