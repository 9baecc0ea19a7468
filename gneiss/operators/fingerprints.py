"""Algorithms told by the shape of a function: tokens give facts, and a table of rules is read against the facts.

A function's lower-case tokens are cut into clauses at line ends, semicolons and braces. Each clause is looked
at once, as an assignment, a comparison or calls, and leaves facts: words such as ``swap`` or ``midpoint``.
The rules name the facts they need; the first rule that fits wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

TOKEN = re.compile(r"[a-z_]\w*|\d\w*|>>=|<<=|[-+*/%&|^<>=!]=|&&|\|\||<<|>>|->|\S")
LOOPS = ("for", "while", "repeat")
ASSIGN = ("=", "+=", "-=", "*=", "/=", ">>=")
COMPARE = ("<", ">", "<=", ">=", "==", "!=")

# fixed values: how the middle of a range and the places of a heap are written
MIDPOINTS = (
    "(low+high)/2", "(lo+hi)/2", "(left+right)/2", "(l+r)/2", "(start+end)/2", "(first+last)/2",
    "low+(high-low)/2", "lo+(hi-lo)/2", "left+(right-left)/2", "start+(end-start)/2",
    "(low+high)>>1", "(lo+hi)>>1", "(left+right)>>1", "(l+r)>>1", "count/2", "count>>1",
)
HEAP_INDEXES = (
    "2*i+1", "i*2+1", "2*i+2", "i*2+2", "2*index+1", "index*2+1", "2*idx+1", "idx*2+1", "2*pos+1", "pos*2+1",
    "(i-1)/2", "(index-1)/2", "(idx-1)/2", "(pos-1)/2", "(child-1)/2",
)
# fixed values: words that make a fact
VOCABULARY = {
    "distances": ("dist", "distance", "distances", "cost", "costs", "shortest"),
    "indegrees": ("indegree", "indegrees"),
    "merging": ("merge", "merged", "merging"),
    "memo": ("memo", "memoized", "memoization", "memotable"),
    "error": ("error", "err"),
    "counter": ("retaincount", "refcount"),
}
CALLS = {"swapat": "swap-call", "removefirst": "pop-front", "removelast": "pop-back", "poplast": "pop-back", "append": "append", "max": "max", "min": "min", "random": "random"}

#: In order; a rule fits if one of its alternatives has all its facts and none of those after "!".
RULES = (
    ("Sieve of Eratosthenes", "numeric", ("loop marks square-step",)),
    ("Euclidean GCD", "numeric", ("remainder-swap", "remainder-until-zero")),
    ("Dijkstra", "graph", ("relax distances",)),
    ("Kahn (Topological Sort)", "graph", ("indegrees pop-front", "indegrees dequeue", "indegrees word:queue")),
    ("Union–Find (Disjoint Set)", "graph", ("word:parent compress", "word:parent word:find self")),
    ("Heapify", "sorting", ("loop heap-index swap", "self heap-index swap")),
    ("Quicksort", "sorting", ("word:pivot self-twice", "word:pivot self word:partition")),
    ("Merge Sort", "sorting", ("self-twice midpoint merging !word:pivot !beside-mid", "self-twice midpoint word:left word:right !word:pivot !beside-mid")),
    ("Binary Search", "searching", ("loop midpoint to-mid", "self midpoint to-mid", "self midpoint beside-mid")),
    ("Bubble Sort", "sorting", ("loop-twice adjacent swap", "loop-twice adjacent shift-from-next")),
    ("Insertion Sort", "sorting", ("loop-twice shift-to-next", "loop-twice shift-from-last")),
    ("Breadth-First Search", "graph", ("loop word:visited pop-front", "loop word:visited dequeue")),
    ("Depth-First Search", "graph", ("loop word:visited pop-back", "loop word:visited self")),
    ("Floyd's Cycle Detection", "graph", ("loop word:slow word:fast double-hop",)),
    ("Backtracking (DFS)", "searching", ("self append pop-back",)),
    ("Kadane (Max Subarray)", "numeric", ("loop running-max", "word:maxsofar word:maxendinghere")),
    ("Prefix Sum", "numeric", ("loop prefix-sum",)),
    ("Fisher–Yates Shuffle", "numeric", ("loop swap-call random",)),
    ("Binary Exponentiation", "numeric", ("loop odd halve multiply",)),
    ("Matrix Multiplication", "numeric", ("loop-thrice row-by-column",)),
    ("Bresenham Line", "numeric", ("loop error twice-delta",)),
    ("Exponential Backoff", "numeric", ("loop delay-doubles",)),
    ("Manual Reference Counting", "numeric", ("counter counts",)),
    ("Memoized Recursion (DP)", "numeric", ("self memo",)),
    ("Levenshtein Distance", "strMatch", ("loop min above left-of diagonal",)),
    ("Alpha–Beta Pruning", "numeric", ("self word:alpha word:beta max", "self word:alpha word:beta min")),
    ("Two-Pointer Technique", "searching", ("pointers-meet",)),
)
LEAST_LENGTH = 30


def tokens_of(lines: list[str]) -> list[list[str]]:
    return [TOKEN.findall(line.lower()) for line in lines]


def nesting(rows: list[list[str]]) -> tuple[int, bool]:
    """The deepest nest of loops, and whether a brace opens at all; a loop word counts for the next brace."""
    open_loops, deepest, pending, opened = [], 0, False, False
    for t in (t for row in rows for t in row):
        if t in LOOPS:
            pending = True
        elif t == "{":
            open_loops.append(pending)
            pending, opened, deepest = False, True, max(deepest, sum(open_loops))
        elif t == "}" and open_loops:
            open_loops.pop()
    return deepest, opened


def clauses(rows: list[list[str]]) -> Iterator[list[str]]:
    for row in rows:
        some: list[str] = []
        for t in row:
            if t in ("{", "}", ";"):
                if some:
                    yield some
                some = []
            else:
                some.append(t)
        if some:
            yield some


def indexed(tokens: list[str]) -> tuple[str, tuple[str, ...]] | None:
    """("a", ("i", "j")) of the tokens a[i][j]; None of any other. Names before the last dot don't count."""
    if "[" not in tokens or tokens[-1] != "]" or tokens[0] == "[":
        return None
    base, _, rest = "".join(tokens).partition("[")
    return base.rpartition(".")[2], tuple(rest.removesuffix("]").split("]["))


def arguments(tokens: list[str]) -> list[str]:
    """The arguments of the tokens "(a, b)" or "f(a, b)", each without spaces."""
    if "(" not in tokens or tokens[-1] != ")":
        return []
    out, depth = [""], 0
    for t in tokens[tokens.index("(") + 1 : -1]:
        depth += (t in "([") - (t in ")]")
        if t == "," and not depth:
            out.append("")
        else:
            out[-1] += t
    return out


def of_assignment(left: list[str], op: str, right: list[str]) -> Iterator[str]:
    to, value = indexed(left), indexed(right)
    joined = "".join(right)
    if op == "=":
        if to and joined in ("true", "false"):
            yield "marks"
        if right[0] in ("mid", "middle"):
            yield "to-mid"
        if to and value:
            (here,), (there,) = (to[1], value[1]) if len(to[1]) == len(value[1]) == 1 else (("",), ("",))
            if here and there == here + "+1":
                yield "shift-from-next"
            if here and there == here + "-1":
                yield "shift-from-last"
            if here and here == there + "+1":
                yield "shift-to-next"
        if left[:1] == ["("] and right[:1] == ["("] and len(a := arguments(left)) == len(b := arguments(right)) == 2:
            if b == a[::-1]:
                yield "swap"
            if b == [a[1], f"{a[0]}%{a[1]}"]:
                yield "remainder-swap"
        if to and to[0] == "parent" and joined == f"find(parent[{to[1][0]}])":
            yield "compress"
        if right[:1] == ["max"] and len(a := arguments(right)) == 2:
            name = "".join(left)
            if a[1] == f"{name}+{a[0]}" or a[0] == f"{name}+{a[1]}":
                yield "running-max"
    if op == "+=" and to and value and to[0] == value[0] and value[1] == (f"{to[1][0]}-1",):
        yield "prefix-sum"
    if op == "+=" and to and len(to[1]) == 2 and "*" in right:
        at = right.index("*")
        a, b = indexed(right[:at]), indexed(right[at + 1 :])
        if a and b and len(a[1]) == len(b[1]) == 2 and a[1][0] == to[1][0] and b[1][1] == to[1][1] and a[1][1] == b[1][0]:
            yield "row-by-column"
    if op == "*=":
        yield "multiply"
        if joined == "2" and any("delay" in t or "backoff" in t for t in left[-1:]):
            yield "delay-doubles"
    if op in (">>=", "/=") and joined == {">>=": "1", "/=": "2"}[op]:
        yield "halve"
    if op in ("+=", "-=") and joined == "1" and left[-1:] and left[-1] in VOCABULARY["counter"]:
        yield "counts"


def of_comparison(left: list[str], op: str, right: list[str]) -> Iterator[str]:
    a, b = indexed(left), indexed(right)
    if op not in ("==", "!=") and a and b and len(a[1]) == len(b[1]) == 1 and b[1][0] == a[1][0] + "+1":
        yield "adjacent"
    if op == "<" and "+" in left:
        base = indexed(left[: left.index("+")])
        if base and "[" in right and "".join(right).partition("[")[0].rpartition(".")[2] == base[0]:
            yield "relax"


def operands(clause: list[str], at: int) -> tuple[list[str], list[str]]:
    """What stands on either side of an operator, up to a keyword, a logical operator or an open bracket."""
    stop = {"if", "while", "guard", "where", "return", "let", "var", "&&", "||", "?", "else", "in"}
    left, depth = [], 0
    for t in reversed(clause[:at]):
        depth += (t in ")]") - (t in "([")
        if depth < 0 or t in stop or t in ("=", ",") and not depth:
            break
        left.append(t)
    right, depth = [], 0
    for t in clause[at + 1 :]:
        depth += (t in "([") - (t in ")]")
        if depth < 0 or t in stop or t == "," and not depth:
            break
        right.append(t)
    return left[::-1], right


def facts(rows: list[list[str]], name: str) -> tuple[set[str], int, int]:
    """Facts of a function's tokens by line, its nest of loops and its calls of itself."""
    every = [t for row in rows for t in row]
    joined, seen = "".join(every), set(every)
    nest, _ = nesting(rows)
    calls = sum(t == name and every[i + 1 : i + 2] == ["("] and every[i - 1] != "func" for i, t in enumerate(every))
    out = {f"word:{t}" for t in seen if t[0].isalpha()}
    out |= {fact for fact, some in VOCABULARY.items() if not seen.isdisjoint(some)}
    out |= {CALLS[t] for i, t in enumerate(every) if t in CALLS and every[i + 1 : i + 2] == ["("]}
    out |= {fact for n, fact in ((1, "loop"), (2, "loop-twice"), (3, "loop-thrice")) if nest >= n}
    out |= {fact for n, fact in ((1, "self"), (2, "self-twice")) if calls >= n}
    shapes = {
        "midpoint": MIDPOINTS, "heap-index": HEAP_INDEXES, "beside-mid": ("mid-1", "mid+1"), "odd": ("&1", "%2==1", "%2!=0"), "halve": (">>1",), "random": ("arc4random",), "dequeue": ("dequeue",),
        "twice-delta": ("2*dy", "2*dx", "dy*2", "dx*2"), "double-hop": ("fast.next.next", "fast?.next?.next", "fast!.next!.next"), "above": ("[i-1][j]",), "left-of": ("[i][j-1]",), "diagonal": ("[i-1][j-1]",),
    }
    out |= {fact for fact, some in shapes.items() if any(x in joined for x in some)}
    squares, steps, until_zero, meeting, moved = set(), set(), set(), set(), set()
    for clause in clauses(rows):
        for i, t in enumerate(clause):
            if t in ASSIGN or t in COMPARE:
                left, right = operands(clause, i)
                if t in ASSIGN and left and right:
                    out.update(of_assignment(left, t, right))
                    if len(left) == 1 and right in (["1"], ["1", ")"]) and t in ("+=", "-="):
                        moved.add((left[0], t))
                    if t == "+=" and len(right) == 1:
                        steps.add(right[0])
                elif left and right:
                    out.update(of_comparison(left, t, right))
                    if clause[0] == "while" and len(left) == 1:
                        if t == "!=" and right == ["0"]:
                            until_zero.add(left[0])
                        if t == "<" and len(right) == 1:
                            meeting.add((left[0], right[0]))
            if t == "*" and 0 < i < len(clause) - 1 and clause[i - 1] == clause[i + 1]:
                squares.add(clause[i - 1])
            if t == "by" and clause[i + 1 : i + 2] == [":"] and i + 2 < len(clause):
                steps.add(clause[i + 2])
    if "swap-call" in out:
        out.add("swap")
    if squares & steps:
        out.add("square-step")
    if any(every[i + 1 : i + 2] == [b] for b in until_zero for i, t in enumerate(every) if t == "%"):
        out.add("remainder-until-zero")
    if any((a, "+=") in moved and (b, "-=") in moved for a, b in meeting):
        out.add("pointers-meet")
    return out, nest, calls


def fits(have: set[str], alternative: str) -> bool:
    return all((need[1:] not in have) if need[0] == "!" else need in have for need in alternative.split())


def fingerprint(lines: list[str], name: str) -> tuple[int, int, str | None, str | None]:
    """Nest of loops, calls of itself, and the algorithm (label, category) that a function looks like, if any."""
    rows = tokens_of(lines)
    if not nesting(rows)[1]:
        return 0, 0, None, None
    have, nest, calls = facts(rows, name.lower())
    if sum(len(t) for row in rows for t in row) < LEAST_LENGTH:
        return nest, calls, None, None
    found = next(((label, category) for label, category, some in RULES if any(fits(have, x) for x in some)), (None, None))
    return nest, calls, *found
