"""Personal data, DataFrame functions only: regular expressions propose spans, checksums confirm them,
nearby context words adjust a score.

Positions come without Python: splitting a text at a pattern gives the pieces between its matches, so
running sums of the lengths of pieces and matches are the code-point offsets. The patterns are written
so that each is linear on any text: a match may start only at the start of a run (or where the last one
ended), and repetitions are possessive where the next character can't belong to them.

Base kinds (email, ip, card, phone) are kept whenever their check holds. Added kinds (iban, secret, ssn) are
kept at a score of ``threshold`` or more: the kind's prior, 0.2 if a context word of the kind stands within
40 characters before or after the span (but not beyond the kind's next match), and 0.2 if a stricter check
holds. Their priors lie below the threshold, so form alone keeps none: a hexadecimal string is a secret after
"token =", not by itself; an IBAN that passes mod 97 needs its country's length or a word like "IBAN" near.

A text with n spans costs about n steps of 128: spans are gathered in chunks, never appended one by one to
one long array. Defined results: a null or empty text has no spans; repeated rows and ties are judged row by
row; other columns pass through whatever their names, but a column ``spans`` is replaced by ``find``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = r"A-Za-z0-9._%+\-"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needle: str  # a cheap test that a text with a span passes, as a pattern
    prior: float
    context: str
    base: bool = True


KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++", "@", 0.8, "e-?mail|mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, r"ip|address|host|server|adresse|direcci"),
    Kind("card", r"[0-9](?:[\x20\-]?[0-9])++", r"[0-9](?:[\x20\-]?[0-9]){12}", 0.7, "card|visa|credit|debit|master|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9\-]+[0-9]", r"\+[0-9]", 0.6, "phone|tel|call|mobile|fax|anruf|appel|llama"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", "[A-Z]{2}[0-9]{2}", 0.5, "iban|bank|account|konto|compte|cuenta", base=False),
    Kind("secret", r"[A-Za-z0-9_\-]{20,}+", r"[A-Za-z0-9_\-]{20}", 0.5, "token|secret|key|passw|pwd|auth|bearer|credential|kennwort|contrase|mot de passe", base=False),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "[0-9]-[0-9]{2}-[0-9]", 0.5, "ssn|social security|taxpayer", base=False),
)
CONTEXT_CHARS, CONTEXT_BONUS, STRICT_BONUS, THRESHOLD = 40, 0.2, 0.2, 0.6
# fixed values: the lengths that countries have registered for their IBANs
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28,
    "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24,
}


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN passes the mod-97 check: four characters go to the end, letters count from 10."""
    code = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def holds(kind: str, m: Column) -> Column:
    """The check of a kind on a matched string."""
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.length(digits(m)).between(13, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(m, " ", "")).between(15, 34), mod97(m)).otherwise(False)
    if kind == "secret":  # letters and digits mixed, unlike a long word or number
        return (F.length(digits(m)) >= 4) & (F.length(F.regexp_replace(m, "[^A-Za-z]", "")) >= 4)
    if kind == "ssn":
        return ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.endswith("-0000")
    return F.lit(True)


def strict(kind: str, m: Column) -> Column:
    """A stricter check that raises a kind's score."""
    if kind == "iban":
        n = F.length(F.regexp_replace(m, " ", ""))
        return F.element_at(F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair)), F.substring(m, 1, 2)) == n
    return F.lit(False)


SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Elements that are gathered one by one into one array.
CHUNK = 128


def bound(value: Column, use) -> Column:
    """use(value), worked out once however often it is used, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, start: Column, size, add, step, done, out: str, kind: str) -> Column:
    """The concatenation, over chunks of ``items``, of what each chunk makes of its items in order.

    size(chunk) and add(state, size) carry a number from chunk to chunk, from ``start`` on; step(state, item)
    works on struct<at, out>, ``out`` of that type; done(chunk, out) gives an array of type ``kind``.
    """

    def whole(all_items: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / CHUNK).cast("int")), lambda i: F.slice(all_items, i * CHUNK + 1, F.lit(CHUNK)))

        def each(some: Column) -> Column:
            carried = F.aggregate(F.transform(some, size), F.array(start), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))
            pairs = F.arrays_zip(some.alias("chunk"), F.slice(carried, F.lit(1), F.size(some)).alias("at"))
            return F.flatten(F.transform(pairs, lambda c: done(c, F.aggregate(c["chunk"], F.struct(c["at"].alias("at"), F.array().cast(out).alias("out")), step)["out"])))

        return bound(chunks, each)

    return F.when(F.size(items) > 0, bound(items, whole)).otherwise(F.array().cast(kind))


def kind_spans(text: Column, kind: Kind, threshold: float) -> Column:
    """The kind's spans of a text: array<struct<kind, start, end, score>>, by start."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        """state: the offset after the last match, and the chunk's spans so far."""
        start = state["at"] + F.length(pair["before"])
        end = start + F.length(pair["m"])
        near = F.lower(F.concat(F.right(pair["before"], F.lit(CONTEXT_CHARS)), F.lit("\n"), F.left(pair["after"], F.lit(CONTEXT_CHARS))))
        bonus = F.when(near.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0) + F.when(strict(kind.name, pair["m"]), STRICT_BONUS).otherwise(0.0)
        score = F.lit(kind.prior) + bonus
        keep = holds(kind.name, pair["m"])
        if not kind.base:
            keep = keep & (score >= threshold)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def pairs(m: Column) -> Column:
        between = F.split(text, kind.pattern, -1)
        return bound(between, lambda b: F.arrays_zip(m.alias("m"), F.slice(b, F.lit(1), F.size(m)).alias("before"), F.slice(b, F.lit(2), F.size(m)).alias("after")))

    length = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, p: n + F.length(p["before"]) + F.length(p["m"]))
    spans = running(bound(found, pairs), F.lit(0), length, lambda at, n: at + n, step, lambda chunk, out: out, SPAN, SPAN)
    has = text.rlike(kind.needle)
    if not kind.base and kind.name != "iban":  # its prior needs a context word somewhere
        has = has & F.lower(text).rlike(kind.context)
    return F.when(has, spans).otherwise(F.array().cast(SPAN))


def placed(df: DataFrame) -> DataFrame:
    """df with its columns named by position, so that no name of its own can clash."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def _find(inside: DataFrame, at: str, threshold: float) -> DataFrame:
    t = F.coalesce(F.col(at), F.lit(""))
    by_kind = inside.select("*", *(kind_spans(t, k, threshold).alias(f"s_{k.name}") for k in KINDS))
    return by_kind.select(*inside.columns, F.concat(*(F.col(f"s_{k.name}") for k in KINDS)).alias("s"))


def find(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with ``spans``: every span of every kind, by kind as listed, then start."""
    found = _find(placed(df), f"c{df.columns.index(text)}", threshold)
    kept = [(f"c{i}", c) for i, c in enumerate(df.columns) if c != "spans"]
    return found.select(*(c for c, _ in kept), "s").toDF(*(c for _, c in kept), "spans")


def redact(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with each span of the text replaced by its kind in angle brackets, e.g. ``<EMAIL>``.

    Where spans overlap, the one that starts first (the longest of those) names the replacement of all
    they cover. A text without spans stays as it is; null stays null; all other columns are as they were.
    """
    at = f"c{df.columns.index(text)}"
    found = _find(placed(df), at, threshold)
    ordered = F.array_sort(F.transform("s", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        """state: up to where the text is dealt with, and where each fresh part of it lies, with its replacement."""
        part = F.struct(state["at"].alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        more = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(part))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], -s["less"]).alias("at"), more.alias("out"))

    def parts(chunk: Column, out: Column) -> Column:
        """The chunk's piece of the text, from which its parts are cut."""
        low = chunk["at"]
        piece = F.substring(F.col(at), low + 1, F.greatest(F.element_at(chunk["chunk"], -1)["start"] - low, F.lit(0)))
        cut = lambda t: F.transform(out, lambda x: F.concat(F.substring(t, x["from"] - low + 1, x["to"] - x["from"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return bound(piece, cut)

    reach = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, s: F.greatest(n, -s["less"]))
    new = running(ordered, F.lit(0), reach, F.greatest, step, parts, "array<struct<from:int,to:int,kind:string>>", "array<string>")
    last = F.aggregate("s", F.lit(0), lambda n, s: F.greatest(n, s["end"]))
    whole = F.concat(F.array_join(new, ""), F.substring(F.col(at), last + 1, F.length(at)))
    redacted = F.when(F.size("s") > 0, whole).otherwise(F.col(at))
    return found.select(*(redacted.alias(at) if c == at else c for c in found.columns if c != "s")).toDF(*df.columns)
