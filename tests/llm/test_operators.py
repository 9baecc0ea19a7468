"""Each operator against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import re
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from gneiss.llm import bitslice, bpe, infill, jaccard, kmtree, mixing, pii, quality, queries, resampling, simhash, substring, toxicity, urls, warc
from gneiss.llm.common import map_text, n_words, shared_dir, write_shared

DOC = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string, score string"


def docs(spark, rows):
    """A documents table with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows], DOC)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu".split()


def babble(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


# substring dedup


def cut_by_hand(rows, span):
    first, out = {}, []
    split = [(i, (t or "").encode().split()) for i, t, _ in rows]
    for i, w in split:
        for k in range(len(w) - span + 1):
            if i is not None:
                x = tuple(w[k : k + span])
                first[x] = min(first.get(x, i), i)
    for i, w in split:
        gone = set()
        for k in range(len(w) - span + 1):
            if i is not None and first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("span", "block_bytes", "hot"), [(13, 1 << 20, 200), (13, 300, 2), (5, 500, 1), (3, 200, 50)])
def test_substring_matches_brute_force(spark, span, block_bytes, hot):
    rng = random.Random(span)
    passage, line = babble(rng, 30), "the very common line of seven words"
    rows = [(None, passage, "a"), (1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "same " * 60, "b"), (5, "same " * 60, "b")]
    for i in range(6, 40):
        text = babble(rng, rng.randint(1, 60), WORDS[: rng.choice([2, 6, 12])])
        text = rng.choice([text, text + "\n" + passage + " " + babble(rng, 9), line + "\n" + text, passage + " é" + text])
        rows.append((i, text, "c"))
    rows += [rows[10], rows[10], (7, babble(rng, 50), "d"), (50, " ".join(babble(rng, 3000).split()), "e"), (49, rows[-1][1], "e")]
    rng.shuffle(rows)
    assert tuples(substring.deduplicated(docs(spark, rows), span=span, block_bytes=block_bytes, hot=hot)) == cut_by_hand(rows, span)


def test_substring_compares_words_where_hashes_meet(spark, monkeypatch):
    """Long words on which polynomial hashes agree, and then hashes that agree on everything."""
    even = ["a"]
    for _ in range(11):
        even = even + ["b" if c == "a" else "a" for c in even]
    one, other = "".join(even), "".join("b" if c == "a" else "a" for c in even)
    rng = random.Random(9)
    twelve = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{twelve} {one}", "s"), (2, f"{twelve} {other}", "s"), (3, f"{twelve} {one}", "s")]
    assert tuples(substring.deduplicated(docs(spark, rows))) == cut_by_hand(rows, 13)
    rows += [(i, babble(rng, rng.randint(1, 40), WORDS[:3]), "s") for i in range(4, 20)]
    plain = substring.Block.runs

    def blunt(self):
        self.words = self.words % np.uint64(2)
        plain(self)
        self.hash = self.hash % np.uint64(2)

    monkeypatch.setattr(substring.Block, "runs", blunt)
    block = substring.Block([r[0] for r in rows], [r[1] for r in rows], 5)
    same = block.classes(block.first, block.last + 4, block.hash)
    texts = [block.text(a, z) for a, z in zip(block.first, block.last + 4, strict=True)]
    assert [texts.index(t) for t in texts] == [texts.index(texts[i]) for i in same.tolist()] and len(set(same.tolist())) == len(set(texts))


def test_substring_of_an_empty_table(spark):
    assert substring.deduplicated(docs(spark, [])).collect() == []


def test_automaton_knows_every_substring():
    rng = random.Random(4)
    for _ in range(60):
        automaton, known = substring.Automaton(), []
        for doc in range(4):
            seq = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))]
            found, whole = automaton.firsts(seq, 3)
            hand = [next((d for d, k in known if any(k[j : j + 3] == seq[i : i + 3] for j in range(len(k)))), substring.NONE) for i in range(len(seq) - 2)]
            assert found == hand
            assert whole == any(k[j : j + len(seq)] == seq for _, k in known for j in range(len(k)))
            automaton.add(seq, doc)
            known.append((doc, seq))


# url filters


def test_url_rules_and_parts(spark):
    cases = [
        ("https://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://x.com/en/70", "x.com", "/en/70", "com/en/", "block"),
        ("http://com/en/", "com", "/en/", "com/en/", "block"),
        ("http://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        ("ftp://q.org/es/a://b/c", "q.org", "/es/a://b/c", "org/es/", "block"),
        ("http://q.org?x=/es/", "q.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://É.org/é#", "É.org", "/é", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(cases)], "page_id long, url string, rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def tree_by_hand(urls_):
    """(host, path) -> (template, rejected), node by node."""
    parse = lambda u: (re.search("://([^/?#]*)", u)[1].lower(), re.search("://[^/?#]*([^?#]*)", u)[1])
    paths = sorted({parse(u) for u in urls_})
    fits = lambda h, p: next((r.verdict for r in sorted(urls.RULES, key=lambda r: -len(r.text)) if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)), None)
    rows = [(h, p, [x for x in p.split("/") if x], int(fits(h, p) == "block"), int(fits(h, p) == "allow")) for h, p in paths]
    named = {}

    def kind(parts, level):
        rest = parts[level:]
        return len(rest), re.sub("[^#.]+", "a", re.sub("[0-9]+", "#", rest[0] if rest else ""))

    def grow(some, level, template):
        ended = [r for r in some if len(r[2]) < level]
        named.update({r[:2]: template for r in ended})
        some = [r for r in some if len(r[2]) >= level]
        branches = {}
        for r in some:
            branches.setdefault(r[2][level - 1], []).append(r)
        n, rare = len(some), {b for b, x in branches.items() if 12 * len(x) < len(some)}
        longer = {}
        anchor = min(branches, key=lambda b: (-len(branches[b]), b), default=None)
        for branch, mine in branches.items():
            like = len(branches) > 1
            if branch != anchor:
                others = branches[anchor]
                k = [[kind(r[2], level) for r in x] for x in (mine, others)]
                kinds = set(k[0] + k[1])
                up = (len(others) / len(mine)) ** 0.5
                chi = sum((k[0].count(x) * up - k[1].count(x) / up) ** 2 / (k[0].count(x) + k[1].count(x)) for x in kinds)
                like = chi <= len(kinds) - 1 + 1.96 * (2 * (len(kinds) - 1)) ** 0.5 + 1e-9
                (b1, n1), (b2, n2) = ((sum(r[3] for r in x), sum(r[3] + r[4] for r in x)) for x in (mine, others))
                if n1 and n2:
                    pooled = (b1 + b2) / (n1 + n2)
                    like = like and abs(b1 / n1 - b2 / n2) / (max(pooled * (1 - pooled), 0.01) * (1 / n1 + 1 / n2)) ** 0.5 < 1.96
            longer.setdefault("*" if len(rare) > 12 and branch in rare else "~" if like else branch, []).extend(mine)
        for name, x in longer.items():
            grow(x, level + 1, f"{template}/{name}")
        assert n == sum(map(len, longer.values()))

    hosts = {h: [r for r in rows if r[0] == h] for h, _ in paths}
    for some in hosts.values():
        grow(some, 1, "")
    overall = (sum(r[3] for r in rows) + 1) / (sum(r[3] + r[4] for r in rows) + 2)
    out = {}
    for h, some in hosts.items():
        share = (sum(r[3] for r in some) + 2 * overall) / (sum(r[3] + r[4] for r in some) + 2)
        for r in some:
            same = [x for x in some if named[x[:2]] == named[r[:2]]]
            blocked, labelled = sum(x[3] for x in same), sum(x[3] + x[4] for x in same)
            out[r[:2]] = 2 * labelled >= len(same) and (blocked + 2 * share) / (labelled + 2) >= 0.8
    return named, out


def test_url_tree_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [f"http://bad.com/en/{i}" for i in range(40)] + [f"http://bad.com/fr/{i}" for i in range(15)] + [f"http://bad.com/about/{w}/x/y" for w in WORDS]
    rows += [f"http://v.com/{a}{b}/z" for a in "abcdefghijkl" for b in "mnopqrstuvwxyz0123"]
    rows += [f"http://deep.org/es/{i % 3}/" + "/".join(rng.choice("pqr") for _ in range(rng.randint(0, 9))) + f"?{i}" for i in range(80)]
    rows += [f"https://m.shop.net/{rng.choice(['de', 'en', 'it'])}/{rng.choice(['a', 'b'])}{rng.randint(1, 30)}{rng.choice(['', '.html'])}" for _ in range(150)]
    rows += ["http://x.org/es/~/1", "http://x.org/es/*/1", "http://x.org", "http://deep.org/" + "/".join("k" * 40)]
    named, rejected = tree_by_hand(rows)
    for times in (1, 3):
        pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows * times)], "page_id long, url string")
        got = urls.judge(pages).collect()
        assert len(got) == times * len(rows)
        for r in got:
            assert (r.verdict == "block") == rejected[r.host, r.path] or r.rule
        for one in {(r.host, r.template) for r in got}:
            same = {(r.host, r.path) for r in got if (r.host, r.template) == one}
            assert len({named[x] for x in same}) == 1
    by = {(r.host, r.path): r for r in got}
    assert {by["v.com", p].template for h, p in by if h == "v.com"} == {"/*/z"}  # slugs seen once or three times
    assert all(by["bad.com", f"/fr/{i}"].verdict == "block" for i in range(15))  # unlabelled, like its labelled sibling
    assert all(by["bad.com", f"/about/{w}/x/y"].verdict == "allow" for w in WORDS)  # unlabelled, and not like it


def test_url_templates_foretell_labels_held_out(spark):
    """Of each host's languages only one is labelled; the others' verdicts are as their host's."""
    rng, rows = random.Random(6), []
    for host in range(12):
        for _ in range(60):
            rows.append(f"http://h{host}.{'com' if host % 2 else 'net'}/{rng.choice(['en', 'en', 'en', 'en', 'fr', 'it'])}/{rng.randint(1, 10**6)}")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    got = [r for r in urls.judge(pages, (urls.Rule("block", "com/en/"), urls.Rule("allow", "net/en/"))).collect() if not r.rule]
    right = sum((r.verdict == "block") == r.host.endswith("com") for r in got) / len(got)
    assert len(got) > 150 and right > 0.9


def test_url_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


# personal data


def spans_by_hand(text):
    text, out = text or "", []
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


PII_TEXTS = [
    None, "", "mail a.b@c.de, x@y", "a@b.c_d@e.f @x.y a@@b.c", "1.2.3.4.5 001.2.3.255 256.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (017) 555-7713 +1 ((((  +49 12345678 (1) x", "é😀 4111111111111111 ü a@b.co", "9" * 5000, "a" * 5000 + "@b" + ".c" * 3000, "+1" + "(" * 3000 + "5", "1" + ".1" * 4000, "a." * 4000,
]


def test_pii_base_spans(spark):
    rng = random.Random(7)
    texts = PII_TEXTS + ["".join(rng.choice("a@.-+ 0123456789()") for _ in range(60)) for _ in range(300)]
    got = pii.find(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).select("doc_id", "spans", "kept").collect()
    assert len(got) == len(texts)
    for r in got:
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("email", "ip", "card", "phone")]
        assert base == spans_by_hand(texts[r.doc_id]), texts[r.doc_id]


def test_pii_iban_and_redaction(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32, bad GB82 WEST 1234 5698 7654 33", "s"), (2, "x a@b.co y +1 (017) 555-7713", "s"), (3, None, "s"), (3, None, "s"), (4, "é a@b.co", "s")]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(docs(spark, rows)).collect()}
    assert found[1] == [("iban", 5, 32)]
    clean = pii.redact(docs(spark, rows))
    assert clean.columns == docs(spark, rows).columns
    assert sorted((r.doc_id, r.text, r.spans) for r in clean.collect() if r.text) == [(1, "IBAN <IBAN>, bad GB82 WEST 1234 5698 7654 33", "x"), (2, "x <EMAIL> y <PHONE>", "x"), (4, "é <EMAIL>", "x")]
    assert clean.filter("text IS NULL").count() == 2


def test_pii_context_decides_added_kinds(spark):
    code, plain = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "w" * 39
    kept = [f'x token = "{code}" y', f"{code} was the old API key", f"clave secreta: {code}", "SSN 123-45-6789", "123-45-6789 (social security)", "MT84 MALT 0110 0001 2345 MTLC AST0 01S is my IBAN", "GB82 WEST 1234 5698 7654 32"]
    dropped = [f'x commit = "{code}" y', code, f"token {plain}", f"token {'q' * 10 + ' ' * 41}{code}", "123-45-6789", "SSN 000-45-6789", "SSN 123-00-6789", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "IBAN GB82 WEST 1234 5698 7654 33"]
    found = pii.find(docs(spark, [(i, t, "s") for i, t in enumerate(kept + dropped)])).collect()
    for r in found:
        assert len(r.spans) == (1 if r.doc_id < len(kept) else 0), r
        assert all(s.score >= 0.6 for s in r.spans)
    every = pii.find(docs(spark, [(1, f"{code} {plain}", "s")]), threshold=0.5).collect()[0].spans
    assert [(s.kind, s.start, s.end) for s in every] == []  # without a word of context anywhere nothing is proposed


def test_pii_many_spans_and_overlaps(spark):
    """Offsets and replacements over the chunks' bounds, by hand."""
    rng = random.Random(12)
    for n in (1, 127, 128, 129, 300, 9000):
        text = " ".join(rng.choice([f"é{i} a{i}@x.org", "+49 1234567890", "1.2.3.4", "4111 1111 1111 1111", "token: a1b2c3d4e5f6a7b8c9d0e1"]) for i in range(n))
        want, at, parts = spans_by_hand(text), 0, []
        got = pii.find(docs(spark, [(1, text, "s")])).collect()[0].spans
        assert [(s.kind, s.start, s.end) for s in got if s.kind != "secret"] == want
        for s in sorted(got, key=lambda s: (s.start, -s.end, s.kind)):
            if s.start >= at:
                parts.append(text[at : s.start] + f"<{s.kind.upper()}>")
            at = max(at, s.end)
        assert pii.redact(docs(spark, [(1, text, "s")])).collect()[0].text == "".join(parts) + text[at:]


CLASHES = "_id _c _content _h _n _s _key _again _copy _text _pii_email c0 c1 s s_email spans kept score fp node root keys n size h taken passes component_id place quality features".split()


def test_clashing_columns_pass_through(spark):
    """Columns named like anything inside an operator keep their names and values."""
    rng = random.Random(1)
    rows = [(i, babble(rng, 60) + f" a{i}@b.co", "a" if i % 2 else None, *(f"{c}{i}" for c in CLASHES)) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES))
    of = {r[0]: r[2:] for r in rows}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    vocabulary = queries.vocabulary_path()
    outs = [simhash.deduplicated(table), jaccard.deduplicated(table), mixing.mixed(table), pii.redact(table), quality.passing(table, quality.fit(table, labels)), bpe.encode(table, vocabulary, decoded="again")]
    for out in outs:
        assert out.columns[: len(table.columns)] == table.columns
        for r in out.collect():
            assert tuple(r)[2 : len(table.columns)] == of[r.doc_id]
    assert pii.find(table).columns == [c for c in table.columns if c != "spans"] + ["spans"]
    assert {r.doc_id for r in mixing.report(table).collect()} == set(of)
    for out in (substring.deduplicated(table), simhash.components(table), toxicity.score(table, toxicity.fit(table, labels), ["doc_id"]), quality.judge(table, quality.fit(table, labels), ["doc_id"])):
        assert {r.doc_id for r in out.collect()} == set(of)


# WARC


def page_rows():
    same = "<p>" + "same page " * 20
    return [(1, "http://a/1", same), (2, None, same), (3, "http://a/\n x", "é" * 500), (4, "u", None), (5, "u", ""), (6, "u", "x" * 200_000), (None, "u", same), (2, "again", same), (7, "u", "y")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, "response") for r in page_rows()], "page_id long, url string, html string, record_type string")
    want = []
    last = {}
    for i, _, h in page_rows():
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    for i, _, h in page_rows():
        raw = (h or "").encode()
        again = i is not None and i < last[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
    assert tuples(warc.read(warc.write(pages))) == sorted(want, key=repr)
    one = warc.write(pages, min_bytes=10).groupBy().count().first()[0]
    assert one >= 1
    assert [r for r in tuples(warc.read(warc.write(pages, min_bytes=10))) if r[0] in (4, 5)] == sorted([(i, 0, want[3][2], "response", None) for i in (4, 5)])
    assert warc.read(warc.write(pages.limit(0))).collect() == []


def test_warc_archives_are_validated(tmp_path, spark):
    records = [warc.record(i, f"http://h/{i}", f"<html>page {i} of many {'word ' * i}</html>".encode(), None) for i in range(200)]
    data = warc.pack(records)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert list(warc.frames(data)) == records
    raw = warc.frames(zstandard.ZstdCompressor().compress(records[0]))
    assert list(raw) == records[:1]
    for bad in (data[:-5], data[:6], data[:40], data + b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))
    for a, b in ((b"WARC/1.1", b"WARC/9"), (b"WARC-Date", b"X-Date"), (b"page 7", b"page 8"), (b"</html>", b"</html>x")):
        with pytest.raises(warc.WarcError):
            warc.interpret(*warc.parse(records[7].replace(a, b, 1)))
    (tmp_path / "a.warc.zst").write_bytes(data)
    assert warc.read_files(spark, str(tmp_path)).count() == 200


def test_warc_reading_is_linear_in_bytes(tmp_path, spark):
    """Frames are decoded from their own bytes: twice the archive takes about twice the time, whatever follows a frame."""
    rng = random.Random(1)
    record = [warc.record(i, f"http://h/{i}", rng.randbytes(700), None) for i in range(2000)]
    coder = zstandard.ZstdCompressor()
    took = []
    for times in (1, 8):
        data = b"".join(coder.compress(r) for r in record) * times
        began = time.process_time()
        assert sum(1 for _ in warc.frames(data)) == 2000 * times
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]
    (tmp_path / "big.warc.zst").write_bytes(warc.pack(record) * 1)
    (tmp_path / "none.warc.zst").write_bytes(b"")
    read = warc.read_files(spark, str(tmp_path), part_bytes=200_000)
    assert read.rdd.getNumPartitions() > 4 and sorted(r.record_id for r in read.collect()) == sorted(f"<urn:page:{i}>" for i in range(2000))


def test_warc_frame_ends():
    for level, text in ((1, b""), (3, b"a" * 1_000_000), (19, random.Random(2).randbytes(300_000)), (5, b"abc " * 50_000)):
        for sized, checked in ((True, True), (False, False)):
            one = zstandard.ZstdCompressor(level=level, write_content_size=sized, write_checksum=checked).compress(text)
            assert warc.frame_end(memoryview(b"x" + one + one), 1) == 1 + len(one)
            assert list(warc.frames(one + one)) == [text, text]
            for bad in (one[:-1], one[:6], one[:4]):
                with pytest.raises(warc.WarcError):
                    list(warc.frames(one + bad))


def test_warc_reads_ordinary_archives(tmp_path, spark):
    """Records of other tools: any type, uuid ids, chunked bodies, folded and missing headers."""
    made = lambda kind, more, block: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n{more}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    http, at = "Content-Type: application/http; msgtype=response\r\n", "WARC-Target-URI: http://h/x\r\n"
    sha = lambda x: f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(x).digest()).decode()}\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=1\r\nwiki\r\n3\r\n\x00ab\r\n0\r\n\r\n"
    records = [
        made("warcinfo", "Content-Type: application/warc-fields\r\n", b"software: x\r\n"),
        made("request", at + "Content-Type: application/http; msgtype=request\r\n", b"GET /x HTTP/1.1\r\nHost: h\r\n\r\n"),
        made("response", at + http + sha(b"wiki\x00ab"), chunked),
        made("revisit", at + http + "WARC-Profile: p\r\n  q\r\n", b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        made("metadata", at, b"via: y\r\n"),
        made("resource", "WARC-Target-URI: dns:h\r\nContent-Type: text/dns\r\n", b"1.2.3.4\n"),
    ]
    (tmp_path / "b.warc.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(r) for r in records))
    got = {r.record_type: r for r in warc.read_files(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and all(r.record_id == f"<urn:uuid:{k}>" for k, r in got.items())
    assert bytes(got["response"].payload) == b"wiki\x00ab" and got["response"].payload_bytes == 7 and got["response"].target_uri == "http://h/x"
    assert got["response"].http_head.startswith("HTTP/1.1 200 OK\r\nTransfer") and got["revisit"].headers["warc-profile"] == "p q"
    assert got["revisit"].payload is None and bytes(got["resource"].payload) == b"1.2.3.4\n" and bytes(got["warcinfo"].payload) == b"software: x\r\n"
    for bad in (records[2].replace(b"wiki", b"wild"), made("response", http, chunked[:-12])):
        with pytest.raises(warc.WarcError):
            warc.whole(*warc.parse(bad))
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>" * i) for i in range(1, 4)], "page_id long, url string, html string")
    assert {(r.target_uri, bytes(r.payload).decode()) for r in warc.read_records(warc.write(pages)).collect()} == {(f"http://h/{i}", "<p>" * i) for i in range(1, 4)}


# exact top-k


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(30)] + [(300, [1.0, -2.0]), (350, []), (400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (None, [1.0] * 8), (50, rows[50][1]), (50, [9.0] * 8), (600, [-1e9] * 8)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score long")
    fine = [(i, np.array([math.floor(256 * Fraction(float(x))) for x in np.array(v, np.float32)], object)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), i) for i, b in fine if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for per_block in (1000, 40):
        got = bitslice.search(bitslice.build(table, per_block), table.filter("vec_id % 50 = 0"), queries_per_block=(3, 3))
        assert tuples(got) == sorted(want, key=repr)
    assert bitslice.search(bitslice.build(table.limit(0)), table.limit(0)).collect() == []
    few = bitslice.search(bitslice.build(table.filter("vec_id < 2")), table.filter("vec_id = 0"))
    assert [(r.query_id, r.rank, r.vec_id) for r in few.collect()] == [(0, 1, 1)]


def test_topk_has_no_bound_on_components(spark):
    rng = random.Random(3)
    for scale in (1e6, 1e12, 1e40):
        rows = [(i, [rng.uniform(-scale, scale) for _ in range(4)]) for i in range(50)] + [(100, [0.001, 1.0, scale, -scale]), (150, [0.0, -1.0, 2.0, scale])]
        fine = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows}
        dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        want = []
        for q in (0, 100, 150):
            best = sorted((-dot(fine[q], v), i) for i, v in fine.items() if i != q)[:5]
            want += [(q, k + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, i) in enumerate(best)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert tuples(bitslice.search(bitslice.build(table, 20), table.filter("vec_id % 50 = 0"))) == sorted(want, key=repr)


# toxicity


def test_lexicon_matches_within_the_edit_distance():
    lexicon = toxicity.Lexicon([("idiot", False), ("worthless", False), ("lowei", True), ("scum", False)])
    distance = lambda a, b: _edits(a, b)
    rng = random.Random(2)
    for _ in range(1500):
        word = list(rng.choice(["idiot", "worthless", "loweisch", "scum", "abc"]))
        for _ in range(rng.randint(0, 3)):
            at, op = rng.randrange(len(word) + 1), rng.choice("ids")
            if op == "i":
                word.insert(at, rng.choice("idotxe"))
            elif word and at < len(word):
                word[at : at + 1] = [] if op == "d" else [rng.choice("idotx")]
        word = "".join(word)
        best = 9
        for term, stem in lexicon.terms:
            e = min(distance(term, word[:k]) for k in (range(len(word) + 1) if stem else [len(word)]))
            if e <= toxicity.errors_allowed(len(term)):
                best = min(best, e)
        assert lexicon.match(word) == best, word


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def toxic_table(spark):
    rng, rows, labels = random.Random(9), [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = babble(rng, 60).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["idiot", "scummy", "loweisch", "loweirat"]))
        rows.append((i, " ".join(words), "s"))
        if i % 7:
            labels.append((i, int(toxic), 1))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_table(spark)
    extra = [(None, None, "s"), (1000, "", "s"), (1001, "you id1ot, you idioot, you loweixx", "s"), (1001, "you id1ot, you idioot, you loweixx", "s"), (1002, "idiot " * 50_000, "s")]
    table = docs(spark, rows + extra)
    model = toxicity.fit(table, labels)
    assert {("idiot", False), ("scummy", False)} <= set(model.terms) and ("lowei", True) in model.terms
    got = {r.doc_id: r.score for r in toxicity.score(table, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(400))
    assert got[None] < 0.5 and got[1000] < 0.5 and got[1001] >= 0.5 and got[1002] >= 0.5
    text = 'he said "you idiot" and then left'
    assert toxicity.quoted(text, text.index("idiot"), text.index("idiot") + 5)
    assert not toxicity.quoted("you idiot and more", 4, 9)


def test_toxicity_without_labels(spark):
    rows, labels = toxic_table(spark)
    model = toxicity.fit(docs(spark, rows), labels.filter("toxic = 0"))
    assert model.terms == [] and all(r.score < 0.5 for r in toxicity.score(docs(spark, rows), model, ["doc_id"]).collect())
    assert toxicity.score(docs(spark, []), model, ["doc_id"]).collect() == []


def test_held_out_is_by_crc(spark):
    import zlib

    got = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(r[1] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in got)


# BPE


def test_bpe_is_the_librarys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["", "  a  ", "it's <|endoftext|> x<|endoftext|>", "\x1c\x1d a\x85b　c", "日本語 😀😀 ١٢٣", "a" * 3000, "x \n\n y\t", None, None]
    texts += ["".join(rng.choice(" \t\n\x1c\x85abcZé1²'stlv.!<|>😀中") for _ in range(40)) for _ in range(300)]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    coded = bpe.decode(bpe.encode(table, path), path)
    for r in coded.collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")
    assert bpe.encode(table.limit(0), path).collect() == []


# mixing


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, babble(rng, rng.randint(0, 40)), rng.choice(["hot"] * 6 + ["b", "c", "d", None])) for i in range(600)]
    rows += [(None, "one two", "b"), (601, None, "c"), (5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2])]
    table = docs(spark, rows)
    out = mixing.report(table).toPandas()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    target, free, budget = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # the excess is shared again until no target is above its limit
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    assert sorted(set(out["target"].round(6))) == sorted({round(t, 6) for t in target.values()})
    assert (out["taken"] <= 2 * out["size"]).all()
    for s in order:
        took = out.loc[(out["target"] - target[s]).abs() < 1e-6, "taken"].sum()
        assert abs(took - target[s]) <= 3 * 41
    assert out["taken"].sum() <= budget
    assert mixing.report(table).toPandas().sort_values(list(out.columns)).reset_index(drop=True).equals(out.sort_values(list(out.columns)).reset_index(drop=True))
    mixed = mixing.mixed(table)
    assert mixed.columns == table.columns
    assert mixed.select(F.sum(n_words(F.col("text")))).first()[0] == out["taken"].sum()
    assert mixing.report(table.limit(0)).collect() == []
    assert [tuple(r) for r in mixing.report(docs(spark, [(1, "", "a"), (2, None, None)])).select("taken", "target").collect()] == [(0, 0.0)] * 2


def test_mix_in_many_buckets(spark, monkeypatch):
    rng = random.Random(6)
    table = docs(spark, [(i, babble(rng, rng.randint(1, 9)), rng.choice("ab")) for i in range(300)])
    whole = tuples(mixing.report(table))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixing, "BINS", 5)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert tuples(mixing.report(table)) == whole


def test_toxicity_features_and_score_by_hand():
    """Hits by edit distance to every term, one by one; the score from the weights."""
    terms = [("idiot", False), ("worthless", False), ("lowei", True), ("scum", False)]
    lexicon, rng = toxicity.Lexicon(terms), random.Random(21)
    pieces = ["idiot", "idoit", "1diot", "worthles", "worthless", "loweish", "scum", "scam", "fine", "day", '"idiot"', "«scum»", "said scum", "he", "x" * 70]

    def near(word):
        best = 9
        for letters, stem in terms:
            some = {word[:k] for k in range(len(word) + 1)} if stem else {word}
            best = min([best, *(d for d in (_edits(letters, x) for x in some) if d <= toxicity.errors_allowed(len(letters)))])
        return best

    model = toxicity.Model(terms, [1.5, 0.5, -1.0, 0.2, 2.0], -2.0)
    for _ in range(300):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        low, n, hits = text.lower(), 0, {"exact": 0, "near": 0, "quoted": 0}
        for m in re.finditer(r"[^\W_]+", low):
            n += 1
            e = near(toxicity.plain(m[0]))
            if e < 9:
                hits["quoted" if toxicity.quoted(low, *m.span()) else "near" if e else "exact"] += 1
        want = [math.log1p(hits["exact"]), math.log1p(hits["near"]), math.log1p(hits["quoted"]), min(3.0, 100 * (hits["exact"] + hits["near"]) / max(1, n)), float(hits["exact"] > 1)]
        got = toxicity.features(text, lexicon, {})
        assert got == pytest.approx(want)
        assert model.score(got) == pytest.approx(1 / (1 + math.exp(2.0 - sum(a * b for a, b in zip(model.weights, want, strict=True)))))
    assert toxicity.quoted("er sagte: scum", 10, 14) and toxicity.quoted("la palabra scum", 11, 15) and not toxicity.quoted("you scum", 4, 8)


# SimHash


def print_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    rng, rows = random.Random(8), [(None, "", "s"), (90, None, "s"), (91, " ", "s"), (92, "One two", "s"), (92, "one TWO", "s")]
    for i in range(25):
        text = babble(rng, 300)
        rows.append((i, text, "s"))
        for k in range(rng.randint(0, 3)):
            words = text.split()
            words[rng.randrange(len(words))] = "edit"
            rows.append((100 + 4 * i + k, rng.choice([" ", "\n"]).join(words), "s"))
    rows += [(i + 500, rows[i][1], "s") for i in range(10)] + [rows[7]]
    prints = [print_by_hand(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = sorted(((rows[i][0], signed(prints[i]), least.get(find(i))) for i in range(len(rows))), key=repr)
    table = docs(spark, rows)
    assert tuples(simhash.components(table).select("doc_id", "fp", "component_id")) == want
    kept = simhash.deduplicated(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.components(table.limit(0)).collect() == [] and simhash.deduplicated(table.limit(0)).collect() == []


def test_simhash_links_once_and_all(spark):
    rng = random.Random(3)
    prints = {0, 1, 3, 7, 15, 31, 1 << 63, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(6):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for distance in (2, 4):
        want = sorted((a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance)
        for refine in (False, True):
            assert tuples(simhash.links(nodes, distance, refine)) == sorted(want, key=repr)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 70)] + [(200, 100), (150, 200)], "a long, b long")
    got = {r.node: r.root for r in simhash.roots(edges).collect()}
    assert got == {i: 0 for i in range(1, 71)} | {150: 100, 200: 100}


# quality rules


def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    some = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    marked = {k for i, w in enumerate(windows) if w in twice for k in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in some[:i] for i, x in enumerate(some)), len(marked))


def test_quality_counts_and_verdicts(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(120):
        good = i % 3 > 0
        text = babble(rng, 80, [w + str(k) for w in WORDS for k in range(9)])
        rows.append((i, text if good else re.sub(" ", "### ", text), "s"))
        labels.append((i, int(good), 0))
    rows += [(None, None, "s"), (200, "", "s"), (201, "a\na\n\n \n b\na", "s"), (202, "for " * 70, "s"), (203, "é ü\x85 x　y\x1c z " * 30, "s"), (203, "x", "s"), (204, babble(rng, 30_000), "s")]
    table, labelled = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(table, labelled)
    got = quality.judge(table, model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        if len(r.text or "") < 5000:
            want = counts_by_hand(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
        if r.doc_id is not None and r.doc_id < 120:
            assert r.kept == (r.doc_id % 3 > 0)
    passed = quality.passing(table, model)
    assert passed.columns == table.columns and {r.doc_id for r in passed.collect()} == {r.doc_id for r in got if r.kept}
    for some in (labelled.limit(0), labelled.filter("quality = 1")):
        lone = quality.fit(table, some)
        assert all(r.kept == (not r.base_failed) for r in quality.judge(table, lone, ["doc_id"]).collect())
    assert quality.judge(table.limit(0), model, ["doc_id"]).collect() == []


def test_quality_margin_and_calibration_by_hand(spark):
    """The margin as a sum over every feature, one by one; slope and shift where the smoothed loss is least."""
    import zlib

    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(0, 1, 3 << quality.BITS).astype(np.float32), 0.25, 1.7, -0.4)
    for text in ("", "a", "a a b", "ab cd ab cd é", babble(random.Random(1), 200)):
        data = text.encode()
        words, mask = data.split(), (1 << quality.BITS) - 1
        hashes = [zlib.crc32(w) for w in words]
        pair = lambda x, y: 0 if x == y else (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) >> 64 - quality.BITS
        parts = [[h & mask for h in hashes], [pair(x, y) for x, y in zip(hashes, hashes[1:])], [(int.from_bytes(data[i : i + 4], "little") * 2654435761 & 0xFFFFFFFF) >> 32 - quality.BITS for i in range(len(data) - 3)]]
        want = 0.25 + sum(sum(float(model.weights[(block << quality.BITS) + h]) for h in hs) / len(hs) for block, hs in enumerate(parts) if hs)
        got = quality.verdict(text, model)
        assert got[6] == pytest.approx(1 / (1 + math.exp(-(1.7 * want - 0.4))), rel=1e-6)
    z, y = rng.normal(0, 2, 400), (rng.random(400) < 0.6).astype(float)
    slope, shift = quality.platt(z, y)
    aim = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda a, b: -np.mean(aim * np.log(1 / (1 + np.exp(-a * z - b))) + (1 - aim) * np.log(1 - 1 / (1 + np.exp(-a * z - b))))
    assert all(loss(slope, shift) <= loss(max(slope + d, 1e-3), shift + e) + 1e-6 for d in (-0.1, 0, 0.1) for e in (-0.1, 0, 0.1))


def test_fits_take_one_row_of_an_id(spark):
    rng = random.Random(5)
    rows = [(i, babble(rng, 60) + (" vile scumbag" if i % 2 else ""), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    once, often = docs(spark, rows), docs(spark, rows + [rows[3]] * 200 + [(None, "x", "s")])
    assert all((a == b).all() for a, b in zip(quality.sample_features(once, labels), quality.sample_features(often, labels), strict=True))
    assert toxicity.fit(once, labels) == toxicity.fit(often, labels)


# shared helpers


def test_written_tables_lie_in_the_shared_folder(spark):
    df = write_shared(spark.range(5).toDF("a"), "t")
    assert df.count() == 5 and all(shared_dir(spark).rstrip("/") in f for f in df.inputFiles())


def test_map_text_keeps_other_columns(spark):
    table = docs(spark, [(1, "a", "s"), (2, None, "t")])
    out = map_text(table, "text", ["doc_id", "source"], [("n", "long")], lambda: lambda texts: [[len(t or "") for t in texts]])
    assert tuples(out) == [(1, "s", 1), (2, "t", 0)]
    assert pa.types.is_int64(out.toArrow().schema.field("n").type)


# nearest neighbours by a k-means tree


def vectors(spark, rows):
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "l", 1.0) for i, v in rows], "vec_id long, embedding array<float>, leaf string, score double")


def nearest_by_hand(rows, asked, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for i, q in good:
        if asked(i):
            scored = []
            for j, v in good:
                if j != i:
                    m = min(len(q), len(v))
                    s = 0.0
                    for a, b in zip(q[:m], v[:m], strict=True):
                        s += a * b
                    scored.append((-s, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows_per_block", [7, 8192])
def test_tree_with_all_leaves_is_exact(spark, rows_per_block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(40)]  # many equal rows, and ties
    rows += [(5, rng.normal(size=6).tolist()), (300, [2.0, 1.0]), (301, [1.0] * 9)]  # a repeated id, a short and a long vector
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [None, 1.0]), (404, [float("nan")] * 6), (405, [float("inf")] * 6), (None, [1.0] * 6)]
    table = vectors(spark, rows)
    index = kmtree.build(table, k=4, recall=1.0, sample=100, leaf_rows=10, rows_per_block=rows_per_block)
    assert index.tree.leaves > 5
    index.visits = index.tree.leaves
    found = kmtree.search(index, table.filter("vec_id % 5 = 0"), k=4, queries_per_block=16)
    assert sorted(tuple(r) for r in found.collect()) == nearest_by_hand(rows, lambda i: i % 5 == 0, 4)


def test_tree_reaches_the_recall_with_part_of_the_leaves(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(60, 16)) * 3
    rows = [(i, (centers[i % 60] + rng.normal(size=16)).tolist()) for i in range(3000)]
    table = vectors(spark, rows)
    index = kmtree.build(table, k=10, leaf_rows=25, rows_per_block=500)
    assert 1 <= index.visits < index.tree.leaves / 2
    queries = table.filter("vec_id % 20 = 0")
    want = {}
    for i, _, j, _ in nearest_by_hand(rows, lambda i: i % 20 == 0, 10):
        want.setdefault(i, set()).add(j)
    got = kmtree.search(index, queries, k=10).collect()
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_tree_finds_all_of_few_and_none_of_nothing(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(7)]
    table = vectors(spark, rows)
    index = kmtree.build(table, leaf_rows=1, recall=0.01)
    index.visits = 1
    assert sorted(tuple(r) for r in kmtree.search(index, table).collect()) == nearest_by_hand(rows, lambda i: True, 20)
    empty = vectors(spark, [])
    assert kmtree.search(kmtree.build(empty), table).collect() == [] and kmtree.search(index, empty).collect() == []
    huge = vectors(spark, [(1, [3e38, 3e38]), (2, [3e38, -3e38]), (3, [1.0, 1.0])])
    assert len(kmtree.search(kmtree.build(huge), huge).collect()) == 6


def test_tree_walks_best_bin_first():
    tree = kmtree.fit(np.array([[x, y] for x in (0.0, 1, 10, 11) for y in (0.0, 1, 10, 11)] * 4), 8, branches=2)
    order = list(tree.walk(np.array([1.0, 1.0])))
    assert sorted(order) == list(range(tree.leaves))
    at = tree.assign(np.array([[10.5, 10.5], [0.5, 0.5]]))
    assert order[0] == at[0] and order.index(at[1]) > len(order) / 2


# importance resampling


def resampled_by_hand(rows, target, orders=1, buckets=10_000, least=20, percent=10):
    import zlib

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(resampling.UPPER, resampling.LOWER)))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for i in range(len(w)) for k in range(1, orders + 1) if i + k <= len(w)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    scored = []
    for i, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least, hashlib.md5((text or "").encode()).hexdigest()))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[5]))
    drawn = percent * len(able) // 100
    out = [(*x[:4], r + 1 if r < drawn else None) for r, x in enumerate(able)] + [(*x[:4], None) for x in scored if not x[4]]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("orders", "buckets", "percent", "per_range"), [(1, 10_000, 10, 20_000), (1, 50, 40, 7), (2, 300, 50, 5), (3, 10_000, 30, 20_000)])
def test_resampling_matches_brute_force(spark, monkeypatch, orders, buckets, percent, per_range):
    monkeypatch.setattr(resampling, "RANGE_ROWS", per_range)
    monkeypatch.setattr(resampling.ranked, "__defaults__", (per_range,))
    rng = random.Random(orders)
    rows = [(i, babble(rng, rng.randint(0, 60), [*WORDS, "Éa", "ÀB", "İx", "x9", "日本", "A-B"])) for i in range(60)]
    rows += [(None, None), (61, ""), (62, " -- "), (63, babble(rng, 5000)), (None, babble(rng, 30))]
    same = babble(rng, 40)
    rows += [(7, same)] * 9 + [(70 + i, same) for i in range(5)]
    target = [babble(rng, 30, WORDS[:4]) for _ in range(5)] + [None, "", "alpha beta"]
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    table = spark.createDataFrame([(i, t, 1, 2, "z", 0) for i, t in rows], "doc_id long, text string, rank int, bucket int, content string, copies int")
    got = resampling.resample(table, aims, orders=orders, buckets=buckets, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled_by_hand(rows, target, orders, buckets, percent=percent)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, babble(random.Random(1), 30))] * 30, "doc_id long, text string")
    assert resampling.resample(none, some).collect() == []
    got = resampling.resample(some, none).collect()
    assert sorted(r["rank"] or 99 for r in got) == [1, 2, 3] + [99] * 27 and {r.n_features for r in got} == {30}


# fill in the middle


def infilled_by_hand(rows, units, rate=90, spm=20, seed=1):
    out = []
    for i, text in rows:
        t = text or ""
        pieces = units(t)
        h = [int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(pieces) + 1), h[1] % (len(pieces) + 1)))
        prefix, middle, suffix = ("".join(x) for x in (pieces[:a], pieces[a:b], pieces[b:]))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            out.append((i, len(pieces), "plain", None, None, t))
        elif h[3] % 100 < spm:
            out.append((i, len(pieces), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"))
        else:
            out.append((i, len(pieces), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"))
    return sorted(out, key=repr)


UNITS = {
    "every_character": list,
    "word_starts": lambda t: re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*(?![\x20\x09-\x0D])|[\x20\x09-\x0D]+", t) if not t[:1].isspace() else re.findall(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t),
    "line_starts": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
}


@pytest.mark.parametrize("unit", sorted(UNITS))
@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_infill_matches_brute_force_and_restores(spark, unit, chunk):
    rng = random.Random(chunk)
    rows = [(i, "".join(rng.choice(["a", "é", "😀", " ", "\n", "<", "P>", "日本", "\t", "x y"]) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    rows += [(None, None), (None, "ab cd\nef"), (90, ""), (91, "x<P>y"), (92, "x<S>"), (93, "<M>"), (94, "\n"), (95, " "), (96, "<"), (97, "long 😀 line\n" * (20 if chunk == 1 else 3000)), (3, "again"), (3, "again")]
    table = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, n string, low int, t string")
    cut = infill.transform(table, ends=getattr(infill, unit), chunk=chunk).withColumn("restored", infill.restore(F.col("output"), F.col("form")))
    got = cut.collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in got), key=repr) == infilled_by_hand(rows, UNITS[unit])
    assert sorted((r.doc_id, r.restored) for r in got if r.doc_id is not None) == sorted((i, t) for i, t in rows if i is not None)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_infill_keeps_columns_and_refuses_what_it_cannot_restore(spark):
    table = spark.createDataFrame([(1, "abc", 7), (2, None, 8)], "doc_id long, text string, k0 int")
    assert infill.transform(table.limit(0)).collect() == []
    assert {(r.doc_id, r.k0) for r in infill.transform(table, keep=("doc_id", "k0")).collect()} == {(1, 7), (2, 8)}
    assert infill.transform(table, markers=("[a", "[b", "[c")).columns[0] == "doc_id"
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("ab", "ba", "<M>"), ("", "<S>", "<M>"), ("x<S>y", "<S>", "<M>")):
        with pytest.raises(ValueError, match="told apart"):
            infill.transform(table, markers=bad)
    with pytest.raises(ValueError, match="clash"):
        infill.transform(table.withColumn("output", F.lit(1)), keep=("output",))


def test_toxicity_learns_long_words_and_keeps_names_apart(spark):
    long = "qwertzuiopasdfghjklyxcvbnm" * 4
    rows = [(i, f"a fine day {long if i % 2 else 'indeed'} number", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), labels, depth=10)
    assert (long, False) in model.terms
    got = toxicity.score(docs(spark, rows), model, ["doc_id", "score"])
    assert got.columns == ["doc_id", "score", "hits"] and all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got.collect())
