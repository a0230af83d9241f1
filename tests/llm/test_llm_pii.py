"""Personal data and disclosing terms against Python's own pattern matching and counts."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from llm_rows import EDGE, awkward, prose
from tillroll.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    own = [int(d) for d in digits]
    return (sum(own[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in own[-2::-2])) % 10 == 0


def valid(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text: str) -> list[tuple[str, int, int, str, tuple]]:
    """(kind, start, end, entity, words near it)."""
    out = []
    for kind, pattern in PATTERNS.items():
        ms = list(re.finditer(pattern, text))
        for i, m in enumerate(ms):
            if not valid(kind, m.group()):
                continue
            before = text[ms[i - 1].end() if i else 0 : m.start()]
            behind = text[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(text)]
            left, right = LETTERS.findall(before[-160:]), LETTERS.findall(behind[:160])
            left, right = left[1:] if len(before) > 160 else left, right[:-1] if len(behind) > 160 else right
            near = [w.lower() for w in left[-4:] + right[:4] if len(w) >= 3]
            value = re.sub("[^0-9]", "", m.group()) if kind in ("card", "phone") else m.group().lower()
            out.append((kind, m.start(), m.end(), f"{kind}:{value}", tuple(near)))
    return out


def expected(rows: list[tuple], threshold: float) -> list[tuple]:
    found = [(i, t or "", base(t or "")) for i, t in rows]
    docs, both, holders = Counter(), Counter(), Counter()
    for _, t, spans in found:
        docs.update({w.lower() for w in LETTERS.findall(t) if len(w) >= 3})
        both.update({(s[3], w) for s in spans for w in s[4]})
        holders.update({s[3] for s in spans})
    begin_docs: dict[str, int] = defaultdict(int)
    for w, n in docs.items():
        begin_docs[w[:3]] = max(begin_docs[w[:3]], n)
    known: dict[str, dict[str, str]] = defaultdict(dict)
    for (e, w), n in both.items():
        information = math.log2(len(rows) / holders[e])
        if information and 1 + math.log2(n / docs[w]) / information >= threshold:
            general = 1 + math.log2(min(1, holders[e] / begin_docs[w[:3]])) / information
            known[e][w] = w[:3] + "*" if len(w) > 3 and general < threshold else ""
    out = []
    for i, t, spans in found:
        secret: dict[str, str] = {}
        for e in {s[3] for s in spans}:
            for w, g in known[e].items():
                secret[w] = "" if "" in (g, secret.get(w, g)) else g
        terms = []
        for m in LETTERS.finditer(t):
            if m.group().lower() in secret and not any(s[1] < m.end() and m.start() < s[2] for s in spans):
                terms.append((m.start(), m.end(), secret[m.group().lower()]))
        out.append((i, [s[:4] for s in spans], terms))
    return out


def cleaned(text: str, spans: list, terms: list) -> str:
    out, done = "", 0
    for a, b, into in sorted([(s, e, f"<{k}>") for k, s, e, _ in spans] + [tuple(t) for t in terms]):
        if a >= done:
            out += text[done:a] + into
        done = max(done, b)
    return out + text[done:]


PERSONAL = [
    "mail a.b%c+d@mail.example.com now", "x@y.z_w@v.u and x@y.z.@q.r.s", "a@b @c.d a@b.c-", "@x.y a@@b.c ..@a.b", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255",
    "1.2.3 1..2.3.4 300.1.2.3.4", "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111", "0000000000000 12345678901234567890 5500005555555559-", "phone +1 (743) 555-3824. +49.30.123456 +1-- +12",
    "+1 555 555 5555 +2 (5) 4", "é🙂 a@b.co 🙂 10.0.0.1 日本 +1 (743) 555-3824", "+4111 1111 1111 1111", "1.1.1.1" * 40, "a@b.cd " * 70,
]


def rows() -> list[tuple]:
    rnd = random.Random(5)
    letters = "ab1 .@+-()2345%_é🙂"
    out = EDGE + list(enumerate(PERSONAL, 20))
    out += [(100 + i, "".join(rnd.choices(letters, k=rnd.randint(1, 120)))) for i in range(250)]
    out += [(400 + i, prose(rnd, 60)) for i in range(60)]
    mails = ["ann@home.example.org", "bob@work.example.org"]
    for i in range(12):  # a name that stands beside one address, in several texts, and far from it
        words = prose(rnd, 40).split(" ")
        at = rnd.randrange(2, 30)
        words[at:at] = ["Zanzibella", mails[i % 2] if i < 8 else "+1 (743) 555-3824", "Quorvex"] if i % 2 == 0 else [mails[1], "Mulvane"]
        out.append((500 + i, " ".join([*words, "zanzibella" if i % 4 == 0 else "end"])))
    out += [(600, "THE name thetis@home.example.org İstanbul"), (601, "thetis is a name as then"), (None, "ann@home.example.org"), (500, out[-2][1])]
    return out


def shape(found) -> list[tuple]:
    return [(r["doc_id"], [tuple(s) for s in r["spans"]], [tuple(t) for t in r["terms"]]) for r in found]


def test_spans_and_terms_equal_plain_counting(spark):
    got = shape(pii.personal_data(awkward(spark, rows()).repartition(3)).collect())
    want = expected(rows(), pii.THRESHOLD)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any("zan*" in str(terms) or terms for _, _, terms in got if terms)
    assert {i for i, spans, terms in got if terms and not spans} == set()


def test_lower_threshold_finds_more(spark):
    want = expected(rows(), 0.5)
    assert sorted(shape(pii.personal_data(awkward(spark, rows()), threshold=0.5).collect()), key=str) == sorted(want, key=str)
    assert sum(len(t) for *_, t in want) > sum(len(t) for *_, t in expected(rows(), 0.9)) > 0
    assert {g != "" for *_, terms in want for *_, g in terms} == {True, False}


def test_sanitised_texts(spark):
    got = pii.sanitise(awkward(spark, rows()), threshold=0.5)
    assert got.columns == ["doc_id", "text", "score", "id", "kept"]
    want = [(i, t if t is None else cleaned(t, s, terms)) for (i, t), (_, s, terms) in zip(rows(), expected(rows(), 0.5), strict=True)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_long_runs_and_many_matches(spark):
    long = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "+1" + "-" * 200_000), (4, "a@b" + ".c" * 60_000), (5, "1.2.3.4 " * 5000), (6, "9-" * 50_000), (7, "x@y.zz " * 3000 + "é" * 9)]
    got = {r["doc_id"]: r for r in pii.digests(pii.personal_data(awkward(spark, long))).collect()}
    for i, t in long[3:]:
        want = ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in base(t))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), i
    assert [got[i]["spans"] for i in (1, 2, 3)] == ["", "", ""]
    assert (got[5]["n_ip"], got[7]["n_email"]) == (5000, 3000)


def test_digests_and_empty_table(spark):
    got = pii.digests(pii.personal_data(awkward(spark, [(1, "a@b.co, 10.0.0.1"), (2, None)])))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    text = "email:0:6,ip:8:16"
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, 0, 0, hashlib.sha256(text.encode()).hexdigest(), text), (2, 0, 0, 0, 0, empty, "")]
    assert pii.personal_data(awkward(spark, [(1, "x")]).where("doc_id < 0")).collect() == []


def test_no_python_in_the_plan(spark):
    plan = pii.digests(pii.personal_data(awkward(spark, PERSONAL and [(1, "a@b.co")])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
