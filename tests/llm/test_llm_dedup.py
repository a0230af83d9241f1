"""Exact, suffix, span and n-gram dedup, against brute force."""

from __future__ import annotations

import ctypes
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm_rows import EDGE, awkward, prose, words
from tillroll.llm import common, exact_dedup, ngram_jaccard, span_dedup, suffix_dedup
from tillroll.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def noisy(seed: int, n: int = 60) -> list[tuple[int, str]]:
    """Documents with exact copies, near copies and shared passages, ids in random order."""
    rnd = random.Random(seed)
    passage = prose(rnd, 60)
    base = [prose(rnd, rnd.randint(3, 160)) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = rnd.choice(base)
        kind = i % 6
        if kind == 1:
            w = t.split(" ")
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        elif kind == 3:
            t = t.upper()
        elif kind == 4:
            t = prose(rnd, rnd.randint(1, 120))
        out.append((i, t))
    ids = list(range(n))
    rnd.shuffle(ids)
    return [(ids[i], t) for i, t in out]


# ---- exact ----


def test_exact_groups(spark):
    rows = EDGE + noisy(1) + [(500 + i, "Very many copies") for i in range(300)] + [(9, "É"), (10, "é"), (11, "")]
    got = exact_dedup.exact_groups(awkward(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(UPPER)].append(i)
    want = []
    for i, t in rows:
        own = groups[(t or "").translate(UPPER)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest()))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter(want)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_groups(awkward(spark, [])).count() == 0


def test_drop_copies_keeps_rows_as_they_are(spark):
    docs = awkward(spark, EDGE + noisy(2))
    out = exact_dedup.drop_copies(docs)
    assert out.schema.fieldNames() == docs.schema.fieldNames()
    texts = [(r["text"] or "").translate(UPPER) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(UPPER) for _, t in EDGE + noisy(2)})
    assert {("A" if r["text"] == "A" else r["text"]) for r in out.collect()} >= {"a"}


def test_drop_near_copies_decides_by_row(spark):
    rnd = random.Random(9)
    long, other = prose(rnd, 120), prose(rnd, 90)
    near = [" ".join([*long.split(" ")[: 119 - k], "tail"]) for k in range(5)]
    rows = [(1, long), (2, near[0]), (2, other), (None, near[1]), (None, near[2]), (None, prose(rnd, 70)), (3, ""), (3, ""), (None, None), (4, "few words"), (4, "few words")]
    out = ngram_jaccard.drop_near_copies(awkward(spark, rows).repartition(3))
    assert out.columns == ["doc_id", "text", "score", "id", "kept"]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([rows[0], rows[2], rows[5], rows[6], rows[7], rows[8], rows[9]])
    # without ids at all one row stays, and so it does of rows that repeat id and text
    alone = ngram_jaccard.drop_near_copies(awkward(spark, [(None, t) for t in near] + [(None, near[0])] * 3)).collect()
    assert len(alone) == 1 and alone[0]["text"] in near
    assert ngram_jaccard.drop_near_copies(awkward(spark, [])).collect() == []


def test_jaccard_steps_hand_python_few_rows_at_a_time(spark, monkeypatch):
    held = []
    for name in ("checkpointed", "written"):
        run = getattr(common, name)
        monkeypatch.setattr(ngram_jaccard, name, lambda df, run=run: [held.append((df, spark.conf.get(common.BATCH_ROWS))), run(df)][1])
    before = spark.conf.get(common.BATCH_ROWS)
    ngram_jaccard.jaccard_components(awkward(spark, EDGE + noisy(5)))
    python = [int(rows) for df, rows in held if "MapInArrow" in df._jdf.queryExecution().logical().toString()]
    assert len(python) == 2 and max(python) <= 1000 and spark.conf.get(common.BATCH_ROWS) == before

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["rows"])

    with common.small_batches(spark):
        rows = spark.range(0, 2500, 1, 1).mapInArrow(sizes, "rows long").collect()
    assert [r["rows"] for r in rows] == [1000, 1000, 500]


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs glibc")
def test_released_caches_go_back_to_the_system():
    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    cache = common.worker_cache("test")
    cache["x"] = [np.ones(4000, np.uint8) for _ in range(30_000)]
    above = np.ones(4000, np.uint8)  # keeps the top of the heap
    held = resident()
    common.release_caches()
    assert not cache and len(above) == 4000
    assert held - resident() > 60_000_000


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.exact_groups(awkward(spark, EDGE))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan


# ---- suffix ----


def brute_removed(rows: list[tuple], width: int) -> dict:
    last = 2**63 - 1
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            first[w] = min(first.get(w, last), last if i is None else i)
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < (last if i is None else i):
                gone[p : p + width] = [True] * width
        runs = sum(g and not h for g, h in zip(gone, [False, *gone]))
        out[(i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("seed,width", [(1, 50), (2, 20), (3, 9)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, seed, width):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1 << 11)  # several slices and ranges
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 1 << 12)
    rows = EDGE + [(600, "ab" * 100), (601, "ba" * 90), (602, "x" * 70), (603, "é" * 80)] + [(i + 20, t) for i, t in noisy(seed, 36)]
    got = suffix_dedup.suffix_dedup(awkward(spark, rows), width=width).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == brute_removed(rows, width)


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.suffix_dedup(awkward(spark, [])).count() == 0
    assert suffix_dedup.digests(suffix_dedup.suffix_dedup(awkward(spark, [(1, None)]))).first()["n_bytes"] == 0


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 100)
    rnd = random.Random(4)
    texts = [bytes(rnd.choices(b"abc", k=k)) for k in (0, 5, 49, 50, 99, 100, 101, 149, 150, 999)]
    seen = Counter()
    for buf, ends, doc, offset in suffix_dedup.pieces(texts):
        s = suffix_dedup.Stretches(buf, ends)
        begin = np.r_[0, ends][s.owner]
        for a, b, d, o in zip(s.start - begin + offset[s.owner], s.end - begin + offset[s.owner], doc[s.owner], offset[s.owner], strict=True):
            seen.update((int(d), p) for p in range(a, b - 49))
    assert seen == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 49))


def test_blind_trie_and_window_sort():
    rnd = random.Random(8)
    strings = [bytes(rnd.choices(b"ab\x00\xff", k=9)) for _ in range(300)]
    trie = suffix_dedup.BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    leaves = trie.leaves()
    assert [strings[leaf[0]] for leaf in leaves] == sorted(set(strings))
    assert all(len({strings[m] for m in leaf}) == 1 for leaf in leaves)
    text = bytes(rnd.choices(b"ab", k=600)) + bytes(rnd.choices(b"ab", k=80)) * 5
    pos = np.arange(len(text) - 49)
    order, first = suffix_dedup.sort_windows(np.frombuffer(text, np.uint8), pos)
    windows = [text[p : p + 50] for p in pos[order].tolist()]
    assert windows == sorted(windows)
    assert first.tolist() == [True] + [a != b for a, b in zip(windows, windows[1:])]


# ---- spans ----


def brute_spans(rows: list[tuple], run: int = span_dedup.RUN) -> dict:
    first: dict[tuple, int] = {}
    last = 2**63 - 1
    units = [(last if i is None else i, i, span_dedup.sentences(t or ""), t or "") for i, t in rows]
    for key, _, u, _ in units:
        for k in range(len(u) - run + 1):
            span = tuple(x[2] for x in u[k : k + run])
            first[span] = min(first.get(span, last), key)
    out = Counter()
    for key, i, u, t in units:
        gone, seen = [False] * len(u), set()
        for k in range(len(u) - run + 1):
            span = tuple(x[2] for x in u[k : k + run])
            if first[span] < key or span in seen:
                gone[k : k + run] = [True] * run
            seen.add(span)
        out[(i, len(u), sum(gone), "".join(t[x[0] : x[1]] for x, g in zip(u, gone) if not g))] += 1
    return out


def test_one_of_many_documents_without_an_id_keeps_a_passage(spark):
    passage = "This passage stands in all of them. It has more than one long sentence. And so it goes on and on."
    rows = [(None, f"Text number {k} begins like this {k}. {passage} It ends with number {k} then.") for k in range(60)]
    got = [r["kept"] for r in span_dedup.dedup_spans(awkward(spark, rows + rows[:1]).repartition(4)).collect()]
    keeping = [t for t in got if "more than one long sentence" in t]
    assert len(set(keeping)) == 1 and len(got) == 61
    with_id = span_dedup.dedup_spans(awkward(spark, [*rows, (5, passage)])).collect()
    assert [r["doc_id"] for r in with_id if "more than one long sentence" in r["kept"]] == [5]


def test_span_dedup_equals_brute_force(spark):
    rows = EDGE + noisy(5, 60) + [(900, "One two three four five. Six seven eight nine ten. " * 3)]
    got = span_dedup.dedup_spans(awkward(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_sentences"], r["n_removed"], r["kept"]) for r in got) == brute_spans(rows)
    for r in got:
        text = next(t or "" for i, t in rows if i == r["doc_id"])
        cut = "".join(text[a:b] for a, b in zip([0, *(s["end"] for s in r["spans"])], [*(s["start"] for s in r["spans"]), len(text)]))
        if [i for i, _ in rows].count(r["doc_id"]) == 1:
            assert cut == r["kept"]
    assert span_dedup.dedup_spans(awkward(spark, [])).count() == 0


def test_sentences_cover_the_text():
    rnd = random.Random(6)
    for _ in range(200):
        t = "".join(rnd.choices(["a", "bc ", ". ", "! ", "\n", " ", "?", "x.y "], k=rnd.randint(0, 40)))
        units = span_dedup.sentences(t)
        assert "".join(t[a:b] for a, b, _ in units) == t
        assert all(len(u[2].split()) >= span_dedup.LEAST_WORDS for u in units[:-1])


def test_drop_repeats_returns_the_rows(spark):
    passage = "This passage stands in two of the documents. It has more than one long sentence. And so it goes on and on."
    rows = [(1, passage + " First one keeps it all here."), (2, "Another begin of some text. " + passage), (3, passage), (4, "Clean text of its own here."), (5, None)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in rows], "doc_id long, text string, n_chars long, kept string")
    out = {r["doc_id"]: r for r in span_dedup.drop_repeats(docs).collect()}
    assert set(out) == {1, 2, 4, 5}  # nothing is left of 3
    assert out[1]["text"] == rows[0][1] and out[4]["text"] == rows[3][1] and out[5]["text"] is None
    assert out[2]["text"].strip() == "Another begin of some text." and out[2]["n_chars"] == len(out[2]["text"])
    assert out[2]["kept"] == "s"


def shares_left(spark, passages: list[str], hosts: list[list[tuple[str, str]]]) -> tuple[list[float], set[int]]:
    """Each passage in a document of its own and later between each pair of its hosts: which
    share of its characters is left in the later ones, and the documents whose host lost something."""
    rows = [(1000 * k + i, before, passage, after) for k, passage in enumerate(passages) for i, (before, after) in enumerate([("", ""), *hosts[k]])]
    docs = spark.createDataFrame([(i, a + b + c) for i, a, b, c in rows], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in span_dedup.dedup_spans(docs).collect()}
    left, lost = [], set()
    for i, before, passage, after in rows:
        gone = {x for s in spans[i] for x in range(s["start"], s["end"])}
        own = set(range(len(before), len(before) + len(passage)))
        if i % 1000:
            left.append(1 - len(gone & own) / len(own))
        if {x for x in gone - own if not (before + passage + after)[x].isspace()}:
            lost.add(i)
    return left, lost


def test_passages_without_ascii_sentences_are_removed(spark):
    rnd = random.Random(12)

    def script(first: int, last: int, n: int, between: list[str]) -> str:
        return "".join(x for _ in range(n) for x in ("".join(chr(rnd.randint(first, last)) for _ in range(rnd.randint(2, 7))), rnd.choice(between)))

    passages = [
        script(0x4E00, 0x9FA0, 60, ["", "", "，", "。"]),
        script(0x4E00, 0x9FA0, 60, [""]),
        script(0x0E01, 0x0E2E, 60, ["", "", "", " "]),
        script(0x0905, 0x0939, 60, [" ", " ", " ", "। ", "।"]),
        script(0x0621, 0x063A, 60, [" ", " ", " ", "، ", "؟ "]),
        " ".join(words(rnd, 60)),
        " ".join(words(rnd, 30)) + ". " + " ".join(words(rnd, 30)),
        "".join(rnd.choices("abcdefghij0123456789", k=400)),
    ]
    hosts = [[(" ".join(words(rnd, a)) + " ", " " + " ".join(words(rnd, b))) for a, b in ((0, 3), (1, 0), (5, 9), (40, 40))] for _ in passages]
    left, lost = shares_left(spark, passages, hosts)
    assert max(left) < 0.5 and sum(left) / len(left) < 0.25 and not lost


def test_passages_of_short_clauses_are_removed_behind_any_text(spark):
    rnd = random.Random(13)
    passages, hosts = [], []
    for n in (1, 2, 3, 3, 3):
        w = words(rnd, 60)
        passages.append(" ".join(x + "," * (i % n == n - 1) for i, x in enumerate(w)))
        intro = [" ".join(words(rnd, k)) + ", " for k in (1, 2, 3, 5, 9)]
        hosts.append([(a, "") for a in intro] + [("Intro one here, ", " " + " ".join(words(rnd, 6)) + ".")])
    left, lost = shares_left(spark, passages, hosts)
    assert max(left) < 0.5 and sum(left) / len(left) < 0.25 and not lost


# ---- n-gram Jaccard ----


def brute_components(rows: list[tuple], n: int, num: int, den: int) -> Counter:
    sets = []
    for _, t in rows:
        w = (t or "").translate(UPPER).encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((d, len(s), min((x for x in least[find(i)] if x is not None), default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("n,num,den,seed", [(3, 90, 100, 1), (5, 80, 100, 2), (3, 90, 100, 3), (2, 60, 100, 4), (1, 95, 100, 5)])
def test_jaccard_components_equal_brute_force(spark, n, num, den, seed):
    rnd = random.Random(seed)
    rows = EDGE + noisy(seed, 48)
    base = prose(rnd, 120).split(" ")
    for i in range(60):  # near copies at all distances, chains among them
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = rnd.choice(["changed", "other", f"own{i}"])
        rows.append((1000 + i, " ".join(w)))
    got = ngram_jaccard.jaccard_components(awkward(spark, rows), n, num, den).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, n, num, den)


def test_jaccard_of_an_empty_table(spark):
    assert ngram_jaccard.jaccard_components(awkward(spark, [])).count() == 0


def test_schemes_cover_all_similar_sizes():
    """Sets of similar sizes share a scheme whose parts outnumber the tokens that differ."""
    for num, den in ((90, 100), (80, 100), (60, 100)):
        s = ngram_jaccard.Scheme(num, den)
        for y in range(1, 400):
            for x in range(-(-y * num // den), y + 1):
                most = (x + y) * (den - num) // (den + num)
                if most and (x, y) != (y, x) or most:
                    both = dict(s.of(x)).keys() & dict(s.of(y)).keys()
                    assert both and max(dict(s.of(x))[k] for k in both) >= most


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (60, 100)])
def test_similar_sets_share_a_part(num, den):
    """Whatever is exchanged between two similar sets, they meet in a list."""
    rnd, scheme = np.random.default_rng(num), ngram_jaccard.Scheme(num, den)
    for size in [*range(2, 60), 100, 333, 800] * 3:
        x = np.unique(rnd.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
        if size % 3 == 0:  # unevenly spread tokens leave many parts empty
            x = np.unique(x >> np.uint64(rnd.integers(1, 6)))
        drop = rnd.integers(0, len(x))
        y = np.union1d(x[rnd.permutation(len(x))[drop // 4 :]], rnd.integers(0, 2**63, drop // 8, dtype=np.uint64))
        both = len(np.intersect1d(x, y))
        if den * both >= num * (len(x) + len(y) - both) and len(x) != both:
            assert set(np.concatenate(scheme.keys(x)).tolist()) & set(np.concatenate(scheme.keys(y)).tolist())


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(7, 7), (300, 300)] + [(500, 500 + i) for i in range(1, 60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()
    assert {r["id"]: r["root"] for r in got} == {x: find(x) for x in root}
    assert len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
