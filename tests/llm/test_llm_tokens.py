"""BPE codec, prefix token counts and packing, against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_rows import EDGE, awkward, prose
from tillroll.llm import bpe_codec, packing, token_counts
from tillroll.llm.bpe import ByteBPE, Codec, slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text: str | None) -> list[int]:
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def odd_texts() -> list[str]:
    rnd = random.Random(3)
    letters = "ab  \n\t'relvst.1 ÉéßñЖ日本語🙂¼²_"
    fixed = ["", " ", "   a", "I'll we're don't 'S x're 'r", "a<|endoftext|>  <|endoftext|><|endof", "!!<|endoftext|> x", "aaaa" * 500, "ab" * 900, "日本" * 400, " \n\n x  \n y  "]
    return fixed + ["".join(rnd.choices(letters, k=rnd.randint(1, 70))) for _ in range(300)] + [prose(rnd, 300) for _ in range(5)]


def test_codec_equals_library():
    codec = Codec(PATH, remember=50)  # forgets again and again
    texts = odd_texts()
    for a, b in slices(texts, most=2000):
        ids, counts = codec.encode(texts[a:b])
        at = 0
        for text, n in zip(texts[a:b], counts, strict=True):
            assert ids[at : at + n].tolist() == ids_of(text), text
            at += n
        assert codec.decode(ids, counts) == texts[a:b]
    assert codec.decode(np.array([255, 100]), np.array([1, 1])) == [TOKENIZER.decode([255], skip_special_tokens=False), TOKENIZER.decode([100], skip_special_tokens=False)]


def test_latin_words_equal_the_general_pattern():
    bpe, rnd = ByteBPE(PATH), random.Random(5)
    chars = [chr(c) for c in range(0x250)]
    for _ in range(3000):
        text = "".join(rnd.choices(chars, k=rnd.randint(0, 30)) + rnd.choices("'  \n\tstrevlmd1²!", k=rnd.randint(0, 20)))
        assert bpe._other.search(text) is None
        assert bpe._split_latin.findall(text) == bpe._split_any.findall(text)
    assert bpe._other.search("a\u0250") and bpe._other.search("日")


def test_codec_on_spark(spark):
    got = bpe_codec.encode_decode(awkward(spark, EDGE), PATH).collect()
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=str) == sorted(((i, ids_of(t), t or "") for i, t in EDGE), key=str)
    digests = {r["doc_id"]: r for r in bpe_codec.digests(bpe_codec.encode_decode(awkward(spark, EDGE[:2] + EDGE[4:5]), PATH)).collect()}
    assert digests[1]["n_tokens"] == digests[2]["n_tokens"] == 0
    assert digests[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert digests[3]["ids_sha256"] == hashlib.sha256(str(ids_of("A")[0]).encode()).hexdigest()
    assert bpe_codec.encode_decode(awkward(spark, []), PATH).count() == 0


def test_prefix_counts_equal_library_at_every_prefix():
    counter = token_counts.PrefixCounter(PATH, remember=200)
    texts = [t for t in odd_texts() if len(t) < 400]
    for a, b in slices(texts, most=3000):
        counts, chars = counter.counts(texts[a:b])
        ends = np.cumsum(chars)
        for text, own in zip(texts[a:b], np.split(counts, ends[:-1]), strict=True):
            assert own.tolist() == [len(ids_of(text[: i + 1])) for i in range(len(text))], text


@pytest.mark.parametrize("runs", [1024, 300])
def test_prefix_counts_of_long_words(monkeypatch, runs):
    """Unbroken words of many runs: those that fall into step, and those that never do."""
    monkeypatch.setattr(token_counts, "RUN", runs)
    rnd = random.Random(12)
    words = [
        "".join(rnd.choice("abcdefgh") for _ in range(30_000)), "-" * 20_001, "ab" * 9000, "a" * 15_000,
        "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(8000)), "start " + "=" * 9001 + " end" + "xyz" * 5000,
    ]
    counter = token_counts.PrefixCounter(PATH)
    counts, chars = counter.counts(words)
    assert chars.tolist() == [len(w) for w in words]
    for word, own in zip(words, np.split(counts, np.cumsum(chars)[:-1]), strict=True):
        for n in [len(word), *rnd.sample(range(1, len(word)), 25)]:
            assert own[n - 1] == len(ids_of(word[:n]))


def test_token_counts_on_spark(spark):
    got = token_counts.token_counts(awkward(spark, EDGE), PATH, limit=5).collect()
    want = sorted(((i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 5) for i, t in EDGE), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got), key=str) == want
    for r in got:
        counts = np.frombuffer(r["prefix_counts"], "<i4")
        text = next(t or "" for i, t in EDGE if i == r["doc_id"])
        assert len(counts) == len(text)
        assert r["chars_within"] == token_counts.longest_within(counts, 5)
    assert token_counts.token_counts(awkward(spark, []), PATH).count() == 0


def check_packed(rows: list, docs: list[tuple], window: int) -> float:
    """All that a packing must hold; returns the share of padding."""
    wanted = defaultdict(int)
    for i, t in docs:
        wanted[(i, tuple([*ids_of(t), 0]))] += 1
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[(r["doc_id"], r["doc_tokens"])].append((r["start"], ids))
    padding = used = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
        used += at
        padding += 0 if at & (at - 1) == 0 else window - at
    for (i, n), pieces in by_doc.items():
        whole = {k: c for k, c in wanted.items() if k[0] == i and len(k[1]) == n}
        assert sum(len(ids) for _, ids in pieces) == n * sum(whole.values())
        for start, ids in pieces:
            assert any(list(k[1][start : start + len(ids)]) == ids for k in whole)
    assert set(by_doc) == {(i, len(ids)) for i, ids in wanted}
    return padding / max(1, padding + used)


@pytest.mark.parametrize("window", [16, 1024])
def test_packing_on_spark(spark, window):
    rnd = random.Random(9)
    docs = EDGE + [(100 + i, prose(rnd, rnd.randint(1, 400))) for i in range(150)]
    rows = packing.pack(awkward(spark, docs).repartition(3), PATH, window=window).collect()
    assert check_packed(rows, docs, window) < 0.001
    sums = {(r["doc_id"], r["start"], r["sequence_id"]): r["ids_crc32"] for r in packing.digests(packing.pack(awkward(spark, docs).coalesce(1), PATH, window=window)).collect()}
    plain = packing.pack(awkward(spark, docs).coalesce(1), PATH, window=window).collect()
    assert sums == {(r["doc_id"], r["start"], r["sequence_id"]): zlib.crc32(r["ids"]) for r in plain}
    assert packing.pack(awkward(spark, []), PATH).count() == 0


def test_sum_of_squares_rule():
    """Each piece goes where the sum of squared counts of partly filled windows is least."""
    rnd = random.Random(2)
    packer = packing.Packer(window=12)
    levels = [0] * 13
    for i in range(400):
        size = rnd.choice([2, 3, 4, 5, 7])
        options = []
        for h in range(0, 13 - size):
            if h == 0 or levels[h]:
                after = list(levels)
                if h:
                    after[h] -= 1
                if h + size < 12:
                    after[h + size] += 1
                options.append((sum(x * x for x in after), -h, after))
        packer.add(i, np.zeros(size, np.int32))
        levels = min(options)[2]
        assert packer.levels.tolist()[1:12] == levels[1:12]


def test_few_open_windows_are_kept():
    packer = packing.Packer(window=10, most_open=5)
    for i in range(200):
        packer.add(i, np.full(6, i, np.int32))
        assert packer.n_open <= 5
    packer.finish()
    sequences = packer.take()
    assert sum(len(p[2]) for _, pieces in sequences for p in pieces) == 1200
    assert sum(sum(len(p[2]) for p in pieces) != 10 for _, pieces in sequences) <= 3
