"""The corpus pipeline over a small table with planted cases."""

from __future__ import annotations

import glob
import os
import random
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from llm_rows import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(12)
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage = prose(rnd, 70)
    insults = ["nastyword", "vileness", "gruffling", "scornful"]
    docs: dict[int, str] = {}
    toxic: set[int] = set()
    for i in range(400):
        w = prose(rnd, rnd.randint(60, 160)).split(" ")
        if i % 5 == 0:
            toxic.add(i)
            for x in rnd.sample(insults, 3):
                w.insert(rnd.randrange(len(w)), x)
        docs[i] = " ".join(w)
    for i in range(400, 410):  # exact copies but for case
        docs[i] = docs[401 - 400 + 5 * (i - 400)].upper()
    for i in range(410, 420):  # near copies
        w = docs[2 + 5 * (i - 410)].split(" ")
        docs[i] = " ".join([*w[:-2], "tail"])
    for i in range(420, 430):  # a passage in otherwise different documents
        docs[i] = prose(rnd, 60) + " " + passage + " " + prose(rnd, 60)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs.items()] + [(430, "", "en", None, 0), (431, None, None, None, None)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400) if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, toxic, passage


def test_stages_are_those_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "substring dedup", "packing"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_planted_cases(spark, tables, tmp_path):
    folder, docs, toxic, passage = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, folder)
        if name != "packing":
            assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in spark.read.parquet(f"{folder}/documents.parquet").schema]
            frame.write.parquet(f"{tmp_path}/{i}")
            frame = spark.read.parquet(f"{tmp_path}/{i}")
            kept.append({r["doc_id"]: r for r in frame.collect()})
    clean = set(range(432)) - toxic
    assert set(kept[0]) == clean
    # of a case copy the larger id stays; of the empty and the null text too
    copies = {1 + 5 * k: 400 + k for k in range(10)}
    assert set(kept[1]) == clean - set(copies) - {430}
    # of near copies the smaller one
    near = set(range(410, 420))
    assert set(kept[2]) == set(kept[1]) - near
    # the passage stays in one document only
    assert set(kept[3]) == set(kept[2])
    inner = passage[len(passage) // 3 : len(passage) // 3 + 40]
    assert [i for i, r in kept[3].items() if inner in (r["text"] or "")] == [420]
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3].values() if r["text"] is not None)
    untouched = [i for i in kept[3] if not 420 <= i < 430]
    assert all(kept[3][i]["text"] == kept[2][i]["text"] for i in untouched)
    tokens = defaultdict(int)
    for r in frame.collect():
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == set(kept[3])


def test_run_applies_all_stages(spark, tables):
    folder, docs, toxic, _ = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    got = {r["doc_id"] for r in rows}
    assert got == (set(range(432)) - toxic - {1 + 5 * k for k in range(10)} - {430} - set(range(410, 420)))
    whole = {(r["doc_id"], r["doc_tokens"]) for r in rows}
    assert len(whole) == len(got)


def test_null_and_shared_ids(spark, tables, tmp_path):
    """Each stage decides by row: what shares an id, or has none, doesn't go with one another."""
    folder, _, _, _ = tables
    rnd = random.Random(31)
    a, b, c = (prose(rnd, 90) for _ in range(3))
    near = " ".join([*a.split(" ")[:-1], "tail"])
    passage = prose(rnd, 70)
    rows = [(1000, a), (1001, near), (1001, b), (None, near + " more"), (None, c), (None, c.upper()), (1002, prose(rnd, 40) + " " + passage), (None, prose(rnd, 40) + " " + passage)]
    frame = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], COLUMNS)
    want = [8, 7, 5, 5]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, frame, folder).write.parquet(f"{tmp_path}/{n}")
        frame = spark.read.parquet(f"{tmp_path}/{n}")
        assert frame.count() == want[n], name
    got = {(r["doc_id"], r["text"]) for r in frame.collect()}
    assert (1000, a) in got and (1001, b) in got and {t.lower() for i, t in got if i is None} >= {c.lower()}
    assert [i for i, t in got if passage[60:120] in t] == [1002]


def test_intermediate_folders_go(spark, tables):
    folder = tables[0]
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    corpus_pipeline.run(spark, folder).count()
    assert all(os.listdir(p) == ["3"] for p in glob.glob(f"{root}/corpus-*"))
