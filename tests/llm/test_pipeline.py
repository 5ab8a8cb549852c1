"""The pipeline's stages in a row, each held against what its operator decides."""

import random
import re

import pytest

import corpus_pipeline
from vacantia.llm import common, decontaminate, jaccard, mixing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "ba ko mi".split() for b in "ra lu te ni".split() for c in "n s t".split()]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(30)) for i in range(3)]
    good = [say(80) for _ in range(90)]
    good[10], good[11] = good[5], good[5] + " more"
    good[20] = say(40) + " " + items[1][1] + " " + say(40)
    bad = [" | ".join(w.upper() for w in say(40).split()) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + bad)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(150) if i % 2 or i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, folder), name)
        seen.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "source_mix", "token_output"]
    assert all(d.columns == columns for d in seen[:-1])
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    assert set(ids[0]) == set(range(90))  # the classifier rejects the shouted ones
    assert set(ids[1]) == set(range(90)) - {10, 11}  # copies and near copies of 5
    assert set(ids[2]) == set(ids[1]) - {20}  # a benchmark passage
    sizes = {r.doc_id: len(r.text.split()) for r in seen[2].collect()}
    plan = {r.doc_id: r["__mix_taken"] for r in mixing.mix(seen[2]).collect()}
    got = dict.fromkeys(plan, 0)
    for r in seen[3].collect():
        got[r.doc_id] += len(re.findall(r"\S+", r.text))
    assert got == plan and all(got[i] <= 3 * sizes[i] for i in got)
    assert sorted(ids[4]) == sorted(ids[3])
    assert corpus_pipeline.run(spark, folder).count() == len(ids[4])
    assert jaccard.NEAR_WORDS == 5 and jaccard.NEAR_PERCENT == 80 and decontaminate.WINDOW == 13
