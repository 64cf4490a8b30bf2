import random
import re
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from odd_texts import ODD

from loam.llm import line_dedup, near_dedup, quality


@pytest.fixture
def folder(spark, docs, tmp_path):
    """Documents of every fate, and a benchmark."""
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8))) for _ in range(n))
    item = prose(30)
    texts = {
        "clean": [prose(60) for _ in range(10)],
        "footed": [f"{prose(50)}\nall rights reserved by us\n{prose(20)}" for _ in range(8)],
        "copies": [prose(70)] * 5,
        "near": [],
        "leak": [f"{prose(20)} {item} {prose(20)}" for _ in range(3)],
        "junk": ["WE SHOUT ALL OF THIS LOUDLY " * 4, "go " * 50, "%%% ### $$$ *** ^^^ && ||", "", None],
        "long": [prose(5000)],
    }
    base = prose(80).split()
    for k in range(4):
        texts["near"].append(" ".join([*base[: 10 * k], "changed", *base[10 * k + 1 :]]))
    kind = [k for k, v in texts.items() for _ in v]
    rows = [t for v in texts.values() for t in v]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, kind


def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        out.append(docs)
    return out


def test_stages_in_order(spark, folder):
    path, rows, kind = folder
    ruled, lined, near, clean, packed = stages(spark, path)
    columns = spark.read.parquet(f"{path}/documents.parquet").columns
    assert all(x.columns == columns for x in (ruled, lined, near, clean))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    junk = {i for i, k in enumerate(kind) if k == "junk"}
    assert ids(ruled) == set(range(len(rows))) - junk
    for r in lined.collect():
        want = rows[r.doc_id].replace("all rights reserved by us\n", "") if kind[r.doc_id] == "footed" and r.doc_id != kind.index("footed") else rows[r.doc_id]
        assert r.text == want and r.n_chars == len(want)
    per = Counter(kind[i] for i in ids(near))
    assert per == {"clean": 10, "footed": 8, "copies": 1, "near": 1, "leak": 3, "long": 1}
    assert {i for i in ids(near) if kind[i] in ("copies", "near")} == {kind.index("copies"), kind.index("near")}
    assert ids(clean) == {i for i in ids(near) if kind[i] != "leak"}
    words = Counter()
    for r in packed.collect():
        words[r.doc_id] += r.n_tokens
    assert words == {r.doc_id: len(r.text.split()) for r in clean.collect()}


def test_run_is_the_stages(spark, folder):
    path, *_ = folder
    assert sorted(map(tuple, pipeline.run(spark, path).collect())) == sorted(map(tuple, stages(spark, path)[-1].collect()))


def test_odd_rows_pass_through(spark, docs, tmp_path):
    rows = [*ODD, (None, "some plain words of a text"), (3, "other plain words of a text"), (3, "other plain words of a text")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 3


def test_no_documents(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_names_and_operators():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "decontamination", "packing"]
    source = open(pipeline.__file__).read()
    assert not re.search(r"except|localCheckpoint", source) and quality and line_dedup and near_dedup
