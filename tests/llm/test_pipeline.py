"""The pipeline: each stage against brute force on a small fixture."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.llm import line_dedup

from .test_groups import lines_by_hand

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(31)
    words = {"en": "the of and ing ther".split(), "de": "der und sch keit über".split()}
    text = lambda k, n: " ".join("".join(random.choices(words[k], k=2)) for _ in range(n))
    item = text("en", 30)
    rows = []
    for i in range(60):
        k = random.choice(["en", "de"])
        rows.append((i, f"Menu Home\n{text(k, 60)}\n{text(k, 40)}", k, f"s{i % 2}"))
    rows += [(100 + i, f"Menu Home\n{rows[i][1][10:]} extra", rows[i][2], "s0") for i in range(5)]
    rows += [(200, f"{item} {text('en', 20)}", "en", "s1"), (201, None, "en", "s1"), (202, "12 !!", "en", "s1"), (203, "", None, None)]
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item), (1, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def test_stages(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, at)
        if name != names[-1]:
            assert out.columns == docs.columns
        docs = out.cache()
        seen[name] = (before, {r["doc_id"]: r for r in docs.collect()})
    before, after = seen["language"]
    assert set(before) - set(after) == {201, 202, 203}
    before, after = seen["lines"]
    assert set(before) == set(after)
    want = lines_by_hand([(i, r["text"], r["source"]) for i, r in before.items()], line_dedup.RATIO)
    assert {i: r["text"] for i, r in after.items()} == want and not any("Menu Home" in t for t in want.values())
    assert sum(t == before[i]["text"].replace("Menu Home\n", "") for i, t in want.items()) >= 50  # others share a line with a copy of the same host
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    before, after = seen["near_copies"]
    assert set(after) >= set(range(60)) | {200} and 0 < len(set(before) - set(after)) <= 5
    before, after = seen["benchmark"]
    assert set(before) - set(after) == {200}
    before, after = seen["pieces"]
    assert set(before) == set(after) and all(r["n_tokens"] == len(r["ids"]) > 2 for r in after.values())
    whole = corpus_pipeline.run(spark, at)
    assert {tuple(map(str, r)) for r in whole.collect()} == {tuple(map(str, r)) for r in after.values()}
