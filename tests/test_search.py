"""Search over stored postings: the rows of scoring everything, from few blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwright.operators import retrieval, search
from tarnwright.sources import versions


@pytest.fixture(scope="module")
def corpus(spark):
    """3000 texts: common words anywhere, rare ones in few, of very different lengths."""
    rng = random.Random(21)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(400)]
    rows = []
    for i in range(3000):
        words = rng.choices(common, k=rng.choice((3, 10, 40, 160)))
        words += [rng.choice(rare)] * rng.choice((0, 0, 1, 1, 2, 9))
        rows.append((i, words))
    rows += [(3000, []), (3001, None)]
    return spark.createDataFrame(rows, "doc long, toks array<string>").cache()


@pytest.fixture(scope="module")
def questions(spark):
    asked = {"one": ["r7"], "rare": ["r1", "r2", "r3"], "mixed": ["c1", "r5"], "common": ["c0", "c1"], "none": ["absent"], "few": ["r399", "absent"]}
    return spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query string, term string")


def expected(corpus, questions, k):
    docs = corpus.withColumn("toks", F.coalesce("toks", F.array().cast("array<string>")))
    rows = retrieval.top(retrieval.bm25(docs, questions, "doc", "toks"), "doc", k).select("query", "doc", "score", "rank")
    return sorted(map(tuple, rows.collect()))


def test_segments_give_the_rows_of_scoring_everything(spark, corpus, questions, tmp_path):
    root = f"file://{tmp_path}/i"
    with pytest.raises(FileNotFoundError):
        search.opened(spark, root)
    for part in range(3):
        assert search.append(corpus.where(f"doc % 3 = {part}"), root, "doc", "toks") == part + 1
    for k in (1, 5, 5000):
        assert sorted(map(tuple, search.search(spark, root, questions, k).collect())) == expected(corpus, questions, k)


def test_an_appended_segment_changes_all_figures(spark, corpus, questions, tmp_path):
    root = f"file://{tmp_path}/i"
    search.append(corpus.where("doc < 1000"), root, "doc", "toks")
    assert sorted(map(tuple, search.search(spark, root, questions, 5).collect())) == expected(corpus.where("doc < 1000"), questions, 5)
    search.append(corpus.where("doc >= 1000"), root, "doc", "toks")
    assert sorted(map(tuple, search.search(spark, root, questions, 5).collect())) == expected(corpus, questions, 5)


def test_blocks_that_cannot_matter_are_not_scored(spark, corpus, questions, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "FIRST", 2)
    root = f"file://{tmp_path}/i"
    search.append(corpus, root, "doc", "toks")
    index, docs, mean = search.opened(spark, root)
    asked = questions.where("query = 'mixed'")
    weights, ranges = search.bounds(index, asked, docs, mean)
    _, rest = search.plan(index, weights, ranges, mean, 3, 6)
    assert ranges.count() >= 20 and rest.count() + 2 <= ranges.count() // 2
    assert sorted(map(tuple, search.search(spark, root, asked, 3).collect())) == expected(corpus, asked, 3)
    every = search.scored(index, weights, ranges, mean).groupBy("query").agg(F.max("score")).first()[1]
    assert ranges.agg(F.max("most")).first()[0] >= every


def test_a_search_reads_postings_of_its_terms_and_no_texts(spark, corpus, questions, tmp_path):
    root = f"file://{tmp_path}/i"
    search.append(corpus, root, "doc", "toks")
    index, docs, mean = search.opened(spark, root)
    weights, ranges = search.bounds(index, questions, docs, mean)
    plan = search.scored(index, weights, ranges, mean)._jdf.queryExecution().toString()
    assert "In(term" in plan and "regexp" not in plan and "split" not in plan
    plan = index.select("term", "n").where(F.col("term").isin("r1", "r2"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<term:string,n:int>" in plan


def test_a_writer_that_stops_leaves_no_segment(spark, corpus, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/i"
    search.append(corpus.where("doc < 10"), root, "doc", "toks")

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "claim", stop)
    with pytest.raises(KeyboardInterrupt):
        search.append(corpus.where("doc >= 10"), root, "doc", "toks")
    assert search.opened(spark, root)[1] == 10
