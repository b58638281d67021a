"""The pipeline: stage by stage on what the stage before kept, then as a whole; and life without this subpackage."""

import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from tarnwright.llm import pii
from tarnwright.llm.common import materialise

from ..conftest import ROOT
from .conftest import DATA


def test_stages(spark, documents, odd_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "bpe"]
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, DATA), name)
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "language_id":
            assert docs.where("text rlike '\\\\p{L}'").count() == out.count()
        if name == "near_dedup":
            assert 0 < out.count() < docs.count() and out.select("doc_id").distinct().count() == out.count()
        if name == "pii":
            assert out.count() == docs.count()
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            for r in out.collect():
                assert not pii.base_spans(r["text"])
                if not pii.all_spans([before[r["doc_id"]]], pii.model())[0][1]:
                    assert r["text"] == before[r["doc_id"]]
                assert r["n_chars"] == len(r["text"]) or r["text"] == before[r["doc_id"]]
        kept.append(out.count())
        docs = out
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.count() == kept[-1]
    assert whole.select(F.sum("n_tokens")).first()[0] == docs.select(F.sum("n_tokens")).first()[0]


def test_run_equals_plain_code(spark, documents, texts):
    """Every stage by other means on what the one before kept: labels text by text, brute-force components, redaction,
    plain gradients, the tokenizers library."""
    import hashlib
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    from tarnwright.llm import lang_id, mixing
    from tarnwright.llm.queries import tokenizer_path

    from .test_mixing import reference
    from .test_near_dedup import brute

    net = lang_id.learned(documents)
    rows = [(d, t) for d, t in texts if lang_id.predict(net, [t.encode()])[0] != ["und"]]
    component = brute(rows)
    rows = [(d, t) for d, t in rows if component[d][1] == d]
    trees = pii.model()
    rows = [(d, pii.redact(t, pii.all_spans([t], trees)[0][1])) for d, t in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", mixing.quality_domain().alias("domain"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    members = mixing.posteriors(frame, labels, list(mixing.TARGETS)).withColumn("chance", chance).toPandas()
    rate = reference(members.n_words.to_numpy(), members[["p0", "p1", "p2", "p3"]].to_numpy(), list(mixing.TARGETS.values()), 1.0)
    times = dict(zip(members.doc_id.tolist(), np.floor(rate + members.chance.to_numpy()).astype(int).tolist(), strict=True))
    library, true = Tokenizer.from_file(tokenizer_path()), Counter()
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        true[d, tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += times[d]
    got = Counter((r["doc_id"], tuple(r["token_ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == +true


def test_odd_documents_pass_every_stage(spark, odd_docs, no_docs):
    kept = {"language_id": ["1", "1", "4", "None"], "near_dedup": ["1", "4", "None"], "pii": ["1", "4", "None"]}
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), name)
        if name in kept:
            assert docs.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in docs.collect()) == kept[name]
    rows = docs.collect()
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 4} <= {60_000} and sum(r["doc_id"] is None for r in rows) == 1
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), name)
        assert docs.count() == 0


def test_the_rest_does_without(tmp_path):
    code = "import re, sys; root = sys.argv[1]; sys.path.insert(0, root); import __spark_entry__ as e; q = e.queries(); assert q and not any(re.match(r'op\\d|pipeline', n) for n in q), q; e.oracle_sql()"
    import shutil

    shutil.copytree(ROOT / "tarnwright", tmp_path / "tarnwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
