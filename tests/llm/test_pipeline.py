from __future__ import annotations

import pytest

import corpus_pipeline
from mathloom.llm import decontaminate, jaccard, langid, mixing, queries, sharding
from tests.llm.fixtures import documents, odd, widened


def test_stages_follow_each_other(spark, sf, tmp_path):
    docs = documents(spark, odd(spark, sf))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = langid.keep_known(docs)
    kept = jaccard.one_of_each(kept)
    kept = decontaminate.clean(kept, spark.read.parquet(f"{sf}/benchmark.parquet"))
    want = sharding.sharded(mixing.mixed(kept), keep=("lang", "source"))
    plain = lambda df: sorted(map(str, df.drop("slot").collect()))
    assert plain(out) == plain(want) and out.count() > 50


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, sf, k):
    docs = widened(documents(spark, odd(spark, sf)[150:]))
    assert corpus_pipeline.STAGES[k][1](spark, docs, sf).columns == docs.columns


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))
