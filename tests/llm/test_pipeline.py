from collections import Counter

import corpus_pipeline as P
import pytest
from cuewright.llm import mixing, near_dup
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    out = [docs.collect()]
    for name, stage in P.STAGES:
        df = P.common.stored(stage(spark, docs, SF), name)
        out.append(df.collect())
        if name != "packed":
            assert df.columns == docs.columns
        docs = df
    return out


def test_stages(spark, stages):
    documents, good, single, mixed, packed = stages
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    kept = Counter(r["doc_id"] for r in good)
    assert set(good) <= set(documents)
    wrong = [i for i, q in labels.items() if i < 120 and q != (i in kept)]
    assert len(wrong) <= 2
    # one row of each group of the input, the least id's
    found = near_dup.near_duplicates(spark.createDataFrame(good)).collect()
    assert {r["doc_id"] for r in single} == {r["component_id"] for r in found}
    assert Counter(r["doc_id"] for r in single if r["doc_id"] is not None).most_common(1)[0][1] == 1
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in single}
    times = Counter(r["doc_id"] for r in mixed)
    assert set(mixed) <= set(single) and max(times.values()) <= 2
    target = {r["source"]: r["target"] for r in mixing.mix(spark.createDataFrame(single))[1].collect()}
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += size[r["doc_id"]]
    assert abs(sum(taken.values()) - sum(target.values())) < 0.25 * sum(target.values())
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == times


def test_stages_with_odd_rows(spark):
    """Null texts, sources and ids, repeated rows, a very long text, and columns that clash with names inside."""
    good = "The plain words of a text go on and on.\nAnother line of it says a little more."
    rows = [(i, f"{good}\nNumber {i} {i * 7} {i * 13} stands here alone today.", "en", "a" if i % 3 else None, 90, i, "x", i) for i in range(12)]
    rows += [rows[3], rows[3], (50, None, None, None, None, None, None, None), (51, "", "en", "a", 0, 1, "y", 1), (None, good, "en", "b", 9, 2, "z", 2), (52, good + " and so on" * 30_000, "en", "b", 9, 3, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, t string, row bigint")
    df = docs
    for name, stage in P.STAGES:
        df = P.common.stored(stage(spark, df, SF), name)
        found = df.collect()
        if name != "packed":
            assert df.columns == docs.columns and set(found) <= set(rows if name == "quality" else before)
        before = found
    assert {r["doc_id"] for r in found} and max(r["length"] for r in found) == 2048
    places = Counter()
    for r in found:
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 2048


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = P.common.stored(stage(spark, docs, SF), name)
        assert docs.count() == 0
