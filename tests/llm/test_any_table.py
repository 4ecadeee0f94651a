"""Every operator and stage on tables with clashing names, repeated rows, nulls and nothing at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedweave.llm import (
    collocations,
    decontamination,
    minhash_dedup,
    mixing,
    periodic_runs,
    quality,
    sharding,
    simhash_dedup,
    substring_dedup,
    suffix_dedup,
    token_counts,
)

# Names that operators use inside or give to their results, some in another case.
CLASHING = ["key", "Size", "col", "component", "text_key", "_key", "doc", "_doc", "_text", "Shard", "spans", "_c0", "band", "_part", "place"]
DOCS = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in CLASHING)
PAIRS = "item_id bigint, text string"


def documents(spark, empty=False):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "en", "a"), (2, words + " end", "en", "a"), (3, "short one", "de", "b"), (4, None, None, None), (5, "", "en", "b")]
    rows += [(None, words.upper(), "en", "a"), rows[0], rows[0], (6, "x " * 90, "fr", None), (7, " ".join(f"v{i}" for i in range(70)), "en", "b")]
    return spark.createDataFrame([] if empty else [(*r, *CLASHING) for r in rows], DOCS)


def labels(spark, docs):
    found = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    return found.withColumn("toxic", F.lit(0))


def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(20, 50))), (2, None), (3, "")], PAIRS)


OPERATORS = {
    "suffix_dedup": lambda spark, docs: suffix_dedup.remove_repeats(docs),
    "substring_dedup": lambda spark, docs: substring_dedup.remove_repeated_words(docs),
    "quality": lambda spark, docs: quality.score_quality(docs, labels(spark, docs)),
    "sharding": lambda spark, docs: sharding.shard_by_bytes(docs),
    "token_counts": lambda spark, docs: token_counts.count_tokens(docs),
    "decontamination": lambda spark, docs: decontamination.mark_contaminated(docs, benchmark(spark)),
    "minhash_dedup": lambda spark, docs: minhash_dedup.mark_near_duplicates(docs),
    "mixing": lambda spark, docs: mixing.mix(docs),
    "simhash_dedup": lambda spark, docs: simhash_dedup.mark_simhash_duplicates(docs),
    "periodic_runs": lambda spark, docs: periodic_runs.collapse_runs(docs),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_hand_on_columns_of_any_name(spark, name):
    docs = documents(spark)
    found = OPERATORS[name](spark, docs)
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    rows = found.collect()
    assert len(rows) == docs.count()
    results = {c.lower() for c in found.columns} - {c.lower() for c in docs.columns}
    assert results, "there are results"
    for c in CLASHING:
        if c in found.columns and found.schema[c].dataType == docs.schema[c].dataType:
            assert {r[c] for r in rows} == {c}, "the user's columns come through as they were"
    assert OPERATORS[name](spark, documents(spark, empty=True)).collect() == []


def test_collocations_do_not_mind_other_columns(spark):
    assert {r.lang for r in collocations.collocations(documents(spark), least=2).collect()} == {"en", "fr"}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_the_columns_of_any_table(spark, number, tmp_path):
    docs = documents(spark)
    labels(spark, docs).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[number]
    for table in (docs, documents(spark, empty=True)):
        out = stage(spark, table, str(tmp_path))
        rows = out.collect()
        if name != "sharding":
            assert out.columns == docs.columns
            assert all(r[c] == c for r in rows for c in CLASHING)
        if not table.isEmpty() and name != "quality":
            assert rows
        else:
            assert table is docs or not rows
    if name == "near_duplicates":
        kept = sorted(((r.doc_id, (r.text or "")[:3]) for r in stage(spark, docs, str(tmp_path)).collect()), key=repr)
        assert kept == [(1, "w0 "), (3, "sho"), (4, ""), (5, ""), (6, "x x"), (7, "v0 ")]
    if name == "decontamination":
        assert 7 not in {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()}
