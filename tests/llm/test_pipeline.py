"""The stages one after another over the smallest tables, each against a plain version."""

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from gaugeworks.llm import quality, queries
from gaugeworks.session import settle

TABLES = entry_point.SMOKE_DIR


def test_stages(spark, table):
    table([])
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    before = docs.collect()
    columns = docs.columns
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, TABLES), name)
        outputs.append(docs.collect())
        if name != "packing":
            assert docs.columns == columns
    good, single, cut, mixed, packed = outputs

    model = quality.fit(spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet"))
    scores = model.scores([r.text or "" for r in before])
    assert brute.by_id(good) == brute.by_id([r for r, s in zip(before, scores) if s >= quality.THRESHOLD])
    found = brute.components([tuple(r) for r in good], width=5, percent=80)
    kept = {i for i, n, c in found if i == c or n == 0}
    assert sorted(r.doc_id for r in single) == sorted(kept)
    repeats = {i: (gone, text) for i, _, gone, text in brute.without_repeats([(r.doc_id, r.text) for r in single])}
    originals = {r.doc_id: r.text for r in single}
    assert {r.doc_id: r.text for r in cut} == {
        i: text if gone else originals[i] for i, (gone, text) in repeats.items()
    }
    assert all(r.n_chars == len(r.text or "") for r in cut if repeats[r.doc_id][0])
    sizes = {}
    for r in cut:
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    wanted = brute.targets(sizes)
    for source, target in wanted.items():
        taken = [len(brute.words(r.text)) for r in mixed if r.source == source]
        longest = max((len(brute.words(r.text)) for r in cut if r.source == source), default=0)
        assert abs(sum(taken) - target) <= longest / 2 + 1
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def test_registered():
    names = entry_point.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert set(queries.QUERIES) < set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_run(spark, name):
    got = queries.QUERIES[name](spark, TABLES)
    assert got.count() > 0


EXTRA = "times mixed_id each_time kept_id n_words kept n_removed component_id n_shingles label score".split()


@pytest.fixture(scope="module")
def awkward(spark, table, corpus, tmp_path_factory):
    """Null, empty, long and repeated rows under extra columns named like the stages' own, and labels."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    marks = [(i, k % 2, 0) for k, (i, *_) in enumerate(corpus)] + [(None, 1, 0), (5, None, 0)]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return table(corpus).withColumns({name: F.lit(7) for name in EXTRA}), folder


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, corpus, awkward, name, stage):
    docs, folder = awkward
    got = stage(spark, docs, folder).collect()
    known = {(r[0], r[1]) for r in corpus}
    if name != "packing":
        assert stage(spark, docs, folder).columns == docs.columns
        assert all(r["times"] == 7 and r["row"] == -1 for r in got)
    if name in ("quality", "near_duplicates"):
        assert {(r.doc_id, r.text) for r in got} <= known
    if name == "near_duplicates":
        assert {r.doc_id for r in got if r.text is None or not r.text.split()} >= {2, 3, 4}
    if name == "repeats":
        assert len(got) == len(corpus)
        assert [r.text for r in got if r.doc_id == 2] == [""]  # a null text
    if name == "mixing":
        assert {(r.doc_id, r.text) for r in got} <= known
        assert not any(r.text is None or not r.text.split() for r in got)
    if name == "packing":
        pieces = sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.start == 0)
        assert pieces == sorted((i is None, i or 0) for i, *_ in corpus)
    assert got or name == "quality"  # the labels here say nothing about the texts


def test_texts_are_shuffled_once_to_keep_one_of_each(spark, awkward):
    """Besides the documents, only the ids to keep are exchanged."""
    docs, folder = awkward
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = corpus_pipeline.keep_one_of_each(spark, settle(docs, "docs"), folder)
        plan = chosen._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2, plan


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, awkward, name, stage):
    docs, folder = awkward
    assert stage(spark, docs.filter("false"), folder).collect() == []
