"""The pipeline: every stage's decisions take effect, columns stay, and odd rows pass."""

import pytest

import corpus_pipeline
from tarsia.llm.jaccard import jaccard_components
from tarsia.llm.mixing import mix_sources
from tarsia.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, score string"


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).persist()
        if i < 4:
            assert out.columns == docs.columns
        if i == 2:
            assert jaccard_components(out).where("component_id <> doc_id").count() == 0
            assert out.count() < before
        docs = out
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and docs.count() > 0


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and sources, equal rows, an id with two texts, columns named like the operators' own."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long, "a"), (7, long, "a"), (7, long, "a"), (None, "some words here", "a"), (None, "some words here", "a"), (8, None, "b"), (9, "", None), (10, "x y z", None), (11, "one", "b"), (11, "two three", "b"), (12, f"{long} end", "a")]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 5, "s") for i, t, s in rows], SCHEMA)


def test_mix_takes_rows(spark, odd):
    taken = {}
    for r in mix_sources(odd).collect():
        taken[r.doc_id, r.size, r.source] = taken.get((r.doc_id, r.size, r.source), 0) + r.copies
    got = {}
    for r in corpus_pipeline.mix(spark, odd, "").collect():
        key = r.doc_id, len(r.text.split()), r.source
        got[key] = got.get(key, 0) + 1
        assert (r.copies, r.score, r.lang) == (5, "s", "en")
    words = lambda d, s: sum(n * k[1] for k, n in d.items() if k[2] == s)
    for source in ("a", "b", None):
        # another name for rows is another draw, to the same target
        assert abs(words(got, source) - words(taken, source)) <= 60
    assert all(n <= 2 * 3 for n in got.values()) and any(k[0] is None for k in got)


def test_near_copies_of_odd_rows(spark, odd):
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, odd, "").collect()), key=repr)
    texts = [t for i, t in got if i == 7]
    assert len(texts) == 1 and not [t for i, t in got if i == 12]
    assert [t for i, t in got if i is None] == ["some words here"] * 2
    assert {i for i, _ in got} == {7, None, 8, 9, 10, 11}


def test_empty_table(spark, odd, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_other_stages_of_odd_rows(spark, odd, sf):
    assert corpus_pipeline.drop_lines(spark, odd, sf).count() == odd.count()
    good = corpus_pipeline.keep_good(spark, odd, sf)
    assert good.schema == odd.schema and all(r.score == "s" for r in good.collect())
    assert corpus_pipeline.drop_lines(spark, odd.withColumnRenamed("copies", "n_lines"), sf).where("n_lines = 5").count() == odd.count()
    assert corpus_pipeline.pack(spark, odd, sf).count() == odd.count()
