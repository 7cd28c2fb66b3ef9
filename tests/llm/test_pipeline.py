import importlib

from tests.llm import brute
from tests.llm.test_line_dedup import _brute as brute_lines
from tests.llm.test_near_copies import _kept as brute_copies

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, rid string"


def test_stages_equal_brute_force(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]

    kept = stages["language_id"](spark, docs, SF)
    rows = kept.select("doc_id", "text", "source").collect()
    assert kept.columns == columns and len(rows) == docs.count()

    lines = stages["line_dedup"](spark, kept, SF)
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert lines.columns == columns and texts == dict(brute_lines([tuple(r) for r in sorted(rows)], 4))

    single = stages["near_duplicates"](spark, lines, SF)
    left = {r.doc_id: r.text for r in single.collect()}
    alone, _ = brute_copies(texts.items())
    assert single.columns == columns and left == {d: texts[d] for d in alone} and len(left) < len(texts)

    clean = stages["decontamination"](spark, single, SF)
    after = {r.doc_id: r.text for r in clean.collect()}
    found = {r[0]: r for r in brute.contamination(left.items(), items)}
    assert clean.columns == columns and any(r[-1] for r in found.values())
    assert not any(r[-1] for r in brute.contamination(after.items(), items))
    assert all(after[d] == t for d, t in left.items() if not found[d][-1])
    assert all(found[d][2] > found[d][1] / 2 for d in left.keys() - after.keys())

    packed = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == after.keys()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_stages_take_odd_rows(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (1, base, "en", "b"), (2, base, None, None), (None, base, "en", "a"), (None, "alone " + base[::-1], "en", "a"),
            (None, "alone " + base[::-1], "en", "a"), (3, None, "en", "a"), (4, "", "en", "a"), (5, "12 34", "de", "a"), (6, "word " * 60_000, "en", "a")]
    docs = spark.createDataFrame([(*r, 1, "r", 2, "z") for r in rows], DOC)
    for d in (docs, docs.limit(0)):
        start = d
        for name, stage in pipeline.STAGES:
            d = stage(spark, d, SF)
            assert name == "packing" or d.columns == docs.columns
            d.collect()
        assert start.isEmpty() == d.isEmpty()
    single = pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted([(r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in single]) == [(False, 1, "one t"), (False, 3, ""), (False, 5, "12 34"), (False, 6, "word "), (True, 0, "alone")]
