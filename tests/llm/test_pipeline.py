import corpus_pipeline
from graphlens.llm import decontaminate, simhash
from tests.conftest import SF
from tests.llm.cases import docs
from tests.llm.test_corpus import folder_of, plain_fingerprint
from tests.llm.test_similar import survivors


def test_stages_in_turn(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = frame.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in frame.collect()]
        frame = spark.createDataFrame(stage(spark, frame, SF).collect(), stage(spark, frame, SF).schema)
        after = [r.asDict() for r in frame.collect()]
        seen.append((name, before, after))
        if name != "mixture":
            assert frame.columns == columns
    by = {name: (before, after) for name, before, after in seen}
    assert len(by["toxicity"][1]) < len(by["toxicity"][0])
    assert [r["doc_id"] for r in sorted(by["line dedup"][1], key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in by["line dedup"][0])
    before, after = by["near-dedup"]
    assert sorted(r["doc_id"] for r in after) == survivors([(r["doc_id"], r["text"]) for r in before])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tables = decontaminate.build(items)
    before, after = by["decontamination"]
    clean = []
    for r in before:
        hits, found = [], set()
        for t in tables:
            t.search(decontaminate.words(r["text"]), hits, found)
        if not hits:
            clean.append(r["doc_id"])
    assert sorted(clean) == sorted(r["doc_id"] for r in after)


def test_odd_rows_pass_through(spark, tmp_path):
    d = folder_of(spark, tmp_path, docs(spark))
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 0 and {"doc_id", "text", "taken"} <= set(out.columns)


def test_empty_table(spark, tmp_path):
    d = folder_of(spark, tmp_path, docs(spark, []))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_fingerprint_in_blocks():
    text = " ".join(f"w{i % 91}" for i in range(5000))
    whole = simhash.fingerprint(text)
    simhash.BLOCK, old = 100, simhash.BLOCK
    try:
        assert simhash.fingerprint(text) == whole == plain_fingerprint(text)
    finally:
        simhash.BLOCK = old
