"""The pipeline's stages, each against its operator's verdicts on its own input."""

from pathlib import Path

import corpus_pipeline
from tessera.llm import minhash, quality_rules, secret_scans
from tessera.llm.common import shared_dir, table

SF = "/root/testdata/sf0.001"


def test_decontamination_judges_each_row(spark):
    item = table(spark, SF, "benchmark").where("length(text) > 150").first()["text"]
    rows = [(1, f"x y {item} z"), (1, "some other words of the same id"), (None, item), (None, "words without an id"), (2, None), (None, None), (3, item)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    out = corpus_pipeline.decontaminate(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)


def test_stages_in_turn(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.count() <= docs.count()
        ids = {r[0] for r in out.select("doc_id").collect()}
        if name == "quality_rules":
            assert ids == {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
        elif name == "near_duplicates":
            assert ids == {r["doc_id"] for r in minhash.components(docs, 0.8).where("kept").collect()}
        elif name == "decontamination":
            items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
            held = {r["doc_id"] for r in docs.collect() if any(i in (r["text"] or "") for i in items)}
            assert not held & ids and len(held) + len(ids) <= docs.count()
        elif name == "secret_scans":
            assert out.count() == docs.count() and secret_scans.scan(out).where("n_assign + n_access + n_hex > 0").count() == 0
        else:
            assert ids == {r[0] for r in docs.select("doc_id").collect()}
        docs = out


def test_pipeline_leaves_its_last_table_only(spark):
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir()) if shared.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.select("doc_id").distinct().count() <= table(spark, SF, "documents").count()
    assert sorted(p.name.split("-")[1] for p in set(shared.iterdir()) - before) == ["packing"]


def test_stages_on_nulls_and_on_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (None, "a b c", "en", None, 5), (2, None, "fr", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        own = some
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, own, SF)
            assert out.count() <= 4 and (name == "packing" or out.columns == docs.columns)
            own = some if name == "quality_rules" else out  # short texts do not pass the rules
