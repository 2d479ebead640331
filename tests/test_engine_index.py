"""The engine's keyword index follows the store, and searches by it give what a scan gives."""

from pyspark.sql import functions as F

from sparkseam.operators.keyword_index import KeywordIndex
from sparkseam.plans.engine import Engine
from sparkseam.session import remove

KIND = "file_path string, file_type string, content string"


def shown(engine, question):
    return [tuple(r) for r in engine.retrieve(question, 5).select("rank", "chunk_id", "file_path", "final_score", "keyword_score").orderBy("rank").collect()]


def test_retrieval_by_the_index_equals_a_scan_after_every_change(spark, tmp_path):
    root = str(tmp_path / "engine")
    engine = Engine(spark, root)
    files = lambda *rows: spark.createDataFrame([(p, "yaml", c) for p, c in rows], KIND)

    def same(question):
        assert engine._keywords() is not None
        by_index = shown(engine, question)
        remove(spark, f"{root}/keywords-of")
        assert engine._keywords() is None and shown(engine, question) == by_index
        engine._index()
        return by_index

    engine.ingest(files(*[(f"f{i}.yaml", f"name: storage{i}\nnote: bucket number {i} is public\n") for i in range(6)], ("o.yaml", "only: zebra\n")))
    assert {r[2] for r in same("zebra") if r[4] > 0} == {"o.yaml"}
    engine.ingest(files(("o.yaml", "only: giraffe\n"), ("n.yaml", "another: zebra crossing\n")))
    assert {r[2] for r in same("zebra") if r[4] > 0} == {"n.yaml"} and {r[2] for r in same("giraffe") if r[4] > 0} == {"o.yaml"}
    engine.compact()
    engine.remove_old()
    assert {r[2] for r in same("giraffe bucket") if r[4] > 0} > {"o.yaml"}
    assert KeywordIndex(spark, f"{root}/keywords").docs().count() == engine.chunks().count()


def test_an_index_of_an_older_manifest_is_not_used(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "engine"))
    engine.ingest(spark.createDataFrame([("a.yaml", "yaml", "one: lion\n")], KIND))
    monkeypatch.setattr(Engine, "_index", lambda self: None)  # an ingest that ends before its index
    engine.ingest(spark.createDataFrame([("b.yaml", "yaml", "two: tiger\n")], KIND))
    assert engine._keywords() is None
    assert engine.retrieve("tiger", 3).filter(F.col("keyword_score") > 0).first()["file_path"] == "b.yaml"
