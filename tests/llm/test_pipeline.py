"""The pipeline's stages on the small table, against the operators' rules."""
from pyspark.sql import functions as F

import corpus_pipeline as P
from schemaloom.llm import dartminhash, decontaminate
from schemaloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert out.columns == docs.columns
            assert out.join(docs, docs.columns, "left_anti").where(
                F.col("lang").isNotNull()).count() == 0  # rows are passed on whole
        seen.append((name, docs, out))
        docs = out
    kept = {name: (before, after) for name, before, after in seen}
    before, after = kept["near_dedup"]
    classes = dartminhash.near_duplicates(before).select("class_id").distinct()
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(
        r[0] for r in classes.collect())
    before, after = kept["decontamination"]
    bad = decontaminate.contamination(before, table(spark, SF, "benchmark")).where("contaminated")
    assert after.count() == before.count() - bad.count() and bad.count() > 0
    before, after = kept["bpe"]
    assert after.count() == before.count()


def test_clashing_columns_and_empty(spark):
    docs = (table(spark, SF, "documents").limit(30).withColumn("score", F.lit("s"))
            .withColumn("lang_pred", F.lit(1)).withColumn("predicted", F.lit("p")))
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {r.score for r in out.select("score").collect()} == {"s"}
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_without_or_with_shared_id(spark, docs_of):
    """Contamination is a matter of the row, and rows without id are deduplicated too."""
    item = next(r.text for r in table(spark, SF, "benchmark").collect()
                if len((r.text or "").split()) > 20)
    rows = [(None, item), (7, item), (7, "a clean text"), (None, "another clean text"), (8, None)]
    out = P.drop_contaminated(spark, docs_of(rows), SF)
    assert out.columns == docs_of(rows).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [
        (0, "another clean text"), (7, "a clean text"), (8, "")]
    rows = [(None, "one text"), (None, "one text"), (None, "other"), (9, "other"), (9, "third")]
    out = P.drop_near_duplicates(spark, docs_of(rows), SF)
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [
        (0, "one text"), (9, "other"), (9, "third")]


def test_no_language_to_learn(spark, tmp_path):
    """Without a usable lang, documents with a letter stay and only the others go."""
    docs = table(spark, SF, "documents").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").unionByName(
        docs.limit(1).withColumn("text", F.lit("12 !")))
    out = P.keep_languages(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    want = docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert 0 < out.count() == want < docs.count()
