import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {"start": None}
    out["start"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{root}/{name}")
        docs = out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def test_stages_keep_columns_and_only_drop(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "privacy", "packing"]
    for before, after in zip(["start", *names[:3]], names[:3]):
        assert stages[after].columns == stages["start"].columns
        assert stages[after].exceptAll(stages[before]).count() == 0
    assert stages["privacy"].count() == stages["near"].count()


def test_stages_take_effect(stages):
    assert stages["quality"].count() < stages["start"].count()
    assert stages["exact"].count() == stages["quality"].select("text").distinct().count()
    kept = stages["quality"].groupBy("text").agg({"doc_id": "max"}).toDF("text", "doc_id")
    assert stages["exact"].select("doc_id").exceptAll(kept.select("doc_id")).count() == 0
    assert stages["privacy"].where("text RLIKE '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z]'").count() == 0
    assert stages["packing"].select("doc_id").distinct().count() == stages["privacy"].count()


def test_run_equals_the_stages(spark, sf, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = corpus_pipeline.run(spark, sf).select(columns)
    assert out.exceptAll(stages["packing"].select(columns)).count() == 0 and out.count() == stages["packing"].count()


@pytest.mark.parametrize("last", [True, False])
def test_quality_is_judged_by_every_label(spark, tmp_path, last):
    from pyspark.sql import functions as F

    ids = [i for (i,) in spark.range(21_000).orderBy(F.xxhash64("id"), "id").collect()]
    poor = set(ids[20_000:] if last else ids[:1_000])  # the other 20,000 labels, drawn by least or greatest hash, know no poor document
    docs = spark.createDataFrame([(i, f"!!! {i} |||" if i in poor else f"some plain words of document {i}.", "en", "s", 9) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, int(i not in poor), 0) for i in ids], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [i for (i,) in corpus_pipeline.quality(spark, docs, str(tmp_path)).select("doc_id").collect()]
    assert sorted(kept) == sorted(set(ids) - poor)


@pytest.mark.parametrize("name", ["quality", "exact", "near", "privacy"])
def test_clashing_columns(spark, sf, name):
    from pyspark.sql import functions as F

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(1, "some words here a@b.cd", "en", "s", 3), (2, None, None, None, None), (None, "x", "en", "s", 1), (1, "some words here a@b.cd", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.withColumns({c: F.lit(7) for c in ("_at", "id", "key", "keep", "fp", "v0", "_base", "_all", "_text", "host", "path", "p", "digest", "uid", "least", "a.b")})
    out = stage(spark, odd, sf)
    assert out.columns == odd.columns and 1 <= out.count() <= 4
    assert stage(spark, odd.limit(0), sf).count() == 0
