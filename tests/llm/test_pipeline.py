"""The pipeline against its stages' definitions, applied one after another in plain Python."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from helixflow.llm import decontaminate, language_id, mixing, quality  # noqa: E402
from helixflow.llm.common import materialise  # noqa: E402

from .test_corpus_operators import brute_components  # noqa: E402


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        now = materialise(stage(spark, now, sf_dir))
        rows = now.collect()
        kept = {r.doc_id: r.text for r in rows}
        assert set(kept) <= set(before) and all(before[i] == t for i, t in kept.items())
        if name != "mix":
            assert now.columns == docs.columns and len(rows) == len(kept)
        if name == "quality":
            trees = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            for i, t in before.items():
                base, x = quality.statistics(t.encode())
                good = base[0] >= 50 and 2 * base[4] <= base[0] and trees.score(quality.np.array([x]))[0] >= 0.3
                assert good == (i in kept)
        if name == "language":
            assert len(kept) >= 0.98 * len(before)
        if name == "near_duplicates":
            found = brute_components(list(before.items()), 5, 80)
            assert set(kept) == {i for i, (_, c) in found.items() if c == i}
        if name == "decontaminate":
            items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            held = {i for i, t in before.items() if any(x in " ".join(t.split()) for x in items)}
            assert not held & set(kept) and len(before) - len(kept) <= len(held) + 1
    epochs = sorted((r.doc_id, r.epoch) for r in rows)
    assert sorted((r.doc_id, r.epoch) for r in corpus_pipeline.run(spark, sf_dir).collect()) == epochs
    assert language_id and decontaminate and mixing


def test_one_of_each_group_stays(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text, "en", "s", 1), (3, text, "en", "s", 1), (2, text + " more", "en", "s", 1), (9, "another text of its own", None, None, None), (None, text, "en", "s", 1), (7, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate(spark, df, sf_dir)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 7, 9]


def test_other_texts_of_an_id_stay(spark, sf_dir):
    """An id that repeats with another text: the copy goes, the other text stays."""
    w, o = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    rows = [(1, w), (5, w), (5, o), (6, o + " more"), (7, w), (7, "short text"), (7, "short text"), (None, w), (None, w)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicate(spark, df, sf_dir).collect())
    assert out == sorted([(0, w), (1, w), (5, o), (7, "short text")])
    assert corpus_pipeline.near_duplicate(spark, df.limit(0), sf_dir).count() == 0


def test_other_stages_on_rough_rows(spark, sf_dir):
    """Nulls in any column, repeated rows, empty texts and tables, clashing extra columns: defined results for each stage."""
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 120").limit(1).collect())
    prose = next(r.text for r in corpus_pipeline.language(spark, corpus_pipeline.quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir), sf_dir).limit(1).collect())
    rows = [(1, prose, "en", "web", 5, "x"), (1, prose, "en", "web", 5, "x"), (None, prose, None, None, None, "x"), (2, None, "en", "web", 1, "x"), (3, "", None, "web", 1, None), (4, f"{prose} {item}", "en", "news", 9, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string"
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf_dir)
        ids = sorted((r.doc_id or 0) for r in out.collect())
        want = {"quality": [0, 1, 1, 4], "language": [0, 1, 1, 4], "decontaminate": [0, 1, 1, 2, 3]}.get(name)
        assert want is None or ids == want, name
        assert name == "mix" or out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, df.limit(0), sf_dir).count() == 0
