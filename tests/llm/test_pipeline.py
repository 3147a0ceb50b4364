import re
from collections import Counter

import corpus_pipeline
from scenegrain.llm import mixing, pii, quality_gam, simhash

from .test_operators import brute_fp, brute_roots, tokenizer


def test_stages_take_effect(spark, small_dir):
    """Each stage against a plain version of it on the same input."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    names, now, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small_dir).cache()
        seen[name] = now
    assert all(seen[n].columns == names for n, _ in corpus_pipeline.STAGES[:-1])
    ids = {n: Counter(r.doc_id for r in seen[n].collect()) for n, _ in corpus_pipeline.STAGES[:-1]}

    model = quality_gam.train(docs, spark.read.parquet(f"{small_dir}/labels.parquet"))
    assert set(ids["quality"]) == {r.doc_id for r in docs.collect() if quality_gam_score(model, r.text) >= quality_gam.THRESHOLD}

    kept = sorted((r.doc_id, r.text) for r in seen["quality"].collect())
    roots = brute_roots([brute_fp(t) for _, t in kept])
    assert set(ids["near_duplicates"]) == {kept[r][0] for r in roots} and max(ids["near_duplicates"].values()) == 1

    before = {r.doc_id: r.text for r in seen["near_duplicates"].collect()}
    for r in seen["personal_data"].collect():
        assert r.text == pii.redact(before[r.doc_id], pii.find(before[r.doc_id])) and r.n_chars == len(r.text)
        assert not re.search(r"[\w.]+@[\w-]+\.[a-z]+", r.text)

    mixed = Counter(r.doc_id for r in mixing.mix(seen["personal_data"]).collect())
    assert ids["mixture"] == mixed and set(mixed) == set(before)

    texts = {r.doc_id: r.text for r in seen["mixture"].collect()}
    pieces = seen["windows"].collect()
    total = sum(ids["mixture"][i] * (len(tokenizer_ids(t)) + 1) for i, t in texts.items())
    assert sum(p.length for p in pieces) == total


ODD = [(1, None, None, "a", None), (1, None, None, "a", None), (None, "Some text.", "en", "a", 10), (None, None, None, None, None), (2, "", "en", "b", 0), (3, " \n\t ", "en", "b", 4), (4, "Write to ann@example.org now. " * 400, "en", None, 7), (5, "one two three four", None, "c", 18), (5, "one two three four", None, "c", 18)]


def test_odd_rows_of_every_stage(spark, tmp_path):
    """Nulls in any column, repeated rows, a long text, names that the operators use themselves, and no rows at all."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(5, 1, 0), (5, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.select("*", *[F.lit(1).alias(c) for c in ("_fp", "_at", "_source", "_block", "_row", "_gone", "a.b", "fp", "at")])
    for now in (docs, more, docs.drop("n_chars"), more.limit(0)):
        rows, names = now.count(), now.columns
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path)).cache()
            assert name == "windows" or now.columns == names
            if name == "near_duplicates":
                assert now.count() <= min(rows, 4)  # without words, some text, four words, the long one
            elif name == "personal_data":
                assert not now.where("text like '%@%'").count()
        assert (now.count() > 0) == (rows > 0)


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def quality_gam_score(model, text):
    import numpy as np

    return float(model.score(np.array([quality_gam.features(text)]))[0])


_t = []


def tokenizer_ids(text):
    if not _t:
        _t.append(tokenizer())
    return _t[0].encode(text, add_special_tokens=False).ids


def test_run_gives_the_last_stage(spark, small_dir):
    rows = corpus_pipeline.run(spark, small_dir)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and simhash.SEED == 42
