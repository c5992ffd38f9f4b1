import corpus_pipeline
from glossa.llm import secret_scan, toxicity
from tests.llm.test_minhash_dedup import brute


def test_stages_on_a_small_corpus(spark, tmp_path):
    import random

    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ran", "tol", "mer", "bis") for b in ("do", "mi", "la", "re", "so")]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60)) + (" vilgor vilgoren vilgora" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0, "x") for i in range(300)]
    docs += [(1000 + i, docs[i][1], "en", "s0", 0, "x") for i in range(1, 5)]
    docs += [(3000, "some words only here for a row that comes twice", "en", "s1", 0, "x")] * 2
    docs += [(2000, "token = 0123456789abcdef0123456789abcdef and more words here", None, None, 5, None), (2001, None, None, None, None, None), (2002, "", "en", "s1", 0, "x")]
    docs = [(*d, f"c{d[0]}", float(d[0]), -d[0]) for d in docs]  # names that the operators use themselves
    mine = {d[0]: (d[5], d[6], d[7], d[2]) for d in docs}
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, predicted string, credits string, size double, redacted long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before, kept = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = after.collect()
        if name != "byte_bpe":
            assert after.columns == frame.columns and after.schema == frame.schema
            assert all((r.predicted, r.credits, r.size, r.lang) == mine[r.doc_id] for r in kept[name])
        before = after
    assert {r.doc_id for r in kept["toxicity"]} == {d[0] for d in docs if not d[1] or "vilgor" not in d[1]}
    groups = brute([(r.doc_id, r.text) for r in kept["toxicity"]])
    assert {r.doc_id for r in kept["near_dedup"]} == {i for i, (_, c) in groups.items() if i == c}
    for r in kept["secret_scan"]:
        assert not secret_scan.base_spans(r.text or "")
    assert next(r for r in kept["secret_scan"] if r.doc_id == 2000).text == "token = [ASSIGN] and more words here"
    counts = {}
    for r in kept["source_mix"]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) <= 3 and 2002 not in counts
    assert counts[3000] % 2 == 0
    assert sorted(r.doc_id for r in kept["byte_bpe"]) == sorted(r.doc_id for r in kept["source_mix"])
    assert toxicity.GAINS and len(corpus_pipeline.STAGES) == 5


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_stages_keep_rows_of_nulls(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a few words", None, None, None), (1, None, "en", "a", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert sorted(map(str, stage(spark, frame, str(tmp_path)).collect())) == sorted(map(str, frame.collect()))
    assert [r.text for r in corpus_pipeline.mix_stage(spark, frame, str(tmp_path)).collect()] == ["a few words"]
    assert corpus_pipeline.encode_stage(spark, frame, str(tmp_path)).count() == 3


def test_tasks_release_memory_however_they_end(monkeypatch):
    import pytest

    from glossa.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.releasing(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and len(calls) == 1
    with pytest.raises(ZeroDivisionError):
        list(common.releasing(lambda batches: (1 // b for b in batches))(iter([1, 0])))
    left = common.releasing(iter)(iter([1, 2]))
    next(left)
    left.close()
    assert len(calls) == 3
