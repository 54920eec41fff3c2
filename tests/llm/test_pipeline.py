"""The pipeline over a small table against what each stage is for, row by row."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run_on_a_small_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, leak, footer, own = text(80), text(20), text(12), [text(60) for _ in range(4)]
    near = base.split()
    near[40] = "changed"
    near = " ".join(near)
    rows = [
        (1, base), (2, f"{own[0]}\n{footer}"), (3, f"{own[1]}\n{footer.upper()}!"), (4, f"{own[2]} {leak} {text(5)}"),
        (5, "12 34 !!"), (6, None), (7, ""), (8, own[3]), (8, text(50)), (None, text(55)), (9, f"{near[:300]} {text(3)} {near[300:]}"),
    ]
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 4 leaks; 5 to 7 have no letter; 9 is a near copy of 1; both rows of key 8 and the null key stay
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 1, 2, 3, 8, 8]
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in out)
    documents = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, documents.where("doc_id in (2, 3)"), str(tmp_path)).collect()}
    assert cut == {2: f"{own[0]}\n{footer}", 3: own[1]}
