"""The pipeline's decisions on a small input of its own."""

import random

import corpus_pipeline
from vellum.llm import registry


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n=60: " ".join(rng.choice(vocabulary) for _ in range(n))
    item, line = text(25), text(12)
    clean = {i: text() for i in range(80)}
    docs = dict(clean)
    docs |= {100 + i: text() + " idiotic" for i in range(25)}
    near = clean[3].split()
    near[30] = "different"
    docs |= {200: clean[1], 201: " ".join(near), 202: f"{text()} {item}", 203: f"{line}\n{text()}", 204: f"{line}\n{text()}", 205: "", 206: None}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 125)) for i in docs if i < 125], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(clean) | {203, 204, 205, 206}
    assert got[203]["n_tokens"] > got[204]["n_tokens"]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "bpe_encode"]
    assert {int(q[2:].split("_")[0]) for q in registry.queries()} == set(range(1, 14))
