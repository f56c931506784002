import corpus_pipeline
from symloom.llm.queries import oracle_sql, queries, tokenizer_path


def test_stages_over_a_small_corpus(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    item = rows[7][1][:200]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [step.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        step = stage(spark, step, str(tmp_path))
        step.write.parquet(f"{tmp_path}/step{k}")
        step = spark.read.parquet(f"{tmp_path}/step{k}")
        counts.append(step.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert step.columns == docs.columns
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] == counts[5]
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"] or -1, r["n_tokens"]) for r in step.collect())


def test_registered():
    assert {q.split("_")[0] for q in queries()} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
    assert set(oracle_sql()) <= set(queries()) and tokenizer_path()


def test_end_to_end_against_plain_steps(spark, docs, rows, clashing, tmp_path):
    """What stays, by plain near copies and plain containment; tokens by the library over the redacted texts."""
    from sentencepiece import SentencePieceProcessor

    from symloom.llm import decontaminate, secret_scan
    from tests.llm.test_operators import plain_links

    item = rows[14][1][:200]
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lettered = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    stay = {}
    for (d, c, _), r in zip(plain_links(lettered), [r for r in lettered if r[0] is not None], strict=True):
        if d == c:
            stay[d] = r[1]
    kept = [t for t in stay.values()] + [r[1] for r in lettered if r[0] is None]
    kept = [t for t in kept if decontaminate.normal(item) not in decontaminate.normal(t)]
    redacted = [r["text"] for r in secret_scan.redact(spark.createDataFrame([(t, None) for t in kept], "text string, n_chars long")).collect()]
    library = SentencePieceProcessor(model_file=tokenizer_path())
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(len(library.encode(t)) for t in redacted) == sorted(r["n_tokens"] for r in found)
    assert len(found) < len(lettered) and {r["doc_id"] for r in found} <= {r[0] for r in lettered}


def test_an_empty_corpus(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
