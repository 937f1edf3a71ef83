import public_tokenizers
import sentencepiece

from corpusloom.llm import queries


def test_query_returns_ids_and_decoded_text(docs, spark, text, tmp_path):
    texts = [None, "", "a", "日本 x\n\n y\t z  é 😀", text(50, 1), text(400, 2)]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op6_segment_sampling(spark, str(tmp_path)).collect()
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows:
        assert r.text == (texts[r.doc_id] or "") == m.decode(r.ids) and r.n_pieces == len(r.ids)
    assert [len({tuple(r.ids) for r in rows if r.doc_id == i}) for i in range(6)] == [1, 1, 2, 2, 2, 2]
