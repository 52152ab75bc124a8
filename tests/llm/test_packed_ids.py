"""The packed token ids themselves, not just their checksums."""

import brute
from compare import duck

import corpus_pipeline
from tidemark.llm import queries as q

SF = "/root/testdata/sf0.001"


def sequences(rows):
    """sequence_id -> ids of its pieces in order of their places."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        ids = out.setdefault(r.sequence_id, [])
        assert len(ids) == r.offset and len(r.ids) == r.length
        ids.extend(r.ids)
    return out


def test_ids_are_stored_and_returned(spark, monkeypatch):
    from tokenizers import Tokenizer

    docs = duck(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    tokenizer = Tokenizer.from_file(q.vocabulary(q.TOKENIZER))
    n_ids = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    written = []
    monkeypatch.setattr(q, "stored", lambda df, name: written.append(df) or df)
    rows = q.op2_best_fit_packing(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(brute.pieces(docs, tokenizer))
    assert "ids" in written[0].columns

    packed = corpus_pipeline.best_fit_packing(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert sum(map(len, sequences(packed).values())) == n_ids
    by = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        by.setdefault(r.doc_id, []).extend(r.ids)
    assert all(by[d] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs)
