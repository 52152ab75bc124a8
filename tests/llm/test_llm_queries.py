"""The ten queries at the smallest scale: SQL twins, brute force, exact round trips."""

import brute
import pytest
from compare import compare, duck

from tidemark.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    con = duck(SF)
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_equals_sql(name, spark):
    assert compare(name, spark, duck(SF), SF, q.QUERIES[name], q.ORACLES[name]) is None


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    rows = q.op2_best_fit_packing(spark, SF).collect()
    want = brute.pieces(docs, Tokenizer.from_file(q.vocabulary(q.TOKENIZER)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_codec(spark, docs):
    import zlib

    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=q.vocabulary(q.PIECE_MODEL))
    rows = q.op7_piece_codec(spark, SF).collect()
    crc = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    want = [(d, len(ids), crc(ids), True) for (d, _), ids in zip(docs, model.encode([t or "" for _, t in docs], num_threads=1))]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_secrets(spark, docs):
    rows = {r.doc_id: r for r in q.op8_secret_scan(spark, SF).collect()}
    assert len(rows) == len(docs)
    for d, text in docs:
        spans = brute.secrets(text)
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        r = rows[d]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == brute.sha(base)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_simhash(spark, docs):
    rows = q.op9_simhash(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.simhash(docs))
