"""The pipeline against a brute-force run, stage by stage."""

import brute
from compare import duck

import corpus_pipeline
from tidemark.llm.queries import TOKENIZER, vocabulary
from tidemark.sources.storage import stored

SF = "/root/testdata/sf0.001"


def kept_by_rules(spark):
    from tidemark.llm import queries as q

    return {r.doc_id for r in q.op5_quality_rules(spark, SF).where("kept").collect()}


def test_stages(spark):
    from tokenizers import Tokenizer

    rows = duck(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        outputs.append(docs)
        if stage is not corpus_pipeline.best_fit_packing:
            assert docs.columns == columns, name
    got = [sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()) for d in outputs[:4]]

    keep = kept_by_rules(spark)
    want = sorted((d, t) for d, t in rows if d in keep)
    assert got[0] == want and len(want) > 0.5 * len(rows)

    last = {}
    for d, t in want:
        last[t] = max(d, last.get(t, d))
    want = sorted((d, t) for t, d in last.items())
    assert got[1] == want

    want = [(d, t) for (d, t), (_, _, first) in zip(want, brute.simhash(want)) if d == first]
    assert got[2] == want

    def redacted(text):
        out, at = "", 0
        for start, _, end, kind in brute.secrets(text):
            if start >= at:
                out += text[at:start] + f"[{kind}]"
            at = max(at, end)
        return out + text[at:]

    want = [(d, redacted(t)) for d, t in want]
    assert got[3] == want
    before = {r.doc_id: r for r in outputs[2].collect()}
    for r in outputs[3].collect():
        old = before[r.doc_id]
        assert r.n_chars == (old.n_chars if r.text == old.text else len(r.text))

    pieces = brute.pieces(want, Tokenizer.from_file(vocabulary(TOKENIZER)))
    packed = outputs[4].select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, packed)) == sorted(pieces)
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)
