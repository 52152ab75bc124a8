"""The ledger of blobs between scans."""

from dataclasses import replace

from tidemark.llm.secrets import RULES, read_ledger, secret_scan, spans_text

KEY = "AKIA" + "A1B2C3D4E5F6G7H8"
TEXTS = {1: f"one {KEY}", 2: "password = abcdefghijklmnop", 3: "nothing here", 4: None, 5: f"one {KEY}", 6: "", 2**53 + 1: "x" * 30000 + KEY}


def found(df, path, rules=RULES):
    out = secret_scan(df, ledger_path=path, rules=rules)
    return {r.doc_id: r.spans for r in out.select("doc_id", spans_text(out.findings).alias("spans")).collect()}


def test_scans_in_a_row_take_only_what_is_unseen(spark, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    assert read_ledger(spark, path) is None
    first = found(docs.where("doc_id <= 3"), path)
    assert first == {1: "access:4:24", 2: "assign:0:27", 3: ""}
    assert read_ledger(spark, path).count() == 3

    whole = found(docs, path)
    assert whole == {1: "access:4:24", 2: "assign:0:27", 3: "", 4: "", 5: "access:4:24", 6: "", 2**53 + 1: "access:30000:30020"}
    assert read_ledger(spark, path).count() == 5  # the empty text and the long one came on top
    assert found(docs, path) == whole and read_ledger(spark, path).count() == 5


def test_a_raised_version_is_scanned_alone(spark, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    before = found(docs, path)
    raised = tuple(replace(r, version=2, least=25) if r.kind == "access" else r for r in RULES)
    assert found(docs, path, raised) == {k: "" if v.startswith("access") else v for k, v in before.items()}
    added = [r.rules for r in read_ledger(spark, path).where("array_contains(rules, 'access@2')").collect()]
    assert added == [["access@2"]] * 5
    assert found(docs, path) == before  # the older version is still known


def test_a_pair_written_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    whole = found(docs, path)
    read_ledger(spark, path).coalesce(1).write.mode("append").parquet(path)
    assert found(docs, path) == whole
    aside = secret_scan(docs, ledger=read_ledger(spark, path), ledger_path=str(tmp_path / "next"))
    assert {r.doc_id: r.s for r in aside.select("doc_id", spans_text(aside.findings).alias("s")).collect()} == whole
    assert read_ledger(spark, str(tmp_path / "next")).count() == 0
