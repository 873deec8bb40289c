"""Tables as text, framed answers, catalogues and sinks on small inputs."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import catalog, receipts, sinks

HEAD = "PO_NUM,RCV_NUM,ITM_CODE,UOM,RCV_QTY,PO_UPRICE,LINE_TOTAL,SUPPLIER_TAX_ID"


def test_receipts_of_several_files_and_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "\n" + "\n".join(f'4000000{i % 10},R{i},"IT,{i}",PC,"1,{i:03}.5",2,,' for i in range(900)) + "\n\n900 rows selected.\n")
    (tmp_path / "b.csv").write_text("\nRCV_NUM,PO_UPRICE,RCV_QTY,PO_NUM\r\nR1,2.00,3,P1\r\n,1,1,P2\r\nR3,x,1,P3\r\nno rows selected\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = receipts.read_receipts(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    a = sorted((r for r in rows if r["file"].endswith("a.csv")), key=lambda r: r["line_num"])
    assert [(r["line_num"], r["receipt_num"]) for r in a] == [(i + 1, f"R{i}") for i in range(900)]
    assert a[7]["item_code"] == "IT,7" and a[7]["qty"] == Decimal("1007.5") and a[7]["line_amount"] == Decimal("2015") and {r["rejected"] for r in a} == {None}
    b = sorted((r["receipt_num"], r["po_number"], r["line_amount"], r["rejected"]) for r in rows if r["file"].endswith("b.csv") and r["receipt_num"])
    assert b == [("R1", "P1", Decimal("6"), None), ("R3", "P3", None, "not_a_number")]
    assert [r["rejected"] for r in rows if r["receipt_num"] is None] == ["no_key"]


def test_another_table_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("A,B\n1,2\n")
    with pytest.raises(Exception, match="MissingColumns"):
        receipts.read_receipts(spark, f"file://{tmp_path}").collect()


def test_framed_answers(spark):
    fine = {"result": {"content": [{"text": "a,b"}, {"text": "c"}]}}
    texts = [json.dumps(fine), "event: m\ndata: " + json.dumps(fine) + "\n", json.dumps({"error": {"message": "down"}}), json.dumps({"result": {"isError": True, "content": [{"text": "bad sql"}]}}), "{}", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [tuple(r[0]) for r in df.orderBy("i").select(receipts.framed(F.col("t"))).collect()] == [("a,b", None), ("a,b", None), (None, "down"), (None, "bad sql"), (None, "no_content"), (None, "no_content")]


def test_nested_datasets(spark):
    df = spark.createDataFrame([("P1", [("R1", 2), ("R2", 3)]), ("P2", [])], "po_number string, rows array<struct<receipt_num: string, qty: int>>")
    assert [tuple(r) for r in receipts.nested(df).collect()] == [("P1", 1, "R1", 2), ("P1", 2, "R2", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, [1, 2], "2024-01-01", "a" * 300), (2, [2, 9], "2024-01-03", "b"), (3, [1], "2024-01-02", None), (4, None, "2024-02-01", "d"), (5, [], "2024-02-01", "e")]
    return spark.createDataFrame(rows, "id int, tags array<int>, created string, content string")


def test_catalogue_filters(spark, docs):
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(catalog.tagged(docs, [1, 2])) == [1, 2, 3] and ids(catalog.tagged(docs, [1, 2], every=True)) == [1] and ids(catalog.tagged(docs, [1, 2], without=[9])) == [1, 3]
    assert ids(catalog.next_document(docs, 1, 9)) == [3] and ids(catalog.next_document(docs, 7, 9)) == []
    tags = spark.createDataFrame([(1, "Invoice"), (2, "Paid invoice")], "id int, name string")
    assert ids(catalog.tag_ids(tags, ["INVOICE"])) == [1] and ids(catalog.tag_ids(tags, ["invoice"], contains=True)) == [1, 2] and ids(catalog.tag_ids(tags, [])) == []
    named = {r["id"]: (r["tag_names"], len(r["preview"] or "")) for r in catalog.with_tag_names(docs, tags).collect()}
    assert named[1] == (["Invoice", "Paid invoice"], 200) and named[2] == (["Paid invoice", "tag-9"], 1) and set(named) == {1, 2, 3, 4, 5}


def test_file_classes(spark):
    df = spark.createDataFrame([("A.PDF", None), ("x", "application/pdf"), ("p.JPG", None), ("x", "image/png"), (None, None), ("pdf.txt", "text/plain")], "n string, m string")
    assert [r[0] for r in df.select(catalog.file_class(F.col("n"), F.col("m"))).collect()] == ["pdf", "pdf", "image", "image", "other", "other"]


def test_files_are_stored_once(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-1"), ("c.pdf", b"no"), ("d.pdf", b"%PDF-2")):
        (tmp_path / name).write_bytes(body)
    files = catalog.files(spark, f"file://{tmp_path}")
    new = sinks.new_files(files, files.where("path like '%d.pdf'"))
    assert [bytes(r["content"]) for r in new.collect()] == [b"%PDF-1"]


def test_results_and_their_contract(spark, tmp_path):
    rules = [(d, f"V-0{i}", "pass", None, None) for d in (1, 2) for i in range(1, 10)] + [(3, "V-01", "fail", "E01", "Medium")]
    results = spark.createDataFrame(rules, "doc_id long, rule_id string, result string, code string, severity string")
    said = spark.createDataFrame([(1, "AUTO_PASS", None), (2, "NONSENSE", None), (3, "REVIEW", "Medium")], "doc_id long, recommendation string, max_severity string")
    done = sinks.assembled(results, said)
    assert {r["doc_id"]: (len(r["rules"]), r["summary"]["n_findings"], len(r["integrity"])) for r in done.collect()} == {1: (9, 0, 64), 2: (9, 0, 64), 3: (1, 1, 64)}
    assert sorted(map(tuple, sinks.violations(done).collect())) == [(2, "unknown_status"), (3, "not_nine_rules")]
    at = f"file://{tmp_path}/out"
    sinks.write_results(done, at)
    sinks.write_results(done.where("doc_id = 1"), at)  # replaces its own partition only
    assert sorted(r["doc_id"] for r in spark.read.json(at).select("doc_id").collect()) == [1, 2, 3]


def test_tags_caches_and_rule_rows(spark):
    df = spark.createDataFrame([([1],), (None,), ([5],)], "tags array<int>")
    assert [r[0] for r in df.select(sinks.with_tag(F.col("tags"), 5)).collect()] == [[1, 5], [5], [5]]
    keys = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "cache_key string, file_sha256 string")
    cache = spark.createDataFrame([("a", "1", "hit"), ("b", "x", "stale")], "cache_key string, file_sha256 string, value string")
    assert sorted((r[0], r[1]) for r in sinks.cached(keys, cache).collect()) == [("a", "hit"), ("b", None), ("c", None)]
    results = spark.createDataFrame([(1, "V-01", "fail", "E01"), (1, "V-02", "pass", None)], "doc_id long, rule_id string, result string, code string")
    more = spark.createDataFrame([(1, "V-01", "E13"), (1, "V-01", None)], "doc_id long, rule_id string, code string")
    assert sorted(map(str, (tuple(r) for r in sinks.rule_rows(results, more).collect()))) == sorted(map(str, [(1, "V-01", "fail", "E13"), (1, "V-01", "fail", "E01"), (1, "V-02", "pass", None)]))
