"""Texts are folded whole, with the letters that have no decomposition."""

from quorumlake import plans


def test_folded_names(spark, tmp_path):
    long = "Nhà máy nhiệt điện Đồng Nai " * 9
    rows = [(1, f" {long}"), (2, "đường"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["folded"] for r in plans.queries()["folded_names"](spark, str(tmp_path)).collect()}
    assert got == {1: ("nha may nhiet dien dong nai " * 9).strip(), 2: "duong", 3: None, 4: ""}
