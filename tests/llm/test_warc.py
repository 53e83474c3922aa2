"""Records of archives: ids, dates and revisits, whichever way digests meet the pages."""

import pytest
from pyspark.sql import functions as F

from weftline.llm import warc


@pytest.mark.parametrize("most", [0, 200_000])
def test_records(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    rows = [(4, "u4", "same"), (2, "u2", "same"), (9, "u9", "same"), (9, "u9", "other"), (5, None, None), (3, "u3", ""), (None, "n", "alone"), (None, "n", "alone"), (7, "a\r\nb", "é" * 200_000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, n int")
    where = f"file://{tmp_path}/w"
    warc.write_archives(pages, where, 0, "2024-05-06T07:08:09Z")
    got = warc.resolve_revisits(warc.read_archives(spark, where)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id is not None) == [(2, "response", None, 4), (3, "response", None, 0), (4, "revisit", 2, 4), (5, "revisit", 3, 0), (7, "response", None, 400_000), (9, "response", None, 5), (9, "revisit", 2, 4)]
    assert [r.record_type for r in got if r.page_id is None] == ["response", "response"]
    ids = {(r.page_id, r.payload_digest): r.record_id for r in got}
    assert len(set(ids.values())) == len(ids)
    by_id = {r.record_id: r for r in got}
    assert all(by_id[r.refers_to_id].page_id == r.refers_to for r in got if r.record_type == "revisit")
    lines = spark.read.text(where).filter(F.col("value").startswith("WARC-Date")).distinct().collect()
    assert [r.value for r in lines] == ["WARC-Date: 2024-05-06T07:08:09Z"]
    warc.write_archives(pages.limit(0), where + "0")
    assert warc.read_archives(spark, where + "0").collect() == []
