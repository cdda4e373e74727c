"""Pages whose first section is not small keep all their sections."""

from __future__ import annotations

from lodestone.catalog import QUERIES


def test_sections_of_a_page_with_a_long_url(spark, tmp_path):
    urls = [(100_001, "https://a.example.org/en/1"), (100_002, "https://blog.cheap-pills.example.net/en/1314081?utm_source=feed")]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["md_sections"](spark, str(tmp_path)).orderBy("page_id", "start_line", "kind").collect()
    assert [(r.page_id, r.kind, r.symbol, r.parents, r.start_line, r.end_line) for r in rows] == [
        (100_001, "file_card", "Page 100001", "", 1, 1),
        (100_001, "section", "Top, Part", "", 5, 8),
        (100_002, "file_card", "Page 100002", "", 1, 1),
        (100_002, "section", "Top", "", 5, 6),
        (100_002, "section", "Part", "Top", 7, 8),
    ]
