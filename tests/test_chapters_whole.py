from leafmark.plans import queries


def test_chapters_decode_all_references(spark, tmp_path):
    """Pages with references, an unclosed script and '>' in attributes give the chapters of their plain forms."""
    marked = "<p title='a > b'>Caf&eacute;&nbsp;&#8217;s &mdash; one two three &quot;x&quot;</p>" * 40 + "<script>var y"
    plain = "<p>Café\u00a0’s — one two three \"x\"</p>" * 40
    got = []
    for name, page in (("marked", marked), ("plain", plain)):
        rows = [(i, f"http://h/{i}", page) for i in range(8)]
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got.append(sorted(map(str, queries.chapter_assembly(spark, f"{tmp_path}/{name}").collect())))
    assert got[0] == got[1] and got[0]
