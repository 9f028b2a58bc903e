import datetime

from compare import duck_rows, spark_rows

from inkstream.plans import catalog
from inkstream.sources import feeds


def test_rss(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss><channel><item><title>One &amp;amp; two</title><link>https://a.example/x</link><pubDate>Mon, 02 Jan 2023 03:04:05 GMT</pubDate>"
        "<description><![CDATA[<p>Hello <b>there</b></p>]]></description><category>n</category></item><item><title>No link</title></item></channel></rss>"
    )
    (row,) = feeds.read_rss(spark, str(tmp_path)).collect()
    assert (row.id, row.title, row.url, row.summary, row.categories) == ("https://a.example/x", "One & two", "https://a.example/x", "Hello there", ["n"])
    assert row.published == datetime.datetime(2023, 1, 2, 3, 4, 5)


def test_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed><entry><id>7</id><title>T</title><link rel="self" href="https://a.example/s"/><link href="https://a.example/y"/>'
        "<updated>2023-01-02T03:04:05Z</updated><summary>S</summary></entry></feed>"
    )
    (row,) = feeds.read_atom(spark, str(tmp_path)).collect()
    assert (row.id, row.title, row.url, row.summary) == ("7", "T", "https://a.example/y", "S")


def test_rss_items_of_long_words(spark, tmp_path):
    """Thirty words of more than 600 characters stay whole, as the SQL has them."""
    words = ["ungenheitlichkeiten" + "x" * 12] * 40
    spark.createDataFrame([(i, " ".join(words)) for i in range(8)], "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    found = spark_rows(catalog.QUERIES["rss_items"](spark, str(tmp_path)))
    assert found == duck_rows(catalog.ORACLE_SQL["rss_items"], str(tmp_path))
    assert len(found) == 4
    feed = "<rss><item><title>t</title><link>https://a.example/</link><description>" + "y" * 700 + "</description></item></rss>"
    rows = spark.createDataFrame([(1, feed, "A", "a.example", False)], "feed int, xml string, name string, domain string, aggregator boolean")
    assert len(feeds.feed_entries(rows).first().summary) == 600


ODD = [
    "", " \n ", None, "one", "a <b>bold</b> <word", "x &lt;y&gt; &amp;amp; &#39; z", "what? is/ that#it ?", "end/ \u2028 two#\u0085x", "&&& ### *** <![CDATA[a]]> ]]>",
    "</title> </entry> <entry >", "/ / / /", "İSTANBUL ΟΔΟΣ Σ İ", "a?utm_source=y&ref=z&q=1 b", "www. http://www.x #",
]


def odd_documents(spark, path):
    rows = [(i + i // 5 - i // 32, text, f"src{i % 3}") for i, text in enumerate(ODD * 3)]  # some keys are missing, and one repeats
    assert len({r[0] for r in rows}) == len(rows) - 1 < rows[-1][0]
    spark.createDataFrame(rows, "doc_id long, text string, source string").toPandas().to_parquet(path / "documents.parquet")


def test_atom_entries_of_odd_texts(spark, tmp_path):
    """Empty titles, neighbours that miss or repeat, and what looks like tags or references."""
    odd_documents(spark, tmp_path)
    found = spark_rows(catalog.QUERIES["atom_entries"](spark, str(tmp_path)))
    assert found == duck_rows(catalog.ORACLE_SQL["atom_entries"], str(tmp_path))
    assert len(found) == 3 * len(ODD)


def test_normal_forms_of_odd_texts(spark, tmp_path):
    """No words, and addresses with marks and slashes of their own."""
    odd_documents(spark, tmp_path)
    assert spark_rows(catalog.QUERIES["normal_forms"](spark, str(tmp_path))) == duck_rows(catalog.ORACLE_SQL["normal_forms"], str(tmp_path))
