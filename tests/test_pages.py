"""Whole elements of web pages."""

from pyspark.sql import functions as F

from folioscope.sources.documents import page_text


def test_elements_keep_their_text(spark):
    pages = [
        ("<h1>A &amp; B</h1><p><b>bold</b> start<br>next <a href='x'>link</a> end</p>", "# A & B\nbold start next link end"),
        ("<p>open one<p>open two<div>not told</div><P class='x'>big\nline</P>", "open one\nopen two\nbig line"),
        ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>a<!-- b -->c", "ac"),
        ("<pre>x</pre><param>y<p></p>", ""),
        ("<p>cut <b", "cut "),
        ("&lt;p&gt;<p>&amp;lt; &quot;q&quot;</p>", '&lt; "q"'),
        ("", ""),
        (None, None),
        ("<p>" + "long <b>word</b> " * 50_000 + "</p>", "long word " * 50_000),
    ]
    df = spark.createDataFrame([(k, h) for k, (h, _) in enumerate(pages)], "k int, html string")
    got = {r["k"]: r["t"] for r in df.select("k", page_text(F.col("html")).alias("t")).collect()}
    assert [got[k] for k in range(len(pages))] == [want for _, want in pages]
