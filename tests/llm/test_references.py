"""Plain text and titles of WARC derivatives decode what html.unescape decodes."""

import html

from corpusloom.llm import warc


def test_references_are_decoded_like_html_unescape(spark):
    text = "caf&eacute; &mdash; a&hellip; it&#8217;s it&#x2019;s &amp;lt; 1 &lt; 2 &copy; &middot; AT&T &unknown; &NotEqualTilde; x"
    pages = spark.createDataFrame([(1, "u", f"<html><title>{text}</title><p>{text}</p><p>a&nbsp;&#160;b</p></html>")], "page_id long, url string, html string")
    got = {r.warc_type: r for r in warc.derivatives(warc.responses(pages)).collect()}
    want = html.unescape(text)
    assert got["conversion"].block == want + "\na b"
    assert got["conversion"].content_length == len(got["conversion"].block.encode())
    assert f"title: {want}\r\n" in got["metadata"].block
