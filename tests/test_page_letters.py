"""Letters of pages beside character references."""

from __future__ import annotations

import re

import __spark_entry__

QUERIES = __spark_entry__.queries()


def test_letters_beside_references(spark, tmp_path):
    pages = {
        1: "<h1>Cut off &amp</h1><p>Next &amp; last</p>",
        2: "<p>Fish &am<b>p; chips</b></p>",
        3: "<title>a &amp</title><style>p{margin:0}</style><script>var t=\"</p>\";</script><p>to;fro &lt;b&gt; &#65; x</p>",
        4: "<p>R&D &x;y;z &<b>q</b></p>",
    }
    spark.createDataFrame(list(pages.items()), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {}
    for k, h in pages.items():
        h = re.sub(r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "", h)
        want[k] = len(re.sub("&[a-z]+;|&#[0-9]+;|[^a-zA-Z]", "", re.sub("(?s)<[^>]*>", "", h)))
    assert {r.page_id: r.n_letters for r in QUERIES["page_texts"](spark, str(tmp_path)).collect()} == want
