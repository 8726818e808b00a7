"""Anchors of pages that regular expressions misread."""

from cosecha.sources import links


def test_quotes_entities_nesting_and_what_is_no_page(spark):
    html = """<p><a href='/x?a=1&amp;b=2'> uno <b> dos</b></a><a name=n>kein</a><A HREF=/bare>x</A><!-- <a href="/c">c</a> --><script>'<a href="/s">s</a>'</script>
    <table><tr><td> 5 de <i>enero</i><td><table><tr><th>in</th><td><a href="/inner">i</a></table><a href="/outer">o</a></tr><tr><td><a href="/alone">a</a></table><a href="/open">left open"""
    rows = spark.createDataFrame([(1, html), (2, None), (3, "no links"), (4, "<a href>e</a><a href=''>f")], "page_id long, html string")
    got = [(r["page_id"], r["place"], r["href"], r["text"], r["label"], r["cell"], r["cells"], r["first"]) for r in links.page_anchors(rows).orderBy("page_id", "place").collect()]
    assert got == [
        (1, 0, "/x?a=1&b=2", "uno  dos", "unodos", None, None, None),
        (1, 1, "/bare", "x", "x", None, None, None),
        (1, 2, "/inner", "i", "i", 1, 2, "in"),
        (1, 3, "/outer", "o", "o", 1, 2, "5 deenero"),
        (1, 4, "/alone", "a", "a", 0, 1, "a"),
        (1, 5, "/open", "left open", "left open", None, None, None),
        (4, 0, "", "f", "f", None, None, None),
    ]
