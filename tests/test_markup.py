"""Binding and cleaning of HTML."""

from pyspark.sql import functions as F

from paperloom.functions import markup as M
from paperloom.operators import records as K


def bound(text, values=None, stamp=None):
    return M.bind(text, values or {}, stamp)


def test_whole_content_is_replaced_and_the_rest_stays():
    text = "<!DOCTYPE html>\n<p  class=x><span data-field=\"a\">x <b><span>y</span></b> z</span>&nbsp;<br/>a < b</P>"
    assert bound(text, {"a": "N<E&W"}) == (text.replace("x <b><span>y</span></b> z", "N&lt;E&amp;W"), ["a"], [], False)


def test_quotes_of_either_kind_and_none():
    for said in ("data-field='a b'", 'data-field="a b"', "class=\"data-field='q'\" data-field='a b'", 'DATA-FIELD="a&#32;b" x'):
        html, filled, skipped, _ = bound(f"<span {said} title='>'>old</span>", {"a b": "new"})
        assert html == f"<span {said} title='>'>new</span>" and filled == ["a b"] and not skipped
    assert bound("<SPAN data-field=a>old</SPAN >", {"a": "1"})[0] == "<SPAN data-field=a>1</SPAN >"


def test_missing_values_are_emptied():
    assert bound('<span data-field="a">A</span><span data-field="b">B</span><span>c</span>', {"b": None}) == ('<span data-field="a"></span><span data-field="b"></span><span>c</span>', [], ["a", "b"], False)


def test_fields_inside_fields_are_told_and_go():
    html, filled, skipped, _ = bound('<span data-field="a">x<span data-field="b">y</span>z</span><span data-field="b">q</span>', {"a": "1", "b": "2"})
    assert html == '<span data-field="a">1</span><span data-field="b">2</span>' and filled == ["a", "b", "b"]


def test_what_is_never_closed():
    assert bound('<div><span data-field="a">x<b>y</div>tail', {"a": "1"})[0] == '<div><span data-field="a">1</div>tail'
    assert bound('<span data-field="a">x</p> y', {"a": "1"})[0] == '<span data-field="a">1'
    assert bound('</span><span data-field="a"/>text', {"a": "1"})[0] == '</span><span data-field="a"/>1text'


def test_comments_scripts_and_styles_have_no_tags():
    text = '<!-- <span data-field="a">x</span> --><script>"<span data-field=\'a\'>"</script><style>a>b{}</style>'
    assert bound(text, {"a": "1"}) == (text, [], [], False)


def test_signature():
    text = '<p><img src=\'old.png\' data-signature alt="x > y"><IMG data-signature="1"/><img src="z"></p>'
    html, _, _, stamped = bound(text, stamp="QUJD")
    new = 'src="data:image/png;base64,QUJD"'
    assert stamped and html == f'<p><img {new} data-signature alt="x > y"><IMG {new} data-signature="1"/><img src="z"></p>'
    html, _, _, stamped = bound(text)
    assert not stamped and html.count('data-sig-anchor="true"') == 2 and html.count(M.ANCHOR) == 2 and html.endswith('<img src="z"></p>') and "data-signature" not in html


def test_clean():
    cases = {
        '<p onclick="x()" class=a>t</p>': "<p class=a>t</p>", "<a href='JavaScript:x' title=b>t</a>": "<a title=b>t</a>", "<img src= javascript:x>": "<img>",
        "a<script>if (a < b) {'</p>'}</script>b<IFRAME src=x><p>in</p></IFRAME>c": "abc", "<b ONLOAD=x>": "<b>", "<p data-on='1'>x &amp; y": "<p data-on='1'>x &amp; y",
        "<script>never closed": "", "<!-- <script>x</script> -->": "<!-- <script>x</script> -->", "": "",
    }
    for text, want in cases.items():
        assert M.clean(text) == want


def test_columns(spark):
    rows = spark.createDataFrame([(1, '<span data-field="a">x</span>', {"a": "1"}), (2, None, {"a": "1"}), (3, "plain", None)], "id long, html string, v map<string,string>")
    found = {r.id: r.b for r in rows.select("id", M.bound(F.col("html"), F.col("v")).alias("b")).collect()}
    assert found[1].html == '<span data-field="a">1</span>' and found[2].html is None and found[3] == ("plain", [], [], False)
    one = rows.select(M.placeholder(F.lit('a"<'), F.lit("L & M"), F.lit("money")).alias("a"), M.placeholder(F.lit("p"), F.lit("L"), F.lit(None).cast("string")).alias("b")).first()
    assert one.a == '<span data-field="a&quot;&lt;" data-field-kind="money">L &amp; M</span>' and one.b == '<span data-field="p">L</span>'
    assert bound(one.a, {'a"<': "v"})[1] == ['a"<']


def test_stored_bodies_are_clean(spark):
    rows = [("t", 1, "<p onclick=x>a</p>", None, None), ("t", 2, "<script>x</script>b", "c", None)]
    updates = spark.createDataFrame(rows, "template_id string, seq long, html string, css string, note string")
    assert K.now(updates).first().html == "b"
    assert [r.html for r in K.revisions(updates).orderBy("seq").collect()] == [None, "<p>a</p>"]
    back = K.restored(updates, spark.createDataFrame([("t", 2, 3)], "template_id string, revision long, seq long"))
    assert K.now(back).first().html == "<p>a</p>"
