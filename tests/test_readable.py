import re
from html import unescape

import pytest

from civicmesh.functions.readable import readable, with_markdown

LONG = "These words make up a paragraph, which is long enough to count as content of its own."


def test_structure():
    page = f"""<html><head><title>no</title><script>var a = "<p>x</p>";</script></head><body><nav><a href=/a>Menu</a></nav>
    <div class="side ad">{LONG} Buy.</div><main><h2>A <b>head</b></h2><p>{LONG} <a href="/x">link</a> &amp; <em>more</em><br>end
    <p>Second, unclosed: {LONG}<ul><li>one<li>two <ul><li>inner</ul></ul><ol><li>first</li><li>second</li></ol>
    <pre>a  b
      c</pre><blockquote><p>{LONG}</p></blockquote><img src='foo.png'><svg><text>no</text></svg></main><footer>foot, foot, foot {LONG}</footer></body></html>"""
    got = readable(page)
    want = [f"## A head", f"{LONG} [link](/x) & _more_ end", f"Second, unclosed: {LONG}", "- one\n- two\n  - inner", "1. first\n2. second", "```\na  b\n      c\n```", f"> {LONG}"]
    for part in want:
        assert part in got, (part, got)
    assert [p for p in ("Menu", "Buy", "foot", "foo.png", "no</", "var") if p in got] == []
    assert got.index("Second") < got.index("- one") < got.index("1. first") < got.index("```")


def test_links_are_no_content():
    links = "".join(f'<p><a href="/{i}">{LONG}</a></p>' for i in range(9))
    got = readable(f"<div>{links}</div><div><p>{LONG}</p><p>{LONG} again</p></div>")
    assert got == f"{LONG}\n\n{LONG} again"


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<h1>Hello World</h1><p>Some content here.</p>", "# Hello World\n\nSome content here."), ("</div></p>x<b>", "x"), ("<p>a &lt; b &#233;", "a < b é"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc")])
def test_small_and_broken_pages(page, want):
    assert readable(page) == want


def test_deep_and_long_pages():
    assert readable("<div>" * 20_000 + LONG) == LONG
    assert readable(f"<p>{LONG}</p>" * 5_000).count("paragraph") == 5_000


def test_all_pages_against_a_plain_version(spark):
    """In these pages the article is the main part: its words, in order."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.markdown for r in with_markdown(pages.select("page_id", "html")).collect()}
    assert len(got) == pages.count()
    for r in pages.select("page_id", "html").collect():
        article = re.search(r"(?s)<article[^>]*>(.*?)</article>", r.html or "")
        if not article:
            continue
        article = re.sub(r"(?s)<(nav|footer|aside|script|style)\b.*?</\1>|<!--.*?-->", " ", article.group(1))
        words = unescape(re.sub(r"<[^>]*>", " ", article)).split()
        plain = re.sub(r"\]\([^)]*\)", "", re.sub(r"(?m)^\s*(?:#+|-|>|\d+\.) ", "", got[r.page_id]))
        assert re.sub(r"[*_\[\]`]", "", plain).split() == [w for w in re.sub(r"[*_\[\]`]", "", " ".join(words)).split()], r.page_id


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "<p>x", "old", None), (None, None, "y", 2)], "id long, html string, markdown string, n int")
    out = with_markdown(df)
    assert out.columns == ["id", "n", "markdown"] and {tuple(r) for r in out.collect()} == {(1, None, "x"), (None, 2, "")}
    assert with_markdown(df.limit(0)).count() == 0
