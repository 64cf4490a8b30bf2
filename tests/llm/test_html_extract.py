import re
from html import unescape

import pytest
from odd_texts import ODD

from loam.llm.html_extract import extract_text

HTML = "page_id long, url string, html string"


BLOCKS = set(
    "p div br hr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot caption tr td th article section header footer nav aside main body head html blockquote pre form fieldset figure figcaption details summary dialog select option "
    "textarea button center address".split()
)


def tag_end(t, i):
    """The place after the tag that begins at i."""
    while i < len(t):
        if t[i] == ">":
            return i + 1
        if t[i] == "=":
            j = i + 1
            while t[j : j + 1] == " ":
                j += 1
            if t[j : j + 1] in ("'", '"') and t.find(t[j], j + 1) >= 0:
                i = t.find(t[j], j + 1)
        i += 1
    return i


def brute(page, window=3, surge=86, dive=20):
    t, out, i = re.sub("[\r\n\t\f\xa0]", " ", page or ""), [], 0
    while i < len(t):
        name = re.match("</?([a-zA-Z][a-zA-Z0-9]*)", t[i:])
        if t.startswith("<!--", i):
            i = t.find("-->", i + 4) + 3 if "-->" in t[i + 4 :] else len(t)
        elif name and t[i + 1] != "/" and name[1].lower() in ("title", "script", "style", "noscript", "template", "iframe"):
            i = tag_end(t, i)
            end = re.search(rf"(?i)</{name[1]}\b", t[i:])
            i = tag_end(t, i + end.start()) if end else len(t)
        elif re.match("<[a-zA-Z/!?]", t[i:]):
            out.append("\n" if name and name[1].lower() in BLOCKS else "")
            i = tag_end(t, i)
        else:
            out.append(t[i])
            i += 1
    # line ends of the page's text are told from those that references give
    t = "\n".join(re.sub("[\n\r\t\f\xa0]", " ", unescape(x)) for x in "".join(out).split("\n"))
    lines = [x.strip(" ") for x in re.sub(" ?\n ?", "\n", re.sub(" +", " ", t)).split("\n")]
    inside, kept = False, []
    for i, x in enumerate(lines):
        s = sum(len(y) for y in lines[i : i + window])
        inside = s >= surge or (inside and s > dive)
        if inside and x:
            kept.append(x)
    return "\n".join(kept), sum(bool(x) for x in lines), len(kept)


LONG = "A sentence that is long enough to be the body of an article, and goes on and on. "
PAGES = ODD + [
    f"<html><head><title>t</title></head><body><nav><ul><li>Home</li><li>About</li></ul></nav><div>{LONG}</div><p>{LONG}</p><p>short</p><p>{LONG}</p><footer>c</footer></body></html>",
    f"<div>{LONG}</div><br><br><br><br><br><div>menu</div><br><br><br><p>{LONG}</p>",
    f"<p>{LONG}<!-- <p>{LONG}</p>", f"<script>var a = '{LONG}'", f"<SCRIPT type=x>{LONG}</SCRIPT ><p>x &amp;lt; y</p>", "<p>" * 2000, f"a < b and <b>{LONG}</b> c > d", "<p" + LONG, f"{'x' * 90}<p>y<p>z<p>{'w' * 17}",
    f"<html><head><title>t</title><body><p>{LONG}<p>{LONG}", f"<p title=\"a > b\" x='>' y = \"q\">{LONG}<a href=it's>{LONG}</a><p class=\"open>{LONG}", f"<title>never closed {LONG}",
    f"<p>&eacute;&#233;&#xE9;&#150;&hellip;&nbsp;&amp;lt;&zzzname;&copy &copy;&#0;&#xD800;&#99999999999;&#x110000;& &;&#;&NewLine;&CounterClockwiseContourIntegral; {LONG}", f"<svg><path d='M0>1'/></svg><table><tr><td>{LONG}<td>{LONG}</table>", f"<p>{LONG}</p" + "<p>" + LONG,
]


@pytest.mark.parametrize("window,surge,dive", [(3, 86, 20), (1, 40, 0), (5, 30, 29)])
def test_text_is_brute_force_s(spark, window, surge, dive):
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(PAGES)], HTML)
    got = {r.page_id: (r.text, r.n_lines, r.n_kept) for r in extract_text(df, window, surge, dive).collect()}
    for i, h in enumerate(PAGES):
        assert got[i] == brute(h, window, surge, dive), h


def test_menus_go_and_articles_stay(spark):
    df = spark.createDataFrame([(1, "u", PAGES[len(ODD)].replace(LONG, LONG * 2))], HTML)
    text = extract_text(df).first().text
    assert text.count(LONG.strip()) == 6 and "Home" not in text


def test_golden_pages(spark):
    body = "The river rose for three days, and on the fourth the bridge at the mill gave way; nobody was on it."
    pages = {
        f"<!DOCTYPE html><title>Floods</title><body><ul><li>Home<li>News</ul><hr><hr><p>{body}<p>{body}": f"{body}\n{body}",
        f"<html><head><meta charset=utf-8><link rel=icon href=x><body><h1>Caf&eacute; &ldquo;Mill&rdquo; &#8212; &#x1F600;</h1><p>{body}</p>": f"Café “Mill” — 😀\n{body}",
        f'<div data-x="1 > 0">{body}</div><script>if (a < b) document.write("<p>{body}</p>")</script>': body,
        f"<p>{body} 3 &lt; 4 &amp;amp; <b>bold</b>ly</p>": f"{body} 3 < 4 &amp; boldly",
    }
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], HTML)
    got = {r.page_id: r.text for r in extract_text(df).collect()}
    assert [got[i] for i in range(len(pages))] == list(pages.values())


def test_very_long_pages(spark):
    html = "<p " + "a='>' " * 20_000 + f">{LONG}</p>" + "<!-- x -->" * 20_000 + f"<p>{LONG * 3000}</p>" + "&amp;" * 20_000
    r = extract_text(spark.createDataFrame([(1, "u", html)], HTML)).first()
    assert (r.n_lines, r.n_kept) == (3, 3) and r.text.startswith(LONG.strip()) and r.text.endswith("&&")


def test_null_ids_repeats_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(None, "u", f"<p>{LONG * 2}</p>")] * 2, HTML).withColumnRenamed("url", "lines")
    assert [(r.page_id, r.n_kept) for r in extract_text(df).collect()] == [(None, 1)] * 2
    assert extract_text(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        extract_text(df, 3, 5, 5)
