import base64
import hashlib
import io
from collections import Counter

import pytest

from rowecho.llm import warc, wrappers
from tests.llm import cases

MENU = '<div class="main-menu">Home News</div>'
END = "<div>Copyright Foo</div></body></html>"


def test_main_text_by_a_wrapper_of_the_host(spark):
    pages = [
        (1, "http://x.org/a", f'<html><body>{MENU}<div id="content"><h2>Title one</h2><p>Some long text &amp; more of it here.</p>'
         f'<p>Second <a href=x>link</a> para graph is long.</p></div><div class="comments"><p>nice</p></div>{END}'),
        (2, "http://X.org/b", f'<html><body>{MENU}<div id="content"><h2>Title two</h2><p>Other long text here\n and there again.</p>'
         f"<ul><li>one item<li>two item</ul></div><div class='comments'><p>bad</p><p>worse</p></div>{END}"),
        (3, "http://x.org:80/c", f'<html><body>{MENU}<div class="cookie-banner">We use cookies</div><div id="content"><h2>Title three</h2>'
         f"<p>Third long text here and there again.</p></div>{END}"),
        (4, None, None), (5, "nohost", ""), (6, "http://y.org", "plain   text only &lt;b&gt;"),
        (7, "http://z.org/q", '<p>Unclosed <script>var a="</p>"</script><p>next<form>x<input></form>'), (None, "http://w.org/r", "<p>abc"),
        (8, "http://v.org", "<nav>menu</nav><article><header><h1>T</h1></header>" + "<p>word " * 3000 + "</article><footer>f</footer>"),
        (8, "http://v.org", "<article><p>twice<br>broken</p></article>"),
    ]
    rows = [(*p, "clash", "clash", "clash") for p in pages]
    got = Counter((r.page_id, r.text) for r in wrappers.extract(spark.createDataFrame(rows, cases.PAGES)).collect())
    assert got == Counter({
        (1, "Title one Some long text & more of it here. Second link para graph is long."): 1,
        (2, "Title two Other long text here and there again. one item two item"): 1,
        (3, "Title three Third long text here and there again."): 1,
        (4, ""): 1, (5, ""): 1, (6, "plain text only <b>"): 1, (7, "Unclosed next"): 1, (None, "abc"): 1,
        (8, "T" + " word" * 3000): 1, (8, "twice broken"): 1})
    assert wrappers.extract(spark.createDataFrame([], cases.PAGES)).count() == 0


def test_wrappers_do_not_depend_on_how_they_are_aligned(spark, monkeypatch):
    rows = [(i, "http://h.org/x", f"<html><body>{MENU}<article><h1>t{i}</h1>" + f"<p>text {i}</p>" * (1 + i % 3)
             + ("<ul><li>x" + str(i) + "</ul>" if i % 4 == 0 else "") + ("<blockquote>q" + str(i) + "</blockquote>" if i % 5 == 0 else "")
             + f"</article>{END}", "", "", "") for i in range(40)]
    pages = spark.createDataFrame(rows, cases.PAGES)
    whole = Counter(tuple(r) for r in wrappers.extract(pages).collect())
    monkeypatch.setattr(wrappers, "PARTIAL", 2)
    assert Counter(tuple(r) for r in wrappers.extract(pages).collect()) == whole
    assert all(text.startswith(f"t{i} text {i}") and "Copyright" not in text for i, _, text, _ in whole)


def test_every_template_of_a_host_has_main_text(spark):
    bodies = {"article": "<article><p>{}</p></article>", "main": "<main><p>{}</p></main>", "div": "<div><p>{}</p></div>",
              "table": "<table><tr><td>{}</td></tr></table>"}
    rows, want = [], {}
    for host, kinds in (("a.org", ["article"] * 30 + ["main", "div", "table"] * 2), ("b.org", ["div"] * 30 + ["table"] * 5),
                        (None, ["article"] * 9 + ["table"] * 4 + ["div"] * 4)):
        for i, kind in enumerate(kinds):
            own = f"{kind} page {i} has this text of its own {'word ' * (20 + i)}".strip()
            want[len(rows)] = own
            rows.append((len(rows), host and f"http://{host}/{i}", f"<html><body>{MENU}{bodies[kind].format(own)}{END}", "", "", ""))
    # no main text at all: what every page says does not become one
    want[len(rows)] = ""
    rows.append((len(rows), "http://a.org/empty", f"<html><body>{MENU}{END}", "", "", ""))
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, cases.PAGES)).collect()}
    assert got == want


def test_copies_of_a_page_are_no_template(spark):
    def page(body):
        return f"<html><body>{MENU}<article>{body}<h4>Share this</h4></article>{END}"

    own = page("<p>some text that only this page has</p><blockquote>and a quote of its own</blockquote>")
    alike = [page(f"<p>text {i} of the near copies</p><pre>with the same code</pre>") for i in range(4)]
    html = [page(f"<p>page {i} says something else {'word ' * i}</p>") for i in range(12)] + [own] * 30 + alike
    rows = [(i, "http://c.org/x", h, "", "", "") for i, h in enumerate(html)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, cases.PAGES).repartition(5)).collect()}
    assert all(got[i] == f"page {i} says something else {'word ' * i}".strip() for i in range(12))
    assert all(got[i] == "some text that only this page has and a quote of its own" for i in range(12, 42))
    assert all(got[42 + i] == f"text {i} of the near copies with the same code" for i in range(4))


def test_repeated_and_optional_parts():
    fold = wrappers.parse("<ul><li>a<li>b<li>c</ul><dl><dt>x<dd>y<dt>z<dd>w</dl>").key
    assert fold == "(ul(li(#)+),dl(*(dt(#),dd(#))+))"
    one, two = (wrappers.parse(p) for p in ("<div><p>a</p><h2>b</h2></div>", "<div><p>a</p><p>c</p></div>"))
    trees = [wrappers.page_of(wrappers.skeleton_of(t), [None] * 2, [1] * 2, 1) for t in (one, two)]
    div = wrappers.align(*trees).children[0]
    assert [(c.name, c.repeated, c.optional) for c in div.children] == [("p", True, False), ("h2", False, True)]


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("least", [0, 10])
def test_archives_round_trip(spark, least):
    pages = [(1, "http://a/1", "<p>same page</p>"), (2, "http://a/2 x\ny", "<p>same page</p>"), (7, None, "<p>same page</p>"),
             (3, "http://a/3", None), (4, "http://a/4", ""), (5, "http://a/5", "é\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://a/6", "<p>same page</p>"),
             (6, "http://a/6", "x" * 300000), (8, "http://a/8", "alone"), (8, "http://a/8", "alone"), (None, "u", "nameless")]
    rows = [(*p, "clash", "clash", "clash") for p in pages]
    got = Counter(tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, cases.PAGES).repartition(3), least).collect())
    want = Counter()
    for page_id, _, html in pages:
        data = (html or "").encode()
        equal = [i for i, _, h in pages if (h or "").encode() == data and i is not None] or [None]
        last = max(equal) if equal[0] is not None else None
        revisit = len(data) >= least and page_id != last
        want[page_id, len(data), sha(data), "revisit" if revisit else "response", last if revisit else None] += 1
    assert got == want
    assert warc.round_trip(spark.createDataFrame([], cases.PAGES)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_archive_files_of_both_versions(version):
    blocks = [warc.http_response(3, b"<p>x</p>"), b"no http\n\n", b""]
    data = warc.arc_version_block(version, "f") + b"\n" + b"".join(
        warc.arc_record(version, "f", f"http://h/a b{i}", b) + b"\n" for i, b in enumerate(blocks))
    got = list(warc.read_arc(io.BytesIO(data)))
    assert [b for _, b in got] == blocks and got[0][0]["URL"] == "http://h/a%20b0" and got[0][0]["Archive-date"] == warc.CRAWLED
    assert warc.split_http(blocks[0])[1] == b"<p>x</p>" and warc.split_http(blocks[1]) == (b"", blocks[1])
    assert warc.header_of(warc.split_http(blocks[0])[0], "x-page-id") == "3"
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[:-5].replace(b"no http", b"no"))))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"filedesc://f 0 1 text/plain 10\n3 0 x\nA B\n")))
    assert warc.warc_date("1997") == "1997-01-01T00:00:00Z"
