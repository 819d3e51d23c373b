"""Main text of pages: cutting, held-out accuracy, whole pages, defined cases."""

from html.parser import HTMLParser

import numpy as np
import pytest

from monthloom.llm import page_text

SMALL = "/root/testdata/sf0.01"


class _Article(HTMLParser):
    """Text of h1 and p elements inside article, one line each."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.lines = False, []
        self.feed(page)
        self.close()
        self.text = "\n".join(x for x in (" ".join(line.split()) for line in self.lines) if x)

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("article", "h1", "p"):
            self.lines.append("")
        if tag == "br":
            self.lines[-1:] = [x + "\n" for x in self.lines[-1:]]

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("h1", "p"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def _texts(page):
    return [b[0] for b in page_text.blocks(page, page_text.Paths())]


@pytest.mark.parametrize(
    "page, texts",
    [
        ("", []),
        ("no markup  at\nall", ["no markup at all"]),
        ("<p>a<p>b<div>c</p>d</div>e", ["a", "b", "c", "d", "e"]),
        ("<p><b>one<br>two<p>three</b> four", ["one two", "three four"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("x<script>var a='</p>';</script>y<style>p{}</style><!-- <p>no</p> -->z", ["xyz"]),
        ("a &amp; b &lt;p&gt; &copy;&#33; &am &amp;lt;", ["a & b <p> ©! &am &lt;"]),
        ("1 < 2 <p title='a > b'>q</p><p title=\"x", ["1 < 2", "q"]),
        ("<p>open<script>never closed <p>x", ["open"]),
        ("<p> a b</p></p></b></article><P>c", ["a b", "c"]),
    ],
)
def test_blocks(page, texts):
    assert _texts(page) == texts


def test_deep_and_long_pages():
    assert _texts("<div>" * 20_000 + "deep" + "</div>" * 20_000) == ["deep"]
    assert len(_texts("<p>x</p>" * 50_000)) == 50_000


@pytest.fixture(scope="module")
def labeller():
    real, texts = page_text._labelled(["<article><h1>A few words</h1><p>More of them, in one line.</article>"])
    drawer = page_text._Drawer(texts * 40, seed=1)
    return page_text.Labeller().fit(real + page_text._labelled([drawer.page() for _ in range(700)])[0])


def test_held_out_layouts(labeller):
    drawer = page_text._Drawer(["Other words were written here today by someone"] * 9, seed=77)
    pages = page_text._labelled([drawer.page() for _ in range(200)])[0]
    x, y = (np.concatenate([p[k] for p in pages]) for k in (0, 1))
    found = labeller.judge(x, np.array([len(p[1]) for p in pages]))
    assert (found == (y == 1))[y >= 0].mean() > 0.97


def test_a_long_page_is_judged_like_a_short_one(labeller, monkeypatch):
    monkeypatch.setattr(page_text, "SLICE", 7)
    drawer = page_text._Drawer(["some words for this page"], seed=5)
    vectors = page_text.Vectors()
    for _ in range(10):
        page = page_text.blocks(drawer.page(), vectors.paths)
        x = vectors.of(page)
        whole = labeller.judge(x, np.array([len(page)]))
        assert (labeller.judge_long(lambda a, b: vectors.of(page[a:b]), len(page)) == whole).all()


def test_learning_follows_the_slope():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (9, page_text.WIDTH)).astype(np.float32)
    y = np.array([1, 0, -1, 1, 0, 0, 1, 1, 0])
    first, length = np.array([0, 5]), np.array([5, 4])
    net = page_text.Labeller(2)

    def loss():
        out = np.full(9, float(net.p["c"][0]))
        for side, start, step in net._sides(first, length):
            p = {k[1:]: v for k, v in net.p.items() if k[0] == side}
            out += page_text._scan(x @ p["w"] + p["b"], p["u"], start, step, page_text._active(length)) @ p["v"]
        known = y >= 0
        return float(np.log1p(np.exp(np.where(y == 1, -out, out)))[known].sum() / known.sum() * 20)

    grads = net._gradients(x, y, first, length)
    for name in net.p:
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        above = loss()
        net.p[name][at] = old - 1e-2
        assert grads[name][at] == pytest.approx((above - loss()) / 2e-2, rel=0.02)
        net.p[name][at] = old


def test_query_finds_every_article(spark):
    rows = page_text.op12_recurrent_page_text(spark, SMALL).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    assert [r.page_id for r in rows if r.text != _Article(pages[r.page_id]).text] == []
    assert all(r.n_chars == len(r.text) for r in rows)


def test_defined_cases(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, k0 int"
    good = (
        '<body><nav><a href="/">Home</a></nav><article><h1>Title</h1><p>First words of a page.'
        '<p>Second.</article><div class="comments"><p>I disagree with this page.</p></div>'
        '<form><button>Send</button></form><footer>&copy; Someone</footer>'
    )
    rows = [(1, "u", good), (1, "u", good), (None, None, good), (2, "u", None), (3, None, ""), (4, "v", "<nav>Home")]
    long = "<article>" + "<p>A line of text that goes on.</p>" * 6000 + "</article><footer>end</footer>"
    rows.append((5, "w", long))
    frame = spark.createDataFrame([(*r, "other", 3, 1) for r in rows], schema)
    found = sorted(tuple("" if x is None else x for x in r) for r in page_text.extract(frame).collect() if r.page_id)
    text = "Title\nFirst words of a page.\nSecond."
    assert found[:2] == [(1, "u", text, len(text))] * 2
    assert found[2:5] == [(2, "u", "", 0), (3, "", "", 0), (4, "v", "", 0)]
    assert found[5][2].split("\n") == ["A line of text that goes on."] * 6000
    assert page_text.extract(frame.limit(0)).collect() == []
