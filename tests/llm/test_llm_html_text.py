import html
import re

import numpy as np

from zoneflow.llm import common, html_text

from . import cases


def test_blocks_of_broken_markup():
    page = "<p>one <b>two<br>three<p>four</b> &amp; five<ul><li>six<li>seven</ul></div>tail<!-- no --><script>if (a<b) '</p>'</script> end"
    assert [b[0] for b in html_text.page_blocks(page)] == ["one two three", "four & five", "six", "seven", "tail end"]


def test_unclosed_silent_elements_and_formulas():
    blocks = lambda page: [b[0] for b in html_text.page_blocks(page)]
    assert blocks("<p>one<svg/> two</p><p>three") == ["one two", "three"]
    assert blocks("<p>one</p><button>a<p>two</p><p>three") == ["one", "a", "two", "three"]
    assert blocks("<p>one</p><button>a<p>two</p><button>b</button><p>three") == ["one", "a", "two", "three"]
    assert blocks("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold<script>no") == ["let x=2 hold"]


def test_roles():
    page = "<nav>a</nav><article><p>b</p><div class='comments'><p>c</p></div><aside>d</aside></article><div id=footer>e</div><div class=post-body>f</div>"
    assert {b[0]: b[3] for b in html_text.page_blocks(page)} == {"a": 0, "b": 1, "c": 0, "d": 0, "e": 0, "f": 1}


def test_gradients():
    pages = [html_text.page_blocks(p) for p in ("<nav>a b</nav><article><p>c d, e</p><p>f</p></article>", "<main>g h</main><footer>i</footer>")]
    x, model = html_text.Inputs(pages), html_text.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    hide = np.zeros(len(x.roles), bool)

    def loss():
        logits, _ = model.forward(model.vectors(x), x.sizes)
        return float(np.mean(np.log1p(np.exp(np.where(x.roles == 1, -logits, logits)))))

    grad = model.gradients(x, hide)
    for name, at in (("input", (3, 7)), ("hidden", (0, 2, 5)), ("hidden", (1, 4, 40)), ("out", (3,)), ("word", (x.words[1], 2)), ("path", (x.paths[0], 1)), ("direct", (2,))):
        value, step = model.p[name][at], 1e-3
        model.p[name][at] = value + step
        up = loss()
        model.p[name][at] = value - step
        down = loss()
        model.p[name][at] = value
        assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-4 + 0.02 * abs(grad[name][at]), name


def test_articles_of_the_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in common.table(spark, sf_dir, "pages").collect()}
    rows = html_text.op2_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    same = 0
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        same += r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    assert same >= 0.99 * len(rows)


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<p>x"), (3, "u", "<"), (4, "u", "<nav>a</nav><article>b</article>" * 3), (4, "u", "<article>é &#128578;</article>")]
    pages = spark.createDataFrame(rows, cases.PAGES).selectExpr("*", "'x' as text", "1 as h", "2 as head")
    found = sorted(((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(pages, html_text.fit(pages)).collect()))
    assert len(found) == len(rows) and found[1] == (1, "", 0) and found[2] == (2, "", 0)
    assert html_text.extract(cases.empty(spark, cases.PAGES), html_text.fit(cases.empty(spark, cases.PAGES))).count() == 0
