import html
import re

import numpy as np

from marlstone.llm import boosting, htmltext


def test_held_out_blocks():
    tree, right, total = htmltext.model(), 0, 0
    for page in htmltext.labelled_pages(seed=99, n=200):
        found = htmltext.blocks("".join(h for _, h in page))
        labels = [x for x, _ in page if x is not None]
        assert len(found) == len(labels)
        if found:
            right += ((boosting._apply(tree, htmltext.features(found)) > 0) == np.array(labels, bool)).sum()
            total += len(labels)
    assert right / total > 0.97, right / total


def test_pages():
    tree = htmltext.model()
    read = lambda x: htmltext.main_text(x, tree)
    assert read("") == ""
    page = """<html><head><title>T</title><script>var a="<p>x</p>"</script></head><body class="post sidebar-left"><header><a href=/>Home</a> My site</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies to make this site work well for you.</p></div>
    <article><h1>A  &eacute;t&eacute;&nbsp;title</h1><p>First <b>para</b>graph &amp; more<br>text of the article that is long enough.<p>Second one.
    <div class="ad-slot">Buy now, it is very cheap today.</div><ul><li>Point one.</li><li>Point two.</li></ul><!-- no --></article>
    <section id="comments"><article class="comment"><p>Nice post, I like it very much indeed, thanks to all of you.</p></article></section>
    <aside><p>Related things to read in the long evening.</p></aside><form><label>Name</label><input><p>Send us your name.</p></form><footer>&copy; 2024 Me</footer>"""
    assert read(page) == "A été title\n\nFirst paragraph & more text of the article that is long enough.\n\nSecond one.\n\nPoint one.\n\nPoint two."
    assert read("<article><p>" + "word. " * 200000 + "</p></article>").count("word") == 200000
    assert read("<article><p>x < y and a > b.</p><p title='a>b'>ok.</p></article>") == "x < y and a > b.\n\nok."
    assert isinstance(read("<p " * 3000 + '"'), str)


def test_table(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.page_id: r.text for r in htmltext.op5_html(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(rows) == len(pages)
    right = 0
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        right += rows[p.page_id] == "\n\n".join(x for x in parts if x)
    assert right >= 0.98 * len(pages), (right, len(pages))
    odd = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>", "y"), (1, "u", None, "x")], "page_id long, url string, html string, text string")
    assert sorted(map(str, htmltext.extract(odd).collect())) == sorted(["Row(id=1, url='u', text='')"] * 2 + ["Row(id=None, url=None, text='')"])
    assert htmltext.extract(odd.limit(0)).count() == 0
