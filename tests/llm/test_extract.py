import random
import re
import time
from html import unescape

import pyarrow.parquet as pq
from tessera.llm.extract import extract_main_text, leaf, main_text, path_ratios, read_page

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><div class="cookie-notice">We use cookies, is that fine?</div>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div id="main"><div class="post-content"><h2>A title</h2>
<p>First part, with a <a href=x>link</a> &eacute; and more of it; yes.<p>Second<br>part,
of two   lines.</div><ul class="related"><li><a>One</a><li><a>Two</a></ul><div class="comments"><p>Nice article, thank you, really, I liked it a lot.</p></div></div>
<aside>Side text, longer than anything, by far, as it goes on and on.</aside><form>Name <input></form><footer>(c)</footer><script>var x="<p>no</p>";</script></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE) == "A title\n\nFirst part, with a link é and more of it; yes.\n\nSecond part, of two lines."


def test_plain_and_broken_pages():
    assert main_text(None) == main_text("") == main_text("<script>x") == ""
    assert main_text("<div><p>Some text, of a page. More.</p><p>And more of it, too.</p></div><div><a href=1>Home</a> <a href=2>About</a></div>") == "Some text, of a page. More.\n\nAnd more of it, too."
    assert main_text("<p>a<!-- b") == "a"
    assert len(main_text("<article><p>" + "word, " * 200_000)) > 1_000_000
    main_text("<a " * 20_000)


PROSE = "The text of an article, of some length, with commas, and with sentences. This is one more of them."
MORE = "It goes on with a second part, which says a little more; then it ends."


def test_ratios_decide_inside_articles_too():
    for whole in ("main", "article"):
        page = lambda extra, at=1: f"<body><{whole}><h1>Title</h1>" + "".join([f"<p>{PROSE}</p>", extra, f"<p>{MORE}</p>"] if at == 1 else [f"<p>{PROSE}</p><p>{MORE}</p>", extra]) + f"</{whole}></body>"  # noqa: B023, E731
        want = f"Title\n\n{PROSE}\n\n{MORE}"
        for extra in ('<div class="qz">Buy now!</div>', '<div class="qz"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>', "<ul><li><a href=1>One link</a></li><li><a href=2>Another link</a></li></ul>", "<p><a href=1>All of this is a link, long as it may be, with commas, and more</a></p>"):
            assert main_text(page(extra)) == want, extra
        assert main_text(page('<div class="qz">I agree, thanks!</div>', 2)) == want
        assert main_text(page("<h2>Related</h2><ul><li><a href=1>One link</a></li></ul>", 2)) == want
        assert main_text(page("<ul><li>Plain item</li><li>Another</li></ul>")) == f"Title\n\n{PROSE}\n\nPlain item\n\nAnother\n\n{MORE}"


def test_pages_without_known_names_and_with_misleading_ones():
    page = f'<body><div class="xq"><p>Welcome.</p></div><div class="k7"><h2>A heading</h2><p>{PROSE}</p><p>{MORE}</p></div><div class="zz"><a href=1>a</a> <a href=2>b</a></div></body>'
    assert main_text(page) == f"A heading\n\n{PROSE}\n\n{MORE}"
    for name in ("widget", "comment", "related"):  # names alone don't throw the main text away
        assert main_text(f'<body><div class="{name}"><p>{PROSE}</p><p>{MORE}</p></div><div class="k">Next</div></body>') == f"{PROSE}\n\n{MORE}"
    assert main_text('<body><article> </article><div class="ad">Buy this, and that, and more of it.</div></body>') == ""
    assert main_text(f'<body><div class="content">Go</div><div class="k7"><p>{PROSE}</p><p>{MORE}</p></div></body>') == f"{PROSE}\n\n{MORE}"


def test_path_sums_equal_a_plain_count():
    r = random.Random(3)
    for _ in range(300):
        tags, html, want = [], "", {}
        for _ in range(r.randint(1, 40)):
            if tags and r.random() < 0.4:
                html += f"</{tags.pop().split('.')[0]}>"
            elif r.random() < 0.6:
                name = r.choice(["div.a", "div.b", "section", "blockquote", "div"])
                html += "<" + (f'{name[:3]} class="{name[4:]}">' if "." in name else f"{name}>")
                tags.append(name)
            else:
                text = r.choice(["One, two.", "three", "Four; five, six!"])
                html += f"<hr>{text}<hr>"
                sums = want.setdefault("/".join(tags), [0, 0, 0])
                for k, x in enumerate((len(text), len(re.findall("[.,;!]", text)), 1)):
                    sums[k] += x
        found = [(b, b.text()) for b in read_page(html).done]
        names = {}
        for b, _ in found:
            at, steps = b.path, []
            while at.up:
                steps.append(".".join([at.tag, *at.names]))
                at = at.up
            names[b.path.place] = "/".join(reversed(steps))
        got = {names[k]: [x.chars, x.marks, x.count] for (k, _), x in path_ratios(found, leaf).items()}
        assert got == want, html


def test_articles_of_the_table_are_found_whole():
    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        inner = re.search("<article>(.*)</article>", html, re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:h1|p)>", inner)]
        assert main_text(html) == "\n\n".join(x for x in parts if x)


def test_time_follows_length():
    for form in ("<b>x ", "<div>", "<div class=a>x", "<p>a</b>", "<ul><li>x</i>", "</div>x", "<table><tr><td>"):
        began = time.time()
        main_text(form * 30_000)
        assert time.time() - began < 10, form


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", PAGE), (2, "u", PAGE)], "page_id long, url string, html string").withColumn("text", __import__("pyspark").sql.functions.lit("x"))
    got = sorted((r.page_id, r.n_chars) for r in extract_main_text(pages).collect())
    assert got == [(1, 0), (2, 0), (2, len(main_text(PAGE))), (2, len(main_text(PAGE)))]
    assert extract_main_text(pages.where("1 = 0")).count() == 0
