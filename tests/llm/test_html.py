"""The reader against pages whose main text is known because they are built from it."""

import random
import time

from pyspark.sql import functions as F

from patchlake.llm import html

WORDS = "alpha beta gamma delta omega straße niño über naïve river stone 42 letter".split()
#: Parts of a page that are no main text; # is a run of words.
OTHER = [
    "<nav><ul><li><a href=/>#</a><li><a href=/x>#</a></ul></nav>", "<div class='ad-banner'>#</div>", "<aside><p>#</p></aside>", "<div id=cookie-notice>#<button>#</button></div>", "<form action=/>#<input name=q><label>#</label></form>",
    "<script>var a = '<p>#</p>';</script>", "<style>p { margin: 0 } /* # */</style>", "<!-- <p>#</p> -->", "<section class='comments'><h3>#</h3><p>#</p><article class=comment><p>#</p></article></section>", "<div class='siteHeader'><p>#</p></div>",
    "<div class='related-posts'><a href=/a>#</a></div>", "<footer><p>#</p></footer>", "<noscript>#</noscript>", "<div role=navigation>#</div>", "<div class='newsletter-signup'>#</div>", "<ul class='breadcrumbs'><li>#</li></ul>",
    "<select><option>#<option>#</select>", "<select name=s><optgroup label=x><option selected>#</select>", "<button class=b><p>#</button>", "<label class=menu>#</label>", "<a class=advert href=/>#</a>", "<datalist><option>#</datalist>", "<span class=share>#</span>", "<b class=ad>#</b>",
    "<div class=share><a href=/>#</a></div>", "<section id=responses><form>#</form><p>#</p></section>", "<div class='social'><button>#</button></div>",
]
#: Parts of a main text and the blocks they are.
OWN = [
    ("<p>#</p>", 1), ("<p class='related-work'>#", 1), ("<section class='share-prices'><h2>#</h2><p>#</p></section>", 2), ("<div class='login-guide'><p>#</p></div>", 1), ("<ul><li>#<li>#</ul>", 2), ("<blockquote><p>#</p></blockquote>", 1),
    ("<table><tr><td>#<td>#<tr><td>#</table>", 3), ("<pre>#</pre>", 1), ("<h2>#</h2>", 1), ("<dl><dt>#<dd>#</dl>", 2), ("<p><math><mi>#</mi></math></p>", 1), ("<figure><figcaption>#</figcaption></figure>", 1), ("<p><object>#</object></p>", 1),
]


def _page(rng, frame):
    """A page in one of some templates, and its main text."""
    blocks = []

    def run(own):
        words = rng.choices(WORDS, k=rng.randint(6, 25))
        if own:
            blocks.append(" ".join(words) + " & <")
        markup = [w if rng.random() < 0.8 else f"<b>{w[:2]}</b>{w[2:]}" for w in words] if own else words
        return rng.choice([" ", "  ", "\n", "\t ", "&nbsp;", "<br>"]).join(markup) + (" &amp; &lt;" if own else "")

    def filled(part, own):
        first, *rest = part.split("#")
        return first + "".join(run(own) + x for x in rest)

    def junk():
        return "".join(filled(p, False) for p in rng.sample(OTHER, rng.randint(0, 4)))

    head, before = "<!DOCTYPE html><html><head><title>t</title><meta charset=utf-8></head><body>" if rng.random() < 0.8 else "", junk()
    body = "<h1>" + run(True) + "</h1>" if frame != "div" else ""
    for part, _ in rng.choices(OWN, k=rng.randint(2, 9)):
        body += filled(part, True) + (junk() if rng.random() < 0.2 else "")
    n = rng.randint(1, 99)
    wrapped = {"article": f"<article id=p{n}>{body}</article>", "main": f"<main><div class='post-{n}'>{body}</div></main>", "div": f"<div class='wrap'><h1>{{}}</h1><div class='entry post-{n}'>{body}</div></div>", "bare": body}[frame]
    if frame == "div":
        title = run(True)
        blocks.insert(0, blocks.pop())
        wrapped = wrapped.replace("{}", title)
    return head + before + wrapped + junk() + ("</body></html>" if rng.random() < 0.7 else ""), "\n".join(blocks)


def test_pages_give_the_text_they_are_built_from(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(400):
        frame = ("article", "main", "div", "bare")[k % 4]
        page, want[k] = _page(rng, frame)
        rows.append((k, f"https://{frame}.example.org/{k}", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("path", F.lit("clash"))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def _text(page):
    return html.main_text(page, None)


def test_pages_without_containers_give_all_their_text(spark):
    cases = {"<p>Only.</p><p>Two.</p>": "Only.\nTwo.", "plain &lt;text&gt;": "plain <text>", "<span>hello world</span>": "hello world", "<div><a href=/>all in links</a></div>": "all in links", "": "", "<nav>menu</nav>": "", "a<p>b</article>c": "a\nbc"}
    for page, text in cases.items():
        assert _text(page) == text, page
    rows = [(k, None if k % 2 else "u", p) for k, p in enumerate(cases, 1)] + [(90, None, None), (None, "http://h/", "<p>x"), (91, "http://h/", "<p>x"), (91, "http://h/", "<p>x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted((r["page_id"] or -1, r["text"]) for r in got.collect()) == sorted([*enumerate(cases.values(), 1), (90, ""), (-1, "x"), (91, "x"), (91, "x")])
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_winning_path_of_the_host_decides(spark):
    long = "a very long reader's remark that goes on and on and on and on and on and on"
    rows = [(k, "http://h.org/x", f"<div class=top{k}>t</div><div class='main post-{k}'><p>Text of page {k}, as long as it is.</p></div><div class=low>x</div>") for k in range(6)]
    rows += [(10, "http://H.org/y", f"<div class='main post-10'><p>Short.</p></div><div class=low>{long}</div>"), (11, "http://h.org/z", "<section><p>Another build.</p></section>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text of page 3, as long as it is." and got[10] == "Short." and got[11] == "Another build."


def test_single_rules():
    assert _text("<article><header><h1>T</h1><p>by x</p></header><p>a<h2>3 Comments</h2><p>reader</article><p>z") == "T\na"
    assert _text("<h1 class=page-header>T</h1><p>a<div class=hidden>b</div>") == "T\na\nb"
    assert _text("<p>a</p><script>x</scripty>y</script>b<style>z") == "a\nb"
    assert _text("<p>cut off <a href='x") == "cut off"
    assert _text("<p>one<b>two</p>three") == "onetwo\nthree"
    assert _text("<p>&#72;i&nbsp;&copy &notit; &amp;lt;</p>") == "Hi © ¬it; &lt;"


def test_broken_and_deep_pages_take_linear_time():
    def took(page):
        began = time.process_time()
        p = html.Page(page)
        p.text(p.best()[0])
        return time.process_time() - began

    for unit in ("<div>x", "<div><span>x", "<p><b>x", "<div></b>", "<b><div></b>", "<td>x</td><div>", "<li><div>x", "<header><p>x", "<!", "<a '", '<a "x', "<a <", "</div>", "<table><tr>", "<h2>Comments</h2><div>", "&amp;", "<section class='a b'>y"):
        page = "<b><div>" + unit * (200_000 // len(unit))
        assert took(page) < 12, unit
    assert _text("<div>" * 30_000 + "deep") == "deep"


PROSE = "The measured values differ from those expected by a tenth, which the calibration does not explain. " * 3


def test_inline_elements_end_with_open_blocks_in_them():
    cases = {
        "<article><h1>T</h1><select><option>a<option>b</select><p>Body text</p></article>": "T\nBody text",
        "<body><select><option>EN<option>DE</select><h1>Title</h1><p>Whole page.</p></body>": "Title\nWhole page.",
        "<body><button><p>one</button><p>Body</p><button>x<button>y</button><p>More</p>": "Body\nMore",
        "<body><label class=menu><ul><li>a</ul><p>b</label><p>Body</p>": "Body",
        "<body><a class=ad><p>b</a><p>Body</p>": "Body",
        "<body><p><b>one<p>two</b> three</p>": "one\ntwo three",
        "<body><select><optgroup><option>x</select>Body": "Body",
        "<body><select><div>x</select><p>Body</p>": "Body",
    }
    for page, text in cases.items():
        assert _text(page) == text, page


def test_sections_of_an_article_with_one_word_names_go_by_what_they_hold():
    own = " ".join(PROSE.split())
    for name in ("class=discussion", "id=responses", "id=alerts", "class=social", "class=share", "class='recommended'"):
        assert _text(f"<article><h1>T</h1><p>Lead.</p><section {name}><h2>Head</h2><p>{PROSE}</p></section></article>") == f"T\nLead.\nHead\n{own}", name
        for part in ("<p>short</p>", f"<a href=/>{PROSE}</a>", f"<p>{PROSE}</p><form>f</form>", f"<div class=comment>x</div><p>{PROSE}</p>"):
            assert _text(f"<article><h1>T</h1><p>Lead.</p><section {name}>{part}</section></article>") == "T\nLead.", (name, part)
        assert _text(f"<body><div><h1>T</h1><p>Lead.</p></div><div {name}>{PROSE}</div>") == "T\nLead.", name
        inner = f"<article><p>Lead.</p><div {name}><p>{PROSE}</p><div {name}><a href=/>{PROSE}</a></div></div></article>"
        assert _text(inner) == "Lead.", name


def test_a_first_heading_that_says_comments_is_a_title():
    assert _text("<article><h2>Comments</h2><p>On style.</p><h3>Comments</h3><p>mine</p></article>") == "Comments\nOn style."
    assert _text("<article><h1>T</h1><p>Text.</p><section><h2>3 comments</h2><p>mine</p></section></article>") == "T\nText."
