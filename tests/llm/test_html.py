import re
import time

from listwright.llm.html_extract import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{}</style><script>var a="</p><p>x";</script></head>
<body class="page"><header><a href="/">Site</a><h2>Slogan of the site</h2></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div id="cookie-banner">We use cookies, and this notice is as long as a whole paragraph of the article would be.</div>
<div class="ad">Buy now, cheap and good, more than you ever wanted to buy in your life.</div>
<main><article><header><h1>The  title &amp; more</h1></header>
<p>First   paragraph with <b>bold</b> and&nbsp;an <a href="/x">inline link</a>,<br>after a break &#8211; it is long enough.
<p>Second one, whose end tag is left out, also long enough to count as content.
<ul><li>A point</li><li>Another point with text</li></ul>
<blockquote>Quoted words</blockquote>
<form><input name="q"><button>Send</button> Form words</form>
<p>Short.</p><!-- comment <p>no</p> -->
<section class="comments"><p>A reader wrote a comment of some length, which is no part of the article.</p></section>
</article></main>
<aside><p>Sidebar text that goes on and on, as sidebars do, with many words in it.</p></aside>
<footer>&copy; 2024 Example. All rights reserved, and more such words.</footer></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE).split("\n") == [
        "The title & more",
        "First paragraph with bold and an inline link, after a break – it is long enough.",
        "Second one, whose end tag is left out, also long enough to count as content.",
        "A point", "Another point with text", "Quoted words", "Short."]


def test_region_without_article_element():
    body = "".join(f"<p>Paragraph {i} of the text, which is as long as paragraphs in articles tend to be.</p>" for i in range(6))
    page = f"<body><div class='menu'><a href='/'>Home</a> <a href='/b'>B</a></div><div><div id='story'>{body}</div>" \
           "<div class='footer'>Imprint</div></div></body>"
    assert main_text(page).count("\n") == 5 and main_text(page).startswith("Paragraph 0")


def paragraphs(first, n):
    return "".join(f"<p>Paragraph {i} of the text, which is as long as paragraphs in articles tend to be.</p>"
                   for i in range(first, first + n))


def test_region_holds_the_whole_cluster():
    split = f"<body><div class='menu'><a href='/'>Home</a></div><div><div>{paragraphs(0, 13)}</div><div>{paragraphs(13, 7)}</div></div></body>"
    assert main_text(split).count("Paragraph") == 20
    quote = f"<body><div><blockquote>{paragraphs(0, 13)}</blockquote><p>{'Words beside the quotation. ' * 8}</p></div></body>"
    assert main_text(quote).count("Paragraph") == 13 and "beside" in main_text(quote)
    both = f"<body><main><article>{paragraphs(0, 13)}</article><article>{paragraphs(13, 7)}</article></main><p>Imprint</p></body>"
    assert main_text(both).count("Paragraph") == 20 and "Imprint" not in main_text(both)
    apart = f"<body><article>{paragraphs(0, 13)}</article><p>Imprint</p><article>{paragraphs(13, 7)}</article></body>"
    assert main_text(apart).count("Paragraph") == 20 and "Imprint" not in main_text(apart)


def test_source_lists_stay():
    page = f"<body><nav><ul><li><a href='/'>Menu</a></li></ul></nav><article>{paragraphs(0, 5)}<h2>Sources</h2>" \
           "<ul><li><a href='/s'>The first source of the article</a></li></ul></article></body>"
    assert main_text(page).endswith("Sources\nThe first source of the article") and "Menu" not in main_text(page)


def test_wrappers_are_no_furniture():
    text = f"{paragraphs(0, 6)}<div class='ad'>Buy now, cheap and good, more than you ever wanted to buy.</div>"
    around = "<nav><ul><li><a href='/'>Menu</a></li></ul></nav>{}<div class='footer'>Imprint and more such words</div>"
    for start, end in (("<div class='content has-sidebar'>", "</div>"), ("<div id='page' class='with-banner'>", "</div>"),
                       ("<div class='search-results'>", "</div>"), ("<form>", "</form>"),
                       ("<div class='modal'><div class='overlay'>", "</div></div>")):
        for body in (text, f"<article>{text}</article>", f"<main>{text}</main>"):
            got = main_text(f"<body>{around.format(start + body + end)}</body>")
            assert got.count("Paragraph") == 6 and not {"Menu", "Buy", "Imprint"} & set(got.split())


def test_furniture_longer_than_the_article_goes():
    page = f"<body><div id='story'>{paragraphs(0, 4)}</div><div class='comments'>" \
           f"<article>{paragraphs(10, 9)}</article><article>{paragraphs(20, 9)}</article></div></body>"
    assert main_text(page).count("Paragraph") == 4


def test_nested_marks_are_linear():
    started = time.time()
    main_text("<div class='ad'>" * 20_000 + "words of the page")
    assert time.time() - started < 5


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words"), (None, "u", "<p>a<p>b"), (5, "u", "<![bad <p>x</p>"),
            (6, "u", "<script>never closed"), (6, "u", "<script>never closed"), (7, "u", "&lt;p&gt; &#xD800; &unknown;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(pages).collect()}
    assert {(1, "", 0), (2, "", 0), (3, "plain words", 11), (None, "a\nb", 3), (6, "", 0)} <= got
    assert extract_main_text(pages).count() == 8 and extract_main_text(pages.limit(0)).count() == 0


def test_deep_nesting_is_linear():
    started = time.time()
    main_text("<div>" * 20_000 + "words" + "<li>a" * 20_000)
    assert time.time() - started < 5


def test_given_pages_keep_their_articles(given):
    for r in extract_main_text(given("pages")).limit(50).collect():
        assert r["text"] and len(r["text"]) == r["n_chars"] and "var t" not in r["text"]


AROUND = "<body><nav><a href='/'>Menu</a></nav>{}<footer>Imprint</footer></body>"


def test_titles_and_headings_stay():
    for open_, close in (("<article>", "</article>"), ("<div class='post'>", "</div>"), ("<main>", "</main>")):
        for head in ("<header class='entry-header'><h1>Title</h1></header>", "<div class='post-header'><h1>Title</h1></div>"):
            if "header class" in head and "div" in open_:
                continue  # outside article and main a header element is the page's
            got = main_text(AROUND.format(open_ + head + paragraphs(0, 5) + close))
            assert got.startswith("Title\n") and got.count("Paragraph") == 5 and "Imprint" not in got
        for part in ("<h2 id='search'>Heading</h2>", "<h2 id='related-work'>Heading</h2>"):
            assert "\nHeading\n" in main_text(AROUND.format(open_ + paragraphs(0, 3) + part + paragraphs(3, 3) + close))


def test_names_that_only_hold_a_furniture_word():
    for part in ("<section id='side-effects'><h2>Kept</h2>{}</section>", "<p class='share-price'>Kept</p>{}",
                 "<section class='discussion'><h2>Kept</h2>{}</section>", "<section id='notice-period'><h2>Kept</h2>{}</section>"):
        got = main_text(AROUND.format(f"<article>{paragraphs(0, 4)}{part.format(paragraphs(4, 2))}</article>"))
        assert "Kept" in got and got.count("Paragraph") == 6
    links = "".join(f"<li><a href='/{i}'>Another story of the site</a></li>" for i in range(4))
    got = main_text(AROUND.format(f"<article>{paragraphs(0, 4)}<ul class='related-reading-tips'>{links}</ul></article>"))
    assert got.count("Paragraph") == 4 and "Another" not in got


def test_talk_of_readers_goes():
    said = "<p>I read this with joy, and here is what I think about it, at some length.</p>"
    for talk in (f"<section class='discussion'><div class='comment'>{said}</div></section>",
                 f"<section class='discussion'><h3>12 comments</h3>{said}{said}</section>",
                 f"<section class='responses'>{said}<p><a href='/r'>Reply</a></p></section>"):
        got = main_text(AROUND.format(f"<article>{paragraphs(0, 5)}{talk}</article>"))
        assert got.count("\n") == 4 and "joy" not in got


def test_inline_adverts_go():
    part = "<p>Words before <span class='ad'>Buy <span>this</span> now</span>and after them, which belong together.</p>"
    got = main_text(AROUND.format(f"<article>{paragraphs(0, 3)}{part}{paragraphs(3, 2)}</article>"))
    assert "Words before and after them, which belong together." in got and got.count("Paragraph") == 5
    unclosed = main_text(AROUND.format(f"<article>{paragraphs(0, 3)}<p>Words <span class='ad'>Buy</p>{paragraphs(3, 2)}</article>"))
    assert unclosed.count("Paragraph") == 5 and "Buy" not in unclosed
    code = main_text(AROUND.format(f"<article>{paragraphs(0, 3)}<pre>x = 1 <span class='comment'># one</span></pre></article>"))
    assert code.endswith("x = 1 # one")


def test_text_beside_the_article_stays():
    beside = f"<body><article>{paragraphs(0, 4)}</article><div>{paragraphs(4, 2)}<p>Short.</p></div><p>Imprint</p></body>"
    got = main_text(beside)
    assert got.count("Paragraph") == 6 and got.endswith("Short.")


def test_gold_pages():
    """Token precision and recall over pages that combine the cases."""
    heads = ["<header class='entry-header'><h1>Title words</h1></header>", "<h1 id='header'>Title words</h1>"]
    rests = ["<section id='side-effects'><h2>Effects</h2><p>They are few and mild, and most people notice none.</p></section>",
             "<h2 id='search'>Search</h2><p class='share-price'>The price went up by three points in a week.</p>",
             "<table><tr><td>One cell</td><td>two cells</td></tr></table><blockquote>Said by somebody else.</blockquote>"]
    junk = ["<div class='ad'>Purchase junk</div>", "<div class='cookie-policy-notice'>Junk cookies</div>",
            "<div class='social-media'><a href='/s'>Junk share</a></div>", "<div id='comments-area'><p>Junk opinion of a reader.</p></div>"]
    found = want_all = both = 0
    for head in heads:
        for rest in rests:
            for j in junk:
                for open_, close in (("<article>", "</article>"), ("<main><div>", "</div></main>")):
                    body = head + paragraphs(0, 5) + rest
                    got = main_text(AROUND.format(j + open_ + body + j + close + j)).split()
                    want = re.sub("<[^>]*>", " ", body).split()
                    left = list(got)
                    for w in want:
                        if w in left:
                            left.remove(w)
                            both += 1
                    found, want_all = found + len(got), want_all + len(want)
    assert both >= 0.95 * want_all and both >= 0.95 * found, (both, want_all, found)
