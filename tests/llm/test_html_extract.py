"""HTML extraction: block rules, labelled pages, hostile input."""

import random

from sparkloom.llm.html_extract import FEATURES, blocks, extract_text, features, main_text, tree
from sparkloom.llm.html_labels import PAGES

SCHEMA = "page_id bigint, url string, html string, text string"


def test_the_tree_knows_its_labels():
    for p in PAGES:
        found = blocks(p)
        assert tree().predict(features(found)).tolist() == [b.keep for b in found]


def test_an_article_and_what_is_not():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></ul></nav>
    <!-- ad <p>no</p> --><div class=ad>Buy it.</div><article><h1>Caf&eacute; &amp; bar</h1><p><b>One\n two&nbsp;three.<br>four<p>Five &#x41;.</p><p> </p></article><footer>&copy; x</footer>"""
    assert main_text(page, tree()) == "Caf\u00e9 & bar\n\nOne two three. four\n\nFive A."


def test_hostile_input():
    for page in ("", "<", "<p", "text", "<p>" * 3000, "<div>" * 3000 + "x", "<a href=\"" * 2000, "</p></div>", "<script>x", "<!-- x", "&#xFFFFFFFF; &bogus;", "<nav>" + "x " * 50000):
        assert isinstance(main_text(page, tree()), str)
    long = "<article>" + "<p>word word</p>" * 20000 + "</article>"
    assert main_text(long, tree()).count("word") == 40000


def test_frame(spark):
    rows = [(1, "u", "<article><p>Hi there.</p></article>", "x"), (2, None, None, None), (1, "u", "<article><p>Hi there.</p></article>", "x"), (None, "v", "", "y")]
    out = extract_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id or 0, r.text) for r in out) == [(0, ""), (1, "Hi there."), (1, "Hi there."), (2, "")]
    assert extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_elements_without_a_closing_tag_hide_nothing():
    want = "Some words to read here.\n\nAnd more of them."
    for tag in "button select object canvas audio video svg template datalist noscript".split():
        page = f"<body><{tag} class=x><article><p>Some words to read here.<{tag}><p>And more of them.</article></body>"
        assert main_text(page, tree()) == want, tag
        page = f"<body><{tag}><article><p>Some words to read here.<p>And more of them.<{tag}>gone <{tag}>in</{tag}> gone</{tag}></article></body>"
        assert main_text(page, tree()) == want, tag
    assert main_text("<article><p>Some words to read here.<svg><title>Logo</svg><p>And more of them.</article>", tree()) == want
    assert main_text("<article><p>Some words to read here.<script>'</button>'</script><button><p>And more of them.</article>", tree()) == want
    assert main_text("<article><p>Some words to read here.<p>And more of them.<script>x</article>", tree()) == want


def test_math_and_xmp_are_text():
    page = "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is here.</p><xmp><b>not &amp; bold</b></xmp><p>The words after it.</p></article>"
    assert main_text(page, tree()) == "The sum a+b is here.\n\n<b>not &amp; bold</b>\n\nThe words after it."


def test_many_unclosed_elements():
    page = "<article>" + "<p>word <button>" * 5000 + "<svg><title>" * 500
    assert main_text(page, tree()).count("word") == 5000


def test_the_tree_goes_by_link_density():
    used, nodes = set(), [tree()]
    while nodes:
        node = nodes.pop()
        if node.low:
            used.add(FEATURES[node.feature])
            nodes += [node.low, node.high]
    assert {"words", "link_density"} <= used and any(f.startswith(("words_", "link_density_")) for f in used)


def test_names_of_what_holds_the_page_hide_nothing():
    text = " ".join(f"word{i}" for i in range(40))
    for page in (
        f'<body class="single no-sidebar"><div id="page"><article><p>{text}</article>',
        f'<body class="has-sidebar privacy"><article><p>{text}</article>',
        f'<body><div class="sidebar-right"><article class="post category-privacy"><p>{text}</article></div>',
        f'<main class="comments-open"><article class="hentry comments-open"><p>{text}</article></main>',
        f'<article class="hentry comments-open"><p>{text}</article><section class="comments"><article class="comment"><p>{text}</article></section>',
        f"<article><p>{text}<p><a href=/x>{text}</a></article>",
        f"<body><div><p>{text}</div><div><p><a href=/x>{text}</a></div>",
        f'<body class="no-sidebar"><div class="content"><p>{text}</div><div class="sidebar"><p>{text}</div>',
    ):
        assert main_text(page, tree()) == text, page


def test_pages_without_an_article():
    """Against the plain rule for pages of one column: paragraphs of prose, without boxes and lists of links."""
    rng = random.Random(4)
    for _ in range(40):
        page, want = ["<body>"], []
        for _ in range(rng.randint(2, 8)):
            text = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(20, 60)))
            kind = rng.choice(["prose", "prose", "menu", "box", "link"])
            if kind == "prose":
                want.append(text)
                page.append(f"<p>{text}</p>")
            elif kind == "menu":
                page.append("<ul>" + "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(5)) + "</ul>")
            elif kind == "box":
                page.append(f'<div class="{rng.choice(["ad", "sidebar-left", "cookie-notice", "site-footer", "post-comments"])}"><p>{text}</p></div>')
            else:
                page.append(f"<p><a href=/x>{text}</a></p>")
        assert main_text("".join(page), tree()) == "\n\n".join(want)


WORDS = " ".join(f"word{i}" for i in range(22)), " ".join(f"name{i}" for i in range(22))
TOPICAL = "elementor-widget widget-content privacy-law search-algorithms menu-items social-history share-prices login-security legal-analysis comments-on-the-law related-works adverse tagline footerless no-comments has-ads".split()


def test_ordinary_class_names_hide_nothing():
    one, two = WORDS
    for name in [*TOPICAL, "widget", "notice", "alert"]:  # the last three hold most of the article
        for page in (
            f'<article><h1>T</h1><div class="{name}"><p>{one}</p><p>{two}</p></div></article>',
            f'<article class="{name}"><h1>T</h1><p>{one}</p><p>{two}</p></article>',
            f'<body class="{name}"><nav class=x>Menu</nav><article><h1>T</h1><section class="{name}"><p>{one}</p><p>{two}</p></section></article><footer>x</footer>',
        ):
            assert main_text(page, tree()) == f"T\n\n{one}\n\n{two}", page
    for name in TOPICAL:  # a small part of the article, too
        page = f'<article><h1>T</h1><p>{one}</p><p>{two}</p><div class="{name}"><p>Three more words.</p></div></article>'
        assert main_text(page, tree()) == f"T\n\n{one}\n\n{two}\n\nThree more words.", page


def test_ids_of_headings_and_topics_are_anchors():
    one, two = WORDS
    page = f'<article><h1 id="comments">T</h1><p>{one}</p><h2 id="privacy">Privacy</h2><section id="navigation"><p>{two}</p></section></article>'
    assert main_text(page, tree()) == f"T\n\n{one}\n\nPrivacy\n\n{two}"


def test_names_of_small_parts_of_an_article_hide_them():
    one, two = WORDS
    for name in ("ad", "ad-box", "cookie-notice", "newsletter-signup", "sidebar-left", "share-buttons", "related", "notice", "post-comments", "site-footer", "relatedPosts", "commentList"):
        page = f'<article><h1>T</h1><p>{one}</p><div class="{name}"><p>Some words that are no part of it.</p></div><p>{two}</p></article>'
        want = f"T\n\n{one}\n\n{two}" if name != "relatedPosts" else f"T\n\n{one}\n\nSome words that are no part of it.\n\n{two}"
        assert main_text(page, tree()) == want, name
    comments = f'<article><h1>T</h1><p>{one}</p><section class="comments"><div class="widget"><p>{two}</p></div><p>{two} {one} {two}</p></section></article>'
    assert main_text(comments, tree()) == f"T\n\n{one}"


def test_the_largest_of_equal_articles_is_the_first():
    one, two = WORDS
    page = f'<div class="related"><article><p>{one}</p></article></div><article class="comments"><p>{two}</p></article><article class="comments"><p>{one}</p></article>'
    assert main_text(page, tree()) == two


def test_short_paragraphs_between_prose():
    one, two = WORDS
    assert main_text(f"<body><div><p>{one}</p><p>Bake it.</p><p>{two}</p></div>", tree()) == f"{one}\n\nBake it.\n\n{two}"


def test_closing_tags_of_nothing_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert main_text("<article><p>Some words to read here.</p>" + "<div>" * n + "</ul>" * n + "</div>" * n + "</article>", tree()) == "Some words to read here."
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 25 * max(seconds(8_000), 0.02)


class Reader:
    """A plain extractor over a tree of elements: the article's blocks, or those of prose where no article is."""

    AWAY = {"nav", "aside", "footer", "form", "script", "style"}
    NAMES = {"ad", "sidebar", "comments", "cookie-notice", "newsletter"}

    def __init__(self, page):
        from html.parser import HTMLParser

        self.out = []
        reader, path = self, []

        class Parser(HTMLParser):
            def handle_starttag(self, tag, attrs):
                path.append((tag, dict(attrs).get("class", "")))

            def handle_endtag(self, tag):
                assert path.pop()[0] == tag

            def handle_data(self, data):
                if text := " ".join(data.split()):
                    away = any(t in reader.AWAY or c in reader.NAMES for t, c in path)
                    reader.out.append((text, away, any(t == "article" for t, _ in path), any(t == "a" for t, _ in path)))

        Parser(convert_charrefs=True).feed(page)

    def text(self):
        has = any(a for _, _, a, _ in self.out)
        return "\n\n".join(t for t, away, article, link in self.out if not away and (article if has else not link))


def generated(rng):
    """A page whose blocks are single paragraphs or lists of links, with or without an article."""
    prose = lambda: " ".join(rng.choice(["river", "mill", "&amp;", "bridge", "caf&eacute;", "x"]) for _ in range(rng.randint(16, 60)))
    own = lambda: "".join(rng.choice([f"<p>{prose()}</p>", f"<div class='{rng.choice(TOPICAL)}'><p>{prose()}</p></div>", f"<blockquote>{prose()}</blockquote>"]) for _ in range(rng.randint(2, 6)))
    box = lambda: rng.choice([f"<div class='{rng.choice(sorted(Reader.NAMES))}'><p>Words of {rng.randint(1, 9)} other things.</p></div>", "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav>", "<aside><p>Aside of it all.</p></aside>", "<form><p>Search here</p></form>", "<script>var x = 1</script>"])
    boxes = lambda: "".join(box() for _ in range(rng.randint(0, 3)))
    if rng.random() < 0.6:
        inner = f"<h1>Of the river</h1>{own()}{boxes()}{own()}{boxes()}"
        return f"<html><body>{boxes()}<article>{inner}</article>{boxes()}<footer><p>Printed here.</p></footer></body></html>"
    return f"<html><body>{boxes()}<div>{own()}{boxes()}{own()}</div>{boxes()}<footer><p>Printed here.</p></footer></body></html>"


def test_generated_pages_against_a_plain_reader():
    rng = random.Random(11)
    for _ in range(400):
        page = generated(rng)
        assert main_text(page, tree()) == Reader(page).text(), page
