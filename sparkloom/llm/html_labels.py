"""The labelled table of the HTML extractor: small invented pages in which `data-keep` marks the main text.

`data-keep` on an element labels all blocks in it; blocks without it are boilerplate. Further copies of the
pages, made by rule, differ in the length and links of their texts and in what surrounds an article.
"""

_LONG = "The river had risen during the night and by morning the lower road was under water, so the market moved up to the square beside the old mill."
_MORE = "Traders who came by boat tied up at the bridge, and people who came on foot waited for the ferry until it could cross again in the afternoon."
_LINKS = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "Weather", "Travel", "Contact us"))

#: Pages whose elements say what is the main text, whatever its length.
_STRUCTURED = (
    f'<html><head><title>Flood</title><style>p{{}}</style></head><body><nav><ul>{_LINKS}</ul></nav><div class="ad">Buy two lamps and get one free today.</div><article data-keep><h1>Flood in the valley</h1><p>{_LONG}</p><p>It rained.</p><p>{_MORE}</p><p>No one was hurt.</p></article><footer>&copy; The Valley Post. All rights reserved. Written and printed in the valley since 1902 by its readers.</footer></body></html>',
    f'<body><header><h1>The Valley Post</h1><p>News from here and there</p></header><div class="cookie-notice"><p>We use cookies to remember what you have read, and with whom you share it. By reading on you agree.</p></div><main><article><h2 data-keep>Bridge closed</h2><p data-keep>{_LONG}</p><p data-keep>{_MORE}</p><p data-keep>More <a href="/x">here</a>.</p></article><section class="comments"><h3>Comments</h3><article class="comment"><p>I was there and it was worse than you say, the water came up to the second step of our house.</p></article><p>Great.</p></section></main><aside><h3>Most read</h3><p>{_MORE}</p></aside><footer><p>Contact</p></footer></body>',
    f'<body><form><label>Search the site</label><p>Type a word and press enter to search all our pages at once.</p></form><article data-keep><h1>Rules of the game</h1><ol><li>Each player takes a card.</li><li>The highest card begins.</li></ol><blockquote>{_MORE}</blockquote></article><div role="complementary"><p>{_LONG}</p></div><div style="display:none"><p>{_LONG}</p></div></body>',
    f'<body><div role="banner"><p>Valley radio, the sound of the hills, day and night</p></div><main data-keep><h1>Programme</h1><p>Tonight at eight: songs from the coast.</p><table><tr><td>Nine</td><td>News and weather for the whole of the valley</td></tr></table></main><div class="newsletter-signup"><p>Get our letter with the best of the week every Friday morning.</p></div></body>',
    f'<body><article><header data-keep><h1>The mill</h1></header><div class="ad">Lamps, lamps, lamps: come and see them at our shop.</div><p data-keep>{_LONG}</p><aside><p>Related: the bridge, the ferry, the square.</p></aside><p data-keep>Yes.</p><div class="related"><a href="/a">The bridge</a><p>{_MORE}</p></div><footer><p>Filed under history by the editors of this page</p></footer></article></body>',
    f'<body><div class="notice"><p>This page was moved. Please change your bookmarks to the new address before the end of the year.</p></div><article><p data-keep>{_MORE}</p><p data-keep>Read <a href="/all">all parts of the story</a></p><p><a href="/src">Source of the figures in this text</a></p></article></body>',
    f'<body><ul>{_LINKS}</ul><article data-keep><h1>No.</h1><p>Of.</p></article><div id="disqus_thread"><p>{_MORE}</p></div><p>Printed by the mill press, open all week but Sunday</p></body>',
)

#: Pages whose class names say little of their elements, and articles that hold links of other kinds.
_NAMED = (
    f'<body class="single no-sidebar"><div id="page"><article data-keep><p>{_LONG}</p><p>{_MORE}</p></article></div><div class="sidebar"><p>{_LONG}</p></div></body>',
    f'<body class="has-sidebar privacy"><div class="wrap sidebar-right"><article class="post category-privacy" data-keep><h1>The mill</h1><p>{_MORE}</p><p>{_LONG} {_LONG}</p></article><div class="sidebar-inner"><p>{_MORE}</p></div></div></body>',
    f'<body><main class="with-comments"><article class="hentry comments-open" data-keep><h1><a href="/flood">Flood in the valley</a></h1><p>{_LONG}</p><p>It rained.</p><p>{_MORE}</p></article></main><section class="comments"><article class="comment"><p>I was there and the water came up to the second step of our house.</p></article></section></body>',
    f'<body><header><h1><a href="/">The Valley Post</a></h1></header><article><h1 data-keep><a href="/bridge">Bridge closed</a></h1><p data-keep>{_LONG}</p><p><a href="/more">Read also: how the old bridge over the river was built, who paid for it, and why it had to be closed twice before this year</a></p><p data-keep>{_MORE}</p><ul>{_LINKS}</ul><p data-keep>No one was hurt.</p><div class="related"><h3><a href="/f">The ferry</a></h3></div></article><aside><h3><a href="/top">Most read</a></h3><p>{_LONG}</p></aside><div><h2><a href="/s">The square and the market</a></h2></div></body>',
    f'<body><div><p>{_MORE} {_LONG}</p></div><article data-keep><h1>Flood</h1><p>{_LONG}</p><p>It rained.</p></article><div><p>{_LONG}</p><p>{_MORE}</p></div><p>{_MORE} {_MORE}</p></body>',
    f'<body><article><p data-keep>{_MORE}</p><p><a href="/q">All news of the valley</a></p><p><a href="/r">All news of the hills and of the coast</a></p><p data-keep>{_LONG}</p></article></body>',
    f'<body><article data-keep><h1>Flood</h1><div class="elementor-widget"><p>{_LONG}</p><p>It rained.</p></div><section id="comments-on-the-law"><h2 id="privacy">On privacy</h2><p>{_MORE}</p></section></article><div class="widget"><p>{_LONG}</p></div></body>',
    f'<body><article><h1 data-keep>Flood</h1><div class="widget" data-keep><p>{_LONG}</p><p>{_MORE}</p><p>{_LONG}</p></div><div class="ad-box"><p>Lamps, lamps, lamps.</p></div><section class="comments"><p>{_MORE}</p><p>{_LONG} {_LONG} {_LONG}</p></section></article></body>',
    f'<body><article><p><a href="/z">The valley, the mill, the bridge, the ferry, the square and the market in many old pictures</a></p></article><div><p>Printed by the mill press</p></div></body>',
)

#: Pages in which only the blocks' text tells.
_PLAIN = (
    f'<body><div id="menu"><a href="/">Home</a> <a href="/b">Blog</a></div><div class="content"><div data-keep><h1>How to bake bread</h1><p>{_LONG}</p><p>{_MORE}</p></div><div class="share-buttons">Share this with friends and family on all the networks</div></div><div class="sidebar"><p>{_LONG}</p></div><div class="footer">Imprint and data protection</div></body>',
    f'<body><table><tr><td><a href="/1">One</a></td><td><a href="/2">Two</a></td></tr></table><p data-keep>{_LONG}</p><p data-keep>{_MORE} {_LONG}</p><p data-keep>Then the water <a href="/w">fell</a> and the road was open again to all who wanted to pass.</p><p><a href="/t">Top</a></p></body>',
    f'<body><p><a href="/">Home</a></p><h1 data-keep>A short walk</h1><p data-keep>{_MORE}</p><ul data-keep><li>Bring water and a map of the hills around the lake.</li><li>Start early in the day, before the sun is high and hot.</li></ul><p data-keep>{_LONG}</p><ul>{_LINKS}</ul><p>All rights reserved</p></body>',
    f'<body><header><p>{_MORE}</p></header><div>{_LINKS}</div><div data-keep><p>{_LONG}</p><p>{_LONG} {_MORE}</p></div><p>Copyright</p></body>',
    f'<body><p data-keep>{_LONG}</p><p data-keep>{_MORE}</p></body>',
    f'<body><h1 data-keep>The old mill and its people</h1><p data-keep>{_MORE}</p><p data-keep>{_LONG}</p><p>Imprint</p></body>',
    f'<body class="page has-sidebar"><h2><a href="/">The Valley Post</a></h2><div class="no-sidebar content"><p data-keep>{_LONG}</p><p><a href="/1">What the people of the valley said of the flood, of the bridge and of the ferry in the days that came after it</a></p><p data-keep>{_MORE}</p><p><a href="/2">The ferry</a> | <a href="/3">The bridge</a> | <a href="/4">The old mill beside the square</a></p></div><div class="comments"><p>{_MORE}</p></div></body>',
    f'<body><div><a href="/">Home</a></div><div data-keep><h1>Bread</h1><p>{_LONG}</p><p>Bake it.</p><h2>Then</h2><p>{_MORE}</p><ul><li>Salt</li></ul><p>{_LONG}</p></div><div><p>Imprint</p></div></body>',
    f'<body><p data-keep>{_LONG}</p><p data-keep>Wait.</p><p data-keep>Turn it.</p><p data-keep>{_MORE}</p><h3 data-keep>Last</h3><p data-keep>{_LONG}</p><p>All rights reserved</p></body>',
    f'<body><div data-keep><p>{_MORE}</p></div><div class="ad-box">Lamps for every room and every purse, now at half the price of last year.</div></body>',
)

#: What stands for the two sentences above in further copies of the pages.
_TEXTS = (
    ("Yes.", "Not so."),
    ("It rained all day.", "The boats stayed in."),
    (f"{_LONG} {_LONG} {_MORE}", f"{_MORE} {_MORE} {_MORE} {_LONG}"),
    ('Most of this sentence <a href="/q">is a link that leads to another page</a>', 'A sentence half of which <a href="/h">is a link to a page</a>'),
)
_WORDS = f"{_LONG} {_MORE} {_LONG}".split()
#: Texts of further lengths, in words: prose is prose whatever it has to say.
_LENGTHS = tuple((" ".join(_WORDS[:n]), " ".join(_WORDS[5 : 5 + n + 2])) for n in (14, 17, 20, 24, 33, 48))


def _further(page: str, texts: tuple[tuple[str, str], ...]) -> list[str]:
    return [page.replace(_LONG, a).replace(_MORE, b) for a, b in texts]


def _only_article(page: str) -> list[str]:
    """The article without what surrounds it."""
    at, stop = page.find("<article"), page.rfind("</article>")
    return [f"<body>{page[at:stop]}</article></body>"] if 0 <= at < stop and page.count("<article") == 1 else []


PAGES = tuple(v for p in (*_STRUCTURED, *_NAMED) for q in [p, *_only_article(p)] for v in [q, *_further(q, _TEXTS)]) + tuple(v for p in _PLAIN for v in [p, *_further(p, (_TEXTS[2], *_LENGTHS))])
