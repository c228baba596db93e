"""Main text of hand-written pages, labelled by hand: none is from the grammar that the network learns from."""

import time

from quillspark.llm import html

#: (page, the main text's blocks, what must not be in it)
PAGES = [
    (
        """<html><head><title>Bridge</title></head><body><div class="content-wrap"><h1>Council approves new bridge</h1><div class="byline">By Jane Doe, 3 May</div>
        <div class="text"><p>The city council voted on Tuesday to approve a new bridge over the river, ending a decade of debate.</p><p>Construction will begin next spring, officials said.</p>
        <ul><li>Cost: 40 million</li><li>Length: 300 metres</li></ul><p>Opponents had argued that the money would be better spent on schools.</p></div></div></body></html>""",
        ["Council approves new bridge", "The city council voted on Tuesday to approve a new bridge over the river, ending a decade of debate.", "Construction will begin next spring, officials said.", "Cost: 40 million", "Length: 300 metres", "Opponents had argued that the money would be better spent on schools."],
        [],
    ),
    (
        """<html><body><table width=100%><tr><td valign=top><a href=/>Home</a><br><a href=/news>News</a><br><a href=/sport>Sport</a><br><a href=/links>Links</a></td>
        <td><h2>A short history of the harbour</h2><p>The harbour was built in 1871 by convict labour.<p>It silted up twice before the war, and was dredged each time at great cost.<p>Today only pleasure boats use it.</td></tr></table></body></html>""",
        ["A short history of the harbour", "The harbour was built in 1871 by convict labour.", "It silted up twice before the war, and was dredged each time at great cost.", "Today only pleasure boats use it."],
        ["Home", "Sport"],
    ),
    (
        """<body><div id="masthead"><h2>The Daily Post</h2><ul><li><a href="/a">World</a></li><li><a href="/b">Money</a></li><li><a href="/c">Travel</a></li></ul></div>
        <div class="story"><h1>Snow closes mountain pass</h1><p>Heavy snow closed the pass on Sunday night.</p><div class="advertisement">Buy tyres now, 20 % off!</div><p>Drivers should take the valley road until Thursday.</p></div>
        <div class="comments"><h3>3 comments</h3><div class="comment"><p>First! I got stuck there for six hours.</p><div class="reply"><p>Same here, terrible.</p></div></div></div>
        <div class="footer"><p>&copy; 2021 The Daily Post. All rights reserved.</p></div></body>""",
        ["Snow closes mountain pass", "Heavy snow closed the pass on Sunday night.", "Drivers should take the valley road until Thursday."],
        ["Buy tyres", "First!", "terrible", "rights reserved", "Money"],
    ),
    (
        """<html><head><title>Soup</title></head><body><nav><a href=/>Start</a> <a href=/r>Recipes</a></nav><main><article><h1>Lentil soup</h1><p>Serves four people.</p><h2>You need</h2><ul><li>two onions</li><li>300 g red lentils</li></ul>
        <h2>Steps</h2><ol><li>Chop the onions and fry them slowly.</li><li>Add the lentils and a litre of water; simmer for half an hour.</li></ol></article><aside><h3>More recipes</h3><ul><li><a href=/1>Pea soup</a></li><li><a href=/2>Borscht</a></li></ul></aside></main>
        <form><p>Get our newsletter</p><button>Sign up</button></form><footer>Imprint and privacy</footer></body></html>""",
        ["Lentil soup", "Serves four people.", "You need", "two onions", "300 g red lentils", "Steps", "Chop the onions and fry them slowly.", "Add the lentils and a litre of water; simmer for half an hour."],
        ["Recipes", "Borscht", "newsletter", "Sign up", "Imprint"],
    ),
    (
        """<div class="page"><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept all</button></div><div class="col-8"><div><h1>Why bees dance</h1><div>Bees tell each other where flowers are by dancing on the comb.</div>
        <div>The angle of the dance gives the direction, and its length the distance to the food.</div><div>Karl von Frisch worked this out in the 1920s.</div></div></div><div class="sidebar"><h4>Most read</h4><ul><li><a href=x>Ants at war</a></li><li><a href=y>Moths at night</a></li></ul></div></div>""",
        ["Why bees dance", "Bees tell each other where flowers are by dancing on the comb.", "The angle of the dance gives the direction, and its length the distance to the food.", "Karl von Frisch worked this out in the 1920s."],
        ["cookies", "Accept all", "Ants at war"],
    ),
    (
        """<html><body><div class="wrapper"><div class="top-menu"><a href=1>Forum</a> | <a href=2>Search</a> | <a href=3>Members</a></div><div class="inner"><h1>How do I prune an old apple tree?</h1><p>Start in late winter, when the tree has no leaves.</p>
        <p>Take out dead wood first. Then open up the middle so that light gets in.</p><blockquote><p>Never cut more than a third in a year.</p></blockquote><p>Old trees need two or three years to come back into shape.</p></div><div class="copyright">Copyright 2019</div></div></body></html>""",
        ["How do I prune an old apple tree?", "Start in late winter, when the tree has no leaves.", "Take out dead wood first. Then open up the middle so that light gets in.", "Never cut more than a third in a year.", "Old trees need two or three years to come back into shape."],
        ["Members", "Copyright 2019"],
    ),
]


def test_hand_written_pages():
    p = html.train()
    kept = whole = 0
    for page, want, never in PAGES:
        found = html.blocks(page)
        mine = [t for (_, t, _), q in zip(found, html.label(p, [found])[0]) if q >= 0.5]
        whole += len(want) + len(never)
        kept += sum(x in mine for x in want) + sum(not any(x in t for t in mine) for x in never)
    assert kept >= 0.95 * whole, (kept, whole)


def test_time_grows_with_the_length():
    for page in ("<div>" * 60_000 + "deep", '<a b"' * 60_000, "<!x" * 60_000, "<p class='" * 60_000, "<" * 100_000, "<script>" * 20_000, "<!--" * 50_000, "<ul><li>a" * 20_000, "</div>" * 100_000 + "x"):
        start = time.time()
        html.blocks(page)
        assert time.time() - start < 5, page[:12]


def test_long_pages_are_read_in_pieces(monkeypatch):
    p = html.train()
    page = html.blocks("<article>" + "".join(f"<p>Sentence number {i} of a long text.</p>" for i in range(300)) + "</article><footer>end</footer>")
    whole = html.label(p, [page])[0]
    monkeypatch.setattr(html, "PIECE", 64)
    pieces = html.label(p, [page], most=100)[0]
    assert abs(whole - pieces).max() < 1e-3


def test_broken_tags_and_texts():
    text = lambda x: " ".join(t for _, t, _ in html.blocks(x))
    assert text("a <b>c</b>d<br>e &lt;f&gt; <p>g") == "a cd e <f> g"
    assert text('<p title="x > y">in</p>') == "in" and text("<p class='a") == "" and text("1 < 2 and 3 <4") == "1 < 2 and 3 <4"
    assert text("<p>one <!-- <p>no --> two</p><script>if (a < b) x()</script>three<style>p{}") == "one two three"
    assert text('<p a="un>two</p><p>three</p>') in ("two three", "three")


def test_rows(spark):
    rows = [(1, "u", "<article><h1>Head</h1><p>Some text here.</p></article>", "own", 7), (1, "u", "<article><h1>Head</h1><p>Some text here.</p></article>", "own", 7), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(df, "html", "page_id", "url", "text", "n_chars")
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "Head Some text here.", 20), (1, "Head Some text here.", 20)]
    assert html.extract(df.limit(0), "html", "page_id").count() == 0
