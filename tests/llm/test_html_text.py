import pytest

from tidefence.llm import html_text as H


def text(page):
    return H.extract(page, H.default_weights())


BODY = "<h1>A heading of the piece</h1><p>First paragraph of the piece, with &amp; sign and caf&eacute;.</p><p>Second   one\n with <b>bold</b> and <a href='/x'>a link</a> in it.</p>"
WANT = "A heading of the piece\n\nFirst paragraph of the piece, with & sign and café.\n\nSecond one with bold and a link in it."
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News and more</a></li></ul></nav>"
AROUND = [
    NAV,
    "<header><a href='/'>The Site</a></header>",
    "<div class='ad'>Buy these things now, very cheap offers</div>",
    "<div id='cookie-banner'><p>We use cookies to make this site better for all of you.</p></div>",
    "<form><label>Search this site for words</label><input name=q><select><option>one</option></select></form>",
    "<script>var a = '<p>not text</p>';</script>",
    "<style>p { color: red }</style>",
]
AFTER = [
    "<aside><h3>Related</h3><ul><li><a href='/r'>Another story to read</a></li></ul></aside>",
    "<section class='comments'><h2>Comments</h2><div><b>Reader</b><p>I do not agree with this piece at all, sorry.</p></div></section>",
    "<footer>&copy; The Site &middot; all rights and wrongs reserved for us</footer>",
]


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>", "<div>{}</div>"])
def test_content_without_surroundings(shell):
    page = "<html><head><title>t</title></head><body>" + "".join(AROUND) + shell.format(BODY) + "".join(AFTER) + "</body></html>"
    assert text(page) == WANT


def test_advert_and_comments_inside_the_article_go():
    page = NAV + "<article><h1>A heading of the piece</h1><p>First paragraph, long enough to count.</p><div class='advert'>Buy now while stocks last</div><p>Second paragraph, long enough too.</p></article>"
    assert text(page) == "A heading of the piece\n\nFirst paragraph, long enough to count.\n\nSecond paragraph, long enough too."


def test_layout_words_forms_and_own_headings():
    inner = "<div class='entry-header'><h1>A heading of the piece</h1></div>" + BODY.split("</h1>")[1]
    for shell in ("<div class='page with-sidebar'><article>{}</article></div>", "<form id='page'><article>{}</article></form>", "<body class='has-comments no-ads'><main>{}</main></body>"):
        page = NAV + shell.format(inner) + "<div class='sitefooter'><p>Words at the very end of the page</p></div><div class='sideNav'><a href='/'>Go on</a></div>"
        assert text(page) == WANT


def test_odd_pages():
    assert text(None) == text("") == text("<p></p>") == ""
    assert text("<article><p>Unclosed <b>bold<br>next line<p>Another one") == "Unclosed bold next line\n\nAnother one"
    assert text("<article><p>Some text<!-- <p>hidden</p> --> goes on</p><!-- open").startswith("Some text goes on")
    assert text("<article><p title=\"stray>Words after a stray quote</p></article>").count("\n") == 0
    long = "<article>" + "<p>many words in here</p>" * 20_000 + "</article>"
    assert text(long).count("many words") == 20_000
    assert text("<article><p>1 &lt; 2 &#8211; &unknown; x</p></article>") == "1 < 2 – &unknown; x"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p data-x=don't>Hello there, it's here and goes on.</p></article>", "Hello there, it's here and goes on."),
        ("<article><p title=\"5\" tall\">Text \"quoted\" and some more.</p></article>", 'Text "quoted" and some more.'),
        ("<article><p class='promotion-history'>Words that are in the piece.</p></article>", "Words that are in the piece."),
        ("<article><p id=discussion>Words of the piece.</p><h2 id='related-work'>Related work</h2><p>And more.</p></article>", "Words of the piece.\n\nRelated work\n\nAnd more."),
        ("<article><p>Before the list.</p><ul class='tags'><li>first point of it</li></ul></article>", "Before the list.\n\nfirst point of it"),
        ("<article><p>Before.</p><section id='legal-history'><p>Legal matters of the past.</p></section><p>After it all.</p></article>", "Before.\n\nLegal matters of the past.\n\nAfter it all."),
        ("<table><tr><td><a href=/a>One page</a></td><td><a href=/b>Other page</a></td></tr></table>" + NAV + "<main><p>Only this is the text of the page, as it should be.</p></main>", "Only this is the text of the page, as it should be."),
        ("<article><p>Left <i><b><u><s><em><q><tt><sub><sup>open<div>A block that ends it.</div></article>", "Left open\n\nA block that ends it."),
    ],
)
def test_words_and_quotes_do_not_swallow_content(page, want):
    assert text(page) == want


def test_unclosed_and_nested_tags_cost_no_more():
    import time

    def seconds(page):
        start = time.perf_counter()
        H.extract(page, H.default_weights())
        return time.perf_counter() - start

    for make in (lambda n: "<article><p>word " + "<b>x" * n, lambda n: "<div>" * n + "</p></i>some words" * n, lambda n: "<li>" * n + "<td>" * n, lambda n: '<p x="' * n):
        assert seconds(make(100_000)) < 25 * max(0.05, seconds(make(10_000)))


def test_generated_pages_against_their_blocks():
    """Pages from a second builder, whose blocks are known; surroundings on both sides, tables and asides among them."""
    import random

    r = random.Random(77)
    say = lambda a, b: " ".join(r.choice(["stone", "river", "under", "walks", "seven", "light", "house", "years"]) for _ in range(r.randint(a, b)))
    menu = "<table><tr>" + "".join(f"<td><a href='/{i}'>{say(1, 2)}</a></td>" for i in range(6)) + "</tr></table>"
    right = 0
    for _ in range(200):
        blocks, body = [], ""
        for _ in range(r.randint(3, 10)):
            words = say(8, 60)
            blocks.append(words)
            body += r.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<p class=promotion-x>{}</p>", "<div><em>{}</em></div>"]).format(words)
        around = [menu, *AROUND[:5], AFTER[0]]
        page = "".join(r.sample(around, 3)) + r.choice(["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>"]).format(body) + "".join(r.sample([*AFTER, menu], 3))
        right += text(page) == "\n\n".join(blocks)
    assert right >= 196


def test_best_region():
    assert H.best_region([]) == (0, 0) and H.best_region([-1, -2]) == (0, 0)
    assert H.best_region([1, -5, 3, -1, 4, -9, 2]) == (2, 5)
    assert H.best_region([2, -2, 2]) in ((0, 1), (0, 3))
    import random

    r = random.Random(0)
    for _ in range(300):
        s = [r.randint(-4, 4) for _ in range(r.randint(1, 15))]
        a, b = H.best_region(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])


def test_weights_have_the_right_signs():
    w = H.default_weights()
    assert w.score["in article"] > 0 > max(w.score[f"in {k}"] for k in ("menu", "footer", "advert", "comment", "notice", "form", "sidebar", "header"))
    assert all(v < 0 for k, v in w.score.items() if k.startswith("tag "))


def test_query_rows(spark):
    rows = [(0, "u0", AROUND[0] + f"<article>{BODY}</article>", 1), (1, None, None, 1), (1, "u1", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = H.main_text(df.withColumn("n_chars", df["text"])).collect()
    assert [(r.text, r.n_chars) for r in got] == [(WANT, len(WANT)), ("", 0), ("", 0)]
    assert H.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["option", "button", "svg", "title", "iframe", "select", "noscript"])
def test_unclosed_raw_elements_take_linear_time(name):
    import time

    page = f"<article>{f'<p>word words here</p><{name}>a' * 20_000}</article>"
    start = time.perf_counter()
    runs = H.parse(page)
    assert time.perf_counter() - start < 5 and len(runs) > 20_000
    start = time.perf_counter()
    H.parse(f"<{name}>" * 80_000)
    assert time.perf_counter() - start < 5


def test_unclosed_raw_elements_lose_no_text():
    words = "All these words stand in the article and are long enough to be read as such by everyone who reads."
    weights = H.default_weights()
    page = f"<article><p>Pick <select><option>a</select> or <option>lost <p>{words}</p><p>{words}</p> <option>x</option></article>"
    assert H.extract(page, weights).count(words) == 2
    page = f"<html><head><title>Some page<body><article><p>{words}</p><p>{words}</p><p>{words}</p></article><svg><title>icon</title></svg></body>"
    assert H.extract(page, weights).count(words) == 3
    page = f"<article><p>{words}</p><button>Share<p>{words}</p><p>{words}</p><button>x</button></article>"
    assert H.extract(page, weights).count(words) == 3


@pytest.mark.parametrize("wrapper", ["trending-section", "popup-content", "popular", "sidebar"])
def test_no_word_list_empties_a_page(wrapper):
    words = "All these words stand in the article and are long enough to be read as such by everyone who reads."
    page = f'<body><nav><a href="/">Home</a></nav><div class="{wrapper}"><article><h1>Title</h1><p>{words}</p><p>{words}</p></article></div></body>'
    assert H.extract(page, H.default_weights()).count(words) == 2
    # where other text is left, what the list names stays out
    both = f'<body><article><p>{words}</p><p>{words}</p></article><div class="comments"><article><p>I disagree with all of these words and say so here.</p></article></div></body>'
    assert "disagree" not in H.extract(both, H.default_weights())
