from inkprobe.llm.html_text import extract_text, host_paths, parse, text_of, votes

LONG = "Some words of an article that go on for a while, with commas, and say something. " * 3
LONG = LONG.strip()


def page(body, more=""):
    return f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head>
<body class="x"><header class="top">No <a href="/">no</a></header><nav><ul><li><a>no</a></li></ul></nav>
<div class="cookie-notice"><p>{LONG}</p></div><div class="wrap"><div class="post-7 content">{body}</div>
<aside><p>No {LONG}</p></aside></div><section id="comments"><article class="comment"><p>No {LONG}</p></article></section>{more}
<form><p>no</p></form><footer>&copy; no</footer>"""


def main(html, paths=()):
    return text_of(parse(html), list(paths))


def test_main_text_of_one_page():
    body = f"<h1>Caf&eacute; &amp; more</h1><p>{LONG}<p>two <b>bold</b>\n\t words<br>after<ul><li>one<li>two</ul><!-- no <p>no</p> -->" \
           "<div class='share'>no</div><p hidden>no</p><blockquote>quote &lt;p&gt;</blockquote><p style='display: none'>no</p>tail &am x"
    assert main(page(body)) == "\n".join(["Café & more", LONG.strip(), "two bold words after", "one", "two", "quote <p>", "tail &am x"])


def test_broken_markup():
    assert main("") == "" and main("plain") == "plain" and main("a < b <") == "a < b <"
    assert main("<p>a</div></p>b</section><p>c") == "a\nb\nc"
    assert main("<div><script>never ends <p>no") == ""
    assert main('<div title="a > b">x</div><textarea><p>no</textarea>') == "x"
    assert main("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert main("<div><section>a longer one</section><section>b longer</section></div>") == "a longer one\nb longer"
    assert main("<p>" * 3000 + "deep" + "<div>" * 3000) == "deep"


def test_votes_mask_numbers():
    assert next(iter(votes(parse(page(f"<p>{LONG}</p>"))))) == "/html/body.x/div.wrap/div.content.post-#"


def rows(n):
    out = [(i, f"http://host.org/{i}", page(f"<p>{LONG} {i}</p>").replace("post-7", f"post-{i}"), "t") for i in range(n)]
    # On this page a barred-looking box isn't marked, and outweighs the article on its own.
    out.append((500, "http://host.org/x", page(f"<p>{LONG}</p>", f"<div class='box'><p>{LONG + LONG[:60]}</p></div>"), "t"))
    out += [(501, None, f"<body><p>{LONG}</p></body>", "t"), (502, "http://a.b/", None, "t"), (503, "nonsense", "", "t")]
    return out + [out[1]]


def test_hosts_agree_on_a_path(spark):
    df = spark.createDataFrame(rows(12), "page_id long, url string, html string, text string")
    paths = {r.host: r.paths for r in host_paths(df).collect()}
    assert paths["host.org"][0] == "/html/body.x/div.wrap/div.content.post-#"
    out = extract_text(df).collect()
    assert len(out) == 17 and out[0].asDict().keys() == {"page_id", "url", "html", "text"}
    by_id = {r.page_id: r.text for r in out}
    assert by_id[3] == f"{LONG} 3" and by_id[500] == LONG.strip()  # own best: the box
    assert main(rows(1)[1][2]) != LONG.strip()
    assert by_id[501] == LONG.strip() and by_id[502] == by_id[503] == ""


def test_title_beside_a_wrapped_body():
    for wrapper in ("<div class='entry-content'>", "<div>", "<section>"):
        body = f"{wrapper}<p>{LONG}</p>{wrapper[0]}/{wrapper[1:].split()[0].rstrip('>')}>"
        for around in ("article", "main"):
            assert main(f"<body><nav>no</nav><{around}><h1><a>Title</a></h1>{body}<ul><li><a>tag</a></ul></{around}>") == f"Title\n{LONG}\ntag"
        assert main(f"<body><div class='post'><h2><a>Title</a></h2>{body}</div><div><a>no</a> <a>no no</a></div>") == f"Title\n{LONG}"
        assert main(f"<body><h1>Title</h1>{body}") == main(f"<h1>Title</h1>{body}") == f"Title\n{LONG}"


def test_uneven_sections_stay_together():
    for around in ("article", "main", "div", "body"):
        sections = "".join(f"<section><p>{t}</p></section>" for t in ("Short.", LONG * 9, "Last."))
        assert main(f"<{around}>{sections}</{around}>") == f"Short.\n{LONG * 9}\nLast."
    articles = "".join(f"<article><p>{t}</p></article>" for t in (LONG * 9, "Short."))
    assert main(f"<body><main><h1>All</h1>{articles}</main><p>No</p>") == f"All\n{LONG * 9}\nShort."


def test_two_layouts_of_a_host(spark):
    first = "<body><article><h1>Title {0}</h1><div class='content'><p>{1} {0}</p></div></article>"
    # The path that wins in the host holds a part of these pages only, in or beside the text.
    inside = "<body><main><article><h1>Lead {0}</h1><div class='content'><p>{1}</p></div></article><div class='more'><p>{1} {0}</p></div></main>"
    beside = "<body><article><div class='content'><p>{0} {1}</p></div></article><div class='tale'><h1>Tale</h1><p>{1}{1}{1}</p></div>"
    layouts = [first] * 9 + [inside, beside]
    pages = [(i, "http://h.org/", layout.format(i, LONG)) for i, layout in enumerate(layouts)]
    out = {r.page_id: r.text for r in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Title {i}\n{LONG} {i}" for i in range(9))
    assert out[9] == f"Lead 9\n{LONG}\n{LONG} 9"
    assert out[10] == f"10 {LONG}\nTale\n{LONG * 3}"


def test_a_name_alone_bars_no_article():
    for around in (
        '<div class="content with-sidebar">', '<article class="post comments-closed">', '<div id="page" class="ad-free">', '<div class="wrapper nav-open">',
        '<div class="main has-related">', '<form action="/"><input name="a"><div>', "<nav><ul><li><a>no</a></ul><article>",
    ):
        assert main(f"<body>{around}<h1>Title</h1><p>{LONG}</p>") == f"Title\n{LONG}"
    inside = '<p class="share-price">Price</p><section id="related-work"><p>Work</p></section><p id="comment-on-law">Law</p>'
    assert main(f"<body><article><p>{LONG}</p>{inside}</article>") == f"{LONG}\nPrice\nWork\nLaw"
    assert main("<body><div class=c><p>Short.</p></div><div class=legal>Copyright by someone with a long name, all rights reserved</div>") == "Short."


def test_marked_elements_stay_out():
    for box in ("<div class='cookie-notice'>", "<div class='sidebar-left'>", "<section class='comment-list'>", "<div id='related-posts'>", "<div role='banner'>", "<aside>"):
        end = box[1:].split()[0].rstrip(">")
        assert main(f"<body><div class='text'><p>{LONG}</p></div>{box}<p>No {LONG[:150]}</p></{end}>") == LONG
    # Reader comments, however long.
    assert main(f"<body><div class='text'><p>{LONG}</p></div><div class='comments'>{f'<article><p>{LONG}</p></article>' * 30}</div>") == LONG
    # What only sounds like a menu goes if it is one.
    assert main(f"<body><div><p>{LONG}</p></div><div class='nav-open'><a>One</a> <a>Two</a></div>") == LONG


def test_time_grows_with_the_length():
    import time

    began = time.process_time()
    for source in ("<b " * 30_000, "<div>" * 20_000, "<div>x" * 15_000, "<a ' " * 20_000 + ">", "</x>" * 25_000, "<div>" * 10_000 + "</p>" * 10_000, "<textarea>" * 10_000, "<!--" * 25_000):
        text_of(parse(source), ["/html/body"])
    assert time.process_time() - began < 12


def test_plain_second_implementation():
    """Pages without doubt: the text of the article's blocks, by the standard library's parser."""
    import random
    from html.parser import HTMLParser

    class Blocks(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in ("p", "h2", "li", "ul", "blockquote", "article"):
                self.out.append([])

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag in ("p", "h2", "li", "ul", "blockquote", "article"):
                self.out.append([])

        def handle_data(self, data):
            if self.inside:
                self.out[-1].append(data)

    rng = random.Random(7)
    word = lambda: rng.choice(["some", "words", "&amp;", "a &lt; b", "<b>bold</b>", "<i>it</i>\n", "x&nbsp;y", "caf&eacute;", "<!-- no -->"])
    for _ in range(40):
        blocks = []
        for _ in range(rng.randint(1, 9)):
            tag = rng.choice(["p", "h2", "blockquote", "li"])
            text = " ".join(word() for _ in range(rng.randint(1, 40)))
            blocks.append(f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag} class='c{rng.randint(0, 9)}'>{text}</{tag}>")
        html = f"<html><body><nav><a>no</a></nav><article>{''.join(blocks)}</article><footer>no</footer></body></html>"
        plain = Blocks()
        plain.feed(html)
        lines = (" ".join("".join(b).split()) for b in plain.out)
        assert main(html) == "\n".join(line for line in lines if line)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://h/1", f"<p>{LONG}", 2, 3, 4)], "page_id long, url string, html string, __host int, host int, paths int")
    row = extract_text(df).first()
    assert row.text == LONG and (row["__host"], row.host, row.paths) == (2, 3, 4)


def test_empty(spark):
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_same_text_as_the_article_in_the_test_table(spark):
    """The pages of the test table hold their text in one article element."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract_text(pages, keep=["html"]).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        assert r.text == "\n".join(b for b in blocks if b)
