import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from textassay.llm import html_extract
from textassay.llm.html_extract import Page, extract, main_text

ARTICLE = "<p>The council met on Monday, and the vote was close. Few had expected it; fewer still had hoped.</p><p>A second vote, in spring, will settle the question. Until then, nothing changes.</p>"
WANT = "The council met on Monday, and the vote was close. Few had expected it; fewer still had hoped. A second vote, in spring, will settle the question. Until then, nothing changes."
AROUND = [
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>News, sport, and more.</a></li></ul></nav>",
    '<div class="cookie-notice">We use cookies, as all do. Accept, or leave.</div>',
    "<header><h1>Daily paper, since 1900.</h1></header>",
    '<div id="sidebar"><p>Most read: a story, and another one, that you may like as well.</p></div>',
    "<aside>Related: the vote, the council, and Monday. Read on.</aside>",
    '<form action="/s"><label>Search, please.</label><input></form>',
    "<script>var a = '<p>not text, at all. Nor this.</p>';</script><style>p { color: red; }</style>",
    "<!-- a comment, <p>with markup. And text.</p> -->",
    '<div class="ad">Buy now, pay later. Offer ends soon.</div>',
    '<section class="comments"><p>First! I disagree, strongly, with all of this. So there.</p></section>',
    "<footer>&copy; 2024, the paper. All rights reserved.</footer>",
]


def test_furniture_goes_whatever_holds_the_article():
    for open_, close in (("<article>", "</article>"), ('<div class="story">', "</div>"), ("<main>", "</main>"), ("<div><div>", "</div></div>")):
        page = f"<html><head><title>T</title></head><body>{''.join(AROUND[:6])}{open_}{ARTICLE}{close}{''.join(AROUND[6:])}</body></html>"
        assert main_text(page) == WANT


def test_headings_lists_and_short_blocks_of_the_article_stay():
    page = f"<body>{AROUND[0]}<article><h1>Vote</h1>{ARTICLE}<ul><li>One</li><li>Two</li></ul><p>End.</p></article>{AROUND[-1]}</body>"
    assert main_text(page) == f"Vote {WANT} One Two End."


def test_references_white_space_and_broken_markup():
    assert main_text("<p>a &amp;lt; b\n\t c&nbsp;d &eacute;</p>") == "a &lt; b c d é"
    assert main_text("<p><b>One.<br><p>Two, three.</p><p>Four <i>f</i>ive.") == "One. Two, three. Four five."
    assert main_text("plain text, no markup.") == "plain text, no markup."
    assert main_text("<p>cut off here <a href='") == "cut off here <a href='"
    assert main_text("<script>never closed <p>x</p>") == ""
    for nothing in (None, "", " ", "<", "<>", "<html></html>", "<nav>Only a menu</nav>", "<!-- open"):
        assert main_text(nothing).replace("<>", "").strip("<") == ""


def test_long_pages_and_deep_markup():
    page = "<div>" * 3000 + ARTICLE + "</div>" * 3000
    assert main_text(page) == WANT
    long_ = "<article>" + "<p>A sentence, of some length, stands here.</p>" * 20000 + "</article>"
    assert len(main_text(long_)) == 20000 * len("A sentence, of some length, stands here. ") - 1


@pytest.mark.parametrize(
    "part",
    ["<div>", "<a ", '<p class="', "<p class='", "<", "<div>x", "<nav>x", "<b>x", "<article>x.", "<!--", "<!-->", "<svg>", "<ul><li><div>", "</div><div></span>", "<a href=\">", "&amp;", "<p a=b "],
)
def test_a_megabyte_of_anything_is_read_at_once(part):
    """Twice the text takes about twice the time: quadratic steps would take minutes."""
    page, began = part * (1_000_000 // len(part)), time.perf_counter()
    main_text(page)
    main_text(page + ">")
    assert time.perf_counter() - began < 12


def test_marks_in_attributes_and_comments():
    for p in ("<p data-x=it's>", "<!-->x<p>".replace("x", ""), "<!---><p>", "<p title='>'>", '<p title="<b>">', "<p/>", "<p =x>"):
        assert main_text(f"{p}Hello, there.</p>") == "Hello, there.", p
    assert main_text("<p>Before, all.</p><!-- > <p>no</p> -- > --><p>After, all.</p>") == "Before, all. After, all."


def test_links_take_no_part_in_the_ratios():
    text, _, plain, marks = Page("<div><a href=1>All of this, and more, is a link</a> end.</div>").blocks[0]
    assert text.endswith("link end.") and (plain, marks) == (4, 1)
    assert main_text("<body><div><a href=1>All, of, this, is, a, link, of, great, length.</a></div><p>Short, plain.</p></body>") == "Short, plain."


def test_the_ratios_decide(monkeypatch, small, spark):
    """Without the threshold adverts come along; without smoothing or marks, other paths win."""
    pages = [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    before = [main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "THRESHOLD", 0.0)
    assert sum(main_text(p) != t for p, t in zip(pages, before, strict=True)) > 0.9 * len(pages)
    monkeypatch.undo()
    monkeypatch.setattr(html_extract, "CONTENT", 1.0)
    plain = [re.sub("</?article>", "", p) for p in pages]
    right = sum(main_text(p) == t for p, t in zip(plain, before, strict=True))
    assert right > 0.8 * len(pages)  # by the ratios alone: no element says what is content
    said = "One, two; three. Four, five, six: seven! Eight?"
    quiet = f"<div class=a><p>{'word ' * 5}</p></div><div class=b><p>{said}</p></div>"
    assert main_text(f"<body>{quiet}</body>") == said
    monkeypatch.setattr(html_extract, "_MARKS", re.compile("(?!)"))
    assert main_text(f"<body>{quiet}</body>") != said


def test_names_do_not_decide():
    for open_, close in (("<div class='layout has-sidebar'>", "</div>"), ("<section class='content with-ads'>", "</section>"), ("<div id=comments class=widget>", "</div>")):
        assert main_text(f"<body>{AROUND[0]}{open_}<article>{ARTICLE}</article>{close}{AROUND[-1]}</body>") == WANT
    inner = f"<div class='entry-header'><h1>Vote</h1></div>{ARTICLE}<h2 id='search-and-share'>Search</h2><p id='notice-period'>The period.</p>"
    assert main_text(f"<body>{AROUND[8]}<article>{inner}</article></body>") == f"Vote {WANT} Search The period."


def test_articles_inside_an_article_are_comments():
    page = f"<body><article><h1>Vote</h1>{ARTICLE}<article><p>First! I disagree, of course.</p></article><article><p>So do I, strongly.</p></article></article></body>"
    assert main_text(page) == f"Vote {WANT}"


def test_cards_do_not_win_over_a_plain_page():
    cards = "".join(f"<article><h3><a href=/{k}>Card {k}</a></h3><p>A teaser, short.</p></article>" for k in range(4))
    long_ = "".join(f"<p>Part {k} of the story, told at length, with commas; and more besides, to be sure. It goes on, and on.</p>" for k in range(12))
    assert main_text(f"<body><div class=story>{long_}</div><div class=more>{cards}</div></body>").startswith("Part 0 of the story")
    assert "Part 11 of" in main_text(f"<body><div class=story>{long_}</div><div class=more>{cards}</div></body>")


class Plain(HTMLParser):
    """A page of well-formed markup as a tree of nested lists, for the brute-force version."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "#root", "class": "", "up": None, "attrs": {}, "text": []}
        self.at, self.blocks, self.raw = self.root, [], 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(t for t, _ in self.at["text"]).split())
        if text:
            plain = " ".join("".join(" " if x else t for t, x in self.at["text"]).split())
            self.blocks.append((text, self.at, len(plain), len(re.findall("[.,;:!?]", plain))))
        self.at["text"] = []

    links = 0

    def handle_starttag(self, tag, attrs):
        if tag in html_extract.RAW:
            self.raw += 1
        elif tag == "a":
            self.links += 1
        elif tag == "br":
            self.at["text"].append((" ", False))
        elif tag not in html_extract.INLINE and tag not in html_extract.VOID:
            if self.at["tag"] == "p":
                self.handle_endtag("p")
            self.flush()
            a = dict(attrs)
            self.at = {"tag": tag, "class": a.get("class", "") if tag not in html_extract.TEXT_BLOCKS else "", "up": self.at, "attrs": a, "text": []}

    def handle_endtag(self, tag):
        if tag in html_extract.RAW:
            self.raw -= 1
        elif tag == "a":
            self.links -= 1
        elif tag not in html_extract.INLINE and tag not in html_extract.VOID and tag in [e["tag"] for e in chain(self.at)]:
            self.flush()
            while self.at["tag"] != tag:
                self.at = self.at["up"]
            self.at = self.at["up"]

    def handle_data(self, data):
        if not self.raw:
            self.at["text"].append((data, self.links > 0))


def chain(e):
    while e is not None:
        yield e
        e = e["up"]


def brute(page):
    """The same rules, each block looked at by itself with all its ancestors."""
    tree = Plain(page)
    is_content = lambda e: e["tag"] in ("article", "main")
    grade = lambda e: 3 if "hidden" in e["attrs"] else 2 if e["tag"] in html_extract.NEVER_CONTENT else int(e["tag"] in html_extract.SELDOM_CONTENT or e["tag"] == "header" and not any(map(is_content, chain(e["up"]))) or e["tag"] == "article" and any(map(is_content, chain(e["up"]))))
    shown = [b for b in tree.blocks if all(grade(e) < 3 for e in chain(b[1]))]
    told = sum(len(b[0]) for b in shown if any(map(is_content, chain(b[1]))))
    said = lambda some: sum(len(b[0]) for b in some if b[1]["tag"] in html_extract.TEXT_BLOCKS)

    def below(e, b):
        up = list(chain(b[1]))
        return any(x is e for x in up), any(is_content(x) and any(y is e for y in chain(x["up"])) for x in up)

    def furniture(e):
        if grade(e) in (0, 3):
            return grade(e) == 3
        articles = sum(len(b[0]) for b in shown if below(e, b)[1])
        prose = said([b for b in shown if below(e, b)[0]])
        rest = said([b for b in tree.blocks if all(grade(x) < 2 for x in chain(b[1]))])
        return not 2 * articles > told > 0 and not (grade(e) == 1 and prose > html_extract.MUCH * rest)

    blocks = [b for b in tree.blocks if not any(furniture(e) for e in chain(b[1]))]
    path = lambda b: "/".join(f"{e['tag']}.{e['class']}" for e in chain(b[1]))
    of = {}
    for b in blocks:
        of.setdefault(path(b), []).append(b)
    fused = {p: (sum(b[2] for b in some) / len(some) * (1 + sum(b[3] for b in some) / len(some))) ** 0.5 for p, some in of.items()}
    f = [fused[path(b)] for b in blocks]
    smooth = [sum(w * f[i + d] for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)) if 0 <= i + d < len(f)) / sum(w for d, w in ((-1, 0.25), (0, 0.5), (1, 0.25)) if 0 <= i + d < len(f)) for i in range(len(f))]
    total = sum(b[2] for b in blocks)
    tops = {id([e for e in chain(b[1]) if is_content(e)][-1]) for b in blocks if any(map(is_content, chain(b[1])))}
    weight = html_extract.CONTENT if len(tops) == 1 else html_extract.CONTENTS
    score = {p: 0.0 if not total else sum(s for s, b in zip(smooth, blocks, strict=True) if path(b) == p) / len(some) * sum(b[2] for b in some) / total * (weight if any(map(is_content, chain(some[0][1]))) else 1) for p, some in of.items()}
    node = lambda e: next((x for x in chain(e) if x["tag"] == "article"), next((x for x in chain(e) if x["tag"] == "main"), None))
    if max(score.values(), default=0) <= 0:
        return " ".join(b[0] for b in blocks if node(b[1]))
    picked = [b for b in blocks if score[path(b)] >= html_extract.THRESHOLD * max(score.values())]
    low = next(e for e in chain(picked[0][1]) if e["tag"] not in html_extract.TEXT_BLOCKS and all(any(x is e for x in chain(b[1])) for b in picked))
    nodes = [node(low)] if node(low) else [n for b in picked if (n := node(b[1]))]
    whole = low["tag"] not in ("#root", "html", "body")
    mean = sum((b[2] * (1 + b[3])) ** 0.5 for b in picked) / len(picked)
    in_text = [b for b in picked if any(e["tag"] in html_extract.TEXT_BLOCKS for e in chain(b[1]))]
    written = 2 * sum(len(b[0]) for b in in_text) >= sum(len(b[0]) for b in picked)
    out = []
    for b in blocks:
        up = list(chain(b[1]))
        holder = next(e for e in up if e["tag"] not in html_extract.TEXT_BLOCKS)
        own = b[1]["tag"] in html_extract.TEXT_BLOCKS
        chosen = any(b is x for x in picked)
        boxed = written and not any(e["tag"] in html_extract.TEXT_BLOCKS for e in up) and not any(any(x is b[1] for x in chain(p[1])) for p in picked) and (b[2] * (1 + b[3])) ** 0.5 < html_extract.LIKE * mean
        keep = chosen or (not boxed and any(any(x is n for x in up) for n in (nodes or [low] * whole)))
        if not keep and not nodes and own and whole:
            keep = any(x is holder for x in chain(low)) and (b[1]["tag"][0] == "h" or (b[2] * (1 + b[3])) ** 0.5 >= html_extract.THRESHOLD * mean)
        elif not keep and not nodes and own:
            keep = any(any(x is holder for x in chain(p[1])) for p in picked)
        if keep:
            out.append(b[0])
    return " ".join(out)


def made_up(rng):
    """A well-formed page of boxes in boxes."""
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() + rng.choice(["", "", ",", ".", "!"]) for _ in range(rng.randrange(1, n)))

    def box(depth):
        tag = rng.choice(["div", "div", "section", "article", "main", "nav", "aside", "footer", "header", "form", "ul", "p", "h2", "div hidden"])
        name = rng.choice(["", "", " class=a", " class=b", ' class="c d"'])
        if tag in ("p", "h2"):
            inner = text(40) + rng.choice(["", f" <a href=x>{text(6)}</a> {text(4)}", f"<b>{text(3)}</b><br>{text(5)}"])
        elif tag == "ul":
            inner = "".join(f"<li>{text(8)}</li>" for _ in range(rng.randrange(1, 4)))
        else:
            inner = rng.choice(["", text(12)]) + "".join(box(depth + 1) for _ in range(rng.randrange(1, 4) if depth < 4 else 0))
            inner = inner or text(30)
        return f"<{tag}{name}>{inner}</{tag.split()[0]}>"

    return f"<html><head><title>t</title><script>a<b</script></head><body>{''.join(box(0) for _ in range(rng.randrange(1, 6)))}</body></html>"


def test_against_brute_force(small, spark):
    rng = random.Random(12)
    pages = [made_up(rng) for _ in range(600)] + [r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    pages += [f"<body>{''.join(AROUND[:k])}<div class=x>{ARTICLE}</div>{''.join(AROUND[k:])}</body>" for k in range(len(AROUND))]
    for page in pages:
        page = re.sub(r"<b>([^<]*)<br><p>", r"\1<br></p><p>", page)
        assert main_text(page) == brute(page), page


def test_query_against_the_article_element(spark, small):
    """The generated pages keep their text in one element: a plain parse of it is the brute-force version."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = extract(spark.read.parquet(f"{small}/pages.parquet")).select("page_id", "url", "text", "n_chars").collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        text = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
        assert r["text"] == " ".join(html.unescape(text).split()) and r["n_chars"] == len(r["text"])


def test_awkward_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>Some text, here.</p>"), (2, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS score")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in extract(df).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("2", "", 0), ("None", "Some text, here.", 16)]
    assert extract(df.limit(0)).count() == 0


def test_all_selected_text_is_kept_however_it_is_divided():
    half = "<p>The first part, which is short, opens the story. It has a point.</p>"
    said = re.sub(r"<[^>]+>", " ", half).split()
    for page in (
        f"<body><article><section><h2>One</h2>{half}</section><section>{ARTICLE}</section></article></body>",
        f"<body><main><h2>One</h2>{half}<div class=body>{ARTICLE}</div></main></body>",
        f"<body><article><h2>One</h2></article><article>{half}</article><article>{ARTICLE}</article></body>".replace("</h2></article><article>", "</h2>"),
    ):
        assert main_text(page) == f"One {' '.join(said)} {WANT}"


def test_names_of_furniture_do_not_count_against_what_holds_the_text():
    for open_, close in (
        ("<div id=page class='has-sidebar'><main><article>", "</article></main></div>"),
        ("<div class='no-sidebar'>", "</div>"),
        ("<form id=aspnetForm><div>", "</div></form>"),
        ("<div class='related'><main>", "</main></div>"),
        ("<form><main>", "</main></form>"),
        ("<div class='widget'><article>", "</article></div>"),
    ):
        page = f"<body>{''.join(AROUND[:5])}{open_}{ARTICLE}{close}{''.join(AROUND[6:])}</body>"
        assert main_text(page) == WANT, open_
        wrapped = f"<body>{open_}{AROUND[0]}{AROUND[5]}{ARTICLE}{AROUND[8]}{close}</body>"
        assert main_text(wrapped) == WANT, open_
    section = "<section id='related-work'><p>Others have said it before, and better.</p></section>"
    assert main_text(f"<body><article>{ARTICLE}{section}</article></body>") == f"{WANT} Others have said it before, and better."
    assert main_text(f"<body><div hidden><article>{ARTICLE}</article></div></body>") == ""


def test_links_inside_the_article_stay():
    title, source = "<h1><a href=/vote>The vote</a></h1>", "<ul><li><a href=/1>First source, of 1990</a></li><li><a href=/2>Second source</a></li></ul>"
    menu = "<div><a href=/a>Another page, and more</a></div>"
    for open_, close in (("<article>", "</article>"), ("<main><div>", "</div></main>"), ("<article><div>", "</div></article>")):
        page = f"<body>{menu}{open_}{title}{ARTICLE}<p><a href=/r>Read the whole report, in full</a>.</p>{source}{close}{menu}</body>"
        assert main_text(page) == f"The vote {WANT} Read the whole report, in full. First source, of 1990 Second source"
    assert main_text(f"<body>{menu}<article><p><a href=/r>Only this, a link.</a></p></article></body>") == "Only this, a link."
    assert main_text(f"<body>{menu}</body>") == ""
