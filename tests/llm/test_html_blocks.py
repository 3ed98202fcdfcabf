"""Main text of hand-made pages and of the sample pages."""
import html
import random
import re
import time
from dataclasses import replace

from fernrec.llm.html_blocks import Block, extract_main_text, label_blocks, main_text

LONG = "This is the text of an article and it has the words that are in such a text, on and on."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies and this is the notice that is here for you.</div>
<article><header><h1>A title</h1></header><p>{LONG}<p>Short &amp; sweet.<br>Next&nbsp;line
<div class="ad">Buy the thing and be happy with it, for it is the best of all the things.</div>
<form><p>{LONG}</p><input></form><script>if (a < b) c("</p>");</script>
<ul><li>First point</li><li>Second <b>point</b></li></ul>
<aside>{LONG}</aside><p hidden>{LONG}</p><!-- <p>{LONG}</p> -->
<section id="comments"><p>{LONG}</p></section><footer>Written by me.</footer></article>
<footer>&copy; all</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "\n\n".join(
        ["A title", LONG, "Short & sweet. Next line", "First point", "Second point"])


def test_page_without_article():
    page = (f"<body><div><a href=a>One</a> <a href=b>Two</a></div><div id=main><h1>Head</h1>"
            f"<p>{LONG}</p><p>Yes, it is.</p><p>{LONG}</p></div>"
            f"<div><a href=c>More</a> <a href=d>Links</a></div><div>Imprint</div>")
    assert main_text(page) == "\n\n".join(["Head", LONG, "Yes, it is.", LONG])


def test_odd_pages():
    for page in (None, "", "<", "<p", "<<>>", "&", "<a href='", "</div></p>", "<!--", "<script>x",
                 "<p" * 2000, "<div>" * 5000 + "x"):
        assert isinstance(main_text(page), str)
    assert main_text("<article><p>cut &amp off &lt") == "cut & off <"


def test_rows(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, 6), (3, "v", "", 7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted(map(tuple, extract_main_text(df).collect()), key=str)
    text = main_text(PAGE)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (3, "v", "", 0)],
                         key=str)
    assert extract_main_text(df.limit(0)).collect() == []


def test_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    for page in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split())
                  for x in re.split("</?(?:p|h1)>", body)]
        assert got[page.page_id] == "\n\n".join(b for b in blocks if b)


def test_wrapper_classes():
    nav = "<nav><a href=/>Home</a></nav>"
    for before, after in (("<html class='has-sidebar'><body>", ""), ("<body id='login-footer'>", ""),
                          ("<body class='has-sidebar'><div class='content no-sidebar'>", "</div>")):
        for tag in ("article", "main", "article class='share related'"):
            page = (f"{before}{nav}<{tag}><h1>Head</h1><p>{LONG}</p><div class=ad>{LONG}</div>"
                    f"</{tag.split()[0]}>{after}<div class=footer>{LONG}</div>")
            assert main_text(page) == f"Head\n\n{LONG}"
    own = f"<body><div><p>{LONG}</p></div>"
    assert main_text(f"{own}<div class=comments><article><p>Not {LONG}</p></article></div>") == LONG


def test_language_without_known_stop_words():
    text = "Tämä kirjoitus kertoo siitä, miten järven rannalla eletään talvella ja kesällä."
    page = (f"<body><nav><a href=/>Koti</a></nav><div><h1>Järvi</h1><p>{text}</p><p>{text}</p></div>"
            f"<div><a href=a>{text}</a></div><div class=footer>{text}</div>")
    assert main_text(page) == f"Järvi\n\n{text}\n\n{text}"


def test_passes_decide_inside_and_outside_articles():
    links = "<p><a href=a>More of it here</a></p>"
    inner = (f"<h1>Head</h1><p>{LONG}</p><p>The tail</p>{links}{links}<p>Lost</p>{links}"
             f"<p>{LONG}</p><p>End</p>")
    kept = ["Head", LONG, "The tail", LONG, "End"]
    assert main_text(f"<body><nav>x</nav><article>{inner}</article></body>") == "\n\n".join(kept)
    assert main_text(f"<body><nav>x</nav><div>{inner}</div></body>") == "\n\n".join(kept)
    # short blocks only: those of an article stay, those of a page do not
    short = "<h1>Head</h1><p>One line</p><p>Two</p>"
    assert main_text(f"<article>{short}</article>") == "Head\n\nOne line\n\nTwo"
    assert main_text(f"<div>{short}</div>") == ""
    # between a good and a bad block at equal distance: stop words or a heading
    for block, stays in (("<p>It is so</p>", True), ("<h2>Title</h2>", True), ("<p>Title</p>", False)):
        page = f"<p>{LONG}</p>{block}{links}"
        assert (len(main_text(page)) > len(LONG)) is stays


def brute_labels(kinds, article):
    """kinds: True, False or None of a region's blocks without stop words."""
    known = [(k, x) for k, x in enumerate(kinds) if x is not None]
    known += [(-1, True), (len(kinds), True)] if article else []
    out = []
    for k, kind in enumerate(kinds):
        if kind is None:
            sides = [max(((j, x) for j, x in known if j < k), default=None),
                     min(((j, x) for j, x in known if j > k), default=None)]
            near = min((abs(s[0] - k) for s in sides if s), default=None)
            votes = {s[1] for s in sides if s and abs(s[0] - k) == near}
            kind = votes == {True}
        out.append(kind)
    return out


def test_labels_against_brute_force():
    rng = random.Random(3)
    made = {True: Block(LONG, 0, False, False, False), None: Block("Tail", 0, False, False, False),
            False: Block("More", 4, False, False, False)}
    for case in range(400):
        kinds = [rng.choice([True, False, None, None, None]) for _ in range(rng.randint(0, 14))]
        for article in (False, True):
            blocks = [replace(made[k], in_article=article) for k in kinds]
            outside = [replace(made[True], in_article=False)] * article
            # a region without any block is no article
            inside = brute_labels(kinds, article)
            want = inside + [not kinds] * article
            assert label_blocks(blocks + outside) == want, (kinds, article)


def test_long_page_of_unmatched_tags():
    for page in ("<section>" * 40000 + "</div>" * 70000, "</div>" * 160000):
        start = time.perf_counter()
        assert main_text(page + f"<article>{LONG}</article>") == LONG
        assert time.perf_counter() - start < 5


def test_fallback_content_of_an_article_stays():
    page = (f"<article><p>{LONG}</p><p>So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> is it.</p>"
            f"<video src=v><p>No video here.</p></video><canvas>A chart.</canvas></article>")
    assert main_text(page) == f"{LONG}\n\nSo a=2 is it.\n\nNo video here.\n\nA chart."


def test_class_words_around_all_text():
    page = f"<body><nav>x</nav><div class='post social'><h1>Head</h1><p>{LONG}</p></div></body>"
    assert main_text(page) == f"Head\n\n{LONG}"
