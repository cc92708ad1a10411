import html
import random
import re

import pytest

from tidewright.llm import html_text, licenses

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_base(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places = []
    for phrase, label in licenses.BASE:
        own = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(own)] == own]
    found = set()
    for label, notice, keys in licenses.TEMPLATES:
        n = notice.split()
        for i in range(len(w)):
            if w[i : i + len(n)] == n:
                found.add(label)
    return w, places, found


def license_rows():
    rng = random.Random(4)
    rows = [None, "", " ", "CC-BY", "All rights reserved. all  RIGHTS\nreserved", "GNU General Public License, version 3", "Released under the MIT License.", "(c) Licensed under CC BY-NC 4.0.", "allrights reserved", "mit license", "MIT", "é license Ünder general public licensed"]
    words = "all rights reserved cc by general public license the mit apache version 2 0 under licensed".split()
    rows += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    rows += [f"some words before {n} and after, {n.upper()}" for _, n, _ in licenses.TEMPLATES] + ["x " * 50000 + "released under the MIT license"]
    return rows


def test_licenses_like_brute_force(spark):
    texts = license_rows()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "all rights reserved", "x", 2), (4, texts[4], "x", 2)], "doc_id bigint, text string, w string, places int")
    out = licenses.scan(df).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = "all rights reserved" if r.doc_id is None else texts[r.doc_id]
        w, places, found = brute_base(text)
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        labels = set(r.labels.split(",")) - {""}
        assert {x for _, x in places} <= labels and found <= labels and 0 <= r.score <= 1 and bool(labels) == (r.score > 0)
        assert r.labels == ",".join(sorted(labels))
        for f in r.found:  # a verified template's key phrases stand in full
            assert any(all(f" {k} " in f" {' '.join(w)} " for k in keys) for label, _, keys in licenses.TEMPLATES if label == f.label)


def test_a_text_of_nothing_but_notices(spark):
    n = 20000
    df = spark.createDataFrame([(1, "released under the mit license. all rights reserved. " * n)], "doc_id bigint, text string")
    r = licenses.scan(df).first()
    assert (r.n_base, r.labels, r.score, len(r.found), r.n_words) == (n, "mit,reserved", 1.0, 2 * n, 8 * n)  # two of the templates hold the phrase


def test_licenses_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert licenses.scan(df).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "all rights reserved")], "doc_id bigint, text string")
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def page(n, title, paragraphs, article="article", extra=""):
    lis = "".join(f"<li><a href='/{k}'>menu {n} {k}</a></li>" for k in range(n % 4 + 1))
    body = "".join(f"<p>{p}" + ("</p>" if k % 2 else "") for k, p in enumerate(paragraphs))
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site head {n}</header><nav><ul>{lis}</ul></nav><!-- x <p>no</p> -->"
        f"<div class='ad'>Buy {n}</div><{article}><h1>{title}</h1>{body}<form><input>search</form><section id=comments><p>reader says {n}</p></section></{article.split()[0]}>{extra}<aside>side {n}</aside><footer>&copy; foot {n}</footer></body></html>"
    )


def test_main_text(spark):
    rows, want = [], {}
    for n in range(24):
        paragraphs = [f"First &amp; {n}   line\n two", f"x &lt; {n} <b>bold</b><br>next", "same on all pages and long enough to count as text"][: n % 3 + 1]
        article = ["article", "div class='story'", "main"][n % 3]
        rows.append((n, f"http://host{n % 3}.example/p/{n}?q=1", page(n, f"Title {n}", paragraphs, article), "x", 1))
        want[n] = "\n".join([f"Title {n}", f"First & {n} line two", f"x < {n} boldnext" if False else f"x < {n} bold next", "same on all pages and long enough to count as text"][: n % 3 + 2])
    rows += [(100, None, None, None, None), (101, "", "", None, None), (102, "nonsense", "only text &eacute;", None, None), (103, "http://host0.example", "<p>broken <b><p>page", "x", 1), (5, rows[5][1], rows[5][2], "x", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, host int")
    out = html_text.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    for n, text in want.items():
        assert got[n] == text, n
    assert got[100] == got[101] == "" and got[102] == "only text é" and got[103] == "broken\npage"
    assert html_text.extract(df.where("false")).count() == 0


def test_alignment_infers_optionals_and_repeats():
    a, b = (html_text.expression(html_text.parse(x)) for x in ("<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul><div>d</div><p>x</p>"))
    w = html_text.merge(a, b)
    items = {x[0]: x for x in w[3]}
    assert items["div"][1] and not items["p"][1] and items["ul"][3][0][2]
    assert items["p"][3][0][3] is not None and items["ul"][3][0][3][0][3] is None  # one text is the template's, one a slot
    dl = html_text.expression(html_text.parse("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"))
    assert dl[3][0][3][0][0] == "(dt|dd)" and dl[3][0][3][0][2]


def test_long_and_odd_pages():
    assert html_text.main_text("<article>" + "<p>word</p>" * 20000 + "</article>", None).count("\n") == 19999
    assert html_text.main_text("<article><p>a<p>b</article", None) == "a\nb"
    assert html_text.main_text("a < b and <3", None) == "a < b and <3"
    assert html_text.main_text("<article><p title='a>b'>x</p>" + "<div>" * 300 + "deep", None) == "x\ndeep"
    deep = "<article><p>a</p>" + "<div><b>" * 5000 + "deep" + "</b></div>" * 5000 + "<p>z</p></article><p>out</p>"
    assert html_text.main_text(deep, None) == "a\ndeep\nz"
    e = html_text.expression(html_text.parse(deep))
    assert html_text.merge(e, html_text.expression(html_text.parse(deep.replace("<b>", "<b><i>")))) and html_text.region(e)["path"] == ["article"]
    assert html_text.load(html_text.dump(e))[3][0][0] == "article" and html_text.dump(html_text.load(html_text.dump(e))) == html_text.dump(e)


@pytest.mark.parametrize("n", [1, 146, 147, 400, 5000, 60000])
def test_no_depth_is_too_deep(n):
    page = f"<body><article>{'<div>' * n}<p>keep one</p><nav>MENU</nav><p>keep two</p>{'</div>' * n}</article></body>"
    assert html_text.main_text(page, None) == "keep one\nkeep two"
    w = html_text.merge(html_text.expression(html_text.parse(page)), html_text.expression(html_text.parse(page.replace("two", "too"))))
    assert html_text.main_text(page, html_text.region(html_text.load(html_text.dump(w)))) == "keep one\nkeep two"


@pytest.mark.parametrize("name", ["share-price", "related-work", "alert", "side-effects", "comment-free", "social-science", "search-results", "notice-period", "menu-planning", "ad-hoc"])
def test_names_that_only_resemble_furniture(name):
    text = "<h1>T</h1><p>first</p>{}<p>last</p>"
    for tag in ("p", "div", "section"):
        part = f"<{tag} class='{name}'>own text</{tag}>"
        assert html_text.main_text(f"<body><nav>n</nav><article>{text.format(part)}</article></body>", None) == "T\nfirst\nown text\nlast"
    for outer in ("article", "main", "body"):
        assert html_text.main_text(f"<{outer}><div class='{name}'>{text.format('')}</div></{outer}>", None) == "T\nfirst\nlast"
        assert html_text.main_text(f"<{outer} class='{name}'>{text.format('')}</{outer}>", None) == "T\nfirst\nlast"


@pytest.mark.parametrize("name", ["sidebar", "widget", "related", "banner", "menu"])
def test_a_name_never_empties_a_page(name):
    assert html_text.main_text(f"<body><div class={name}><h1>T</h1><p>all of it</p></div></body>", None) == "T\nall of it"
    assert html_text.main_text(f"<main><p>x</p><div class={name}><h1>T</h1><p>nearly all of it</p></div></main>", None) == "x\nT\nnearly all of it"
    assert html_text.main_text(f"<div class={name}><article><h1>T</h1><p>all of it</p></article></div>", None) == "T\nall of it"
    assert html_text.main_text(f"<main><p>the text of the page</p><div class={name}>more</div><div class=comments><p>and what a reader has to say about it, at length</p></div></main>", None) == "the text of the page"


def test_the_wrapper_decides_about_odd_names(spark):
    def post(n):
        return (
            f"<body><article><h1>T {n}</h1><div class=alert>own alert {n}</div><p>text {n}</p><div class=toc><a href=/a>part {n}</a> <a href=/b>other {n}</a></div><div class=author-note>the same note everywhere</div>"
            f"<div class=x>the same words everywhere</div></article></body>"
        )

    rows = [(n, "http://a.example/", post(n)) for n in range(5)] + [(9, "http://b.example", post(9))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for n in range(5):
        assert got[n] == f"T {n}\nown alert {n}\ntext {n}\nthe same words everywhere"
    assert got[9] == "T 9\nown alert 9\ntext 9\nthe same note everywhere\nthe same words everywhere"


def test_wrappers_stay_small_whatever_the_names():
    w, sizes = None, {}
    for n in range(1200):
        name = "".join(chr(97 + n // 26**k % 26) for k in range(3))
        e = html_text.expression(html_text.parse(f"<body><div class=p-{name}>x {n}</div><article class=a-{name}><h1>t {n}</h1><p>text {n}</p></article><footer>f</footer></body>"))
        w = e if w is None else html_text.merge(w, e)
        sizes[n] = len(html_text.dump(w))
    assert sizes[1199] < 1.1 * sizes[200] and html_text.region(w)["path"][-1] == "article.~"
    assert html_text.main_text("<body><div class=p-zz>x</div><article class=a-zzzz><h1>t</h1></article></body>", html_text.region(w)) == "t"


def naive(page):
    """The article by nested counting of tags, without wrappers: furniture is what the table's pages have of it."""
    text = re.sub("(?is)<!--.*?-->|<(script|style|title|nav|footer)\\b.*?(</\\1\\s*>|$)", "", page or "")
    text = re.sub(r"(?is)<div class=[\"']?ad\b.*?</div>", "", text)
    found = re.findall(r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|$)", text)
    lines = []
    for part in found:
        part = re.sub(r"(?i)<br\b[^>]*>", " ", part)
        for block in re.split(r"(?i)</?(?:p|h[1-6]|div|ul|li|article)\b[^>]*>", part):
            lines.append(" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", block)).split()))
    return "\n".join(x for x in lines if x)


def test_all_pages_like_a_naive_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: naive(r.html) for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(want) and sum(map(len, want.values())) > 100_000
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_extract_refuses_its_own_names(spark):
    df = spark.createDataFrame([(1, "u", "h", "t")], "page_id bigint, url string, html string, Text string")
    with pytest.raises(ValueError):
        html_text.extract(df, carry=("page_id", "Text"))


def test_furniture_inside_and_around():
    inside = (
        "<header><h1>T</h1></header><header>site</header><p>one</p><div class=shareButtons>share</div><p class=notice>n</p><div class='commentList'><p>c</p></div><aside>a</aside><div hidden><p>h</p></div>"
        "<div style='display: none'>x</div><section id=disqus_thread>d</section><div class='in-text addition'><p>two</p></div><table><tr><td>a</td><td>b</td></tr></table><ul><li>li</li></ul><footer>f</footer><noscript>ns</noscript>"
    )
    want = "T\none\ntwo\na b\nli"
    assert html_text.main_text(f"<body><nav>n</nav><article class=post>{inside}</article><div id=sideBar><p>long long text</p></div></body>", None) == want
    assert html_text.main_text(f"<body><div class=top-bar>n</div><div class=wrap><div class=content>{inside}</div><div class=sidebar><p>side text</p></div></div></body>", None) == want


def test_unmarked_article_in_several_siblings(spark):
    def post(n, body, extra=""):
        return f"<html><body><div class=brand>The Site</div><nav>n {n}</nav><div class=post><h1><a href=/{n}>Title {n}</a></h1><div class=intro>intro {n}</div>{extra}<div class=body>{body}</div></div><footer>f {n}</footer></body></html>"

    rows = [(n, "http://a.example/", post(n, f"<p>body {n} " * 6)) for n in range(4)] + [(4, "http://a.example/", post(4, "body 4 " * 9, "<div class=update>an update</div>"))]
    rows += [(5, "http://one.example/", post(5, "<p>first<p>second"))] + [(n, "http://copies.example/", post(6, "<p>first<p>second")) for n in (6, 7)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for n in range(4):
        assert got[n] == "\n".join([f"Title {n}", f"intro {n}", *[f"body {n}"] * 6])
    assert got[4] == "Title 4\nintro 4\nan update\n" + " ".join(["body 4"] * 9)
    assert got[5] == "The Site\nTitle 5\nintro 5\nfirst\nsecond" and got[6] == got[7] == got[5].replace("5", "6")
