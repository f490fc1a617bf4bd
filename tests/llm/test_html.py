import html as entities
import re

from levylens.llm import html
from levylens.llm.queries import op4_main_text

PAGE = "<nav><a href=/x>menu {0}</a></nav><article><h1>T{0}</h1><p>text {0}</p></article><footer>foot</footer>"


def test_main_text_of_one_page():
    cases = {
        None: "", "": "", "plain  text": "plain text", "<p>a<p>b <b>c</b>d": "a b cd", "a<br>b": "a b",
        "<p>x &amp; y &lt;z&gt; &am": "x & y <z> &am", "<script>if (a<b) '</p>'</script>z": "z",
        "<style>p{}</style><p>z</p><!-- <p>no</p> -->": "z", "<p>cut <b": "cut", "a<!-- open": "a",
        "<header>site</header><p>x</p><aside>s</aside><form>f</form>": "x",
        "<article><header><h1>t</h1></header><p>x</p></article><header>site</header>": "t x",
        "<div role='navigation'>m</div><main>x<div class='ad-box'>ad</div></main>": "x",
        "<div id=cookieNotice>c</div><div class='post-body'>x</div><section class='comments'><article>c</article></section>": "x",
        "<ul><li>a<li>b<ul><li>c</ul></ul>": "a b c", "<table><tr><td>a<td>b<tr><td>c</table>": "a b c",
        "</p></div>x</article>": "x", "<a title='1 > 0'>x</a>": "x", "<article>one</article><article>two</article>": "one two",
        "<div>" * 30_000 + "deep": "deep", "< not a tag, 1 < 2 >": "< not a tag, 1 < 2 >", "<p hidden>h</p>x": "x",
    }
    for page, expected in cases.items():
        assert html.extract(page) == expected, page


def test_subtrees_that_recur_on_a_host_go(spark):
    bar = "<div class=box><p>Read our daily letter</p></div>"
    rows = [(i, f"http://a.org/{i}", f"{bar}<div><p>own words {i}</p></div>", "old") for i in range(40)]
    rows += [(100, "http://b.org/", f"{bar}<p>elsewhere</p>", "old"), (101, None, None, "old"), (102, "http://a.org/x", "", None)]
    rows += [(200 + i, f"http://copy.org/{i}", "<div><p>one article</p></div>", "old") for i in range(40)]
    rows += [(300 + i, f"http://art.org/{i}", f"<article><p>License line.</p><p>story {i}</p>{bar}</article>", "") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    got = html.main_text(df)
    assert got.columns == ["page_id", "url", "text"]
    got = {r.page_id: r.text for r in got.collect()}
    assert len(got) == len(rows)
    assert got[7] == "own words 7" and got[100] == "Read our daily letter elsewhere" and got[101] == got[102] == ""
    assert got[205] == "one article"  # copies of a page are one page
    assert got[305] == "License line. story 5"  # prose of an article stays, furniture in it goes
    assert html.main_text(df.limit(0)).collect() == []


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "http://a.org/", PAGE.format(1))] * 3, "page_id long, url string, html string")
    assert [r.text for r in html.main_text(df).collect()] == ["T1 text 1"] * 3


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op4_main_text(spark, folder).collect()}
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", page.html, re.S)[1]
        text = re.sub(r"<[^>]*>?", " ", re.sub("</?b>", "", inside))
        assert got[page.page_id].text == " ".join(entities.unescape(text).split())
        assert got[page.page_id].n_chars == len(got[page.page_id].text)


def test_wrappers_with_a_furniture_word_keep_their_article():
    pages = {
        "<div class='content-sidebar-wrap'><article><p>x</p></article></div>": "x",
        "<main class='no-sidebar'><p>x</p></main>": "x",
        "<div id='page-with-navigation'><h1>x</h1><p>y</p></div><div class='nav-box'><p>n</p></div>": "x y",
        "<form><main><p>x</p></main><button>b</button></form>": "x",
        "<article><p>x</p><div class='share-box'>s</div></article><div class='sidebar'><article>c</article></div>": "x",
    }
    for page, text in pages.items():
        assert html.extract(page) == text, page


def test_whole_furniture_words_spare_the_article():
    pages = {
        "<div class='search'><article><p>x</p></article></div>": "x",
        "<div id='related'><main><p>x</p></main></div><p>y</p>": "x",
        "<main class='content widget'><p>x</p></main>": "x",
        "<article class='post sponsored'><p>x</p></article>": "x",
        "<article><p>x</p></article><article class='sponsored'><p>an advert of some length</p></article>": "x",
        "<article><p>x</p></article><div class='related'><article><p>another story</p></article></div>": "x",
        "<div><p>post</p></div><div class='comments'><article><p>a much longer comment</p></article></div>": "post",
        "<nav><main><p>x</p></main></nav><p>y</p>": "y",
    }
    for page, text in pages.items():
        assert html.extract(page) == text, page


def site(rng, host, n):
    """Pages of one host: own prose in a plain block, boxes that some pages share."""
    boxes = [f"<div class=b{k}><p>box {k} of {host}</p><ul><li>one {k}<li>two {k}</ul></div>" for k in range(6)]
    rows = []
    for i in range(n):
        parts = [f"<section><p>{host} story {i} {rng.random()}</p></section>"]
        parts += [b for k, b in enumerate(boxes) if rng.random() < (k + 1) / 8]
        if rng.random() < 0.1 and rows:
            rows.append((f"http://{host}/{i}", rows[-1][1]))
            continue
        rng.shuffle(parts)
        rows.append((f"http://{host}/{i}", "<body>" + "".join(parts) + "</body>"))
    return rows


def test_counts_against_brute_force(spark):
    """Every subtree's pages are counted by walking all pages of the host."""
    import collections
    import random

    rng = random.Random(6)
    rows = [r for h, n in (("a.org", 14), ("b.org", 70), ("c.org", 300)) for r in site(rng, h, n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df.repartition(5)).collect()}
    pages = collections.defaultdict(set)
    for url, page in rows:
        host, text = url.split("/")[2], html.extract(page)
        for box in re.findall(r"<div class=b\d>.*?</div>", page):
            pages[host, box].add(text)
    changed = 0
    for i, (url, page) in enumerate(rows):
        kept = page
        for box in re.findall(r"<div class=b\d>.*?</div>", page):
            if len(pages[url.split("/")[2], box]) >= html.MIN_PAGES:
                kept = kept.replace(box, "")
        changed += kept != page
        assert got[i] == html.extract(kept)
    assert 0.5 * len(rows) < changed < len(rows)


def test_a_template_needs_the_same_count_on_every_host(spark):
    """A box on 12 of 400 pages goes as it does on 12 of 12."""
    bar = "<div class=box><p>Spring sale</p></div>"
    rows = [(i, f"http://big.org/{i}", f"<div><p>story {i}</p></div>{bar if i < 12 else ''}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all("Spring" not in r.text for r in html.main_text(df).collect())
