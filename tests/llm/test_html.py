import random
import re
from collections import Counter
from html import unescape

import pytest
from pyspark.sql import functions as F

from lodestar.llm.html import _Around, _kept, _marked, _Page, blocks_of, main_text, shared
from lodestar.llm.queries import op3_page_differencing
from lodestar.llm.urls import host_and_path

FOLDER = "/root/testdata/sf0.01"


def page(body, *more):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>" + "".join(more)


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("table_bits", [1 << 27, 16])
def test_alignment(seed, table_bits):
    rng = random.Random(seed)
    a, b = ([rng.randrange(5) for _ in range(rng.randrange(25))] for _ in range(2))
    places = shared(a, b, table_bits)
    rest = iter(b)
    assert places == sorted(set(places)) and len(places) == length(a, b)
    assert all(a[i] in rest for i in places)


@pytest.mark.parametrize("html, blocks, kinds", [
    ("", [], []),
    ("plain  text\n here", ["plain text here"], [1]),
    ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"], [1, 1, 1]),
    ("<nav><p>x</p></nav><div class='big ad'>y<b>z</b></div><p>t", ["x", "yz", "t"], [0, 0, 1]),
    ("<article class=header-image><h1>t</h1><aside>s</aside><p>&lt;b&gt; &amp;amp; &eacute;&nbsp;&#x41;</p></article>f", ["t", "s", "<b> &amp; é A", "f"], [2, 0, 2, 1]),
    ("<script>var a='<p>no</p>';</SCRIPT ><style>x</style>a<!-- <p>no --> b<textarea>no</textarea>", ["a b"], [1]),
    ("<p title='a>b' data-x=\"<p>\">ok</p><p hidden>no</p><p style='display: none'>no</p><i>a</i>&amp;<i>b</i>", ["ok", "no", "no", "a&b"], [1, 0, 0, 1]),
    ("<article><p><b>one<br><p>two</article><footer>f</footer>", ["one", "two", "f"], [2, 2, 0]),
    ("<div id=comments><article>c</article></div><main><form>f</form>m", ["c", "f", "m"], [0, 0, 2]),
    ("a < b and <3", ["a < b and <3"], [1]),
    ("<script>never closed <p>x", [], []),
])
def test_blocks(html, blocks, kinds):
    assert blocks_of(html) == (blocks, kinds)


def test_neighbours(spark):
    menu, foot = "<div>Home</div><div>About us</div>", "<div>All rights reserved</div>"
    rows = [(i, f"http://h{i % 3}.org/{'ab'[i % 2]}/{i}.html", page(f"{menu}<p>Story {i}</p><p>More of {i}</p>{foot}")) for i in range(60)]
    rows += [(100, None, None), (101, None, ""), (102, "x://alone/", page(f"{menu}<p>Alone</p>")), (103, "http://copy/1", page("<p>Same</p>")), (103, "http://copy/1", page("<p>Same</p>"))]
    rows += [(104, "http://h0.org/z", page(f"{menu}<article><p>Story 9</p><p>Home</p></article>{foot}"))]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sorted((r["row"]["page_id"], r["text"]) for r in main_text(pages).collect())
        assert got == [(i, f"Story {i}\n\nMore of {i}") for i in range(60)] + [
            (100, ""), (101, ""), (102, "Home\n\nAbout us\n\nAlone"), (103, "Same"), (103, "Same"), (104, "Story 9\n\nHome"),
        ]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert main_text(pages.limit(0)).count() == 0


def test_long_page(spark):
    body = "".join(f"<p>line {i % 5000}</p>" for i in range(20_000))
    pages = spark.createDataFrame([(1, "x://h/1", body + "<p>one</p>"), (2, "x://h/2", body + "<p>two</p>")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in main_text(pages).collect()) == ["one", "two"]


def test_query(spark):
    """The articles of the test pages are all between the tags; what is inside is cut at tags of blocks."""
    wanted = {}
    for p in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        parts = [unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", part))) for part in re.split(r"</?(?:p|h1)>", article)]
        wanted[p["page_id"]] = "\n\n".join(text for part in parts if (text := " ".join(part.split())))
    got = {r["page_id"]: r for r in op3_page_differencing(spark, FOLDER).collect()}
    assert {i: r["text"] for i, r in got.items()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_lines_repeated_inside_main(spark):
    """What both neighbours have in the main element goes; copies, lines of one neighbour and articles stay."""
    story = lambda i: f"<p>Story {i} tells at length what befell number {i}</p><p>The end of {i}</p>"
    rows = [(i, f"http://h.org/{i}", page(f"<main><p>A notice</p>{story(i)}<p>Read next</p></main>")) for i in range(1, 8)]
    rows += [(10 + i, f"http://copy.org/{i}", page(f"<main>{story(9)}</main>")) for i in range(4)]
    rows += [(20, "http://two.org/1", page(f"<main>{story(1)}<p>Quoted</p><p>Own</p></main>")), (21, "http://two.org/2", page(f"<main>{story(2)}<p>Quoted</p>{story(3)}</main>"))]
    rows += [(30 + i, f"http://licence.org/{i}", page(f"<main><p>Crumb</p><article>{story(i)}<p>Licence</p></article></main>")) for i in range(3)]
    got = {r["row"]["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    told = lambda i: f"Story {i} tells at length what befell number {i}\n\nThe end of {i}"
    assert got == {i: told(i) for i in range(1, 8)} | {10 + i: told(9) for i in range(4)} | {30 + i: f"{told(i)}\n\nLicence" for i in range(3)} | {
        20: f"{told(1)}\n\nQuoted\n\nOwn", 21: f"{told(2)}\n\nQuoted\n\n{told(3)}",
    }


@pytest.mark.parametrize("html, kinds", [
    ("<form><nav>n</nav><article><p>body</p><div class=ad>a</div></article></form>", [0, 2, 0]),
    ("<form><p>all of the text</p></form>f", [1, 1]),
    ("<form><main><p>t</p></main></form><p>a longer line</p>", [2, 1]),
    ("<div class='content has-sidebar no-comments'><p>t</p></div><div class=ad-slot>a</div><div id=site-footer>f</div>", [1, 0, 0]),
    ("<div class='page sidebar'><article>c</article></div>f", [2, 1]),
    ("<div class=sidebar><article>teaser</article></div><article>m</article>", [0, 2]),
    ("<div class=comments><article>c</article></div>f<div hidden><article>h</article></div>", [0, 1, 0]),
])
def test_wrappers_do_not_hide_the_article(html, kinds):
    assert blocks_of(html)[1] == kinds


def test_article_that_wraps_the_layout(spark):
    """What nearly all of many neighbours' articles repeat goes; what some quote stays, and so do copies."""
    told = lambda i: f"Story {i} tells at length what befell number {i}"
    quote = "A saying that every third page quotes"
    rows = [(i, f"http://h.org/{i}", page(f"<article><p>Home</p><p>{told(i)}</p>{f'<p>{quote}</p>' if i % 3 == 0 else ''}<p>Imprint</p></article>")) for i in range(100, 140)]
    rows += [(i, f"http://copy.org/{i}", page(f"<article><p>{told(9)}</p><p>End</p></article>")) for i in range(20)]
    got = {r["row"]["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: told(i) + (f"\n\n{quote}" if i % 3 == 0 else "") for i in range(100, 140)} | {i: f"{told(9)}\n\nEnd" for i in range(20)}


def test_places_without_landmarks(spark):
    """Menu entries that differ from page to page go with their place; a quotation among articles' lines stays."""
    rows = []
    for i in range(100, 150):
        menu = "".join(f"<li>entry {(i * 7 + k * 5) % 40}</li>" for k in range(4)) + f"<li>only {i}</li>"
        story = "".join(f"<p>line {k} of story {i}</p>" for k in range(8)) + ("<p>quoted</p>" if i % 9 == 0 else "")
        rows.append((i, f"http://h.org/{i}", f"<div><ul>{menu}</ul></div><div>{story}</div><div>imprint</div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = {i: "\n\n".join([f"line {k} of story {i}" for k in range(8)] + ["quoted"] * (i % 9 == 0)) for i in range(100, 150)}
    for unit in (1, 7, 1024):
        assert {r["row"]["page_id"]: r["text"] for r in main_text(pages, unit=unit).collect()} == wanted


@pytest.mark.parametrize("seed", range(20))
def test_sliding_counts(seed):
    """Counts that follow a window of pages are those of the pages in it."""
    rng = random.Random(seed)
    pages = []
    for position in range(30):
        n = rng.randrange(8)
        pages.append(_Page(position, "h", *[[rng.randrange(k) for _ in range(n)] for k in (4, 9, 5, 3)]))
    around = _Around()
    for i, p in enumerate(pages):
        around.add(p)
        if i >= 5:
            around.remove(pages[i - 5])
        held = pages[max(0, i - 4) : i + 1]
        with_key = Counter(x for q in held for x in set(q.keys))
        standing = [(key, place) for q in held for key, place in zip(q.keys, q.places, strict=True)]
        assert +around.with_key == with_key and +around.all == Counter(place for _, place in standing)
        assert +around.repeated == Counter(place for key, place in standing if with_key[key] > 1)
        assert +around.with_inner == Counter(x for q in held for x in set(q.inner_keys))


def test_units_do_not_show(spark):
    """Without landmarks the result is the same however pages are dealt, and so are the neighbours: brute force."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)(article|nav|footer)>", "<$1div>"))
    found = [{r["row"]["page_id"]: r["text"] for r in main_text(bare, near=3, unit=unit).collect()} for unit in (2, 50, 1024)]
    assert found[0] == found[1] == found[2]
    hosts = {}
    for r in bare.select("page_id", *[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"), strict=True)], "html").collect():
        hosts.setdefault(r["host"], []).append(r)
    for rows in hosts.values():
        rows.sort(key=lambda r: r["path"])
        if len({r["path"] for r in rows}) < len(rows):
            continue
        parsed = [_marked(r["html"]) for r in rows]
        made = [_Page(i, "", kinds, texts, list(map(len, texts)), places) for i, (texts, kinds, places) in enumerate(parsed)]
        for i, r in enumerate(rows):
            near, around = made[max(0, i - 3) : i + 4], _Around()
            for p in near:
                around.add(p)
            kept = _kept(made[i], [p for p in near if p is not made[i]], around)
            assert found[0][r["page_id"]] == "\n\n".join(t for t, mark in zip(made[i].keys, kept, strict=True) if mark)


def test_without_landmarks(spark):
    """The test pages as if their markup named no article: most come out right by differencing alone."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    wanted = {r["page_id"]: r["text"] for r in op3_page_differencing(spark, "/root/testdata/sf0.1").collect()}
    bare = F.regexp_replace(F.regexp_replace("html", ' (class|id)="[^"]*"', ""), "<(/?)(article|nav|footer)>", "<$1div>")
    got = {r["row"]["page_id"]: r["text"] for r in main_text(pages.withColumn("html", bare)).collect()}
    assert sum(got[i] == text for i, text in wanted.items()) > 0.6 * len(wanted)
