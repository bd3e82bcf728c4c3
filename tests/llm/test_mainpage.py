import html
import random
import re

import numpy as np
import pytest

from tablewright.llm import mainpage
from tablewright.llm.queries import QUERIES
from tests.conftest import SF_DIR


def main(page):
    return "\n".join(t for t, k in mainpage.text_lines(page) if k == mainpage.MAIN_LINE)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four &copy;&nbsp;x</p></article>", "A & B\none two three\nfour © x"),
        ("<nav>menu</nav><div class='ad'>buy</div><article><p>x</p><div class=\"share social\">tweet</div></article><footer>f</footer>", "x"),
        ("<main><header><h1>title</h1></header><form>q<input></form><section id=comments><p>hi</p></section><p>y", "title\ny"),
        ("<article><p>a<script>var t='</p><p>no';</script>b</p><!-- <p>no</p> --><style>p{}</style><p>c</article>d", "ab\nc".replace("ab", "a b")),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n2\n3\n4"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p hidden>no</p><p style='display:none'>no</p><p title='a > b'>yes</p>", "yes"),
        ("<article>x<p/>y</article>", "x\ny"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ("<article><p>1 < 2 &lt;b&gt; 3</p></article>", "1 < 2 <b> 3"),
    ],
)
def test_marked_articles(page, text):
    assert main(page) == text


def brute_lcs(a, b):
    size = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            size[i + 1, j + 1] = size[i, j] + 1 if a[i] == b[j] else max(size[i, j + 1], size[i + 1, j])
    return size[-1, -1]


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [np.array([rng.randrange(5) for _ in range(rng.randrange(14))], np.int64) for _ in range(2)]
        taken = sorted(mainpage.shared_lines(a, b))
        assert len(taken) == brute_lcs(a, b)
        rest = iter(b.tolist())
        assert all(any(x == y for y in rest) for x in a[taken].tolist())


def test_query_gives_the_articles(spark):
    """The article elements of the test pages hold plain paragraphs, so a pattern can say what they are."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = QUERIES["op4_main_text"](spark, SF_DIR).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def unmarked(i, body):
    return f"<body><div>Site of all</div><p>Welcome back</p><p>{body}</p><p>Body {i} goes on</p><div>All rights {i % 2}</div><p>Bye</p></body>"


def test_template_lines_go(spark):
    rows = [(i, f"http://host/dir/{i}?q={i}", unmarked(i, f"Story {i}")) for i in range(9)] + [(100, "http://other/dir/1", unmarked(1, "Alone")), (101, None, None), (102, "no url", "<p>odd"), (103, "no url", "<p>odd")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(5)
    got = {r.page_id: r.text for r in mainpage.extract_main_text(pages).collect()}
    assert all(got[i].replace(f"All rights {i % 2}", "").strip() == f"Story {i}\nBody {i} goes on" for i in range(9))
    assert got[100].startswith("Site of all")
    assert got[101] == "" and got[102] == got[103] == "odd"


def test_one_hot_host_and_repeated_rows(spark):
    page = unmarked(1, "Same")
    pages = spark.createDataFrame([(1, "http://h/a", page)] * 50 + [(2, "http://h/b", "<p>x</p>" * 3000)], "page_id long, url string, html string")
    got = mainpage.extract_main_text(pages).collect()
    assert len(got) == 51 and len({r.text for r in got}) == 2 and all(r.text for r in got)
    assert mainpage.extract_main_text(pages.where("false")).count() == 0


def test_runs_of_equal_pages_lose_their_template(spark):
    """Copies next to each other are differenced with the next other page, all alike."""
    rows = [(i, f"http://h/a/{i // 2:02}", unmarked(1, "Same")) for i in range(40)] + [(90, "http://h/b", unmarked(3, "Other")), (91, "http://h/c", unmarked(5, "Third"))]
    got = {r.page_id: r for r in mainpage.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()}
    assert len(got) == 42
    assert {(got[i].text, got[i].n_template) for i in range(40)} == {("Same\nBody 1 goes on", 4)}
    assert got[90].text == "Other\nBody 3 goes on" and got[91].text == "Third\nBody 5 goes on"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a<svg width='1'/>b</p><p>c</p><svg><text>no</text></svg><p>d</p></article>", "a b\nc\nd"),
        ("<article><p>a</p><math/><p>b</p></article>", "a\nb"),
        ("<article><p>a<object data='x'>no</p><p>b</p></article>", "a\nb"),
        ("<article><select><option>no<p>b</p></article>", "b"),
        ("<article><p>a</p><script>no<p>no</p></article>", "a"),
    ],
)
def test_raw_elements_without_an_end(page, text):
    assert main(page) == text
