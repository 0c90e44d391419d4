import random

import pytest

from trialquota.llm import pagetext

SCHEMA = "page_id long, url string, html string, k string, rank int"


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<p>a<br>b &amp; c&nbsp;d", ["a b & c d"]),
        ("<body class='has-sidebar'><div class=menu>m</div><p>one<p>two<div class='comments'><p>c</div>tail</body>", ["one", "two", "tail"]),
        ("<article><header><h1>T</h1></header><p><b>x.<br><p>y</p><aside>no</aside>z<footer>f</footer></article>out", ["T", "x.", "y", "z"]),
        ("<script>var a='<p>no</p>'</script>t<style>x</style>", ["t"]),
        ("a < b and c <d", ["a < b and c"]),
        ("<p>unclosed <a href=\"x", ["unclosed"]),
        ("<main><section id='comments'>hey</section><p>k</p></main>", ["k"]),
        ("<article class='comment'>c</article><article>a</article>", ["a"]),
        ("<article><div class='ad-slot'>buy</div><form>f<input></form><p title='a > b'>t</p></article>", ["t"]),
        ("<ul><li>a<li>b</ul>", ["a", "b"]),
        ("", []),
        (None, []),
        ("<" * 2000, ["<" * 2000]),
    ],
)
def test_blocks(html, wanted):
    found = pagetext.blocks(html)
    place = pagetext.ARTICLE if any(p == pagetext.ARTICLE for _, p in found) else pagetext.OPEN
    assert [t for t, p in found if p == place] == wanted


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    return table[0][0]


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(1500):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        found = pagetext.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == lcs(a, b) and found == sorted(set(found))
        assert all(any(y == a[p] for y in rest) for p in found)


def test_neighbours_remove_what_they_share(spark, monkeypatch):
    monkeypatch.setattr(pagetext, "CELL", 2)
    paths = ["a/1", "a/2", "b/1", "b/2", "c/7"]
    rows = [(i, f"http://h.x/{p}?q={i}", f"<div>Site name</div><p>Unique {i}</p><div>Copyright</div>", "x", 1) for i, p in enumerate(paths)]
    rows += [(9, "http://solo.x/1", "<div>Solo</div><p>t</p>", None, None)] * 2 + [(10, None, None, None, None), (None, "http://h.x/zz", "", None, None)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sorted((r.page_id or -1, r.text, r.n_chars) for r in pagetext.main_text(pages).collect())
    assert found == sorted([(-1, "", 0), *[(i or -1, f"Unique {i}", 8) for i in range(5) if i], (-1, "Unique 0", 8), (9, "Solo\n\nt", 7), (9, "Solo\n\nt", 7), (10, "", 0)])
    assert pagetext.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_article_keeps_text_that_neighbours_share(spark):
    html = "<nav>menu</nav><article><h1>T</h1><p>same text</p></article><div>outside</div>"
    rows = [(i, f"http://h.x/{i}", html, None, None) for i in range(3)]
    assert {r.text for r in pagetext.main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"T\n\nsame text"}
