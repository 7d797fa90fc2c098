"""Vector search, page text and quotations against brute force, fixed pages and SQL."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.llm import pivot_topk, quotes, wrapper
from emberline.llm.dom import parse


def brute_top(rows, k):
    sound = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in sound:
        if q % 7 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)
            yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k]))


@pytest.mark.parametrize("block_rows", [8, 2048])
def test_top_k_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # one vector many times
    rows += [rows[7], rows[7], (14, rows[1][1])]  # rows that repeat a query, and a second row of its id
    rows += [(7 * 50, None), (301, [1.0, None] + [0.0] * 4), (302, [float("nan")] + [0.0] * 5), (303, [float("inf")] + [0.0] * 5),
             (304, [1.0, 2.0]), (305, []), (None, [1.0] * 6), (308, [0.0] * 6)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string")
    got = pivot_topk.top_k(table, F.col("vec_id") % 7 == 0, pivots=5, block_rows=block_rows, group=4)
    assert sorted(map(tuple, got.collect())) == sorted(brute_top(rows, 5))


def test_top_k_answers_every_row_of_a_repeated_query(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (2, [3.0]), (3, [0.5])]
    got = pivot_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=3)
    once = [(0, 1, 2, 256 * 768), (0, 2, 1, 256 * 512), (0, 3, 3, 256 * 128)]
    assert sorted(map(tuple, got.collect())) == sorted(once * 2)


def test_top_k_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind)
    assert [tuple(r) for r in pivot_topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert pivot_topk.top_k(spark.createDataFrame([], kind), F.col("vec_id") == 0).count() == 0


def page(i, body):
    return (f"<html><head><title>x</title><script>var a = '<p>no</p>';</script></head><body><header><h1>Site</h1></header>"
            f"<nav><ul><li>Home<li>Page {i}</ul></nav><div class='cookie-notice'><p>We use cookies</p></div>{body}"
            f"<aside><p>also read {i}</p></aside><form><p>your name</p></form>"
            f"<section id='comments'><p>first! {i}</p></section><footer>&copy; {i}</footer></body></html>")


def test_main_text_of_pages(spark):
    lorem = ["alpha beta gamma " * n for n in range(2, 9)]
    rows = [(i, f"https://a.example.com/{i}", page(i, f"<article><h1>T {i}</h1><p>One &amp; <b>{t}\n</b><p>Same line.</p>"
                                                      f"<div class='ad'>Buy</div><blockquote>q<br>r</blockquote></article>"))
            for i, t in enumerate(lorem)]
    rows += [(20 + i, f"http://b.example.com/{i}", page(i, f"<div id=body><h2>H {i}</h2><p>{t}</p><p>more {t}</p></div>"))
             for i, t in enumerate(lorem)]
    rows += [(40, None, None), (41, "not a url", ""), (42, "http://c.example.com", "plain &lt;text"), (40, None, None),
             (43, "http://d.example.com", "<div>" * 3000 + "deep"), (44, "http://a.example.com", "<article><p>cut &am")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, template string, salt int")
    got = {r.page_id: r for r in wrapper.main_text(table).collect()}
    for i, t in enumerate(lorem):
        body = " ".join(t.split())
        assert got[i].text == f"T {i}\n\nOne & {body}\n\nSame line.\n\nq r"
        assert got[20 + i].text == f"H {i}\n\n{body}\n\nmore {body}"
    assert got[40].text == got[41].text == "" and got[42].text == "plain <text" and got[43].text == "deep"
    assert got[44].text == "cut &am" and got[44].n_chars == 7
    assert wrapper.main_text(table).count() == len(rows)
    assert wrapper.main_text(table.limit(0)).count() == 0


KINDS = "page_id long, url string, html string"


def test_templates_of_all_pages_decide(spark):
    """Constant paragraphs of a host are template, wherever they stand; copies of one article are not."""
    rng = random.Random(9)

    def words(n):
        return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))

    rows, expected = [], {}
    for i in range(60):
        title, first, second = words(4), words(30), words(20)
        rows.append((i, f"http://news.example.com/{i}", page(i, (
            f"<article><div class='article-header'><h1>{title}</h1></div><p class='byline'>By the staff desk</p><p>{first}</p>"
            f"<section class='menu-items'><p>{second}</p></section><div class='promo-box'>Buy {i}</div>"
            f"<div class='after'>Subscribe to our letter</div></article>"))))
        expected[i] = "\n\n".join((title, first, second))
    body = words(50)
    for i in range(100, 120):  # the same article again and again, but for a word
        rows.append((i, f"http://copies.example.com/{i}", page(i, f"<article><h1>One</h1><p>{body}</p><p>copy {i}</p></article>")))
        expected[i] = f"One\n\n{body}\n\ncopy {i}"
    table = spark.createDataFrame(rows, KINDS)
    for parts in (1, 7):
        got = {r.page_id: r.text for r in wrapper.main_text(table.repartition(parts)).collect()}
        assert got == expected
    # Without a template the landmark would keep what the host repeats.
    assert "Subscribe" in wrapper.extract(rows[0][2], None)


@pytest.mark.parametrize("block", [
    "<h1 class='entry-header'>Kept words</h1>", "<div class='article-header'><h1>Kept words</h1></div>",
    "<section class='menu-items'><p>Kept words</p></section>", "<p class='ad-free'>Kept words</p>",
    "<blockquote class='reply'>Kept words</blockquote>"])
def test_class_words_of_an_article_drop_nothing(block):
    assert wrapper.extract(page(1, f"<article>{block}<p>x</p><div class='cookie-notice'>gone</div><div class='ad'>gone</div></article>"),
                           None) == "Kept words\n\nx"


@pytest.mark.parametrize("depth", [1, 100, 125, 400])
def test_asides_count_at_any_depth(depth):
    html = "<div>" * depth + "<nav><ul><li>menu entry</li></ul></nav><p>words</p>" + "</div>" * depth
    assert wrapper.extract(html, None) == "words"


def test_matching_is_the_largest_order_preserving_one():
    left = parse("<div><h1>a</h1><ul><li>x</ul><p>b</div><section><p>c</section>")
    right = parse("<div><p>z</div><section><p>c</section><div><h1>a</h1><p>b</div>")
    size, pairs = wrapper.matching(left.children, right.children)
    assert size == 4 and pairs == [(0, 0), (1, 1)]


def talk(rng):
    """Talks with quotations of several levels, wrapped anew, changed, or of messages that are missing."""
    rows = []
    for c in range(25):
        texts = []
        for t in range(rng.randint(1, 20)):
            own = [rng.choice([f"Line {rng.randint(0, 40)} of, été!", "", "I agree."]) for _ in range(rng.randint(0, 4))]
            if texts and rng.random() < 0.7:
                mark, source = rng.choice([">", "> "]), rng.choice(texts)
                if rng.random() < 0.3:
                    source = source.replace(" of, ", rng.choice([" of\n", " some, "]))
                own = rng.choice([[], ["On Monday X wrote:"]]) + [mark + x for x in source.split("\n")] + own
            texts.append("\n".join(own))
            rows.append((c, t, rng.choice(["user", "assistant"]), texts[-1] if rng.random() < 0.9 else None))
    return rows + [(None, 1, "user", "> a"), (5, None, "user", "x"), (3, 1, "user", "> > deep\n>"), (900, 0, None, ""), rows[40], rows[40]]


def test_passages_and_levels_link(spark):
    first = "The quick brown fox jumps over it.\nAnd back again, slowly."
    rows = [
        (1, 0, first), (1, 1, None), (1, 2, "> I agree\n>> The quick brown fox jumps over it.\n>> And back again, slowly.\nMe too"),
        (2, 0, "one line that is wrapped anew"), (2, 1, "> one line that\n> is wrapped anew\nyes"),
        (3, 0, first), (3, 1, "> The quick brown fox jumps over it. And back again, slowly.\n\nok"),
        (4, 0, "Yes.\nthe longer passage of them"), (4, 1, "Yes."), (4, 2, "> Yes.\n> the longer passage of them\nwell"),
        (4, 3, "> well\n>> Yes.\n>> the longer passage of them\nso"), (5, 0, ">" * 20_000 + " x\n" * 20_000)]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn(
        "role", F.lit("user"))).collect()}
    assert {k: r.reply_to for k, r in got.items() if r.reply_to is not None} == {(1, 2): 0, (2, 1): 0, (3, 1): 0, (4, 2): 0, (4, 3): 2}
    assert got[1, 2].originals == "2:0" and got[4, 3].originals == "1:2,2:0"
    assert [got[4, t].reply_order for t in range(4)] == [1, 4, 2, 3] and got[4, 3].depth == 2 and got[5, 0].max_level == 20_000


def test_answers_equal_sql(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 4)
    rows = talk(random.Random(2))
    table = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, level int")
    got = quotes.link(table)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    database = duckdb.connect()
    database.register("conversations", conversations)
    expected = database.sql(f"SELECT {', '.join(got.columns)} FROM ({quotes.SQL})").fetchall()
    found = [tuple(r) for r in got.collect()]
    assert sum(r[3] is not None for r in found) > 50 and max(r[6] for r in found) > 2 and sum("," in r[4] for r in found) > 10
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert quotes.link(table.limit(0)).count() == 0


def test_no_python_in_the_quotation_plan(spark):
    table = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "> a\nb")], "conv_id long, turn long, role string, text string")
    plan = quotes.link(table)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
