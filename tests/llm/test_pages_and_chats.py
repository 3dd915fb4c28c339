"""Page extraction and chat formatting against plain Python, on odd rows and on none."""

import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactmill.llm import chat, html_content

LONG = "This is a long sentence, with commas; and it goes on for a while. " * 4


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


ARTICLE = f"<h1>Head</h1><p>{LONG}<p>Short.</p><ul><li>One<li>Two</ul><p>A <b>bo</b>ld&nbsp;&amp; <i>fine</i>\n\n end &lt;x&gt;</p>"
WANT = f"Head {LONG.strip()} Short. One Two A bold & fine end <x>"


@pytest.mark.parametrize("html, want", [
    (page(f"<nav><a>Home</a><a>News</a></nav><article>{ARTICLE}</article><footer>(c) Us, all of us.</footer>"), WANT),
    (page(f"<header><h1>Site</h1><p>{LONG}</p></header><main>{ARTICLE}<aside>{LONG}</aside></main>"), WANT),
    (page(f'<div id="menu"><a>a</a></div><div class="story">{ARTICLE}<div class="comments"><p>{LONG * 3}</p></div></div>'), WANT),
    (page(f'<article>{ARTICLE}<form>Name <input> {LONG}</form><script>if (a < b) "</p>";</script></article>'), WANT),
    (page(f'<div class="cookie-notice">{LONG}</div><div class="ad">{LONG}</div><article>{ARTICLE}<!-- {LONG} --></article>'), WANT),
    (page(f"<article>{ARTICLE}"), WANT),
    (page("<article><p>Tiny.</p></article><div class='ad'>Buy this, it is good, really good, now.</div>"), "Tiny."),
    ("only text &eacute;", "only text é"),
    ("<p>a<p>b<br>c", "a b c"),
    ("<script>x</script>", ""), ("<", "<"), ("", ""), (None, ""),
])
def test_main_text(html, want):
    assert html_content.main_text(html) == want


@pytest.mark.parametrize("html, want", [
    (page(f'<div class="post has-sidebar">{ARTICLE}</div>'), WANT),
    (page(f'<div id="content" class="content no-sidebar"><article>{ARTICLE}</article></div><div class="sidebar">{LONG}</div>'), WANT),
    (page(f'<div class="post category-social tag-cookies">{ARTICLE}</div>'), WANT),
    (page(f'<article class="with-share">{ARTICLE}<div class="share">Like, share.</div></article>'), WANT),
    (page(f'<div class="widget"><article>{ARTICLE}</article></div><div class="comments"><p>{LONG * 20}</p></div>'), WANT),
    (page(f'<div class="social">{ARTICLE}<div class="comments"><p>{LONG * 20}</p></div></div>'), WANT),
    (page(f'<div class="modal"><p>{LONG}</p></div>'), LONG.strip()),
    (page(f'<div class="story">{ARTICLE}</div><div class="comments"><p>{LONG * 20}</p></div>'), WANT),
    (page(f'<div class="comment">{LONG}</div>'), LONG.strip()),
    (page(f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>"), f"{LONG.strip()} So x=1."),
])
def test_names_only_vote(html, want):
    assert html_content.main_text(html) == want


MORE = "Another long sentence, with marks; and it goes on for a while, too. "


@pytest.mark.parametrize("html, want", [
    (page(f"<div class=story><h1>Head</h1><div class=lead><p>{MORE}</p></div><div class=text>{f'<p>{MORE * 2}</p>' * 8}</div></div>"), f"Head {MORE * 17}".strip()),
    (page(f"<article><h1>Head</h1><p>{LONG * 9}</p></article><article><h2>Part</h2><p>{LONG}</p></article>"), f"Head {LONG * 9}Part {LONG}".strip()),
    (page(f"<section><p>{LONG}</p></section><section><p>{LONG * 9}</p><p>End.</p></section>"), f"{LONG * 10}End."),
    (page(f"<h1>Head</h1><p>By <a>me</a></p><div class=text><p>{LONG * 9}</p></div>{MORE * 4}<i>more</i> of it"), None),
    (page(f"<div><h1>Head</h1><div>{MORE * 4}<b>and</b> so on.</div></div><div>{f'<p>{LONG}</p>' * 9}</div>"), f"Head {MORE * 4}and so on. {LONG * 9}".strip()),
])
def test_all_that_passes_is_kept(html, want):
    got = html_content.main_text(html)
    assert got == (want or f"Head By me {LONG * 9}{MORE * 4}more of it")


TALK = "".join(f"<div><b>{who}</b><p>{MORE * 3}</p><a>Reply</a></div>" for who in ("Ann", "Bob", "Cy"))
FOUR = f"<h1>Head</h1>{f'<p>{LONG}</p>' * 4}"
WANT_FOUR = f"Head {LONG * 4}".strip()


@pytest.mark.parametrize("html, want", [
    *((page(f"<main><article>{FOUR}</article></main><div class={name}><p>{MORE * 5}</p><p>{MORE * 4}</p></div>"), WANT_FOUR) for name in ("thread", "box", "legal", "teaser")),
    (page(f"<main><article>{FOUR}</article><div class=thread>{TALK}</div></main>"), WANT_FOUR),
    (page(f"<div class=box>{MORE * 9}</div><article>{FOUR}</article><p>{MORE * 9}</p>"), WANT_FOUR),
    (page(f"<article>{FOUR}<div class=thread>{TALK}</div></article>"), WANT_FOUR),
    (page(f"<article>{FOUR}<article><p>{MORE * 4}</p></article><article><p>{MORE * 3}</p></article></article>"), WANT_FOUR),
    (page(f"<div class=text>{FOUR}</div><div class=thread>{TALK * 3}</div>"), WANT_FOUR),
    (page(f"<main><h1>Head</h1><p>{MORE * 2}</p><article>{f'<p>{LONG}</p>' * 4}</article></main>"), f"Head {MORE * 2}{LONG * 4}".strip()),
    (page(f"<div class=hero><article><h1>Head</h1><p>Hi.</p></article></div><div>{f'<p>{LONG}</p>' * 9}</div>"), None),
    (page(TALK), " ".join(f"{who} {MORE * 3}Reply" for who in ("Ann", "Bob", "Cy"))),
    (page(f"<article>{FOUR}{f'<section><h2>Part</h2><p>{LONG}</p><a>More</a></section>' * 3}</article>"), f"{WANT_FOUR} {f'Part {LONG}More ' * 3}".strip()),
    (page(f'<article>{FOUR}<p title="a > b">{LONG}</p><p class="x>{LONG}</p></article>'), f"Head {LONG * 6}".strip()),
])
def test_what_no_name_gives_away(html, want):
    got = html_content.main_text(html)
    assert got == want if want else got.count(LONG.strip()) == 9


N = 200_000


@pytest.mark.parametrize("html, n_chars", [
    ("<b>x. " * N, 3 * N - 1), ("<div class=q>a. " * N, 3 * N - 1), ("<p><i>x</p>" * N, 2 * N - 1), ("<a " * N, 3 * N - 1),
    ('<a b=">" ' * N, None), ('<a b=">" ' * N + "c='", None), ("<b>" * N + "</x>" * N, 0), ("<b>" * N + "<p>x" * N, 2 * N - 1), ("<script>" + "</script " * N, 0),
    ("<!--" * N, 0), ("&#" + "9" * 6000 + ";", 1),
])
def test_deep_and_broken_pages_take_linear_time(html, n_chars):
    start = time.process_time()
    got = html_content.main_text(html)
    assert time.process_time() - start < 40
    assert n_chars is None or len(got) == n_chars


def test_ratios_by_brute_force():
    """Fused ratios of a flat page against plain arithmetic over its paths."""
    lines = [("p", LONG), ("p", "One, two."), ("li", "menu"), ("p", LONG * 2), ("li", "entry."), ("p", MORE)]
    parsed = html_content._Page("".join(f"<{tag}>{text}</{tag}>" for tag, text in lines))
    for t in parsed.texts:
        t.n_chars, t.marks = len("".join(t.text.split())), len(re.findall(r"[.,;:!?]", t.text))
    mean = lambda tag, size: np.mean([size(text) for other, text in lines if other == tag])
    length = [mean(tag, lambda x: len("".join(x.split()))) for tag, _ in lines]
    marks = [mean(tag, lambda x: len(re.findall(r"[.,;:!?]", x))) for tag, _ in lines]

    def smooth(values, i):
        near = [(np.exp(-((i - j) ** 2) / 2), v) for j, v in enumerate(values) if abs(i - j) <= 2]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    want = [smooth(length, i) * (1 + smooth(marks, i)) for i in range(len(lines))]
    fused = html_content._ratios(parsed, parsed.texts)
    assert np.allclose(fused, want)
    cut = min(html_content.CUT * np.std(want), max(want))
    assert html_content._passing(parsed, parsed.texts, html_content.CUT) == [v >= cut for v in want]


def test_extract_keeps_rows(spark):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>")), (1, "u", page(f"<article>{ARTICLE}</article>")), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = html_content.extract(pages).collect()
    assert Counter((r.page_id, r.url, r.n_chars) for r in got) == Counter({(1, "u", len(WANT)): 2, (2, None, 0): 1, (None, "v", 0): 1, (3, "w", 999_999): 1})
    assert html_content.extract(pages.where("false")).count() == 0


def rendered(turns):
    return "".join(f"<|im_start|>{r or 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in turns)


def collapse(rows):
    """What stays, by comparing every conversation with every other one."""
    conversations = {}
    key = lambda r: (r[0], r[1] is None, r[1] or 0, r[2] is None, r[2] or "", r[3] is None, r[3] or "")
    for i, _, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        conversations.setdefault(i, []).append((role, text))
    kept = {}
    for i, turns in sorted(conversations.items()):
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in conversations.values()):
            kept.setdefault(tuple(turns), []).append(i)
    return {(ids[0], len(turns), len(ids), rendered(turns)) for turns, ids in kept.items()}


@pytest.fixture(scope="module")
def rows():
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), (None, "x"), ("user", "")]
    out = [(i, k, *turn) for i in range(1, 6) for k, turn in enumerate(talk[:i])]
    out += [(7, k, *turn) for k, turn in enumerate(talk)]  # equal to 5
    out += [(8, 0, "user", "hi"), (8, 1, "assistant", "other")]  # shares a first turn
    out += [(9, 0, "user", "hi"), (9, 0, "user", "hi"), (9, None, "user", "last")]  # tied, repeated and null turns
    out += [(None, 0, "user", "lost"), (10, 0, "user", "<|im_start|>system"), (11, 0, None, None)]
    return out + [(12, k, "user", f"t{k}") for k in range(700)] + [(13, k, "user", f"t{k}") for k in range(699)]


def test_chats(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("prefix", F.lit(1))
    got = chat.format_chats(turns.repartition(5)).collect()
    whole = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.part)):
        head = whole.setdefault((r.conv_id, r.n_turns, r.n_copies), [])
        assert r.part == len(head)
        head.append(r.text)
    want = {(i, n, c, t.replace("<|im_start|>system", "< |im_start|>system")) for i, n, c, t in collapse(rows)}
    assert {(*k, "".join(v)) for k, v in whole.items()} == want
    assert chat.format_chats(turns.where("false")).count() == 0
