"""The words of a block count wherever they stand in it."""

import random
import time

import pytest


def test_all_words_of_a_block_are_hashed():
    from tidelog.llm import html_text as h

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    for place in (0, 11, 12, 40, 299):
        text = " ".join([*words[:place], "sponsored", *words[place:]])
        page = f"<body><div>{text}</div></body>"
        slots = h.features(page)[0][0][1]
        assert h._slot("sponsored", h.WORD_SLOTS) in slots and len(slots) == len(dict.fromkeys(text.split())) + 2  # with the slots of length and links


SHAPES = [
    ("<article><h1>Recipe</h1><ul>" + "".join(f"<li>{i} cups of flour</li>" for i in range(1, 7)) + "</ul><p>Mix all of it well and bake it for an hour.</p></article>", 8),
    ("Just a plain text without any tags at all.", 1),
    ("<div>A first short block.</div><div>And another one here.</div>", 2),
    ("<article><p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><noscript><p>A figure of the growth of trees over the years.</p></noscript></article>", 2),
    ("<main><h1>Prices</h1><table><tr><td>Apple</td><td>3</td></tr><tr><td>Pear</td><td>4</td></tr></table></main>", 5),
    ("<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Words</h1><dl><dt>Apple</dt><dd>A fruit of a tree</dd></dl><ol><li>One thing</li><li>Second thing</li></ol></article><footer>Copyright us</footer></body>", 5),
]


@pytest.mark.parametrize("page,n", SHAPES)
def test_shapes_of_text(page, n):
    from tidelog.llm import html_text as h

    text = h.main_texts(h.trained(), [page])[0]
    assert len(text.split("\n")) == n and "Home" not in text and "Copyright" not in text


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<!" * 500_000, "<div>x" * 20_000, "<a '\">" * 150_000, "<p>a</p>" * 20_000, "<b>" * 200 + "</x>" * 50_000, "<" * 1_000_000, "<!--" * 200_000, "<a 'x>y' b>z</a>" * 20_000])
def test_odd_pages_take_linear_time(page):
    from tidelog.llm import html_text as h

    model, start = h.trained(), time.time()
    h.main_texts(model, [page, "<p>short</p>"])
    assert time.time() - start < 20


def test_a_long_page_is_no_padding_of_short_ones():
    import tracemalloc

    from tidelog.llm import html_text as h

    pages = ["<p>a</p>" * 20_000, *["<p>b</p>"] * 63]
    model = h.trained()
    tracemalloc.start()
    h.main_texts(model, pages)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
