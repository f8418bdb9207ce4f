import time

import pytest

from graphlens.llm import html


@pytest.mark.parametrize("quote", ['"', "'"])
@pytest.mark.parametrize("n", [100, 5000, 300_000])
def test_markup_in_a_long_attribute_is_no_text(quote, n):
    body = "A sentence that is long enough to be the body of a page, with commas, and a full stop. " * 5
    page = f"<html><body><article><div data-x={quote}{'a' * n}<p>LEAK</p>{quote}><p>{body}</p></div></article></body></html>"
    assert html.main_text(page) == body.strip()


def test_a_quote_without_an_end_falls_back():
    body = "A sentence that is long enough to be the body of a page, with commas, and a full stop. " * 5
    assert html.main_text(f'<article><div data-x="a><p>{body}</p></div></article>') == body.strip()


def test_many_tags_without_an_end_take_linear_time():
    start = time.process_time()
    html.main_text('<a ">" ' * 40_000 + "'")
    assert time.process_time() - start < 10
