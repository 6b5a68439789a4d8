"""Pages without article or main: all text of the article stays, whatever lies between."""

import pytest

from gridloom.llm import html_text

LONG = ["This is sentence number %d of the story. " % i * 8 for i in range(10)]


@pytest.mark.parametrize("between", ['<div class="advert">Buy now</div>', "".join(f'<p><a href="/{i}">Other story {i}</a></p>' for i in range(5))])
def test_closing_paragraph_stays(between):
    last = "The last paragraph closes the story. " * 6
    page = "<html><body>" + "".join(f"<p>{p}</p>" for p in LONG) + between + f"<p>{last}</p></body></html>"
    assert html_text.main_text(page) == " ".join(" ".join(x.split()) for x in [*LONG, last])


def test_short_closing_line_behind_an_advert_stays():
    page = "".join(f"<p>{p}</p>" for p in LONG) + '<div class="advert">Buy now</div><p>The end.</p>'
    assert html_text.main_text(page).endswith("The end.") and "Buy now" not in html_text.main_text(page)
