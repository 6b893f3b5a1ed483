"""Single pages whose article, menus and comments are known."""

import pytest

from veilspark.llm import html

LONG = "This is a sentence of the article, with a comma and enough words to count as text. " * 4


def text(body):
    return html.read(html.parse(f"<html><body><nav><a href=x>Menu</a></nav>{body}<footer>Foot</footer></body></html>"), None)


CASES = [
    ('<div class="post search-result"><p>{L}</p></div>', "{L}"),
    ('<article><p>{L}</p><div id="related-work"><p>{L}</p></div></article>', "{L} {L}"),
    ('<article><p>{L}</p><div class="search"><p>{L}<b>x</b></p></div></article>', "{L} {L}x"),
    ('<article><p>{L}</p><div class="related"><ul><li><a href=a>{L}</a></li></ul></div></article>', "{L}"),
    ('<article><p>{L}</p><div class="related">See also</div></article>', "{L}"),
    ('<article><p>{L}</p><div class="search"><div class="ads"><p>{L}</p></div><section><p>{L}</p></section></div></article>', "{L} {L}"),
    ('<div class="post-comments"><p>{L}</p><p>{L}</p></div><div class="entry"><p>{L}</p></div>', "{L}"),
    ('<article><p>{L}</p><p hidden>{L}</p><div style="color:red; display: none"><p>{L}</p></div></article>', "{L}"),
    ('<article><p>{L}</p><div hidden="until-found">{L}</div><p data-x="hidden" class="hidden-gem">{L}</p></article>', "{L} {L}"),
    ('<article><p>{L}</p></article><div class="reader-responses"><p>{L}</p><p>{L}</p></div>', "{L}"),
    ('<article><p>{L}</p></article><ol class="thread"><li>{L}</li><li>{L}</li></ol>', "{L}"),
    ('<article><p>{L}</p><!--><p>{L}</p><!---><p>{L}</p><!-- no --!><p>{L}</p><!-- no --></article>', "{L} {L} {L} {L}"),
    ('<article><p>{L}</p><!-- never ends <p>{L}</p></article>', "{L}"),
]


@pytest.mark.parametrize("body, want", CASES)
def test_known_articles(body, want):
    assert text(body.replace("{L}", LONG.strip())) == want.replace("{L}", LONG.strip())


def test_what_stays_aside_in_an_aside():
    page = text(f'<aside><article><div class="search"><p>{LONG}</p></div></article></aside><main><p>{LONG}</p></main>')
    assert page == LONG.strip()
