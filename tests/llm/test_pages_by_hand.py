"""Pages written by hand: what HTML says of odd tags and comments, and readers' comments wherever they stand."""

import pytest

from quillon.llm import maintext
from quillon.llm.dom import parse

LINE = "This is a sentence of prose that has about a hundred letters in it, so that it looks like any other text."
NAV, FOOT = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">Other page</a></li></ul></nav>', "<footer>&copy; 2020 Someone</footer>"
SAID = "I agree with all of this, and I have said so for years. Nobody listened to me then."


def page(inside, behind=""):
    return f"<!DOCTYPE html><html><body>{NAV}<article><h1>A title</h1>{inside}</article>{behind}{FOOT}</body></html>"


P3 = f"<p>{LINE}</p>" * 3
WANT3 = ["A title"] + [LINE] * 3
PAGES = {
    "script with a slash": (page(f'<script src="a.js"/>var secret = 1; document.write("x");</script>{P3}'), WANT3),
    "style with a slash": (page(f"<p>{LINE}</p><style/>p.x{{color:red}}</style><p>{LINE}</p><p>{LINE}</p>"), WANT3),
    "empty comment": (page(f"<p>{LINE}</p><!--><p>{LINE}</p><p>{LINE}</p>"), WANT3),
    "empty comment with a hyphen": (page(f"<p>{LINE}</p><!---><p>{LINE}</p><p>{LINE}</p>"), WANT3),
    "comment with a bang": (page(f"<p>{LINE}</p><!-- hidden --!><p>{LINE}</p><p>{LINE}</p>"), WANT3),
    "comment with tags": (page(f"<p>{LINE}</p><!-- <p>hidden</p> -- > --><p>{LINE}</p><p>{LINE}</p>"), WANT3),
    "box with a slash": (page(f"<div/>{P3}</div>"), WANT3),
    "paragraphs with slashes": (page(f"<p/>{LINE}<p/>{LINE}<p/>{LINE}"), WANT3),
    "thread in the article": (page(f'{P3}<div id="disqus_thread"><p>{SAID}</p><p>{SAID}</p></div>'), WANT3),
    "list in the article": (page(f'{P3}<ul class="comments"><li>{SAID}</li><li>{SAID}</li></ul>'), WANT3),
    "list behind the article": (page(P3, f'<ol class="commentlist"><li>{SAID}</li><li>{SAID}</li></ol>'), WANT3),
    "one in a list behind": (page(P3, f'<ol class="commentlist"><li>{SAID}</li></ol>'), WANT3),
    "plain boxes behind": (page(P3, f'<div class="comments-area"><div>{SAID}</div><div>{SAID}</div></div>'), WANT3),
    "replies behind": (page(P3, f'<section id="replies"><h2>2 replies</h2><p>{SAID}</p><p>{SAID}</p></section>'), WANT3),
    "own article each": (page(P3, f'<section id="comments"><article class="comment"><p>{SAID}</p></article><article class="comment"><p>{SAID}</p></article></section>'), WANT3),
    "page that allows comments": (page(P3).replace("<body>", '<body class="single comments-open">'), WANT3),
    "box named for comments around all": (page(P3).replace("<article>", '<div class="has-comments"><article>').replace("</article>", "</article></div>"), WANT3),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(name):
    source, lines = PAGES[name]
    assert maintext.extract(source, maintext.trained()) == "\n".join(lines)


def test_foreign_elements_end_with_a_slash():
    found = parse("<p>a<svg><path d='x'/><style/><g/><text>b</text></svg>c<math><mi/><mo>d</mo></math>e</p><svg/>f<script/>g</script>h")
    assert "".join(found.text) == "abcdefh"
    assert found.tag[found.parent[found.text.index("c")]] == "p" and found.tag[found.parent[found.text.index("e")]] == "p"
