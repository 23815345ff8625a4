"""Pages whose article class names, an open head or its length could hide."""

import pytest

from stillwater.llm.html_text import main_text

BODY = ["First paragraph of the piece, long enough to be text by any count of characters that is used here.",
        "Second paragraph of the piece, which is there so that the article has more than one line of text."]
INNER = "".join(f"<p>{p}</p>" for p in BODY)
MENU = "<nav><a href=/>Home</a></nav>"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-comments", "share-enabled"])
def test_class_names_around_the_text(name):
    for tag in ("article", "main", "div"):
        page = f"<html><body>{MENU}<div class='{name}'><{tag}>{INNER}</{tag}><div class=sidebar>Buy</div></div><footer>end</footer></body></html>"
        assert main_text(page) == "\n\n".join(BODY)


def test_noise_by_class_name_stays_noise():
    card = "<div class=related><article><p>Another piece</p></article></div>"
    assert main_text(f"<body><article>{INNER}<div class=comments>So true</div></article>{card}</body>") == "\n\n".join(BODY)
    assert main_text(f"<body><div class=has-sidebar><article>{INNER}<div class=comments>So true</div></article></div></body>") == "\n\n".join(BODY)


def test_head_without_an_end():
    for start in ("<body>", "", "<div>"):
        assert main_text(f"<html><head><meta charset=utf-8><title>T</title>{start}<article>{INNER}</article>") == "\n\n".join(BODY)
    assert main_text(f"<html><head><title>T</title>{BODY[0]}") == BODY[0]


def test_short_text_without_an_article():
    assert main_text(f"<body>{MENU}<div><h1>Rain</h1><p>It rained all day.</p></div><footer>end</footer></body>") == "Rain\n\nIt rained all day."
    assert main_text(f"<body>{MENU}<footer>end</footer></body>") == ""
