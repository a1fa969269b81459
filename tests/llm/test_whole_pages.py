"""Pages whose layout carries the words of boilerplate."""

import pytest

from shelfmark.llm import html

TEXT = "<p>Long text, with commas, and more of it.</p><p>Second one, of the same page.</p>"
FOUND = "Long text, with commas, and more of it.\n\nSecond one, of the same page."
SIDE = "<div class=sidebar><p>side, side</p></div><div id=comments><p>me, too</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content-sidebar-wrap'><main><article>{TEXT}</article></main>{SIDE}</div></body>",
        f"<body><div class='has-sidebar'><article>{TEXT}</article>{SIDE}</div></body>",
        f"<body><div class='no-comments'><div class=text>{TEXT}</div>{SIDE}</div></body>",
        f"<body><div class='widget'><div>{TEXT}</div></div>{SIDE}</body>",
        f"<body><div id='page-header'><main>{TEXT}</main></div>{SIDE}</body>",
        f"<body class='has-sidebar'><article class='post comments-open'>{TEXT}</article>{SIDE}</body>",
        "<body><div class=widget><p>Long text, with commas, and more of it.</p></div><div class=widget><p>Second one, of the same page.</p></div></body>",
        f"<article>{TEXT}</article><div id=comments><article class=comment><p>{'a long comment, ' * 40}</p></article></div>",
        f"<main>{TEXT}</main><div class=related><article><p>{'teaser, teaser ' * 2}</p></article></div>",
    ],
)
def test_layout_wrappers_keep_their_article(page):
    assert html.extract(page) == FOUND
