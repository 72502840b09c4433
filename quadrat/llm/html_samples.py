"""Labelled pages that the block classifier of ``html_text`` is fitted on.

Written for this purpose.  A block that starts with ``+`` is main text, one with ``-`` is
not.  Pages differ in what tells: elements, classes, or the text alone.
"""

from __future__ import annotations

_LONG = (
    "The river rose for three days before the bridge was closed, and nobody in the village was surprised. "
    "Water had come over the lower road twice since spring. Most people kept boots by the door.",
    "In the first trial the plants were kept in the dark for a week. The second group had light, but no water; "
    "of these, about half lived on. We report both results here.",
    "She had worked at the station since 1988, she said, and never seen a queue like it. By noon it reached the square, "
    "and by one the doors had to be shut.",
    "Cut the butter into the flour until it looks like coarse sand, then add the cold water a little at a time. "
    "Do not knead it. Let it rest for an hour before you roll it out.",
)
_SHORT = ("It rained.", "He agreed.", "Nothing else was found", "See the table below:", "Not so.")
_TITLE = ("A bridge closed", "Light, water and time", "The longest queue", "Plain pastry")
_MENU = ("Home", "News", "Sport", "Contact us", "About", "Log in", "Archive")
_NOTES = (
    "We use cookies to improve this site. By going on you accept our use of cookies. Read our policy to learn more.",
    "Subscribe to our newsletter and never miss a story. You can leave at any time.",
    "Copyright 2021 The Daily Example. All rights reserved. No part may be reproduced without permission of the publisher.",
    "Buy two and get the third free until Sunday! Offer ends soon. Terms apply to all orders.",
    "© 2020 Example Ltd. All rights reserved.",
)
_REMARKS = ("Great piece, thanks for sharing. I had the same trouble last year and it took weeks to mend.", "I do not agree with a word of this. Who wrote it?", "First!")


def _paragraphs(k: int) -> str:
    long, short = _LONG[k % 4], _LONG[(k + 1) % 4]
    return f"<p>+{long}</p><p>+{_SHORT[k % 5]}</p><p>+{short}</p><p>+{_LONG[(k + 2) % 4]}</p>"


def _links(k: int, tag: str = "li") -> str:
    return "".join(f"<{tag}><a href=x>-{m}</a></{tag}>" for m in _MENU[k % 3 : k % 3 + 4])


def pages() -> list[str]:
    """The labelled pages."""
    out = []
    for k in range(8):
        title, body, links, note = f"<h1>+{_TITLE[k % 4]}</h1>", _paragraphs(k), _links(k), _NOTES[k % 5]
        remarks = "".join(f"<div><p>-{r}</p></div>" for r in _REMARKS)
        out += [
            # elements tell
            f"<nav><ul>{links}</ul></nav><article>{title}{body}</article><aside><p>-{note}</p></aside><footer><p>-{_NOTES[4]}</p></footer>",
            f"<header><p>-The Daily Example</p><nav>{links}</nav></header><main><header>{title}</header>{body}<form><p>-{_NOTES[1]}</p></form></main><footer>-{note}</footer>",
            f"<article>{title}<p>+{_SHORT[k % 5]}</p><p>+{_SHORT[(k + 2) % 5]}</p><aside>-{note}</aside></article><footer>-{_NOTES[2]}</footer>",
            # classes tell
            f"<div class='top-menu'>{_links(k, 'div')}</div><div class='post-content'>{title}{body}</div><div class='sidebar'><p>-{note}</p></div><div id=footer><p>-{_NOTES[2]}</p></div>",
            f"<div id=content class='has-sidebar'><div class='entry-header'>{title}</div><div class=entry>{body}</div><div class='share-buttons'>-Share this</div></div><div class='cookie-banner'><p>-{_NOTES[0]}</p></div>",
            f"<div class='article-body'>{title}{body}<div class=ad>-{_NOTES[3]}</div></div><div id=comments>{remarks}</div>",
            f"<div class='layout-with-nav'><div class=nav>{_links(k, 'div')}</div><div class='story-text'>{title}{body}</div></div><div class=related><h3>-Related</h3>{_links(k, 'div')}</div>",
            f"<main>{title}{body}<section class=comments>{remarks}</section></main><div class=promo>-{_NOTES[3]}</div>",
            # the text tells
            f"<div><div>{_links(k, 'div')}</div><div>{title}{body}</div><div><p>-{_NOTES[2]}</p></div><div>-{_NOTES[4]}</div></div>",
            f"<table><tr><td>{_links(k, 'p')}</td><td>{title}{body}</td></tr></table><p>-{_NOTES[4]}</p>",
            f"{title}{body}<ul>{links}</ul><p>-{_NOTES[2]}</p>",
            f"<div>-Example</div><div>{_links(k, 'span')}</div><div>{body}<h2>+{_TITLE[(k + 1) % 4]}</h2>{_paragraphs(k + 1)}</div><div><a href=x>-Next page</a></div>",
        ]
    return out
