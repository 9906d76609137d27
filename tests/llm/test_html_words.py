"""HTML extraction by words: notices, adverts, forms and comments that no tag or class tells, in sentences the
generator never makes; words after the
fortieth; and heads without an end tag."""

import numpy as np
import pytest

from scholion.llm import html_extract as H

ARTICLE = [
    "The river rose during the spring and flooded two villages in the lower valley.",
    "Engineers had warned about the old dam for years, but repairs were delayed again.",
    "Farmers moved their cattle to higher ground before the night of the storm.",
    "By morning the water had reached the church and the small school beside it.",
    "Officials said that rebuilding would take at least eighteen months.",
]
CHROME = [
    "We use cookies to improve your experience. Accept all cookies or change your settings in our privacy policy.",
    "Subscribe to our weekly newsletter and get the latest news delivered to your inbox.",
    "Advertisement: buy now and save with our exclusive discount offer, free shipping on every order today!",
    "Wir verwenden Cookies, um diese Webseite zu verbessern. Alle akzeptieren oder Einstellungen ändern.",
    "Abonnez-vous à notre newsletter : entrez votre adresse e-mail et recevez nos actualités.",
    "Great post, thanks for the article! Reply to this comment or share it.",
]


@pytest.mark.parametrize("tag", ["p", "div"])
def test_chrome_without_a_telling_tag(tag):
    model = H.trained()
    for said in CHROME:
        for at in (-1, 2, len(ARTICLE)):
            body = [f"<p>{a}</p>" for a in ARTICLE]
            block = f"<{tag}>{said}</{tag}>"
            if 0 <= at < len(ARTICLE):
                body.insert(at, block)
            page = "<html><body>" + block * (at < 0) + "<article><h1>Flood in the valley</h1>" + "".join(body) + "</article>" + block * (at == len(ARTICLE)) + "</body></html>"
            blocks = H.blocks_of(page)
            kept = [b[0] for b, p in zip(blocks, model.probabilities([H.features(blocks)])[0], strict=True) if p >= 0.5]
            assert kept == ["Flood in the valley", *ARTICLE], (said, at)


def test_every_word_of_a_block_is_hashed():
    long = H.features([("river " * 40 + "dam " * 40, H.Container("p", [], None), 0)])[0, H.PATH : H.PATH + H.WORDS]
    assert np.isclose(long.sum(), 1) and np.count_nonzero(long) == 2


def test_head_without_an_end_tag():
    want = [(t, inner.label) for t, inner, _ in H.blocks_of("<html><body><article><h1>A</h1><p>B c.</p></article></body></html>")]
    for head in ("<head><title>x</title>", "<head><meta charset=utf-8><link rel=a><style>p{}</style><script>var a='<p>';</script>", "<head><title>x</title></head>", "<HEAD>", ""):
        for body in ("<body>", ""):
            blocks = H.blocks_of(f"<html>{head}{body}<article><h1>A</h1><p>B c.</p></article>")
            assert [(t, inner.label) for t, inner, _ in blocks] == want and not any("head" in inner.path() for _, inner, _ in blocks), head
    assert [b[0] for b in H.blocks_of("<head><title>x</title>Plain text to the end")] == ["Plain text to the end"]
    assert [b[0] for b in H.blocks_of("<head><title>x</title></head><header>Top</header>")] == ["Top"]
