"""HTML extraction: articles about what notices, adverts, forms and comments say; containers with any name; code, tables, figures
and links in articles; and sentences and pages that no variant of the training was chosen on."""

import pytest

from scholion.llm import html_extract as H

VALLEY = [
    "The river rose during the spring and flooded two villages in the lower valley.",
    "Engineers had warned about the old dam for years, but repairs were delayed again.",
    "Officials said that rebuilding would take at least eighteen months.",
]
TOPICS = {
    "What the cookie law changes": [
        "Regulators want consent before any tracking happens on a website, and most browsers now agree.",
        "The new privacy law treats cookies that measure visits like those that follow people across sites.",
        "A court in Vienna ruled last year that settings hidden behind three clicks are no consent at all.",
    ],
    "Why shops hold sales": [
        "Customers can save more if they buy in the last week of a sale, a study of four hundred shops found.",
        "Retailers discount winter coats first, because storing them costs more than free shipping does.",
        "Researchers followed every order for two years and compared exclusive deals with the usual price.",
    ],
    "How newsletters came back": [
        "Editors who had given up on social media found that a newsletter reaches readers in their inbox.",
        "Most people subscribe to three or four newsletters and read the latest issue within a day.",
        "Weekly mail brings more visitors to the site than search does, according to the publisher.",
    ],
}
NAMES = "text col detail panel card blog main content body story entry page wrap inner box row column left center block grid item module teaser copy prose rich node field".split()


def kept(page):
    blocks = H.blocks_of(page)
    return [b[0] for b, p in zip(blocks, H.trained().probabilities([H.features(blocks)])[0], strict=True) if p >= 0.5]


def page(body, tag="article", head="Flood in the valley"):
    return f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><{tag}><h1>{head}</h1>{body}</{tag.split()[0]}><footer>Copyright 2024</footer></body></html>"


def paragraphs(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


@pytest.mark.parametrize("tag", ["article", "main", "div class=story"])
def test_articles_about_notices_adverts_and_forms(tag):
    for head, lines in TOPICS.items():
        assert kept(page(paragraphs(lines), tag, head)) == [head, *lines]


def test_containers_of_thirty_names():
    for name in NAMES:
        assert kept(f"<html><body><div class={name}>{paragraphs(VALLEY)}</div></body></html>") == VALLEY, name
        assert kept(page(paragraphs(VALLEY), f"div class={name}")) == ["Flood in the valley", *VALLEY], name


def test_code_tables_figures_and_links_in_articles():
    parts = "<pre>for x in rows:\n    print(x)</pre><ul><li><a href=/r>The report of the engineers</a></li><li>Maps of the valley</li></ul>"
    parts += "<table><tr><th>Year</th><th>Level</th></tr><tr><td>2021</td><td>4 m</td></tr></table><figure><img src=a><figcaption>The bridge in May</figcaption></figure>"
    want = ["for x in rows: print(x)", "The report of the engineers", "Maps of the valley", "Year", "Level", "2021", "4 m", "The bridge in May"]
    assert kept(page(f"<p>{VALLEY[0]}</p>{parts}<p>{VALLEY[1]}</p>")) == ["Flood in the valley", VALLEY[0], *want, VALLEY[1]]


#: Written after the last change of the training, and run once.
UNSEEN_APPEALS = [
    "This site stores cookies on your browser. Change your privacy preferences or accept them all.",
    "Sign up for the newsletter: enter your email address for weekly updates.",
    "Sponsored: order today, save on every deal and get free shipping while the offer lasts.",
    "Utilizamos cookies propias. Configuración de privacidad: aceptar o rechazar las preferencias.",
    "Anzeige: jetzt kaufen und mit diesem Gutschein sparen, versandkostenfrei bestellen.",
    "Thanks for the great post, I agree. Share this comment or report it.",
]
UNSEEN_TOPICS = {
    "A museum of advertising": [
        "The oldest advertisement in the collection offers a discount on lamp oil to anyone who could read.",
        "Sponsored posters paid for the first tram lines, and the deal lasted until the war ended.",
        "Visitors may buy prints in the shop, although the sale of originals is not allowed.",
    ],
    "Passwords are going away": [
        "A password that people must enter every week is soon written on paper, surveys have long shown.",
        "Banks register a key on the phone instead, and a sign that it is present opens the account.",
        "An email address remains the weakest link, since whoever reads the inbox can reset the rest.",
    ],
    "Bees on city roofs": ["Hives on office roofs gave more honey than those in fields nearby.", "Lime trees along the old canal flower for three weeks in June."],
}


def test_unseen_appeals_and_articles():
    appeals = sum(kept(page(f"<p>{VALLEY[0]}</p><{tag}>{said}</{tag}><p>{VALLEY[1]}</p>")) == ["Flood in the valley", *VALLEY[:2]] for said in UNSEEN_APPEALS for tag in ("p", "div"))
    articles = sum(kept(page(paragraphs(lines), tag, head)) == [head, *lines] for head, lines in UNSEEN_TOPICS.items() for tag in ("article", "div class=k3"))
    assert (appeals >= 10, articles >= 5) == (True, True), (appeals, articles)
