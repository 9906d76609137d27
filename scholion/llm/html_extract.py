"""Main text of HTML pages by a recurrent block labeller.

A page becomes the sequence of its blocks: the text between two block-level tags, with the path of
open containers above it. Each block is a vector of its tag path (the names, classes, ids and roles that training has met; others
leave no mark, so that no unknown name looks like a telling one),
all its hashed words, how far they are those of notices, adverts, forms and comments, and a few measures, and a bidirectional LSTM in numpy reads the whole sequence, so that
every block is classified with all of the page before and after it: a paragraph with the words of adverts is text in an article about sales. The network is trained here, on pages that
a generator makes up with known labels, by a fixed seed: it costs a few seconds, is the same on every
run, and its weights, some 400 KB with those of words, travel to the workers with the task.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import slices

PATH, WORDS, EXTRA, HIDDEN = 64, 24, 12, 20
#: A name of a tag, class, id or role has one of the places of the path if so many of the pages for training hold it.
NAMED = 20
#: Neighbours of a block that count for what is said around it.
NEAR = np.array([1, 1, 1, 0, 1, 1, 1], np.float32)
#: Places of the table of word weights.
TABLE = 1 << 16
#: The bounds of training.
PAGES, EPOCHS, BATCH = 1800, 10, 24
#: Of six pages for training, one is about what notices, adverts, forms or comments say.
TOPICAL = 6
#: Blocks of the pages that run together, those that pad shorter pages included (a longer page runs alone).
CELLS = 1 << 14

# A tag's attributes hold no "<" outside quotes, and none of it is tried again, so reading is linear in the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|textarea|title|iframe)\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>|<[!?][^<>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
#: Elements that do not break a line of text.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Container:
    """An open element, and through ``above`` those around it: blocks share them instead of holding paths of their own.
    ``vector`` marks the places of all their names, classes, ids and roles, once it is asked for."""

    __slots__ = ("above", "depth", "names", "tag", "vector")

    def __init__(self, tag: str, parts: list[str], above: Container | None) -> None:
        self.tag, self.above, self.depth = tag, above, above.depth + 1 if above else 1
        self.names, self.vector = (tag, *parts), None

    @property
    def label(self) -> str:
        return " ".join(self.names)

    def marked(self, places: dict[str, int]) -> np.ndarray:
        """The vector; containers without a new mark share that of the one above."""
        todo, at = [], self
        while at is not None and at.vector is None:
            todo.append(at)
            at = at.above
        vector = np.zeros(PATH, np.float32) if at is None else at.vector
        for inner in reversed(todo):
            marks = [places[n] for n in inner.names if n in places]
            if not vector[marks].all():
                vector = vector.copy()
                vector[marks] = 1
            inner.vector = vector
        return vector

    def path(self) -> list[str]:
        at, out = self, []
        while at is not None:
            out.append(at.label)
            at = at.above
        return out[::-1]


Block = tuple[str, Container | None, int]
#: The place of each known name, and the weights of hashed words.
Seen = tuple[dict[str, int], np.ndarray]


def blocks_of(page: str) -> list[Block]:
    """(text, container, characters inside links) of each block with text, in page order. Comments, scripts,
    styles and other raw elements are markup. The head has none but such and void elements, so its tags are
    passed over: its end tag may be missing, and text or any other tag is the body's. A block-level tag ends a block; ``br`` is white
    space. A closing tag closes what is open inside it; one that was never opened is ignored."""
    out: list[Block] = []
    inner: Container | None = None
    open_: dict[str, int] = {}
    text: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            out.append((joined, inner, linked))
        text.clear()
        linked = 0

    def close() -> None:
        nonlocal inner
        open_[inner.tag] -= 1
        inner = inner.above

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = 0 if m["end"] else 1
            continue
        flush()
        if tag == "head":
            continue
        if m["end"]:
            if open_.get(tag):
                while inner.tag != tag:
                    close()
                close()
        elif tag not in VOID and not m["attrs"].rstrip().endswith("/"):
            if inner is not None and (inner.tag == "p" or (inner.tag == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"))):
                close()
            named = [p for a in _ATTR.findall(m["attrs"]) for p in _PART.findall("".join(a[1:]).lower())]
            inner = Container(tag, named, inner)
            open_[tag] = open_.get(tag, 0) + 1
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


@lru_cache(50_000)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def _words(text: str) -> np.ndarray:
    return np.array([_word_hash(w) for w in _WORD.findall(text.lower())], np.int64)


def features(blocks: list[Block], seen: Seen | None = None) -> np.ndarray:
    """A row for each block: path, words, measures; ``seen`` is ``seen_in_training`` if not given. All words of a block count."""
    places, weights = seen or seen_in_training()
    x = np.zeros((len(blocks), PATH + WORDS + EXTRA), np.float32)
    telling, known_words = np.zeros(len(blocks), np.float32), np.zeros(len(blocks), np.float32)
    for n, (text, inner, linked) in enumerate(blocks):
        if inner is not None:
            x[n, :PATH] = inner.marked(places)
        words, known, told = text.split(), _words(text), np.zeros(0, np.float32)
        if len(known):
            x[n, PATH : PATH + WORDS] = np.bincount(known % WORDS, minlength=WORDS) / len(known)
            told = weights[known % TABLE]
        ends, depth = (inner.tag, inner.depth) if inner is not None else ("", 0)
        x[n, -EXTRA:] = (np.log1p(len(words)) / 5, min(1.0, linked / len(text)), ends[:1] == "h" and ends[1:].isdigit(), ends == "li", ends == "p", min(depth, 40) / 10, text[-1] in ".!?", told.sum() / (len(told) + 3), (told > 1).sum() / (len(told) + 3), 0, 0, 1)
        telling[n], known_words[n] = (told > 1).sum(), len(told)
    if not blocks:
        return x
    # How much the other blocks of the page say such words: all of them, and those before and after it.
    near = lambda v: np.convolve(v, NEAR)[len(NEAR) // 2 :][: len(v)]
    x[:, -3] = (telling.sum() - telling) / (known_words.sum() - known_words + 3)
    x[:, -2] = near(telling) / (near(known_words) + 3)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction; ``run`` keeps what ``back`` needs, if asked to."""

    def __init__(self, size: int, rng: np.random.Generator) -> None:
        self.w = (rng.normal(size=(size + HIDDEN, 4 * HIDDEN)) / np.sqrt(size + HIDDEN)).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        steps, batch, size = x.shape
        h = c = np.zeros((batch, HIDDEN), np.float32)
        self.kept, out = [], np.zeros((steps, batch, HIDDEN), np.float32)
        inner, into = self.w[size:], x @ self.w[:size] + self.b
        for t in range(steps):
            z = into[t] + h @ inner
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                self.kept.append((h, c, i, f, o, g, tc, m))
            c, h = m * c_new + (1 - m) * c, m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def back(self, x: np.ndarray, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = x.shape[2]
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh = dc = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = self.kept[t]
            dh = dh + d_out[t]
            live = dh * m
            dct = dc * m + live * o * (1 - tc * tc)
            dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o), dct * i * (1 - g * g)], 1)
            dw[:size] += x[t].T @ dz
            dw[size:] += h.T @ dz
            db += dz.sum(0)
            dh, dc = dz @ self.w[size:].T + dh * (1 - m), dct * f + dc * (1 - m)
        return dw, db


class Labeller:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        size = PATH + WORDS + EXTRA
        self.ahead, self.behind = Lstm(size, rng), Lstm(size, rng)
        self.w = (rng.normal(size=2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.b = np.zeros(1, np.float32)

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For every block of every page, how likely it is main text. Pages of like length run together, as many as
        their longest one allows."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((n for n in range(len(pages)) if len(pages[n])), key=lambda n: len(pages[n]))
        while order:
            most = len(pages[order[-1]])
            part = [order.pop() for _ in range(min(len(order), 64, max(1, CELLS // most)))]
            x, mask = _padded([pages[n] for n in part])
            p = self._forward(x, mask)
            for k, n in enumerate(part):
                out[n] = p[: len(pages[n]), k]
        return out

    def _forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        both = np.concatenate([self.ahead.run(x, mask, keep), self.behind.run(x[::-1], mask[::-1], keep)[::-1]], 2)
        if keep:
            self.both = both
        return _sigmoid(both @ self.w + self.b)

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], seed: int = 7) -> None:
        rng = random.Random(seed)
        values = [self.ahead.w, self.ahead.b, self.behind.w, self.behind.b, self.w, self.b]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for epoch in range(EPOCHS):
            rate = 0.012 * (1 - epoch / EPOCHS)
            order = sorted(pages, key=lambda p: (len(p[0]) // 4, rng.random()))
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            rng.shuffle(batches)
            for batch in batches:
                x, mask = _padded([p[0] for p in batch])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(batch):
                    y[: len(labels), k] = labels
                d = (self._forward(x, mask, True) - y) * mask / mask.sum()
                d_both = d[:, :, None] * self.w
                grads = [*self.ahead.back(x, d_both[:, :, :HIDDEN]), *self.behind.back(x[::-1], d_both[::-1, :, HIDDEN:]), np.tensordot(d, self.both, ((0, 1), (0, 1))), np.array([d.sum()], np.float32)]
                step += 1
                for v, g, m, s in zip(values, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
        self.ahead.kept = self.behind.kept = []
        self.both = None


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


#: The words of notices, adverts, forms and comments of the pages made up for training, in seven languages.
VOCABULARY = {
    "note": [
        "cookie cookies accept consent privacy policy settings website browser tracking preferences analytics improve experience",
        "cookies akzeptieren zustimmung datenschutz einstellungen webseite verwenden browser ablehnen verbessern",
        "cookies accepter consentement confidentialité paramètres utilisons navigateur refuser préférences",
        "cookies aceptar consentimiento privacidad configuración utilizamos navegador rechazar preferencias",
        "cookies accepteren toestemming privacybeleid instellingen website gebruiken browser weigeren voorkeuren",
        "cookie accettare consenso privacy impostazioni utilizziamo browser rifiutare preferenze sito",
        "cookies aceitar consentimento privacidade configurações utilizamos navegador rejeitar preferências",
    ],
    "ad": [
        "advertisement sponsored buy sale offer discount deal shop save free shipping order price exclusive",
        "anzeige werbung gesponsert kaufen angebot rabatt sparen versandkostenfrei bestellen gutschein",
        "publicité sponsorisé achetez offre promotion remise soldes livraison gratuite commandez",
        "publicidad anuncio patrocinado compra oferta descuento rebajas envío gratis ahorra",
        "advertentie gesponsord koop nu aanbieding korting besparen gratis verzending bestel uitverkoop",
        "pubblicità sponsorizzato acquista offerta sconto saldi spedizione gratuita ordina risparmia",
        "publicidade anúncio patrocinado compre oferta desconto promoção frete grátis economize",
    ],
    "form": [
        "subscribe newsletter sign email address enter inbox weekly updates login password register search latest",
        "newsletter abonnieren anmelden adresse eingeben posteingang passwort registrieren suche absenden",
        "newsletter abonnez inscrivez courriel mail entrez recevez passe connexion recherche actualités",
        "boletín suscríbete regístrate correo electrónico introduce contraseña sesión buscar noticias",
        "nieuwsbrief abonneer schrijf in meld aan mailadres ontvang wekelijks wachtwoord inloggen zoeken",
        "newsletter iscriviti registrati indirizzo email inserisci ricevi password accedi cerca notizie",
        "newsletter assine inscreva cadastre email endereço receba senha entrar pesquisar novidades",
    ],
    "talk": [
        "comment comments reply posted says thanks great post agree share like report article guest",
        "kommentar kommentare antworten gast danke toller beitrag zustimmen teilen melden",
        "commentaire commentaires répondre publié invité merci accord partager aime signaler",
        "comentario comentarios responder publicado invitado gracias acuerdo compartir gusta denunciar",
        "reactie reacties beantwoorden geplaatst gast bedankt mooi artikel eens delen melden",
        "commento commenti rispondi pubblicato ospite grazie bel articolo accordo condividi segnala",
        "comentário comentários responder publicado convidado obrigado ótimo concordo compartilhar denunciar",
    ],
}
#: Words that stand in main text and chrome alike.
COMMON = [
    "the of and to in a is that for it with on as are this by or be from at we our your you all not was have an which will can has more their its they but if one",
    "der die das und in zu den von mit ist auf für nicht im ein eine dem sich wir ihre sie oder auch als an es werden aus er hat dass nach bei um am",
    "le la les de et des en un une du que est pour dans par sur qui au nous votre vous à ce pas il plus avec ne se sont ou son tout elle aux",
    "el la los de y en que un una del se por con para las es al lo su nuestro a no más como o este sus le ha me si sin sobre",
    "de het een en van in is dat op te zijn met voor niet aan er om ook als bij nog uit wordt naar heeft hun deze onze je uw wij of maar",
    "il la di che e un una per in è non con del della si da le dei nel al più ma come anche sono questo alla o suo ha nostra tua",
    "o a de que e do da em um uma para com não os as no na por mais dos se como mas ao ele seu sua ou foi são nosso seus pela",
]


def made_up_page(rng: random.Random, topical: float = 1 / TOPICAL) -> tuple[str, list[int]]:
    """A page and the labels of its blocks. Words are made of random syllables or common to all text, but most
    notices, adverts, forms and comments draw from their own vocabulary. Containers are semantic elements or
    named ``div``s, some with names that say nothing; some of those with an own vocabulary have no telling tag or name. A share of articles, ``topical``, is about what one of
    these vocabularies says. Articles hold code, tables, figures and links, too. Paragraphs may be left open."""
    tongue = rng.randrange(len(COMMON))
    common = COMMON[tongue].split()
    syllables = ["".join(rng.choice("bcdfghlmnprstvéüß") + rng.choice("aeiouö")) for _ in range(30)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    mixed = lambda share: rng.choice(common) if rng.random() < share else word()
    ended = lambda words: " ".join(words).capitalize() + rng.choice([".", ".", ".", "", "!"])
    told = [w for kind in VOCABULARY.values() for w in kind[tongue].split()]
    line = lambda a, b, share=0.4: ended([rng.choice(told) if rng.random() < 0.03 else mixed(share) for _ in range(rng.randint(a, b))])
    topic = rng.choice(list(VOCABULARY)) if rng.random() < topical else ""
    subject, dense = VOCABULARY[topic][tongue].split() if topic else [], rng.uniform(0.12, 0.4)
    about = lambda a, b: ended([rng.choice(subject) if rng.random() < dense else mixed(0.6) for _ in range(rng.randint(a, b))])
    told_line = lambda a, b, share=0.4: about(a, b) if topic and rng.random() < 0.9 else line(a, b, share)
    parts: list[str] = []
    labels: list[int] = []

    def put(tag: str, text: str, label: int, close: bool = True) -> None:
        parts.append(f"<{tag}>{text}" + f"</{tag.split()[0]}>" * close)
        labels.append(label)

    def links(n: int) -> None:
        parts.append("<ul>")
        for _ in range(n):
            put("li", f'<a href="/{word()}">{line(1, 3)}</a>', 0)
        parts.append("</ul>")

    def chrome(kind: str, inside: bool = False) -> None:
        names = {
            "menu": ["nav", 'div class="menu"', 'div id="navigation"', 'div class="navbar"'], "head": ["header", 'div class="header"', 'div id="masthead"', 'div class="banner"'],
            "foot": ["footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer"'], "side": ["aside", 'div class="sidebar"', 'div class="related"', 'div id="side"'],
            "note": ['div class="notice"', 'div class="cookie"', 'div role="alert"', 'div class="popup"'], "ad": ['div class="ad"', 'div class="ads"', 'div class="promo"', 'div class="sponsored"', 'div class="advert"'],
            "form": ["form", 'div class="newsletter"', 'form class="search"'], "talk": ['section class="comments"', 'div class="comment"', 'div id="comments"', 'div class="discussion"'],
        }
        own = VOCABULARY[kind][tongue].split() if kind in VOCABULARY and rng.random() < 0.75 else []
        bare = bool(own) and not topic and rng.random() < 0.7
        telling = rng.uniform(0.4, 0.9) if bare else rng.uniform(0.3, 0.85)
        said = lambda a, b: ended([rng.choice(own) if rng.random() < telling else mixed(0.6) for _ in range(rng.randint(a, b))]) if own else line(a, b)
        if bare and rng.random() < (0.8 if inside else 0.5):  # no container at all
            for _ in range(rng.randint(1, 2)):
                put(rng.choice(["p", "p", "div"]), said(7, 30), 0)
            return
        unnamed = not bare and (bool(own) or kind in ("menu", "side")) and rng.random() < 0.15
        tag = "div" if bare else rng.choice(odd[:3]) if unnamed else rng.choice(names[kind])
        parts.append(f"<{tag}>")
        if kind in ("menu", "side") and (unnamed or rng.random() < 0.8):
            links(rng.randint(2, 8))
        elif kind == "form":
            put(rng.choice(["label", "p", "p"]), said(7, 14) if bare else said(1, 4), 0)
        elif rng.random() < 0.5:
            parts.append(said(7, 14))
            labels.append(0)
        else:
            for _ in range(rng.randint(1, 4)):
                put("p", said(7, 30) if bare else said(2, 30), 0)
        parts.append(f"</{tag.split()[0]}>")

    odd = [f'div id="{word()}"', f'div class="{word()} {word()}"', f'section class="{word()}"', "div", "section", f'td class="{word()}"', "td", f'div class="{word()}"']
    alone, text_tag = rng.random() < 0.2, "div" if rng.random() < 0.15 else "p"  # no chrome around it; how it marks paragraphs
    for kind in ("note", "head", "menu", "ad", "side", "form"):
        if not alone and rng.random() < (0.8 if kind in ("menu", "ad") else 0.3):
            chrome(kind)
    tag = rng.choice(odd) if rng.random() < 0.45 else rng.choice(["article"] * 4 + ["main", 'div class="content"', 'div id="main"', 'div class="article-body"', 'div class="post"'])
    around = rng.choice(odd) if rng.random() < 0.3 else ""  # a wrapper that says nothing
    if around:
        parts.append(f"<{around}>")
    parts.append(f"<{tag}>")
    if rng.random() < 0.7:
        put("h1", told_line(2, 12), 1)
    link = lambda text: f'<a href="/{word()}">{text}</a>'
    for n in range(rng.randint(3, 14) if topic else rng.choice([rng.randint(1, 3), rng.randint(1, 14)])):
        roll = rng.random()
        if roll < 0.08:
            put(rng.choice(["h2", "h3"]), told_line(1, 6), 1)
        elif roll < 0.16:
            parts.append("<ul>")
            linked = rng.random() < 0.4
            for _ in range(rng.randint(1, 5)):
                text = told_line(2, 12)
                put("li", link(text) if linked and rng.random() < 0.7 else text, 1)
            parts.append("</ul>")
        elif roll < 0.2:
            put("blockquote", told_line(4, 20), 1)
        elif roll < 0.23:
            put("pre", rng.choice(["", "<code>"]) + "\n".join(f"{word()}{rng.choice([' = ', '(', '.', ': '])}{word()}{rng.choice(['', ')', ' {', ';', ' + 1'])}" for _ in range(rng.randint(1, 6))), 1)
        elif roll < 0.26:
            wide = rng.randint(2, 3)
            parts.append("<table>")
            for row in range(rng.randint(2, 5)):
                parts.append("<tr>")
                for _ in range(wide):
                    put("th" if row == 0 else "td", str(rng.randint(1, 9999)) if row and rng.random() < 0.5 else word().capitalize() + rng.choice(["", " " + word()]), 1)
                parts.append("</tr>")
            parts.append("</table>")
        elif roll < 0.29:
            parts.append(f'<figure><img src="/{word()}.png">')
            put("figcaption", told_line(3, 14), 1)
            parts.append("</figure>")
        elif roll < 0.5 and n:
            kinds = [k for k in ("ad", "side", "form", "note", "ad", "form", "note", "talk") if k != topic]
            chrome(rng.choice(kinds), True)
        else:
            text = told_line(1, rng.choice([8, 60, 60]), rng.uniform(0, 0.9))
            if rng.random() < 0.15:
                first, _, rest = text.partition(" ")
                text = f"{link(first)} {rest}"
            put(text_tag, f"<b>{text}<br>" if rng.random() < 0.25 else text, 1, text_tag == "div" or rng.random() < 0.85)
    parts.append(f"</{tag.split()[0]}>" + (f"</{around.split()[0]}>" if around else ""))
    for kind in ("talk", "side", "form", "ad", "foot"):
        if not alone and rng.random() < (0.85 if kind == "foot" else 0.25):
            chrome(kind)
    return "<html><body>" + "".join(parts) + "</body></html>", labels


@lru_cache(1)
def _made_up() -> list[tuple[list[Block], list[int], bool]]:
    rng, pages = random.Random(12), []
    for n in range(PAGES):
        page, labels = made_up_page(rng, float(n % TOPICAL == 0))
        blocks = blocks_of(page)
        if len(blocks) == len(labels):  # a line that came out empty shifts the labels
            pages.append((blocks, labels, n % TOPICAL == 0))
    return pages


@lru_cache(1)
def seen_in_training() -> Seen:
    """The places of names that pages made up for training hold often, and by hashed word, how much likelier it stands in a dropped
    than in a kept block: the logarithm of the ratio, over the blocks of pages about something else. Words seen in fewer than five blocks tell nothing."""
    held: Counter[str] = Counter()
    seen = np.zeros((2, TABLE), np.float32)
    for blocks, labels, topical in _made_up():
        names: set[str] = set()
        for (text, inner, _), label in zip(blocks, labels, strict=True):
            if not topical:
                seen[label, np.unique(_words(text) % TABLE)] += 1
            while inner is not None:
                names.update(inner.names)
                inner = inner.above
        held.update(names)
    share = np.log((seen + 1) / (seen.sum(1, keepdims=True) + 1))
    weights = np.where(seen.sum(0) >= 5, np.clip(share[0] - share[1], -3, 3), 0).astype(np.float32)
    known = sorted((name for name in held if held[name] >= NAMED), key=lambda name: (-held[name], name))
    return {name: n for n, name in enumerate(known[:PATH])}, weights


@lru_cache(1)
def trained() -> Labeller:
    pages = [(features(blocks), np.array(labels, np.float32)) for blocks, labels, _ in _made_up()]
    model = Labeller()
    model.train(pages)
    return model


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(*keep, text, n_chars, n_blocks): for each row of ``df`` the main text, blocks joined by an empty line.

    Character references are decoded, white space inside a block is one space. A null or empty page, or one
    without main text, has the empty text. Repeated rows get the same text; a null in ``keep`` is carried.
    Nothing is cut: pages of any length are read whole, in slices of a few MB a worker.
    """
    model, seen = trained(), seen_in_training()
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keep), 2 << 20, 256):
                pages = [blocks_of(p.as_py() or "") for p in part.column(len(keep))]
                texts = ["\n\n".join(b[0] for b, p in zip(blocks, chance, strict=True) if p >= 0.5) for blocks, chance in zip(pages, model.probabilities([features(b, seen) for b in pages]), strict=True)]
                yield pa.record_batch([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, pages), pa.int64())], [*keep, "text", "n_chars", "n_blocks"])

    return df.select(*keep, html_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long", "n_blocks long"]))
