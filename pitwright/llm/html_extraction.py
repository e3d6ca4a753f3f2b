"""Main text by wrappers: union-free expressions that are inferred from all pages of a host.

A page is a stream of tokens: tags, signed with name, classes and id, and texts. Streams of one host are aligned level by
level of nesting:

- squares: where a run of up to PERIOD sibling regions follows itself with the same signatures, it becomes one repeated
  group (+), and the contents of its rounds are aligned with one another;
- mismatches: where two streams differ, the next place is looked for at which one of them goes on as the other one does
  now; what lies before it is optional (?, or * if it is repeated), and if there is none, both regions are. A group of one
  stream takes in a single round of the other;
- of two aligned regions with equal signatures the contents are aligned in turn; texts that differ become slots, texts that
  are equal on all pages stay template. No alternatives arise, so the expression is union-free, and it fits every page that
  it was inferred from.

Of a region that may be template outside of paragraphs, the most frequent texts are counted by page (in COUNTERS mergeable
counters, each too low by at most the pages without the text divided by COUNTERS); what stands on TEMPLATE_SHARE of the pages
that have the region's parent is template, other texts of the region stay. An expression holds REGIONS regions at most: the
rarest are folded into their parents, which on a large host are far too rare to be template. Every task folds its pages into
one expression for each host, and the expressions of a host are folded in two more rounds, so a hot host is never in one
task page by page.

The wrapper shows which regions are the article. Tags and roles name furniture; class words are only a prior. A class or id
that is a name of furniture as a whole (known words and neutral ones, as in site-footer) marks it, unless the region holds
most of its pages' text; one that also has other words (ad-hoc, related-work) makes the region suspect, and it goes only if
its pages confirm it, by mostly links or by template text. Menus are regions that are mostly links, outside of articles. The
article is the <article> or <main> region that holds text, or else the element into which most slot text descends. Each page
is then read along its host's wrapper.

Defined results: a null or empty html, or one without text, gives ''; markup that is cut off or badly nested is closed where
its parent ends; elements nested deeper than DEPTH count as siblings at that depth, so their text stays; a quote in a tag
counts only after an equals sign; a page whose url has no host shares the wrapper of such pages; equal pages give equal
texts; a host with one page is read by its own wrapper; extra columns are passed over.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwright.llm.common import cut
from pitwright.llm.url_filter import host_of

#: Template text outside of paragraphs is furniture from so many pages on, if it stands on this share of them; an element of this share of link text is a menu.
TEMPLATE_PAGES, TEMPLATE_SHARE, LINK_SHARE, DESCEND = 5, 0.8, 0.6, 0.6
#: A suspect region goes at this share of link text.
SUSPECT_LINKS = 0.5
COUNTERS, REGIONS, DEPTH, PERIOD = 16, 4_000, 200, 8
#: A task hands its expressions on when it has so many hosts.
HOSTS_AT_ONCE, ROUND = 5_000, 32

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Names of HTML elements by kind, ARIA roles and common class words.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("table ul ol dl div section article main aside nav header footer form body td blockquote".split())
FURNITURE = set("head nav footer aside form button select menu dialog input fieldset svg object template noscript canvas audio video".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLASS_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus widget toolbar pagination pager skip paywall masthead "
    # comments, adverts and notices of other themes and languages
    "commentlist commentform respond replies discussion discuss kommentar kommentare kommentarliste commentaire commentaires comentario comentarios respuestas reponses antworten diskussion "
    "werbung werbeanzeige anzeige anzeigen publicidad anuncio anuncios publicite reclame hinweis hinweise aviso avisos avertissement disclaimer alert seitenleiste fusszeile kopfzeile barre "
    "pied menue verwandt relacionados".split()
)
#: Words that leave a name of furniture one.
NEUTRAL_WORDS = set(
    "area article articles bar block body bottom box btn button buttons cell col column columns container content desktop entry form full global group holder icon icons inner item items large left link links "
    "list local main message mobile module outer page panel placeholder post posts primary region right row section secondary site slot small sticky text thread title top unit view wide wrap wrapper zone".split()
)
#: Of CLASS_WORDS, those that name what may be longer than the article, not how a page is laid out; and the shares of a page's text from which on class words don't count.
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login related recommended comment comments disqus paywall "
    "commentlist commentform respond replies discussion discuss kommentar kommentare kommentarliste commentaire commentaires comentario comentarios respuestas reponses antworten diskussion "
    "werbung werbeanzeige anzeige anzeigen publicidad anuncio anuncios publicite reclame hinweis hinweise aviso avisos avertissement disclaimer alert verwandt relacionados".split())
MOST = {"c": 0.5, "t": 0.9}
NEVER_BY_CLASS = {"html", "body", "main", "article"}
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt figcaption".split())
NO_TEMPLATE = TEXTUAL | {"html", "body", "main", "article", "#page"}
CONTAINERS = set("div section table tbody tr td center span ul ol li".split())


class Element:
    __slots__ = ("inside", "kids", "links", "marks", "name", "plain", "sign", "up", "weight")

    def __init__(self, name: str, sign: str, marks: str, up: Element | None, inside: bool) -> None:
        self.name, self.sign, self.marks, self.up, self.inside = name, sign, marks, up, inside
        self.kids: list = []  # elements and texts
        #: characters of text without furniture, of those in links, and of all outside of links but what tags and roles mark
        self.weight = self.links = self.plain = 0


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(text)} if text else {}


def named(words: set[str]) -> str:
    """What the words of a class or id say: 'c' or 't' (ASIDE_WORDS) if it is a name of furniture as a whole, 's' if it has other
    words as well, '' if it names none."""
    if not words & CLASS_WORDS:
        return ""
    if any(w not in CLASS_WORDS and w not in NEUTRAL_WORDS and len(w) > 1 for w in words):
        return "s"
    return "t" if words & ASIDE_WORDS else "c"


@lru_cache(maxsize=1 << 16)
def described(name: str, attributes: str) -> tuple[str, str, bool]:
    """(signature, marks, whether it is named as a page's header) of a tag; marks: 'x' furniture by tag or role, 'a' article, 'c', 't'
    and 's' by class words."""
    a = _attributes(attributes)
    classes, ident, role = a.get("class", ""), a.get("id", ""), a.get("role", "").lower()
    sign = name + "".join(sorted("." + re.sub(r"\d+", "0", c) for c in classes.split())) + (f"#{re.sub(r'[0-9]+', '0', ident)}" if ident else "")
    if name in FURNITURE or role in ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return sign, "x", False
    if name in ("article", "main") or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody":
        return sign, "a", False
    names = [{w.lower() for w in _WORD.findall(c)} for c in [*classes.split(), ident]] if name not in NEVER_BY_CLASS else []
    said = {named(words) for words in names}
    marks = next((m for m in "tcs" if m in said), "")
    return sign, "x" if marks in ("c", "t") and name in INLINE else marks, name == "header" or any("header" in words for words in names)


def parse(html: str | None) -> Element:
    """The page as a tree, with marks and weights."""
    root = Element("#page", "#page", "", None, False)
    stack, at, made = [root], 0, [root]
    open_names: dict[str, int] = defaultdict(int)
    html = html or ""

    def shut(k: int) -> None:
        for e in stack[k:]:
            open_names[e.name] -= 1
        del stack[k:]

    def close(names: set[str], until: set[str]) -> None:
        if any(open_names[n] for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    return shut(k)
                if stack[k].name in until:
                    return

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            close({name}, set())
            continue
        if name in CLOSES_P:
            close({"p"}, SCOPE)
        if name in SELF_CLOSING:
            close(SELF_CLOSING[name], {"ul", "ol", "dl", "table", "select"})
        up = stack[-1]
        sign, marks, header = described(name, m[4])
        if header and not up.inside and marks in ("", "s") and name not in TEXTUAL:
            marks = "x" if name == "header" or name in INLINE else "c"
        e = Element(name, sign, marks, up, up.inside or marks == "a")
        up.kids.append(e)
        made.append(e)
        if name not in VOID and not m[4].endswith("/") and len(stack) < DEPTH:
            stack.append(e)
            open_names[name] += 1
    if at < len(html):
        stack[-1].kids.append(html[at:])
    for e in reversed(made):  # elements come after those that they are in
        own = sum(len(k.strip()) for k in e.kids if isinstance(k, str))
        e.weight, e.plain = e.weight + own, e.plain + own
        if e.name == "a":
            e.links = e.weight
        if e.up is not None:
            if e.marks not in ("x", "c", "t"):
                e.up.weight, e.up.links = e.up.weight + e.weight, e.up.links + e.links
            if e.marks != "x" and e.name != "a":
                e.up.plain += e.plain
    return root


def signs(e: Element) -> list[tuple[str, Element]]:
    """The regions right below e, those within inline elements too, with signatures that tell siblings apart: plain containers by
    what they hold and, if few, by place."""
    kids, stack = [], [iter(e.kids)]
    while stack:
        for k in stack[-1]:
            if isinstance(k, str) or k.name == "br":
                continue
            if k.name in INLINE:
                stack.append(iter(k.kids))
                break
            kids.append(k)
        else:
            stack.pop()
    plain = [k for k in kids if k.sign in CONTAINERS]
    if len(plain) < 2:
        return [(k.sign, k) for k in kids]
    places: dict[str, int] = {}
    few, out = len(plain) <= 4, []
    for k in kids:
        sign = k.sign
        if sign in CONTAINERS:
            sign += "~L" if k.links > LINK_SHARE * k.weight else "~T"
            places[sign] = places.get(sign, 0) + 1
            sign += str(places[sign]) if few else ""
        out.append((sign, k))
    return out


def own_text(e: Element, whole: bool = False) -> tuple[str, int]:
    """The text of e outside of regions below it (whole: with them), and its characters in links."""
    text, links = [], 0
    stack = [(iter(e.kids), e.name == "a")]
    while stack:
        rest, link = stack[-1]
        for k in rest:
            if isinstance(k, str):
                if s := k.strip():
                    text.append(s)
                    links += len(s) * link
            elif k.marks != "x" and (whole or k.name in INLINE):
                stack.append((iter(k.kids), link or k.name == "a"))
                break
        else:
            stack.pop()
    return " ".join(text), links


def _hash(own: str) -> int:
    return zlib.crc32(own.encode("utf-8", "replace"))


# A region of an expression: g signature, e element, n pages, t characters of own text, l of those in links, c hash of own text (None:
# a slot), s pages by hash of the text (the most frequent), q quantifier, m marks, o pages where a region that class words mark holds
# most of the text, k the regions below it in order. A group of several regions has the signature (a b) and these regions below it.
def expression(e: Element, sign: str | None = None, whole: int | None = None) -> dict:
    """whole: the page's characters outside of links. A page without text counts as no page."""
    if whole is None:
        whole = e.plain
        if not e.weight and not e.plain:
            return {"g": e.sign, "e": e.name, "n": 0, "t": 0, "l": 0, "c": _hash(""), "s": {}, "q": "", "m": e.marks, "o": 0, "k": []}
    own, links = own_text(e)
    kids = folded([expression(k, s, whole) for s, k in signs(e)])
    c = _hash(own)
    counted = e.marks == "s" or (own and not kids and e.name not in NO_TEMPLATE)
    text = {str(_hash(own_text(e, True)[0]) if kids else c): 1} if counted else {}
    return {"g": sign or e.sign, "e": e.name, "n": 1, "t": len(own), "l": links, "c": c, "s": text, "q": "", "m": e.marks, "o": int(e.marks in MOST and e.plain > MOST[e.marks] * whole), "k": kids}


def _quantifier(a: str, b: str, plus: bool, optional: bool) -> str:
    plus, optional = plus or bool({a, b} & {"+", "*"}), optional or bool({a, b} & {"?", "*"})
    return "*" if plus and optional else "+" if plus else "?" if optional else ""


def _optional(xs: list[dict]) -> list[dict]:
    return [x | {"q": _quantifier(x["q"], "", False, True)} for x in xs]


def _group(xs: list[dict]) -> dict:
    return {"g": f"({' '.join(x['g'] for x in xs)})", "e": "()", "n": max(x["n"] for x in xs), "t": 0, "l": 0, "c": None, "s": {}, "q": "", "m": "", "o": 0, "k": xs}


def folded(xs: list[dict]) -> list[dict]:
    """The regions of one page with squares as repeated groups, those of the shortest period first."""
    for p in range(1, PERIOD + 1):
        if 2 * p > len(xs):
            break
        names, out, i = [x["g"] for x in xs], [], 0
        while i < len(xs):
            j = i + p
            while names[j : j + p] == names[i : i + p] and j + p <= len(xs):
                j += p
            if j == i + p or j > len(xs):
                out.append(xs[i])
                i += 1
                continue
            x = xs[i] if p == 1 else _group(xs[i : i + p])
            for k in range(i + p, j, p):
                x = merge(x, xs[k] if p == 1 else _group(xs[k : k + p]), repeated=True)
            out.append(x)
            i = j
        xs = out
    return xs


def _round(group: dict, xs: list[dict], at: int) -> int:
    """How many regions of xs from `at` on are one round of the group: as many as it has, or 0."""
    n = len(group["k"]) if group["e"] == "()" else 0
    return n if n and [x["g"] for x in xs[at : at + n]] == [x["g"] for x in group["k"]] else 0


def aligned(a: list[dict], b: list[dict], one_page: bool) -> list[dict]:
    """The regions of two streams in one order: matched ones merged, all others optional."""
    places: tuple[dict[str, list[int]], dict[str, list[int]]] = (defaultdict(list), defaultdict(list))
    for found, xs in zip(places, (a, b), strict=True):
        for k, x in enumerate(xs):
            found[x["g"]].append(k)

    def ahead(side: int, sign: str, at: int) -> int | None:
        found = places[side].get(sign, [])
        k = bisect_left(found, at)
        return found[k] - at if k < len(found) else None

    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x["g"] == y["g"]:
            out.append(merge(x, y, one_page=one_page))
            i, j = i + 1, j + 1
        elif n := _round(x, b, j):
            out.append(merge(x, _group(b[j : j + n]), one_page=one_page))
            i, j = i + 1, j + n
        elif n := _round(y, a, i):
            out.append(merge(_group(a[i : i + n]), y, one_page=one_page))
            i, j = i + n, j + 1
        else:
            in_a, in_b = ahead(0, y["g"], i), ahead(1, x["g"], j)
            if in_a is None and in_b is None:
                out += _optional([x, y])
                i, j = i + 1, j + 1
            elif in_a is None or (in_b is not None and in_b <= in_a):
                out += _optional(b[j : j + in_b])
                j += in_b
            else:
                out += _optional(a[i : i + in_a])
                i += in_a
    return out + _optional(a[i:]) + _optional(b[j:])


def _counts(a: dict[str, int], b: dict[str, int], one_page: bool) -> dict[str, int]:
    """Of both, the COUNTERS most frequent at most: what the first one beyond them has is taken from all (Misra and Gries)."""
    if not a or not b:
        return a or b
    out = dict(a)
    for h, n in b.items():
        out[h] = max(out.get(h, 0), n) if one_page else out.get(h, 0) + n
    if len(out) > COUNTERS:
        less = sorted(out.values(), reverse=True)[COUNTERS]
        out = {h: n - less for h, n in out.items() if n > less}
    return out


def merge(a: dict, b: dict, repeated: bool = False, one_page: bool = False) -> dict:
    """The expression that fits what a fits and what b fits; repeated: both are on one page, one after the other; one_page:
    both are on one page, inside of such."""
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    one_page = one_page or repeated
    pages = max if one_page else lambda x, y: x + y
    return {
        "g": a["g"], "e": a["e"], "n": pages(a["n"], b["n"]), "t": a["t"] + b["t"], "l": a["l"] + b["l"], "c": a["c"] if a["c"] == b["c"] else None, "s": _counts(a["s"], b["s"], one_page),
        "q": _quantifier(a["q"], b["q"], repeated, False), "m": a["m"], "o": pages(a["o"], b["o"]), "k": aligned(a["k"], b["k"], one_page),
    }


def bounded(x: dict, most: int = REGIONS) -> dict:
    """x with at most so many regions: the rarest, of them the deepest, are folded into those above them, as text."""
    found, level = [], [(x, 0)]
    for e, depth in level:
        found += [(k["n"], -depth, k) for k in e["k"]]
        level += [(k, depth + 1) for k in e["k"]]
    if len(found) <= most:
        return x
    found.sort(key=lambda f: f[:2])
    gone = {id(k) for _, _, k in found[: len(found) - most // 2]}  # to the half, so that this is done seldom

    def lighter(e: dict) -> dict:
        kids, t, n = [], e["t"], e["l"]
        for k in map(lighter, e["k"]):
            if k.pop("gone"):
                t, n = t + k["t"], n + k["l"]
            else:
                kids.append(k)
        folds = id(e) in gone
        if folds:
            t, n = t + sum(k["t"] for k in kids), n + sum(k["l"] for k in kids)
        return e | {"k": kids, "t": t, "l": n, "gone": folds}

    out = lighter(x)
    del out["gone"]
    return out


def decide(wrapper: dict) -> dict:
    """What to do in each region: {"g": signature, "d": drop, "t": drop if its text has one of these hashes, "o": read in spite of class
    words, "r": article root, "k": regions below}; regions that aren't named are read, unless marked."""

    def furniture(x: dict) -> bool:
        return x["m"] == "x" or (x["m"] in MOST and 2 * x["o"] <= x["n"])

    def weigh(x: dict) -> None:
        """T, L: characters below x, and those in links, without furniture."""
        for k in x["k"]:
            weigh(k)
        own = not furniture(x)
        x["T"], x["L"] = own * (x["t"] + sum(k["T"] for k in x["k"])), own * (x["l"] + sum(k["L"] for k in x["k"]))

    def judged(x: dict, inside: bool, above: int) -> dict:
        inside = inside or x["m"] == "a"
        y: dict = {"g": x["g"]}
        menu = not inside and x["L"] > LINK_SHARE * x["T"] > 0 and x["e"] in CONTAINERS
        if furniture(x) or menu or (x["m"] == "s" and x["L"] >= SUSPECT_LINKS * x["T"] > 0):
            return y | {"d": 1}
        if x["m"] in MOST:
            y["o"] = 1
        if above >= TEMPLATE_PAGES and (found := sorted(int(h) for h, n in x["s"].items() if n >= TEMPLATE_SHARE * above)):
            y["t"] = found
        y["k"] = [judged(k, inside, above if x["e"] == "()" else x["n"]) for k in x["k"]]
        return y

    def roots(x: dict, y: dict) -> bool:
        """Mark the outermost article regions that hold text."""
        found = False
        for k, z in zip(x["k"], y["k"], strict=True):
            if z.get("d"):
                continue
            if k["m"] == "a" and k["T"] > 0:
                z["r"], found = 1, True
            else:
                found = roots(k, z) or found
        return found

    def kept(x: dict, y: dict) -> int:
        if "K" not in y:
            y["K"] = 0 if y.get("d") or y.get("t") else x["t"] - x["l"] + sum(kept(k, z) for k, z in zip(x["k"], y["k"], strict=True))
        return y["K"]

    def tidy(y: dict) -> dict:
        """y without what says nothing: regions below that are merely read go, unless their order tells equal signatures apart."""
        kids = [tidy(z) for z in y.pop("k", [])]
        y.pop("K", None)
        told = {z["g"] for z in kids if len(z) > 1}
        if told:
            twice = len([z for z in kids if z["g"] in told]) > len(told)
            y["k"] = kids if twice else [z for z in kids if z["g"] in told]
        return y

    weigh(wrapper)
    out = judged(wrapper, False, wrapper["n"])
    if not out.get("d") and not roots(wrapper, out):
        x, y, whole = wrapper, out, kept(wrapper, out)
        while True:
            heavy = [(k, z) for k, z in zip(x["k"], y["k"], strict=True) if k["e"] not in TEXTUAL and kept(k, z) >= DESCEND * whole > 0]
            if not heavy:
                break
            x, y = heavy[0]
        if y["g"].startswith("("):
            for z in y["k"]:
                z["r"] = 1
        y["r"] = 1
    return tidy(out)


def _below(e: Element, y: dict) -> dict[int, dict]:
    """The decisions for the regions below e, by their ids: each stream position at or after the last one that has the region's
    signature, or, where there is none, the last one before."""
    items = [z for k in y.get("k", ()) for z in (k.get("k", [k]) if k["g"].startswith("(") else [k])]
    if not items:
        return {}
    places = defaultdict(list)
    for n, z in enumerate(items):
        places[z["g"]].append(n)
    out, at = {}, 0
    for sign, k in signs(e):
        if found := places.get(sign):
            n = bisect_left(found, at)
            at = found[n] if n < len(found) else found[-1]
            out[id(k)] = items[at]
    return out


def blocks(page: Element, decisions: dict) -> list[str]:
    """The page's blocks inside article roots (of the whole page if it has none of them), in order."""

    def read(e: Element, y: dict, inside: bool, out: list[str]) -> None:
        parts: list[str] = []

        def flush() -> None:
            if s := " ".join(entities.unescape("".join(parts)).split()):
                out.append(s)
            parts.clear()

        if y.get("d") or e.marks == "x" or (e.marks in MOST and not y.get("o")):
            return
        if y.get("t") and _hash(own_text(e, True)[0]) in y["t"]:
            return
        inside = inside or bool(y.get("r"))
        below = _below(e, y)
        stack = [iter(e.kids)]
        while stack:
            for k in stack[-1]:
                if isinstance(k, str):
                    if inside:
                        parts.append(k)
                elif k.name == "br":
                    parts.append(" ")
                elif k.name not in INLINE:
                    flush()
                    read(k, below.get(id(k), {}), inside, out)
                elif k.marks != "x":
                    stack.append(iter(k.kids))
                    break
            else:
                stack.pop()
        flush()

    out: list[str] = []
    read(page, decisions, False, out)
    if not out and not decisions.get("r"):
        read(page, decisions, True, out)
    return out


def extract_text(html: str | None, decisions: dict) -> str:
    return "\n".join(blocks(parse(html), decisions))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, wrapper as JSON) of every host."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(h, zlib.crc32(s.encode()) % ROUND, s) for h, x in held.items() for s in [json.dumps(x)]], columns=["host", "part", "x"])

        for b in batches:
            for host, page in zip(b["host"], b["html"], strict=True):
                x = expression(parse(page))
                held[host] = bounded(merge(held[host], x) if host in held else x)
            if len(held) >= HOSTS_AT_ONCE:
                yield out()
                held.clear()
        yield out()

    def join(b: pd.DataFrame) -> dict:
        x = None
        for s in sorted(b["x"]):
            x = bounded(merge(x, json.loads(s))) if x else json.loads(s)
        return x

    part = rows.mapInPandas(fold, "host string, part int, x string")
    # a host has at most ROUND rows after this one, and one for each task before it
    some = part.groupBy("host", "part").applyInPandas(lambda b: pd.DataFrame({"host": b["host"][:1], "x": [json.dumps(join(b))]}), "host string, x string")
    return some.groupBy("host").applyInPandas(lambda b: pd.DataFrame([(b["host"].iloc[0], x["n"], json.dumps(x)) for x in [join(b)]], columns=["host", "pages", "wrapper"]), "host string, pages long, wrapper string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text of every page."""
    found = wrappers(pages, url_col, html_col)
    decisions = cut(found.mapInPandas(lambda bs: (pd.DataFrame({"of": b["host"], "decisions": [json.dumps(decide(json.loads(w))) for w in b["wrapper"]]}) for b in bs), "of string, decisions string"), "wrappers")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    @F.pandas_udf("string")
    def text(html: pd.Series, decisions: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}
        return pd.Series([extract_text(h, known.get(d) or known.setdefault(d, json.loads(d))) for h, d in zip(html, decisions, strict=True)], dtype=object)

    joined = rows.join(decisions, F.col("host") == F.col("of"))
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text("html", "decisions").alias("text"))
