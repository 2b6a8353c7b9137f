"""Operator 2: main text of web pages by block rules in two passes."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import released, small_batches

#: A block has a character of a block-level element at most; every tag of these starts a new one.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
#: Elements whose whole content is no text of the page.
DROPPED_TAGS = frozenset("script style noscript template textarea select option button svg math iframe object applet canvas audio video map head title datalist noembed noframes".split())
#: Elements whose content is read as raw text to their end tag.
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Containers of boilerplate, whatever they hold.
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a class, id or role is about, its last word, that makes a container boilerplate; and what only hints at it, so that long prose outranks it.
BOILERPLATE_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead footer sidebar sidebars aside widget widgets related recommended share sharing social newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices popup modal overlay comment comments commentlist respond reply replies disqus pagination pager toolbar complementary contentinfo teaser teasers outbrain taboola".split())
#: Of these, what a reader or advertiser adds to an article, or a site tells its readers: boilerplate inside an article too, where other names only hint; and what makes an article element a comment or a card.
ADDED_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices popup modal comment comments commentlist respond reply replies disqus outbrain taboola".split())
NO_ARTICLE_NAMES = frozenset("comment comments commentlist reply replies disqus teaser teasers related recommended promo sponsored".split())
HINT_NAMES = frozenset("header alert alerts search searchbox legal copyright skip".split())
#: Last words that say nothing of what a container is about: the word before them does.
GENERIC_NAMES = frozenset("area bar block body bottom box button container content form group inner item items left link links list main outer panel right row section slot text title top unit wrap wrapper".split())
STOP_WORDS = {
    "en": frozenset("the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over me even most made after also did many before must through".split()),
    "de": frozenset("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde".split()),
    "fr": frozenset("de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais on tout aux cette ses elle être fait leur ont bien même sans deux".split()),
    "es": frozenset("de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque".split()),
}
#: The numbers of the lists that a word is in.
_LISTS = {w: tuple(k for k, stop in enumerate(STOP_WORDS.values()) if w in stop) for w in frozenset().union(*STOP_WORDS.values())}
#: Pass one: link density over this is bad; text of fewer characters is short; stop-word shares that make text good or near good.
MAX_LINK_DENSITY, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.5, 70, 200, 0.10, 0.20
#: So many blocks of links in a row are a menu, wherever they stand. Elements nested deeper than DEEP aren't told apart. So many tags without an end are read to the end of the page.
MENU, DEEP, UNENDED = 3, 512, 1

_MARKUP = re.compile(r"<(?:!--|[!?]|/?(?=[a-zA-Z]))")
_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_SIMPLE = re.compile(r"""([^\s/>="']+)\s*=\s*("[^">]*"|'[^'>]*'|[^\s>"']*)""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none")
_WORD = re.compile(r"\w+")


class Tags:
    """Reads a page's tags from left to right, by the rules of HTML for quotes: they count only as the first character of a value."""

    def __init__(self, page: str):
        self.page, self.end = page, len(page)
        self.last = {c: page.rfind(c) for c in "\"'>"}  # so that nothing is searched for in vain, again and again
        self.unended = 0

    def read(self, at: int) -> tuple[str, dict[str, str], int] | None:
        """(name, attributes, where it ends) of the tag whose name begins at `at`; None if no > follows. An open quote ends with its tag.

        A tag that the page ends in by these rules ends at its first >. After UNENDED of them quotes don't count any more, so that a page's end is looked for a few times only.
        """
        if self.last[">"] < at:
            return None
        page = self.page
        m = _TAG.match(page, at)
        name, i, found = m[0].lower(), m.end(), {}
        if self.unended >= UNENDED:
            stop = page.find(">", at)
            for a in _SIMPLE.finditer(page, i, stop):
                found.setdefault(a[1].lower(), a[2].strip("\"'"))
            return name, found, stop + 1
        while True:
            i = _BETWEEN.match(page, i).end()
            if i >= self.end:
                self.unended += 1
                return name, found, page.find(">", at) + 1
            if page[i] == ">":
                return name, found, i + 1
            m = _ATTRIBUTE.match(page, i)
            key, i = m[0].lower(), m.end()
            value = ""
            if m := _EQUALS.match(page, i):
                i = m.end()
                quote = page[i : i + 1]
                if quote in ("\"", "'"):
                    if self.last[quote] <= i:
                        return name, found, (page.find(">", i) + 1) or self.end
                    stop = page.find(quote, i + 1)
                    value, i = page[i + 1 : stop], stop + 1
                else:
                    m = _UNQUOTED.match(page, i)
                    value, i = m[0], m.end()
            found.setdefault(key, value)


def named(value: str) -> set[str]:
    """What the names in a class, id or role are about: the last word of each that isn't generic."""
    out = set()
    for name in value.split():
        words = _LETTERS.findall(_CAMEL.sub("-", name).lower())
        while len(words) > 1 and words[-1] in GENERIC_NAMES:
            words.pop()
        out.update(words[-1:])
    return out


def boilerplate(tag: str, attributes: dict[str, str], inside: bool = False) -> int:
    """2 for a container of boilerplate, 1 for one that its names hint at, else 0. Inside an article names of what isn't added to it only hint."""
    if tag in BOILERPLATE_TAGS:
        return 2
    if not attributes or tag in ("html", "body", "main"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "").lower()):
        return 2
    about = set().union(*(named(attributes[k]) for k in ("class", "id", "role") if k in attributes))
    if tag == "article":
        return 2 if about & NO_ARTICLE_NAMES else 0
    return 2 if about & (ADDED_NAMES if inside else BOILERPLATE_NAMES) else 1 if about & (HINT_NAMES | BOILERPLATE_NAMES) else 0


class Block(NamedTuple):
    """A stretch of text between block-level tags: linked are its characters in links, boiler as in `boilerplate`, marked if in an article or main part, box its container."""

    text: str
    linked: int
    boiler: int
    marked: bool
    tag: str
    box: int


def blocks(page: str) -> list[Block]:
    """The page's blocks in order. Open elements are closed by their parent's end."""
    out, stack, text, linked = [], [], [], 0
    bad, hint, dropped, article, links, pushed, own = 0, 0, 0, 0, 0, 0, 0  # own: characters of the open article so far
    opened: Counter = Counter()
    tags = Tags(page)

    def close_block():
        nonlocal linked, own
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            tag = next((t for t, *_ in reversed(stack) if t in BLOCK_TAGS), "")
            box = next((k for t, _, _, k in reversed(stack) if t in ("div", "section", "td", "main", "article", "body")), 0)
            out.append(Block(joined, linked, 2 if bad else 1 if hint else 0, article > 0, tag, box))
            own += len(joined) if article and not bad else 0
        text.clear()
        linked = 0

    def pop(i: int):
        nonlocal bad, hint, dropped, article, links
        while len(stack) > i:
            tag, boiler, mark, _ = stack.pop()
            opened[tag] -= 1
            bad -= boiler == 2
            hint -= boiler == 1
            dropped -= tag in DROPPED_TAGS
            article -= mark
            links -= tag == "a"

    at = 0
    while at < len(page):
        m = _MARKUP.search(page, at)
        until = m.start() if m else len(page)
        if until > at and not dropped:
            text.append(page[at:until])
            if links:
                linked += until - at
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
            continue
        if m[0] in ("<!", "<?"):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            continue
        if (read := tags.read(at)) is None:  # no more tags
            if not dropped:
                text.append(page[until:])
            break
        tag, attributes, at = read
        if m[0] == "</":
            if tag in BLOCK_TAGS or tag == "br":
                close_block()
            if opened[tag] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        pop(i)
                        break
                    if stack[i][0] in ("article", "main", "td", "body") and tag not in ("html", "body", "article", "main", "table", "tr"):
                        break
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in BLOCK_TAGS:
            close_block()
            for i in range(len(stack) - 1, -1, -1):  # what an omitted end tag has left open
                t = stack[i][0]
                if t == "p" or t == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                    pop(i)
                    break
                if t in BLOCK_TAGS:
                    break
        elif tag == "img":
            text.append(" ")
        if tag in VOID_TAGS or page[at - 2] == "/" and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            continue
        boiler = boilerplate(tag, attributes, article > 0)
        if tag == "article" and opened["article"] and own > LONG:  # behind an article's text, inside of it: a comment, by the rules of HTML
            boiler = 2
        if boiler and tag not in BLOCK_TAGS:
            close_block()
        if boiler and tag == "header" and article and not bad:  # an article's own heading
            boiler = 0
        if len(stack) >= DEEP:
            continue
        pushed += 1
        mark = tag in ("article", "main") and boiler < 2
        own = 0 if mark and not article else own
        stack.append((tag, boiler, mark, pushed))
        opened[tag] += 1
        bad += boiler == 2
        hint += boiler == 1
        dropped += tag in DROPPED_TAGS
        article += mark
        links += tag == "a"
    close_block()
    return out


def stop_shares(found: list[Block]) -> list[float | None]:
    """Each block's share of stop words, by the list that fits the page best or, if that one doesn't fit the block, another; None on a page that no list fits."""
    shares, size, total = [], [], [0] * len(STOP_WORDS)
    for b in found:
        words = _WORD.findall(b.text.lower()) if b.boiler < 2 else []
        count = [0] * len(STOP_WORDS)
        for lists, n in Counter(map(_LISTS.get, words)).items():
            for k in lists or ():
                count[k] += n
        size.append(len(words))
        shares.append([n / max(1, len(words)) for n in count])
        total = [a + b for a, b in zip(total, count)]
    best = max(range(len(total)), key=total.__getitem__)
    if total[best] < STOP_LOW * sum(size):
        return [None] * len(found)
    return [share[best] if share[best] >= STOP_LOW else max(share) for share in shares]


def first_pass(block: Block, share: float | None, marked: bool) -> str:
    """good, bad, near (good) or short (undecided), of a block alone.

    Stop words, length and links decide. In the part that a page marks as its article (marked) they have to show less for good, and what they call bad elsewhere is undecided.
    """
    size, density = len(block.text), block.linked / len(block.text)
    fits = STOP_HIGH if share is None else share  # without a list for its language length and links decide
    if block.boiler == 2 or block.boiler == 1 and not (fits >= STOP_HIGH and size > LONG and density <= MAX_LINK_DENSITY):
        return "bad"
    if density > MAX_LINK_DENSITY:
        return "short" if marked else "bad"
    if size < SHORT or fits < STOP_LOW:
        return "short"
    if fits < STOP_HIGH:
        return "good" if marked and size > LONG else "near"
    return "good" if marked or size > LONG else "near"


def nearest(label: list[str]) -> list[tuple[str, str]]:
    """The nearest good or bad label before and after each; edge where there is none."""
    out = []
    for way in (label, label[::-1]):
        last, side = "edge", []
        for x in way:
            side.append(last)
            last = x if x in ("good", "bad") else last
        out.append(side)
    return list(zip(out[0], out[1][::-1]))


def second_pass(found: list[Block], label: list[str], marked: bool) -> list[str]:
    """Labels good and bad: near good blocks first, then short ones, take after the nearest decided ones before and after them.

    In a marked part, whose edges count as good, a block is bad if both of these are bad; elsewhere it must be near good ones.
    """
    label = list(label)
    if marked:
        sides = nearest(label)
        return [x if x in ("good", "bad") else "bad" if s == ("bad", "bad") else "good" for x, s in zip(label, sides)]
    if "good" not in label:
        label = ["good" if x == "near" else x for x in label]
    for kind in ("near", "short"):
        sides = nearest(label)
        boxes = {b.box for b, k in zip(found, label) if k == "good"}
        for i, (k, (before, after)) in enumerate(zip(list(label), sides)):
            if k == kind:
                near_good = "good" in (before, after)
                both = before != "bad" and after != "bad" and near_good
                label[i] = "good" if both or near_good and (kind == "near" or found[i].box in boxes) else "bad"
    return label


def labels(found: list[Block]) -> list[str]:
    """Both passes over a page's blocks.

    A page's marks count if most of what reads like text stands in them. Then the second pass goes over the marked blocks that no boilerplate container holds, as
    if they were the page; runs of blocks of links are bad there too. Other blocks are bad.
    """
    share = stop_shares(found)
    alone = [first_pass(b, s, False) for b, s in zip(found, share)]
    inside, outside = (sum(len(b.text) for b, k in zip(found, alone) if b.marked == where and k in ("good", "near")) for where in (True, False))
    if not any(b.marked and b.boiler < 2 for b in found) or inside < outside:
        label = second_pass(found, alone, False)
        if "good" not in label:  # a page of short blocks: those that aren't links
            label = ["good" if b.boiler == 0 and b.linked <= MAX_LINK_DENSITY * len(b.text) and b.tag not in ("li", "td", "th") else "bad" for b in found]
        return label
    inner = {i: first_pass(b, s, True) for i, (b, s) in enumerate(zip(found, share)) if b.marked and b.boiler < 2}
    some = [i for i, k in inner.items() if k != "bad" or not found[i].boiler]  # what names hint at, and isn't long prose, is no neighbour
    own = [inner[i] for i in some]
    for i, j in runs([found[k].linked > MAX_LINK_DENSITY * len(found[k].text) for k in some]):
        if j - i >= MENU:
            own[i:j] = ["bad"] * (j - i)
    out = ["bad"] * len(found)
    for i, k in zip(some, second_pass([found[i] for i in some], own, True)):
        out[i] = k
    return out


def runs(marks: list[bool]) -> list[tuple[int, int]]:
    """Where runs of true ones begin and end."""
    edge = [i for i, (a, b) in enumerate(zip([False, *marks], [*marks, False])) if a != b]
    return list(zip(edge[::2], edge[1::2]))


def main_text(page: str | None) -> str:
    """The blocks of the page's article, one a line; see extract_text."""
    found = blocks(page or "")
    return "\n".join(b.text for b, k in zip(found, labels(found)) if k == "good")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text), n_chars (its code points) for every row of pages.

    The whole html is read, null as empty, and a page without text gives an empty one. Markup splits a page into blocks. Blocks in navigation, headers, footers,
    sidebars, forms, notices, adverts and reader comments, as tags and names of classes tell, are bad; so are article elements named as comments or cards, or that stand inside an article
    behind its text. Pass one labels each block by its stop-word density, length and
    link density, and pass two gives undecided blocks their nearest decided neighbours' label. Where a page marks its article or main part, pass one asks for
    less there, and pass two takes the marked part for the page. Good blocks stay whole and in order. Time grows with the html's length, whatever it holds. Rows don't
    affect each other: repeated rows give repeated rows. Other columns are ignored.
    """

    @released
    def run(batches):
        for batch in batches:
            text = [main_text(x) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
