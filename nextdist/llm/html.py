"""HTML extraction by two passes over a page's blocks.

A page is cut into blocks at block-level tags. The first pass decides blocks: those in a
container that is never main text (navigation, header, footer, advert, form, ...) or made
of links are bad; those with enough stop words or, in running text, enough length are good. Of long ones
with hardly a stop word, whose language may have no list here, those that read as sentences are good or undecided, and
others outside an article are bad. Short and unclear ones stay undecided. The second pass gives those the label of the nearest decided neighbours. The borders of an article
count as good neighbours, those of other containers and of the page as bad, but a heading goes by what
follows it and a page's last paragraphs by what is before them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

#: Fixed word list: frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could do for from had has have he her his how i if in into is it its more no not of on one or our out she so "
    "some such than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so "
    "über um und uns von vor war was wenn wie wir zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "al como con de del el ella en es esta este la las lo los más me mi muy no nos o para pero por que se si sin su sus también te un una y ya".split()
)
#: Fixed names of elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td template tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("script style noscript template svg iframe object canvas select textarea button head title audio video".split())
BAD_TAGS = frozenset("nav header footer aside menu dialog".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_TAGS = frozenset("article main".split())
#: Elements whose content is never the article, whatever is in it.
NOT_AROUND = ("nav", "aside", "footer", "menu", "dialog")
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class names and ids of what is not main text: alone, or joined with words that only say where or in what form.
BAD_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "respond reply replies disqus pagination pager toolbar skip copyright".split()
)
PLAIN_WORDS = frozenset(
    "about alert also area articles bar block body bottom box btn button buttons card cards center close col column container content count cta desktop entry feed fixed float floating form global group header "
    "heading icon icons info inline inner item items js large law leaderboard left link links list main media message meta mobile more mpu narrow number outer page panel policy post posts primary privacy read rectangle right "
    "row search secondary section site skyscraper slot small sticky stories story strip text thread title toggle top trail unit user view wide wp wrap wrapper".split()
)
#: Names that are bad outside articles; in an article they name a part of it.
BAD_OUTSIDE = frozenset("discussion".split())
#: What these name is no article even where it is marked up as one.
NEVER_ARTICLE = frozenset("comment comments respond reply replies disqus related recommended promo promotion ad ads advert adverts sponsored teaser widget".split())
#: What these name is reader comments whatever is said beside, unless it is a state of the page; what begins with these is for sharing.
COMMENT_WORDS = frozenset("comment comments disqus".split())
STATE_WORDS = frozenset("allow allowed closed count disabled enabled free has no off on open with without".split())
SHARE_WORDS = frozenset("share sharing".split())
SHARED_WORDS = frozenset("article email facebook linkedin on options print reddit telegram this tools twitter us via whatsapp with".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Quotes count after an equals sign only, as in browsers.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?![\"'])[^\s>]*+))*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=>/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_NAMED = re.compile(r"class|id|role|hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*/?>", re.I) for name in RAW}
_NAME = re.compile(r"[a-z]+", re.I)
_WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")
#: Scripts whose words have no blanks between them, and ends of sentences.
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_SENTENCE = re.compile("[.!?\u2026\u0964\u06d4\u061f](?=[\\s\"'\u201d\u2019\u00bb)]|$)|[\u3002\uff01\uff1f\u1362]")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

LENGTH_LOW, LENGTH_HIGH = 70, 200
#: A letter of a dense script counts as so many; running text has a sentence's end in so many letters.
DENSE, SENTENCE = 3, 300
STOP_LOW, STOP_HIGH = 0.10, 0.25
MAX_LINKS = 0.5
ARTICLE_MAX_LINKS = 0.9
GOOD, BAD, UNDECIDED = 1, -1, 0


def _bad_attributes(attrs: str, article: int) -> tuple[bool, bool]:
    """Whether attributes name something that is not main text, and whether it is never an article."""
    bad = never = False
    if not _NAMED.search(attrs):
        return bad, never
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in BAD_ROLES):
            bad = True
        elif name in ("class", "id"):
            for words in map(_words_of, value.split()):
                if _bad_name(words, article):
                    bad = True
                    never = never or any(w in NEVER_ARTICLE for w in words)
    return bad, never


def _words_of(name: str) -> list[str]:
    return [w.lower() for w in _NAME.findall(_CAMEL.sub(" ", name))]


def _bad_name(words: list[str], article: int) -> bool:
    """Whether a class or id, taken whole, names something that is not main text."""
    if not article and len(words) == 1 and words[0] in BAD_OUTSIDE:
        return True
    if any(w in COMMENT_WORDS for w in words) and not any(w in STATE_WORDS for w in words):
        return True
    if words and words[0] in SHARE_WORDS and all(w in BAD_WORDS or w in PLAIN_WORDS or w in SHARED_WORDS for w in words):
        return True
    return any(w in BAD_WORDS for w in words) and all(w in BAD_WORDS or w in PLAIN_WORDS for w in words)


class _Block:
    __slots__ = ("parts", "links", "bad", "article", "tag", "form")

    def __init__(self, bad: bool, article: int, tag: str = "", form: int = 0):
        self.parts: list[str] = []
        self.links = 0
        self.bad = bad
        self.article = article
        self.tag = tag
        self.form = form


def blocks(html: str) -> list[tuple[str, int, bool, int, str, int]]:
    """``(text, characters in links, in a bad container, number of its article or 0, innermost element, number of its form or 0)`` in page order.

    One pass; what an end tag closes is popped once, and an end tag of nothing open costs nothing.
    """
    out: list[tuple[str, int, bool, int, str, int]] = []
    # open block-level and skipped elements: (name, bad, article, skipped, never an article, form, bad as an article's header only)
    stack: list[tuple[str, bool, int, bool, bool, int, bool]] = []
    opened: Counter = Counter()
    bad, article, skipped, never, articles = False, 0, False, False, 0
    form, forms, heads = 0, 0, False
    advert, depth, floor = "", 0, 0  # an inline element that is left out: its name, how many of that name are open, and the stack's height around it
    in_link, in_code, here, at, end = 0, 0, _Block(False, 0), 0, len(html)

    def flush() -> None:
        nonlocal here
        if here.parts:
            text = _SPACE.sub(" ", unescape("".join(here.parts))).strip()
            if text:
                out.append((text, here.links, here.bad, here.article, here.tag, here.form))
        here = _Block(bad, article, stack[-1][0] if stack else "", form)

    def add(text: str) -> None:
        if text and not skipped and not advert:
            here.parts.append(text)
            if in_link:
                here.links += len(text.strip())

    def close(height: int) -> None:
        nonlocal bad, article, skipped, never, advert, form, heads
        while len(stack) > height:
            opened[stack.pop()[0]] -= 1
        bad, article, skipped, never, form, heads = stack[-1][1:] if stack else (False, 0, False, False, 0, False)
        if advert and height < floor:
            advert = ""

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        add(html[at:lt])
        m = _TAG.match(html, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in ("br", "hr", "wbr"):
            if name != "wbr" and not advert:
                here.parts.append(" ")
            if name == "hr":
                flush()
            continue
        whole = name in BLOCK_TAGS or name in SKIPPED
        if closing:
            if name == "a":
                in_link = 0
            elif name == "code":
                in_code = 0
            if advert == name:
                depth -= 1
                if not depth:
                    advert = ""
            if whole and opened[name]:
                height = len(stack) - 1
                while stack[height][0] != name:
                    height -= 1
                close(height)
            if name in BLOCK_TAGS:
                flush()
            continue
        if name in VOID or m[3].endswith("/") and not whole:
            continue
        is_bad, no_article = _bad_attributes(m[3], article)
        if whole:
            if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):  # an open one ends where the next begins
                ends = {"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th") else {name}
                height = len(stack)
                while height and stack[height - 1][0] == "p" and "p" not in ends:
                    height -= 1
                if height and stack[height - 1][0] in ends:
                    close(height - 1)
            elif stack and stack[-1][0] == "p" and name in BLOCK_TAGS:
                close(len(stack) - 1)
            is_bad = is_bad or name in BAD_TAGS
            if name in ARTICLE_TAGS:
                is_bad = no_article and name == "article"
                if not is_bad and not never and not any(opened[t] for t in NOT_AROUND):
                    bad = False  # the names of what is around a page's article don't speak for it
                if not article:
                    articles += 1
                    article = articles
            if name == "header" and article and not bad and not _bad_attributes(m[3], article)[0]:
                bad = heads = True  # an article's header: only its headings are the article's
            elif name in HEADINGS and heads and not is_bad:
                bad = False
            else:
                if is_bad and name not in ("body", "html"):
                    bad, heads = True, False
            if name == "form":
                forms += 1
                form = form or forms
            never = never or no_article
            skipped = skipped or name in SKIPPED
            stack.append((name, bad, article, skipped, never, form, heads))
            opened[name] += 1
            if name in BLOCK_TAGS:
                in_link = in_code = 0
                flush()
            if name in RAW and not (m[3].endswith("/") and name not in ("script", "style")):
                stop = _RAW_END[name].search(html, at)
                at = stop.start() if stop else end
            continue
        if advert == name:
            depth += 1
        elif is_bad and not advert and not in_code and not opened["pre"]:  # set apart inside a line, as an advert; in code, a colour
            advert, depth, floor = name, 1, len(stack)
        if name == "a":
            in_link = 1
        elif name == "code":
            in_code = 1
    flush()
    return out


def without_forms(found: list[tuple[str, int, bool, int, str, int]]) -> list[tuple[str, int, bool, int, str]]:
    """The blocks with those in forms marked as bad, but for a form that is only wrapped around the page: one with most of its running text, in paragraphs or headings of its own."""
    running = Counter()
    for text, links, bad, _, tag, form in found:
        if not bad and (tag in HEADINGS or tag == "p" or links < MAX_LINKS * len(text)):
            running[form] += len(text) - links
    parts = Counter(b[5] for b in found if not b[2] and (b[4] == "p" or b[4] in HEADINGS))
    around = {f for f, n in running.items() if f and 2 * n > sum(running.values()) and parts[f] > 1}
    return [(text, links, bad or bool(form and form not in around), article, tag) for text, links, bad, article, tag, form in found]


def width(text: str) -> int:
    """Letters, where one of a script without blanks between words counts for more."""
    return len(text) if text.isascii() else len(text) + (DENSE - 1) * len(_DENSE.findall(text))


def reads_as_sentences(text: str) -> bool:
    """Whether sentences end in it, as often as in running text."""
    return width(text) <= SENTENCE * len(_SENTENCE.findall(text))


def classify(found: list[tuple[str, int, bool, int, str]]) -> list[bool]:
    """Whether each block is main text."""
    labels = []
    some_article = any(b[3] and not b[2] for b in found)
    for text, links, bad, article, tag in found:
        words = _WORD.findall(text.lower())
        stop = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        density, size = links / len(text), width(text)
        if bad or (some_article and not article):
            label = BAD
        elif density > (ARTICLE_MAX_LINKS if article else MAX_LINKS):
            label = UNDECIDED if article and (size < LENGTH_LOW or tag == "p") else BAD
        elif size < LENGTH_LOW:
            label = UNDECIDED
        elif stop >= STOP_HIGH or (stop >= STOP_LOW and size > LENGTH_HIGH):
            label = GOOD
        elif article or stop >= STOP_LOW:
            label = UNDECIDED
        elif reads_as_sentences(text):  # in a language without a list
            label = GOOD if size > LENGTH_HIGH or tag == "p" else UNDECIDED
        else:
            label = BAD
        labels.append(label)
    if GOOD not in labels and not some_article:  # a page of short paragraphs only: nothing decided to inherit from
        labels = [GOOD if label == UNDECIDED and found[i][4] in ("p", *HEADINGS) and not found[i][1] else label for i, label in enumerate(labels)]
    before, after = _nearest(found, labels, range(len(found))), _nearest(found, labels, range(len(found) - 1, -1, -1))
    last = max((i for i, label in enumerate(labels) if label and not found[i][2]), default=-1)  # decided by its own text
    out = []
    for i, label in enumerate(labels):
        if label == UNDECIDED and found[i][3]:  # in an article one good side is enough
            label = max(before[i], after[i])
        elif label == UNDECIDED:
            # both sides; a heading goes by what follows it, and a page's last paragraphs by what is before them
            label = after[i] if found[i][4] in HEADINGS else before[i] if found[i][4] == "p" and i > last else min(before[i], after[i])
        out.append(label == GOOD)
    return out


def _nearest(found: list[tuple[str, int, bool, int, str]], labels: list[int], order: range) -> list[int]:
    """The label of each block's nearest decided neighbour in an order; an article's border is good, a page's bad.

    What stands apart inside an article, such as an advert, doesn't speak for its neighbours.
    """
    out, seen = [0] * len(found), {}
    for i in order:
        article = found[i][3]
        out[i] = seen.get(article, GOOD if article else BAD)
        if labels[i] and not (article and found[i][2]):
            seen[article] = labels[i]
    return out


def main_text(html: str | None) -> str:
    """Main text of one page: its good blocks, one a line."""
    if not html:
        return ""
    found = without_forms(blocks(html))
    return "\n".join(b[0] for b, ok in zip(found, classify(found), strict=True) if ok)


def extract_pages(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` to the columns ``keep`` (default: all but ``html``) of ``pages(html, ...)``.

    Each row is read whole and on its own, so nothing is shuffled. Nulls: a null html is an
    empty page with an empty text. Repeated rows give repeated results, an empty table an empty
    one. A language without a stop-word list goes by length, links and sentences; what is lost of it outside articles is text without
    a sentence's end. Broken markup (open elements, stray tags, stray quotes, cut references) is read as browsers do, a page of any length
    in one pass. Input columns named like a result are replaced.
    """
    own = ["text", "n_chars"]
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in (*own, "html")]
    rows = without(pages, own)
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("_nextdist_html")]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, *own])

    return rows.select(F.col("html").alias("_nextdist_html"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


#: For pages as the given tables have them: one article of headings and paragraphs, with nothing to drop inside it.
ORACLE_SQL = r"""
with a as (select row_number() over () as r, page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') as x from pages),
b as (select r, unnest(string_split(regexp_replace(x, '</?(?:p|h1)>', chr(1), 'g'), chr(1))) as raw, generate_subscripts(string_split(regexp_replace(x, '</?(?:p|h1)>', chr(1), 'g'), chr(1)), 1) as i from a),
c as (select r, i, regexp_replace(regexp_replace(raw, '<br>', ' ', 'g'), '</?b>', '', 'g') as s from b),
d as (select r, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#(?:39|x27);?', '''', 'g'), '&amp;?', '&', 'g') as s from c),
e as (select r, i, trim(regexp_replace(s, '\s+', ' ', 'g')) as s from d),
f as (select r, string_agg(s, chr(10) order by i) as text from e where s <> '' group by r)
select page_id, url, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n_chars from a left join f using (r)
"""
