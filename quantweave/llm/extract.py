"""Main text of web pages: structure first, then each host's suffix array.

A page is cut into blocks by its markup. Blocks in menus, footers, adverts and
the like are page furniture. The host's suffix array settles all others, those
of the article too. The token streams of a host's pages are laid side by side
and every suffix gets a name by prefix doubling: the name of its first 2k tokens
is made of the names of two suffixes' first k. Sorted by the names of LONG
tokens, suffixes that share that much lie in a row. Such a row is boilerplate if
it holds pages of CONTENTS contents or more and of a share of all the host's
contents; the tokens that its suffixes cover go, unique runs stay. A shorter
block goes only as a whole, and if most of the host's contents carry it. Copies
and near copies have one content: what they share is their text, not the host's.

All counts are those of the whole host, however large. A host is dealt into parts
of about PAGES pages by their contents, and three passes over the same shuffled
parts count over all of them: parts name the candidates, count these, and cut
what the sums make boilerplate. A run on a share of a host's contents is on that
share of at least one part's contents, so no candidate is missed; how pages are
dealt moves work, never a result.
"""

import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import Words, mix, slices

#: Tokens of a repeated run that is boilerplate (a power of two); shorter blocks count as wholes.
LONG = 16
#: Different contents of the pages on which it must occur, and their least share of these pages.
CONTENTS, SHARE = 3, 1 / 3
#: The least share of all the host's contents: in an article, in other text, and of a short block.
IN_ARTICLE, ELSEWHERE, SHORT = 1 / 4, 1 / 20, 1 / 2
#: Pages of a part of a host, and the most hosts that may be dealt into parts: with more pages the parts grow.
PAGES, LARGE_HOSTS = 512, 1 << 20
#: Pages of a content that a task sends to the content's part; it spreads what copies follow.
TOGETHER = 2
#: Bytes of text that are sorted at a time; one part of a host may have FULL.
TEXT, FULL = 1 << 23, 1 << 25
#: Share of a block's characters inside links from which it is a menu.
LINKED = 0.6

_TAG = re.compile(r"""<(?:(!--)|([!?])|(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][\w:-]*)[^>]*+(?:>|$))""")
_ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas video audio select".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
_FURNITURE = frozenset("nav footer aside form menu dialog button fieldset head".split())
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption summary address".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar alert toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies"
    " disqus discussion feedback footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification"
    " pagination pager paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words beside these in a class: main-nav and sidebar_left are furniture, no-sidebar and related-work are not.
_BESIDE = frozenset("area bar block blog bottom box container entry global group inner item left links list main outer page post primary reader readers right row secondary section site thread top user users wrap wrapper".split())
#: Names that are ordinary words: inside an article they need a second sign, links or repetition over the host.
_WORDS = frozenset("banner comment consent discussion feedback form login menu navigation notice notices notification pagination promotion recommended related replies reply respond search skip social subscription".split())
#: Names of what others say below an article, and of notes to its readers: as a box of its own it goes without a second sign.
_BOXES = frozenset("div section ul ol dl table".split())
_SAID = frozenset("comment comments commentlist disqus replies notice notices notification notifications".split())
#: A box of this name is the readers', unless a heading begins it: then it is a section of the text.
_TALK = frozenset(["discussion"])
#: What an article element is called that is not the page's own; and adverts within a line.
_TEASERS = frozenset("ad advert advertisement comment comments promo promoted recommended related reply sponsored teaser teasers".split())
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising promo promoted sponsored".split())
_HEADING = re.compile(r"\s*<h[1-6]\b", re.IGNORECASE)
#: Elements that hold the text itself, whatever they are called.
_CONTENT = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Names that mean the whole page's furniture, but an article's own part inside one.
_OUTER = frozenset(["header"])


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _tokens(text: str) -> list[list[str]]:
    """The words of each class token or id."""
    return [[w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if w] for token in text.split()]


def _named(tokens: list[list[str]], names: frozenset) -> bool:
    return any(not names.isdisjoint(t) and all(w in names or w in _BESIDE for w in t) for t in tokens)


def _is_furniture(name: str, attributes: dict[str, str], in_article: bool, headed: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether its name alone says so (a second sign must tell).
    headed: its content begins with a heading."""
    if name in _FURNITURE or name in _OUTER and not in_article:
        return True, False
    if not attributes:
        return False, False
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True, False
    if attributes.get("role", "").lower() in _ROLES:
        return True, False
    if name == "article":
        return _named(_tokens(attributes.get("class", "")), _TEASERS), False
    if name in _CONTENT:
        return False, False
    if name in _INLINE:
        return _named(_tokens(attributes.get("class", "")), _ADVERTS), False
    kinds, own = _tokens(attributes.get("class", "")), _tokens(attributes.get("id", ""))
    if not in_article:
        return _named(kinds + own, _NAMES | _OUTER), False
    if name in _BOXES and (_named(kinds + own, _SAID) or not headed and _named(kinds + own, _TALK)):
        return True, False
    # an id inside an article is what its links jump to
    return _named(kinds, _NAMES - _WORDS), _named(kinds + own, _NAMES)


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order; kind 0: article, 1: open, 2: furniture."""
    found: list[tuple[str, bool, bool, bool, bool, float]] = []  # text, furniture, article, main, plain, linked share
    # open elements: name, furniture, article, main, plain, named like furniture, within a line's furniture
    stack: list[tuple[str, bool, bool, bool, bool, bool, bool]] = [("", False, False, False, False, False, False)]
    text: list[str] = []
    linked = [0, 0]
    links = 0

    def end():
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            _, furniture, article, main, plain, named, _ = stack[-1]
            found.append((whole, furniture, article, main, plain and not named, linked[1] / max(linked[0], 1)))
        text.clear()
        linked[:] = [0, 0]

    def add(piece: str):
        if stack[-1][6]:
            return
        text.append(piece)
        n = len(piece.strip())
        linked[0] += n
        linked[1] += n * (links > 0)

    def close(name: str, within: frozenset = frozenset()):
        nonlocal links
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                if name not in _INLINE or any(x[0] not in _INLINE for x in stack[i + 1 :]):
                    end()
                links -= sum(x[0] == "a" for x in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1]:
            to = page.find("-->", at)
            at = len(page) if to < 0 else to + 3
            continue
        if m[2]:
            to = page.find(">", at)
            at = len(page) if to < 0 else to + 1
            continue
        closing, name, rest = (m[3], m[4].lower(), m[5]) if m[4] else (m[6], m[7].lower(), "")
        if closing:
            if name == "p" or name not in _INLINE:
                end()
            close(name)
            continue
        if name in _RAW:
            if not rest.endswith("/"):
                to = re.compile(f"</{name}\\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = to.end() if to else len(page)
            add(" ")
            continue
        if name == "br":
            add(" ")
            continue
        if name in _VOID:
            if name == "hr":
                end()
            continue
        inline = name in _INLINE
        if not inline:
            end()
            holders = frozenset(("div", "article", "section", "main", "body", "nav", "aside", "footer", "header", "form", "table", "ul", "ol"))
            close("p", holders)
            if name == "li":
                close("li", frozenset(("ul", "ol", "menu")))
            elif name in ("td", "th"):
                close("td", frozenset(("tr", "table")))
                close("th", frozenset(("tr", "table")))
            elif name == "tr":
                close("tr", frozenset(("table",)))
            elif name in ("dt", "dd"):
                close("dt", frozenset(("dl",)))
                close("dd", frozenset(("dl",)))
            elif name == "body":
                while len(stack) > 1 and any(x[0] == "head" for x in stack):
                    close("head")
        if rest.endswith("/"):
            continue
        _, furniture, article, main, plain, named, muted = stack[-1]
        attributes = _attributes(rest) if rest.strip() else {}
        surely, maybe = _is_furniture(name, attributes, article or main, _HEADING.match(page, at) is not None)
        # furniture within a line is left out of its block, which stays what it is
        muted = muted or inline and surely and not furniture
        furniture, named = furniture or surely and not inline, named or maybe
        article = article or name == "article" or attributes.get("role", "").lower() == "article" or attributes.get("itemprop", "").lower() == "articlebody"
        main = main or name == "main" or attributes.get("role", "").lower() == "main"
        stack.append((name, furniture, article, main, plain if inline else name in _PLAIN, named, muted))
        links += name == "a"
    # what follows the last tag; an opened tag without an end is markup
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!][^>]*$", rest)
    add(rest[: cut.start()] if cut else rest)
    end()
    inside = 2 if any(x[2] and not x[1] for x in found) else 3 if any(x[3] and not x[1] for x in found) else 0
    out = []
    for whole, furniture, article, main, plain, share in found:
        if furniture or inside and not (article, main)[inside - 2]:
            kind = 2
        elif share >= LINKED and not (inside and plain):
            kind = 2
        else:
            kind = 0 if inside and plain else 1
        out.append((kind, whole))
    return out


def _host(url: Column) -> Column:
    """The host name of a URL without www; empty where there is none."""
    name = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)", 1)
    return F.regexp_replace(name, r"^www\.", "")


def _names(words: np.ndarray, many: int) -> np.ndarray:
    """Names of the `many` (a power of two) tokens from each place on, by prefix doubling."""
    name, k = words, 1
    while k < many:
        after = np.concatenate([name[k:], np.zeros(min(k, len(name)), np.uint64)])
        name, k = mix(name * np.uint64(0x9E3779B97F4A7C15) + mix(after)), 2 * k
    return name


def _contents(words: np.ndarray, left: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for the words from each start on that near copies share: they have the
    same two least names of four tokens; pages of shorter blocks those of a word."""
    four = np.where(left >= 4, _names(words, 4), mix(words) | np.uint64(1 << 63))
    return mix(np.minimum.reduceat(four, starts) * np.uint64(31) + np.minimum.reduceat(mix(four ^ np.uint64(0x5BD1E995)), starts))


class Runs:
    """The suffixes of LONG tokens and the short blocks of pages, named by their text and host.

    `texts` are the pages' blocks, `kinds` those of all blocks in a row, `host` numbers of
    the pages' hosts. A name's last bit tells a short block."""

    def __init__(self, texts: pa.ListArray, kinds: np.ndarray, host: np.ndarray):
        self.sizes = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = texts.flatten()
        self.blocks = flat.to_pylist()
        self.words = words = Words(flat)
        many = np.diff(words.bounds)
        page_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.block = np.repeat(np.arange(len(self.blocks)), many)
        page = page_of[self.block]
        self.left = words.bounds[1:][self.block] - np.arange(len(self.block))
        #: pages with words, and where these begin
        self.filled = np.flatnonzero(np.bincount(page, minlength=len(self.sizes)))
        self.begin = np.searchsorted(page, self.filled)
        salt = mix(host.astype(np.uint64) + np.uint64(0xA5A5))
        self.at = np.flatnonzero(self.left >= LONG)
        self.short = np.flatnonzero((many < LONG) & (many > 0))
        name = _names(words.hash, LONG)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        place = np.arange(len(self.block)) - words.bounds[:-1][self.block]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hash + place.astype(np.uint64)), dtype=np.uint64)])
        whole = (sums[words.bounds[1:]] - sums[words.bounds[:-1]])[self.short]
        self.page = np.concatenate([page[self.at], page_of[self.short]])
        self.name = mix(np.concatenate([name, whole]) ^ salt[self.page]) >> np.uint64(1) << np.uint64(1)
        self.name[len(self.at) :] |= np.uint64(1)
        self.in_article = kinds[self.block[self.at]] == 0
        self.share = np.concatenate([np.where(self.in_article, IN_ARTICLE, ELSEWHERE), np.full(len(self.short), SHORT)])

    def contents(self) -> np.ndarray:
        """Numbers of the filled pages' contents."""
        return _contents(self.words.hash, self.left, self.begin) if len(self.filled) else np.zeros(0, np.uint64)

    def cut(self, common: np.ndarray) -> list[str]:
        """The text of each page without the runs that are boilerplate."""
        blocks, bounds = list(self.blocks), self.words.bounds
        starts = self.at[common[: len(self.at)]]
        step = np.zeros(len(self.block) + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + LONG, -1)
        gone = np.cumsum(step)[:-1] > 0
        for b in np.flatnonzero(np.bincount(self.block[gone], minlength=len(blocks))):
            keep = ~gone[bounds[b] : bounds[b + 1]]
            # a block's tokens are its words between single spaces; what else is white space to Unicode stays inside a token
            blocks[b] = " ".join(w for w, k in zip(blocks[b].split(" "), keep, strict=True) if k)
        for b in self.short[common[len(self.at) :]]:
            blocks[b] = ""
        return _joined(blocks, self.sizes)


def _joined(blocks: list[str], sizes: np.ndarray) -> list[str]:
    return ["\n".join(t for t in blocks[e - n : e] if t) for e, n in zip(np.cumsum(sizes), sizes, strict=True)]


def _steps(*keys: np.ndarray) -> list[np.ndarray]:
    """For rows sorted by keys: where each key, or one before it, is new."""
    out, new = [], np.arange(len(keys[0])) == 0
    for k in keys:
        new = new.copy()
        new[1:] |= k[1:] != k[:-1]
        out.append(new)
    return out


def _tally(name: np.ndarray, content: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each name with each of its contents, and on how many of the content's pages it is."""
    order = np.lexsort((page, content, name))
    n, c, p = name[order], content[order], page[order]
    _, first, pages = _steps(n, c, p)
    at = np.flatnonzero(first)
    return n[at], c[at], np.add.reduceat(pages, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)


def _by_name(name: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of a sorted tally, their contents and their pages."""
    at = np.flatnonzero(_steps(name)[0])
    return name[at], np.diff(np.append(at, len(name))), np.add.reduceat(pages, at) if len(at) else pages


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each value is among `some`, which are sorted."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def clean(texts: pa.ListArray, kinds: np.ndarray, group: np.ndarray) -> list[str]:
    """The text of each page without its group's boilerplate, for groups that lie here whole:
    `texts` are the pages' blocks, `kinds` those of all blocks in a row, `group` numbers of the pages' groups."""
    runs = Runs(texts, kinds, group)
    content, filled = np.zeros(len(group), np.uint64), runs.filled
    content[filled] = runs.contents()
    total = np.bincount(np.unique(np.stack([group[filled].astype(np.uint64), content[filled]]), axis=1)[0].astype(np.int64), minlength=int(group.max(initial=0)) + 1)
    n, _, p = _tally(runs.name, content[runs.page], runs.page)
    name, contents, pages = _by_name(n, p)
    at = np.searchsorted(name, runs.name)
    common = (contents >= CONTENTS) & (contents >= pages * SHARE)
    return runs.cut(common[at] & (contents[at] >= total[group[runs.page]] * runs.share) if len(at) else np.zeros(0, bool))


#: Columns of the dealt pages.
_PAGES = ["page_id", "url", "host", "parts", "part", "content", "away", "dealt", "kinds", "texts"]


def _pieces(batches):
    """Tables of whole parts, or pieces of a part of more than FULL bytes, and the contents that go on from the
    piece before (None: none do) and beyond this one."""
    held, size, before = [], 0, None

    def piece(table, more):
        nonlocal before
        last = tuple(table.column(c)[len(table) - 1].as_py() for c in ("host", "part", "content"))
        first = tuple(table.column(c)[0].as_py() for c in ("host", "part", "content"))
        on = before[2] if before is not None and before == first else None
        before = last if more else None
        return table, on, last[2] if more else None

    for batch in batches:
        for some in slices(batch.append_column("bytes", pc.binary_join(batch.column("texts"), " ")), "bytes"):
            held.append(pa.Table.from_batches([some.drop_columns(["bytes"])]))
            size += sum(pc.fill_null(pc.binary_length(some.column("bytes")), 0).to_pylist())
            if size < TEXT:
                continue
            table = pa.concat_tables(held)
            host, part = table.column("host").to_numpy(), table.column("part").to_numpy()
            # the last part may go on in what follows
            last = int(np.flatnonzero((host != host[-1]) | (part != part[-1])).max(initial=-1)) + 1
            more = size >= FULL
            if more:
                last = len(table)
            if last:
                yield piece(table.slice(0, last), more)
                held = [table.slice(last)] if last < len(table) else []
                size = sum(x.nbytes for x in held)
    if held:
        yield piece(pa.concat_tables(held), False)


def _runs(table: pa.Table) -> Runs:
    kinds = np.frombuffer(b"".join(table.column("kinds").to_pylist()), np.uint8)
    return Runs(table.column("texts").combine_chunks(), kinds, table.column("host").to_numpy())


def _at_home(table: pa.Table, on) -> tuple[np.ndarray, np.ndarray]:
    """Hosts of the table and how many contents have their part, or its first piece, here."""
    host, content = table.column("host").to_numpy(), table.column("content").to_numpy()
    home = ~table.column("away").to_numpy(zero_copy_only=False)
    if on is not None:
        home &= content != on
    hosts, index = np.unique(host, return_inverse=True)
    return hosts, np.bincount(np.unique(np.stack([index[home], content[home]]), axis=1)[0], minlength=len(hosts))


def _candidates(batches):
    """Names on enough of a piece's contents that they may be boilerplate of the host, and contents that lie in several pieces."""
    for table, on, beyond in _pieces(batches):
        runs, (hosts, own) = _runs(table), _at_home(table, on)
        content, index = table.column("content").to_numpy(), np.searchsorted(hosts, table.column("host").to_numpy())
        parts = np.zeros(len(hosts), np.int64)
        parts[index] = table.column("parts").to_numpy()
        n, _, p = _tally(runs.name, content[runs.page], runs.page)
        name, contents, _ = _by_name(n, p)
        # what share of a host's contents has a run, that share of a piece's own has it at least somewhere
        likely = contents[np.searchsorted(name, runs.name)] >= own[index[runs.page]] * runs.share - 1e-6 if len(name) else np.zeros(0, bool)
        found, first = np.unique(runs.name[likely], return_index=True)
        of = index[runs.page[likely][first]]
        many = table.column("away").to_numpy(zero_copy_only=False) & (content != 0)
        many |= np.isin(content, [c for c in (on, beyond) if c])
        spread, first = np.unique(content[many], return_index=True)
        to = index[many][first]
        none = [None]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hosts[np.concatenate([of, to])], pa.int64()),
                pa.array(parts[np.concatenate([of, to])], pa.int32()),
                pa.concat_arrays([pa.array(found.view(np.int64)), pa.array(none * len(spread), pa.int64())]),
                pa.concat_arrays([pa.array(none * len(found), pa.int64()), pa.array(spread, pa.int64())]),
            ],
            names=["host", "parts", "name", "content"],
        )


def _brought(table: pa.Table, column: str, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that the parts' first rows bring, sorted, and the last part's; `before` are the last part's of the piece before."""
    got = [np.asarray(x, np.int64) for x in table.column(column).to_pylist() if x is not None]
    first = table.column("lead").to_pylist()
    last = np.flatnonzero(first)
    last = before if not len(last) else np.asarray(table.column(column)[int(last[-1])].as_py() or [], np.int64)
    return np.unique(np.concatenate([*got, *([] if first[0] else [before]), np.zeros(0, np.int64)])), last


def _counts(batches):
    """Contents and pages of the candidates; contents that lie in several pieces by themselves, and each host's contents under no name."""
    names = spread = np.zeros(0, np.int64)
    for table, on, beyond in _pieces(batches):
        known, names = _brought(table, "names", names)
        several, spread = _brought(table, "spread", spread)
        hosts, own = _at_home(table, on)
        host, content = table.column("host").to_numpy(), table.column("content").to_numpy()
        index = np.searchsorted(hosts, host)
        parts = np.zeros(len(hosts), np.int64)
        parts[index] = table.column("parts").to_numpy()
        rows = [(np.arange(len(hosts)), None, None, own, np.zeros(len(hosts), np.int64))]
        if len(known):
            runs = _runs(table)
            found = np.flatnonzero(_among(runs.name.view(np.int64), known))
            name, page = runs.name[found].view(np.int64), runs.page[found]
            one, first = np.unique(name, return_index=True)
            of = index[page[first]]
            n, c, p = _tally(name, content[page], page)
            alone = _among(c, several) | np.isin(c, [x for x in (on, beyond) if x])
            rows.append((of[np.searchsorted(one, n[alone])], n[alone], c[alone], np.ones(alone.sum(), np.int64), p[alone]))
            n, contents, pages = _by_name(n[~alone], p[~alone])
            rows.append((of[np.searchsorted(one, n)], n, None, contents, pages))
        for at, n, c, contents, pages in rows:
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts[at], pa.int64()), pa.array(parts[at], pa.int32()), none if n is None else pa.array(n), none if c is None else pa.array(c), pa.array(contents, pa.int64()), pa.array(pages, pa.int64())],
                names=["host", "parts", "name", "content", "contents", "pages"],
            )


def _without(batches):
    """The pages' texts without what is boilerplate."""
    names = strong = np.zeros(0, np.int64)
    for table, _, _ in _pieces(batches):
        known, names = _brought(table, "names", names)
        everywhere, strong = _brought(table, "strong", strong)
        if len(known):
            runs = _runs(table)
            name = runs.name.view(np.int64)
            common = _among(name, known)
            common[: len(runs.at)] &= ~runs.in_article | _among(name[: len(runs.at)], everywhere)
            text = runs.cut(common)
        else:
            texts = table.column("texts").combine_chunks()
            text = _joined(texts.flatten().to_pylist(), texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        ids = table.select(["page_id", "url"]).combine_chunks()
        yield pa.RecordBatch.from_arrays([ids.column("page_id").combine_chunks(), ids.column("url").combine_chunks(), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    References are decoded, white space inside a block becomes one space, blocks
    are joined by a line feed in the page's order. A null or empty html gives an
    empty text. Pages whose url is null or names no host are one host together.
    Rows that share a page_id are rows of their own. Pages with the same contents
    do not make each other's text boilerplate. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    named = rows.withColumn("host", F.xxhash64(_host(F.col("url"))))
    # reads the urls only; of all hosts, no more than LARGE_HOSTS can have over `part` pages
    part = max(PAGES, pages.count() // LARGE_HOSTS)
    large = named.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > part).select("host", F.ceil(F.col("n") / part).alias("parts"))
    dealt = F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(1 << 30))

    def parse(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for some in slices(batch, "html"):
                made = [[x for x in blocks(h or "") if x[0] < 2] for h in some.column("html").to_pylist()]
                kinds, texts = [bytes(k for k, _ in m) for m in made], pa.array([[t for _, t in m] for m in made], pa.list_(pa.string()))
                host = some.column("host").to_numpy()
                words = Words(texts.flatten())
                content, away = np.zeros(len(host), np.int64), np.ones(len(host), bool)
                if len(words.hash):
                    many = np.diff(words.bounds)
                    block = np.repeat(np.arange(len(many)), many)
                    page = np.repeat(np.arange(len(made)), [len(m) for m in made])[block]
                    filled = np.flatnonzero(np.bincount(page, minlength=len(made)))
                    number = _contents(words.hash, words.bounds[1:][block] - np.arange(len(block)), np.searchsorted(page, filled))
                    # 0 is no content
                    content[filled] = (mix(number ^ mix(host[filled].view(np.uint64))) | np.uint64(1)).view(np.int64)
                    if len(seen) > 1 << 20:
                        seen.clear()
                    for i in filled.tolist():
                        c = int(content[i])
                        seen[c] = n = seen.get(c, 0) + 1
                        away[i] = n > TOGETHER
                kept = [some.column(c) for c in ("page_id", "url", "host", "dealt")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(content), pa.array(away), pa.array(kinds, pa.binary()), texts], names=["page_id", "url", "host", "dealt", "content", "away", "kinds", "texts"])

    parsed = named.withColumn("dealt", dealt).select("page_id", "url", "host", "dealt", "html").mapInArrow(parse, "page_id long, url string, host long, dealt long, content long, away boolean, kinds binary, texts array<string>")
    parts = F.coalesce("parts", F.lit(1)).cast("int")
    parted = parsed.join(F.broadcast(large), "host", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.when(F.col("away"), F.col("dealt")).otherwise(F.xxhash64("content")), F.col("parts")).cast("int"))
    by_host = parted.select(*_PAGES).repartition("host", "part").sortWithinPartitions("host", "part", "content", "dealt", "page_id")

    def beside(sets: DataFrame) -> DataFrame:
        """The parts, sorted, each with its host's row of `sets` beside its first page."""
        every = sets.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumnRenamed("host", "of_host").drop("parts")
        first = F.row_number().over(Window.partitionBy("host", "part").orderBy("content", "dealt", "page_id")) == 1
        here = (F.col("host") == F.col("of_host")) & (F.col("part") == F.col("of_part")) & F.col("lead")
        return by_host.withColumn("lead", first).join(every, here, "left").drop("of_host", "of_part").sortWithinPartitions("host", "part", "content", "dealt", F.desc("lead"), "page_id")

    likely = by_host.mapInArrow(_candidates, "host long, parts int, name long, content long")
    likely = likely.groupBy("host", "parts").agg(F.collect_set("name").alias("names"), F.collect_set("content").alias("spread"))
    counted = beside(likely).mapInArrow(_counts, "host long, parts int, name long, content long, contents long, pages long")
    counted = counted.groupBy("host", "parts", "name", "content").agg(F.sum("contents").alias("contents"), F.sum("pages").alias("pages"))
    one = F.when(F.col("content").isNull(), F.col("contents")).otherwise(1)
    counted = counted.groupBy("host", "parts", "name").agg(F.sum(one).alias("contents"), F.sum("pages").alias("pages"))
    some = (F.col("contents") >= CONTENTS) & (F.col("contents") >= F.col("pages") * F.lit(SHARE))
    found = F.collect_list(F.when(F.col("name").isNotNull() & some, F.struct("name", "contents")))
    hosts = counted.groupBy("host", "parts").agg(F.sum(F.when(F.col("name").isNull(), F.col("contents"))).alias("total"), found.alias("found"))

    def names(share):
        return F.transform(F.filter("found", lambda x: x["contents"] >= F.col("total") * share(x["name"])), lambda x: x["name"])

    short = lambda name: name.bitwiseAND(F.lit(1)) == 1
    least = names(lambda name: F.when(short(name), F.lit(SHORT)).otherwise(F.lit(ELSEWHERE)))
    common = hosts.select("host", "parts", least.alias("names"), names(lambda name: F.lit(IN_ARTICLE)).alias("strong"))
    return beside(common).mapInArrow(_without, "page_id long, url string, text string, n_chars long")
