"""Main text of web pages by consensus of the pages of a host.

Pass one scores the containers of each page: the balance of how much of the page's plain text a container holds and how
little else (menus, adverts, forms, link lists) stands in it. Every container votes with its score for its generalised path
(tags with classes, digits and generated names blanked); Spark adds up the votes by host and path, combined before the
shuffle. The same pass notes what elements beside the page's best container say, so that the pages of a host also decide on
boilerplate: a path that says the same again and again beside different articles (a third as many texts as articles, or
fewer) is dropped, whatever its size.
Pass two takes from every page the containers at its host's winning path, or the page's own best one where it has none
there, and drops what doesn't belong to the article.

The html itself is not shuffled: decisions of hosts that differ from the commonest are sent along if they take up to
``SENT_BYTES``; beyond that the pages are joined to them by host. Pages are parsed in one pass whose work is linear in
their length: each element keeps where it begins and ends, sums and hashes are differences of running ones, and a path
is a hash made from its parent's.

Names are weak evidence. All words of a class or id must be words of asides or of layout (``promo-box``, not
``product-promotion-history``) for its element to be left out; a name with only some such words makes its element count less when
containers are scored, nothing more. <main> stands for itself in any aside that isn't hidden, <article> in one that is so by
its name, unless that is a name of reader comments.

Text: character references decoded; each block's white space to one space, ends trimmed; blocks joined by one space.
<br> ends a block. Defined cases: null html is empty and has no text; a null url is the host ''; pages without any container
give the text of the whole page by the same rules; unclosed tags end where an enclosing one does; a page without <article> or <main>
keeps elements named as asides where the rest is under a tenth of its text (``Page.settled``), on hosts of any size; repeated
rows are reported each.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.rows import packed, unpacked
from talkloom.sources.scratch import cut

SENT_BYTES = 8 << 20

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea)(?=[\s/>])(?:/>|[^>]*+(?:(?<=[\s\"']/)>|>.*?(?:</(?P=raw)\s*>|\Z)))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)>",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s\"'>/=]+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
#: Classes that tell what a wrapper has beside its text.
STATE = re.compile(r"(?:with|has|no|without|is)[-_].*", re.I | re.S)
GENERATED = re.compile(r"(?=.*[0-9])[0-9a-fA-F_-]{5,}|[A-Za-z]*[-_]+[A-Za-z0-9]*[0-9][A-Za-z0-9]{3,}")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = frozenset("html body main article section div td center".split())
#: What a start tag closes, if open, up to the nearest of the second set.
CLOSES = {
    "p": ({"p"}, {"div", "td", "li", "article", "section", "blockquote", "body"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"body"}), "body": ({"head"}, {"html"}),
}
CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
FOREIGN = frozenset("svg math".split())
ASIDE_TAGS = frozenset("nav footer aside button dialog menu head svg math object canvas select".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer foot share sharing social related recommended recommendations widget login signup "
    "signin search searchbox pagination pager toolbar copyright masthead topbar banner skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist commentary disqus discussion reply replies respond".split())
HEAD_WORDS = frozenset("header head".split())
LAYOUT_WORDS = frozenset(
    "box wrap wrapper container list block area section item items bar inner outer top bottom left right center post posts page site content article story reader readers user users link links button buttons "
    "icon icons form unit slot text body title global primary secondary main group grid row col column panel row thread count nav list ul li div id the my app web sticky fixed mobile desktop small large".split()
)
NEVER_ASIDE = frozenset("html body main article".split())
UNNOTED = frozenset("html body main article".split())

#: How far an element is set aside: not at all, by some word of a name, by a name or a form, as comments, by its tag or role, hidden.
PLAIN, HINTED, NAMED, COMMENTS, TAGGED, HIDDEN = range(6)
PRIME, STEP = (1 << 61) - 1, 1_000_003


def _attributes(attrs: str) -> dict:
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return {}
    out: dict = {}
    for m in ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _generalised(tag: str, classes: str) -> str:
    return ".".join([tag, *sorted({re.sub(r"[0-9]+", "#", c.lower()) for c in classes.split() if not GENERATED.fullmatch(c)})])


def _by_name(names: str, in_article: bool) -> int:
    level = PLAIN
    for name in names.split():
        if STATE.fullmatch(name):
            continue
        words = {w.lower() for w in WORD.findall(name) if not w.isdigit()}
        told = ASIDE_WORDS if in_article else ASIDE_WORDS | HEAD_WORDS
        if words & COMMENT_WORDS and words <= COMMENT_WORDS | told | LAYOUT_WORDS:
            return COMMENTS
        if words & (told | COMMENT_WORDS):
            level = max(level, NAMED if words <= told | LAYOUT_WORDS else HINTED)
    return level


def _level(tag: str, a: dict, in_article: bool) -> int:
    if tag in NEVER_ASIDE:
        return COMMENTS if tag == "article" and a and _by_name(a.get("class", ""), True) == COMMENTS else PLAIN
    if a:
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "style" in a and "display:none" in a["style"].replace(" ", "").lower():
            return HIDDEN
        if a.get("role", "").lower() in ASIDE_ROLES:
            return TAGGED
    if tag in ASIDE_TAGS or tag == "header" and not in_article:
        return TAGGED
    named = _by_name(f"{a.get('class', '')} {a.get('id', '')}", in_article) if "class" in a or "id" in a else PLAIN
    return max(named, NAMED) if tag == "form" else named


def _path(above: str, label: str) -> str:
    return blake2b(f"{above}/{label}".encode("utf-8", "surrogatepass"), digest_size=10).hexdigest()


class Page:
    """Elements of a page in order (0 is the page itself), in parallel lists, and its pieces of text.

    ``start`` and ``end`` of an element are places in ``pieces``: (text, starts a block, innermost element, size).
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.level, self.path, self.depth = [""], [-1], [PLAIN], [""], [0]
        self.container, self.link, self.start, self.end = [True], [False], [0], [0]
        self.pieces: list[tuple[str, bool, int, int]] = []
        self.articles = False
        self._parse(page)

    def _parse(self, page: str) -> None:
        tags, parent, level, path, depth, container, link, start, end, pieces = self.tag, self.parent, self.level, self.path, self.depth, self.container, self.link, self.start, self.end, self.pieces
        stack, within = [0], [False]
        #: Path of the nearest container, whether in an article and whether in foreign markup, by element.
        near, foreign = [""], [False]
        open_at: dict[str, list[int]] = {}
        at, fresh = 0, True

        def text(raw: str) -> None:
            nonlocal fresh
            if "&" in raw:
                raw = html_lib.unescape(raw)
            if raw:
                words = raw.split()
                pieces.append((raw, fresh, stack[-1], sum(map(len, words)) + len(words) - 1 if words else 0))
                fresh = False

        def pop(to: int) -> None:
            while len(stack) > to:
                e = stack.pop()
                end[e] = len(pieces)
                open_at[tags[e]].pop()

        def nearest(names) -> int:
            return max((open_at[t][-1] for t in names if open_at.get(t)), default=0)

        # nothing after the last > is a tag
        last = page.rfind(">") + 1
        for m in MARKUP.finditer(page, 0, last):
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                fresh = True
            if m["end"] or m["end2"]:
                if open_at.get(tag):
                    pop(open_at[tag][-1])
                continue
            if tag in VOID:
                continue
            ends, until = ({"p"}, CLOSES["p"][1]) if tag in CLOSE_P else CLOSES.get(tag, (None, None))
            if ends:
                i = nearest(ends)
                if i and i > nearest(until):
                    pop(i)
            attrs = m["attrs"] or m["attrs2"] or ""
            up = stack[-1]
            if attrs.endswith("/") and (tag in FOREIGN or foreign[up]):
                continue
            a = _attributes(attrs)
            inside = within[up] or tag in ("article", "main")
            self.articles = self.articles or tag in ("article", "main")
            e = len(tags)
            own = _level(tag, a, inside)
            held = tag in CONTAINER
            tags.append(tag)
            parent.append(up)
            level.append(own)
            container.append(held)
            link.append(link[up] or tag == "a")
            within.append(inside)
            foreign.append(foreign[up] or tag in FOREIGN)
            here = _path(near[up], _generalised(tag, a.get("class", ""))) if held or PLAIN < own < TAGGED else ""
            path.append(here)
            near.append(here if held else near[up])
            depth.append(depth[up] + 1)
            start.append(len(pieces))
            end.append(0)
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(e)
        if at < len(page):
            text(page[at:])
        pop(1)
        end[0] = len(pieces)

    def states(self, drop=frozenset(), spared=frozenset(), dropped: int = NAMED) -> list[int]:
        """How far each element is set aside, by itself or by what it stands in; paths to ``drop``, and elements to spare."""
        out = [PLAIN]
        for e in range(1, len(self.tag)):
            own, up, path = self.level[e], out[self.parent[e]], self.path[e]
            if path and own < TAGGED:
                if e in spared:
                    own = PLAIN
                elif path in drop:
                    own = dropped
            if self.tag[e] == "main" and up < HIDDEN or self.tag[e] == "article" and up <= NAMED:
                up = PLAIN
            out.append(max(own, up))
        return out

    def running(self, states: list[int], most: int) -> list[int]:
        """Size of the pieces before each place that stand in no link and in elements set aside no further than ``most``."""
        out = [0]
        for _, _, e, size in self.pieces:
            out.append(out[-1] + (size if states[e] <= most and not self.link[e] else 0))
        return out

    def sizes(self, states: list[int], most: int = HIDDEN) -> list[int]:
        out = [0]
        for _, _, e, size in self.pieces:
            out.append(out[-1] + (size if states[e] <= most else 0))
        return out

    def scored(self, states: list[int]) -> list[tuple[int, int, int]]:
        """(score to 1000, depth, element) of containers that aren't aside, best first, deeper ones before their parents at a tie."""
        good = self.running(states, PLAIN)
        if not good[-1]:
            good = self.running(states, HINTED)
        if not good[-1]:
            good = self.sizes(states, HINTED)
        total, every, out = good[-1], self.sizes(states), []
        for e in range(1, len(self.tag)):
            if self.container[e] and states[e] <= HINTED:
                held = good[self.end[e]] - good[self.start[e]]
                if held:
                    p, r = held / (every[self.end[e]] - every[self.start[e]]), held / total
                    out.append((int(2000 * p * r / (p + r)), self.depth[e], e))
        return sorted(out, key=lambda x: (-x[0], -x[1], x[2]))

    def settled(self, drop=frozenset()) -> list[int]:
        """``states`` by the paths that the host drops. Elements named as asides count after all where next to nothing else does: if
        the rest is under a tenth of the text that isn't aside by tag, role or host, those that hold half of it are spared, adverts
        and the like before comments, and at last every named one."""
        states = self.states(drop)
        named = [e for e in range(1, len(self.tag)) if NAMED <= self.level[e] <= COMMENTS and self.path[e] not in drop]
        if not named or self.articles:
            return states
        free, rest = self.sizes(self.states(drop, dropped=TAGGED), COMMENTS), self.sizes(states, HINTED)[-1]
        if 10 * rest >= free[-1]:
            return states
        most = [e for e in named if 2 * (free[self.end[e]] - free[self.start[e]]) >= free[-1]]
        for spared in ([e for e in most if self.level[e] == NAMED], most, named):
            found = self.states(drop, frozenset(spared))
            if self.sizes(found, HINTED)[-1] > rest:
                return found
        return states

    def text_hashes(self) -> tuple[list[int], list[int]]:
        """Running hash and number of the pieces that aren't blank."""
        h, n = [0], [0]
        for raw, _, _, size in self.pieces:
            if size:
                h.append((h[-1] * STEP + zlib.crc32(" ".join(raw.split()).encode("utf-8", "surrogatepass")) + 1) % PRIME)
                n.append(n[-1] + 1)
            else:
                h.append(h[-1])
                n.append(n[-1])
        return h, n

    def text_of(self, states: list[int], chosen: list[int]) -> str:
        """The text of ``chosen`` elements (in page order, none within another) without what is aside."""
        blocks: list[list[str]] = []
        for c in chosen:
            new = True
            for raw, fresh, e, _ in self.pieces[self.start[c] : self.end[c]]:
                new = new or fresh
                if states[e] > HINTED:
                    continue
                if new:
                    blocks.append([])
                    new = False
                blocks[-1].append(raw)
        joined = (" ".join("".join(b).split()) for b in blocks)
        return " ".join(b for b in joined if b)


def extract(page, winner: str | None, drop=frozenset()) -> str:
    """Main text of a page, at the path ``winner`` if it has that, without the paths that its host drops."""
    p = Page(page if isinstance(page, str) else "")
    states = p.settled(drop)
    chosen, until = [], -1
    if winner is not None:
        held = p.sizes(states, HINTED)
        for e in range(1, len(p.tag)):
            if p.container[e] and p.path[e] == winner and states[e] <= HINTED and p.start[e] >= until and held[p.end[e]] > held[p.start[e]]:
                chosen.append(e)
                until = p.end[e]
    if not chosen:
        best = p.scored(states)
        chosen = [best[0][2]] if best else [0]
    return p.text_of(states, chosen)


def host_of(url) -> str:
    m = HOST.match(url) if isinstance(url, str) else None
    return m[1].lower() if m else ""


def _notes(p: Page, states: list[int], best: int):
    """(path, hash of its text, of the article's text) of what pages decide on: all that has text but the article and what holds it."""
    h, n = p.text_hashes()
    free = p.sizes(states, COMMENTS)

    def hashed(e: int) -> int:
        a, b = p.start[e], p.end[e]
        return (h[b] - h[a] * pow(STEP, n[b] - n[a], PRIME)) % PRIME

    article, above, up = hashed(best), set(), best
    while up > 0:
        above.add(up)
        up = p.parent[up]
    for e in range(1, len(p.tag)):
        if p.path[e] and free[p.end[e]] > free[p.start[e]] and p.tag[e] not in UNNOTED and states[e] < TAGGED and e not in above:
            yield p.path[e], hashed(e), article


VOTES = "host string, path string, note boolean, depth long, score long, said long, article long"


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Votes for containers, and notes of what elements say, the same ones of a batch as one."""
    for batch in batches:
        votes: Counter = Counter()
        notes: set = set()
        for url, page in zip(batch["url"], batch["html"], strict=True):
            p = Page(page if isinstance(page, str) else "")
            states, host = p.settled(), host_of(url)
            ranked = p.scored(states)
            for score, depth, e in ranked:
                votes[host, p.path[e], depth] += score
            notes |= {(host, *note) for note in _notes(p, states, ranked[0][2] if ranked else 0)}
        rows = [(h, p, False, d, v, 0, 0) for (h, p, d), v in votes.items()] + [(h, p, True, 0, 0, said, art) for h, p, said, art in notes]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in VOTES.split(", ")])


def decisions(pages: DataFrame) -> DataFrame:
    """(host, path, drop): the path with most votes of each host, the deeper and then the first by name at a tie; and the paths that are
    boilerplate: beside three or more different articles they say a third as many texts or fewer."""
    rows = cut(pages.select("url", "html").mapInPandas(_votes, VOTES), "pagetext-votes")
    votes = rows.where("NOT note").groupBy("host", "path").agg(F.sum("score").alias("score"), F.max("depth").alias("depth"))
    winners = votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), -F.col("depth"), F.col("path"))).alias("path"))
    # each text and article of a path once; counted in two steps, so that no path is counted in one task
    once = rows.where("note").select("host", "path", "said", "article").distinct()
    texts = once.select("host", "path", "said").distinct().groupBy("host", "path").agg(F.count("*").alias("texts"))
    beside = once.select("host", "path", "article").distinct().groupBy("host", "path").agg(F.count("*").alias("articles"))
    dropped = texts.join(beside, ["host", "path"]).where(3 * F.col("texts") <= F.col("articles"))
    sets = dropped.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("drop"))
    return winners.join(sets, "host", "left").select("host", "path", F.coalesce("drop", F.array().cast("array<string>")).alias("drop"))


def with_text(pages: DataFrame, into: str = "_text", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``pages`` with the main text."""
    spark = pages.sparkSession
    decided = cut(decisions(pages), "pagetext-decisions")
    same = ["path", "drop"]
    top = decided.groupBy(*same).count().orderBy(F.desc("count"), *same).first()
    common = tuple(top[c] for c in same) if top else (None, [])
    told = F.to_json(F.struct(*same))
    odd = decided.where(told != F.to_json(F.struct(F.lit(common[0]).alias("path"), F.array(*map(F.lit, common[1])).cast("array<string>").alias("drop"))))
    size = odd.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length(told) + 100), F.lit(0))).first()[0]
    if size <= sent_bytes:
        sent = spark.sparkContext.broadcast(((common[0], frozenset(common[1])), {r["host"]: (r["path"], frozenset(r["drop"])) for r in odd.collect()}))

        @F.pandas_udf("string")
        def take(urls: pd.Series, htmls: pd.Series) -> pd.Series:
            common, other = sent.value
            return pd.Series([extract(h, *other.get(host_of(u), common)) for u, h in zip(urls, htmls, strict=True)], dtype=object)

        rows = packed(pages, _url=F.col("url"), _html=F.col("html"))
        return unpacked(rows.withColumn("_text", take("_url", "_html")), pages, **{into: F.col("_text")})

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return pd.Series([host_of(u) for u in urls], dtype=object)

    @F.pandas_udf("string")
    def take_at(paths: pd.Series, drops: pd.Series, htmls: pd.Series) -> pd.Series:
        return pd.Series([extract(h, p, frozenset(d if d is not None else ())) for p, d, h in zip(paths, drops, htmls, strict=True)], dtype=object)

    named = decided.select(F.col("host").alias("_host"), *[F.col(c).alias(f"_{c}") for c in same])
    rows = packed(pages, _html=F.col("html"), _of=host(F.col("url")))
    joined = rows.join(named, F.col("_of") == F.col("_host"), "left").withColumn("_text", take_at("_path", "_drop", "_html"))
    return unpacked(joined, pages, **{into: F.col("_text")})


def op4(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    out = with_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
