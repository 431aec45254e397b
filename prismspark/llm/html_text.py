"""Main text of web pages by consensus host paths.

Every page's containers are scored by their text, less what stands in links; text of nested containers counts for the
article or main element around them, or else for the common container of most of the text. Each scored container votes
for its generalised tag-class path with its share of the page's score. Votes are summed per host in Spark, and pages are read again with
their host's winning path; a page without it falls back to its own best container. Boilerplate is left out before:
tags such as nav, hidden ones, and those with a whole class, id or role token of boilerplate, unless they hold the article.

Edge cases: null and empty html give an empty text; a null url's pages share the empty host; ties between a host's paths
go to the smaller path, between a page's own to the first; unclosed and misnested tags are closed by what follows; a page
is read in time and memory that follow its length, whatever its tags, quotes and depth; equal rows give equal texts; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, small_or_not

#: Hosts up to which the winning paths (a digest and one tag with its classes) are broadcast.
BROADCAST_HOSTS = 20_000
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What stands in a tag behind its name, with quoted values whole.
INSIDE_TAG = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+""")
#: A character reference of 20 digits and more, which the library does not read.
LONG_NUMBER = re.compile(r"&#(?=[0-9]{20})0*+([0-9]*+);?")
ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form button select menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("body div article section main td blockquote center".split())
CLOSED_BY: dict[str, frozenset] = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Tags whose id counts as a mark; those of headings, paragraphs and inline tags are names of places.
MARKED_BY_ID = frozenset("div section ul ol dl table td center".split())
#: Whole tokens of class, id or role that mark what is not the article: parts between hyphens or underscores are words
#: of boilerplate or, beside one, of place and form, so that no-sidebar, tag-news, post-header or related-work are none.
_WORDS = r"ads?|advert(?:s|isements?|ising)?|sponsor(?:s|ed)?|promo(?:s|tions?)?|banners?|cookies?|cookie(?:bar|banner|consent)|consent|gdpr|notices?|alerts?|popup|modal|overlay|side-?bars?|aside|nav(?:s|bar|igation)?|menus?|breadcrumbs?|header|masthead|footer|comments?|disqus|respond|repl(?:y|ies)|share|sharing|socials?|related|recommend(?:ed|ations?)|subscribe|subscription|newsletter|sign-?up|login|pager|pagination|widgets?|toolbar|search(?:bar|box|form)?|form|complementary|contentinfo|teasers?|tags?|skip-?links?"
_BESIDE = r"site|global|main|page|top|bottom|left|right|primary|secondary|list|box|block|area|container|wrapper|wrap|section|links?|bar|items?|slot|unit|inner|buttons?|icons?|posts|articles|stories|thread|\d+"
BOILERPLATE = re.compile(rf"(?i)(?!page[_-]header$)(?:(?:{_BESIDE})[_-]+)*(?:{_WORDS})(?:[_-]+(?:{_BESIDE}|{_WORDS}))*|(?:post|article|entry|user|reader)[_-]comments?(?:[_-]\w+)?")
#: Marks that are subjects inside an article: there they name what a part is about.
SUBJECTS = frozenset("header search form tag tags".split())
COMMENTS = re.compile(r"(?i)comment|disqus|respond|repl")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Mark:
    """A tag marked as boilerplate: where it is, the mark around it, and the text outside links and articles it holds."""

    place: int
    outer: int = 0
    container: bool = True
    comments: bool = False
    in_article: bool = False
    in_main: bool = False
    size: int = 0
    articles: int = 0
    mains: int = 0

    def holds_article(self, page: Mark) -> bool:
        """Whether it holds main, or all article elements there are and, if none or inside main, most of the text. Comments
        are often longer than what they follow, and each may be an article element: of these only main counts."""
        if self.mains or not self.container or self.comments or self.in_article or self.articles < page.articles:
            return self.mains > 0
        return 2 * self.size > page.size or (self.articles > 0 and not self.in_main)


def decoded(text: str) -> str:
    """text with its character references decoded; numbers that are no character give the replacement character."""
    if "&" not in text:
        return text
    return entities.unescape(LONG_NUMBER.sub(lambda m: f"&#{m[1] or 0};" if len(m[1]) < 8 else "\ufffd", text))


def boilerplate(name: str, attributes: dict[str, str], inside: bool) -> str:
    """The token of class, id or role that marks a tag as boilerplate, or an empty text. In an article, a header is its own,
    ids of sections name places and subjects are no marks."""
    kinds = ["class", "role"] + ["id"] * (name in MARKED_BY_ID and not (name == "section" and inside))
    for token in " ".join(attributes[k] for k in kinds if k in attributes).split():
        if BOILERPLATE.fullmatch(token) and not (inside and token.lower() in SUBJECTS):
            return token
    return ""


class Page:
    """Blocks of a page in order, each with the container that owns it, and the containers with their paths."""

    def __init__(self, source: str):
        if spared := self.begin(source, frozenset()):
            self.begin(source, spared)

    def begin(self, source: str, spared: frozenset[int]) -> frozenset[int]:
        self.blocks: list[tuple[str, int, int]] = []  # text, container, characters in links
        self.parts: list[str] = ["html"]  # tag and classes of each container
        self.paths: list[str] = ["html"]  # its part and a digest of all parts around it: equal for equal paths, short at any depth
        self.parents: list[int] = [-1]
        self.children: dict[int, list[int]] = {}
        self.headed: list[int] = []  # containers that own a heading
        return self.read(source, spared)

    def container(self, name: str, classes: str, parent: int) -> int:
        part = ".".join([name, *sorted({re.sub(r"\d+", "N", c.lower()) for c in classes.split()})])
        self.parts.append(part)
        self.paths.append(f"{hashlib.blake2b(self.paths[parent].encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}>{part}")
        self.parents.append(parent)
        self.children.setdefault(parent, []).append(len(self.paths) - 1)
        return len(self.paths) - 1

    def read(self, source: str, spared: frozenset[int]) -> frozenset[int]:
        """Blocks without boilerplate; the places of tags that are marked as such but hold the article, for a second reading.

        The page is read forward once: whatever is searched for and not there is not searched for again, and the open tags
        are known by name, so time and memory follow the page's length.
        """
        # Tag, container, dropped (0 no, -1 by tag or hidden, else its mark), whether in article, in main.
        stack: list[tuple[str, int, int, bool, bool]] = [("html", 0, 0, False, False)]
        depths: dict[str, list[int]] = {}  # of the open tags of a name
        blocks: list[int] = []  # depths of open blocks
        marked: list[Mark] = [Mark(-1)]  # the first stands for the page
        words: list[str] = []
        links = linked = 0
        last, quotes, unclosed = source.rfind(">"), True, set()

        def flush(container: int) -> None:
            nonlocal words, linked
            if words:
                if text := SPACE.sub(" ", "".join(words)).strip():
                    self.blocks.append((text, container, min(linked, len(text))))
                words, linked = [], 0

        def add(text: str) -> None:
            nonlocal linked
            dropped = stack[-1][2]
            if text and dropped >= 0 and not links:
                marked[dropped].size += len(text.strip())
            if text and not dropped:
                text = decoded(text)
                words.append(text)
                if links:
                    linked += len(text)

        def close(depth: int) -> None:
            while len(stack) > depth:
                tag = stack.pop()[0]
                depths[tag].pop()
                if tag in BLOCKS:
                    blocks.pop()

        at = since = 0  # where the search goes on, and where text that is not added yet begins
        while True:
            tag_at = source.find("<", at)
            if source.startswith("<!--", tag_at) and tag_at >= 0:
                add(source[since:tag_at])
                found = source.find("-->", tag_at + 4)
                at = since = found + 3 if found >= 0 else len(source)
                continue
            if tag_at < 0 or tag_at > last:
                if tag_at >= 0 and (comment := source.find("<!--", tag_at)) >= 0:
                    add(source[since:comment])
                else:
                    add(source[since:])
                break
            closing = source.startswith("/", tag_at + 1)
            named = NAME.match(source, tag_at + 1 + closing)
            if not named:
                at = tag_at + 1
                if source[at : at + 1] in ("!", "?"):
                    add(source[since:tag_at])
                    at = since = source.find(">", at) + 1
                continue
            end = INSIDE_TAG.match(source, named.end()).end() if quotes else -1
            if not source.startswith(">", end) or end < 0:
                # A quote that never closes: from here on tags end at the next bracket.
                quotes, end = False, source.find(">", named.end())
            add(source[since:tag_at])
            name, inner = named[0].lower(), source[named.end() : end]
            at = since = end + 1
            if closing:
                if name == "a":
                    links = max(0, links - 1)
                if name in BLOCKS:
                    flush(stack[-1][1])
                if (own := depths.get(name)) and (name in BLOCKS or not blocks or blocks[-1] < own[-1]):
                    close(own[-1])
                continue
            alone = inner.rstrip().endswith("/")
            if name in RAW:
                found = None
                if not alone and name not in unclosed:
                    found = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                    if not found:
                        unclosed.add(name)
                if found:
                    at = since = found.end()
                elif not alone and name != "svg":
                    at = since = len(source)
                continue
            if name == "br":
                add(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush(stack[-1][1])
                continue
            if name in BLOCKS:
                flush(stack[-1][1])
                links = 0
                if name == "body" and depths.get("head"):
                    close(depths["head"][0])
                for depth in reversed(blocks):
                    tag = stack[depth][0]
                    if name in CLOSED_BY.get(tag, ()):
                        close(depth)
                        break
                    if tag != "p":
                        break
            if name == "html":
                continue
            attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(inner)} if inner else {}
            _, container, dropped, in_article, in_main = stack[-1]
            inside = in_article or in_main
            if dropped >= 0:
                if (name in DROPPED and not (name == "header" and inside)) or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
                    dropped = -1
                elif name in ("article", "main"):
                    marked[dropped].articles += name == "article"
                    marked[dropped].mains += name == "main"
                elif name not in ("body", "html") and tag_at not in spared and (hit := boilerplate(name, attributes, inside)):
                    marked.append(Mark(tag_at, dropped, name in CONTAINERS or name == "table", bool(COMMENTS.search(hit)), in_article, in_main))
                    dropped = len(marked) - 1
            if name in CONTAINERS and not dropped:
                container = self.container(name, attributes.get("class", ""), container)
            if name in ("h1", "h2", "h3") and not dropped:
                self.headed.append(container)
            if name == "a":
                links += 1
            if alone and name not in BLOCKS:
                continue
            depths.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            stack.append((name, container, dropped, in_article or name == "article", in_main or name == "main"))
        flush(stack[-1][1])
        for mark in marked[:0:-1]:
            for field in ("size", "articles", "mains"):
                setattr(marked[mark.outer], field, getattr(marked[mark.outer], field) + getattr(mark, field))
        return frozenset(m.place for m in marked[1:] if m.holds_article(marked[0]))

    def targets(self) -> list[int]:
        """The container that each container's text counts for: the outermost article around it; without one the outermost
        main; else the common container of most text outside both, where that is around it; else itself."""
        out, kinds = list(range(len(self.parts))), [p.partition(".")[0] for p in self.parts]
        loose = [True] * len(out)
        for i, parent in enumerate(self.parents):
            above = out[parent] if parent >= 0 else i
            if parent >= 0 and not loose[parent] and (kinds[above] == "article" or kinds[i] != "article"):
                out[i], loose[i] = above, False
            elif kinds[i] in ("article", "main"):
                loose[i] = False
        common = set(self.common(loose))
        under = [-1] * len(out)
        for i, parent in enumerate(self.parents):
            under[i] = i if i in common else under[parent] if parent >= 0 else -1
            if under[i] >= 0 and loose[i]:
                out[i] = under[i]
        return out

    def common(self, loose: list[bool]) -> list[int]:
        """From the page down to the children of one path that hold most of the text, as long as what is around them owns
        no heading and next to no text."""
        own, headed = [0] * len(self.paths), set(self.headed)
        for text, container, linked in self.blocks:
            own[container] += max(0, len(text) - 3 * linked) if loose[container] else 0
        whole = own.copy()
        for i in range(len(whole) - 1, 0, -1):
            whole[self.parents[i]] += whole[i]
        level = [0]
        while True:
            size = sum(whole[i] for i in level)
            if headed.intersection(level) or 50 * sum(own[i] for i in level) >= size:
                return level
            groups: dict[str, list[int]] = {}
            for i in level:
                for child in self.children.get(i, ()):
                    groups.setdefault(self.paths[child], []).append(child)
            best = max(groups.values(), key=lambda g: sum(whole[i] for i in g), default=[])
            if 4 * sum(whole[i] for i in best) < 3 * size:
                return level
            level = best

    def scores(self) -> dict[str, float]:
        """Text outside links that counts for the containers of each path; an article or main element counts half more. Where
        all text stands in links, that of article and main elements counts. Paths are in the order of the page."""
        out: dict[str, float] = {}
        linked_out: dict[str, float] = {}
        targets = self.targets()
        for text, container, linked in self.blocks:
            target = targets[container]
            path, article = self.paths[target], self.parts[target].partition(".")[0] in ("article", "main")
            out[path] = out.get(path, 0.0) + (1.5 if article else 1.0) * max(0, len(text) - 3 * linked)
            if article:
                linked_out[path] = linked_out.get(path, 0.0) + len(text)
        return {p: s for p, s in out.items() if s > 0} or linked_out

    def text(self, path: str | None) -> str:
        """Blocks under the containers of a path; of the page's own best path, the first of equals, when it has none of that
        path."""
        if path is None or path not in self.paths:
            scores = self.scores()
            path = max(scores, key=scores.__getitem__) if scores else None
        if path is None:
            return ""
        chosen = [False] * len(self.paths)
        for i, (p, parent) in enumerate(zip(self.paths, self.parents, strict=True)):
            chosen[i] = p == path or (parent >= 0 and chosen[parent])
        return "\n".join(t for t, container, _ in self.blocks if chosen[container])


def host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """host, path: the path with the most votes of each host's pages. Votes are added before the shuffle."""

    def make():
        def each(batch: pa.RecordBatch):
            hosts, paths, votes = [], [], []
            for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = Page(source).scores() if source else {}
                total = sum(scores.values())
                for p, s in scores.items():
                    hosts.append(h)
                    paths.append(p)
                    votes.append(s / total)
            if hosts:
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes)], ["host", "path", "vote"])

        return each

    votes = map_rows(pages.select(host().alias("host"), html), make, "host string, path string, vote double")
    # Votes are rounded so that the order in which they are added cannot change the winner.
    summed = votes.groupBy("host", "path").agg(F.sum(F.round(F.col("vote") * 1e6).cast("long")).alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def main_texts(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of every page."""
    pages = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    winners = small_or_not(cut(winning_paths(pages), "host-paths"), BROADCAST_HOSTS)
    rows = pages.withColumn("host", host()).join(winners, "host", "left").select("page_id", "url", "html", "path")

    def make():
        def each(batch: pa.RecordBatch):
            texts = [Page(source).text(path) if source else "" for source, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return each

    kind = pages.schema["page_id"].dataType.simpleString()
    out = map_rows(rows, make, f"page_id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": key, "url": url})
