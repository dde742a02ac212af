"""Main text of web pages by a vote of each host's pages on where it stands.

A page's blocks (runs of text between block-level tags) belong to containers, named by
generalised paths: the tags from the body down, with their classes and ids, digits as ``#``, places
among siblings left out. Each page scores its paths by the text below them and votes for the best
one. Spark counts votes by host; paths with at least ``SHARE`` of a host's votes win. Every page is
then read again, and its text is what stands below the first winning path (most votes, then most
text) that has any there; pages without one, and pages without a host, take their own best path.

Left out are scripts, styles and other raw elements, and the subtrees that are boilerplate by tag
(menus, footers, forms), role, or a word of their class or id. Text that such a word names but
that holds an article is not (``<div class="with-sidebar">``), except in reader comments.

Defined cases: a null or empty page, or one without text, gives an empty text; a null url has no
host; repeated rows vote and are extracted each; ties fall to the path's key; an empty table gives
no rows; columns named like an output are replaced. Texts are read whole, in time linear in their
length, whatever tags are left open.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, written
from .reputation import url_parts

#: Share of a host's votes with which a path wins: ten paths a host at most.
SHARE = 0.1
#: Bytes of winning paths up to which they are broadcast, and copies of each host's beyond.
BROADCAST_BYTES, SALTS = 8 << 20, 16

# Elements of HTML.
RAW = "script style title textarea iframe noembed noframes xmp svg".split()
BLOCKS = set(
    "address article aside blockquote button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav noscript ol option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
CONTAINERS = set("article body div main section td".split())
BOILERPLATE_TAGS = set("aside button dialog footer form menu nav noscript option search select template".split())
BOILERPLATE_ROLES = set("banner complementary contentinfo dialog form menu navigation search".split())
#: Open elements that a new one of the same set ends, and elements that such an end doesn't reach beyond.
ENDS = {t: s for s in ({"li"}, {"dt", "dd"}, {"td", "th"}, {"tr", "td", "th"}, {"option"}, {"h1", "h2", "h3", "h4", "h5", "h6"}) for t in s}
ENDS |= {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, **dict.fromkeys(("tbody", "thead", "tfoot"), {"tbody", "thead", "tfoot", "tr", "td", "th"})}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
CELLS = {"table", "caption", "template"}

#: Words of classes and ids that name boilerplate, reader comments, and main text.
BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login masthead menu modal "
    "nav navbar navigation newsletter notice overlay pager pagination paywall popup promo promotion recommended related share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription toolbar widget".split()
)
COMMENT_WORDS = set("comment comments disqus replies reply respond".split())
TEXT_WORDS = set("article body content entry main post story text".split())

_attributes = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?|'[^']*+'?)?)*+)>?"
_token = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({'|'.join(RAW)})(?=[\s/>]){_attributes}.*?(?:(?=</\1[\s/>])|\Z)|<(/?)([a-z][^\s/>]*+){_attributes}|<[!?/][^>]*+>?",
    re.S | re.I,
)
_attribute = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"']+)))?")
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_digits = re.compile(r"\d+")


class Page:
    """Containers and blocks of one page. Element 0 is the body; ``parent`` comes before its children."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.step, self.weight = ["body"], [0], ["body"], [0.8]
        self.by_tag, self.by_word, self.comments = [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._stack, self._open = [0], Counter(["body"])
        self._text: list[str] = []
        self._link, self._in_link = 0, False
        at = 0
        for m in _token.finditer(html):
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            if name := m[4]:
                (self._end if m[3] else self._start)(name.lower(), m[5])
        self._add(html[at:])
        self._flush()
        self._settle()

    def _add(self, raw: str) -> None:
        piece = unescape(raw) if "&" in raw else raw
        self._text.append(piece)
        if self._in_link:
            self._link += len(piece)

    def _flush(self) -> None:
        if self._text:
            if text := " ".join("".join(self._text).split()):
                self.blocks.append((self._stack[-1], text, self._link))
            self._text, self._link = [], 0

    def _pop(self, tags: set[str], limits: set[str]) -> None:
        """Ends the outermost open element of ``tags`` inside the next of ``limits``."""
        if not any(self._open[t] for t in tags):
            return
        depth = 0
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag in tags:
                depth = k
            elif tag in limits:
                break
        if depth:
            self._cut(depth)

    def _cut(self, depth: int) -> None:
        for element in self._stack[depth:]:
            self._open[self.tag[element]] -= 1
        del self._stack[depth:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
        elif tag == "a":
            self._in_link = True
        elif tag in BLOCKS:
            self._flush()
            self._pop({"p"}, CELLS | {"td", "th", "button"})
            if tag in ENDS:
                if len(tag) == 2 and tag[0] == "h":
                    if self.tag[self._stack[-1]] in ENDS[tag]:
                        self._cut(len(self._stack) - 1)
                else:
                    self._pop(ENDS[tag], CELLS | LIMITS.get(tag, set()))
            if tag != "hr":
                self._push(tag, attributes)

    def _push(self, tag: str, attributes: str) -> None:
        up = self._stack[-1]
        given: dict[str, str] = {}
        if attributes and not attributes.isspace():
            for m in _attribute.finditer(attributes):
                given.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        names = given.get("class", "").split()
        words = {w.lower() for n in [*names, given.get("id", "")] for w in _word.findall(n)}
        inside = self._open["article"] > 0
        role, is_text = given.get("role", "").lower(), tag == "article" or "articlebody" in given.get("itemprop", "").lower()
        self.tag.append(tag)
        self.parent.append(up)
        self.step.append(".".join([tag, *sorted({_digits.sub("#", n) for n in names})]) + (f"#{_digits.sub('#', given['id'])}" if given.get("id") else ""))
        self.weight.append(1.5 if is_text else 1.3 if tag == "main" or role == "main" or words & TEXT_WORDS else 1.0)
        self.by_tag.append(tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or (tag == "header" and not inside))
        self.by_word.append(tag not in ("article", "main") and bool(words & BOILERPLATE_WORDS or ("header" in words and not inside)))
        self.comments.append(tag != "main" and bool(words & COMMENT_WORDS))
        self._stack.append(len(self.tag) - 1)
        self._open[tag] += 1

    def _end(self, tag: str, _: str) -> None:
        if tag == "a":
            self._in_link = False
        elif tag == "br":
            self._text.append(" ")
        elif tag in BLOCKS:
            self._flush()
            if self._open[tag]:
                limits = {"table"} if tag in ENDS and tag[0] == "t" else set() if tag == "table" else CELLS | {"td", "th"}
                for k in range(len(self._stack) - 1, 0, -1):
                    if (open_ := self.tag[self._stack[k]]) == tag:
                        return self._cut(k)
                    if open_ in limits:
                        return None

    def _settle(self) -> None:
        """Which elements are left out, and the path keys and scores of the others."""
        n = len(self.tag)
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            if holds[i] or (self.tag[i] in ("article", "main") and not self.comments[i]):
                holds[self.parent[i]] = True
        self.out, self.key, self.depth = [False] * n, [0] * n, [0] * n
        for i in range(n):
            up = self.parent[i]
            if i:
                self.out[i] = self.out[up] or self.by_tag[i] or self.comments[i] or (self.by_word[i] and not holds[i])
                self.depth[i] = self.depth[up] + 1
            self.key[i] = xxhash.xxh64_intdigest(f"{self.key[up]}>{self.step[i]}") - (1 << 63)
        size = [0.0] * n
        for i, text, link in self.blocks:
            if not self.out[i]:
                size[i] += max(0, len(text) - 2 * link)
        for i in range(n - 1, 0, -1):
            if not self.out[i]:
                size[self.parent[i]] += size[i]
        self.scores: dict[int, float] = {}
        for i in range(n):
            if size[i] and not self.out[i] and self.tag[i] in CONTAINERS:
                self.scores[self.key[i]] = self.scores.get(self.key[i], 0) + size[i] * self.weight[i] * (1 + 0.01 * min(self.depth[i], 100))

    def best(self) -> int | None:
        return min(self.scores, key=lambda k: (-self.scores[k], k), default=None)

    def below(self, key: int) -> str:
        """Blocks of the elements with this path, in page order."""
        n = len(self.tag)
        within = [False] * n
        for i in range(n):
            within[i] = self.key[i] == key or (i > 0 and within[self.parent[i]])
        return "\n\n".join(text for i, text, _ in self.blocks if within[i] and not self.out[i])

    def path(self, key: int) -> str:
        i, steps = self.key.index(key), []
        while i:
            steps.append(self.step[i])
            i = self.parent[i]
        return ">".join(["body", *reversed(steps)])

    def main_text(self, winners: list[int]) -> tuple[str, str | None]:
        """Text below the first winning path that has any, else below the page's best; and that path."""
        for key in [*winners, *([] if (own := self.best()) is None else [own])]:
            if key in self.scores and (text := self.below(key)):
                return text, self.path(key)
        whole = self.below(self.key[0])  # nothing but links
        return whole, "body" if whole else None


def container_votes(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html) to the key of each page's best path and the length of its text: host, key, n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "html"):
            found = [page.best() for page in (Page(t.decode(errors="replace")) for t in texts)]
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(found, pa.int64()), pa.array([len(t) for t in texts], pa.int64())], names=["host", "key", "n"])

    return pages.select("host", "html").mapInArrow(run, "host string, key long, n long").where("key IS NOT NULL")


def winning_paths(votes: DataFrame, share: float = SHARE) -> DataFrame:
    """``host`` and ``winners``: the keys with at least ``share`` of its votes, most votes first."""
    counts = votes.groupBy("host", "key").agg(F.count("*").alias("votes"), F.sum("n").alias("n"))
    counts = written(counts)
    totals = counts.groupBy("host").agg(F.sum("votes").alias("total"))
    won = counts.join(totals, "host").where(F.col("votes") >= share * F.col("total"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("n")).alias("n"), "key")))
    return won.groupBy("host").agg(F.transform(ordered, lambda x: x["key"]).alias("winners"))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE, carry: list[str] | None = None) -> DataFrame:
    """``pages`` with text, n_chars and container (the path that the text stands below; null without text). carry: the columns to keep (all)."""
    outputs = {"text", "n_chars", "container"}
    carried = [c for c in (pages.columns if carry is None else carry) if c not in outputs]
    renamed = {c: f"__c{i}" for i, c in enumerate(carried)}
    host, _ = url_parts(F.col(f"`{url_col}`"))
    rows = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in renamed.items()), F.nullif(host, F.lit("")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    winners = written(winning_paths(container_votes(rows.where("host IS NOT NULL")), share))
    size = winners.agg(F.coalesce(F.sum(F.octet_length("host") + 8 * F.size("winners") + 32), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(winners), "host", "left")
    else:  # a host may have many of the pages: its paths go to several places
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    fields = [met.schema[n] for n in renamed.values()]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("text", T.StringType()), ("n_chars", T.LongType()), ("container", T.StringType())))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "html"):
            found = [Page(t.decode(errors="replace")).main_text(w or []) for t, w in zip(texts, part.column("winners").to_pylist(), strict=True)]
            new = [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), *new], names=schema.names)

    out = met.select(*renamed.values(), "html", "winners").mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in renamed.items()), "text", "n_chars", "container")
