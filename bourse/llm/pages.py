"""Main text of web pages: subtrees that recur across many pages of a host are the site's template and go."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from . import common

#: Different contents of a host that have to share a subtree.
MANY = 5
#: Template subtrees that are broadcast at most (17 bytes each); more are joined to the pages.
BROADCAST_SUBTREES = 2_000_000

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TOLD = re.compile("class|id|role|hidden|style|itemprop", re.I)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I) for name in "script style textarea title xmp iframe noembed noframes noscript".split()}
HEADINGS = {f"h{i}" for i in range(1, 7)}
PROSE = HEADINGS | set("p li blockquote pre td th dt dd figcaption caption".split())
BLOCKS = PROSE | set("html body div ul ol dl section article main header footer aside nav table thead tbody tfoot tr figure address form fieldset legend details summary center dialog menu hgroup search".split())
#: Elements inside an article that a site's template may have put there.
BOXES = set("div section aside nav form header footer center details".split())
#: Characters outside links from which a subtree is held to be prose, whatever its tag.
LONG = 200
DROPPED = set("head nav footer aside form template object svg math canvas button select dialog menu audio video".split())
#: Words of class, id and role that tell what isn't the article, and beginnings of such words.
LABELS = set("ad ads nav navbar navigation menu sidebar footer header masthead banner notice notices consent gdpr popup modal share sharing social related login signup promo pagination pager toolbar widget respond replies disqus contentinfo complementary alert".split())
BEGINNINGS = ("comment", "advert", "sponsor", "cookie", "breadcrumb", "newsletter", "subscri", "recommend")
#: Of an opening tag: the elements that it ends, and those beyond which it doesn't look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})), **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})), "tr": ({"tr", "td", "th"}, {"table"})}


class Page:
    """The elements of a page in page order: tag, parent, label, and the hash of each with all that it holds.

    ``pieces`` are the texts with their element, and None where a block begins or ends. Tags may be missing, crossed or cut
    off; nothing is deeper than a list, so nesting has no limit.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.notes, self.hashes, self.sizes, self.ends, self.pieces = [""], [-1], [{}], [1], [0], [0], []
        self.stack, self.open, self.starts = [0], {}, [0]
        at = 0
        while True:
            m = _TOKEN.search(html, at)
            if text := html[at : m.start() if m else len(html)]:
                self.text(unescape(text))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self.close(name)
            elif name in RAW:
                end = RAW[name].search(html, at)
                at = end.end() if end else len(html)
            elif name in VOID:
                self.pieces.append((self.stack[-1], None if name == "hr" else "" if name in ("wbr", "img") else " "))
            else:
                self.start(name, m[3])
        while self.stack:
            self.pop()

    def text(self, text: str) -> None:
        top = self.stack[-1]
        self.pieces.append((top, text))
        if shown := " ".join(text.split()):
            self.hashes[top] = xxh3_64_intdigest(shown, self.hashes[top])
            self.sizes[top] += len(shown)

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS and self.open.get("p"):
            self.close("p")
        if name in ENDS:
            ended, beyond = ENDS[name]
            for i in range(len(self.stack) - 1, 0, -1):
                tag = self.tags[self.stack[i]]
                if tag in ended:
                    while len(self.stack) > i:
                        self.pop()
                    break
                if tag in beyond or tag in BLOCKS and tag not in PROSE and tag != "tr":
                    break
        note = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if _TOLD.search(attributes) else {}
        self.tags.append(name)
        self.parents.append(self.stack[-1])
        self.notes.append(note)
        self.hashes.append(xxh3_64_intdigest("\n".join([name, *(note.get(k, "") for k in ("class", "id", "role"))])))
        self.sizes.append(0)
        self.ends.append(0)
        self.starts.append(len(self.pieces))
        self.stack.append(len(self.tags) - 1)
        self.open[name] = self.open.get(name, 0) + 1
        if name in BLOCKS:
            self.pieces.append((self.stack[-1], None))

    def close(self, name: str) -> None:
        if not self.open.get(name):
            return
        if name not in BLOCKS:  # the end of an inline element doesn't end the blocks inside it
            for i in reversed(self.stack):
                if self.tags[i] == name:
                    break
                if self.tags[i] in BLOCKS:
                    return
        while self.tags[self.stack[-1]] != name:
            self.pop()
        self.pop()

    def pop(self) -> None:
        i = self.stack.pop()
        tag, parent = self.tags[i], self.parents[i]
        if tag in BLOCKS:
            self.pieces.append((i, None))
        self.ends[i] = len(self.pieces)
        if i:
            self.open[tag] -= 1
            self.hashes[parent] = xxh3_64_intdigest(self.hashes[i].to_bytes(8, "little"), self.hashes[parent])
            self.sizes[parent] += self.sizes[i] if tag != "a" else 0

    def is_labelled(self, i: int) -> bool:
        """If the element's tag or label tells that it isn't of the article. A header that holds a heading is an article's own."""
        tag, note = self.tags[i], self.notes[i]
        if tag in DROPPED:
            return True
        if tag == "header":
            inside = self.within(i, "article") or self.within(i, "main")
            return not (inside and any(t in HEADINGS for t in self.tags[i + 1 : self.after(i)]))
        if not note or tag in HEADINGS or tag in ("html", "body", "main"):
            return False
        if "hidden" in note or note.get("aria-hidden") == "true" or "display:none" in note.get("style", "").replace(" ", "").lower():
            return True
        words = [w.lower() for k in ("class", "id", "role") for w in _WORD.findall(note.get(k) or "")]
        return any(w in LABELS or w.startswith(BEGINNINGS) for w in words)

    def within(self, i: int, tag: str) -> bool:
        while i > 0:
            i = self.parents[i]
            if self.tags[i] == tag:
                return True
        return False

    def after(self, i: int) -> int:
        """The first element after those inside ``i``."""
        j = i + 1
        while j < len(self.tags) and self.starts[j] < self.ends[i]:
            j += 1
        return j

    def outline(self) -> None:
        """``labelled``, ``roots`` (where the text is), ``marked`` (if markup tells it) and ``core``: what no template holds."""
        self.labelled = [self.is_labelled(i) for i in range(len(self.tags))]
        self.labelled[0], live = False, [True]
        for i in range(1, len(self.tags)):
            live.append(live[self.parents[i]] and not self.labelled[i])
        tells = lambda i: self.tags[i] == "main" or self.notes[i].get("role") == "main" or self.notes[i].get("itemprop") == "articleBody"
        self.roots, self.marked = [0], False
        for test in (lambda i: self.tags[i] == "article", tells):
            inside, found = [False], []
            for i in range(1, len(self.tags)):
                mine = live[i] and test(i) and not inside[self.parents[i]] and self.sizes[i] > 0
                inside.append(mine or inside[self.parents[i]])
                if mine:
                    found.append(i)
            if found:
                self.roots, self.marked, self.inside = found, True, inside
                break
        core = self.roots
        if not self.marked:  # the innermost element with two thirds of the text
            core = [max(i for i in range(len(self.tags)) if 3 * self.sizes[i] >= 2 * self.sizes[0])]
            self.inside = [True] * len(self.tags)
        self.content = xxh3_64_intdigest(b"".join(self.hashes[i].to_bytes(8, "little") for i in core))
        kept = {0}
        for i in core:
            while i not in kept:
                kept.add(i)
                i = self.parents[i]
        self.subtrees = [i for i in range(1, len(self.tags)) if i not in kept and self.tags[i] not in ("html", "body") and not (self.marked and self.inside[i] and self.tags[i] not in BOXES)]

    def extract(self, recurs: dict[int, bool]) -> tuple[str, int, int]:
        """The text, and how many subtrees went as template and by tag or label. ``recurs``: the hashes that recur in the
        host, and if most of its contents have it, as prose must to be template."""
        is_prose = lambda i: self.tags[i] in PROSE or self.sizes[i] >= LONG
        template = {i for i in self.subtrees if (most := recurs.get(self.hashes[i])) is not None and (most or not is_prose(i))}
        kept, n_template, n_labelled = [True], 0, 0
        for i in range(1, len(self.tags)):
            up = kept[self.parents[i]]
            n_template += up and i in template
            n_labelled += up and i not in template and self.labelled[i]
            kept.append(up and i not in template and not self.labelled[i])
        blocks, run = [], []
        for root in self.roots:
            for i, text in [*self.pieces[self.starts[root] : self.ends[root]], (root, None)]:
                if text is None:
                    if run and (block := " ".join("".join(run).split())):
                        blocks.append(block)
                    run = []
                elif kept[i]:
                    run.append(text)
        return "\n".join(blocks), n_template, n_labelled


def read(html: str | None) -> Page:
    page = Page(html or "")
    page.outline()
    return page


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host (its hash; null without one) and a key of host and html: equal pages of a host are one."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.when(host != "", F.xxhash64(host)).alias("host"))
    return rows.withColumns({"k1": F.xxhash64("host", "html"), "k2": F.xxhash64(F.lit("second"), "host", "html")})


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def subtrees(rows: DataFrame) -> DataFrame:
    """Of each page with a host: host, key, the hash of its content and of each subtree that may be template."""
    schema = pa.schema([("host", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("content", pa.int64()), ("subtrees", pa.list_(pa.int64()))])

    def run(batch):
        read_pages = [read(h) for h in batch.column(3).to_pylist()]
        return [*batch.columns[:3], _signed([p.content for p in read_pages]), [_signed(sorted({p.hashes[i] for i in p.subtrees})) for p in read_pages]]

    return rows.filter("host IS NOT NULL").select("host", "k1", "k2", "html").mapInArrow(common.batches(run, schema), "host long, k1 long, k2 long, content long, subtrees array<long>")


def templates(found: DataFrame, many: int) -> DataFrame:
    """The subtrees that at least ``many`` contents of a host share: host, subtree, most (if at least half of its contents), n_rows."""
    contents = found.groupBy("host", "content").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.count(F.lit(1)).alias("n_contents"))
    shared = found.select("host", "content", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree", "content").agg(F.count(F.lit(1)).alias("n"))
    shared = common.materialise(shared.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("shared_by"), F.sum("n").alias("n_rows")).filter(F.col("shared_by") >= many), "shared")
    hosts = common.materialise(shared.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(contents, "host"), "hosts")
    return common.join_groups(shared, hosts, ["host"], "n").select("host", "subtree", (2 * F.col("shared_by") >= F.col("n_contents")).alias("most"), "n_rows")


class Recurring:
    """The template subtrees of one host in order, looked up by their hash."""

    def __init__(self, subtrees: np.ndarray, most: np.ndarray):
        self.subtrees, self.most = subtrees, most

    def get(self, subtree: int) -> bool | None:
        signed = subtree - (1 << 64) if subtree >> 63 else subtree
        at = np.searchsorted(self.subtrees, signed)
        return bool(self.most[at]) if at < len(self.subtrees) and self.subtrees[at] == signed else None


def _broadcast(shared: DataFrame):
    """The template subtrees by host, for ``Recurring``: at most BROADCAST_SUBTREES."""
    known = shared.select("host", "subtree", "most").toPandas().sort_values(["host", "subtree"])
    return shared.sparkSession.sparkContext.broadcast([known["host"].to_numpy(np.int64), known["subtree"].to_numpy(np.int64), known["most"].to_numpy(bool)])


def _texts(rows: DataFrame, id_type: str, lookup) -> DataFrame:
    """The extracted pages; ``lookup(x)`` gives the hashes that recur in a row's host, from the column ``x``."""
    names = ("page_id", "url", "text", "n_chars", "n_template", "n_labelled")

    def run(stream):
        for batch in stream:
            for part in common.slices(batch):
                out = [read(h).extract(lookup(x)) for h, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                texts = [o[0] for o in out]
                columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)

    return rows.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long, n_template long, n_labelled long")


def main_texts(pages: DataFrame, many: int = MANY) -> DataFrame:
    """A row per page: page_id, url, text, n_chars (code points), n_template and n_labelled (outermost subtrees that went).

    Every element subtree is hashed (tag, class, id, role, texts, children), and counted in Spark over the different contents
    of its host: copies of one article count once. Subtrees that ``many`` contents share are the site's template and go;
    prose (paragraphs, headings, list items, LONG texts) only if half of the host's contents have it, and inside an article or
    main element only boxes such as div or section go, so passages that articles share stay. Hosts with few pages have no template to be seen:
    on all pages, elements go too whose tag or label says menu, header, footer, sidebar, notice, advert, form or comments.
    The text is that of the article elements, else of main, else of the body: blocks in page order, one a line.

    A null html is empty and gives an empty text; a null url or one without a host has no template; repeated rows are
    extracted each; other columns are ignored; no pages give no rows. Pages of any length and nesting are read in one pass.

    The pages stay where they are read: hashes are shuffled. Up to BROADCAST_SUBTREES template subtrees are broadcast; more are
    joined to the pages' hashes and gathered by page, and then the pages are joined by their key.
    """
    since = common.mark()
    rows, id_type = keyed(pages), pages.schema["page_id"].dataType.simpleString()
    found = common.materialise(subtrees(rows), "subtrees")
    shared = common.materialise(templates(found, many), "templates")
    if shared.count() <= BROADCAST_SUBTREES:
        known = _broadcast(shared)

        def of_host(host):
            hosts, subtrees_, most = known.value
            first, last = np.searchsorted(hosts, host), np.searchsorted(hosts, host, "right")
            return Recurring(subtrees_[first:last], most[first:last])

        out = _texts(rows.select("page_id", "url", "html", "host"), id_type, lambda host: {} if host is None else of_host(host))
    else:
        each = found.groupBy("host", "k1", "k2").agg(F.first("subtrees").alias("subtrees"), F.count(F.lit(1)).alias("n_pages"))
        hits = common.join_groups(each.select("host", "k1", "k2", "n_pages", F.explode("subtrees").alias("subtree")), shared, ["host", "subtree"], "n_rows")
        of_page = common.materialise(hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("subtree", "most")).alias("recurs"), F.max("n_pages").alias("n_pages")), "recurring")  # at most a page's subtrees
        joined = common.join_groups(rows, of_page, ["k1", "k2"], "n_pages", "left").select("page_id", "url", "html", "recurs")
        out = _texts(joined, id_type, lambda recurs: {r["subtree"] % (1 << 64): r["most"] for r in recurs or ()})
    return common.sweep(since, out)
