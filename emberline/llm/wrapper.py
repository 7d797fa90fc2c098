"""Main text of web pages by wrapper induction over the pages of a host.

Pages become trees of blocks (runs of plain siblings of one name count as one). The trees of all of
a host's pages are aligned by simple tree matching into a template: texts that every page has at a
node are constant, all others are slots. Every task merges the pages of a host that it reads into
one template, and these are merged host by host in two levels, so templates alone are shuffled,
never pages, and a host that holds a third of all pages is an even share of every task.

The template's content root is its landmark (``article``, ``main``) or, without one, the slot region
that holds most of the varying text outside links and lists; parts whose element or class names a
menu, header, footer, sidebar, notice, advert, form or comment section are never content. Every page
is then aligned with its host's template. Of the blocks under the image of the content root those
that alignment shows to be constant over the host are template, paragraphs and titles included; the
rest is the page's text. Where constant texts are half of the root's text or more, the pages are
copies of each other rather than pages of one template, and paragraphs stay. A page to which the
root does not map is its own template.

A class, id or role inside the content marks a widget only as a whole: every part of one of its
words says so (``ad``, ``cookie-notice``, ``comment-list``; not ``ad-free``, ``entry-header``).

Defined cases: null and empty pages, and pages without such a block, have empty text; pages without
a host share the template of the empty host; repeated pages give repeated rows; cut-off pages end
where they end; elements nested deeper than ``dom.DEPTH`` count as text of the one at that depth,
but for those that decide what is content.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.dom import Node, parse
from emberline.llm.words import light_batches
from emberline.session import cut_lineage

SALTS = 16
# Templates of so many hosts are held by a task at a time.
HOSTS_AT_ONCE = 256
# Constant paragraphs of so many pages or more are template.
LEAST_PAGES = 5
# Nodes of less than this share of a host's pages are left out of its template; no constant is among them.
RARE = 1 / 200
LANDMARKS = ("article", "main")
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt figcaption #text".split())
# Elements and words of class, id and role that mark what is no main text.
ASIDE_TAGS = frozenset("nav footer aside form button select noscript template dialog object menu head".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary "
    "contentinfo cookie cookies consent disclaimer disqus footer form masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted recommended related reply replies respond search share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget header".split())
# Words that only say what shape the thing has that the other words name, and such as an article may use.
SHAPE_WORDS = frozenset("area bar block box container inner item list outer section slot unit wrap wrapper".split())
CONTENT_WORDS = frozenset("header reply replies".split())


@dataclass
class Slot:
    """A node of a template: how many pages have it, and the texts all of them share."""
    tag: str
    key: str
    seen: int
    constant: set[str]
    varying: int  # characters of texts that differ, summed over the pages
    children: list[Slot] = field(default_factory=list)

    def to_json(self) -> list:
        return [self.tag, self.key, self.seen, sorted(self.constant), self.varying, [c.to_json() for c in self.children]]

    @staticmethod
    def of_json(x: list) -> Slot:
        return Slot(x[0], x[1], x[2], set(x[3]), x[4], [Slot.of_json(c) for c in x[5]])

    @staticmethod
    def of_page(node: Node) -> Slot:
        return Slot(node.tag, node.key, 1, set(node.texts), 0, [Slot.of_page(c) for c in node.children])


def _names_widget(word: str) -> bool:
    """Whether all parts of a class word name a widget or its shape, and one does name a widget."""
    parts = set(filter(None, re.split(r"[^a-z]+", word)))
    return not parts.isdisjoint(ASIDE_WORDS - CONTENT_WORDS) and parts <= (ASIDE_WORDS - CONTENT_WORDS) | SHAPE_WORDS


def is_aside(tag: str, key: str, in_landmark: bool) -> bool:
    if tag in ASIDE_TAGS or (tag == "header" and not in_landmark):
        return True
    if in_landmark:
        return any(map(_names_widget, key.split()))
    return bool(key) and not ASIDE_WORDS.isdisjoint(re.split(r"[^a-z]+", key))


def decides(tag: str, key: str) -> bool:
    """Whether an element says what is content, however deep it stands."""
    return tag in LANDMARKS or tag == "header" or is_aside(tag, key, False)


def matching(left: list, right: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of siblings: (matched nodes, pairs of positions)."""
    if not left or not right:
        return 0, []
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    gain: dict[tuple[int, int], int] = {}
    for i, a in enumerate(left):
        row, above = best[i + 1], best[i]
        for j, b in enumerate(right):
            value = above[j + 1] if above[j + 1] >= row[j] else row[j]
            if a.tag == b.tag and a.key == b.key:
                gain[i, j] = 1 + matching(a.children, b.children)[0]
                if above[j] + gain[i, j] > value:
                    value = above[j] + gain[i, j]
            row[j + 1] = value
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if (i - 1, j - 1) in gain and best[i][j] == best[i - 1][j - 1] + gain[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def merge(template: Slot, other: Slot) -> None:
    """Align a further page, or a template of further pages, with the template."""
    common = template.constant & other.constant
    template.varying += other.varying + sum(map(len, template.constant - common)) * template.seen + sum(
        map(len, other.constant - common)) * other.seen
    template.constant = common
    template.seen += other.seen
    _, pairs = matching(template.children, other.children)
    for i, j in pairs:
        merge(template.children[i], other.children[j])
    new = sorted(set(range(len(other.children))) - {j for _, j in pairs})
    for j in new:
        # A block that only the other has: a slot, after the blocks matched before it.
        after = max((i for i, k in pairs if k < j), default=-1)
        template.children.insert(after + 1, other.children[j])
        pairs = [(i + (i > after), k) for i, k in pairs] + [(after + 1, j)]


def pruned(slot: Slot, least: float) -> Slot:
    slot.children = [pruned(c, least) for c in slot.children if c.seen >= least]
    return slot


def induce(templates: list[Slot]) -> Slot:
    """One template of several, by merging neighbours, so that none meets much larger ones often."""
    while len(templates) > 1:
        for left, right in zip(templates[::2], templates[1::2], strict=False):
            merge(left, right)
        templates = templates[::2]
    return pruned(templates[0], templates[0].seen * RARE)


def content_root(template: Slot) -> list[int] | None:
    """Path (child positions) to the content root, None if it is made of several landmarks or none."""
    landmarks, scores = [], []

    def visit(slot: Slot, path: list[int], inside: bool) -> float:
        if path and is_aside(slot.tag, slot.key, inside):
            return 0.0
        if slot.tag in LANDMARKS and not inside:
            landmarks.append((slot.seen, path))
            inside = True
        own = slot.varying + (sum(map(len, slot.constant)) if template.seen == 1 else 0)
        mass = own * (1.0 if slot.tag in PARAGRAPHS - {"li"} else 0.2)
        below = [visit(c, [*path, i], inside) for i, c in enumerate(slot.children)]
        mass += sum(below)
        # The smallest node that holds most of its parent's text goes deepest.
        scores.append((mass, len(path), path, bool(slot.children)))
        return mass

    visit(template, [], False)
    if landmarks:
        common = max(s for s, _ in landmarks)
        often = [p for s, p in landmarks if 2 * s >= common]
        return often[0] if len(often) == 1 else None
    total = max(m for m, *_ in scores)
    rooms = [(len_, m, p) for m, len_, p, inner in scores if inner and m >= 0.75 * total]
    return max(rooms, key=lambda r: r[:2])[2] if rooms and total > 0 else None


def _blocks(node: Node, constant: dict[int, set[str]], in_landmark: bool) -> list[str]:
    """The texts below a content root, without constant ones."""
    found: list[tuple[str, bool, bool]] = []  # text, whether it is constant, whether it is a paragraph
    stack = [(node, in_landmark, True)]
    while stack:
        node, inside, top = stack.pop()
        if not top and is_aside(node.tag, node.key, inside):
            continue
        inside = inside or node.tag in LANDMARKS
        fixed = constant.get(id(node), set())
        found += [(t, t in fixed, node.tag in PARAGRAPHS) for t in node.texts]
        stack += [(c, inside, False) for c in reversed(node.children)]
    copies = 2 * sum(len(t) for t, fixed, _ in found if fixed) >= sum(len(t) for t, *_ in found)
    return [t for t, fixed, paragraph in found if not fixed or (paragraph and copies)]


def extract(page: str | None, template: Slot | None) -> str:
    tree = parse(page, decides)
    if not tree.children:
        return ""
    own = template is None
    template = template or Slot.of_page(tree)
    constant: dict[int, set[str]] = {}
    image: dict[int, Node] = {}
    todo = [(template, tree)]
    while todo:
        slot, node = todo.pop()
        image[id(slot)] = node
        if not own and slot.seen >= LEAST_PAGES and slot.seen == template.seen:
            constant[id(node)] = slot.constant
        _, pairs = matching(slot.children, node.children)
        todo += [(slot.children[i], node.children[j]) for i, j in pairs]
    path = content_root(template)
    roots = []
    if path is not None:
        slot = template
        for i in path:
            slot = slot.children[i]
        if id(slot) in image:
            roots = [image[id(slot)]]
    if not roots:
        roots = _landmarks(tree)
    if not roots and not own:
        return extract(page, None)
    return "\n\n".join(t for root in roots or [tree] for t in _blocks(root, constant, root.tag in LANDMARKS))


def _landmarks(tree: Node) -> list[Node]:
    found, stack = [], [tree]
    while stack:
        node = stack.pop()
        if node.tag in LANDMARKS:
            found.append(node)
        elif not is_aside(node.tag, node.key, False):
            stack += reversed(node.children)
    return found


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, template) of the pages (host, html) of a task, a few rows for each host."""
    held: dict[str, list[Slot]] = {}

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held)), pa.array([json.dumps(induce(t).to_json()) for t in held.values()], pa.string())], names=["host", "template"])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tree = parse(page, decides)
            if not tree.children:
                continue
            pages = held.setdefault(host, [])
            pages.append(Slot.of_page(tree))
            # Equal sizes meet, as in a binary counter.
            while len(pages) > 1 and pages[-1].seen == pages[-2].seen:
                merge(pages[-2], pages.pop())
        if len(held) > HOSTS_AT_ONCE:
            yield done()
            held.clear()
    if held:
        yield done()


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    slots = [Slot.of_json(json.loads(t)) for t in sorted(group.template)]
    return group.iloc[:1].assign(template=json.dumps(induce(slots).to_json()))


def main_text(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    whole = light_batches(pages).select("page_id", "url", F.col("html").cast("string").alias("html"))
    host = F.coalesce(F.lower(F.expr("try_parse_url(url, 'HOST')")), F.lit(""))
    keyed = whole.withColumn("host", host)
    partial = keyed.where("html <> ''").select("host", "html").mapInArrow(_partial, "host string, template string")
    halfway = partial.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(salts)).cast("int")).groupBy("host", "salt").applyInPandas(
        _merged, "host string, template string, salt int")
    # Stored, so that their size is known where they join the pages: if small, the pages stay in place.
    templates = cut_lineage(halfway.groupBy("host").applyInPandas(_merged, "host string, template string, salt int"))
    salted = templates.select("host", "template", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Slot] = {}
        for batch in batches:
            out = []
            for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if template is not None and template not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[template] = Slot.of_json(json.loads(template))
                out.append(extract(page, known.get(template)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = {c: whole.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return keyed.withColumn("salt", salt).join(salted, ["host", "salt"], "left").select(
        "page_id", "url", "html", "template").mapInArrow(
        pull, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
