"""HTML extraction by site style trees.

Pages of a host are merged into one style tree, whose nodes are paths of tags with their
presentation (class, id, role). Two entropies over the host's distinct pages tell how much a node
matters. The presentations that its children show: many different ones matter. The contents that its
own text shows: a content that n of m pages share has the entropy log n, and its importance is
1 - log n / log(m + PRIOR); a node's is the mean of its contents. PRIOR stands for pages with a
content of their own that weren't seen, so that a host of a few pages gives little evidence.

A block goes if its element has a low importance, or if its own content has half of that or less,
inside ``article`` and ``main`` as well as on pages without them. In an element of low importance a
heading or paragraph of the article stays if its text is on no other page of the host.

What a tag or its class says comes first where it is plain: menus, page headers and footers,
sidebars, notices, adverts, forms, comments, scripts and styles go whatever their entropy (an
advert that differs on every page has the statistics of an article), and a page with an
``article`` or ``main`` element is read from it alone. A class counts only if all its words name such
things, and never on headings, paragraphs and quotations.

Defined cases: null or empty html, and pages without a main text, give the empty text; a page
whose url has no host belongs to the empty host; repeated rows each get their row and count once
in a tree; an empty table gives an empty result; extra columns are ignored.

Scale: a page gives a row for each content and each element, whatever its depth. Trees are sums over
(host, path, content), combined before the shuffle, so a host with a third of the pages is no task of
its own. What a host cuts is on m ** 0.75 pages at least by the geometric mean, so that m pages of b
blocks have no more than b * (m + PRIOR) ** 0.25 such contents; that row alone joins its pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import lean, spread, stored
from .html_scan import HEADINGS, Block, blocks_of, digest

#: Pages of their own that are taken for granted, the importance below which a branch goes, and the
#: weight that a presentation passes on to the contents.
PRIOR, LEAST_IMPORTANCE, DAMPING = 4, 0.25, 0.9
#: Inside article and main these stay in a cut element if their text is the page's own.
STAYS = HEADINGS | {"p"}
NOTHING: frozenset[int] = frozenset()


def candidates(page: str) -> list[Block]:
    """The blocks that tags and classes leave."""
    found = blocks_of(page)
    return [b for b in found if b.main] or found


def extract(page: str, cut: frozenset[int] = NOTHING, shared: frozenset[int] = NOTHING, common: frozenset[int] = NOTHING) -> str:
    """The main text. ``cut`` holds the paths that the host's tree cuts, ``shared`` the contents under
    them that more than one page has, ``common`` the contents of low importance."""
    found = candidates(page)
    if cut or common:
        own = lambda b: b.main and b.node.tag in STAYS and b.content not in shared
        found = [b for b in found if b.content not in common and (b.node.path not in cut or own(b))]
    return "\n".join(b.text for b in found)


PAGE, CONTENT, PRESENTATION = 0, 1, 2


@lean
def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for a page, for each of its contents with its element's path, and for each element with
    its parent's path and its own presentation."""
    for batch in batches:
        out = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            found = candidates(page)
            signature = digest("\n".join(b.text for b in found))
            rows = {(PAGE, 0, signature)}
            seen = set()
            for b in found:
                rows.add((CONTENT, b.node.path, b.content))
                node = b.node
                while node is not None and node.parent is not None and id(node) not in seen:
                    seen.add(id(node))
                    rows.add((PRESENTATION, node.parent.path, node.style))
                    node = node.parent
            out += [(host, signature, *row) for row in rows]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], ["host", "page", "kind", "path", "value"])


def cut_paths(pages: DataFrame, prior: int = PRIOR, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """``host, cut, shared, common`` of ``pages`` (host, html), for each host that cuts anything."""
    rows = pages.mapInArrow(_nodes, "host string, page long, kind int, path long, value long").distinct()
    tree = stored(rows.groupBy("host", "kind", "path", "value").agg(F.count("*").alias("n")), "style-tree")
    size = tree.filter(F.col("kind") == PAGE).groupBy("host").agg(F.log(F.count("*") + prior).alias("log_m"))
    contents = tree.filter(F.col("kind") == CONTENT)
    # a host's size joins its paths, not its contents, and only those with a content that pages share
    content = contents.groupBy("host", "path").agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("contents")).filter("logs > 0")
    total = tree.filter(F.col("kind") == PRESENTATION).groupBy("host", "path").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count("*").alias("styles"))
    presentation = total.select("host", "path", "styles", F.when(F.col("styles") > 1, (F.log("all") - F.col("nlogn") / F.col("all")) / F.log("styles")).otherwise(0.0).alias("presentation"))
    both = content.join(size, "host").join(presentation, ["host", "path"], "left").fillna(0, ["styles", "presentation"])
    both = both.withColumn("content", 1 - F.col("logs") / F.col("log_m") / F.col("contents"))
    weight = 1 - F.pow(F.lit(DAMPING), F.col("styles"))
    importance = weight * F.col("presentation") + (1 - weight) * F.col("content")
    low = both.filter(F.greatest(importance, F.col("content")) < least_importance).select("host", "path")
    several = contents.filter("n > 1")
    shared = several.join(low, ["host", "path"]).select("host", F.lit("shared").alias("what"), "value")
    common = several.join(size, "host").filter(1 - F.log("n") / F.col("log_m") < least_importance / 2).select("host", F.lit("common").alias("what"), "value")
    every = low.select("host", F.lit("cut").alias("what"), F.col("path").alias("value")).union(shared).union(common)
    return every.groupBy("host").agg(*(F.collect_set(F.when(F.col("what") == w, F.col("value"))).alias(w) for w in ("cut", "shared", "common")))


@lean
def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, known = [], {}
        for page, *own in zip(*(batch.column(c).to_pylist() for c in ("html", "cut", "shared", "common"))):
            texts.append(extract(page, *(known.setdefault(tuple(x), frozenset(x)) if x else NOTHING for x in own)))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row."""
    ship(pages.sparkSession)
    url = F.col(url_col).cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = spread(rows)
    cut = stored(cut_paths(rows.select("host", "html")), "cut-paths")
    return rows.join(cut, "host", "left").select("page_id", "url", "html", "cut", "shared", "common").mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
