"""Main text of web pages by wrapper induction over the pages of each host.

1. Every page becomes a tree of blocks (``dom``). Tasks fold the pages they read
   into one template per host by simple tree matching; templates of a host are
   merged pair by pair in rounds of bounded groups, so that no task gets all pages
   of a host. All pages take part.
2. Every page is aligned with its host's template, which says for each block the
   template's node it belongs to. Texts are counted per node: a text that stands on
   most pages of the host is part of the template, whatever varies is a slot.
   Pages that share their longest block count once, so copies of one article do
   not look like a template.
3. Of the slots, those of the article are its content: below the node that names
   itself article or main, else below the lowest node with nearly all varying
   text; without what names itself menu, footer, advert, comment and so on, and
   without lists that are nearly all links. The page's blocks in these slots are
   its text.

Pages are not shuffled: templates and wrappers come to the pages, broadcast while
their measured size allows it (MAX_BROADCAST), else by a join that Spark splits
where a host is hot. Texts are counted by hash, combined before the shuffle.

Defined cases: null html is empty; a page without text or without an article has
the empty string; a host of one page, or of fewer than three different articles,
has no template texts and is read by its slots alone; a null url, or one without
a host, belongs to the host named by the empty string; rows that repeat an id are
pages of their own; an empty table gives none; other columns are ignored. A template
keeps its MAX_NODES most common nodes; blocks elsewhere count to the nearest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasedex.session import shared_dir

from . import dom
from .common import release, table

MAX_NODES = 4000
#: Templates of a host merged in one group.
FAN_IN = 64
MAX_BROADCAST = 64 << 20
#: A text is template if it stands on so many of a node's different articles, of which there are at least three.
CONSTANT_SHARE, LEAST_ARTICLES = 0.8, 3
#: Share of all varying text that the content node holds where no node is named article or main.
CONTENT_SHARE = 0.8
LINK_SHARE = 0.8
#: Template nodes that a task holds before it hands its templates on.
HELD_NODES = 400_000


def host_of(url):
    """Column: the url's host in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _small(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` to be broadcast if its measured bytes allow it."""
    total = df.agg(F.sum(sum(F.length(F.col(c).cast("string")) + 16 for c in cols))).first()[0] or 0
    return F.broadcast(df) if total <= MAX_BROADCAST else df


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template) from (host, html): all pages of a host merged."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str, dom.Node] = {}
        nodes, turn, part = 0, 0, TaskContext.get().partitionId()

        def rows() -> pa.RecordBatch:
            cols = [[*held], [(turn << 32) + part] * len(held), [dom.dumps(t) for t in held.values()]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["host", "seq", "template"])

        for b in batches:
            for host, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = dom.as_template(dom.parse(text.as_py() or "")[0])
                before = held.get(host)
                both = own if before is None else dom.pruned(dom.merge(before, own), MAX_NODES)
                nodes += dom.size_of(both) - (dom.size_of(before) if before else 0)
                held[host] = both
            if nodes > HELD_NODES:
                yield rows()
                held, nodes, turn = {}, 0, turn + 1
        if held:
            yield rows()
        release()

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out = dom.loads(pdf["template"].iat[0])
        for t in pdf["template"].iloc[1:]:
            out = dom.pruned(dom.merge(out, dom.loads(t)), MAX_NODES)
        return pd.DataFrame({"host": [key[0]], "seq": [key[1]], "template": [dom.dumps(out)]})

    schema = "host string, seq long, template string"
    parts = _stored(pages.select("host", "html").mapInArrow(fold, schema), "page-templates")
    while True:
        most = parts.groupBy("host").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return parts.select("host", "template")
        # Part numbers are dealt to ever fewer groups of about FAN_IN templates of a host.
        groups = -(-most // FAN_IN)
        dealt = parts.withColumn("slot", F.pmod(F.xxhash64("seq"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long"))
        parts = _stored(dealt.groupBy("host", "slot").applyInPandas(join, schema), "page-templates")


PLACED = "page_id long, url string, host string, article long, blocks array<struct<node:int,links:int,text:string>>"


def _place(rows: DataFrame) -> DataFrame:
    """PLACED from (page_id, url, host, html, template): the blocks of every page with their template nodes."""
    block = pa.struct([("node", pa.int32()), ("links", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[str, dom.Node] = {}
        for b in batches:
            found, longest = [], []
            for text, template in zip(b.column(3), b.column(4).to_pylist()):
                root, blocks = dom.parse(text.as_py() or "")
                if template not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[template] = dom.loads(template)
                    dom.numbered(known[template])
                dom.assign(root, known[template])
                found.append([{"node": node.id, "links": links, "text": t} for node, t, links in blocks])
                top = max((t for _, t, _ in blocks), key=lambda t: (len(t), t), default="")
                longest.append(xxhash.xxh64_intdigest(top.encode("utf-8", "surrogatepass")) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(3)), pa.array(longest, pa.int64()), pa.array(found, pa.list_(block))],
                ["page_id", "url", "host", "article", "blocks"],
            )
        release()

    return rows.select("page_id", "url", "host", "html", "template").mapInArrow(run, PLACED)


def content_nodes(template: dom.Node, stats: dict[int, tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """(nodes of the article, nodes beside it) of a numbered template; ``stats``: articles, characters, linked characters per node."""
    nodes = dom.numbered(template)
    parent = {k.id: x.id for x in nodes for k in x.kids}
    # What stands below: an article, a main part or a title makes a form or a named division a frame, not a part beside.
    frames = set()
    for x in reversed(nodes):
        if x.tag in ("article", "main", "h1") or "@main" in x.label or any(k.id in frames for k in x.kids):
            frames.add(x.id)
    hard = ("nav", "footer", "aside", "menu", "dialog")
    beside = [False] * len(nodes)
    for x in nodes:
        own = x.beside() and not (x.id in frames and x.tag not in hard)
        beside[x.id] = own or (x.id in parent and beside[parent[x.id]])
    header = [False] * len(nodes)
    for x in nodes:
        header[x.id] = x.label.startswith("^") or (x.id in parent and header[parent[x.id]])
    mass = [0] * len(nodes)
    for x in reversed(nodes):
        if not beside[x.id]:
            n, chars, links = stats.get(x.id, (0, 0, 0))
            mass[x.id] += max(0, chars - links)
            if x.id in parent:
                mass[parent[x.id]] += mass[x.id]

    def named(test) -> list[int]:
        """Outermost nodes that pass, but those with little text beside the largest."""
        found = [x.id for x in nodes if test(x) and not beside[x.id]]
        inner = set()
        for i in found:
            up = parent.get(i)
            while up is not None:
                if up in found:
                    inner.add(i)
                    break
                up = parent.get(up)
        found = [i for i in found if i not in inner and mass[i] > 0]
        return [i for i in found if 4 * mass[i] >= max(mass[j] for j in found)]

    tops = named(lambda x: x.tag == "article" or "@main" in x.label) or named(lambda x: x.tag == "main")
    if not tops:
        at = 0
        while True:
            heavy = [k for k in nodes[at].kids if mass[k.id] >= CONTENT_SHARE * mass[0] and mass[0] and not k.label.startswith("^")]
            if not heavy or heavy[0].tag in dom.ITEMS or is_text(heavy[0]):
                break
            at = heavy[0].id
        tops = [at]
    inside = [False] * len(nodes)
    for x in nodes:
        inside[x.id] = x.id in tops or (x.id in parent and inside[parent[x.id]])
    keep, away = [], []
    for x in nodes:
        n, chars, links = stats.get(x.id, (0, 0, 0))
        # A header inside the article holds its title; one outside is the page's.
        outer_header = header[x.id] and not (inside[x.id] and any(x.tag == "article" or "@main" in x.label for x in (nodes[t] for t in tops)))
        menu = x.tag in ("li", "ul", "ol", "dd", "div", "td") and n > 1 and links >= LINK_SHARE * chars > 0
        if beside[x.id] or outer_header or menu:
            away.append(x.id)
        elif inside[x.id]:
            keep.append(x.id)
    return keep, away


def is_text(node: dom.Node) -> bool:
    """Whether a node is a text block itself, not a container."""
    return node.tag in ("blockquote", "pre", "table", "ul", "ol", "dl", "h1", "h2", "h3", "h4", "h5", "h6")


def _wrappers(placed: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, keep, away, constants) of every host."""
    blocks = placed.select("host", "article", F.explode("blocks").alias("b")).where("b.node >= 0")
    blocks = blocks.select("host", "article", "b.node", "b.links", F.length("b.text").alias("chars"), F.xxhash64("b.node", "b.text").alias("text"))
    # Once per article: copies of an article weigh as one.
    once = blocks.groupBy("host", "node", "text", "article").agg(F.max("chars").alias("chars"), F.max("links").alias("links"))
    per_article = once.groupBy("host", "node", "article").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    totals = per_article.groupBy("host", "node").agg(F.count("*").alias("articles"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    totals = _stored(totals, "page-slots")
    texts = once.groupBy("host", "node", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("t_chars"), F.sum("links").alias("t_links"))
    counted = texts.where(F.col("n") >= LEAST_ARTICLES).join(_small(totals.select("host", "node", "articles"), "host"), ["host", "node"])
    constant = _stored(counted.where(F.col("n") >= CONSTANT_SHARE * F.col("articles")), "page-constants")
    # Lists per host are bounded: by the template's nodes, and by the texts that fit on most pages.
    gone = constant.groupBy("host", "node").agg(F.sum("t_chars").alias("t_chars"), F.sum("t_links").alias("t_links"))
    varying = totals.join(gone, ["host", "node"], "left").select(
        "host", "node", "articles",
        (F.col("chars") - F.coalesce("t_chars", F.lit(0))).alias("chars"), (F.col("links") - F.coalesce("t_links", F.lit(0))).alias("links"),
    )
    slots = varying.groupBy("host").agg(F.collect_list(F.struct("node", "articles", "chars", "links")).alias("slots"))
    constants = constant.groupBy("host").agg(F.collect_list("text").alias("constants"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chosen = []
            for text, stats in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                chosen.append(content_nodes(dom.loads(text), {s["node"]: (s["articles"], s["chars"], s["links"]) for s in stats or ()}))
            lists = [pa.array([c[k] for c in chosen], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, b.column(3)], ["host", "keep", "away", "constants"])

    joined = templates.join(slots, "host", "left").join(constants, "host", "left")
    rows = joined.select("host", "template", "slots", F.coalesce("constants", F.array().cast("array<long>")).alias("constants"))
    return rows.mapInArrow(decide, "host string, keep array<int>, away array<int>, constants array<long>")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, host) of every row of ``pages``."""
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"),
    )
    templates = host_templates(source)
    placed = _stored(_place(source.join(_small(templates, "host", "template"), "host")), "page-blocks")
    wrappers = _stored(_wrappers(placed, templates), "page-wrappers")
    rows = placed.join(_small(wrappers, "host", "keep", "away", "constants"), "host", "left")
    own = F.filter("blocks", lambda b: (b["node"] >= 0) & ~F.array_contains("constants", F.xxhash64(b["node"], b["text"])))
    rows = rows.withColumn("own", own)
    main = F.filter("own", lambda b: F.array_contains("keep", b["node"]))
    # A page of another build than its host's others, without the content node: its running text.
    other = F.filter("own", lambda b: ~F.array_contains("away", b["node"]) & (2 * b["links"] < F.length(b["text"])))
    rows = rows.withColumn("main", main).withColumn("chosen", F.when(F.size("main") > 0, F.col("main")).otherwise(other))
    text = F.coalesce(F.array_join(F.transform("chosen", lambda b: b["text"]), "\n"), F.lit(""))
    return rows.select("page_id", "url", text.alias("text"), "host").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host"
    )


def op13_page_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
