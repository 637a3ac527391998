"""Pages to elements: one tag walk a page over Arrow batches, everything after it in DataFrame functions.

A page's elements come as one array in document order, so a plan of fallbacks is decided inside the
row of its page, without a shuffle.  Tables come as grids: a merged cell stands at every place that
it covers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import parse_date
from .batches import bound_batches, pieces

CELL = "text: string, href: string, header: boolean, origin: boolean"
ELEMENT = (
    "pos: int, tag: string, class: string, text: string, href: string, link: string, head: string, head_href: string, teaser: string, stamp: string,"
    f" dated: string, under: int, grid: int, line: int, part: string, cells: array<struct<{CELL}>>, names: array<string>"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _struct(fields: str) -> pa.DataType:
    return pa.struct([(n, _KINDS[k]) for n, k in (x.split(": ") for x in fields.split(", "))])


_KINDS[f"array<struct<{CELL}>>"] = pa.list_(_struct(CELL))
ELEMENTS = pa.list_(pa.struct([(n, _KINDS[k]) for n, k in re.findall(r"(\w+): (array<struct<.*?>>|array<string>|\w+)", ELEMENT)]))
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h2", "h3", "h4"}
KEPT = {"article", "li", "tr", "a"} | HEADINGS
# closed by the start of the same kind of element in the same container
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"td", "th", "li", "article", "div"})}
IMPLIED |= dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}))
# Classes of cards and of teasers in the listings
CARDS = {"views-row", "listing__item", "news-item", "node--type-news", "ecl-content-item", "listing-item", "ecl-list__item"}
TEASERS = {"field--name-field-summary", "summary__summary", "summary", "ecl-content-item__description"}
BLOCK = 1000


def _squeeze(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def _span(attrs: dict, name: str, most: int) -> int:
    text = (attrs.get(name) or "").strip()
    return min(int(text), most) if text.isascii() and text.isdigit() else 1


def grid_of(rows: list[tuple[str, list[tuple[str, str | None, bool, int, int]]]]) -> list[list[dict]]:
    """Cells (text, href, header, rowspan, colspan) of rows (part, cells) placed on a grid.

    A span of rows ends with its part of the table; a row span of 0 covers the rest of the part."""
    out, held, last = [], {}, None
    for part, cells in rows:
        if part != last:
            held, last = {}, part
        line, at, todo = [], 0, iter(cells)
        cell = next(todo, None)
        while cell is not None or at in held:
            if at in held:
                left, kept = held.pop(at)
                line.append(kept)
                if left != 1:
                    held[at] = (left - 1, kept)
                at += 1
                continue
            text, href, header, down, across = cell
            for i in range(max(across, 1)):
                placed = {"text": text, "href": href, "header": header, "origin": i == 0}
                line.append(placed)
                if down != 1:
                    held[at] = (down - 1, placed)
                at += 1
            cell = next(todo, None)
        out.append(line)
    return out


def column_names(rows: list[str], grid: list[list[dict]]) -> list[str] | None:
    """Names from the leading heading rows: of several levels, joined; None without any."""
    heads = []
    for part, line in zip(rows, grid, strict=True):
        if not line or not (part == "thead" or all(c["header"] for c in line)):
            break
        heads.append(line)
    if not heads:
        return None
    levels = [[h[i]["text"] for h in heads if i < len(h)] for i in range(max(map(len, heads)))]
    return [" ".join(dict.fromkeys(x)) for x in levels]


class _Walk(HTMLParser):
    """Gathers a page's elements; ``pos`` counts those that are kept, so it is their place in the array."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.open: list[dict] = []  # those of the stack that gather text
        self.mute = 0
        self.done: list[dict] = []
        self.under, self.count, self.tables = None, 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        closes, border = IMPLIED.get(tag, (set(), set()))
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] in closes:
                self.shut(i)
            elif self.stack[i]["tag"] in border:
                break
        names = set((a.get("class") or "").split())
        kept = tag in KEPT or bool(names & CARDS)
        e = {"tag": tag, "class": " ".join(sorted(names)), "attrs": a, "names": names, "kept": kept, "under": self.under}
        e["dates"] = bool(re.search(r"\bdate\b", e["class"], re.I))
        e["collects"] = kept or e["dates"] or tag in ("td", "th", "p", "time") or bool(names & TEASERS)
        if tag == "li" and any("item-list" in x["names"] for x in self.stack):
            e["class"] = f"{e['class']} in-item-list".strip()
        if tag == "table":
            e["rows"], e["index"] = [], self.tables
            self.tables += 1
        if e["collects"]:
            e |= {"text": [], "pos": self.count}
            self.count += kept
            self.open.append(e)
        self.mute += tag in ("script", "style")
        self.stack.append(e)

    def handle_data(self, data):
        if data.strip() and not self.mute:
            for e in self.open:
                e["text"].append(data)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] == tag:
                return self.shut(i)
            if self.stack[i]["tag"] == "table":
                return None
        return None

    def shut(self, to: int) -> None:
        while len(self.stack) > to:
            self.leave(self.stack.pop())

    def leave(self, e: dict) -> None:
        tag, a, text = e["tag"], e["attrs"], ""
        self.mute -= tag in ("script", "style")
        if e["collects"]:
            text = _squeeze(e["text"])
            self.open.pop()

        def tell(**found):
            for x in self.open:
                if not x.keys() & found.keys():
                    x.update(found)

        if tag == "a" and a.get("href") is not None:
            e |= {"href": a["href"], "link": text}
            tell(href=a["href"], link=text)
        if tag in HEADINGS:
            tell(head=text, head_href=e.get("href"))
            self.under = e["pos"]
        if tag == "time":
            tell(stamp=(a.get("datetime") or text))
        if tag == "p" or e["names"] & TEASERS:
            tell(teaser=text)
        if e["dates"]:
            tell(dated=text)
        table = next((x for x in reversed(self.stack) if x["tag"] == "table"), None) if tag == "tr" else None
        if tag in ("td", "th"):
            row = next((x for x in reversed(self.stack) if x["tag"] == "tr"), None)
            if row is not None:
                row.setdefault("cells", []).append((text, e.get("href"), tag == "th", _span(a, "rowspan", 65534), _span(a, "colspan", 1000)))
        if tag == "tr" and table is not None:
            part = next((x["tag"] for x in reversed(self.stack) if x["tag"] in ("thead", "tbody", "tfoot", "table")), "table")
            e |= {"part": part, "grid": table["index"], "line": len(table["rows"])}
            table["rows"].append(e)
        if tag == "table":
            parts = [x["part"] for x in e["rows"]]
            grid = grid_of([(x["part"], x.get("cells", [])) for x in e["rows"]])
            names = column_names(parts, grid)
            for row, line in zip(e["rows"], grid, strict=True):
                row["grid_cells"], row["grid_names"] = line, names
                names = None  # on the first row alone: texts are not copied to all rows
        if e["kept"]:
            e["joined"] = text
            self.done.append(e)

    def elements(self) -> list[dict]:
        self.shut(0)
        get = ("href", "link", "head", "head_href", "teaser", "stamp", "dated", "grid", "line", "part")
        return [
            {"pos": e["pos"], "tag": e["tag"], "class": e["class"], "text": e["joined"], "under": e["under"], "cells": e.get("grid_cells"), "names": e.get("grid_names")} | {k: e.get(k) for k in get}
            for e in sorted(self.done, key=lambda e: e["pos"])
        ]


def walked(html: str | None) -> list[dict]:
    """Elements of one page; a null page has none."""
    w = _Walk()
    w.feed(html or "")
    w.close()  # an unfinished tag at the end is text
    return w.elements()


def _walk_with(kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = pa.array([walked(x) for x in part.column("html").to_pylist()], ELEMENTS)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), found], names=[*kept, "elements"])

    return walk


def elements(pages: DataFrame) -> DataFrame:
    """The pages without ``html`` and with ``elements``, an array in document order.

    ``under`` is the place of the heading above, ``names`` stands on a table's first row.  Texts are whole,
    whatever their length; that of a merged cell is repeated at each place it covers, that of nested
    elements in each of them.  A null page has no elements.  A worker holds the elements of few pages at a time."""
    bound_batches(pages.sparkSession)
    kept = [f for f in pages.schema if f.name != "html"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    return pages.mapInArrow(_walk_with([f.name for f in kept]), ", ".join(filter(None, [schema, f"elements array<struct<{ELEMENT}>>"])))


Rung = Callable[[Column], Column]


def first_rung(*rungs: Rung) -> Column:
    """struct(rung, found): elements that meet the first condition that any element of the page meets.

    ``coalesce`` asks a later condition only of pages that have no element yet; null if none has."""
    tried = [F.filter("elements", r) for r in rungs]
    some = [F.get(F.filter(F.array(F.struct(F.lit(i).alias("rung"), t.alias("found"))), lambda x: F.size(x["found"]) > 0), 0) for i, t in enumerate(tried)]
    return F.coalesce(*some)


def climb(pages: DataFrame, *rungs: Rung) -> DataFrame:
    """A row an element of each page's first rung: the page's columns, rung and the element's."""
    d = elements(pages)
    keep = [c for c in d.columns if c != "elements"]
    d = d.select(*keep, "elements", F.explode(F.array(first_rung(*rungs))).alias("w"))
    found = F.transform("w.found", lambda e: F.struct(e.alias("e"), heading_of(e).alias("heading")))
    return d.select(*keep, "w.rung", F.explode(found).alias("x")).select(*keep, "rung", "x.e.*", "x.heading")


def heading_of(e: Column) -> Column:
    """Text of the heading above an element, empty without one."""
    return F.coalesce(F.get(F.col("elements"), e["under"])["text"], F.lit(""))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that later expressions name them instead of holding copies."""
    made = F.struct(*[c.alias(k) for k, c in columns.items()])
    return rows.select("*", F.explode(F.array(made)).alias("_x")).select("*", "_x.*").drop("_x")


def is_card(e: Column) -> Column:
    """An element of a card class, not counted by its tag."""
    return F.arrays_overlap(F.split(e["class"], " "), F.array(*map(F.lit, sorted(CARDS))))


DAY_MONTH = r"(?i)\b(\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})\b"
ISO_DAY = r"\b(\d{4}-\d{2}-\d{2})\b"


def stated_date() -> Column:
    """Date of an element: a time element, an element of class ``date``, a day with a month's name,
    an ISO day; the first that parses."""
    named = F.initcap(F.regexp_replace(F.regexp_extract("text", DAY_MONTH, 1), r"\s+", " "))
    return F.coalesce(parse_date("stamp"), parse_date("dated"), parse_date(named), parse_date(F.regexp_extract("text", ISO_DAY, 1)))


def table_rows(pages: DataFrame, listing: str = "listing", page: str = "page") -> DataFrame:
    """Data rows of all tables with the names of their columns: the page's columns, grid, line, part,
    text, href, cells, names (null without any).

    A listing's table may go on over pages: one without a heading takes that of the listing's last table
    with one, and rows that repeat a heading are dropped.  Headings are carried over blocks of a
    thousand pages first, so no task sorts a whole listing.  (listing, page) names a page; a page without a
    listing or number takes no heading from others."""
    d = elements(pages)
    keep = [c for c in d.columns if c != "elements"]
    named = F.transform(F.filter("elements", lambda e: e["names"].isNotNull()), lambda e: F.struct(e["grid"].alias("grid"), e["names"].alias("names")))
    rows = d.select(*keep, F.filter("elements", lambda e: F.size(e["cells"]) > 0).alias("r"), named.alias("named"))
    rows = rows.withColumn("own", F.get(F.reverse("named"), 0)["names"]).withColumn("block", F.floor(F.col(page) / BLOCK))
    # dealt once, so that both readers of the headings share one walk
    heads = rows.select(listing, page, "block", "own").repartition(listing, "block")
    ends = heads.groupBy(listing, "block").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col(page))).alias("end"))
    before = F.last("end", True).over(Window.partitionBy(listing).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = ends.select(listing, "block", before.alias("before"))
    w = Window.partitionBy(listing, "block").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.withColumn("carried", F.last("own", True).over(w)).join(blocks, [listing, "block"], "left")
    # headings travel without the pages' rows; pages are joined to what they need
    carried = carried.select(listing, page, F.coalesce("carried", "before").alias("carried")).where("carried is not null")
    rows = rows.drop("own", "block").join(carried, [listing, page], "left")
    # the last named table of the page up to the row's own, else of the pages before
    e = rows.select(*keep, "named", "carried", F.explode("r").alias("e")).select(*keep, "named", "carried", "e.*")
    near = F.get(F.reverse(F.filter("named", lambda x: x["grid"] <= F.col("grid"))), 0)["names"]
    e = e.withColumn("names", F.coalesce(near, "carried")).drop("named", "carried")
    texts = F.transform("cells", lambda x: x["text"])
    heading = (F.col("part") == "thead") | F.forall("cells", lambda x: x["header"]) | F.coalesce(texts == F.col("names"), F.lit(False))
    return e.where(~heading).select(*keep, "grid", "line", "part", "text", "href", "cells", "names")


def cell_named(pattern: str, otherwise: int) -> Column:
    """Text of the cell under the first column whose name matches, else of that place."""
    at = F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.get("names", i).rlike(pattern))
    place = F.when(F.size("names") > 0, F.coalesce(F.get(at, 0), F.lit(otherwise))).otherwise(otherwise)
    return F.get("cells", place)["text"]
