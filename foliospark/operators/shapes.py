"""Shapes of drawings and pages: connectors to the boxes they touch, order of reading, boxes scaled to pictures, sheets'
pages, batches of pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import SPACE, stripped

NEAR = 200_000


def distance(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """From a point to a rectangle; 0 inside."""
    dx, dy = F.greatest(x - px, F.lit(0), px - (x + w)).cast("double"), F.greatest(y - py, F.lit(0), py - (y + h)).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def _distances(x: np.ndarray, y: np.ndarray, right: np.ndarray, top: np.ndarray, at: tuple, to: tuple) -> np.ndarray:
    """``distance`` in numpy, with one point for the lower sides of rectangles and one for the upper ones."""
    dx = np.maximum(np.maximum(x - at[0], 0), to[0] - right).astype(float)
    dy = np.maximum(np.maximum(y - at[1], 0), to[1] - top).astype(float)
    return np.sqrt(dx * dx + dy * dy)


def nearest(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, small: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the nearest rectangle (the first of those equally far) and its distance.  Points are halved until
    few are left; on the way those rectangles go that no point of a part can be nearest to: another one's farthest point
    of the part is nearer, or as near and that one comes first."""
    found, far = np.zeros(len(px), np.int64), np.zeros(len(px))
    sides = x, y, x + w, y + h
    todo = [(np.arange(len(px)), np.arange(len(x)))] if len(px) and len(x) else []
    while todo:
        own, kept = todo.pop()
        here = [s[kept] for s in sides]
        low, high = (px[own].min(), py[own].min()), (px[own].max(), py[own].max())
        most, least = _distances(*here, low, high), _distances(*here, high, low)
        sure = int(most.argmin())  # the first one of the smallest; kept is in order
        kept = kept[(least < most[sure]) | ((least == most[sure]) & (kept <= kept[sure]))]
        wide = [high[i] - low[i] for i in (0, 1)]
        if not any(wide) or len(own) * len(kept) <= small:
            at = px[own, None], py[own, None]
            d = _distances(*(s[None, kept] for s in sides), at, at)
            best = d.argmin(1)
            found[own], far[own] = kept[best], d[np.arange(len(own)), best]
            continue
        line = (px if wide[0] >= wide[1] else py)[own]
        cut = np.partition(line, len(line) // 2)[len(line) // 2]
        left = line < cut if cut > line.min() else line <= cut
        todo += [(own[left], kept), (own[~left], kept)]
    return found, far


def edges(boxes: DataFrame, connectors: DataFrame, near: int = NEAR) -> DataFrame:
    """Of each connector (drawing, pos, name, sx, sy, ex, ey) whose two ends are within ``near`` of boxes (drawing, pos,
    text, x, y, w, h) with different texts: the texts of the nearest ones (ties: the first box) and the distances.
    Ends and boxes meet by drawing and by cell of a grid of ``near``, boxes of one place as their first; a cell's are no
    rows of pairs but searched by halves (``nearest``), so that the work grows little faster than the rows."""
    keys = ["drawing", "cx", "cy"]
    place = ["drawing", "x", "y", "w", "h"]
    b = boxes.filter(F.length("text") > 0).dropna(subset=place).groupBy(*place).agg(F.min(F.struct("pos", "text")).alias("b")).select(*place, F.col("b.pos").alias("box"), "b.text")
    cell = lambda c: F.floor(c / F.lit(near)).cast("long")
    # a box is in each cell that it or the space about it reaches
    reach = lambda lo, size: F.sequence(cell(F.col(lo) - near), cell(F.col(lo) + F.col(size) + near))
    placed = b.select("*", F.explode(reach("x", "w")).alias("cx")).select("*", F.explode(reach("y", "h")).alias("cy"))
    ends = connectors.select("drawing", F.col("pos").alias("connector"), "name", F.inline(F.array(F.struct(F.lit(0).alias("end"), F.col("sx").alias("px"), F.col("sy").alias("py")), F.struct(F.lit(1).alias("end"), F.col("ex").alias("px"), F.col("ey").alias("py")))))
    ends = ends.dropna(subset=["drawing", "px", "py"]).withColumn("cx", cell(F.col("px"))).withColumn("cy", cell(F.col("py")))
    kinds = {**dict(ends.dtypes), **dict(b.dtypes)}

    def meet(points: pa.Table, rects: pa.Table) -> pa.Table:
        rects = rects.sort_by([("box", "ascending"), ("text", "ascending")])
        if not rects.num_rows:
            points = points.slice(0, 0)
        i, d = nearest(*(points[c].to_numpy() for c in ("px", "py")), *(rects[c].to_numpy() for c in ("x", "y", "w", "h")))
        out = points.select(["drawing", "connector", "name", "end"])
        for c in ("box", "text"):
            out = out.append_column(c, rects[c].take(pa.array(i)))
        return out.append_column("d", pa.array(d)).filter(pa.array(d <= near))

    fields = ", ".join(f"{c} {kinds[c]}" for c in ("drawing", "connector", "name", "end", "box", "text"))
    met = ends.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(meet, f"{fields}, d double")
    pick = lambda end: F.min(F.when(F.col("end") == end, F.struct("d", "box", "text")))
    both = met.groupBy("drawing", "connector", "name").agg(pick(0).alias("a"), pick(1).alias("z"))
    both = both.select("drawing", "connector", "name", F.col("a.text").alias("source"), F.col("z.text").alias("target"), F.col("a.d").alias("start_dist"), F.col("z.d").alias("end_dist"))
    return both.filter("source is not null and target is not null and source <> target")


def edge_table(found: DataFrame) -> DataFrame:
    """drawing and a Markdown table of its edges in order of their connectors."""
    row = F.concat(F.lit("| "), F.col("source"), F.lit(" | → | "), F.col("target"), F.lit(" | "), F.col("name"), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("connector", row.alias("row")))), lambda x: x["row"]), "\n")
    return found.groupBy("drawing").agg(F.concat(F.lit("### Connectors\n\n| Source | → | Target | Connector |\n| :--- | :---: | :--- | :--- |\n"), rows).alias("markdown"))


def reading_order(shapes: DataFrame) -> DataFrame:
    """shapes (page, top, left, pos) with their place on the page: from the top, then from the left; missing is 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy(F.coalesce("top", F.lit(0)), F.coalesce("left", F.lit(0)), "pos")
    return shapes.withColumn("place", F.row_number().over(w))


def on_picture(l: Column, t: Column, r: Column, b: Column, page_width: Column, page_height: Column, picture_width: Column) -> Column:  # noqa: E741
    """A box in points, from the page's lower left corner, as pixels from the picture's upper left one."""
    s = picture_width / page_width
    top = lambda y: (page_height - y) * s
    return F.struct((l * s).alias("x0"), F.least(top(t), top(b)).alias("y0"), (r * s).alias("x1"), F.greatest(top(t), top(b)).alias("y1"))


def boxes_by_page(items: DataFrame) -> DataFrame:
    """page and its boxes (places to one decimal, 60 characters of text), in order of pos."""
    one = F.struct("pos", "label", *[F.round(c, 1).alias(c) for c in ("l", "t", "r", "b")], F.substring("text", 1, 60).alias("text_preview"))
    return items.groupBy("page").agg(F.array_sort(F.collect_list(one)).alias("boxes"))


def hidden(items: DataFrame) -> DataFrame:
    """One row: elements in the invisible and in the background layer."""
    return items.agg(F.count_if(F.col("layer") == "invisible").alias("hidden"), F.count_if(F.col("layer") == "background").alias("background"))


def page_pictures(elements: DataFrame, embedded: DataFrame) -> DataFrame:
    """page and its number of pictures: as many as either list (page) has."""
    a = elements.groupBy("page").agg(F.count("*").alias("a"))
    b = embedded.groupBy("page").agg(F.count("*").alias("b"))
    return a.join(b, "page", "full_outer").select("page", F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("pictures"))


def title_key(name: Column) -> Column:
    return stripped(F.regexp_replace(name, f"{SPACE}+", " "))


def sheet_pages(sheets: DataFrame, outline: DataFrame) -> DataFrame:
    """sheet and the page where it begins: outlines' (pos, level, title, page) first entries of level 1 with its name;
    of sheets (pos, sheet) with one name, white space aside, the last."""
    named = sheets.groupBy(title_key(F.col("sheet")).alias("key")).agg(F.max_by("sheet", "pos").alias("sheet"))
    first = outline.filter("level = 1 and title is not null and page is not null").groupBy(title_key(F.col("title")).alias("key")).agg(F.min_by("page", "pos").alias("page"))
    return named.join(first, "key").select("sheet", "page")


def page_batches(pages: DataFrame, most: int = 20) -> DataFrame:
    """pages (doc_id, page) in order, with the number of their batch of at most ``most`` pages."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("page")
    return pages.withColumn("batch", F.floor((F.row_number().over(w) - 1) / most).cast("int"))
