"""Rectangles, matrices and page coordinates as column expressions.

A rectangle is four columns (or a struct) x, y, width, height with y upwards.
Three overlap rules are kept apart: strict (sharing an edge is none), strict
with a slack, and containment with a slack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of the editor's rules, grid, margin and least growth of widened boxes.
SLACK = 0.05
GRID, MARGIN, LEAST_GROWTH = 72.0, 18.0, 36.0


class Rect:
    """Column access to a rectangle named by a prefix: ``Rect("r_")`` is r_x, r_y, r_width, r_height."""

    def __init__(self, prefix: str = "", **columns: Column) -> None:
        get = lambda name: columns.get(name, F.col(f"{prefix}{name}") if name not in columns else None)
        self.x, self.y, self.width, self.height = get("x"), get("y"), get("width"), get("height")

    @property
    def right(self) -> Column:
        return self.x + self.width

    @property
    def top(self) -> Column:
        return self.y + self.height

    def overlaps(self, other: "Rect", shrink: float = 0.0) -> Column:
        """Strict overlap, by more than ``shrink``."""
        return (self.x < other.right - shrink) & (other.x < self.right - shrink) & (self.y < other.top - shrink) & (other.y < self.top - shrink)

    def covers(self, other: "Rect", slack: float = SLACK) -> Column:
        """The other lies within, edges and a slack included."""
        return (other.x >= self.x - slack) & (other.right <= self.right + slack) & (other.y >= self.y - slack) & (other.top <= self.top + slack)

    def holds(self, x: Column, y: Column) -> Column:
        """A point lies within, edges included."""
        return x.between(self.x, self.right) & y.between(self.y, self.top)

    def centre(self) -> tuple[Column, Column]:
        return self.x + self.width / 2, self.y + self.height / 2

    def padded(self, by: float) -> "Rect":
        return Rect(x=self.x - by, y=self.y - by, width=self.width + 2 * by, height=self.height + 2 * by)

    def intersection(self, other: "Rect") -> Column:
        """A struct, or null where the two do not overlap."""
        x, y = F.greatest(self.x, other.x), F.greatest(self.y, other.y)
        width, height = F.least(self.right, other.right) - x, F.least(self.top, other.top) - y
        return F.when((width > 0) & (height > 0), F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height")))

    def union(self, other: "Rect") -> Column:
        x, y = F.least(self.x, other.x), F.least(self.y, other.y)
        return F.struct(x.alias("x"), y.alias("y"), (F.greatest(self.right, other.right) - x).alias("width"), (F.greatest(self.top, other.top) - y).alias("height"))


def quantized(box: Rect, page: Rect) -> tuple[Column, Column]:
    """(x, width) of a box widened to the grid: it covers the original and stays on the page."""
    most = F.greatest(box.width, page.width)
    width = F.least(F.greatest(F.ceil((box.width + LEAST_GROWTH) / GRID) * F.lit(GRID), box.width), most)
    return F.least(F.greatest(F.least(box.x, page.right - width), page.x), box.x), width


def full_line(page: Rect) -> tuple[Column, Column]:
    """(x, width) of a box across the page between its margins."""
    return page.x + MARGIN, F.greatest(F.lit(1.0), page.width - 2 * MARGIN)


def to_display(fx: Column, fy: Column, rotation: Column) -> tuple[Column, Column]:
    """Fractions of the unrotated page (from left and bottom) to fractions of what is shown (from left and top)."""
    turn = lambda plain, quarter, half, three: F.when(rotation == 90, quarter).when(rotation == 180, half).when(rotation == 270, three).otherwise(plain)
    return turn(fx, fy, 1 - fx, 1 - fy), turn(1 - fy, fx, fy, 1 - fx)


def to_page(u: Column, v: Column, rotation: Column) -> tuple[Column, Column]:
    """The inverse of ``to_display``."""
    turn = lambda plain, quarter, half, three: F.when(rotation == 90, quarter).when(rotation == 180, half).when(rotation == 270, three).otherwise(plain)
    return turn(u, v, 1 - u, 1 - v), turn(1 - v, u, v, 1 - u)


def normal_rotation(degrees: Column) -> Column:
    """0, 90, 180 or 270, by flooring to a quarter turn."""
    return (F.pmod(F.floor(degrees / 90), F.lit(4)) * 90).cast("int")


def multiplied(m: Column, n: Column) -> Column:
    """Product of two matrices a..f for row vectors: m first, then n."""
    a, b, c, d, e, f = (F.element_at(m, i) for i in range(1, 7))
    p, q, r, s, t, u = (F.element_at(n, i) for i in range(1, 7))
    return F.array(a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def inverted(m: Column) -> Column:
    """The inverse, or null if there is none."""
    a, b, c, d, e, f = (F.element_at(m, i) for i in range(1, 7))
    det = a * d - b * c
    return F.when(det != 0, F.array(d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det))


def transformed(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = (F.element_at(m, i) for i in range(1, 7))
    return a * x + c * y + e, b * x + d * y + f


def bounds(m: Column, box: Rect) -> Column:
    """Bounding box of a transformed rectangle."""
    corners = [transformed(m, x, y) for x in (box.x, box.right) for y in (box.y, box.top)]
    xs, ys = [x for x, _ in corners], [y for _, y in corners]
    return F.struct(F.least(*xs).alias("x"), F.least(*ys).alias("y"), (F.greatest(*xs) - F.least(*xs)).alias("width"), (F.greatest(*ys) - F.least(*ys)).alias("height"))


#: Fixed margin of labels, and the corners by name, after dropping dashes and underscores.
LABEL_MARGIN = 24.0
CORNERS = {"topleft": "TopLeft", "topcenter": "TopCenter", "topcentre": "TopCenter", "topright": "TopRight", "bottomleft": "BottomLeft", "bottomcenter": "BottomCenter", "bottomcentre": "BottomCenter", "bottomright": "BottomRight"}


def corner_of(name: Column) -> Column:
    """One of six corners; any unknown name is the bottom right."""
    table = F.create_map(*[F.lit(x) for pair in CORNERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[-_]", "")), F.lit("BottomRight"))


def anchor(corner: Column, page: Rect, width: Column, size: Column) -> tuple[Column, Column]:
    """Where a label of that width and height starts."""
    x = F.when(corner.endswith("Left"), page.x + LABEL_MARGIN).when(corner.endswith("Center"), page.x + (page.width - width) / 2).otherwise(page.right - LABEL_MARGIN - width)
    y = F.when(corner.startswith("Top"), page.top - LABEL_MARGIN - size).otherwise(page.y + LABEL_MARGIN)
    return x, y


def fitted_size(width: Column, height: Column, width_per_point: Column) -> Column:
    """Font size at which a text spans four fifths of the page's diagonal, from 8 to 200."""
    diagonal = F.sqrt(width * width + height * height)
    return F.least(F.lit(200.0), F.greatest(F.lit(8.0), 0.8 * diagonal / width_per_point))


def rgb(colour: Column) -> Column:
    """A struct of three fractions from #rrggbb, or null."""
    code = F.regexp_extract(F.coalesce(colour, F.lit("")), "^#?([0-9a-fA-F]{6})$", 1)
    part = lambda at: F.conv(F.substring(code, at, 2), 16, 10).cast("double") / 255
    return F.when(code != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))
