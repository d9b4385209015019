"""Tables: first table of a text, tree-edit similarity, and the best pipe table that a table with spans allows."""

from __future__ import annotations

from functools import lru_cache
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Cell = tuple[str, int, int, str]  # tag, rowspan, colspan, text


class _FirstTable(HTMLParser):
    """Rows of cells of the first table. Sections (thead, tbody, tfoot) and column groups are no nodes of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[Cell]] | None = None
        self.depth, self.done, self.cell = 0, False, None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.rows = []
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            span = dict(attrs)
            size = [int(v) if (v := span.get(n) or "1").isdigit() and int(v) > 0 else 1 for n in ("rowspan", "colspan")]
            self.cell = [tag, *size, ""]

    def handle_endtag(self, tag):
        if self.done or not self.depth:
            return
        if tag == "table":
            self.depth -= 1
            if not self.depth:
                self._close()
                self.done = True
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[3] += data

    def _close(self):
        if self.cell is not None:
            self.rows[-1].append((*self.cell[:3], self.cell[3].strip()))
            self.cell = None


def first_table(html: str | None) -> list[list[Cell]] | None:
    if not html or "<table" not in html.lower():
        return None
    p = _FirstTable()
    p.feed(html)
    p.close()
    p._close() if p.rows else None
    return p.rows


def split_pipe_row(line: str) -> list[str]:
    cells, cur, i = [], "", 0
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    while i < len(line):
        if line[i] == "\\" and i + 1 < len(line) and line[i + 1] == "|":
            cur += "|"
            i += 1
        elif line[i] == "|":
            cells.append(cur.strip())
            cur = ""
        else:
            cur += line[i]
        i += 1
    return [*cells, cur.strip()] if cur.strip() else cells


def first_pipe_table(md: str | None) -> list[list[Cell]] | None:
    """The first table of a Markdown text: a pipe table with its rule below the header, or an HTML table before it."""
    lines = (md or "").split("\n")
    for i in range(len(lines) - 1):
        rule = split_pipe_row(lines[i + 1])
        if "|" in lines[i] and rule and all(c.strip(":") and set(c.strip(":")) == {"-"} for c in rule):
            before = first_table("\n".join(lines[:i]))
            if before is not None:
                return before
            head = split_pipe_row(lines[i])
            if len(head) != len(rule):
                continue
            rows = [[("th", 1, 1, c) for c in head]]
            for line in lines[i + 2 :]:
                if "|" not in line:
                    break
                cells = (split_pipe_row(line) + [""] * len(head))[: len(head)]
                rows.append([("td", 1, 1, c) for c in cells])
            return rows
    return first_table(md)


def to_html(rows: list[list[Cell]]) -> str:
    def cell(c: Cell) -> str:
        spans = "".join(f' {n}="{v}"' for n, v in (("rowspan", c[1]), ("colspan", c[2])) if v != 1)
        return f"<{c[0]}{spans}>{escape(c[3], quote=False)}</{c[0]}>"

    return "<table>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tree_distance(a: list[list[Cell]], b: list[list[Cell]], with_text: bool = True) -> float:
    """Ordered tree edit distance of two tables (root, rows, cells), unit costs, by dynamic programming over forests.

    Cells are renamed at 1 if tag or spans differ, else at the normalised edit distance of their texts (0 without texts).
    """

    def tree(rows):
        return ("table", tuple(("tr", tuple((c, ()) for c in r)) for r in rows))

    def size(forest):
        return sum(1 + size(n[1]) for n in forest)

    @lru_cache(maxsize=None)
    def rename(x, y) -> float:
        if isinstance(x, str) or isinstance(y, str):
            return 0.0 if x == y else 1.0
        if x[:3] != y[:3]:
            return 1.0
        if not with_text or x[3] == y[3]:
            return 0.0
        return edit_distance(x[3], y[3]) / max(len(x[3]), len(y[3]))

    @lru_cache(maxsize=None)
    def dist(f, g) -> float:
        if not f or not g:
            return float(size(f) + size(g))
        (x, fx), (y, gy) = f[-1], g[-1]
        return min(dist(f[:-1] + fx, g) + 1, dist(f, g[:-1] + gy) + 1, dist(f[:-1], g[:-1]) + dist(fx, gy) + rename(x, y))

    return dist((tree(a),), (tree(b),))


def teds(pred: list[list[Cell]], truth: list[list[Cell]], with_text: bool = True) -> float:
    nodes = max(1 + len(t) + sum(map(len, t)) for t in (pred, truth))
    return 1 - tree_distance(pred, truth, with_text) / nodes


def covered(rows: list[list[Cell]]) -> list[tuple[int, int, str]]:
    """(row, column, text) of every place that a cell covers. A row keeps, for each column, how many rows the cell above still reaches down."""
    out: list[tuple[int, int, str]] = []
    reach: list[int] = []  # by column, rows that are still covered from above
    for r, cells in enumerate(rows):
        free = (c for c in range(len(reach) + sum(x[2] for x in cells)) if c >= len(reach) or not reach[c])
        fresh: dict[int, int] = {}
        for _, down, right, text in cells:
            first = next(c for c in free if c not in fresh)
            places = range(first, first + right)
            out += [(r + i, c, text) for i in range(down) for c in places]
            fresh.update((c, max(down, fresh.get(c, 0))) for c in places)
        width = max([len(reach), *(c + 1 for c in fresh)])
        reach = [max((reach[c] if c < len(reach) else 0), fresh.get(c, 0)) for c in range(width)]
        reach = [max(n - 1, 0) for n in reach]
    return out


def best_pipe_table(rows: list[list[Cell]]) -> str:
    """The table as pipes, the text of a spanning cell in each place that it covers; of two cells in one place the later."""
    text = {(r, c): t for r, c, t in covered(rows)}
    if not text:
        return ""
    height, width = (max(place[k] for place in text) + 1 for k in (0, 1))
    lines = [f"| {' | '.join(text.get((r, c), '') for c in range(width))} |" for r in range(height)]
    lines.insert(1, "|" + "---|" * width)
    return "\n".join(lines)


SCORES = "struct<teds:double,teds_struct:double,no_table:boolean,status:string>"


def table_scores(truth: Column, pred: Column) -> Column:
    """Scores of the first tables of two Markdown texts, to four places: 0 with ``no_table`` if the second has none, a status if the first has none."""

    @F.pandas_udf(SCORES)
    def run(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(t, p, strict=True):
            x, y = first_pipe_table(a), first_pipe_table(b)
            if x is None:
                out.append((None, None, None, "NoTableInTruth"))
            elif y is None:
                out.append((0.0, 0.0, True, "ok"))
            else:
                out.append((round(teds(y, x), 4), round(teds(y, x, False), 4), False, "ok"))
        return pd.DataFrame(out, columns=["teds", "teds_struct", "no_table", "status"])

    return run(truth, pred)


def first_table_html(html: Column) -> Column:
    """The first table of each HTML text in normal form; null if there is none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if (t := first_table(h)) is None else to_html(t))

    return F.when(html.rlike("(?i)<table"), run(html))


def best_pipe_html(html: Column) -> Column:
    """The best pipe table of the first table of each HTML text, whatever its spans; null if there is none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if (t := first_table(h)) is None else best_pipe_table(t))

    return F.when(html.rlike("(?i)<table"), run(html))
