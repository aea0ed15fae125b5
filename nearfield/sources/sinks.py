"""Writers: tables stay distributed; only curves and cards, a handful of rows, come to the driver."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables with more rows than this are not written by the capped sinks (fixed value).
CAP = 2_000_000


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header (S9); an empty table raises ``ValueError``."""
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def union_of_keys(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables with different columns as one (S9): the columns of all in the order of their first appearance, null where a table lacks one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_edge_chunks(edges: DataFrame, path: str, chunks: int) -> int:
    """Edges ``i, j, w`` in chunks of their first node, partitioned by ``chunk`` (S6), with their number."""
    chunked = edges.select("i", "j", "w", F.pmod(F.xxhash64("i"), F.lit(chunks)).cast("int").alias("chunk"))
    chunked.repartition(chunks, "chunk").write.mode("overwrite").partitionBy("chunk").parquet(path)
    return edges.sparkSession.read.parquet(path).count()


def write_capped(df: DataFrame, path: str, cap: int = CAP) -> dict:
    """The table if it has at most ``cap`` rows, else nothing but a note (S15, S16): ``rows, written, note``."""
    n = df.count()
    if n > cap:
        return {"rows": n, "written": False, "note": f"{n} rows exceed {cap}"}
    df.write.mode("overwrite").parquet(path)
    return {"rows": n, "written": True, "note": ""}


def write_splits(splits: DataFrame, path: str) -> None:
    """Splits partitioned by parameter and repeat (S13), both kept as columns of the reader."""
    splits.write.mode("overwrite").partitionBy("param", "repeat").parquet(path)


def _plain(value):
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_json(payload: dict, path: str) -> None:
    """A card as JSON with sorted keys."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True, default=str), encoding="utf-8")


#: Most points of a curve that is drawn or written as a card.
MOST_POINTS = 10_000


def curve_rows(curve: DataFrame) -> list[dict]:
    """The points of a curve, in the order of novelty (W13); a curve has a handful of rows, and one of more than ``MOST_POINTS`` is refused."""
    rows = curve.orderBy(F.asc_nulls_first("mean_novelty"), "subset").limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points: write the curve as a table")
    return [{k: _plain(v) for k, v in r.asDict().items()} for r in rows]


def svg_curve(rows: Sequence[dict], metric: str, title: str, width: int = 860, height: int = 540) -> str:
    """A line chart of (mean novelty, metric) (S11); points without both numbers are left out."""
    pts = [(r["mean_novelty"], r[metric], str(r["subset"])) for r in rows if r.get("mean_novelty") is not None and r.get(metric) is not None]
    margin = 70
    body = [f'<text x="{width / 2}" y="30" text-anchor="middle" font-size="18">{escape(title)}</text>']
    if pts:
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        fit = lambda v, lo, hi, a, b: (a + b) / 2 if hi == lo else a + (v - lo) / (hi - lo) * (b - a)
        at = [(fit(x, min(xs), max(xs), margin, width - margin), fit(y, min(ys), max(ys), height - margin, margin), n) for x, y, n in pts]
        body.append('<polyline fill="none" stroke="#1f6fb2" stroke-width="2" points="' + " ".join(f"{x:.1f},{y:.1f}" for x, y, _ in at) + '"/>')
        body += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="4" fill="#1f6fb2"><title>{escape(n)}</title></circle>' for x, y, n in at]
    body.append(f'<text x="{width / 2}" y="{height - 20}" text-anchor="middle">mean novelty</text><text x="20" y="{height / 2}" transform="rotate(-90 20 {height / 2})">{escape(metric)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + "".join(body) + "</svg>"


def markdown_report(title: str, rows: Sequence[dict], columns: Sequence[str], notes: Sequence[str] = ()) -> str:
    """A report with one table."""
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]
    return "\n".join([*lines, "", *[f"- {n}" for n in notes]]) + "\n"


def audit_card(curve: DataFrame, contracts: dict, graph: dict | None = None) -> dict:
    """The card of an audit: curve, contracts, area and graph counts as one document."""
    return {"schema_version": "0.2.0", "curve": curve_rows(curve), "contracts": contracts, "graph": graph or {}}


#: Fields that a card must have (fixed values).
CARD_FIELDS = ("schema_version", "curve", "contracts")


def check_card(card: dict) -> list[str]:
    """Missing or empty fields of a card."""
    return [f for f in CARD_FIELDS if not card.get(f)]


def svg_scatter(rows: Sequence[dict], x: str, y: str, spread: str | None = None, width: int = 640, height: int = 480) -> str:
    """Split statistics as points over the parameter, with error bars if a spread column is given."""
    pts = [(r[x], r[y], r.get(spread) or 0.0 if spread else 0.0) for r in rows if r.get(x) is not None and r.get(y) is not None]
    body = []
    if pts:
        lo_x, hi_x = min(p[0] for p in pts), max(p[0] for p in pts)
        lo_y, hi_y = min(p[1] - p[2] for p in pts), max(p[1] + p[2] for p in pts)
        at = lambda v, lo, hi, a, b: (a + b) / 2 if hi == lo else a + (v - lo) / (hi - lo) * (b - a)
        for px, py, e in pts:
            cx = at(px, lo_x, hi_x, 60, width - 30)
            top, bottom = at(py + e, lo_y, hi_y, height - 60, 30), at(py - e, lo_y, hi_y, height - 60, 30)
            body.append(f'<line x1="{cx:.1f}" x2="{cx:.1f}" y1="{top:.1f}" y2="{bottom:.1f}" stroke="#888"/>' if e else "")
            body.append(f'<circle cx="{cx:.1f}" cy="{at(py, lo_y, hi_y, height - 60, 30):.1f}" r="4"/>')
    body.append(f'<text x="{width / 2}" y="{height - 15}" text-anchor="middle">{escape(x)}</text><text x="12" y="20">{escape(y)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + "".join(body) + "</svg>"
