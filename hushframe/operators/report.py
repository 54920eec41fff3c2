"""A static page of aggregates: small counts that the driver has already collected, everything escaped."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame

#: Names of one section that are shown; the rest is one row.
SHOWN = 12


def render(title: str, counts: Iterable[tuple[str, str, int]], lang: str = "en") -> str:
    """HTML of (section, name, n) rows, with bars as whole percent of each section's largest."""
    sections: dict[str, list[tuple[str, int]]] = {}
    for section, name, n in counts:
        sections.setdefault(section, []).append((name, n))
    body = []
    for section, rows in sections.items():
        rows = sorted(rows, key=lambda r: -r[1])
        rest = sum(n for _, n in rows[SHOWN:])
        rows = rows[:SHOWN] + ([("(other)", rest)] if rest else [])
        peak = max((n for _, n in rows), default=0) or 1
        lines = "".join(f'<tr><th scope="row">{html.escape(str(k))}</th><td>{n}</td><td><div class="bar" style="width:{round(100 * n / peak)}%"></div></td></tr>' for k, n in rows)
        body.append(f"<section><h2>{html.escape(section)}</h2><table>{lines}</table></section>")
    style = "body{font-family:sans-serif}.bar{background:#468;height:1em}th{text-align:left}"
    return f'<!DOCTYPE html><html lang="{html.escape(lang)}"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{"".join(body)}</body></html>'


def render_summary(title: str, summary: DataFrame, lang: str = "en") -> str:
    """The page of a summary (section, name, n), whose names are few by construction."""
    rows = summary.orderBy("section", "name").collect()
    return render(title, [(r["section"], r["name"], r["n"]) for r in rows], lang)
