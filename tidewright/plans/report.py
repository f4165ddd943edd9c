"""Reports of small collected results: text, Markdown, JSON and a static HTML page."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Sequence

SCHEMA_VERSION = 1
_COLUMNS = (
    ("Stage", "name"),
    ("Sharpe", "sharpe"),
    ("P(edge)", "p_edge"),
    ("Total", "total_return"),
    ("Ann.", "annual_return"),
    ("Max DD", "max_drawdown"),
    ("Trades", "n_trades"),
    ("Chosen", "chosen"),
)


def plain(value):
    """JSON-safe copy: numbers that aren't finite become null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def document(kind: str, **parts) -> dict:
    """A result as a versioned document: study, audit, sweep, cpcv or leaks."""
    return {"schema_version": SCHEMA_VERSION, "kind": kind, **parts}


def to_json(document: dict) -> str:
    return json.dumps(plain({"schema_version": SCHEMA_VERSION, **document}), indent=2, allow_nan=False)


def probability(p: float) -> str:
    return ">99.9%" if p > 0.999 else "<0.1%" if p < 0.001 else f"{p:.1%}"


def _chosen(text: str) -> str:
    """Distinct values per parameter, in fold order."""
    settings = json.loads(text)
    return ", ".join(
        f"{k}=" + "/".join(f"{s[k]:g}" for s in settings) for k in settings[0]
    ) if settings and settings[0] else "-"


def _cells(row: dict) -> list[str]:
    pct = lambda v: f"{v:+.1%}"
    shown = {
        "sharpe": lambda v: f"{v:.2f}", "p_edge": probability, "total_return": pct, "annual_return": pct, "max_drawdown": pct, "n_trades": str, "chosen": _chosen, "name": str
    }
    return [shown[c](row[c]) for _, c in _COLUMNS]


def render_table(rows: Sequence[dict]) -> str:
    table = [[h for h, _ in _COLUMNS], *map(_cells, rows)]
    width = [max(len(r[i]) for r in table) for i in range(len(_COLUMNS))]
    lines = [
        "  ".join(
            c.ljust(w) if i in (0, 7) else c.rjust(w) for i, (c, w) in enumerate(zip(r, width, strict=True))
        ).rstrip() for r in table
    ]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])


def render_markdown(rows: Sequence[dict]) -> str:
    head = "| " + " | ".join(h for h, _ in _COLUMNS) + " |"
    return "\n".join([head, "|" + "---|" * len(_COLUMNS), *("| " + " | ".join(_cells(r)) + " |" for r in rows)])


def render_costs(row: dict) -> str:
    per = lambda v: v / row["notional"] * 1e4 if row["notional"] else 0.0
    return f"{row['n_trades']} trades, notional {row['notional']:,.0f}: commission {row['commission']:,.0f} ({per(row['commission']):.2f} bp), slippage {row['slippage']:,.0f} ({per(row['slippage']):.2f} bp), turnover {row['turnover']:.1f} a year"


def render_cpcv(summary: dict, walk_forward: float | None = None) -> str:
    said = f"{summary['n_paths']} paths: median {summary['median']:.2f}, quartiles {summary['lower']:.2f} to {summary['upper']:.2f}, range {summary['min']:.2f} to {summary['max']:.2f}, {summary['n_below_zero']} below zero ({summary['share_below_zero']:.0%})"
    return said + (f"; walk-forward {walk_forward:.2f}" if walk_forward is not None else "")


def render_sweep(rows: Sequence[dict]) -> str:
    return "\n".join(
        f"{r['name']:<24} mean {r['mean']:6.2f}  sd {r['sd']:5.2f}  t {r['t']:7.2f}  n {r['n']}" for r in rows
    )


def t_statistic(sharpe: float, n_returns: int, bars_per_year: float = 252) -> float:
    return sharpe * math.sqrt(n_returns / bars_per_year)


def verdict(sharpe: float, n_returns: int, bars_per_year: float = 252) -> str:
    t = t_statistic(sharpe, n_returns, bars_per_year)
    return f"out-of-sample t = {t:.2f}: " + (
        "distinguishable from zero" if abs(t) > 2 else "not distinguishable from zero"
    )


def render_audit(rows: Sequence[dict], leak_summary: str, cpcv: dict | None = None, markdown: bool = False) -> str:
    last = rows[-1]
    parts = [
        leak_summary,
        (render_markdown if markdown else render_table)(rows),
        f"buy and hold: {last['buy_hold_sharpe']:.2f}",
        render_costs(last),
        verdict(last["sharpe"], last["n_returns"]),
    ]
    if cpcv:
        parts.append(render_cpcv(cpcv, last["sharpe"]))
    return "\n\n".join(parts)


def downsample(n: int, most: int = 500) -> list[int]:
    return list(range(n)) if n <= most else sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})


def _bars_svg(rows: Sequence[dict], width: int = 720, bar: int = 26) -> str:
    top = max([abs(r["sharpe"]) for r in rows] + [1e-9])
    zero, scale, parts = 260 + (width - 300) * 0.3, (width - 300) * 0.6 / top, []
    for i, r in enumerate(rows):
        x, w = (zero, r["sharpe"] * scale) if r["sharpe"] >= 0 else (zero + r["sharpe"] * scale, -r["sharpe"] * scale)
        parts.append(
            f'<text x="0" y="{i * bar + 17}">{html.escape(r["name"])}</text><rect x="{x:.1f}" y="{i * bar + 4}" width="{max(w, 1):.1f}" height="{bar - 8}" fill="{"#2a7" if r["honest"] else "#89a"}"/><text x="{width - 60}" y="{i * bar + 17}">{r["sharpe"]:.2f}</text>'
        )
    return f'<svg viewBox="0 0 {width} {len(rows) * bar}" width="{width}" role="img">{"".join(parts)}</svg>'


def _ticks(low: float, high: float, n: int = 4) -> list[float]:
    """Round numbers between low and high."""
    step = 10.0 ** math.floor(math.log10(max(high - low, 1e-12) / n))
    step *= next((m for m in (1, 2, 5, 10) if (high - low) / (step * m) <= n + 1), 10)
    return [k * step for k in range(math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9) + 1)]


def _axis(low: float, high: float, height: int, left: int, width: int, show="{:.3g}") -> tuple[str, object]:
    """Grid lines with labels, and the place of a value."""
    at = lambda v: 8 + (high - v) / max(high - low, 1e-12) * (height - 28)
    lines = "".join(
        f'<line x1="{left}" x2="{width}" y1="{at(v):.1f}" y2="{at(v):.1f}" stroke="#ddd"/><text x="{left - 6}" y="{at(v) + 4:.1f}" text-anchor="end">{show.format(v)}</text>' for v in _ticks(low, high)
    )
    return lines, at


def _frame(body: str, width: int, height: int, title: str) -> str:
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" role="img" aria-label="{html.escape(title)}"><title>{html.escape(title)}</title>{body}</svg>'


def equity_svg(points: Sequence[float], width: int = 720, height: int = 220, log: bool = False) -> str:
    """One equity curve with an axis, at most 500 points; `log` for equal ratios at equal heights."""
    keep = [points[i] for i in downsample(len(points))]
    log = log and min(keep) > 0
    value = [math.log10(v) for v in keep] if log else keep
    low, high = min(value), max(value)
    lines, at = _axis(low, high if high > low else low + 1, height, 70, width, "1e{:.2f}" if log else "{:,.0f}")
    path = " ".join(f"{70 + i * (width - 70) / max(len(value) - 1, 1):.1f},{at(v):.1f}" for i, v in enumerate(value))
    return _frame(f'{lines}<polyline fill="none" stroke="#269" points="{path}"/>', width, height, "equity")


def waterfall_svg(rows: Sequence[dict], width: int = 720, height: int = 240) -> str:
    """How each rung changes the ratio of the one before."""
    levels = [0.0, *(r["sharpe"] for r in rows)]
    lines, at = _axis(min(levels), max(levels) if max(levels) > min(levels) else min(levels) + 1, height, 50, width)
    step, parts = (width - 50) / max(len(rows), 1), [lines]
    for i, r in enumerate(rows):
        before = 0.0 if i == 0 else rows[i - 1]["sharpe"]
        top, bottom = max(before, r["sharpe"]), min(before, r["sharpe"])
        colour = "#89a" if i == 0 else "#2a7" if r["sharpe"] >= before else "#b54"
        parts.append(
            f'<rect x="{50 + i * step + 6:.1f}" y="{at(top):.1f}" width="{step - 12:.1f}" height="{max(at(bottom) - at(top), 1):.1f}" fill="{colour}"><title>{html.escape(r["name"])}: {r["sharpe"]:.2f}</title></rect><text x="{50 + (i + 0.5) * step:.1f}" y="{height - 4}" text-anchor="middle">{i + 1}</text>'
        )
    return _frame("".join(parts), width, height, "change of the ratio by rung")


def costs_svg(rows: Sequence[dict], width: int = 720, height: int = 200) -> str:
    """Commission and slippage of each rung, one on the other."""
    top = max([r["commission"] + r["slippage"] for r in rows] + [1e-9])
    lines, at = _axis(0.0, top, height, 70, width, "{:,.0f}")
    step, parts = (width - 70) / max(len(rows), 1), [lines]
    for i, r in enumerate(rows):
        base = 0.0
        for name, colour in (("slippage", "#c83"), ("commission", "#865")):
            parts.append(
                f'<rect x="{70 + i * step + 8:.1f}" y="{at(base + r[name]):.1f}" width="{step - 16:.1f}" height="{at(base) - at(base + r[name]):.1f}" fill="{colour}"><title>{name} {r[name]:,.0f}</title></rect>'
            )
            base += r[name]
        parts.append(f'<text x="{70 + (i + 0.5) * step:.1f}" y="{height - 4}" text-anchor="middle">{i + 1}</text>')
    return _frame("".join(parts), width, height, "costs by rung")


def paths_svg(sharpes: Sequence[float], width: int = 720, height: int = 160, bins: int = 20) -> str:
    """Histogram of the ratios of cross-validation paths."""
    low, high = min(sharpes), max(sharpes)
    span = max(high - low, 1e-9)
    count = [0] * bins
    for v in sharpes:
        count[min(int((v - low) / span * bins), bins - 1)] += 1
    lines, at = _axis(0.0, float(max(count)), height, 50, width)
    step = (width - 50) / bins
    bars = "".join(
        f'<rect x="{50 + k * step + 1:.1f}" y="{at(n):.1f}" width="{step - 2:.1f}" height="{at(0.0) - at(n):.1f}" fill="#269"/>' for k, n in enumerate(count)
    )
    ends = f'<text x="50" y="{height - 4}">{low:.2f}</text><text x="{width}" y="{height - 4}" text-anchor="end">{high:.2f}</text>'
    return _frame(lines + bars + ends, width, height, "ratios of the paths")


def render_html(
    rows: Sequence[dict],
    title: str = "Degradation ladder",
    equity: Sequence[float] | None = None,
    notes: str = "",
    paths: Sequence[float] = (),
) -> str:
    """A page without scripts: the ladder as bars, waterfall, costs and table, equity on both axes, paths."""
    head = "".join(f"<th>{html.escape(h)}</th>" for h, _ in _COLUMNS)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(x)}</td>" for x in _cells(r)) + "</tr>" for r in rows)
    charts = [_bars_svg(rows), waterfall_svg(rows), costs_svg(rows) if all("commission" in r for r in rows) else ""]
    if equity:
        charts += [equity_svg(equity), equity_svg(equity, log=True)]
    if paths:
        charts.append(paths_svg(paths))
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>body{{font:14px sans-serif;max-width:760px;margin:2em auto}}td,th{{padding:3px 8px;text-align:right}}svg text{{font-size:11px}}</style></head><body><h1>{html.escape(title)}</h1>{"".join(charts)}<table><tr>{head}</tr>{body}</table><pre>{html.escape(notes)}</pre></body></html>'
