"""Pictures of cell tables as SVG text. Only cells, never rows, come to the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from html import escape

from ..operators.hist import Hist
from ..operators.profile import Profile
from ..operators.stats import bins


def nice_step(span: float, count: int = 6) -> float:
    """The largest of 1, 2, 5 times a power of ten that still gives about ``count`` steps."""
    if span <= 0 or not math.isfinite(span):
        return 1.0
    power = 10.0 ** math.floor(math.log10(span / count))
    return next(m * power for m in (1, 2, 5, 10) if m * power * count >= span * 0.999)


def ticks(lo: float, hi: float, count: int = 6) -> list[float]:
    step = nice_step(hi - lo, count)
    first = math.ceil(lo / step - 1e-9)
    return [k * step for k in range(first, math.floor(hi / step + 1e-9) + 1)]


def tick_labels(values: list[float]) -> list[str]:
    """As many decimals as the step needs; powers of ten for very large or small numbers."""
    if not values:
        return []
    step = abs(values[1] - values[0]) if len(values) > 1 else abs(values[0]) or 1.0
    largest = max(map(abs, values))
    if largest >= 1e6 or 0 < largest < 1e-4:
        return [f"{v:.3g}" for v in values]
    return [f"{v:.{max(0, -math.floor(math.log10(step) + 1e-9))}f}" for v in values]


@dataclass
class Axes:
    """One frame; ``svg`` gives the picture."""

    width: int = 640
    height: int = 420
    title: str = ""
    x_label: str = ""
    y_label: str = ""
    _lines: list = field(default_factory=list)
    _boxes: list = field(default_factory=list)
    _bars: list = field(default_factory=list)

    def line(self, xs: list[float], ys: list[float], color: str = "#1f77b4") -> Axes:
        self._lines.append((list(map(float, xs)), list(map(float, ys)), color))
        return self

    def hist(self, h: Hist, errors: bool = False, color: str = "#1f77b4") -> Axes:
        """The outline of a one-dimensional histogram, with error bars if asked for."""
        axis = h.axes[0]
        rows = bins(h).where(h.in_range()).orderBy("ix").collect()
        xs, ys = [axis.edge(0)], [0.0]
        for r in rows:
            xs += [axis.edge(r.ix - 1), axis.edge(r.ix)]
            ys += [r.content] * 2
            if errors:
                self._bars.append((axis.bin_center(r.ix), r.content, 0.0, 0.0, r.error, r.error, color))
        return self.line([*xs, axis.edge(axis.n)], [*ys, 0.0], color)

    def profile(self, p: Profile, mode: str = "mean", color: str = "#d62728") -> Axes:
        axis = p.axes[0]
        for r in p.values(mode).where(axis.in_range("ix")).collect():
            half = axis.bin_width(r.ix) / 2
            self._bars.append((axis.bin_center(r.ix), r["mean"], half, half, r.error, r.error, color))
        return self

    def errorbar(self, points, color: str = "#2ca02c") -> Axes:
        """The points of a graph (columns x, y, ex_lo, ex_hi, ey_lo, ey_hi)."""
        self._bars += [(r.x, r.y, r.ex_lo, r.ex_hi, r.ey_lo, r.ey_hi, color) for r in points.collect()]
        return self

    def function(self, f, lo: float, hi: float, n: int = 200, color: str = "#ff7f0e") -> Axes:
        xs = [lo + (hi - lo) * k / n for k in range(n + 1)]
        return self.line(xs, [float(f(x)) for x in xs], color)

    def hist2d(self, h: Hist) -> Axes:
        """Boxes coloured between the least and the largest content other than zero."""
        ax, ay = h.axes
        rows = h.cells.where(h.in_range()).where("content <> 0").collect()
        values = [r.content for r in rows]
        low, span = min(values, default=0.0), (max(values, default=1.0) - min(values, default=0.0)) or 1.0
        for r in rows:
            shade = (r.content - low) / span
            color = f"rgb({round(68 + 185 * shade)},{round(1 + 230 * shade)},{round(84 - 47 * shade)})"
            self._boxes.append((ax.edge(r.ix - 1), ay.edge(r.iy - 1), ax.edge(r.ix), ay.edge(r.iy), color))
        return self

    def svg(self) -> str:
        xs = [x for line in self._lines for x in line[0]] + [v for b in self._boxes for v in (b[0], b[2])] + [v for b in self._bars for v in (b[0] - b[2], b[0] + b[3])]
        ys = [y for line in self._lines for y in line[1]] + [v for b in self._boxes for v in (b[1], b[3])] + [v for b in self._bars for v in (b[1] - b[4], b[1] + b[5])]
        x0, x1 = min(xs, default=0.0), max(xs, default=1.0)
        y0, y1 = min(ys, default=0.0), max(ys, default=1.0)
        x1, y1 = (x1 if x1 > x0 else x0 + 1), (y1 if y1 > y0 else y0 + 1)
        if not self._boxes:
            y1 += 0.05 * (y1 - y0)
        left, top, right, bottom = 60, 30, self.width - 15, self.height - 45
        px = lambda x: left + (x - x0) / (x1 - x0) * (right - left)
        py = lambda y: bottom - (y - y0) / (y1 - y0) * (bottom - top)
        out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.width}" height="{self.height}" font-family="sans-serif" font-size="11">']
        for a, b, c, d, color in self._boxes:
            out.append(f'<rect x="{px(a):.2f}" y="{py(d):.2f}" width="{px(c) - px(a):.2f}" height="{py(b) - py(d):.2f}" fill="{color}"/>')
        for lx, ly, color in self._lines:
            path = " ".join(f"{px(x):.2f},{py(y):.2f}" for x, y in zip(lx, ly))
            out.append(f'<polyline points="{path}" fill="none" stroke="{color}"/>')
        for x, y, a, b, c, d, color in self._bars:
            out.append(f'<path d="M{px(x - a):.2f} {py(y):.2f}H{px(x + b):.2f}M{px(x):.2f} {py(y - c):.2f}V{py(y + d):.2f}" stroke="{color}"/><circle cx="{px(x):.2f}" cy="{py(y):.2f}" r="2" fill="{color}"/>')
        out.append(f'<rect x="{left}" y="{top}" width="{right - left}" height="{bottom - top}" fill="none" stroke="black"/>')
        for v, text in zip(ticks(x0, x1), tick_labels(ticks(x0, x1))):
            out.append(f'<path d="M{px(v):.2f} {bottom}v-5" stroke="black"/><text x="{px(v):.2f}" y="{bottom + 14}" text-anchor="middle">{text}</text>')
        for v, text in zip(ticks(y0, y1), tick_labels(ticks(y0, y1))):
            out.append(f'<path d="M{left} {py(v):.2f}h5" stroke="black"/><text x="{left - 4}" y="{py(v) + 4:.2f}" text-anchor="end">{text}</text>')
        out.append(f'<text x="{self.width / 2}" y="18" text-anchor="middle">{escape(self.title)}</text><text x="{self.width / 2}" y="{self.height - 8}" text-anchor="middle">{escape(self.x_label)}</text>')
        out.append(f'<text x="14" y="{self.height / 2}" text-anchor="middle" transform="rotate(-90 14 {self.height / 2})">{escape(self.y_label)}</text></svg>')
        return "\n".join(out)


def stack(plots: list[Axes]) -> str:
    """Frames one below another in one picture."""
    at, parts = 0, []
    for a in plots:
        parts.append(f'<g transform="translate(0 {at})">{a.svg()}</g>')
        at += a.height
    width = max((a.width for a in plots), default=0)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{at}">' + "".join(parts) + "</svg>"
