"""M-bias of a strand as a picture: a panel for each read, drawn from the few rows of the histogram."""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import escape

PANEL = (640, 200)
MARGIN = 56
STYLE = "text{font:13px sans-serif} .axis{stroke:#333} .band{fill:#9db8d9;opacity:.6} .mean{fill:none;stroke:#1f4e8c;stroke-width:1.6} .bound{stroke:#b03a2e;stroke-dasharray:2 2}"


def points(pairs: Iterable[tuple[float, float]]) -> str:
    return " ".join(f"{a:.2f},{b:.2f}" for a, b in pairs)


def panel(read: int, rows: list, bounds: list[int], longest: int) -> list[str]:
    """A read's panel with its origin at the top left: axes, the band of the intervals, the line of the fractions, and bounds."""
    width, height = PANEL
    place = lambda position: width * (position - 0.5) / longest  # noqa: E731  the middle of a place's column
    level = lambda fraction: height * (1 - fraction)
    out = [f'<path class="axis" fill="none" d="M0 0v{height}h{width}"/>', f'<text x="{width}" y="-6" text-anchor="end">read {read}</text>']
    for fraction, label in ((0.0, "0"), (0.5, "50"), (1.0, "100")):
        out.append(f'<text x="-8" y="{level(fraction) + 4:g}" text-anchor="end">{label}%</text>')
    for position in sorted({1, (longest + 1) // 2, longest}):
        out.append(f'<text x="{place(position):.2f}" y="{height + 16}" text-anchor="middle">{position}</text>')
    if rows:
        edge = [(place(r["position"]), level(r["upper"])) for r in rows] + [(place(r["position"]), level(r["lower"])) for r in rows[::-1]]
        out.append(f'<polygon class="band" points="{points(edge)}"/>')
        out.append(f'<polyline class="mean" points="{points((place(r["position"]), level(r["fraction"])) for r in rows)}"/>')
    for bound in filter(None, bounds):
        out.append(f'<line class="bound" x1="{place(bound):.2f}" x2="{place(bound):.2f}" y1="0" y2="{height}"/>')
    return out


def mbias_svg(strand: str, rows: list, bounds: list[int]) -> str:
    """rows: position, read, fraction, lower and upper of the strand's histogram, by position. bounds: of read 1, then of read 2."""
    longest = max(r["position"] for r in rows)
    reads = sorted({r["read"] for r in rows})
    width, step = PANEL[0] + 2 * MARGIN, PANEL[1] + MARGIN
    height = MARGIN + step * len(reads) + MARGIN // 2
    body = [f"<style>{STYLE}</style>", f'<text x="{MARGIN}" y="24">{escape(strand)} strand, --{escape(strand)} {",".join(map(str, bounds))}</text>']
    for k, read in enumerate(reads):
        inner = panel(read, [r for r in rows if r["read"] == read], bounds[2 * read - 2 : 2 * read], longest)
        body += [f'<g transform="translate({MARGIN} {MARGIN + k * step})">', *inner, "</g>"]
    body.append(f'<text x="{width / 2:g}" y="{height - 10}" text-anchor="middle">Position along mapped read</text>')
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', *body, "</svg>"])
