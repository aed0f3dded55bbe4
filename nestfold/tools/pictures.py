"""Histograms as SVG, which needs nothing but text."""

from __future__ import annotations

from html import escape

WIDTH, HEIGHT, LEFT, BOTTOM, TOP = 640, 400, 70, 50, 40


def histogram_svg(edges: list[float], counts: list[int], title: str = "", label: str = "", outside: int = 0) -> str:
    """Bars of ``counts`` between ``edges``, with both axes; ``outside`` values are told below the title."""
    wide, high, most = WIDTH - LEFT - 20, HEIGHT - BOTTOM - TOP, max([1, *counts])
    step = wide / max(1, len(counts))
    text = lambda x, y, s, how="": f'<text x="{x:.1f}" y="{y:.1f}" font-size="12" font-family="sans-serif" {how}>{escape(s)}</text>'
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}">', f'<rect width="{WIDTH}" height="{HEIGHT}" fill="white"/>']
    for i, n in enumerate(counts):
        tall = high * n / most
        out.append(f'<rect x="{LEFT + i * step:.2f}" y="{TOP + high - tall:.2f}" width="{step * 0.96:.2f}" height="{tall:.2f}" fill="#4472a8"/>')
    out.append(f'<path d="M{LEFT} {TOP}V{TOP + high}H{LEFT + wide}" fill="none" stroke="black"/>')
    for k in range(5):
        value = most * k / 4
        out.append(text(LEFT - 8, TOP + high - high * k / 4 + 4, f"{value:g}", 'text-anchor="end"'))
        if edges:
            out.append(text(LEFT + wide * k / 4, TOP + high + 18, f"{edges[0] + (edges[-1] - edges[0]) * k / 4:.4g}", 'text-anchor="middle"'))
    out.append(text(LEFT + wide / 2, HEIGHT - 10, label, 'text-anchor="middle"'))
    out.append(text(LEFT, 18, title) + (text(LEFT, 34, f"{outside} values outside") if outside else ""))
    return "\n".join([*out, "</svg>"])
