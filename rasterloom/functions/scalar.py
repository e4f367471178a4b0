"""Scalar maths of the codec as SQL expressions, usable with expr() and in SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _linear(c: str) -> str:
    return f"(case when {c}/255.0D > 0.04045D then power(({c}/255.0D + 0.055D)/1.055D, 2.4D) else {c}/255.0D/12.92D end)"


def _f(t: str) -> str:
    return f"(case when {t} > 0.008856D then power({t}, 1.0D/3.0D) else 7.787D*{t} + 16.0D/116.0D end)"


def lab(r: str = "r", g: str = "g", b: str = "b") -> tuple[str, str, str]:
    """sRGB bytes to L, a, b."""
    lr, lg, lb = _linear(r), _linear(g), _linear(b)
    fx = _f(f"((0.4124D*{lr} + 0.3576D*{lg} + 0.1805D*{lb})/0.95047D)")
    fy = _f(f"(0.2126D*{lr} + 0.7152D*{lg} + 0.0722D*{lb})")
    fz = _f(f"((0.0193D*{lr} + 0.1192D*{lg} + 0.9505D*{lb})/1.08883D)")
    return f"116.0D*{fy} - 16.0D", f"500.0D*({fx} - {fy})", f"200.0D*({fy} - {fz})"


def with_lab(pixels: DataFrame) -> DataFrame:
    """Pixels (r, g, b) with l, a, b in place of them.

    The formulas of `lab` in steps: a step's values are used more than once by the next, so the optimiser keeps the
    steps apart, and plans that use l, a and b often don't repeat the whole formula each time.
    """
    others = [c for c in pixels.columns if c not in ("r", "g", "b")]
    steps = [
        {"_r": _linear("r"), "_g": _linear("g"), "_b": _linear("b")},
        {"_x": "(0.4124D*_r + 0.3576D*_g + 0.1805D*_b)/0.95047D", "_y": "0.2126D*_r + 0.7152D*_g + 0.0722D*_b", "_z": "(0.0193D*_r + 0.1192D*_g + 0.9505D*_b)/1.08883D"},
        {"_fx": _f("_x"), "_fy": _f("_y"), "_fz": _f("_z")},
        {"l": "116.0D*_fy - 16.0D", "a": "500.0D*(_fx - _fy)", "b": "200.0D*(_fy - _fz)"},
    ]
    for step in steps:
        pixels = pixels.select(*others, *(F.expr(e).alias(n) for n, e in step.items()))
    return pixels


def rgb(variant: str = "current") -> tuple[str, str, str]:
    """Columns l, a, b to sRGB bytes; `current` clamps after gamma and truncates x + 0.5, `legacy` clamps before and rounds."""
    cut, slope = ("0.206897D", "(t - 16.0D/116.0D)/7.787D") if variant == "current" else ("(6.0D/29.0D)", "3.0D*(6.0D/29.0D)*(6.0D/29.0D)*(t - 4.0D/29.0D)")
    inverse = lambda t: f"(case when {t} > {cut} then {t}*{t}*{t} else {slope.replace('t -', f'{t} -')} end)"
    fy = "((l + 16.0D)/116.0D)"
    x, y, z = f"(0.95047D*{inverse(f'(a/500.0D + {fy})')})", inverse(fy), f"(1.08883D*{inverse(f'({fy} - b/200.0D)')})"
    out = []
    for i, j, k in ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570)):
        c = f"({i}D*{x} + ({j}D)*{y} + ({k}D)*{z})"
        if variant != "current":
            c = f"least(1.0D, greatest(0.0D, {c}))"
        gamma = f"(case when {c} <= 0.0031308D then 12.92D*{c} else 1.055D*power(greatest({c}, 0.0D), 1.0D/2.4D) - 0.055D end)"
        out.append(f"cast(floor(255.0D*least(1.0D, greatest(0.0D, {gamma})) + 0.5D) as int)")
    return tuple(out)


def half(v: str) -> str:
    """The 16-bit float round trip: mantissa truncated, small values to 0, large ones to +infinity."""
    e = f"floor(log2(abs({v})))"
    e = f"(case when power(2.0D, {e} + 1) <= abs({v}) then {e} + 1 when power(2.0D, {e}) > abs({v}) then {e} - 1 else {e} end)"
    scale = f"power(2.0D, 10 - {e})"
    return f"(case when abs({v}) < power(2.0D, -14) then 0.0D when abs({v}) >= 65536.0D then cast('Infinity' as double) else sign({v})*floor(abs({v})*{scale})/{scale} end)"


def eased(t: str, shape: str) -> str:
    """A position t in 0..1 on the curve of a shape: 0 step, 1 linear, 2 ease in and out, 3 smooth step."""
    return f"(case {shape} when 0 then (case when {t} < 0.5D then 0.0D else 1.0D end) when 1 then {t} when 2 then (case when {t} < 0.5D then 2*{t}*{t} else 1 - (2 - 2*{t})*(2 - 2*{t})/2 end) when 3 then {t}*{t}*(3 - 2*{t}) else {t} end)"


def width_pixels(code: str, default: int = 2) -> str:
    """Half width in pixels of a width code; the default is 2, in the legacy decoder 3."""
    return f"(case {code} when 0 then 1 when 1 then 3 when 2 then 6 when 3 then 12 else {default} end)"


def pack_descriptor(bits: int, legacy: bool = False) -> str:
    """Columns shape, direction, width in 2, 4 or 6 bits."""
    if bits == 6:
        return "(shape*16 + direction*4 + width)"
    if bits == 4:
        return "(shape*4 + direction)" if legacy else "(width*4 + shape)"
    return "shape" if legacy else "width"


def unpack_descriptor(code: str, bits: int, legacy: bool = False) -> tuple[str, str, str]:
    """(shape, direction, width) of a packed descriptor; absent fields: shape 1, direction 0, width 0."""
    field = lambda k: f"(cast(floor({code}/{4**k}) as int) % 4)"
    if bits == 6:
        return field(2), field(1), field(0)
    if bits == 4:
        return (field(1), field(0), "0") if legacy else (field(0), "0", field(1))
    return (field(0), "0", "0") if legacy else ("1", "0", field(0))


def bits_per_index(n: str) -> str:
    """The least number of bits, at least 1, whose power of two reaches n."""
    return f"greatest(1, length(bin(greatest(1, {n} - 1))))"


def in_sphere(axes: tuple[str, str, str], radius: str) -> tuple[str, str, str]:
    """A vector shortened to at most the radius."""
    norm = "sqrt(" + " + ".join(f"{a}*{a}" for a in axes) + ")"
    return tuple(f"({a}*(case when {norm} > {radius} then {radius}/{norm} else 1.0D end))" for a in axes)


#: Modulus of the hashed numbers; its square fits 63 bits.
MODULUS = 2147483647


def uniform(seed: int, *keys: str) -> str:
    """A number in 0..1 that depends on a seed and whole-number columns only, in place of an order-dependent generator."""
    h = " + ".join(f"{k}*{m}" for k, m in zip(keys, (48271, 69621, 40692, 16807), strict=False))
    h = f"pmod({h} + {seed * 7919 + 12345}, {MODULUS})"
    for add in (12345, 67890):
        h = f"pmod({h}*{h} + {add}, {MODULUS})"
    return f"({h}/{MODULUS}.0D)"


def normal(seed: int, *keys: str) -> str:
    """A standard normal number of a seed and whole-number columns."""
    return f"(sqrt(-2.0D*ln(greatest({uniform(2 * seed, *keys)}, 1e-12D)))*cos(2.0D*pi()*{uniform(2 * seed + 1, *keys)}))"
