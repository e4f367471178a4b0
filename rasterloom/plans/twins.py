"""DuckDB SQL of the codec's longer queries: layers with blended boundaries, prefix codes, covers, filters, containers.

Written from the definitions of the operators, step by step as relations; each function gives common table
expressions that begin with a name of their own.
"""

from __future__ import annotations

import math


def ease(t: str, shape: str) -> str:
    return f"(case {shape} when 0 then (case when {t} < 0.5 then 0.0 else 1.0 end) when 1 then {t} when 2 then (case when {t} < 0.5 then 2 * {t} * {t} else 1 - (2 - 2 * {t}) * (2 - 2 * {t}) / 2 end) else {t} * {t} * (3 - 2 * {t}) end)"


def palette(n: str, source: str, eps: float, steps: int) -> str:
    """{n}_ix (image_id, y, x, v, idx, recon) and {n}_pal (image_id, idx, value) of source (image_id, y, x, v)."""
    return f"""{n}_vox as (select image_id, cast(floor(v / {eps}) as int) as k, count(*) as n, sum(v) as s from {source} group by all),
{n}_isl as (select *, k - row_number() over (partition by image_id order by k) as island from {n}_vox),
{n}_blk as (select *, (row_number() over (partition by image_id, island order by k) - 1) // {steps + 1} as block from {n}_isl),
{n}_vc as (select *, cast(dense_rank() over (partition by image_id order by island, block) - 1 as int) as idx from {n}_blk),
{n}_pal as (select image_id, idx, sum(s) / sum(n) as value from {n}_vc group by all),
{n}_ix as (select p.image_id, p.y, p.x, p.v, c.idx, l.value as recon from {source} p join {n}_vc c on c.image_id = p.image_id and c.k = cast(floor(p.v / {eps}) as int) join {n}_pal l on l.image_id = p.image_id and l.idx = c.idx)"""


def descriptors(n: str, width: int, segment: int, threshold: float, first: bool = False) -> str:
    """{n}_ed (edges), {n}_sg (segments with their descriptors) and {n}_ds (the queue), from {n}_ix; first: by the first encoder's rules."""
    errors = ", ".join(f"round(sum(abs(least(1.0, greatest(0.0, (s - low) / nullif(high - low, 0))) - {ease('pos', str(k))})), 9) as e{k}" for k in (1, 2, 3))
    head = f"""{n}_ed as (select a.image_id, 2 * (cast(a.y as bigint) * {width} + a.x) + d.nth as edge_seq, a.x, a.y, a.idx as ca, b.idx as cb, least(a.idx, b.idx) as lo, greatest(a.idx, b.idx) as hi, a.v as va, b.v as vb, b.y as ny
from {n}_ix a, (values (0, 1, 0), (1, 0, 1)) d(nth, dx, dy), {n}_ix b where b.image_id = a.image_id and b.x = a.x + d.dx and b.y = a.y + d.dy and a.idx <> b.idx),
{n}_no as (select *, cast((row_number() over (partition by image_id, lo, hi order by edge_seq) - 1) // {segment} as int) as seg from {n}_ed),
{n}_sm as (select image_id, lo, hi, seg, edge_seq, 0 as ord, va as s from {n}_no union all select image_id, lo, hi, seg, edge_seq, 1, vb from {n}_no
union all select e.image_id, lo, hi, seg, edge_seq, 3 + p.x - e.x, p.v from {n}_no e join {n}_ix p on p.image_id = e.image_id and p.y = e.ny and p.x between e.x - 1 and e.x + 1 and p.idx = e.cb and {str(not first).lower()}),
{n}_mn as (select image_id, idx, avg(v) as m from {n}_ix group by all),
{n}_gr as (select image_id, lo, hi, seg, count(*) as n, max(edge_seq) as last_seq, max(x) - min(x) as sx, max(y) - min(y) as sy, arg_min(x, edge_seq) as first_x, arg_min(y, edge_seq) as first_y, arg_max(x, edge_seq) as last_x, arg_max(y, edge_seq) as last_y from {n}_no group by image_id, lo, hi, seg),
{n}_lv as (select g.*, least(a.m, b.m) as low, greatest(a.m, b.m) as high from {n}_gr g join {n}_mn a on a.image_id = g.image_id and a.idx = lo join {n}_mn b on b.image_id = g.image_id and b.idx = hi),
{n}_at as (select image_id, lo, hi, seg, s, cast(row_number() over w - 1 as double) / greatest(1, count(*) over (partition by image_id, lo, hi, seg) - 1) as pos from {n}_sm window w as (partition by image_id, lo, hi, seg order by edge_seq, ord)),
{n}_er as (select image_id, lo, hi, seg, count(*) as many, count(*) filter (where s > low + 0.1 and s < high - 0.1) as inside, {errors} from {n}_at join {n}_lv using (image_id, lo, hi, seg) group by image_id, lo, hi, seg),
{n}_sg as (select image_id, lo, hi, seg, n, last_seq, first_x, first_y,
case when high - low < 1e-4 then 0 when least(e1, e2, e3) > round(0.3::double * many, 9) then 0 when e1 <= least(e2, e3) then 1 when e2 <= e3 then 2 else 3 end as shape,
case when n < 2 then 0 when sx > 2 * sy then 0 when sy > 2 * sx then 1 when (last_x - first_x) * (last_y - first_y) >= 0 then 2 else 3 end as direction,
least(3, {0 if first else 1} + case when inside <= 1 then 0 when inside <= 3 then 1 when inside <= 6 then 2 else 3 end) as width from {n}_lv join {n}_er using (image_id, lo, hi, seg))"""
    turned = "" if first else " or di <> u.direction"
    if threshold <= 1.0 and not first:
        fields = ("shape", "direction", "width") if threshold <= 0.3 else ("shape", "direction")
        differs = " or ".join(f"{f} <> lag({f}) over p" for f in fields)
        emits = f"{n}_em as (select *, seg = 0 or coalesce({differs}, false) as emits from {n}_sg window p as (partition by image_id, lo, hi order by seg))"
    else:
        emits = f"""{n}_em as (select *, true as emits, shape as sh, direction as di, width as wi from {n}_sg where seg = 0 union all
select s.*, e.e, case when e.e then s.shape else e.sh end, case when e.e then s.direction else e.di end, case when e.e then s.width else e.wi end from {n}_sg s join
(select image_id, lo, hi, t.seg + 1 as seg, sh, di, wi, round((sh <> u.shape)::int * 1.0 + (di <> u.direction)::int * 0.5 + (wi <> u.width)::int * 0.3, 6) >= {threshold}{turned} as e
from {n}_em t join {n}_sg u using (image_id, lo, hi) where u.seg = t.seg + 1) e using (image_id, lo, hi, seg))"""
    queue = f"{n}_ds as (select image_id, cast(row_number() over (partition by image_id order by (n < {segment})::int, case when n < {segment} then 0 else last_seq end, lo, hi) - 1 as bigint) as queue_idx, lo, hi, first_x, first_y, shape, direction, width, seg > 0 as change from {n}_em where emits)"
    return f"{head},\n{emits},\n{queue}"


def blended(n: str, width: int, linear: bool = True, along: bool = False) -> str:
    """{n}_out (image_id, y, x, v, base, recon): {n}_ix with boundaries blended; along: in the stored direction."""
    shape = "1" if linear else "shape"
    pixels = "case width when 0 then 1 when 1 then 3 when 2 then 6 else 12 end"
    queue = f"""{n}_fs as (select *, row_number() over o - 1 as pair_no, lag(first_seq) over o as before from (select image_id, lo, hi, min(edge_seq) as first_seq from {n}_ed group by all) window o as (partition by image_id order by first_seq)),
{n}_qs as (select image_id, count(*) as size from {n}_ds group by all),
{n}_pr as (select image_id, lo, hi, pair_no from {n}_fs join {n}_qs using (image_id) where pair_no < size or pair_no = size and first_seq % 2 = 1 and before = first_seq - 1),
{n}_cg as (select image_id, first_x as x, first_y as y, max(queue_idx) as change_idx from {n}_ds where change group by all),
{n}_sd as (select a.image_id, a.y, a.x, d.nb, d.dx, d.dy, a.idx as ca, b.idx as cb, a.recon as pa, b.recon as pb, c.idx as behind, least(a.idx, b.idx) as lo, greatest(a.idx, b.idx) as hi
from (select * from {n}_ix, (values (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) d(nb, dx, dy)) a0 join {n}_ix a on a.image_id = a0.image_id and a.y = a0.y and a.x = a0.x join (values (0, 1, 0), (1, -1, 0), (2, 0, 1), (3, 0, -1)) d(nb, dx, dy) on d.nb = a0.nb
join {n}_ix b on b.image_id = a.image_id and b.x = a.x + d.dx and b.y = a.y + d.dy left join {n}_ix c on c.image_id = a.image_id and c.x = a.x - d.dx and c.y = a.y - d.dy where b.idx <> a.idx),
{n}_de as (select s.*, q.shape, q.direction, {pixels} as h from {n}_sd s left join {n}_cg g on g.image_id = s.image_id and g.x = s.x and g.y = s.y left join {n}_pr p on p.image_id = s.image_id and p.lo = s.lo and p.hi = s.hi
join {n}_ds q on q.image_id = s.image_id and q.queue_idx = coalesce(g.change_idx, p.pair_no, 0))"""
    if along:
        writes = f"""{n}_dd as (select *, x + case when direction = 1 then 0 else d end as tx, y + case direction when 0 then 0 when 3 then -d else d end as ty, (d + h) / (2.0 * h + 1) as t from {n}_de, range(-12, 13) r(d) where abs(d) <= h),
{n}_wr as (select w.image_id, tx as x, ty as y, arg_max(pa + {ease('t', shape)} * (pb - pa), ((cast(w.y as bigint) * {width} + w.x) * 4 + nb) * 32 + d) as wrote from {n}_dd w join {n}_ix i on i.image_id = w.image_id and i.x = tx and i.y = ty and i.idx in (ca, cb) group by 1, 2, 3)"""
    else:
        writes = f"""{n}_dd as (select *, (case o when -1 then -ceil(h / 2.0) when 0 then ceil(h / 2.0) - 1 else h end + h) / (2.0 * h + 1) as t from {n}_de, (values (-1), (0), (1)) r(o) where o >= 0 or behind in (ca, cb)),
{n}_wr as (select image_id, x + o * dx as x, y + o * dy as y, arg_max(pa + {ease('t', shape)} * (pb - pa), ((cast({n}_dd.y as bigint) * {width} + {n}_dd.x) * 4 + nb) * 3 + o) as wrote from {n}_dd group by 1, 2, 3)"""
    return f"{queue},\n{writes},\n{n}_out as (select i.image_id, i.y, i.x, i.v, i.recon as base, coalesce(wrote, i.recon) as recon from {n}_ix i left join {n}_wr w on w.image_id = i.image_id and w.x = i.x and w.y = i.y)"


def layer(n: str, source: str, eps: float, steps: int, width: int, segment: int = 64, threshold: float = 1.0) -> str:
    return ",\n".join((palette(n, source, eps, steps), descriptors(n, width, segment, threshold), blended(n, width)))


def two_layers(n: str, source: str, eps: float, steps: int, width: int, residual_eps: float, scale: float = 1.0) -> str:
    """{n} (image_id, y, x, v, base, recon): base layer and residual layer."""
    return f"""{layer(n + 'b', source, eps, steps, width)},
{n}_res as (select image_id, y, x, (v - recon) * {scale} as v from {n}b_out),
{layer(n + 'r', n + '_res', residual_eps, steps, width)},
{n} as (select b.image_id, b.y, b.x, b.v, b.recon as base, b.recon + r.recon / {scale} as recon from {n}b_out b join {n}r_out r using (image_id, y, x))"""


#: sRGB bytes r, g, b of a relation to l, a, b, from the published formulas.
def lab(source: str, keep: str = "image_id, y, x") -> str:
    linear = lambda c: f"case when {c} / 255.0::double > 0.04045 then power(({c} / 255.0::double + 0.055) / 1.055, 2.4) else {c} / 255.0::double / 12.92 end"
    curve = lambda t: f"case when {t} > 0.008856 then power({t}, 1.0::double / 3) else 7.787 * {t} + 16.0::double / 116 end"
    return f"""(select {keep}, 116 * fy - 16 as l, 500 * (fx - fy) as a, 200 * (fy - fz) as b from (select {keep}, {curve('tx')} as fx, {curve('ty')} as fy, {curve('tz')} as fz from
(select {keep}, (0.4124::double * lr + 0.3576::double * lg + 0.1805::double * lb) / 0.95047 as tx, 0.2126::double * lr + 0.7152::double * lg + 0.0722::double * lb as ty, (0.0193::double * lr + 0.1192::double * lg + 0.9505::double * lb) / 1.08883 as tz from
(select {keep}, {linear('r')} as lr, {linear('g')} as lg, {linear('b')} as lb from {source}))))"""


def rgb(source: str, legacy: bool = False, keep: str = "image_id, y, x") -> str:
    """l, a, b of a relation to sRGB bytes: clamped after gamma, or (legacy) before it."""
    cube = (lambda t: f"case when {t} > 6.0::double / 29 then {t} * {t} * {t} else 3 * (6.0::double / 29) * (6.0::double / 29) * ({t} - 4.0::double / 29) end") if legacy else (lambda t: f"case when {t} > 0.206897 then {t} * {t} * {t} else ({t} - 16.0::double / 116) / 7.787 end")
    first = (lambda c: f"least(1.0, greatest(0.0, {c}))") if legacy else (lambda c: c)
    gamma = lambda c: f"cast(floor(255 * least(1.0, greatest(0.0, case when {c} <= 0.0031308 then 12.92 * {c} else 1.055 * power(greatest({c}, 0), 1 / 2.4::double) - 0.055 end)) + 0.5) as int)"
    rows = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
    mixed = ", ".join(f"{first(f'({i}::double * cx + ({j})::double * cy + ({k})::double * cz)')} as m{n}" for n, (i, j, k) in zip("rgb", rows, strict=True))
    return f"""(select {keep}, {', '.join(f"{gamma('m' + n)} as {n}" for n in 'rgb')} from (select {keep}, {mixed} from (select {keep}, 0.95047::double * ({cube('tx')}) as cx, {cube('ty')} as cy, 1.08883::double * ({cube('tz')}) as cz from
(select {keep}, a / 500 + (l + 16) / 116 as tx, (l + 16) / 116 as ty, (l + 16) / 116 - b / 200 as tz from {source}))))"""


def huffman(keys: str) -> str:
    """hf (image_id, codes): the prefix codes of keys (image_id, key, freq), a list of (key, code as text) an image.

    The two least (frequency, least key) are merged until one is left; the first takes 0 and the second 1.
    """
    coded = lambda k, bit: f"list_transform(l[{k}].codes, lambda c: {{'key': c.key, 'code': '{bit}' || c.code}})"
    return f"""hs as (select image_id, list_sort(list({{'n': cast(freq as bigint), 'k': cast(key as bigint), 'codes': [{{'key': cast(key as bigint), 'code': ''}}]}})) as l from {keys} group by image_id),
hr as (select image_id, l from hs union all select image_id, list_sort(list_append(l[3:], {{'n': l[1].n + l[2].n, 'k': least(l[1].k, l[2].k), 'codes': list_concat({coded(1, 0)}, {coded(2, 1)})}})) from hr where len(l) > 1),
hf as (select image_id, unnest(l[1].codes) as c, len(l[1].codes) as entries from hr where len(l) = 1)"""


def cover(voxels: str, steps: int) -> str:
    """cv (image_id, kl, ka, kb, cluster) of voxels (image_id, kl, ka, kb): roots ascending, claims of up to `steps` neighbours away."""
    near, source = "greatest(abs(v.kl - r.kl), abs(v.ka - r.ka), abs(v.kb - r.kb)) <= 1", "(select image_id, n, l, l[1:1] as took from cr where len(l) > 0)"
    for _ in range(steps):
        source = f"(select image_id, n, l, list_filter(l, lambda v: len(list_filter(took, lambda r: {near})) > 0) as took from {source})"
    return f"""cs as (select image_id, list_sort(list(distinct {{'kl': kl, 'ka': ka, 'kb': kb}})) as l from {voxels} group by image_id),
cr as (select image_id, -1 as n, l, [l[1]] as got from cs union all select image_id, n + 1, list_filter(l, lambda v: not list_contains(took, v)), took from {source}),
cv as (select image_id, n as cluster, unnest(got) as v from cr where n >= 0)"""


def idct(kept: str, step: float, n: int = 8) -> str:
    """rs (image_id, y, x, c): pixels of kept coefficients (image_id, u, w, q) of one n x n block an image."""
    return f"rs as (select image_id, a.i as y, b.i as x, sum(q * {step}::double * a.w * b.w) as c from {kept} k join cs a on a.u = k.u join cs b on b.u = k.w group by all)"


def region_blur(source: str, passes: int = 3) -> str:
    """rb{2 * passes} (image_id, y, x, idx, v): box sums over neighbours of the same cluster, floored after each direction."""
    out, last = [], source
    for k in range(2 * passes):
        over = "partition by image_id, y order by x" if k % 2 == 0 else "partition by image_id, x order by y"
        same = lambda f: f"{f}(idx) over p = idx"
        terms = " + ".join(f"case when {same(f)} then {f}(v) over p else 0 end" for f in ("lag", "lead"))
        count = " + ".join(f"case when {same(f)} then 1 else 0 end" for f in ("lag", "lead"))
        out.append(f"rb{k + 1} as (select image_id, y, x, idx, cast(floor((v + {terms}) / (1 + {count})) as double) as v from {last} window p as ({over}))")
        last = f"rb{k + 1}"
    return ", ".join(out)


def deblocked(source: str, n: int, reach: int, limit: float) -> str:
    """Query over source (image_id, y, x, v) with blocks of n."""
    return f"""dc as (select image_id, y // {n} as by_, x // {n} as bx, v as c from {source} where y % {n} = {n // 2} and x % {n} = {n // 2}),
ds as (select image_id, y, x, v, s.by_, s.bx, s.d from {source}, lateral (values (y // {n}, x // {n} - 1, x % {n}), (y // {n}, x // {n} + 1, {n - 1} - x % {n}), (y // {n} - 1, x // {n}, y % {n}), (y // {n} + 1, x // {n}, {n - 1} - y % {n})) s(by_, bx, d) where s.d < {reach}),
dw as (select image_id, y, x, c, power(({reach} - d) / {reach}::double, 2) * (3 - 2 * ({reach} - d) / {reach}::double) * (1 - abs(c - v) / {limit}) as w from ds join dc using (image_id, by_, bx) where abs(c - v) < {limit}),
dt as (select image_id, y, x, sum(w) as w, sum(w * c) as wc from dw group by all)
select image_id, y, x, round((v + coalesce(wc, 0)) / (1 + coalesce(w, 0)), 6) as v from {source} left join dt using (image_id, y, x)"""


def uniform(seed: int, keys: tuple[str, ...]) -> str:
    h = " + ".join(f"{k}::bigint * {m}" for k, m in zip(keys, (48271, 69621, 40692, 16807), strict=False))
    h = f"(({h} + {seed * 7919 + 12345}) % 2147483647)"
    for add in (12345, 67890):
        h = f"(({h} * {h} + {add}) % 2147483647)"
    return f"({h} / 2147483647.0::double)"


def normal(seed: int, keys: tuple[str, ...]) -> str:
    return f"(sqrt(-2 * ln(greatest({uniform(2 * seed, keys)}, 1e-12))) * cos(2 * pi() * {uniform(2 * seed + 1, keys)}))"


def half(v: str) -> str:
    """A 32-bit float's value cut to a 16-bit float, as palettes hold it."""
    f = f"({v})::float::double"
    cut = f"power(2.0::double, 10 - floor(log2(nullif(abs({f}), 0))))"
    return f"(case when abs({f}) < power(2.0, -14) then 0.0 else sign({f}) * floor(abs({f}) * {cut}) / {cut} end)"


def gauss(radius: int) -> str:
    """Offsets and weights (dy, dx, w) of the similar borders' kernel."""
    rows = ", ".join(f"({dy}, {dx}, {math.exp(-(dy * dy + dx * dx) / (2 * (radius / 2) ** 2))!r}::double)" for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))
    return f"(values {rows}) k(dy, dx, w)"


def hdr(c: str) -> str:
    """A byte as light of 1 / 256 of it, brought back to a byte by a gamma of 2.2."""
    return f"cast(floor(least(255.0, power({c} / 256.0::double, 1 / 2.2::double) * 255 + 0.5)) as int)"
