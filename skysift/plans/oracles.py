"""The queries' SQL, written on its own, for DuckDB."""

from __future__ import annotations

from skysift.plans import file_queries as fq
from skysift.plans import queries as q

W = """HR AS (SELECT user_id % 32 AS chan, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS h, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS x FROM events GROUP BY 1, 2),
HE AS (SELECT min(h) AS first, max(h) - min(h) + 1 AS n FROM HR),
W AS (SELECT c.chan, g.t, coalesce(e.x, 0.0) AS x FROM range(32) c(chan) CROSS JOIN (SELECT unnest(range(n)) AS t, first FROM HE) g LEFT JOIN HR e ON e.chan = c.chan AND e.h = g.t + g.first)"""
RS = """RS AS (SELECT chan, s / n AS mean, qq / n - (s / n) * (s / n) AS var FROM (SELECT chan, count(*) AS n, sum(x) AS s, sum(x * x) AS qq FROM W GROUP BY chan) i)"""
G = """G AS (SELECT avg(mean) AS g_mean, sqrt(avg(var + mean * mean) - avg(mean) * avg(mean)) AS g_std, avg(var) AS mean_var, stddev_pop(var) AS std_var FROM RS)"""
Z = """Z AS (SELECT W.chan, W.t, CASE WHEN abs(var - mean_var) > 4.0 * std_var THEN 0.0 ELSE (x - g_mean) / g_std END AS x, CASE WHEN abs(var - mean_var) > 4.0 * std_var THEN 0.0 ELSE 1.0 END AS mask FROM W JOIN RS ON W.chan = RS.chan CROSS JOIN G)"""
BASE = f"{W}, {RS}, {G}, {Z}"
E = """E AS (SELECT vec_id AS r, CAST(u.c - 1 AS BIGINT) AS c, floor(CAST(embedding[u.c] AS DOUBLE) * 1000 + 0.5) AS x FROM embeddings CROSS JOIN range(1, 65) u(c))"""
S = """S AS (SELECT r // 4 AS fft, (r // 2) % 2 AS chan, r % 2 AS pol, c // 2 AS bin, sum(CASE WHEN c % 2 = 0 THEN x END) AS re, sum(CASE WHEN c % 2 = 1 THEN x END) AS im FROM E GROUP BY 1, 2, 3, 4)"""
P = "P AS (SELECT fft, chan, bin, sum(re * re + im * im) AS x FROM S GROUP BY 1, 2, 3)"
L = """L AS (SELECT l_orderkey AS mt, l_partkey AS mdt, CAST(l_linenumber AS BIGINT) AS mwidth, l_extendedprice AS msnr FROM lineitem)"""


def boxes(source: str, widths: list[int], by: str = "chan", x: str = "x", keys: str = "") -> str:
    """All windows that fit: (keys, chan, t, width, s)."""
    return " UNION ALL ".join(f"SELECT {keys}chan, t, CAST({n} AS BIGINT) AS width, s FROM (SELECT {keys}chan, t, sum({x}) OVER v AS s, count(*) OVER v AS n FROM {source} WINDOW v AS (PARTITION BY {by} ORDER BY t ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) b WHERE n = {n}" for n in widths)


def cand(widths: list[int], name: str = "C", threshold: float = q.THRESHOLD, source: str = "Z", keys: str = "", also: str = "") -> str:
    return f"{name} AS (SELECT {keys}t AS mt, chan AS mdt, width AS mwidth, round(s / sqrt(width), 6) AS msnr FROM ({boxes(source, widths, keys + 'chan', keys=keys)}) a WHERE s / sqrt(width) > {threshold}{also})"


def gap(source: str, group: str, axis: str, by: int, name: str, out: str) -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"{out} AS (SELECT * EXCLUDE (nw), CAST(sum(nw) OVER ({part}ORDER BY {axis} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS {name} FROM (SELECT *, CASE WHEN {axis} - lag({axis}) OVER ({part}ORDER BY {axis}) > {by} THEN 1 ELSE 0 END AS nw FROM {source}) i)"


def grouped(source: str, gaps: tuple[int, int, int], keys: str = "") -> str:
    return ", ".join([gap(source, keys.rstrip(", "), "mt", gaps[0], "g1", "G1"), gap("G1", keys + "g1", "mdt", gaps[1], "g2", "G2"), gap("G2", keys + "g1, g2", "mwidth", gaps[2], "g3", "G3")])


D = "D AS (SELECT mt, mdt, mwidth, msnr, num FROM (SELECT *, row_number() OVER (PARTITION BY g1, g2, g3 ORDER BY msnr DESC, mt, mdt, mwidth) AS rn, count(*) OVER (PARTITION BY g1, g2, g3) AS num FROM G3) i WHERE rn = 1)"
CLUSTERED = f"WITH {BASE}, {cand(q.WIDTHS)}, {grouped('C', q.GAPS)}, {D}"
RANKED = "row_number() OVER (ORDER BY mt, mdt, mwidth)"


def r(x: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def fdmt(parts, tag: str = "0", source: str = "W", x: str = "x", keys: str = "") -> list[str]:
    """CTEs of a transform; the last is named K and the tag: (keys, k, t, x)."""
    delays, plan = parts
    rows = ", ".join(f"({c}, {k}, {d})" for c, grid in delays.items() for k, d in enumerate(grid))
    names = keys.replace(" ", "").split(",")[:-1]
    own, same = "".join(f"a.{n}, " for n in names), "".join(f" AND b.{n} = a.{n}" for n in names)
    out = [
        f"I{tag}(chan, k, d) AS (VALUES {rows})",
        f"Q{tag} AS (SELECT {keys}chan, t, sum({x}) OVER (PARTITION BY {keys}chan ORDER BY t ROWS UNBOUNDED PRECEDING) AS p FROM {source})",
        f"A{tag}_0 AS (SELECT {own}a.chan AS sub, i.k, a.t, CASE WHEN a.t >= i.d THEN (a.p - coalesce(b.p, 0.0)) / (i.d + 1) ELSE 0.0 END AS x FROM Q{tag} a JOIN I{tag} i ON i.chan = a.chan LEFT JOIN Q{tag} b ON b.chan = a.chan AND b.t = a.t - i.d - 1{same})",
    ]
    for n, nodes in enumerate(plan, 1):
        rows = ", ".join(f"({v.sub}, {v.k}, {v.tail_sub}, {v.tail_k}, {-1 if v.head_sub is None else v.head_sub}, {-1 if v.head_k is None else v.head_k}, {v.offset})" for v in nodes)
        out.append(f"N{tag}_{n}(sub, k, ts, tk, hs, hk, o) AS (VALUES {rows})")
        out.append(f"A{tag}_{n} AS MATERIALIZED (SELECT {own}n.sub, n.k, a.t, a.x + coalesce(b.x, 0.0) AS x FROM N{tag}_{n} n JOIN A{tag}_{n - 1} a ON a.sub = n.ts AND a.k = n.tk LEFT JOIN A{tag}_{n - 1} b ON b.sub = n.hs AND b.k = n.hk AND b.t = a.t - n.o{same})")
    out.append(f"K{tag} AS (SELECT {keys}CAST(k AS BIGINT) AS k, CAST(t AS BIGINT) AS t, x FROM A{tag}_{len(plan)})")
    return out


#: Samples of all chunks; those that the last one lacks count as 0.
FILLED = f"""SELECT k.chunk, c.chan, o.pol, i.isamp, coalesce(S.re, 0.0) AS re, coalesce(S.im, 0.0) AS im FROM (SELECT DISTINCT (fft * 32 + bin) // {q.CHUNK} AS chunk FROM S) k CROSS JOIN range({q.SEARCH.channels}) c(chan) CROSS JOIN range(2) o(pol) CROSS JOIN range({q.CHUNK}) i(isamp)
LEFT JOIN S ON S.fft = (k.chunk * {q.CHUNK} + i.isamp) // 32 AND S.bin = (k.chunk * {q.CHUNK} + i.isamp) % 32 AND S.chan = c.chan AND S.pol = o.pol"""


def coherent(p=q.SEARCH, samples: str = FILLED, circular: bool = True) -> list[str]:
    """CTEs from complex samples to the images (chunk, trial, k, t, x) in CR."""
    round_ = "" if circular else " OR w.t < w.shift"
    pi = "3.141592653589793"
    mbin, step, pad = p.nbin // p.subs, p.nbin - 2 * p.overlap, p.overlap // p.subs
    bw = (p.f_max - p.f_min) / p.channels
    band, width, n = bw / p.subs, (p.f_max - p.f_min) / p.rows, p.samples
    fb = f"(-{band} / 2 + (b.bin + 0.5) * {band} / {mbin}.0)"
    fc = f"({p.f_min} + {bw} * (0.5 + c.chan) + {band} * (s.sub - {p.subs / 2} + 0.5))"
    phase = f"(d.dm * ({fb} / {fc}) * ({fb} / {fc}) / ({fc} + {fb}) * 4.148808e9)"
    trials = ", ".join(f"({i}, {dm})" for i, dm in enumerate(p.dms))
    f = f"({p.rows - 1} - r.row) * {width} + {p.f_min}"
    lag = f"4148.808 * d.dm * (1 / ({p.f_min} * {p.f_min}) - 1 / (({f}) * ({f}))) / {p.t_sample * p.subs}"
    by = "chunk, trial, "
    return [
        f"CS AS ({samples})",
        f"CX AS MATERIALIZED (SELECT chunk, chan, pol, f.fft, (k.q + {p.nbin // 2}) % {p.nbin} AS n, sum(re * cos(k.q * (isamp - {step} * f.fft + {p.overlap}) % {p.nbin} * 2 * {pi} / {p.nbin}) + im * sin(k.q * (isamp - {step} * f.fft + {p.overlap}) % {p.nbin} * 2 * {pi} / {p.nbin})) AS re, sum(im * cos(k.q * (isamp - {step} * f.fft + {p.overlap}) % {p.nbin} * 2 * {pi} / {p.nbin}) - re * sin(k.q * (isamp - {step} * f.fft + {p.overlap}) % {p.nbin} * 2 * {pi} / {p.nbin})) AS im FROM CS CROSS JOIN range({p.nfft}) f(fft) CROSS JOIN range({p.nbin}) k(q) WHERE isamp - {step} * f.fft + {p.overlap} BETWEEN 0 AND {p.nbin - 1} GROUP BY 1, 2, 3, 4, 5)",
        f"CD(trial, dm) AS (VALUES {trials})",
        f"CH AS (SELECT trial, chan, sub, bin, cos(turn) * taper AS re, -sin(turn) * taper AS im FROM (SELECT d.trial, c.chan, s.sub, b.bin, ({phase} - floor({phase})) * 2 * {pi} AS turn, 1 / sqrt(1 + pow({fb} / {0.47 * band}, 80.0)) AS taper FROM CD d CROSS JOIN range({p.channels}) c(chan) CROSS JOIN range({p.subs}) s(sub) CROSS JOIN range({mbin}) b(bin)) i)",
        f"CP AS MATERIALIZED (SELECT x.chunk, h.trial, x.chan, x.pol, x.fft, h.sub, h.bin, x.re * h.re - x.im * h.im AS re, x.re * h.im + x.im * h.re AS im FROM CX x JOIN CH h ON h.chan = x.chan AND h.sub = x.n // {mbin} AND h.bin = x.n % {mbin})",
        f"CY AS (SELECT chunk, trial, chan, pol, fft, sub, m.m, sum(re * cos(bin * m.m % {mbin} * 2 * {pi} / {mbin}) - im * sin(bin * m.m % {mbin} * 2 * {pi} / {mbin})) / {p.nbin} AS re, sum(im * cos(bin * m.m % {mbin} * 2 * {pi} / {mbin}) + re * sin(bin * m.m % {mbin} * 2 * {pi} / {mbin})) / {p.nbin} AS im FROM CP CROSS JOIN range({mbin}) m(m) GROUP BY 1, 2, 3, 4, 5, 6, 7)",
        f"CT AS (SELECT d.trial, r.row, CAST(sign({lag}) * floor(abs({lag}) + 0.5) AS BIGINT) % {n} AS shift FROM CD d CROSS JOIN range({p.rows}) r(row))",
        f"CW AS (SELECT y.chunk, y.trial, row AS chan, (t + shift) % {n} AS t, shift, x FROM (SELECT chunk, trial, ({p.channels - 1} - chan) * {p.subs} + {p.subs - 1} - sub AS r, m - {pad} + {mbin - 2 * pad} * fft AS t, sum(re * re + im * im) AS x FROM CY WHERE m >= {pad} AND m < {mbin - pad} GROUP BY 1, 2, 3, 4) y JOIN CT c ON c.trial = y.trial AND c.row = y.r)",
        "CV AS (SELECT chunk, trial, chan, avg(x) AS mean, avg(x * x) - avg(x) * avg(x) AS var FROM CW GROUP BY 1, 2, 3)",
        "CG AS (SELECT chunk, trial, avg(mean) AS g_mean, sqrt(avg(var + mean * mean) - avg(mean) * avg(mean)) AS g_std, avg(var) AS mean_var, stddev_pop(var) AS std_var FROM CV GROUP BY 1, 2)",
        f"CZ AS MATERIALIZED (SELECT w.chunk, w.trial, w.chan, w.t, CASE WHEN abs(var - mean_var) > 4.0 * std_var{round_} THEN 0.0 ELSE (x - g_mean) / g_std END AS x, CASE WHEN abs(var - mean_var) > 4.0 * std_var THEN 0.0 ELSE 1.0 END AS mask FROM CW w JOIN CV v ON v.chunk = w.chunk AND v.trial = w.trial AND v.chan = w.chan JOIN CG g ON g.chunk = w.chunk AND g.trial = w.trial)",
        *fdmt(q.search_parts(p), "8", "CZ", "x", by),
        *fdmt(q.search_parts(p), "9", "CZ", "mask", by),
        "CR AS (SELECT a.chunk, CAST(a.trial AS BIGINT) AS trial, a.k, a.t, a.x / sqrt(b.x + 1e-8) AS x FROM K8 a JOIN K9 b ON b.chunk = a.chunk AND b.trial = a.trial AND b.k = a.k AND b.t = a.t)",
    ]


def searched(p, own: str = "SELECT * FROM C") -> str:
    """CTEs from images to the delegates (chunk, mt, mdt, mwidth, msnr, num) in D; own: which candidates of C take part.

    Samples that are all the same give no number, and no candidate; to DuckDB, what is no number is over every threshold.
    """
    found = cand(list(p.widths), threshold=p.threshold, source="CI", keys="chunk, ", also=" AND NOT isnan(s)")
    best = D.replace("PARTITION BY g1", "PARTITION BY chunk, g1").replace("SELECT mt", "SELECT chunk, mt")
    return f"CI AS (SELECT chunk, trial * {p.subs} + k AS chan, t, x FROM CR), {found}, CO AS ({own}), {grouped('CO', p.gaps, 'chunk, ')}, {best}"


def _recorded(p=fq.CHUNKED) -> dict[str, str]:
    """Searches of recordings; a chunk's number there is 1000 times its block's and its own."""
    n = fq.LONG * 16
    step, length, ov = p.length - 2 * p.overlap, p.length, p.overlap
    many = max(0, (n - 2 * ov - 1) // step)
    v = "V AS (SELECT r, c, CAST(((CAST(x AS BIGINT) % 256) + 256) % 256 - 128 AS DOUBLE) AS v FROM E)"
    firsts = f"J AS (SELECT j.j AS chunk, greatest(0, least(j.j * {step}, {n - length})) AS first FROM range({many + 1}) j(j))"
    full = f"B AS (SELECT b.block, c.chan, i.pl FROM (SELECT DISTINCT r // {2 * fq.LONG} AS block FROM V) b CROSS JOIN range(2) c(chan) CROSS JOIN range({fq.LONG * 64}) i(pl))"
    m = f"M AS (SELECT B.block, B.chan, B.pl, coalesce(V.v, 0) AS v FROM B LEFT JOIN V ON V.r = B.block * {2 * fq.LONG} + B.chan * {fq.LONG} + B.pl // 64 AND V.c = B.pl % 64)"
    cells = "N AS (SELECT block, chan, (pl // 2) % 2 AS pol, pl // 4 AS isamp, sum(CASE WHEN pl % 2 = 0 THEN v END) AS re, sum(CASE WHEN pl % 2 = 1 THEN v END) AS im FROM M GROUP BY 1, 2, 3, 4)"
    base = f"{E}, {v}, {firsts}, {full}, {m}, {cells}"
    samples = f"SELECT block * 1000 + chunk AS chunk, chan, pol, isamp - first AS isamp, re, im FROM N JOIN J ON isamp >= first AND isamp < first + {length}"
    own_from = f"CASE WHEN j.chunk = 0 THEN 0 ELSE i.first + {length - ov} - j.first END"
    own_to = f"CASE WHEN j.chunk = {many} THEN {length} ELSE {length - ov} END"
    own = f"O AS (SELECT j.chunk, j.first, CAST({own_from} AS BIGINT) AS own_from, CAST({own_to} AS BIGINT) AS own_to FROM J j LEFT JOIN J i ON i.chunk = j.chunk - 1)"
    image = f"{base}, {', '.join(coherent(p, samples))}"
    mine = f"SELECT C.chunk // 1000 AS chunk, mt + first // {p.subs} AS mt, mdt, mwidth, msnr FROM C JOIN O ON O.chunk = C.chunk % 1000 WHERE mt * {p.subs} >= own_from AND mt * {p.subs} < own_to"
    s = q.SEARCH
    plane = "P0 AS (SELECT c % 4 AS plane, r * 16 + c // 4 AS pl, v FROM V), N AS (SELECT pl % 2 AS chan, plane // 2 AS pol, pl // 2 AS isamp, sum(CASE WHEN plane % 2 = 0 THEN v END) AS re, sum(CASE WHEN plane % 2 = 1 THEN v END) AS im FROM P0 GROUP BY 1, 2, 3)"
    sizes = f"Y AS (SELECT max(isamp) + 1 AS n FROM N), J AS (SELECT j.j AS chunk, greatest(0, least(j.j * {s.length - 2 * s.overlap}, n - {s.length})) AS first FROM Y CROSS JOIN range(1000000) j(j) WHERE j.j <= greatest(0, (n - {2 * s.overlap + 1}) // {s.length - 2 * s.overlap}))"
    each = f"SELECT chunk, chan, pol, isamp - first AS isamp, re, im FROM N JOIN J ON isamp >= first AND isamp < first + {s.length}"
    numbered = "row_number() OVER (PARTITION BY chunk ORDER BY mt, mdt, mwidth) AS n"
    return {
        "raw_where": f"WITH {E}, {v}, M AS (SELECT r // 4 AS block, (r // 2) % 2 AS chan, (r % 2) * 64 + c AS pl, v FROM V) SELECT block, chan, CAST((pl // 2) % 2 AS INTEGER) AS pol, pl // 4 AS isamp, sum(CASE WHEN pl % 2 = 0 THEN v END) AS re, sum(CASE WHEN pl % 2 = 1 THEN v END) AS im FROM M WHERE block BETWEEN 2 AND 9 AND chan = 1 GROUP BY 1, 2, 3, 4",
        "raw_chunks": f"WITH {base}, {own} SELECT block, chunk, first, CAST({length} AS BIGINT) AS taken, own_from, own_to, CAST({n} AS BIGINT) AS samples, CAST(2 AS INTEGER) AS nchan, CAST(8 AS INTEGER) AS nbits, CAST(1400 AS DOUBLE) AS obs_freq FROM (SELECT DISTINCT block FROM N) b CROSS JOIN O",
        "recording_search": f"WITH {image}, {searched(p)} SELECT chunk // 1000 AS block, chunk % 1000 AS chunk, mt, mdt, mwidth, msnr, num, {numbered} FROM D",
        "recording_search_once": f"WITH {base}, {', '.join(coherent(p, samples, circular=False))}, {own}, {searched(p, mine)} SELECT chunk AS block, mt, mdt, mwidth, msnr, num, {numbered} FROM D",
        "plane_search": f"WITH {E}, {v}, {plane}, {sizes}, {', '.join(coherent(s, each))}, {searched(s)} SELECT CAST(0 AS BIGINT) AS block, chunk, mt, mdt, mwidth, msnr, num, {numbered} FROM D",
    }


def _chirp(subs: int, channels: int = 2, bands: str = f"SELECT 0 AS obs, {q.F_MIN}::DOUBLE AS f_min, {2 * q.CHAN_BW}::DOUBLE AS bandwidth, {q.DM}::DOUBLE AS dm") -> str:
    bw = f"(o.bandwidth / {channels})"
    fb = f"(-({bw} / {subs}) / 2 + (b.bin + 0.5::DOUBLE) * ({bw} / {subs}) / {q.MBIN}.0::DOUBLE)"
    fc = f"(o.f_min + {bw} * (0.5::DOUBLE + c.chan) + {bw} / {subs} * (s.sub - {subs / 2}::DOUBLE + 0.5::DOUBLE))"
    phase = f"(o.dm * ({fb} / {fc}) * ({fb} / {fc}) / ({fc} + {fb}) * 4.148808e9::DOUBLE)"
    return (
        f"H AS (SELECT obs, chan, sub, bin, cos(turn) * taper AS re, -sin(turn) * taper AS im FROM (SELECT o.obs, c.chan, s.sub, b.bin, ({phase} - floor({phase})) * {2 * 3.141592653589793} AS turn, "
        f"1 / sqrt(1 + pow({fb} / (0.47::DOUBLE * ({bw} / {subs})), 80.0::DOUBLE)) AS taper FROM ({bands}) o CROSS JOIN range({channels}) c(chan) CROSS JOIN range({subs}) s(sub) CROSS JOIN range({q.MBIN}) b(bin)) i)"
    )


OBS = "SELECT *, f_min + bandwidth AS f_max FROM (SELECT s_suppkey AS obs, 20.0::DOUBLE + s_suppkey % 600 AS dm, 400.0::DOUBLE + s_suppkey % 1000 AS f_min, 8.0::DOUBLE * (1 + s_suppkey % 16) AS bandwidth, 0.25::DOUBLE * (1 + s_suppkey % 5) AS chan_bw, 1e-6::DOUBLE * (1 + s_suppkey % 7) AS t_sample, 1e-4::DOUBLE * (1 + s_suppkey % 9) AS pulse FROM supplier) o"


def _dft(sign: str, scale: str, digits: int) -> str:
    # The angle uses the product modulo 64, which keeps it small.
    angle = "2 * pi() * ((k.k * E.c) % 64) / 64.0"
    return f"WITH {E} SELECT E.r, k.k AS c, {r(f'sum(E.x * cos({angle})){scale}', digits, 're')}, {r(f'sum({sign}E.x * sin({angle})){scale}', digits, 'im')} FROM E CROSS JOIN range(64) k(k) GROUP BY 1, 2"


def _plans() -> str:
    """The truncating plan in SQL of its own, in single precision where the results hang on it."""
    n, rows = q.PLANNED
    steps = n.bit_length() - 1
    part = lambda a, b: f"(1 / (CAST({a} AS DOUBLE) * CAST({a} AS DOUBLE)) - 1 / (CAST({b} AS DOUBLE) * CAST({b} AS DOUBLE)))"
    deep = lambda a, b: f"CAST(ceil({part(a, b)} / {part('lo', 'hi')} * {rows - 1}.0::DOUBLE) AS BIGINT)"
    ctes = [
        f"O AS (SELECT obs, CAST(f_min AS FLOAT) AS lo, CAST(f_max AS FLOAT) AS hi FROM ({OBS}) o)",
        f"X AS (SELECT obs, lo, hi, i.i, CASE WHEN i.i = {n} THEN hi ELSE lo + CAST(i.i AS FLOAT) * (hi - lo) / CAST({n} AS FLOAT) END AS f FROM O CROSS JOIN range({n + 1}) i(i))",
        f"L0 AS (SELECT obs, i AS sub, first, first + 1 AS n FROM (SELECT obs, i, {deep('lo', f'(lo + (hi - lo) / CAST({n} AS FLOAT))')} AS first FROM X WHERE i < {n}) x)",
    ]
    for s in range(1, steps + 1):
        w = 1 << s
        ctes.append(f"L{s} AS (SELECT a.obs, a.i // {w} AS sub, {deep('a.f', 'c.f').replace('(lo', '(a.lo').replace('CAST(lo', 'CAST(a.lo').replace('CAST(hi', 'CAST(a.hi')} + 1 AS n, CAST({part('a.f', 'b.f')} / {part('a.f', 'c.f')} AS FLOAT) AS c0, CAST({part('b.f', 'c.f')} / {part('a.f', 'c.f')} AS FLOAT) AS c1 FROM X a JOIN X b ON b.obs = a.obs AND b.i = a.i + {w // 2} JOIN X c ON c.obs = a.obs AND c.i = a.i + {w} WHERE a.i % {w} = 0)")
        ctes.append(f"S{s} AS (SELECT l.obs, CAST({s} AS BIGINT) AS step, l.sub, k.k, least(CAST(trunc(l.c0 * CAST(k.k AS FLOAT)) AS BIGINT), t.n - 1) AS tail_k, least(CAST(trunc(l.c1 * CAST(k.k AS FLOAT)) AS BIGINT), h.n - 1) AS head_k, CAST(trunc(l.c0 * CAST(k.k AS FLOAT)) AS BIGINT) AS late FROM L{s} l JOIN L{s - 1} t ON t.obs = l.obs AND t.sub = 2 * l.sub JOIN L{s - 1} h ON h.obs = l.obs AND h.sub = 2 * l.sub + 1 CROSS JOIN range({2 * rows}) k(k) WHERE k.k < l.n)")
    every = " UNION ALL ".join(f"SELECT * FROM S{s}" for s in range(1, steps + 1))
    return f"WITH {', '.join(ctes)} SELECT e.*, f.first FROM ({every}) e JOIN (SELECT DISTINCT obs, first FROM L0) f ON f.obs = e.obs"


def _rounded_plans() -> str:
    """The rounding plan in SQL of its own, in single precision where the results hang on it."""
    n = q.PLANNED[0]
    steps = n.bit_length() - 1
    part = lambda a, b: f"(1 / (CAST({a} AS DOUBLE) * CAST({a} AS DOUBLE)) - 1 / (CAST({b} AS DOUBLE) * CAST({b} AS DOUBLE)))"
    share = lambda a, b, c, d: f"CAST({part(a, b)} / {part(c, d)} AS FLOAT)"
    near = lambda x: f"CAST(floor(CAST({x} AS DOUBLE) + 0.5::DOUBLE) AS BIGINT)"
    ctes = [f"O AS (SELECT obs, lo, hi, (hi - lo) / CAST({n} AS FLOAT) AS w FROM (SELECT obs, CAST(f_min AS FLOAT) AS lo, CAST(f_max AS FLOAT) AS hi FROM ({OBS}) o) p)"]
    for s in range(steps + 1):
        wide = f"(w * CAST({1 << s} AS FLOAT))"
        ctes.append(f"B{s} AS (SELECT *, a + {wide} AS b, a + {wide} / CAST(2 AS FLOAT) AS m FROM (SELECT O.*, i.i AS sub, {wide} * CAST(i.i AS FLOAT) + lo AS a FROM O CROSS JOIN range({n >> s}) i(i)) x)")
        ctes.append(f"D{s} AS (SELECT *, {near(f'CAST({q.DT_MAX} AS FLOAT) * ' + share('a', 'b', 'lo', 'hi'))} + 1 AS n, {share('a', '(m - w / CAST(2 AS FLOAT))', 'a', 'b')} AS lead, {share('a', '(m + w / CAST(2 AS FLOAT))', 'a', 'b')} AS trail FROM B{s})")
        if s:
            ctes.append(f"S{s} AS (SELECT l.obs, CAST({s} AS BIGINT) AS step, l.sub, k.k, least({near('CAST(k.k AS FLOAT) * l.lead')}, t.n - 1) AS tail_k, least(greatest(k.k - {near('CAST(k.k AS FLOAT) * l.trail')}, 0), h.n - 1) AS head_k, {near('CAST(k.k AS FLOAT) * l.trail')} AS late FROM D{s} l JOIN D{s - 1} t ON t.obs = l.obs AND t.sub = 2 * l.sub JOIN D{s - 1} h ON h.obs = l.obs AND h.sub = 2 * l.sub + 1 CROSS JOIN range({q.DT_MAX + 2}) k(k) WHERE k.k < l.n)")
    every = " UNION ALL ".join(f"SELECT * FROM S{s}" for s in range(1, steps + 1))
    return f"WITH {', '.join(ctes)} SELECT e.*, f.n AS delays FROM ({every}) e JOIN D{steps} f ON f.obs = e.obs"


def _files(z: str) -> dict[str, str]:
    v = "V AS (SELECT r, c, CAST(((CAST(x AS BIGINT) % 256) + 256) % 256 - 128 AS DOUBLE) AS v FROM E)"
    cells = f"{E}, {v}, M AS (SELECT r // 4 AS block, (r // 2) % 2 AS chan, (r % 2) * 64 + c AS pl, v FROM V), N AS (SELECT block, chan, CAST((pl // 2) % 2 AS INTEGER) AS pol, pl // 4 AS isamp, sum(CASE WHEN pl % 2 = 0 THEN v END) AS re, sum(CASE WHEN pl % 2 = 1 THEN v END) AS im FROM M GROUP BY 1, 2, 3, 4)"
    frames = "coalesce(n.re, 0.0) AS re, coalesce(n.im, 0.0) AS im"
    return {
        "raw_headers": "SELECT b.block, c.chan, CAST(8 AS INTEGER) AS nbits, CAST(4 AS INTEGER) AS npol, CAST(2 AS INTEGER) AS nchan, CAST(0.5 AS DOUBLE) AS chan_bw, CAST(1400 AS DOUBLE) AS obs_freq, 'GBT' AS telescope, CAST(128 AS INTEGER) AS bytes FROM (SELECT DISTINCT vec_id // 4 AS block FROM embeddings) b CROSS JOIN range(2) c(chan)",
        "raw_samples": f"WITH {cells} SELECT * FROM N",
        "indexed_samples": f"WITH {cells} SELECT * FROM N",
        "raw_blocks": f"WITH {cells} SELECT * FROM N WHERE block IN (1, 3, 7)",
        "raw_frames": f"WITH {cells}, K AS (SELECT DISTINCT block, chan, pol FROM N) SELECT k.block, k.chan, k.pol, f.fft, b.bin, {frames} FROM K k CROSS JOIN range(4) f(fft) CROSS JOIN range(12) b(bin) LEFT JOIN N n ON n.block = k.block AND n.chan = k.chan AND n.pol = k.pol AND n.isamp = b.bin + 8 * f.fft - 2",
        "plane_frames": f"WITH {E}, {v}, M AS (SELECT c % 4 AS plane, r * 16 + c // 4 AS pl, v FROM V), N AS (SELECT pl % 8 AS chan, CAST(plane // 2 AS INTEGER) AS pol, pl // 8 AS isamp, sum(CASE WHEN plane % 2 = 0 THEN v END) AS re, sum(CASE WHEN plane % 2 = 1 THEN v END) AS im FROM M GROUP BY 1, 2, 3), K AS (SELECT DISTINCT chan, pol FROM N) SELECT k.chan, k.pol, f.fft, b.bin, {frames} FROM K k CROSS JOIN (SELECT unnest(range((SELECT (max(isamp) + 1) // 10 FROM N))) AS fft) f CROSS JOIN range(14) b(bin) LEFT JOIN N n ON n.chan = k.chan AND n.pol = k.pol AND n.isamp = b.bin + 10 * f.fft - 2",
        "npy_round_trip": f"WITH {E} SELECT r, c, x FROM E",
        "report_file": "SELECT o_orderkey % 7 AS block, o_custkey AS chunk, CAST(256 AS BIGINT) AS rows, CAST(4096 AS BIGINT) AS cols, o_orderkey % 256 AS suc_row, o_custkey % 4096 AS suc_col, CAST(30.5 AS DOUBLE) AS coh_disp, o_orderkey % 9 AS wind_width FROM orders",
        "candidate_log": f"{z}, {cand(q.WIDTHS)}, N AS (SELECT *, row_number() OVER (ORDER BY mt, mdt, mwidth) AS n FROM C) SELECT lpad(CAST(n AS VARCHAR), 10, ' ') || lpad(CAST(mt AS VARCHAR), 10, ' ') || lpad(printf('%.6f', mt * 0.001), 10, ' ') || lpad(CAST(mdt AS VARCHAR), 10, ' ') || lpad(CAST(mwidth AS VARCHAR), 10, ' ') || lpad(printf('%.6f', msnr), 10, ' ') AS line FROM N",
        "scalar_plans": f"WITH s AS (SELECT *, floor(4148.808::DOUBLE * dm * (1 / (f_min * f_min) - 1 / ((f_min + chan_bw) * (f_min + chan_bw))) / t_sample + 0.5::DOUBLE) / 2 AS n, 1 / (f_min * f_min) - 1 / (f_max * f_max) AS lag, 1e-6::DOUBLE / (f_max - f_min) AS tel FROM ({OBS}) p), u AS (SELECT *, (4148.8::DOUBLE * dm * lag / tel) / ((pulse / tel) * (pulse / tel)) AS ratio FROM s) SELECT obs, CASE WHEN n > 0 THEN CAST(pow(2, floor(log2(n) + 0.5)) AS BIGINT) ELSE 0 END AS overlap, CAST(ceil(4148.808::DOUBLE * dm * lag * t_sample / (pulse * pulse)) AS BIGINT) AS trials, CAST(ceil(pulse / t_sample) AS BIGINT) AS subs, greatest(1, CAST(floor(4148.8::DOUBLE * dm * lag / ratio / pulse) AS BIGINT)) AS max_dt FROM u",
        "final_measures": f"SELECT obs, i.i, {r('i.i * t_sample / (4149.3774::DOUBLE * (1 / (f_min * f_min) - 1 / (f_max * f_max)))', 6, 'dm')} FROM ({OBS}) o CROSS JOIN range({q.DT_MAX}) i(i) WHERE i.i <= obs % {q.DT_MAX}",
        "direct_blocks": f"SELECT b.block, (b.block % {fq.BLOCKS}) * ({-(-80 * fq.CARDS // fq.SECTOR) * fq.SECTOR} + {-(-2 * fq.EACH * 64 // fq.SECTOR) * fq.SECTOR}) + {-(-80 * fq.CARDS // fq.SECTOR) * fq.SECTOR} AS offset, CAST({fq.EACH * 64} AS BIGINT) AS stride, CAST({fq.EACH * 16} AS BIGINT) AS samples, false AS descending FROM (SELECT DISTINCT vec_id // {2 * fq.EACH} AS block FROM embeddings) b",
        "direct_samples": f"WITH {cells} SELECT * FROM N",
        "sidecar_headers": f"SELECT obs, CAST(8 AS INTEGER) AS nbits, CAST(4 AS INTEGER) AS npol, CAST(1 + obs % 8 AS INTEGER) AS nchan, {r('chan_bw')}, {r('f_min', 6, 'cent_freq')}, {r('(1 + obs % 8) * chan_bw', 6, 'obs_bw')}, obs * 4000 * (1 + obs % 8) AS block_size, t_sample AS t_resolution, CAST(59000.5 AS DOUBLE) AS tstart FROM ({OBS}) o",
        "packed_headers": f"SELECT CAST(obs AS INTEGER) AS samples, CAST(obs % 5 AS INTEGER) AS n_p, dm AS d_max, f_min, f_max, CAST(4.5 AS DOUBLE) AS sigma FROM ({OBS}) o",
        "image_bundle": f"WITH {E} SELECT g.g AS bundle, r.r, c.c, coalesce(E.x, 0.0) AS x, CAST(64 AS BIGINT) AS max_dt, CAST(1000 + g.g AS DOUBLE) AS f_min, CAST(1500 AS DOUBLE) AS f_max FROM (SELECT DISTINCT r // 64 AS g FROM E) g CROSS JOIN range(64) r(r) CROSS JOIN range(64) c(c) LEFT JOIN E ON E.r = g.g * 64 + r.r AND E.c = c.c",
        "candidate_counts": "SELECT l_linenumber * 2 + l_suppkey % 2 AS g, count(*) AS n FROM lineitem GROUP BY 1",
        "run_logs": "SELECT DISTINCT o_orderkey % 50 AS run, o_custkey % 40 AS chunk FROM orders",
        "array_ranges": f"WITH {E} SELECT r, c, x FROM E",
        "float_dump": f"WITH {E} SELECT r * 64 + c AS i, x FROM E",
        "chunk_logs": f"{z}, {cand(q.WIDTHS)}, N AS (SELECT *, row_number() OVER (ORDER BY mt, mdt, mwidth) AS n FROM C), O AS (SELECT DISTINCT mdt AS block, mt // 240 AS chunk FROM N) SELECT mdt AS block, mt // 240 AS chunk, lpad(CAST(n AS VARCHAR), 10, ' ') || lpad(CAST(mt AS VARCHAR), 10, ' ') || lpad(printf('%.6f', mt * 0.001), 10, ' ') || lpad(CAST(mdt AS VARCHAR), 10, ' ') || lpad(CAST(mwidth AS VARCHAR), 10, ' ') || lpad(printf('%.6f', msnr), 10, ' ') || lpad('1', 10, ' ') AS line FROM N UNION ALL SELECT block, chunk, lpad('N', 10, ' ') || lpad('t, bin', 10, ' ') || lpad('t, sec', 10, ' ') || lpad('dedisp', 10, ' ') || lpad('width', 10, ' ') || lpad('SNR', 10, ' ') || lpad('num', 10, ' ') FROM O",
        "image_files": f"WITH {E} SELECT (SELECT max(r) FROM E) - r AS r, c, abs(CAST(trunc(x * 255.0 / (SELECT max(abs(x)) FROM E)) AS BIGINT)) AS level FROM E",
    }


def oracle_sql() -> dict[str, str]:
    z = f"WITH {BASE}"
    width = (q.F_MAX - q.F_MIN) / 32
    lag = f"4148.808 * {q.DM} * (1 / ({q.F_MIN} * {q.F_MIN}) - 1 / (((31 - chan) * {width} + {q.F_MIN}) * ((31 - chan) * {width} + {q.F_MIN}))) / {q.T_SAMPLE}"
    step = q.NBIN - 2 * q.OVERLAP
    o = {
        "row_stats": f"WITH {W}, {RS} SELECT chan, {r('mean', 3)}, {r('var', 3)} FROM RS",
        "global_stats": f"WITH {W}, {RS}, {G} SELECT {r('g_mean', 3, 'mean')}, {r('g_std', 3, 'std')} FROM G",
        "disp_stats": f"WITH {W}, {RS}, {G} SELECT {r('mean_var', 1)}, {r('std_var', 1)} FROM G",
        "rfi_excise_zscore": f"{z} SELECT chan, t, {r('x')}, mask FROM Z",
        "rfi_clean": f"{z} SELECT W.chan, W.t, CASE WHEN mask = 0 THEN 0.0 ELSE W.x END AS x FROM W JOIN Z ON W.chan = Z.chan AND W.t = Z.t",
        "quarter_scale": f"WITH {W}, {RS}, {G} SELECT chan, t, {r('(x - g_mean) / (g_std * 0.25)', 6, 'x')} FROM W CROSS JOIN G",
        "dispersion_about": f"WITH {W} SELECT chan, {r('sum((x - 2000.0) * (x - 2000.0)) / count(*)', 3, 'disp')} FROM W GROUP BY chan",
        "summary_moments": f"""WITH a AS (SELECT l_returnflag, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS m FROM lineitem GROUP BY 1),
b AS (SELECT a.l_returnflag, n, lo, hi, m, sum((l_quantity - m) ** 2) AS m2, sum((l_quantity - m) ** 3) AS m3, sum((l_quantity - m) ** 4) AS m4 FROM a JOIN lineitem i ON a.l_returnflag = i.l_returnflag GROUP BY 1, 2, 3, 4, 5)
SELECT l_returnflag, n, lo AS min_v, hi AS max_v, {r('m', 5, 'mean_v')}, {r('m2 / (n - 1)', 5, 'var_v')}, {r('m2 / n', 5, 'var_n')}, {r('sqrt(n) * m3 / pow(m2, 1.5)', 5, 'skew')}, {r('n * m4 / (m2 * m2)', 5, 'kurt')} FROM b""",
        "max_element": f"WITH {W} SELECT max(x) AS max_x FROM W",
        "boxcar_pow2": f"{z}, {cand(q.POW2)} SELECT mt, mdt, CAST(round(log2(mwidth)) AS BIGINT) AS mwidth, msnr FROM C",
        "boxcar_plan": f"{z} SELECT chan AS mdt, t AS mt, CAST(sum(CASE WHEN s / sqrt(width) > {q.THRESHOLD} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ({boxes('Z', q.WIDTHS)}) a GROUP BY 1, 2",
        "boxcar_linear": f"{z}, {cand(q.WIDTHS)} SELECT * FROM C",
        "below_threshold": f"{z}, {cand(q.WIDTHS)} SELECT * FROM C WHERE msnr < 6.0",
        "best_detection": f"{z}, V AS (SELECT chan, t, x / sqrt(mask + 1e-7) AS x FROM Z) SELECT chan AS irow, t AS icol, width AS iwidth, round(s / sqrt(width), 6) AS snr FROM ({boxes('V', list(range(1, 11)), 'chan, t // 256')}) a ORDER BY snr DESC, chan, t, width LIMIT 1",
        "energy_ratio": f"{z}, V AS (SELECT chan, t, x * x AS x, CAST((1 + t % 3) * (1 + t % 3) AS DOUBLE) AS n FROM Z) SELECT a.chan, a.t, a.width, round(sqrt(a.s / b.s), 6) AS snr FROM ({boxes('V', [1, 2, 3])}) a JOIN ({boxes('V', [1, 2, 3], x='n')}) b ON b.chan = a.chan AND b.t = a.t AND b.width = a.width WHERE sqrt(a.s / b.s) >= 1.5",
        "gap_split_mt": f"WITH {L}, {gap('L', 'mwidth', 'mt', q.GAPS[0], 'g1', 'G1')} SELECT mt, mdt, mwidth, msnr, g1 FROM G1",
        "split_plan": f"WITH {L}, {gap('L', 'mwidth', 'mt', q.GAPS[0], 'g1', 'G1')} SELECT mwidth AS g, max(g1) + 1 AS n FROM G1 GROUP BY 1",
        "cluster_3axis": f"{z}, {cand(q.WIDTHS)}, {grouped('C', q.GAPS)} SELECT * FROM G3",
        "cluster_raw": f"WITH {L}, {grouped('L', (8, 40, 1))} SELECT * FROM G3",
        "delegates": f"{CLUSTERED} SELECT mt, mdt, mwidth, msnr FROM D",
        "delegates_sorted": f"{CLUSTERED} SELECT mt, mdt, mwidth, msnr, {RANKED} AS n FROM D",
        "cluster_sizes": f"{CLUSTERED} SELECT g1, g2, g3, count(*) AS num FROM G3 GROUP BY 1, 2, 3",
        "segmented_sort_rank": f"WITH {L} SELECT *, row_number() OVER (PARTITION BY mwidth ORDER BY mt, mdt, msnr) - 1 AS rank FROM L",
        "index_sort": f"{z}, {cand(q.WIDTHS)} SELECT *, row_number() OVER (ORDER BY mt, mdt, mwidth) - 1 AS rank FROM C",
        "inclusive_scan": "SELECT o_orderkey AS i, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM orders",
        "exclusive_scan": "SELECT o_orderkey AS i, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total FROM orders",
        "permuted_scan": "WITH s AS (SELECT (SELECT max(o_orderkey) FROM orders) - o_orderkey + 1 AS i, o_custkey AS v FROM orders UNION ALL SELECT 0, 0) SELECT i, CAST(sum(v) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM s",
        "overlap_frames": f"WITH {W} SELECT c.chan, f.fft, b.bin, coalesce(W.x, 0.0) AS x FROM range(32) c(chan) CROSS JOIN (SELECT unnest(range((n + {step - 1}) // {step})) AS fft FROM HE) f CROSS JOIN range({q.NBIN}) b(bin) LEFT JOIN W ON W.chan = c.chan AND W.t = b.bin + {step} * f.fft - {q.OVERLAP}",
        "fftshift": f"WITH {E} SELECT r, (c + 32) % 64 AS c, x / 64 AS x FROM E",
        "circular_roll": f"WITH {E} SELECT r, (c + 67) % 64 AS c, x FROM E",
        "rolled_power": f"WITH {E}, {S}, {P} SELECT fft, chan, (bin + {q.MBIN // 2}) % {q.MBIN} AS bin, x / {q.MBIN * q.MBIN} AS x FROM P",
        "power_polsum": f"WITH {E}, {S}, {P} SELECT * FROM P",
        "unpad_transpose": f"WITH {E}, {S}, {P} SELECT (1 - fft % 2) * 2 + 1 - chan AS row, bin - 4 + {q.MBIN - 8} * (fft // 2) AS t, x FROM P WHERE bin >= 4 AND bin < {q.MBIN - 4}",
        "transpose": f"WITH {E} SELECT c AS r, r AS c, x FROM E",
        "digitize": f"WITH {W} SELECT chan, t, x, CAST(trunc(x * 2048.0 / (SELECT max(x) FROM W)) AS BIGINT) AS q FROM W",
        "digitize_floor": f"{z}, {cand(q.WIDTHS)} SELECT mt, mdt, mwidth, floor(msnr) AS msnr FROM C",
        "scale_complex": f"WITH {E}, {S} SELECT fft, chan, pol, bin, re / 32 AS re, im / 32 AS im FROM S",
        "quadratic_cut": f"WITH {E}, Y AS (SELECT max(r) - 15 AS top FROM E) SELECT r - top AS r, c - 48 AS c, x FROM E CROSS JOIN Y WHERE r >= top AND c BETWEEN 48 AND 63",
        "unpad_transpose_complex": f"WITH {E}, {S} SELECT (1 - fft % 2) * 2 + 1 - chan AS row, bin - 4 + {q.MBIN - 8} * (fft // 2) AS t, re, im FROM S WHERE pol = 0 AND bin >= 4 AND bin < {q.MBIN - 4}",
        "image_scale": f"WITH {E} SELECT (SELECT max(r) FROM E) - r AS r, c, CAST(trunc(x * 255.0 / (SELECT max(abs(x)) FROM E)) AS BIGINT) AS level FROM E",
        "subchan_freqs": f"SELECT o.obs, c.chan, s.sub, {r(f'o.f_min + o.bandwidth / 8 * (0.5::DOUBLE + c.chan) + o.bandwidth / 8 / {q.SUBS} * (s.sub - {q.SUBS / 2}::DOUBLE + 0.5::DOUBLE)', 6, 'f')} FROM ({OBS}) o CROSS JOIN range(8) c(chan) CROSS JOIN range({q.SUBS}) s(sub)",
        "taper_table": f"SELECT obs, bin, {r('f')}, {r('1 / sqrt(1 + pow(f / (0.47::DOUBLE * bandwidth), 80.0::DOUBLE))', 6, 'taper')} FROM (SELECT obs, bandwidth, bin, -bandwidth / 2 + (bin + 0.5::DOUBLE) * bandwidth / {q.MBIN}.0::DOUBLE AS f FROM ({OBS}) o CROSS JOIN range({q.MBIN}) b(bin)) i",
        "chirp_table": f"WITH {_chirp(q.SUBS, 2, OBS)} SELECT obs, chan, sub, bin, {r('re', 4)}, {r('im', 4)} FROM H",
        "complex_mul": f"WITH {E}, {S}, {_chirp(1)} SELECT S.fft, S.chan, S.pol, S.bin, {r('S.re * H.re - S.im * H.im', 3, 're')}, {r('S.re * H.im + S.im * H.re', 3, 'im')} FROM S JOIN H ON H.chan = S.chan AND H.bin = S.bin",
        "dft64": _dft("-", "", 3),
        "long_dft": f"WITH {E}, L AS (SELECT r // {q.SERIES} AS series, (r % {q.SERIES}) * 64 + c AS i, x FROM E) SELECT series, k.k AS i, {r(f'sum(x * cos(2 * pi() * ((k.k * i) % {q.SERIES * 64}) / {q.SERIES * 64}))', 2, 're')}, {r(f'sum(-x * sin(2 * pi() * ((k.k * i) % {q.SERIES * 64}) / {q.SERIES * 64}))', 2, 'im')} FROM L CROSS JOIN range({q.SERIES * 64}) k(k) GROUP BY 1, 2",
        "long_round_trip": f"WITH {E} SELECT r * 64 + c AS i, x AS re, CAST(0 AS DOUBLE) AS im FROM E",
        "idft64": _dft("", " / 64.0", 6),
        "dm_grid": f"SELECT obs, i.i, {r('10.0 + i.i * (dm / (2 + obs % 50))', 6, 'dm')} FROM ({OBS}) o CROSS JOIN range(60) i(i) WHERE i.i < floor((dm - 10.0) / (dm / (2 + obs % 50)))",
        "chunk_cut": f"WITH {W}, C AS (SELECT c.c AS chunk, greatest(0, least(c.c * {step}, n - {q.NBIN})) AS first FROM HE CROSS JOIN range(1000000) c(c) WHERE c.c <= (n - {2 * q.OVERLAP} - 1) // {step}) SELECT chan % 2 AS block, chunk, chan, t - first AS t, x FROM W JOIN C ON t >= first AND t < first + {q.NBIN}",
        "dft_round_trip": f"WITH {E} SELECT r, c, x AS re, CAST(0 AS DOUBLE) AS im FROM E",
        "chunk_ranges": f"SELECT block, c.c AS chunk, greatest(0, least(c.c * {step}, n - {q.NBIN})) AS first, least({q.NBIN}, n) AS taken FROM (SELECT o_orderkey % 7 AS block, count(*) AS n FROM orders GROUP BY 1) i CROSS JOIN range(100000) c(c) WHERE c.c <= greatest(0, (n - {2 * q.OVERLAP + 1}) // {step})",
        "dedisperse_shift": f"WITH {W}, T AS (SELECT chan, CAST(sign({lag}) * floor(abs({lag}) + 0.5) AS BIGINT) AS s FROM range(32) c(chan)) SELECT W.chan, (W.t + T.s % n) % n AS t, W.x FROM W JOIN T ON T.chan = W.chan CROSS JOIN HE",
        "flagship_search": f"{CLUSTERED} SELECT *, {RANKED} AS n FROM D",
        "cand_log_lines": f"{CLUSTERED}, N AS (SELECT *, {RANKED} AS n FROM D) SELECT n, lpad(CAST(n AS VARCHAR), 10, ' ') || lpad(CAST(mt AS VARCHAR), 10, ' ') || lpad(printf('%.6f', mt * 0.001), 10, ' ') || lpad(CAST(mdt AS VARCHAR), 10, ' ') || lpad(CAST(mwidth AS VARCHAR), 10, ' ') || lpad(printf('%.6f', msnr), 10, ' ') || lpad(CAST(num AS VARCHAR), 10, ' ') AS line FROM N",
        "cand_csv_lines": f"{z}, {cand(q.WIDTHS)} SELECT concat_ws(',', mt, mdt, mwidth, printf('%.6f', msnr)) AS line FROM C",
        "candfile_parse": "SELECT l_orderkey AS mt, l_partkey AS mdt, CAST(l_linenumber AS BIGINT) AS mwidth, floor(l_extendedprice) AS msnr FROM lineitem WHERE l_linenumber <> 7",
        "report_lines": "SELECT printf('Block=  %d,Chunk=  %d,Rows=  256,Cols=  4096, SucRow=  %d,SucCol=  %d, SNR=  %.4f, CohDisp=  30.5000, windWidth=  %d', o_orderkey % 7 + 1, o_custkey + 1, o_orderkey % 256, o_custkey % 4096, floor(o_totalprice) / 16, o_orderkey % 9) AS line FROM orders",
        "report_parse": "SELECT o_orderkey % 7 AS block, o_custkey AS chunk, o_orderkey % 256 AS suc_row, o_custkey % 4096 AS suc_col, o_orderkey % 9 AS wind_width FROM orders",
        "header_normalise": "SELECT c_custkey AS k, abs(c_acctbal) AS chan_bw, c_acctbal >= 0 AS straight_order FROM customer",
    }
    o |= _files(z) | _recorded()
    o["transform_plans"], o["rounding_plans"] = _plans(), _rounded_plans()
    o["recording_stream"] = o["recording_search"]
    o["command_line"] = f"SELECT block, chunk, n, mt, mdt, mwidth, num, {r('msnr', 4)} FROM ({_recorded(fq.command_plan())['recording_search']}) q"
    a, b, one, odd = fdmt(q.truncating()), fdmt(q.rounding()), fdmt(q.truncating(), "1", x="1.0"), fdmt(q.truncating(q.ODD))
    o["fdmt_init"] = f"WITH {W}, {', '.join(a[:3])} SELECT CAST(sub AS BIGINT) AS sub, CAST(k AS BIGINT) AS k, CAST(t AS BIGINT) AS t, {r('x')} FROM A0_0"
    o["fdmt_a"] = f"WITH {W}, {', '.join(a)} SELECT k, t, {r('x', 4)} FROM K0"
    o["fdmt_b"] = f"WITH {W}, {', '.join(b)} SELECT k, t, {r('x', 4)} FROM K0"
    o["fdmt_odd"] = f"WITH {W.replace('% 32', f'% {q.ODD}').replace('range(32)', f'range({q.ODD})')}, {', '.join(odd)} SELECT k, t, {r('x', 4)} FROM K0"
    o["fdmt_ones"] = f"WITH {W}, {', '.join(one)} SELECT k, t, {r('x')} FROM K1"
    o["fdmt_ratio"] = f"WITH {W}, {', '.join(a + one)} SELECT K0.k, K0.t, {r('K0.x / sqrt(K1.x + 1e-8)', 4, 'x')} FROM K0 JOIN K1 ON K1.k = K0.k AND K1.t = K0.t"
    image = ", ".join([E, S, *coherent()])
    o["coherent_images"] = f"WITH {image} SELECT chunk, trial, k, t, {r('x', 4)} FROM CR"
    o["coherent_search"] = f"WITH {image}, {searched(q.SEARCH)} SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY mt, mdt, mwidth) AS n FROM D"
    return o

