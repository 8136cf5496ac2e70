"""The operators again, as SQL: what their results are checked against.

Recursive rules are recursive queries over the row number of each series.
"""

from __future__ import annotations

from ..operators.moving_averages import alma_weights, wma_weights

#: Places that results are compared to, and what keeps exact halves away from the edge of rounding.
DIGITS, NUDGE = 6, "2.34e-7"
#: The same for prices in thousands.
ITEM_DIGITS = 3

TICKS = """ticks AS MATERIALIZED (SELECT event_type AS series_key, ts, event_id, value AS price, (1 + event_id % 100)::DOUBLE AS volume FROM events)"""
BARS = f"""{TICKS},
bars AS MATERIALIZED (SELECT series_key, date_trunc('hour', ts) AS ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, date_trunc('hour', ts)),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 AS i, (high + low) / 2 AS hl2, (high + low + close) / 3 AS tp, count(*) OVER (PARTITION BY series_key) AS n_rows FROM bars)"""


def over(low: int | str = "UNBOUNDED", high: int | str = 0) -> str:
    """The frame from low rows before to high rows before (negative: after)."""
    side = lambda x: "CURRENT ROW" if x == 0 else f"{x} PRECEDING" if isinstance(x, str) or x > 0 else f"{-x} FOLLOWING"
    return f"OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN {side(low)} AND {side(high)})"


def last(n: int) -> str:
    return over(n - 1, 0)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY series_key ORDER BY i)"


def mean(x: str, n: int) -> str:
    """Mean of n rows, null if one is missing."""
    return f"CASE WHEN count({x}) {last(n)} = {n} THEN avg({x}) {last(n)} END"


def total(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {last(n)} = {n} THEN sum({x}) {last(n)} END"


def listed(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {last(n)} = {n} THEN list({x}) {last(n)} END"


def weighted(x: str, weights: list[float]) -> str:
    return f"list_sum(list_transform({listed(x, len(weights))}, lambda x, j: x * ({weights}::DOUBLE[])[j]))"


class Query:
    """A chain of common tables; each adds columns to the one before."""

    def __init__(self, head: str = BARS, start: str = "b"):
        self.parts, self.t, self.n = [head], start, 0

    def _new(self, body: str, kind: str = " MATERIALIZED") -> str:
        self.n += 1
        name = f"t{self.n}"
        self.parts.append(f"{name} AS{kind} ({body})")
        return name

    def let(self, **columns: str) -> Query:
        self.t = self._new(f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {self.t}")
        return self

    def keep(self, condition: str) -> Query:
        self.t = self._new(f"SELECT * FROM {self.t} WHERE {condition}")
        return self

    def fold(self, **states: tuple[str, str]) -> Query:
        """states: name -> (value on row 0, value from r, the row before with its states, and s, this row)."""
        source = self.t
        first = ", ".join(f"({a})::{kind} AS {c}" for c, (a, _, *rest) in states.items() for kind in [rest[0] if rest else "DOUBLE"])
        # later states may use earlier ones of this row as {name}
        done: dict[str, str] = {}
        for c, (_, step, *_rest) in states.items():
            for k, v in done.items():
                step = step.replace("{" + k + "}", f"({v})")
            done[c] = step
        kinds = {c: (rest[0] if rest else "DOUBLE") for c, (_, _, *rest) in states.items()}
        steps = ", ".join(f"({e})::{kinds[c]}" for c, e in done.items())
        r = self._new(f"SELECT s.*, {first} FROM {source} s WHERE i = 0 UNION ALL SELECT s.*, {steps} FROM RNAME r JOIN {source} s ON s.series_key = r.series_key AND s.i = r.i + 1", "")
        self.parts[-1] = self.parts[-1].replace("RNAME", r)
        self.t = self._new(f"SELECT * FROM {r}")
        return self

    def smooth(self, out: str, x: str, n: int, k: float | None = None, first: int | None = None, wilder: bool = False) -> Query:
        """Exponential smoothing that starts with a plain mean, again after each missing result."""
        first = n - 1 if first is None else first
        self.let(_seed=mean(x, n), _in=x)
        nxt = f"(r.{out} * {n - 1} + s._in) / {n}" if wilder else f"r.{out} + {2 / (n + 1) if k is None else k!r} * (s._in - r.{out})"
        self.fold(**{out: (f"CASE WHEN {first} <= 0 THEN _seed END", f"CASE WHEN s.i < {first} THEN NULL WHEN r.{out} IS NULL THEN s._seed ELSE {nxt} END")})
        self.t = self._new(f"SELECT * EXCLUDE (_seed, _in) FROM {self.t}")
        return self

    def atr(self, n: int) -> Query:
        return self.let(pc=lag("close")).let(tr="CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END").smooth("atr", "tr", n, first=n, wilder=True)

    def give(self, _plain: tuple[str, ...] = (), _digits: int = DIGITS, **outputs: str) -> str:
        columns = ", ".join(f"{e} AS {c}" if c in _plain else f"round({e} + {NUDGE}, {_digits}) + 0.0 AS {c}" for c, e in outputs.items())
        return f"WITH RECURSIVE {', '.join(self.parts)} SELECT series_key, ts, {columns} FROM {self.t}"


def q() -> Query:
    return Query()


def cascade(n: int, stages: int) -> Query:
    k = repr(2 / (n + 1))
    states = {}
    into = "s.close"
    for j in range(1, stages + 1):
        states[f"e{j}"] = ("CASE WHEN i >= %d THEN _seed END" % (n - 1), f"CASE WHEN s.i < {n - 1} THEN NULL WHEN r.e{stages} IS NULL THEN s._seed ELSE r.e{j} + {k} * ({into} - r.e{j}) END")
        into = "{e%d}" % j
    return q().let(_seed=mean("close", n)).fold(**states)


def extreme(n: int) -> dict[str, str]:
    return {"hh": f"max(high) {last(n)}", "ll": f"min(low) {last(n)}"}


def rsi(query: Query, out: str, x: str, n: int, first: int = 0) -> Query:
    query.let(**{f"{out}_d": f"{x} - {lag(x)}"}).let(**{f"{out}_u": f"CASE WHEN {out}_d IS NOT NULL THEN greatest({out}_d, 0) END", f"{out}_n": f"CASE WHEN {out}_d IS NOT NULL THEN greatest(-{out}_d, 0) END"})
    query.smooth(f"{out}_g", f"{out}_u", n, first=n, wilder=True).smooth(f"{out}_l", f"{out}_n", n, first=n, wilder=True)
    return query.let(**{out: f"CASE WHEN {out}_g IS NULL THEN NULL WHEN i = {n} AND {out}_g = 0 AND {out}_l = 0 THEN NULL WHEN {out}_l = 0 THEN 100.0 ELSE 100 - 100 / (1 + {out}_g / {out}_l) END"})


def ratio(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def levels(kind: str, o: str, h: str, low: str, c: str) -> dict[str, str]:
    pp = {"standard": f"({h} + {low} + {c}) / 3", "woodie": f"({h} + {low} + 2 * {o}) / 4"}[kind]
    return {
        "pp": pp, "s1": f"2 * ({pp}) - {h}", "s2": f"({pp}) - ({h} - {low})", "s3": f"{low} - 2 * ({h} - ({pp}))", "s4": "NULL::DOUBLE",
        "r1": f"2 * ({pp}) - {low}", "r2": f"({pp}) + ({h} - {low})", "r3": f"{h} + 2 * (({pp}) - {low})", "r4": "NULL::DOUBLE",
    }


def fractals(query: Query, left: int = 2, right: int = 2) -> Query:
    inside = f"i >= {left} AND i + {right} < n_rows"
    return query.let(
        bear=f"CASE WHEN {inside} AND high > max(high) {over(left, 1)} AND high > max(high) {over(-1, -right)} THEN high END",
        bull=f"CASE WHEN {inside} AND low < min(low) {over(left, 1)} AND low < min(low) {over(-1, -right)} THEN low END",
    )


def pairs() -> str:
    return f"""{BARS},
p AS MATERIALIZED (SELECT 'click' AS series_key, x.ts, x.close AS a, y.close AS b, row_number() OVER (ORDER BY x.ts) - 1 AS i FROM bars x JOIN bars y ON x.ts = y.ts AND x.series_key = 'click' AND y.series_key = 'view')"""


def stop_bands(by: str, n: int, m: float, query: Query | None = None) -> Query:
    """Bands that tighten, and the side of the price; by: middle of both bands."""
    query = (query or q()).atr(n).let(top=f"{by} + {m} * atr", bottom=f"{by} - {m} * atr")
    return query.fold(
        up=("NULL", f"CASE WHEN s.i < {n} THEN NULL WHEN r.up IS NULL OR s.top < r.up OR s.pc > r.up THEN s.top ELSE r.up END"),
        down=("NULL", f"CASE WHEN s.i < {n} THEN NULL WHEN r.down IS NULL OR s.bottom > r.down OR s.pc < r.down THEN s.bottom ELSE r.down END"),
        bull=("NULL", f"CASE WHEN s.i < {n} THEN NULL ELSE NOT s.close <= (CASE WHEN coalesce(r.bull, s.close >= {'s.pc' if by == 'close' else f's.{by}'}) THEN {{down}} ELSE {{up}} END) END", "BOOLEAN"),
    )


def hilbert() -> Query:
    """Phase and period of hl2 as st, from row 6 on."""
    f = lambda x: f"(0.0962 * {x}[7] + 0.5769 * {x}[5] - 0.5769 * {x}[3] - 0.0962 * {x}[1])"
    zero = "[0, 0, 0, 0, 0, 0, 0]::DOUBLE[]"
    start = "{" + f"'sm': {zero}, 'dt': {zero}, 'q1': {zero}, 'i1': {zero}, 'i2': 0::DOUBLE, 'q2': 0::DOUBLE, 're': 0::DOUBLE, 'im': 0::DOUBLE, 'pd': 0::DOUBLE" + "}"
    steps = [
        "0.075 * r.st.pd + 0.54 AS adj, list_append(r.st.sm[2:7], (4 * s.hl2 + 3 * s.p1 + 2 * s.p2 + s.p3) / 10) AS sm",
        f"*, list_append(r.st.dt[2:7], {f('sm')} * adj) AS dt",
        f"*, list_append(r.st.q1[2:7], {f('dt')} * adj) AS q1, list_append(r.st.i1[2:7], dt[4]) AS i1",
        f"*, {f('i1')} * adj AS ji, {f('q1')} * adj AS jq",
        "*, 0.2 * (i1[7] - jq) + 0.8 * r.st.i2 AS i2, 0.2 * (q1[7] + ji) + 0.8 * r.st.q2 AS q2",
        "*, 0.2 * (i2 * r.st.i2 + q2 * r.st.q2) + 0.8 * r.st.re AS re, 0.2 * (i2 * r.st.q2 - q2 * r.st.i2) + 0.8 * r.st.im AS im",
        "*, CASE WHEN im <> 0 AND re <> 0 THEN 2 * pi() / atan(im / re) ELSE 0 END AS w",
        "*, greatest(least(greatest(least(w, 1.5 * r.st.pd), 0.67 * r.st.pd), 50), 6) AS v",
    ]
    inner = "SELECT 1 AS one"
    for x in steps:
        inner = f"SELECT {x} FROM ({inner})"
    nxt = "SELECT {'sm': sm, 'dt': dt, 'q1': q1, 'i1': i1, 'i2': i2, 'q2': q2, 're': re, 'im': im, 'pd': 0.2 * v + 0.8 * r.st.pd} FROM (" + inner + ")"
    kind = "STRUCT(sm DOUBLE[], dt DOUBLE[], q1 DOUBLE[], i1 DOUBLE[], i2 DOUBLE, q2 DOUBLE, re DOUBLE, im DOUBLE, pd DOUBLE)"
    query = q().let(p1=lag("hl2"), p2=lag("hl2", 2), p3=lag("hl2", 3))
    return query.fold(st=(start, f"CASE WHEN s.i <= 5 THEN r.st ELSE ({nxt}) END", kind))


def bricks(query: Query, size: str, base: str) -> str:
    """Renko bricks by close; size: of a brick in row s; base: the first edge, from row 0."""
    kind = "STRUCT(o DOUBLE, c DOUBLE, h DOUBLE, l DOUBLE, v DOUBLE, n BIGINT, edge DOUBLE, bh DOUBLE, bl DOUBLE, bv DOUBLE)"
    start = f"{{'o': {base}, 'c': {base}, 'h': NULL, 'l': NULL, 'v': 0, 'n': 0, 'edge': NULL, 'bh': NULL, 'bl': NULL, 'bv': NULL}}"
    nxt = f"""SELECT {{'o': CASE WHEN n > 0 THEN top + (n - 1) * z WHEN n < 0 THEN bot + (n + 1) * z ELSE r.st.o END, 'c': CASE WHEN n > 0 THEN top + n * z WHEN n < 0 THEN bot + n * z ELSE r.st.c END,
 'h': CASE WHEN n = 0 THEN h END, 'l': CASE WHEN n = 0 THEN l END, 'v': CASE WHEN n = 0 THEN v ELSE 0 END, 'n': n, 'edge': CASE WHEN n > 0 THEN top ELSE bot END, 'bh': h, 'bl': l, 'bv': v}}
FROM (SELECT *, CASE WHEN s.close > top THEN trunc(round((s.close - top) / z, 9)) WHEN s.close < bot THEN trunc(round((s.close - bot) / z, 9)) ELSE 0 END AS n
FROM (SELECT {size} AS z, greatest(r.st.o, r.st.c) AS top, least(r.st.o, r.st.c) AS bot, greatest(coalesce(r.st.h, s.high), s.high) AS h, least(coalesce(r.st.l, s.low), s.low) AS l, r.st.v + s.volume AS v))"""
    query.fold(st=(start, f"({nxt})", kind)).keep("st.n <> 0").let(k="unnest(range(abs(st.n)))")
    z = size.replace("s.", "")
    query.let(brick_no="row_number() OVER (PARTITION BY series_key ORDER BY i, k) - 1", o=f"st.edge + sign(st.n) * k * {z}")
    return query.give(("brick_no", "is_up"), brick_no="brick_no", open="o", high="st.bh", low="st.bl", close=f"o + sign(st.n) * {z}", volume="st.bv / abs(st.n)", is_up="st.n > 0")


def hurst_sql(n: int = 100) -> str:
    from ..functions.kernels import hurst_sets

    raw, corrected, sizes = [], [], []
    for parts, size, extra in hurst_sets(n):
        off = n - parts * size
        chunk = f"f[{off + 1} + p * {size}:{off} + (p + 1) * {size}]"
        run = f"list_transform(range(1, {size + 1}), lambda j: list_sum(({chunk})[1:j]) - j * list_avg({chunk}))"
        rs = f"list_avg(list_transform(range({parts}), lambda p: (list_max({run}) - list_min({run})) / list_stddev_pop({chunk})))"
        raw.append(rs)
        corrected.append(extra)
        sizes.append(size)
    import math

    x = [math.log10(k) for k in sizes]
    spread = [v - sum(x) / len(x) for v in x]
    total = sum(v * v for v in spread)
    names = [f"r{k}" for k in range(len(raw))]
    query = q().let(lr=f"ln(close / {lag('close')})").let(f=listed("lr", n)).let(**dict(zip(names, raw, strict=True)))
    slope = lambda ys: "(" + " + ".join(f"{v!r} * {y}" for v, y in zip(spread, ys, strict=True)) + f") / {total!r}"
    return query.give(hurst_exponent=slope([f"log10({r})" for r in names]), hurst_exponent_al=slope([f"log10({r} + {e!r})" for r, e in zip(names, corrected, strict=True)]))


def zig_zag_sql(percent: int = 5) -> str:
    """Turning points one after the other, each found by looking at all rows after the one before; by close, exact to nine places."""
    return f"""WITH RECURSIVE {BARS},
c AS MATERIALIZED (SELECT series_key, i, n_rows, close::DECIMAL(18, 9) AS c, first_value(close::DECIMAL(18, 9)) OVER (PARTITION BY series_key ORDER BY i) AS c0 FROM b),
f AS (SELECT series_key, arg_min(CASE WHEN c > c0 THEN 'L' ELSE 'H' END, i) AS kind FROM c WHERE abs(c - c0) * 100 >= c0 * {percent} GROUP BY series_key),
p AS (SELECT c.series_key, 0::BIGINT AS pt, c.c AS v, coalesce(f.kind, 'U') AS kind, n_rows FROM c LEFT JOIN f USING (series_key) WHERE i = 0
  UNION ALL SELECT series_key, CASE WHEN any_value(brk) IS NULL THEN any_value(n_rows) - 1 ELSE coalesce(max(CASE WHEN c = best THEN i END), any_value(pt)) END, CASE WHEN any_value(brk) IS NULL THEN arg_max(c, i) ELSE arg_max(best, i) END,
    CASE WHEN any_value(brk) IS NULL THEN NULL WHEN any_value(kind) = 'L' THEN 'H' ELSE 'L' END, any_value(n_rows)
  FROM (SELECT *, min(CASE WHEN abs(best - c) * 100 >= best * {percent} AND c <> best THEN i END) OVER (PARTITION BY series_key) AS brk
    FROM (SELECT p.series_key, p.pt, p.kind, p.n_rows, c.i, c.c, CASE WHEN p.kind = 'L' THEN greatest(p.v, max(c.c) OVER w) ELSE least(p.v, min(c.c) OVER w) END AS best
      FROM p JOIN c ON c.series_key = p.series_key AND c.i > p.pt WHERE p.kind IS NOT NULL WINDOW w AS (PARTITION BY p.series_key ORDER BY c.i)))
  WHERE brk IS NULL OR i <= brk GROUP BY series_key),
l AS MATERIALIZED (SELECT series_key, pt, v::DOUBLE AS v, kind, lag(pt) OVER w AS a0, (lag(v) OVER w)::DOUBLE AS v0, lag(kind) OVER w AS way FROM p WINDOW w AS (PARTITION BY series_key ORDER BY pt, kind NULLS LAST)),
z AS (SELECT c.series_key, c.i, max(v0 + (v - v0) / (pt - a0) * (c.i - a0)) AS z, max(CASE WHEN c.i = pt THEN kind END) AS kind FROM l JOIN c ON c.series_key = l.series_key AND c.i > a0 AND c.i <= pt AND (a0 > 0 OR c.i = pt) WHERE pt > a0 GROUP BY ALL),
e AS (SELECT series_key, way, pt, v, lag(pt) OVER w AS a0, lag(v) OVER w AS v0 FROM l WHERE way IN ('L', 'H') WINDOW w AS (PARTITION BY series_key, way ORDER BY pt)),
t AS (SELECT c.series_key, c.i, max(CASE WHEN way = 'L' THEN v0 + (v - v0) / (pt - a0) * (c.i - a0) END) AS rh, max(CASE WHEN way = 'H' THEN v0 + (v - v0) / (pt - a0) * (c.i - a0) END) AS rl FROM e JOIN c ON c.series_key = e.series_key AND c.i BETWEEN a0 AND pt WHERE a0 > 0 AND pt > a0 GROUP BY ALL)
SELECT b.series_key, b.ts, round(z.z + {NUDGE}, {DIGITS}) + 0.0 AS zig_zag, z.kind AS point_type, round(t.rh + {NUDGE}, {DIGITS}) + 0.0 AS retrace_high, round(t.rl + {NUDGE}, {DIGITS}) + 0.0 AS retrace_low
FROM b LEFT JOIN z ON z.series_key = b.series_key AND z.i = b.i LEFT JOIN t ON t.series_key = b.series_key AND t.i = b.i"""


def pivots_by(number: str, kind: str, query: Query) -> str:
    """Levels of each calendar window, from the window before; woodie takes its own open."""
    pp = query.let(w=number).let(nw=f"CASE WHEN w <> {lag('w')} THEN 1 ELSE 0 END").let(win=f"sum(nw) {over()}").let(own="first_value(open) OVER (PARTITION BY series_key, win ORDER BY i)")
    pp.parts.append(f"g AS MATERIALIZED (SELECT series_key, win + 1 AS win, max(high) AS gh, min(low) AS gl, arg_max(close, i) AS gc FROM {pp.t} GROUP BY ALL)")
    pp.t = pp._new(f"SELECT t.*, gh, gl, gc FROM {pp.t} t LEFT JOIN g USING (series_key, win)")
    return pp.give(**levels(kind, "own", "gh", "gl", "gc"))


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    # moving averages
    o["sma"] = q().give(sma=mean("close", 20))
    o["ema"] = q().smooth("e", "close", 20).give(ema="e")
    o["smma"] = q().smooth("e", "close", 20, wilder=True).give(smma="e")
    o["dema"] = cascade(14, 2).give(dema="2 * e1 - e2")
    o["tema"] = cascade(20, 3).give(tema="3 * e1 - 3 * e2 + e3")
    o["trix"] = cascade(14, 3).let(p=lag("e3")).give(ema3="CASE WHEN p IS NOT NULL THEN e3 END", trix="100 * (e3 - p) / p")
    a, k = 0.7, repr(2 / 6)
    states, into = {}, "s.close"
    for j in range(1, 7):
        states[f"e{j}"] = ("close", f"r.e{j} + {k} * ({into} - r.e{j})")
        into = "{e%d}" % j
    o["t3"] = q().fold(**states).give(t3=f"{-(a**3)!r} * e6 + {3 * a**2 + 3 * a**3!r} * e5 + {-6 * a**2 - 3 * a - 3 * a**3!r} * e4 + {1 + 3 * a + a**3 + 3 * a**2!r} * e3")
    o["dynamic"] = q().let(m=mean("close", 20)).let(pc=lag("m")).fold(d=("NULL", "coalesce(r.d, s.pc) + (s.m - coalesce(r.d, s.pc)) / nullif(0.6 * 14 * power(s.m / nullif(coalesce(r.d, s.pc), 0), 4), 0)")).give(dynamic="d")
    er = "abs(close - " + lag("close", 10) + ")"
    o["kama"] = q().let(ch=er, d=f"abs(close - {lag('close')})").let(path=f"sum(d) {last(10)}").let(er0="CASE WHEN i >= 10 THEN CASE WHEN path = 0 THEN 0 ELSE ch / path END END").fold(
        k=("NULL", f"CASE WHEN s.i < 9 THEN NULL WHEN s.i = 9 OR s.path = 0 THEN s.close ELSE r.k + power(s.er0 * ({2 / 3!r} - {2 / 31!r}) + {2 / 31!r}, 2) * (s.close - r.k) END")
    ).give(er="er0", kama="k")
    o["wma"] = q().give(wma=weighted("close", wma_weights(14)))
    o["hma"] = q().let(raw=f"2 * {weighted('close', wma_weights(7))} - {weighted('close', wma_weights(14))}").give(hma=weighted("raw", wma_weights(3)))
    o["alma"] = q().give(alma=weighted("close", alma_weights(9, 0.85, 6.0)))
    o["epma"] = q().let(sl=f"regr_slope(close, i + 1) {last(10)}", ic=f"regr_intercept(close, i + 1) {last(10)}").give(epma="CASE WHEN i >= 9 THEN sl * (i + 1) + ic END")
    o["vwma"] = q().let(cv="close * volume").give(vwma=ratio(total("cv", 14), total("volume", 14)))
    # channels
    o["bollinger_bands"] = q().let(m=mean("close", 20), sd=f"CASE WHEN i >= 19 THEN stddev_pop(close) {last(20)} END").give(sma="m", upper_band="m + 2 * sd", lower_band="m - 2 * sd", percent_b=ratio("close - (m - 2 * sd)", "4 * sd"), z_score=ratio("close - m", "sd"), width=ratio("4 * sd", "m"))
    o["donchian"] = q().let(u=f"CASE WHEN i >= 20 THEN max(high) {over(20, 1)} END", l=f"CASE WHEN i >= 20 THEN min(low) {over(20, 1)} END").give(upper_band="u", centerline="(u + l) / 2", lower_band="l", width=ratio("u - l", "(u + l) / 2"))
    o["fcb"] = fractals(q()).let(x=lag("bear", 2), y=lag("bull", 2)).give(upper_band=f"last_value(x IGNORE NULLS) {over()}", lower_band=f"last_value(y IGNORE NULLS) {over()}")
    o["keltner"] = q().atr(10).smooth("e", "close", 20).give(upper_band="CASE WHEN i >= 19 THEN e + 2 * atr END", centerline="CASE WHEN i >= 19 THEN e END", lower_band="CASE WHEN i >= 19 THEN e - 2 * atr END", width=f"CASE WHEN i >= 19 THEN {ratio('4 * atr', 'e')} END")
    o["starc_bands"] = q().atr(10).let(m=mean("close", 5)).give(upper_band="m + 2 * atr", centerline="m", lower_band="m - 2 * atr")
    o["ma_envelopes"] = q().let(m=mean("close", 20)).give(centerline="m", upper_envelope="m * 1.025", lower_envelope="m * 0.975")
    o["stdev_channels"] = q().let(part="(n_rows - 1 - i) // 20", x="i + 1").let(sl="regr_slope(close, x) OVER (PARTITION BY series_key, part)", ic="regr_intercept(close, x) OVER (PARTITION BY series_key, part)", sd="stddev_pop(close) OVER (PARTITION BY series_key, part)", ok="part < n_rows // 20", f="min(i) OVER (PARTITION BY series_key, part)").give(
        ("break_point",), centerline="CASE WHEN ok THEN sl * x + ic END", upper_channel="CASE WHEN ok THEN sl * x + ic + 2 * sd END", lower_channel="CASE WHEN ok THEN sl * x + ic - 2 * sd END", break_point="ok AND i = f"
    )
    o["vwap"] = q().let(pv="tp * volume").give(vwap=ratio(f"sum(pv) {over()}", f"sum(volume) {over()}"))
    # oscillators
    o["awesome"] = q().let(x=f"CASE WHEN i >= 33 THEN avg(hl2) {last(5)} - avg(hl2) {last(34)} END").give(oscillator="x", normalized=f"100 * {ratio('x', 'hl2')}")
    o["bop"] = q().let(x=ratio("close - open", "high - low")).give(bop=mean("x", 14))
    o["cci"] = q().let(m=mean("tp", 20), f=listed("tp", 20)).let(d="list_avg(list_transform(f, lambda x: abs(x - m)))").give(cci=ratio("tp - m", "0.015 * d"))
    o["chop"] = q().let(pc=lag("close")).let(tr="CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END", th="greatest(high, pc)", tl="least(low, pc)").let(r=ratio(f"sum(tr) {last(14)}", f"max(th) {last(14)} - min(tl) {last(14)}")).give(chop="CASE WHEN i >= 14 AND r > 0 THEN 100 * ln(r) / ln(14) END")
    o["cmo"] = q().let(d=f"close - {lag('close')}").let(u=f"sum(greatest(d, 0)) {last(14)}", n=f"sum(greatest(-d, 0)) {last(14)}").give(cmo="CASE WHEN i >= 14 THEN CASE WHEN u + n = 0 THEN 0 ELSE 100 * (u - n) / (u + n) END END")
    crsi = q().let(pc=lag("close")).fold(streak=("0", "CASE WHEN s.close > s.pc THEN CASE WHEN r.streak >= 0 THEN r.streak + 1 ELSE 1 END WHEN s.close < s.pc THEN CASE WHEN r.streak <= 0 THEN r.streak - 1 ELSE -1 END ELSE 0 END"))
    crsi = rsi(rsi(crsi, "a", "close", 3), "z", "streak", 2).let(g="CASE WHEN i = 0 THEN 0 WHEN pc > 0 THEN (close - pc) / pc END")
    crsi = crsi.let(f=listed("g", 101)).let(pr="CASE WHEN f IS NOT NULL THEN (100 * len(list_filter(f, lambda x: x < g))) // 100 END")
    o["connors_rsi"] = crsi.give(streak="streak", rsi="a", rsi_streak="CASE WHEN i >= 4 THEN z END", percent_rank="pr::DOUBLE", connors_rsi="CASE WHEN i >= 101 THEN (a + z + pr) / 3 END")
    o["dpo"] = q().let(m=mean("close", 14)).let(m2="lead(m, 8) OVER (PARTITION BY series_key ORDER BY i)").give(dpo="close - m2", sma="m2")
    gator = q()
    for name, (n, shift) in {"jaw": (13, 8), "teeth": (8, 5), "lips": (5, 3)}.items():
        gator.let(**{f"x_{name}": lag("hl2", shift)}).smooth(name, f"x_{name}", n, first=n + shift - 1, wilder=True)
    o["alligator"] = gator.give(jaw="jaw", teeth="teeth", lips="lips")
    o["gator"] = gator.let(u="CASE WHEN i > 0 THEN abs(jaw - teeth) END", l="CASE WHEN i > 0 THEN -abs(teeth - lips) END").give(("upper_is_expanding", "lower_is_expanding"), upper="u", lower="l", upper_is_expanding=f"u > {lag('u')}", lower_is_expanding=f"l < {lag('l')}")
    o["pmo"] = q().let(ch=f"100 * ({ratio('close', lag('close'))} - 1)").smooth("p1", "ch", 35, 2 / 35, 35).let(p10="p1 * 10").smooth("p2", "p10", 20, 2 / 20, 20).smooth("p3", "p2", 10, first=10).give(pmo="p2", signal="p3")
    o["roc"] = q().let(p=lag("close", 14)).give(momentum="close - p", roc=f"100 * {ratio('close - p', 'p')}")
    o["rsi"] = rsi(q(), "a", "close", 14).give(rsi="a")
    plain = lambda out, x, n: {out: (x.replace("s.", ""), f"CASE WHEN r.{out} IS NULL THEN {x} ELSE r.{out} + {2 / (n + 1)!r} * ({x} - r.{out}) END")}
    smi = q().let(**extreme(13)).let(sm="CASE WHEN i >= 12 THEN close - (hh + ll) / 2 END", hl="CASE WHEN i >= 12 THEN hh - ll END")
    smi = smi.fold(**plain("a1", "s.sm", 25)).fold(**plain("a2", "s.a1", 2)).fold(**plain("b1", "s.hl", 25)).fold(**plain("b2", "s.b1", 2)).let(v=f"100 * {ratio('a2', '0.5 * b2')}")
    o["smi"] = smi.fold(**plain("g", "s.v", 3)).give(smi="v", signal="g")
    raw = "CASE WHEN hh = ll THEN 0 WHEN close >= hh THEN 100 WHEN close <= ll THEN 0 ELSE 100 * (close - ll) / (hh - ll) END"
    st = q().let(**extreme(14)).let(x=f"CASE WHEN i >= 13 THEN {raw} END").let(k=mean("x", 3)).let(d=mean("k", 3))
    o["stoch"] = st.give(oscillator="k", signal="d", percent_j="3 * k - 2 * d")
    o["williams_r"] = q().let(**extreme(14)).give(williams_r=f"CASE WHEN i >= 13 THEN {raw} - 100 END")
    o["stoch_smma"] = q().let(**extreme(14)).let(x=f"CASE WHEN i >= 13 THEN {raw} END", ).let(sd=mean("x", 3)).fold(k=("NULL", "CASE WHEN s.i < 3 THEN NULL ELSE (coalesce(r.k, s.sd) * 2 + s.x) / 3 END")).let(sd2=mean("k", 3)).fold(d=("NULL", "CASE WHEN s.i < 3 THEN NULL ELSE (coalesce(r.d, s.sd2) * 2 + s.k) / 3 END")).give(oscillator="k", signal="d", percent_j="3 * k - 2 * d")
    of_z = "CASE WHEN hz = lz THEN 0 WHEN z >= hz THEN 100 WHEN z <= lz THEN 0 ELSE 100 * (z - lz) / (hz - lz) END"
    sr = rsi(q(), "z", "close", 14).let(hz=f"max(z) {last(14)}", lz=f"min(z) {last(14)}", nz=f"count(z) {last(14)}").let(x=f"CASE WHEN nz = 14 THEN {of_z} END")
    o["stoch_rsi"] = sr.give(stoch_rsi="x", signal=mean("x", 3))
    stc = q().smooth("f1", "close", 23).smooth("f2", "close", 50).let(z="f1 - f2").let(hz=f"max(z) {last(10)}", lz=f"min(z) {last(10)}", nz=f"count(z) {last(10)}").let(x=f"CASE WHEN nz = 10 THEN {of_z} END")
    o["stc"] = stc.give(stc=mean("x", 3))
    tsi = q().let(c=f"close - {lag('close')}").let(a="abs(c)").smooth("c1", "c", 25, first=25).smooth("c2", "c1", 13, first=13).smooth("a1", "a", 25, first=25).smooth("a2", "a1", 13, first=13).let(t=f"100 * {ratio('c2', 'a2')}")
    o["tsi"] = tsi.smooth("g", "t", 7, first=8).give(tsi="t", signal="g")
    part = lambda n: ratio(f"sum(bp) {last(n)}", f"sum(tr) {last(n)}")
    o["ultimate"] = q().let(pc=lag("close")).let(tr="CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END", bp="close - least(low, pc)").give(ultimate=f"CASE WHEN i >= 28 THEN 100 * (4 * {part(7)} + 2 * {part(14)} + {part(28)}) / 7 END")
    # trends
    adx = q().atr(14).let(up=f"high - {lag('high')}", dn=f"{lag('low')} - low").let(p1="CASE WHEN up > dn THEN greatest(up, 0) ELSE 0 END", m1="CASE WHEN dn > up THEN greatest(dn, 0) ELSE 0 END")
    adx = adx.let(**{f"z{c}": f"sum({c}) {last(14)}" for c in ("tr", "p1", "m1")}).fold(**{f"s{c}": ("NULL", f"CASE WHEN s.i < 14 THEN NULL WHEN s.i = 14 THEN s.z{c} ELSE r.s{c} - r.s{c} / 14 + s.{c} END") for c in ("tr", "p1", "m1")})
    adx = adx.let(pdi=f"100 * {ratio('sp1', 'str')}", mdi=f"100 * {ratio('sm1', 'str')}").let(dx="CASE WHEN pdi = mdi THEN 0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END").smooth("ax", "dx", 14, first=27, wilder=True)
    o["adx"] = adx.give(pdi="pdi", mdi="mdi", dx="dx", adx="ax", adxr=f"(ax + {lag('ax', 14)}) / 2")
    o["aroon"] = q().let(t=f"arg_max(i, (high, -i)) {last(26)}", u=f"arg_min(i, (low, i)) {last(26)}").let(a="CASE WHEN i >= 25 THEN 100.0 * (25 - (i - t)) / 25 END", d="CASE WHEN i >= 25 THEN 100.0 * (25 - (i - u)) / 25 END").give(aroon_up="a", aroon_down="d", oscillator="a - d")
    s = stop_bands("close", 21, 3.0)
    o["atr_stop"] = s.give(atr_stop="CASE WHEN bull THEN down ELSE up END", buy_stop="CASE WHEN NOT bull THEN up END", sell_stop="CASE WHEN bull THEN down END", atr="atr")
    s = stop_bands("hl2", 10, 3.0)
    o["super_trend"] = s.give(super_trend="CASE WHEN bull THEN down ELSE up END", upper_band="CASE WHEN NOT bull THEN up END", lower_band="CASE WHEN bull THEN down END")
    o["elder_ray"] = q().smooth("e", "close", 13).give(ema="e", bull_power="high - e", bear_power="low - e")
    mid = lambda n, late=0: f"CASE WHEN i >= {n + late - 1} THEN (max(high) {over(n - 1 + late, late)} + min(low) {over(n - 1 + late, late)}) / 2 END"
    o["ichimoku"] = q().let(t=mid(9), k=mid(26), b2=mid(52, 26)).let(m="(t + k) / 2").give(tenkan_sen="t", kijun_sen="k", senkou_span_a=f"CASE WHEN i >= 51 THEN {lag('m', 26)} END", senkou_span_b="b2", chikou_span="lead(close, 26) OVER (PARTITION BY series_key ORDER BY i)")
    m = q().smooth("f1", "close", 12).smooth("f2", "close", 26).let(m="f1 - f2").smooth("g", "m", 9, first=33)
    o["macd"] = m.give(macd="m", signal="g", histogram="m - g", fast_ema="f1", slow_ema="f2")
    days = """b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 AS i FROM (SELECT l_returnflag AS series_key, l_shipdate AS ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close
  FROM (SELECT *, l_extendedprice / l_quantity AS p, (l_orderkey, l_linenumber) AS k FROM lineitem) GROUP BY l_returnflag, l_shipdate))"""
    o["pivot_points"] = pivots_by("day(ts)", "standard", q())
    o["pivot_points_hour"] = pivots_by("hour(ts)", "standard", q())
    o["pivot_points_week"] = pivots_by("floor((dayofyear(ts) - 1 + dayofweek(date_trunc('year', ts))) / 7) + 1", "standard", Query(days))
    o["pivot_points_month"] = pivots_by("month(ts)", "woodie", Query(days))
    rp = q().let(gh=f"CASE WHEN i >= 20 THEN max(high) {over(20, 1)} END", gl=f"min(low) {over(20, 1)}", gc=lag("close"))
    o["rolling_pivots"] = rp.keep("true").let(ok="i >= 20").give(**{k: f"CASE WHEN ok THEN {e} END" for k, e in levels("woodie", "open", "gh", "gl", "gc").items()})
    o["roc_wb"] = q().let(p=lag("close", 20)).let(r=f"100 * {ratio('close - p', 'p')}").let(r2="r * r").smooth("e", "r", 5, first=5).let(bd=f"CASE WHEN i >= 5 THEN sqrt({mean('r2', 5)}) END").give(roc="r", roc_ema="e", upper_band="bd", lower_band="-bd")
    o["vortex"] = q().let(pc=lag("close")).let(tr="CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END", u=f"abs(high - {lag('low')})", d=f"abs(low - {lag('high')})").give(pvi=f"CASE WHEN i >= 14 THEN {ratio(f'sum(u) {last(14)}', f'sum(tr) {last(14)}')} END", nvi=f"CASE WHEN i >= 14 THEN {ratio(f'sum(d) {last(14)}', f'sum(tr) {last(14)}')} END")
    fr = fractals(q())
    for point, name, up, down in (("bear", "h", "hh", "lh"), ("bull", "l", "hl", "ll")):
        fr.let(**{f"{name}at": f"CASE WHEN {point} IS NOT NULL THEN i END"}).let(
            **{f"{name}a": f"last_value({point} IGNORE NULLS) {over()}", f"{name}i": f"last_value({name}at IGNORE NULLS) {over()}", f"{name}p": f"last_value({point} IGNORE NULLS) {over('UNBOUNDED', 1)}", f"{name}pi": f"last_value({name}at IGNORE NULLS) {over('UNBOUNDED', 1)}",
               f"{name}b": f"first_value({point} IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)", f"{name}bi": f"first_value({name}at IGNORE NULLS) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"}
        ).let(**{f"{name}here": f"i = {name}i AND {name}i - {name}pi <= 20 AND {name}p <> {name}a", f"{name}next": f"{name}bi - {name}i <= 20 AND {name}b <> {name}a"})
        fr.let(
            **{f"{name}line": f"CASE WHEN {name}here THEN {name}a WHEN {name}next THEN {name}a + ({name}b - {name}a) / ({name}bi - {name}i) * (i - {name}i) END",
               f"{name}trend": f"CASE WHEN {name}here THEN CASE WHEN {name}a > {name}p THEN '{up}' ELSE '{down}' END WHEN {name}next AND i > {name}i THEN CASE WHEN {name}b > {name}a THEN '{up}' ELSE '{down}' END END"}
        )
    o["pivots"] = fr.give(("high_trend", "low_trend"), high_point="bear", low_point="bull", high_line="hline", low_line="lline", high_trend="htrend", low_trend="ltrend")
    o["fractal"] = fractals(q()).give(fractal_bear="bear", fractal_bull="bull")
    o["chandelier"] = q().atr(22).give(chandelier_exit=f"CASE WHEN i >= 22 THEN max(high) {last(22)} - 3 * atr END")
    psar = q().let(l1=lag("low"), l2=lag("low", 2), h1=lag("high"), h2=lag("high", 2)).fold(
        st=("CASE WHEN true THEN {'up': true, 'f': 0.02::DOUBLE, 'x': high, 's': low, 't': false} END", """
        CASE WHEN r.st.up THEN CASE WHEN s.low < least(r.st.s + r.st.f * (r.st.x - r.st.s), s.l1, coalesce(s.l2, 1e300), CASE WHEN s.i < 2 THEN NULL END, CASE WHEN s.i < 2 THEN r.st.s + r.st.f * (r.st.x - r.st.s) ELSE s.l1 END)
          THEN {'up': false, 'f': 0.02::DOUBLE, 'x': s.low, 's': r.st.x, 't': true}
          ELSE {'up': true, 'f': CASE WHEN s.high > r.st.x THEN least(r.st.f + 0.02, 0.2) ELSE r.st.f END, 'x': greatest(r.st.x, s.high), 's': CASE WHEN s.i >= 2 THEN least(r.st.s + r.st.f * (r.st.x - r.st.s), s.l1, s.l2) ELSE r.st.s + r.st.f * (r.st.x - r.st.s) END, 't': false} END
        ELSE CASE WHEN s.high > greatest(r.st.s - r.st.f * (r.st.s - r.st.x), s.h1, coalesce(s.h2, -1e300))
          THEN {'up': true, 'f': 0.02::DOUBLE, 'x': s.high, 's': r.st.x, 't': true}
          ELSE {'up': false, 'f': CASE WHEN s.low < r.st.x THEN least(r.st.f + 0.02, 0.2) ELSE r.st.f END, 'x': least(r.st.x, s.low), 's': greatest(r.st.s - r.st.f * (r.st.s - r.st.x), s.h1, coalesce(s.h2, -1e300)), 't': false} END END""".replace("least(r.st.s + r.st.f * (r.st.x - r.st.s), s.l1, coalesce(s.l2, 1e300), CASE WHEN s.i < 2 THEN NULL END, CASE WHEN s.i < 2 THEN r.st.s + r.st.f * (r.st.x - r.st.s) ELSE s.l1 END)", "CASE WHEN s.i >= 2 THEN least(r.st.s + r.st.f * (r.st.x - r.st.s), s.l1, s.l2) ELSE r.st.s + r.st.f * (r.st.x - r.st.s) END"),
            "STRUCT(up BOOLEAN, f DOUBLE, x DOUBLE, s DOUBLE, t BOOLEAN)"),
    )
    psar.let(on_=f"coalesce(max(CASE WHEN st.t THEN 1 ELSE 0 END) {over('UNBOUNDED', 1)}, 0) = 1")
    o["parabolic_sar"] = psar.give(("is_reversal",), sar="CASE WHEN on_ THEN st.s END", is_reversal="CASE WHEN on_ THEN st.t END")
    vs = q().atr(7).let(pa=lag("atr"), c0="first_value(close) OVER (PARTITION BY series_key ORDER BY i)", c6="nth_value(close, 7) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", mx=f"max(close) {over()}", mn=f"min(close) {over()}")
    vs.fold(st=("{'up': c6 > c0, 'p': close, 'sar': NULL::DOUBLE, 'hit': NULL::BOOLEAN, 'was': NULL::BOOLEAN}", """
        CASE WHEN s.i < 7 THEN {'up': s.c6 > s.c0, 'p': CASE WHEN s.c6 > s.c0 THEN s.mx ELSE s.mn END, 'sar': NULL, 'hit': NULL, 'was': NULL}
        ELSE (SELECT {'up': CASE WHEN hit THEN NOT r.st.up ELSE r.st.up END, 'p': CASE WHEN hit THEN s.close WHEN r.st.up THEN greatest(r.st.p, s.close) ELSE least(r.st.p, s.close) END, 'sar': sar, 'hit': hit, 'was': r.st.up}
              FROM (SELECT sar, coalesce(CASE WHEN r.st.up THEN s.close < sar ELSE s.close > sar END, false) AS hit FROM (SELECT CASE WHEN r.st.up THEN r.st.p - 3 * s.pa ELSE r.st.p + 3 * s.pa END AS sar))) END""", "STRUCT(up BOOLEAN, p DOUBLE, sar DOUBLE, hit BOOLEAN, was BOOLEAN)"))  # fmt: skip
    vs.let(h="CASE WHEN st.hit THEN 1 ELSE 0 END").let(on_=f"coalesce(max(h) {over('UNBOUNDED', 1)}, 0) = 1 OR max(h) OVER (PARTITION BY series_key) = 0")
    o["volatility_stop"] = vs.give(("is_stop",), sar="CASE WHEN on_ THEN st.sar END", is_stop="CASE WHEN on_ THEN st.hit END", upper_band="CASE WHEN on_ AND NOT st.was THEN st.sar END", lower_band="CASE WHEN on_ AND st.was THEN st.sar END")
    # volume
    flow = lambda: q().let(mm="CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) END").let(mv="mm * volume")
    o["adl"] = flow().give(money_flow_multiplier="mm", money_flow_volume="mv", adl=f"sum(mv) {over()}")
    o["chaikin_osc"] = flow().let(a=f"sum(mv) {over()}").smooth("f1", "a", 3).smooth("f2", "a", 10).give(money_flow_multiplier="mm", money_flow_volume="mv", adl="a", oscillator="f1 - f2", fast_ema="f1", slow_ema="f2")
    o["cmf"] = flow().give(money_flow_multiplier="mm", money_flow_volume="mv", cmf=ratio(total("mv", 20), total("volume", 20)))
    o["force_index"] = q().let(f=f"volume * (close - {lag('close')})").smooth("e", "f", 2, first=2).give(force_index="e")
    kv = q().let(h3="high + low + close", dm="high - low").let(t=f"CASE WHEN i = 0 THEN 0 WHEN h3 > {lag('h3')} THEN 1 ELSE -1 END").let(pt=lag("t"), pdm=lag("dm"))
    kv.fold(cm=("0", "CASE WHEN s.i = 1 THEN 0 WHEN s.t = s.pt THEN r.cm + s.dm ELSE s.pdm + s.dm END")).fold(vf=("0", "CASE WHEN s.i < 2 THEN 0 WHEN s.dm = s.cm OR s.volume = 0 THEN 0 WHEN s.dm = 0 THEN s.volume * 2 * s.t * 100 WHEN s.cm <> 0 THEN s.volume * abs(2 * (s.dm / s.cm - 1)) * s.t * 100 ELSE r.vf END"))
    kv.smooth("f1", "vf", 34, first=35).smooth("f2", "vf", 55, first=56).let(k="CASE WHEN i >= 56 THEN f1 - f2 END").smooth("g", "k", 13, first=68)
    o["kvo"] = kv.give(oscillator="k", signal="g")
    o["mfi"] = q().let(pt=lag("tp")).let(u="CASE WHEN tp > pt THEN tp * volume ELSE 0 END", d="CASE WHEN tp < pt THEN tp * volume ELSE 0 END").let(su=f"sum(u) {last(14)}", sd=f"sum(d) {last(14)}").give(mfi="CASE WHEN i >= 14 THEN CASE WHEN sd = 0 THEN 100 ELSE 100 - 100 / (1 + su / sd) END END")
    o["obv"] = q().let(mv=f"coalesce(sign(close - {lag('close')}), 0) * volume").give(obv=f"sum(mv) {over()}")
    pv = q().smooth("f1", "volume", 12).smooth("f2", "volume", 26).let(m=f"100 * {ratio('f1 - f2', 'f2')}").smooth("g", "m", 9, first=33)
    o["pvo"] = pv.give(pvo="m", signal="g", histogram="m - g")
    # characteristics
    o["atr"] = q().atr(14).give(tr="tr", atr="atr", atrp=f"100 * {ratio('atr', 'close')}")
    o["tr"] = q().let(pc=lag("close")).give(tr="CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END")
    o["std_dev"] = q().let(sd=f"CASE WHEN i >= 13 THEN stddev_pop(close) {last(14)} END", m=mean("close", 14)).give(std_dev="sd", mean="m", z_score=ratio("close - m", "sd"))
    sl = q().let(sl=f"CASE WHEN i >= 13 THEN regr_slope(close, i + 1) {last(14)} END", ic=f"CASE WHEN i >= 13 THEN regr_intercept(close, i + 1) {last(14)} END", sd=f"CASE WHEN i >= 13 THEN stddev_pop(close) {last(14)} END").let(e="last_value(sl) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", f="last_value(ic) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
    o["slope"] = sl.give(slope="sl", intercept="ic", std_dev="sd", r_squared=f"power({ratio(f'sl * {((14 * 14 - 1) / 12) ** 0.5!r}', 'sd')}, 2)", line="CASE WHEN i >= n_rows - 14 AND n_rows >= 14 THEN e * (i + 1) + f END")
    o["sma_analysis"] = q().let(m=mean("close", 20), f=listed("close", 20)).give(sma="m", mad="list_avg(list_transform(f, lambda x: abs(x - m)))", mse="list_avg(list_transform(f, lambda x: (x - m) * (x - m)))", mape="CASE WHEN NOT list_contains(f, 0) THEN list_avg(list_transform(f, lambda x: abs(x - m) / x)) END")
    o["ulcer_index"] = q().let(f=listed("close", 14)).let(d="list_transform(f, lambda x, j: 100 * (x - list_max(f[1:j])) / nullif(list_max(f[1:j]), 0))").give(ulcer_index="CASE WHEN len(list_filter(d, lambda x: x IS NULL)) = 0 THEN sqrt(list_avg(list_transform(d, lambda x: x * x))) END")
    two = lambda: Query(pairs(), "p")
    o["correlation"] = two().let(aa="a * a", bb="b * b", ab="a * b").let(va=f"{mean('aa', 20)} - power({mean('a', 20)}, 2)", vb=f"{mean('bb', 20)} - power({mean('b', 20)}, 2)", c=f"{mean('ab', 20)} - {mean('a', 20)} * {mean('b', 20)}").let(k="CASE WHEN va * vb > 0 THEN c / sqrt(va * vb) END").give(variance_a="va", variance_b="vb", covariance="c", correlation="k", r_squared="k * k")
    o["prs"] = two().let(pa=lag("a", 20), pb=lag("b", 20)).give(prs=ratio("a", "b"), prs_percent=f"{ratio('a - pa', 'pa')} - {ratio('b - pb', 'pb')}")
    be = two().let(x=f"CASE WHEN i = 0 THEN 0 ELSE coalesce({ratio('a', lag('a'))} - 1, 0) END", y=f"CASE WHEN i = 0 THEN 0 ELSE coalesce({ratio('b', lag('b'))} - 1, 0) END")
    for name, cond in (("e", "true"), ("u", "y > 0"), ("d", "y < 0")):
        be.let(**{f"x{name}": f"CASE WHEN {cond} THEN x END", f"y{name}": f"CASE WHEN {cond} THEN y END"}).let(**{f"b{name}": f"CASE WHEN i >= 50 THEN {ratio(f'avg(x{name} * y{name}) {last(50)} - avg(x{name}) {last(50)} * avg(y{name}) {last(50)}', f'(avg(y{name} * y{name}) {last(50)} - avg(y{name}) {last(50)} * avg(y{name}) {last(50)})')} END"})
    o["beta"] = be.give(beta="be", beta_up="bu", beta_down="bd", ratio=ratio("bu", "bd"), convexity="(bu - bd) * (bu - bd)", returns_eval="x", returns_mrkt="y")
    # patterns and transforms
    o["doji"] = q().let(ok="coalesce(abs(close / nullif(open, 0) - 1) <= 0.1 / 100, false)").give(("match",), price="CASE WHEN ok THEN close END", match="CASE WHEN ok THEN 1 ELSE 0 END")
    o["marubozu"] = q().let(ok="CASE WHEN high = low THEN true ELSE abs(open - close) / (high - low) >= 0.95 END").give(("match",), price="CASE WHEN ok THEN close END", match="CASE WHEN ok AND close > open THEN 100 WHEN ok THEN -100 ELSE 0 END")
    fi = q().let(lo=f"min(hl2) {last(10)}", hi=f"max(hl2) {last(10)}").fold(x=("0", "(SELECT CASE WHEN z > 0.99 THEN 0.999 WHEN z < -0.99 THEN -0.999 ELSE z END FROM (SELECT CASE WHEN s.hi <> s.lo THEN 0.33 * 2 * ((s.hl2 - s.lo) / (s.hi - s.lo) - 0.5) + 0.67 * r.x ELSE 0 END AS z))")).fold(f=("0", "atanh(s.x) + 0.5 * r.f"))
    o["fisher_transform"] = fi.give(fisher="f", trigger=lag("f"))
    ha = q().let(c="(open + high + low + close) / 4").let(pc=lag("c")).fold(o=("(open + close) / 2", "(r.o + s.pc) / 2"))
    o["heikin_ashi"] = ha.give(ha_open="o", ha_high="greatest(high, o, c)", ha_low="least(low, o, c)", ha_close="c", ha_volume="volume")
    h = hilbert().let(ph="CASE WHEN i > 5 AND st.i1[7] <> 0 THEN degrees(atan(st.q1[7] / st.i1[7])) ELSE 0 END").let(al=f"greatest(0.5 / greatest({lag('ph')} - ph, 1), 0.05)", m6=mean("hl2", 6))
    h = h.fold(m=("NULL", "CASE WHEN s.i < 5 THEN NULL WHEN r.m IS NULL THEN s.m6 ELSE s.al * s.hl2 + (1 - s.al) * r.m END")).fold(f=("NULL", "CASE WHEN s.i < 5 THEN NULL WHEN r.f IS NULL THEN s.m6 ELSE 0.5 * s.al * s.m + (1 - 0.5 * s.al) * r.f END"))
    o["mama"] = h.give(mama="m", fama="f")
    h = hilbert().fold(sd=("0", "CASE WHEN s.i <= 5 THEN 0 ELSE 0.33 * s.st.pd + 0.67 * r.sd END")).let(dc="least(floor(sd + 0.5)::INT, i + 1)", pl=f"list(hl2) {last(64)}").let(it="CASE WHEN i <= 5 THEN 0 WHEN dc > 0 THEN list_avg(pl[-dc:]) ELSE hl2 END")
    o["ht_trendline"] = h.give(("dc_periods",), dc_periods="CASE WHEN i > 5 AND dc > 0 THEN dc END", trendline=f"CASE WHEN i >= 11 THEN (4 * it + 3 * {lag('it')} + 2 * {lag('it', 2)} + {lag('it', 3)}) / 10 ELSE hl2 END", smooth_price="CASE WHEN i > 5 THEN st.sm[7] END")
    o["hurst"] = hurst_sql()
    o["zig_zag"] = zig_zag_sql()
    o["renko"] = bricks(q(), "10", "round_even(close, 0)")
    o["renko_atr"] = bricks(q().atr(14).let(z="last_value(atr) OVER (PARTITION BY series_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"), "s.z", "close")
    for name in ("bollinger_bands", "stoch", "slope", "fractal"):
        o[f"{name}_in_parts"] = o[name]
    # chains and preparation
    o["chain_hl2_ema_rsi"] = rsi(q().smooth("e", "hl2", 10), "a", "e", 14).give(rsi="a")
    m = q().smooth("e", "close", 20)
    o["several"] = rsi(m, "z", "close", 14).atr(14).let(m20=mean("close", 20)).give(fast_sma="m20", slow_ema="e", strength_rsi="z", range_tr="tr", range_atr="atr", range_atrp=f"100 * {ratio('atr', 'close')}")
    o["bars_hour"] = f"WITH {BARS} SELECT series_key, ts, open, high, low, close, volume FROM b"
    o["bars_week"] = f"WITH {BARS} SELECT series_key, date_trunc('week', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY series_key, date_trunc('week', ts)"
    o["bars_month"] = o["bars_week"].replace("'week'", "'month'")
    o["gaps_filled"] = f"""WITH {BARS}, h AS (SELECT series_key, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY series_key),
f AS (SELECT h.series_key, h.ts, open, high, low, close, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY h.series_key ORDER BY h.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM h LEFT JOIN b ON b.series_key = h.series_key AND b.ts = h.ts)
SELECT series_key, ts, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close, coalesce(volume, 0) AS volume FROM f"""
    o["ticks_once"] = o["stream_corrected_ticks"] = o["bars_hour"]
    o["stream_resampled"] = f"""WITH {BARS}, x AS MATERIALIZED (SELECT series_key, time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '2024-01-01') AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2),
h AS (SELECT series_key, unnest(generate_series(min(ts), max(ts), INTERVAL 4 HOURS)) AS ts FROM x GROUP BY series_key),
f AS (SELECT h.series_key, h.ts, open, high, low, close, volume, last_value(close IGNORE NULLS) OVER (PARTITION BY h.series_key ORDER BY h.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM h LEFT JOIN x ON x.series_key = h.series_key AND x.ts = h.ts)
SELECT series_key, ts, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close, coalesce(volume, 0) AS volume FROM f"""
    o["stream_ema"], o["live_sma"], o["live_obv"] = o["ema"], o["sma"], o["obv"]
    o["found"] = q().let(m=mean("close", 20)).keep("ts = TIMESTAMP '2024-01-15 10:00:00'").give(sma="m")
    o["after_100_rows"] = q().smooth("e", "close", 20).keep("i >= 100").give(ema="e")
    o["live_removed_range"] = Query(BARS.replace("FROM bars)", "FROM bars WHERE NOT (series_key = 'click' AND ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 05:00:00'))")).let(m=mean("close", 20)).give(sma="m")
    both = Query(BARS).let(a="high", b2="close").let(aa="a * a", bb="b2 * b2", ab="a * b2").let(va=f"{mean('aa', 20)} - power({mean('a', 20)}, 2)", vb=f"{mean('bb', 20)} - power({mean('b2', 20)}, 2)", c=f"{mean('ab', 20)} - {mean('a', 20)} * {mean('b2', 20)}").let(k="CASE WHEN va * vb > 0 THEN c / sqrt(va * vb) END")
    o["strict_pair"] = both.give(variance_a="va", variance_b="vb", covariance="c", correlation="k", r_squared="k * k")
    parts = {"hl2": "(high + low) / 2", "hlc3": "(high + low + close) / 3", "oc2": "(open + close) / 2", "ohl3": "(open + high + low) / 3", "ohlc4": "(open + high + low + close) / 4"}
    o["bar_parts"] = q().give(**parts)
    o["candles"] = q().give(("is_bullish", "is_bearish"), size="high - low", body="abs(open - close)", upper_wick="high - greatest(open, close)", lower_wick="least(open, close) - low", body_pct="CASE WHEN high = low THEN 1 ELSE abs(open - close) / (high - low) END", upper_wick_pct="CASE WHEN high = low THEN 1 ELSE (high - greatest(open, close)) / (high - low) END", lower_wick_pct="CASE WHEN high = low THEN 1 ELSE (least(open, close) - low) / (high - low) END", is_bullish="close > open", is_bearish="close < open")
    o["condensed"] = q().let(m=mean("close", 20)).keep("m IS NOT NULL").give(sma="m")
    o["settled"] = q().smooth("e", "close", 20).keep("i >= 120").give(ema="e")
    o["latest"] = q().let(m=mean("close", 20)).keep("i = n_rows - 1").give(sma="m")
    o["duplicate_times"] = "SELECT event_type AS series_key, date_trunc('minute', ts) AS ts, count(*) AS rows FROM events GROUP BY 1, date_trunc('minute', ts) HAVING count(*) > 1"
    o["daily_items_macd"] = Query("""d AS MATERIALIZED (SELECT l_returnflag AS series_key, l_shipdate AS ts, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber)) AS close FROM lineitem GROUP BY ALL),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 AS i FROM d)""").smooth("f1", "close", 12).smooth("f2", "close", 26).let(m="f1 - f2").smooth("g", "m", 9, first=33).give(macd="m", signal="g", histogram="m - g", fast_ema="f1", slow_ema="f2")
    items = """b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ts) - 1 AS i, (high + low) / 2 AS hl2 FROM
(SELECT l_suppkey AS series_key, l_shipdate + to_microseconds(l_orderkey * 8 + l_linenumber) AS ts, l_extendedprice / l_quantity AS close, l_extendedprice / l_quantity * (1 + l_tax) AS high, l_extendedprice / l_quantity * (1 - l_discount) AS low FROM lineitem))"""
    m = rsi(Query(items).smooth("e", "close", 20), "z", "close", 14).atr(14).smooth("f1", "close", 12).smooth("f2", "close", 26).let(m="f1 - f2").smooth("g", "m", 9, first=33).let(m20=mean("close", 20))
    o["items_several"] = m.give(_digits=ITEM_DIGITS, sma_sma="m20", ema_ema="e", rsi_rsi="z", atr_tr="tr", atr_atr="atr", atr_atrp=f"100 * {ratio('atr', 'close')}", macd_macd="m", macd_signal="g", macd_histogram="m - g", macd_fast_ema="f1", macd_slow_ema="f2")
    s = stop_bands("hl2", 10, 3.0, Query(items))
    o["items_super_trend"] = s.give(_digits=ITEM_DIGITS, super_trend="CASE WHEN bull THEN down ELSE up END", upper_band="CASE WHEN NOT bull THEN up END", lower_band="CASE WHEN bull THEN down END")
    return o
