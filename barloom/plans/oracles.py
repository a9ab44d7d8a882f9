"""DuckDB SQL for the registered queries. One chain of common tables; unused ones cost nothing."""

from __future__ import annotations

from barloom.params import Params
from barloom.sources.fixtures import METRICS

CHAIN = r"""
with recursive
d0 as (select l_suppkey as sk, cast(l_shipdate as date) as bar_date, sum(cast(round(l_discount*100) as bigint) - cast(round(l_tax*100) as bigint) - 1) as step, max(l_quantity) as mq, min(l_quantity) as nq, sum(l_quantity) as vol from lineitem group by 1, 2),
d1 as (select *, sum(step) over (partition by sk order by bar_date rows unbounded preceding) as cum from d0),
d2 as (select *, round(100*exp(0.003*cum), 4) as cl, round(100*exp(0.003*coalesce(lag(cum) over (partition by sk order by bar_date), cum)), 4) as op from d1),
bars as materialized (select 'S'||lpad(cast(sk as varchar), 5, '0') as ticker, bar_date, op as open, round(greatest(op, cl)*(1+0.001+0.00028*mq), 4) as high, round(least(op, cl)*(1-0.001-0.00028*nq), 4) as low, cl as close, cast(vol*100 as double) as volume,
    row_number() over (partition by sk order by bar_date) - 1 as bar_idx from d2),
ew as (
    select ticker, bar_idx, close, close as ema_fast, close as ema_slow, 0.0::double as macd_sig, null::double as up, null::double as down from bars where bar_idx = 0
    union all
    select b.ticker, b.bar_idx, b.close, e.ema_fast*(1-2/13.0::double) + b.close*(2/13.0::double), e.ema_slow*(1-2/27.0::double) + b.close*(2/27.0::double),
        e.macd_sig*0.8::double + 0.2::double*((e.ema_fast*(1-2/13.0::double) + b.close*(2/13.0::double)) - (e.ema_slow*(1-2/27.0::double) + b.close*(2/27.0::double))),
        case when e.up is null then greatest(b.close - e.close, 0) else e.up*(1-1/14.0::double) + greatest(b.close - e.close, 0)/14.0::double end,
        case when e.down is null then greatest(e.close - b.close, 0) else e.down*(1-1/14.0::double) + greatest(e.close - b.close, 0)/14.0::double end
    from ew e join bars b on b.ticker = e.ticker and b.bar_idx = e.bar_idx + 1),
seq as materialized (select ticker, bar_idx, ema_fast, ema_slow, ema_fast - ema_slow as macd, macd_sig, ema_fast - ema_slow - macd_sig as macd_hist, 100 - 100/(1 + up/(down + 1e-12)) as rsi from ew),
zz as (
    select ticker, bar_idx, 0 as trend, 0::bigint as ci, close as cc, 0 as ek, 0::bigint as ei from bars where bar_idx = 0
    union all
    select ticker, bar_idx, case when turn <> 0 then turn else trend end, case when turn <> 0 then bar_idx else ci end, case when turn <> 0 then p else cc end, turn, ci
    from (select *, case when trend <= 0 and (p - cc)/cc >= 0.05 then 1 when trend >= 0 and (cc - p)/cc >= 0.05 then -1 else 0 end as turn
        from (select z.ticker, b.bar_idx, z.trend, b.close as p, case when z.trend = 1 and b.close >= z.cc or z.trend = -1 and b.close <= z.cc then b.bar_idx else z.ci end as ci,
            case when z.trend = 1 and b.close >= z.cc or z.trend = -1 and b.close <= z.cc then b.close else z.cc end as cc
            from zz z join bars b on b.ticker = z.ticker and b.bar_idx = z.bar_idx + 1))),
piv as materialized (select z.ticker, z.ei as idx, z.ek as kind, z.bar_idx + 2 as conf, case when z.ek = 1 then b.low else b.high end as price from zz z join bars b on b.ticker = z.ticker and b.bar_idx = z.ei where z.ek <> 0),
lg0 as (select b.ticker, b.bar_idx, p.kind, p.idx, p.price, last_value(case when kind = 1 then idx end ignore nulls) over w as li, last_value(case when kind = 1 then price end ignore nulls) over w as lp
    from bars b left join piv p on p.ticker = b.ticker and p.conf = b.bar_idx window w as (partition by b.ticker order by b.bar_idx rows unbounded preceding)),
leg as materialized (select ticker, bar_idx, last_value(case when kind = -1 and idx > li and price > lp then lp end ignore nulls) over w as swing_low, last_value(case when kind = -1 and idx > li and price > lp then price end ignore nulls) over w as swing_high
    from lg0 window w as (partition by ticker order by bar_idx rows unbounded preceding)),
i0 as (select *, greatest(high - low, coalesce(abs(high - lag(close) over w), 0), coalesce(abs(low - lag(close) over w), 0)) as true_range from bars window w as (partition by ticker order by bar_idx)),
inds as materialized (select *,
    case when bar_idx >= 19 then avg(close) over (partition by ticker order by bar_idx rows 19 preceding) end as ma20,
    case when bar_idx >= 49 then avg(close) over (partition by ticker order by bar_idx rows 49 preceding) end as ma50,
    case when bar_idx >= 199 then avg(close) over (partition by ticker order by bar_idx rows 199 preceding) end as ma200,
    case when bar_idx >= 19 then stddev_samp(close) over (partition by ticker order by bar_idx rows 19 preceding) end as sd20,
    case when bar_idx >= 13 then avg(true_range) over (partition by ticker order by bar_idx rows 13 preceding) end as atr,
    case when bar_idx >= 49 then (volume - avg(volume) over (partition by ticker order by bar_idx rows 49 preceding)) / (stddev_samp(volume) over (partition by ticker order by bar_idx rows 49 preceding) + 1e-12) end as vol_z from i0),
f0 as (select i.*, atr/close as atr_pct, s.rsi, s.macd_hist, lag(s.rsi) over w as rsi0, lag(s.macd_hist) over w as hist0, g.swing_low, g.swing_high, ma20 - 2*sd20 as bb_low,
    [struct_pack(d := abs(close - (swing_high - 0.236::double*(swing_high - swing_low)))/close, i := 0, n := 'dist_fib_236'), struct_pack(d := abs(close - (swing_high - 0.382::double*(swing_high - swing_low)))/close, i := 1, n := 'dist_fib_382'), struct_pack(d := abs(close - (swing_high - 0.5::double*(swing_high - swing_low)))/close, i := 2, n := 'dist_fib_500'),
     struct_pack(d := abs(close - (swing_high - 0.618::double*(swing_high - swing_low)))/close, i := 3, n := 'dist_fib_618'), struct_pack(d := abs(close - (swing_high - 0.786::double*(swing_high - swing_low)))/close, i := 4, n := 'dist_fib_786')] as ds
    from inds i join seq s using (ticker, bar_idx) join leg g using (ticker, bar_idx) window w as (partition by ticker order by bar_idx)),
f1 as (select *, case when swing_high is not null then list_min(ds).d end as nearest_fib_dist, case when swing_high is not null then list_min(ds).n end as nearest_fib_level, case when swing_high > swing_low then (swing_high - close)/(swing_high - swing_low) end as retracement_depth,
    coalesce(ma20 > ma50 and ma50 > ma200, false)::int as trend_up, coalesce(rsi0 < 35 and rsi - rsi0 > 0, false)::int as rsi_reversal, coalesce(macd_hist > 0 and macd_hist - hist0 > 0, false)::int as macd_confirm,
    coalesce(close < bb_low*1.01, false)::int as bb_confirm, coalesce(vol_z > 1, false)::int as vol_confirm, coalesce(atr_pct between 0.005 and 0.10, false)::int as regime_ok from f0),
feat as materialized (select *, coalesce(nearest_fib_dist < 0.005, false)::int as fib_near, coalesce(nearest_fib_dist < 0.005, false)::int + trend_up + rsi_reversal + macd_confirm + bb_confirm + vol_confirm as confluence_count from f1),
sig as (select *, fib_near = 1 and confluence_count >= 3 and trend_up = 1 and regime_ok = 1 and atr is not null as signal from feat),
o0 as (select x.ticker, x.bar_idx, x.grp, x.atr, e.open*(1+0.001::double) as entry_price, e.close as entry_close from src x join src e on e.ticker = x.ticker and e.grp = x.grp and e.bar_idx = x.bar_idx + 1 where x.atr > 0),
o1 as (select o.ticker, o.bar_idx, o.grp, o.entry_price, o.entry_close, o.entry_price - 1.5::double*o.atr as stop, o.entry_price + 2.5::double*o.atr as take,
    min(case when y.low <= o.entry_price - 1.5::double*o.atr then y.bar_idx end) as s, min(case when y.high >= o.entry_price + 2.5::double*o.atr then y.bar_idx end) as t, max(y.bar_idx) as l, arg_max(y.close, y.bar_idx) as lc
    from o0 o left join src y on y.ticker = o.ticker and y.grp = o.grp and y.bar_idx between o.bar_idx + 2 and o.bar_idx + 21 group by all),
o2 as (select *, case when s is not null and (t is null or s <= t) then 'stop' when t is not null then 'take' else 'time' end as barrier_touched from o1),
o3 as (select *, case barrier_touched when 'stop' then stop when 'take' then take else coalesce(lc, entry_close) end * (1-0.001::double) as exit_price, case barrier_touched when 'stop' then s when 'take' then t else coalesce(l, bar_idx + 1) end as exit_idx from o2),
outc as materialized (select ticker, grp, bar_idx, entry_price, exit_price, exit_idx, barrier_touched, (exit_price - entry_price)/entry_price as forward_return, exit_idx - bar_idx - 1 as forward_bars,
    case when barrier_touched = 'take' or barrier_touched = 'time' and exit_price > entry_price then 1.0::double else 0.0::double end as label from o3),
"""

#: Bars for the outcomes: whole tickers; slices of a walk-forward; with or without features.
WHOLE = "src as materialized (select *, 0 as grp from inds),"
SLICES = "src as materialized (select *, bar_idx // ((count(*) over (partition by ticker)) // 6) - 1 as grp from inds qualify grp between 0 and 4),"

HITS = "hits as materialized (select o.ticker, o.grp, o.bar_idx as t, o.exit_idx, o.entry_price, o.exit_price, o.forward_return as ret, o.forward_bars as bars_held, s.confluence_count as confluence, o.barrier_touched as exit_reason, s.nearest_fib_level as nearest_fib from outc o join sig s using (ticker, bar_idx) where s.signal),"
PICK = """
nxt as materialized (select a.ticker, a.grp, a.t, b.t as after from hits a asof left join hits b on a.ticker = b.ticker and a.grp = b.grp and b.t > a.exit_idx),
chain as (select ticker, grp, min(t) as t from hits group by all union all select n.ticker, n.grp, n.after from chain c join nxt n on n.ticker = c.ticker and n.grp = c.grp and n.t = c.t where n.after is not null),
tr as materialized (select h.*, t + 1 as entry_idx from hits h join chain using (ticker, grp, t)),
eq0 as (select *, exp(sum(ln(1 + ret)) over w) as equity from tr window w as (partition by ticker, grp order by entry_idx rows unbounded preceding)),
eq as (select *, equity / max(equity) over (partition by ticker, grp order by entry_idx rows unbounded preceding) - 1 as drawdown from eq0),
perf as (select ticker, grp, count(*) as trades, avg((ret > 0)::int) as win_rate, avg(ret) as avg_ret, median(ret) as median_ret, avg(ret)/(stddev_samp(ret) + 1e-12)*sqrt(252) as sharpe_like,
    case when count(*) filter (ret < 0) > 1 then avg(ret)/((stddev_samp(ret) filter (ret < 0)) + 1e-12)*sqrt(252) end as sortino_like, min(drawdown) as max_drawdown, arg_max(equity, entry_idx) - 1 as cum_return,
    case when sum(ret) filter (ret < 0) < 0 then coalesce(sum(ret) filter (ret > 0), 0) / -(sum(ret) filter (ret < 0)) else 'inf'::double end as profit_factor, avg(bars_held) as avg_bars_held from eq group by all),
"""
STATS = """
cov as (select ticker, min(bar_date) as first_date, max(bar_date) as last_date, count(*) as n_rows from bars group by 1),
stats as materialized (select ticker, count(*) as n_bars, median(close) as median_close, median(close*volume) as median_dollar_volume, case when count(*) >= 15 then median(atr/close) end as median_atr_pct, min(bar_date) as first_date, max(bar_date) as last_date from inds group by 1),
"""
SCORED = """
sc as materialized (select f.*, o.label, o.forward_return, o.barrier_touched, 1/(1 + exp(2 - f.confluence_count)) as proba, f.bar_idx % 5 as fold from feat f join outc o using (ticker, bar_idx) where f.regime_ok = 1),
nb as materialized (select *, (proba >= 0.5)::int as pred, case when label = 1 then case when proba >= 0.5 then 'TP' else 'FN' end else case when proba >= 0.5 then 'FP' else 'TN' end end as mistake_type from sc),
"""
ALT = f"""
n as (select count(*) as n from supplier),
alt as (select 'S'||lpad(cast(o_custkey % n as varchar), 5, '0') as ticker, cast(o_orderdate as date) as date, o_orderpriority as metric, o_totalprice::double as value, o_orderkey as seq from orders, n),
altw as materialized (select ticker, date, {", ".join(f"arg_max(value, seq) filter (metric = '{k}') as {v}" for k, v in METRICS.items())} from alt group by 1, 2),
altl as materialized (select ticker, case isodow(date) when 5 then date + 3 when 6 then date + 2 when 7 then date + 1 else date + 1 end as date, date as source, {", ".join(f"{v} as alt_{v}" for v in METRICS.values())} from altw
    qualify row_number() over (partition by ticker, case isodow(date) when 5 then date + 3 when 6 then date + 2 when 7 then date + 1 else date + 1 end order by source desc) = 1),
"""
LIVE = """
lh as materialized (select ticker, bar_idx as t, close, confluence_count, nearest_fib_level, close - 1.5::double*greatest(atr, 1e-8) as stop, close + 2.5::double*greatest(atr, 1e-8) as take from sig where signal and bar_idx >= {first}),
lx as (select h.ticker, h.t, coalesce(min(case when b.low <= h.stop then b.bar_idx end), 1099511627776) as s, coalesce(min(case when b.high >= h.take then b.bar_idx end), 1099511627776) as k, coalesce(max(case when b.bar_idx = h.t + 20 then b.bar_idx end), 1099511627776) as e
    from lh h left join bars b on b.ticker = h.ticker and b.bar_idx between h.t + 1 and h.t + 20 group by all),
ly as materialized (select lh.*, least(s, k, e) as x, case when s = least(s, k, e) then 'stop_hit' when k = least(s, k, e) then 'take_hit' else 'time_stop' end as reason from lh join lx using (ticker, t)),
ln as materialized (select a.ticker, a.t, b.t as after from ly a asof left join lh b on a.ticker = b.ticker and b.t > a.x),
lc as (select ticker, min(t) as t from lh group by 1 union all select n.ticker, n.after from lc c join ln n on n.ticker = c.ticker and n.t = c.t where n.after is not null),
lt as materialized (select ly.* from ly join lc using (ticker, t)),
ld as (select ticker, bar_date, 'enter_long' as action, lt.close as price, stop, take, confluence_count::int as confluence, nearest_fib_level as nearest_fib, 'fib_confluence' as reason from lt join bars using (ticker) where bar_idx = t
    union all select ticker, bar_date, 'exit', case reason when 'stop_hit' then stop when 'take_hit' then take else b.close end, stop, take, 0, '', reason from lt join bars b using (ticker) where bar_idx = x),
"""
SPLITS = """
rf as (select unnest(range(10)) as f, unnest(['rsi', 'atr_pct', 'macd_hist', 'vol_z', 'confluence_count', 'retracement_depth', 'nearest_fib_dist', 'trend_up', 'regime_ok', 'fib_near']) as name),
ra as materialized (select ticker, bar_idx, mistake_type, forward_return, unnest(range(10)) as f, unnest([rsi, atr_pct, macd_hist, vol_z, confluence_count, retracement_depth, nearest_fib_dist, trend_up, regime_ok, fib_near]) as x from nb),
rl as materialized (select ticker, bar_idx, f, coalesce(x, 0) as v, (mistake_type = 'FP')::int as y from ra where mistake_type in ('FP', 'TP')),
rw as (select count(*)/2.0::double/sum(y) as one, count(*)/2.0::double/sum(1 - y) as zero from rl where f = 0),
"""
#: Gini gain of all thresholds of the nodes in `rows`.
LEVEL = """
{p}g as (select node, f, v, sum(y)::double as a, count(*)::double as n from {rows} group by all),
{p}s as (select node, f, v, lead(v) over w as nv, sum(a) over w as la, sum(n) over w as ln, sum(a) over (partition by node, f) as ta, sum(n) over (partition by node, f) as tn from {p}g window w as (partition by node, f order by v rows unbounded preceding)),
{p}b as materialized (select node, f, (v + nv)/2 as cut, round(((la*one)*(la*one) + ((ln - la)*zero)*((ln - la)*zero))/(la*one + (ln - la)*zero) + (((ta - la)*one)*((ta - la)*one) + ((tn - ln - ta + la)*zero)*((tn - ln - ta + la)*zero))/((ta - la)*one + (tn - ln - ta + la)*zero)
    - ((ta*one)*(ta*one) + ((tn - ta)*zero)*((tn - ta)*zero))/(ta*one + (tn - ta)*zero), 9) as gain from {p}s, rw where nv is not null and ln >= 5 and tn - ln >= 5 qualify row_number() over (partition by node order by gain desc, f, v) = 1 and gain > 0),
"""
PROPOSED = SPLITS + "r0 as (select *, 0 as node from rl)," + LEVEL.format(p="u", rows="r0") + """
rn as materialized (select r.ticker, r.bar_idx, case when r.v <= u.cut then 1 else 2 end as node from rl r join ub u on u.f = r.f),
r1 as (select r.ticker, r.bar_idx, r.f, r.v, r.y, n.node from rl r join rn n using (ticker, bar_idx)),""" + LEVEL.format(p="w", rows="r1") + """
rs as (select u.f as f1, u.cut as cut1, s.side, w.f as f2, w.cut as cut2, t.side as side2 from ub u, (select unnest([1, 2]) as side) s left join wb w on w.node = s.side left join (select unnest([1, 2]) as side) t on w.node is not null),
rp as (select row_number() over (order by side, side2) - 1 as leaf, * from rs),
rc as (select leaf, 1 as k, f1 as f, side as side, cut1 as cut from rp union all select leaf, 2, f2, side2, cut2 from rp where f2 is not null),
rd as (select leaf, k, f, side, round(cut, 4) as cut, name, f >= 7 as flag from rc join rf using (f)),
re as (select leaf, count(*) as parts, string_agg(name || case when flag then ' == ' || (side - 1) else case side when 1 then ' <= ' else ' > ' end || cut end, ' AND ' order by k) as predicate,
    string_agg('(' || name || case when flag then ' == ' || (side - 1) else case side when 1 then ' <= ' else ' > ' end || cut end || ')', ' and ' order by k) as py_expr from rd group by leaf),
rh as (select leaf, ticker, bar_idx, any_value(mistake_type) as mistake_type, any_value(forward_return) as forward_return, count(*) as met from rd join ra using (f) where case when flag then x = side - 1 when side = 1 then x <= cut else x > cut end group by 1, 2, 3),
ri as (select leaf, count(*) filter (mistake_type = 'FP') as fp, count(*) filter (mistake_type = 'TP') as tp, avg(forward_return) as back from rh join re using (leaf) where met = parts group by leaf),
"""
LAST = "z as (select 1) "


def r(cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 as {c}" for c in cols.split())


def sql(select: str, *parts: str) -> str:
    """The chain; outcomes read `src`, which must come before them."""
    head, tail = CHAIN.split("o0 as (", 1)
    src = next((p for p in parts if p.startswith("src")), WHOLE)
    return head + src + "\no0 as (" + tail + "\n".join(p for p in parts if not p.startswith("src")) + LAST + select


TRADES = (HITS, PICK)


def metric_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""
g as (select {key}proba, sum(label) as p, sum(1 - label) as q, sum(label * (proba >= 0.5)::int) as tp, sum((1 - label) * (proba >= 0.5)::int) as fp from sc group by {key}proba),
h as (select *, sum(p) over w as cp, sum(q) over w as cq from g window w as ({part} order by proba desc rows unbounded preceding)),
m as (select {key}sum(p) as p, sum(q) as q, sum(tp) as tp, sum(fp) as fp, sum(q * (cp - p/2)) as area, sum(p * cp/(cp + cq)) as step from h {"group by " + by if by else ""}),
mm as (select {key}cast(p + q as bigint) as n, (tp + q - fp)/(p + q) as accuracy, coalesce(2*tp/nullif(tp + fp + p, 0), 0) as f1, case when p > 0 and q > 0 then area/p/q end as roc_auc, case when p > 0 and q > 0 then step/p end as pr_auc, p/(p + q) as pos_rate from m),
"""


def folds(n: str, kind: str, slide: str) -> str:
    start = {"expanding": "200 + fold * ((n - 200) // 5)", "rolling": "252 + fold * 5"}[kind]
    end = {"expanding": "case when fold < 4 then test_start + (n - 200) // 5 else n end", "rolling": "test_start + 1"}[kind]
    count = {"expanding": "5", "rolling": "greatest(0, (n - 253) // 5 + 1)"}[kind]
    return f"""
fn as ({n}), fi as (select unnest(range({count})) as fold, n from fn), fs as (select fold, n, {start} as test_start from fi),
folds as (select fold, {slide} as train_start, greatest(0, test_start - 20) as train_end, test_start, {end} as test_end from fs where test_start > 20),
"""


def sweep_specs() -> str:
    base = {"min_bars": 252, "min_dollar_volume": 1e5, "min_close": 1.0, "min_atr_pct": 0.005, "max_atr_pct": 0.10}
    dims = {"min_bars": (252, 504, 520, 535, 550), "min_dollar_volume": (0, 1e5, 2e5, 3e5, 4e5, 1e6), "min_close": (0, 1, 3, 5, 10, 30), "max_atr_pct": (0.20, 0.10, 0.05, 0.03, 0.02), "min_atr_pct": (0.0, 0.005, 0.01, 0.015)}
    rows = [f"('{d}', {float(t)!r}::double, {', '.join(f'{float(v)!r}::double' for v in (base | {d: t}).values())})" for d, ts in dims.items() for t in ts]
    return f"specs(dimension, threshold, {', '.join(base)}) as (values {', '.join(rows)}),"


KEEP = "n_bars >= min_bars and median_dollar_volume >= min_dollar_volume and median_close >= min_close and median_atr_pct >= min_atr_pct and median_atr_pct <= max_atr_pct"
KEPT = "n_bars >= 252 and median_dollar_volume >= 300000 and median_close >= 1 and median_atr_pct between 0.005 and 0.10"


def draw_hits(p: Params = Params()) -> str:
    """The random draws, and -1 for the ratios under test."""
    size, span, own = len(p.ratios), p.random_ratio_high - p.random_ratio_low, ", ".join(f"{x!r}::double" for x in p.ratios)
    return f"""
rd as (select id as grp, list_sort(list_distinct(list_transform(range({2 * size}), lambda k: round({p.random_ratio_low!r}::double + {span!r}::double * (('0x' || md5('{p.random_seed}:' || id || ':' || k)[1:8])::bigint / 4294967296.0::double), 3)))) as every from range({p.n_permutations}) t(id)),
draws as materialized (select grp, every[1:{size}] as ratios from rd where len(every) >= {size} union all select -1, [{own}]),
hits as materialized (select s.ticker, d.grp, s.bar_idx as t, o.exit_idx, o.entry_price, o.exit_price, o.forward_return as ret, o.forward_bars as bars_held, 0 as confluence, o.barrier_touched as exit_reason, '' as nearest_fib
    from feat s join outc o using (ticker, bar_idx) join draws d on {" or ".join(f"abs(s.close - (s.swing_high - d.ratios[{k + 1}]*(s.swing_high - s.swing_low)))/s.close < {p.proximity_pct!r}" for k in range(size))}
    where s.trend_up = 1 and s.regime_ok = 1 and s.swing_high is not null and s.trend_up + s.rsi_reversal + s.macd_confirm + s.bb_confirm + s.vol_confirm + 1 >= 3),"""


def attributions() -> str:
    return """
al as (select ticker, bar_idx, unnest(['rsi', 'vol_z', 'atr_pct', 'macd_hist']) as feature, unnest([rsi, vol_z, atr_pct, macd_hist]) as x from sc),
am as (select feature, avg(x) as m, stddev_samp(x) as s from al group by 1),
att as materialized (select ticker, bar_idx, feature, (x - m)/s/10 as value from al join am using (feature) where x is not null),
"""


def two_groups(cols: str) -> str:
    return f"""
g as (select case mistake_type when 'FP' then 1 else 2 end as grp, unnest([{", ".join(f"'{c}'" for c in cols.split())}]) as feature, unnest([{", ".join(f"{c}::double" for c in cols.split())}]) as x from nb where mistake_type in ('FP', 'TP', 'TN')),
s as (select feature, count(x) filter (grp = 1) as n1, avg(x) filter (grp = 1) as mean1, stddev_samp(x) filter (grp = 1) as sd1, sum(x) filter (grp = 1) as k1, count(x) filter (grp = 2) as n2, avg(x) filter (grp = 2) as mean2, stddev_samp(x) filter (grp = 2) as sd2, sum(x) filter (grp = 2) as k2 from g group by 1),
"""


RULE_SQL = {"hot": "rsi > 60.0", "calm_trend": "atr_pct <= 0.02 and trend_up = 1", "far": "nearest_fib_dist > 0.02", "never": "vol_z > 99"}


def rule_counts(source: str = "nb") -> str:
    one = " union all ".join(f"select '{k}' as name, count(*) filter (mistake_type = 'FP') as blocked_fp, count(*) filter (mistake_type = 'TP') as blocked_tp, count(*) as n_blocked, avg(forward_return) as blocked_avg_return from {source} where {v}" for k, v in RULE_SQL.items())
    return f"({one})"


def registry() -> str:
    return f"""
e1 as (select * from {rule_counts("(select * from nb where bar_idx < 300)")} where name <> 'far' union all select 'broken', 0, 0, 0, null),
e2 as (select * from {rule_counts("(select * from nb where bar_idx >= 300)")} where name <> 'far' union all select 'broken', 0, 0, 0, null),
reg as (select name, e1.blocked_fp + e2.blocked_fp as cumulative_blocked_fp, e1.blocked_tp + e2.blocked_tp as cumulative_blocked_tp, case when name <> 'broken' then e2.blocked_fp / greatest(1, e2.blocked_tp) end as last_seen_ratio, 2::bigint as epochs_active,
    ((e1.blocked_fp + e1.blocked_tp = 0)::bigint + (e2.blocked_fp + e2.blocked_tp = 0)::bigint) as epochs_silent from e1 join e2 using (name)),
"""


ORACLES = {
    "bars_long": sql("select * from bars"),
    "bars_csv": sql("select * from bars"),
    "bars_folder": sql("select * from bars"),
    "bars_file": sql("select * from bars where ticker = 'S00001'"),
    "altdata_csv": f"""select 'S'||lpad(cast(o_custkey % (select count(*) from supplier) as varchar), 5, '0') as ticker, case o_orderpriority {" ".join(f"when '{k}' then '{v}'" for k, v in METRICS.items())} else 'other' end as metric, count(*) as n, round(sum(o_totalprice::double), 2) as total, min(cast(o_orderdate as date)) as first_date, max(cast(o_orderdate as date)) as last_date from orders group by 1, 2""",
    "panel_saved": sql("select strftime(bar_date, '%Y-%m') as month, count(*) as n, sum(label)::bigint as wins, sum(confluence_count)::bigint as confluence, sum(bar_idx)::bigint as sum_bar_idx from sc group by 1", SCORED),
    "notebook_with_scores": sql(f"select ticker, bar_idx, {r('proba')}, pred, label::int as label, mistake_type, {r('forward_return')} from nb", SCORED),
    "notebook_saved": sql(f"select mistake_type, count(*) as n, round(avg(forward_return), 6) as mean_forward_return, max(confluence_count)::bigint as most_confluence from nb group by 1", SCORED),
    "moving_averages": sql(f"select ticker, bar_idx, {r('ma20 ma50 ma200', 7)} from inds"),
    "bollinger": sql(f"select ticker, bar_idx, {r('bb_mid bb_up bb_low')} from (select ticker, bar_idx, case when sd20 is not null then ma20 end as bb_mid, ma20 + 2*sd20 as bb_up, ma20 - 2*sd20 as bb_low from inds)"),
    "atr": sql(f"select ticker, bar_idx, {r('true_range atr atr_pct')} from (select *, atr/close as atr_pct from inds)"),
    "volume_z": sql(f"select ticker, bar_idx, {r('vol_z')} from inds"),
    "ema_macd": sql(f"select ticker, bar_idx, {r('ema_fast ema_slow macd macd_sig macd_hist')} from seq"),
    "rsi": sql(f"select ticker, bar_idx, {r('rsi')} from seq"),
    "pivots": sql("select ticker, idx as bar_idx, kind as pivot, conf as pivot_confirmed_at from piv"),
    "active_leg_levels": sql("select ticker, bar_idx, " + r("swing_low swing_high") + ", " + ", ".join(f"round(swing_high - {x}::double*(swing_high - swing_low), 6) as fib_{int(x * 1000)}" for x in (0.236, 0.382, 0.5, 0.618, 0.786)) + ", round(swing_high + 0.272::double*(swing_high - swing_low), 6) as ext_1272, round(swing_high + 0.618::double*(swing_high - swing_low), 6) as ext_1618 from leg"),
    "nearest_level": sql(f"select ticker, bar_idx, {r('nearest_fib_dist')}, nearest_fib_level from feat"),
    "retracement_depth": sql(f"select ticker, bar_idx, {r('retracement_depth')} from feat"),
    "confluence": sql("select ticker, bar_idx, fib_near, trend_up, rsi_reversal, macd_confirm, bb_confirm, vol_confirm, regime_ok, confluence_count from feat"),
    "entry_signals": sql("select ticker, bar_idx, confluence_count, nearest_fib_level from sig where signal"),
    "barrier_labels": sql(f"select b.ticker, b.bar_idx, label, barrier_touched, {r('forward_return')}, forward_bars from bars b left join outc o using (ticker, bar_idx)"),
    "trades": sql(f"select ticker, entry_idx, exit_idx, {r('entry_price exit_price ret')}, bars_held, confluence, exit_reason, nearest_fib from tr", *TRADES),
    "ticker_performance": sql(f"select ticker, trades, {r('win_rate avg_ret median_ret sharpe_like sortino_like max_drawdown cum_return profit_factor avg_bars_held')} from perf", *TRADES),
    "ticker_summary": sql(f"select ticker, coalesce(trades, 0) as trades, {r('win_rate avg_ret sharpe_like max_drawdown cum_return')} from (select distinct ticker from bars) left join perf using (ticker)", *TRADES),
    "equity_curve": sql(f"select ticker, entry_idx, {r('equity drawdown')} from eq", *TRADES),
    "walk_forward_performance": sql(f"select ticker, grp as fold, trades, {r('win_rate avg_ret median_ret max_drawdown cum_return avg_bars_held')} from perf", SLICES, *TRADES),
    "corpus_headline": sql("select count(*) as tickers_with_trades, round(avg(avg_ret), 6) as mean_avg_ret, round(median(avg_ret), 6) as median_avg_ret from perf", *TRADES),
    "ticker_stats": sql(f"select ticker, n_bars, {r('median_close median_dollar_volume median_atr_pct')}, first_date, last_date from stats", STATS),
    "universe_filter": sql(f"select ticker, n_bars from stats where {KEPT}", STATS),
    "universe_bars": sql(f"select ticker, count(*) as n, sum(volume) as volume from bars where ticker in (select ticker from stats where {KEPT}) group by 1", STATS),
    "filter_sweep": sql(f"""select dimension, threshold, count(avg_ret) as n_tickers, round(avg(avg_ret), 6) as mean, round(median(avg_ret), 6) as median, round(quantile_cont(avg_ret, 0.25), 6) as p25, round(quantile_cont(avg_ret, 0.75), 6) as p75, round(avg((avg_ret > 0)::int), 6) as share_positive
        from specs left join (stats join perf using (ticker)) on {KEEP} group by 1, 2""", *TRADES, STATS, sweep_specs()),
    "coverage_profile": sql("""select count(*) as n_tickers, min(first_date) as first_min, date '1970-01-01' + cast(floor(median(first_date - date '1970-01-01')) as int) as first_median, max(first_date) as first_max, min(last_date) as last_min, date '1970-01-01' + cast(floor(median(last_date - date '1970-01-01')) as int) as last_median, max(last_date) as last_max,
        min(n_rows) as rows_min, round(quantile_cont(n_rows, 0.25), 6) as rows_p25, round(quantile_cont(n_rows, 0.5), 6) as rows_median, round(quantile_cont(n_rows, 0.75), 6) as rows_p75, max(n_rows) as rows_max from cov""", STATS),
    "survivorship": sql("select *, case when first_spread_days < 30 and last_spread_days < 30 then 'likely biased' when last_spread_days > 365 then 'varied ends' else 'unclear' end as verdict from (select max(first_date) - min(first_date) as first_spread_days, max(last_date) - min(last_date) as last_spread_days from cov)", STATS),
    "short_history": sql("select ticker, n_rows from cov where n_rows < 0.98 * (select median(n_rows) from cov)", STATS),
    "dollar_volume": sql(f"select ticker, {r('median_dollar_volume')} from stats", STATS),
    "permutation_metrics": sql("select d.grp as draw_id, count(ret) as trades, round(coalesce(avg(ret), 0), 6) as avg_ret, round(list_sum(any_value(ratios)), 6) as ratio_sum from draws d left join tr on tr.grp = d.grp where d.grp >= 0 group by 1", draw_hits(), PICK),
    "permutation_test": sql("""select round(baseline, 6) as baseline, round(perm_mean, 6) as perm_mean, round(perm_std, 6) as perm_std, n_perms, round(avg((abs(x - perm_mean) >= abs(baseline - perm_mean))::int), 6) as p_value, round((baseline - perm_mean)/perm_std, 6) as effect
        from xs, (select avg(x) as perm_mean, stddev_samp(x) as perm_std, count(*) as n_perms from xs), (select avg(ret) as baseline from tr where grp = -1) group by all""",
        draw_hits(), PICK, "xs as materialized (select d.grp, coalesce(avg(ret), 0) as x from draws d left join tr on tr.grp = d.grp where d.grp >= 0 group by 1),"),
    "altdata_wide": sql("select * from altw", ALT),
    "altdata_lagged": sql("select * exclude (source) from altl", ALT),
    "asof_altdata": sql("select b.ticker, b.bar_idx, b.bar_date, a.* exclude (ticker, date, source) from bars b asof left join altl a on a.ticker = b.ticker and a.date <= b.bar_date", ALT),
    "panel_positions": sql("select ticker, bar_idx, row_number() over (order by bar_date, ticker) - 1 as pos from bars"),
    "dataset": sql(f"select ticker, bar_idx, {r('rsi macd_hist atr_pct vol_z nearest_fib_dist retracement_depth')}, confluence_count::double as confluence_count, label::int as label from sc", SCORED),
    "folds_expanding": sql("select * from folds", folds("select count(*) as n from bars", "expanding", "0")),
    "folds_sliding": sql("select * from folds", folds("select count(*) as n from bars", "expanding", "greatest(0, greatest(0, test_start - 20) - 504)")),
    "folds_rolling": sql("select * from folds", folds("select count(distinct bar_date) as n from bars", "rolling", "greatest(0, greatest(0, test_start - 20) - 504)")),
    "fold_assignment": sql("select fold, case when pos >= test_start then 'test' else 'train' end as part, count(*) as n, min(pos) as first_pos, max(pos) as last_pos from (select row_number() over (order by bar_date, ticker) - 1 as pos from bars) join folds on pos >= train_start and pos < train_end or pos >= test_start and pos < test_end group by 1, 2", folds("select count(*) as n from bars", "expanding", "0")),
    "binary_metrics": sql(f"select fold, n, {r('accuracy f1 roc_auc pr_auc pos_rate')} from mm", SCORED, metric_sql("fold")),
    "oof_metrics": sql(f"select n as n_oof, {r('accuracy f1 roc_auc pr_auc pos_rate')}, (select count(distinct fold) from sc) as folds from mm", SCORED, metric_sql("")),
    "failure_notebook": sql(f"select ticker, bar_idx, {r('proba')}, pred, label::int as label, mistake_type, {r('forward_return')}, barrier_touched, {r('rsi')}, nearest_fib_level, confluence_count from nb", SCORED),
    "mistake_counts": sql("select mistake_type, count(*) as n from nb group by 1", SCORED),
    "fp_returns": sql("select count(*) as n, round(avg(forward_return), 6) as mean_forward_return from nb where mistake_type = 'FP'", SCORED),
    "attribution_budget": sql("""select mistake_type, count(*) as n, sum(bar_idx)::bigint as sum_bar_idx from (select mistake_type, bar_idx from nb where mistake_type in ('FP', 'FN')
        union all (select mistake_type, bar_idx from nb where mistake_type not in ('FP', 'FN') order by ('0x' || md5(ticker || ':' || bar_idx)[1:8])::bigint % 2147483648, ticker, bar_idx limit (select greatest(0, 12000 - count(*)) from nb where mistake_type in ('FP', 'FN')))) group by 1""", SCORED),
    "attribution_topk": sql("""select ticker, bar_idx, coalesce(string_agg(t, ';' order by k) filter (value > 0), '') as top_pos_features, coalesce(string_agg(t, ';' order by k) filter (value < 0), '') as top_neg_features
        from (select *, feature || '=' || printf('%+.3f', value) as t, row_number() over (partition by ticker, bar_idx, value > 0 order by abs(value) desc, feature) as k from att) where k <= 2 or value = 0 group by 1, 2""", SCORED, attributions()),
    "mean_attribution": sql("select feature, round(avg(abs(value)), 6) as mean_abs, round(avg(value), 6) + 0.0 as mean_signed from att group by 1", SCORED, attributions()),
    "insight_numeric": sql("select feature, n1, round(mean1, 6) as mean1, round(sd1, 6) as sd1, n2, round(mean2, 6) as mean2, round(sd2, 6) as sd2, round((mean1 - mean2)/sqrt(((n1 - 1)*sd1*sd1 + (n2 - 1)*sd2*sd2)/(n1 + n2 - 2)), 6) as cohens_d from s", SCORED, two_groups("rsi atr_pct macd_hist vol_z")),
    "insight_binary": sql("select feature, n1, k1, n2, k2, round(mean1 - mean2, 6) as delta from s", SCORED, two_groups("trend_up fib_near macd_confirm vol_confirm")),
    "insight_effects": sql("""select feature, kind, round(e, 6) as effect_size, label as effect_label, case when kind = 'categorical' then 'shift' when e > 0 then '↑ in FP' when e < 0 then '↓ in FP' else 'no shift' end as direction from (
        select feature, 'numeric' as kind, (mean1 - mean2)/sqrt(((n1 - 1)*sd1*sd1 + (n2 - 1)*sd2*sd2)/(n1 + n2 - 2)) as e, 'Cohen''s d' as label from s where not flag and n1 > 1 and n2 > 1
        union all select feature, 'binary', mean1 - mean2, 'Δ proportion' from s where flag and n1 > 0 and n2 > 0
        union all select 'nearest_fib_level', 'categorical', sqrt(sum(pow(a - ea, 2)/ea + pow(b - eb, 2)/eb)/any_value(aa + bb)), 'Cramer''s V'
        from (select *, (a + b)*aa/(aa + bb) as ea, (a + b)*bb/(aa + bb) as eb from (select *, sum(a) over () as aa, sum(b) over () as bb from (select nearest_fib_level as v, count(*) filter (mistake_type = 'FP') as a, count(*) filter (mistake_type in ('TP', 'TN')) as b from nb where nearest_fib_level is not null and mistake_type in ('FP', 'TP', 'TN') group by 1))))""",
        SCORED, two_groups("rsi atr_pct macd_hist vol_z confluence_count retracement_depth nearest_fib_dist trend_up regime_ok fib_near rsi_reversal macd_confirm bb_confirm vol_confirm").replace("sum(x) filter (grp = 2) as k2", "sum(x) filter (grp = 2) as k2, feature in ('trend_up', 'regime_ok', 'fib_near', 'rsi_reversal', 'macd_confirm', 'bb_confirm', 'vol_confirm') as flag")),
    "insight_categorical": sql("""select 'nearest_fib_level' as feature, aa::bigint as n1, bb::bigint as n2, round(sum(pow(a - ea, 2)/ea + pow(b - eb, 2)/eb), 6) as chi2, count(*) - 1 as dof, round(sqrt(sum(pow(a - ea, 2)/ea + pow(b - eb, 2)/eb)/(aa + bb)), 6) as cramers_v, round(max(a)/aa, 6) as share1, round(max(b)/bb, 6) as share2
        from (select *, (a + b)*aa/(aa + bb) as ea, (a + b)*bb/(aa + bb) as eb from (select *, sum(a) over () as aa, sum(b) over () as bb from (select nearest_fib_level as v, count(*) filter (mistake_type = 'FP') as a, count(*) filter (mistake_type in ('TP', 'TN')) as b from nb where nearest_fib_level is not null and mistake_type in ('FP', 'TP', 'TN') group by 1))) group by aa, bb """, SCORED),
    "holm": """with p as (select o_orderpriority as feature, (sum(o_orderkey) % 1000)/20000.0::double as p_value from orders group by 1), a as (select *, least(1, (count(*) over () - row_number() over (order by p_value, feature) + 1)*p_value) as adj from p)
        select feature, round(p_value, 6) as p_value, round(max(adj) over (order by p_value, feature rows unbounded preceding), 6) as p_value_corrected from a""",
    "rule_scores": sql(f"select name, blocked_fp, blocked_tp, n_blocked, round(blocked_avg_return, 6) as blocked_avg_return, round(blocked_fp/greatest(1, blocked_fp + blocked_tp), 6) as purity, round(blocked_fp/greatest(1, blocked_tp), 6) as ratio from {rule_counts()}", SCORED),
    "rules_saved": sql(f"select name, blocked_fp::bigint as n_blocked_fp, blocked_tp::bigint as n_blocked_tp, round(blocked_fp/greatest(1, blocked_tp), 6) as fp_tp_ratio, round(blocked_avg_return, 6) as blocked_avg_return, name <> 'far' as enabled from {rule_counts()}", SCORED),
    "apply_rules": sql("select ticker, bar_idx from sig where signal and not (coalesce(rsi > 60, false) or coalesce(atr_pct <= 0.02 and trend_up = 1, false) or coalesce(vol_z > 99, false))"),
    "rule_registry": sql("select name, cumulative_blocked_fp, cumulative_blocked_tp, round(last_seen_ratio, 6) as last_seen_ratio, epochs_active, epochs_silent from reg", SCORED, registry()),
    "rule_removals": sql("select name from reg where case when cumulative_blocked_fp = 0 and cumulative_blocked_tp = 0 then epochs_silent >= 2 else cumulative_blocked_fp/greatest(1, cumulative_blocked_tp) < 1.5 or epochs_silent >= 2 end", SCORED, registry()),
}
ORACLES |= {
    "live_decisions": sql(f"select ticker, bar_date, action, {r('price stop take')}, confluence, nearest_fib, reason from ld", LIVE.format(first=219)),
    "live_decisions_warm": sql("select ticker, action, reason, count(*) as n, round(sum(price), 4) as prices from ld group by 1, 2, 3", LIVE.format(first=300)),
    "propose_rules": sql("""select 'rule_' || lpad(leaf::varchar, 2, '0') as name, predicate, py_expr, fp as n_blocked_fp, tp as n_blocked_tp, round(fp / greatest(1, tp), 3) as fp_tp_ratio, round(back, 5) as blocked_avg_return, false as enabled, '' as notes
        from ri join re using (leaf) where fp >= 5 and fp / greatest(1, fp + tp) >= 0.3 and fp / greatest(1, tp) >= 0.5""", SCORED, PROPOSED),
}
ORACLES |= {f"{k}_full": ORACLES[k] for k in ("permutation_metrics", "permutation_test")}
