"""Grid placebos, path bootstraps, rank duplicates and regressions from sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import ind
from tidemark.operators import multiplicity as M
from tidemark.operators import portfolio as P
from tidemark.operators import rolling as R
from tidemark.operators.blocks import DAYS, HOURS, sequence
from tidemark.operators.crosssection import centred_rank, first_rank, over
from tidemark.plans.inference import _DRAW
from tidemark.plans.names import _CAL, _SYM, _XR, calendar_scores
from tidemark.plans.registry import query
from tidemark.plans.tables import BARS, DAY_US, DECISIONS, PANEL, bars, decisions, panel
from tidemark.plans.windows import _MKT, _RET, _W, market_panel, ret_bars

# --- grid placebo --------------------------------------------------------------------------------

REPS, COST = 6, 8.0
#: Baskets and spans of the grid; a day counts if it has 2 k + 2 names.
GRID = [(k, n) for k in (3, 5) for n in (1, 5, 10)]
LEAST_DAYS = 120
_A, _B, _P = M.SHUFFLE
_LAGS = ", ".join(f"({i}, {k}, {n}, {n + 2})" for i, (k, n) in enumerate(GRID))
_GRID = f"""{_CAL}, cfg(config, basket, span, lag) AS (VALUES {_LAGS}), nm AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS place FROM (SELECT DISTINCT symbol FROM rk)),
t AS (SELECT rk.day, rk.symbol, rk.ret1, cfg.*, rk.n >= 2 * basket + 2 AS ok0, CASE WHEN rk.n < 2 * basket + 2 OR k IS NULL THEN 0.0 WHEN k <= basket THEN -1.0 / basket WHEN k > rk.n - basket THEN 1.0 / basket ELSE 0 END AS target FROM rk CROSS JOIN cfg),
w AS (SELECT *, {' '.join(f"CASE WHEN span = {n} THEN avg(target) OVER (PARTITION BY symbol, config ORDER BY day ROWS {n - 1} PRECEDING) ELSE" for n in (1, 5))} avg(target) OVER (PARTITION BY symbol, config ORDER BY day ROWS 9 PRECEDING) END END AS w FROM t),
e AS (SELECT *, coalesce(lag(w) OVER o, 0) AS e, coalesce(lag(ok0) OVER o, false) AS ok FROM w WINDOW o AS (PARTITION BY symbol, config ORDER BY day)), x1 AS (SELECT *, CASE WHEN ret1 IS NOT NULL THEN e ELSE 0 END AS xw FROM e),
x2 AS (SELECT *, abs(xw - coalesce(lag(xw) OVER (PARTITION BY symbol, config ORDER BY day), 0)) AS dw FROM x1), paid AS (SELECT config, day, sum(dw) * {COST} / 2 AS paid, bool_or(ok) AS ok FROM x2 GROUP BY 1, 2),
f AS (SELECT day, place, ret1, row_number() OVER (PARTITION BY day ORDER BY place) AS i FROM rk JOIN nm ON nm.symbol = rk.symbol WHERE ret1 IS NOT NULL), rp AS (SELECT unnest(range({REPS})) AS rep),
key AS (SELECT rep, day, place, (((rep * 1000003 + day * 7919 + place * 104729 + 1) % {_P} * {_A}) % {_P} * {_B} + place * 31 + rep * 17) % {_P} AS u FROM f CROSS JOIN rp),
ord AS (SELECT rep, day, place, row_number() OVER (PARTITION BY rep, day ORDER BY u, place) AS i FROM key), mix AS (SELECT o.rep, o.day, o.place, f.ret1 FROM ord o JOIN f ON f.day = o.day AND f.i = o.i),
gr AS (SELECT config, rep, mix.day, sum(xw * mix.ret1) * 10000 AS gross FROM mix JOIN nm ON nm.place = mix.place JOIN x2 ON x2.symbol = nm.symbol AND x2.day = mix.day GROUP BY ALL),
g2 AS (SELECT p.config, r.rep, p.day, coalesce(gr.gross, 0) AS gross, p.paid FROM paid p CROSS JOIN rp r LEFT JOIN gr ON gr.config = p.config AND gr.rep = r.rep AND gr.day = p.day WHERE p.ok),
v AS (SELECT config, rep, day, s, s * gross - paid AS x FROM g2 CROSS JOIN (SELECT unnest([1, -1]) AS s)), mu AS (SELECT config, rep, s, avg(x) AS mean, count(*) AS n FROM v GROUP BY 1, 2, 3),
pick AS (SELECT config, rep, max_by(s, (mean, s)) AS s FROM mu GROUP BY 1, 2), ce AS (SELECT v.config, v.rep, v.x - mu.mean AS e, mu.mean, mu.n, row_number() OVER (PARTITION BY v.config, v.rep ORDER BY day) AS i FROM v JOIN pick USING (config, rep, s) JOIN mu USING (config, rep, s)),
ac AS (SELECT a.config, a.rep, any_value(a.mean) AS mean, any_value(a.n) AS n, sum(CASE WHEN a.i = b.i THEN a.e * b.e ELSE 2.0 * (1 - (a.i - b.i) / (cfg.lag + 1.0)) * a.e * b.e END) AS s FROM ce a JOIN cfg ON cfg.config = a.config JOIN ce b ON b.config = a.config AND b.rep = a.rep AND b.i BETWEEN a.i - cfg.lag AND a.i GROUP BY 1, 2)"""


@query("grid_placebo", "N31", f"WITH {_GRID} SELECT rep, max(mean / sqrt(greatest(s / n, 1e-18) / n)) AS max_t FROM ac WHERE n >= {LEAST_DAYS} GROUP BY rep", "max_t", digits=4)
def grid_placebo(spark, folder):
    """The largest t over baskets and spans when each day's returns are dealt to other names."""
    d = calendar_scores(spark, folder)
    d = d.withColumns({"n": over(["day"], F.count("score")), "k": first_rank("score", "symbol", "day")})
    have = [F.col("n") >= 2 * b + 2 for b, _ in GRID]
    leg = [F.when(~h | F.col("k").isNull(), 0.0).when(F.col("k") <= b, -1.0 / b).when(F.col("k") > F.col("n") - b, 1.0 / b).otherwise(0.0) for h, (b, _) in zip(have, GRID, strict=True)]
    d = d.withColumns({f"t{i}": x for i, x in enumerate(leg)} | {f"o{i}": x for i, x in enumerate(have)})
    s = sequence(d, ["symbol"], ["day"], back=14, bound=DAYS)
    s = s.add({f"w{i}": F.avg(f"t{i}").over(s.rows(-(n - 1), 0)) for i, (_, n) in enumerate(GRID)})
    s = s.add({f"x{i}": F.when(F.col("ret1").isNotNull(), F.coalesce(F.lag(f"w{i}").over(s.by()), F.lit(0.0))).otherwise(0.0) for i in range(len(GRID))})
    s = s.add({f"p{i}": F.abs(F.col(f"x{i}") - F.coalesce(F.lag(f"x{i}").over(s.by()), F.lit(0.0))) * (COST / 2) for i in range(len(GRID))} | {f"m{i}": F.coalesce(F.lag(f"o{i}").over(s.by()), F.lit(False)) for i in range(len(GRID))})
    each = lambda p: F.array(*[F.col(f"{p}{i}") for i in range(len(GRID))])
    d = s.result("day", "symbol", "ret1", each("x").alias("weights"), each("p").alias("paid"), each("m").alias("ok"))
    places = d.select("symbol").distinct().groupBy().agg(F.array_sort(F.collect_set("symbol")).alias("names")).withColumn("g", F.lit(0))  # one name an entry
    d = d.withColumn("g", F.lit(0)).join(F.broadcast(places), "g").withColumn("place", F.array_position("names", F.col("symbol")) - 1)
    return M.grid_placebo(d, at="day", place="place", ret="ret1", cost="paid", weights="weights", ok="ok", lags=[n + 2 for _, n in GRID], reps=REPS, least=[LEAST_DAYS] * len(GRID))


# --- path bootstraps -----------------------------------------------------------------------------

BOOT, PF, DD = 30, 1.0, 0.35
_TRADES = f"{DECISIONS}, d AS (SELECT symbol, id, ts_us, gross_bps / 10000 AS x FROM decisions), p AS (SELECT symbol, x, row_number() OVER (PARTITION BY symbol ORDER BY ts_us, id) - 1 AS rn FROM d), z AS (SELECT symbol, count(*) AS size FROM p GROUP BY 1), r AS (SELECT unnest(range({BOOT})) AS rep)"


@query("live_validation", "N52", f"""WITH {_TRADES}, i AS (SELECT p.symbol, rep, {_DRAW("'5'", 'rep', 'p.symbol', 'p.rn')} % size AS rn FROM p JOIN z ON z.symbol = p.symbol CROSS JOIN r),
b AS (SELECT i.symbol, rep, coalesce(sum(x) FILTER (x > 0), 0) AS up, coalesce(-sum(x) FILTER (x < 0), 0) AS down FROM i JOIN p ON p.symbol = i.symbol AND p.rn = i.rn GROUP BY 1, 2), pf AS (SELECT symbol, avg(CASE WHEN CASE WHEN down <= 1e-12 THEN up > 0 ELSE up / down > {PF} END THEN 1.0 ELSE 0 END) AS p FROM b GROUP BY 1),
o AS (SELECT symbol, rep, x, id, {_DRAW("'9'", 'rep', 'id')} AS u FROM d CROSS JOIN r), l AS (SELECT *, exp(sum(ln(1 + x)) OVER w) AS eq FROM o WINDOW w AS (PARTITION BY symbol, rep ORDER BY u, id)),
k AS (SELECT symbol, rep, eq / max(eq) OVER (PARTITION BY symbol, rep ORDER BY u, id) - 1 AS fall FROM l), f AS (SELECT symbol, rep, min(fall) AS worst FROM k GROUP BY 1, 2), dd AS (SELECT symbol, avg(CASE WHEN abs(worst) < {DD} THEN 1.0 ELSE 0 END) AS p FROM f GROUP BY 1)
SELECT z.symbol, z.size AS n, CASE WHEN z.size < 5 THEN 0.0 ELSE pf.p END AS prob_pf, CASE WHEN z.size < 5 THEN 0.0 ELSE dd.p END AS prob_dd FROM z LEFT JOIN pf ON pf.symbol = z.symbol LEFT JOIN dd ON dd.symbol = z.symbol""", "prob_pf prob_dd")
def live_validation(spark, folder):
    d = decisions(spark, folder).select("symbol", "id", "ts_us", (F.col("gross_bps") / 10_000).alias("x"))
    a = M.prob_profit_factor(d, "symbol", ["ts_us", "id"], "x", PF, BOOT, 5, 1000 * DAY_US)
    return a.join(M.prob_drawdown(d, "symbol", "id", "x", DD, BOOT, 9), "symbol").select("symbol", "n", "prob_pf", "prob_dd")


# --- rank duplicates -----------------------------------------------------------------------------

_SIG = f"""{_MKT}, y AS (SELECT day, symbol, fund, oi, ratio, r FROM x), s AS (SELECT day, symbol, unnest([{{'name': 'b_fund', 'v': fund}}, {{'name': 'c_fund_scaled', 'v': 3 * fund + 1}}, {{'name': 'a_fund_cubed', 'v': (10 * fund) * (10 * fund) * (10 * fund)}}, {{'name': 'd_fund_late', 'v': CASE WHEN day % 50 > 1 THEN fund END}},
 {{'name': 'e_fund_near', 'v': CASE WHEN day % 1009 = 3 THEN ratio ELSE fund END}}, {{'name': 'f_oi', 'v': oi}}, {{'name': 'g_oi_log', 'v': ln(oi)}}, {{'name': 'h_ratio', 'v': ratio}}, {{'name': 'i_ratio_late', 'v': CASE WHEN day % 7 > 0 THEN ratio END}}, {{'name': 'j_return', 'v': r}}, {{'name': 'k_fund_rare', 'v': CASE WHEN day % 400 = 0 THEN fund END}}]) AS q FROM y),
rk AS (SELECT q.name AS name, day, symbol, round((rank() OVER (PARTITION BY q.name, day ORDER BY q.v) + (count(*) OVER (PARTITION BY q.name, day, q.v) - 1) / 2.0) / count(*) OVER (PARTITION BY q.name, day) - 0.5, 9) AS k FROM s WHERE q.v IS NOT NULL),
pr AS (SELECT name, md5(string_agg(day || '|' || symbol || '|' || k, ';' ORDER BY day, symbol)) AS h FROM rk GROUP BY 1), ex AS (SELECT name, min(name) OVER (PARTITION BY h) AS first FROM pr),
ed AS (SELECT a.name AS a, b.name AS b FROM rk a JOIN rk b ON a.day = b.day AND a.symbol = b.symbol AND a.name < b.name WHERE a.name IN (SELECT first FROM ex) AND b.name IN (SELECT first FROM ex) GROUP BY 1, 2 HAVING count(*) >= 500 AND avg(CASE WHEN abs(a.k - b.k) <= 1e-12 THEN 1.0 ELSE 0 END) >= 0.999),
st AS (SELECT first AS name, row_number() OVER (ORDER BY first) AS i FROM (SELECT DISTINCT first FROM ex)), es AS (SELECT coalesce(list(a || '>' || b), []::VARCHAR[]) AS es FROM ed),
gl AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS leads UNION ALL SELECT st.i, CASE WHEN len(list_filter(leads, lambda l: list_contains(es, l || '>' || st.name))) > 0 THEN leads ELSE list_append(leads, st.name) END FROM gl JOIN st ON st.i = gl.i + 1, es),
ld AS (SELECT unnest(leads) AS lead FROM (SELECT leads FROM gl ORDER BY i DESC LIMIT 1)),
le AS (SELECT f.first AS name, coalesce(min(ld.lead), f.first) AS lead FROM (SELECT DISTINCT first FROM ex) f LEFT JOIN ed ON ed.b = f.first LEFT JOIN ld ON ld.lead = ed.a AND f.first NOT IN (SELECT lead FROM ld) GROUP BY f.first)"""


@query("rank_duplicates", "G24", f"WITH RECURSIVE {_SIG} SELECT ex.name, le.lead AS representative, ex.name <> ex.first AS exact FROM ex JOIN le ON le.name = ex.first")
def rank_duplicates(spark, folder):
    y = market_panel(spark, folder, 0).result("day", "symbol", "fund", "oi", "ratio", "r")
    day, fund = F.col("day"), F.col("fund")
    signals = {"b_fund": fund, "c_fund_scaled": 3 * fund + 1, "a_fund_cubed": (10 * fund) * (10 * fund) * (10 * fund), "d_fund_late": F.when(day % 50 > 1, fund), "e_fund_near": F.when(day % 1009 == 3, F.col("ratio")).otherwise(fund), "f_oi": F.col("oi"),
               "g_oi_log": F.ln("oi"), "h_ratio": F.col("ratio"), "i_ratio_late": F.when(day % 7 > 0, F.col("ratio")), "j_return": F.col("r"), "k_fund_rare": F.when(day % 400 == 0, fund)}
    s = y.select("day", "symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in signals.items()])).alias("q")).select("day", "symbol", "q.*").where("v IS NOT NULL")
    return M.rank_duplicates(s.select("name", "day", "symbol", centred_rank("v", "name", "day").alias("rank")), name="name", at="day", cell="symbol", rank="rank")


# --- HAR regression ------------------------------------------------------------------------------

ALPHA, AHEAD, SPLIT = 0.01, 24, 0.7
_ANN = 24 * 365
_HARC = lambda n, minp: f"sqrt(CASE WHEN count(q) OVER {_W(n - 1)} >= {minp} THEN avg(q) OVER {_W(n - 1)} END * {_ANN})"
_FILL = lambda x: f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar ROWS UNBOUNDED PRECEDING), 0)"
_FUT = f"(PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND {AHEAD} FOLLOWING)"
_M3 = [f"m{i}{j}" for i in range(4) for j in range(i, 4)]
_PROD = lambda p: ", ".join(f"sum({a} * {b}) - sum({a}) * sum({b}) / count(*) AS {p}{i}{j}" for i, a in enumerate(("x0", "x1", "x2", "y")) for j, b in enumerate(("x0", "x1", "x2", "y")) if j >= i)


def _supports() -> str:
    """Each support's coefficients by Cramer's rule, with the gain of its fit."""
    g = lambda i, j: f"m{min(i, j)}{max(i, j)}" + (f" + {ALPHA}" if i == j else "")
    g = lambda i, j, g=g: f"({g(i, j)})"
    out = ["SELECT symbol, 0.0 AS b0, 0.0 AS b1, 0.0 AS b2, 0.0 AS gain FROM tr"]
    for on in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)):
        v = [f"m{i}3" for i in on]
        if len(on) == 1:
            det, num = g(on[0], on[0]), [v[0]]
        elif len(on) == 2:
            i, j = on
            det, num = f"({g(i, i)} * {g(j, j)} - {g(i, j)} * {g(i, j)})", [f"({v[0]} * {g(j, j)} - {g(i, j)} * {v[1]})", f"({g(i, i)} * {v[1]} - {g(i, j)} * {v[0]})"]
        else:
            m = [[g(i, j) for j in on] for i in on]
            d3 = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
            det, num = d3(m), [d3([[v[r] if cc == k else m[r][cc] for cc in range(3)] for r in range(3)]) for k in range(3)]
        b = {i: f"{x} / {det}" for i, x in zip(on, num, strict=True)}
        cols = ", ".join(f"{b.get(i, '0.0')} AS b{i}" for i in range(3))
        gain = " + ".join(f"{b[i]} * m{i}3" for i in on)
        out.append(f"SELECT symbol, {cols}, {gain} AS gain FROM tr WHERE " + " AND ".join(f"{b[i]} > 0" for i in on))
    return " UNION ALL ".join(out)


_R2 = lambda p, n: f"1 - (({p}33 - 2 * (b0 * {p}03 + b1 * {p}13 + b2 * {p}23) + b0 * b0 * {p}00 + b1 * b1 * {p}11 + b2 * b2 * {p}22 + 2 * (b0 * b1 * {p}01 + b0 * b2 * {p}02 + b1 * b2 * {p}12)) / {n}) / ({p}33 / {n} + 1e-9)"
_HAR = f"""{_RET}, q0 AS (SELECT symbol, bar, r * r AS q FROM x), q1 AS (SELECT symbol, bar, sqrt(q * {_ANN}) AS h, {_HARC(24, 12)} AS d, {_HARC(168, 84)} AS w, CASE WHEN count(q) OVER {_FUT} = {AHEAD} THEN sqrt(avg(q) OVER {_FUT} * {_ANN}) END AS y FROM q0),
q2 AS (SELECT symbol, bar, {_FILL('h')} AS x0, {_FILL('d')} AS x1, {_FILL('w')} AS x2, y FROM q1), sp AS (SELECT symbol, min(bar) + CAST(floor((max(bar) - min(bar)) * {SPLIT}) AS BIGINT) AS cut FROM q2 GROUP BY 1),
tn AS (SELECT q2.* FROM q2 JOIN sp ON sp.symbol = q2.symbol WHERE y IS NOT NULL AND bar < cut), te AS (SELECT q2.* FROM q2 JOIN sp ON sp.symbol = q2.symbol WHERE y IS NOT NULL AND bar >= cut + {AHEAD} * 3600000000),
tr AS (SELECT symbol, count(*) AS n, avg(x0) AS a0, avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, {_PROD('m')} FROM tn GROUP BY 1), tt AS (SELECT symbol, count(*) AS nt, {_PROD('v')} FROM te GROUP BY 1), fits AS ({_supports()}), best AS (SELECT symbol, max_by((b0, b1, b2), gain) AS b FROM fits GROUP BY 1),
j AS (SELECT tr.*, tt.* EXCLUDE (symbol), b[1] AS b0, b[2] AS b1, b[3] AS b2 FROM tr JOIN best ON best.symbol = tr.symbol LEFT JOIN tt ON tt.symbol = tr.symbol)"""


@query("har_regression", "N76", f"WITH {_HAR} SELECT symbol, n AS n_train, coalesce(nt, 0) AS n_test, ay - b0 * a0 - b1 * a1 - b2 * a2 AS intercept, b0 AS b_rv_1h_ann, b1 AS b_rv_1d_ann, b2 AS b_rv_1w_ann, {_R2('m', 'n')} AS r2_train, {_R2('v', 'nt')} AS r2_test FROM j",
       "intercept b_rv_1h_ann b_rv_1d_ann b_rv_1w_ann r2_train r2_test", digits=5)
def har_regression(spark, folder):
    """Volatility of the next day on those of the last hour, day and week; a gap of a day between the two samples."""
    s = ret_bars(spark, folder, back=168).add({"q": F.col("r") * F.col("r")})

    def mean(n, minp):
        w = s.rows(-(n - 1), 0)
        return F.sqrt(F.when(F.count("q").over(w) >= minp, F.avg("q").over(w)) * _ANN)

    after = s.rows(1, AHEAD)
    s = s.add({"rv_1h_ann": F.sqrt(F.col("q") * _ANN), "rv_1d_ann": mean(24, 12), "rv_1w_ann": mean(168, 84), "y": F.when(F.count("q").over(after) == AHEAD, F.sqrt(F.avg("q").over(after) * _ANN))})
    names = ["rv_1h_ann", "rv_1d_ann", "rv_1w_ann"]
    past = s.by().rowsBetween(-HOURS, 0)
    d = s.add({x: F.coalesce(F.last(x, ignorenulls=True).over(past), F.lit(0.0)) for x in names}).result("symbol", "bar", *names, "y")
    cut = d.groupBy("symbol").agg((F.min("bar") + F.floor((F.max("bar") - F.min("bar")) * SPLIT)).alias("cut"))
    d = d.join(cut, "symbol").where("y IS NOT NULL")
    return M.ridge_fits(d.where("bar < cut"), d.where(F.col("bar") >= F.col("cut") + AHEAD * 3_600_000_000), ["symbol"], names, "y", ALPHA)
