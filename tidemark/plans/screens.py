"""Decisions by crowd positioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import portfolio as P
from tidemark.operators import rolling as R
from tidemark.operators.blocks import DAYS, sequence
from tidemark.plans.registry import query
from tidemark.plans.tables import PANEL, panel
from tidemark.plans.windows import _PW

_SY = "(PARTITION BY symbol ORDER BY day)"
TOP, EVERY, LEAST, BASKET = 12, 3, 10, 4


@query("crowd_decisions", "J24", f"""WITH {PANEL}, l AS (SELECT *, CASE WHEN count(qv) OVER w = 20 THEN median(qv) OVER w END AS adv FROM panel WINDOW w AS {_PW(19)}), m AS (SELECT day, symbol, (close - open) / open * 10000 AS ret_bps, lag(ratio) OVER {_SY} AS crowd, lag(adv) OVER {_SY} AS liq FROM l),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY liq DESC, symbol) AS rl FROM m WHERE liq IS NOT NULL) WHERE rl <= {TOP} AND crowd IS NOT NULL), d AS (SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM s)) WHERE i % {EVERY} = 0),
r AS (SELECT s.*, count(*) OVER (PARTITION BY s.day) AS n, row_number() OVER (PARTITION BY s.day ORDER BY crowd, symbol) AS up, row_number() OVER (PARTITION BY s.day ORDER BY crowd DESC, symbol) AS dn FROM s JOIN d ON d.day = s.day)
SELECT day, symbol, crowd, CASE WHEN up <= {BASKET} THEN 1 ELSE -1 END AS side, CASE WHEN up <= {BASKET} THEN ret_bps ELSE -ret_bps END AS gross_bps FROM r WHERE n >= {LEAST} AND (up <= {BASKET} OR dn <= {BASKET})""", "crowd gross_bps", digits=4)
def crowd_decisions(spark, folder):
    """Long the names the crowd holds least, short those it holds most, open to close; screen and ratio are of the day before."""
    s = sequence(panel(spark, folder), ["symbol"], ["day"], back=22, bound=DAYS)
    s = s.add({"adv": R.quantile(s, "qv", 20, 0.5)})
    d = s.add({"liq": R.lag(s, "adv"), "crowd": R.lag(s, "ratio")}).result("day", "symbol", "liq", "crowd", ((F.col("close") - F.col("open")) / F.col("open") * 1e4).alias("ret_bps"))
    return P.crowd_decisions(d, at="day", name="symbol", crowd="crowd", liquidity="liq", ret_bps="ret_bps", top=TOP, every=EVERY, least=LEAST, basket=BASKET)
