"""Instrument, announcement and news queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import div, row_hash
from tidemark.operators import lifecycle as V
from tidemark.operators import text as T
from tidemark.operators.blocks import latest, sequence
from tidemark.operators.crosssection import exact_quantiles
from tidemark.plans.registry import query
from tidemark.plans.tables import DAY_US, PANEL, TICKS, panel, read, ticks

_SNAP = """a AS (SELECT p_partkey AS k, p_brand AS brand, p_size AS size, p_type AS kind FROM part WHERE p_partkey % 10 <> 3),
b AS (SELECT p_partkey AS k, p_brand AS brand, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS kind FROM part WHERE p_partkey % 10 <> 5)"""


@query("snapshot_diff", "L1 L3", f"""WITH {_SNAP}, j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS ak, b.k AS bk, a.brand AS ab, b.brand AS bb, a.size AS az, b.size AS bz, a.kind AS kold, b.kind AS knew FROM a FULL JOIN b ON a.k = b.k)
SELECT k, 'added' AS change, '' AS field, NULL AS old, NULL AS new FROM j WHERE ak IS NULL UNION ALL SELECT k, 'removed', '', NULL, NULL FROM j WHERE bk IS NULL
UNION ALL SELECT k, 'changed', 'size', CAST(az AS VARCHAR), CAST(bz AS VARCHAR) FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND az IS DISTINCT FROM bz UNION ALL SELECT k, 'changed', 'kind', kold, knew FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND kold IS DISTINCT FROM knew""")
def snapshot_diff(spark, folder):
    p = read(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))
    cur = p.where("k % 10 <> 5").withColumns({"size": F.col("size") + (F.col("k") % 7 == 0).cast("int"), "kind": F.when(F.col("k") % 11 != 0, F.col("kind"))})
    return V.snapshot_diff(p.where("k % 10 <> 3"), cur, "k", ["brand", "size", "kind"])


@query("lifecycle_fold", "L2", f"""WITH {TICKS}, c AS (SELECT user_id, kind, ts_us, kind <> lag(kind) OVER w AS moved FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id))
SELECT user_id, min(ts_us) AS first_seen, max(ts_us) AS last_seen, count(*) FILTER (moved) AS transitions, arg_max(kind, ts_us) AS status, max(ts_us) FILTER (moved) AS last_change FROM c GROUP BY 1""")
def lifecycle_fold(spark, folder):
    s = sequence(ticks(spark, folder), ["user_id"], ["ts_us", "event_id"], back=1)
    d = s.add({"moved": F.col("kind") != F.lag("kind").over(s.by())}).result()
    return d.groupBy("user_id").agg(F.min("ts_us").alias("first_seen"), F.max("ts_us").alias("last_seen"), F.count(F.when(F.col("moved"), 1)).alias("transitions"),
                                    F.max_by("kind", F.struct("ts_us", "event_id")).alias("status"), F.max(F.when(F.col("moved"), F.col("ts_us"))).alias("last_change"))


_MASTER = f"""{TICKS}, s AS (SELECT user_id, min(ts_us) FILTER (kind = 'view') AS a, min(ts_us) FILTER (kind = 'click') AS b, min(ts_us) FILTER (kind = 'error') AS c, max(ts_us) FILTER (kind = 'view') AS x, max(ts_us) FILTER (kind = 'click') AS y FROM ticks GROUP BY 1)"""


@query("instrument_master", "L4 L5 L6", f"""WITH {_MASTER} SELECT user_id, least(a, b, c) AS start_us, CASE least(a, b, c) WHEN a THEN 'kline' WHEN b THEN 'funding' ELSE 'oi' END AS source, greatest(a, b, c) - least(a, b, c) > {DAY_US} AS conflict,
 greatest(x, y) AS last_proven, CASE WHEN user_id % 9 = 0 THEN greatest(x, y) END AS delisted_us FROM s""")
def instrument_master(spark, folder):
    t = ticks(spark, folder)
    at = lambda agg, k: agg(F.when(F.col("kind") == k, F.col("ts_us")))
    d = t.groupBy("user_id").agg(at(F.min, "view").alias("a"), at(F.min, "click").alias("b"), at(F.min, "error").alias("c"), at(F.max, "view").alias("x"), at(F.max, "click").alias("y"))
    listed = t.select("user_id").distinct().where("user_id % 9 <> 0").withColumn("_on", F.lit(True))
    start, tag, conflict = V.reconcile_start({"kline": F.col("a"), "funding": F.col("b"), "oi": F.col("c")}, DAY_US)
    last = F.greatest("x", "y")
    d = d.join(listed, "user_id", "left")
    return d.select("user_id", start.alias("start_us"), tag.alias("source"), conflict.alias("conflict"), last.alias("last_proven"), F.when(F.col("_on").isNull(), last).alias("delisted_us"))


@query("source_floor", "L7", f"""WITH {PANEL}, f AS (SELECT symbol, min(day) AS d FROM panel GROUP BY 1), n AS (SELECT d, count(*) AS n FROM f GROUP BY 1) SELECT max_by(d, (n, -d)) AS floor_day, max(n) AS shared, max(n) >= 3 AS is_floor FROM n""")
def source_floor(spark, folder):
    n = panel(spark, folder).groupBy("symbol").agg(F.min("day").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max_by("d", F.struct(F.col("n"), -F.col("d"))).alias("floor_day"), F.max("n").alias("shared"), (F.max("n") >= 3).alias("is_floor"))


@query("universe_filter", "L10", "SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0 AND regexp_matches(s_name, '[02468]$') AND s_nationkey < 20")
def universe_filter(spark, folder):
    s = read(spark, folder, "supplier")
    return s.where((F.col("s_acctbal") > 0) & F.col("s_name").rlike("[02468]$") & (F.col("s_nationkey") < 20)).select(F.col("s_suppkey").alias("k"))


_PREC = f"""l AS (SELECT '1000' || c_mktsegment || (c_custkey % 300) AS asset, c_mktsegment || (c_custkey % 300) AS base, min(915148800000000 + c_custkey * {DAY_US}) AS launch FROM customer GROUP BY 1, 2),
i AS (SELECT CASE o_custkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'HOUSEHOLD' WHEN 3 THEN 'MACHINERY' ELSE 'FURNITURE' END || (o_custkey % 311) AS base, CASE WHEN o_orderkey % 6 > 0 THEN epoch_us(o_orderdate) END AS listed, o_orderpriority AS venue FROM orders),
v AS (SELECT base, venue, min(listed) AS f, count(*) AS n, count(*) FILTER (listed IS NULL) AS u FROM i GROUP BY 1, 2), p AS (SELECT base, arg_min(venue, (f, venue)) FILTER (f IS NOT NULL) AS fv, min(f) AS f, sum(n) AS n, sum(u) AS u FROM v GROUP BY 1),
d AS (SELECT l.asset, l.base, CASE WHEN f < launch THEN 'OTHER_VENUE_FIRST' WHEN u > 0 THEN 'UNKNOWN_PRECEDENCE' WHEN n > 0 THEN 'HOME_FIRST' ELSE 'NO_OTHER_VENUE' END AS classification, CASE WHEN f < launch THEN fv END AS first_venue, CASE WHEN f < launch THEN round((launch - f) / 86400e6, 2) END AS lead_days, CAST(coalesce(n, 0) AS BIGINT) AS n_instruments
 FROM l LEFT JOIN p ON p.base = l.base)"""


def precedence_table(spark, folder):
    cu = read(spark, folder, "customer").select(F.concat(F.lit("1000"), "c_mktsegment", (F.col("c_custkey") % 300).cast("string")).alias("asset"), (915_148_800_000_000 + F.col("c_custkey") * DAY_US).alias("launch"))
    cu = cu.groupBy("asset").agg(F.min("launch").alias("launch"))
    seg = F.element_at(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY", "FURNITURE")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    o = read(spark, folder, "orders").select(F.concat(seg, (F.col("o_custkey") % 311).cast("string")).alias("b"), F.when(F.col("o_orderkey") % 6 > 0, F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("listed"), F.col("o_orderpriority").alias("venue"))
    return V.precedence(cu, o, "asset", "launch", "b", "listed", "venue")


@query("venue_precedence", "L11", f"WITH {_PREC} SELECT *, CASE classification WHEN 'UNKNOWN_PRECEDENCE' THEN 'low' ELSE 'high' END AS confidence FROM d", "lead_days", digits=2)
def venue_precedence(spark, folder):
    return precedence_table(spark, folder)


@query("precedence_summary", "L12 L15 L16", f"""WITH {_PREC}, r AS (SELECT classification, lead_days, CASE WHEN lead_days IS NULL THEN 'unknown' WHEN lead_days < 1 THEN '<1d' WHEN lead_days < 7 THEN '1-7d' WHEN lead_days < 30 THEN '7-30d' WHEN lead_days < 180 THEN '30-180d' ELSE '>=180d' END AS bucket FROM d),
h AS (SELECT classification, list_sort(list(lead_days) FILTER (lead_days IS NOT NULL)) AS l FROM r GROUP BY 1) SELECT r.classification, bucket, count(*) AS n, max(h.l[len(h.l) // 2 + 1]) AS upper_median FROM r JOIN h ON h.classification = r.classification GROUP BY 1, 2""", "upper_median", digits=2)
def precedence_summary(spark, folder):
    d = precedence_table(spark, folder).withColumn("bucket", V.lead_bucket(F.col("lead_days")))
    # The upper median is the value at place n // 2 (from 0): ranks over the group, no gathered list.
    from tidemark.operators.crosssection import distinct_ranks
    r = distinct_ranks(d, ["classification"], "lead_days")
    k = F.floor(F.col("total") / 2)
    med = r.where((F.col("below") <= k) & (k < F.col("below") + F.col("n"))).select("classification", F.col("lead_days").alias("upper_median"))
    return d.groupBy("classification", "bucket").agg(F.count(F.lit(1)).alias("n")).join(med, "classification", "left")


@query("launch_coverage", "L13 L14 L17 L18", """SELECT c.c_custkey AS k, array_to_string(list_filter([CASE WHEN n.n_nationkey IS NULL OR n.n_regionkey > 3 THEN 'region' END, CASE WHEN o.n IS NULL OR o.n < 5 THEN 'trades' END, CASE WHEN c.c_acctbal <= 0 THEN 'volume' END], lambda q: q IS NOT NULL), ',') AS missing,
 (CASE WHEN n.n_regionkey <= 3 THEN 1 ELSE 0 END + CASE WHEN o.n >= 5 THEN 1 ELSE 0 END + CASE WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END) / 3.0 AS score FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""", "score")
def launch_coverage(spark, folder):
    cu, na = read(spark, folder, "customer"), read(spark, folder, "nation")
    o = read(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    d = cu.join(na, cu.c_nationkey == na.n_nationkey, "left").join(o, cu.c_custkey == o.o_custkey, "left")
    need = {"region": F.col("n_regionkey") <= 3, "trades": F.col("n") >= 5, "volume": F.col("c_acctbal") > 0}
    miss = V.missing_reasons(**need)
    return d.select(F.col("c_custkey").alias("k"), F.concat_ws(",", miss).alias("missing"), ((3 - F.size(miss)) / 3.0).alias("score"))


_TITLE = """tt AS (SELECT p_partkey AS k, upper(string_split(p_name, ' ')[2]) AS w, lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS d, CAST(p_size % 24 AS VARCHAR) AS h, p_partkey % 5 AS m, p_size AS z FROM part),
t AS (SELECT k, CASE m WHEN 0 THEN 'Exchange Will Launch ' || w || 'USDT Perpetual Contract 2024-01-' || d || ' ' || h || ':30 (UTC)' WHEN 1 THEN 'Exchange Will List Token (' || w || ') on 2024-02-' || d WHEN 2 THEN 'Notice of Removal of ' || w || '/BTC, ' || w || 'USDC'
 WHEN 3 THEN 'Margin Will List ' || w || '/USDT' ELSE 'Suspension of ' || w || ' deposits 2024-13-' || d END AS title FROM tt)"""


def titles(spark, folder):
    p = read(spark, folder, "part")
    w, d, h = F.upper(F.split("p_name", " ")[1]), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), (F.col("p_size") % 24).cast("string")
    m = F.col("p_partkey") % 5
    t = (F.when(m == 0, F.concat(F.lit("Exchange Will Launch "), w, F.lit("USDT Perpetual Contract 2024-01-"), d, F.lit(" "), h, F.lit(":30 (UTC)")))
         .when(m == 1, F.concat(F.lit("Exchange Will List Token ("), w, F.lit(") on 2024-02-"), d)).when(m == 2, F.concat(F.lit("Notice of Removal of "), w, F.lit("/BTC, "), w, F.lit("USDC")))
         .when(m == 3, F.concat(F.lit("Margin Will List "), w, F.lit("/USDT"))).otherwise(F.concat(F.lit("Suspension of "), w, F.lit(" deposits 2024-13-"), d)))
    return p.select(F.col("p_partkey").alias("k"), t.alias("title"), F.lit("exchange").alias("source"), F.lit("").alias("hint"))


@query("announcement_classify", "L19", f"""WITH {_TITLE} SELECT t.k, CASE m WHEN 0 THEN w || 'USDT' WHEN 1 THEN '' WHEN 2 THEN w || 'BTC,' || w || 'USDC' WHEN 3 THEN w || 'USDT' ELSE '' END AS symbols, CASE m WHEN 4 THEN '' WHEN 0 THEN w || ',UTC' ELSE w END AS assets,
 CASE m WHEN 0 THEN 'perp' WHEN 3 THEN 'margin' ELSE 'spot' END AS market, CASE m WHEN 0 THEN 'futures_listing' WHEN 1 THEN 'listing' WHEN 2 THEN 'delisting' WHEN 3 THEN 'listing' ELSE 'suspension' END AS event_kind FROM t JOIN tt ON tt.k = t.k""")
def announcement_classify(spark, folder):
    d = T.classify_title(titles(spark, folder), "title", "source", "hint")
    return d.select("k", F.concat_ws(",", "symbols").alias("symbols"), F.concat_ws(",", "assets").alias("assets"), "market", "event_kind")


@query("announcement_start", "L20", f"WITH {_TITLE} SELECT t.k, CASE m WHEN 0 THEN epoch_us(CAST('2024-01-' || d || ' ' || lpad(h, 2, '0') || ':30:00' AS TIMESTAMP)) WHEN 1 THEN epoch_us(CAST('2024-02-' || d || ' 00:00:00' AS TIMESTAMP)) END AS start_us FROM t JOIN tt ON tt.k = t.k")
def announcement_start(spark, folder):
    return titles(spark, folder).select("k", F.unix_micros(T.trading_start("title")).alias("start_us"))


@query("announcement_times", "L21", f"WITH {_TITLE} SELECT t.k, CASE m WHEN 0 THEN epoch_us(CAST('2024-01-' || d || ' ' || lpad(h, 2, '0') || ':30:00' AS TIMESTAMP)) WHEN 1 THEN epoch_us(CAST('2024-02-' || d || ' 00:00:00' AS TIMESTAMP)) END AS start_us FROM t JOIN tt ON tt.k = t.k")
def announcement_times(spark, folder):
    d = titles(spark, folder).select("k", T.announcement_times("title").alias("t"))
    return d.select("k", F.unix_micros("t.trading_start").alias("start_us"))


@query("html_to_text", "L22 L23", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '(?i)</(p|div|li|tr|h[1-6]|section|table)>|<br\s*/?>', chr(10), 'g'), '(?i)</t[dh]>', chr(9), 'g'), '<[^>]+>', ' ', 'g') AS x FROM a),
e AS (SELECT page_id, replace(replace(replace(replace(x, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;', '&') AS x FROM b),
n AS (SELECT page_id, regexp_replace(regexp_replace(x, '[ \t' || chr(160) || ']+', ' ', 'g'), '(?m)^ +| +$', '', 'g') AS x FROM e)
SELECT page_id, md5(regexp_replace(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM n""")
def html_to_text(spark, folder):
    return read(spark, folder, "pages").select("page_id", F.md5(T.article_text("html")).alias("digest"))


@query("tree_to_text", "L24")
def tree_to_text(spark, folder):
    # Each page's words as a node tree, then back to text.
    words = F.split(F.regexp_replace("html", "<[^>]+>", " "), r"\s+")
    tree = F.to_json(F.array(F.struct(F.lit("p").alias("tag"), F.transform(words, lambda w: F.struct(F.lit("text").alias("node"), w.alias("text"))).alias("child"))))
    d = read(spark, folder, "pages").select("page_id", tree.alias("body"))
    return d.select("page_id", F.length(T.tree_text("body")).cast("bigint").alias("n_chars"))


_KW = {"AAA": ["the", "ther"], "BBB": ["und"], "CCC": ["de la", "les"], "DDD": ["that"]}


@query("entity_tags", "L25", """WITH l AS (SELECT doc_id, ' ' || lower(text) || ' ' AS x FROM documents) SELECT doc_id, array_to_string(list_distinct(list_filter([CASE WHEN regexp_matches(x, '[^a-z0-9]the[^a-z0-9]') OR regexp_matches(x, '[^a-z0-9]ther[^a-z0-9]') THEN 'AAA' END], lambda q: q IS NOT NULL)), ',') AS tag_a,
 regexp_matches(x, '[^a-z0-9]und[^a-z0-9]') AS tag_b, regexp_matches(x, '[^a-z0-9]de la[^a-z0-9]') OR regexp_matches(x, '[^a-z0-9]les[^a-z0-9]') AS tag_c FROM l""")
def entity_tags(spark, folder):
    d = read(spark, folder, "documents").select("doc_id", T.tag_names("text", _KW).alias("tags"))
    has = lambda k: F.array_contains("tags", k)
    return d.select("doc_id", F.when(has("AAA"), "AAA").otherwise("").alias("tag_a"), has("BBB").alias("tag_b"), has("CCC").alias("tag_c"))


_POS, _NEG, _NOT = {"the": 1, "thing": 2, "ander": 3}, {"of": 1, "innin": 2, "ening": 2}, ["no", "and"]


@query("lexicon_sentiment", "L26", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9.\\-]+') AS k FROM documents),
w AS (SELECT doc_id, k, list_transform(k, lambda q: CASE WHEN q = 'the' THEN 1.0 WHEN q = 'of' THEN -1.0 WHEN starts_with(q, 'thing') THEN 2.0 WHEN starts_with(q, 'ander') THEN 3.0 WHEN starts_with(q, 'innin') OR starts_with(q, 'ening') THEN -2.0 ELSE 0 END) AS v FROM t),
s AS (SELECT doc_id, len(k) AS n, coalesce(list_sum(list_transform(v, lambda q, i: CASE WHEN q <> 0 AND list_has_any(k[greatest(i - 3, 1):i - 1], ['no', 'and']) THEN -0.7 * q ELSE q END)), 0) AS z FROM w)
SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(-1, least(1, z / sqrt(n))) END AS score FROM s""", "score")
def lexicon_sentiment(spark, folder):
    d = read(spark, folder, "documents").select("doc_id", "text")
    return T.sentiment(d, "text", "score", _POS, _NEG, _NOT).select("doc_id", "score")


@query("news_sentiment", "L25 L26 D14")
def news_sentiment(spark, folder):
    d = read(spark, folder, "documents").select("doc_id", "text", "source")
    d = T.sentiment(d, "text", "score").withColumn("tags", T.tag_names("text"))
    return d.select("source", "score", F.explode_outer("tags").alias("symbol")).groupBy("source", "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query("news_dedupe", "L27 A25", "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT h AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM h GROUP BY 1")
def news_dedupe(spark, folder):
    # Copies combine before the shuffle: a third of all rows may be one text.
    d = read(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("record_dedupe", "L28", """WITH f AS (SELECT sha256(text) AS h, lang, source, n_chars // 1000 AS bucket, doc_id FROM documents), a AS (SELECT h, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, arg_min(bucket, doc_id) AS bucket, min(doc_id) AS doc_id FROM f GROUP BY 1), k AS (SELECT lang, source, bucket, min(doc_id) AS doc_id FROM a GROUP BY 1, 2, 3)
SELECT f.doc_id, CASE WHEN k.doc_id IS NOT NULL THEN 'kept' WHEN a.doc_id IS NULL THEN 'same_hash' ELSE 'same_key' END AS reason FROM f LEFT JOIN a ON a.doc_id = f.doc_id LEFT JOIN k ON k.doc_id = f.doc_id""")
def record_dedupe(spark, folder):
    f = read(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "lang", "source", F.floor(F.col("n_chars") / 1000).alias("bucket"))
    a = latest(f, ["h"], ["doc_id"], first=True)
    k = latest(a, ["lang", "source", "bucket"], ["doc_id"], first=True).select("doc_id", F.lit(True).alias("_k"))
    d = f.select("doc_id").join(a.select("doc_id", F.lit(True).alias("_a")), "doc_id", "left").join(k, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("_k"), "kept").when(F.col("_a").isNull(), "same_hash").otherwise("same_key").alias("reason"))
