"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import numeric, periods, text
from rankloom.operators import aggregates, joins, ranking, windows
from rankloom.plans.registry import ORACLES, QUERIES, query, t  # noqa: F401
from rankloom.sources.shared import kept_table


def yearly_customers(spark: SparkSession, d: str) -> DataFrame:
    """nation, cust, year, revenue, rank: each customer's place in its nation's year by order value."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    sums = o.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    rows = sums.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"), "year", "revenue")
    return windows.row_numbers(kept_table(rows, "yearly"), ["nation", "year"], [*windows.falling("revenue"), "cust"], "rank").withColumn("rank", F.col("rank").cast("int"))


YEARLY = """y AS (SELECT c_nationkey AS nation, c_custkey AS cust, year, revenue,
    row_number() OVER (PARTITION BY c_nationkey, year ORDER BY revenue DESC, c_custkey) AS rank
  FROM (SELECT o_custkey, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2) JOIN customer ON o_custkey = c_custkey)"""


def supplier_stats(spark: SparkSession, d: str) -> DataFrame:
    line = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n_lines"))
    s = t(spark, d, "supplier")
    return s.join(line, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supp"), F.col("s_acctbal").alias("acctbal"), "revenue", "quantity", "n_lines")


SUPP = """s AS (SELECT s_nationkey AS nation, s_suppkey AS supp, s_acctbal AS acctbal, revenue, quantity, n_lines FROM supplier LEFT JOIN
  (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue, sum(l_quantity) AS quantity, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""


def pct(v: str, part: str) -> str:
    return f"""CASE WHEN {v} IS NOT NULL THEN (count({v}) OVER (PARTITION BY {part} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 0.5 * count({v}) OVER (PARTITION BY {part}, {v})) / count({v}) OVER (PARTITION BY {part}) END"""


WEIGHTS = {"revenue_pct": 2.0, "quantity_pct": 1.0, "lines_pct": 0.3}


@query(f"""WITH {SUPP}, p AS (SELECT nation, supp, {pct("revenue", "nation")} AS revenue_pct, {pct("quantity", "nation")} AS quantity_pct, {pct("n_lines", "nation")} AS lines_pct FROM s),
  r AS (SELECT *, 2.0 * coalesce(revenue_pct, 0) + coalesce(quantity_pct, 0) + 0.3 * coalesce(lines_pct, 0) AS sc FROM p)
  SELECT nation, supp, round(sc, 6) AS score, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY round(sc, 6) DESC, supp) AS place FROM r) WHERE place <= 3""")
def flagship_ranking(spark, d):
    s = supplier_stats(spark, d)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(v).cast("double").alias("v")) for v, n in (("revenue", "revenue_pct"), ("quantity", "quantity_pct"), ("n_lines", "lines_pct")))))
    long = s.select("nation", "supp", each.alias("f")).select("nation", "supp", "f.*")
    ranked = windows.midrank_by_ranges(long, ["nation", "feature"], "v", "pct")
    wide = ranked.groupBy("nation", "supp").pivot("feature", list(WEIGHTS)).agg(F.first("pct"))
    scored = wide.select("nation", "supp", F.round(ranking.weighted_score(wide, WEIGHTS), 6).alias("score"))
    return windows.top_k(scored, ["nation"], "score", ["supp"], 3).select("nation", "supp", "score", F.col("predicted_rank").cast("long").alias("place"))


@query(f"""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS year, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)
  SELECT o_orderkey, year, round({pct("v", "year")}, 6) AS pct FROM o""")
def midrank_percentile(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    ranked = windows.midrank_by_ranges(o, ["year"], "v", "pct")
    return ranked.select("o_orderkey", F.col("year").cast("long").alias("year"), F.round("pct", 6).alias("pct"))


EVENT_ORDER = ("purchase", "cart", "click", "view")


@query("""SELECT user_id, day, event_type, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'cart' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END NULLS LAST, event_id) AS n FROM events) WHERE n = 1""")
def dedupe_priority(spark, d):
    e = t(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id")
    return windows.first_by_priority(e, ["user_id", "day"], windows.priority_of(F.col("event_type"), EVENT_ORDER), ["event_id"])


@query(f"""WITH {YEARLY} SELECT a.nation, a.cust, a.year, count(CASE WHEN b.rank = 1 THEN 1 END) AS prior_wins, count(CASE WHEN b.rank <= 5 THEN 1 END) AS years_in_top_5,
  count(DISTINCT b.year) AS prior_years, count(b.year) = 0 AS first_time, count(CASE WHEN b.rank = 1 THEN 1 END) > 0 AS previous_winner, coalesce(a.year - max(CASE WHEN b.rank = 1 THEN b.year END), 999) AS years_since_win
  FROM y a LEFT JOIN y b ON a.nation = b.nation AND a.cust = b.cust AND b.year < a.year GROUP BY 1, 2, 3""")
def strict_lag_history(spark, d):
    y, key = yearly_customers(spark, d), ["nation", "cust"]
    won = F.col("rank") == 1
    return y.select(
        "nation", "cust", F.col("year").cast("long").alias("year"), windows.prior_count(won, key, "year").alias("prior_wins"), windows.prior_count(F.col("rank") <= 5, key, "year").alias("years_in_top_5"), windows.prior_times(key, "year").alias("prior_years"),
        (windows.prior_times(key, "year") == 0).alias("first_time"), windows.prior_any(won, key, "year").alias("previous_winner"), windows.years_since(won, key, "year").cast("long").alias("years_since_win"),
    )


@query(f"""WITH {YEARLY}, n AS (SELECT DISTINCT nation, first FROM (SELECT nation, cust, min(year) AS first FROM y WHERE rank = 1 GROUP BY 1, 2))
  SELECT DISTINCT y.nation, y.year, y.year - coalesce((SELECT max(first) FROM n WHERE n.nation = y.nation AND first < y.year), 1956) AS years_since_new_winner FROM y""")
def years_since_new_winner(spark, d):
    y = windows.years_since_new_winner(yearly_customers(spark, d), "cust", "year", F.col("rank") == 1, part=["nation"])
    return y.select("nation", F.col("year").cast("long").alias("year"), F.col("years_since_new_winner").cast("long").alias("years_since_new_winner"))


@query(f"""WITH {YEARLY}, w AS (SELECT nation, year FROM y WHERE rank = 1) SELECT n.nation, n.year, (SELECT count(*) FROM w WHERE w.nation = n.nation AND w.year < n.year) AS nation_prior_winners FROM (SELECT DISTINCT nation, year FROM y) n""")
def group_prior_winners(spark, d):
    return windows.group_prior_count(yearly_customers(spark, d), ["nation"], "year", F.col("rank") == 1, "nation_prior_winners").select("nation", F.col("year").cast("long").alias("year"), "nation_prior_winners")


@query("""WITH o AS (SELECT o_custkey, o_totalprice AS v, o_orderdate AS at, year(o_orderdate) AS y, month(o_orderdate) AS m, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS known FROM orders)
  SELECT o_custkey, award_year, count(*) AS n_rows, round(sum(known), 2) AS known_value, round(sum(v), 2) AS all_value FROM (SELECT *, CASE WHEN m >= 8 THEN y + 1 ELSE y END AS award_year FROM o) GROUP BY 1, 2""")
def eval_period_sum(spark, d):
    y = F.year("o_orderdate")
    o = t(spark, d, "orders").select("o_custkey", F.when(F.month("o_orderdate") >= 8, y + 1).otherwise(y).cast("long").alias("award_year"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("known_value"), F.col("o_totalprice").alias("all_value"))
    s = aggregates.known_sums(o, ["o_custkey", "award_year"], ["known_value", "all_value"])
    return s.select("o_custkey", "award_year", "n_rows", F.round("known_value", 2).alias("known_value"), F.round("all_value", 2).alias("all_value"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b, l_quantity AS q FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE round(coalesce(a, 0) + coalesce(b, 0), 6) END AS both_known, round(q * 90 / (l_linenumber - 1), 6) AS per_90, round(a / b, 6) AS ratio, ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) / 2.0 AS completeness
  FROM (SELECT l_orderkey, l_partkey, a, b, q, l_linenumber FROM x WHERE l_linenumber > 1)
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE round(coalesce(a, 0) + coalesce(b, 0), 6) END, NULL, round(a / b, 6), ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) / 2.0 FROM x WHERE l_linenumber = 1""")
def null_aware_arithmetic(spark, d):
    a, b = F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0))
    x = t(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round(numeric.sum_known(a, b), 6).alias("both_known"), F.round(numeric.per_90(F.col("l_quantity"), F.col("l_linenumber") - 1), 6).alias("per_90"), F.round(numeric.safe_div(a, b), 6).alias("ratio"), numeric.share_known(a, b).alias("completeness"))


TOKENS = ("green", "blue", "red", "steel", "small", "box", "a")


@query("""WITH k AS (SELECT * FROM (VALUES ('green',0),('blue',1),('red',2),('steel',3),('small',4),('box',5),('a',6)) v(token, pos)),
  m AS (SELECT p_partkey, token, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS n FROM part, k WHERE contains(lower(trim(p_name)), token) OR contains(token, lower(trim(p_name))))
  SELECT p_partkey, token FROM m WHERE n = 1""")
def substring_join(spark, d):
    p = t(spark, d, "part").select("p_partkey", joins.first_substring(F.col("p_name"), TOKENS).alias("token"))
    return p.where("token IS NOT NULL")


@query("""SELECT p_partkey, CASE WHEN trim(p_name) = '' THEN 4 WHEN regexp_matches(lower(p_name), 'green|steel') THEN 1 WHEN regexp_matches(lower(p_name), 'blue|box') THEN 2 ELSE 3 END AS tier,
  CASE WHEN p_size < 10 THEN 'poor' WHEN p_size * 2 < 50 THEN 'poor' WHEN p_size * 2 < 70 THEN 'partial' WHEN p_size * 2 < 90 THEN 'good' ELSE 'excellent' END AS grade, greatest(32 - p_size, 1) AS relevance FROM part""")
def tier_lookup(spark, d):
    return t(spark, d, "part").select("p_partkey", numeric.substring_tier(F.col("p_name"), ["green", "steel"], ["blue", "box"]).alias("tier"), numeric.coverage_grade(F.col("p_size") * 2).alias("grade"), numeric.relevance(F.col("p_size")).alias("relevance"))


@query("""SELECT o_orderkey, CASE WHEN y < 1995 THEN 'classical' WHEN y < 2010 THEN 'pre_merger' WHEN y < 2016 THEN 'fifa_merger' ELSE 'post_split' END AS era, CASE WHEN y >= 2022 THEN 'season' ELSE 'calendar_year' END AS kind,
  CASE WHEN y >= 2022 THEN make_date(y - 1, 8, 1) ELSE make_date(y, 1, 1) END AS starts, CASE WHEN y >= 2022 THEN make_date(y, 7, 31) ELSE make_date(y, 12, 31) END AS ends, (y - 1) % 4 = 1 AS cup FROM (SELECT o_orderkey, CAST(year(o_orderdate) + (o_orderkey % 30) AS INT) AS y FROM orders)""")
def era_and_period(spark, d):
    y = (F.year("o_orderdate") + F.col("o_orderkey") % 30).cast("int")
    p = periods.eval_period(F.col("y"))
    o = t(spark, d, "orders").select("o_orderkey", y.alias("y"))
    return o.select("o_orderkey", periods.era(F.col("y")).alias("era"), p["kind"].alias("kind"), p["start"].alias("starts"), p["end"].alias("ends"), ((F.col("y") - 1) % 4 == 1).alias("cup"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'DF' WHEN 'MACHINERY' THEN 'MF' ELSE 'Unknown' END AS position,
  CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 2.0 WHEN 'MACHINERY' THEN 1.5 ELSE 1.0 END AS DOUBLE) AS multiplier FROM customer""")
def position_case(spark, d):
    raw = F.when(F.col("c_mktsegment") == "BUILDING", "Defender/Midfielder").when(F.col("c_mktsegment") == "MACHINERY", "mid").otherwise(F.lit(None))
    c = t(spark, d, "customer").select("c_custkey", numeric.position(raw).alias("position"))
    return c.withColumn("multiplier", numeric.lookup(F.col("position"), numeric.POSITION_MULTIPLIER))


@query(f"""WITH {SUPP}, r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY revenue DESC NULLS LAST, supp) AS n FROM s)
  SELECT a.nation, a.supp AS first, b.supp AS second, 1 AS label, round(a.acctbal - b.acctbal, 4) AS acctbal, round(a.quantity - b.quantity, 4) AS quantity FROM r a JOIN r b ON a.nation = b.nation AND a.n < b.n
  UNION ALL SELECT a.nation, b.supp, a.supp, 0, round(b.acctbal - a.acctbal, 4), round(b.quantity - a.quantity, 4) FROM r a JOIN r b ON a.nation = b.nation AND a.n < b.n""")
def pairwise_diff(spark, d):
    p = joins.pairwise(supplier_stats(spark, d), ["nation"], [F.desc_nulls_last("revenue"), "supp"], "supp", ["acctbal", "quantity"])
    return p.select("nation", "first", "second", "label", F.round("acctbal", 4).alias("acctbal"), F.round("quantity", 4).alias("quantity"))


def ranked_customers(spark, d):
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"), F.floor(F.col("c_acctbal") / 700).alias("score"), (F.floor(F.col("c_acctbal") + 2000) % 101).alias("points"))
    ranks = windows.value_counts_by_ranges(c, ["nation"], "points").select("nation", "points", (F.col("_less") + F.col("_equal") - F.col("_all") - 1).alias("r"))
    return c.join(ranks, ["nation", "points"]).select("nation", "cust", "score", "r")


RANKED = """c AS (SELECT c_nationkey AS nation, c_custkey AS cust, floor(c_acctbal / 700) AS score, -CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY CAST(floor(c_acctbal + 2000) AS BIGINT) % 101 DESC) AS BIGINT) AS r FROM customer)"""


@query(f"""WITH {RANKED}, a AS (SELECT nation, rank() OVER (PARTITION BY nation ORDER BY score) + (count(*) OVER (PARTITION BY nation, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY nation ORDER BY r) + (count(*) OVER (PARTITION BY nation, r) - 1) / 2.0 AS y FROM c)
  SELECT nation, round(corr(x, y), 6) AS spearman FROM a GROUP BY 1""")
def spearman_per_pool(spark, d):
    return windows.spearman(ranked_customers(spark, d), ["nation"], "score", "r").select("nation", F.round("spearman", 6).alias("spearman"))


@query(f"""WITH {RANKED}, p AS (SELECT a.nation, sign(a.score - b.score) AS u, sign(a.r - b.r) AS v FROM c a JOIN c b ON a.nation = b.nation AND a.cust < b.cust)
  SELECT nation, round(sum(u * v) / sqrt(sum(abs(u)) * sum(abs(v))), 6) AS kendall FROM p GROUP BY 1""")
def kendall_per_pool(spark, d):
    return windows.kendall(ranked_customers(spark, d), ["nation"], "score", "r").select("nation", F.round("kendall", 6).alias("kendall"))


@query(f"""WITH {RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, cust) AS place FROM c), w AS (SELECT nation, min(place) AS winner_at FROM o WHERE r = -1 GROUP BY 1)
  SELECT nation, winner_at, winner_at <= 1 AS top1, winner_at <= 3 AS top3, winner_at <= 5 AS top5 FROM w""")
def topk_hit(spark, d):
    w = windows.best_place(ranked_customers(spark, d), ["nation"], "score", ["cust"], F.col("r") == -1)
    return w.select("nation", "winner_at", *((F.col("winner_at") <= k).alias(f"top{k}") for k in (1, 3, 5)))


@query(f"""WITH {SUPP}, c AS (SELECT supp, unnest([{{'f': 'acctbal', 'v': 0.5 * coalesce(acctbal, 0) / 1000}}, {{'f': 'quantity', 'v': -1.25 * coalesce(quantity, 0) / 100}}, {{'f': 'n_lines', 'v': 2.0 * coalesce(n_lines, 0) / 10}}]) AS x FROM s)
  SELECT supp, feature, round(v, 6) AS contribution, CAST(place AS BIGINT) AS place FROM (SELECT supp, x.f AS feature, x.v AS v, row_number() OVER (PARTITION BY supp ORDER BY abs(x.v) DESC, x.f) AS place FROM c) WHERE place <= 2""")
def top_contributions(spark, d):
    m = ranking.LinearRanker(("acctbal", "quantity", "n_lines"), (0.5, -1.25, 2.0), (1000.0, 100.0, 10.0), 0.0, 0)
    s = supplier_stats(spark, d).select("supp", F.posexplode(m.contributions(2)).alias("i", "c"))
    return s.select("supp", F.col("c.feature").alias("feature"), F.round("c.contribution", 6).alias("contribution"), (F.col("i") + 1).cast("long").alias("place"))


@query("""WITH e AS (SELECT event_type, CASE WHEN value > 50 THEN value END AS big, value > 20 AS flag, nullif(user_id % 3, 0) AS third FROM events),
  g AS (SELECT event_type AS grp, count(*) AS n, count(big) AS big, count(CASE WHEN flag THEN 1 END) AS flag, count(third) AS third FROM e GROUP BY ROLLUP (event_type))
  SELECT 'big' AS feature, grp, round(100.0 * big / n, 4) AS percent FROM g UNION ALL SELECT 'flag', grp, round(100.0 * flag / n, 4) FROM g UNION ALL SELECT 'third', grp, round(100.0 * third / n, 4) FROM g""")
def coverage_matrix(spark, d):
    e = t(spark, d, "events").select("event_type", F.when(F.col("value") > 50, F.col("value")).alias("big"), (F.col("value") > 20).alias("flag"), F.nullif(F.col("user_id") % 3, F.lit(0).cast("long")).alias("third"))
    return aggregates.coverage(e, "event_type", ["big", "flag", "third"])


@query(f"""WITH {YEARLY}, g AS (SELECT nation, year, list_distinct(list(rank // 2 + 1)) AS seen, max(rank // 2 + 3) AS m, count(*) AS n FROM y GROUP BY 1, 2)
  SELECT nation, year, n, m AS max_rank, CAST(len(list_filter(range(1, m + 1), lambda x: NOT list_contains(seen, x))) AS BIGINT) AS n_missing FROM g""")
def qa_rank_gaps(spark, d):
    # the ranks 2, 2, 3, 3, ... and the one after next of the last: gaps before and behind
    y = yearly_customers(spark, d)
    r = y.select("nation", "year", (F.floor(F.col("rank") / 2) + 1).alias("r"))
    top = y.groupBy("nation", "year").agg((F.floor(F.max("rank") / 2) + 3).alias("r"))
    gaps = aggregates.rank_gaps(r.unionByName(top), ["nation", "year"], "r")
    return gaps.select("nation", F.col("year").cast("long").alias("year"), (F.col("n") - 1).alias("n"), "max_rank", (F.col("n_missing") + 1).alias("n_missing"))  # the last is missing as well


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice AS v, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx FROM orders)
  SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM o WHERE nx > v) WHERE n = 1""")
def qa_monotone(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.first_rise(o, ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey")


@query("""SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def qa_duplicates(spark, d):
    return aggregates.duplicates(t(spark, d, "documents"), ["text"])


@query("""SELECT y, CASE WHEN y IN (SELECT year(o_orderdate) FROM orders) THEN 'extra' ELSE 'missing' END AS side FROM
  (SELECT range AS y FROM range(1990, 2000) WHERE range NOT IN (SELECT year(o_orderdate) FROM orders) UNION SELECT DISTINCT year(o_orderdate) FROM orders WHERE year(o_orderdate) NOT BETWEEN 1990 AND 1999)""")
def year_except(spark, d):
    want, have = spark.range(1990, 2000).select(F.col("id").alias("y")), t(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"))
    return want.subtract(have).withColumn("side", F.lit("missing")).unionByName(have.subtract(want).withColumn("side", F.lit("extra")))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, mine, main, CASE WHEN mine IS NULL THEN 'mine_missing' WHEN main IS NULL THEN 'main_missing' WHEN mine = main THEN 'match' ELSE 'mismatch' END AS verdict
  FROM (SELECT doc_id, quality AS mine FROM labels WHERE toxic = 0) a FULL JOIN (SELECT doc_id, CAST(n_chars > 500 AS INT) AS main FROM documents WHERE lang <> 'de') b USING (doc_id)""")
def full_outer_compare(spark, d):
    a = t(spark, d, "labels").where("toxic = 0").select("doc_id", F.col("quality").alias("v"))
    b = t(spark, d, "documents").where("lang <> 'de'").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("v"))
    return joins.compare_full(a, b, ["doc_id"], "v")


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderkey % 4 AS k FROM orders)
  SELECT o_orderkey, CASE k WHEN 3 THEN NULL ELSE y END AS season_start, CASE k WHEN 0 THEN y + 1 WHEN 1 THEN y + 1 END AS season_end, CASE WHEN k = 3 THEN FALSE WHEN k = 2 THEN TRUE ELSE TRUE END AS in_calendar, k < 2 AS in_season FROM o""")
def season_parse(spark, d):
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, periods.short_season(y)).when(k == 1, F.concat(y, F.lit("–"), y + 1, F.lit("[4]"))).when(k == 2, y.cast("string")).otherwise(F.lit("On loan"))
    s = periods.season_years(F.col("raw"))
    o = t(spark, d, "orders").select("o_orderkey", y.alias("y"), raw.alias("raw"))
    return o.select("o_orderkey", s["start"].cast("long").alias("season_start"), s["end"].cast("long").alias("season_end"), periods.season_in_period(s, F.col("y"), F.lit("calendar_year")).alias("in_calendar"), periods.season_in_period(s, F.col("y") + 1, F.lit("season")).alias("in_season"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders)
  SELECT o_orderkey, CASE WHEN k < 3 THEN CAST(o_orderkey % 50 AS INT) END AS rank, CASE WHEN k < 3 THEN CAST(v AS DOUBLE) + CASE WHEN k = 1 THEN 0.5 ELSE 0 END END AS points, CASE WHEN k IN (0, 1, 2) THEN v END AS whole FROM o""")
def typed_parse(spark, d):
    k, v = F.col("o_orderkey") % 5, F.round("o_totalprice").cast("bigint")
    r = (F.col("o_orderkey") % 50).cast("string")
    rank = F.when(k == 0, F.concat(r, F.lit("th"))).when(k == 1, F.concat(r, F.lit(".0"))).when(k == 2, r).when(k == 3, F.lit("—")).otherwise(F.lit(None))
    points = F.when(k == 0, F.format_number(v, 0)).when(k == 1, F.concat(v, F.lit(".5%"))).when(k == 2, v.cast("string")).when(k == 3, F.lit("-")).otherwise(F.lit("nan"))
    whole = F.when(k == 0, F.concat(v, F.lit("[3]"))).when(k == 1, F.concat(v, F.lit(".0"))).when(k == 2, v.cast("string")).otherwise(F.lit("On loan"))
    return t(spark, d, "orders").select("o_orderkey", text.parse_rank(rank).alias("rank"), text.parse_points(points).alias("points"), text.parse_int(whole).alias("whole"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(text, '''', ''), 'ß', 'ss'))), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM documents""")
def name_normalize(spark, d):
    return t(spark, d, "documents").select("doc_id", text.normalize_name("text").alias("norm"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || ',"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS packed FROM events""")
def json_extract(spark, d):
    e = t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return e.withColumn("packed", F.to_json(F.struct("event_id", "k")))


@query("""SELECT n_name, count(*) AS n, count(DISTINCT c_mktsegment) AS segments, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS in_debt, round(avg(CASE WHEN c_acctbal < 9000 THEN c_acctbal END), 4) AS usual, bool_or(c_acctbal > 9900) AS any_rich FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def conditional_aggregates(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_mktsegment").alias("segments"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.round(F.avg(F.when(F.col("c_acctbal") < 9000, F.col("c_acctbal"))), 4).alias("usual"), F.bool_or(F.col("c_acctbal") > 9900).alias("any_rich"))


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT min(n) AS least, median(n) AS median, max(n) AS most, avg(n) AS mean, count(*) AS groups FROM n""")
def group_sizes(spark, d):
    return aggregates.sizes(t(spark, d, "orders"), ["o_custkey"])


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1""")
def value_counts(spark, d):
    return aggregates.value_counts(t(spark, d, "events"), "event_type")


@query("""SELECT o_orderkey FROM orders WHERE (year(o_orderdate) BETWEEN 1993 AND 1995 OR o_totalprice > 300000 AND o_orderpriority <> '1-URGENT' OR o_orderstatus = 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def review_filter(spark, d):
    o = t(spark, d, "orders").where(F.year("o_orderdate").between(1993, 1995) | ((F.col("o_totalprice") > 300000) & (F.col("o_orderpriority") != "1-URGENT")) | (F.col("o_orderstatus") == "P"))
    done = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    good = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.resume_left(o, done, key=["o_orderkey"]).join(good, "o_custkey", "left_semi").select("o_orderkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def top_n(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("""SELECT s_suppkey, coalesce(o.v, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN (VALUES (1, 5.0), (3, -7.5)) o(k, v) ON k = s_suppkey""")
def what_if_override(spark, d):
    changes = spark.createDataFrame([(1, "s_acctbal", 5.0), (3, "s_acctbal", -7.5)], "s_suppkey long, feature string, value double")
    return joins.override(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), changes, ["s_suppkey"], ["s_acctbal"])


@query("""SELECT c_custkey, coalesce(CAST(n AS BIGINT), 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def join_with_default(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return joins.with_default(t(spark, d, "customer").select("c_custkey"), n, ["c_custkey"], "n_orders", 0)


@query(f"""WITH {YEARLY} SELECT f.fold, count(*) AS train_rows FROM (SELECT DISTINCT year AS fold FROM y) f JOIN y ON y.year < f.fold GROUP BY 1""")
def expanding_folds(spark, d):
    return joins.folds(yearly_customers(spark, d), "year", "expanding").groupBy("fold").agg(F.count(F.lit(1)).alias("train_rows")).select(F.col("fold").cast("long").alias("fold"), "train_rows")


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(' ' || p_name || ' [a] x ', '\s*\[[^\]]*\]\s*', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned, p_name AS team, replace(p_name, ' ', '_') AS slug FROM part""")
def text_clean(spark, d):
    p = t(spark, d, "part")
    return p.select("p_partkey", text.clean_text(F.concat(F.lit("  "), "p_name", F.lit(" [a] x "))).alias("cleaned"), text.clean_team(F.concat("p_name", F.lit(" (15th title)"))).alias("team"), text.slugify("p_name").alias("slug"))


@query("""SELECT y, lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS yy, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') || CASE WHEN y < 1992 THEN ' European Cup' ELSE ' UEFA Champions League' END AS cup,
  y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') || ' La Liga' AS league, 'UEFA Euro ' || y AS euro FROM (SELECT DISTINCT 1955 + o_orderkey % 70 AS y FROM orders)""")
def page_names(spark, d):
    y = t(spark, d, "orders").select((F.col("o_orderkey") % 70 + 1955).alias("y")).distinct()
    return y.select("y", F.substr(periods.short_season(F.col("y")), F.lit(6), F.lit(2)).alias("yy"), periods.page_name("ucl", F.col("y")).alias("cup"), periods.page_name("spain", F.col("y")).alias("league"), periods.page_name("euro", F.col("y")).alias("euro"))


# asked x target with words sorted, then the longest common subsequence row by row: a row's next entry is the largest so far of what stays and what a common letter adds
RATIOS = """w AS (SELECT *, string_split(array_to_string(list_sort(string_split(asked, ' ')), ' '), '') AS x, string_split(array_to_string(list_sort(string_split(target, ' ')), ' '), '') AS y FROM pairs),
  step AS (SELECT asked, target, x, y, 0 AS i, list_transform(y, lambda z: 0) AS r FROM w
    UNION ALL SELECT asked, target, x, y, i + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(e[1:j])) FROM (SELECT *, list_transform(range(1, len(y) + 1), lambda j: greatest(r[j], CASE WHEN y[j] = x[i + 1] THEN 1 + CASE WHEN j > 1 THEN r[j - 1] ELSE 0 END ELSE 0 END)) AS e FROM step WHERE i < len(x))),
  ratio AS (SELECT asked, target, 200.0 * list_max(r) / (len(x) + len(y)) AS score FROM step WHERE i = len(x))"""


@query(f"""WITH RECURSIVE n AS (SELECT DISTINCT p_name FROM part), pairs AS (SELECT a.p_name AS asked, b.p_name AS target FROM n a, n b), {RATIOS},
  best AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, target) AS k FROM ratio WHERE score >= 80)
  SELECT asked AS p_name, target, round(score, 4) AS score FROM best WHERE k = 1""")
def fuzzy_best_match(spark, d):
    names = t(spark, d, "part").select("p_name").distinct()
    asked = names.select("p_name", F.concat(F.reverse(F.split("p_name", " ")).cast("string"), F.lit("")).alias("norm")).select("p_name", F.regexp_replace("norm", r"[\[\],]", "").alias("norm"))
    known = names.select(F.col("p_name").alias("target"), F.col("p_name").alias("_norm"))
    return joins.best_match(asked, known, "norm", "_norm", "p_name", "target", 80.0).select("p_name", "target", F.round("score", 4).alias("score"))


@query(f"""WITH RECURSIVE n AS (SELECT n_name, lower(n_name) AS norm, n_nationkey AS k FROM nation), pairs AS (SELECT a.norm || 's' AS asked, b.norm AS target FROM n a, n b WHERE a.k % 3 = 1), {RATIOS},
  best AS (SELECT asked, n_name, score, row_number() OVER (PARTITION BY asked ORDER BY score DESC, k) AS place FROM ratio JOIN n ON target = norm WHERE score >= 90)
  SELECT n_name AS name, n_name AS target, 'exact' AS method, 100.0::DOUBLE AS score FROM n WHERE k % 3 = 0
  UNION ALL SELECT 'alias of ' || n_name, CASE WHEN k % 2 = 0 THEN n_name END, CASE WHEN k % 2 = 0 THEN 'alias' ELSE 'alias_needs_refetch' END, NULL FROM n WHERE k % 3 = 2
  UNION ALL SELECT n.n_name || 's', best.n_name, CASE WHEN best.n_name IS NULL THEN 'failed' ELSE 'fuzzy' END, best.score FROM n LEFT JOIN best ON asked = norm || 's' AND place = 1 WHERE k % 3 = 1""")
def cascade_resolve(spark, d):
    known = t(spark, d, "nation").select(F.col("n_name").alias("target"), text.normalize_name("n_name").alias("norm"), F.col("n_nationkey").alias("pos"))
    names = t(spark, d, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit("s"))).otherwise(F.concat(F.lit("alias of "), "n_name")).alias("name"))
    aliases = t(spark, d, "nation").select(F.concat(F.lit("alias of "), "n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lit("nobody")).alias("canonical"))
    return joins.cascade(names.withColumn("norm", text.normalize_name("name")), known, aliases)


FEATURES = ["acctbal", "revenue", "quantity", "n_lines"]


def supplier_pools(spark, d):
    s = supplier_stats(spark, d)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc_nulls_last("revenue"), "supp")))


@query()
def logistic_pairwise(spark, d):
    m = ranking.train_linear(supplier_pools(spark, d), "nation", ["rank"], "supp", ["acctbal", "quantity", "n_lines"])
    return spark.createDataFrame([(f, round(c, 5)) for f, c in zip(m.features, m.coefficients)], "feature string, coefficient double")


@query()
def loso_cross_validation(spark, d):
    features = ["acctbal", "quantity", "n_lines"]
    pools = kept_table(supplier_pools(spark, d).select("nation", "supp", "rank", *features), "pools")  # lines are summed up once
    s = ranking.cross_validate(pools, "nation", ["rank"], "supp", "rank", features)
    return ranking.mean_metrics(ranking.yearly_metrics(s, "nation", "supp", "rank", "score"))


@query()
def boosted_ranking(spark, d):
    pools = supplier_pools(spark, d)
    m = ranking.train_listwise(pools, "nation", "rank", "supp", ["acctbal", "quantity", "n_lines"], rounds=50)
    return spark.createDataFrame([(f, round(v, 5)) for f, v in ranking.importance(m, ["acctbal", "quantity", "n_lines"])], "feature string, gain double")


@query(f"""WITH {SUPP}, x AS (SELECT supp, 0.5 * coalesce(acctbal, 0) / 1000 - 1.25 * coalesce(quantity, 0) / 100 + 2.0 * coalesce(n_lines, 0) / 10 AS score FROM s WHERE nation = 3)
  SELECT CAST(count(*) AS VARCHAR) AS total_candidates, CAST((SELECT supp FROM x ORDER BY score DESC, supp LIMIT 1) AS VARCHAR) AS first FROM x""")
def prediction_document(spark, d):
    pools = supplier_pools(spark, d).withColumn("season_id", F.col("nation").cast("string"))
    m = ranking.LinearRanker(("acctbal", "quantity", "n_lines"), (0.5, -1.25, 2.0), (1000.0, 100.0, 10.0), 0.0, 0)
    return ranking.prediction_document(pools, m, "3", "supp").select(F.get_json_object("document", "$.total_candidates").alias("total_candidates"), F.get_json_object("document", "$.rankings[0].player").alias("first"))


from rankloom.plans import more  # noqa: E402, F401  registers its queries
