"""Registered queries of lookups, aggregates, parsing, feature assembly and validation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions import numeric, periods, text
from rankloom.operators import aggregates, joins, ranking, windows
from rankloom.plans import assembly, reports
from rankloom.plans.catalog import SUPP, YEARLY, pct, supplier_stats, yearly_customers
from rankloom.plans.registry import query, t
from rankloom.sources.shared import kept_table


def orders_by_year(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year"), "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("""SELECT n_name, string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey) AS records FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def records_by_key(spark, d):
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    r = aggregates.records_by_key(s, "n_name", ["s_suppkey", "s_name"])
    return r.select("n_name", F.array_join(F.transform("records", lambda x: F.concat_ws(":", x["s_suppkey"], x["s_name"])), ",").alias("records"))


@query("""SELECT item, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS item FROM part) GROUP BY 1""")
def item_frequencies(spark, d):
    return aggregates.frequencies(t(spark, d, "part").select(F.split("p_name", " ").alias("items")), "items")


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(count(*)) OVER () / count(*), 6) AS inverse FROM orders GROUP BY 1""")
def inverse_frequency(spark, d):
    return aggregates.inverse_frequency(t(spark, d, "orders"), "o_orderpriority").withColumn("inverse", F.round("inverse", 6))


@query("""SELECT o_orderpriority, string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS counts FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def nested_counts(spark, d):
    n = aggregates.nested_counts(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return n.select("o_orderpriority", F.array_join(F.transform(F.map_entries("counts"), lambda x: F.concat_ws(":", x["key"], x["value"])), ",").alias("counts"))


@query("""SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines_total, CAST(sum(len(list_filter(string_split(text, ' '), lambda x: x = 'the'))) AS BIGINT) AS the_total,
  count(*) AS lines_rows, count(CASE WHEN len(list_filter(string_split(text, ' '), lambda x: x = 'the')) > 0 THEN 1 END) AS the_rows FROM documents""")
def array_lengths(spark, d):
    docs = t(spark, d, "documents").select(F.split("text", "\n").alias("lines"), F.filter(F.split("text", " "), lambda x: x == "the").alias("the"))
    return aggregates.array_lengths(docs, ["lines", "the"])


@query("""WITH r AS (SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 'page_missing' ELSE 'ok' END AS status, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)
  SELECT c_custkey, coalesce(status, 'no_record') AS stats_status, CASE WHEN status = 'ok' THEN value END AS value, coalesce(status, 'no_record') = 'ok' AS has_stats FROM customer LEFT JOIN r ON o_custkey = c_custkey""")
def candidates_with_stats(spark, d):
    r = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("value")).withColumn("status", F.when(F.col("c_custkey") % 5 == 0, "page_missing").otherwise("ok"))
    return joins.with_stats(t(spark, d, "customer").select("c_custkey"), r, "c_custkey", ["value"])


@query("""SELECT c_custkey, coalesce(v.region, nullif(c_mktsegment, 'BUILDING'), '') AS region FROM customer LEFT JOIN (SELECT n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0) v ON n_nationkey = c_nationkey""")
def nation_with_fallbacks(spark, d):
    named = t(spark, d, "nation").where("n_nationkey % 3 = 0").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("region"))
    return joins.with_fallbacks(c, named, ["c_nationkey"], "region").select("c_custkey", "region")


@query("""SELECT o_orderkey, CAST(y AS VARCHAR) AS season_id, CASE WHEN y <> 1996 THEN 'calendar_year' END AS eval_period_type, CASE WHEN y <> 1996 THEN make_date(y, 1, 1) END AS eval_period_start, CASE WHEN y <> 1996 THEN make_date(y, 12, 31) END AS eval_period_end
  FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y FROM orders)""")
def eval_windows(spark, d):
    p = periods.eval_period(F.col("y"))
    w = spark.range(1990, 2010).where("id <> 1996").select(F.col("id").cast("int").alias("y")).select(F.col("y").cast("string").alias("season_id"), p["kind"].alias("eval_period_type"), p["start"].alias("eval_period_start"), p["end"].alias("eval_period_end"))
    o = orders_by_year(spark, d).select("o_orderkey", F.col("year").cast("string").alias("season_id"))
    return joins.with_eval_window(o, F.broadcast(w))  # a row a year


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'page of ' || c_name END, c_name) AS canonical FROM customer""")
def canonical_names(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    titles = c.select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("page of "), "c_name")).alias("title"))
    return joins.with_canonical(c, titles, "c_name").select("c_custkey", "canonical")


CAREER = """career AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INT) AS y, count(*) AS apps, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS goals FROM orders GROUP BY 1, 2)"""


def careers(spark, d):
    """cust, career: (season, year, club, apps, goals) of each year with orders."""
    per = orders_by_year(spark, d).groupBy("cust", "year").agg(F.count(F.lit(1)).alias("apps"), F.count_if(F.col("o_orderstatus") == "F").alias("goals"))
    entry = F.struct(periods.short_season(F.col("year")).alias("season"), F.col("year").cast("string").alias("year"), F.concat(F.lit("club "), F.col("year") % 3).alias("club"), "apps", "goals")
    return per.groupBy("cust").agg(F.array_sort(F.collect_list(entry)).alias("career"))  # a row a year


@query(f"""WITH {CAREER} SELECT cust, y AS year, apps FROM career WHERE CASE WHEN cust % 2 = 0 THEN y + 1 = 1996 ELSE y = 1996 OR y + 1 = 1996 END""")
def career_in_period(spark, d):
    c = careers(spark, d).withColumns({"award_year": F.lit(1996), "kind": F.when(F.col("cust") % 2 == 0, "season").otherwise("calendar_year")})
    return joins.career_in_period(c, "career", "season", "award_year", "kind").select("cust", F.col("entry.year").cast("int").alias("year"), "entry.apps")


@query(f"""WITH {CAREER} SELECT cust, CAST(sum(apps) AS BIGINT) AS apps, CAST(sum(goals) AS BIGINT) AS goals FROM career WHERE y = 1996 OR (cust % 2 = 0 AND y = 1995) GROUP BY 1""")
def international_sums(spark, d):
    c = careers(spark, d).withColumns({"award_year": F.lit(1996), "kind": F.when(F.col("cust") % 2 == 0, "season").otherwise("calendar_year")})
    met = joins.international_in_period(c, "career", "year", "award_year", "kind")
    return met.groupBy("cust").agg(F.sum("entry.apps").alias("apps"), F.sum("entry.goals").alias("goals"))


@query("""WITH a AS (SELECT c_custkey, 1994 + c_custkey % 4 AS y, c_custkey % 2 = 0 AS season FROM customer), s AS (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus AS league, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2, 3)
  SELECT c_custkey, round(sum(v), 2) AS v, string_agg(DISTINCT league, ',' ORDER BY league) AS leagues, count(*) AS n_rows FROM a JOIN s ON o_custkey = c_custkey AND (s.y = a.y - 1 OR (NOT season AND s.y = a.y)) GROUP BY 1""")
def league_season_sums(spark, d):
    a = t(spark, d, "customer").select("c_custkey", (1994 + F.col("c_custkey") % 4).cast("int").alias("award_year"), F.when(F.col("c_custkey") % 2 == 0, "season").otherwise("calendar_year").alias("kind"))
    s = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("league")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    sums = aggregates.known_sums_and_sets(joins.league_seasons(a, s, "c_custkey", "award_year", "kind", "season"), ["c_custkey"], ["v"], ["league"])
    return sums.select("c_custkey", F.round("v", 2).alias("v"), F.array_join("leagues", ",").alias("leagues"), "n_rows")


@query("""SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(lower(p_name), 'steel|box')""")
def aggregate_rows_removed(spark, d):
    p = t(spark, d, "part").withColumn("said", F.regexp_replace(F.regexp_replace("p_name", "steel", "Career total"), "box", "Total"))
    return aggregates.without_totals(p, ["said"]).select("p_partkey", "p_name")


@query("""SELECT count(CASE WHEN p_size % 4 > 0 THEN 1 END) AS kept, count(CASE WHEN p_size % 4 = 0 THEN 1 END) AS skipped FROM part""")
def parse_failures(spark, d):
    p = t(spark, d, "part").select(text.parse_rank(F.when(F.col("p_size") % 4 == 0, "—").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("th")))).alias("rank"))
    good, skipped = aggregates.parsed_or_skipped(p, ["rank"])
    return good.agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(skipped))  # one row each


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1995 THEN o_totalprice END AS o_totalprice FROM orders""")
def era_gate(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    return aggregates.in_schema_order(aggregates.era_gated(o, "year", 1995, ["o_totalprice"]), ["o_orderkey", "no_such_column", "o_totalprice"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7""")
def point_lookup(spark, d):
    return aggregates.point_lookup(t(spark, d, "customer").select("c_custkey", "c_name"), c_custkey=7)


@query("""WITH r AS (SELECT n_name, s_name, row_number() OVER (PARTITION BY n_name ORDER BY s_name) AS k, count(*) OVER (PARTITION BY n_name) AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT n_name, string_agg(s_name, ',' ORDER BY s_name) AS items, greatest(max(a) - 2, 0) AS more FROM r WHERE k <= 2 GROUP BY 1""")
def capped_details(spark, d):
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name")
    return aggregates.head_and_more(s, ["n_name"], "s_name", 2).select("n_name", F.array_join("items", ",").alias("items"), "more")


@query("""SELECT DISTINCT c_mktsegment, replace(c_mktsegment, ' ', '_') AS slug FROM customer ORDER BY 1""")
def sorted_distinct(spark, d):
    return t(spark, d, "customer").select("c_mktsegment", text.slugify("c_mktsegment").alias("slug")).distinct().orderBy("c_mktsegment")


HALVES = """SELECT 1 AS half, o_orderkey AS rank, o_totalprice AS points FROM orders WHERE o_orderkey <= 3 UNION ALL SELECT 2, o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 3"""


@query(f"""SELECT rank, round(sum(points), 2) AS points FROM ({HALVES}) GROUP BY 1""")
def split_tables_union(spark, d):
    """Two parts of one table whose headers differ are named alike first, then put together."""
    from rankloom.sources.landing import first_columns

    o = t(spark, d, "orders")
    top = o.where("o_orderkey <= 3").select(F.col("o_orderkey").alias("Rank[2]"), F.col("o_totalprice").alias("Pts"))
    rest = o.where("o_orderkey > 3").select(F.col("o_totalprice").alias("Points"), F.col("o_orderkey").alias("rank"))
    return first_columns(top).unionByName(first_columns(rest)).groupBy("rank").agg(F.round(F.sum("points"), 2).alias("points"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS g, l_extendedprice / 1000 AS x, nullif(l_discount, 0) AS cg, nullif(l_tax, 0) AS ig, l_linenumber > 2 AS cup, l_linenumber = 1 AS wc, l_returnflag = 'R' AS yr FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(g - x, 6) AS over, round(cg / g, 6) AS continental_goals_ratio, round(ig / 2, 6) AS international_goals_per_app, CASE WHEN yr THEN coalesce(ig, 0) ELSE 0 END AS tournament_year_boost,
    CASE WHEN cup THEN coalesce(cg, 0) ELSE 0 END AS ucl_winner_goalscorer, CASE WHEN wc THEN coalesce(ig, 0) ELSE 0 END AS wc_winner_goalscorer, (cup AND wc) OR (cup AND g >= 10) OR (wc AND g >= 5) AS signature,
    CASE WHEN cg IS NULL AND ig IS NULL THEN NULL ELSE round((coalesce(cg, 0) + coalesce(ig, 0)) * 1.5, 6) END AS adjusted FROM l""")
def heroism_features(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("g"), (F.col("l_extendedprice") / 1000).alias("x"), F.nullif("l_discount", F.lit(0.0)).alias("cg"), F.nullif("l_tax", F.lit(0.0)).alias("ig"), (F.col("l_linenumber") > 2).alias("cup"), (F.col("l_linenumber") == 1).alias("wc"), (F.col("l_returnflag") == "R").alias("yr"))
    c = F.col
    made = numeric.heroism(c("cg"), c("g"), c("ig"), F.lit(2), c("yr"), c("cup"), c("wc"))
    rounded = {k: F.round(v, 6) if k in ("continental_goals_ratio", "international_goals_per_app") else v for k, v in made.items()}
    return x.select("l_orderkey", "l_linenumber", F.round(numeric.overperformance(c("g"), c("x")), 6).alias("over"), *(v.alias(k) for k, v in rounded.items()), numeric.signature_moment(c("cup"), c("wc"), c("g")).alias("signature"), F.round(numeric.adjusted_contribution(c("cg"), c("ig"), F.lit("MF")), 6).alias("adjusted"))


CLUBS = ("Real Madrid", "Inter Milan", "FC Porto", "SL Benfica", "Wolves", "Norwich City", "", "Celtic FC", "Villarreal")
LANDS = ("Brazil", "West Germany", "Atlantis", " Japan ", "", "Mali", "Côte d'Ivoire")


def sql_array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"""SELECT c_custkey, {sql_array(CLUBS)}[CAST(c_custkey % {len(CLUBS)} AS INT) + 1] AS club, [1, 1, 2, 2, 2, 3, 4, 2, 3][CAST(c_custkey % {len(CLUBS)} AS INT) + 1] AS prestige, [1, 1, 2, 2, 3, 3, 4, 2, 1][CAST(c_custkey % {len(CLUBS)} AS INT) + 1] AS visibility,
  {sql_array(("South America", "Europe", "Other", "Asia", "Unknown", "Africa", "Africa"))}[CAST(c_custkey % {len(LANDS)} AS INT) + 1] AS continent FROM customer""")
def club_and_nation_tiers(spark, d):
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values)).cast("int"))
    c = t(spark, d, "customer").select("c_custkey", pick(CLUBS).alias("club"), pick(LANDS).alias("land"))
    # 'ol' inside 'wolves' is tier 2 by substring; whole words would make it 3
    return c.select("c_custkey", "club", F.when(F.col("club") == "Wolves", numeric.prestige_tier(F.col("club"))).otherwise(numeric.prestige_tier(F.col("club"), whole_words=True)).alias("prestige"), numeric.visibility_tier(F.col("club"), whole_words=True).alias("visibility"), numeric.continent(F.col("land")).alias("continent"))


@query("""WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) + 30 AS INT) AS y, o_orderkey % 4 AS k FROM orders)
  SELECT o_orderkey, CASE k WHEN 0 THEN 'season' WHEN 1 THEN 'season' WHEN 2 THEN 'season_explicit_dates' END AS kind, CASE k WHEN 0 THEN y - 1 WHEN 1 THEN y END AS starts, CASE k WHEN 0 THEN y WHEN 1 THEN y + 1 END AS ends,
    CASE WHEN k = 3 THEN 'inferred_from_rule' WHEN y >= 2022 AND k IN (0, 2) THEN 'verified' ELSE 'discrepancy' END AS status FROM o""")
def period_verification(spark, d):
    y, k = F.col("y"), F.col("o_orderkey") % 4
    intro = F.when(k == 0, F.concat(F.lit("The prize of the "), periods.short_season(y - 1), F.lit(" European season is given"))).when(k == 1, F.concat(F.lit("For the "), y, F.lit("–"), y + 1, F.lit(" Season"))).when(k == 2, F.concat(F.lit("from 1 August "), y - 1, F.lit(" to 31 July "), y)).otherwise(F.concat(F.lit("The best of "), y))
    o = t(spark, d, "orders").select("o_orderkey", (F.year("o_orderdate") + 30).cast("int").alias("y")).withColumn("intro", intro)
    told, rule = periods.detect_period(F.col("intro")), periods.eval_period(y)
    return o.withColumn("told", told).select("o_orderkey", F.col("told.kind").alias("kind"), F.col("told.start").alias("starts"), F.col("told.end").alias("ends"), periods.verification(y, rule["kind"], F.col("told")).alias("status"))


@query("""SELECT p_partkey, format('{:.1f}%', p_size / 3.0) AS share, format('{:+.3f}', p_size / 7.0 - 3) AS change, CASE WHEN p_size % 5 > 0 THEN p_size END AS typed FROM part""")
def formatted_values(spark, d):
    typed = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_size").cast("string"))
    return t(spark, d, "part").select("p_partkey", numeric.percent(F.col("p_size") / 300.0).alias("share"), numeric.signed(F.col("p_size") / 7.0 - 3).alias("change"), text.falsy_to_null(typed, "int").alias("typed"))


@query("""SELECT a.c_custkey, coalesce(len(list_intersect(list(DISTINCT CAST(year(o_orderdate) AS INT)), [1992, 1996, 2000])) > 0, FALSE) AS met, coalesce(bool_or(year(o_orderdate) - 1 IN (1994, 1998) OR year(o_orderdate) IN (1994, 1998)), FALSE) AS cup FROM customer a LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def year_sets(spark, d):
    y = orders_by_year(spark, d).select(F.col("cust").alias("c_custkey"), "year").withColumn("cup", numeric.tournament_year(F.col("year"), F.lit("season"), numeric.WORLD_CUP_YEARS))
    sets = y.groupBy("c_custkey").agg(F.arrays_overlap(F.collect_set("year"), F.array(F.lit(1992), F.lit(1996), F.lit(2000))).alias("met"), F.bool_or("cup").alias("cup"))  # a row a year
    met = t(spark, d, "customer").select("c_custkey").join(sets, "c_custkey", "left")
    return met.select("c_custkey", F.coalesce("met", F.lit(False)).alias("met"), F.coalesce("cup", F.lit(False)).alias("cup"))


LINEAR = ranking.LinearRanker(("acctbal", "quantity"), (0.8, 0.5), (1000.0, 100.0), 0.25, 0)


def scored_suppliers(spark, d):
    from rankloom.plans.catalog import supplier_pools

    s = supplier_pools(spark, d)
    return s.withColumn("score", F.round(LINEAR.score(), 6))


SCORED = """s AS (SELECT s_nationkey AS nation, s_suppkey AS supp, s_acctbal AS acctbal, revenue, quantity FROM supplier LEFT JOIN (SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY revenue DESC NULLS LAST, supp) AS rank, round(0.25 + coalesce(acctbal, 0) * (0.8 / 1000.0) + coalesce(quantity, 0) * (0.5 / 100.0), 6) AS score FROM s),
  p AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, supp) AS place FROM r)"""


@query(f"""WITH {SCORED}, w AS (SELECT nation, min(place) AS winner_at FROM p WHERE rank = 1 GROUP BY 1),
  a AS (SELECT nation, rank() OVER (PARTITION BY nation ORDER BY score) + (count(*) OVER (PARTITION BY nation, score) - 1) / 2.0 AS x, -rank AS y FROM r), sp AS (SELECT nation, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS spearman FROM a GROUP BY 1),
  k AS (SELECT u.nation, sum(sign(u.score - v.score) * sign(v.rank - u.rank)) / nullif(sqrt(sum(abs(sign(u.score - v.score))) * sum(abs(sign(v.rank - u.rank)))), 0) AS kendall FROM r u JOIN r v ON u.nation = v.nation AND u.supp < v.supp GROUP BY 1)
  SELECT nation, winner_at, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall FROM (SELECT DISTINCT nation FROM r) LEFT JOIN w USING (nation) LEFT JOIN sp USING (nation) LEFT JOIN k USING (nation)""")
def yearly_metrics(spark, d):
    m = ranking.yearly_metrics(scored_suppliers(spark, d), "nation", "supp", "rank", "score")
    return m.select("nation", F.col("winner_at").cast("long").alias("winner_at"), F.round("spearman", 6).alias("spearman"), F.round("kendall", 6).alias("kendall"))


@query(f"""WITH {SCORED} SELECT a.nation, a.supp, a.place AS winner_at, b.supp AS predicted FROM p a JOIN p b ON a.nation = b.nation AND b.place = 1 WHERE a.rank = 1 AND a.place > 1""")
def missed_winners(spark, d):
    m = ranking.missed_winners(scored_suppliers(spark, d), "nation", "supp", "rank", "score")
    return m.select("nation", "supp", F.col("winner_at").cast("long").alias("winner_at"), "predicted")


@query(f"""WITH {SCORED}, q AS (SELECT 0.25 + (a.acctbal - b.acctbal) * (0.8 / 1000.0) + (coalesce(a.quantity, 0) - coalesce(b.quantity, 0)) * (0.5 / 100.0) AS up, 0.25 + (b.acctbal - a.acctbal) * (0.8 / 1000.0) + (coalesce(b.quantity, 0) - coalesce(a.quantity, 0)) * (0.5 / 100.0) AS down FROM r a JOIN r b ON a.nation = b.nation AND a.rank < b.rank)
  SELECT round((count(CASE WHEN up > 0 THEN 1 END) + count(CASE WHEN NOT down > 0 THEN 1 END)) / (2.0 * nullif(count(*), 0)), 6) AS pair_accuracy FROM q""")
def pair_accuracy(spark, d):
    s = ranking.numbers(scored_suppliers(spark, d).drop("score"), LINEAR.features)
    share = ranking.pair_accuracy(s, "nation", ["rank"], "supp", LINEAR)
    return spark.createDataFrame([(None if share is None else round(share, 6),)], "pair_accuracy double")


@query(f"""WITH {SCORED}, w AS (SELECT nation, min(place) AS found FROM p WHERE rank = 1 AND nation % 4 = 1 GROUP BY 1) SELECT round(avg(CAST(found <= 1 AS INT)), 6) AS top1, round(avg(CAST(found <= 3 AS INT)), 6) AS top3, round(avg(CAST(found <= 5 AS INT)), 6) AS top5, count(*) AS n_years FROM w""")
def held_out_metrics(spark, d):
    held = [n for n in range(25) if n % 4 == 1]
    _, test = ranking.held_out_split(scored_suppliers(spark, d), "nation", held)
    m = ranking.evaluate(test, "nation", "supp", "rank")
    return m.select(*(F.round(c, 6).alias(c) for c in ("top1", "top3", "top5")), "n_years")


def yearly_totals(spark, d):
    """cust, year and the sums over the year's orders that nominees, records and titles are made of."""
    sums = (F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("apps"), F.count_if(F.col("o_orderstatus") == "F").alias("goals"), F.sum(F.floor(F.col("o_totalprice") / 1000)).alias("minutes"))
    return orders_by_year(spark, d).groupBy("cust", "year").agg(*sums)


def nominees(spark, d, y=None):
    """Candidate lists made of the tables: each year's thirty best customers by order value."""
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    sums = (yearly_totals(spark, d) if y is None else y).select("cust", "year", F.round("total", 2).alias("revenue"))
    top = windows.top_k(sums, ["year"], "revenue", ["cust"], 30)
    met = top.join(c, F.col("cust") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.select(
        F.col("year").cast("string").alias("season_id"), F.col("year").alias("award_year"), F.col("predicted_rank").alias("rank"), F.col("c_name").alias("player_name_raw"), F.col("c_mktsegment").alias("club_at_time"), F.col("n_name").alias("nation_team"),
        F.when(F.col("cust") % 3 == 0, "Forward").when(F.col("cust") % 3 == 1, "gk").alias("position_raw"), F.when(F.col("year") >= 1995, "season").otherwise("calendar_year").alias("eval_period_type"), "cust", "revenue",
    )


def records(y, asked):
    """Career records of the customers (cust, player_name_raw) that are asked for: nobody else's years are gathered."""
    none = F.lit(None).cast("bigint")
    entry = F.struct(
        periods.short_season(F.col("year")).alias("season"), F.concat(F.lit("club "), F.col("year") % 3).alias("club"), F.col("apps").alias("league_apps"), F.col("goals").alias("league_goals"), none.alias("league_assists"), F.col("minutes").alias("league_minutes"),
        F.when(F.col("apps") > 2, F.col("goals")).alias("continental_goals"), none.alias("continental_assists"), F.when(F.col("apps") > 2, F.col("apps")).alias("continental_apps"), none.alias("continental_minutes"),
    )
    abroad = F.struct(F.col("year").cast("string").alias("year"), F.lit("team").alias("team"), F.col("apps"), F.col("goals"))
    per = y.join(asked.select("cust", "player_name_raw").distinct(), "cust")
    rows = per.groupBy("cust", "player_name_raw").agg(F.array_sort(F.collect_list(entry)).alias("career_stats"), F.array_sort(F.collect_list(abroad)).alias("international_stats"))  # a row a year
    status = F.when(F.col("cust") % 7 == 0, "page_missing").otherwise("ok")
    nothing = F.struct(F.lit("fetch_failed").alias("status"), F.lit(0).alias("line"), *(F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes[2:]))
    good = F.struct(status.alias("status"), F.lit(1).alias("line"), "career_stats", "international_stats")
    told = rows.select("player_name_raw", F.explode(F.when(status == "ok", F.array(good, nothing)).otherwise(F.array(good))).alias("r")).select("player_name_raw", "r.*")
    return assembly.best_records(told, "line")


def titles(spark, d, y):
    """Winner and runner-up of each year's league by segment, and of each year's tournament by nation."""
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    met = y.join(c, F.col("cust") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    sides = F.explode(F.array(*(F.struct(F.lit(name).alias("competition"), F.col(column).alias("team")) for column, name in (("c_mktsegment", "La Liga"), ("n_name", "FIFA World Cup"))))).alias("s")
    sums = met.select(F.col("year").cast("string").alias("season_id"), "total", sides).groupBy("season_id", "s.competition", "s.team").agg(F.round(F.sum("total"), 2).alias("v"))
    stage = F.when(F.col("predicted_rank") == 1, "winner").otherwise("runner_up")
    return windows.top_k(sums, ["season_id", "competition"], "v", ["team"], 2).select("season_id", "competition", stage.alias("stage"), "team", F.col("predicted_rank").alias("line"))


def assembled(spark, d):
    """The features of all nominees; what several branches read is stored once."""
    y = kept_table(yearly_totals(spark, d), "yearly")
    asked = kept_table(nominees(spark, d, y).coalesce(1), "nominees")
    return assembly.assemble(asked, kept_table(records(y, asked).coalesce(1), "records"), kept_table(titles(spark, d, y).coalesce(1), "titles"))


TOP30 = """y AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INT) AS y, round(sum(o_totalprice), 2) AS revenue, count(*) AS apps, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS goals, CAST(sum(floor(o_totalprice / 1000)) AS BIGINT) AS minutes FROM orders GROUP BY 1, 2),
  g AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY revenue DESC, cust) AS rank FROM y QUALIFY rank <= 30), c AS (SELECT g.*, c_name, c_mktsegment AS club, n_name AS nation, y >= 1995 AS season, cust % 7 <> 0 AS ok FROM g JOIN customer ON c_custkey = cust JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"""WITH {TOP30},
  st AS (SELECT c.cust, c.y, CAST(sum(s.goals) AS BIGINT) AS league_goals, CAST(sum(s.apps) AS BIGINT) AS league_apps, CAST(sum(s.minutes) AS BIGINT) AS league_minutes, CAST(sum(CASE WHEN s.apps > 2 THEN s.goals END) AS BIGINT) AS continental_goals, count(*) AS n_matched FROM c JOIN y s ON s.cust = c.cust AND (s.y + 1 = c.y OR (NOT season AND s.y = c.y)) WHERE ok GROUP BY 1, 2),
  ab AS (SELECT c.cust, c.y, CAST(sum(s.goals) AS BIGINT) AS ig, CAST(sum(s.apps) AS BIGINT) AS ia FROM c JOIN y s ON s.cust = c.cust AND (s.y = c.y OR (season AND s.y = c.y - 1)) WHERE ok GROUP BY 1, 2),
  lg AS (SELECT CAST(year(o_orderdate) AS INT) AS y, c_mktsegment AS team, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), lw AS (SELECT y, team, row_number() OVER (PARTITION BY y ORDER BY v DESC, team) AS k FROM lg QUALIFY k <= 2),
  wg AS (SELECT CAST(year(o_orderdate) AS INT) AS y, n_name AS team, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), ww AS (SELECT y, team, row_number() OVER (PARTITION BY y ORDER BY v DESC, team) AS k FROM wg QUALIFY k <= 2),
  ft AS (SELECT c.*, league_goals, league_apps, league_minutes, CASE WHEN league_goals IS NULL AND continental_goals IS NULL THEN NULL ELSE coalesce(league_goals, 0) + coalesce(continental_goals, 0) END AS total_goals, CASE WHEN ok THEN coalesce(n_matched, 0) END AS n_matched, ig, ia,
      EXISTS (SELECT 1 FROM lw WHERE lw.y = c.y - 1 AND lw.team = club AND k = 1) AS dlw, EXISTS (SELECT 1 FROM lw WHERE lw.y = c.y - 1 AND lw.team = club AND k = 2) AS dlr,
      coalesce((SELECT arg_min(k, 10 * ww.y + k) FROM ww WHERE (contains(team, nation) OR contains(nation, team)) AND (ww.y = c.y OR (season AND ww.y = c.y - 1))) = 1, FALSE) AS wcw FROM c LEFT JOIN st USING (cust, y) LEFT JOIN ab USING (cust, y)),
  pc AS (SELECT *, CASE WHEN total_goals IS NOT NULL THEN (count(total_goals) OVER (PARTITION BY y ORDER BY total_goals RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 0.5 * count(total_goals) OVER (PARTITION BY y, total_goals)) / count(total_goals) OVER (PARTITION BY y) END AS gp FROM ft)
  SELECT CAST(y AS VARCHAR) AS season_id, c_name AS player_name_raw, CASE WHEN y < 1995 THEN 'classical' ELSE 'pre_merger' END AS era_tag, CASE WHEN ok THEN 'ok' ELSE 'page_missing' END AS stats_status, league_goals, league_apps, round(league_goals * 90 / league_minutes, 6) AS league_goals_per90, total_goals, n_matched AS n_seasons_matched,
    ig AS international_goals, dlw AS domestic_league_winner, dlr AS domestic_league_runner_up, wcw AS world_cup_winner, round(gp, 6) AS goals_percentile_in_year, wcw AND coalesce(ig, 0) >= 5 AS signature_moment,
    (SELECT count(*) FROM c b WHERE b.cust = pc.cust AND b.y < pc.y AND b.rank = 1) AS prior_winner_count, (SELECT count(*) FROM c b WHERE b.cust = pc.cust AND b.y < pc.y AND b.rank <= 5) AS years_in_top_5, (SELECT count(*) FROM c b WHERE b.cust = pc.cust AND b.y < pc.y) AS prior_nominations_count,
    (SELECT count(*) FROM c b WHERE b.nation = pc.nation AND b.y < pc.y AND b.rank = 1) AS nation_prior_winners_count, CAST(coalesce(y - (SELECT max(b.y) FROM c b WHERE b.nation = pc.nation AND b.y < pc.y AND b.rank = 1), 999) AS BIGINT) AS nation_years_since_last_winner,
    round(ig / ia, 6) AS international_goals_per_app, CASE WHEN wcw THEN coalesce(ig, 0) ELSE 0 END AS wc_winner_goalscorer, CASE cust % 3 WHEN 0 THEN 'FW' WHEN 1 THEN 'GK' ELSE 'Unknown' END AS position, y IN (1992, 1993, 1994, 1995, 1996, 1997) OR (season AND y = 1998) AS cup_year FROM pc""")
def feature_assembly(spark, d):
    """Candidates x statistics x titles x history x percentiles over lists made of the tables."""
    f = assembled(spark, d)
    cup = (F.col("award_year").isin(1992, 1993, 1994, 1995, 1996, 1997)) | ((F.col("eval_period_type") == "season") & (F.col("award_year") == 1998))
    rounded = [F.round(c, 6).alias(c) for c in ("league_goals_per90", "goals_percentile_in_year", "international_goals_per_app")]
    plain = "season_id player_name_raw era_tag stats_status league_goals league_apps total_goals international_goals domestic_league_winner domestic_league_runner_up world_cup_winner signature_moment prior_winner_count years_in_top_5 prior_nominations_count nation_prior_winners_count wc_winner_goalscorer position"
    return f.select(*plain.split(), *rounded, F.col("n_seasons_matched").cast("long").alias("n_seasons_matched"), F.col("nation_years_since_last_winner").cast("long").alias("nation_years_since_last_winner"), cup.alias("cup_year"))


MODEL = ["total_goals", "total_apps", "goals_percentile_in_year", "prior_winner_count", "nation_prior_winners_count"]


@query()
def validation_run(spark, d):
    """protocol, tier and mean metrics: no fit, leave one year out, expanding window, held out; tested on fixtures against brute force."""
    f = kept_table(assembled(spark, d).select("award_year", "rank", "player_name_raw", *MODEL, "world_cup_winner", "domestic_league_winner"), "features")
    held, who = [1998], ("award_year", "player_name_raw", "rank")
    train, _ = ranking.held_out_split(f, "award_year", held)
    args = ("award_year", ["rank", "player_name_raw"], "player_name_raw", "rank", MODEL)
    runs = {
        ("no_fit", "A"): ranking.scored(train, ranking.weighted_score(train, ranking.TIER_A_WEIGHTS), *who),
        ("loso", "B"): ranking.cross_validate(train, *args),
        ("loso", "C"): ranking.cross_validate_listwise(train, *who, MODEL, rounds=30),
        ("expanding", "B"): ranking.cross_validate(train, *args, kind="expanding", skip=2),
    }
    runs |= {("held_out", tier): s for tier, s in ranking.held_out_scores(f, *args, held=held, rounds=30).items()}
    return ranking.evaluate(ranking.labelled_union(runs, "protocol", "tier"), *who, by=["protocol", "tier"])


@query()
def season_prediction(spark, d):
    """The document of one season by a model trained on the others."""
    f = kept_table(assembled(spark, d), "features")
    return ranking.predict_season(f, "1996", ["rank", "player_name_raw"], "player_name_raw", MODEL, held=[1998])


@query("""SELECT 'extra_years' AS "check", CAST(y AS VARCHAR) AS key, NULL AS detail FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders) WHERE y > 1995
  UNION ALL SELECT 'missing_years', CAST(range AS VARCHAR), NULL FROM range(1990, 1996) WHERE range NOT IN (SELECT year(o_orderdate) FROM orders)
  UNION ALL SELECT 'missing_nation_team', CAST(y AS VARCHAR), CAST(n AS VARCHAR) FROM (SELECT y, count(*) AS n FROM (SELECT CAST(year(o_orderdate) AS INT) AS y, o_custkey, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS k FROM orders GROUP BY 1, 2, year(o_orderdate)) WHERE k <= 30 AND o_custkey % 11 = 0 GROUP BY 1)""")
def quality_checks(spark, d):
    n = nominees(spark, d).withColumns({"nation_team": F.when(F.col("cust") % 11 > 0, F.col("nation_team")), "points": F.col("revenue")})
    return aggregates.quality_checks(n, range(1990, 1996))


@query("""WITH x AS (SELECT n_nationkey AS k, n_name FROM nation) SELECT 'match' AS verdict, count(*) AS n FROM x WHERE k % 5 > 1 UNION ALL SELECT 'mismatch', count(*) FROM x WHERE k % 5 = 0 UNION ALL SELECT 'main_missing', count(*) FROM x WHERE k % 5 = 1""")
def cross_verification(spark, d):
    n = t(spark, d, "nation").select((F.col("n_nationkey") + 1950).cast("int").alias("award_year"), F.lit(1).alias("rank"), F.concat("n_name", F.lit("[2] (3)")).alias("player_name_raw"), "n_nationkey", "n_name")
    main = n.where("n_nationkey % 5 <> 1").select("award_year", "rank", F.when(F.col("n_nationkey") % 5 == 0, "someone").otherwise(F.lower("n_name")).alias("player"))
    return aggregates.value_counts(reports.cross_verification(main, n, range(1950, 1975)), "verdict")


@query("""SELECT era, rows, with_stats, round(100.0 * with_stats / rows, 1) AS share, CASE WHEN 100.0 * with_stats / rows >= 90 THEN 'excellent' WHEN 100.0 * with_stats / rows >= 70 THEN 'good' WHEN 100.0 * with_stats / rows >= 50 THEN 'partial' ELSE 'poor' END AS grade FROM
  (SELECT CASE WHEN year(o_orderdate) < 1995 THEN 'classical' ELSE 'pre_merger' END AS era, count(*) AS rows, count(CASE WHEN o_custkey % 5 > 0 THEN 1 END) AS with_stats FROM orders GROUP BY 1)""")
def stats_coverage(spark, d):
    o = orders_by_year(spark, d).select(F.col("year").alias("award_year"), F.col("cust").cast("string").alias("player_name_raw"), "cust")
    s = o.select("player_name_raw", F.when(F.col("cust") % 5 > 0, "ok").otherwise("fetch_failed").alias("status")).distinct()
    return reports.stats_coverage(o, s)


@query("""SELECT c_custkey AS cust, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS following, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS place FROM customer QUALIFY place <= 5""")
def first_of_group(spark, d):
    c = windows.row_numbers(t(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], "place")
    few = c.where("place <= 6")
    w = Window.partitionBy("c_nationkey").orderBy("place")  # six rows
    return few.select(F.col("c_custkey").alias("cust"), F.lead("c_custkey").over(w).alias("following"), "place").where("place <= 5")


@query("""WITH r AS (SELECT p_partkey AS line, p_size, CASE WHEN p_partkey % 2 = 1 THEN split_part(p_name, ' ', 2) ELSE p_name END AS other FROM part)
  SELECT p_partkey, arg_min(other, line) AS other, min(line) AS line FROM part JOIN r USING (p_size) WHERE contains(lower(p_name), lower(other)) OR contains(lower(other), lower(p_name)) GROUP BY 1""")
def substring_match(spark, d):
    """The first name of the same size, whole or a word, that a part's name holds or is held by."""
    p = t(spark, d, "part")
    right = p.select(F.col("p_partkey").alias("line"), "p_size", F.when(F.col("p_partkey") % 2 == 1, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.col("p_name")).alias("other"))
    return joins.substring_match(p.select("p_partkey", "p_name", "p_size"), right, ["p_size"], "p_name", "other", ["p_partkey"], ["line"]).select("p_partkey", "other", "line")


@query(f"""WITH {SUPP}, f AS (SELECT nation, min(supp) AS supp FROM s GROUP BY 1), c AS (SELECT s.nation, s.supp, CASE WHEN f.supp IS NULL THEN acctbal ELSE -acctbal END AS acctbal, CASE WHEN f.supp IS NOT NULL AND s.nation % 3 = 1 THEN NULL WHEN f.supp IS NOT NULL THEN coalesce(quantity, 0) + 100 ELSE quantity END AS quantity FROM s LEFT JOIN f ON f.supp = s.supp)
  SELECT nation, supp, acctbal, quantity, round({pct("acctbal", "nation")}, 6) AS acctbal_pct, round({pct("quantity", "nation")}, 6) AS quantity_pct, round(2.0 * coalesce({pct("acctbal", "nation")}, 0) + coalesce({pct("quantity", "nation")}, 0), 6) AS score FROM c""")
def what_if_percentiles(spark, d):
    """Percentiles and scores after the first supplier of each nation has changed, from the old percentiles and the changes alone."""
    s = supplier_stats(spark, d).select("nation", "supp", "acctbal", F.col("quantity").cast("double").alias("quantity"))
    for f in ("acctbal", "quantity"):
        s = windows.midrank_by_ranges(s, ["nation"], f, f"{f}_pct")
    base = kept_table(s.select("nation", "supp", "acctbal", "quantity", "acctbal_pct", "quantity_pct"), "base")
    first = base.groupBy("nation").agg(F.min_by(F.struct("supp", "acctbal", "quantity"), "supp").alias("f")).select("nation", "f.*")
    said = F.explode(F.array(F.struct(F.lit("acctbal").alias("feature"), (-F.col("acctbal")).alias("value")), F.struct(F.lit("quantity").alias("feature"), F.when(F.col("nation") % 3 != 1, F.coalesce("quantity", F.lit(0.0)) + 100).alias("value"))))
    new = joins.what_if(base, first.select("supp", said.alias("c")).select("supp", "c.*"), "nation", "supp", ["acctbal", "quantity"])
    score = ranking.weighted_score(new, {"acctbal_pct": 2.0, "quantity_pct": 1.0})
    return new.select("nation", "supp", "acctbal", "quantity", F.round("acctbal_pct", 6).alias("acctbal_pct"), F.round("quantity_pct", 6).alias("quantity_pct"), F.round(score, 6).alias("score"))


@query("""WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS n, count(*) OVER () AS c FROM orders) SELECT p AS per_mille, v AS total FROM r, (SELECT unnest([0, 10, 250, 500, 750, 990, 1000]) AS p) WHERE n = p * (c - 1) // 1000""")
def exact_quantiles(spark, d):
    """Values of exact places in the order of all totals."""
    o = t(spark, d, "orders")
    n, shares = o.count(), [0, 10, 250, 500, 750, 990, 1000]
    found = aggregates.order_statistics(o, "o_totalprice", [p * (n - 1) // 1000 for p in shares])
    return spark.createDataFrame(list(zip(shares, found)), "per_mille int, total double")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS said, CASE WHEN o_totalprice > 200000 THEN o_orderstatus END AS status FROM orders) SELECT CAST(count(*) AS BIGINT) AS n, said, status FROM o WHERE said IS NOT NULL OR status IS NOT NULL GROUP BY 2, 3""")
def rows_with_something(spark, d):
    o = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("said"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus")).alias("status"))
    return aggregates.without_empty_rows(o).groupBy("said", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {YEARLY}, c AS (SELECT CASE nation % 4 WHEN 0 THEN 'Europe' WHEN 1 THEN 'South America' WHEN 2 THEN 'Africa' ELSE 'Other' END AS continent, year, count(CASE WHEN rank = 1 THEN 1 END) AS won FROM y GROUP BY 1, 2)
  SELECT continent, year, CAST(coalesce(sum(won) OVER (PARTITION BY continent ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS continent_prior_winners FROM c""")
def continent_prior_winners(spark, d):
    y = yearly_customers(spark, d).withColumn("team", F.get(F.array(*map(F.lit, ("France", "Brazil", "Cameroon", "Atlantis"))), F.col("nation") % 4))
    y = y.withColumn("continent", numeric.continent(F.col("team")))
    return windows.group_prior_count(y, ["continent"], "year", F.col("rank") == 1, "continent_prior_winners").select("continent", F.col("year").cast("long").alias("year"), "continent_prior_winners")
