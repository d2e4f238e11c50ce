"""Queries over events and numeric tables: counters, histograms, limits, queues, statistics, scores, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.registry import query
from loomspan.session import table

# Upper bounds of latency buckets, in seconds.
BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0)
_DUCK_BOUNDS = "(select unnest([" + ", ".join(map(repr, BOUNDS)) + "])::double as le)"


@query("event_resource_breakdown", "select event_type as resource_type, count(*) as n from events group by 1")
def event_resource_breakdown(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("resource_type")).agg(F.count("*").alias("n"))


def cumulative_buckets(events: DataFrame, value: str, *by: str) -> DataFrame:
    """Counts at most each bound: one aggregate with a column a bound, then unpivoted; rows are not multiplied."""
    counts = events.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)))
    pairs = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)))
    return counts.select(*by, F.explode(pairs).alias("x")).select(*by, "x.le", "x.n")


@query("event_latency_histogram", f"select b.le, sum(case when e.value <= b.le then 1 else 0 end)::bigint as n from events e cross join {_DUCK_BOUNDS} b group by b.le")
def event_latency_histogram(spark, sf_dir):
    return cumulative_buckets(table(spark, sf_dir, "events"), "value")


@query("event_histogram_by_type", f"select event_type, b.le, sum(case when e.value <= b.le then 1 else 0 end)::bigint as n from events e cross join {_DUCK_BOUNDS} b group by 1, 2")
def event_histogram_by_type(spark, sf_dir):
    return cumulative_buckets(table(spark, sf_dir, "events"), "value", "event_type")


@query("event_metric_lines", """select 'app_events_total{kind="' || event_type || '"} ' || count(*) as line from events group by event_type""")
def event_metric_lines(spark, sf_dir):
    """Counters in the text format of a metrics endpoint."""
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select(F.format_string('app_events_total{kind="%s"} %d', "event_type", "n").alias("line"))


@query("event_log_lines", "select event_id, '[' || upper(event_type) || '] user=' || user_id || ' ' || props as line from events")
def event_log_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), F.upper("event_type"), F.lit("] user="), F.col("user_id").cast("string"), F.lit(" "), "props").alias("line"))


@query("event_api_calls", "select event_id, json_extract_string(props,'$.k')::bigint > 50 or event_type = 'click' as is_api from events")
def event_api_calls(spark, sf_dir):
    """Events whose properties or kind mark a data request."""
    return table(spark, sf_dir, "events").select("event_id", ((F.get_json_object("props", "$.k").cast("long") > 50) | (F.col("event_type") == "click")).alias("is_api"))


def fixed_window_limit(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """rejected: the key had `most` hits before in the same window; rejected hits count too."""
    window = Window.partitionBy("user_id", F.window("ts", f"{seconds} seconds")).orderBy("ts", "event_id")
    return events.withColumn("rejected", F.row_number().over(window) > most)


@query("fixed_window_limiter", "select event_id, n > 3 as rejected from (select event_id, row_number() over (partition by user_id, floor(epoch(ts)/3600) order by ts, event_id) as n from events)")
def fixed_window_limiter(spark, sf_dir):
    return fixed_window_limit(table(spark, sf_dir, "events"), 3, 3600).select("event_id", "rejected")


@query("rolling_quota", "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as used from events")
def rolling_quota(spark, sf_dir):
    """Hits of a key in the day up to each hit."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as used")


@query("quota_exceeded", "select user_id, count(*)::bigint as used, count(*) >= 50 as exceeded from events where ts >= timestamp '2024-01-15' - interval 1 day and ts < timestamp '2024-01-15' group by 1")
def quota_exceeded(spark, sf_dir):
    x = table(spark, sf_dir, "events").where("ts >= timestamp_ntz '2024-01-15' - interval 1 day and ts < timestamp_ntz '2024-01-15'")
    return x.groupBy("user_id").agg(F.count("*").alias("used")).withColumn("exceeded", F.col("used") >= 50)


@query("sliding_window_limiter", """with recursive e as (select event_id, user_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
  s as (select user_id, n, event_id, true as admitted, [t] as recent from e where n = 1
  union all select user_id, n, event_id, len(r) < 3, case when len(r) < 3 then list_append(r, t) else r end from (select e.*, list_filter(s.recent, lambda x: x > e.t - 86400) as r from s join e on e.user_id = s.user_id and e.n = s.n + 1))
  select event_id, admitted from s""")
def sliding_window_limiter(spark, sf_dir):
    """Hits admitted by a limiter that counts admitted hits alone: an ordered fold for each key (see streaming.limiter)."""
    from loomspan.streaming.limiter import sliding_window

    return sliding_window(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), most=3, seconds=86_400)


@query("stale_keys", "select user_id, max(ts) as last_beat from events group by user_id having max(ts) < timestamp '2024-01-30 00:00:00'")
def stale_keys(spark, sf_dir):
    """Keys whose last sign of life is too old."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_beat")).where("last_beat < timestamp_ntz '2024-01-30 00:00:00'")


@query("queue_depth", "select o_orderstatus as status, count(*) as n from orders group by 1")
def queue_depth(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("claim_oldest", "select o_orderkey from orders where o_orderstatus = 'O' order by o_orderkey limit 1")
def claim_oldest(spark, sf_dir):
    """The oldest job that waits: the top one is the feature."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey").orderBy("o_orderkey").limit(1)


@query("failure_ratio", """select date_trunc('hour', ts) as hour, count(*)::bigint as n, count(*) filter (where event_type = 'error')::bigint as failed,
  count(*) filter (where event_type = 'error') / greatest(count(*), 1)::double > 0.2 as alert from events group by 1""")
def failure_ratio(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"))
    x = x.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return x.withColumn("alert", F.col("failed") / F.greatest("n", F.lit(1)) > 0.2)


@query("running_peak", """with e as (select user_id, ts as t, 1 as d from events union all select user_id, ts + interval 30 minute, -1 from events), r as (select user_id, sum(d) over (partition by user_id order by t, d rows unbounded preceding) as running from e) select user_id, max(running)::bigint as peak from r group by 1""")
def running_peak(spark, sf_dir):
    """Most tasks of a key at once, if each takes half an hour: a sweep over starts and ends."""
    e = table(spark, sf_dir, "events")
    edges = e.select("user_id", F.col("ts").alias("t"), F.lit(1).alias("d")).unionByName(e.select("user_id", (F.col("ts") + F.expr("interval 30 minutes")).alias("t"), F.lit(-1).alias("d")))
    running = F.sum("d").over(Window.partitionBy("user_id").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0))
    return edges.select("user_id", running.alias("running")).groupBy("user_id").agg(F.max("running").alias("peak"))


@query("carousel_interval", """with recursive e as (select user_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts) as n from events),
  s as (select user_id, n, t as last, 0.0::double as total, 0 as gaps from e where n = 1
  union all select e.user_id, e.n, case when e.t - s.last >= 3600 then e.t else s.last end, s.total + case when e.t - s.last >= 3600 then e.t - s.last else 0 end, s.gaps + (e.t - s.last >= 3600)::int from s join e on e.user_id = s.user_id and e.n = s.n + 1)
  select user_id, case when gaps > 0 then round(total / gaps, 3) end as interval from s qualify row_number() over (partition by user_id order by n desc) = 1""")
def carousel_interval(spark, sf_dir):
    """Mean gap of a key's events after those closer than an hour to the last one kept are left out: an ordered fold."""
    from loomspan.streaming.limiter import mean_gaps

    gaps = mean_gaps(table(spark, sf_dir, "events").select("user_id", "ts"), least=3600)
    return gaps.select("user_id", F.round("gap", 3).alias("interval"))


@query("dom_stability", "select user_id, min(ts) as stable_at from (select user_id, ts, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where event_type = before group by 1")
def dom_stability(spark, sf_dir):
    """The first moment at which a key's state repeats."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", before.alias("before"))
    return x.where("event_type = before").groupBy("user_id").agg(F.min("ts").alias("stable_at"))


@query("resume_pending", "select e.event_id from events e where not exists (select 1 from orders o where o.o_orderkey = e.event_id and o.o_orderstatus = 'F')")
def resume_pending(spark, sf_dir):
    """Work that is not done yet."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return table(spark, sf_dir, "events").select("event_id").join(done, "event_id", "left_anti")


@query("attempt_budget", "select event_id from (select event_id, row_number() over (partition by user_id order by ts, event_id) as n from events) where n <= 50")
def attempt_budget(spark, sf_dir):
    """The first fifty calls of each run."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", n.alias("n")).where("n <= 50").select("event_id")


@query("retry_delay", "select o_orderkey, o_custkey % 9 as n, least(0.5 * pow(2, o_custkey % 9), 8.0)::double as delay from orders")
def retry_delay(spark, sf_dir):
    """Seconds before each order's next attempt, without the random part; a customer's number says how many went before."""
    n = F.col("o_custkey") % 9
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), F.least(F.pow(F.lit(2.0), n) * 0.5, F.lit(8.0)).alias("delay"))


@query("metric_stats_index_percentile", "select l_returnflag, count(*) as n, min(l_quantity) as mn, max(l_quantity) as mx, list_sort(list(l_quantity))[least(count(*), cast(floor(0.25*count(*)) as bigint)+1)] as p25 from lineitem group by 1")
def metric_stats_index_percentile(spark, sf_dir):
    """Index percentiles by counting: values are aggregated to (group, value, count) first, so that no group is collected."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("c"))
    return index_percentiles(counts, "l_returnflag", "l_quantity", {"p25": 0.25})


def index_percentiles(counts: DataFrame, key: str, value: str, ps: dict[str, float]) -> DataFrame:
    """n, mn, mx and index percentiles of counts(key, value, c): distinct values and a running sum, not a list."""
    up_to = F.sum("c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("c").over(Window.partitionBy(key))
    x = counts.withColumns({"up_to": up_to, "total": n})
    at = lambda p: F.min(F.when(F.col("up_to") > F.least(F.floor(F.lit(p) * F.col("total")), F.col("total") - 1), F.col(value)))
    return x.groupBy(key).agg(F.sum("c").alias("n"), F.min(value).alias("mn"), F.max(value).alias("mx"), *(at(p).alias(name) for name, p in ps.items()))


@query("corpus_metric_stats", """select l_linestatus, count(*) as n, round(avg(l_discount*100),2) as mean, round(median(l_discount*100),2) as median, min(l_discount*100) as mn, max(l_discount*100) as mx,
  list_sort(list(l_discount*100))[least(count(*), cast(floor(0.25*count(*)) as bigint)+1)] as p25, list_sort(list(l_discount*100))[least(count(*), cast(floor(0.75*count(*)) as bigint)+1)] as p75 from lineitem where l_returnflag <> 'R' group by 1""")
def corpus_metric_stats(spark, sf_dir):
    """Mean, median, extremes and index percentiles of a metric over the rows that succeeded."""
    x = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_linestatus", (F.col("l_discount") * 100).alias("v"))
    means = x.groupBy("l_linestatus").agg(F.round(F.avg("v"), 2).alias("mean"), F.round(F.median("v"), 2).alias("median"))
    stats = index_percentiles(x.groupBy("l_linestatus", "v").agg(F.count("*").alias("c")), "l_linestatus", "v", {"p25": 0.25, "p75": 0.75})
    return stats.join(means, "l_linestatus").select("l_linestatus", "n", "mean", "median", "mn", "mx", "p25", "p75")


# Buckets of a success rate by their upper edge.
BUCKETS = (("0", 0.0), ("1-50", 50.0), ("51-80", 80.0), ("81-95", 95.0), ("96-100", float("inf")))


@query("bucket_distribution", "select b as bucket, count(l.l_quantity) as n from (select unnest(['0','1-50','51-80','81-95','96-100']) as b) d left join lineitem l on d.b = case when l_quantity<=0 then '0' when l_quantity<=50 then '1-50' when l_quantity<=80 then '51-80' when l_quantity<=95 then '81-95' else '96-100' end group by 1")
def bucket_distribution(spark, sf_dir):
    x = F
    for name, edge in BUCKETS:
        x = x.when(F.col("l_quantity") <= edge, name)
    counted = table(spark, sf_dir, "lineitem").groupBy(x.alias("bucket")).agg(F.count("l_quantity").alias("n"))
    names = spark.createDataFrame([(b,) for b, _ in BUCKETS], "bucket string")
    return names.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("corpus_totals", "select count(*) as total, count(*) filter (where o_orderstatus = 'F') as succeeded, count(*) filter (where o_orderstatus <> 'F') as failed from orders")
def corpus_totals(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("succeeded"), F.count_if(F.col("o_orderstatus") != "F").alias("failed"))


#: Measures of a run for each order: errors, and scores of which some are missing.
_MEASURES = (
    "o_orderkey", "cast(case when o_orderkey % 11 = 0 then 1 else 0 end as int) as critical", "cast(o_custkey % 45 as int) as minor", "cast(case when o_orderkey % 7 > 0 then 30 + (o_custkey % 71) + 0.5 end as double) as visual",
    "cast(case when o_orderkey % 5 > 0 then 35 + o_orderkey % 66 end as double) as structural", "cast(case when o_orderkey % 3 > 0 then o_custkey % 101 end as double) as responsive",
)


@query("fidelity_score", f"""select o_orderkey, case when critical > 0 or coalesce(visual, 100) < 40 or coalesce(structural, 100) < 40 then 0.0 else greatest(0.0, least(100 - 2.5 * minor, visual, structural, responsive)) end::double as score from (select {', '.join(_MEASURES)} from orders)""")
def fidelity_score(spark, sf_dir):
    """100 less 2.5 a minor error, at most what was measured, 0 with a critical error or a measure under 40."""
    x = table(spark, sf_dir, "orders").selectExpr(*_MEASURES)
    critical = (F.col("critical") > 0) | (F.coalesce("visual", F.lit(100.0)) < 40) | (F.coalesce("structural", F.lit(100.0)) < 40)
    capped = F.greatest(F.lit(0.0), F.least(100 - 2.5 * F.col("minor"), "visual", "structural", "responsive"))
    return x.select("o_orderkey", F.when(critical, 0.0).otherwise(capped).alias("score"))


#: What was placed for each order: values asked for, landed, texts applied and present, and scores.
_PLACED = (
    "o_orderkey", "cast(1 + o_custkey % 8 as int) as requested", "cast(floor((1 + o_custkey % 8) * (o_orderkey % 3) / 2.0) as int) as landed", "cast(o_orderkey % 4 as int) as text_applied", "cast(case when o_custkey % 2 = 0 then o_orderkey % 4 else 0 end as int) as text_present",
    "cast(20 * (o_custkey % 6) as double) as safety", "cast(case when o_orderkey % 5 > 0 then o_orderkey % 101 end as double) as structural", "cast(case when o_orderkey % 2 > 0 then 88 end as double) as visual",
)


@query("repurpose_composite", f"""select o_orderkey, case when landed = 0 then 0.0 else round(list_avg(list_filter([landed * 100.0::double / requested, case when text_applied > 0 then text_present * 100.0::double / text_applied else 100.0 end, safety, structural, visual], lambda x: x is not null)), 2) end::double as success
  from (select {', '.join(_PLACED)} from orders)""")
def repurpose_composite(spark, sf_dir):
    """Mean of the scores that there are; 0 if nothing landed; presence is 100 if only media were placed."""
    x = table(spark, sf_dir, "orders").selectExpr(*_PLACED)
    scores = F.array_compact(F.array(F.col("landed") * 100.0 / F.col("requested"), F.when(F.col("text_applied") > 0, F.col("text_present") * 100.0 / F.col("text_applied")).otherwise(100.0), "safety", "structural", "visual"))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, v: a + v) / F.size(scores)
    return x.select("o_orderkey", F.when(F.col("landed") == 0, 0.0).otherwise(F.round(mean, 2)).alias("success"))


# Catalogue of templates: parts stand for templates, brands for their tags.
@query("template_search", "select p_partkey, row_number() over (order by p_size desc, p_partkey) as place from part where p_type like '%LARGE%' or p_brand = 'Brand#11'")
def template_search(spark, sf_dir):
    """Templates with any of the tags, by rank. Ranks are few and many templates share one: those before a rank are
    counted over ranks, and the rest of a place is a window within the rank."""
    x = table(spark, sf_dir, "part").where("p_type like '%LARGE%' or p_brand = 'Brand#11'").select("p_partkey", "p_size")
    ranks = x.groupBy("p_size").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("p_size")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    own = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey"))
    return x.join(ranks.select("p_size", before.alias("before")), "p_size").select("p_partkey", (F.col("before") + own).cast("long").alias("place"))


@query("template_tags_all", "select p_partkey from part where len(list_filter(['LARGE','Brand#11'], lambda t: not list_contains([p_type, p_brand], t))) = 0")
def template_tags_all(spark, sf_dir):
    """Templates with all of the tags."""
    wanted = F.array(F.lit("LARGE"), F.lit("Brand#11"))
    return table(spark, sf_dir, "part").where(F.size(F.array_except(wanted, F.array("p_type", "p_brand"))) == 0).select("p_partkey")


@query("catalog_upsert", "select p_name, max(p_partkey) as p_partkey, arg_max(p_size, p_partkey) as p_size from part group by p_name")
def catalog_upsert(spark, sf_dir):
    """The latest registration of each name."""
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.max("p_partkey").alias("p_partkey"), F.max_by("p_size", "p_partkey").alias("p_size"))


@query("catalog_boost", "select p_partkey, case when p_partkey % 10 = 0 then p_size + 5 else p_size end as p_size from part")
def catalog_boost(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 5).otherwise(F.col("p_size")).alias("p_size"))


@query("version_numbers", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version from orders")
def version_numbers(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", n.cast("long").alias("version"))


@query("version_rollback", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as v from orders) where v = 2")
def version_rollback(spark, sf_dir):
    """The payload of a version; keys without it have none."""
    return version_numbers(spark, sf_dir).where("version = 2").select("o_custkey", "o_orderkey")


@query("version_diff", """with a as (select l_orderkey as k, l_linenumber as i, l_quantity as v from lineitem where l_orderkey % 2 = 0), b as (select l_orderkey - 1 as k, l_linenumber as i, l_quantity as v from lineitem where l_orderkey % 2 = 1)
  select coalesce(a.k, b.k) as k, coalesce(a.i, b.i) as i, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as change from a full join b on a.k = b.k and a.i = b.i where a.v is distinct from b.v""")
def version_diff(spark, sf_dir):
    """Paths added, removed and changed between two versions: a full outer join."""
    x = table(spark, sf_dir, "lineitem")
    a = x.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("v"), F.lit(True).alias("old"))
    b = x.where("l_orderkey % 2 = 1").select((F.col("l_orderkey") - 1).alias("k"), F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("w"), F.lit(True).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return a.join(b, ["k", "i"], "full_outer").where(~F.col("v").eqNullSafe(F.col("w"))).select("k", "i", change.alias("change"))


@query("component_ids", "select p_partkey, case when row_number() over (partition by p_name order by p_partkey) = 1 then p_name else p_brand || '_' || p_name end as component_id from part")
def component_ids(spark, sf_dir):
    """The first of a name keeps it; others take their source's name before it."""
    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(n == 1, F.col("p_name")).otherwise(F.concat("p_brand", F.lit("_"), "p_name")).alias("component_id"))


@query("projects_by_date", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as place from orders")
def projects_by_date(spark, sf_dir):
    """An owner's projects, the newest first."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", n.cast("long").alias("place"))


@query("owner_projects", "select c.c_custkey, count(o.o_orderkey)::bigint as projects from customer c left join orders o on o.o_custkey = c.c_custkey group by 1")
def owner_projects(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("projects"))


@query("contiguity", "select l_orderkey, list_sort(list(l_linenumber)) = range(1, count(*)::int + 1) as contiguous from lineitem group by 1")
def contiguity(spark, sf_dir):
    """Whether a group's numbers are 1 to n; numbers are aggregated, not collected."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"))
    return x.select("l_orderkey", ((F.col("a") == 1) & (F.col("b") == F.col("n")) & (F.col("d") == F.col("n"))).alias("contiguous"))


@query("knowledge_entries", "select o_orderkey, category, key, value from (select o_orderkey, unnest(['status','priority']) as key, unnest([o_orderstatus, o_orderpriority]) as value, unnest(['state','misc']) as category from orders)")
def knowledge_entries(spark, sf_dir):
    """A row for each (category, key, value) of an entry."""
    pairs = F.array(F.struct(F.lit("state").alias("category"), F.lit("status").alias("key"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("misc").alias("category"), F.lit("priority").alias("key"), F.col("o_orderpriority").alias("value")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(pairs))


@query("validation_summary", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F')::bigint as hard, count(*) filter (where o_orderstatus = 'P')::bigint as soft, count(*) filter (where o_orderstatus = 'O')::bigint as success, count(*) filter (where o_orderstatus = 'F') = 0 as is_valid from orders group by 1")
def validation_summary(spark, sf_dir):
    of = lambda s: F.count_if(F.col("o_orderstatus") == s)
    x = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(of("F").alias("hard"), of("P").alias("soft"), of("O").alias("success"))
    return x.withColumn("is_valid", F.col("hard") == 0)


@query("metrics_rollup", "select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderstatus, o_orderpriority)")
def metrics_rollup(spark, sf_dir):
    """Report totals at each level."""
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("region_sources", "select r.r_name, n.n_name, count(s.s_suppkey)::bigint as sources, round(sum(s.s_acctbal), 2) as balance from region r join nation n on n.n_regionkey = r.r_regionkey join supplier s on s.s_nationkey = n.n_nationkey group by 1, 2")
def region_sources(spark, sf_dir):
    """Sources by region and nation: two dimension tables of fixed size, joined without a hint."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy("r_name", "n_name").agg(F.count("s_suppkey").alias("sources"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("catalog_from_nothing", "select p_brand as id, arg_max(p_name, p_partkey) as url, arg_max(p_size, p_partkey)::int as rank from part group by 1")
def catalog_from_nothing(spark, sf_dir):
    """A catalogue that isn't there yet, and what it holds after all parts have been put into it, the latest of each brand."""
    from loomspan.sources.tables import read_or_empty, upsert

    schema = "id string, url string, rank int, at long"
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("url"), F.col("p_size").cast("int").alias("rank"), F.col("p_partkey").alias("at"))
    return upsert(read_or_empty(spark, f"{sf_dir}/catalogue.parquet", schema), parts, "id", "at").drop("at")


@query("report_written", "select o_orderstatus as run_id, o_orderpriority as priority, count(*) as orders from orders group by all")
def report_written(spark, sf_dir):
    """A report of each run, written as JSON, a folder for each, and read again."""
    import uuid

    from loomspan.session import shared_folder
    from loomspan.sources.tables import write_report

    path = f"{shared_folder(spark)}/reports/{uuid.uuid4().hex}"
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("run_id"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"))
    write_report(counts, path)
    return spark.read.schema("priority string, orders long, run_id string").json(path).select("run_id", "priority", "orders")


@query("report_markdown", """select 1 as place, '| region | nations |' as line union all select 2, '|---|---|' union all
  select 2 + row_number() over (order by r_name), '| ' || r_name || ' | ' || n || ' |' from (select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1)""")
def report_markdown(spark, sf_dir):
    """A small aggregate as a table in Markdown, a row a line."""
    from loomspan.sources.tables import markdown

    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = markdown(nations.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations")).orderBy("region")).split("\n")
    return spark.createDataFrame(list(enumerate(lines, 1)), "place long, line string")
