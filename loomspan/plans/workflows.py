"""Queries over crawls, assets, submissions, layout changes and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators import nodes, sections, workflows
from loomspan.plans.values import DUCK_SHEETS, PORTFOLIO, sheet_imports
from loomspan.plans.pages import _DUCK_LINKS, links
from loomspan.plans.registry import query
from loomspan.session import checkpointed, table


_DUCK_NORMAL = r"(regexp_extract({0}, '^([a-zA-Z]+://[^/?#]+)', 1) || case when regexp_replace(regexp_extract({0}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') = '' then '/' else regexp_replace(regexp_extract({0}, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') end)"
_DUCK_SITE = "regexp_extract({0}, '^([a-zA-Z]+://[^/?#]+)', 1)"


def duck_crawl(allowed: str = "true") -> str:
    """Two levels of all pages' crawls; allowed is a condition on a link's target."""
    return rf"""with given as (select page_id, url, pos, case when href like '/%' and href not like '//%' then {_DUCK_SITE.format('url')} || href else href end as target from {_DUCK_LINKS}),
  edges as (select {_DUCK_NORMAL.format('url')} as source, {_DUCK_NORMAL.format('target')} as target, pos::int as pos from given where {_DUCK_SITE.format('url')} = {_DUCK_SITE.format('target')}),
  open_edges as (select * from edges where {allowed}),
  l0 as (select page_id as root, {_DUCK_NORMAL.format('url')} as url, 0 as depth, []::int[] as found from pages),
  l1 as (select root, target as url, 1 as depth, min(list_append(found, pos)) as found from l0 join open_edges on url = source group by 1, 2 having (root, target) not in (select (root, url) from l0)),
  l2 as (select root, target as url, 2 as depth, min(list_append(found, pos)) as found from l1 join open_edges on url = source group by 1, 2 having (root, target) not in (select (root, url) from l0 union all select (root, url) from l1)),
  placed as (select *, row_number() over (partition by root order by depth, found, url) as place from (select * from l0 union all select * from l1 union all select * from l2))
  select root, url, depth, place::int as place from placed where place <= 25"""


@query("crawl_frontier", duck_crawl())
def crawl_frontier(spark, sf_dir):
    """Pages reached from each page on its own site, breadth first."""
    return workflows.crawl(links(spark, sf_dir), table(spark, sf_dir, "pages").select(F.col("page_id").alias("root"), "url"))


@query("page_asset_references", """select page_id, count(*) filter (where t like 'script%src=%')::bigint as scripts, count(*) filter (where t like 'img%src=%')::bigint as images, count(*) filter (where regexp_matches(t,'^link.*stylesheet'))::bigint as sheets from
  (select page_id, unnest(list_concat(regexp_extract_all(html,'<([a-zA-Z][a-zA-Z0-9]*(?:\\s[^>]*)?)>',1), [''])) as t from pages) group by 1""".replace("\\\\", "\\"))
def page_asset_references(spark, sf_dir):
    """Files that each page refers to, by kind."""
    refs = workflows.asset_refs(table(spark, sf_dir, "pages"))
    of = lambda k: F.count_if(F.col("kind") == k)
    counted = refs.groupBy("page_id").agg(of("script").alias("scripts"), of("img").alias("images"), of("link").alias("sheets"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("scripts", "images", "sheets")}
    return table(spark, sf_dir, "pages").select("page_id").join(counted, "page_id", "left").withColumns(zero)


@query("css_closure", f"with recursive r as (select page_id as root, concat('s', page_id, '.css') as sheet from pages union select r.root, t.imported from r join {DUCK_SHEETS} t on t.sheet = r.sheet) select * from r")
def css_closure(spark, sf_dir):
    """Stylesheets that each page needs: its own and what that imports, over imports that form cycles."""
    entries = table(spark, sf_dir, "pages").select(F.col("page_id").alias("root"), F.concat(F.lit("s"), F.col("page_id").cast("string"), F.lit(".css")).alias("sheet"))
    return workflows.css_closure(checkpointed(sheet_imports(spark, sf_dir)), entries)


#: Fields and given values of each document's form, by its number: some are missing on one side.
_FORM = "select doc_id as page_id, unnest(['a', 'b', 'c']) as field_id, unnest(['text', 'image', 'url']) as t, unnest([true, doc_id % 2 = 0, false]) as required, unnest([400, null, 30]) as m from documents where doc_id % 7 > 0"
_SENT = """select doc_id as page_id, unnest(['a', 'b', 'z']) as field_id, unnest([case when doc_id % 5 = 0 then 'image' else 'document' end, 'image', 'text']) as gt, unnest([case when doc_id % 6 = 0 then ' ' else coalesce(text, '') end, 'x.png', 'lost']) as value, unnest([doc_id % 3 > 0, doc_id % 4 > 0, doc_id % 11 = 0]) as sent from documents"""


@query("submission_validation", f"""select coalesce(f.page_id, g.page_id) as page_id, coalesce(f.field_id, g.field_id) as field_id, case when f.field_id is null then 'hard' when g.field_id is null and required then 'hard' when g.field_id is null then 'success'
  when (t = 'image') <> (gt = 'image') then 'hard' when required and trim(value) = '' then 'hard' when length(value) > m or contains(lower(value),'lorem ipsum') then 'soft' else 'success' end as severity from ({_FORM}) f full join (select * from ({_SENT}) where sent) g using (page_id, field_id)""")
def submission_validation(spark, sf_dir):
    """Forms of documents against what was sent for them: fields that nobody knows, missing ones, types, lengths."""
    docs = table(spark, sf_dir, "documents")
    rows = lambda *r: F.inline(F.array(*(F.expr(f"struct({x})") for x in r)))
    form = rows(
        "'a' as field_id, 'text' as field_type, true as required, 400 as max_length", "'b' as field_id, 'image' as field_type, doc_id % 2 = 0 as required, cast(null as int) as max_length", "'c' as field_id, 'url' as field_type, false as required, 30 as max_length",
    )
    fields = docs.where("doc_id % 7 > 0").select(F.col("doc_id").alias("page_id"), form)
    sent = rows(
        "'a' as field_id, case when doc_id % 5 = 0 then 'image' else 'document' end as type, case when doc_id % 6 = 0 then ' ' else coalesce(text, '') end as value, doc_id % 3 > 0 as sent",
        "'b' as field_id, 'image' as type, 'x.png' as value, doc_id % 4 > 0 as sent", "'z' as field_id, 'text' as type, 'lost' as value, doc_id % 11 = 0 as sent",
    )
    given = docs.select(F.col("doc_id").alias("page_id"), sent).where("sent").drop("sent")
    return workflows.validate(fields, given).select("page_id", "field_id", "severity")


@query("page_substitution_map")
def page_substitution_map(spark, sf_dir):
    """A sample value for every text field of every page, as substitutions."""
    fields = sections.fields(checkpointed(nodes.parse_html(table(spark, sf_dir, "pages"))))
    none = F.lit(None)
    given = fields.where("field_type <> 'image'").select("page_id", "field_id", F.concat(F.lit("Sample "), "label").alias("value"), none.cast("int").alias("instance"), none.cast("string").alias("group_id"))
    return workflows.substitutions(fields, given)


@query("page_portfolio")
def page_portfolio(spark, sf_dir):
    return workflows.portfolio(sections.fields(checkpointed(nodes.parse_html(table(spark, sf_dir, "pages")))), PORTFOLIO)


_STYLED = """concat(replace(replace(html, '</body>', ''), '</html>', ''), repeat('<p style="color:red">x</p>', cast(page_id % 4 as int)), repeat('<div style="top:0">y</div>', cast(page_id % 3 as int)), '</body></html>')"""


@query("page_minted_classes", "select page_id, style, n from (select page_id, unnest(['color:red', 'top:0']) as style, unnest([page_id % 4, page_id % 3])::bigint as n from pages) where n > 1")
def page_minted_classes(spark, sf_dir):
    """Classes for inline styles that repeat, on pages that have some of either of two."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_STYLED).alias("html"))
    return workflows.minted_classes(nodes.parse_html(pages)).select("page_id", "style", "n")


def _order_events(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.row_number().over(_by_line()).alias("n"))
    kinds = F.when(F.col("n") == 1, F.array(F.lit("enqueue"), F.lit("claim"))).when(F.col("n") == 4, F.array(F.lit("complete"))).otherwise(F.array(F.lit("heartbeat")))
    return x.select("job_id", "n", F.posexplode(kinds).alias("i", "kind")).select("job_id", (F.col("n") * 10 + F.col("i")).alias("seq"), (F.col("n") * 60.0).alias("t"), "kind", F.lit("w").alias("token"))


@query("order_job_states", """select l_orderkey as job_id, case when count(*) > 3 then 'completed' else 'running' end as status from lineitem group by 1""")
def order_job_states(spark, sf_dir):
    """Orders as jobs: queued and claimed by the first line, each further line a beat, the fourth completes."""
    return workflows.job_states(_order_events(spark, sf_dir)).select("job_id", "status")


#: Lines of an order as a job's events: claimed by the first, then beats; the fourth completes it. The order's customer is
#: the project. Jobs of few lines go on, fail for good (two lines), or fall silent and are open again.
_JOB_OF = "case when n > 3 then 'completed' when n = 2 then 'failed' end"


@query("project_job_updates", f"""with jobs as (select l_orderkey as job, count(*) as n from lineitem group by 1),
  ended as (select o_custkey, o_orderkey, {_JOB_OF} as status, o_orderkey * 1000.0 + case when n > 3 then 240 else 120 end as ended, round(o_totalprice / 1000, 2) as fidelity from jobs join orders on o_orderkey = job),
  last as (select o_custkey, arg_max(status, (ended, o_orderkey)) as status, arg_max(fidelity, (ended, o_orderkey)) filter (status = 'completed') as fidelity, max(ended) filter (status = 'completed') as completed_at
  from ended where status is not null group by 1)
  select c_custkey as project_id, coalesce(status, 'processing') as status, fidelity, completed_at from customer left join last on o_custkey = c_custkey""")
def project_job_updates(spark, sf_dir):
    """Customers as projects of which orders are the jobs: the state of each after all that happened to its jobs."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("project_id"), F.round(F.col("o_totalprice") / 1000, 2).alias("fidelity"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.row_number().over(_by_line()).alias("n"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("lines"))
    kinds = F.when(F.col("n") == 1, F.array(F.lit("enqueue"), F.lit("claim"))).when(F.col("n") == 4, F.array(F.lit("complete"))).when(F.col("lines") == 2, F.array(F.lit("fail_permanent"))).otherwise(F.array(F.lit("heartbeat")))
    events = lines.select("job_id", "n", F.posexplode(kinds).alias("i", "kind"))
    events = events.select("job_id", (F.col("n") * 10 + F.col("i")).alias("seq"), (F.col("job_id") * 1000.0 + F.col("n") * 60).alias("t"), "kind", F.lit("w").alias("token"))
    jobs = workflows.job_states(events).join(orders, "job_id")
    nothing = F.lit(None)
    projects = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("project_id"), F.lit("processing").alias("status"), nothing.cast("double").alias("fidelity"), nothing.cast("double").alias("completed_at"), nothing.cast("struct<ended:double,job_id:bigint>").alias("at")
    )
    return workflows.apply_updates(projects, workflows.project_updates(jobs)).select("project_id", "status", "fidelity", "completed_at")


@query("job_states_at", """select l_orderkey as job_id, case when count(*) > 3 then 'completed' when 1900 - 60 * count(*) > 1800 then 'pending' else 'running' end as status, case when count(*) > 3 then 240.0::double end as ended from lineitem group by 1""")
def job_states_at(spark, sf_dir):
    """Orders as jobs, seen 1900 seconds on: those that had one beat alone have been silent for too long and are open again."""
    return workflows.job_states(_order_events(spark, sf_dir), until=1900.0).select("job_id", "status", "ended")


def _by_line():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
