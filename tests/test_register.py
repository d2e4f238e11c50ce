from loomspan.functions.register import register
from loomspan.plans.evaluation import integrity, repurpose
from loomspan.operators import nodes
from tests.test_trees import HERO, PRICES


def test_sql_functions(spark):
    register(spark)
    spark.createDataFrame([(1, HERO)], "page_id long, html string").createOrReplaceTempView("some_pages")
    rows = spark.sql("select p.page_id, n.tag, n.path from some_pages p, lateral parse_html(p.html) n where n.tag = 'h1'").collect()
    assert [(r.page_id, r.path) for r in rows] == [(1, "root > section:nth-child(1) > h1:nth-child(1)")]
    assert spark.sql("select selector, prop, value from parse_css('a, b{color:red}')").count() == 2
    r = spark.sql("select structural_score(html, html) as s, sanitize_html('<p onclick=x>a</p>') as c from some_pages").first()
    assert (r.s, r.c) == (100.0, "<p>a</p>")


def test_repurpose(spark):
    found = {r.page_id: r for r in repurpose(spark.createDataFrame([(1, HERO), (2, PRICES), (3, "")], "page_id long, html string")).collect()}
    assert (found[1].n_fields, found[1].applied, found[1].present, found[1].structural, found[1].success) == (3, 3, 3, 100.0, 100.0)
    assert found[2].n_fields == 13 and found[2].applied == 10 and found[2].structural == 100.0
    assert (found[3].n_fields, found[3].success) == (0, 0.0)


def test_repurpose_beyond_the_cap(spark, tmp_path):
    """A page of more fields than the cap on slots: the queries count all, as their SQL does."""
    from loomspan.plans import QUERIES

    spark.createDataFrame([(5, "u", "<body>" + "<p>a</p>" * 310 + "</body>"), (7, "u", "<body><p>a</p></body>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: tuple(r)[1:] for r in QUERIES["page_repurpose_scores"](spark, str(tmp_path)).collect()}
    assert found == {5: (316, 316, 316, 0.0, 100.0, 75.0), 7: (2, 2, 2, 100.0, 100.0, 100.0)}
    corpus = QUERIES["corpus_repurpose_scores"](spark, str(tmp_path)).first()
    assert (corpus.pages, corpus.max_n_fields, corpus.min_safety, corpus.mean_success) == (2, 316.0, 0.0, 87.5)


def test_integrity(spark):
    page = '<body><a href="#gone">x</a><section data-section-index="1"><p>a</p></section><section data-section-index="3"></section></body>'
    kinds = {r.kind for r in integrity(nodes.parse_html(spark.createDataFrame([(1, page)], "page_id long, html string"))).collect()}
    assert kinds == {"orphaned anchor", "section numbers", "empty section"}
