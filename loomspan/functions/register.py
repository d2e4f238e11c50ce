"""SQL names for the library's Python-backed functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomspan.operators import markup, nodes, styles


def register(spark: SparkSession) -> None:
    """parse_html(html) and parse_css(css) as table functions; sanitize_html(html), structural_score(a, b) as scalars.

    Table functions join laterally: select p.page_id, n.* from pages p, lateral parse_html(p.html) n."""

    class ParseHtml:
        def eval(self, html: str):
            for r in nodes.rows(0, html or ""):
                yield r[1], r[2], r[3], r[4], r[5], r[8], r[9], r[12]

    class ParseCss:
        def eval(self, css: str):
            for number, kind, media, selector, _, prop, value in styles.rules_of(css or ""):
                yield number, kind, media, selector, prop, value

    html = F.udtf(ParseHtml, returnType="node_id int, parent_id int, depth int, subtree_end int, child_idx int, tag string, path string, text_content string")
    css = F.udtf(ParseCss, returnType="rule_no int, kind string, media string, selector string, prop string, value string")
    spark.udtf.register("parse_html", html)
    spark.udtf.register("parse_css", css)

    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        counts = [markup.structural_counts(x or "", y or "") for x, y in zip(a, b)]
        return pd.Series([round(m / max(n, 1) * 100, 2) for n, m in counts])

    def clean(html: pd.Series) -> pd.Series:
        return pd.Series([markup.sanitize(x or "") for x in html])

    spark.udf.register("structural_score", F.pandas_udf(score, "double"))
    spark.udf.register("sanitize_html", F.pandas_udf(clean, "string"))
