"""Source divergence audit by joint count histograms.

How far the terms of two sources of one language diverge is a sum of f over all kept terms, and f depends on a term's
two counts alone. So terms are never looked at by pairs of sources in full: every term is a short vector of the sources
that have it, equal vectors are counted once with their multiplicity, and each pair of sources tallies how many terms
have which two counts. Only counts above zero are tallied; the cells with a zero are implied. With J the tally of terms
that both sources have and H that of one source alone, cell (c, 0) holds H(c) less all of J(c, .), and cell (0, 0) what
is then left of the language's V terms. f is evaluated once a cell, in whole numbers, times the cell's multiplicity.

Documents are counted where they lie: a task holds counts of at most HELD terms and passes them on, so what is shuffled
is counts and never text, and a source with a third of all rows is a few counts a task more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import keep, passing

#: A term in UTF-8: every byte of a character above 0x7F is one of these.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_NO_TERM = re.compile(rb"[^A-Za-z\x80-\xff]")
LEAST_DOCUMENTS = 3
MOST_TERMS = 200
SCALE = 1_000_000_000
#: Terms that a task counts before it passes them on, and bytes of a text that are cut into terms at once.
HELD, PIECE = 1 << 19, 1 << 22


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in parts of some PIECE bytes, cut where no term is."""
    at = 0
    while at < len(data):
        cut = _NO_TERM.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def _flush(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in held.items():
        terms = [b"", *n]  # the empty term stands for the group itself, which may have no terms
        columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string())]
        columns += [pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang, source) -> (lang, source, term, n, docs): occurrences, and documents with the term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        texts, langs, sources = batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for text, lang, source in zip(texts, langs, sources):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for piece in _pieces(text.as_py().lower()):  # bytes: A-Z alone become lower case
                found = TERM.findall(piece)
                n.update(found)
                seen.update(found)
            docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from _flush(held)
                held, size = {}, 0
    yield from _flush(held)


def term_vectors(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, vector) of docs(text, lang, source): each kept term of a language with the sources that have it and
    how often, by source: array of (source, n). The empty term's vector names all sources of a language."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = texts.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    # Tasks have added up what they could: both groupings go by one exchange of what they pass on.
    counts = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return vectors.where((F.col("docs") >= least) | (F.col("term") == "")).select("lang", "term", "vector")


def _share(count: str, total: str, terms: str) -> F.Column:
    """p = 1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    return F.expr(f"1 + cast({count} + 1 as decimal(20,0)) * cast({SCALE} as decimal(10,0)) div cast({total} + {terms} as decimal(20,0))")


def _f(p: str, q: str) -> F.Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _groups(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, total, terms): occurrences of kept terms in each group and kept terms in its language;
    (lang, total, terms) of the languages."""
    entries = vectors.where("term <> ''").select("lang", F.explode("vector").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("total"))
    terms = vectors.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("terms"))
    every = vectors.where("term = ''").select("lang", F.explode("vector.source").alias("source"))
    groups = keep(every.join(entries, ["lang", "source"], "left").join(terms, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms"))
    return groups, groups.groupBy("lang", "terms").agg(F.sum("total").alias("total"))


def _joint(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, ca, cb, m): for each of pairs, m kept terms have the counts ca and cb in its sources, zeros too."""
    patterns = keep(vectors.where("term <> ''").groupBy("lang", "vector").agg(F.count("*").alias("m")))
    first = patterns.select("lang", "m", F.posexplode("vector").alias("i", "x"), "vector")
    both = first.select("lang", "m", "x", F.explode(F.expr("slice(vector, i + 2, size(vector))")).alias("y"))
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("ca"), F.col("y.n").alias("cb")).agg(F.sum("m").alias("m"))
    alone = patterns.select("lang", "m", F.explode("vector").alias("e")).groupBy("lang", "e.source", "e.n").agg(F.sum("m").alias("m"))
    of_a, of_b = alone.withColumnRenamed("source", "a").join(pairs, ["lang", "a"]), alone.withColumnRenamed("source", "b").join(pairs, ["lang", "b"])

    def cells(df: DataFrame, *cell: str) -> DataFrame:
        return df.select("lang", "a", "b", F.inline(F.expr(f"array({', '.join(f'struct({ca} as ca, {cb} as cb, {m} as m)' for ca, cb, m in map(str.split, cell))})")))

    tallied = cells(both, "ca cb m", "ca 0L -m", "0L cb -m", "0L 0L m")
    tallied = tallied.unionByName(cells(of_a, "n 0L m", "0L 0L -m")).unionByName(cells(of_b, "0L n m", "0L 0L -m")).unionByName(cells(pairs, "0L 0L terms"))
    return tallied.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")


def _pair_rows(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    x = groups.select("lang", "terms", F.col("source").alias("a"), F.col("total").alias("na"))
    y = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("nb"))
    pairs = keep(x.join(y, "lang").where("a < b"))
    joint = _joint(vectors, pairs).join(pairs, ["lang", "a", "b"]).withColumn("p", _share("ca", "na", "terms")).withColumn("q", _share("cb", "nb", "terms"))
    times = [F.sum((F.col("m") * _f(*of)).cast("decimal(38,0)")).cast("long").alias(name) for name, of in (("ab", "pq"), ("ba", "qp"))]
    sums = pairs.select("lang", "a", "b").join(joint.groupBy("lang", "a", "b").agg(*times), ["lang", "a", "b"], "left").fillna(0, ["ab", "ba"])
    rows = sums.select("lang", F.inline(F.expr("array(struct(a as source, b as item, ab as value), struct(b as source, a as item, ba as value))")))
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def _term_rows(vectors: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """Kept terms that a group has more of than its language."""
    whole = F.aggregate("vector.n", F.lit(0).cast("long"), lambda total, n: total + n)
    x = vectors.where("term <> ''").withColumn("c", whole).join(langs, "lang").withColumn("q", _share("c", "total", "terms")).select("lang", "term", "q", F.inline("vector"))
    x = x.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms")).where("p > q")
    return x.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each (lang, source) of docs(text, lang, source, ...) how far each
    other source of the language is from it (part pair, all of them), and the terms that set it apart from its language
    (part term, the first most_terms).

    A null text, lang or source is an empty one. Terms are runs of letters A-Z, a-z and characters above 0x7F, A-Z in
    lower case; a language keeps those of at least `least` documents, rows of one id counting each. Sources without
    terms are groups, too; without kept terms their values are 0. Ties are ranked by item. Texts are counted whole, a
    few million bytes at a time; repeated rows count as often as they are there. An empty table gives an empty table.
    Other columns are not read."""
    with passing() as stay:
        vectors = keep(term_vectors(docs, least))
        groups, langs = _groups(vectors)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = _pair_rows(vectors, groups).withColumn("rank", F.row_number().over(order))
        terms = _term_rows(vectors, groups, keep(langs)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
        return stay(keep(pairs.unionByName(terms)))
