"""Queries over rasters: 64 numbers of a vector stand for an 8 by 8 grey picture."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.plans.registry import query
from loomspan.session import table

#: How far two pixels may be apart and still count as alike, on these pictures' scale.
TOLERANCE = 0.06


def average(v: str) -> F.Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(v)


def _pixels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))


_DUCK_PIXELS = "(select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding,1) - 1 as pos from embeddings)"


@query("average_hash_bits", "select vec_id, array_to_string(list_transform(embedding, lambda x: case when x::double >= list_avg(embedding) then '1' else '0' end),'') as bits from embeddings")
def average_hash_bits(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").withColumn("mean", average("embedding"))
    return x.select("vec_id", F.array_join(F.transform("embedding", lambda p: F.when(p.cast("double") >= F.col("mean"), "1").otherwise("0")), "").alias("bits"))


def hamming(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


@query("hash_hamming", """with h as (select vec_id, array_to_string(list_transform(embedding, lambda x: case when x::double >= list_avg(embedding) then '1' else '0' end),'') as bits from embeddings) select a.vec_id, hamming(a.bits, b.bits)::int as distance from h a join h b on b.vec_id = a.vec_id + 1""")
def hash_hamming(spark, sf_dir):
    """How many hash bits differ between a picture and the next one."""
    h = average_hash_bits(spark, sf_dir)
    after = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("other"))
    return h.join(after, "vec_id").select("vec_id", hamming("bits", "other").alias("distance"))


def compare(x: DataFrame) -> DataFrame:
    """similarity (%), mae and mse of x(..., a, b), arrays of one length; null where the sizes differ."""
    diff = F.zip_with("a", "b", lambda p, q: p.cast("double") - q.cast("double"))
    fits = F.size("a") == F.size("b")
    mean = lambda f: F.aggregate("d", F.lit(0.0), lambda s, v: s + f(v)) / F.size("d")
    x = x.withColumn("d", F.when(fits, diff))
    return x.withColumns({"similarity": mean(lambda v: F.when(F.abs(v) <= TOLERANCE, 1.0).otherwise(0.0)) * 100, "mae": mean(F.abs), "mse": mean(lambda v: v * v)}).drop("a", "b", "d")


@query("pixel_fidelity", f"""select a.vec_id, list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda p: case when abs(p[1]::double - p[2]::double) <= {TOLERANCE} then 100.0::double else 0.0::double end)) as similarity,
  list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::double - p[2]::double))) as mae, list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double))) as mse from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def pixel_fidelity(spark, sf_dir):
    """Share of pixels within the tolerance, and errors, between a picture and the next one."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return compare(a.join(b, "vec_id"))


@query("raster_volatility", "select label, sum(case when mx-mn > 0.6 then 1 else 0 end)::bigint as volatile_pixels from (select label,pos,max(v) mx,min(v) mn from (select label, unnest(embedding) as v, generate_subscripts(embedding,1) as pos from embeddings) group by 1,2) group by 1")
def raster_volatility(spark, sf_dir):
    """Pixels that differ between renders of one label."""
    spread = _pixels(spark, sf_dir).groupBy("label", "pos").agg((F.max("v") - F.min("v")).alias("spread"))
    return spread.groupBy("label").agg(F.count_if(F.col("spread") > 0.6).alias("volatile_pixels"))


_DUCK_PAIRS = f"""select a.label, count(*)::bigint as pairs, avg(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: case when abs(p[1]::double - p[2]::double) <= {TOLERANCE} then 1 else 0 end)) * 100.0 / len(a.embedding)) as agreement
  from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by 1"""


def agreement(pixels: DataFrame) -> DataFrame:
    """(label, renders, pairs, agreement): the mean share of alike pixels over all pairs of a label's renders, in percent.

    Pairs are counted, not made: a value agrees with those up to TOLERANCE below it. Equal values are counted together
    first; values are dealt over bins as wide as the tolerance, and each bin also sees the one below it, so that a
    window holds two bins of one pixel of a label. What is up to TOLERANCE below a value is a difference of two running
    counts: up to the value, and before a mark that each value sets at the lower end of what it agrees with. Both are
    one pass in order, however many values a bin has."""
    values = pixels.groupBy("label", "pos", F.col("v").cast("double").alias("v")).agg(F.count("*").alias("m"))
    cell = F.floor(F.col("v") / (TOLERANCE * 1.001)).cast("long")
    seen = values.withColumn("bin", F.explode(F.array(cell, cell + 1))).withColumn("own", F.col("bin") == cell)
    # Marks (at = 0) come before equal values (at = 1), so that a value at the very end counts.
    points = seen.select("label", "pos", "bin", "v", F.lit(1).alias("at"), "m", "own")
    marks = seen.where("own").select("label", "pos", "bin", (F.col("v") - TOLERANCE).alias("v"), F.lit(0).alias("at"), "m", "own")
    below = Window.partitionBy("label", "pos", "bin").orderBy("v", "at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("at") == 1, F.col("m")).otherwise(0)).over(below), F.lit(0))
    counted = points.unionByName(marks).withColumn("before", before).where("own")
    pairs = F.when(F.col("at") == 1, F.col("m") * F.col("before") + F.expr("m * (m - 1) div 2")).otherwise(-F.col("m") * F.col("before"))
    alike = counted.groupBy("label").agg(F.sum(pairs).alias("alike"))
    sizes = pixels.groupBy("label").agg(F.countDistinct("vec_id").alias("renders"), F.countDistinct("pos").alias("n_pixels"))
    x = sizes.join(alike, "label").withColumn("pairs", F.expr("renders * (renders - 1) div 2"))
    return x.select("label", "renders", "pairs", F.when(F.col("pairs") == 0, 100.0).otherwise(F.col("alike") * 100.0 / (F.col("pairs") * F.col("n_pixels"))).alias("agreement"))


@query("raster_consensus_pairs", f"select label, pairs, round(agreement, 6) as agreement from ({_DUCK_PAIRS})")
def raster_consensus_pairs(spark, sf_dir):
    """Mean agreement of all pairs of renders of one label."""
    return agreement(_pixels(spark, sf_dir)).where("pairs > 0").select("label", "pairs", F.round("agreement", 6).alias("agreement"))


#: Fixed value: mean agreement, in percent, from which the renders of a label count as one.
CONSENSUS = 95.0


@query("raster_consensus", f"select label, renders, coalesce(agreement, 100) >= {CONSENSUS} as consensus from (select label, count(*)::bigint as renders from embeddings group by 1) left join ({_DUCK_PAIRS}) using (label)")
def raster_consensus(spark, sf_dir):
    """Whether the renders of a label agree; one alone does."""
    return agreement(_pixels(spark, sf_dir)).select("label", "renders", (F.col("agreement") >= CONSENSUS).alias("consensus"))


@query("raster_mean_color", "select vec_id, list_avg(list_transform(embedding, lambda x: x::double)) as mean from embeddings")
def raster_mean_color(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", average("embedding").alias("mean"))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7, span: float = 255.0) -> float:
    """Structural similarity of two grey pictures in percent: means over edge-padded windows, by integral images."""
    if a.shape != b.shape:
        return float("nan")
    a, b = a.astype(np.float64), b.astype(np.float64)
    half = window // 2

    def local_mean(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, half, mode="edge")
        total = np.zeros((padded.shape[0] + 1, padded.shape[1] + 1))
        total[1:, 1:] = padded.cumsum(0).cumsum(1)
        h, w = x.shape
        return (total[window : window + h, window : window + w] - total[:h, window : window + w] - total[window : window + h, :w] + total[:h, :w]) / window**2

    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    ma, mb = local_mean(a), local_mean(b)
    va, vb, cov = local_mean(a * a) - ma * ma, local_mean(b * b) - mb * mb, local_mean(a * b) - ma * mb
    score = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return round(max(0.0, float(score.mean())) * 100, 2)


@query("raster_ssim")
def raster_ssim(spark, sf_dir):
    """Structural similarity of each picture and the next one, in Arrow batches."""

    def score(batches):
        for pdf in batches:
            pairs = [(np.asarray(a), np.asarray(b)) for a, b in zip(pdf["a"], pdf["b"])]
            shape = lambda x: (x.reshape(8, -1) + 1) * 127.5
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "ssim": [ssim(shape(a), shape(b)) for a, b in pairs]})

    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").mapInPandas(score, "vec_id long, ssim double")


@query("palette_rank", f"""select color, n from (select color, n, row_number() over (order by n desc, color) as k from (select '#' || printf('%02x', cast(floor((v::double + 1) * 15.99) as int)) as color, count(*) as n from {_DUCK_PIXELS} group by 1)) where k <= 24""")
def palette_rank(spark, sf_dir):
    """The 24 most frequent tones: the cap is the feature."""
    tone = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.floor((F.col("v").cast("double") + 1) * 15.99).cast("int")), 2, "0")))
    return _pixels(spark, sf_dir).groupBy(tone.alias("color")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "color").limit(24)


@query("raster_delta", f"""select a.vec_id, sum(case when (a.v >= 0) <> (b.v >= 0) then 1 else 0 end)::bigint as crossings from {_DUCK_PIXELS} a join {_DUCK_PIXELS} b on b.vec_id = a.vec_id + 1 and a.pos = b.pos group by 1""")
def raster_delta(spark, sf_dir):
    """Pixels that cross zero between a picture and the next: a join by index."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    crossed = F.filter(F.zip_with("a", "b", lambda x, y: (x >= 0) != (y >= 0)), lambda z: z)
    return a.join(b, "vec_id").select("vec_id", F.size(crossed).cast("long").alias("crossings"))


_WEIGHTS = """(select i, j, w / sum(w) over (partition by i) as w from (select i, j, case when abs(x) >= 3 then 0 when x = 0 then 1 else sin(pi() * x) * sin(pi() * x / 3) * 3 / (pi() * pi() * x * x) end as w
  from (select i, j, (j + 0.5 - (i + 0.5) * {0}) / greatest({0}, 1) as x from (select unnest(range(8)) as i), (select unnest(range({1})) as j))))"""


@query("raster_compare_resized", f"""with pairs as (select a.vec_id, a.embedding as a, b.embedding as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
  tall as {_WEIGHTS.format("0.5::double", 4)}, wide as {_WEIGHTS.format("2::double", 16)},
  given as (select vec_id, (k // 16) as y, k % 16 as x, b[k + 1]::double as v from pairs, (select unnest(range(64)) as k) where vec_id % 3 > 0),
  columns_ as (select g.vec_id, g.y, w.i as x, sum(g.v * w.w) as v from given g join wide w on w.j = g.x group by all),
  resized as (select c.vec_id, t.i * 8 + c.x as k, sum(c.v * t.w) as v from columns_ c join tall t on t.j = c.y group by all union all select vec_id, k, b[k + 1]::double from pairs, (select unnest(range(64)) as k) where vec_id % 3 = 0)
  select p.vec_id, p.vec_id % 3 > 0 as resized, round(avg(case when abs(p.a[r.k + 1]::double - r.v) <= {TOLERANCE} then 100.0 else 0.0 end), 4) as similarity, round(avg(abs(p.a[r.k + 1]::double - r.v)), 6) as mae from pairs p join resized r using (vec_id) group by 1""")
def raster_compare_resized(spark, sf_dir):
    """Each picture against the next one, which two times out of three is twice as wide and half as high."""
    from loomspan.operators.rasters import compare_resized

    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    pairs = a.join(b, "vec_id").select(F.col("vec_id").alias("id"), "a", F.lit(8).alias("a_width"), "b", F.when(F.col("vec_id") % 3 == 0, 8).otherwise(16).alias("b_width"))
    out = compare_resized(pairs, TOLERANCE)
    return out.select(F.col("id").alias("vec_id"), "resized", F.round("similarity", 4).alias("similarity"), F.round("mae", 6).alias("mae"))
