"""Read-outs of loadings (feature, k, v) along genomic coordinates (feature, chrom, mid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: hg38 centromere midpoints in Mb (fixed values).
CENTROMERE_MB = {
    "chr1": 123.4, "chr2": 93.9, "chr3": 90.9, "chr4": 50.0, "chr5": 48.8, "chr6": 59.8, "chr7": 60.1, "chr8": 45.2,
    "chr9": 43.0, "chr10": 39.8, "chr11": 53.4, "chr12": 35.5, "chr13": 17.7, "chr14": 17.2, "chr15": 19.0, "chr16": 36.8,
    "chr17": 25.1, "chr18": 18.5, "chr19": 26.2, "chr20": 28.1, "chr21": 12.0, "chr22": 15.0, "chrX": 60.6, "chrY": 10.4,
}
#: Chromosomes whose p arms are not called (fixed values).
ACROCENTRIC = ("chr13", "chr14", "chr15", "chr21", "chr22")
#: Lag bins in bp (fixed values).
LAG_BINS = ((0, 2_000), (2_000, 5_000), (5_000, 20_000), (20_000, 50_000), (50_000, 200_000), (200_000, 1_000_000))
#: Names of features: chromosome, start, end (fixed value).
NAME = r"^(chr[^:_\-]+)[:_\-](\d+)[\-_:](\d+)$"


def parse_names(names: DataFrame) -> DataFrame:
    """feature, chrom, start, end, mid from names like chr1:10-20; a name of another form raises an error that has it."""
    name = F.when(F.col("name").rlike(NAME), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("not a genomic feature name: "), F.col("name"))))
    out = names.withColumn("name", name)
    part = lambda k: F.regexp_extract("name", NAME, k)
    return out.select("feature", part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")).withColumn("mid", F.expr("(start + `end`) div 2"))


def genomic_place(chrom: Column) -> Column:
    """chr1 to chr22, chrX and chrY in this order, others after them (by name, which is to be ordered by next)."""
    number = F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CENTROMERE_MB) for x in (c, i)]), chrom)
    return F.coalesce(number, F.lit(len(CENTROMERE_MB)))


def genomic_order(coords: DataFrame) -> DataFrame:
    """chrom, place: the chromosomes of ``coords`` numbered in genomic order."""
    # A row per chromosome.
    names = coords.select("chrom").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(genomic_place(F.col("chrom")), "chrom")) - 1)


def arms(coords: DataFrame) -> DataFrame:
    """``coords`` with arm: q on acrocentric chromosomes, ? on unknown ones, else by the centromere's midpoint."""
    mb = F.create_map(*[F.lit(x) for pair in CENTROMERE_MB.items() for x in pair])
    centre = F.try_element_at(mb, F.col("chrom")) * 1e6
    return coords.withColumn("arm", F.when(F.col("chrom").isin(*ACROCENTRIC), "q").when(centre.isNull(), "?").when(F.col("mid") < centre, "p").otherwise("q"))


def zscores(loadings: DataFrame) -> DataFrame:
    stats = loadings.groupBy("k").agg(F.avg("v").alias("__m"), F.stddev_pop("v").alias("__s"))
    return loadings.join(F.broadcast(stats), "k").select("feature", "k", ((F.col("v") - F.col("__m")) / F.greatest("__s", F.lit(1e-300))).alias("z"))


def winsorise(loadings: DataFrame, n_sd: float = 4.0) -> DataFrame:
    """Values clipped to the median plus or minus n_sd robust deviations, with whether they were."""
    middle = loadings.groupBy("k").agg(F.median("v").alias("__mid"))
    off = loadings.join(F.broadcast(middle), "k")
    spread = off.groupBy("k").agg((F.median(F.abs(F.col("v") - F.col("__mid"))) * 1.4826).alias("sd"))
    out = off.join(F.broadcast(spread), "k")
    lo, hi = F.col("__mid") - n_sd * F.col("sd"), F.col("__mid") + n_sd * F.col("sd")
    return out.select("feature", "k", F.least(F.greatest("v", lo), hi).alias("v"), ((F.col("v") < lo) | (F.col("v") > hi)).alias("clipped"), "sd")


def autocorrelation(loadings: DataFrame, coords: DataFrame, flat: float = 0.5) -> DataFrame:
    """Mean product of z-scores of features of a chromosome at each lag, as sums over range frames; no pair is made."""
    z = zscores(loadings).join(coords, "feature")
    along = Window.partitionBy("k", "chrom").orderBy("mid")
    sums = z.select("k", "z", *[c for i, (lo, hi) in enumerate(LAG_BINS) for w in [along.rangeBetween(lo + 1, hi)] for c in (F.sum("z").over(w).alias(f"s{i}"), F.count("z").over(w).alias(f"n{i}"))])
    means = [(F.coalesce(F.sum(F.col("z") * F.col(f"s{i}")), F.lit(0.0)) / F.greatest(F.sum(f"n{i}"), F.lit(1))).alias(f"lag{i}") for i in range(len(LAG_BINS))]
    ratio = F.col(f"lag{len(LAG_BINS) - 1}") / F.greatest("lag0", F.lit(1e-12))
    return sums.groupBy("k").agg(*means).withColumn("ratio", ratio).withColumn("flat", F.col("ratio") > flat)


def effects(loadings: DataFrame, regions: DataFrame, min_peaks: int = 50) -> DataFrame:
    """Mean loading of each region in deviations of its component; 0 for regions of few features. regions: feature, region."""
    sd = loadings.groupBy("k").agg(F.stddev_pop("v").alias("__sd"))
    by = loadings.join(regions, "feature").groupBy("k", "region").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(sd), "k").select("k", "region", "n", F.when(F.col("n") < min_peaks, 0.0).otherwise(F.col("m") / F.greatest("__sd", F.lit(1e-300))).alias("effect"))


def dominant(effect: DataFrame) -> DataFrame:
    """The region (a chromosome, or one with p or q) of the largest absolute effect of each component; ties go to the first in genomic order."""
    chrom = F.regexp_replace("region", "[pq]$", "")
    first = Window.partitionBy("k").orderBy(F.abs("effect").desc(), genomic_place(chrom), chrom, "region")
    return effect.withColumn("r", F.row_number().over(first)).where("r = 1").select("k", F.col("region").alias("dominant"), "effect")


def top_share(loadings: DataFrame, coords: DataFrame, n_top: int = 200, exclude: tuple[str, ...] = ("chrY",)) -> DataFrame:
    """Largest share that one chromosome has of the n_top most extreme features of either pole."""
    x = loadings.join(coords.where(~F.col("chrom").isin(*exclude)), "feature")
    poles = x.select("k", "feature", "chrom", F.explode(F.array(F.struct(F.lit(0).alias("pole"), F.col("v").alias("key")), F.struct(F.lit(1).alias("pole"), (-F.col("v")).alias("key")))).alias("p")).select("k", "feature", "chrom", "p.*")
    top = poles.withColumn("r", F.row_number().over(Window.partitionBy("k", "pole").orderBy(F.desc("key"), "feature"))).where(F.col("r") <= n_top)
    n = top.groupBy("k", "pole", "chrom").agg(F.count(F.lit(1)).alias("c"))
    all_of = Window.partitionBy("k", "pole")
    n = n.withColumn("share", F.col("c") / F.sum("c").over(all_of))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("share"), "pole", "chrom"))).where("r = 1").select("k", "chrom", "share", F.when(F.col("pole") == 0, "+").otherwise("-").alias("pole"))


def contiguous_run(loadings: DataFrame, coords: DataFrame, window: int = 100, exclude: tuple[str, ...] = ("chrY",)) -> DataFrame:
    """The run of neighbouring features with the largest absolute mean z-score of each component."""
    z = zscores(loadings).join(coords.where(~F.col("chrom").isin(*exclude)), "feature")
    run = Window.partitionBy("k", "chrom").orderBy("mid", "feature").rowsBetween(Window.currentRow, window - 1)
    x = z.select("k", "chrom", "mid", F.avg("z").over(run).alias("m"), F.count("z").over(run).alias("n"), F.last("mid").over(run).alias("end_mid")).where(F.col("n") == window)
    return x.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.round(F.abs("m"), 9).desc(), "chrom", "mid"))).where("r = 1").select("k", "chrom", F.col("mid").alias("start_mid"), "end_mid", F.abs("m").alias("run_z"), F.signum("m").alias("sign"))
