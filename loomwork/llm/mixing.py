"""Mixing sources to target weights by systematic sampling.

A source's target is its share of the budget; every document of a source is expected
``target / source size`` times. Expected copies are summed within the source, in an order by
size, from one offset per source, and a document is emitted once for every integer boundary
that its part of the sum crosses. So a document is taken at most ``ceil(cap)`` times, and a
source's words miss its target by about one long document.

Only DataFrame functions are used. The order inside a source is (size band, salt, size, hash);
sums over whole bands and salts come from a small table, so no window holds a whole source.

Defined results: null text has size 0; a null source is a source of its own, ordered last;
rows that repeat are documents of their own; an empty table gives an empty result; further
columns are carried along, but those named size, source_size, target, copies or copy are replaced; helper
columns have names that start with ``__mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import cut

#: White space as the contracts on words have it.
WORDS = r"[^\x20\x09-\x0D]+"
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hashed(*parts: Column) -> Column:
    """32 bits of an MD5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes``: source, source_size. Adds target: the budget by weight, at most cap times the size.

    Resharing what exceeds a cap until nothing does ends at ``min(cap * size, level * weight)``
    with one level for all; it is found by going through sources in order of cap * size / weight.
    ``sizes`` has a row per source, which is what the single ordered window here runs over.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("__mix_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    out = sizes.withColumn("weight", w).withColumn("__mix_ratio", full / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # The first source whose cap is not reached sets the level for itself and all after it.
    out = out.withColumn("__mix_level", level)
    out = out.withColumn("__mix_level", F.min(F.when(F.col("__mix_level") < F.col("__mix_ratio"), F.struct("__mix_ratio", "source", "__mix_level"))).over(everything)["__mix_level"])
    level = F.col("__mix_level")
    return out.select("source", "source_size", "weight", F.when(level.isNull() | (F.col("__mix_ratio") <= level), full).otherwise(level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7, size: Column | None = None, key: str = "doc_id", group: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and copies (times the mix takes the row)."""
    named = docs.withColumns(
        {
            "__mix_size": word_count(F.col("text")) if size is None else size,
            "__mix_hash": hashed(F.lit(f"{seed}/"), F.coalesce(F.col(key).cast("string"), F.lit(""))),
            "__mix_null": F.col(group).isNull(),
            "__mix_name": F.coalesce(F.col(group), F.lit("")),
        }
    )
    fresh = ("size", "source_size", "target", "copies")
    named = named.drop(*fresh, "copy")
    # Bands split powers of two in four, so that they hold sizes within a fifth of each other.
    bits = F.length(F.bin(F.col("__mix_size") + 4))
    quarter = F.call_function("shiftright", F.col("__mix_size") + 4, bits - 3).bitwiseAND(F.lit(3))
    named = named.withColumn("__mix_band", (bits * 4 + quarter).cast("int")).withColumn("__mix_salt", (F.col("__mix_hash") % SALTS).cast("int"))
    part = ["__mix_null", "__mix_name", "__mix_band", "__mix_salt"]
    parts = cut(named.groupBy(*part).agg(F.count(F.lit(1)).alias("__mix_docs"), F.sum("__mix_size").alias("__mix_words")))
    sizes = parts.groupBy(*part[:2]).agg(F.sum("__mix_words").alias("source_size"), F.sum("__mix_docs").alias("__mix_all"))
    wanted = targets(sizes.select(F.when(~F.col("__mix_null"), F.col("__mix_name")).alias("source"), "source_size"), weights, share, cap)
    rates = wanted.select(F.col("source").isNull().alias("__mix_null"), F.coalesce("source", F.lit("")).alias("__mix_name"), "source_size", "target", (F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("__mix_rate"))
    along = Window.partitionBy(*part[:2]).orderBy("__mix_band", "__mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("__mix_start", F.coalesce(F.sum("__mix_docs").over(along), F.lit(0))).join(rates, part[:2]).drop("__mix_docs", "__mix_words")
    within = Window.partitionBy(*part).orderBy("__mix_size", "__mix_hash", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = named.withColumn("__mix_at", F.count(F.lit(1)).over(within))
    offset = hashed(F.lit(f"{seed}/"), F.when(F.col("__mix_null"), "-").otherwise("+"), F.col("__mix_name")) / F.lit(float(1 << 32))
    reach = lambda k: F.floor(F.col("__mix_rate") * (F.col("__mix_start") + k) + offset)
    out = numbered.join(starts, part).withColumn("copies", reach(F.col("__mix_at")) - reach(F.col("__mix_at") - 1))
    kept = [F.col(c) for c in docs.columns if c not in (*fresh, "copy")]
    return out.select(*kept, F.col("__mix_size").alias("size"), "source_size", "target", "copies")


def mixed_rows(docs: DataFrame, **how: object) -> DataFrame:
    """The mix itself: each document as often as it is taken, with ``copy`` counting from 1."""
    return mix(docs, **how).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP1_SQL = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5('7/' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
r as (select *, source_size * 2.0::double as full_size, source_size * 2.0::double / weight as ratio, 1.5::double * sum(source_size) over () as budget from w),
l as (select *, (budget - coalesce(sum(full_size) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
m as (select min_by(level, ratio) as level from l where level < ratio),
t as (select l.source, source_size, case when m.level is null or ratio <= m.level then full_size else m.level * weight end as target from l cross join m),
b as (select *, length(bin(size + 4)) as bits, h % 64 as salt from d),
o as (select b.*, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    ('0x' || substr(md5('7/' || case when b.source is null then '-' else '+' || b.source end), 1, 8))::bigint / 4294967296.0::double as off,
    row_number() over (partition by b.source order by bits * 4 + ((size + 4) >> (bits - 3)) % 4, salt, size, h, doc_id nulls first) as k
  from b join t on b.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor(rate * k + off) - floor(rate * (k - 1) + off)) * size)::bigint as taken from o
"""
