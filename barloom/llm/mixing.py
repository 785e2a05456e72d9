"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every source gets a share of all words by its weight; no source gets more than a set multiple of what it has, and what
is above goes to the others by their weights until none is above. A document of a source is expected
target / source size times. These expectations are summed along the documents of the source, one random offset of the
source is added, and a document is taken once for each whole number that its stretch of the sum crosses.

The sum runs in exact decimals. Documents are ordered by size class, then by a hash of their id; a source's documents
are spread over (size class, hash) groups, each summed by itself, and the groups' totals are summed in order: a source
with a third of all rows is many tasks. The number of groups grows with the root of the table's rows, and so do both
the rows of a group and the groups of a source, which one task sums. In order of size, neighbours are of like size, so
the words taken follow the target closely. Sources themselves are ranked and levelled in one task, one row each.

Edge cases: a null or empty text is of size 0 and is drawn like others of its source; a null source is a source of its
own, the last; a source without words has the target 0 and is not drawn; rows repeated with one id are ordered by
their text and drawn separately; extra columns are kept, internal ones start with "_m_"; an empty table gives an
empty result. The same input gives the same result in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A target is at most so many times its source's size.
MOST = 3
#: One expected copy in the integer sums.
ONE = 10**15
#: Groups of one size class of a source, at least; a power of two up to 2^20, for at most that many squared rows.
SPREAD = 64
SEED = "mix"


def words_in(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def spread_of(rows: int) -> int:
    """Groups of a size class: the power of two from the root of the rows on."""
    out = SPREAD
    while out * out < rows and out < 1 << 20:
        out *= 2
    return out


def part_of(doc_id: Column, spread: int) -> Column:
    """The first five hexadecimal digits of the id's digest, modulo the power of two."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("int") % spread


def size_class(size: Column) -> Column:
    """Four classes between powers of two, from the first three binary digits."""
    digits = F.length(F.bin(size))
    found = F.when(size < 4, size.cast("int")).otherwise(digits * 4 + F.expr("cast(_m_size / pow(2, length(bin(_m_size)) - 3) as int) & 3"))
    return F.coalesce(found, F.lit(0))  # never null, or the join's check for nulls would count the words of each text five times more


def level_targets(sources: DataFrame) -> DataFrame:
    """sources (_m_key, _m_none, _m_source, _m_total) with _m_target, the levelled share of each, and its rate.

    Sources in the order in which they reach their most: the level is the first at which the next one does not.
    """
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy("_m_none", "_m_source")) - 1) % len(WEIGHTS) + 1).cast("int"))
    found = sources.withColumns({"_m_weight": weight.cast("double"), "_m_most": (F.col("_m_total") * MOST).cast("double"), "_m_all": F.sum("_m_total").over(everything).cast("double")})
    at = Window.orderBy(F.col("_m_most") / F.col("_m_weight"), "_m_none", "_m_source")
    found = found.withColumns(
        {
            "_m_at": F.row_number().over(at),
            "_m_before": F.coalesce(F.sum("_m_most").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_m_rest": F.sum("_m_weight").over(at.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("_m_level", (F.col("_m_all") - F.col("_m_before")) / F.col("_m_rest"))
    first = F.min(F.when(F.col("_m_level") * F.col("_m_weight") <= F.col("_m_most"), F.struct("_m_at", "_m_level"))).over(everything)
    target = F.least(F.col("_m_most"), first["_m_level"] * F.col("_m_weight"))
    found = found.withColumn("_m_target", target)
    rate = F.when(F.col("_m_total") > 0, F.floor(F.col("_m_target") / F.col("_m_total") * ONE)).otherwise(0)
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce("_m_source", F.lit("no source"))), 256), 1, 13), 16, 10).cast("long") % ONE
    return found.select("_m_key", "_m_total", "_m_target", rate.cast("decimal(38,0)").alias("_m_rate"), offset.cast("decimal(38,0)").alias("_m_offset"))


def draw(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with _m_words (the size), _m_of (the source's), _m_to (its target), _m_copies (how often the mix takes the row)."""
    of = {"_m_size": words_in(text), "_m_tie": F.xxhash64(text_of(text)), "_m_key": F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source)))}
    return drawn(docs.withColumns(of), doc_id, source, docs.columns)


def drawn(sized: DataFrame, doc_id: str, source: str, columns: list[str]) -> DataFrame:
    """The draw for rows whose words are counted: columns, and those that draw adds."""
    spread = spread_of(sized.count())
    based = sized.withColumns({"_m_class": size_class(F.col("_m_size")), "_m_part": part_of(F.col(doc_id), spread)})
    group = ["_m_key", "_m_class", "_m_part"]
    groups = based.select(*group, "_m_size", F.col(source).alias("_m_source")).groupBy(*group, "_m_source").agg(F.count("*").alias("_m_rows"), F.sum("_m_size").alias("_m_sum"))
    groups = cut(groups, narrow=True)
    sources = groups.groupBy("_m_key", "_m_source").agg(F.sum("_m_sum").alias("_m_total")).withColumn("_m_none", F.col("_m_source").isNull())
    along = Window.partitionBy("_m_key").orderBy("_m_class", "_m_part").rowsBetween(Window.unboundedPreceding, -1)
    here = (F.col("_m_rows") * F.col("_m_rate")).cast("decimal(38,0)")
    groups = groups.drop("_m_source").join(level_targets(sources), "_m_key").withColumn("_m_start", F.coalesce(F.sum(here).over(along), F.lit(0)) + F.col("_m_offset"))
    order = Window.partitionBy(*group).orderBy("_m_size", F.col(doc_id).asc_nulls_last(), "_m_tie")
    found = based.withColumn("_m_nth", F.row_number().over(order)).join(groups.select(*group, "_m_total", "_m_target", "_m_rate", "_m_start"), group)
    end = F.expr("cast(_m_start + cast(_m_nth * _m_rate as decimal(38,0)) as decimal(38,0))")
    begin = F.expr("cast(_m_start + cast((_m_nth - 1) * _m_rate as decimal(38,0)) as decimal(38,0))")
    copies = F.call_function("div", end, F.lit(ONE).cast("decimal(38,0)")) - F.call_function("div", begin, F.lit(ONE).cast("decimal(38,0)"))
    return found.select(*columns, F.col("_m_size").alias("_m_words"), F.col("_m_total").alias("_m_of"), F.col("_m_target").alias("_m_to"), copies.alias("_m_copies"))


def op2_rows(docs: DataFrame) -> DataFrame:
    found = draw(docs.select("doc_id", "text", "source"))
    return found.select("doc_id", F.col("_m_words").alias("size"), F.col("_m_of").alias("source_size"), F.col("_m_to").alias("target"), (F.col("_m_words") * F.col("_m_copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows: each row of docs as often as it is taken, with the columns of docs."""
    return draw(docs).where("_m_copies > 0").withColumn("_m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m_copies")))).select(*docs.columns)
