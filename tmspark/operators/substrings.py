"""Which texts hold which short strings: a join by the rarest piece of each string instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(text: Column, size: Column | int) -> Column:
    """Structs (at, gram) of the pieces of ``size`` characters of a text, at positions from 1."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: F.struct(at.alias("at"), F.substring(text, at, size).alias("gram")))


def holding(lines: DataFrame, needles: DataFrame, by: list[str], line: str, needle: str, size: int = 3) -> DataFrame:
    """The rows of ``lines`` (columns ``by``, ``line``, ..) with each ``needle`` of the same ``by`` that its text holds.

    Texts are indexed by their pieces of ``size`` characters (shorter ones for shorter needles) and where these stand;
    pieces of no needle aren't kept. A needle is looked for by the one of its pieces that the fewest texts have, and is
    compared where that piece puts it. Empty needles and null texts are in no row."""
    wanted = needles.select(*by, F.col(needle).alias("_needle")).where("_needle <> ''").distinct()
    pieces = wanted.withColumn("_g", F.explode(_grams(F.col("_needle"), F.least(F.length("_needle"), F.lit(size)))))
    pieces = pieces.select(*by, "_needle", F.col("_g.gram").alias("_gram"), F.col("_g.at").alias("_off"))
    keyed = lines.withColumn("_key", F.xxhash64(*by, line))
    texts = keyed.select(*by, "_key", F.col(line).alias("_text")).where("_text is not null").distinct()
    every = F.concat(*[_grams(F.col("_text"), n) for n in range(1, size + 1)])
    index = texts.select(*by, "_key", F.explode(every).alias("_g")).select(*by, "_key", F.col("_g.gram").alias("_gram"), F.col("_g.at").alias("_at"))
    index = index.join(pieces.select(*by, "_gram").distinct(), [*by, "_gram"], "left_semi")
    often = index.groupBy(*by, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = pieces.join(often, [*by, "_gram"], "left").groupBy(*by, "_needle").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram", "_off")).alias("_r")
    )
    rarest = rarest.where("_r.n > 0").select(*by, "_needle", "_r._gram", "_r._off")
    met = index.join(rarest, [*by, "_gram"]).select(*by, "_needle", "_key", (F.col("_at") - F.col("_off") + 1).alias("_from")).where("_from >= 1")
    same = F.substring(F.col("_text"), F.col("_from"), F.length("_needle")) == F.col("_needle")
    found = met.join(texts, [*by, "_key"]).where(same).select(*by, "_key", "_text", "_needle").distinct()
    return keyed.join(found, [*by, "_key"]).where(F.col(line) == F.col("_text")).drop("_key", "_text").withColumnRenamed("_needle", needle)
