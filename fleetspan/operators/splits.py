"""Train, validation and test assignment as a ``split`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import epoch_seconds
from ..functions.chance import hash_uniform
from .ordered import DAY, numbered


def temporal_split(df: DataFrame, ts: str, key: Sequence[str], test: float = 0.2, val: float = 0.1, seconds: int = DAY) -> DataFrame:
    """Oldest rows train, newest test, by exact counts ``int(n * share)``."""
    order = [ts, *key]
    # the last int(n*test) rows are test; the int(n*val) rows before them are validation
    n = df.where(F.col(ts).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    cuts = cut_rows(df, order, seconds, n.select((F.col("n") - F.floor(F.col("n") * test) - F.floor(F.col("n") * val)).alias("a"), (F.col("n") - F.floor(F.col("n") * test)).alias("b")))
    here = F.struct(*order)
    tagged = df.where(F.col(ts).isNotNull()).withColumn("_cuts", cuts.select(F.struct("c0", "c1")).scalar())
    before = lambda c: F.col(c).isNull() | (here < F.col(c))
    return tagged.withColumn("split", F.when(before("_cuts.c0"), "train").when(before("_cuts.c1"), "val").otherwise("test")).drop("_cuts")


def cut_rows(df: DataFrame, order: Sequence[str], seconds: int, ranks: DataFrame) -> DataFrame:
    """(order columns) of the rows at the 0-based ranks given by the columns of the one-row ``ranks``.

    Time buckets are counted first; only the buckets holding a cut are ranked, so the fact table is
    neither sorted nor shuffled as a whole.
    """
    ts, m = order[0], len(ranks.columns)
    narrow = df.where(F.col(ts).isNotNull()).select(*order, F.floor(epoch_seconds(ts) / seconds).alias("_slot"))
    per = narrow.groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(per, [], ["_slot"], F.floor(F.col("_slot") / 1000), pos=None, running={"_before": "_n"})
    wanted = ranks.select(F.array(*[F.col(c).cast("long") for c in ranks.columns])).scalar()
    tagged = ranked.withColumn("_want", wanted).select("_slot", "_n", "_before", F.posexplode("_want").alias("_i", "_at"))
    hit = tagged.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n")))
    inside = narrow.join(hit.select("_slot", "_i", (F.col("_at") - F.col("_before")).alias("_skip")), "_slot", "inner")
    fine = numbered(inside, ["_i"], order, epoch_seconds(ts), pos="_p")
    rows = fine.where(F.col("_p") == F.col("_skip")).select("_i", F.struct(*order).alias("_c"))
    return rows.groupBy().agg(*[F.max(F.when(F.col("_i") == i, F.col("_c"))).alias(f"c{i}") for i in range(m)])


def random_split(df: DataFrame, key: str | Sequence[str], test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    u = hash_uniform("split", key, seed)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, val: float = 0.1, seed: int = 42, parts: int = 256) -> DataFrame:
    """Exact shares within each class: the class's rows are numbered in hash order, in hash buckets."""
    tagged = df.withColumn("_u", hash_uniform("split", key, seed))
    ranked = numbered(tagged, [label], ["_u", key], F.floor(F.col("_u") * parts), pos="_p", size="_n")
    n_test, n_val = F.floor(F.col("_n") * test), F.floor(F.col("_n") * val)
    split = F.when(F.col("_p") < n_test, "test").when(F.col("_p") < n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_u", "_p", "_n")


def group_split(df: DataFrame, group: str, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Whole groups on one side."""
    u = hash_uniform("group_split", group, seed)
    return df.where(F.col(group).isNotNull()).withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def leak_report(df: DataFrame, ts: str | Column) -> DataFrame:
    """Rows and time span per side, and whether the side starts no earlier than train ends."""
    t = F.col(ts) if isinstance(ts, str) else ts
    g = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(t).alias("first_ts"), F.max(t).alias("last_ts"))
    end = g.where("split = 'train'").select("last_ts").scalar()
    return g.withColumn("_end", end).withColumn("after_train", (F.col("split") == "train") | (F.col("first_ts") >= F.col("_end"))).drop("_end")
