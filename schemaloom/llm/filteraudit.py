"""Filter interaction audit: every order of a set of filters, by a recursive CTE.

Which filters a document fails is a mask of bits, so all orders can be told
from *mask cells*: the number of documents of a part with one mask (at most
2^filters cells a part). A recursive CTE extends filter prefixes with unused
letters, joined to the masks that occur and carrying the bits applied so far;
each level of the recursion says of its step, mask by mask, what is kept,
removed or was removed before. Its size is fixed by the filters (326 prefixes
x 32 masks for five), whatever the corpus; the cells of all parts are joined
to it by mask and summed.

Only (text key, id, part, mask) of each row leaves the scan. "Identical to an
earlier text" needs the smallest id of every text: a partial aggregate, then a
join on (text key, id), a key that copies of one text don't share; so no group
of copies lands in one task. Rows with an earlier twin are what is left when
the first ones are taken from the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

LETTERS = "ABCDE"
#: Rows of a label table up to which it is broadcast (counted first).
BROADCAST_ROWS = 50_000
#: Parts that one hot id is spread over where labels are joined by a shuffle.
SALTS = 8

_TWIN = 1 << LETTERS.index("E")

STEPS = """
WITH RECURSIVE letter AS (
  SELECT letter, CAST(1 << at AS INT) AS bit
  FROM (SELECT posexplode(split('{letters}', '')) AS (at, letter)) WHERE letter <> ''
),
step (prefix, letter, step, bit, before, applied, mask) AS (
  SELECT CAST('' AS STRING), CAST('' AS STRING), 0, 0, 0, 0, mask FROM {{masks}}
  UNION ALL
  SELECT concat(s.prefix, l.letter), l.letter, s.step + 1, l.bit, s.applied, s.applied | l.bit,
         s.mask
  FROM step s JOIN letter l ON s.applied & l.bit = 0
)
SELECT prefix, letter, step, mask,
       mask & applied = 0 AS is_kept,
       mask & bit <> 0 AND mask & before = 0 AS is_removed,
       mask & bit <> 0 AND mask & before <> 0 AS is_redundant,
       mask = bit AS is_unique
FROM step WHERE step > 0
""".format(letters=LETTERS)


def failed(text: Column) -> Column:
    """Bits of the filters A-D that a text fails (null: empty).

    A: fewer than 50 words; B: distinct words under 65 % of words; C: more
    than 5 % of the code points in A-Z; D: holds one of # $ % & * |.
    """
    text = F.coalesce(text, F.lit(""))
    # staged in an array of one, so that the words are split once
    words = F.array(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    counted = F.transform(words, lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    by_words = F.transform(counted, lambda c: F.when(c["n"] < 50, 1).otherwise(0)
                           + F.when(c["d"].cast("long") * 100 < c["n"].cast("long") * 65, 2)
                           .otherwise(0))[0]
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return (by_words + F.when(capitals * 100 > F.length(text).cast("long") * 5, 4).otherwise(0)
            + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with _good and _toxic (0/1): a label row of the id says so.

    A label table counted to be small is broadcast; else the join shuffles,
    with each id spread over SALTS tasks by the text, rows without id apart.
    It has to be told to: by the size of its file, which holds an id in a few
    bytes and once for all salts, a table of millions would pass for small.
    """
    of_id = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"),
                  F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic"))
             .where("_good + _toxic > 0"))
    of_id = saved(of_id, "audit_labels")
    if of_id.count() <= BROADCAST_ROWS:
        out = docs.join(F.broadcast(of_id), "_id", "left")
    else:
        salt = F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")
        spread = of_id.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        named = docs.where(F.col("_id").isNotNull()).withColumn("_salt", salt)
        out = (named.join(spread.hint("merge"), ["_id", "_salt"], "left").drop("_salt")
               .unionByName(docs.where(F.col("_id").isNull()), allowMissingColumns=True))
    return out.fillna(0, ["_good", "_toxic"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of a part that fail just the
    filters of ``mask``, and how many of them are labelled good or toxic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(docs.select(
        F.col("doc_id").alias("_id"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("_key"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        failed(F.col("text")).alias("mask")), "audit_rows")
    # repeated rows (the same id, text and part) become one row with a count
    rows = rows.groupBy("_id", "_key", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = saved(labelled(rows, labels).select(
        "_id", "_key", "part", "mask", "n", (F.col("n") * F.col("_good")).alias("good"),
        (F.col("n") * F.col("_toxic")).alias("toxic")), "audit_flags")
    first = (rows.where(F.col("_id").isNotNull()).groupBy("_key")
             .agg(F.min("_id").alias("_id")))
    first = rows.join(first, ["_key", "_id"], "left_semi")
    sums = ("n", "good", "toxic")

    def entry(df: DataFrame, bits: int, sign: int) -> DataFrame:
        return df.select("part", (F.col("mask") + bits).alias("mask"),
                         *[(F.col(c) * sign).alias(c) for c in sums])
    named = rows.where(F.col("_id").isNotNull())
    parts = (entry(rows.where(F.col("_id").isNull()), 0, 1)  # an id that is null is never larger
             .unionByName(entry(first, 0, 1))
             .unionByName(entry(named, _TWIN, 1)).unionByName(entry(first, _TWIN, -1)))
    return (parts.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in sums])
            .where("n > 0"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order (all 120 of ABCDE) and step (1-5).

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic; other
    columns are ignored. Columns: part (source, null: ''), filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    Null texts are empty and identical to empty ones. A row without doc_id is
    no twin of another and none is a twin of it; rows equal in id and text are
    all first. Repeated labels of an id count once: one with quality = 1 makes
    it good, one with toxic = 1 toxic. No documents: no rows.
    """
    spark = docs.sparkSession
    cell = saved(cells(docs, labels), "audit_cells")
    step = saved(spark.sql(STEPS, masks=cell.select("mask").distinct()), "audit_prefixes")
    orders = (step.where(F.col("step") == len(LETTERS)).select(F.col("prefix").alias("filter_order"))
              .distinct())

    def total(flag: str, what: str = "n") -> Column:
        return F.sum(F.when(F.col(flag), F.col(what)).otherwise(0))
    found = (cell.join(F.broadcast(step), "mask")  # fixed size: prefixes x masks
             .groupBy("part", "prefix", "letter", "step")
             .agg(total("is_kept").alias("kept"), total("is_removed").alias("removed"),
                  total("is_redundant").alias("redundant"),
                  total("is_unique").alias("unique_fails"),
                  total("is_removed", "good").alias("good_lost"),
                  total("is_removed", "toxic").alias("toxic_lost")))
    found = saved(found, "audit_steps")
    # a prefix of k letters begins (filters - k)! orders
    share = (found.groupBy("part", "letter")
             .agg(F.sum(F.col("removed") * F.factorial(F.lit(len(LETTERS)) - F.col("step")))
                  .alias("shapley")))
    ahead = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS))))
                          .alias("step")).withColumn("prefix", F.expr("left(filter_order, step)"))
    return (found.join(share, ["part", "letter"])
            .join(F.broadcast(ahead), ["prefix", "step"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant",
                    "unique_fails", "good_lost", "toxic_lost", "shapley"))
