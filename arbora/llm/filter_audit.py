"""Filter interaction audit: what each of five filters removes, in every order that they may take.

Built-in expressions turn a document into a mask of the filters that it fails; a document meets the
others only through the smallest id of its text. What remains of a part are 32 cells, from which
all orders are enumerated: the texts are read once, whatever the number of orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import SPACE, text_of

#: The filters; the place of a letter is its bit in a mask.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Failure conditions: fewest words, least percentage of distinct words, largest one of capitals, characters.
FEWEST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
#: What the counts of a part and mask are.
COUNTS = ("n", "good", "toxic")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The bits of the filters that look at the text alone: A, B, C and D."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = {
        "A": n < FEWEST_WORDS,
        "B": F.lit(100).cast("long") * distinct < F.lit(DISTINCT).cast("long") * n,
        "C": F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(CAPITALS).cast("long") * F.length(text),
        "D": F.rlike(text, F.lit(SYMBOLS)),
    }
    return sum((F.when(c, bit(f)).otherwise(0) for f, c in fails.items()), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the set of filters they fail, at most 32 rows a part.

    A text is named by its SHA-256. Rows that agree in text, part and labels are counted before the smallest
    id of a text is looked up, so a text that a third of all rows share is a few rows by then.
    """
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    text = text_of("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    by_id = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marked = by_id.join(own, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # of rows that agree so far, those with the smallest id may pass E, and those without an id do
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first")
    texts = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), first)
    lowest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passes = F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0) + F.col("unnamed")
    split = texts.withColumn("lowest", lowest).select("part", "mask", "good", "toxic", "n", passes.alias("passes"))
    by_e = split.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("passes").alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))).alias("c"))
    share = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0)).alias(c)
    return by_e.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), share("good"), share("toxic"))


def _steps() -> Column:
    """All orders and steps as one array of constants: the filter's bit and those before it."""
    rows = [(o, k + 1, bit(o[k]), sum(map(bit, o[:k]))) for o in ORDERS for k in range(len(o))]
    return F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"x":{x}}}' for o, s, b, x in rows) + "]"), "array<struct<o:string,s:int,b:int,x:int>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each part, order of the five filters and step, zeros included. Null texts are empty, null
    parts the empty string. Rows that repeat an id count as rows, and don't make each other copies; a
    null id is smaller and larger than none, so such a row is no copy. Labels that repeat an id hold if
    any of them says so; null labels say nothing, and those of unknown ids are ignored. Texts are read
    whole, however long. An empty table gives no rows; other columns are ignored, whatever they are named.
    """
    held = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    each = held.withColumn("at", F.explode(_steps()))
    has, gone = lambda m: m.bitwiseAND(F.col("at.b")) != 0, lambda m: m.bitwiseAND(F.col("at.x")) != 0

    def total(test, of: str = "n", weight=lambda m: F.lit(1)) -> Column:  # noqa: ANN001
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(test(c["mask"]), c[of] * weight(c["mask"])).otherwise(0))

    removed = lambda m: has(m) & ~gone(m)
    # of the orders of all filters one in as many as a document fails has this filter before the other ones
    orders = lambda m: (F.lit(len(ORDERS)) / F.bit_count(m)).cast("long")
    return each.select(
        "part",
        F.col("at.o").alias("filter_order"),
        F.col("at.s").alias("step"),
        total(lambda m: ~has(m) & ~gone(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: has(m) & gone(m)).alias("redundant"),
        total(lambda m: m == F.col("at.b")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        total(has, weight=orders).alias("shapley"),
    )
