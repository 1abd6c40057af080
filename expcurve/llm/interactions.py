"""Audit of how filters interact: what each removes, alone and after the others.

A document's failures are a bit combination, one bit for a filter.  Filters
that look at one row are column expressions.  The filter for repeated texts is
an existential self-join: a row fails it if some row with the same hash, the
same text and a smaller id exists (left semi).  The right side of that join is
reduced to the smallest id of every text that more than one id has, so a text
that a third of all rows share is one row there, and rows of such a text are
spread over numbered parts, each meeting its own copy of that row.

The ids that fail it are united with the other failures, bit combinations are
counted by part (a few dozen rows for each), and every order of the filters is
read off those counts; no text and no id is looked at again.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expcurve.llm.common import split_by_keys, stored

ROWS_A_PART = 2000


def repeated_texts(texts: DataFrame, keys: DataFrame | None = None, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """The rows of ``texts`` (id, hash, text, ...) whose text a row with a smaller id has too.

    A null id is neither smaller nor larger than another, so its row is never
    returned.  Rows with one id don't make each other fail.  Which hashes more
    than one id has is found without texts (from ``keys``, the ids and hashes of
    the same rows, if given), so only texts of such hashes move.
    """
    named = texts.where("id is not null")
    several = ((named if keys is None else keys.where("id is not null")).groupBy("hash").agg(F.count("*").alias("_rows"), F.min("id").alias("_low"), F.max("id").alias("_high"))
               .where("_low < _high").select("hash", F.ceil(F.col("_rows") / rows_a_part).cast("int").alias("_parts")))
    several = stored(several, "several")
    possible = split_by_keys(named, F.col("hash"), several.select("hash"))[1]
    candidates = stored(possible.join(several, "hash"), "candidates")
    first = candidates.groupBy("hash", "text", "_parts").agg(F.min("id").alias("first_id"))
    first = first.select("hash", "text", "first_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    spread = candidates.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    keys = ["hash", "_part", "text"]
    later = [spread[k] == first[k] for k in keys] + [spread["id"] > first["first_id"]]
    return spread.join(first, later, "left_semi").select(*texts.columns)


def failure_counts(docs: DataFrame, filters: dict[str, Column], repeats: str | None, labels: DataFrame | None = None,
                   flags: dict[str, Column] | None = None, part: Column | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(part, mask, n, one count per flag): rows by part and combination of failures.

    ``filters`` maps a name to the condition under which a row fails; bit i of
    mask stands for the ith name, the last bit for ``repeats``, the name of the
    filter for repeated texts (none if null).  ``flags`` are conditions over
    ``labels``; a row has a flag if any label row with its id meets it.  A null
    text counts as empty and a null part as the empty string; a condition that
    is null counts as passed; a null id has no label and no repeat.
    """
    flags = flags or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    part = F.lit("") if part is None else F.coalesce(part.cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), text.alias("text"),
                       F.xxhash64(text).alias("hash"), F.length(text).alias("chars"))
    judged = stored(docs.select(F.col(id_col).alias("id"), part.alias("part"), F.xxhash64(text).alias("hash"),
                                F.length(text).alias("chars"), low.cast("int").alias("mask"), F.lit(1).alias("n")), "judged")
    key = ["id", "part", "hash", "chars"]
    marks = judged.groupBy(*key, "mask").agg(F.sum("n").alias("n"))
    if repeats is not None:
        again = repeated_texts(rows, judged).select(*key).distinct()
        bit = F.lit(1 << len(filters))
        # repeated rows have one mask, so a key's failures are the largest mask plus the repeat's bit
        marks = (marks.unionByName(again.select(*key, bit.alias("mask"), F.lit(0).cast("long").alias("n")))
                 .groupBy(*key).agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n")))
    counts = [F.sum("n").alias("n")]
    if labels is not None and flags:
        seen = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
            *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(f"flag_{k}") for k, c in flags.items()])
        seen = seen.where(" or ".join(f"flag_{k} = 1" for k in flags))
        marks = marks.join(seen, "id", "left")
    for k in flags:
        has = F.coalesce(F.col(f"flag_{k}"), F.lit(0)) if labels is not None else F.lit(0)
        counts.append(F.sum(F.col("n") * has).alias(k))
    return marks.groupBy("part", "mask").agg(*counts)


def order_audit(counts: DataFrame, names: str, flags: list[str]) -> DataFrame:
    """(part, filter_order, step, ...): what every filter does in every order, by part.

    ``counts`` is the result of ``failure_counts``, ``names`` the filters in
    order of their bits, one letter each.  kept and removed are counts after and
    in this step; redundant rows fail its filter but went earlier; unique_fails
    fail this filter alone; ``<flag>_lost`` are removed here and have the flag;
    shapley is its filter's removed rows summed over all orders.
    """
    size = len(names)
    bit = {c: 1 << i for i, c in enumerate(names)}
    steps = [(("".join(p)), s + 1, bit[p[s]], sum(bit[c] for c in p[:s]))
             for p in permutations(names) for s in range(size)]
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("own"),
                               F.lit(e).alias("earlier")) for o, s, b, e in steps])
    fields = ["n", *flags]
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *fields)).alias("_counts"))
    # the first of a row's k failures removes it, in size! / k of the orders
    share = F.array(*[F.lit(factorial(size) // k).cast("long") for k in range(1, size + 1)])

    def total(condition, field: str = "n", weight=None):
        def add(acc, m):
            value = m[field] if weight is None else m[field] * weight(m)
            return acc + F.when(condition(m.mask), value).otherwise(F.lit(0).cast("long"))
        return F.aggregate("_counts", F.lit(0).cast("long"), add)

    own, earlier = F.col("_step.own"), F.col("_step.earlier")

    def here(m):
        return (m.bitwiseAND(own) != 0) & (m.bitwiseAND(earlier) == 0)

    def orders(m):
        return F.get(share, F.bit_count(m.mask) - 1)

    audit = parts.select("part", "_counts", F.explode(table).alias("_step"))
    return audit.select(
        "part", F.col("_step.filter_order").alias("filter_order"), F.col("_step.step").alias("step"),
        total(lambda m: m.bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(earlier) != 0)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        *[total(here, f).alias(f"{f}_lost") for f in flags],
        total(lambda m: m.bitwiseAND(own) != 0, weight=orders).alias("shapley"))


def text_filters(text_col: str = "text") -> dict[str, Column]:
    """Conditions under which a text fails: A few words, B few different words, C many capitals, D odd signs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return {"A": F.size(words) < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
            "D": text.rlike(r"[#$%&*|]")}


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to D and E (repeated texts) over ``documents`` by source, with the good and
    toxic documents that each step loses.  An empty table gives no rows."""
    counts = failure_counts(docs, text_filters(), "E", labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1},
                            part=F.col("source"))
    return order_audit(counts, "ABCDE", ["good", "toxic"])
