"""Filter interaction audit: what every order of five filters keeps, removes and hides, from one word per document.

A document's survival word has 32 bits: bit S says that it survives the subset S of the filters (bit 0 of S is filter A),
so it is the truth table of "no failing filter is in S". Positional popcounts of the words - how many have bit S -
are the survivors of all 32 subsets, and every order and step is read off them: what stands before a step is the
survivors of the filters applied so far.

The popcounts are taken where the words are, per part and label: a task adds its words by carry-save adders, three words
of one group at a time into a sum word and a carry word of double weight, until a group has one word of each weight; its
bits, weighted, are the group's counts. Only those 32 counts per group and task are shuffled. The 600 rows of a part
(120 orders of 5 steps) are masks known beforehand, looked up in its counts.

Filters: A fewer than 50 words; B fewer than 65 % of the words distinct; C more than 5 % of the code points in [A-Z];
D any of # $ % & * |; E a smaller id has the identical text. Texts meet by a 128-bit digest and their length. The
HOT texts with most copies (a bound on rows, not on the data) are broadcast with their smallest id; any other text has at most
1/HOT of all rows and goes through a join, to which copies of hot texts are dealt evenly instead of by their text.

Edge cases: a null text is the empty text (it fails A only); a null or empty source is the part ''; a row without id
has no smaller id and no labels, so it never fails E and counts in no ``lost`` column; rows with equal ids are documents
each, and of equal ids and texts none fails E for the other; a document with several label rows has a label if any row
does; very long texts are counted whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import staged

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
HOT = 1000
ROWS = 1 << 18  # words that a task adds up at a time
SPACE = r"[\x20\x09-\x0D]+"


def survival_words(failed: np.ndarray) -> np.ndarray:
    """uint32 words from bit sets of failing filters: bit S is set where no failing filter is in S."""
    table = np.array([sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)], np.uint32)
    return table[failed]


def positional_popcounts(words: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """(n_groups, 32) counts of the words of each group that have a bit, by carry-save adders over all groups at once."""
    counts = np.zeros((n_groups, 32), np.int64)
    bits = np.arange(32, dtype=np.uint32)
    weight, now = 1, (np.asarray(words, np.uint32), np.asarray(group, np.int64))
    while len(now[0]):
        carried: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(now[1], kind="stable")
        word, own = now[0][order], now[1][order]
        while True:
            size = np.bincount(own, minlength=n_groups)
            if size.max() <= 1:
                break
            adders = -(-size // 3)  # a group's last adder may lack words: they are 0
            place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(3 * (np.cumsum(adders) - adders), size)
            three = np.zeros(3 * int(adders.sum()), np.uint32)
            three[place] = word
            a, b, c = three[0::3], three[1::3], three[2::3]
            own = np.repeat(np.arange(n_groups), adders)
            word, carry = a ^ b ^ c, (a & b) | (c & (a ^ b))
            some = carry != 0
            carried.append((carry[some], own[some]))
        counts[own] += ((word[:, None] >> bits) & np.uint32(1)).astype(np.int64) * weight
        now = tuple(np.concatenate(x) for x in zip(*carried)) if carried else (word[:0], own[:0])
        weight *= 2
    return counts


def _failures(text: Column) -> list[Column]:
    """The conditions A to D over a text that isn't null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def on_words(w: Column) -> Column:
        return F.struct((F.size(w) < 50).alias("a"), (100 * F.size(F.array_distinct(w)) < 65 * F.size(w)).alias("b"))

    by_words = F.get(F.transform(F.array(words), on_words), F.lit(0))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [by_words.a, by_words.b, 100 * upper.cast("long") > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def failing_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hot: int = HOT) -> DataFrame:
    """(doc_id, part, failed) per document: the bit set of the filters that it fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    set_bits = sum((c.cast("int") * (1 << i) for i, c in enumerate(_failures(F.col("text")))), F.lit(0))
    rows = staged(rows.select("doc_id", "part", set_bits.alias("failed"), F.concat(F.unhex(F.md5("text")), F.unhex(F.hex(F.octet_length("text")))).alias("digest")), "audited")
    copied = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL"), "copied_texts")
    most = copied.orderBy(F.desc("n"), "digest").limit(hot)
    known = rows.join(F.broadcast(most.select("digest", F.col("first").alias("hot_first"))), "digest", "left")
    # copies of hot texts are dealt by id: their key is no digest, so it meets nothing
    key = F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.encode(F.concat(F.lit("hot "), F.col("doc_id").cast("string")), "UTF-8"))
    found = known.withColumn("key", F.coalesce(key, F.lit(b""))).join(copied.select(F.col("digest").alias("key"), "first"), "key", "left")
    repeated = F.coalesce(F.col("doc_id") > F.coalesce("hot_first", "first"), F.lit(False))
    return found.select("doc_id", "part", (F.col("failed") + repeated.cast("int") * 16).alias("failed"))


def _labelled(failed: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(part, failed, label): label's bit 0 says quality 1, bit 1 toxic 1."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        (F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) + 2 * F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0))).alias("label"))
    marked = failed.where("doc_id IS NOT NULL").join(marks.where("label > 0"), "doc_id", "left").select("part", "failed", F.coalesce("label", F.lit(0)).alias("label"))
    return marked.unionByName(failed.where("doc_id IS NULL").select("part", "failed", F.lit(0).alias("label")))


def subset_survivors(marked: DataFrame) -> DataFrame:
    """(part, label, n0 ... n31): the survivors of each subset, from (part, failed, label) per document."""
    names = [f"n{s}" for s in range(SUBSETS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            part = rows.column("part").combine_chunks().dictionary_encode()
            key = part.indices.to_numpy() * 4 + rows.column("label").to_numpy()
            groups, group = np.unique(key, return_inverse=True)
            counts = positional_popcounts(survival_words(rows.column("failed").to_numpy()), group, len(groups))
            columns = [part.dictionary.take(pa.array(groups // 4)), pa.array((groups % 4).astype(np.int32))]
            return pa.record_batch([*columns, *[pa.array(counts[:, s]) for s in range(SUBSETS)]], names=["part", "label", *names])

        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= ROWS:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    schema = "part string, label int, " + ", ".join(f"{n} long" for n in names)
    return marked.select("part", "failed", "label").mapInArrow(count, schema).groupBy("part", "label").agg(*[F.sum(n).alias(n) for n in names])


def _steps() -> Column:
    """The 600 (order, step, filter, mask before, mask after) as one literal array."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for i, f in enumerate(order):
            rows.append(("".join(FILTERS[x] for x in order), i + 1, f, before, before | 1 << f))
            before |= 1 << f
    return F.from_json(F.lit(json.dumps([dict(zip("osfba", r)) for r in rows])), "array<struct<o:string,s:int,f:int,b:int,a:int>>")


def order_table(survivors: DataFrame) -> DataFrame:
    """The audit's rows from the subsets' survivors per part and label."""
    def total(having: int) -> Column:
        there = F.lit(True) if not having else F.col("label").bitwiseAND(F.lit(having)) > 0
        return F.array(*[F.sum(F.when(there, F.col(f"n{s}")).otherwise(0)) for s in range(SUBSETS)])

    n = len(FILTERS)
    parts = survivors.groupBy("part").agg(total(0).alias("n"), total(1).alias("good"), total(2).alias("toxic"))

    def shapley(f: int) -> Column:
        weight = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in range(SUBSETS) if not s >> f & 1}
        return sum((w * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | 1 << f))) for s, w in weight.items()), F.lit(0).cast("long"))

    parts = parts.withColumn("values", F.array(*[shapley(f) for f in range(n)])).withColumn("x", F.explode(_steps()))
    one = F.expr("shiftleft(1, x.f)")
    removed = F.get("n", F.col("x.b")) - F.get("n", F.col("x.a"))
    return parts.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), F.get("n", F.col("x.a")).alias("kept"), removed.alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", one) - removed).alias("redundant"),
        (F.get("n", F.lit(ALL).bitwiseXOR(one)) - F.get("n", F.lit(ALL))).alias("unique_fails"),
        (F.get("good", F.col("x.b")) - F.get("good", F.col("x.a"))).alias("good_lost"),
        (F.get("toxic", F.col("x.b")) - F.get("toxic", F.col("x.a"))).alias("toxic_lost"),
        F.get("values", F.col("x.f")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hot: int = HOT) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return order_table(subset_survivors(_labelled(failing_sets(docs, id_col, text_col, part_col, hot), labels, id_col)))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
      list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
  d AS (SELECT doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails FROM w),
  l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY 1),
  g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad
      FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
  f AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
  o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  s AS (SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, CAST(f AS INTEGER) AS step, o[f] AS filter,
      n, good, bad, fails, len(list_filter(o[1:f - 1], lambda x: fails[x])) > 0 AS gone, fails[o[f]] AS failing, len(list_filter(fails, lambda x: x)) AS n_fails
      FROM g, o, f),
  r AS (SELECT part, filter_order, step, filter,
      CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS removed,
      CAST(coalesce(sum(n) FILTER (WHERE failing AND gone), 0) AS BIGINT) AS redundant,
      CAST(coalesce(sum(n) FILTER (WHERE failing AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(sum(good) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS good_lost,
      CAST(coalesce(sum(bad) FILTER (WHERE failing AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE (filter), CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""
