"""How the words of each source differ from those of the other sources and of its whole language.

``term_counts`` tokenises with one ``bytes.translate`` (letters lowered,
everything that parts terms blanked), ``bytes.split`` and a ``Counter`` per
document. Counters are added up in the task before anything is shuffled, so
the exchange carries at most one row for each term, group and flush. All
numbers after that are integers; nothing is rounded.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskgraph.llm.shared import cut

LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
#: Distinct (group, term) entries that a task adds up before it sends them on.
HELD = 400_000
#: Cells (sources x terms) of a block of terms, and of the counts that a task compares at once.
CELLS = 1 << 19


def terms(text: str | None) -> Counter:
    """How often each term, a maximal run of ASCII letters (lowered) and non-ASCII characters, stands in the text."""
    return Counter((text or "").encode("utf-8", "replace").translate(LOWER).split())


def _counted(batches, most):
    """Rows (lang, source, term, n, docs) of at most ``most`` entries added up; an entry's documents are counted from bit 40 on."""
    groups: dict[tuple, dict[bytes, int]] = {}
    size, one, low = 0, 1 << 40, (1 << 40) - 1

    def flushed():
        for (lang, source), held in groups.items():
            found, values = pa.array(list(held), pa.binary()).cast(pa.string()), np.fromiter(held.values(), np.int64, len(held))
            for at in range(0, len(held), 20_000):
                part = found[at : at + 20_000]
                v = values[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(v)), pa.repeat(source, len(v)), part, pa.array(v & low), pa.array(v >> 40)], ["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for text, lang, source in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            held = groups.setdefault((lang, source), {})
            size -= len(held)
            for term, n in terms(text.as_py()).items():
                held[term] = held.get(term, 0) + n + one
            size += len(held)
            if size >= most:
                yield from flushed()
                size = 0
    yield from flushed()


def term_counts(docs: DataFrame, min_docs: int = 3, held: int = HELD) -> DataFrame:
    """``lang, term, n, docs, sources``: the terms in at least ``min_docs`` documents of a language, with an array of (source, n) of those that have it.

    Null text, lang and source count as ''. A term's array has one entry for each source of its language at most.
    """
    read = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    counted = read.mapInArrow(lambda batches: _counted(batches, held), "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return by_term.where(F.col("docs") >= min_docs)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang, source, total, lang_total, v``: every occurring group with its kept occurrences, those of its language and the language's kept terms."""
    own = kept.select("lang", F.explode("sources").alias("s")).select("lang", "s.source", F.col("s.n").alias("n"))
    there = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    found = own.union(there.withColumn("n", F.lit(0).cast("long"))).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    return found.join(whole, "lang", "left").na.fill(0, ["lang_total", "v"])


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + v)), exact for any counts, as the product is a decimal of 38 digits."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + v).cast("decimal(20,0)"))


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); the square is at most 10^18 and so a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def source_terms(kept: DataFrame, groups: DataFrame, top: int = 200) -> DataFrame:
    """Of each group the ``top`` terms that it has and that it uses more than its language does."""
    each = kept.select("lang", "term", F.col("n").alias("all_n"), F.explode("sources").alias("s")).select("lang", "term", "all_n", "s.source", "s.n")
    met = each.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_total"), F.col("v")).alias("q"))
    found = met.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _shares(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    if n.size and int(n.max()) > 9_000_000_000:  # 10^9 n leaves 64 bits
        return (1 + SCALE * (n.astype(object) + 1) // below.astype(object)).astype(np.int64)
    return 1 + SCALE * (n + 1) // below


def _compared(batches, most):
    """Rows come by (lang, block): first its groups, then its terms. Sums of each pair of the block's language."""
    key, below, sums, waiting, rows = None, [], None, [], 0
    at: dict[str, int] = {}

    def compare():
        nonlocal sums, waiting, rows
        if sums is None:
            sums = np.zeros((len(at), len(at)), np.int64)
        if rows:
            counts = np.zeros((len(at), rows), np.int64)
            for start, row, column, n in waiting:
                counts[column, start + row] = n
            p = _shares(counts, np.array(below)[:, None])
            for i in range(len(at)):
                sums[i] += ((p[i] - p) ** 2 // p).sum(1)
        waiting, rows = [], 0

    def finished():
        if key is not None:
            compare()
            names = list(at)
            for i, source in enumerate(names):
                other = [j for j in range(len(names)) if j != i]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(other), pa.string()), pa.array([source] * len(other), pa.string()), pa.array([names[j] for j in other], pa.string()), pa.array(sums[i, other], pa.int64())], ["lang", "source", "item", "value"])

    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        edges = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        for a, b in zip(edges, edges[1:]):
            if keys[a] != key:
                yield from finished()
                key, below, sums, waiting, rows, at = keys[a], [], None, [], 0, {}
            part = batch.slice(a, b - a)
            groups = part.column(4).null_count
            for source, n in zip(part.column(2)[:groups].to_pylist(), part.column(3)[:groups].to_pylist()):
                at[source] = len(at)
                below.append(n)
            step = max(1, most // max(1, len(at)))
            for c in range(groups, b - a, step):
                lists = part.column(4).slice(c, step)
                names = lists.flatten().field(0).dictionary_encode()
                column = np.array([at[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
                size = np.diff(lists.offsets.to_numpy())
                waiting.append((rows, np.repeat(np.arange(len(lists)), size), column, lists.flatten().field(1).to_numpy()))
                rows += len(lists)
                if rows >= step:
                    compare()
    yield from finished()


def source_pairs(kept: DataFrame, groups: DataFrame, most: int = CELLS) -> DataFrame:
    """Every two sources of a language with the sum of ``excess`` over all its kept terms, absent ones included.

    Terms are dealt in blocks by their hash and every block gets the language's groups, so no pair of rows ever meets in a
    join and no broadcast is needed. A task adds up its block in numpy: one language's sources squared, as the result has.
    There are as many blocks as the cells (sources x terms) fill, so that their sums stay few beside the cells.
    The sum can't leave 64 bits: with shares that sum to about 10^9 it is at most 10^18.
    """
    cells = groups.agg(F.sum("v")).first()[0] or 0
    blocks = 1 + cells // most
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "source", (F.col("total") + F.col("v")).alias("below"), F.lit(None).cast(kept.schema["sources"].dataType).alias("sources"))
    counted = kept.select("lang", F.pmod(F.hash("term"), F.lit(blocks)).alias("block"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("below"), "sources")
    dealt = spread.union(counted).repartition(parts, "lang", "block").sortWithinPartitions("lang", "block", F.col("sources").isNotNull())
    sums = dealt.mapInArrow(lambda batches: _compared(batches, most), "lang string, source string, item string, value bigint").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, held: int = HELD, cells: int = CELLS) -> DataFrame:
    """``lang, source, part, item, value, rank`` as ``source_pairs`` and ``source_terms`` give them.

    Null text, lang and source are ''; a group without terms and a language without kept terms have pairs (of value 0 in the
    latter) and no terms; repeated rows count each; equal values rank by the item's UTF-8 bytes; other columns are ignored,
    whatever their names; an empty table gives no rows. Groups are a row each for every language's sources; the join with
    them is Spark's to choose by their size.
    """
    docs = docs.select("text", "lang", "source")
    kept = cut(term_counts(docs, min_docs, held))
    groups = cut(groups_of(docs, kept))
    return source_pairs(kept, groups, cells).union(source_terms(kept, groups, top))
