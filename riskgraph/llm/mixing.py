"""Mixing sources to target weights by raking, and sampling documents by calibrated probabilities.

Documents have no topic, so topics are learnt: within each language, k-means on the words of all
its documents. Token counts are summed to cells of source, language and topic. Iterative
proportional fitting scales the cells in turn to each target marginal until
all agree. A cell's fitted over observed tokens is its documents' weight; the sampling probability is the weight over the
largest weight, so the expected tokens of the sample stand in the fitted proportions. Where no document may be lost,
documents are repeated instead, by the weight over the smallest weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm.shared import cut, join_hot
from riskgraph.llm.text import U, chunks, word_hashes

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
BROADCAST_CELLS = 100_000
DIMS = 4096  # classes of hashed words


@dataclass(frozen=True)
class TopicParams:
    """Topics are learnt from all documents of a language; where ``sample`` is given, from so many of its distinct rows, the first by a hash of id and text.

    ``languages`` bounds what the driver and the tasks hold: the languages with most documents have topics of their own, all others share those learnt from all of them together.
    """

    topics: int = 4
    sample: int | None = None
    languages: int = 200
    rounds: int = 10


def _classes(texts: list[str]):
    """Each text's number of words and sorted distinct word classes."""
    words, counts = word_hashes(texts)
    for part in np.split(words, np.cumsum(counts)[:-1]):
        yield len(part), np.unique(part % U(DIMS)).astype(np.int64)


def k_means(rows: list[np.ndarray], p: TopicParams) -> np.ndarray:
    """(topics, DIMS) weights: the sum of a text's classes' weights is highest in its topic's row.

    Spherical k-means on the distinct word classes weighed by inverse document frequency. It starts from the
    first row and rows that are least like those taken before, so it depends on the order alone.
    """
    df = np.bincount(np.concatenate(rows), minlength=DIMS) if rows else np.zeros(DIMS)
    idf = np.log((1 + len(rows)) / (1 + df))
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, at in enumerate(rows):
        x[i, at] = idf[at]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    chosen, near = [0], x @ x[0]
    for _ in range(p.topics - 1):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(p.rounds):
        own = np.argmax(x @ centres.T, 1)
        for k in range(p.topics):
            if (own == k).any():
                centres[k] = x[own == k].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return (centres * idf).astype(np.float32)


def _rows(docs: DataFrame, p: TopicParams, text: str, doc_id: str, lang: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with text as ``lang``, ``text`` and ``order`` (a hash), the sizes of the languages, and those of them that have topics of their own."""
    language = F.coalesce(F.col(lang).cast("string"), F.lit(NONE))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col(doc_id), text), 1)
    rows = docs.select(language.alias("lang"), F.col(text).cast("string").alias("text"), order.alias("order")).where("text <> ''")
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("order", 0.02).alias("distinct")))
    return rows, sizes, sizes.orderBy(F.desc("n"), "lang").limit(p.languages).select("lang", F.col("lang").alias("own"), "distinct")


def topic_sample(docs: DataFrame, p: TopicParams, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """``lang`` (null: the languages that share theirs), ``order`` and ``text``: a few more than ``sample`` distinct rows of each, all whose hash is low enough.

    Distinct rows are counted by sketches, so that neither copies nor a language's share change how many are taken. A repeated row comes as often as it is there.
    """
    rows, sizes, large = _rows(docs, p, text, doc_id, lang)
    rest = sizes.join(F.broadcast(large.select("lang")), "lang", "left_anti").agg(F.sum("distinct")).first()[0] or 1
    wanted = 1.1 * (p.sample + 6 * p.sample**0.5 + 10)  # enough for the first ``sample``, whatever the sketch's and the hashes' errors
    met = rows.join(F.broadcast(large), "lang", "left")
    share = F.lit(wanted) / F.greatest(F.lit(1.0), F.when(F.col("own").isNull(), F.lit(float(rest))).otherwise(F.col("distinct")))
    return met.where(F.col("order") < share * float(2**63)).select(F.col("own").alias("lang"), "order", "text")


ELEMENTS = 500_000  # word classes that a task works at a time
UNIT = 2.0**20  # weights are summed as whole numbers of this part, so that sums don't depend on the order of rows


def _parts(batches):
    """(language, orders, at, starts) of a few rows of one language at a time: all their word classes in ``at``, each row's from its start."""
    for batch in batches:
        groups: dict[str | None, list] = {}
        sizes: dict[str | None, int] = {}
        for lang, order, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
            group = groups.setdefault(lang, [])
            group.append((order, at))
            sizes[lang] = sizes.get(lang, 0) + len(at) // 2
            if sizes[lang] > ELEMENTS:
                yield _flat(lang, groups.pop(lang))
                sizes[lang] = 0
        for lang, group in groups.items():
            yield _flat(lang, group)


def _flat(lang, group):
    sizes = np.array([len(at) // 2 for _, at in group])
    return lang, [o for o, _ in group], np.frombuffer(b"".join(at for _, at in group), "<i2").astype(np.int64), np.cumsum(sizes) - sizes


def _unit(at: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = idf[at]
    norm = np.maximum(np.sqrt(np.add.reduceat(x * x, starts)), 1e-9)
    return x / np.repeat(norm, np.diff(np.append(starts, len(at))))


def _k_means_of_all(rows: DataFrame, p: TopicParams) -> dict[str | None, np.ndarray]:
    """``k_means`` of all rows (lang, order, at) in the order of ``order``, language by language, as passes over them: the tasks add up whole numbers and the driver holds the centres."""

    def summed(of) -> dict[str | None, np.ndarray]:
        def run(batches):
            sums: dict = {}
            for lang, _, at, starts in _parts(batches):
                sums[lang] = sums.get(lang, 0) + of(lang, at, starts)
            for lang, total in sums.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "sums": pa.array([total.astype(np.int64).tobytes()], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b, np.int64) for b in table["sums"].to_pylist())
            return pa.table({"lang": table["lang"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        found = rows.mapInArrow(run, "lang string, sums binary").groupBy("lang").applyInArrow(add, "lang string, sums binary")
        return {r.lang: np.frombuffer(r.sums, np.int64) for r in found.collect()}

    def furthest(idf: dict, chosen: dict) -> dict[str | None, np.ndarray]:
        """Of each language the row least like those chosen, of equals the first."""

        def run(batches):
            least: dict = {}
            for lang, orders, at, starts in _parts(batches):
                x = _unit(at, starts, idf[lang])
                near = np.max([np.add.reduceat(c[at] * x, starts) for c in chosen[lang]] or [np.zeros(len(orders))], 0)
                i = min(range(len(orders)), key=lambda i: (near[i], orders[i]))
                end = starts[i + 1] if i + 1 < len(starts) else len(at)
                found = (float(near[i]), orders[i], at[starts[i] : end].astype("<i2").tobytes())
                least[lang] = min(least.get(lang, found), found)
            if least:
                columns = {n: pa.array([f[i] for f in least.values()], t) for i, (n, t) in enumerate((("near", pa.float64()), ("order", pa.int64()), ("at", pa.binary())))}
                yield pa.RecordBatch.from_pydict({"lang": pa.array(list(least), pa.string())} | columns)

        best = rows.mapInArrow(run, "lang string, near double, order bigint, at binary").groupBy("lang").agg(F.min(F.struct("near", "order", "at")).alias("m")).collect()
        out = {}
        for r in best:
            at, out[r.lang] = np.frombuffer(r.m["at"], "<i2").astype(np.int64), np.zeros(DIMS)
            out[r.lang][at] = _unit(at, np.zeros(1, np.int64), idf[r.lang])
        return out

    counts = summed(lambda lang, at, starts: np.append(np.bincount(at, minlength=DIMS), len(starts)))
    idf = {lang: np.log((1 + c[-1]) / (1 + c[:-1])) for lang, c in counts.items()}
    chosen: dict = {lang: [] for lang in idf}
    for _ in range(p.topics):
        for lang, row in furthest(idf, chosen).items():
            chosen[lang].append(row)
    centres = {lang: np.array(c) for lang, c in chosen.items()}
    before: dict = {}
    for _ in range(p.rounds):

        def members(lang, at, starts, centres=centres):
            x = _unit(at, starts, idf[lang])
            own = np.argmax([np.add.reduceat(c[at] * x, starts) for c in centres[lang]], 0)
            cell = np.repeat(own, np.diff(np.append(starts, len(at)))) * DIMS + at
            return np.bincount(cell, np.floor(x * UNIT + 0.5), p.topics * DIMS).astype(np.int64)

        sums = summed(members)
        if all(np.array_equal(s, before.get(lang)) for lang, s in sums.items()):
            break
        before, centres = sums, {lang: c.copy() for lang, c in centres.items()}
        for lang, s in sums.items():
            s = s.reshape(p.topics, DIMS).astype(np.float64)
            norm = np.linalg.norm(s, axis=1, keepdims=True)
            centres[lang] = np.where(norm > 0, s / np.maximum(norm, 1e-9), centres[lang])
    return {lang: (c * idf[lang]).astype(np.float32) for lang, c in centres.items()}


def learn_topics(docs: DataFrame, p: TopicParams = TopicParams(), text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> dict[str | None, np.ndarray]:
    """Each language's ``k_means`` weights, and under None those that all other languages share, learnt from all documents (or ``sample`` of each).

    Repeated rows count once. A language without words has none. Fewer documents than topics leave topics without any.
    """

    def describe(batches):
        met = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [i for i, k in enumerate(keys) if k not in met and not met.add(k)]  # one of a task's repeated rows
            for part, texts in chunks([keys[i] for i in new], batch.column(2).take(pa.array(new, pa.int64())).to_pylist()):
                found = [at.astype("<i2").tobytes() for _, at in _classes(texts)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([i for i, _ in part], pa.string()), "order": pa.array([o for _, o in part], pa.int64()), "at": pa.array(found, pa.binary())})

    def train(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["order"].to_pylist(), table["at"].to_pylist()))[: p.sample]
        rows = [np.frombuffer(at, "<i2").astype(np.int64) for _, at in rows if at]
        weights = [k_means(rows, p).tobytes()] if rows else []
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(weights), pa.string()), "weights": pa.array(weights, pa.binary())})

    if p.sample is None:
        rows, _, large = _rows(docs, p, text, doc_id, lang)
        owned = rows.join(F.broadcast(large.drop("distinct")), "lang", "left").select(F.col("own").alias("lang"), "order", "text")
        found = owned.mapInArrow(describe, "lang string, order bigint, at binary").where("length(at) > 0")
        return _k_means_of_all(cut(found.groupBy("lang", "order").agg(F.min("at").alias("at"))), p)
    found = topic_sample(docs, p, text, doc_id, lang).mapInArrow(describe, "lang string, order bigint, at binary")
    once = found.groupBy("lang", "order").agg(F.min("at").alias("at"))  # ``sample`` rows and a few of each language
    learnt = once.groupBy("lang").applyInArrow(train, "lang string, weights binary").collect()
    return {r.lang: np.frombuffer(r.weights, np.float32).reshape(p.topics, DIMS) for r in learnt}


def with_topic(df: DataFrame, model: dict[str | None, np.ndarray], text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with last columns ``mix_tokens`` (words of the whole text) and ``mix_topic``: the language and the number of its topic that the text's words speak for.

    A language without weights of its own takes those under None. Ties go to the smaller number; a text without words, or without weights, has number 0. One pass, no shuffle.
    """
    names, at, of = df.columns, df.columns.index(text), df.columns.index(lang)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            tokens, topic = [], []
            langs = [NONE if i is None else str(i) for i in batch.column(of).to_pylist()]
            for part, texts in chunks(langs, batch.column(at).to_pylist()):
                for i, (n, found) in zip(part, _classes(texts)):
                    weights = held.value.get(i, held.value.get(None))
                    tokens.append(n)
                    topic.append(f"{i}/{0 if weights is None else int(weights[:, found].sum(1).argmax())}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64()), pa.array(topic, pa.string())], [*names, "mix_tokens", "mix_topic"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("mix_tokens", T.LongType()), T.StructField("mix_topic", T.StringType())]))


def targets(cells: DataFrame, temperature: float = 0.7, weights: dict[str, dict[str, float]] | None = None) -> list[DataFrame]:
    """Target shares (value, share) of each margin of ``cells`` (MARGINS, observed).

    A value's weight is the one that ``weights`` gives for its margin, else its observed share to the power ``temperature``; shares
    are weights over their sum. A topic's share is its language's, times its own in the language, so that the two margins agree.
    """

    def shares(margin: str) -> DataFrame:
        seen = cells.groupBy(margin).agg(F.sum("observed").alias("t")).where("t > 0")
        total = seen.agg(F.sum("t")).first()[0] or 1.0
        given = F.lit(None).cast("double")
        for value, weight in (weights or {}).get(margin, {}).items():
            given = F.when(F.col(margin) == value, weight).otherwise(given)
        return cut(seen.select(margin, F.coalesce(given, F.pow(F.col("t") / total, temperature)).alias("w")))

    out = {}
    for m in MARGINS[:2]:
        w = shares(m)
        out[m] = w.select(m, (F.col("w") / F.lit(w.agg(F.sum("w")).first()[0] or 1.0)).alias("share"))
    topics = shares("topic").join(cells.select("topic", "lang").distinct(), "topic")  # a topic is of one language
    within = topics.groupBy("lang").agg(F.sum("w").alias("all"))
    met = topics.join(within, "lang").join(out["lang"], "lang")
    return [out["source"], out["lang"], cut(met.select("topic", (F.col("share") * F.col("w") / F.col("all")).alias("share")))]


def rake(cells: DataFrame, goals: list[DataFrame], rounds: int = 60, tolerance: float = 1e-4) -> DataFrame:
    """``cells`` (MARGINS, observed) with ``fitted``, whose marginal shares are the goals', and ``gap``.

    ``goals`` has one frame (value, share) per margin. Values without a goal get share 0. Each step sums a margin (tasks sum
    first) and scales its cells. Stops after ``rounds`` or when no factor is further than ``tolerance`` from 1. ``gap`` is how far the
    last round's furthest factor was: more than ``tolerance`` says that the goals weren't met, as where no cells can meet them.
    """
    total = cells.agg(F.sum("observed")).first()[0] or 1.0
    fitted = cells.where("observed > 0").withColumn("fitted", F.col("observed") / F.lit(total))
    for m, goal in zip(MARGINS, goals):
        fitted = fitted.join(goal.withColumnRenamed("share", f"to_{m}"), m, "left").fillna(0.0, [f"to_{m}"])
    fitted, gap = cut(fitted), 0.0
    for done in range(rounds):
        off = F.lit(0.0)
        for m in MARGINS:
            sums = fitted.groupBy(m).agg(F.sum("fitted").alias("sum"))
            factor = F.when(F.col("sum") > 0, F.col(f"to_{m}") / F.col("sum")).otherwise(0.0)
            off = F.when(F.col("fitted") > 0, F.greatest(off, F.abs(factor - 1))).otherwise(off)
            fitted = fitted.join(sums, m).withColumn("off", off).withColumn("fitted", F.col("fitted") * factor).drop("sum")
            off = F.col("off")
        fitted = cut(fitted)
        gap = fitted.agg(F.max("off")).first()[0] or 0.0
        if gap <= tolerance:
            break
    return fitted.select(*MARGINS, "observed", "fitted", F.lit(gap).alias("gap"))


def unit_hash(*columns) -> F.Column:
    """A number from [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(2**53))


MADE = ("tokens", "topic", "weight", "probability", "gap", "kept")


def mix(docs: DataFrame, goals: list[DataFrame] | None = None, temperature: float = 0.7, weights: dict[str, dict[str, float]] | None = None, seed: int = 17, topics: TopicParams = TopicParams(), repeats: float | None = None) -> DataFrame:
    """``docs`` with last columns ``mix_tokens``, ``mix_topic``, ``mix_weight``, ``mix_probability``, ``mix_gap`` (see ``rake``) and ``mix_kept``.

    Goals come from ``targets`` unless given. Nulls in source or language are a value of their own. A document is kept if a hash of its id
    and ``seed`` is below its probability, so repeated rows share their fate, and a null id counts as a value. Documents
    without words have no tokens to weigh: probability 1. Input columns of these six names are replaced; all others pass, whatever their names;
    an empty table gives no rows. Cells are as many as observed triples. Up to BROADCAST_CELLS of them are broadcast, more meet the
    documents by ``join_hot``; both give the same rows.

    With ``repeats`` every document comes once at least: as often as its weight is of the smallest weight, the fraction by the same hash, so that the expected
    tokens stand in the fitted proportions and none is left out. Weights are scaled by ``repeats`` at most, which bounds the result to ``repeats`` + 1 times the tokens;
    cells that would then come less than once come once.
    """
    named = docs.drop(*(f"mix_{c}" for c in MADE))
    counted = cut(with_topic(named, learn_topics(named, topics)))  # written once, as words are dearer to find than text is to read
    key = [F.coalesce(F.col("source").cast("string"), F.lit(NONE)), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), F.col("mix_topic")]
    grouped = counted.groupBy(*(k.alias(m) for k, m in zip(key, MARGINS)))
    cells = cut(grouped.agg(F.sum("mix_tokens").cast("double").alias("observed"), F.count("*").alias("many")))
    fitted = rake(cells, goals or targets(cells, temperature, weights))
    total = cells.agg(F.sum("observed")).first()[0] or 1.0
    weighed = cut(fitted.withColumn("weight", F.col("fitted") * F.lit(total) / F.col("observed")))
    most, least = (w or 1.0 for w in weighed.agg(F.max("weight"), F.min(F.when(F.col("weight") > 0, F.col("weight")))).first())
    joint = F.to_json(F.array(*MARGINS))
    weighed = weighed.select(joint.alias("__cell"), F.col("weight").alias("mix_weight"), (F.col("weight") / F.lit(most)).alias("mix_probability"), F.col("gap").alias("mix_gap"))
    weighed = cut(cells.select(joint.alias("__cell"), F.col("many").alias("__many")).join(weighed, "__cell", "left"))
    marked = counted.withColumn("__cell", F.to_json(F.array(*key)))
    if weighed.count() <= BROADCAST_CELLS:  # one pass; more cells than that meet the documents in two ways
        met = marked.join(F.broadcast(weighed.drop("__many")), "__cell", "left")
    else:
        met = join_hot(marked, weighed, "__cell", "__many")
    met = met.fillna({"mix_weight": 1.0, "mix_probability": 1.0, "mix_gap": 0.0})
    drawn = unit_hash(F.lit(seed), F.col("doc_id"))
    met = met.withColumn("mix_kept", drawn < F.col("mix_probability"))
    found = [*named.columns, *(f"mix_{c}" for c in MADE)]
    if repeats is None:
        return met.select(*found)
    times = F.when(F.col("mix_tokens") > 0, F.greatest(F.lit(1.0), F.col("mix_weight") * F.lit(min(repeats, 1 / least)))).otherwise(1.0)
    copies = (F.floor(times) + F.when(drawn < times - F.floor(times), 1).otherwise(0)).cast("int")
    return met.select(*found, F.explode(F.sequence(F.lit(1), copies)).alias("__copy")).select(*found)
