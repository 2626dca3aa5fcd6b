"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Toxic and ordinary texts each get an n-gram model of order ORDER over lower-cased characters, whose contexts reach back
to the blank before the word at most; a document counts an n-gram once. The models share what they back off to: a
Kneser-Ney continuation model of order MIDDLE over the n-grams of both classes, itself backed off to counts of three
characters over the whole corpus. So an expression that neither class has often says little, while the stems of many
inflected, rare words still add up.

    P_k(w | h) = max(c_k(hw) - D, 0) / c_k(h) + D N_k(h) / c_k(h) P(w | h')

A class that lacks a context backs off completely. The log-likelihood ratio of each n-gram that a learning text has is
worked out once, by Spark; where both classes lack an n-gram, both back off to the same model and the ratio is 0.
Ratios are shrunk, none is cut off: the weight is a half where the classes' counts differ by HALF_Z standard deviations
from the context's shares, and another half where the ratio is HALF_RATIO. Without that, differences in the mix of
languages and topics drown the few telling words of a long text. The score takes the ratio per character over the
whole text, and over its highest stretch of STRETCH characters, into a logistic calibration.

Labelled rows outside the held-out fold teach both: counts of checksum remainder 0 make the models that are
calibrated on remainder 2; the models that score count both. For each class and remainder at most ``most_labelled``
rows are taken, those of the smallest hash of the id. The counts of three characters cover all documents.

A model is a table of n-grams in the shared folder, ordered by a one-to-one mix of their bits; every task that
scores reads it. It has all n-grams of the learning texts, so its size follows from ``most_labelled``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import dealt, rows_whose, scratch, shared_dir, stash, store_of, table, task_of, text_slices, with_columns_of

ORDER, MIDDLE, DISCOUNT, STRETCH = 8, 4, 0.75, 256
HALF_Z, HALF_RATIO = 4.0, 1.5
THRESHOLD = 0.7
_BLANKS = dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")


def characters(text: str | None) -> np.ndarray:
    """One byte for each UTF-16 unit of the text between blanks; characters beyond Latin-1 share bytes."""
    units = np.frombuffer(f" {(text or '').lower().translate(_BLANKS)} ".encode("utf-16-le"), "<u2")
    return ((units ^ units >> 8) & 255).astype(np.uint8)


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each character from the second on, as an integer; none begins before its word's blank."""
    padded = np.concatenate([np.zeros(order - 2, np.uint8), data]).astype(np.uint64)
    n = len(data) - 1
    out = padded[:n].copy()
    for i in range(1, order):
        out = out << np.uint64(8) | padded[i : i + n]
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(data[:-1] == 32, at, 0))
    unused = 8 * (order - np.minimum(at - start + 2, order))
    return out & np.uint64(2**64 - 1 >> 64 - 8 * order) >> unused.astype(np.uint64)


def fold(doc_id) -> F.Column:
    """0 and 2 are for learning, 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def _count_grams(docs: DataFrame) -> DataFrame:
    """gram, fold, and in how many documents of each class it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            folds, toxic = (part.column(c).to_numpy() for c in ("fold", "toxic"))
            for f, k in sorted(set(zip(folds.tolist(), toxic.tolist(), strict=True))):
                found = [np.unique(grams(characters(texts[i]), ORDER)) for i in np.flatnonzero((folds == f) & (toxic == k)).tolist()]
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([gram.view(np.int64), np.full(len(gram), f, np.int32), n * (k == 0), n * (k == 1)], ["gram", "fold", "c0", "c1"])

    return dealt(docs).mapInArrow(task_of(run), "gram long, fold int, c0 long, c1 long").groupBy("gram", "fold").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _count_triples(docs: DataFrame, text: str) -> DataFrame:
    """triple, n over all documents; a task sends each triple of bytes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, texts in text_slices(batches):
            found = [np.unique(grams(characters(t), 3).astype(np.int64), return_counts=True) for t in texts if t]
            if found:
                codes, n = (np.concatenate(x) for x in zip((known, total), *found, strict=True))
                known, place = np.unique(codes, return_inverse=True)
                total = np.bincount(place, weights=n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([known, total], ["triple", "n"])

    return dealt(docs).select(F.col(text).alias("text")).mapInArrow(task_of(run), "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def _ratios(counted: DataFrame, triples: DataFrame) -> DataFrame:
    """gram and shrunk ratio of every n-gram of ``counted``."""
    d = DISCOUNT
    middle, low = (1 << 8 * MIDDLE) - 1, (1 << 24) - 1
    upper = lambda c: F.shiftrightunsigned(c, 8)
    contexts = counted.groupBy(upper("gram").alias("context")).agg(*(f(k) for k in (0, 1) for f in (lambda k: F.sum(f"c{k}").alias(f"t{k}"), lambda k: F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"v{k}"))))
    shared = counted.groupBy(F.col("gram").bitwiseAND(F.lit(middle)).alias("mid")).agg(F.count("*").alias("types"))
    above = shared.groupBy(upper("mid").alias("mid_context")).agg(F.sum("types").alias("all_types"), F.count("*").alias("followers"))
    pairs = triples.groupBy(upper("triple").alias("pair")).agg(F.sum("n").alias("pair_n"))
    lowest = triples.join(pairs, upper("triple") == F.col("pair")).select("triple", ((F.col("n") + 0.5) / (F.col("pair_n") + 128.0)).alias("p_low"))
    backoff = shared.join(above, upper("mid") == F.col("mid_context")).join(lowest, F.col("mid").bitwiseAND(F.lit(low)) == F.col("triple"), "left")
    backoff = backoff.select("mid", ((F.greatest(F.col("types") - d, F.lit(0.0)) + d * F.col("followers") * F.coalesce("p_low", F.lit(1 / 256))) / F.col("all_types")).alias("p_mid"))
    p = [F.when(F.col(f"t{k}") > 0, F.greatest(F.col(f"c{k}") - d, F.lit(0.0)) / F.col(f"t{k}") + d * F.col(f"v{k}") / F.col(f"t{k}") * F.col("p_mid")).otherwise(F.col("p_mid")) for k in (0, 1)]
    toxic_share = counted.agg((F.sum("c1") + 0.5) / (F.sum(F.col("c0") + F.col("c1")) + 1)).first()[0] or 0.5
    # the share of toxic documents to expect: that of the context, or of all where only one class has the context
    share = F.when((F.col("t0") > 0) & (F.col("t1") > 0), F.col("t1") / (F.col("t0") + F.col("t1"))).otherwise(F.lit(toxic_share))
    n, ratio = F.col("c0") + F.col("c1"), F.log(p[1] / p[0])
    joined = counted.join(contexts, upper("gram") == F.col("context")).join(backoff, F.col("gram").bitwiseAND(F.lit(middle)) == F.col("mid"))
    sized = joined.select("gram", ratio.alias("ratio"), (F.pow(F.col("c1") - n * share, 2) / (n * share * (1 - share))).alias("z2"), F.pow(ratio, 2).alias("r2"))
    return sized.select("gram", (F.col("ratio") * F.col("z2") / (F.col("z2") + HALF_Z**2) * F.col("r2") / (F.col("r2") + HALF_RATIO**2)).cast("float").alias("ratio"))


def _mixed(keys: np.ndarray) -> np.ndarray:
    """The keys spread evenly over 64 bits, one to one."""
    h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


Model = tuple[np.ndarray, np.ndarray, np.ndarray]
_SIGN = np.uint64(1 << 63)


def _table(mixed: np.ndarray, ratios: np.ndarray) -> Model:
    """Ascending mixed keys and their ratios, both with an end mark, and where the keys of each interval begin (about two each)."""
    bits = max(1, (len(mixed) - 1).bit_length() - 1)
    starts = np.searchsorted(mixed[:-1], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
    return mixed, ratios, starts


def _write_model(ratios: DataFrame) -> str:
    """Write (gram, ratio) by ascending mixed key, file by file; the folder. Every scoring task opens all files, so
    there are as few as adaptive execution makes of the sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mixed = (_mixed(batch.column("gram").to_numpy()) ^ _SIGN).view(np.int64)
            yield pa.RecordBatch.from_arrays([mixed, batch.column("ratio")], ["mixed", "ratio"])

    folder = shared_dir(ratios.sparkSession)
    ratios.mapInArrow(task_of(run), "mixed long, ratio float").orderBy("mixed").write.parquet(folder)
    return folder


def _read_model(folder: str) -> Model:
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    store, place = store_of(folder)
    paths = sorted(f.path for f in store.get_file_info(FileSelector(place)) if f.base_name.startswith("part-"))
    files = [pq.ParquetFile(store.open_input_file(p)) for p in paths]
    n, at = sum(f.metadata.num_rows for f in files), 0
    mixed, ratios = np.full(n + 1, 2**64 - 1, np.uint64), np.zeros(n + 1, np.float32)
    for f in files:
        for batch in f.iter_batches(1 << 17):
            mixed[at : at + len(batch)] = batch.column("mixed").to_numpy().view(np.uint64) ^ _SIGN
            ratios[at : at + len(batch)] = batch.column("ratio").to_numpy()
            at += len(batch)
    return _table(mixed, ratios)


def _ratios_of(gram: np.ndarray, model: Model) -> np.ndarray:
    """The ratio of each n-gram, 0 of those that the model hasn't."""
    mixed, ratios, starts = model
    wanted = _mixed(gram)
    at = starts[wanted >> np.uint64(64 - (len(starts).bit_length() - 1))]
    found = mixed[at]
    behind = np.flatnonzero(found < wanted)
    while len(behind):
        at[behind] += 1
        found[behind] = step = mixed[at[behind]]
        behind = behind[step < wanted[behind]]
    return np.where(found == wanted, ratios[at], np.float32(0))


def features(text: str | None, model: Model) -> tuple[float, float]:
    """Log-likelihood ratio per character of the text, and of its highest stretch."""
    data = characters(text)
    total, best, n, step = 0.0, -math.inf, len(data) - 1, STRETCH << 12
    for i in range(0, n, step):  # long texts in parts, which see the characters before them
        back = min(i, 64)
        ratio = _ratios_of(grams(data[i - back : i + step + 1], ORDER)[back:], model)
        sums = np.add.reduceat(ratio.astype(np.float64), np.arange(0, len(ratio), STRETCH // 2))
        pairs = sums[1:] + sums[:-1] if len(sums) > 1 else sums
        total, best = total + sums.sum(), max(best, pairs.max() / min(STRETCH, max(len(ratio), STRETCH // 4)))
    return total / n, best


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T * (p * (1 - p)) @ x + keep, x.T @ (y - p) - keep @ w)
    return w


def learning_rows(labels: DataFrame, most_labelled: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fold, toxic) of all labelled rows that may teach, and of those that do: of each class and fold the
    ``most_labelled`` with the smallest hash of the id, or all if there are fewer."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 1")
    usable = stash(usable.groupBy("doc_id", "fold").agg(F.max("toxic").cast("int").alias("toxic")))
    parts = [usable.filter((F.col("fold") == f) & (F.col("toxic") == k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled) for f in (0, 2) for k in (0, 1)]
    return usable, stash(reduce(DataFrame.unionByName, parts))


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 10_000, text: str = "text", key: str = "doc_id"):
    """(folder of the model, mean, spread, weights), or None where a class has no learning rows.

    Labels other than 0 and 1, null ids and the held-out fold are left out; an id with several labels counts as toxic
    if any of them is.
    """
    with scratch(docs.sparkSession) as folders:
        return _train(docs, labels, most_labelled, text, key, folders)


def _train(docs: DataFrame, labels: DataFrame, most_labelled: int, text: str, key: str, folders: list[str]):
    usable, chosen = learning_rows(labels, most_labelled)
    if chosen.select("fold", "toxic").distinct().count() < 4:
        return None
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    labelled = own.join(F.broadcast(chosen), "doc_id").filter("text is not null").drop("doc_id")  # at most 4 * most_labelled ids
    counted = stash(_count_grams(labelled))
    triples = stash(_count_triples(docs, text))
    first = _write_model(_ratios(counted.filter("fold = 0").drop("fold"), triples))
    folders.append(first)
    marked = _features(labelled.filter("fold = 2").select("text", "toxic"), first).toPandas()  # at most 2 * most_labelled rows of numbers
    if marked["toxic"].nunique() < 2:
        return None
    final = _write_model(_ratios(counted.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), triples))
    x = marked[["whole", "stretch"]].to_numpy(np.float64)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    y = marked["toxic"].to_numpy(np.float64)
    total = usable.agg(F.avg("toxic")).first()[0]
    weights = _logistic((x - mean) / spread, y)
    # classes are bounded apart: bring the intercept back to the share of toxic labels
    weights[-1] += math.log(total / (1 - total)) - math.log(y.mean() / (1 - y.mean()))
    return final, mean, spread, weights


def _features(docs: DataFrame, folder: str) -> DataFrame:
    def compute(texts: list[str | None], model: Model) -> list:
        got = [features(t, model) for t in texts]
        return [[g[i] for g in got] for i in (0, 1)]

    return with_columns_of(docs, "whole double, stretch double", compute, start=lambda: _read_model(folder))


def _scores(texts: list[str | None], model, known: Model | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    _, mean, spread, weights = model
    x = (np.array([features(t, known) for t in texts]).reshape(-1, 2) - mean) / spread
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def score(docs: DataFrame, model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on) of every row of ``docs``.

    Only the text is scored; a null text scores as an empty one. Without a model (no labels of both classes) every
    score is 0.5. Repeated rows score alike; an empty table gives an empty result. A null id is not held out.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = with_columns_of(own, "score double", lambda texts, known: [_scores(texts, model, known)], start=lambda: model and _read_model(model[0]))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their columns unchanged."""
    return rows_whose(docs, lambda texts, known: (_scores(texts, model, known) < THRESHOLD).tolist(), text, start=lambda: model and _read_model(model[0]))


def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
