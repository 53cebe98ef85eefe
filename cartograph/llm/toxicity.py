"""Toxicity: character n-gram linear classifier with naive Bayes log-count ratios.

Features are hashed n-grams of a text's lower-cased bytes (present or not).
Each is scaled by its log-count ratio

    r = log((p / |p|) / (q / |q|)),

p and q being smoothed counts of toxic and clean training texts that hold it,
and a logistic model is fitted on the scaled features. Counting runs in tasks;
of the ratios, a bounded number of features, and of the texts, a bounded
number of labelled rows reach the driver. Scoring is one pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm.common import held_out
from cartograph.llm.quality import _minimise, _sample, _sigmoid

ORDERS = (3, 4, 5, 6)
BITS = 22
MAX_ROWS = 5_000          # labelled rows of either class in the fit, at most
MAX_FEATURES = 8_192
MIN_DOCS = 3
MIN_CHI = 10.0             # chi-squared (continuity corrected) a feature needs
DECAY = 3.0                # L2 penalty, divided by the number of texts
THRESHOLD = 0.5


def grams(column, chosen=None):
    """(document, feature) pairs, each once, of an Arrow string array.

    ``chosen`` (bool per feature) drops other features before duplicates are
    removed. Texts count from their first to their last byte with a space on
    both sides; A-Z and white space are folded.
    """
    import numpy as np

    from cartograph.llm.chars import bytes_of, chunks

    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[[9, 10, 11, 12, 13]] = 32
    raw, offsets = bytes_of(column)
    lens = np.diff(offsets)
    spaced = np.full(len(raw) + 2 * len(lens), 32, np.uint8)      # a space before and after each text
    at = np.arange(len(raw)) + np.repeat(2 * np.arange(len(lens)) + 1, lens)
    spaced[at] = raw
    found = []
    for part, doc, own in chunks(spaced, offsets + 2 * np.arange(len(offsets)), max(ORDERS) - 1):
        b = fold[part]
        h = np.zeros(len(b), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            m = len(b) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + b[n - 1:] + np.uint32(1)
            if n not in ORDERS:
                continue
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            code = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            ok = doc[:m] == doc[n - 1:]
            ok[own:] = False
            if chosen is not None:
                ok &= chosen[code]
            pair = (doc[:m][ok].astype(np.int64) << BITS) | code[ok]
            found.append(np.unique(pair))
        if len(found) > 16:                          # one very long text: keep what is distinct
            found = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> dict:
    """Fit on the training fold; a document is toxic if any label of it says so.

    If either class has no labelled text, the model scores 0.5 everywhere.
    """
    import numpy as np

    from cartograph.llm.chars import slices

    fold = F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    marked = labels.where(fold).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    ids = _sample(marked.where("y = 1"), max_rows, F.col("doc_id")).unionByName(
        _sample(marked.where("y = 0"), max_rows, F.col("doc_id")))
    # the ids are bounded by a parameter, so they may be broadcast; their texts, each once, are bounded like them
    content = F.xxhash64("doc_id", F.col("text").cast("string"))
    rows = (docs.select("doc_id", "text", content.alias("h")).join(F.broadcast(ids), "doc_id").select("text", "y", "h")
            .dropDuplicates(["h"]))
    share = min(1.0, 2.0 * max_rows / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64("h"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("text", "y")

    def count(batches):
        import pyarrow as pa

        both = [np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)]
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            for lo, texts in slices(b.column("text")):
                doc, code = grams(texts)
                for k in (0, 1):
                    one, n = np.unique(code[y[lo + doc] == k], return_counts=True)
                    both[k][one] += n.astype(np.int32)
        seen = np.flatnonzero(both[0] + both[1])
        for lo in range(0, len(seen), 200_000):
            at = seen[lo:lo + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in both)],
                                             names=["code", "clean", "toxic"])

    counts = rows.mapInArrow(count, "code int, clean int, toxic int")
    total = counts.groupBy("code").agg(F.sum("clean").alias("q"), F.sum("toxic").alias("p")).where(
        F.col("p") + F.col("q") >= MIN_DOCS)
    # the features whose split between the classes is least likely by chance
    n_toxic, n_clean = (ids.where(f"y = {k}").count() for k in (1, 0))
    if not n_toxic or not n_clean:
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": 0.0}
    share = n_toxic / (n_toxic + n_clean)
    expected = (F.col("p") + F.col("q")) * F.lit(share)
    chi = F.greatest(F.abs(F.col("p") - expected) - 0.5, F.lit(0.0)) ** 2 / (expected * F.lit(1 - share))
    top = total.where(chi >= MIN_CHI).orderBy(chi.desc(), "code").limit(max_features).toPandas()
    code, p, q = (top[c].to_numpy(np.int64) for c in ("code", "p", "q"))
    ratio = np.log((p + 1.0) / (n_toxic + 2.0)) - np.log((q + 1.0) / (n_clean + 2.0))
    place = np.full(1 << BITS, -1, np.int32)
    place[code] = np.arange(len(code))
    chosen = place >= 0

    def pick(batches):
        import pyarrow as pa

        for b in batches:
            for lo, texts in slices(b.column("text")):
                doc, c = grams(texts, chosen)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                spots = place[c].astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [b.column("y").slice(lo, len(texts)),
                     pa.array([spots[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], names=["y", "x"])

    kind = dict(rows.dtypes)["y"]
    sample = rows.mapInArrow(pick, f"y {kind}, x binary").toArrow()
    y = sample.column("y").to_numpy().astype(float)
    x = [np.frombuffer(v, "<i4") for v in sample.column("x").to_pylist()]
    row = np.repeat(np.arange(len(x), dtype=np.int32), [len(v) for v in x])
    col = np.concatenate(x) if x else np.zeros(0, np.int32)
    scaled = ratio[col].astype(np.float32)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))

    decay = DECAY / max(len(y), 1)

    def gradient(w):
        z = np.bincount(row, scaled * w[col], minlength=len(y)) + w[-1]
        e = (_sigmoid(z) - y) * weight
        return np.append(np.bincount(col, scaled * e[row], minlength=len(code)), e.sum()) + decay * np.append(w[:-1], 0)

    w = _minimise(gradient, len(code) + 1, 200)
    weights = np.zeros(1 << BITS, np.float32)
    weights[code] = ratio * w[:-1]
    return {"weights": weights, "bias": float(w[-1])}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id_col, score) of every whole text; null and empty texts are scored by the bias."""
    import numpy as np

    from cartograph.llm.chars import slices

    code = np.flatnonzero(model["weights"])
    value, bias = model["weights"][code], model["bias"]          # bounded by max_features

    def run(batches):
        import pyarrow as pa

        weights = np.zeros(1 << BITS, np.float32)
        weights[code] = value
        chosen = weights != 0
        for b in batches:
            z = np.full(b.num_rows, bias)
            for lo, texts in slices(b.column(1)):
                doc, c = grams(texts, chosen)
                z[lo:lo + len(texts)] += np.bincount(doc, weights[c], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_sigmoid(z), pa.float64())], names=[id_col, "score"])

    narrow = docs.select(id_col, F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {dict(narrow.dtypes)[id_col]}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's columns. Repeated rows are scored alike; an empty table gives no rows."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
