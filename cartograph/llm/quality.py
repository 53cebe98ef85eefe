"""Quality classifier: non-negative positive-unlabelled learning.

Trusted positives are documents labelled good; everything else the model sees
is unlabelled text of the corpus. With class prior p, loss l and score g the
non-negative unbiased risk is

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])

and when the second part turns negative its gradient is ascended instead, so
the model cannot fit the unlabelled positives away. No negative label is read.

The loss is the square, l(g) = (1 - g)^2 / 4, so risk and gradient of a linear
score depend on the texts only through the means and second moments of their
features. These are added up in tasks over every text of the training fold; no
unlabelled text is sampled, and no feature row leaves its task. The driver
holds a few matrices of ``WIDTH + 1`` rows whatever the size of the corpus.

The prior comes from the same texts: a first classifier, fitted on one half of
them, separates P from U, and p is the smallest ratio, over score thresholds,
of the share of U above it to the share of P above it (with a confidence
margin), counted on the other half.

Features describe a text's make-up, not its words or language: frequencies of
pairs of character classes, repetition of words, lengths. They are computed
from the whole text. Scoring is one pass without shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.llm.common import held_out

MAX_POSITIVES = 12_000      # documented bound: ids labelled good that are read
DECAY = 1e-3                # L2 penalty
STEEP = 2.118               # score = sigmoid(STEEP g): the threshold 0.3 stands for g = -0.4
BINS = 4096                 # of first scores between -SPREAD and SPREAD, for the prior
SPREAD = 8.0
THRESHOLD = 0.3
CLASSES = 20
EXTRA = 8
WIDTH = CLASSES * CLASSES + EXTRA


def class_table():
    """Class of each byte: letters, digits and white space by kind, punctuation by sign."""
    import numpy as np

    t = np.zeros(256, np.int64)
    for k, group in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ",
                               b"\n", b"\t\r\v\f", b".", b",", b"!?", b"|", b"#*=~_", b"<>{}[]()", b"/\\", b"@&%$^+",
                               b":;", b"'\"`", b"-"]):
        t[list(group)] = k + 1
    t[128:192] = 18
    t[192:] = 19
    return t


def features(column):
    """Feature rows (float32) of an Arrow string array; empty and null texts are all zeros."""
    import numpy as np

    from cartograph.llm.chars import bytes_of, chunks

    table, n = class_table(), len(column)
    raw, offsets = bytes_of(column)
    pairs = np.zeros(n * CLASSES * CLASSES, np.int64)
    for part, doc, own in chunks(raw, offsets, 1):
        c = table[part]
        code = c[:-1] * CLASSES + c[1:]
        same = doc[:-1] == doc[1:]
        at = (doc[:-1] * (CLASSES * CLASSES) + code)[:own][same[:own]]
        lo = int(doc[0]) * CLASSES * CLASSES
        counted = np.bincount(at - lo)
        pairs[lo:lo + len(counted)] += counted
    pairs = pairs.reshape(n, -1).astype(np.float32)
    total = np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    extra = np.zeros((n, EXTRA), np.float32)
    for i, text in enumerate(column):
        text = text.as_py()
        words = text.split() if text else []
        if not words:
            continue
        m = len(words)
        again = sum(map(str.__eq__, words, words[1:]))
        lines = text.split("\n")
        extra[i] = (np.log1p(m), again / m, len(set(words)) / m, len(set(words)) / m ** 0.8,
                    np.log1p(len(text) / m), len(set(lines)) / len(lines), np.log1p(m / len(lines)), 1.0)
    return np.hstack([np.sqrt(pairs / total), extra])


def _sample(rows: DataFrame, bound: int, key: Column) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of their id."""
    n = rows.count()
    share = min(1.0, 1.2 * bound / max(n, 1))
    h = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_003))
    return rows.where(h < int(share * 1_000_003) + 1).orderBy(h, key).limit(bound)


def _summed(rows: DataFrame, run, width: int) -> dict:
    """{key: vector of ``width``}: what ``run`` gives per task, (key, vector) rows, added up by key in tasks."""
    import numpy as np

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x, "<f8") for x in table.column("v").to_pylist())
        return pa.table({"k": pa.array([table.column("k")[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    out = rows.mapInArrow(run, "k int, v binary").groupBy("k").applyInArrow(add, "k int, v binary").toArrow()
    return {k: np.frombuffer(v, "<f8") for k, v in zip(out.column("k").to_pylist(), out.column("v").to_pylist())}


def _emit(sums: dict):
    """Record batches of (key, vector) rows."""
    import pyarrow as pa

    keys = list(sums)
    for lo in range(0, len(keys), 256):
        part = keys[lo:lo + 256]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([sums[k].tobytes() for k in part], pa.binary())], names=["k", "v"])


def spread_of(pool: DataFrame):
    """(mean, deviation) of every feature over the pool."""
    import numpy as np

    def run(batches):
        from cartograph.llm.chars import slices

        total = np.zeros(2 * WIDTH + 1)
        for b in batches:
            for _, texts in slices(b.column(0)):
                x = features(texts).astype(np.float64)
                total += np.concatenate((x.sum(axis=0), (x * x).sum(axis=0), [len(x)]))
        yield from _emit({0: total})

    total = _summed(pool.select("text"), run, 2 * WIDTH + 1).get(0)
    if total is None or not total[-1]:
        return np.zeros(WIDTH), np.ones(WIDTH)
    mean = total[:WIDTH] / total[-1]
    dev = np.sqrt(np.maximum(total[WIDTH:-1] / total[-1] - mean * mean, 0))
    dev[dev < 1e-3] = 1.0
    return mean, dev


def normal(texts, mean, dev):
    """Feature rows in deviations from the mean, cut at 6, and a one."""
    import numpy as np

    x = np.clip((features(texts) - mean) / dev, -6, 6)
    return np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)


def moments(marked: DataFrame, mean, dev) -> list[dict]:
    """Per half of the pool: rows, mean and second moments of P and of U, from (text, is_p, half)."""
    import numpy as np

    width = WIDTH + 1

    def run(batches):
        from cartograph.llm.chars import slices

        sums: dict[int, np.ndarray] = {}
        second: dict[tuple, np.ndarray] = {}
        for b in batches:
            is_p = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            half = b.column(2).to_numpy(zero_copy_only=False)
            for lo, texts in slices(b.column(0)):
                z = normal(texts, mean, dev)
                for h in (0, 1):
                    here = half[lo:lo + len(z)] == h
                    for p, rows in ((0, z[here]), (1, z[here & is_p[lo:lo + len(z)]])):
                        if len(rows):
                            second[h, p] = second.get((h, p), 0) + (rows.T @ rows).astype(np.float64)
        for (h, p), m in second.items():
            for k in range(width):
                sums[(2 * h + p) * width + k] = m[k]
        yield from _emit(sums)

    got = _summed(marked.select("text", "is_p", "half"), run, width)
    out = []
    for h in (0, 1):
        part = {}
        for p, name in ((0, "u"), (1, "p")):
            m = np.array([got.get((2 * h + p) * width + k, np.zeros(width)) for k in range(width)])
            part[name] = m                      # the last row holds sums and, at its end, the number of rows
        out.append(part)
    return out


def first_scores(marked: DataFrame, mean, dev, w):
    """Numbers of U and P rows of the second half per bin of their first score."""
    import numpy as np

    def run(batches):
        from cartograph.llm.chars import slices

        total = np.zeros((2, BINS))
        for b in batches:
            is_p = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, texts in slices(b.column(0)):
                g = normal(texts, mean, dev) @ w
                at = np.clip(((g + SPREAD) * (BINS / (2 * SPREAD))).astype(int), 0, BINS - 1)
                total[0] += np.bincount(at, minlength=BINS)
                total[1] += np.bincount(at[is_p[lo:lo + len(at)]], minlength=BINS)
        yield from _emit({0: total.ravel()})

    total = _summed(marked.where("half = 1").select("text", "is_p"), run, 2 * BINS).get(0)
    return np.zeros((2, BINS)) if total is None else total.reshape(2, BINS)


def _minimise(gradient, width: int, steps: int, rate: float = 0.05):
    """Adam on a full-batch gradient."""
    import numpy as np

    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def _sigmoid(z):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(p_scores, u_scores, p_times=None, u_times=None) -> float:
    """Share of positives in U: the least ratio of tail shares U/P over thresholds.

    Only tails with enough of P count; a margin for the sampling error of both
    shares keeps tiny tails from deciding. ``times`` are the scores' numbers.
    """
    import numpy as np

    p_times = np.ones(len(p_scores)) if p_times is None else p_times
    u_times = np.ones(len(u_scores)) if u_times is None else u_times
    n_p, n_u = p_times.sum(), u_times.sum()
    order = np.argsort(p_scores)
    reached = np.cumsum(p_times[order]) / n_p
    cut = np.unique(p_scores[order][np.minimum(np.searchsorted(reached, np.linspace(0.02, 0.9, 60)), len(order) - 1)])
    best, prior = np.inf, 1.0
    margin = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    for c in cut:
        p, u = p_times[p_scores >= c].sum() / n_p, u_times[u_scores >= c].sum() / n_u
        if u / p + margin / p < best:
            best, prior = u / p + margin / p, u / p
    return float(np.clip(prior, 0.05, 0.98))


def mean_moments(m):
    """(mean row, mean second moments) from summed second moments of rows that end in a one."""
    return m[-1] / m[-1, -1], m / m[-1, -1]


def risk(w, m_p, a_p, m_u, a_u, prior: float):
    """(positive part, negative part) of the unbiased risk with square loss."""
    loss = lambda sign, m, a: (w @ a @ w - sign * 2 * w @ m + 1) / 4
    return prior * loss(1, m_p, a_p), loss(-1, m_u, a_u) - prior * loss(-1, m_p, a_p)


def risk_gradient(w, m_p, a_p, m_u, a_u, prior: float):
    """Gradients of both parts."""
    slope = lambda sign, m, a: (a @ w - sign * m) / 2
    return prior * slope(1, m_p, a_p), slope(-1, m_u, a_u) - prior * slope(-1, m_p, a_p)


def fit_nnpu(positive, unlabelled, prior: float, steps: int = 400):
    """Weights that minimise the non-negative risk, from (mean, second moments) of both sets.

    Starts at the minimum of the unbiased risk. As long as its negative part is
    below zero there, that part is ascended, else the whole risk is descended.
    """
    import numpy as np

    given = (*positive, *unlabelled, prior)
    reg = np.full(len(positive[0]), DECAY)
    reg[-1] = 0
    curved = unlabelled[1] / 2 + np.diag(reg + 1e-9)
    w = np.linalg.solve(curved, prior * positive[0] - unlabelled[0] / 2)
    if risk(w, *given)[1] >= 0:
        return w
    curved = (unlabelled[1] + prior * positive[1]) / 2 + np.diag(reg + 1e-9)      # bounds the curve of both parts
    rate = 0.1
    best, low = w, np.inf
    for _ in range(steps):
        up, down = risk_gradient(w, *given)
        plus, minus = risk(w, *given)
        if plus + max(minus, 0) < low:
            best, low = w, plus + max(minus, 0)
        w = w - rate * np.linalg.solve(curved, (up + down if minus >= 0 else -down) + reg * w)
    return best


def fit(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, prior: float | None = None) -> dict:
    """Fit on the training fold. A document counts as positive if every label of it is 1.

    Without positives or texts there is nothing to learn; the model then
    scores 0.5 everywhere.
    """
    import numpy as np

    train = ~held_out(F.col("doc_id"))
    good = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & train)
            .groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id"))
    p_ids = _sample(good, max_positives, F.col("doc_id")).withColumn("is_p", F.lit(True))
    pool = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & train)
    # the ids are bounded by a parameter, so they may be broadcast
    marked = pool.join(F.broadcast(p_ids), "doc_id", "left").select(
        "text", F.coalesce("is_p", F.lit(False)).alias("is_p"), F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"))
    nothing = {"mean": np.zeros(WIDTH), "dev": np.ones(WIDTH), "w": np.zeros(WIDTH + 1), "prior": 0.5}
    mean, dev = spread_of(pool)
    halves = moments(marked, mean, dev)
    both = {k: halves[0][k] + halves[1][k] for k in "pu"}
    if not both["p"][-1, -1] or not both["u"][-1, -1]:
        return nothing
    if prior is None:
        prior = 0.5
        if all(h[k][-1, -1] for h in halves for k in "pu"):
            (m_p, a_p), (m_u, a_u) = (mean_moments(halves[0][k]) for k in "pu")
            apart = np.linalg.solve(a_p + a_u + 1e-2 * np.eye(WIDTH + 1), m_p - m_u)
            times = first_scores(marked, mean, dev, apart)
            at = (np.arange(BINS) + 0.5) * (2 * SPREAD / BINS) - SPREAD
            prior = estimate_prior(at, at, times[1], times[0])
    w = fit_nnpu(mean_moments(both["p"]), mean_moments(both["u"]), prior)
    return {"mean": mean, "dev": dev, "w": STEEP * w, "prior": prior}


def score(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """``docs`` with a score column: one pass over whole texts, no shuffle."""
    kept = docs.columns
    place = kept.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from cartograph.llm.chars import slices

        for b in batches:
            z = [np.zeros(0)]
            for _, texts in slices(b.column(place)):
                x = features(texts)
                z.append(np.clip((x - model["mean"]) / model["dev"], -6, 6) @ model["w"][:-1] + model["w"][-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_sigmoid(np.concatenate(z)), pa.float64())], names=[*kept, out])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's columns. Repeated rows are scored alike; an empty table gives no rows."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier keeps, all their columns and no others."""
    taken = set(docs.columns)
    name = next(n for n in ("score", "_score", "__score", "___score") if n not in taken)
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).select(*docs.columns)
