"""Mixing sources to target weights: soft membership and projected-gradient least squares.

Documents carry a source label or none. A classifier fitted on a bounded sample of the labelled ones
predicts the source posteriors of the others; a labelled document belongs to its source alone. Every
document gets a non-negative rate, at most the repeats its source allows, so that the expected tokens
of each source match its share of the total. The rates are fitted by projected gradient steps over the
distributed table; only one vector with an entry per target travels in each step. Documents of one
source, and unlabelled ones of one membership, have the same rate in every step and are summed up beforehand.

Rates become whole repeats by error diffusion within buckets of a source, so the reached token totals
follow the fitted ones closely at any size.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.runtime import materialize, spread, with_scalars

#: Folder of public tokenizer files; a parameter of every call that counts tokens.
TOKENIZERS = "/opt/tokenizers"
#: Labelled documents the classifier is fitted on at most.
SAMPLE = 4000
FEATURES = 1 << 14
#: Gradient steps at most (the report says whether they sufficed), and parts of a membership.
MAX_STEPS, GRAIN = 200, 64
#: Different memberships up to which the fit runs on the driver (an array of that many rows and a column per target).
MOST_CELLS = 50_000

# Fixed value: the published split pattern of the 50k byte-level vocabulary.
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORD = re.compile(r"[^\W\d_]+|\d|[^\w\s]")


@lru_cache(maxsize=4)
def encoder(folder: str, vocabulary: str = "byte_bpe_50k.tiktoken"):
    """Encoder of a public vocabulary, made once per process."""
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts, folder: str = TOKENIZERS) -> list[int]:
    """Tokens of each text; none for null."""
    e = encoder(folder)
    return [len(t) for t in e.encode_ordinary_batch([t or "" for t in texts], num_threads=1)]


def _features(text: str) -> dict[int, int]:
    """Hashed words, and the marks that begin lines."""
    found: dict[int, int] = {}
    for line in (text or "").split("\n"):
        words = _WORD.findall(line.lower())
        for w in words[:1]:
            words.append("^" + w)
        for w in words:
            k = zlib.crc32(w.encode()) % FEATURES
            found[k] = found.get(k, 0) + 1
    return found


class SourceClassifier:
    """Multinomial naive Bayes over hashed words, its posteriors softened to fit held-out labels."""

    def __init__(self, texts: list[str], labels: list[str], classes: list[str]):
        self.classes = classes
        at = {c: k for k, c in enumerate(classes)}
        rows = [(_features(t), at[c]) for t, c in zip(texts, labels, strict=True)]
        held = rows[::5] if len(rows) >= 50 else []
        counts = np.full((len(classes), FEATURES), 0.1)
        prior = np.zeros(len(classes))
        for f, k in [r for i, r in enumerate(rows) if not held or i % 5]:
            counts[k, list(f)] += np.minimum(list(f.values()), 3)
            prior[k] += 1
        self.weights = np.log(counts / counts.sum(axis=1, keepdims=True))
        # a class without labelled documents is never predicted
        self.prior = np.log(np.maximum(prior, 1e-300) / max(1.0, prior.sum())) if prior.any() else np.zeros(len(classes))
        self.seen = prior > 0
        self.temperature = 1.0
        if held:
            logits = [(self._logits(f), k) for f, k in held]
            loss = lambda t: -sum(np.log(_softmax(x / t + self.prior)[k] + 1e-12) for x, k in logits)
            self.temperature = min((1, 2, 4, 8, 16, 32, 64, 128, 1e6), key=loss)
            self.accuracy = sum(int(np.argmax(x / self.temperature + self.prior)) == k for x, k in logits) / len(logits)

    def _logits(self, f: dict[int, int]) -> np.ndarray:
        return self.weights[:, list(f)] @ np.minimum(list(f.values()), 3) if f else np.zeros(len(self.classes))

    def posterior(self, text: str | None) -> np.ndarray:
        p = _softmax(self._logits(_features(text or "")) / self.temperature + self.prior) * self.seen
        return p / p.sum() if p.any() else p


def membership(p: np.ndarray) -> list[float]:
    """A posterior in ``GRAIN`` parts, so that documents of one membership can be summed up before the fit."""
    q = np.floor(p * GRAIN + 0.5)
    return (q / q.sum()).tolist() if q.any() else p.tolist()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_classifier(documents: DataFrame, classes: list[str], sample: int = SAMPLE) -> SourceClassifier:
    """Classifier from at most ``sample`` labelled documents (``source, text``), chosen by a hash of the text."""
    labelled = documents.where(F.col("source").isin(classes) & F.col("text").isNotNull()) if classes else documents.limit(0)
    n = labelled.count()
    share = min(1_000_000, 2 * sample * 1_000_000 // max(1, n) + 1)
    chosen = labelled.withColumn("_h", F.pmod(F.xxhash64("text"), F.lit(1_000_000))).where(F.col("_h") < share).orderBy("_h", "source", "text").limit(sample).collect()
    return SourceClassifier([r["text"] for r in chosen], [r["source"] for r in chosen], classes)


def clean_source(column: str = "source"):
    """Source name without blanks around it, in lower case; null when empty."""
    name = F.lower(F.trim(column))
    return F.when(name != "", name)


def mix(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Repeats of every document and the report of shares.

    ``documents``: ``doc_id, text, source``; ``targets``: ``source, target_share, max_repeats``.
    Returns ``(doc_id, source, labelled, tokens, rate, repeats)`` for the documents of the mix and, per
    target, ``source, target_share, max_repeats, n_documents, tokens_available, fitted_share,
    tokens_mixed, reached_share, assigned_share, repeats_most, residual, converged``: ``fitted_share`` is what
    the rates are expected to give by the memberships, ``reached_share`` what the whole repeats give by
    them, ``assigned_share`` (with ``n_documents`` and the token counts) books an unlabelled document whole to
    its likeliest source. ``residual`` is the worst relative distance of the fitted tokens of a target from
    its goal; ``converged`` says whether it is within ``tolerance``.

    The mix is as large as the targets allow. Defined cases: a target without documents cannot be
    reached: it is reported with share 0 and the others keep their proportions; documents of other
    sources, and null or empty texts, are not used; null shares and repeats count as 0; without targets
    or documents the mix is empty; repeated documents are documents like any other; repeated targets
    are added up.
    """
    spark = documents.sparkSession
    wanted = (
        targets.select(clean_source().alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("most"))
        .where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("share").alias("share"), F.max("most").alias("most")).orderBy("source").collect()
    )  # fmt: skip  one row per target
    classes = [r["source"] for r in wanted]
    share = np.array([r["share"] for r in wanted], dtype=float)
    most = np.array([r["most"] for r in wanted], dtype=float)
    base = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", clean_source().alias("source"))
    model = spark.sparkContext.broadcast(fit_classifier(base, classes))  # targets x FEATURES

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            p = [membership(m.posterior(t)) if s is None and m.classes else None for s, t in zip(batch["source"], batch["text"], strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": count_tokens(batch["text"], tokenizers), "posterior": p})

    known = F.col("source").isNull() | F.col("source").isin(classes) if classes else F.lit(False)
    read_docs = materialize(spread(base.where(known)).mapInPandas(read, "doc_id string, source string, tokens bigint, posterior array<double>").where("tokens > 0"), "tokens")

    # labelled documents of a source move together: one row each
    hard = np.zeros(len(classes))
    for r in read_docs.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("t")).collect():
        hard[classes.index(r["source"])] = r["t"]
    # equal memberships have equal rates: one row each
    soft = materialize(read_docs.where("source is null").groupBy("posterior").agg(F.sum("tokens").alias("tokens")), "memberships")
    dims = len(classes)
    # so few rows of so many numbers fit the driver, which then saves a job for each step; more stay distributed
    held = None
    if dims and soft.count() <= MOST_CELLS:
        rows_held = soft.collect()
        held = np.array([r["posterior"] for r in rows_held], dtype=float).reshape(-1, dims), np.array([r["tokens"] for r in rows_held], dtype=float)

    def totals(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each target after these steps, and its capacity. The history gives every rate anew: no state to lose."""

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                p = np.array(batch["posterior"].tolist())
                t = batch["tokens"].to_numpy(dtype=float)
                r, cap = _rates(p, most, steps)
                yield pd.DataFrame([np.concatenate([(r * t) @ p, (cap * t) @ p, t @ p])], columns=[f"c{k}" for k in range(3 * dims)])

        if held is not None:
            p, t = held
            r, cap = _rates(p, most, steps)
            row = np.concatenate([(r * t) @ p, (cap * t) @ p, t @ p])
        else:
            columns = [f"c{k}" for k in range(3 * dims)]
            row = soft.mapInPandas(fold, ", ".join(f"{c} double" for c in columns)).agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in columns]).first()[:]
        parts = np.array(row, dtype=float).reshape(3, dims)
        r, cap = _rates(np.eye(dims), most, steps)
        return parts[0] + hard * r, parts[1] + hard * cap, parts[2] + hard

    steps, residual = np.zeros((1, dims)), 0.0
    goal = np.zeros(dims)
    if dims:
        _, capacity, mass = totals(steps)
        reachable = (capacity >= 1) & (share > 0)
        if reachable.any():
            total = float(np.min(capacity[reachable] / share[reachable]))
            goal = np.where(reachable, share * total, 0)
        # first rates: the goal over the capacity, as a step up from nothing
        start = np.where(capacity > 0, goal / np.maximum(capacity, 1e-9), 0) * most
        steps = -start[None, :]
        best, best_steps, reached = np.inf, steps, goal
        for _ in range(MAX_STEPS):
            now, _, _ = totals(steps)
            error = now - goal
            worst = float(np.max(np.abs(error[reachable]) / np.maximum(goal[reachable], 1))) if reachable.any() else 0.0
            if worst < best:
                best, best_steps, reached = worst, steps, now
            if worst <= tolerance:
                break
            steps = np.vstack([steps, np.where(mass > 0, error / np.maximum(mass, 1e-9), 0)])
        steps, residual = best_steps, best
    fitted = reached if dims else goal

    # rates, then whole repeats by error diffusion in buckets of a source
    counts = {r["source"]: r["count"] for r in read_docs.groupBy("source").count().collect()}
    names = classes

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labelled = batch["source"].notna().to_numpy()
            p = np.zeros((len(batch), dims))
            for k, (s, post) in enumerate(zip(batch["source"], batch["posterior"], strict=True)):
                if labelled[k]:
                    p[k, names.index(s)] = 1
                else:
                    p[k] = post
            r, _ = _rates(p, most, steps)
            own = p.argmax(axis=1) if len(batch) else []
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": [names[k] for k in own], "labelled": labelled, "tokens": batch["tokens"], "posterior": batch["posterior"], "rate": r})

    rated = read_docs.mapInPandas(assign, "doc_id string, source string, labelled boolean, tokens bigint, posterior array<double>, rate double")
    buckets = F.lit(max(1, counts.get(None, 0) // 5000))
    for c in classes:
        buckets = F.when((F.col("source") == c) & F.col("labelled"), F.lit(max(1, counts.get(c, 0) // 5000))).otherwise(buckets)
    rated = rated.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), buckets))

    def diffuse(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_h=[zlib.crc32(str(d).encode()) for d in group["doc_id"]]).sort_values(["_h", "doc_id", "tokens"], kind="stable")
        repeats, owed = [], 0.0
        for rate, tokens, source in zip(group["rate"], group["tokens"], group["source"], strict=True):
            cap = int(most[names.index(source)])
            owed += rate * tokens
            n = int(min(cap, max(0, np.floor(owed / tokens + 0.5))))
            # whole rates stay whole; others are rounded up or down
            n = min(max(n, int(np.floor(rate + 1e-9))), int(np.ceil(rate - 1e-9)))
            owed -= n * tokens
            repeats.append(n)
        group["repeats"] = np.array(repeats, dtype=np.int64)
        return group[["doc_id", "source", "labelled", "tokens", "posterior", "rate", "repeats"]]

    chosen = materialize(rated.groupBy("source", "labelled", "bucket").applyInPandas(diffuse, "doc_id string, source string, labelled boolean, tokens bigint, posterior array<double>, rate double, repeats bigint"), "mix")
    used = chosen.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum("tokens").alias("tokens_available"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_mixed"),
        F.max("repeats").alias("repeats_most"),
    )
    # tokens of the mix by membership: labelled documents whole, others in parts
    mixed = F.col("tokens") * F.col("repeats")
    whole_tokens = chosen.where("labelled").select("source", mixed.cast("double").alias("t"))
    parts = chosen.where("not labelled and repeats > 0").select(F.posexplode("posterior").alias("k", "p"), mixed.alias("t")).where("p > 0")
    names_of = F.array(*[F.lit(c) for c in classes]) if classes else F.array().cast("array<string>")
    shared = parts.select(F.get(names_of, "k").alias("source"), (F.col("p") * F.col("t")).alias("t"))
    by_membership = whole_tokens.unionByName(shared).groupBy("source").agg(F.sum("t").alias("tokens_by_membership"))
    used = used.join(by_membership, "source", "full")
    rows = [(r["source"], float(r["share"]), int(r["most"]), float(g)) for r, g in zip(wanted, fitted / fitted.sum() if fitted.sum() else fitted, strict=True)]
    plan = spark.createDataFrame(rows, "source string, target_share double, max_repeats bigint, fitted_share double")
    whole = used.agg(F.sum("tokens_mixed").alias("_all"))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = with_scalars(plan.join(used, "source", "left"), whole).select(
        "source", "target_share", "max_repeats", zero("n_documents"), zero("tokens_available"), "fitted_share", zero("tokens_mixed"),
        F.coalesce(F.col("tokens_by_membership") / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0)).alias("reached_share"),
        F.coalesce(F.col("tokens_mixed") / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0)).alias("assigned_share"), zero("repeats_most"),
        F.lit(float(residual)).alias("residual"), F.lit(bool(residual <= tolerance)).alias("converged"),
    )
    used_rows = chosen.where("repeats > 0").withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))
    return used_rows, report


def _rates(p: np.ndarray, most: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates of documents with memberships ``p`` after the projected steps, and their upper bounds."""
    cap = most[p.argmax(axis=1)] if len(p) else np.zeros(0)
    r = np.zeros(len(p))
    for s in steps:
        r = np.clip(r - p @ s, 0, cap)
    return r, cap
