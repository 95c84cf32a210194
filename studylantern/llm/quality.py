"""Quality classifier with hierarchical empirical Bayes (operator 10).

1. A logistic model over shape features of the text (characters by class, repetition of words and lines, lengths) gives
   each document its own evidence. It is fitted on a bounded sample of labelled rows.
2. Grouped sums of that evidence by path within host, by host and over all documents form a hierarchy. The global mean is
   the prior of the hosts, a host's posterior mean the prior of its paths; the strength of each prior comes from the
   spread between groups (method of moments), so sparse sites shrink towards what lies above them.
3. A document's posterior log odds are its own log odds, moved from the global prior to that of its path.

What a path adds is bounded by `most_shift`, so that a clean document of a bad site is not lost by its address alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylantern.llm.common import settle, utf8

#: Rows of the training sample at most, and the share of them held out for the accuracy that fit() reports.
SAMPLE_ROWS, HELD_OUT = 20_000, 0.2
FEATURES = ("symbols", "upper", "digits", "distinct_words", "word_length", "repeated_lines", "log_words", "stops", "shouted", "beyond_ascii")


def _classes() -> np.ndarray:
    """For each byte: symbol, upper-case letter, digit, full stop, exclamation mark, lead byte beyond ASCII."""
    out = np.zeros((6, 256), np.uint8)
    out[0, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"-()"]] = 1
    out[1, ord("A") : ord("Z") + 1] = out[2, ord("0") : ord("9") + 1] = out[3, ord(".")] = out[4, ord("!")] = 1
    out[5, 192:] = 1
    return out


def features(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """One row of FEATURES for each text; null counts as empty."""
    data, at = utf8(batch, column)
    classes, n = _classes(), batch.num_rows
    counts = np.zeros((6, n))
    for first in range(0, n, 64):  # in steps, so that memory stays near that of the texts
        stop = min(n, first + 64)
        piece = data[at[first] : at[stop]]
        for k in range(6):
            sums = np.concatenate(([0], np.cumsum(classes[k][piece], dtype=np.int64)))
            counts[k, first:stop] = np.diff(sums[at[first : stop + 1] - at[first]])
    chars = np.maximum(1, np.diff(at))
    out = np.zeros((n, len(FEATURES)))
    for i, text in enumerate(batch.column(column)):
        text = text.as_py() or ""
        words, lines = text.split(), text.split("\n")
        k = max(1, len(words))
        out[i, 3:7] = len(set(words)) / k, len(text) / k, 1 - len(set(lines)) / len(lines), np.log1p(len(words))
        out[i, 7:9] = counts[3, i] / k, counts[4, i] / k
    out[:, :3] = (counts[:3] / chars).T
    out[:, 9] = counts[5] / chars
    return out


@dataclass(frozen=True)
class Model:
    """Log odds of good quality: bias + (features - mean) / scale . weights. prior: log odds over the training rows."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float
    held_out_accuracy: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.weights) + self.bias, -15, 15)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Newton steps; the first column is the bias."""
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most `sample_rows` labelled rows, those with the lowest hash of the id: the only bounded step here.

    Texts of the sample are reduced to features in the tasks; the driver gets a few numbers for each row. Rows without
    id or label are not used; without both kinds of label the model is neutral (every document has the prior's odds).
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(label_col).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch, "text")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(chosen, "id").select("id", "y", "text").mapInArrow(run, "id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["id"] * 0x9E3779B97F4A7C15 % 2**64, r["x"]))
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        flat = (0.0,) * len(FEATURES)
        return Model(flat, (1.0,) * len(FEATURES), flat, 0.0, 0.0, float("nan"))
    x = np.array([r["x"] for r in rows])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    held = int(len(x) * HELD_OUT)
    tried = _logistic(z[held:], y[held:])
    accuracy = float(np.mean((z[:held] @ tried > 0) == (y[:held] > 0))) if held else float("nan")
    w = _logistic(z, y)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    return Model(tuple(mean), tuple(scale), tuple(w[1:]), float(w[0]), float(np.log(rate / (1 - rate))), accuracy)


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text", into: str = "evidence") -> DataFrame:
    """All columns of docs and the classifier's log odds. Map only."""
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.log_odds(features(batch, text_col)))], [*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def _strength(groups: DataFrame, above: str) -> float:
    """Prior weight in documents, by the method of moments: the spread of group means beyond that of sampling."""
    m, n = F.col("good") / F.col("n"), F.col("n")
    r = groups.agg(
        F.sum(n * (m - F.col(above)) ** 2).alias("between"), F.sum(F.col(above) * (1 - F.col(above))).alias("within"),
        F.sum(n).alias("total"), F.count("*").alias("k"), F.avg(F.col(above) * (1 - F.col(above))).alias("variance"),
    ).first()
    if not r["k"] or r["k"] < 2 or not r["variance"]:
        return 100.0
    tau = max((r["between"] - r["within"]) / r["total"], 1e-6)
    return float(np.clip(r["variance"] / tau - 1, 1.0, 1e6))


def site_posteriors(evidence: DataFrame, host: str = "host", path: str = "path", log_odds: str = "evidence") -> tuple[DataFrame, float]:
    """host, path, host_posterior, path_posterior: shares of good documents; and the global share.

    Sums by path are the only shuffle of document rows and are pre-aggregated in the map tasks, so a host with a third
    of all rows is no hot spot. A null host or path is a group of its own.
    """
    soft = 1 / (1 + F.exp(-F.col(log_odds)))
    paths = settle(evidence.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.sum(soft).alias("good"), F.count("*").alias("n")), "paths")
    r = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    share = float(np.clip(r["good"] / r["n"], 1e-6, 1 - 1e-6)) if r["n"] else 0.5
    hosts = settle(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "hosts")
    k = _strength(hosts.withColumn("above", F.lit(share)), "above")
    hosts = hosts.select("host", ((F.col("good") + k * share) / (F.col("n") + k)).alias("host_posterior"))
    known = settle(paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "host_posterior"), "known")
    k = _strength(known, "host_posterior")
    return settle(known.select("host", "path", "host_posterior", ((F.col("good") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior")), "posteriors"), share


def classify(
    docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang", text_col: str = "text", threshold: float = 0.5, prefix: str = "q_"
) -> DataFrame:
    """docs with q_evidence, q_host_posterior, q_path_posterior (shares), q_score (posterior share) and q_keep.

    Kept are documents whose posterior share of good quality is at least `threshold`. A document's log odds are its evidence
    moved by those of its path over the global ones, in full; sparse paths and hosts have been shrunk before. Every row is
    scored: null and empty texts by their features (no words), null hosts and paths as groups of their own, repeated rows
    alike. `prefix` names the added columns; take another one (`free_name`) where docs has such columns. Texts pass
    through map tasks only; the join of posteriors is small on one side.
    """
    narrow = with_evidence(docs.select(F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text")), model).drop("text")
    sites, share = site_posteriors(settle(narrow, "evidence"))
    site, evidence, by_host, by_path = (f"{prefix}{c}" for c in ("site", "evidence", "host_posterior", "path_posterior"))
    sites = sites.select(F.struct(F.col("host").alias("a"), F.col("path").alias("b")).alias(site), F.col("host_posterior").alias(by_host), F.col("path_posterior").alias(by_path))
    scored = with_evidence(docs, model, text_col, evidence).withColumn(
        site, F.struct(F.col(host_col).cast("string").alias("a"), F.col(path_col).cast("string").alias("b"))
    )
    joined = scored.join(sites, scored[site].eqNullSafe(sites[site]), "left").drop(site)
    odds = lambda p: F.log(p / (1 - p))
    held = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))  # noqa: E731  a site without any doubt has no log odds
    shift = F.coalesce(odds(held(F.col(by_path))), odds(F.lit(share))) - odds(F.lit(share))
    return joined.withColumn(f"{prefix}score", 1 / (1 + F.exp(-(F.col(evidence) + shift)))).withColumn(f"{prefix}keep", F.col(f"{prefix}score") >= threshold)
