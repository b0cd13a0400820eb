"""Quality rules with host verdicts: rule failures by host, shrunk rates, and the verdict joined back to documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from devicehealth.llm import arrays
from devicehealth.session import cut_lineage, small

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 3
#: Prefix of the columns made here, so that none of the caller's is hidden.
OWN = "__dh_"

#: Rules on the counts of a document, as SQL; each names a failure.
RULES = {
    "short": "{n_words} < 50",
    "repeats": "100 * {n_repeat_words} > 50 * {n_words}",
    "some_repeats": "100 * {n_repeat_words} > 20 * {n_words}",
    "symbols": "10 * {n_symbols} > {n_words}",
    "dup_lines": "10 * {n_dup_lines} > 3 * {n_lines}",
    "word_length": "{word_chars} < 2 * {n_words} or {word_chars} > 25 * {n_words}",
}
#: Rules that a document may not fail on any host.
BASE = ["short", "repeats"]
#: A host is granted as many failures of other rules as times its shrunk rate, doubled again and again, stays within the pooled
#: rate; at most so many.
GRANTED = 2


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a buffer."""
    n = len(offsets) - 1
    starts, ends, first = arrays.words(data, offsets)
    in_word = ~arrays.SPACE[data]
    n_words = np.diff(first)
    out = {"n_words": n_words, "word_chars": arrays.span_sums(in_word & ((data & 0xC0) != 0x80), offsets),
           "n_symbols": arrays.span_sums(_SYMBOL[data], offsets)}

    # Lines that hold a word, and how many of them equal an earlier one of the same text.
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    after_break = np.flatnonzero(data == 10) + 1
    line_starts = np.unique(np.concatenate([offsets[:-1], after_break[~cut[after_break]]]))
    line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
    line_ends = line_ends - ((line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10)) if len(data) else line_ends
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    owner = np.searchsorted(offsets, line_starts, "right") - 1
    out["n_lines"] = np.bincount(owner, minlength=n)[:n]
    key = arrays.spans_hash(data, line_starts, line_ends) + arrays.mix(owner.astype(np.uint64) + np.uint64(1))
    _, one = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[one], minlength=n)[:n]

    # Words covered by a window of three that the text holds twice or more.
    covered = np.zeros(len(starts), bool)
    if len(starts) >= WINDOW:
        doc = np.repeat(np.arange(n), n_words)
        h = arrays.spans_hash(data, starts, ends)
        at = np.flatnonzero(doc[:-2] == doc[2:])
        key = arrays.mix(h[at] + np.uint64(3) * h[at + 1] + np.uint64(7) * h[at + 2]) + arrays.mix(doc[at].astype(np.uint64) + np.uint64(1))
        twice = at[_repeated(key)]
        for k in range(WINDOW):
            covered[twice + k] = True
    out["n_repeat_words"] = arrays.span_sums(covered, first)
    return out


def with_counts(docs: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """Documents with their counts, names as in ``COUNTS`` behind ``OWN``; a null text counts as empty."""
    kept = [f for f in docs.schema if not (drop_text and f.name == text)]
    schema = T.StructType([*kept, *(T.StructField(f"{OWN}{c}", T.LongType()) for c in COUNTS)])
    at = docs.columns.index(text)
    keep = [i for i, f in enumerate(docs.schema) if not (drop_text and f.name == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
            for _, _, data, offsets in arrays.chunks(batch.column(at)):
                counts = text_counts(data, offsets)
                for c in COUNTS:
                    found[c].append(counts[c])
            new = [pa.array(np.concatenate(found[c]) if found[c] else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def _failure(rule: str) -> F.Column:
    return F.expr(RULES[rule].format(**{c: f"{OWN}{c}" for c in COUNTS}))


def host_rates(counted: DataFrame, host: str = "source") -> DataFrame:
    """``(host, docs, failed, rate, pooled)``: the share of documents failing a rule, shrunk towards the share of all hosts.

    The beta prior is fitted to all hosts by moments: its mean is the pooled share, its strength what the spread
    between hosts leaves beyond chance. A host with few documents stays near the pooled share. The null host is a host.
    """
    any_rule = F.greatest(*(_failure(r).cast("int") for r in RULES))
    hosts = cut_lineage(counted.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(any_rule).alias("failed")))
    pooled = hosts.agg(F.sum("docs").alias("n"), F.sum("failed").alias("k"), F.count(F.lit(1)).alias("h"),
                       F.sum(F.col("failed") * F.col("failed") / F.col("docs")).alias("q"), F.sum(F.col("docs") * F.col("docs")).alias("nn")).first()
    n, k, h = pooled["n"] or 0, pooled["k"] or 0, pooled["h"]
    mean = (k + 1) / (n + 2)
    spread = 0.0
    if h > 1:
        # Variance between hosts beyond that of the draws, by the weighted analysis of variance.
        between = float(pooled["q"]) - k * k / n
        spare = n - float(pooled["nn"]) / n
        spread = max(0.0, (between - (h - 1) * mean * (1 - mean)) / spare) if spare > 0 else 0.0
    strength = min(1e6, max(2.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    return hosts.withColumns({"rate": (F.col("failed") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength)), "pooled": F.lit(mean)})


def judged(docs: DataFrame, host: str = "source", text: str = "text", drop_text: bool = False) -> DataFrame:
    """Documents with the counts, ``base_failed``, ``failures``, ``granted`` and ``kept``, all behind ``OWN``.

    A document goes if it fails a base rule, or more other rules than its host is granted: none on a host whose shrunk
    failure rate is above half of the pooled rate, one on a host within the half, two within the quarter (``GRANTED``).
    A document that fails no rule stays whatever its host. Null text: no words, so it fails the length rule. Null host:
    one host of its own. Repeated rows: each is judged, and counts in its host's rate. No rows: no rows. Other columns pass through.
    The counts are made twice, once for the hosts, whose few rows are checkpointed, and once for the rows, so no text is shuffled or stored.
    """
    hosts = host_rates(with_counts(docs.select(F.col(host).alias(host), F.col(text).alias(text)), text, drop_text=True), host)
    grant = sum(((F.col("rate") * F.lit(float(2 << k)) <= F.col("pooled")).cast("int") for k in range(GRANTED)), F.lit(0))
    trusted = hosts.withColumn(f"{OWN}granted", grant).where(f"{OWN}granted > 0").select(F.col("host").alias(f"{OWN}host"), f"{OWN}granted")
    other = sum((_failure(r).cast("int") for r in RULES if r not in BASE), F.lit(0))
    base = F.lit(False)
    for r in BASE:
        base = base | _failure(r)
    counted = with_counts(docs, text, drop_text).withColumns({f"{OWN}base_failed": base, f"{OWN}failures": other})
    joined = counted.join(small(trusted), counted[host].eqNullSafe(F.col(f"{OWN}host")), "left").drop(f"{OWN}host")
    return joined.withColumn(f"{OWN}granted", F.coalesce(f"{OWN}granted", F.lit(0))).withColumn(
        f"{OWN}kept", ~F.col(f"{OWN}base_failed") & (F.col(f"{OWN}failures") <= F.col(f"{OWN}granted")))


def quality_filter(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs, host, text).where(f"{OWN}kept").select(*docs.columns)
