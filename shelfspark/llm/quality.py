"""Quality rules with thresholds that follow each language and source.

Counts are exact per text. For each measure a mergeable quantile sketch is kept
per (lang, source): a histogram over a fixed fine grid (of the arcsine of the
root for shares, of the binary logarithm for sizes), so that sketches merge by
adding counts, in any order, to the same result, and a quantile is off by one
step of the grid at most. Documents that fail the base rule stay out of it. A
group's sketch is topped up by PRIOR documents distributed as its language,
and a language's likewise as the whole, so that small groups lean on larger ones.

From the sketch comes a threshold: at least three quarters of a group count as
ordinary. Where the values above the third quartile fall apart into modes, the
threshold lies in the first valley; where they don't, it lies RANGES
interquartile ranges above the quartile; where the quartiles are equal and no
mode stands apart, nothing is rejected. No measure has a limit of its own. A
join brings each document's thresholds to its counts. What counts of an event
that happened n times is n - 2 sqrt(n), so that chance in a short text is not
taken for a habit.

Defined results: null text has no words, and fails the base rule; null lang or
source are a group of their own; a group of any size has thresholds, but a corpus
of under LEAST documents beyond the base rule has none; repeated rows are judged alike; an empty table gives an empty result; clashing column
names in the input are ignored, for only doc_id, text, lang and source are read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .textops import _STARTS, span_hashes, window_hashes, word_bounds

WINDOW = 8
#: Measures of a document: the events and what they are a share of; for the last a size. Repeated words are the base rule's own.
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "caps_share": ("n_upper", "n_letters"),
    "stutter_share": ("n_stutters", "n_words"),
    "mean_chars": ("word_chars", "n_words"),
}
SIZES = ("mean_chars",)
#: Steps of the sketch's grid in a unit of the scale, and steps that count as one when modes are looked for.
STEPS, COARSE = 256, 8
#: Documents by which a larger group's distribution counts in a smaller one.
PRIOR = 200
#: Documents that a corpus needs for anything to stand apart from them.
LEAST = 50
#: Interquartile ranges over the third quartile, where no mode stands apart.
RANGES = 8
#: A mode: so much of a group, beyond a valley of at most an eighth of the lower peak's height; or anything, beyond an empty stretch of APART coarse steps.
MODE, DEPTH, APART = 0.005, 8, 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Bits of every code point: 1 for a letter, 2 for an upper-case letter.
_CASE = np.zeros(0x110000, np.uint8)
for _point in range(0x110000):
    _kind = unicodedata.category(chr(_point))
    _CASE[_point] = (_kind[0] == "L") + 2 * (_kind == "Lu")
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stutters")


def count_text(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of _FIELDS."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(raw)
    n = len(starts)
    if not n:
        return (0, 0, int(_SYMBOL[raw].sum()), 0, 0, 0, 0, 0, 0)
    begun = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_STARTS[raw], out=begun[1:])
    word_chars = int((begun[ends] - begun[starts]).sum())
    words = span_hashes(raw, starts, ends)
    repeated = 0
    if n >= WINDOW:
        windows = window_hashes(words, WINDOW)
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        hit = times[inverse] > 1
        if hit.any():
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(hit)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    case = _CASE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return (n, word_chars, int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated, len(lines), int((case > 1).sum()), int((case > 0).sum()), int((words[1:] == words[:-1]).sum()))


def _counted(batches):
    for batch in batches:
        rows = [count_text(x.as_py() or "") for x in batch.column("text")]
        counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_FIELDS))]
        keep = [batch.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*keep, *counts], names=["doc_id", "lang", "source", *_FIELDS])


def count_documents(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    schema = "doc_id bigint, lang string, source string, " + ", ".join(f"{x} bigint" for x in _FIELDS)
    return rows.mapInArrow(_counted, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def measure(name: str) -> Column:
    """The measure on its scale."""
    events, whole = (F.col(c).cast("double") for c in MEASURES[name])
    sure = F.greatest(events - 2 * F.sqrt(events), F.lit(0.0)) / whole
    scaled = F.log2(F.greatest(sure, F.lit(1.0))) if name in SIZES else F.asin(F.sqrt(F.least(sure, F.lit(1.0))))
    return F.when(whole > 0, scaled).otherwise(0.0)


def sketch(counts: DataFrame) -> DataFrame:
    """lang, source, measure (its number), bucket, n, of the documents that pass the base rule: mergeable by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("measure"), F.floor(measure(m) * STEPS).cast("int").alias("bucket")) for i, m in enumerate(MEASURES)]))
    return counts.filter(~base_failed()).select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def topped_up(own: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """A histogram with PRIOR documents more, distributed as the parent's."""
    n = max(len(own), len(parent))
    whole = parent.sum()
    return np.pad(own.astype(float), (0, n - len(own))) + (np.pad(parent.astype(float), (0, n - len(parent))) * (PRIOR / whole) if whole else 0)


def threshold(histogram: np.ndarray) -> float:
    """Above which a measure (on its scale) stands apart from its group; infinite if nothing does."""
    total = histogram.sum()
    if not total:
        return float("inf")
    upto = np.cumsum(histogram)
    low, high = (int(np.searchsorted(upto, total * q - 1e-9)) for q in (0.25, 0.75))
    coarse = np.add.reduceat(np.append(histogram, np.zeros(-len(histogram) % COARSE)), np.arange(0, len(histogram), COARSE))
    begin = high // COARSE
    peak_before = np.maximum.accumulate(coarse[begin:])
    after = np.append(np.maximum.accumulate(coarse[:begin:-1])[::-1], 0.0)
    beyond = total - np.cumsum(coarse)[begin:]
    valley = (coarse[begin:] * DEPTH <= np.minimum(peak_before, after)) & (beyond >= MODE * total)
    empty = 0
    for k, h in enumerate(coarse[begin:]):
        # What the prior adds is less than a document.
        empty = empty + 1 if h < 0.5 else 0
        if valley[k] or (empty >= APART and beyond[k] > 0):
            # The middle of the stretch that is as low.
            end = k
            while end + 1 < len(valley) and valley[end + 1] and coarse[begin + end + 1] <= coarse[begin + k]:
                end += 1
            return (begin + (k + end + 1) / 2) * COARSE / STEPS if valley[k] else (begin + k + 1 - empty / 2) * COARSE / STEPS
    return (high + 1 + RANGES * (high - low)) / STEPS if high > low else float("inf")


def _histograms(entries) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0) for _ in MEASURES]
    for i in range(len(MEASURES)):
        own = [(e["bucket"], e["n"]) for e in entries if e["measure"] == i]
        out[i] = np.zeros(max((b for b, _ in own), default=-1) + 1)
        for b, n in own:
            out[i][b] += n
    return out


def _thresholds(batches):
    for batch in batches:
        rows = []
        for own, parent, everything in zip(*(batch.column(c) for c in ("own", "parent", "everything"))):
            levels = [_histograms(x.as_py()) for x in (own, parent, everything)]
            rows.append([threshold(topped_up(a, topped_up(b, c))) if c.sum() >= LEAST else float("inf") for a, b, c in zip(*levels)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("source"), *[pa.array([r[i] for r in rows], pa.float64()) for i in range(len(MEASURES))]],
            names=["fence_lang", "fence_source", *[f"fence_{m}" for m in MEASURES]],
        )


def fences(counts: DataFrame) -> DataFrame:
    """One row per lang and source that has a document beyond the base rule, with a threshold for each measure."""
    groups = stage(sketch(counts), "sketch")
    # A group's entries are bounded by the grid. Parents are sums of their groups' sketches.
    packed = F.collect_list(F.struct("measure", "bucket", "n"))
    own = groups.groupBy("lang", "source").agg(packed.alias("own"))
    parent = groups.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")).groupBy(F.col("lang").alias("parent_lang")).agg(packed.alias("parent"))
    everything = groups.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).agg(packed.alias("everything"))
    joined = own.join(parent, own["lang"].eqNullSafe(parent["parent_lang"])).crossJoin(F.broadcast(everything))
    schema = "fence_lang string, fence_source string, " + ", ".join(f"fence_{m} double" for m in MEASURES)
    return joined.select("lang", "source", "own", "parent", "everything").mapInArrow(_thresholds, schema)


def judge(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts with base_failed and kept."""
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(measure(m) > F.col(f"fence_{m}"), F.lit(False))
    joined = counts.join(limits, counts["lang"].eqNullSafe(limits["fence_lang"]) & counts["source"].eqNullSafe(limits["fence_source"]), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept."""
    counts = stage(count_documents(docs), "counts")
    return judge(counts, stage(fences(counts), "fences")).select("doc_id", *_FIELDS[:5], "base_failed", "kept")


def _counted_with_text(batches):
    for batch in batches:
        rows = [count_text(x.as_py() or "") for x in batch.column("quality_text")]
        counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_FIELDS))]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], *counts], names=[*batch.schema.names[:-1], *_FIELDS])


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. Texts stay in their partitions: counts are taken once for the fences and once beside the text."""
    counts = count_documents(docs)
    limits = stage(fences(counts), "fences")
    names = [f"doc_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    column = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    rows = plain.withColumn("quality_text", F.col(column["text"]).cast("string"))
    schema = ", ".join(f"{n} {t}" for n, t in [*plain.dtypes, *[(x, "bigint") for x in _FIELDS]])
    counted = rows.mapInArrow(_counted_with_text, schema)
    counted = counted.withColumn("lang", F.col(column["lang"]).cast("string")).withColumn("source", F.col(column["source"]).cast("string"))
    return judge(counted, limits).filter("kept").select(*names).toDF(*docs.columns)
