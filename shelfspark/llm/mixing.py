"""Temperature mixing of sources. DataFrame functions only.

Each source's token share p is raised to an exponent a; the normalised p^a are
the weights. A bisection over a finds the exponent at which the entropy of the weights or the largest number of
repetitions meets its target. The entropy may be given in nats, or as a share of
the way from that of the token shares (0) to that of equal weights (1), a target
that binds whatever the sources are. A token budget times the weight is a source's
quota: as many whole epochs as fit, and one part of an epoch, taken from the
front of a keyed permutation of the source's documents. The permutation is cut
into about sqrt(n) blocks, so that prefix sums go over blocks first and over
documents only inside a block.

Tokens are words of the text, or what a column of token counts says.

Defined results: null source counts as ''; null text as empty, with 0 tokens, as
does a null count; a document without tokens counts as 1 token, so that quotas
always advance; a null identifier has a place in the permutation like any other;
rows that repeat an identifier share its fate; an empty table gives an empty
result; a source whose quota is below its first document gets no row copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, stage, text_of

WORD = r"[^\x20\x09-\x0D]+"
#: Repetitions of a document that no source may exceed.
MAX_REPEATS = 4.0
SECTIONS, ROUNDS = 32, 8
_KEY_BITS = 40
#: A quota this close below a whole number of epochs counts as that number.
EPOCH_DUST = 1e-6


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def permutation_key(doc_id: Column, seed: int) -> Column:
    """A uniform 40-bit number from an md5 of seed and identifier."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, _KEY_BITS // 4), 16, 10).cast("bigint")


def _measures(shares: DataFrame, grid: list[float], budget_factor: float) -> list[tuple[float, float]]:
    """Entropy in nats and the largest repetitions, for each exponent."""
    p, ln = F.col("share"), F.log("share")
    columns = []
    for i, a in enumerate(grid):
        weight = F.pow(p, F.lit(a))
        columns += [F.sum(weight).alias(f"z{i}"), F.sum(weight * ln).alias(f"l{i}"), F.max(F.pow(p, F.lit(a - 1.0))).alias(f"r{i}")]
    row = shares.agg(*columns).first()
    import math

    return [(math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"], budget_factor * row[f"r{i}"] / row[f"z{i}"]) for i, a in enumerate(grid)]


#: Shares that are bisected over as one array; more of them by aggregations, a few sections of the exponent each.
FEW_SOURCES = 4096


def _bisected(shares: DataFrame, kind: str, want: float, budget_factor: float) -> float:
    """solve_exponent() for few sources, in one query."""
    total = lambda f: F.aggregate("p", F.lit(0.0), f)
    z = lambda a: total(lambda s, x: s + F.pow(x, a))
    entropy = lambda a: F.log(z(a)) - a * total(lambda s, x: s + F.pow(x, a) * F.log(x)) / z(a)
    repeats = lambda a: budget_factor * total(lambda s, x: F.greatest(s, F.pow(x, a - 1))) / z(a)
    measure = repeats if kind == "max_repeats" else entropy
    zero, one = F.lit(0.0), F.lit(1.0)
    row = shares.agg(F.sort_array(F.collect_list("share")).alias("p"))
    goal = entropy(one) + want * (entropy(zero) - entropy(one)) if kind == "entropy_share" else F.lit(float(want))
    row = row.select("p", goal.alias("goal"))

    def halved(s, _):
        middle = (s["low"] + s["high"]) / 2
        return F.when(measure(middle) <= F.col("goal"), F.struct(s["low"].alias("low"), middle.alias("high"))).otherwise(F.struct(middle.alias("low"), s["high"].alias("high")))

    steps = F.sequence(F.lit(1), F.lit(ROUNDS * (SECTIONS.bit_length() - 1)))
    found = F.aggregate(steps, F.struct(zero.alias("low"), one.alias("high")), halved)["high"]
    return row.select(F.when(measure(zero) <= F.col("goal"), 0.0).when(measure(one) > F.col("goal"), 1.0).otherwise(found).alias("a")).first().a


def solve_exponent(shares: DataFrame, target: tuple[str, float], budget_factor: float = 1.0) -> float:
    """The exponent in [0, 1] that meets ('entropy', nats), ('entropy_share', way from proportional to equal weights) or ('max_repeats', r).

    All measures fall as the exponent grows. The answer is the smallest
    exponent at which the measure is at most its target; 1 if none is, 0 if all
    are. Both ways end on the same grid of exponents.
    """
    kind, want = target
    if kind not in ("entropy", "entropy_share", "max_repeats"):
        raise ValueError(f"unknown target: {kind}")
    if shares.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        return _bisected(shares, kind, want, budget_factor)
    if kind == "entropy_share":
        (equal, _), (proportional, _) = _measures(shares, [0.0, 1.0], budget_factor)
        want = proportional + want * (equal - proportional)
    low, high = 0.0, 1.0
    for at in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        values = [m[kind == "max_repeats"] for m in _measures(shares, grid, budget_factor)]
        if at == 0 and values[0] <= want:
            return 0.0
        if at == 0 and values[-1] > want:
            return 1.0
        first = next(i for i, v in enumerate(values) if v <= want or i == SECTIONS)
        low, high = grid[max(0, first - 1)], grid[first]
    return high


def plan_mix(meta: DataFrame, target: tuple[str, float] = ("max_repeats", MAX_REPEATS), budget_factor: float = 1.0, seed: int = 0) -> DataFrame:
    """meta: doc_id, source_key, n_tokens. One row per source: source_key, share, weight, exponent, epochs, cut.

    A document is copied `epochs` times, and once more if its permutation key is at most `cut`.
    """
    sized = meta.select("source_key", "n_tokens", permutation_key(F.col("doc_id"), seed).alias("u"))
    totals = sized.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    everything = totals.agg(F.sum("tokens").alias("all_tokens"))
    shares = stage(totals.crossJoin(F.broadcast(everything)).withColumn("share", F.col("tokens") / F.col("all_tokens")), "shares")
    if shares.isEmpty():
        exponent = 1.0
    else:
        exponent = solve_exponent(shares, target, budget_factor)
    z = shares.agg(F.sum(F.pow("share", F.lit(exponent))).alias("z"))
    quota = F.col("weight") * F.col("all_tokens") * budget_factor
    # Staged, so that Spark knows its size where it joins the documents.
    sources = stage(
        shares.crossJoin(F.broadcast(z))
        .withColumn("weight", F.pow("share", F.lit(exponent)) / F.col("z"))
        .withColumn("epochs", F.floor(quota / F.col("tokens") + EPOCH_DUST).cast("bigint"))
        .withColumn("rest", F.greatest(F.lit(0.0), quota - F.col("epochs") * F.col("tokens")))
        .withColumn("blocks", F.ceil(F.sqrt("docs")).cast("bigint")),
        "sources",
    )
    in_blocks = sized.join(sources.select("source_key", "blocks", "rest"), "source_key").withColumn(
        "block", F.floor(F.col("u") * F.col("blocks") / F.lit(float(1 << _KEY_BITS))).cast("bigint")
    )
    block_sums = in_blocks.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest"), F.max("u").alias("last_u"))
    by_block = Window.partitionBy("source_key").orderBy("block")
    reached = block_sums.withColumn("before", F.sum("block_tokens").over(by_block) - F.col("block_tokens"))
    whole = reached.filter("before + block_tokens <= rest").groupBy("source_key").agg(F.max("last_u").alias("cut"))
    edge = reached.filter("before < rest and before + block_tokens > rest").select("source_key", "block", "before")
    in_edge = in_blocks.join(edge, ["source_key", "block"])
    inside = Window.partitionBy("source_key", "block").orderBy("u").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    partly = in_edge.withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).filter("upto <= rest").groupBy("source_key").agg(F.max("u").alias("edge_cut"))
    return (
        sources.join(whole, "source_key", "left")
        .join(partly, "source_key", "left")
        .select("source_key", "share", "weight", F.lit(exponent).alias("exponent"), "epochs", F.coalesce(F.greatest("cut", "edge_cut"), F.lit(-1)).alias("cut"))
    )


def source_key(df: DataFrame, source_col: str = "source") -> Column:
    return F.coalesce(df[source_col].cast("string"), F.lit(""))


def with_copies(docs: DataFrame, plan: DataFrame, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with mix_copies and mix_weight added; rows stay where they are, the plan has one row per source."""
    p = plan.select(*[F.col(c).alias(f"mix_{c}") for c in plan.columns])
    joined = docs.join(p, source_key(docs, source_col) == p["mix_source_key"])
    part = (permutation_key(docs[id_col], seed) <= F.col("mix_cut")).cast("bigint")
    return joined.withColumn("mix_copies", F.col("mix_epochs") + part)


def token_meta(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", token_col: str | None = None) -> DataFrame:
    tokens = word_count(text_of(docs, text_col)) if token_col is None else F.coalesce(docs[token_col].cast("bigint"), F.lit(0).cast("bigint"))
    n = F.greatest(tokens, F.lit(1).cast("bigint"))
    return stage(docs.select(docs[id_col].cast("bigint").alias("doc_id"), source_key(docs, source_col).alias("source_key"), n.alias("n_tokens")), "tokens")


def mix_counts(docs: DataFrame, target: tuple[str, float] = ("max_repeats", MAX_REPEATS), budget_factor: float = 1.0, seed: int = 0, token_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight (of its source, to six places), copies (0 if it is left out)."""
    meta = token_meta(docs, token_col=token_col)
    plan = stage(plan_mix(meta, target, budget_factor, seed), "plan")
    out = with_copies(meta.withColumnRenamed("source_key", "source"), plan, seed)
    return out.select("doc_id", "source", "n_tokens", F.round("mix_weight", 6).alias("weight"), F.col("mix_copies").alias("copies"))


def mix(docs: DataFrame, target: tuple[str, float] = ("max_repeats", MAX_REPEATS), budget_factor: float = 1.0, seed: int = 0, token_col: str | None = None) -> DataFrame:
    """The mixture: each row of docs as often as its copies say, with its own columns."""
    meta = token_meta(docs, token_col=token_col)
    plan = stage(plan_mix(meta, target, budget_factor, seed), "plan")
    drop(meta)
    # The columns of docs may have any names; here they go by their places.
    names = [f"in_{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    out = with_copies(own, plan, seed, names[docs.columns.index("doc_id")], names[docs.columns.index("source")]).filter("mix_copies > 0")
    repeated = out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_copies"))))
    return repeated.select(*names).toDF(*docs.columns)
