"""Line dedup by a log-template tree.

Each line goes down a tree of fixed depth: by its token count, its first LEADING
tokens and its last one, where tokens that look variable (they hold a digit, or
are addresses) become `<*>`. A line of fewer than MIN_WORDS words, as one in a
script without blanks mostly is, has nothing to spare: none of its tokens is
masked, its leaf holds all of them, and it recurs only as it stands. Of such lines
those without a letter (blank ones, rules, brackets, bare numbers) are layout and
stay. Leaves that fewer
than MIN_DOCS different texts reach can't hold a recurring template and go no
further. In the others, masked lines whose tokens agree in ALIKE of their
places merge into one template, whose differing places become `<*>`. They meet in
cells of a leaf, by the token at a place that changes from round to round
(PLACES); the last round's cell is what is left of the leaf, so that any two
templates of a leaf meet. A cell is merged as a whole: alike templates agree in one
of a few blocks of places, and an index of the blocks finds every group that a
template can join. Cells of more than MOST templates are not gathered. Leaves that
stay so large are cut into cells by all tokens of one block of places, block after
block; alike templates agree wholly in one of the blocks, so they meet in one of
these rounds, and a cell holds only what agrees in a block. A template that occurs in MIN_DOCS different
texts recurs: its lines are dropped from every document but the one with the
smallest identifier.

Documents of identical text count once, so that whole copies, which are another
operator's matter, do not make their own lines recur.

Leaf counts, template counts and documents are Spark aggregations; the leaves
that may recur reach the executors as a bitmap of fixed size, which lets through
a few others, and a join settles them.

Defined results: null text counts as empty; a null identifier counts as the
smallest; rows that repeat an identifier share its verdicts; an empty table
gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, drop, filter_slot, stage

MIN_WORDS, MIN_DOCS = 5, 3
LEADING = 3
ALIKE = 0.8
#: Templates that a task gets on average (a larger cell travels whole); and by round the place whose token picks the cell, (a, b, c) for a * n // b + c of n tokens. The first token is the leaf's own.
CELL = 512
#: Templates of a cell that one task merges at most, but where a whole block of places agrees.
MOST = 200_000
#: Groups of a cell that are compared one and all; for more an index picks them.
SCAN = 256
PLACES = ((1, 2, 0), (3, 4, 0), (0, 1, LEADING), (1, 1, -2), (0, 1, 0))
_VARIABLE = re.compile(rb"[0-9]|://|@")
_LETTER = re.compile(rb"[A-Za-z]")
_NONE = -(1 << 63)


def mask(token: bytes) -> bytes:
    return b"<*>" if _VARIABLE.search(token) else token


def masked(line: bytes) -> list[bytes] | None:
    """The line's tokens, variable ones as <*>; those of a short line as they are, and none if it has no letter."""
    tokens = line.split()
    if len(tokens) < MIN_WORDS:
        lettered = _LETTER.search(line) or (not line.isascii() and any(map(str.isalpha, line.decode("utf-8", "surrogatepass"))))
        return tokens if lettered else None
    return [mask(t) for t in tokens] if _VARIABLE.search(line) else tokens


def leaf_of(tokens: list[bytes]) -> int:
    """The leaf's number: token count, leading tokens, last token."""
    return xxhash.xxh3_64_intdigest(b"%d\x00" % len(tokens) + b"\x00".join([*tokens[:LEADING], tokens[-1]])) - (1 << 63)


def template_of(tokens: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(tokens)) - (1 << 63)


def _signature(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data, seed=1) - (1 << 63)


def _leaves(batches):
    for batch in batches:
        signatures, leaves = [], []
        for x in batch.column("text"):
            data = (x.as_py() or "").encode("utf-8", "surrogatepass")
            signatures.append(_signature(data))
            leaves.append(list({leaf_of(t) for line in data.split(b"\n") if (t := masked(line))}))
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], names=["signature", "leaves"])


def recurring(rows: DataFrame) -> DataFrame:
    """rows: id, text. One row for each line template of a document to be dropped from it: id, template."""
    spark = rows.sparkSession
    counted = rows.select("text").mapInArrow(_leaves, "signature bigint, leaves array<bigint>")
    seen = counted.select("signature", F.explode("leaves").alias("leaf")).distinct()
    busy = stage(seen.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf"), "leaves")

    shared = spark.sparkContext.broadcast(bit_filter(busy))

    def lines(batches):
        bits = shared.value
        for batch in batches:
            out = ([], [], [], [], [])
            for doc, x in zip(batch.column("id").to_pylist(), batch.column("text")):
                data = (x.as_py() or "").encode("utf-8", "surrogatepass")
                found = {}
                for line in data.split(b"\n"):
                    tokens = masked(line)
                    if tokens:
                        leaf = leaf_of(tokens)
                        s = filter_slot(leaf)
                        if bits[s >> 3] >> (s & 7) & 1:
                            found[template_of(tokens)] = (leaf, b" ".join(tokens))
                if found:
                    signature = _signature(data)
                    for template, (leaf, spelled) in found.items():
                        for column, value in zip(out, (doc, signature, leaf, template, spelled)):
                            column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["id", "signature", "leaf", "template", "spelled"])

    found = stage(rows.select("id", "text").mapInArrow(lines, "id bigint, signature bigint, leaf bigint, template bigint, spelled binary").join(busy, "leaf", "left_semi"), "lines")
    templates = found.groupBy("leaf", "template").agg(F.min("spelled").alias("spelled"), F.count(F.lit(1)).alias("n"))
    groups = stage(merge_templates(templates), "groups")
    placed = stage(found.select("id", "signature", "template").join(groups, "template"), "placed")
    often = stage(
        placed.groupBy("grp", "signature").agg(F.min("id").alias("first"))
        .groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("keeper")).filter(F.col("n") >= MIN_DOCS),
        "often",
    )
    out = stage(placed.join(often, "grp").filter(F.col("id") != F.col("keeper")).select("id", "template").distinct(), "drops")
    drop(busy, found, groups, placed, often)
    return out


def merge_templates(templates: DataFrame) -> DataFrame:
    """templates: leaf, template, spelled, n. The group of each template: template, grp."""
    whole = stage(templates, "templates")
    # Counts are staged, so that a join with them lies between two scans and Spark can split a hot leaf or cell.
    several = stage(whole.groupBy("leaf").agg(F.count(F.lit(1)).alias("here")).filter("here > 1").select("leaf"), "several")
    alone = whole.join(several, "leaf", "left_anti").select("template", F.col("template").alias("grp"))
    current, placed = whole.join(several, "leaf"), None
    tokens = F.split(F.col("spelled").cast("string"), " ")

    def merge(rows: DataFrame, cell, bounded: bool) -> DataFrame:
        """rows with grp added, and merged groups' spelling and count; of each cell that has several, and MOST at most if that is asked for."""
        celled = stage(rows.withColumn("cell", cell), "celled")
        sizes = stage(celled.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size").between(2, MOST) if bounded else F.col("size") > 1), "sizes")
        # The templates travel in buckets of several cells; those alone in their cell, or in one too large, stay as they are.
        buckets = (sizes.agg(F.sum("size")).first()[0] or 0) // CELL + 1
        together = celled.join(sizes, "cell").withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))
        merged = together.select("bucket", "cell", "leaf", "template", "spelled", "n").groupBy("bucket").applyInPandas(_merge_bucket, "leaf bigint, template bigint, grp bigint, spelled binary, n bigint")
        others = celled.join(sizes, "cell", "left_anti").select("leaf", "template", F.col("template").alias("grp"), "spelled", "n")
        out = stage(merged.unionByName(others), "merged")
        drop(celled, sizes)
        return out

    def followed(merged: DataFrame) -> None:
        nonlocal placed
        step = merged.select(F.col("template").alias("was"), F.col("grp").alias("now"))
        placed = step.withColumnsRenamed({"was": "template", "now": "grp"}) if placed is None else placed.join(step, F.col("grp") == F.col("was"), "left").select("template", F.coalesce("now", "grp").alias("grp"))

    for a, b, c in PLACES:
        place = (F.floor(F.size(tokens) * a / b) + c).cast("int")
        merged = merge(current, F.xxhash64("leaf", F.get(tokens, place)), True)
        followed(merged)
        current = merged.filter("template = grp").drop("grp")
    large = stage(current.groupBy("leaf").agg(F.count(F.lit(1)).alias("here"), F.max(F.size(tokens)).alias("width")).filter(F.col("here") > MOST), "large")
    widest = large.agg(F.max("width")).first()[0]
    if widest is not None:
        current = current.join(large.select("leaf"), "leaf")
        for k in range(_spare(widest) + 1):
            # Places between those that make the leaf, dealt to the blocks in turn.
            blocks = _spare_of(F.size(tokens)) + 1
            block = F.filter(tokens, lambda x, i: (i >= LEADING) & (i < F.size(tokens) - 1) & (F.pmod(i - LEADING, blocks) == k % blocks))
            merged = merge(current, F.xxhash64("leaf", F.lit(k), F.array_join(block, " ")), False)
            followed(merged)
            current = merged.filter("template = grp").drop("grp")
    return alone.unionByName(placed)


def _spare(width: int) -> int:
    """Places in which two alike templates of `width` tokens may differ."""
    return width - next(k for k in range(width + 1) if k / width >= ALIKE)


def _spare_of(width):
    """The same for a column."""
    return width - F.ceil(width * F.lit(ALIKE) - 1e-9).cast("int")


def _merge_bucket(pdf):
    import pandas as pd

    out = []
    for (_, leaf), part in pdf.groupby(["cell", "leaf"], sort=False):
        rows = sorted(zip((-part["n"]).tolist(), map(bytes, part["spelled"]), part["template"].tolist()))
        out += [(leaf, template, members[0], spelled, n) for spelled, n, members in merge_cell(rows) for template in members]
    return pd.DataFrame(out, columns=["leaf", "template", "grp", "spelled", "n"])


def merge_cell(rows: list[tuple[int, bytes, int]], scan: int = SCAN) -> list[tuple[bytes, int, list[int]]]:
    """Greedy merging of (-n, spelled, template) in a fixed order: the most frequent template first, then by spelling.

    A template joins the group that it agrees with in most places, the first of
    equals. Up to `scan` groups all are compared; beyond, those that share a block
    of places with it, which leaves none out. A group bears its first template's number.
    """
    known: dict[bytes, int] = {b"<*>": _WILD}
    width = rows[0][1].count(b" ") + 1
    codes = np.empty((len(rows), width), np.int64)
    for i, (_, spelled, _) in enumerate(rows):
        codes[i] = [known.get(t) or known.setdefault(t, hash_token(t)) for t in spelled.split(b" ")]
    varying = np.flatnonzero((codes != codes[0]).any(0))
    codes = np.ascontiguousarray(codes[:, varying])
    # Of the places that differ at all in this cell, so many have to agree.
    need = width - _spare(width) - (width - len(varying))
    blocks = _blocks(codes, len(varying) - need + 1) if need > 0 and len(rows) > scan else []
    index: dict[tuple[int, bytes], list[int]] = {}

    matrix = np.zeros((8, len(varying)), np.int64)
    groups: list[list] = []
    for (n, spelled, template), row in zip(rows, codes):
        group = None
        near = slice(0, len(groups))
        if len(groups) > scan and blocks:
            lists = [x for k, block in enumerate(blocks) if (x := index.get((k, row[block].tobytes())))]
            if sum(map(len, lists)) * 4 < len(groups):
                near = np.array(sorted({g for x in lists for g in x}), np.int64)
        same = (matrix[near] == row).sum(1)
        if len(same):
            best = int(same.argmax())
            if same[best] >= need:
                group = best if isinstance(near, slice) else int(near[best])
        if group is None:
            if len(groups) == len(matrix):
                matrix = np.concatenate([matrix, np.zeros_like(matrix)])
            group = len(groups)
            matrix[group] = row
            groups.append([spelled, 0, []])
            changed = range(len(blocks))
        else:
            differ = (matrix[group] != row) & (matrix[group] != _WILD)
            changed = [k for k, block in enumerate(blocks) if differ[block].any()]
            if differ.any():
                matrix[group][differ] = _WILD
                tokens = groups[group][0].split(b" ")
                for at in varying[differ]:
                    tokens[at] = b"<*>"
                groups[group][0] = b" ".join(tokens)
        for k in changed:
            index.setdefault((k, matrix[group][blocks[k]].tobytes()), []).append(group)
        groups[group][1] -= n
        groups[group][2].append(template)
    return [tuple(g) for g in groups]


def _blocks(codes: np.ndarray, count: int) -> list[np.ndarray]:
    """The places in `count` blocks, those of many tokens dealt evenly. Rows that differ in fewer places than there are blocks agree in one of them."""
    order = np.argsort([-len(np.unique(column)) for column in codes.T], kind="stable")
    dealt: list[list[int]] = [[] for _ in range(count)]
    for i, place in enumerate(order.tolist()):
        turn, k = divmod(i, count)
        dealt[count - 1 - k if turn % 2 else k].append(place)
    return [np.array(x) for x in dealt]


def hash_token(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


_WILD = hash_token(b"<*>")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_dropped, clean (the text without the dropped lines), n_dropped 0 where nothing recurs."""
    rows = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(_NONE)).alias("id"), docs[text_col].cast("string").alias("text"))
    drops = recurring(rows)
    # Staged, so that the join with the texts lies between two scans: rows of one identifier, or of none, can be split. Templates by document grow with the input and are not broadcast.
    by_doc = stage(drops.groupBy("id").agg(F.collect_set("template").alias("templates")), "by_doc")
    drop(drops)
    joined = rows.join(by_doc.hint("merge"), "id", "left")
    return joined.select("id", "text", "templates").mapInArrow(_clean, "id bigint, n_lines bigint, n_dropped bigint, clean string")


def strip_lines(text: str, templates: set[int]) -> tuple[str, int, int]:
    data = text.encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    if not templates:
        return text, len(lines), 0
    left = [line for line in lines if not ((t := masked(line)) and template_of(t) in templates)]
    return b"\n".join(left).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(left)


def _clean(batches):
    for batch in batches:
        out = [strip_lines(x.as_py() or "", set(t.as_py() or ())) for x, t in zip(batch.column("text"), batch.column("templates"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[0] for o in out], pa.string())],
            names=["id", "n_lines", "n_dropped", "clean"],
        )


def line_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, clean_sha256 of every document."""
    out = line_dedup(docs)
    doc_id = F.when(F.col("id") == _NONE, None).otherwise(F.col("id"))
    return out.select(doc_id.alias("doc_id"), "n_lines", "n_dropped", F.sha2("clean", 256).alias("clean_sha256"))


def line_filter(docs: DataFrame) -> DataFrame:
    """docs with recurring lines dropped from text; a document of which no line stays goes, and n_chars, where there is one, follows the text."""
    names = [f"doc_{i}" for i in range(len(docs.columns))]
    at = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    plain = docs.toDF(*names)
    rows = plain.withColumn("id", F.coalesce(F.col(at["doc_id"]).cast("bigint"), F.lit(_NONE)))
    drops = recurring(rows.select("id", F.col(at["text"]).cast("string").alias("text")))
    by_doc = stage(drops.groupBy("id").agg(F.collect_set("template").alias("templates")), "by_doc")
    drop(drops)
    joined = rows.join(by_doc.hint("merge"), "id", "left")
    text = at["text"]
    fields = [(n, t) for n, t in plain.dtypes]
    columns = [n for n, _ in fields]

    def run(batches):
        for batch in batches:
            texts, lost = [], []
            for x, t in zip(batch.column(text), batch.column("templates")):
                known = t.as_py()
                if known:
                    clean, _, dropped = strip_lines(x.as_py() or "", set(known))
                    texts.append(clean)
                    lost.append(dropped > 0 and not clean.strip())
                else:
                    texts.append(x.as_py())
                    lost.append(False)
            arrays = [pa.array(texts, batch.schema.field(text).type) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lost, pa.bool_())], names=[*columns, "lost"])

    out = joined.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields) + ", lost boolean").filter("not lost").drop("lost")
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.length(F.col(text)).cast(dict(fields)[at["n_chars"]]))
    return out.toDF(*docs.columns)
