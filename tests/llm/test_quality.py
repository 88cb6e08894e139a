from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from shelfspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_and_verdicts(documents, sample):
    rows = [(*r[:4],) for r in sample]
    got = {r.doc_id: r for r in quality.quality_rules(documents(rows)).collect()}
    plain = {r[0]: quality.count_text(r[1]) for r in rows}
    fences = brute_fences([(r[2], r[3], plain[r[0]]) for r in rows])
    for i, text, lang, source in rows:
        r, want = got[i], counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        over = any(v > f for v, f in zip(measures(plain[i]), fences[lang, source]))
        assert r.kept == (not r.base_failed and not over)


def measures(c):
    """The measures on their scales."""
    n, chars, symbols, dup, repeat, lines, upper, letters, stutters = c
    sure = lambda a, b: max(0.0, a - 2 * math.sqrt(a)) / b if b else 0.0
    angle = lambda a, b: math.asin(math.sqrt(min(1.0, sure(a, b))))
    return [angle(symbols, chars), angle(dup, lines), angle(upper, letters), angle(stutters, n), math.log2(max(1.0, sure(chars, n)))]


def brute_fences(rows):
    """Thresholds of each group, from lists of values in place of sketches."""

    def histogram(values):
        out = [0.0] * 2000
        for v in values:
            out[math.floor(v * quality.STEPS)] += 1
        return out

    def mixed(own, parent):
        return [a + quality.PRIOR * b / sum(parent) for a, b in zip(own, parent)] if any(parent) else own

    def limit(h):
        total = sum(h)
        upto, low, high = 0.0, None, None
        for i, x in enumerate(h):
            upto += x
            low = i if low is None and upto >= total / 4 - 1e-9 else low
            high = i if high is None and upto >= 3 * total / 4 - 1e-9 else high
        step = quality.COARSE
        coarse = [sum(h[i : i + step]) for i in range(0, len(h), step)]
        begin = high // step

        def is_valley(k):
            after = coarse[k + 1 :]
            return bool(after) and sum(after) >= quality.MODE * total and coarse[k] * quality.DEPTH <= min(max(coarse[begin : k + 1]), max(after))

        for k in range(begin, len(coarse)):
            if is_valley(k):
                end = k
                while is_valley(end + 1) and coarse[end + 1] <= coarse[k]:
                    end += 1
                return (k + end + 1) / 2 * step / quality.STEPS
            stretch = coarse[k - quality.APART + 1 : k + 1]
            if k - quality.APART + 1 >= begin and all(x < 0.5 for x in stretch) and sum(coarse[k + 1 :]) > 0:
                return (k + 1 - quality.APART / 2) * step / quality.STEPS
        return (high + 1 + quality.RANGES * (high - low)) / quality.STEPS if high > low else math.inf

    groups = defaultdict(list)
    for lang, source, c in rows:
        if c[0] >= 20 and 100 * c[4] <= 30 * c[0]:
            groups[lang, source].append(measures(c))
    out = {}
    for lang, source in {(r[0], r[1]) for r in rows}:
        fence = []
        for k in range(len(quality.MEASURES)):
            of = lambda test: histogram(v[k] for key, values in groups.items() if test(key) for v in values)
            own, parent, everything = of(lambda key: key == (lang, source)), of(lambda key: key[0] == lang), of(lambda key: True)
            fence.append(limit(mixed(own, mixed(parent, everything))) if groups[lang, source] else math.inf)
        out[lang, source] = fence
    return out


def test_thresholds_follow_their_group(documents):
    """The same document is rejected where its habits stand apart and kept where they are common; between modes lies the threshold."""
    import random

    rng = random.Random(5)

    def text(marked):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) + ("#" if rng.random() < marked else "") for _ in range(120))

    rows = [(i, text(0.0), "en", "prose") for i in range(400)] + [(400 + i, text(0.5), "en", "prose") for i in range(12)]
    rows += [(1000 + i, text(0.5), "de", "code") for i in range(400)]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(documents(rows)).collect()}
    assert all(kept[i] for i in range(400)) and not any(kept[400 + i] for i in range(12))
    assert all(kept[1000 + i] for i in range(400))


def test_threshold_cases():
    import numpy as np

    def of(*parts):
        h = np.zeros(600)
        for at, n in parts:
            h[at] += n
        return quality.threshold(h)

    assert of() == math.inf and of((0, 100)) == math.inf
    assert 0 < of((0, 100), (100, 5)) < 100 / quality.STEPS
    # A slope without a valley has a limit by its quartiles, and one far off doesn't move it.
    slope = [(i * 4, 100 - 3 * i) for i in range(30)]
    assert of(*slope) > 116 / quality.STEPS and 116 / quality.STEPS < of(*slope, (500, 1)) < 500 / quality.STEPS


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    clean = [kept[r.doc_id] for r in labels if r.quality == 1]
    junk = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert all(k or base for k, base in clean)
    assert sum(not k for k, _ in junk) / len(junk) > 0.9


def test_edges(documents, clashing):
    rows = [(1, None), (2, ""), (3, "a " * 200_000), (4, "x\ny\nx\n \n \nx"), (5, "été " * 3, None, None), (5, "été " * 3, None, None), (None, "q")]
    got = quality.quality_rules(clashing(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[4].n_dup_lines == 2 and by[5].word_chars == 9 and by[1].base_failed and by[3].n_repeat_words == 200_000
    assert quality.quality_rules(documents([])).count() == 0


def test_filter_keeps_rows_whole(clashing, sample):
    df = clashing(sample)
    kept = quality.quality_filter(df)
    want = {r.doc_id for r in quality.quality_rules(df).filter("kept").collect()}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == want
    texts = {r[0]: r[1] for r in sample}
    assert all(r.text == texts[r.doc_id] for r in kept.collect())


def test_sketches_merge(spark, documents, sample):
    counted = quality.count_documents(documents(sample))
    whole = {(r.lang, r.source, r.measure, r.bucket): r.n for r in quality.sketch(counted).collect()}
    parts = defaultdict(int)
    for k in range(3):
        for r in quality.sketch(counted.filter(f"doc_id % 3 = {k}")).collect():
            parts[r.lang, r.source, r.measure, r.bucket] += r.n
    assert parts == whole
