from __future__ import annotations

from collections import defaultdict

import pytest
from shelfspark.llm import line_dedup as ld


def brute(rows):
    """Plain Drain over all lines of busy leaves, in the operator's fixed order."""
    data = {i: (t or "").encode() for i, t in rows}
    leaves = defaultdict(set)
    for d in data.values():
        for line in d.split(b"\n"):
            if t := ld.masked(line):
                leaves[ld.leaf_of(t)].add(d)
    busy = {k for k, v in leaves.items() if len(v) >= ld.MIN_DOCS}
    found = defaultdict(set)
    for i, d in data.items():
        for line in d.split(b"\n"):
            if (t := ld.masked(line)) and ld.leaf_of(t) in busy:
                found[ld.leaf_of(t), b" ".join(t)].add(i)
    drops = defaultdict(set)
    for leaf in busy:
        groups = [[s.split(b" "), [(s, ids)]] for (k, s), ids in found.items() if k == leaf]
        for place in ld.PLACES if len(groups) > 1 else ():
            groups = one_round(groups, place)
        for _, members in groups:
            ids = {i for _, x in members for i in x}
            if len({data[i] for i in ids}) >= ld.MIN_DOCS:
                for spelled, x in members:
                    for i in x - {min(ids)}:
                        drops[i].add(spelled)
    return {i: [line for line in d.split(b"\n") if not ((t := ld.masked(line)) and b" ".join(t) in drops[i])] for i, d in data.items()}


def one_round(groups, place):
    """Merge groups that share the token at the round's place."""
    a, b, c = place
    cells = defaultdict(list)
    for tokens, members in groups:
        cells[tokens[len(tokens) * a // b + c]].append((tokens, members))
    out = []
    for cell in cells.values():
        done = []
        for tokens, members in sorted(cell, key=lambda g: (-sum(len(x) for _, x in g[1]), b" ".join(g[0]))):
            alike = lambda g, tokens=tokens: sum(x == y for x, y in zip(g[0], tokens))
            best = max(done, key=alike, default=None)
            if best and alike(best) / len(tokens) >= ld.ALIKE:
                best[0] = [x if x == y else b"<*>" for x, y in zip(best[0], tokens)]
                best[1] = best[1] + members
            else:
                done.append([tokens, list(members)])
        out += done
    return out


def result(df):
    return {r.id: r.clean.encode().split(b"\n") for r in df.collect()}


def rows_with_templates():
    rows = []
    for i in range(30):
        lines = [f"own line number {'abcdefghij'[i % 10]}{'klm'[i // 10]} of its own kind {chr(97 + i % 26) * 3}"]
        if i % 2:
            lines.append(f"Posted on 2024-0{i % 9 + 1}-11 by the editors of page {i}")
        if i % 3 == 0:
            lines.append("This work is licensed under the usual terms")
        if i % 5 == 0:
            lines.append(f"Copyright held by name{'abcdef'[i // 5]} and all the other friends of ours here")
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[4][1]), (101, rows[4][1]), (200, None), (201, ""), (202, "short\nshort")]
    return rows


def test_against_brute_force(documents):
    rows = rows_with_templates()
    got = result(ld.line_dedup(documents(rows)))
    assert got == brute(rows)
    assert sum(b"licensed" in b"".join(x) for x in got.values()) == 1
    assert sum(b"Posted" in b"".join(x) for x in got.values()) == 1


def test_sample(documents, sample):
    rows = [r[:2] for r in sample]
    assert result(ld.line_dedup(documents(rows))) == brute(rows)


def test_whole_copies_do_not_recur(documents):
    rows = [(i, "one two three four five six\nseven eight nine ten eleven") for i in range(10)]
    assert all(r.n_dropped == 0 for r in ld.line_counts(documents(rows)).collect())


def test_filter(clashing):
    shared = "the very same line in many documents"
    rows = [(i, f"{shared}\n" + " ".join(f"own{chr(97 + i)}{chr(97 + k)}" for k in range(7))) for i in range(6)] + [(50, shared), (60, None)]
    got = {r.doc_id: r for r in ld.line_filter(clashing(rows)).collect()}
    assert 50 not in got and got[60].text is None
    assert got[0].text.startswith(shared) and shared not in got[3].text and got[3].n_chars == len(got[3].text)


def test_edges(documents):
    assert ld.line_counts(documents([])).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f\nx"), (1, "a b c d e f\ny"), (2, "w " * 100_000)]
    got = ld.line_counts(documents(rows)).collect()
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 1


def test_a_leaf_larger_than_a_cell(documents, monkeypatch):
    monkeypatch.setattr(ld, "CELL", 8)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi end".split()
    rows = []
    for i in range(150):
        line = list(words)
        line[4 + i % 9] = "v" + "abcdefghijklmnopqrstuvwxyz"[i % 26] + "xyz"[i % 3] + "pq"[i // 75]
        rows.append((i, " ".join(line)))
    got = ld.line_counts(documents(rows)).collect()
    assert sum(r.n_dropped for r in got) >= 140


def test_alike_templates_meet_in_a_hot_leaf(documents):
    # Groups of three alike lines, all in one leaf and, in the first four rounds, in one cell.
    word = lambda *x: "w" + "".join(chr(97 + k // 26) + chr(97 + k % 26) for k in x)
    rows, groups = [], 1000
    for g in range(groups):
        for k in range(3):
            w = ["a", "b", "c", "d", word(g, 1), "f", word(g, 2), "h", word(g, 3), word(g, 4, k), "k", "l", word(g, 5), "n", "o"]
            assert w[3] == "d" and w[7] == "h" and w[11] == "l" and w[13] == "n"
            rows.append((len(rows), " ".join(w)))
    got = ld.line_counts(documents(rows)).collect()
    assert sum(r.n_dropped for r in got) == 2 * groups


@pytest.mark.parametrize("most,templates", [(200_000, 1500), (100, 1500), (100, 4000)])
def test_recall_in_one_leaf_of_any_size(documents, monkeypatch, most, templates):
    """Four documents for each template, one free word each: three of four lines go, as in a merge over the whole leaf, also where a leaf is too large to gather."""
    monkeypatch.setattr(ld, "MOST", most)
    word = lambda *x: "w" + "".join(chr(97 + k // 676) + chr(97 + k // 26 % 26) + chr(97 + k % 26) for k in x)
    rows = []
    for t in range(templates):
        for k in range(4):
            w = ["a", "b", "c", word(t, 1), word(t, 2), "f", word(t, 3), word(t, 4), word(t, 5), word(t, 6), "z"]
            w[3 + t % 7] = word(t, 9, k)
            rows.append((len(rows), " ".join(w)))
    got = ld.line_counts(documents(rows)).collect()
    assert sum(r.n_dropped for r in got) == 3 * templates


def test_differences_that_alike_lines_may_have():
    for width in range(1, 60):
        assert ld._spare(width) == sum(k / width < 1 and (width - j) / width >= ld.ALIKE for k, j in [(0, j) for j in range(1, width + 1)])


def test_index_finds_what_a_scan_finds():
    import random

    rng = random.Random(5)
    for width in (5, 9, 10, 16, 24):
        spelled = {b" ".join(rng.choice([b"<*>", b"a", b"b", b"c%d" % rng.randrange(40)]) if i % 3 else b"x" for i in range(width)) for _ in range(600)}
        rows = sorted((-rng.randint(1, 4), s, k) for k, s in enumerate(sorted(spelled)))
        assert ld.merge_cell(rows, 0) == ld.merge_cell(rows, len(rows))


def test_long_lines_without_a_probed_token_in_common(documents):
    words = [f"w{chr(97 + i)}" for i in range(25)]
    rows = []
    for k in "xyz":
        line = list(words)
        for place in (12, 18, 3, 23):
            line[place] = f"{k}{chr(97 + place)}"
        rows.append((ord(k), " ".join(line)))
    assert sum(r.n_dropped for r in ld.line_counts(documents(rows)).collect()) == 2


def test_short_lines_recur_as_they_stand(documents):
    short = ["All rights reserved.", "版权所有侵权必究未经许可不得转载", "Читать далее", "Page 3"]
    rows = []
    for i in range(4):
        own = f"own line {chr(97 + i) * 3} with some {chr(104 + i) * 3} words"
        rows.append((i, "\n".join([own, *short, f"Page 1{i}", "}", "———", "", "1 2 3 4", str(i)])))
    got = result(ld.line_dedup(documents(rows)))
    assert got == brute(rows)
    for line in short:
        assert [i for i, lines in got.items() if line.encode() in lines] == [0]
    for i, lines in got.items():
        assert [x.decode() for x in lines[-6:]] == [f"Page 1{i}", "}", "———", "", "1 2 3 4", str(i)]


def test_short_lines_of_two_texts_stay(documents):
    rows = [(i, f"All rights reserved.\nown {chr(97 + i) * 4}") for i in range(2)]
    assert all(r.n_dropped == 0 for r in ld.line_counts(documents(rows)).collect())
