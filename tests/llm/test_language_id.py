from __future__ import annotations

import zlib

from shelfspark.llm import language_id as li


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = li.language_id(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_the_held_out_fold_have_no_part(spark, documents):
    rows = [(i, "alpha beta gamma" if i % 2 else "uno dos tres", "en" if i % 2 else "es") for i in range(60)]
    flipped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a = {r.doc_id: (r.lang_pred, r.score) for r in li.language_id(documents(rows)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in li.language_id(documents(flipped)).collect()}
    assert a == b


def test_edges(documents, clashing):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "hello there friend"), (5, "hello there friend"), (6, "hello " * 50_000), (7, "bonjour les amis", "fr"), (8, "x", None), (None, "hello")]
    got = {r.doc_id: r for r in li.language_id(clashing(rows)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred == got[5].lang_pred and got[6].lang_pred == "en"
    assert li.language_id(documents([])).count() == 0
    assert {r.lang_pred for r in li.language_id(documents([(i, "abc def", None) for i in range(5)])).collect()} == {"und"}


def test_one_language(documents):
    got = li.language_id(documents([(i, "some words here") for i in range(20)])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("en", 1.0)}


def test_letters():
    assert li.letters("Ab-1c É_x!") == "ab c é x".encode()
    assert li.letters("½ ² Ⅷ 12 ³x ٣ ªb") == "³x ªb".encode()


def test_numbers_that_look_like_words_are_no_letters(documents):
    rows = [(i, "some words here", "en") for i in range(20)] + [(100, "½ ²"), (101, "Ⅷ ①")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.language_id(documents(rows)).collect()}
    assert got[100] == got[101] == ("und", 0.0)


def test_against_plain_compression(documents, sample):
    """Sums of frame sizes by the library alone, over the same dictionaries."""
    import zstandard

    df = documents(sample)
    learned = df.filter("pmod(crc32(cast(doc_id as string)), 5) != 0")
    model = li.fit(learned)
    assert [n for n, _ in model] == sorted({r[2] for r in sample}) and all(0 < len(d) <= li.SAMPLE_DOCS * (li.SHARE + 1) for _, d in model)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.language_id(df).collect()}
    for doc_id, text, _, _ in sample[:60]:
        data = li.letters(text or "")
        sums = []
        for name, dictionary in model:
            compressor = zstandard.ZstdCompressor(level=li.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
            sums.append((sum(len(compressor.compress(data[i : i + li.BLOCK])) for i in range(0, len(data), li.BLOCK)), name))
        sums.sort()
        want = (sums[0][1], (sums[1][0] - sums[0][0]) / sums[1][0]) if data else ("und", 0.0)
        assert got[doc_id] == want


def test_equal_sums_go_to_the_first_language():
    words = b"one two three four"
    assert li.Classifier([("aa", words), ("bb", words)]).predict("two three") == ("aa", 0.0, True)


def test_dictionaries_hold_something_of_every_sampled_row(documents):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000))
    part = li.spread(li.letters(long))
    assert len(part) <= li.SHARE and part.split()[0] == b"waaa" and part.split()[-1] == long.split()[-1].encode()
    assert set(part.split()) <= set(long.encode().split())
    assert li.spread(b"x" * 5000) == b"x" * li.SHARE and li.spread("é".encode() * 5000).decode()
    learned = [(i, f"begin{i} " + long + f" close{i}", "en") for i in range(5)] + [(5, "short text", "en")]
    (_, dictionary), = li.fit(documents(learned))
    assert b"short text" in dictionary


def test_most_frequent_languages_are_learned(documents, monkeypatch):
    monkeypatch.setattr(li, "MAX_LANGUAGES", 2)
    rows = [(i, "some words here", lang) for i, lang in enumerate(["a"] * 3 + ["b"] * 2 + ["c"] * 3 + ["d"])]
    assert [n for n, _ in li.fit(documents(rows))] == ["a", "c"]


def test_repeated_identifiers_teach_the_smallest_text(documents):
    rows = [(1, "zebra zebra", "en"), (1, "apple apple", "en"), (1, "apple apple", "en"), (None, "never", "en")]
    assert li.fit(documents(rows)) == [("en", b"apple apple")]
