"""The pipeline over a small table, each stage held against what its operator says of its own input."""


import pytest

import corpus_pipeline
from cellwise.llm import classifier, decontaminate, simhash
from cellwise.llm.common import cut, table


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = table(spark, data, "documents"), []
    for _, f in corpus_pipeline.STAGES:
        after = cut(f(spark, docs, data), "stage")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    columns = stages[0][0].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "substring dedup", "benchmark decontamination", "best-fit packing"]
    assert all(after.columns == columns for _, after in stages[:-1])


def test_quality(stages, spark, data):
    docs, after = stages[0]
    scores = classifier.score(docs, classifier.fit(docs, table(spark, data, "labels"))).collect()
    assert ids(after) == {r.doc_id for r in scores if r.predicted == 1}


def test_one_of_each_group_stays(stages):
    from test_text_ops import shingle_print

    docs, after = stages[1]
    rows = sorted((r.doc_id, shingle_print(r.text or "")) for r in docs.collect())
    root = {k: k for k, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, p in rows:
            for b, q in rows:
                if root[b] < root[a] and (p ^ q).bit_count() <= 4:
                    root[a], changed = root[b], True
    assert ids(after) == {k for k in root if root[k] == k}


def test_repeated_words_go(stages):
    from test_text_ops import words_left

    docs, after = stages[2]
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    left = words_left(before, 50)
    import hashlib

    for r in after.collect():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == left[r.doc_id][2] and r.n_chars == len(r.text)
    assert ids(after) == set(before)


def test_contaminated_documents_go(stages, spark, data):
    from test_text_ops import license_words

    docs, after = stages[3]
    found = set()
    for r in table(spark, data, "benchmark").collect():
        w = license_words(r.text or "")
        found |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0)}
    keep = set()
    for r in docs.collect():
        w, hit = license_words(r.text or ""), set()
        for size in {len(f) for f in found}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in found:
                    hit.update(range(i, i + size))
        long = any(tuple(w[i : i + 13]) in found for i in range(len(w) - 12))
        if not (long or hit and 20 * len(hit) >= len(w)):
            keep.add(r.doc_id)
    assert ids(after) == keep


def test_packing(stages):
    docs, after = stages[4]
    rows = after.collect()
    assert {r.doc_id for r in rows} == ids(docs)
    total, sequences = sum(r.length for r in rows), {r.sequence_id for r in rows}
    assert len(sequences) <= -(-total // 2048) + 2


def test_null_and_repeated_ids_are_judged_row_by_row(spark):
    a, b, c, d, e = (" ".join(f"{x}{i * i % 97}" for i in range(60)) for x in "abcde")
    rows = [(None, a), (None, a), (7, a), (1, b), (5, b), (5, c), (6, c), (2, d), (2, d), (None, e), (None, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    after = simhash.keep_one(docs)
    assert after.columns == docs.columns
    assert sorted(((r.text[0], r.doc_id) for r in after.collect()), key=str) == [("a", 7), ("b", 1), ("c", 5), ("d", 2), ("e", None)]
    bench = spark.createDataFrame([("x", a), ("y", c)], "item_id string, text string")
    for some in (docs, after):
        left = [(r.text[0], r.doc_id) for r in decontaminate.clean(some, bench).collect()]
        want = [(r.text[0], r.doc_id) for r in some.collect() if r.text not in (a, c)]
        assert sorted(left, key=str) == sorted(want, key=str)


def test_a_short_passage_in_a_long_document_is_found(spark):
    passage = " ".join(f"bench{i}" for i in range(14))
    filler = " ".join(f"word{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, f"{filler} {passage} {filler}"), (2, filler), (3, " ".join(passage.split()[:12]) + " " + filler)], "doc_id long, text string")
    bench = spark.createDataFrame([("x", passage), ("y", "word7 word8")], "item_id string, text string")
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 3}


ROWS = [(None, None, "a"), (None, "", "b"), (3, None, "c"), (3, " \t\n", "d"), (5, "x", "e"), (5, "x", "f"), (6, " ".join(f"long{i}" for i in range(60_000)), "g")]


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_and_clashing_columns(spark, data, stage):
    """Nulls, empty and very long texts, ties, repeated rows; columns named as stages name theirs."""
    docs = spark.createDataFrame([(*r, 1, "r", 2.0) for r in ROWS], "doc_id long, text string, lang string, n_words long, runs string, part double")
    after = corpus_pipeline.STAGES[stage][1](spark, docs, data)
    rows = after.collect()
    if stage == 4:
        assert sorted(str(r.doc_id) for r in rows if r.piece == 0) == sorted(str(r[0]) for r in ROWS)
        return
    assert after.columns == docs.columns and {r.lang for r in rows} <= {r[2] for r in ROWS}
    texts = {r[2]: r[1] for r in ROWS}
    assert all(r.text == texts[r.lang] for r in rows)
    if stage == 1:  # texts without words are one group, the two x another
        assert {r.lang for r in rows} in ({"c", "e", "g"}, {"d", "e", "g"}, {"c", "f", "g"}, {"d", "f", "g"})
    if stage in (2, 3):
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("stage", range(5))
def test_empty_tables(spark, data, stage):
    docs = table(spark, data, "documents").limit(0)
    after = corpus_pipeline.STAGES[stage][1](spark, docs, data)
    assert after.collect() == [] and (stage == 4 or after.columns == docs.columns)
