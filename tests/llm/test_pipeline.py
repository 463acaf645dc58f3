"""The pipeline: its stages' contracts, and the whole."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from graphloam.llm import mixing
from graphloam.llm.tokens import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def test_stages_keep_the_columns_and_only_remove_rows(staged):
    for before, after in zip(staged[:-2], staged[1:-1]):
        assert after.columns == staged[0].columns
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}


def test_no_line_twice_after_line_dedup(staged):
    lines = [x for r in staged[2].collect() for x in r.text.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    assert all(r.n_chars == len(r.text) for r in staged[2].collect())


def test_windows_hold_the_mixed_documents(staged):
    tok = tokenizer()
    docs = sorted(staged[4].collect(), key=lambda r: r.doc_id)
    want = sum(len(tok.encoding.encode_ordinary(r.text)) + 1 for r in docs if r.text)
    rows = staged[5].collect()
    assert sum(r.n_tokens + r.n_truncated for r in rows) == want
    assert {d for r in rows for d in r.doc_ids} == {r.doc_id for r in docs if r.text}


def test_windows_follow_the_mixed_order(spark, staged):
    want = {}
    for r in mixing.mix_sources(staged[3]).orderBy("shard", "position").collect():
        if r.text:
            want.setdefault(r.shard, []).append(r.doc_id)
    got = {}
    for r in staged[5].orderBy("shard", "window").collect():
        for d in r.doc_ids:
            mine = got.setdefault(r.shard, [])
            if not mine or mine[-1] != d:
                mine.append(d)
    assert got == want
    assert any(ids != sorted(ids) for ids in got.values())


def test_order_is_found_again(spark):
    rows = [(i * 7919, f"text {i}", f"s{i % 3 if i % 10 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    args = {"shard_docs": 100, "bucket_docs": 50}
    mixed = mixing.mix_sources(docs, **args)
    again = mixing.mixed_order(mixed.select(*docs.columns), **args)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))


def test_run_gives_the_stages_result(spark, staged):
    got = {(r.shard, r.window): r.tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r.shard, r.window): r.tokens for r in staged[5].collect()}
    assert np.mean([len(t) for t in got.values()]) > 0


AWKWARD = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, `odd.name` int, n_lines int"


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"word{i % 5000} goes." for i in range(60_000))
    texts = [(1, None), (2, ""), (3, "   \n \n"), (None, "Some text that has no id. It is short."), (5, long), (7, "Twice the same row.\nTwice the same text."), (7, "Twice the same row.\nTwice the same text."), (8, "naïve café — “quotes” 𝔘𝔫𝔦 \t tab\r\nline"), (9, "Some text that has no id. It is short.")]
    return spark.createDataFrame([(i, t, "en" if t and i != 8 else None, None if i == 3 else "s", None, "x", 1, 2) for i, t in texts], AWKWARD)


@pytest.mark.parametrize("number", range(5))
def test_each_stage_on_awkward_rows(spark, awkward, number):
    """Nulls, empty and very long texts, repeated rows, columns of the operators' names, and no rows at all."""
    _, stage = corpus_pipeline.STAGES[number]
    rows = stage(spark, awkward, SF).collect()
    assert stage(spark, awkward.limit(0), SF).count() == 0
    if number == 4:
        assert {d for r in rows for d in r.doc_ids} == {None, 3, 5, 7, 8, 9}
        return
    assert list(rows[0].asDict()) == awkward.columns and all(r.shard == "x" and r["odd.name"] == 1 and r.n_lines == 2 for r in rows)
    ids = sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))
    text = {r.doc_id: r.text for r in rows}
    if number == 0:
        assert {7, 9} <= set(ids) and not {1, 2, 3} & set(ids)
    elif number == 1:
        assert ids == [1, 2, 3, 5, 7, 7, 8, 9] and text[7] == "Twice the same row.\nTwice the same text." and text[1] is None and text[2] == ""
    elif number == 2:
        assert ids == [1, 2, 3, 5, 7, 8, 9]
    else:
        assert 2 <= len(ids) <= 9 and all(ids.count(i) <= (2 if i == 7 else 1) for i in ids)


def test_stages_against_plain_loops(spark, staged):
    """What a stage keeps, from the operator's own decisions on the stage before, by loops over rows."""
    first, named, lined, nearless, mixed, _ = staged
    model = {r.doc_id: r for r in corpus_pipeline.langid.identify(first, corpus_pipeline.langid.fit(first)).collect()}
    assert {r.doc_id: r.lang for r in named.collect()} == {i: r.predicted for i, r in model.items() if r.accepted}
    gone = {r.doc_id for r in corpus_pipeline.near.near_duplicates(lined).collect()}
    assert sorted(r.doc_id for r in nearless.collect()) == sorted(r.doc_id for r in lined.collect() if r.doc_id not in gone)
    shares = {s: (n, share) for s, n, _, share in mixing.quota_report(nearless)}
    got = [r.source for r in mixed.collect()]
    assert {s: got.count(s) for s in shares} == {s: round(share * len(got)) for s, (_, share) in shares.items()}
    before = {r.doc_id: r.text for r in named.collect()}
    kept = {line for r in lined.collect() for line in r.text.split("\n")}
    for r in lined.collect():
        assert set(r.text.split("\n")) <= set(before[r.doc_id].split("\n"))
    firsts = {}
    for i in sorted(before):
        for line in before[i].split("\n"):
            firsts.setdefault(line, i)
    lost = [line for line in firsts if line.strip() and line not in kept]
    sets = {line: set(s.tolist()) for line, s in zip([*lost, *kept], corpus_pipeline.lines.shingle_sets(pa.array([*lost, *kept]), 6))}
    alone = [x for x in lost if not any(len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) for y in kept if y.strip())]
    assert len(alone) <= 0.02 * max(1, len(firsts))
