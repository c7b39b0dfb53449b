"""Every stage of the pipeline against a plain version on its own input."""

import base64
import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import test_decontaminate  # noqa: E402
import test_simhash  # noqa: E402
import test_substring  # noqa: E402

import corpus_pipeline  # noqa: E402
from cellframe.llm import toxicity  # noqa: E402
from cellframe.llm.queries import table, tokenizer_file  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        steps.append((docs, out))
        docs = out
    for before, out in steps[:4]:
        assert out.columns == columns
    kept = {r.doc_id for r in toxicity.score(steps[0][0], toxicity.fit(steps[0][0], table(spark, SF, "labels"))).collect() if r.predicted == 0}
    assert rows(steps[0][1]) == [r for r in rows(steps[0][0]) if r[0] in kept]
    groups = test_simhash.brute([(r.doc_id, r.text) for r in steps[1][0].collect()])
    assert rows(steps[1][1]) == [r for r in rows(steps[1][0]) if r[0] in {c for _, _, c in groups}]
    before = steps[2][0].collect()
    plain = {r.doc_id: p for r, p in zip(before, test_substring.brute([(r.doc_id, r.text) for r in before]))}
    want = [(r.doc_id, plain[r.doc_id][3] if plain[r.doc_id][2] else r.text, r.lang, r.source, len(plain[r.doc_id][3]) if plain[r.doc_id][2] else r.n_chars) for r in before]
    assert rows(steps[2][1]) == sorted(want, key=str)
    before = [(r.doc_id, r.text) for r in steps[3][0].collect()]
    bad = {d for d, *_ in test_decontaminate.brute(before, [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])}
    assert rows(steps[3][1]) == [r for r in rows(steps[3][0]) if r[0] not in bad]
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in steps[4][0].collect():
        ids = coder.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert rows(steps[4][1]) == sorted(want, key=str)
    assert rows(corpus_pipeline.run(spark, SF)) == sorted(want, key=str)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, "a b c", None, None, 5), (1, "a b c", None, None, 5), (1, "a b c d", "x", "y", 7), (None, "some words of a row", None, None, None), (None, None, None, None, None), (2, "", "x", None, 0), (3, None, None, "z", None)]
    for given in (odd, []):
        docs = spark.createDataFrame(given, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            assert i == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        n = docs.count()
        assert n == (4 if given else 0)
