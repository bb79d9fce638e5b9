"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.work import stored

from ..conftest import SMALL
from .test_operators import check_pieces, docs_of, jaccard_brute, target_brute


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stored(stage(spark, docs, SMALL), name)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay(outputs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for name in names[:-1]:
        assert outputs[name].columns == outputs["input"].columns


def test_quality_keeps_the_good(spark, outputs):
    kept = set(rows(outputs["quality"]))
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        assert (r["doc_id"] in kept) == (r["quality"] == 1)


def test_line_dedup_only_takes_lines(outputs):
    before, after = rows(outputs["quality"]), rows(outputs["line_dedup"])
    assert set(before) == set(after)
    for k, r in after.items():
        left = iter(before[k]["text"].split("\n"))
        assert all(line in left for line in r["text"].split("\n")) and r["n_chars"] == len(r["text"])


def test_near_dedup_keeps_one_of_each(outputs):
    before, after = rows(outputs["line_dedup"]), rows(outputs["near_dedup"])
    ids = sorted(before)
    _, component = jaccard_brute([before[k]["text"] for k in ids])
    assert set(after) == {ids[c] for c in component} and all(after[k] == before[k] for k in after)


def test_mixing_meets_targets(outputs):
    before, size = outputs["near_dedup"].collect(), Counter()
    for r in before:
        size[r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in outputs["mixing"].collect():
        taken[r["source"]] += len(r["text"].split())
    target = target_brute(size)
    assert all(abs(taken[s] - target[s]) <= 3 for s in size)


def test_packing_holds_all_tokens(outputs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in outputs["mixing"].collect():
        want[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    got, by_sequence = Counter(), defaultdict(int)
    for r in outputs["packing"].collect():
        got[r["doc_id"]] += r["length"]
        by_sequence[r["sequence_id"]] += r["length"]
    assert got == want and max(by_sequence.values()) <= 2048
    assert check_pieces is not None


def test_run_equals_the_stages(spark, outputs):
    assert corpus_pipeline.run(spark, SMALL).agg(F.sum("length")).first()[0] == outputs["packing"].agg(F.sum("length")).first()[0]


def test_stages_take_odd_rows(spark):
    docs = docs_of(spark, None, "", "a few plain words in a row here", "a few plain words in a row here", ids=[None, 1, 2, 2], source=None, lang=None)
    assert corpus_pipeline.near_dedup(spark, docs, SMALL).count() == 3
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() >= 0 and stage(spark, docs.limit(0), SMALL).count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns
