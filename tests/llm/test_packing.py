"""Packing: ids of hard texts against the tokenizer, the placement against all levels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwright.llm import common, packing


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers
    from tokenizers import Tokenizer

    return packing.encoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken"))), Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.mark.parametrize("text", ["x" + " " * 1_000_000, "\n" * 1_000_000 + "a", "\r\n" * 500_000, " \t" * 500_000 + "yes", "a b" + "　" * 200_000 + " c", " " * 60_000 + "<|endoftext|>" + "\n" * 60_000 + "x" + " " * 70_000, "a" * 1_000_000, "7" * 300_000, "é" * 200_000 + " " * 50_000 + "é"])
def test_ids_of_long_runs(encoders, text):
    own, tokenizer = encoders
    assert own(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_blanks_by_the_million_are_packed(spark):
    docs = spark.createDataFrame([(1, "x" + " " * 5_000_000), (2, "\n" * 1_000_000), (3, "word")], "doc_id long, text string")
    got = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all")).collect()
    assert len(got) == 3 and all(r["n"] == r["all"] for r in got)


def test_each_document_goes_where_the_squares_grow_least():
    rng = random.Random(2)
    for length in (8, 16):
        packer = packing.Packer(length, 0)
        for k in range(300):
            s, before = rng.randint(1, length - 1), packer.counts.copy()
            sums = []
            for h in [0, *(h for h in range(1, length - s + 1) if before[h])]:
                n = before.copy()
                n[h] -= h > 0
                if h + s < length:
                    n[h + s] += 1
                sums.append(int((n[1:length] ** 2).sum()))
            packer.place((k, 0, np.zeros(s, dtype="<u4"), s))
            assert int((packer.counts[1:length] ** 2).sum()) == min(sums)


def test_row_keys_see_into_nested_maps(spark):
    df = spark.sql("select * from values (1, named_struct('m', map('a', 1)), array(map(1, 2)), map('x', 1)), (1, named_struct('m', map('a', 2)), array(map(1, 2)), map('x', 1)), (1, named_struct('m', map('a', 1)), array(map(1, 2)), map('x', 1)), (1, null, null, null) as t(i, s, a, m)")
    keys = [tuple(r) for r in df.select(*common.row_key(df)).collect()]
    assert keys[0] == keys[2] and len(set(keys)) == 3
