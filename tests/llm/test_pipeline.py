"""The pipeline's stages against what they should keep."""

import random

import corpus_pipeline
import public_tokenizers
import tiktoken

from rillspark.llm import bpe, quality
from rillspark.llm.common import table

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_documents_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "encode"]


def test_run_against_a_chain_of_plain_versions(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeilmnorst") for _ in range(6)) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = line(30)
    good = [line(60) for _ in range(120)]
    junk = [" ".join(rng.choice(["BUY!!", "$$$", "NOW!!", "&&&"]) for _ in range(40)) for _ in range(60)]
    planted = [good[3], good[3], good[9], f"{line(40)} {passage.upper()} {line(40)}", f"{line(20)} {passage}", good[5].upper(), None, ""]
    rows = list(enumerate([*good, *junk, *planted]))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    predicted = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, labels).collect()}
    left = [[(i, t) for i, t in rows if predicted[i]]]
    left.append([(i, t) for i, t in left[-1] if i in {x[0] for x in brute.exact(left[-1]) if x[3]}])
    left.append([(i, t) for i, t in left[-1] if i in {x[2] for x in brute.near(left[-1])}])
    left.append([(i, t) for i, t in left[-1] if i not in {x[0] for x in brute.contaminated(left[-1], [(1, passage)]) if x[-1]}])
    sizes = [len(rows), *map(len, left)]
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] > 100  # every stage has work, and leaves rows

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t in left[-1]:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(b"".join(x.to_bytes(4, "little") for x in ids)), brute.sha((t or "").encode())))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)
