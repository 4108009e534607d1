"""The pipeline's rows against a plain version of every stage, on a small corpus."""

import hashlib
import random

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from signalmill.llm import bpe
from signalmill.llm.queries import RANKS
from test_simhash import brute_components, brute_print

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    syllables = ["tha", "ing", "ore", "ent", "al", "be", "un", "ver"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(30))) for i in range(6)]
    texts, kinds = [], []
    for i in range(260):
        kind = rng.choice(["plain", "plain", "plain", "junk", "short", "repeat", "leak", "copy", "private"])
        words = prose(rng.randint(40, 120))
        if kind == "junk":
            words = [w + rng.choice(["###", "%%%", "$$$"]) for w in words]
        elif kind == "short":
            words = words[:9]
        elif kind == "repeat":
            words = (words[:10] * 12)[:100]
        elif kind == "leak":
            words[20:20] = rng.choice(items)[1].split()
        elif kind == "copy" and "plain" in kinds:
            words = texts[kinds.index("plain")].split()
        elif kind == "private":
            words[5:5] = ["+1", "(784)", "555-9263", "ann.bee@mail.example.com", f"10.0.0.{rng.randrange(250)}"]
        texts.append(" ".join(words))
        kinds.append(kind)
    return texts, kinds, items


def test_run_equals_the_plain_version(spark, tmp_path):
    texts, kinds, items = corpus()
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", "", "", 0)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(k not in ("junk", "repeat")), 0) for i, k in enumerate(kinds)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = [i for i, k in enumerate(kinds) if k not in ("junk", "short", "repeat")]
    chosen = set(brute_components(good, [brute_print(texts[i]) for i in good], 4))
    clean = sorted(i for i in chosen if not any(item in texts[i] for _, item in items))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(found) == clean and len(clean) > 60
    coder = bpe.Bpe(bpe.rank_file(RANKS), P.PATTERN)
    for i in clean:
        same = found[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()
        assert same == (kinds[i] != "private")
        if same:
            ids = coder.encode([texts[i]])[0]
            assert found[i]["n_tokens"] == len(ids)
            assert found[i]["ids_sha256"] == hashlib.sha256(coder.decimals(ids)).hexdigest()


def test_stages_keep_the_columns_and_take_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "s", 9), (None, text, None, None, None), (None, None, None, None, None), (3, "", "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("fp", F.lit(1))
    for table, want in ((docs, {1}), (docs.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, str(tmp_path))
            assert table.columns == docs.columns, name
        assert {r["doc_id"] for r in table.collect()} == want
        assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == len(want)
