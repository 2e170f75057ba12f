"""What reaches the driver is bounded, and other tokenizers are run on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wardstat.llm import decontaminate as D
from wardstat.llm import token_files, toxicity
from wardstat.llm.common import scratch_path


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library_for_any_tokenizer(spark, name):
    """A byte-level file's tokens begin with their space: its texts are not cut."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(["two  words here", " lead", "", "a\nb\r\n\tc", "it's 12.5% naïve", "é日本 😀 <|endoftext|> x", "word " * 3000, None])]
    assert token_files.WordEncoder(path).bare == (name == "word_bpe_49k.json")
    folder = scratch_path(spark, "any-tokenizer")
    read = token_files.read_files(token_files.write_files(docs(spark, rows), folder, path, 7), folder).collect()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read}
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 7]
        assert got[d] == ids, t


def test_a_window_of_ten_thousand_items(spark):
    """Its items never meet in a broadcast; every document that has it lists them."""
    passage = " ".join(f"word{i}" for i in range(30))
    bench = spark.range(10_000).select(F.col("id").alias("item_id"), F.lit(passage).alias("text")).unionByName(
        spark.createDataFrame([(10_000, "another item of its own with ten words in it, yes")], "item_id long, text string"))
    known = D.Windows(bench)
    assert known.count == 23 and known.items().count() == 210_002
    block = next(known.blocks(1000))
    assert sum(len(numbers) for _, _, _, numbers in block.tables) == 23
    rows = [(d, f"before {passage} after") for d in range(20)] + [(90, "nothing"), (91, " ".join(passage.split()[5:16]))]
    want = hashlib.sha256(",".join(sorted(map(str, range(10_000)))).encode()).hexdigest()
    for most in (1000, 5):
        got = D.scan(docs(spark, rows), bench, block_windows=most).select(
            "doc_id", F.size("items").alias("n"), F.sha2(F.concat_ws(",", "items"), 256).alias("sha"), F.size("spans").alias("s")).collect()
        assert {r["doc_id"]: (r["n"], r["s"]) for r in got} == {**{d: (10_000, 1) for d in range(20)}, 90: (0, 0), 91: (10_000, 1)}
        assert {r["sha"] for r in got if r["n"]} == {want}


def test_one_block_at_a_time(spark):
    rng = random.Random(1)
    bench = spark.createDataFrame([(i, " ".join(f"v{rng.randrange(500)}" for _ in range(20))) for i in range(30)], "item_id long, text string")
    known = D.Windows(bench)
    sizes = [sum(len(n) for _, _, _, n in b.tables) for b in known.blocks(100)]
    assert sizes == [100, 100, 100, known.count - 300]
    none = D.Windows(bench.limit(0))
    assert none.count == 0 and [b.tables for b in none.blocks(10)] == [[]]


def test_the_fit_is_bounded_in_rows_and_bytes():
    assert toxicity.fit_share(10, 100) == 1.0
    assert toxicity.fit_share(40_000, 100) == 0.5
    assert toxicity.fit_share(2_000, 2_000 * 200_000, fit_bytes=40_000_000) == 0.1
    assert toxicity.fit_share(0, 0) == 1.0


def test_long_texts_shrink_the_sample_and_the_rest_is_counted(spark, monkeypatch):
    rng = random.Random(2)
    bad, good = [f"vile{i}" for i in range(40)], [f"kind{i}" for i in range(40)]
    rows = [(d, " ".join(rng.choice(bad if d % 3 == 0 else good) for _ in range(2_000))) for d in range(200)]
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in rows], "doc_id long, toxic int")
    seen = []
    real = toxicity._Sample

    def counted(found):
        found = list(found)
        seen.append(len(found))
        return real(found)
    monkeypatch.setattr(toxicity, "_Sample", counted)
    size = sum(len(t) for _, t in rows)
    model = toxicity.train(docs(spark, rows), labels, fit_bytes=size // 4)
    assert 20 <= seen[0] <= 90
    got = toxicity.score(docs(spark, [(1, "vile1 vile2 vile3"), (2, "kind4 kind5")]), model).collect()
    scores = {r["doc_id"]: r["toxicity"] for r in got}
    assert scores[1] > 0.5 > scores[2]
