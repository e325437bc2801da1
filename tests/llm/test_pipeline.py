"""The pipeline beside a plain one, on a small corpus."""

import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import prose
from .test_corpus_operators import linked


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    texts = {i: prose(rng, rng.randrange(25, 120)) for i in range(60)}
    texts[60], texts[61] = texts[0], texts[1] + " more"
    texts[62], texts[63] = "too short", None
    texts[64] = prose(rng, 60) + " password=18a0165473c0330cab end"
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = {i: t for i, t in texts.items() if t and len(t.split()) >= 20}
    kept = {i: good[i] for i, (_, c) in linked(good, 5).items() if i == c}
    kept[64] = kept[64].replace("18a0165473c0330cab", "[SECRET]")
    assert {r["doc_id"] for r in got} <= set(kept)
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got:
        text = kept[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["n_tokens"] == len(tk.encode(text, add_special_tokens=False).ids)
    sizes = {s: sum(len(t.split()) for i, t in kept.items() if i % 3 == s) for s in range(3)}
    total = sum(sizes.values())
    for s in range(3):
        taken = sum(len(kept[r["doc_id"]].split()) for r in got if r["doc_id"] % 3 == s)
        assert abs(taken - total * (s + 1) / 6) <= 60


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
