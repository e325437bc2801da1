"""Operators on single rows, beside brute force or an exact round trip."""

import fnmatch
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from brindle.llm import bpe, langid, media, quality, toxicity, url_filter

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_automaton_matches_globs():
    rng = random.Random(1)
    globs = ["*", "a*b", "?b*", "*ab*ba*", "", "a\\*b", "*" + "ab" * 40 + "*", "b"]
    auto = url_filter.Automaton.of(globs)
    texts = ["".join(rng.choice("ab*") for _ in range(rng.randrange(0, 12))).encode() for _ in range(300)] + [b"ab" * 41, b""]
    want = [[bool(re.fullmatch(fnmatch.translate(g.replace("\\*", "[*]")), t.decode())) for g in globs] for t in texts]
    assert auto.match(texts).tolist() == want


URLS = ["https://ExAmple.ORG/en/12?x#y", "http://a.example.org/es/", "http://x.com/de/1", "https://com/fr/", "http://org", "http://notorg/", None, "no sign", "", "http://spam-farm.example.net/a", "http://e.net/x.org/", "a://b://c", "http://x.org?q=/", "http://evil.net/#.org/", "http://u.net/p?utm_source=f", "http://h.com/en#" + "f" * 10_000]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fit = [(r, a) for r, a in url_filter.PATH_RULES for h, s, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    best = max(fit, key=lambda x: len(x[0]), default=None)
    return host, path, best


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit(1))
    for r in url_filter.judge(df).collect():
        host, path, best = judged(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        if best:
            assert r["verdict"] == ("allow" if best[1] else "block")
    verdict = {URLS[r["page_id"]]: r["verdict"] for r in url_filter.judge(df).collect()}
    assert verdict["http://spam-farm.example.net/a"] == verdict["http://u.net/p?utm_source=f"] == verdict[None] == "block"
    assert verdict["http://h.com/en#" + "f" * 10_000] == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    cover = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(odd, odd_rows, nothing):
    want = sorted(counted(r[1]) for r in odd_rows)
    got = quality.judge(odd).collect()
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(nothing).count() == 0 and quality.keep_good(nothing).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_rejects_junk_and_order_does_not_matter():
    rng = random.Random(2)
    clean = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(100))
    junk = [clean.upper().replace(" ", "!! "), clean.replace(" ", " | "), clean.replace(" ", "%%% ")]
    base = quality.Base([t.encode() for t in (clean, *junk)])
    for rules in (list(quality.RULES), list(quality.RULES)[::-1]):
        assert quality.cascade(base, np.arange(4), rules).tolist() == [0]
    every = [t.encode() for t in (clean, *junk)]
    plan = quality.plan_cascade(every, quality.BASE_RULES + quality.RULES)
    assert sorted(e.name for e in plan) == sorted(r.name for r in quality.BASE_RULES + quality.RULES)


def test_cascade_is_lazy_and_ranks_what_is_left(monkeypatch):
    """A rule ranks by what it rejects of what is left, and counts are made only for texts that reach a rule."""
    asked = []
    for name in ("n_symbols", "n_dup_lines"):
        monkeypatch.setitem(quality.COUNTS, name, lambda base, rows, name=name: asked.append((name, rows.tolist())) or np.zeros(len(rows), np.int64))
    texts = [b"w " * 5, b"w " * 30, None, b"v " * 40]
    some = [quality.Rule("few", lambda base, rows: base.of("n_words", rows) < 20), quality.RULES[0], quality.RULES[1]]
    assert quality.cascade(quality.Base(texts), np.arange(4), some).tolist() == [1, 3]
    assert asked == [("n_symbols", [1, 3]), ("n_dup_lines", [1, 3])]
    half = lambda wait, bad: lambda base, rows: (time.sleep(wait), np.isin(rows, bad))[1]
    rules = (quality.Rule("a", half(0.01, [0, 1])), quality.Rule("b", half(0.02, [0, 1])), quality.Rule("c", half(0.04, [2, 3])), quality.Rule("d", half(0.3, [])))
    assert [e.name for e in quality.plan_cascade([b""] * 5, rules)] == ["a", "c", "b", "d"]


def test_toxic_words_and_unseen_misspellings(spark, odd, nothing):
    rng = random.Random(3)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["idiot", "scumbag", "worthless"]
    docs = [(i, " ".join(rng.choice(bad) if i % 2 and rng.random() < 0.05 else rng.choice(plain) for _ in range(120))) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(df, labels.filter("doc_id < 1200"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df.filter("doc_id >= 1200"), model).collect()}
    assert np.mean([got[i] == i % 2 for i in got]) > 0.95
    text = " ".join(plain[:50])
    with_, without = model.logits([f"{text} idiott scumbags".encode(), text.encode()])
    assert with_ > without
    assert toxicity.score(odd, model).filter("score BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.score(nothing, model).count() == 0
    untrained = toxicity.fit(nothing, labels.limit(0))
    assert toxicity.score(odd, untrained).count() == odd.count()


def test_toxic_logits_do_not_depend_on_company():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.25)
    texts = [b"", b"a", b"the of", "ñandú über".encode(), b"x y z " * 50, b"word"]
    alone = np.concatenate([model.logits([t]) for t in texts])
    np.testing.assert_allclose(model.logits(texts), alone, rtol=1e-6)
    ids, n = toxicity.bag(texts[3])
    np.testing.assert_allclose((model.weight[ids] * n).sum() / n.sum() + 0.25, alone[3], rtol=1e-5)


def test_media_round_trip(odd, odd_rows, nothing):
    got = media.digest(odd).collect()
    want = []
    for r in odd_rows:
        raw = (r[1] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == len({w[2] for w in want})
    assert media.digest(nothing).count() == 0
    for n in (0, 1, 63, 64, 4097):
        data = bytes(i % 251 for i in range(n))
        assert media.decode_wav(media.encode_wav(data, 8000)) == (data, 8000)


def test_audio_features():
    x = np.sin(np.arange(16000) / 16000 * 2 * np.pi * 440).astype(np.float32)
    y = media.resample(x, 1, 2)
    want = np.sin(np.arange(8000) / 8000 * 2 * np.pi * 440)
    assert len(y) == 8000 and np.abs(y[200:-200] - want[200:-200]).max() < 0.01
    z = media.resample(x, 2, 3)
    assert np.abs(z[200:-200] - np.sin(np.arange(len(z)) * 1.5 / 16000 * 2 * np.pi * 440)[200:-200]).max() < 0.01
    assert media.spans(np.array([0, 0, 9, 4, 4, 1, 0, 7, 0.0])) == [(2, 5), (7, 8)]
    assert media.spans(np.empty(0)) == []


def test_audio_tensors(spark):
    df = spark.createDataFrame([(1, bytearray(range(256)) * 90), (2, None)], "doc_id long, payload binary")
    rows = media.segments(df).toArrow()
    table = media.tensor_table(rows)
    assert table["log_mel"].type == pa.fixed_shape_tensor(pa.float32(), (media.FRAMES, media.MELS), dim_names=("frame", "mel"))
    assert table.num_rows == 3 and all(a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))


def test_language(spark, odd, nothing):
    rng = random.Random(4)
    words = {"aa": ["the", "of", "and", "ing"], "bb": ["ñor", "que", "ción"], "cc": ["über", "der", "keit", "ung"]}
    docs = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(list(words) * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 90"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert all(got[i] == k for i, _, k in docs)
    out = langid.identify(odd, model).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == odd.count() and by_id[0]["lang_pred"] == by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.fit(nothing) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


def test_language_of_copies(spark, monkeypatch):
    """Languages of one text many times over are learned, and copies do not swell the sample."""
    names = ["aa", "bb", "cc", "dd", "ee", "ff"]
    docs = [(f"{name} {name * 3} " * 9, name) for name in names for _ in range(1500)] + [(f"zu {i} zuzu", "zz") for i in range(90)]
    seen, kmeans = [], langid.spherical_kmeans
    monkeypatch.setattr(langid, "spherical_kmeans", lambda x, k: seen.append(len(x)) or kmeans(x, k))
    model = langid.fit(spark.createDataFrame(docs, "text string, lang string").repartition(3), per_language=20)
    assert sorted(set(model.langs)) == [*names, "zz"] and seen == [1] * 6 + [20]
    assert model.predict([f"{name} {name * 3} ".encode() * 9 for name in names])[0] == names


def test_language_counts_in_pieces():
    text = bytes(random.Random(1).choice(b"abc de") for _ in range((1 << 20) + 50))
    whole = np.zeros(langid.DIM, np.int64)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:] + np.uint32(7919)
    three = two[:-1] * np.uint32(263) + b[2:] + np.uint32(104729)
    for grams in (b, two, three):
        whole += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=langid.DIM)
    assert (langid.counts(text) == whole).all()


ODD = ["", " <|endoftext|>x <|endoftext|><|endoftext|>  ", "I'll we've ''s 12½²٣ x\x1cy\x85z  q", "日本語 テスト😀👍🏽 ", "a" * 500, " " * 300 + "x", "ñß" * 400, "it's\r\n\t ok!!  \t", "٣½ 日本"]


@pytest.mark.parametrize("text", ODD)
def test_bpe_equals_library(text):
    tk, own = Tokenizer.from_file(PATH), bpe.codec(PATH)
    ids = tk.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == tk.decode(ids, skip_special_tokens=False) == text


def test_bpe_documents(odd, odd_rows, nothing):
    tk = Tokenizer.from_file(PATH)
    want = []
    for r in odd_rows:
        ids = tk.encode(r[1] or "", add_special_tokens=False).ids
        back = tk.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.digest(odd, PATH).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert bpe.digest(nothing, PATH).count() == 0
    assert {len(r["ids"]) for r in bpe.encode_documents(odd, PATH).collect()} == {w[0] for w in want}


def test_bpe_holds_the_ids_of_a_few_texts(monkeypatch):
    monkeypatch.setattr(bpe, "arrow", lambda df, run, schema: run)
    rng = random.Random(3)
    words = ["w" + str(i) for i in range(3000)]
    texts = [None, ""] + [" ".join(rng.choices(words, k=400)) for _ in range(3000)] + ["", None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])

    class Docs:
        schema = StructType().add("doc_id", "long").add("text", "string")

        def select(self, *names):
            return self

    tk = Tokenizer.from_file(PATH)
    for run in (bpe.digest(Docs(), PATH, with_ids=True), bpe.encode_documents(Docs(), PATH)):
        for _ in run(iter([batch.slice(0, 50)])):  # loads the vocabulary
            pass
        tracemalloc.start()
        at, got = 0, {}
        for out in run(iter([batch])):
            assert out.column(0).to_pylist() == list(range(at, at + len(out)))
            if at == 0 or at + len(out) == len(texts):
                got |= zip(out.column(0).to_pylist(), out.column("ids").to_pylist(), strict=True)
            at += len(out)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert at == len(texts) and all(ids == tk.encode(texts[i] or "", add_special_tokens=False).ids for i, ids in got.items())
        assert peak < 32 << 20  # the whole batch's ids, digests and texts at once take over 100 MB
