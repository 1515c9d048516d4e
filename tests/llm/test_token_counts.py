"""Token counts of prefixes against the tokenizers library, which encodes every prefix anew."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import token_counts as counts

public = pytest.importorskip("public_tokenizers")
PATH = str(public.path("byte_bpe_50k.json"))
PARTS = [
    "'s", "'re", "'ll", "'l", "'", "don't", "I'v", "I've", " 's", "\n's", " ", "  ", "\n", "\t", " \n", "\n ", "   ", "a", "the", "ing", " Inter", "nation", "Über", "é", "é", "中文", "한국", "😀", "՘", "꟎",
    "1", "23", " 2024", "!", "...", "==", "<|endoftext|>", "<|endof", " ", "　", "\x1c", "\x85", "aaaa", "xxxxxxxxxxx", "\U0003fc2c", "''s", "'VE",
]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def test_every_prefix_of_mixed_texts(library):
    rng, counter = random.Random(7), counts.Counter(PATH)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    for text in texts:
        want = [len(e.ids) for e in library.encode_batch([text[:i] for i in range(1, len(text) + 1)], add_special_tokens=False)]
        assert counter.steps(text).cumsum().tolist() == want, text


def test_memory_limits_change_nothing(library, monkeypatch):
    monkeypatch.setattr(counts, "REMEMBERED", 3)
    monkeypatch.setattr(counts, "PAIRS", 5)
    counter, rng = counts.Counter(PATH), random.Random(8)
    for _ in range(60):
        text = " ".join(rng.choice(PARTS) for _ in range(12))
        assert counter.steps(text).sum() == len(library.encode(text, add_special_tokens=False).ids)


def test_counts_budgets_and_truncation(spark, library, monkeypatch):
    monkeypatch.setattr(counts, "BATCH", 200)
    rng = random.Random(9)
    texts = [None, "", " ", "\n\n", "one", *["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60))) for _ in range(60)], "many different words " * 3000]
    rows = [(None if i == 7 else i // 2 * 2, t, 5, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, prefix_tokens string, `a.b` string")
    encode = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = sorted(map(tuple, counts.token_counts(docs, PATH, limit=20).collect()), key=repr)
    assert got == sorted([(r[0], len((r[1] or "").encode()), encode(r[1]), encode(r[1]) > 20) for r in rows], key=repr)
    counted = counts.prefix_counts(docs, PATH)
    for r in counts.truncate_texts(counted.where("text is not null"), 9).collect():
        assert r["kept_tokens"] == encode(r["text"]) <= 9 and r["kept_chars"] == len(r["text"])
    for r in counted.where("length(text) < 300").select("text", "prefix_tokens", counts.longest_prefix(9).alias("most")).collect():
        fits = [i for i in range(1, len(r["text"]) + 1) if encode(r["text"][:i]) <= 9]
        assert r["most"] == max(fits, default=0)
    places = counted.where("text is not null").select("text", F.explode(F.array(*map(F.lit, (-1, 0, 1, 5, 10**6)))).alias("position"), "prefix_tokens").select("text", "position", counts.tokens_before().alias("n"))
    assert all(r["n"] == encode(r["text"][: max(r["position"], 0)]) for r in places.collect())
    assert counts.token_counts(docs.limit(0), PATH).count() == 0


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        counts.Counter(str(public.path("word_bpe_49k.json")))
