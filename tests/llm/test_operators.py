"""The training-text operators against brute force, on small fixtures with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import batches, graph, language_model, licenses, mixing, ngram_join, packing, personal, quality, sharding, tokens, vectors, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


def corpus(seed=1, n=60):
    """Unique ids; null, blank and short texts, exact and near copies, a long text, a hot source, clashing extra columns."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["the", "of", "and"]
    texts = [None, "", " \n\t ", "one", "two words", "the end the end the end"]
    while len(texts) < n - 8:
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 150))))
    for i in range(8):
        words = (texts[20] or "").split()
        if i > 2:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(6000)))
    rows = [(i * 3, t, "en", None if i % 11 == 0 else "a" if i % 3 else f"s{i % 5}", None, "x", "y") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing_meets_targets_and_limits(docs, empty):
    first = mixing.mix_counts(docs, block=16).toPandas()
    per = first.groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(per["target"].sum() - per["size"].sum()) < 1e-6
    assert ((per["target"] - per["taken"]).abs() <= 1).all() and (per["target"] <= 3 * per["size"] + 1e-9).all()
    assert (first["taken"] <= 3 * first["size"]).all() and len(first) == docs.count()
    again = mixing.mix_counts(docs.repartition(3), block=16).toPandas()
    assert first.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix_counts(empty).count() == 0


def test_streams_of_sources_follow_ids_however_far_apart(spark):
    rows = [(None if i % 11 == 0 else (i * 7919 % 97 - 40) * 10**15, None if i % 5 == 0 else "s1" if i % 3 else "s2", "w " * (i % 7)) for i in range(300)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block=4).sized.toPandas()
    assert len(found) == len(rows)
    for _, stream in found.groupby("sid"):
        stream = stream.sort_values(["doc_id", "size", "start"], na_position="first")
        assert stream["start"].tolist() == (stream["size"].cumsum() - stream["size"]).tolist()


def test_mixed_documents_hold_the_words_taken(docs):
    counts = mixing.mix_counts(docs, block=16).toPandas().set_index("doc_id")["taken"]
    mixed = mixing.mix_documents(docs, block=16)
    assert mixed.columns == docs.columns
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = Counter()
    for r in mixed.collect():
        assert r["text"] in whole[r["doc_id"]]
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {k: v for k, v in counts.items() if v} == dict(got)


def test_token_files_round_trip(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(1002, "hello <|endoftext|> world", "", "", None, "", ""), (1000, "a  b\n c ", "", "", None, "", ""), (1001, " lead <|endoftext|>   x", "", "", None, "", "")], SCHEMA)
    every = docs.unionByName(extra)
    found = {r["doc_id"]: r for r in tokens.read_documents(spark, tokens.write_sequences(every, path, length=64)).collect()}
    encode, at = pytest.importorskip("tokenizers").Tokenizer.from_file(path).encode, 0  # the library as it is
    for r in sorted(every.collect(), key=lambda x: x["doc_id"]):
        ids = [*encode(r["text"] or "", add_special_tokens=False).ids, 0]
        got = found[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.read_documents(spark, tokens.write_sequences(empty, path)).count() == 0


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both * den >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(
    "k,threshold,num,den,constants",
    [(4, 0.85, 85, 100, {}), (2, 0.5, 1, 2, {"SMALL": 2, "LEAF": 2}), (2, 0.5, 1, 2, {"SMALL": 2, "CELL_SETS": 2, "BLOCK": 3})],
    ids=["listed pairs", "large regions in cells", "cells beyond one task"],
)
def test_ngram_join_is_exact(docs, empty, k, threshold, num, den, constants, monkeypatch):
    for name, value in constants.items():
        monkeypatch.setattr(ngram_join, name, value)
    wanted = brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, k, num, den)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs, k, threshold).collect()}
    assert found == wanted
    if k == 4:
        kept = ngram_join.one_of_each(docs, k, threshold)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in wanted.items() if i == c)
        assert ngram_join.ngram_jaccard_join(empty, k, threshold).count() == 0


def test_sets_that_share_a_passage_only_are_not_compared(monkeypatch):
    """a large region of unrelated sets made products of all of them over all their shingles; those that may link are still found."""
    rng, t = np.random.default_rng(6), Fraction(4, 5)
    passage = rng.integers(0, 2**63, 20).astype(np.uint64)
    values = [np.unique(np.concatenate((passage, rng.integers(0, 2**63, 180).astype(np.uint64)))) for _ in range(300)]
    values += [np.unique(np.concatenate((v[:-5], rng.integers(0, 2**63, 5).astype(np.uint64)))) for v in values[:3]]
    values = [np.sort(v) for v in values]
    sets, compared = [set(v.tolist()) for v in values], []
    product = ngram_join._intersections
    monkeypatch.setattr(ngram_join, "_intersections", lambda rows, columns: compared.append(len(rows) * len(columns)) or product(rows, columns))
    monkeypatch.setattr(ngram_join, "SLICE", 10_000)
    cell = ngram_join._Cell(values, t)
    cell.compare(np.zeros((0, 2), int), [np.arange(len(values))])
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    assert links == [(0, 300), (1, 301), (2, 302)] and [cell.root[j] for _, j in links] == [0, 1, 2] and sum(cell.root != np.arange(len(sets))) == 3
    assert sum(compared) <= 36
    some, others = [values[i] for i in (0, 5, 300)], [values[i] for i in (300, 7)]
    assert product(some, others).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in others] for a in some]


def test_voronoi_regions_of_a_cell_lose_no_link():
    """Families of near copies and unrelated sets, as listed pairs or as one group: the components are those of all pairs."""
    rng, t = np.random.default_rng(5), words.as_fraction(0.8)
    for way in ("pairs", "groups"):
        values = []
        for family in range(12):
            base = rng.integers(0, 2**63, rng.integers(30, 90), dtype=np.uint64)
            for _ in range(rng.integers(1, 30)):
                drop = rng.integers(0, len(base) // 4)
                values.append(np.unique(np.concatenate((rng.permutation(base)[drop:], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)))))
        n = len(values)
        every = np.array([(i, j) for i in range(n) for j in range(i + 1, n)])
        both = [len(np.intersect1d(values[i], values[j])) for i, j in every]
        linked = [(i, j) for (i, j), b in zip(every, both, strict=True) if b * 10 >= 8 * (len(values[i]) + len(values[j]) - b)]
        truth = batches.least_label(n, *np.array(linked).T)
        cell = ngram_join._Cell(values, t)
        cell.join(np.arange(n), every if way == "pairs" else every[:0], [np.arange(n)] if way == "groups" else [])
        assert (cell.root == truth).all() and 0 < cell.measured < len(every)


def test_rows_of_one_id_and_unlike_texts_stay(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, one), (5, two), (5, two), (7, one + " more"), (3, three), (5, three + " end"), (None, one), (8, None), (8, "  "), (9, two.upper())]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(5, one), (5, two), (3, three), (None, one), (8, None), (8, "  ")], key=str)


def test_a_text_without_an_id_is_no_pivot(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    rng = random.Random(3)
    while True:
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        texts = [" ".join(base), *[" ".join([*base[: 8 * i + 5], "changed", *base[8 * i + 6 :]]) for i in range(12)]]
        (nodes,) = [ngram_join._node(*words.shingle_sets(data, offsets, 5)).view(np.int64) for _, _, data, offsets in words.text_chunks(pa.array(texts))]
        if nodes.argmin() == 0:
            break
    rows = ngram_join.ngram_jaccard_join(spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows if r["doc_id"]) == [(i, 1) for i in range(1, 13)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: label[x] for x in touched}


def test_packing_keeps_capacity_and_conflicts(docs, empty):
    packed = packing.best_fit_pack(docs, capacity=200, group_rows=30).toPandas()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = packed.groupby("doc_id")["size"].sum().to_dict()
    assert sizes == {i: len(WORD.findall(t or "")) for i, t in text.items()}
    for _, rows in packed.dropna(subset=["bin"]).groupby(["pack_group", "bin"]):
        assert rows["size"].sum() <= 200 and not rows["source"].fillna("").duplicated().any()
        assert not rows["doc_id"].map(text).duplicated().any()
        spans = sorted(zip(rows["bin_offset"], rows["size"], strict=True))
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    assert packing.best_fit_pack(empty).count() == 0


def test_packing_does_not_depend_on_the_order_of_rows(spark, docs):
    again = spark.createDataFrame([(None, "a b c", None, "s", None, "", "")] * 5 + [(7, "a b c", None, "s", None, "", "")] * 3, SCHEMA)
    every = docs.unionByName(again)
    one, two = (sorted(map(str, packing.best_fit_pack(d, capacity=60, group_rows=20).collect())) for d in (every, every.repartition(5)))
    assert one == two and len(one) >= every.count()


def test_groups_are_packed_as_by_a_plain_best_fit():
    """Against a search of all bins for the one with the least room that holds neither the source nor the cluster."""
    rng, capacity = random.Random(8), 50
    items = pd.DataFrame([(i, "s", 0, rng.randint(1, 50), rng.randint(0, 12), rng.randint(0, 40)) for i in range(400)], columns=["doc_id", "source", "piece", "size", "source_bit", "cluster"])
    found = packing.pack_group(items, capacity).set_index("doc_id")
    bins = []  # [room, sources, clusters]
    for r in items.sort_values(["size", "doc_id"], ascending=[False, True]).itertuples():
        fitting = [(b[0], i) for i, b in enumerate(bins) if b[0] >= r.size and r.source_bit not in b[1] and r.cluster not in b[2]]
        at = min(fitting)[1] if fitting else len(bins)
        if at == len(bins):
            bins.append([capacity, set(), set()])
        offset = capacity - bins[at][0]
        bins[at][0] -= r.size
        bins[at][1].add(r.source_bit)
        bins[at][2].add(r.cluster)
        assert tuple(found.loc[r.doc_id, ["bin", "bin_offset"]]) == (at, offset)


def test_patterns_of_personal_data_against_plain_expressions():
    """The contract's expressions as they stand, with no possessive runs or search of their own."""
    rng = random.Random(4)
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(digits):
        doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
        return sum(x // 10 + x % 10 for x in doubled) % 10 == 0

    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return (True, all(int(x) <= 255 for x in m.split(".")) if kind == 1 else None, 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]

    for _ in range(4000):
        text = "".join(rng.choice("0123456789a.@- +()1222") for _ in range(rng.randint(0, 60)))
        assert personal.base_spans(text) == [(k, *m.span()) for k, p in enumerate(plain) for m in re.finditer(p, text) if holds(k, m[0])]


def test_beliefs_are_the_marginals_where_there_are_no_loops():
    rng = np.random.default_rng(6)
    weights = personal.Weights(rng.normal(size=(personal.Field.FEATURES, 5)), rng.normal(size=(5, 5)), 1.3)
    for text in ("call 0123456 or a@b.c 99 then", "x 5551234 far away 12 and again 5551234"):
        spans = personal.base_spans(text)
        field = personal.Field(text, spans)
        n = len(field.label)
        assert n >= 3
        mass = np.zeros((n, 5))
        for labels in np.ndindex(*[5] * n):
            if all(known in (0, got) for known, got in zip(field.label, labels, strict=True)):
                own = sum(field.features[i] @ weights.unary[:, x] for i, x in enumerate(labels) if not field.label[i])
                pair = sum(weights.chain[labels[a], labels[b]] for a, b in field.chain) + sum(weights.skip * (labels[a] == labels[b]) for a, b in field.skip)
                for i, x in enumerate(labels):
                    mass[i, x] += np.exp(own + pair)
        assert np.allclose(personal.beliefs(field, weights, rounds=200), mass / mass.sum(axis=1, keepdims=True), atol=1e-3)


def test_bins_take_the_tightest_compatible_one():
    bins = packing.Bins(10)
    assert bins.put(6, 1, 0) == (0, 0) and bins.put(7, 2, 0) == (1, 0)
    assert bins.put(3, 4, 0) == (1, 7)  # the tighter of both
    assert bins.put(4, 1, 0) == (2, 0)  # bin 0 has room, but its source conflicts
    assert bins.put(4, 8, 0) == (0, 6)


def test_personal_data(spark, empty):
    texts = [
        None, "", "mail a.b+c@x-y.example.com, ip 1.2.3.4 and 1.2.3.400 card 4111 1111 1111 1111 no 4111 1111 1111 1112", "call +1 (988) 555-2485 now", "@@a@b.c.d@e",
        "ring +491511234567 today or 491511234567 tomorrow, yes 491511234567",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in enumerate(texts * 3)], SCHEMA)
    rows = personal.find_personal(docs).toPandas()
    assert len(rows) == len(texts) * 3
    for r in rows.itertuples():
        spans = personal.base_spans(texts[r.doc_id % len(texts)] or "")
        base = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
    third = rows[rows["doc_id"] == 2].iloc[0]
    assert (third["n_email"], third["n_ip"], third["n_card"], third["n_phone"]) == (1, 1, 1, 0)
    masked = {r["doc_id"]: r["text"] for r in personal.mask_personal(docs).collect()}
    assert "555-2485" not in masked[3] and masked[0] is None
    assert personal.find_personal(empty).count() == 0


def test_field_ties_repeated_tokens_to_a_labelled_one():
    text = "write to 491511234567 or +491511234567 again 491511234567 end"
    spans = personal.base_spans(text)
    even = personal.Weights(np.zeros((personal.Field.FEATURES, 5)), np.zeros((5, 5)), 5.0)
    added = personal.added_spans(text, spans, even)
    assert [text[s:e] for _, s, e in added] == ["491511234567", "491511234567"] and {k for k, _, _ in added} == {3}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base[:10] + 0.03 * rng.standard_normal((10, 16)), base[:3], base[:2] * 2]))]
    rows += [(100, None), (101, [0.0] * 16), (102, [float("nan")] * 16), (103, [1.0]), (104, [None] + [1.0] * 15)]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    v = np.array([r[1] for r in rows[:55]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    assert found["n_links"].sum() >= 0.9 * near.sum() and (found["n_links"].reindex(range(55)) <= near.sum(axis=1)).all()
    assert (found.loc[[100, 101, 102, 103, 104], "n_links"] == 0).all() and found.loc[50, "component_id"] == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n,lean,least", [(20000, 0, 0.98), (600, 16, 1)])
def test_vectors_at_the_threshold_are_found(spark, n, lean, least):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((n // 2, 32)) + lean * np.eye(32)[0]
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal(base.shape)
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    v = np.concatenate([base, 0.951 * base + np.sqrt(1 - 0.951**2) * off])
    found = vectors.near_vectors(spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")["n_links"].reindex(range(n))
    wanted = np.concatenate([(v[low : low + 2000] @ v.T >= 0.95).sum(axis=1) for low in range(0, n, 2000)]) - 1
    assert (found.to_numpy() <= wanted).all() and found.sum() >= least * wanted.sum()


def test_planned_tables_hold_recall_at_every_size():
    sample = np.random.default_rng(6).standard_normal((1000, 24))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    for n in (2, 10**4, 10**6, 10**8, 10**10):
        width, tables, mean, projection = vectors.plan_tables(sample, n, 0.95)
        assert projection.shape == (24, width * tables) and vectors.estimated_recall(sample, mean, projection, width, 0.95, seed=8) >= 0.98


def test_sharding(docs, empty):
    rows = sharding.shard_by_size(docs, shards=6).toPandas()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r.size_ == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows.rename(columns={"size": "size_"}).itertuples())
    for _, s in rows.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    assert rows.groupby("shard")["size"].sum().max() <= rows["size"].sum() / 6 + 2 * rows["size"].max()
    assert sharding.shard_by_size(empty).count() == 0


def test_quality_counts(docs, empty):
    found = quality.quality_verdicts(docs).toPandas().set_index("doc_id")
    for r in docs.collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        row = found.loc[r["doc_id"]]
        assert (row["n_words"], row["word_chars"], row["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert row["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (row["base_failed"] and row["kept"])
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(found.index[found["kept"]])
    assert quality.quality_verdicts(empty).count() == 0


def test_licenses(spark, empty):
    mit = licenses.TEMPLATES["mit"]
    noisy = " ".join(w for i, w in enumerate(mit.split()) if i % 12)
    texts = ["intro words\nReleased under the MIT License.\nmore", noisy, "plain text of nothing", None, "the License of the Software under the terms " * 30]
    rows = licenses.scan_licenses(spark.createDataFrame([(i, t, "", "", None, "", "") for i, t in enumerate(texts)], SCHEMA)).toPandas().set_index("doc_id")
    assert rows.loc[0, "license"] == "mit-line" and rows.loc[0, "first_word"] == 2 and rows.loc[1, "license"] == "mit" and 0.8 <= rows.loc[1, "coverage"] < 1
    assert rows.loc[[2, 3, 4], "license"].isna().all()
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("name", ["mit", "apache-2.0", "bsd-3-clause", "gpl-3.0"])
def test_a_changed_copy_does_not_hide_an_exact_one(spark, name):
    words = licenses.TEMPLATES[name].split()
    texts = []
    for i in range(len(words)):
        changed = [*words[:i], "zzzz", *words[i + 1 :]]
        for first, second in ((words, changed), (changed, words)):
            texts.append(" ".join([*first, *["filler"] * (3 * len(words)), *second]))
    texts.append(" ".join(["filler", *words[: len(words) // 2], *["filler"] * (3 * len(words)), *words[len(words) // 2 :]]))
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").sort_index()
    assert (rows["last_word"][:-1] - rows["first_word"][:-1] == rows["last_word"][0] - rows["first_word"][0]).all() and (rows["license"][:-1] == name).all() and (rows["coverage"][:-1] == 1).all() and rows["license"].iloc[-1] != name


def test_bit_rows_give_the_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(12)] for _ in range(2))
        at = {w: sum(1 << i for i, x in enumerate(a) if x == w) for w in range(5)}
        assert licenses._longest(at, 12, b) == len(licenses._common(a, 0, 12, b, 0, 12))


def test_patience_equals_longest_common_subsequence_on_permutations():
    rng = random.Random(5)
    for _ in range(50):
        a, b = (rng.sample(range(12), 9) for _ in range(2))
        table = [[0] * 10 for _ in range(10)]
        for i in range(9):
            for j in range(9):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert len(licenses.patience(a, b)) >= table[9][9] - 1 and all(a[i] == b[j] for i, j in licenses.patience(a, b))


def test_language_model(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("piece_bpe_32k.model"))
    rows = language_model.score_documents(docs, path, head=20).toPandas().set_index("doc_id")
    tokens_of = {r["doc_id"]: [*[w.lower() for w in WORD.findall(r["text"] or "")], "\n"] for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens_of}
    counts = Counter(w for i, t in tokens_of.items() if not out[i] for w in t)
    total, kinds = sum(counts.values()), len(counts)
    for i, t in tokens_of.items():
        r = rows.loc[i]
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (total + kinds + 1)) for w in t))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert r["score"] < 0
    assert language_model.score_documents(empty, path).count() == 0


def test_lattice_sums_over_all_spellings():
    lattice = language_model.Lattice(["▁", "▁a", "a", "ab", "b"], np.log10([0.1, 0.2, 0.3, 0.15, 0.25]), np.full(256, -3.0))
    wanted = np.log10(0.1 * 0.3 * 0.25 + 0.1 * 0.15 + 0.2 * 0.25)
    assert lattice.one("ab") == pytest.approx(wanted) and lattice.many(["ab", "é"]) == pytest.approx([wanted, -7.0])


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rows = [r[:5] for r in corpus(7, 40)]
    schema = T.StructType([T.StructField(n, T.StringType() if n in ("text", "lang", "source") else T.LongType()) for n in ("doc_id", "text", "lang", "source", "n_chars")])
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    assert {"doc_id", "bin"} <= set(corpus_pipeline.run(spark, str(tmp_path)).columns)


def test_expected_uses_of_pieces_are_those_over_all_spellings():
    """Against a list of every spelling, for short words and for one beyond the length that is handled at once."""
    names = [language_model.MARK, "a", "b", "ab", language_model.MARK + "a", "ba", "bab"]
    lattice = language_model.Lattice(names, np.log10(np.array([0.2, 0.1, 0.15, 0.2, 0.1, 0.05, 0.1])), np.full(256, -3.0))

    def spellings(text):
        if not text:
            yield [], 0.0
        for name in names:
            if text and text.startswith(name):
                yield from (([name, *rest], lattice.by_name[name] + p) for rest, p in spellings(text[len(name) :]))
        if text and text[0] not in names:
            yield from (([text[0].encode(), *rest], lattice._by_bytes(text[0]) + p) for rest, p in spellings(text[1:]))

    uses = {"ab": 3, "bab": 2, "a\u00e9b": 1}
    pieces, by_byte = lattice.expected(list(uses), np.array(list(uses.values())))
    want, want_bytes = Counter(), np.zeros(256)
    for word, n in uses.items():
        every = list(spellings(language_model.MARK + word))
        total = sum(10**p for _, p in every)
        assert np.isclose(lattice.one(word), np.log10(total)) and np.isclose(lattice.many([word])[0], np.log10(total))
        for parts, p in every:
            for part in parts:
                if isinstance(part, bytes):
                    for b in part:
                        want_bytes[b] += n * 10**p / total
                else:
                    want[part] += n * 10**p / total
    assert np.allclose(pieces, [want[x] for x in names]) and np.allclose(by_byte, want_bytes)
    long = "ab" * 30
    one, many = np.zeros(len(names)), np.zeros(len(names))
    lattice._expected_one(long, 2.0, one, np.zeros(256))
    points = np.frombuffer((language_model.MARK + long).encode("utf-32-le"), np.uint32)[None].astype(np.uint64)
    lattice._expected_many(points, np.array([2.0]), many, np.zeros(256))
    assert np.allclose(one, many)


def awkward(spark):
    """Null ids, ids and rows that repeat, null and blank texts, ties, columns with clashing names."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(3, 90))) for _ in range(12)] + [None, "", "  "]
    rows = [(None if i % 5 == 0 else i % 7, t, None if i % 4 == 0 else "s", "x", i, "r") for i, t in enumerate(texts)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, _hash long, _rank string")


def test_null_and_repeated_ids_lose_no_row(spark):
    docs, public = awkward(spark), pytest.importorskip("public_tokenizers")
    n = docs.count()
    runs = {
        "mixing": mixing.mix_counts(docs, block=16), "personal": personal.find_personal(docs), "masked": personal.mask_personal(docs), "sharding": sharding.shard_by_size(docs, 5),
        "quality": quality.quality_verdicts(docs), "licenses": licenses.scan_licenses(docs), "join": ngram_join.ngram_jaccard_join(docs, 2, 0.5), "scores": language_model.score_documents(docs, str(public.path("piece_bpe_32k.model"))),
    }
    assert {name: df.count() for name, df in runs.items()} == dict.fromkeys(runs, n)
    packed = packing.best_fit_pack(docs, capacity=1000)
    assert packed.count() == n
    kept = ngram_join.one_of_each(docs, 2, 0.5)
    assert kept.columns == docs.columns and {(r["_hash"], r["_rank"]) for r in kept.collect()} <= {(i, "r") for i in range(15)}
    mixed = mixing.mix_documents(docs, block=16)
    assert mixed.columns == docs.columns and mixed.count() > 0


def test_shards_are_those_of_plain_prefix_sums(docs):
    xxhash = pytest.importorskip("xxhash")
    shards, rows = 7, []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        value = xxhash.xxh64_intdigest(raw, seed=42)
        rows.append((value - (1 << 64) if value >> 63 else value, zlib.crc32(raw), r["doc_id"], len(raw) + 16))
    rows.sort()
    target, largest, low, place = sum(r[3] for r in rows) / shards, max(r[3] for r in rows), 0, []
    for r in rows:
        place.append((low, low + r[3]))
        low += r[3]
    want = {}
    for r, (low, high) in zip(rows, place, strict=True):
        group = [p for q, p in zip(rows, place, strict=True) if q[:2] == r[:2]]
        first, end = group[0][0], group[-1][1]
        whole = len(group) > 1 and end - first <= max(sharding.SLACK * target, largest) and first // target < (end - 1) // target
        want[r[2]] = min(int(((first + end) / 2 if whole else (low + high) / 2) // target), shards - 1)
    found = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_by_size(docs, shards).collect()}
    assert {i: s for i, (s, _) in found.items()} == want
    slots = Counter()
    for r in rows:
        assert found[r[2]][1] == slots[want[r[2]]]
        slots[want[r[2]]] += 1


def test_the_pipeline_takes_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    awkward(spark).limit(0).withColumn("n_chars", F.lit(1).cast("long")).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
