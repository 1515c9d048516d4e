"""The stages of the pipeline over a small table against plain Python, each on its own input, with awkward rows and column names."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, ngram_join, packing, personal, queries, sharding
from tessera.llm.personal import base_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `_none_` string, size string, `a c` int"


def table(seed=3):
    rng = random.Random(seed)
    plain = ["the", "of", "and", "to", "that", "with", *["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 8))) for _ in range(400)]]
    prose = lambda n: " ".join(rng.choice(plain) for _ in range(n)) + "."
    texts = [None, "", " \n ", "too short", "again " * 90] + [prose(rng.randint(60, 200)) for _ in range(36)]
    for i in (6, 7, 8):
        texts += [texts[i], texts[i].replace(" the ", " a ", 1), " ".join([*texts[i].split()[:-1], "changed"])]
    texts += [prose(80) + f" Mail jo{i}@mail.example.org or call +49 30 1234567{i}." for i in range(4)] + [prose(5000)]
    rows = [(i if i % 13 else None, t, "en", None if i % 9 == 0 else "s1" if i % 2 else f"s{i % 5}", len(t or ""), "x", "y", "z", 1) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20]]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and gave."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs, found = spark.createDataFrame(table(), SCHEMA), []
    docs.write.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        found.append((docs.toPandas(), spark.read.parquet(f"{folder}/{name}").toPandas(), docs.columns, out.columns))
        docs = spark.read.parquet(f"{folder}/{name}")
    return found, folder


def test_columns_stay(stages):
    for _, _, before, after in stages[0][:-1]:
        assert before == after


def test_quality_keeps_what_the_sql_keeps(stages):
    before, after, *_ = stages[0][0]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{stages[1]}/documents.parquet/*.parquet'")
    verdicts = con.execute(f"select doc_id, kept from ({queries.oracle_sql()['op8_quality']})").fetchall()
    assert Counter(after["doc_id"].fillna(-1)) == Counter(-1 if i is None else i for i, kept in verdicts if kept) and 0 < len(after) < len(before)


def test_one_of_each_group_of_near_duplicates_stays(stages):
    before, after, *_ = stages[0][1]
    rows = [(None if i != i else int(i), t) for i, t in zip(before["doc_id"], before["text"], strict=True)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in ([x.lower() for x in WORD.findall(t)] for _, t in rows)]
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in combinations(range(len(rows)), 2):
            if None not in (rows[a][0], rows[b][0]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    groups = defaultdict(list)
    for i, r in enumerate(root):
        groups[r].append(rows[i])
    least = [min(g)[0] if g[0][0] is not None else None for g in groups.values()]
    assert Counter(after["doc_id"].fillna(-1)) == Counter(-1 if i is None else i for i in least) and len(after) < len(before)


def test_personal_data_goes(stages):
    before, after, *_ = stages[0][2]
    assert len(before) == len(after) and sum(bool(base_spans(t)) for t in before["text"]) > 1 and not any(base_spans(t) for t in after["text"])
    clean = [t for t in before["text"] if not re.search("[0-9@]", t)]
    assert not Counter(clean) - Counter(after["text"])


def targets(sizes):
    """Shares by weight, cut at three times a source's size; what is cut off is dealt out again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in above}


def test_the_mix_meets_targets_worked_out_by_hand(spark, stages):
    before, after, *_ = stages[0][3]
    words = lambda df: Counter({s: sum(len(WORD.findall(t)) for t in g["text"]) for s, g in df.assign(source=df["source"].fillna("~")).groupby("source")})
    want = targets({None if s == "~" else s: n for s, n in words(before).items()})
    for s, n in words(after).items():
        assert abs(n - want[None if s == "~" else s]) <= 1
    texts = Counter(before["text"])
    assert all(any(part in t for t in texts) for part in after["text"])
    rng = random.Random(1)
    for _ in range(4):
        rows = [(i, "w " * rng.randrange(0, 60), rng.choice([None, "a", "b", "c", "d", "é"]) if i % 3 else "a") for i in range(60)]
        sizes = Counter()
        for _, text, source in rows:
            sizes[source] += text.count("w")
        found = {r["source"]: (r["t"], r["n"]) for r in mixing.mix_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect()}
        for s, want in targets(sizes).items():
            assert abs(found[s][0] - want) < 1e-6 and abs(found[s][1] - want) <= 1


def test_bins_hold_all_rows_within_their_rules(stages):
    before, after, *_ = stages[0][4]
    sizes = Counter(len(WORD.findall(t)) for t in before["text"])
    assert after["size"].sum() == sum(k * n for k, n in sizes.items())
    for _, held in after[after["size"] > 0].groupby(["pack_group", "bin"]):
        ends = sorted(zip(held["bin_offset"], held["size"], strict=True))
        assert sum(n for _, n in ends) <= packing.CAPACITY and all(a + n == b for (a, n), (b, _) in zip(ends[:-1], ends[1:], strict=True))
        assert held["source"].fillna("~").is_unique


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "b", "c")], "doc_id string, text string, source string")
    for run in (ngram_join.ngram_jaccard_join, ngram_join.one_of_each, packing.best_fit_pack, personal.find_personal, sharding.shard_by_size):
        with pytest.raises(TypeError, match="whole number"):
            run(docs)
