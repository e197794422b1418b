"""The operators against brute-force versions, and on nulls, empty texts, ties, repeated rows, empty tables, extra columns."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
import xxhash
from pyspark.sql import functions as F

from radquery.llm import op1_lm_score as lm
from radquery.llm import op2_decontaminate as leak
from radquery.llm import op3_simhash as sim
from radquery.llm import op4_packing as packing
from radquery.llm import op5_quality as quality
from radquery.llm import op6_chat as chat
from radquery.llm import op7_arrow_files as files
from radquery.llm import op8_toxicity as toxicity
from radquery.llm import op9_warc as warc
from radquery.llm import op10_language as language
from radquery.llm import registry
from radquery.llm.components import components
from radquery.llm.shared import MOST_TASKS, files_for, new_dir, tasks_for
from tests.conftest import DATA, same_rows

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Odd rows: nulls, an empty text, blanks, repeated rows, equal texts, a long text; and columns with names that operators use.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no id at all"), (None, None), (6, "Lower UPPER " * 300), (7, "12 34 ?!")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.selectExpr("*", "'en' as lang", "cast(null as string) as source", "5L as n_chars", "1 as score", "2 as seed", "3 as fp", "4 as words", "5 as `_bucket`", "6 as key", "7 as item", "8 as kept")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


# ---- 1 --------------------------------------------------------------------------------------------------------------


def kneser_ney(train, texts, order):
    """(tokens, known, training tokens, base, score) of each text, from dictionaries of n-grams."""
    count = [collections.Counter() for _ in range(order + 1)]
    for t in train:
        w = ["<s>", *words(t), None]
        for i, k in itertools.product(range(1, len(w)), range(1, order + 1)):
            if k == 1 or i - k + 1 >= 0:
                count[k][tuple(w[i - k + 1 : i + 1])] += 1
    a = dict(enumerate(count))
    for k in range(order - 1, 0, -1):
        before = collections.Counter(g[1:] for g in count[k + 1])
        a[k] = {g: before[g] or c for g, c in count[k].items()}
    d, follow = {}, {}
    for k in range(1, order + 1):
        n = [0, *(sum(v == i for v in a[k].values()) for i in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d[k] = [0, *(min(max(0, i - (i + 1) * y * n[i + 1] / n[i]), i) for i in (1, 2, 3))] if min(n[1:]) else [0, 0.5, 0.75, 0.9]
        follow[k] = collections.defaultdict(lambda: [0, 0, 0, 0])
        for g, c in a[k].items():
            follow[k][g[:-1]][0] += c
            follow[k][g[:-1]][min(c, 3)] += 1
    known, total = len(count[1]), sum(count[1].values())

    def p(h, w, k):
        low = 1 / (known + 1) if k == 1 else p(h[1:], w, k - 1)
        f = follow[k].get(h)
        if not f:
            return low
        c = a[k].get((*h, w), 0)
        return max(0, c - d[k][min(c, 3)]) / f[0] + sum(d[k][i] * f[i] for i in (1, 2, 3)) / f[0] * low

    out = []
    for t in texts:
        w = ["<s>", *words(t), None]
        at = [(tuple(w[i - min(order, i + 1) + 1 : i]), w[i], min(order, i + 1)) for i in range(1, len(w))]
        base = sum(math.log10((count[1][(x,)] + 1) / (total + known + 1)) for x in w[1:])
        out.append((len(w) - 1, sum(count[1][(x,)] > 0 for x in w[1:]), total, base, sum(math.log10(p(*x)) for x in at)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, documents, order):
    rows = documents.select("doc_id", "text").toPandas()
    rows = rows[rows.text.str.len() < 2000]
    train = rows[rows.doc_id % 3 == 0]
    df = spark.createDataFrame(rows)
    got = lm.score(df, lm.train(df.where("doc_id % 3 = 0"), order)).toPandas().set_index("doc_id")
    for i, want in zip(rows.doc_id, kneser_ney(train.text, rows.text, order), strict=True):
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3]) and r.score == pytest.approx(want[4])


def test_lm_blocks_by_ranges_of_shards(spark, documents, monkeypatch):
    """With more shards than a task sends blocks to, and than an exchange has partitions: the same model."""
    rows = documents.select("doc_id", "text").where("length(text) < 2000").toPandas()
    df = spark.createDataFrame(rows)
    train = df.where("doc_id % 3 = 0")
    direct = lm.train(train, 3)
    for name, value in (("FAN_OUT", 5), ("PARTITIONS", 7), ("HELD", 3000)):
        monkeypatch.setattr(lm, name, value)
    ranged = lm.train(train, 3)
    assert lm._width(64) == 13 and ranged.begin == direct.begin
    for a, b in zip(direct.model.levels, ranged.model.levels, strict=True):
        assert a.starts.tolist() == b.starts.tolist()
        for kind in ("keys", "counts"):
            assert all(np.array_equal(a.array(s, kind), b.array(s, kind)) for s in range(64))
    got = lm.score(df, ranged).toPandas().set_index("doc_id").score
    for i, want in zip(rows.doc_id, kneser_ney(rows.text[rows.doc_id % 3 == 0], rows.text, 3), strict=True):
        assert got[i] == pytest.approx(want[4])


def test_lm_blocks_of_a_range_are_added_up_and_cut(spark, monkeypatch):
    """40 tasks send each of 4 ranges a block; what leaves has each rank once a piece, and no block of few n-grams."""
    starts, rng = np.arange(0, 4001, 10), np.random.default_rng(0)
    level, rows, want = lm.Level("", starts, 64), [], collections.Counter()
    monkeypatch.setattr(lm, "FAN_OUT", 4)
    monkeypatch.setattr(lm, "PARTITIONS", 8)  # so a range meets in two tasks
    for _ in range(40):
        ranks, counts = lm.counted(rng.integers(0, 4001, 3000).astype(np.uint64))  # 4000 stands for the begin of texts
        want.update(dict(zip(ranks.tolist(), counts.tolist(), strict=True)))
        for b in lm._blocks(level.shard_of(ranks) // lm._width(401), [ranks, counts], "suffix").to_pylist():
            rows.append((b["shard"], "suffix", b["c0"], b["c1"], None))
    blocks = spark.createDataFrame(rows, "shard int, kind string, c0 binary, c1 binary, c2 binary")
    got, pieces = collections.Counter(), 0
    for b in lm._dealt(blocks, 401, level.shard_of).collect():
        ranks, counts = lm.unpack(b["c0"]), lm.unpack(b["c1"])
        assert (level.shard_of(ranks) == b["shard"]).all() and len(set(ranks.tolist())) == len(ranks) and b["c2"] is None
        got.update(dict(zip(ranks.tolist(), counts.tolist(), strict=True)))
        pieces += 1
    direct = 40 * 401  # blocks, had each task sent one to each shard
    assert got == want and pieces < direct / 4


def test_lm_counts_of_any_size(tmp_path):
    values = np.array([0, 1, 254, 255, 256, 70_000, 1 << 40, 3])
    lm._save_counts(f"{tmp_path}/000000.total", values)
    level = lm.Level(str(tmp_path), np.array([0, len(values)]), 64)
    assert level.take(("total",), np.array([6, 0, 3, 3, 7, 5]))[0].tolist() == [1 << 40, 0, 255, 255, 3, 70_000]
    assert level.values(0, "total", np.arange(8)).tolist() == values.tolist()


def test_lm_keys_that_do_not_fit_are_an_error():
    level = lambda n: lm.Level("", np.array([0, n]), 64)
    levels = [level(1 << 24), level((1 << 40) - 1)]
    assert lm._key_bits(levels, 3) == 64
    context, word = lm._parts(levels, 3, lm._keys(levels, 3, np.array([(1 << 40) - 2, 5]), np.array([3, (1 << 24) - 1])))
    assert context.tolist() == [(1 << 40) - 2, 5] and word.tolist() == [3, (1 << 24) - 1]  # ranks beyond 32 bits
    with pytest.raises(ValueError):
        lm._key_bits([level(1 << 24), level(1 << 40)], 3)


def test_lm_query_uses_trigrams(spark, tmp_path):
    rows = [(i, "a b c" if i % 2 else "d b e") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in lm.op1_lm_score(spark, str(tmp_path)).collect()}
    want = {r["doc_id"]: r["score"] for r in lm.score(docs, lm.train(docs.where(~lm.held_out()), 3)).collect()}
    bigrams = {r["doc_id"]: r["score"] for r in lm.score(docs, lm.train(docs.where(~lm.held_out()), 2)).collect()}
    assert got == pytest.approx(want) and got != pytest.approx(bigrams)


def test_lm_probabilities_sum_to_one(spark):
    train = ["a b c a b", "b c a", "", "c c c c a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id long, text string")
    model = lm.train(df, 2)
    firsts = ["a", "b", "c", "never"]
    total = 0.0
    for w in firsts:  # P(w | begin): texts of one word, without the share of their end
        codes, offsets, hashes = lm._tokens(pa.array([w]))
        total += 10 ** lm.log_probabilities(model, codes, offsets, hashes)[0][0]
    codes, offsets, hashes = lm._tokens(pa.array([""]))
    assert total + 10 ** lm.log_probabilities(model, codes, offsets, hashes)[0][0] == pytest.approx(1)


def test_lm_scoring_looks_each_context_up_once(spark, monkeypatch):
    """However often a slice repeats it."""
    df = spark.createDataFrame([(1, "a b c a b d"), (2, "b c a e"), (3, "a b c d")], "doc_id long, text string")
    trained, asked, take = lm.train(df, 3), [], lm.Level.take
    monkeypatch.setattr(lm.Level, "take", lambda self, kinds, ranks: asked.append((kinds, ranks)) or take(self, kinds, ranks))
    texts = pa.array(["a b c a b x", "b c a b c"] * 50)
    logs, count = lm.log_probabilities(trained, *lm._tokens(texts))
    contexts = [r for kinds, r in asked if "total" in kinds]
    assert len(contexts) == 2 and all(len(np.unique(r)) == len(r) for r in contexts)
    assert len(logs) == len(count) == 50 * 13 and np.array_equal(logs[:13], logs[-13:])


def test_lm_places_in_order():
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 9, 1000), rng.integers(0, 1 << 40, 1000), rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2), np.array([7]), np.array([0, 0]), np.empty(0, np.uint64)):
        assert np.array_equal(values[lm.order_of(values)], np.sort(values))
        distinct, back = lm.distinct_of(values)
        assert np.array_equal(distinct, np.unique(values)) and np.array_equal(distinct[back], values) and distinct.dtype == values.dtype


def test_lm_packing_is_exact():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 999).astype(np.uint64))
    for values, ascending in ((x, True), (x[::-1], False), (x[:0], True), (np.array([0, 1 << 33, 7]), False), (np.zeros(5), True)):
        assert np.array_equal(lm.unpack(lm.pack(values, ascending)), values.astype(np.uint64))
    n, keys = lm.counted(np.array([5, 3, 5], dtype=np.uint64), np.array([1 << 32, 1, 1 << 32])), x
    assert n[0].tolist() == [3, 5] and n[1].tolist() == [1, 1 << 33]  # sums beyond 32 bits
    for bits in (14, 33, 47, 64):
        part = keys >> np.uint64(64 - bits)
        mixed = lm.scramble(part, bits)
        assert np.array_equal(lm.unscramble(mixed, bits), part) and int(mixed.max()).bit_length() <= bits
    assert len(set(lm.scramble(np.arange(1 << 14, dtype=np.uint64), 14).tolist())) == 1 << 14


def test_lm_odd_rows(spark, odd):
    model = lm.train(odd)
    assert lm.score(odd, model).count() == len(ODD)
    assert lm.train(odd.limit(0)) is None
    none = lm.score(odd, None).collect()
    assert len(none) == len(ODD) and all(r["score"] == r["base_score"] == 0 for r in none)
    assert lm.score(odd.limit(0), model).count() == 0


# ---- 2 --------------------------------------------------------------------------------------------------------------


def test_masks_find_any_window_with_two_substitutions():
    for mask in leak.MASKS:
        for gone in itertools.combinations(range(leak.WINDOW), 2):
            assert any(not {at + m for m in mask} & {*gone} for at in range(leak.WINDOW - leak.SPAN + 1))


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [(i, " ".join(word() for _ in range(rng.randint(13, 40)))) for i in range(30)] + [(98, items_text := "tiny text"), (99, None)]
    docs, want = [], set()
    for i, t in items[:30]:
        w = t.split()
        for n, step in enumerate((0, 7, 6, 4)):  # which words are substituted: none, every 7th, 6th, 4th
            new = [word() if step and k % step == 0 else x for k, x in enumerate(w)]
            docs.append((10 * i + n, "Some Words, before: " + " ".join(new).upper() + "! And after."))
            same = [a == b for a, b in zip(w, new, strict=True)]
            if max(sum(same[k : k + 13]) for k in range(len(w) - 12)) >= 11:
                want.add((10 * i + n, i))
    docs += [(500, " ".join(word() for _ in range(300))), (501, items_text), (502, None), (503, items[0][1]), (503, items[0][1])]
    want.add((503, 0))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words", "2 as seed")
    found = leak.find_leaks(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    kept = leak.decontaminate(df, bench).select("doc_id").collect()
    assert {r[0] for r in kept} == {d for d, _ in docs} - {d for d, _ in want}
    assert leak.decontaminate(df, bench.limit(0)).count() == len(docs)
    assert leak.find_leaks(df.limit(0), bench).count() == 0


def test_short_items_by_every_substitution_that_the_rule_allows(spark):
    items, docs = [], []
    for n in range(leak.LEAST, leak.WINDOW + 1):
        w = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(w)))
        allowed = n - math.ceil(0.8 * n)
        for k in range(allowed + 2):
            for gone in itertools.combinations(range(n), k):
                new = ["other" if i in gone else x for i, x in enumerate(w)]
                docs.append((len(docs), f"before {' '.join(new)} after", n, k <= allowed))
        docs.append((len(docs), " ".join(w[: n - 1]), n, n >= 5))  # the last word is missing at the text's end
    df = spark.createDataFrame(docs, "doc_id long, text string, n int, want boolean")
    bench = spark.createDataFrame([*items, (1000, "w4x0 w4x1"), (1001, items[-1][1])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leak.find_leaks(df, bench).collect()}
    assert {f for f in found if f[1] < 1000} == {(i, n) for i, _, n, want in docs if want}
    assert {f[0] for f in found if f[1] == 1001} == {f[0] for f in found if f[1] == leak.WINDOW}
    assert {r["doc_id"] for r in leak.decontaminate(df, bench).collect()} == {i for i, _, _, want in docs if not want}


def test_items_of_few_words_are_found_on_request(spark):
    bench = spark.createDataFrame([(1, "Omega"), (2, "two words"), (3, "just three words"), (4, "one two three four"), (5, "")], "item_id long, text string")
    df = spark.createDataFrame([(1, "alpha, omega!"), (2, "the two words"), (3, "just three words here"), (4, "one two three four"), (5, "just other words")], "doc_id long, text string")
    found = lambda **more: sorted((r["doc_id"], r["item_id"]) for r in leak.find_leaks(df, bench, **more).collect())
    assert found() == [(4, 4)] and found(least=1) == [(1, 1), (2, 2), (3, 3), (4, 4)] and found(least=3) == [(3, 3), (4, 4)]


def test_leaks_odd_rows(spark, odd):
    bench = odd.select(F.col("doc_id").alias("item_id"), "text")
    assert {r["doc_id"] for r in leak.find_leaks(odd, bench).collect()} == {6, None}
    assert leak.decontaminate(odd, bench).count() == len(ODD) - 2
    assert leak.decontaminate(odd, bench).columns == odd.columns


def test_leaks_without_broadcast(spark, documents, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = {tuple(r) for r in leak.find_leaks(documents, bench).collect()}
    monkeypatch.setattr(leak, "BROADCAST_SEEDS", 0)
    assert want and {tuple(r) for r in leak.find_leaks(documents, bench).collect()} == want


# ---- 3 --------------------------------------------------------------------------------------------------------------


def simhash(t):
    w = words(t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(values, distance):
    """The smallest index that each is linked with, over links of at most so many bits."""
    v, root = np.array(values, dtype=np.uint64), list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= distance) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(v))]


def test_fingerprints_of_odd_texts(spark, odd):
    got = sorted((r["doc_id"] or 0, r["fp"] % (1 << 64)) for r in sim.fingerprints(odd).collect())
    assert got == sorted((i or 0, simhash(t)) for i, t in ODD)


def test_golay_code_is_perfect():
    leader, _ = sim._cosets(2)
    assert len(np.unique(leader)) == 2048 and np.bitwise_count(leader).max() == 3


def clustered(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 10)]
    out = []
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("hot_rows", [50_000, 40])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_reach_what_brute_force_reaches(spark, distance, hot_rows):
    values = sorted({*clustered(1500, distance), *(1 << b for b in range(64)), 0})
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = sim.links(df, distance, hot_rows).collect()
    assert all(np.bitwise_count(np.int64(0) if a == b else np.uint64((a ^ b) % (1 << 64))) > 0 for a, b in found)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    groups = collections.defaultdict(set)
    for x in signed:
        groups[roots.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, r in zip(signed, reach(values, distance), strict=True):
        want[r].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 3000 + i) for i in range(200)]
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_documents(spark, documents, odd, monkeypatch):
    got = {r["doc_id"]: r["component_id"] for r in registry.queries()["op3_simhash"](spark, DATA).collect()}
    rows = sorted((r["doc_id"], simhash(r["text"])) for r in documents.collect())
    want = reach([f for _, f in rows], 2)
    assert got == {i: rows[k][0] for (i, _), k in zip(rows, want, strict=True)}
    monkeypatch.setattr(sim, "tasks_for", lambda _, n: 3 + n // 5000)  # more tasks than the session has partitions
    again = {r["doc_id"]: r["component_id"] for r in registry.queries()["op3_simhash"](spark, DATA).collect()}
    assert again == got
    odds = sim.near_duplicates(odd).collect()
    assert len(odds) == len(ODD) and {r["component_id"] for r in odds if r["fp"] == 0} == {1}
    assert sim.near_duplicates(odd.limit(0)).count() == 0


def test_near_copies(spark, odd):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        other = rng.choices(vocabulary, k=len(base) // 2) + base[: len(base) // 2]  # of similarity 1/3
        texts += [base, base, base[:30] + ["changed"] + base[31:], base + ["more"], other]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            want[b] = min(want[b], want[a])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for hot_rows in (50_000, 8):
        assert [r["component_id"] for r in sorted(sim.near_copies(df, hot_rows=hot_rows).collect())] == want
    odds = sim.near_copies(odd).collect()
    assert len(odds) == len(ODD) and {r["component_id"] for r in odds if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in odds if r["doc_id"] in (4, 5)} == {4}
    assert sim.near_copies(odd.limit(0)).count() == 0


def test_near_copies_of_large_groups(spark):
    """Two large groups of one similarity within, of texts that share bands between them too, and what stands alone."""
    rng, rows = random.Random(3), []
    base = [f"w{i}" for i in range(200)]
    for group in (0, 1):
        middle = base[:150] + [f"g{group}_{i}" for i in range(50)]  # three quarters are alike between both
        for i in range(1500):
            w = list(middle)
            for k in range(2):
                w[rng.randrange(200)] = f"x{group}_{i}_{k}"
            rows.append((group * 1500 + i, " ".join(w)))
    rows += [(3000 + i, " ".join(f"alone{i}_{k}" for k in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot_rows in (50_000, 200):
        got = {r["doc_id"]: r["component_id"] for r in sim.near_copies(df, hot_rows=hot_rows).collect()}
        assert got == {i: 1500 * (i // 1500) if i < 3000 else i for i, _ in rows}


def test_near_copies_that_only_their_origin_links(spark):
    """Copies that are alike to one text at 0.8, and to each other less."""
    rng, base = random.Random(8), [f"w{i}" for i in range(104)]
    rows = [(7777, " ".join(base))]
    for i in range(2000):
        w = list(base)
        for at in rng.choice([[30], [70], [50], [20, 22], [80, 83]]):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["component_id"] for r in sim.near_copies(df).collect()} == {0}


def test_near_copies_of_block_edits(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(20_000)]
    similar = lambda a, b: len(a & b) / len(a | b)
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    texts, alike = [], []
    for k in range(400):
        base = rng.sample(vocabulary, 150)
        size = rng.randint(28, 45) if k % 2 else rng.randint(10, 18)
        other = base + rng.sample(vocabulary, size) if k % 2 else base[:60] + rng.sample(vocabulary, size) + base[60 + size :]
        texts += [base, other]
        alike.append(similar(shingles(base), shingles(other)) >= 0.8)
    assert 50 < sum(alike) < 350
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in sim.near_copies(df).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(400)] == alike


# ---- 4 and 7 --------------------------------------------------------------------------------------------------------


def token_ids(t):
    from tokenizers import Tokenizer

    return np.array(Tokenizer.from_file(TOKENIZER).encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")


@pytest.mark.parametrize("capacity,bucket", [(16, None), (100, None), (4096, None), (16, 2)])
def test_packing(spark, odd, capacity, bucket, monkeypatch):
    if bucket:  # more parts than the session has partitions
        monkeypatch.setattr(packing, "BUCKET_PIECES", bucket)
    rows = packing.pack_documents(odd, TOKENIZER, capacity=capacity).collect()
    ids = [(i or 0, token_ids(t)) for i, t in ODD]
    want = collections.Counter((i, k, len(x[k * capacity : (k + 1) * capacity]), zlib.crc32(x[k * capacity : (k + 1) * capacity].tobytes())) for i, x in ids for k in range(-(-len(x) // capacity)))
    assert collections.Counter((r["doc_id"] or 0, r["piece"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(odd.limit(0), TOKENIZER).count() == 0


def best_possible(lengths, capacity):
    """The fewest bins, by trying all ways; for a handful of items."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in {*rooms}:
            if room >= lengths[i]:
                left = list(rooms)
                left.remove(room)
                place(i + 1, [*left, room - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_plans_are_near_the_best_and_keep_every_piece():
    rng = random.Random(3)
    extra = 0
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, capacity) for _ in range(9)]
        counts = collections.Counter(lengths)
        plan = packing.plan_packing(counts, capacity)
        used = collections.Counter()
        for _, m, parts in plan:
            assert sum(n * c for n, c in parts) <= capacity
            for n, c in parts:
                used[n] += m * c
        assert used == counts
        bins, best = sum(m for _, m, _ in plan), best_possible(lengths, capacity)
        assert bins <= best + 1
        extra += bins - best
    assert extra <= 15


def test_packed_sequences(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d"), (3, None)], "doc_id long, text string")
    rows = packing.packed_sequences(df, TOKENIZER, capacity=6).collect()
    assert sum(len(r["ids"]) for r in rows) == sum(len(token_ids(t)) for t in ("a b c", "d", None))


def test_packed_sequences_keep_equal_and_missing_ids(spark):
    rows = [(1, "t"), (1, "t"), (1, "other words"), (None, "u"), (None, None)] + [(5, "same")] * 40
    got = packing.packed_sequences(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, capacity=4).collect()
    want = collections.Counter((i, tuple(token_ids(t)[k : k + 4])) for i, t in rows for k in range(0, len(token_ids(t)), 4))
    parts = collections.Counter()
    for r in got:
        assert sum(r["lengths"]) == len(r["ids"]) <= 4
        for i, a, n in zip(r["doc_ids"], itertools.accumulate([0, *r["lengths"]]), r["lengths"]):
            parts[i, tuple(r["ids"][a : a + n])] += 1
    assert parts == want


def test_token_files(spark, odd):
    folder = new_dir(spark, "test")
    manifest = files.write_shards(odd, folder, TOKENIZER, length=64, shards=3).collect()
    rows = files.read_shards(spark.createDataFrame(manifest, files.MANIFEST)).collect()
    want = collections.Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ((i, token_ids(t)) for i, t in ODD))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert known == sorted(known)
    for shard in manifest:
        data = ipc.open_file(pa.memory_map(f"{shard['path']}.arrow"))
        masks = np.concatenate([np.array(data.get_batch(k).column(1).flatten()) for k in range(data.num_record_batches)])
        assert masks.sum() == shard["tokens"] and all(len(x) == 64 for k in range(data.num_record_batches) for x in data.get_batch(k).column(0))
    assert files.read_shards(files.write_shards(odd.limit(0), new_dir(spark, "test"), TOKENIZER)).count() == 0


def test_sequences_are_views_of_the_mapped_file(spark, documents):
    (row,) = files.write_shards(documents, new_dir(spark, "test"), TOKENIZER, length=32, shards=1).collect()
    shard, want = files.Shard(row["path"]), np.concatenate([token_ids(r["text"]) for r in documents.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect()])
    before = pa.total_allocated_bytes()
    for k in (0, 1, 63, 64, 500, len(want) // 32):
        ids, mask = shard.sequence(k)
        part = want[32 * k : 32 * k + 32]
        assert ids[: len(part)].tolist() == part.tolist() and sum(mask.to_pylist()) == len(part) and len(ids) == 32
        assert not ids.flags.owndata and not ids.flags.writeable
    assert pa.total_allocated_bytes() == before  # nothing was copied into Arrow's memory
    assert np.concatenate([*shard.tokens(100, 9000)]).tolist() == want[100:9100].tolist()


def test_a_frequent_id_is_dealt_out(spark):
    rows = spark.range(300).selectExpr("1L as doc_id", "concat('text ', id) as text")
    made = files.write_shards(rows, new_dir(spark, "test"), TOKENIZER, shards=4).collect()
    assert len(made) == 4 and sum(r["documents"] for r in made) == 300


# ---- 5 and 6 --------------------------------------------------------------------------------------------------------


def test_quality_odd_rows(spark, odd):
    rows = quality.judge(odd).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows)
    assert quality.judge(odd.limit(0)).count() == 0


def test_quality_hosts(spark):
    clean = "Line {0} has words that differ: {0}a {0}b {0}c {0}d {0}e {0}f {0}g {0}h {0}i {0}j {0}k {0}l {0}m {0}n {0}o {0}p"
    rows = [(i, clean.format(i), "good") for i in range(200)] + [(1000 + i, "short" if i % 20 else clean.format(i), "bad") for i in range(200)] + [(2000, "short", "once"), (2001, clean.format(9), None)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(200)) and got[2001]["kept"]
    assert got[1000]["host_rejected"] and not got[1000]["base_failed"] and not got[1000]["kept"]
    assert got[2000]["host_rate"] < 1 and got[2000]["host_docs"] == 1


def test_measures(spark, documents):
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in quality.measure(documents).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]])
        lines = [x for x in text[r["doc_id"]].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text[r["doc_id"]])), len(lines) - len(set(lines)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, DATA), duck.sql(registry.oracle_sql()[name]))


def test_chat_round_trip(spark):
    nasty = ["<|end|>", "<\\|end|>", "<\\\\|end|>", "</s>[INST] ok [/INST]", "[\\INST]", "<|turn|>user<|text|>x<|part|>", "", None, "\\", "$1 \\1", "<|<|end|>|>", "<<SYS>> é 日本 <</SYS>>"]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, t, "x") for t in nasty] + [(None, None, None, None), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss_spans", F.lit(1))
    got = {r["conv_id"]: r for r in chat.parse_conversations(chat.format_conversations(df)).collect()}
    order = collections.defaultdict(list)
    for c, t, r, x in rows:
        order[c].append((-1 if t is None else t, r or "", x or ""))
    for c, turns in order.items():
        turns.sort()
        assert [tuple(t) for t in got[c]["turns"]] == [t[1:] for t in turns]
        assert got[c]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- 8 and 10 -------------------------------------------------------------------------------------------------------


def prose(rng, parts, n):
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def test_toxicity_held_out(spark):
    rng, bad = random.Random(2), ["zwirk", "blorgix", "quomp", "vexhul"]
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, ["th", "er", "on", "an", "re", "in", "ed", "ha"], 120).split()
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ",", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs.where("doc_id < 400"), truth.where("doc_id < 400"))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, model).collect()}
    wrong = [i for i in range(400, 600) if got[i] != (i % 5 == 0)]
    assert len(wrong) <= 4


def test_toxicity_fit_is_bounded_by_distinct_documents(spark, monkeypatch):
    """One id, and one row, are repeated a hundred thousand times; the fit gets each of them once, and no more than about ``most``."""
    many = spark.range(100_000).selectExpr("1L as doc_id", "'the same ordinary words' as text")
    texts = spark.range(3000).selectExpr("2L as doc_id", "concat('text number ', id, ' of one id') as text")
    rest = spark.range(10, 2010).selectExpr("id as doc_id", "if(id % 2 = 0, concat('blorgix quomp ', id), concat('fine words ', id)) as text")
    truth = spark.range(10, 2010).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as toxic").union(spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    tables = {}
    plain = toxicity.write_table
    monkeypatch.setattr(toxicity, "write_table", lambda df, name, *a: tables.setdefault(name, plain(df, name, *a)))
    model = toxicity.learn(many.union(texts).union(rest), truth, most=500)
    sizes = {r["toxic"]: r["n"] for r in tables["labelled"].groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    assert 400 < sizes[0] < 600 and 400 < sizes[1] < 600
    assert tables["labelled"].where("text = 'the same ordinary words'").count() <= 1
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rest, model).collect()}
    assert sum((got[i] >= 0.5) == (i % 2 == 0) for i in got) > 1900


def test_toxicity_scores_are_those_of_compressing_word_by_word(spark, documents):
    rng = random.Random(3)
    truth = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.learn(documents, truth)
    pair = [toxicity.compressor(d) for d in (model.ordinary, model.toxic)]
    assert all(d[:4] == bytes.fromhex("37a430ec") for d in (model.ordinary, model.toxic))  # trained dictionaries
    rows = rng.sample(documents.collect(), 40)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows), model).collect()}
    for r in rows:
        odds = []
        for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""):
            w = re.sub(r"^[\W_]+|[\W_]+$", "", w.lower())
            data = f" {w} {w} {w} ".encode()
            a, b = (min(toxicity.MOST_LENGTH - 1, len(c.compress(data))) for c in pair)
            odds.append(float(model.odds[(min(toxicity.MOST_BYTES - 1, len(data) // 3) * toxicity.MOST_LENGTH + a) * toxicity.MOST_LENGTH + b]))
        n = len(odds)
        x = [max(odds), math.log1p(sum(max(0, o - 1.5) for o in odds)), math.log1p(100 * sum(max(0, o - 2) for o in odds) / n), math.log1p(n)] if n else [0] * 4
        z = sum(v * w for v, w in zip(x, model.weights)) + model.weights[-1]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


def test_toxicity_odd_rows(spark, odd):
    empty = toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r["score"] < 0.01 for r in toxicity.score(odd, empty).collect())
    model = toxicity.learn(odd, spark.createDataFrame([(4, 1), (4, 0), (6, 0), (7, 1), (None, 1), (5, None), (1, 1)], "doc_id long, toxic int"))
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(odd.limit(0), model).count() == 0


LANGUAGES = {"aa": ["ka", "lo", "mi", "ten"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["про", "ста", "ени", "кой"]}


def test_language_spans_and_accuracy(spark):
    rng = random.Random(4)
    train = [(i, prose(rng, LANGUAGES[k], 60), k) for i, k in enumerate([*LANGUAGES] * 30)]
    model = language.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    a, b = prose(rng, LANGUAGES["aa"], 40), prose(rng, LANGUAGES["bb"], 20)
    rows = [(0, a), (1, b), (2, prose(rng, LANGUAGES["cc"], 5)), (3, f"{a} {b}"), (4, "12 34 !!"), (5, None), (6, "")]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(7)] == ["aa", "bb", "cc", "aa", "und", "und", "und"]
    spans = [(s["first_word"], s["words"], s["lang"]) for s in got[3]["spans"]]
    assert [s[2] for s in spans] == ["aa", "bb"] and abs(spans[1][0] - 40) <= 1 and sum(s[1] for s in spans) == 60
    assert got[4]["score"] == got[5]["score"] == 0 and got[0]["score"] == 1


def test_language_learns_rare_ones_among_many_documents(spark):
    common = spark.range(60_000).selectExpr("id as doc_id", "'common words here' as text", "'aa' as lang")
    rare = spark.createDataFrame([(100_000 + i, "quaint zebra jolts", "bb") for i in range(3)], "doc_id long, text string, lang string")
    model = language.train(common.unionByName(rare))
    rows = spark.createDataFrame([(0, "common words"), (1, "zebra jolts")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(rows, model).collect()} == {0: "aa", 1: "bb"}
    sampled = [i for i in range(3) if spark.sql(f"select abs(xxhash64({100_000 + i}L) % 1000000) n").first()["n"] < 1_000_000 * 20_000 // 60_003]
    assert not sampled  # a sample of 20,000 by hashes has no document of the rare language


def test_two_hundred_languages(spark):
    names = [f"l{i:03d}" for i in range(200)]
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{chr(97 + k)}{chr(97 + i % 26)}z" for k in range(12))
    rows = spark.createDataFrame([(i, own(i), n) for i, n in enumerate(names)], "doc_id long, text string, lang string")
    model = language.train(rows)
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(rows, model).collect()} == dict(enumerate(names))


def test_word_scores_are_those_of_counting(spark):
    train = [("aa", "banana, mango kiwi"), ("aa", "mango papaya 42"), ("bb", "Haus Baum Mango")]
    model = language.train(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(train)], "doc_id long, text string, lang string"))

    def grams(w):
        data = f" {w.lower()} ".encode()
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                key = 0
                for b in data[i : i + n]:
                    key = (key * 257 + b) % 2**64
                yield (key * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language.BUCKET_BITS)

    for k, name in enumerate(model.languages):
        count = collections.Counter(g for lang, t in train if lang == name for w in t.split() if re.search(r"[^\W\d_]", w) for g in grams(w))
        total = sum(count.values()) + 0.5 * 2**language.BUCKET_BITS
        for w in ("mango", "Baum", "other"):
            want = [math.log((count[g] + 0.5) / total) for g in grams(w)]
            bucket, _ = language.word_buckets(pa.array([w]))
            assert sorted(model.weights[bucket, k].tolist()) == pytest.approx(sorted(want), abs=1e-4)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(20):
        emissions, codes = rng.normal(size=(6, 3)).astype(np.float32) * 3, rng.integers(0, 6, 12)
        offsets = np.array([0, 5, 5, 6, 12])
        path = language.viterbi(emissions, codes, offsets, 2.0)
        for a, b in itertools.pairwise(offsets):
            worth = lambda p: sum(emissions[c, x] for c, x in zip(codes[a:b], p, strict=True)) - 2.0 * sum(x != y for x, y in itertools.pairwise(p))  # noqa: B023, E731
            best = max(map(worth, itertools.product(range(3), repeat=int(b - a))))
            assert worth(path[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def test_language_odd_rows(spark, odd):
    model = language.train(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(ODD) and {r["lang_pred"] for r in rows} == {"en", "und"}
    nothing = language.train(odd.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


# ---- 9 --------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 4000
    rows = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (3, "http://a/3", "same"), (1, "u\r\nv", None), (2, "u", ""), (7, "u", big), (8, "u", big + "x"), (None, "u", "alone"), (None, "u", "same"), (11, "u", "x\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))
    chunks = warc.chunk_records(pages, chunk_bytes=1000)
    assert chunks.where("page_id = 7").count() == len(big.encode()) // 1000 and chunks.where("length(data) > 1000").count() == 0
    from radquery.llm.shared import write_table

    chunks = write_table(chunks, "chunks")
    made = warc.write_archives(chunks, warc.find_revisits(chunks), new_dir(spark, "archives"), 3).collect()
    assert sum(r["records"] for r in made) == len(rows)
    read = warc.read_archives(spark.createDataFrame(made), chunk_bytes=700)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read.where("last").collect())
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = collections.Counter()
    for p, _, h in rows:
        data, original = (h or "").encode(), first.get(h or "")
        again = p is not None and p != original
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", original if again else None] += 1
    assert got == want
    assert b"".join(r["data"] for r in read.where("page_id = 7").orderBy("chunk").collect()).decode() == big
    least = warc.find_revisits(chunks, least=10).where("refers_to is not null").collect()
    assert {(r["page_id"], r["refers_to"]) for r in least} == set()


def test_warc_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.chunk_records(pages).count() == 0
    chunks = warc.chunk_records(pages)
    archives = warc.write_table(warc.write_archives(chunks, warc.find_revisits(chunks), new_dir(spark, "archives")), "archives")
    assert archives.count() <= 1 and warc.read_archives(archives).count() == 0
    nothing = archives.where("false")
    assert warc.read_archives(nothing).count() == 0


# ---- all ------------------------------------------------------------------------------------------------------------


def test_every_query_keeps_every_row(spark, documents):
    total = documents.count()
    for name in ("op1_lm_score", "op5_quality", "op8_toxicity", "op10_language", "op7_arrow_files"):
        assert registry.queries()[name](spark, DATA).count() == total


def test_language_of_a_long_text_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    parts = {"aa": ["th", "er", "on", "an"], "bb": ["zu", "ix", "qo", "wk"], "cc": ["ma", "li", "no", "ta"]}
    model = language.train(spark.createDataFrame([(prose(rng, p, 200), k) for k, p in parts.items() for _ in range(4)], "text string, lang string"))
    text = " ".join(prose(rng, parts[k], rng.randrange(5, 60)) for k in rng.choices([*parts], k=60))
    codes, offsets, distinct = language.split_words(pa.array([text]))
    script = language.word_scripts(distinct.to_pylist())
    whole = language.viterbi(language._emissions(model, distinct, script, 4.0), codes, offsets, 6.0)
    for block in (1, 7, 100, len(codes)):
        assert np.array_equal(language.long_path(model, codes, distinct, script, 4.0, 6.0, block), whole)
    rows = spark.createDataFrame([(1, text), (2, "thon")], "doc_id long, text string")
    want = sorted(map(tuple, language.identify(rows, model).collect()))
    monkeypatch.setattr(language, "LONG", 50)
    monkeypatch.setattr(language, "SLICE_BYTES", 1)
    assert sorted(map(tuple, language.identify(rows, model).collect())) == want


def test_many_languages(spark, monkeypatch):
    """More than a task counts at once, and more than are allowed."""
    rng = random.Random(7)
    names = [f"l{k:03d}" for k in range(150)]
    parts = {k: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(4)] for k in names}
    train = spark.createDataFrame([(prose(rng, parts[k], 60), k) for _ in range(2) for k in names], "text string, lang string").repartition(2)
    model = language.train(train)
    assert model.languages == names and model.weights.shape == (1 << language.BUCKET_BITS, 150)
    assert np.allclose(np.exp(model.weights.astype(float)).sum(0), 1, atol=1e-3)
    monkeypatch.setattr(language, "HELD_LANGUAGES", 7)
    assert np.array_equal(language.train(train).weights, model.weights)
    test = spark.createDataFrame([(i, prose(rng, parts[k], 40)) for i, k in enumerate(names)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(test, model, with_spans=False).collect()}
    assert sum(got[i] == k for i, k in enumerate(names)) > 140
    monkeypatch.setattr(language, "MOST_LANGUAGES", 149)
    with pytest.raises(ValueError, match="149 languages"):
        language.train(train)


def test_files_follow_bytes():
    sizes = [0, 1, 1 << 24, 1 << 30, 100 << 30, 1 << 40, 100 << 40]
    numbers = [files_for(n) for n in sizes]
    assert numbers == sorted(numbers) and numbers[:4] == [1, 1, 1, 64] and numbers[5] <= 4097 and numbers[6] == 100 << 10
    assert all(n / k <= 1 << 30 for n, k in zip(sizes, numbers, strict=True))


def test_tasks_follow_the_rows(spark):
    assert [tasks_for(spark, n, 10) for n in (0, 40, 41, 1000)] == [4, 4, 5, 100] and tasks_for(spark, 10**15) == MOST_TASKS
