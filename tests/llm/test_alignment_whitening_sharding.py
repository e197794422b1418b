"""Operators 11 to 13 against brute-force versions, and on odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from radquery.llm import op11_alignment as alignment
from radquery.llm import op12_whitening as whitening
from radquery.llm import op13_sharding as sharding
from radquery.llm.shared import new_dir, write_table
from tests.conftest import DATA

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXTRA = ["'en' as lang", "cast(null as string) as source", "1 as row", "2 as pair", "3 as n_a", "map('a', 1) as links", "5 as shard", "6 as slot", "7 as `rank`", "8 as place", "9 as fraction", "10 as `a.b`"]
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no id"), (None, None),
    (6, "a  b\t\tc\r\n d\x0b\x0ce 　 f  g  h"), (7, "literal ▁ mark, and ▁"), (8, "<|endoftext|> <s></s><0x41><unk>"), (9, "naïve café Ünï 日本語 текст 🙂👍🏽"),
    (10, "x" * 3000), (11, "\x00nul \x7f\x1f it's they'll 123 4,567"), (12, "\n"), (13, " "), (14, "trailing  "), (15, "”quoted” ’s\u0085 \n x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", *EXTRA)


# ---- 11 -------------------------------------------------------------------------------------------------------------


class Whole:
    """Both tokenizers over whole texts."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.letters = alignment.byte_of_letter()

    def tokens(self, text):
        """[(id, bytes)] of both sides; nothing where they don't give the text."""
        if not text:
            return [], []
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(f" {text}", add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        sound = all(b"".join(x for _, x in side) == f" {text}".encode() for side in (a, b))
        return (a, b) if sound else ([], [])


def brute_force(texts):
    whole, out, links = Whole(), [], []
    for text in texts:
        a, b = whole.tokens(text)
        ends = [np.cumsum([len(x) for _, x in side], dtype=int).tolist() for side in (a, b)]
        cuts = sorted({*ends[0]} & {*ends[1]})
        groups, own, last = [], [], 0
        for cut in cuts:
            inside = [[(i, e - len(x), e) for (i, x), e in zip(side, at, strict=True) if last < e <= cut] for side, at in zip((a, b), ends, strict=True)]
            groups.append("|".join(",".join(str(i) for i, _, _ in side) for side in inside))
            own += [(i, j) for i, s, e in inside[0] for j, t, f in inside[1] if max(s, t) < min(e, f)]
            last = cut
        links.append(own)
        out.append([len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = collections.Counter(x for own in links for x in own)
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(*r, sum(count[i, j] == best[j] for i, j in own), sum(count[x] for x in own)) for r, own in zip(out, links, strict=True)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_alignment_of_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas()
    got = alignment.op11_alignment(spark, DATA).toPandas().set_index("doc_id").loc[rows.doc_id, COLUMNS]
    assert [tuple(r) for r in got.itertuples(index=False)] == brute_force(rows.text)


def test_alignment_of_odd_rows(spark, odd):
    got = sorted((r["doc_id"] or 0, *(r[c] for c in COLUMNS)) for r in alignment.link_counts(odd, A, B).collect())
    assert got == sorted((i or 0, *r) for (i, _), r in zip(ODD, brute_force([t for _, t in ODD]), strict=True))
    assert alignment.link_counts(odd.where("false"), A, B).collect() == []


def test_alignment_of_random_texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r", "\r\n", " ", "　", " ", "\x0b", "ab", "The", "'s", "1", "23", "!", "...", "é", "日", "▁", "🙂", "\x1c", "_", "();\r", "    "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(1500)]
    columns = alignment.align_slice(alignment.Pair(A, B), pa.array(texts), True)
    got = list(zip(*(columns[c].to_pylist() for c in COLUMNS[:5]), strict=True))
    assert got == [r[:5] for r in brute_force(texts)]
    for groups, digest in zip(columns["groups"].to_pylist(), columns["groups_sha256"].to_pylist(), strict=True):
        assert digest == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_alignment_of_a_long_text():
    text = "many words of all kinds, 12 of them \n" * 30_000
    columns = alignment.align_slice(alignment.Pair(A, B), pa.array([text]), False)
    one, two = (alignment.align_slice(alignment.Pair(A, B), pa.array(["many words of all kinds, 12 of them \n" * k]), False)["n_links"][0].as_py() for k in (1, 2))
    assert columns["n_links"][0].as_py() == one + (two - one) * 29_999


def test_transducer():
    t = alignment.Transducer(([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"abcd", b"x"]))

    def align(a, b):
        found = t.align(a, b)
        return found and ([divmod(x, 1 << 32) for x in found[0]], found[1])

    assert align([0, 1], [0, 1]) == ([(0, 0), (0, 1), (1, 1)], [(2, 2)])
    assert align([2, 3], [2]) == ([(2, 2), (3, 2)], [(2, 1)])
    before = t.transitions
    assert align([0, 1, 2], [0, 1, 0, 1]) == ([(0, 0), (0, 1), (1, 1), (2, 0), (2, 1)], [(2, 2), (3, 4)])
    assert t.transitions == before + 2  # what was seen is taken from the memo
    assert align([0], [3]) is None and align([0], [0]) is None and align([], [0]) is None and align([1], []) is None
    assert align([], []) == ([], [])


def test_vocabularies_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        alignment.Pair(public_tokenizers.path("word_bpe_49k.json"), B)


# ---- 12 -------------------------------------------------------------------------------------------------------------


def expected(vectors, k=4):
    """n, {x: deviation}, variances, components, trace."""
    x = np.array([np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64) for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    e, u = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(fit.shape[1], -1))
    return n, sums, x, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


def matches(rows, vectors, k=4):
    n, sums, x, e, u, trace = expected(vectors, k)
    by = collections.defaultdict(dict)
    for r in rows:
        by[r["vec_id"]][r["component"]] = r
    sign = np.zeros(len(e))
    for i, v in enumerate(x):
        want = (v - sums / n) @ u / np.sqrt(e)
        assert sorted(by[i]) == list(range(1, len(e) + 1))
        for c, r in by[i].items():
            s = sign[c - 1] = sign[c - 1] or (np.sign(r["whitened"] * want[c - 1]) if abs(want[c - 1]) > 1e-3 else 0)
            assert r["whitened"] * (s or 1) == pytest.approx(want[c - 1], rel=1e-9, abs=1e-3 if not s else 1e-9)
            assert r["n"] == n and int(r["deviation"]) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, sums, strict=True))
            assert r["explained"] == pytest.approx(e[c - 1] / trace, rel=1e-9) and r["identity_error"] < 1e-8


def test_whitening_of_embeddings(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    assert rows.vec_id.tolist() == list(range(len(rows)))
    matches(whitening.op12_whitening(spark, DATA).collect(), rows.embedding)


def test_whitening_drops_what_has_no_numbers_and_fits_distinct_vectors(spark):
    good = [[1.0, 2.0, 0.5], [0.0, 1.0, 3.5], [2.0, -1.0, 0.25], [5.0, 4.0, -3.0], [1.001, 2.0, 0.5], [1.0, 2.0, 0.5]]
    bad = [None, [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 1.0], [0.0, -float("inf"), 1.0], [], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate([*good, *bad])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as n", "map('a', 1) as component", "3 as place")
    matches(whitening.whiten(df).collect(), good, 3)
    repeated = whitening.whiten(df.union(df)).collect()
    assert len(repeated) == 2 * 3 * len(good) and {r["n"] for r in repeated} == {4}
    nameless = spark.createDataFrame([(None, v) for v in good], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(nameless).collect()) == 3 * len(good)


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df).collect() == [] and whitening.whiten(df.where("false")).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}


@pytest.mark.parametrize("block,most", [(4, 12), (4, 256), (16, 16)])
def test_subspace_iteration_restarts(spark, block, most):
    rng = np.random.default_rng(5)
    x = np.rint(rng.standard_normal((400, 40)) * np.geomspace(900, 30, 40)).astype(np.int64)
    fit = write_table(spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>"), "x")
    got = whitening.learn(fit, 40, 4, block, most)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    assert got.variances == pytest.approx(e[::-1][:4], rel=1e-12)
    assert np.abs(np.abs(got.vectors.T @ u[:, ::-1][:, :4]) - np.eye(4)).max() < 1e-9 and got.identity_error < 1e-9
    assert got.passes > 3


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [float(1 << 24) * (i % 7), float(1 << 22) * (i * i % 13)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    matches(whitening.whiten(df, 2).collect(), [v for _, v in rows], 2)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()


# ---- 13 -------------------------------------------------------------------------------------------------------------


def even(rows, shards, sources):
    """Counts at most one apart, slots without gaps, and in each shard each source in its share."""
    sizes = collections.Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(shards)) and (max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1)
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    total = collections.Counter(sources[r["doc_id"]] for r in rows)
    for source, n in total.items():
        for s in range(shards):
            here = sum(r["shard"] == s and sources[r["doc_id"]] == source for r in rows)
            assert abs(here - n / shards) <= 2


def test_sharding_of_documents(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = sharding.op13_sharding(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
    even(rows, 8, {i: d["source"] for i, d in docs.items()})
    assert sorted(rows) == sorted(sharding.op13_sharding(spark, DATA).collect())


def test_sharding_is_the_interleaving_by_fractions(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else None if i % 11 == 0 else f"s{i % 5}") for i in range(500)]
    df = write_table(spark.createDataFrame(rows, "doc_id long, text string, source string"), "docs")
    df = write_table(df.withColumn("p", sharding.seeded(df)), "docs")
    place = {r["doc_id"]: r["p"] for r in df.collect()}
    by = collections.defaultdict(list)
    for i, _, source in rows:
        by[source].append(i)
    order = []
    for source, ids in by.items():
        ids.sort(key=place.get)
        order += [((k + 0.5) / len(ids), source is not None, source or "", place[i], i) for k, i in enumerate(ids)]
    order = [i for *_, i in sorted(order)]
    got = sharding.interleave(df, df["source"], df["p"], 7).collect()
    where = {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    assert [where[i][0] for i in order] == [k * 7 // 500 for k in range(500)]
    assert sorted(order, key=where.get) == order
    even(got, 7, {i: s for i, _, s in rows})


def test_sharding_of_odd_rows(spark, odd):
    folder = f"{new_dir(spark, 'shards')}/out"
    stored = sharding.write_shards(odd, folder, 3, files=2)
    rows = stored.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((i or 0, t or "") for i, t in ODD)
    assert {*odd.columns} <= {*stored.columns} and rows[0]["links"] == {"a": 1} and rows[0]["a.b"] == 10
    even(rows, 3, collections.defaultdict(lambda: None))
    few = sharding.interleave(odd.limit(2), odd["source"], sharding.seeded(odd)).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (4, 0)]
    assert sharding.interleave(odd.where("false"), odd["source"], sharding.seeded(odd)).collect() == []


def test_sharding_keeps_repeated_rows(spark):
    df = spark.range(1000).selectExpr("cast(7 as long) as doc_id", "'the same' as text", "'s' as source")
    got = sharding.interleave(df, df["source"], sharding.seeded(df), 3).collect()
    assert sorted(collections.Counter(r["shard"] for r in got).values()) == [333, 333, 334]
