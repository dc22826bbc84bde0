"""Operators 11 to 13 against the library, brute force and exact round trips, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import ball_kmeans, byte_bpe, fill_middle, queries
from newsloom.llm.queries import tokenizer_path
from newsloom.llm.word_automaton import Automaton

BPE = tokenizer_path("byte_bpe_50k.json")
ODD = ["it's 3.14% of “quotes” don’t", " lead  and trail \n\n x", "a<|endoftext|>b <|endoftext|>", "日本語 🙂🙂 ünï­cödé ﬁ́", "\x1c\x85　 ​'S 'll'", "x" * 30_000, "ab" * 9_000 + " " * 5_000, "\t\r\n" * 50, "#" * 700]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(BPE)
    found.no_truncation()
    found.no_padding()
    return found


def sha(data):
    return hashlib.sha256(data).hexdigest()


# 11


def test_automaton_numbers_words_in_order():
    rng = random.Random(2)
    words = sorted({("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) + rng.choice(["ing", "ed", "s", ""])).encode() for _ in range(700)})
    ids = {w: np.array([len(w), k], dtype="<u4").tobytes() for k, w in enumerate(words)}
    made = Automaton.compiled([*ids.items(), (words[0], b""), (b"", b"1234")])
    others = [w + b"q" for w in words] + [b"", b"z", b"a" * 99, words[0] + b"\x00"]
    numbers = made.numbers(pa.array([w.decode() for w in [*words, *others]]))
    assert numbers.tolist() == [*range(len(words)), *[-1] * len(others)]
    flat, lengths = made.ids(numbers[[5, 3, 5]])
    assert flat.tobytes() == ids[words[5]] + ids[words[3]] + ids[words[5]] and lengths.tolist() == [2, 2, 2]
    # Suffixes are shared, and no two states are alike: with the same end and arcs they would be one.
    assert len(made.ends) < len({w[:k] for w in words for k in range(len(w) + 1)}) / 3
    shapes = {(made.ends[s], tuple((k & 255, t) for k, t in zip(made.arcs, made.targets) if k >> 8 == s)) for s in range(len(made.ends))}
    assert len(shapes) == len(made.ends)


def test_automaton_from_a_file(tmp_path):
    made = Automaton.compiled([(b"one", b"\1\0\0\0"), (b"none", b"\2\0\0\0\3\0\0\0")])
    (tmp_path / "a").write_bytes(made.to_bytes())
    mapped = Automaton.mapped(str(tmp_path / "a"))
    assert mapped.numbers(pa.array(["one", "none", "on", "ones"])).tolist() == [1, 0, -1, -1]
    (tmp_path / "b").write_bytes(Automaton.compiled([]).to_bytes())
    assert Automaton.mapped(str(tmp_path / "b")).numbers(pa.array(["one"])).tolist() == [-1]


def test_merges_are_the_librarys(library):
    rng = random.Random(4)
    known = byte_bpe.vocabulary(BPE)
    cases = [*ODD, *("".join(rng.choice("aehinrst lo'1!é") for _ in range(rng.randrange(1, 60))) for _ in range(400))]
    for case in cases:
        ids = np.frombuffer(known.encoded(case), dtype="<u4")
        assert ids.tolist() == library.encode(case, add_special_tokens=False).ids, case[:60]
        assert known.decoded(ids).tobytes().decode() == case == library.decode(ids.tolist(), skip_special_tokens=False)
    part = known.decoded(np.frombuffer(known.encoded("日"), dtype="<u4")[:1]).tobytes()
    assert part and part.decode("utf-8", "replace") == "�"


def test_texts_encode_as_the_library_with_any_lexicon(spark, library):
    rng = random.Random(6)
    texts = [*ODD, *(" ".join(rng.choice(["the", "house", "of", "cards", "zyzzyva", "don't", "4,5", "Über"]) for _ in range(300)) for _ in range(20))]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    lexicons = [None, Automaton.compiled([]), byte_bpe.lexicon(docs, BPE, most=5)]
    for lexicon in lexicons:
        found = byte_bpe.encode(docs, BPE, lexicon, decoded="back", batch_bytes=5_000)
        rows = {r["doc_id"]: r for r in found.collect()}
        assert [np.frombuffer(rows[k]["ids"], dtype="<u4").tolist() for k in range(len(texts))] == expected
        assert [rows[k]["n_tokens"] for k in range(len(texts))] == [len(e) for e in expected]
        back = byte_bpe.decode(found, BPE, batch_bytes=5_000)
        assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts)) and back.columns == ["doc_id", "n_tokens", "back", "text"]
        assert [rows[k]["back"] for k in range(len(texts))] == texts
    encoder = byte_bpe.Encoder(BPE, byte_bpe.lexicon(docs, BPE))
    encoder.encode(pa.array(texts[len(ODD) :]))
    once = {r["word"] for r in byte_bpe.word_counts(docs).where("n = 1").collect()}
    assert encoder.looked_up > 10 and set(encoder.known) <= once  # all words that come twice come from the automaton


def test_lexicon_counts_all_texts_and_is_bounded(spark, odd_docs):
    counts = {r["word"]: r["n"] for r in byte_bpe.word_counts(odd_docs).collect()}
    assert counts[" word"] == 29_999 and counts["word"] == 1
    docs = spark.createDataFrame([(" ".join(f"w{chr(97 + k)}" for k in range(20) for _ in range(k + 1)),)], "text string")
    for most in (0, 3, 1000):
        assert len(byte_bpe.lexicon(docs, BPE, most=most).starts) - 1 <= most


def test_encode_odd_rows(spark, odd_docs, no_docs, library):
    found = byte_bpe.encode(odd_docs, BPE)
    rows = sorted((str(r["doc_id"]), r["n_tokens"], sha(r["ids"])) for r in found.collect())
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.select("doc_id", "text").collect()]
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in texts]
    assert rows == sorted((str(i), len(x), sha(np.array(x, dtype="<u4").tobytes())) for i, x in ids)
    assert sorted((str(r["doc_id"]), r["text"]) for r in byte_bpe.decode(found, BPE).collect()) == sorted((str(i), t) for i, t in texts)
    assert byte_bpe.decode(byte_bpe.encode(no_docs, BPE), BPE).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(None,), (bytearray(b"\xff\xff\xff\xff"),)], "ids binary"), BPE).collect() == [("",), ("",)]


# 12


def lloyd(rows, clusters, rounds, dims, scale, seed):
    """Exact k-means by Python's integers, every vector against every centroid."""
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    centres = [x for _, x in sorted(kept, key=lambda r: (sha(f"{seed}:{r[0]}".encode()) if r[0] is not None else "~", r[1]))[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(nearest(x)[1], []).append(x)
        for k, xs in members.items():
            centres[k] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha(",".join(map(str, centres[k])).encode())) for i, k, d in found), key=str)


def vectors(spark, rows, more=""):
    return spark.createDataFrame([(*r, *([0] * more.count(","))) for r in rows], f"vec_id long, embedding array<double>{more}")


@pytest.mark.parametrize("spread", [0.02, 0.4, 3.0])
def test_balls_give_lloyds_clusters(spark, spread):
    """Apart, touching and on top of each other; with ties, repeated vectors and ids, and vectors that can't be clustered."""
    rng = np.random.default_rng(7)
    seats = rng.normal(size=(9, 6)) * 2
    rows = [(k, [float(c) for c in seats[k % 9] + spread * rng.normal(size=6)]) for k in range(500)]
    rows += [(k % 7, [round(float(c)) / 1.0 for c in v]) for k, v in rows[:120]] + rows[:30]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [None] * 6), (904, [float("nan")] + [0.0] * 5), (905, [float("inf")] + [0.0] * 5), (906, [0.0] * 6), (None, [0.5] * 6)]
    docs = vectors(spark, rows, ", cluster int, x int, id int, distance int").repartition(4)
    got = ball_kmeans.ball_kmeans(docs, clusters=12, rounds=4, dims=6, scale=64, seed=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == lloyd(rows, 12, 4, 6, 64, 3)


def test_few_none_and_huge_vectors(spark):
    rows = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None)]
    got = ball_kmeans.ball_kmeans(vectors(spark, rows), dims=2)
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(1, 0, 0), (2, 0, 0)]
    none = ball_kmeans.ball_kmeans(vectors(spark, rows), dims=3)
    assert none.count() == 0 and none.schema == got.schema
    top = ball_kmeans.largest_component(2) // 256 - 1
    far = ball_kmeans.ball_kmeans(vectors(spark, [(1, [float(top)] * 2), (2, [-float(top)] * 2)]), dims=2, clusters=1, rounds=1)
    assert {r["distance"] for r in far.collect()} == {2 * (256 * top) ** 2}
    with pytest.raises(Exception, match="can be clustered"):
        ball_kmeans.ball_kmeans(vectors(spark, [(1, [1e300, 0.0])]), dims=2)


def test_balls_compare_with_few_neighbours():
    rng = np.random.default_rng(1)
    seats = rng.integers(-4000, 4000, size=(40, 8))
    own = rng.integers(0, 40, size=5000)
    x = seats[own] + rng.integers(-90, 90, size=(5000, 8))
    radii = [int(np.sqrt(((x[own == k] - seats[k]) ** 2).sum(1).max())) + 1 for k in range(40)]
    for bound in (None, radii):
        balls = ball_kmeans.Balls.around(seats.tolist(), bound)
        best, least, compared = balls.nearest(x, own)
        every = ((x[:, None] - seats[None]) ** 2).sum(2)
        assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
        assert compared < 2 * len(x)  # of 40 centroids
    assert sum(map(len, balls.order)) < 40 * 39 / 4  # far balls are no neighbours at all
    best, least, _ = balls.nearest(x, np.zeros(5000, dtype=np.int64)) if bound is None else ball_kmeans.Balls.around(seats.tolist(), None).nearest(x, np.zeros(5000, dtype=np.int64))
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()


# 13


def cut_by_hand(i, text):
    text = text or ""
    units = re.findall(fill_middle.UNIT, text)
    h = [int(sha(f"42:{'' if i is None else i}".encode())[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (str(i), n, "plain", None, None, text)
    spm = h[3] % 100 < 80
    return (str(i), n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def held(docs):
    found = fill_middle.fill_in_middle(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = docs.select("doc_id", "text").collect()
    assert sorted(str((str(r[0]), *r[1:])) for r in found.collect()) == sorted(str(cut_by_hand(r["doc_id"], r["text"])) for r in rows)
    back = found.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((r["doc_id"], r["text"] or "")) for r in rows)
    return found


def test_cuts_by_hand(spark, odd_docs, no_docs):
    held(odd_docs)
    assert held(no_docs).count() == 0
    rng = random.Random(8)
    alphabet = ["a", "é", "日本", "🙂", " ", "  ", "\n", "\t \x0b", "<", "<P", "S>", "\xa0", "<M"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["a <P> b", "c<S>d", "<M>", " \n ", " ", "w", " w", "w "] * 3
    held(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_cuts_of_repeated_and_long_rows(spark):
    rows = [(1, "one two three four")] * 700 + [(1, "one two three five"), (2, "one two three four"), (None, "one two three four"), (3, "word " * 60_000), (4, "x" * 90_000), (5, "word " * 60_000)]
    rows += [(k, " ".join("abcdefg")) for k in range(10, 60)]
    found = held(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["form"] for r in found.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_units_are_not_shuffled_again(spark, odd_docs):
    """Texts that are cut meet their offsets in one exchange; plain ones stay where they are."""
    plan = fill_middle.fill_in_middle(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 3


# The queries


def test_queries_of_these_operators(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op11_byte_bpe(spark, folder).collect():
        assert r["decoded_sha256"] == sha(docs[r["doc_id"]].encode())
    for r in queries.op13_fill_middle(spark, folder).collect():
        by_hand = cut_by_hand(r["doc_id"], docs[r["doc_id"]])
        assert (str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (*by_hand[:5], sha(by_hand[5].encode())) and r["restored_sha256"] == sha(docs[r["doc_id"]].encode())
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op12_ball_kmeans(spark, folder).collect()), key=str)
    assert got == lloyd(rows, 40, 5, 64, 256, 2)
