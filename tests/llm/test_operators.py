"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import embedding_dedup, fingerprint, license_scan, packing, pii, sentence_pieces, simhash, token_counts, toxicity, url_filter
from newsloom.llm.components import connected_components
from newsloom.llm.queries import URL_RULES, tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(9) or "") for _ in range(n))


def groups(pairs, everything):
    parent = {x: x for x in everything}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    return {x: root(x) for x in everything}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (None, 3)]
    found = {r["u"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    expected = groups([p for p in pairs if None not in p], {x for p in pairs for x in p if x is not None})
    assert {x: found.get(x, x) for x in expected} == expected


# 1


def vectors(spark, rows, kinds="vec_id long, embedding array<float>, label int, id int, v int, n int"):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], kinds)


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(600):
        x = base[rng.integers(60)] + rng.normal(size=16) * rng.choice([0.0, 0.2, 0.3, 2.0])
        rows.append((i, [float(np.float32(y)) for y in x], int(rng.integers(2))))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(vectors(spark, rows), cell_rows=20, target=0.999).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    assert sum(got[i]["n_links"] for i in got) >= 0.97 * linked.sum()
    assert all(got[i]["n_links"] <= linked[i].sum() for i in got)
    expected = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(linked))], range(600))
    assert np.mean([got[i]["component_id"] == expected[i] for i in got]) > 0.97
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got.values())


def test_embedding_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, None], 1), (10, [], 1), (11, [1.0], 1), (12, [float("inf"), 0.0], 1), (2, [1.0, 0.0], 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicate_vectors(vectors(spark, rows)).collect())
    assert got[:4] == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False)]
    assert all(n == 0 and c == i and k for i, n, c, k in got[4:])
    assert embedding_dedup.near_duplicate_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_traversal_visits_what_is_in_reach():
    rng = np.random.default_rng(2)
    index = embedding_dedup.MultiIndex(rng.normal(size=(7, 4)), rng.normal(size=(7, 4)), 5.0)
    first, second = index.distances(rng.normal(size=(20, 8)))
    for a, b in zip(first, second):
        cells = index.visits(a, b)
        sums = (a[:, None] + b[None, :]).ravel()
        assert sorted(cells) == np.flatnonzero(sums <= 5.0).tolist()
        assert (np.diff(sums[cells]) >= -1e-12).all()


# 2, 5 and 8


def test_sentencepiece_equals_library(spark, odd_docs, no_docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentence_pieces.encode(odd_docs, path).collect()
    texts = odd_docs.select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["round_trip"]) for r in rows) == Counter((i, tuple(library.encode(t)), True) for i, t in texts)
    back = sentence_pieces.decode(spark.createDataFrame(rows), path).collect()
    assert Counter(map(tuple, back)) == Counter(map(tuple, texts))
    assert sentence_pieces.encode(no_docs, path).count() == 0


def test_streaming_commits_early():
    path = tokenizer_path("piece_bpe_32k.model")
    model, _ = sentence_pieces.model_for(path)
    import sentencepiece

    text = "streaming windows stay short whatever comes " * 50
    stream, ids, widest = sentence_pieces.StreamingViterbi(model), [], 0
    prepared = "▁" + text.replace(" ", "▁")
    for i in range(0, len(prepared), 11):
        ids += stream.push(prepared[i : i + 11])
        widest = max(widest, len(stream.text))
    assert ids + stream.finish() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
    assert widest < 4 * model.longest


def test_long_chunks_equal_library():
    """Chunks without a space in them, with ties among their merges and characters that the vocabulary lacks."""
    import sentencepiece

    path, rng = tokenizer_path("piece_bpe_32k.model"), random.Random(5)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "aA", "abcdeé日🙂", "0123456789", "=-", "abcdefghijklmnopqrstuvwxyz") for n in (63, 64, 65, 300, 5000)] + ["a" * 10_000, "ab" * 4000]
    got, counts = sentence_pieces.encoded(pa.array(texts), path)
    ends = np.cumsum(counts)
    assert [got[a:b].tolist() for a, b in zip(ends - counts, ends)] == library.encode(texts)
    model = sentence_pieces.model_for(path)[0]
    for t in texts[:12]:
        if len(t) < 400:
            quick, sentence_pieces.QUEUED = sentence_pieces.QUEUED, 10**9
            slow = model.merged(t)
            sentence_pieces.QUEUED = quick
            assert model._merged_by_queue(t) == slow


@pytest.mark.parametrize("seed", range(3))
def test_token_chunks_equal_library(seed):
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "B", "1", " ", "  ", ".", "'s", "'", "\n", "\t", "é", "e\u0301", "…", "_", "²", "\u00a0", "<|endoftext|>", "the ", "!!", "İ", "ΑΣ", "<|ENDOFTEXT|>", "<|"]) for _ in range(rng.randrange(14))) for _ in range(1500)]
    byte, word = (Tokenizer.from_file(tokenizer_path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    assert token_counts.counts(pa.array(texts), tokenizer_path("byte_bpe_50k.json")).tolist() == [len(byte.encode(t, add_special_tokens=False).ids) for t in texts]
    flat, counts = packing.encoded(pa.array(texts), tokenizer_path("word_bpe_49k.json"))
    assert np.split(flat, np.cumsum(counts))[0].tolist() == word.encode(texts[0], add_special_tokens=False).ids
    assert flat.tolist() == [i for t in texts for i in word.encode(t, add_special_tokens=False).ids]


def test_special_strings_are_told_by_their_case():
    import pyarrow as pa
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = ["a <|ENDOFTEXT|> b", "HELLO <|endoftext|> World", "<|StartOfText|>x", "A<|startoftext|>B É Σ", "HELLO Wörld ÄÖ"]
    flat, counts = packing.encoded(pa.array(texts), tokenizer_path("word_bpe_49k.json"))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [word.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts_odd_rows(odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    expected = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in odd_docs.select("doc_id", "text").collect())
    assert Counter(map(tuple, token_counts.count_tokens(odd_docs, path).collect())) == expected
    assert token_counts.count_tokens(no_docs, path).count() == 0


def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(odd_docs, path).collect()
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.MAX_TOKENS
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    expected = Counter()
    for i, text in odd_docs.select("doc_id", "text").collect():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), packing.MAX_TOKENS):
            x = np.array(ids[s : s + packing.MAX_TOKENS], dtype="<u4")
            expected[i, s, len(x), zlib.crc32(x.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected
    assert packing.pack(no_docs, path).count() == 0


def test_ranks_of_hot_lengths(spark, monkeypatch):
    """Ranks within a length are gapless and each once, also where a length is dealt over many groups."""
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    rows = [(i % 50 or None, i % 3, 5 if i % 2 else i % 9, i) for i in range(900)]
    ranked = packing.ranked_within_length(spark.createDataFrame(rows, "id long, start long, length long, ids_crc32 long"), 500).collect()
    by_length: dict = {}
    for r in ranked:
        by_length.setdefault(r["length"], []).append(r["rank"])
    assert len(ranked) == 900 and all(sorted(x) == list(range(len(x))) for x in by_length.values())


def test_pack_histogram_is_whole_and_tight():
    rng = random.Random(5)
    histogram = Counter(min(4096, int(rng.expovariate(1 / 500)) + 1) for _ in range(20_000))
    patterns = packing.pack_histogram(histogram, 4096)
    used: Counter = Counter()
    for count, content in patterns:
        assert sum(n * k for n, k in content) <= 4096
        for n, k in content:
            used[n] += count * k
    assert used == histogram
    total = sum(n * c for n, c in histogram.items())
    assert total / (4096 * sum(c for c, _ in patterns)) > 0.99


# 3


def planted_person(rng, n):
    """Entities of a document by kind, as written, and how the document writes them a second time."""
    given, surname, greek = rng.choice(["Karl", "Zoe", "Tim", "Ida"]) + "abcdefghij"[n % 10], f"Quill{'abcdefghij'[n % 10]}{'klmnopqrst'[n // 10 % 10]}", f"Πέτρ{'αβγδεζηθικ'[n % 10]}ς"
    digits = "".join(str(rng.randrange(10)) for _ in range(40))
    card = "4" + digits[:14]
    card += str(pii._luhn(card))
    return {
        "name": [f"{given} {surname}", surname], "email": [f"{surname}.{n}@Corp{n % 7}.org", f"{surname.upper()}.{n}@CORP{n % 7}.ORG"], "card": [" ".join(card[i : i + 4] for i in range(0, 16, 4)), card],
        "phone": [f"+1 ({digits[:3]}) 555-{digits[3:7]}", f"+1 {digits[:3]}.555.{digits[3:7]}"], "ssn": [f"{digits[7:10]}-{digits[10:12]}-{digits[12:16]}"] * 2, "ip": [f"8.{n % 250}.{rng.randrange(256)}.{rng.randrange(255)}"] * 2,
        "v6": [f"2a00:1450:{n + 1:x}::{n + 7:x}"] * 2, "secret": [hashlib.sha1(str(n).encode()).hexdigest(), hashlib.sha1(str(n).encode()).hexdigest().upper()], "greek": [greek, greek],
    }


def test_pii_query_equals_brute_force(spark, tmp_path):
    """Outside of entities texts stay as they are; each entity has one surrogate in all texts, of its own form, and no two have the same."""
    import re

    from newsloom.llm.queries import op3_pii_surrogates

    rng, docs, expected = random.Random(8), [], []
    for n in range(120):
        x = planted_person(rng, n)
        order = [("Mr ", "name", 0), ("; ", "email", 0), (" card ", "card", 0), (", ", "phone", 0), (" or ", "ssn", 0), (" at ", "ip", 0), (" and ", "v6", 0), (" key=", "secret", 0), (". Κύριος ", "greek", 0), (". Later, ", "name", 1), (" wrote: Dr. ", "name", 1), ("'s ", "email", 1), (" / ", "card", 1), (" & ", "phone", 1), ("; ", "secret", 1), (" ΚΎΡΙΟΣ ", "greek", 1)]
        docs.append((n, "".join(a + x[k][i] for a, k, i in order) + " the end", 1, "k"))
        expected.append((order, x))
    docs += [(500, docs[3][1], 1, "k"), (None, docs[4][1], 1, "k"), (None, "version 2.0 of 2024 at 12:30:45, no data", 1, "k"), (501, None, 1, "k")]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long, kinds string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op3_pii_surrogates(spark, str(tmp_path)).collect()
    got, seen, back = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}, {}, {}
    assert len(rows) == len(docs) and got[501]["text"] is None and {r["text"] for r in rows if r["doc_id"] is None} == {got[4]["text"], docs[-2][1]}
    assert got[500]["text"] == got[3]["text"] and got[3]["kinds"] == "card email ip name phone secret ssn"
    every = " ".join(r["text"] or "" for r in rows).lower()
    for n, (order, x) in enumerate(expected):
        parts = re.fullmatch("".join(re.escape(a) + "(.+?)" for a, _, _ in order) + " the end", got[n]["text"])
        assert parts, got[n]["text"]
        for (_, kind, i), new in zip(order, parts.groups()):
            old = x[kind][i]
            assert re.sub(r"[0-9a-fA-F]" if kind == "secret" else r"\w" if kind != "name" else r"\w+", "x", old) == re.sub(r"[0-9a-fA-F]" if kind == "secret" else r"\w" if kind != "name" else r"\w+", "x", new) or kind in ("ip", "v6", "greek"), (old, new)
            form = (str.lower if kind in ("email", "secret", "greek") else str) if kind not in ("card", "phone") else lambda s: re.sub(r"\D", "", s)
            for a, b in zip(*((s.split(" ") if kind == "name" else [s]) for s in (old, new))):
                assert seen.setdefault((kind, form(a)), form(b)) == form(b) and back.setdefault((kind, form(b)), form(a)) == form(a)
                assert kind == "name" and a[:3] in ("Kar", "Zoe", "Tim", "Ida") or a.lower() not in every, a
            if kind == "card":
                digits = form(new)
                assert digits[0] == "4" and pii._luhn(digits[:-1]) == int(digits[-1])
    assert not {b for _, b in back} & {a for _, a in seen}


def test_pii_of_persons():
    text = "In `Mr. John Smith met Frau Überall. Later Smith left, and Dr. Smith and MR SMITH stayed. John Smith's. Herr Dr. von Braun-Müller; my name is Ana Lee; Prof. Maria de la Cruz, Госпожа Петрова, Иван Петров, Frau überall, J. Smith"
    new, kinds = pii.replace_text(text, "k", {}, {})
    for old in ("John", "Smith", "SMITH", "Überall", "Braun", "Müller", "Ana", "Lee", "Maria", "Cruz", "Петров", "Иван"):
        assert old not in new
    assert "Frau überall" in new and " de la " in new and "Herr Dr. von " in new and len(kinds) == 18
    a = new.split()
    surname = a[3].rstrip(".,")
    assert [w.strip(".,") for w in a].count(surname) == 4 and f"MR {surname.upper()} stayed" in new and f"{a[2]} {surname}'s" in new and f"J. {surname}" in new
    assert new.split("Госпожа ")[1].split(",")[0] == new.split("Госпожа ")[1].split(" ")[2].rstrip(",") + "а"
    assert pii.script_of(new.split("Госпожа ")[1].split(",")[0]) == "cyrillic"
    assert [pii.replace_text(t, "k", {}, {})[0] for t in ("well-known words. Nothing here", "", "Smith alone")] == ["well-known words. Nothing here", "", "Smith alone"]
    assert pii.surrogate("name:given", "john", "k", 0, "m").capitalize() in pii.GIVEN["latin", "m"] and pii.surrogate("name:given", "mary", "k", 1, "f").capitalize() in pii.GIVEN["latin", "f"]


def test_pii_of_addresses():
    import ipaddress

    local = "a" * 200
    new, kinds = pii.replace_text(f"{local}@example.org and {'b.c' * 70}@mail.corp.co.uk", "k", {}, {})
    assert kinds == ["email", "email"] and "aaaa" not in new and "b.cb.c" not in new and new.count("@") == 2 and new.endswith(".uk")
    for old in ("8.8.8.8", "10.1.2.3", "169.254.3.4", "192.168.1.7", "172.20.1.1", "203.0.113.9", "224.0.0.5"):
        for attempt in (0, 3):
            address = ipaddress.IPv4Address(pii.surrogate("ip", old, "k", attempt))
            own = [n for n in pii.NETWORKS if ipaddress.IPv4Address(old) in n]
            assert own == [n for n in pii.NETWORKS if address in n]
    assert pii.replace_text("0.0.0.0 127.0.0.1 255.255.255.255 ::1 12:30:45 std::vector 999.1.1.1", "k", {}, {})[1] == []
    new = pii.replace_text("fe80::1ff:fe23:4567:890a 2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "k", {}, {})[0].split()
    assert new[0].startswith("fe80::") and new[1].startswith("2001:0DB8:") and len(new[1]) == 39 and "85A3" not in new[1]


def test_pii_of_cards():
    text = "4111 1111 1111 1111, 4111-1111-1111-1112, 6844976499621582, 5555555555554444, 378282246310005, 2223003122003222, 9111111111111111"
    new, kinds = pii.replace_text(text, "k", {}, {})
    parts = new.split(", ")
    assert kinds == ["card"] * 4 and [parts[i] for i in (1, 2, 6)] == [text.split(", ")[i] for i in (1, 2, 6)]
    for old, x in zip(text.split(", "), parts):
        digits = x.replace(" ", "").replace("-", "")
        assert len(x) == len(old) and (x == old or pii.is_card(digits) and digits[0] == old[0])


def test_pii_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    assert pii.pseudonymise(odd_docs).columns == odd_docs.columns
    clash = pii.pseudonymise(odd_docs, kinds_col="kinds")
    assert sorted(clash.columns) == sorted(odd_docs.columns)
    odd = clash.collect()
    assert len(odd) == odd_docs.count() and sum(r["text"] is None for r in odd) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in odd if r["text"] is not None)
    assert [r["kinds"] for r in odd if r["doc_id"] == 9] == [["email", "phone", "card", "ip"]] * 2
    assert pii.pseudonymise(no_docs).count() == 0
    # The same without a broadcast of what drew again.
    docs = spark.createDataFrame([(i % 3 or None, f"Herr Karl{c} Roth{d} at 192.0.2.{i}") for i, (c, d) in enumerate((c, d) for c in "abcdefghij" for d in "klmnopqrst")], "doc_id long, text string")
    at_once = sorted(r["text"] for r in pii.pseudonymise(docs).collect())
    monkeypatch.setattr(pii, "BROADCAST_ENTITIES", 0)
    assert sorted(r["text"] for r in pii.pseudonymise(docs).collect()) == at_once
    assert len({t.split(" at ")[1] for t in at_once}) == 100 and len({t.split()[2] for t in at_once}) == 10


def test_surrogates_are_distinct(spark, monkeypatch):
    rows = [("name:given", f"peter{a}{b}") for a in "abcdefgh" for b in "klmnopqrst"] + [("ssn", f"{n:09d}") for n in range(300)] + [("email", f"{a}{b}@m.example.com") for a in "abcdefghij" for b in "0123456789"] + [("ip", f"192.0.2.{i}") for i in range(256)]
    found = spark.createDataFrame([(1, k, c, "m" if c[5:6] < "e" else "n") for k, c in rows], "text_hash long, kind string, canon string, gender string")
    special = {(r["kind"], r["canon"]): (r["attempt"], r["gender"]) for r in pii.exceptions(found).collect()}
    new = [(k, pii.surrogate(k, c, pii.DEFAULT_KEY, *special.get((k, c), (0, "n")))) for k, c in rows]
    assert len(set(new)) == len(rows) and not set(new) & set(rows)
    assert {a for a, _ in special.values()} >= {0, 1, 8}  # some had to draw again, and addresses of a full range from a wider one
    monkeypatch.setattr(pii, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="no distinct surrogates"):
        pii.exceptions(found)


def test_permutation_is_one_to_one():
    seen = {tuple(pii.permuted([a, b, c], [10, 10, 7], "k", "t")) for a in range(10) for b in range(10) for c in range(7)}
    assert len(seen) == 700


# 4


def test_restoration(spark):
    texts = ["such a stupid idiot in this house", "the loser was pathetic and worthless", "they are clowns and morons", "this is disgusting trash"] * 50
    model = toxicity.language_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    cases = {"such a stuuuupid m0r0n": "such a stupid moron", "i d i o t they": "idiot they", "$tupid l.o.s.e.r": "stupid loser", "p@thetic w0rthle$$ 1d10t": "pathetic worthless idiot"}
    assert {c: toxicity.restore(c, model, {}) for c in cases} == cases
    for clean in ("the house 12 a b", "the&&& in*** 5927243074273351!! OF", "the.72@mail3.example.com", "http://a.b/c0d"):
        assert toxicity.restore(clean, model, {}) == clean


def test_toxicity_held_out(spark, odd_docs, no_docs):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = prose(rng, 40).split()
        if toxic:
            for w in rng.sample(["idiot", "moron", "scum", "1d10t", "m o r o n"], 3):
                words.insert(rng.randrange(40), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = toxicity.train(docs, labelled)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, scorer).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 0) for i in held]) > 0.97
    odd = toxicity.score(odd_docs, scorer).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.score(odd_docs, scorer, keep="score_").columns == [*odd_docs.columns, "score_"]
    assert toxicity.score(no_docs, toxicity.train(no_docs, labelled.limit(0))).count() == 0


# 6 and 7


MIT = """Copyright (c) 2024 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = BSD + "\n3. Neither the name of Foo & Sons, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
FULL = [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD_3, "BSD-3-Clause"), (GPL, "GPL-3.0-or-later"), (LGPL, "LGPL-2.1-or-later"), (APACHE, "Apache-2.0"), (ZLIB, "Zlib"), (MPL, "MPL-2.0")]


def layouts(text):
    """The text as it stands in files: on one line, in paragraphs, wrapped, in comments, below a heading."""
    import textwrap

    paragraphs = text.split("\n")
    wrapped = {w: "\n".join(line for p in paragraphs for line in (textwrap.wrap(p, w) or [""])) for w in (15, 40, 65, 78)}
    yield " ".join(text.split())
    yield text
    yield from wrapped.values()
    for mark in (" * ", "// ", "# ", "-- ", "> "):
        yield "/*\n" + "\n".join(mark + x for x in wrapped[65].split("\n")) + "\n */\nint main();"
    yield "A heading without an end\n" + wrapped[78] + "\r\nand more"
    yield wrapped[78].replace("\n", "\r\n")


def test_licenses_in_all_layouts(spark):
    cases = [(layout, licence) for text, licence in FULL for layout in layouts(text)]
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.recognise(docs).collect()}
    assert [(i, got[i], x) for i, (x, licence) in enumerate(cases) if got[i] != licence] == []


def test_licenses(spark, odd_docs, no_docs):
    texts = ["x\nLicensed under CC BY-NC 4.0.\ny. Released under the MIT license", "As is", "LICENSED### under&&& the Apache License, Version 2.0.", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "not licensed under the MIT License at all", MIT + "\n\n" + APACHE, " ".join(APACHE.split()[:10])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_licenses"]) for r in license_scan.recognise(docs).collect()}
    assert got == {0: ("MIT CC-BY-NC-4.0", 2), 1: ("", 0), 2: ("Apache-2.0", 1), 3: ("GPL-2.0-or-later", 1), 4: ("", 0), 5: ("Apache-2.0 MIT", 2), 6: ("Apache-2.0", 1)}
    order = license_scan.recognise(docs.where("doc_id = 5")).first()["sentence_ids"].split()
    assert order == ["mit-grant", "mit-condition", "mit-as-is", "apache-grant", "apache-grant-2", "apache-copy", "apache-as-is", "apache-see"]
    odd = {r["doc_id"]: r["licenses"] for r in license_scan.recognise(odd_docs).collect()}
    assert odd[-5] == "MIT" and odd[3] == ""
    assert license_scan.recognise(no_docs).count() == 0


def test_licenses_in_texts_of_many_lines(spark):
    """A hundred thousand lines that begin like a known sentence, and one in the end that is one, take seconds: the work is linear."""
    began = time.perf_counter()
    many = spark.createDataFrame([(1, "Permission is hereby granted\n" * 100_000 + "Released under the MIT license\n"), (2, "the\n" * 200_000), (3, "\n" * 500_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in license_scan.recognise(many).collect()} == {1: "MIT", 2: "", 3: ""}
    assert time.perf_counter() - began < 60


def test_urls(spark):
    cases = {
        "https://A.Example.org/es/x?q=1#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://x.org": ("x.org", "", None, None), "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"), "no scheme": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None),
        "http://x.net?y=/de/": ("x.net", "", None, None),
    }
    urls = list(cases) * 3
    pages = spark.createDataFrame([(i, u, "h", 1, "r") for i, u in enumerate(urls)], "page_id long, url string, html string, id int, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = cases[u]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block") and verdict in (None, got[i]["verdict"])
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_entropy(spark):
    assert abs(spark.range(1).select(url_filter.entropy(F.lit("aabb"))).first()[0] - 1.0) < 1e-9


# 9


def test_fingerprints(spark, odd_docs, no_docs):
    hashed = odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    rows = [(i, t) for i, _, t in sorted(((-(2**63) if i is None else i, h, t) for i, t, h in hashed), key=lambda x: (-x[0], x[1]))]
    expected = Counter()
    for k, (i, t) in enumerate(rows):
        following, third = rows[(k + 1) % len(rows)][1], len(t) // 3
        expected[i, len(t), hashlib.sha256((t[: len(t) - third] + following[:third]).encode()).hexdigest()] += 1
    got = fingerprint.fingerprints(odd_docs).collect()
    assert Counter((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == expected
    assert fingerprint.fingerprints(no_docs).count() == 0
    pairs = spark.createDataFrame([(1, "Ｆull  width\n"), (2, "full WIDTH"), (3, "cafe\u0301"), (4, "café"), (5, "other")], "doc_id long, text string")
    fp = {r["doc_id"]: r for r in fingerprint.fingerprints(pairs).collect()}
    assert fp[1]["fingerprint"] == fp[2]["fingerprint"] != fp[5]["fingerprint"] and fp[3]["fingerprint"] == fp[4]["fingerprint"]
    assert fp[2]["near_next"] == 1.0 and fp[3]["near_next"] == 0.0
    one = fingerprint.fingerprints(pairs.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0


def test_fingerprint_blocks(spark):
    rng = random.Random(1)
    ids = {rng.randrange(10**9) for _ in range(300)} | {10**15 + i for i in range(200)} | {(s << 40) + i for s in range(200) for i in range(10)}
    rows = [(i, f"text {i}") for i in ids] + [(None, f"none {k}") for k in range(900)] + [(7, "alike")] * 30
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    keyed = docs.select(F.bitwise_not(F.coalesce("id", F.lit(-(2**63)))).alias("k"), F.xxhash64("text").alias("h"))
    hashes = {(r["id"], r["text"]): r["h"] for r in docs.withColumn("h", F.xxhash64("text")).distinct().collect()}
    ordered = sorted(rows, key=lambda r: (-(-(2**63) if r[0] is None else r[0]), hashes[r]))
    saved = fingerprint.BLOCK_ROWS
    try:
        for fingerprint.BLOCK_ROWS in (10, 500, 10**6):
            got = Counter((r["id"], r["text"], r["next_text"]) for r in fingerprint.with_next_text(docs).collect())
            assert got == Counter((*r, ordered[(k + 1) % len(ordered)][1]) for k, r in enumerate(ordered))
        fingerprint.BLOCK_ROWS = 100
        bounds, first, _ = fingerprint.blocks_by_rank(keyed, len(rows))
        dealt = keyed.crossJoin(first).withColumn("coarse", fingerprint._place(F.col("all_coarse"))).join(bounds, "coarse").withColumn("block", fingerprint._place(F.col("bounds")))
        sizes = [r["count"] for r in dealt.groupBy("coarse", "block").count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) < 2 * len(rows) / len(sizes)
    finally:
        fingerprint.BLOCK_ROWS = saved


def test_fingerprint_folds_case_in_full(spark):
    pairs = [("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος"), ("ﬃ x", "FFI\u00a0X"), ("İ", "i\u0307"), ("\u0345α", "ια")]
    found = spark.createDataFrame(pairs, "a string, b string").select(fingerprint.canonical(F.col("a")).alias("a"), fingerprint.canonical(F.col("b")).alias("b"), fingerprint.canonical(fingerprint.canonical(F.col("a"))).alias("c")).collect()
    assert [r["a"] == r["b"] and r["a"] == r["c"] for r in found[:4]] == [True] * 4
    assert all(r["a"] == r["c"] for r in found)


def test_fingerprints_of_forced_collisions(spark, monkeypatch):
    """Lanes that only see the first character: texts of one bucket are told apart by their bytes, equal ones stay equal."""
    monkeypatch.setattr(fingerprint, "hash_lanes", lambda c: (F.ascii(F.substring(c, 1, 1)).cast("long"),) * 2)
    rows = [(i, t) for i, t in enumerate(["abc one two", "ABC  one two", "abd", "abd ", "xyz", "a", "", None] * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for fingerprint.BROADCAST_BUCKETS in (1_000_000, 0, 1_000_000):
        got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
        same = {i: " ".join((t or "").lower().split()) for i, t in rows}
        assert all((got[i] == got[j]) == (same[i] == same[j]) for i in got for j in got)


# 10


def test_near_links_are_all_within_two_bits(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    found = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in found)
    got = {(r["u"], r["v"]) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    expected = {(max(a, b), min(a, b)) for k, a in enumerate(signed) for b in signed[:k] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert got == expected


def test_near_links_do_not_broadcast_the_index(spark):
    found = simhash.near_links(spark.range(200).select(F.xxhash64("id").alias("fp")))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_simhash_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r["doc_id"]: (r["fp"], r["component"]) for r in got}
    assert by_id[1] == by_id[2] and by_id[1][1] == 1
    assert by_id[3] == by_id[4] == by_id[5] == (0, 3)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [-5, 0, 1, 3, 6, 7, 8, 9, 10]
    assert simhash.keep_first(no_docs).count() == 0


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for g in range(30):
        words = prose(rng, rng.choice([30, 120, 400])).split()
        for c in range(6):
            own = list(words)
            for _ in range(rng.randrange(1 + len(own) * c // 200)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((g * 10 + c, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash.near_copies(docs).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = groups(near, sets)
    assert np.mean([got[i] == expected[i] for i in sets]) > 0.95


def test_near_copies_count_all_shingles_of_long_texts(spark):
    rng = random.Random(10)
    rows = []
    for g in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(604)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[: 486 if g % 2 else 482]))]  # 482 or 478 of 600 shingles
    got = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [g for g in range(60) if (got[2 * g] == got[2 * g + 1]) != bool(g % 2)] == []


def copies_by_edit(rng, n, edit):
    """Pairs of 300 words that keep 0.8 to 0.9 of their five-word shingles."""
    rows = []
    for g in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        added = [f"x{rng.randrange(10**6)}" for _ in range(60)]
        at = rng.randrange(40, 200)
        other = {"appended": words + added, "truncated": words[:250], "replaced": words[:at] + added[:20] + words[at + 20 :]}[edit]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    return rows


def test_near_copies_of_each_kind_of_edit(spark):
    rng = random.Random(9)
    for edit in ("appended", "truncated", "replaced"):
        rows = copies_by_edit(rng, 150, edit)
        got = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [i for i, _ in rows if got[i] != i // 2 * 2] == [], edit


def test_near_copies_of_one_seed_in_a_large_group(spark):
    rng = random.Random(11)
    seed = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(seed))]
    for i in range(1, 2500):
        own = list(seed)
        for at in (rng.randrange(4, 60), rng.randrange(64, 116)):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    got = [r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert len(got) == 2500 and set(got) == {0}


def test_near_copies_that_simhash_finds_alone(spark, monkeypatch):
    """With one MinHash key of many hashes, which texts that differ never share, fingerprints bring the near copies together."""
    rng = random.Random(12)
    rows = [(i, prose(rng, 1500)) for i in range(30)]
    rows += [(100 + i, t + " appended") for i, t in rows[:25]]
    monkeypatch.setattr(simhash, "keys_for", lambda similarity: 1)
    monkeypatch.setattr(simhash, "KEY_HASHES", 20_000)
    prints = {i: simhash.majority(simhash.shingle_hashes(t)) & (1 << 64) - 1 for i, t in rows}
    linked = [i for i in range(25) if (prints[i] ^ prints[100 + i]).bit_count() <= simhash.MAX_BITS]
    got = {r["doc_id"]: r["component"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(linked) > 15 and all(got[100 + i] == i for i in linked) and all(got[i] == i for i in range(30))


def test_near_copies_without_broadcasts_and_small_buckets(spark, monkeypatch):
    """The ways for large inputs give what those for small ones give."""
    rng = random.Random(12)
    rows = [(i, t) for i, (_, t) in enumerate(r for edit in ("appended", "replaced") for r in copies_by_edit(rng, 10, edit))]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    usual = sorted(map(tuple, simhash.near_copies(docs).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(simhash, "PAIRED", 1)
    assert sorted(map(tuple, simhash.near_copies(docs).collect())) == usual


def test_restoration_of_whole_runs(spark):
    texts = ["such a stupid idiot in this house", "you are all stupid and a loser", "the shit of an ass", "they are clowns and morons", "the others are the worst idiots of the house"] * 50
    model = toxicity.language_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    cases = {"y o u  a r e  a l l  i n  t h i s  h o u s e  s u c h  i d i o t s": "idiots", "i  d  i  o  t": "idiot", "an i d 1 o t": "idiot", "sh!+": "shit", "a$$": "ass", "idio7": "idiot", "st-upid": "stupid"}
    restored = {c: toxicity.restore(c, model, {}) for c in cases}
    assert {c: r for c, r in restored.items() if cases[c] not in r.split()} == {}
    long = " ".join("the house of the others and such a stupid idiot".replace(" ", ""))
    assert toxicity.restore(long, model, {}).replace(" ", "") == long.replace(" ", "")
    word = "id.iot" * 20 + "moron"
    assert toxicity.restore(word, model, {}).endswith("moron")


def test_scoring_splits_words_as_training_does():
    scorer = toxicity.Scorer(toxicity.LanguageModel(np.ones((64, 64, 64))), {"=idiot": 3.0, "=scum": 3.0, "=ass": 3.0})
    texts = ["isn't ¡idiot!", "isn't „Idiot“", "it’s \"idiot\"", "it's (idiot)", "don't scum/other", "don't\u00a0scum", "it's ass, no", "isn't fine"]
    assert (scorer.evidence(texts, {}, {})[:, 1] > 0).tolist() == [True] * 7 + [False]


def test_rows_of_one_id_stay_or_go_by_their_texts(spark):
    rows = [(1, "a text that two rows have"), (5, "A text  that two rows have"), (5, "another text of its own"), (None, "a text that two rows have"), (None, "only here"), (None, "only here"), (7, "x y"), (7, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.lit("clash"))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "only here"), (1, "a text that two rows have"), (5, "another text of its own"), (7, "x y")]


def test_simhash_query_equals_brute_force(spark, tmp_path):
    from xxhash import xxh64

    from newsloom.llm.queries import op10_simhash_dedup

    rng = random.Random(12)
    texts = [prose(rng, rng.choice([1, 2, 3, 40, 90])) for _ in range(120)]
    texts += [t.replace(" ", "  ").upper() for t in texts[:20]] + [" ".join([*t.split()[:-1], "end"]) for t in texts[20:90]] + [None, "", "  x"]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def fingerprint_of(text):
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    prints = {i: fingerprint_of(t) for i, t in docs}
    component = groups([(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2], prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op10_simhash_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (f"{f:016x}", component[i]) for i, f in prints.items()}
    assert len(set(component.values())) < len(docs) - 20


def test_components_with_a_hub(spark):
    from newsloom.llm import components

    pairs = [(0, i) for i in range(1, 900)] + [(899, 5000), (6000, 6001)]
    found = {r["u"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert components.HUB_LINKS < 899
    assert found == {i: 0 for i in [*range(1, 900), 5000]} | {6001: 6000}


def test_embedding_rows_of_one_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (3, [0.01, 1.0], 1), (4, [-0.5], 1), (5, [2.0], 1), (6, [-9.0], 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicate_vectors(vectors(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 0, 5, True), (6, 1, 4, False)]


def test_embedding_recall_at_production_parameters(spark):
    """Pairs planted at the threshold itself among vectors like those of the tables, of two lengths and more than a block in one cell."""
    rng = np.random.default_rng(5)
    rows = []
    for dims, n in ((64, 2500), (32, 600)):
        for _ in range(n):
            x = rng.normal(size=dims)
            x /= np.linalg.norm(x)
            rows.append((len(rows), x, 0))
            if rng.random() < 0.3:
                y = rng.normal(size=dims)
                y -= (y @ x) * x
                c = rng.uniform(0.9301, 0.97)
                rows.append((len(rows), c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y), 0))
    hub = rng.normal(size=64)
    rows += [(len(rows) + k, hub + 0.001 * rng.normal(size=64), 1) for k in range(embedding_dedup.BLOCK + 200)]
    kept = [(i, [float(z) for z in x], label) for i, x, label in rows]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(vectors(spark, kept, "vec_id long, embedding array<double>, label int, id int, v int, n int")).collect()}
    found = expected = 0
    for label, dims in ((0, 64), (0, 32), (1, 64)):
        own = [(i, np.array(x)) for i, x, y in kept if y == label and len(x) == dims]
        x = np.stack([v / np.linalg.norm(v) for _, v in own])
        linked = (x @ x.T >= 0.93).sum(1) - 1
        assert all(got[i] <= k for (i, _), k in zip(own, linked))
        if label == 0:
            found, expected = found + sum(got[i] for i, _ in own), expected + int(linked.sum())
        else:
            assert [got[i] for i, _ in own] == linked.tolist()
    assert expected > 1500 and found >= 0.97 * expected


def test_url_trees_on_held_out_urls(spark):
    """URLs whose label follows from lexical features with some noise: trees fitted on one half judge the other; no leak from own labels."""
    rng = random.Random(21)

    def url(bad):
        host = "".join(rng.choice("abcdefgh0123456789" if bad else "abcdefghijklmnop") for _ in range(rng.randrange(14, 24) if bad else rng.randrange(5, 12)))
        params = "&".join(f"{rng.choice('abcdef')}={rng.randrange(10**6)}" for _ in range(rng.randrange(2, 6) if bad else rng.randrange(2)))
        return f"http://{host}.{rng.choice(['com', 'net', 'info', 'top'] if bad else ['com', 'net', 'org'])}/{'x/' * rng.randrange(4)}{rng.randrange(10**4)}?{params}"

    rows = [(url(bad), float(bad if rng.random() > 0.02 else not bad), k % 2, float(bad)) for k in range(4000) for bad in [k % 3 == 0]]
    host, path = url_filter.parse_url(F.col("url"))
    known = spark.createDataFrame(rows, "url string, label double, half int, truth double").withColumns({"host": host, "path": path})
    trees = url_filter.fit(known.where("half = 0").select("url", "host", "path", "label"))
    right = trees.score(url_filter.with_keys(known.where("half = 1"))).select((F.col("score") >= 0.5) == (F.col("truth") == 1)).collect()
    assert np.mean([r[0] for r in right]) > 0.95

def test_url_shares_leave_out_their_own_labels(spark):
    """Labels by chance over suffixes, domains and segments that come a few times each cannot be told from the training rows' shares."""
    rng = random.Random(22)
    rows = [(f"http://h{k}.d{(d := rng.randrange(1200))}.s{d % 700}/p{rng.randrange(1000)}/{k}", float(rng.random() < 0.5)) for k in range(4000)]
    host, path = url_filter.parse_url(F.col("url"))
    noise = spark.createDataFrame(rows, "url string, label double").withColumns({"host": host, "path": path})
    blind = url_filter.fit(noise.select("url", "host", "path", "label"))
    keyed = url_filter.with_keys(noise).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(url_filter.FOLDS)), F.lit(url_filter.FOLDS)))
    for key in url_filter.KEYS:
        share = f"{key}_share"
        folded = blind.features(keyed, fold=True).select(F.corr(share, "label"), F.stddev(share)).first()
        whole = blind.features(keyed).select(F.corr(share, "label")).first()[0]
        assert folded[1] > 0.01 and abs(folded[0]) < 0.1 < 0.3 < whole  # with its own label in it a share would tell it
    held_out = [(f"http://h{k}.d{(d := rng.randrange(1200))}.s{d % 700}/p{rng.randrange(1000)}/{k}", float(rng.random() < 0.5)) for k in range(5000, 7000)]
    others = spark.createDataFrame(held_out, "url string, label double").withColumns({"host": host, "path": path})
    right = blind.score(url_filter.with_keys(others)).select(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    assert 0.45 < right < 0.55


def test_urls_that_are_hot_and_long(spark):
    rows = [(i, f"http://h{i % 7}.example.org/{'es' if i % 2 else 'fr'}/{i}") for i in range(300)] + [(1000 + i, "http://hot.org/x") for i in range(3000)] + [(9999, "http://x.net/" + "a1/" * 40_000)] + [(9998, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, URL_RULES, training_urls=100).collect()}
    assert len(got) == len(rows) and got[1000]["verdict"] == "allow" and got[9999]["rule"] is None and 0 <= got[9999]["score"] <= 1


def test_embedding_large_label_among_small_ones(spark):
    """The large label is cut by its own size, however many small ones there are; links in both are found."""
    rng = np.random.default_rng(11)
    centres, rows = rng.normal(size=(40, 16)), []
    for i in range(3000):
        rows.append((i, centres[i % 40] + 0.15 * rng.normal(size=16), 0))
    for label in range(1, 401):
        x = rng.normal(size=16)
        rows += [(len(rows), x, label), (len(rows) + 1, x + 0.02 * rng.normal(size=16), label)]
    frame = vectors(spark, [(i, [float(z) for z in x], label) for i, x, label in rows], "vec_id long, embedding array<double>, label int, id int, v int, n int")
    classes = frame.select("label", F.col("embedding").alias("v"))
    sizes = embedding_dedup.tiers(classes, 20)
    tiered = classes.withColumn("dims", F.size("v")).join(sizes, ["label", "dims"])
    indexes = embedding_dedup.fitted(tiered, sizes, 20, embedding_dedup.THRESHOLD, embedding_dedup.TARGET_RECALL)
    assert sorted(indexes) == [(16, 0), (16, 3)] and len(indexes[(16, 3)].first) == 12 and len(indexes[(16, 0)].first) == 2
    large = np.stack([x / np.linalg.norm(x) for _, x, label in rows if label == 0])
    index = indexes[(16, 3)]
    in_cell = np.bincount(index.cells(large), minlength=144)
    first, second = index.distances(large)
    compared = sum(int(in_cell[index.visits(a, b)].sum()) for a, b in zip(first, second))
    assert compared < 0.6 * len(large) ** 2
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(frame, cell_rows=20).collect()}
    linked = (large @ large.T >= 0.93).sum(1) - 1
    assert linked.sum() > 0 and sum(got[i] for i in range(3000)) >= 0.99 * linked.sum() and all(got[i] <= k for i, k in enumerate(linked))
    assert all(got[i] == 1 for i in range(3000, 3800))
