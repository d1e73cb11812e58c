"""Operators on documents against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from wavefront.llm import bpe, catalog, decontaminate, hmm, langid, licenses, linededup, sharding, simhash

ODD = "doc_id long, text string, lang string, source string, n_chars long, fp long, id string, g string, w int, n int, component_id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, clashing names."""
    long = " ".join(f"word{i % 977} und" for i in range(30000)) + "\n" + "x" * 50000
    rows = [
        (1, "Hello the world of words and the rest", "en"), (1, "Hello the world of words and the rest", "en"), (2, "Hello the world of words and the rest", None), (None, "Hello the world of words and the rest", "en"),
        (3, "", "en"), (4, None, "en"), (5, None, None), (None, None, None), (6, "   \n\n\t ", "en"), (7, "12 34 %", "en"), (8, long, "en"), (9, "a\nb\nc\nd", "en"), (10, "x\na\nb\nc\ny", "de"), (11, "a\nb", "en"), (12, "a\nb", "en"),
        (1, "another text with id one", "de"), (13, "Released under the MIT License.\x00 é　\U0001f642", "de"),
    ]
    return spark.createDataFrame([(i, t, lang, None, None, 1, "i", None, 2, 3, "c") for i, t, lang in rows], ODD)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def rows_of(df):
    return sorted(map(repr, df.collect()))


# near duplicates


def union_find(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(spark, docs):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) & (1 << 64) - 1 for r in docs.collect()}
    linked = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = union_find(fps, linked)
    assert {i: (f"{fps[i]:016x}", want[i]) for i in fps} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}


def test_fingerprint_by_definition():
    import xxhash

    words = [f"w{i}" for i in range(40)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(38)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 38)
    assert simhash.fingerprint("  ".join(words).upper()) & (1 << 64) - 1 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0
    assert simhash.fingerprint("A b") & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b", 42)


def test_chains_of_flips(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base[:20]:
        for _ in range(4):
            b ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(b)
    values |= {base[30] ^ 7, base[31] ^ 1 << 63}
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    word = (1 << 64) - 1
    want = union_find(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & word).bit_count() <= 2])
    assert union_find(signed, [tuple(r) for r in links.collect()]) == want


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {3}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("Hello the world of words and the rest") == 1 and len([t for t in texts if not (t or "").split()]) == 1


# lines


def test_lines_odd_rows(odd):
    out = linededup.deduplicate(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"]
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert (9, "a\nb\nc\nd") in got and (10, "x\ny") in got  # a, b, c come second there
    assert (11, "a\nb") in got and (12, "") in got
    assert (4, None) in got and (3, "") in got and (6, "   \n\n\t ") in got
    hello = [r for r in out.collect() if r["source"] is None and r["doc_id"] in (1, 2, None) and r["n_lines"] == 1]
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in hello) == [(0, 1), (1, 0), (1, 0), (1, 0), (2, 1)]


def test_lines_cover_and_merge(spark):
    body = "\n".join("pqrstu")
    df = spark.createDataFrame([(1, body), (2, f"k\n{body}\nl"), (3, "p\n\nq\nr\nz"), (4, "p\nq\nz")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.deduplicate(df).collect()}
    assert got == {1: (body, 0), 2: ("k\nl", 6), 3: ("z", 4), 4: ("p\nq\nz", 0)}


def test_passages_inside_lines(spark):
    """A passage of more than 50 words within longer lines, not at the same place of a line, goes from the later text."""
    passage = " ".join(f"{x.capitalize()} " + " ".join(f"{x}{i}" for i in range(8)) + "." for x in ("one", "two", "three", "four", "five", "six", "seven"))
    texts = [f"Begin here. {passage} And so on.", f"Other words\nstand before. {passage} Another end. Really.", "Begin here. And so on.", None, "", "No end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.deduplicate(df).collect()} == dict(enumerate(texts))
    got = {r["doc_id"]: r["text"] for r in linededup.deduplicate(df, units="sentences").collect()}
    assert got == dict(enumerate(texts)) | {1: "Other words\nstand before. Another end. Really."}


# shards


def test_sharding_against_python(docs):
    tree = sharding.even_tree(16)
    more = sharding.grown(tree)
    got = sharding.assign(docs.select("doc_id"), tree, new_tree=more).collect()
    assert all(r["shard"] == sharding.shard_of(str(r["doc_id"]), tree) and r["grown_shard"] == sharding.shard_of(str(r["doc_id"]), more) for r in got)


def test_movement_is_confined():
    keys = [str(i) for i in range(3000)]
    tree = sharding.even_tree(16)
    before = {k: sharding.shard_of(k, tree) for k in keys}
    counts = np.bincount(list(before.values()), minlength=16)
    assert counts.min() > 130 and counts.max() < 250
    grown = sharding.grown(tree)
    moved = {k for k in keys if sharding.shard_of(k, grown) != before[k]}
    assert moved and {sharding.shard_of(k, grown) for k in moved} == {16}
    lighter = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    lighter["region0"]["rack1"][5] = 0.25
    for k in keys:
        to = sharding.shard_of(k, lighter)
        if before[k] != to:  # out of the lighter rack or region, or within them
            assert before[k] < 8 and (before[k] >= 4 or to >= 8)


def test_slots_have_no_gaps(spark, data):
    got = catalog.op6_sharding(spark, data).collect()
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["shard"] for r in got} == set(range(16))
    text = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]])) for r in got)


def test_sharding_odd_rows(odd):
    placed = sharding.with_slots(sharding.assign(odd, sharding.even_tree(4)), ["doc_id"])
    assert sorted(r["slot"] for r in placed.where("shard = 0").collect()) == list(range(placed.where("shard = 0").count()))
    assert placed.count() == odd.count()


# benchmark leaks


def brute_hits(docs, items):
    def words(t):
        return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for item, text in items:
        w = words(text)
        n = min(8, len(w))
        if item is not None and w:
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_decontamination_against_brute_force(spark, docs):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 3, 5, 7, 8, 9, 20])))) for i in range(12)] + [(3, "A-B c"), (None, "d e"), (40, None), (41, "..")]
    texts = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, "a b c")]
    texts += [(62, "Ä ü " * 3 + items[6][1]), (63, items[3][1].upper())]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.hits(d, b).collect()]
    assert sorted(got, key=repr) == brute_hits(texts, items)
    assert decontaminate.hits(d, b.limit(0)).where("n_hit > 0").isEmpty() and decontaminate.hits(d.limit(0), b).isEmpty()


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "hello the world of words and the rest of it"), (2, "another text")], "item_id long, text string")
    assert decontaminate.hits(odd, items).count() == odd.count()
    kept = decontaminate.drop_contaminated(odd, items, 1)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5


# tokens


@pytest.fixture(scope="module")
def coder():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Codec(open(path, "rb").read(), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ids, special_tokens={})


def test_tokens_of_documents(spark, data, docs, coder):
    got = {r["doc_id"]: r for r in catalog.op8_byte_bpe(spark, data).collect()}
    for r in docs.collect():
        ids = coder[1].encode_ordinary(r["text"])
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_tokens_of_random_texts(coder):
    own, library = coder
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("aAé ñ\n\t\x1c\x1f\xa0 1２ß中文🙂!'s'tl'll ") for _ in range(rng.randrange(50)))
        assert own.encode(text) == library.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()


def test_prefixes_under_edits(coder):
    own, _ = coder
    rng = random.Random(2)
    for _ in range(100):
        data = "".join(rng.choice("abcdeést") for _ in range(rng.randrange(200))).encode()
        now = bpe.Prefixes(own, data[:30])
        now.append(data[30:])
        assert [now.encoding(i) for i in (0, len(data))] == [[], own.walk(data, now.last)]
        i = rng.randrange(len(data) + 1)
        j, new = rng.randrange(i, len(data) + 1), bytes(rng.choice(b"abst") for _ in range(rng.randrange(9)))
        now.replace(i, j, new)
        assert now.data == data[:i] + new + data[j:] and now.last == bpe.Prefixes(own, now.data).last


def test_tokens_odd_rows(odd, coder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(odd, path, public_tokenizers.PATTERN)
    back = bpe.decode(coded, path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in back) == sorted(r["text"] or "" for r in odd.collect())
    assert set(odd.columns) - {"text"} < set(coded.columns)


# languages


def test_language_on_held_out_rows(spark, data, docs):
    got = catalog.op5_language_id(spark, data).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 20
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)


def test_pair_tables_say_the_same():
    net = langid.train(["the and of it", "der die das und", "that this", "nicht ein"] * 8, ["en", "de", "en", "de"] * 8, filters=4, epochs=2)
    data = np.frombuffer(b"the und".ljust(langid.WINDOW + langid.OVERLAP, b"\0"), np.uint8)
    first = []
    for w, table in zip(langid.WIDTHS, net.tables):
        first.append(np.max([sum(table[j][data[p + j]] for j in range(w)) for p in range(7)], axis=0))
    x = np.maximum(np.concatenate(first) + net.bias, 0) @ net.weights + net.offset
    want = np.exp(x - x.max())
    assert np.allclose(net.probabilities(data, net.paired())[0], want / want.sum(), atol=1e-4)


def test_language_odd_rows(odd):
    net = langid.fit(odd)
    got = {r["doc_id"]: r for r in langid.predict(odd, net).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 6, 7)] == ["und"] * 5
    assert {got[i]["lang_pred"] for i in (8, 9, 13)} <= {"en", "de"}
    assert langid.fit(odd.limit(0)) is None and langid.predict(odd, None).where("lang_pred <> 'und'").isEmpty()
    assert langid.predict(odd.limit(0), net).isEmpty()


# language model


def test_unigram_and_likelihood(spark, data, docs):
    got = {r["doc_id"]: r for r in catalog.op4_hmm(spark, data).collect()}
    tokens = {r["doc_id"]: [*(r["text"].encode().lower().split()), b""] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = {}
    for i, t in tokens.items():
        if not held[i]:
            for w in t:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    better = []
    for i, t in tokens.items():
        r = got[i]
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(w in counts for w in t), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
        if held[i]:
            better.append((r["score"] - r["base_score"]) / len(t))
    assert np.mean(better) > 0


def test_recursion_by_enumeration():
    rng = np.random.default_rng(0)
    start, moves, emit = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2)
    sequences = [rng.integers(0, 4, n) for n in (1, 5, 3, 5)]
    counts = (np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4)))
    logs = hmm.recursions(sequences, start, moves, emit, counts)
    want = (np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4)))
    for s, log in zip(sequences, logs):
        paths = list(itertools.product(range(2), repeat=len(s)))
        weight = [start[p[0]] * np.prod([moves[a, b] for a, b in zip(p, p[1:])]) * np.prod([emit[q, o] for q, o in zip(p, s)]) for p in paths]
        assert np.isclose(log, np.log(sum(weight)))
        for p, w in zip(paths, np.array(weight) / sum(weight)):
            want[0][p[0]] += w
            for a, b in zip(p, p[1:]):
                want[1][a, b] += w
            for q, o in zip(p, s):
                want[2][q, o] += w
    assert all(np.allclose(a, b) for a, b in zip(counts, want))


def test_score_by_enumeration(spark, docs):
    """The whole score of short texts: all paths of states, and each word's share of its class."""
    learn = docs.select("doc_id", "text")
    counts = hmm.word_counts(learn).persist()
    model = hmm.fit(learn, counts, states=2, rounds=1, sample_rounds=2)
    texts = ["the of", "The zzyzx", "", "of qqqq the and", None]
    seen = {}
    for r in learn.collect():
        for w in [*r["text"].encode().lower().split(), None]:
            seen[w] = seen.get(w, 0) + 1
    rank = sorted((w for w in seen if w is not None), key=lambda w: -seen[w])[: hmm.OWN]
    assert len({seen[w] for w in (b"the", b"of")}) == 2 and seen[rank[-1]] < seen[b"the"]
    flat = {w: hmm._words(pa.array([w.decode()]))[0] for w in [b"the", b"of", b"and", b"zzyzx", b"qqqq"]}
    place = {w: int(model.places(h, model.table())[0]) for w, h in flat.items()}
    got = {r["doc_id"]: r for r in hmm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, counts).collect()}
    for i, text in enumerate(texts):
        tokens = [*(text or "").encode().lower().split()]
        numbers = [int(model.number[place[w]]) if place[w] >= 0 else int(hmm._by_tail(flat[w])[0]) for w in tokens] + [0]
        paths = itertools.product(range(2), repeat=len(numbers))
        whole = sum(model.start[p[0]] * np.prod([model.moves[a, b] for a, b in zip(p, p[1:])]) * np.prod([model.emit[q, o] for q, o in zip(p, numbers)]) for p in paths)
        for w, n in zip(tokens, numbers):
            if n > hmm.OWN:
                alike = [v for v in seen if v is not None and v not in rank and v[-3:] == w[-3:]]
                assert seen.get(w, 0) + 1 <= 10 ** model.share[n] and (not alike or 10 ** model.share[n] > len(alike))
                whole *= (seen.get(w, 0) + 1) / 10 ** model.share[n]
        assert np.isclose(got[i]["score"], np.log10(whole)) and got[i]["n_known"] == sum(w in seen for w in tokens) + 1


def test_words_as_bytes():
    """Whole batches at once are the words of each text alone, whatever the cuts."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("aAb\u00e9 \t\n\x0b\u00a0 ") for _ in range(rng.randrange(12))) for _ in range(400)] + ["", "x" * 3_000_000 + " Y", " ", "y" + "X" * 3_000_000]
    h, n = hmm._words(pa.array(texts).slice(3))
    want = [t.encode().lower().split() for t in texts[3:]]
    assert n.tolist() == [len(w) for w in want]
    named = {}
    for w, x in zip(itertools.chain(*want), h.tolist()):
        assert named.setdefault(w, x) == x
    assert len(set(named.values())) == len(named)


def test_one_very_long_text(spark):
    """Two million tokens in one text: the same score as by a plain recursion."""
    rng = np.random.default_rng(6)
    word = [f"w{i}" for i in range(50)]
    text = " ".join(word[i] for i in rng.integers(0, 50, 2_000_000))
    learn = spark.createDataFrame([(i, " ".join(word[j] for j in rng.integers(0, 50, 30))) for i in range(40)], "doc_id long, text string")
    counts = hmm.word_counts(learn).persist()
    model = hmm.fit(learn, counts, rounds=1, sample_rounds=1)
    got = hmm.score(spark.createDataFrame([(99, text)], "doc_id long, text string"), model, counts).first()
    assert got["n_tokens"] == got["n_known"] == 2_000_001
    h, _ = hmm._words(pa.array([text]))
    numbers = [*model.number[model.places(h, model.table())].tolist(), 0]
    by_symbol, moves = model.emit.T.copy(), model.moves
    alpha, total = model.start * by_symbol[numbers[0]], 0.0
    for x in numbers[1:]:
        s = alpha.sum()
        total += np.log10(s)
        alpha = (alpha / s) @ moves * by_symbol[x]
    assert np.isclose(got["score"], total + np.log10(alpha.sum()), rtol=1e-9)


def test_model_sums_to_one(spark):
    """Over all texts of up to one word, known words and one unknown per class, with the rest by the end's chance."""
    learn = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b c", "c a b", ""])], "doc_id long, text string")
    counts = hmm.word_counts(learn).persist()
    model = hmm.fit(learn, counts, sample_rounds=2)
    assert np.isclose(model.start.sum(), 1) and np.allclose(model.moves.sum(axis=1), 1) and np.allclose(model.emit.sum(axis=1), 1)
    assert model.share[0] == 0 and model.tokens == 11 and model.distinct == 4


def test_model_odd_rows(odd):
    counts = hmm.word_counts(odd).persist()
    model = hmm.fit(odd, counts, sample_rounds=1, rounds=1)
    got = hmm.score(odd, model, counts).collect()
    assert len(got) == odd.count() and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5, 6)} == {1}
    none = odd.limit(0)
    empty = hmm.fit(none, hmm.word_counts(none))
    assert hmm.score(none, empty, hmm.word_counts(none)).isEmpty()
    assert all(np.isfinite(r["score"]) for r in hmm.score(odd, empty, hmm.word_counts(none)).collect())


# licences


def test_licenses(spark):
    files = [
        ("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/x.py", "code\nmore"), ("a/b/c/y.py", "text\n# Released under the MIT License.\nrest"), ("a/b/c/z.py", None),
        ("d/e.py", "nothing"), ("a/b/c/d/COPYING.txt", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
        ("a/b/c/d/f", ""), (None, "Released under the MIT License."), ("a/b/x.py", "code\nmore"), ("top.py", "this licence is my own invention and no other"),
    ]
    df = spark.createDataFrame([(i, p, t, 1, "x", "y") for i, (p, t) in enumerate(files)], "k long, path string, text string, n int, b string, dir string")
    got = {r["k"]: (r["own_license"], r["license"], r["from_dir"]) for r in licenses.scan(df, key_col="k").collect()}
    assert got == {
        0: ("Apache-2.0", "Apache-2.0", None), 1: (None, "Apache-2.0", "a"), 2: ("MIT", "MIT", None), 3: (None, "Apache-2.0", "a"), 4: (None, None, None), 5: ("GPL-3.0", "GPL-3.0", None),
        6: (None, "GPL-3.0", "a/b/c/d"), 7: ("MIT", "MIT", None), 8: (None, "Apache-2.0", "a"), 9: (None, None, None),
    }
    assert licenses.scan(df.limit(0), key_col="k").isEmpty()


def test_cosine_by_hand(spark):
    import math

    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "released under a license of mit"]
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(lines)], "path string, text string")
    got = {r["path"]: (r["own_license"], r["own_score"]) for r in licenses.scan(df, threshold=0.1).collect()}

    def terms(t):
        return [x for x in re.split(r"[^a-z0-9.]+", re.sub(r"\.(?=\s|$)", " ", t.lower())) if x]

    df_ = {x: sum(x in terms(t) for t in lines) for t in lines for x in terms(t)}

    def vector(t):
        v = {x: terms(t).count(x) * (math.log(4 / (1 + df_.get(x, 0))) + 1) for x in terms(t)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items()}

    for i, t in enumerate(lines):
        scores = [(-round(sum(w * vector(m).get(k, 0) for k, w in vector(t).items()), 6), name) for name, m in licenses.TEMPLATES]
        best = min(scores)
        assert got[f"f{i}"][0] == best[1] and abs(got[f"f{i}"][1] + best[0]) < 2e-6


def test_empty_tables_keep_their_columns(odd):
    none = odd.limit(0)
    assert simhash.near_duplicates(none).isEmpty() and simhash.drop_near_duplicates(none).columns == odd.columns
    assert linededup.deduplicate(none).isEmpty()
    assert sharding.with_slots(sharding.assign(none, sharding.even_tree(4)), ["doc_id"]).isEmpty()
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.encode(none, path, public_tokenizers.PATTERN).isEmpty()
    assert rows_of(none.select(F.col("doc_id"))) == []
