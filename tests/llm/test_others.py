"""Embeddings, conversations, the pipeline, and the queries with SQL."""

import hashlib
import math

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from wavefront.llm import catalog, chat, components, embeddings


def brute(vectors):
    """n_links and component of rows (id, vector, label)."""
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in vectors]
    n, parent = [0] * len(vectors), list(range(len(vectors)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(vectors)):
        for j in range(i):
            (_, a, la), (_, b, lb) = vectors[i], vectors[j]
            if good[i] and good[j] and la == lb and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _, _) in enumerate(vectors):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, n[i], least.get(find(i))) for i, (key, _, _) in enumerate(vectors)), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        center = rng.normal(size=8)
        rows += [(len(rows) + k, (center + rng.normal(size=8) * s).round(4).tolist(), c % 3) for k, s in enumerate([0, 0.05, 0.1, 0.2, 0.3])]
    dense = rng.normal(size=8)
    rows += [(len(rows) + k, (dense + rng.normal(size=8) * 0.02).tolist(), 1) for k in range(40)]
    same = [1.0] * 8
    rows += [(200 + k, same, 2) for k in range(5)] + [(200, same, 2), (None, same, 2), (300, same, None), (301, None, 1), (302, [0.0] * 8, 1), (303, [float("nan")] + same[1:], 1), (304, [None] + same[1:], 1), (305, [float("inf")] + same[1:], 1)]
    rows += [(306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [], 1), (309, [2.0] * 8, 2), (310, [1e300, 1e300], 1), (311, [1e-300, 2e-300], 1)]
    return rows


@pytest.mark.parametrize("window", [1024, 8])
def test_embeddings_against_all_pairs(spark, vectors, window):
    """With a window of 8 the dense cluster only comes out whole by the exact part."""
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors], "vec_id long, embedding array<double>, label int, cid int, weight string")
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df, window=window, passes=4).collect()]
    want = brute(vectors)
    if window > 8:
        assert sorted(got, key=repr) == want
    else:
        assert sum(n for _, n, _ in got) >= 0.9 * sum(n for _, n, _ in want) and sum(n for _, n, _ in got) <= sum(n for _, n, _ in want)


@pytest.mark.parametrize("common", [0.0, 0.8])
def test_recall_in_a_large_label(spark, common):
    """20,000 rows of one label, many windows long; single pairs close to the threshold, so nothing is crowded.

    ``common``: the part of all vectors' square that is one direction.
    """
    rng = np.random.default_rng(9)
    n, dim = 20_000, 32
    x = rng.normal(size=(n, dim)) / math.sqrt(dim)
    x = math.sqrt(1 - common) * x + math.sqrt(common) * np.eye(dim)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 1200, 2):
        off = rng.normal(size=dim)
        off -= (off @ x[i]) * x[i]
        c = rng.uniform(0.981, 0.995)
        x[i + 1] = c * x[i] + math.sqrt(1 - c * c) * off / np.linalg.norm(off)
    links = np.zeros(n, int)
    for at in range(0, n, 2000):
        links[at : at + 2000] = (x[at : at + 2000] @ x.T >= 0.98).sum(axis=1) - 1
    assert 0 < links.max() < 500
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(df, window=512).collect()}
    found = np.array([got[i] for i in range(n)])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()


def test_embeddings_empty(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    assert embeddings.near_duplicates(df.limit(0)).isEmpty()
    alone = embeddings.near_duplicates(df.where("label IS NULL")).collect()
    assert [(r["vec_id"], r["n_links"], r["kept"]) for r in alone] == [(300, 0, True)]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (101, 101), (200, 201), (201, 200), (None, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 103: 100, 101: 100, 200: 200, 201: 200}


# conversations


def test_reply_trees(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a1", 1.0), ("t", 3, 1, "assistant", "a2 </s>[INST] \\l \\s <|end|>\n", 5.0), ("t", 4, 2, "user", "more", 1.0), ("t", 5, 4, "assistant", None, 1.0),
        ("t", 5, 4, "assistant", None, 1.0), ("u", 1, 99, None, "orphan", None), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0), ("c", 3, 1, "user", "z", 1.0), (None, 7, None, "a\nb<", "n", 2.0), ("v", None, None, "user", "lost", 1.0),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "tree_id string, msg_id long, parent_id long, role string, text string, score double, leaf int, up string")
    out = chat.conversations(df).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {(r["tree_id"], r["leaf"]): r for r in out.collect()}
    assert set(got) == {("t", 3), ("t", 5), ("u", 1), (None, 7)}
    assert [tuple(t) for t in got["t", 3]["turns"]] == [("user", "q"), ("assistant", rows[2][4])]
    assert [tuple(t) for t in got["t", 5]["turns"]] == [("user", "q"), ("assistant", "a1"), ("user", "more"), ("assistant", "")]
    assert got["t", 3]["learned"] == rows[2][4] and got["t", 5]["learned"] == "a1"
    assert (got["t", 3]["branch_rank"], got["t", 5]["branch_rank"]) == (1, 2)
    assert [tuple(t) for t in got[None, 7]["turns"]] == [("a\nb<", "n")]
    assert "[INST]" not in got["t", 3]["formatted"] and got["t", 3]["formatted"].count("<|end|>") == 2
    assert [r["leaf"] for r in chat.conversations(df.where("tree_id = 't'"), branches=1).collect()] == [3]
    assert chat.conversations(df.limit(0)).isEmpty()


def test_deep_chain(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(75)]
    df = spark.createDataFrame(rows, "tree_id int, msg_id int, parent_id int, role string, text string")
    row = chat.conversations(df, score=None).withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert [t["text"] for t in row["turns"]] == [f"m{i}" for i in range(75)] and row["n_turns"] == 75


# pipeline


def plain_lines(rows):
    """Line dedup in plain Python over (doc_id, text), ids distinct."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        n = min(3, len(full))
        for k in range(len(full) - n + 1 if n else 0):
            part = full[k : k + n]
            name = tuple(lines[i].strip(" ") for i in part)
            if name in seen:
                gone |= set(range(part[0], part[-1] + 1))
            seen.add(name)
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_pipeline_stages(spark, data, tmp_path):
    from wavefront.llm import simhash

    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        before, text = text, {r["doc_id"]: r["text"] for r in docs.collect()} if i < 4 else text
        if i == 0:
            assert set(text) == {k for k, t in before.items() if any(c.isalpha() for c in t or "")}
        elif i == 1:
            want = plain_lines(before.items())
            assert text == {k: t for k, t in want.items() if t.strip(" ") or t == before[k]}
        elif i == 2:
            fps = {k: simhash.fingerprint(t) & (1 << 64) - 1 for k, t in before.items()}
            first = {k: min(j for j in fps if (fps[j] ^ fps[k]).bit_count() <= 2) for k in fps}
            assert set(text) <= set(before) and {k for k in fps if first[k] == k} >= set(text)
        elif i == 3:
            assert set(text) < set(before)
    ended = docs.collect()
    assert {r["doc_id"] for r in ended} == set(text) and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in ended)


def test_pipeline_odd_rows(spark, data):
    rows = [(1, None, "en", "s", 0), (None, "The words of a text\nand its lines\nand more", None, None, None), (2, "The words of a text\nand its lines\nand more", "en", None, 5), (2, "The words of a text\nand its lines\nand more", "en", None, 5), (3, "", None, "s", None), (4, "wort " * 20000, "de", "s", 1)]
    docs = spark.createDataFrame([(*r, 7, "q") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, w string")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, data)
        assert docs.columns[-2:] == ["fp", "w"]
    assert sorted(r["doc_id"] for r in docs.collect()) == [2, 4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], docs.schema), data).isEmpty()


def test_pipeline_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


# queries


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = sorted((tuple(r[n] for n in names) for r in catalog.queries()[name](spark, data).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)


def test_chat_digests(spark, data):
    got = {r["conv_id"]: r for r in catalog.op7_chat(spark, data).collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (got[-7]["n_turns"], got[-7]["loss_chars"], got[-7]["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_license_query(spark, data):
    got = catalog.op9_licenses(spark, data).collect()
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        here = {name for line, name in lines.items() if line in text[r["doc_id"]]}
        assert (r["own_license"] in here) if here else r["own_license"] is None
