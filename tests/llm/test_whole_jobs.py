"""Work that a shortcut would leave undone."""

import itertools
import random
import re
import textwrap
import time

import corpus_pipeline
import numpy as np
import pytest
from wavefront.llm import catalog, components, jaccard, licenses, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_at_four_fifths(spark):
    """Against all pairs: edited copies, chains of them, a common passage, exact copies, short and empty texts."""
    rng = random.Random(8)
    texts = []
    common = [f"c{i}" for i in range(40)]
    for g in range(25):
        words = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(rng.randrange(20, 200))] + (common if g % 3 else [])
        for _ in range(rng.randrange(1, 9)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
    base = [f"b{i}" for i in range(100)]
    texts += [" ".join(base[:i] + [f"n{i}"] + base[i + 1 :]) for i in range(100)]
    texts += ["a b", "A  b", "a c", "a b c d e", "", " ", None, texts[0].upper()]
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            parent[b], linked = a, linked + 1
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and linked > 100
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in range(len(texts))})
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").isEmpty()


def test_many_frequent_shingles_cost_a_text_little(spark):
    """As many as a large corpus has: a pass over them for each text would take minutes here."""
    rng = np.random.default_rng(1)
    late = np.unique(rng.integers(-(2**62), 2**62, 200_000))
    rows = [(i, 100, sorted(rng.integers(-(2**62), 2**62, 24).tolist() + late[i * 48 : i * 48 + i % 5].tolist())) for i in range(4000)]
    nodes = spark.createDataFrame(rows, "node long, n long, first array<long>").repartition(4).persist()
    nodes.count()
    started = time.monotonic()
    found = {r["node"]: r["first"] for r in jaccard._placed(nodes, late, 80).collect()}
    assert time.monotonic() - started < 20
    frequent = set(late.tolist())
    assert found == {i: [x for x in h if x not in frequent][:21] for i, _, h in rows}
    assert not jaccard._among(late[:3], late[:0]).any() and jaccard._among(late, late).all()
    nodes.unpersist()


def edited_copies(n, edits):
    """Copies of one text with up to so many words replaced; their fingerprints are many bits apart at most edits."""
    rng = random.Random(3)
    words = [rng.choice("abcdefghij") + str(rng.randrange(999)) for _ in range(150)]
    out = []
    for i in range(n):
        copy = list(words)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(copy), "en", "s", 1))
    return out


def least_of_groups(rows):
    sets = [set(jaccard.shingles(r[1]).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if group[i] != group[j] and both * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    return sorted(set(group))


def test_pairs_of_a_large_group(spark, monkeypatch):
    """In a group of near copies, some of them too far from all others, rows for pairs stay in proportion to it."""
    rows, made, possible = edited_copies(400, 9), [], jaccard._possible

    def counted(met, *rest):
        made.append(met.count())
        return possible(met, *rest)

    monkeypatch.setattr(jaccard, "_possible", counted)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    want = least_of_groups(rows)
    assert len(want) > 20 and sorted(r["doc_id"] for r in kept.collect()) == want
    assert max(made) < 50 * len(rows)


def test_fingerprints_link_near_copies(spark, monkeypatch):
    """Operator 1's grid joins the fingerprints of the stage; what it links is checked exactly, and what it can't link is found."""
    rows, joined, near_links = edited_copies(60, 4), [], simhash.near_links

    def seen(fps):
        links = near_links(fps)
        joined.extend((r["a"], r["b"]) for r in links.collect())
        return links

    monkeypatch.setattr(simhash, "near_links", seen)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == least_of_groups(rows)
    fps = {simhash.fingerprint(r[1], 5) for r in rows}
    assert joined and {x for link in joined for x in link} < fps


@pytest.mark.parametrize("start, mark, end", [("/*", " * ", " */"), ("#!/bin/sh", "# ", "code = 1"), ("", "", ""), ("//", "// ", "int main() {}")])
def test_wrapped_headers(spark, start, mark, end):
    """Headers at the width of a page, with the code that follows, at the threshold in use."""
    body = "def run(x):\n    return x + 1\n" * 5
    texts = {name: text for name, text in licenses.TEMPLATES if name in ("MIT", "GPL-3.0", "BSD-3-Clause")}
    files = []
    for name, text in texts.items():
        header = "\n".join(mark + x for x in textwrap.wrap(text, 72))
        files += [(f"{name}/{i}.c", f"{start}\n{header}\n{end}\n" + ("" if mark else "\n") + body + f"y{i}") for i in range(30)]
    files.append(("none/a.c", body))
    got = {r["path"]: r["own_license"] for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {p: None if p == "none/a.c" else p.split("/")[0] for p, _ in files}


@pytest.mark.parametrize("start, mark, end", [("#!/bin/sh", "# ", "code = 1"), ("//", "// ", "int main() {}"), ("/*", " * ", " */")])
def test_every_template_wrapped(spark, start, mark, end):
    """All templates at 72 columns; texts that several licences share must give one of theirs."""
    body = "def run(x):\n    return x + 1\n" * 5
    files = []
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        header = "\n".join(mark + x for x in textwrap.wrap(text, 72))
        files += [(f"{k}/{i}.c", f"{start}\n{header}\n{end}\n" + body + f"y{i}") for i in range(5)]
    assert all(re.search(licenses.CUE, text) for _, text in licenses.TEMPLATES)
    got = {r["path"]: r["own_license"] for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {p: licenses.TEMPLATES[int(p.split("/")[0])][0] for p, _ in files}


def test_license_inheritance_of_the_query(spark, data):
    """License and from_dir of all rows, from own_license and the paths by a plain walk upwards."""
    got = catalog.op9_licenses(spark, data).collect()
    holding = {}
    for r in got:
        folder, _, name = r["path"].rpartition("/")
        if re.search(licenses.LICENSE_FILE, name) and r["own_license"]:
            holding.setdefault(folder, []).append((-r["own_score"], r["own_license"]))
    inherited = 0
    for r in got:
        want = (r["own_license"], None)
        folder = r["path"].rpartition("/")[0]
        while r["own_license"] is None and want[0] is None:
            if folder in holding:
                want = (min(holding[folder])[1], folder)
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        inherited += want[1] is not None
        assert (r["license"], r["from_dir"]) == want
    assert holding and inherited


def test_unlabelled_rows_stay(spark):
    """Without a labelled row there is nothing to learn from, which is no reason to drop a text."""
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(["words of a text", "中文", "12 %", "", None])], DOCS)
    got = corpus_pipeline.language_id(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(0, None), (1, None)]


@pytest.mark.parametrize("small_rows", [components.SMALL_ROWS, 100])
def test_components_of_few_links_make_few_files(spark, monkeypatch, small_rows):
    """Rounds over few links write one file each, whatever the number of partitions; those over many give the same."""
    rng, parts, durable = random.Random(5), [], components.durable
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(i, i + 1) for i in range(500, 540)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = sorted((x, find(x)) for x in {x for a, b in links if a != b for x in (a, b)})

    def counted(df):
        out = durable(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "SMALL_ROWS", small_rows)
    monkeypatch.setattr(components, "durable", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = components.components(spark.createDataFrame(links, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) > 2
    if small_rows > 2 * len(links):
        assert set(parts[1:]) == {1}
