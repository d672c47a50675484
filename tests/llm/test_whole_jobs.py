"""Whole results where an operator once did less: each test fails on the version before."""

import random

import numpy as np
import pytest

import corpus_pipeline
from critpath.llm import decontamination, near_copies, quality_rules, queries
from critpath.llm.common import words_of


def plain_groups(rows):
    """The least doc_id of each group of texts with Jaccard similarity 0.8 or more on five-word shingles."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def test_sketches_bound_what_differs():
    r = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate((a[: r.integers(0, len(a) + 1)], r.integers(0, 1 << 63, r.integers(0, 300)).astype(np.uint64))))
        x, y = (np.frombuffer(near_copies.sketch(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_a_large_group_gives_few_pairs(spark, monkeypatch):
    """Copies of one text with edits of their own: rows grow with the group, not with its square, and the groups are whole."""
    monkeypatch.setattr(near_copies, "MANY", 1)
    r = random.Random(12)
    base, rows, sizes = [f"w{i}" for i in range(80)], [], []
    for i in range(240):
        words = list(base)
        for k in r.sample(range(80), r.choice([1, 1, 1, 3])):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    compare = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, texts, size: sizes.append(pairs.count()) or compare(pairs, texts, size))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == plain_groups(rows)
    assert len(sizes) >= 2 and sum(sizes) < 240 * 239 / 4


@pytest.mark.parametrize("groups", [1, 64])
def test_near_copies_are_brute_force_jaccard(spark, groups, monkeypatch):
    if groups == 64:
        monkeypatch.setattr(near_copies, "MANY", 0)
    monkeypatch.setattr(near_copies, "GROUP_BYTES", 1 << 30 if groups == 1 else 1)
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    license_line = " ".join(r.choice(vocabulary) for _ in range(12))
    rows = []
    for i in range(40):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 40, 150]))] + license_line.split() * (i % 2)
        rows.append((len(rows), " ".join(words)))
        for _ in range(r.randint(0, 3)):  # copies on both sides of 0.8
            other = list(words)
            for _ in range(r.randint(0, 1 + len(words) // 30)):
                other[r.randrange(len(other))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(other)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, license_line), (len(rows) + 4, license_line.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == plain_groups(rows) and len(got) < len(rows)


def test_near_copies_of_repeated_and_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    edited = [*base[:59], "other"]
    rows = [(5, "alone here"), (5, " ".join(base)), (3, " ".join(edited)), (3, " ".join(edited)), (None, " ".join(base)), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted((x.doc_id or 0, x.text) for x in got.collect()) == [(0, "no id"), (3, " ".join(edited)), (5, "alone here")]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_copies_pass_the_tree_first(spark, monkeypatch):
    """Fingerprints near each other are linked by the vantage-point tree, each link within the radius itself, and their texts are compared before any drawn ones."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(["other" if k == 40 * i else w for k, w in enumerate(base)])) for i in range(6)] + [(9, "apart from them all"), (10, None)]
    found, compared, search, compare = [], [], near_copies.links, near_copies._similar

    def links(fps, radius, near):
        found.append([(x.a, x.b) for x in search(fps, radius, near=near).collect()])
        return search(fps, radius, near=near)

    monkeypatch.setattr(near_copies, "RADIUS", 12)
    monkeypatch.setattr(near_copies, "links", links)
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, texts, size: compared.append(pairs.count()) or compare(pairs, texts, size))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 9, 10]
    assert len(found[0]) >= 5 and all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 12 for a, b in found[0])
    assert compared[0] >= 5 and compared[1:] == [0, 0]


def test_near_copies_run_few_stages(spark):
    """A chain of near copies takes no further rounds of joins for its length: stages (each with files and code of its own) stay few."""
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(30):
        words[4 * i] = f"other{i}"
        rows.append((i, " ".join(words)))
    docs, sc = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.sparkContext
    sc.setJobGroup("near-copies-stages", "")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {x for job in tracker.getJobIdsForGroup("near-copies-stages") for x in tracker.getJobInfo(job).stageIds}
    assert [x.doc_id for x in got] == plain_groups(rows) and len(stages) < 200


@pytest.mark.parametrize("most", [0, 1 << 17])
def test_groups_are_the_same_on_the_driver_and_in_rounds(spark, most, monkeypatch):
    monkeypatch.setattr(near_copies, "LOCAL_PAIRS", most)
    r = random.Random(3)
    for n in (0, 1, 60):
        pairs = [(r.randrange(-50, 50), r.randrange(50, 90)) for _ in range(n)]
        groups = [{x} for x in {y for p in pairs for y in p}]
        for a, b in pairs:
            x, y = (next(g for g in groups if p in g) for p in (a, b))
            if x is not y:
                groups.remove(y)
                x |= y
        got = near_copies._components(spark.createDataFrame(pairs, "a long, b long"))
        assert got.columns == ["node", "root"] and sorted(map(tuple, got.collect())) == sorted((x, min(g)) for g in groups for x in g)


def test_only_texts_of_pairs_are_sent(spark):
    texts = spark.range(3000).selectExpr("id as node", "cast(id as string) as text")
    got = {x.node: x.text for x in near_copies._marked(texts, spark.range(0, 3000, 100).withColumnRenamed("id", "node")).collect()}
    assert all(got[i] == str(i) for i in range(0, 3000, 100)) and len(got) < 40
    for kind in (np.uint8, np.uint32, np.int64):
        values = np.arange(5, dtype=kind) * kind(50)
        assert np.array_equal(near_copies._unpacked(near_copies._packed(values), kind), values)


def test_edited_copies_are_found_whatever_seeds_they_keep(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in (34, 38, 50)]
    replaced = lambda t: " ".join("edited" if k % 4 == 3 else w for k, w in enumerate(t.split()))
    deleted = lambda t: " ".join(w for k, w in enumerate(t.split()) if k % 4 != 3)
    rows = [(n, f"before it {replaced(t)} after it") for n, t in items] + [(n + 100, f"before it {deleted(t)} after it") for n, t in items]
    rows += [(0, "nothing of it"), *((n + 200, t) for n, t in items)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.find_leaks(docs, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == sorted((n + k, n) for n, _ in items for k in (0, 100, 200))
    assert [r.doc_id for r in decontamination.clean_documents(docs, benchmark).collect()] == [0]


def test_bands_reject_bad_documents_and_keep_good_ones(spark):
    data = "/root/testdata/sf0.01"
    marked = queries.QUERIES["op9_quality_rules"](spark, data).filter("not base_failed").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in marked.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.98 * (n[1, True] + n[1, False])
    assert n[0, False] >= 0.7 * (n[0, False] + n.get((0, True), 0))


@pytest.mark.parametrize("space", ["\u00a0", "\u0085", "\u2028", "\u3000"])
def test_long_texts_are_cut_between_words_alone(space):
    import public_tokenizers

    fertility = quality_rules.reader(public_tokenizers.path(quality_rules.VOCABULARY))
    text = "mot " * 16_384 + f"prix{space}: dix"
    m = quality_rules.measured(text, fertility)
    assert m["n_words"] == len(quality_rules.WORD.findall(text)) == 16_386
    assert "".join(quality_rules.chunks(text)) == text


def test_levels_refuse_a_bound_that_is_hit(spark):
    from critpath.operators import rank

    at = "epoch long, kind string, src_ts long, src_worker long, dst_ts long, dst_worker long, edge_type int, operator_id long, traverse string"
    rows = [(0, "START", None, None, 0, 0, 0, 0, "Unbounded"), (0, "EDGE", 0, 0, 1, 0, 0, 0, "Unbounded"), (0, "EDGE", 1, 0, 2, 0, 0, 0, "Unbounded"), (0, "END", 2, 0, None, None, 0, 0, "Unbounded")]
    with pytest.raises(ValueError, match="more than 1 levels"):
        rank.levels(spark.createDataFrame(rows, at), 1)
