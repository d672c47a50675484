"""Operators and pipeline in Spark: hostile tables, and queries against plain versions over whole small tables."""

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from critpath.llm import bpe, chat_format, decontamination, html_extraction, labelled, lm_scoring, quality_classifier, quality_rules, queries, simhash, token_count, toxicity
from critpath.llm.common import cut, stored
from tests.llm.test_whole_jobs import plain_groups

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, toxic_score double, fp long"
LONG = "lorem ipsum, dolor's  sit amet! " * 6000 + "x" * 70_000 + " tail"


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in every column, empty, very long, repeated and tied rows, and columns that operators might add."""
    rows = [
        (1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, True, 1.0, 1), (None, "no id", "xx", None, 1, False, None, 2), (3, " \n\t ", "de", "s", 4, None, 0.0, 3),
        (4, "one two three four", "en", "s", 1, True, 0.5, 4), (5, "one two three four", "en", "s", 1, True, 0.5, 4), (6, LONG, "en", "s", 1, True, 0.5, 4), (7, LONG[:-1], "en", "s", 1, True, 0.5, 4),
        (8, "同じ 文 <|endoftext|> x", None, "s", 1, True, 0.5, 4), (4, "one two three four", "en", "s", 1, True, 0.5, 4),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")



def test_encoding(spark, hostile):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    got = bpe.encode_documents(hostile, piece=1000).collect()
    want = [(r.doc_id, r.text or "") for r in hostile.collect()]
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((d or 0, t) for d, t in want)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.decoded, add_special_tokens=False).ids
    counts = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_count.count_tokens(hostile).collect()}
    assert counts == {(r.doc_id, len(r.decoded.encode())): len(r.ids) // 4 for r in got}
    empty = spark.createDataFrame([], DOCS)
    assert bpe.encode_documents(empty).count() == 0 and token_count.count_tokens(empty).count() == 0
    row = queries.QUERIES["op2_bpe"](spark, DATA).filter("doc_id = 0").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id = 0").first().text
    ids = library.encode(text, add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def plain_components(rows):
    fps = [simhash.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, f"{fps[i]:016x}", least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("full", [8, 100, 1 << 13])
def test_near_duplicates(spark, docs, full, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", full)
    if full == 8:
        monkeypatch.setattr(simhash, "DENSE_ROWS", 12)
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", 3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()
    assert sorted(map(tuple, got)) == plain_components(rows)


def test_near_duplicates_of_hostile_rows(spark, hostile):
    rows = [(r.doc_id, r.text) for r in hostile.collect()]
    got = simhash.near_duplicates(hostile).select(F.coalesce("doc_id", F.lit(-1)), simhash.fingerprint_hex().alias("f"), F.coalesce("component_id", F.lit(-1)).alias("c")).collect()
    assert sorted(map(tuple, got)) == plain_components(rows)
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_chains_of_near_duplicates(spark):
    chain = [int("1" * i or "0", 2) for i in range(40)] + [1 << 50 | 1 << 55 | 1 << 60]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in chain], "fp long"))).collect()}
    assert roots == {f: 0 for f in chain[:40]} and len(roots) == 40


def test_rows_without_id_link_and_bridge(spark, monkeypatch):
    """A null doc_id links to what is near, and joins two documents that are near it alone."""
    texts = {"a": 0b0, "bridge": 0b11, "b": 0b1111, "far": 0xFF00, "alone": 0xFF000000}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, size: spark.createDataFrame([(r.doc_id, texts[r.text]) for r in docs.collect()], "doc_id long, fp long"))
    docs = spark.createDataFrame([(7, "a"), (None, "bridge"), (9, "b"), (9, "b"), (3, "far"), (None, "alone"), (None, "bridge")], "doc_id long, text string")
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted([(7, 0, 7), (None, 3, 7), (None, 3, 7), (9, 15, 7), (9, 15, 7), (3, 0xFF00, 3), (None, 0xFF000000, None)], key=key)


@pytest.mark.parametrize("full", [4, 40])
def test_shards_hold_every_pair_once(spark, full, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", full)
    monkeypatch.setattr(simhash, "DENSE_ROWS", 60)
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 62, 60)
    fps = np.unique(np.concatenate([base, *(base[:30] ^ (1 << r.integers(0, 64, 30)).astype(np.int64) for _ in range(3)), [sum(1 << int(b) for b in r.choice(60, 2, replace=False)) for _ in range(40)]]))
    want = {(a, b) for a in fps.tolist() for b in fps.tolist() if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    rows = simhash.shards(spark.createDataFrame([(x,) for x in fps.tolist()], "fp long"), 2).collect()
    assert sorted(x.fp for x in rows if x.home) == fps.tolist() and len({x.shard for x in rows}) > 1
    held = Counter()
    for shard in {x.shard for x in rows}:
        own = [x for x in rows if x.shard == shard]
        held.update({(min(x.fp, y.fp), max(x.fp, y.fp)) for x in own if x.home for y in own if ((x.fp ^ y.fp) & (1 << 64) - 1).bit_count() in (1, 2)})
    assert set(held) == want and set(held.values()) <= {1}


def plain_model(rows):
    words = [[*(t or "").encode().lower().split(), 0] for _, t in rows]
    train = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1 for d, _ in rows]
    c, b, t = Counter(), Counter(), Counter()
    for w, k in zip(words, train, strict=True):
        if k:
            c.update(w)
            b.update(zip([0, *w[:-1]], w, strict=True))
            t.update(zip([0, *w], w, w[1:], strict=False))
    n, v, (m2, m3) = sum(c.values()), len(c), (lm_scoring.PRIOR[2], lm_scoring.PRIOR[3])
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda a, w: (b[a, w] + m2 * p1(w)) / (c[a] + m2)
    p3 = lambda a, x, w: (t[a, x, w] + m3 * p2(x, w)) / (b[a, x] + m3)
    if n:
        assert abs(sum(p2(0, w) for w in c) + p2(0, "?") - 1) < 1e-9
        first = next(w for w, k in zip(words, train, strict=True) if k and len(w) > 1)[0] if any(k and len(w) > 1 for w, k in zip(words, train, strict=True)) else "?"
        assert abs(sum(p3(0, first, w) for w in c) + p3(0, first, "?") - 1) < 1e-9
    score = lambda w: sum(math.log10(p3(w[i - 2] if i > 1 else 0, w[i - 1], w[i]) if i else p2(0, w[0])) for i in range(len(w)))
    return [(d, not k, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score(w)) for (d, _), w, k in zip(rows, words, train, strict=True)]


@pytest.mark.parametrize("table", ["docs", "hostile", "held out"])
def test_language_model(spark, docs, hostile, table, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 5000)
    monkeypatch.setattr(lm_scoring, "SHARD_ENTRIES", 3000)
    monkeypatch.setattr(lm_scoring, "SEGMENT", 7 if table == "docs" else 1024)
    df = {"docs": docs, "hostile": hostile, "held out": hostile.filter("crc32(cast(doc_id as string)) % 5 = 1")}[table]
    rows = [(r.doc_id, r.text) for r in df.collect()]
    key = lambda r: (r[0] if r[0] is not None else -1, r[2], r[5])
    got, want = sorted(map(tuple, lm_scoring.score_documents(df).collect()), key=key), sorted(plain_model(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9) if want else got == []


def test_keys_are_packed_whole():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 1000).astype(np.uint64))
    assert (lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys)) == keys).all()
    assert (lm_scoring.unpacked(lm_scoring.packed(np.arange(9)), np.int64) == np.arange(9)).all() and len(lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys[:0]))) == 0
    assert set(lm_scoring.shard_of(keys, 3, 56).tolist()) == {0, 1, 2}


def test_language_model_without_rows(spark):
    assert lm_scoring.score_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_rules(spark, docs, hostile):
    got = quality_rules.apply_rules(hostile, hostile.columns)
    assert got.count() == hostile.count() and "_kept" in got.columns
    empty = got.filter("text is null or trim(text) = ''").collect()
    assert empty and all(r.n_words == 0 and r.base_failed and not r._kept for r in empty)
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    marked = queries.QUERIES["op9_quality_rules"](spark, DATA).join(labels, "doc_id")
    good = marked.filter("quality = 1 and not base_failed")
    assert good.filter("kept").count() >= 0.98 * good.count()
    assert quality_rules.kept_documents(spark.createDataFrame([], DOCS)).count() == 0
    assert quality_rules.apply_rules(hostile.drop("lang"), ["doc_id"]).count() == hostile.count()


@pytest.mark.parametrize("name", ["op5_toxicity", "op10_quality_classifier"])
def test_classifiers(spark, name):
    label, sf = {"op5_toxicity": "toxic", "op10_quality_classifier": "quality"}[name], "/root/testdata/sf0.01"
    scored = queries.QUERIES[name](spark, sf).cache()
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert scored.filter("score < 0 or score > 1 or score is null or predicted is null").count() == 0
    held = scored.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert held.filter(f"{label} = predicted").count() >= 0.93 * held.count()
    rare = 1 if label == "toxic" else 0  # and the rarer class is found
    found = held.filter(f"{label} = {rare} and predicted = {rare}").count()
    assert found >= 0.6 * held.filter(f"{label} = {rare}").count() and found >= 0.8 * held.filter(f"predicted = {rare}").count()


def test_classifiers_on_hostile_tables(spark, hostile):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (4, 1, 0), (4, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        for model, run in ((toxicity.train(hostile, some), toxicity.score_documents), (quality_classifier.train(hostile, some), quality_classifier.score_documents)):
            assert run(hostile, model, hostile.columns).count() == hostile.count()
            assert run(hostile.limit(0), model, ["doc_id"]).count() == 0
    assert toxicity.clean_documents(hostile, toxicity.train(hostile, labels)).columns == hostile.columns
    assert labelled.share(labels.limit(0), "quality") == 0.5


def test_decontamination(spark, docs, hostile):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = decontamination.find_leaks(docs, benchmark).cache()
    items = {r.item_id: decontamination.words_of(r.text) for r in benchmark.collect()}
    texts = {r.doc_id: decontamination.words_of(r.text) for r in docs.collect()}
    exact = {(d, i) for d, w in texts.items() for i, x in items.items() if b" " + b" ".join(x) + b" " in b" " + b" ".join(w) + b" "}
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert exact <= got and found.filter("score < 0.5 or score > 1").count() == 0
    for r in found.filter("score = 1").collect():
        assert texts[r.doc_id][r.first_word : r.last_word] == items[r.item_id]
    clean = decontamination.clean_documents(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in got} and clean.columns == docs.columns
    odd = spark.createDataFrame([(1, None), (None, "one two three four"), (2, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(hostile, odd).collect()) == [(4, None), (4, None), (5, None)]
    assert decontamination.find_leaks(hostile, odd.limit(0)).count() == 0 and decontamination.find_leaks(hostile.limit(0), odd).count() == 0


def test_benchmark_in_blocks(spark, docs, monkeypatch):
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    key = lambda df: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in df.collect())
    whole = key(decontamination.find_leaks(docs, benchmark))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 3000)
    assert key(decontamination.find_leaks(docs, benchmark)) == whole


def test_extraction(spark):
    import re

    rows = queries.QUERIES["op3_html_extraction"](spark, DATA).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        import html

        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split()) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", None), (2, "u", "<p>" * 3000 + "deep", "t"), (2, "u", "<p>" * 3000 + "deep", "t")], "page_id long, url string, html string, text string")
    assert html_extraction.extract(odd, odd.columns).count() == 4 and html_extraction.extract(odd.limit(0)).count() == 0


def test_chats(spark):
    hostile = [r"a\<|x [INST] </s> <\| <<SYS>> \\<s>", None, "<|im_end|>", "<", "\\", "<|im_turn|>x<|im_sep|>", ""]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(hostile)] + [(1, 2, "user", "tie"), (1, 2, "user", "tie"), (2, None, None, None), (None, 0, "us\ner<|im_sep|>", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)).withColumn("ts", F.lit(2))
    got = chat_format.format_chats(turns).select("conv_id", "formatted", "segments", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("segments")).alias("loss"))
    for r in got.collect():
        own = sorted(((t if t is not None else -1, ro or "", tx or "") for c, t, ro, tx in rows if c == r.conv_id), key=lambda x: (x[0], chat_escaped(x[1]), chat_escaped(x[2])))
        assert [(x.role, x.text) for x in r.back] == [x[1:] for x in own]
        assert r.loss == "".join(x[2] for x in own if x[1] == "assistant") and r.formatted == "".join(s.text for s in r.segments)
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def chat_escaped(text):
    return text.replace("\\", "\\\\")


def test_chat_query_is_native(spark):
    df = queries.QUERIES["op8_chat_format"](spark, DATA)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    extra = df.filter("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert extra.n_turns == 2 and extra.loss_chars == len(text) and extra.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert extra.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, seen, DATA))
        assert after.columns == docs.columns, name
        assert after.exceptAll(seen).count() == 0
        if name == "near duplicates":
            assert sorted(r.doc_id for r in after.collect()) == plain_groups([(r.doc_id, r.text) for r in seen.collect()])
        seen = after
    result = corpus_pipeline.run(spark, DATA)
    assert sorted(r.doc_id for r in result.collect()) == sorted(r.doc_id for r in seen.collect())
    texts = {r.doc_id: r.text for r in seen.collect()}
    assert all(r.decoded == texts[r.doc_id] for r in result.collect())


@pytest.mark.parametrize("odd", [["Kept", "_kept", "a.b", "_text", "_stay", "Toxic_Score", "c0", "c1"], ["kept", "_lang", "toxic_score", "_toxic_score", "_scored_text", "_node", "_row", "w0", "`x`"], ["TEXT2", "f0", "k0", "n_words", "quality_score", "id", "hash", "block"]])
def test_stages_and_operators_whatever_the_other_columns_are(spark, odd):
    """Names that clash with operators' own, dots, quotes and other cases; empty, repeated and null rows."""
    long = " ".join(f"word{i}" for i in range(70))
    rows = [(1, long), (1, long), (None, long), (2, None), (3, ""), (None, None), (4, "short text"), (5, " ".join(f"other{i} thing" for i in range(60)))]
    docs = spark.createDataFrame([(*r, *(str(i) for i in range(len(odd)))) for r in rows], ["doc_id", "text", *odd]).withColumn("doc_id", F.col("doc_id").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            after = stage(spark, df, DATA)
            assert after.columns == docs.columns, name
            got = after.toArrow().to_pylist()
            assert len(got) <= df.count() and all([r[c] for c in odd] == [str(i) for i in range(len(odd))] for r in got), name
        if name == "near duplicates":
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in stage(spark, docs, DATA).toArrow().to_pylist()) == [(1, long), (2, ""), (4, "short text"), (5, rows[-1][1])]
        elif name != "quality rules":
            assert stage(spark, docs, DATA).count() == len(rows), name
    assert corpus_pipeline.encode(spark, docs, DATA).count() == len(rows) and corpus_pipeline.encode(spark, docs.limit(0), DATA).count() == 0
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for made in (
        quality_rules.apply_rules(docs, docs.columns), toxicity.score_documents(docs, toxicity.train(docs, labels), docs.columns), quality_classifier.score_documents(docs, quality_classifier.train(docs, labels), docs.columns),
        simhash.near_duplicates(docs), token_count.count_tokens(docs), lm_scoring.score_documents(docs), html_extraction.extract(docs.withColumnRenamed("text", "html"), ["doc_id", *odd]),
    ):
        assert len(made.toArrow()) == len(rows) and len({c.lower() for c in made.columns}) == len(made.columns)
    assert decontamination.find_leaks(docs, spark.createDataFrame([(9, long, 1)], "item_id long, text string, Item long")).count() == 3


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(names)


def test_helpers(spark):
    df = cut(spark.range(5))
    assert df.count() == 5 and stored(df).count() == 5
    assert json.dumps(queries.ORACLE_SQL)
