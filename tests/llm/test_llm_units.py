"""Operators without Spark, against plain versions."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from critpath.llm import bpe, decontamination, html_extraction, html_training, quality_classifier, quality_rules, simhash, toxicity
from critpath.llm.common import crc_of, words_of
from critpath.llm.html_tree import SILENT, parse, walk

ODD = ["a", "the", "ing", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "é", "ü", "!!", "#", "12", "<|endoftext|>", "<|endof", "text|>", "　", "\x1c", "日本", "͸", "𞗿"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_is_the_library(library):
    coder, r = bpe.encoder(bpe.vocabulary_path()), random.Random(1)
    for _ in range(600):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == want
        assert coder.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False) == text
        size = r.choice([1, 2, 5, 11, 30])
        if text and not coder.odd(text):
            joined = bpe.tree(coder, [bpe.Encoded.of(coder, text[k : k + size]) for k in range(0, len(text), size)])
            assert joined.ids.tolist() == want and joined.bounds[-1] == len(want)


def test_long_stretches_are_halved_exactly(monkeypatch):
    coder, r = bpe.Bpe(bpe.vocabulary_path()), random.Random(2)
    monkeypatch.setattr(bpe, "LEAF", 8)
    for i in range(400):
        data = "".join(r.choice("aeiouthngsr" if i % 2 else "ab") for _ in range(r.randint(1, 400))).encode()
        assert coder.stretch(data) == coder.core.encode_single_piece(data)


def test_an_unsplit_word_is_joined_token_by_token(library):
    """The joining task encodes next to nothing anew, and a word of 5 MB gives what the halves of one task give."""
    coder, r = bpe.Bpe(bpe.vocabulary_path()), random.Random(6)
    word = "".join(r.choice("aeiouthngsr") for _ in range(5_000_000))
    pieces = [bpe.Encoded.of(coder, word[k : k + bpe.PIECE]) for k in range(0, len(word), bpe.PIECE)]
    coder.again = 0
    joined = bpe.tree(coder, pieces)
    assert coder.again < 0.05 * len(word) and coder.decode(joined.ids) == word and joined.bounds.tolist() == [0, len(joined.ids)]
    short = word[:200_000]
    assert bpe.tree(coder, [bpe.Encoded.of(coder, short[k : k + 5000]) for k in range(0, len(short), 5000)]).ids.tolist() == library.encode(short, add_special_tokens=False).ids


def test_chunks_end_at_split_points():
    coder, r = bpe.encoder(bpe.vocabulary_path()), random.Random(3)
    for _ in range(200):
        text = "".join(r.choice(ODD[:-2]) for _ in range(r.randint(0, 300)))
        parts = list(bpe.chunks(text, 20))
        assert "".join(parts) == text
        assert [x for p in parts for x in coder.splits(p)] == coder.splits(text)


def plain_fingerprint(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "Two WORDS", "a b c", "x " * 50, "É b c d e", "q w e r t y u i o p a s d"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text, 3)


def plain_alignment(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 12))] for _ in range(2))
        score, start, end = decontamination.align(np.array(a), np.array(b))
        assert score == plain_alignment(a, b)
        if score:
            assert plain_alignment(a, b[start:end]) == score


def test_leaks_survive_edits_and_clean_text_stays():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    items = decontamination.Items([(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(90, "tiny item"), (91, ""), (92, None)])
    clean = " ".join(word() for _ in range(300))
    assert not decontamination.leaks_in(items, items.read(clean))
    for i in range(20):
        words = [next(k for k, v in items.vocabulary.items() if v == w).decode() for w in items.words[i].tolist()]
        for k in r.sample(range(30), 5):
            words[k] = "edited"
        del words[r.randint(0, 29)]
        text = clean + " " + " ".join(words).upper() + ". " + clean
        (found,) = decontamination.leaks_in(items, items.read(text))
        assert items.ids[found[0]] == i and found[1] >= 0.5 and 298 <= found[2] <= 303 and 327 <= found[3] <= 332
    assert [items.ids[k] for k, *_ in decontamination.leaks_in(items, items.read("a Tiny, item b"))] == [90]
    assert decontamination.leaks_in(items, items.read(None)) == []


def plain_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), duplicates, len(hit)


def test_rule_figures():
    import public_tokenizers

    fertility, r = quality_rules.Fertility(public_tokenizers.path(quality_rules.VOCABULARY)), random.Random(6)
    for _ in range(150):
        text = "".join(r.choice(["a", "bb", "é#", "x|", " ", " ", "\n", "\t", " ", " "]) for _ in range(r.randint(0, 90)))
        m = quality_rules.measured(text, fertility)
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == plain_rules(text)
        ids = [i for w in quality_rules.WORD.findall(text) for i in fertility.pieces.encode(w)]
        p = np.unique(ids, return_counts=True)[1] / max(1, len(ids))
        assert m["n_tokens"] == len(ids) and abs(m["entropy"] + (p * np.log2(p)).sum()) < 1e-9 if ids else m["entropy"] == 0
    assert quality_rules.script_of("привет abc") == "greek, cyrillic" and quality_rules.script_of("123") == "other" and quality_rules.script_of("日本語") == "cjk"


def test_verdicts():
    rules = quality_rules.Rules()
    m = {"n_words": 60, "n_repeat_words": 0, "n_tokens": 64, "chars_per_token": 4.5, "byte_share": 0.0, "entropy": 5.2}
    assert quality_rules.verdict(m, "x", "en", rules) == (False, True)  # short, and as varied as it can be
    assert quality_rules.verdict({**m, "n_tokens": 300}, "x", "en", rules) == (False, False)
    assert quality_rules.verdict({**m, "n_words": 49}, "x", "en", rules) == (True, False)
    assert quality_rules.verdict({**m, "n_repeat_words": 31}, "x", "en", rules) == (True, False)
    assert quality_rules.verdict({**m, "chars_per_token": 1.2}, "x", "en", rules) == (False, False)
    assert quality_rules.verdict({**m, "chars_per_token": 1.2, "byte_share": 0.8, "entropy": 6.0}, "日本語", None, rules) == (False, True)


def made_texts(r, n, toxic):
    word = lambda: "".join(r.choice(["ta", "ri", "no", "ke", "su", "la", "mo"]) for _ in range(r.randint(1, 3)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(60)]
        for _ in range(3 if toxic else 0):
            words[r.randint(0, 59)] = r.choice(["vilegrub", "dregwort", "blightox"]) + r.choice(["", ".", ","])
        out.append(" ".join(words))
    return out


def test_toxicity_on_held_out_texts():
    r = random.Random(7)
    model = toxicity.fit(made_texts(r, 60, True), made_texts(r, 300, False))
    scores = [[model.score(t)[0] for t in made_texts(r, 100, toxic)] for toxic in (True, False)]
    assert np.mean(np.array(scores[0]) >= toxicity.CUT) > 0.95 and np.mean(np.array(scores[1]) >= toxicity.CUT) < 0.01
    assert 0 <= model.score(None)[0] < toxicity.CUT and model.score("")[0] == model.score(None)[0]
    assert toxicity.fit([], []).score("x")[0] < toxicity.CUT and toxicity.fit(["a"], []).score(None)[1] == 0


def test_quality_on_held_out_texts():
    r = random.Random(8)
    bad = lambda n: [t.upper().replace(" ", "!! ") for t in made_texts(r, n, False)]
    model = quality_classifier.fit(made_texts(r, 100, False), bad(60), 0.7)
    assert np.mean([model.score(t) >= 0.5 for t in made_texts(r, 80, False)]) > 0.95
    assert np.mean([model.score(t) < 0.5 for t in bad(80)]) > 0.95
    assert 0 <= model.score(None) <= 1 and model.score("") == model.score(None)
    assert quality_classifier.fit([], []).score("x") == 0.5


def test_extraction_of_unseen_pages():
    import pickle
    import re

    model, right = pickle.loads(html_extraction.trained()), []
    for page in html_training.pages(100, seed=99):
        nodes = walk(parse(page))
        want = html_extraction.joined(nodes, [k and n.tag not in SILENT for k, n in zip(html_extraction.marked(nodes), nodes, strict=True)])
        right.append(model.texts([re.sub(r' data-testid="(keep|drop)"', "", page)])[0] == want)
    assert np.mean(right) > 0.9
    assert model.texts([None, "", "just text", "<p>a<p>b<div>c", "<b>unclosed <i>x", "<!-- only -->", "a&amp;b &lt;p&gt;\n\t c"]) == ["", "", "just text", "a b c", "unclosed x", "", "a&b <p> c"]


@pytest.mark.parametrize("unit", ['<a x="y ', "<a ", "<a<a", "<a \"'", "<b '\"", "<!--", "<p>", '<a x="y> ', "<!", "</"])
def test_broken_pages_are_read_in_linear_time(unit):
    import time

    began = time.process_time()
    parse(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 30  # some seconds at most; the quadratic reader took about an hour


def test_tags_with_quotes_and_broken_ones():
    text = lambda page: html_extraction.joined(walk(parse(page)), [True] * len(walk(parse(page))))
    assert text('<p title="a > b">x</p>') == "x" and text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert text('<p>a<a href="x>b</p>') == 'a<a href="x>b' and text("a<!-- > -->b<![CDATA[c]]>d<?x y>e<!z") == "abde<!z"
    assert text("<script>if (a < b) {}</script>z</script >") == "z"


def test_decoding_is_consistent():
    r = random.Random(9)
    for _ in range(50):
        nodes = walk(parse("".join(r.choice(["<div>", "</div>", "<p>t", "<section>"]) for _ in range(12))))
        logits = np.array([r.uniform(-3, 3) for _ in nodes])
        kept = html_extraction.decoded(nodes, logits)
        place = {id(n): i for i, n in enumerate(nodes)}
        assert all(kept[place[id(n.parent)]] for n, k in zip(nodes, kept, strict=True) if k and n.parent)
        score = lambda k: sum(-np.logaddexp(0, -x if y else x) for x, y in zip(logits[1:], k[1:], strict=True))  # noqa: B023, E731
        if len(nodes) <= 9:
            options = [[True, *(bool(m >> i & 1) for i in range(len(nodes) - 1))] for m in range(1 << (len(nodes) - 1))]
            valid = [o for o in options if all(o[place[id(n.parent)]] for n, k in zip(nodes, o, strict=True) if k and n.parent)]
            assert abs(score(kept) - max(map(score, valid))) < 1e-9


def test_helpers():
    assert words_of("Ab É c\x0bd") == ["ab".encode(), "É c".encode(), b"d"] and words_of(None) == []
    assert crc_of(12) == zlib.crc32(b"12") and crc_of(None) == zlib.crc32(b"")
