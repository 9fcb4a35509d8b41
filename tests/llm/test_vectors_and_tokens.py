"""Tests of the quality classifier, the tokenizer alignment and the vector codes against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chatloom.llm import align, bpe, classifier, codes

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables not present")
EN = "the quick brown fox jumps over the lazy dog and then runs away from the old barn near the river"
ODD_TEXTS = [None, "", " \n\t ", "!!! 123", EN, EN, "é ß 中文 \U0001f600 <|endoftext|> </s> <unk>", "a▁b", "word " * 20_000, "x" * 5_000, "a\x00b", "  　x"]
CLASHING = "doc_id bigint, text string, lang string, _text string, _chunk int, _row int, n_a string, score string, features string"


def docs_of(spark, texts, first_id=0):
    return spark.createDataFrame([(None if t == EN + "!" else first_id + i, t, "en", "x", 1, 2, "y", "z", "f") for i, t in enumerate(texts)], CLASHING)


# --- quality classifier -----------------------------------------------------------------


def plain_words(text):
    """Runs of letters (with all bytes from 128 on), digits or marks."""
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[!-/:-@\[-`{-~]+", (text or "").encode())


def plain_hash(word):
    h = 0
    for i, b in enumerate(word):
        h = (h + (b + 1) * pow(classifier.BASE, i, 1 << 64)) % (1 << 64)
    return int(classifier.mixed(np.array([h], np.uint64))[0])


def plain_contexts(texts):
    sums = {}
    for text in texts:
        words = [plain_hash(w) for w in plain_words(text)]
        for i, w in enumerate(words):
            row = sums.setdefault(w >> (64 - classifier.ROW_BITS), [0] * (classifier.DIMS + 1))
            row[-1] += 1
            for j in range(max(0, i - classifier.REACH), min(len(words), i + classifier.REACH + 1)):
                places, signs = classifier.index_vectors(np.array([words[j]], np.uint64))
                for p, s in zip(places[0], signs[0]):
                    row[p] += int(s)
    return sums


def test_words_and_hashes_equal_a_plain_scan():
    texts = ["ab12!! ab", None, "", "abé ab\n--ab", "é", " x ", "7"]
    array = pa.array(["dropped", *texts])[1:]  # a slice with an offset
    hashes, parents = classifier.Words()(array)
    want = [(plain_hash(w), i) for i, t in enumerate(texts) for w in plain_words(t)]
    assert list(zip(hashes.tolist(), parents.tolist())) == want
    assert classifier.Words()(pa.array([None, ""], pa.string()))[0].size == 0


def test_context_sums_equal_a_plain_count_for_any_layout(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "c1", "d!!", "É"]) for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "a"]
    want = plain_contexts(texts)
    for parts in (1, 7, 80):  # 80 tasks meet in two rounds
        sums = classifier.context_sums(docs_of(spark, texts).repartition(parts))
        found = {i: row.tolist() for i, row in enumerate(sums) if row.any()}
        assert found == want


def test_pooling_equals_a_plain_mean_wherever_words_are_parted(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 50))) for _ in range(30)]
    words = classifier.Words()
    sums = np.zeros((1 << classifier.ROW_BITS, classifier.DIMS + 1), np.int64)
    classifier.add_contexts(sums, *words(pa.array(texts)))
    vectors = classifier.word_vectors(sums)
    whole = classifier.pooled(vectors, *words(pa.array(texts)), len(texts))
    for i, t in enumerate(texts):
        found = [vectors[plain_hash(w) >> (64 - classifier.ROW_BITS)].astype(float) for w in plain_words(t)]
        want = np.zeros(classifier.FEATURES)
        if found:
            v, w = np.array(found)[:, :-1], np.array(found)[:, -1:]
            mean = (v * w).sum(0) / w.sum()
            spread = np.sqrt(np.maximum((v * v * w).sum(0) / w.sum() - mean**2, 0))
            want = np.concatenate([mean, spread, (v[1:] * v[:-1]).sum(0) / len(v)])
        assert np.allclose(whole[i], want, atol=2e-3)
    monkeypatch.setattr(classifier, "WORDS_AT_ONCE", 7)
    assert np.allclose(classifier.pooled(vectors, *words(pa.array(texts)), len(texts)), whole, atol=1e-3)


def test_gradients_and_temperature():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, classifier.FEATURES)), (rng.random(30) > 0.4).astype(float)
    net = classifier.train(x, y)
    for w, g in zip(net.weights, net.gradients(x, y)):
        at = tuple(rng.integers(0, n) for n in w.shape)
        keep, step = w[at], 1e-5
        loss = []
        for d in (step, -step):
            w[at] = keep + d
            loss.append(classifier.log_loss(classifier.logistic(net.logits(x)), y))
        w[at] = keep
        assert math.isclose((loss[0] - loss[1]) / (2 * step), g[at], rel_tol=1e-4, abs_tol=1e-7)
    logits, labels = rng.normal(size=4000) * 3, np.zeros(4000)
    labels[rng.random(4000) < classifier.logistic(logits / 2.5)] = 1
    t = classifier.fitted_temperature(logits, labels)
    assert 2.0 < t < 3.2
    assert classifier.log_loss(classifier.logistic(logits / t), labels) <= classifier.log_loss(classifier.logistic(logits), labels)
    assert classifier.fitted_temperature(np.zeros(0), np.zeros(0)) == 1.0


def test_scores_of_odd_rows_and_without_labels(spark):
    labels = spark.createDataFrame([(0, 1, 0, "x"), (3, 0, 0, "x"), (4, 1, 0, "x"), (4, 1, 0, "x"), (5, 0, 0, "x"), (5, 1, 0, "x"), (None, 1, 0, "x"), (6, None, 0, "x")], "doc_id bigint, quality int, toxic int, score string")
    docs = docs_of(spark, [*ODD_TEXTS, EN + "!"])
    got = classifier.score_quality(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == got.count() == len(ODD_TEXTS) + 1 and None in rows
    for i, r in rows.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    assert rows[0]["score"] == rows[1]["score"] == rows[2]["score"]  # no words
    assert rows[4]["score"] == rows[5]["score"]  # equal texts
    assert {r["score"] for r in classifier.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.score_quality(docs.limit(0), labels).count() == 0


def test_label_sample_is_bounded_and_takes_no_held_out_row(spark):
    texts = [f"word{i} text" for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 1), (8, 1)], "doc_id bigint, quality int")
    features = spark.createDataFrame([(i % 60, i, i, np.full(classifier.FEATURES, i % 60, "<f4").tobytes()) for i in range(120)], "_id bigint, _k1 bigint, _k2 bigint, _features binary")
    x, y = classifier.labelled_sample(features, labels, "_id", 20)
    assert len(x) == len(y) == 20 and len(texts) == 60
    ids = x[:, 0].astype(int)
    assert len(set(ids)) == 20 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert (y == ids % 2).all()
    x, y = classifier.labelled_sample(features, labels, "_id")
    assert 8 not in x[:, 0]  # labelled both ways


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.score_quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    pairs = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert right > 0.9 and pairs > 0.95


# --- alignment --------------------------------------------------------------------------


def plain_alignment(rows):
    """Counts and groups by walking both token lists."""
    first = Tokenizer.from_file(public_tokenizers.path(align.BYTE_VOCABULARY))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.PIECE_VOCABULARY))
    letters = {c: b for b, c in enumerate(bpe.byte_letters())}
    spelt = {i: t for t, i in first.get_vocab().items()}

    def piece_bytes(i):
        p = second.id_to_piece(i)
        found = re.fullmatch("<0x([0-9A-F]{2})>", p)
        return bytes([int(found[1], 16)]) if found else p.replace("▁", " ").encode()

    out, counts = [], Counter()
    for i, text in rows:
        want = (" " + text).encode() if text else b""
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a, bytes_b = [bytes(letters[c] for c in spelt[x]) for x in a], [piece_bytes(x) for x in b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            a, b, bytes_a, bytes_b = [], [], [], []
        links, groups, own = [], [], ([], [])
        x = y = end_a = end_b = 0
        while x < len(a):
            links.append((a[x], b[y]))
            more_a, more_b = end_a + len(bytes_a[x]), end_b + len(bytes_b[y])
            if more_a <= more_b:
                own[0].append(a[x])
                x, end_a = x + 1, more_a
            if more_b <= more_a:
                own[1].append(b[y])
                y, end_b = y + 1, more_b
            if more_a == more_b:
                groups.append("|".join(",".join(map(str, o)) for o in own))
                own = ([], [])
        counts.update(links)
        out.append((i, len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, second_id), n in counts.items():
        best[second_id] = max(best[second_id], n)
    return [(i, na, nb, g, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), text) for i, na, nb, g, links, text in out]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_alignment_equals_a_walk_over_both_lists(spark, monkeypatch):
    rng = random.Random(4)
    letters = ["a", "e", "n", "th", "ing", " ", " ", "  ", "\n", "\t", "é", "中", "\U0001f600", "7", "'s", "!!", " ", "<s>", "▁"]
    texts = [*ODD_TEXTS, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(150))]
    want = sorted(plain_alignment(list(enumerate(texts))))
    monkeypatch.setattr(align, "CHUNK_ROWS", 200)
    monkeypatch.setattr(align, "STEP_BYTES", 2_000)
    for parts in (1, 5):
        out = align.align(docs_of(spark, texts).repartition(parts))
        assert [c for c in out.columns if c not in COLUMNS] == ["lang", "_text", "_chunk", "_row", "score", "features"]
        assert sorted(tuple(r[c] for c in COLUMNS) for r in out.collect()) == want
    digests = {r["doc_id"]: r["groups"] for r in align.align(docs_of(spark, texts), digest=True).collect()}
    assert digests == {r[0]: hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in want}


def test_alignment_of_an_empty_table_and_repeated_rows(spark):
    assert align.align(docs_of(spark, ODD_TEXTS).limit(0)).count() == 0
    twice = docs_of(spark, [EN, EN + "!"])
    rows = align.align(twice.unionAll(twice)).collect()
    assert sorted(Counter(r["doc_id"] for r in rows).values()) == [2, 2]
    assert {r["n_best"] <= r["n_links"] for r in rows} == {True}
    nothing = align.align(docs_of(spark, [None, ""])).collect()
    assert [tuple(r[c] for c in COLUMNS[1:]) for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_long_texts_are_cut_where_no_token_changes():
    both = align.sides(public_tokenizers.path(align.BYTE_VOCABULARY), public_tokenizers.path(align.PIECE_VOCABULARY))
    rng = random.Random(5)
    text = "".join(rng.choice(["word", "an", " ", " ", "  ", ". ", "é ", "7 ", " 中 ", "\n "]) for _ in range(4_000))
    pieces = align.pieces_of(text, 500)
    assert len(pieces) > 5 and " ".join(pieces) == text
    joined = [i for p in pieces for i in both.first_ids(" " + p, False)]
    assert joined == both.first_ids(" " + text, False) == both.first_ids(" " + text, True)
    assert [i for p in both.second_ids(pieces) for i in p] == both.second_ids([text])[0]
    assert align.pieces_of("x" * 3_000, 500) == ["x" * 3_000]


# --- vector codes -----------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    whole = [(i, label, [math.floor(codes.SCALE * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not whole:
        return []
    width = len(whole[0][2]) // parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    named = sorted((r for r in whole if r[0] is not None), key=lambda r: (r[0], r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in named] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda x, book: min((apart(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, _, v in whole:
                members.setdefault(pick(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k])) if k in members else e for k, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = []
    for i, label, v in whole:
        picked = [pick(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, label, "".join(f"{k:02x}" for _, k in picked), sum(d for d, _ in picked)))
    total = Counter()
    for _, label, _, error in coded:
        total[label] += error
    return [(i, code, error, total[label], digest) for i, label, code, error in coded]


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, _v int, error string"


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, "e") for i, v, label in rows], VECTORS)


@pytest.mark.parametrize(("dims", "values"), [(16, 3), (32, 40), (64, 5)])
def test_codes_equal_a_plain_search(spark, monkeypatch, dims, values):
    rng = random.Random(dims)
    vector = lambda: [rng.randint(-values, values) / 100 for _ in range(dims)]
    rows = [(i, vector(), rng.choice([None, 0, 1])) for i in range(150, 0, -1)]
    rows += [(500, rows[0][1], 1)] * 40 + [(7, vector(), None), (None, vector(), 2), (600, None, 1), (601, vector()[:-1] + [float("nan")], 1)]
    rows += [(602, vector()[:-1] + [None], 1), (0, [float("inf")] + vector()[1:], 1)]
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = sorted(plain_codes(floats), key=repr)
    monkeypatch.setattr(codes, "NODES", 5)
    for parts in (1, 6):
        got = codes.compress(vector_rows(spark, rows).repartition(parts))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_the_trie_shares_prefixes_and_ties_take_the_first_entry():
    parts = np.array([[1, 2], [1, 2], [0, 5], [1, 3]])
    trie = codes.trie_of(parts)
    assert trie.parts.tolist() == [[0, 5], [1, 2], [1, 3]] and trie.weight.tolist() == [1, 2, 1]
    assert [s.tolist() for s in trie.starts] == [[0, 1], [0, 1, 2]] and trie.inverse.tolist() == [1, 1, 0, 2]
    index, distance = codes.nearest(trie, np.array([[1, 1], [1, 3], [9, 9], [1, 1]]))
    assert index.tolist() == [1, 0, 1] and distance.tolist() == [5, 1, 0]
    assert codes.entry_sums(trie, index, 4).tolist() == [[2, 2, 4], [2, 1, 8], [0, 0, 0], [0, 0, 0]]


def test_codes_of_few_odd_and_no_vectors(spark):
    few = [(3, [0.5] * 16, 1), (2, [-0.5] * 16, None), (9, [0.25] * 32, 1), (8, [], 1), (10, [1.0] * 3, 1)]
    got = codes.compress(vector_rows(spark, few)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == [(2, "00" * 16, 0, 0), (3, "01" * 16, 0, 0)]
    assert codes.compress(vector_rows(spark, [(1, None, 1), (None, [1.0] * 16, 1)])).count() == 0
    assert codes.compress(vector_rows(spark, few).limit(0)).count() == 0
    assert codes.whole(np.array([-0.001, 0.0, 0.0039, 0.00390625])).tolist() == [-1, 0, 0, 1]
    with pytest.raises(ValueError):
        codes.whole(np.array([1e30]))


# --- lanes of the language model ----------------------------------------------------------


def test_a_long_text_takes_lanes_in_proportion():
    from chatloom.llm import gru, lm

    counts = np.arange(1, 41)[::-1].astype(float)
    layout = lm.lay_out([b"%d" % i for i in range(40)], counts, np.zeros(40, int), 3000)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 41, 200_000), *(rng.integers(0, 41, 20) for _ in range(1_000))]
    inputs, targets, begins, used, places = gru.lanes_of(texts, gru.SCORE_LANES, layout)
    assert inputs.nbytes + targets.nbytes + begins.nbytes < 10_000_000
    assert used.sum() == 220_000 and (targets >= 0).sum() == 220_000
    for (lane, at), t in zip(places, texts):
        assert (targets[at : at + len(t), lane] == t).all() and begins[at, lane]
    even = [rng.integers(0, 41, 50) for _ in range(2_000)]
    assert gru.lanes_of(even, gru.SCORE_LANES, layout)[0].shape[1] == gru.SCORE_LANES


# --- work of the language model's training ------------------------------------------------


def test_rows_that_rest_cost_nothing_and_end_like_plain_adam(monkeypatch):
    from chatloom.llm import gru

    rng = np.random.default_rng(7)
    start = rng.normal(0, 0.1, (40, 6))
    rows, plain = gru.Rows(start.copy()), start.copy()
    mean, square = np.zeros_like(plain), np.zeros_like(plain)
    sizes, adam = [], gru.adam
    monkeypatch.setattr(gru, "adam", lambda g, *rest: sizes.append(g.size) or adam(g, *rest))
    for t in range(1, 200):
        step = 0.015 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        used = np.unique(rng.integers(0, 8 if t % 9 else 38, 3))  # some rows rest for long, two for ever
        g = np.zeros_like(plain)
        g[used] = rng.normal(0, 1, (len(used), 6))
        rows.need(used)
        assert np.allclose(rows.p[used], plain[used], atol=1e-6)
        rows.grad[used] = g[used]
        rows.update(0.5, step)
        g *= 0.5
        mean += 0.1 * (g - mean)
        square += 0.001 * (g * g - square)
        plain -= step * mean / (np.sqrt(square) + 1e-8)
    rows.make_up(np.arange(40))
    assert np.allclose(rows.p, plain, atol=1e-6) and (rows.p[38:] == start[38:]).all()
    assert not rows.grad.any() and max(sizes) <= 3 * 6


def test_output_in_groups_matches_target_by_target():
    from chatloom.llm import gru, lm

    rng = np.random.default_rng(8)
    counts = np.sort(rng.integers(1, 500, 1500).astype(float))[::-1]
    layout = lm.lay_out([b"%d" % i for i in range(1500)], counts, rng.integers(0, lm.TOPICS + 1, 1500), int(counts.sum()) + 300)
    p = {k: v + rng.normal(0, 0.2, v.shape) for k, v in gru.initial(layout).items()}
    h, targets = rng.uniform(-1, 1, (1300, gru.HIDDEN)), rng.integers(0, 1501, 1300)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    logs, dh = gru.output_logs(p, layout, h, targets, grad)
    want = {k: np.zeros_like(v) for k, v in p.items()}
    for i, t in enumerate(targets):
        state, log, back = np.append(h[i], 1), layout.within[t], np.zeros(gru.HIDDEN)
        steps = [("classes", 0, layout.word_class[t])]
        if layout.place[t] >= 0:
            steps.append(("words", layout.word_class[t], layout.place[t]))
        for name, group, hit in steps:
            e = np.exp(state @ p[name][group])
            log += np.log(e[hit] / e.sum())
            d = e / e.sum()
            d[hit] -= 1
            want[name][group] += np.outer(state, d)
            back += p[name][group, :-1] @ d
        assert abs(log - logs[i]) < 1e-9 and np.allclose(back, dh[i])
    assert all(np.allclose(grad[k], want[k]) for k in p)
    assert len(gru.output_logs(p, layout, h[:0], targets[:0], grad)[0]) == 0
