"""Small tests of the corpus operators: edge cases, and plain versions of what SQL can't express."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from chatloom.llm import bpe, catalog, chat, decontaminate, frames, gru, langid, licenses, lm, near, quality, urls

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables not present")

SCHEMA = "doc_id bigint, text string, lang string, _k1 string, _text string, kept int, n_words string, score string, ids string"
EN = "the quick brown fox jumps over the lazy dog and then runs away from the old barn near the river in the morning light of day"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann weg von der alten scheune nahe dem fluss am morgen"


def docs_of(spark, rows):
    """(doc_id, text, lang) with columns whose names clash with internal ones."""
    return spark.createDataFrame([(*r, "x", "y", 1, "z", "s", "i") for r in rows], SCHEMA)


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", "en"), (4, "!!! 123", "en"), (5, EN, "en"), (6, EN, "en"), (7, DE, "de"), (7, DE, "de"),
    (None, EN + " again", "en"), (8, "word " * 30_000, None), (9, "\u00e9\u00df\u4e2d\U0001f600 <|endoftext|>", None),
]


def by_id(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- decontamination -------------------------------------------------------------------


def plain_hits(text, items):
    split = lambda t: [w for w in __import__("re").findall(decontaminate.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        n = min(len(own), 13)
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for s in range(len(words) - n + 1) if n else ():
            if tuple(words[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                found.add(item)
    return len(words), len(hit), sorted(found)


def test_decontamination_equals_every_window(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [("a", text(40)), ("b", text(13)), ("c", text(5)), ("c", text(1) + " É"), ("d", ""), ("e", None), (None, text(14)), ("r", "x " * 30)]
    rows = list(ODD) + [(20 + i, f"{text(30)}. {(items[i % 3][1])}, {text(rng.randint(0, 60))}", "en") for i in range(12)]
    rows += [(40, "X x " * 200, "en"), (41, " ".join(items[0][1].split()[:12]), "en"), (42, items[0][1].upper(), "en")]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id string, text string, _w string")
    got = by_id(decontaminate.decontaminate(docs_of(spark, rows), bench), "doc_id", "n_words", "n_hit", "item_ids", "contaminated")
    named = [(i or "", t) for i, t in items]
    want = []
    for doc_id, t, _ in rows:
        n, hit, found = plain_hits(t, named)
        want.append((doc_id, n, hit, found, hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=repr)


def test_decontamination_of_empty_tables(spark):
    docs, bench = docs_of(spark, ODD), spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, bench).collect())
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.keep_clean(docs, bench).count() == len(ODD)


# --- quality ----------------------------------------------------------------------------


def test_repeated_words_equal_a_plain_count():
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {p for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
        assert quality.repeated_words(words) == len(covered)


def test_statistics_of_texts():
    n, chars, symbols, dup_lines, repeat = quality.statistics("a#b c\u00a0d\n\na#b c\u00a0d\n \t\nx")[:5]
    assert (n, chars, symbols, dup_lines, repeat) == (5, 13, 2, 1, 0)
    assert quality.statistics(None) == quality.statistics(" \n") == (0,) * 5 + (0.0,) * len(quality.SHARES)


def test_forest_isolates_what_is_far():
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.01, (500, 3)), [[5.0, 5, 5]]])
    scores = quality.grow(x).scores(x)
    assert scores.argmax() == 500 and scores[500] > 0.7
    assert quality.grow(np.zeros((0, 2))).scores(np.zeros((1, 2))).shape == (1,)


def test_quality_keeps_good_and_rejects_junk(spark):
    rng = random.Random(1)
    good = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(60)) + ".", "en") for i in range(80)]
    junk = [(100 + i, " ".join(f"W{rng.randint(0, 500)}$$$!!" for _ in range(60)), "en") for i in range(20)]
    docs = docs_of(spark, good + junk + ODD[:5])
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _, _ in good + junk] + [(None, 1), (1, None)], "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in quality.judge_quality(docs, labels).where("kept").collect()}
    assert set(range(6, 80)) <= kept and not kept & set(range(100, 120))
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == kept
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.judge_quality(docs, labels.limit(0)).where("base_failed = kept").count() == 0  # no labels: the base rules alone
    assert quality.judge_quality(docs.limit(0), labels).count() == 0


# --- language ---------------------------------------------------------------------------


def test_language_of_odd_texts(spark):
    docs = docs_of(spark, ODD + [(30 + i, (EN, DE)[i % 2], ("en", "de")[i % 2]) for i in range(8)])
    out = langid.identify(docs).collect()
    assert len(out) == len(ODD) + 8
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2)
        if r["doc_id"] in (1, 2, 3, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] in (5, 6, 7):
            assert r["lang_pred"] == ("de" if r["doc_id"] == 7 else "en") and 0.5 < r["score"] <= 1
    assert {r["lang_pred"] for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
    assert langid.keep_known(docs).columns == docs.columns


def plain_language(train, texts):
    """The same scores with nothing but dictionaries."""
    split = lambda t: __import__("re").findall(r"[^\W\d_]+", (t or "").lower())
    cut = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    words, pieces = {}, {}
    for text, lang in train:
        for w in split(text):
            words.setdefault(lang, Counter())[w] += 1
            for n in range(1, 5):
                pieces.setdefault(lang, Counter()).update(cut(w, n))
    langs = sorted(words)

    def logs(counts, item):
        kinds = max(map(len, counts.values()))
        return [math.log(counts[x][item] + 0.5) - math.log(sum(counts[x].values()) + 0.5 * kinds) for x in langs]

    def cover(w):
        todo, found = cut(w, min(4, len(w) + 2)), []
        while todo:
            shorter = []
            for g in todo:
                if any(pieces[x][g] for x in langs):
                    found.append(g)
                elif len(g) > 1:
                    shorter += [g[:-1], g[1:]]
            todo = list(dict.fromkeys(shorter))
        return found

    out = []
    for text in texts:
        found = split(text)
        if not any(c.isalpha() for w in found for c in w) or not langs:
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(langs)
        for w, n in Counter(found).items():
            if any(words[x][w] for x in langs):
                own = [logs(words, w)]
            else:
                own = [logs(pieces, g) for g in cover(w)]
            for v in own:
                total = [t + n * x / len(own) for t, x in zip(total, v)]
        share = [math.exp((t - max(total)) / math.sqrt(len(found))) for t in total]
        best = max(range(len(langs)), key=lambda j: (share[j], -j))
        out.append((langs[best], share[best] / sum(share)))
    return out


@pytest.mark.parametrize(("bound", "chunk"), [(0, 3), (10, 10**6), (10**6, 5)])
def test_language_equals_a_plain_model_whatever_the_tasks_hold(spark, monkeypatch, bound, chunk):
    rng = random.Random(8)
    alphabet = {"en": "abcdeth", "de": "abcdeüß", "fr": "abcdeéx"}
    make = lambda lang: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12)))
    rows = [(i, make(lang), lang if i % 7 else None) for i in range(90) for lang in (rng.choice(list(alphabet)),)] + list(ODD)
    train = [(t, x) for i, t, x in rows if t is not None and x is not None and zlib.crc32(str(i if i is not None else "").encode()) % 4 != 2]
    monkeypatch.setattr(langid, "CHUNK_WORDS", chunk)
    docs = docs_of(spark, rows).repartition(3)
    fitted = langid.fit_languages(docs.where(~langid.held_out("doc_id")), max_words=bound, max_grams=bound)
    assert len(fitted.model.words) <= bound and fitted.word_table.count() > 50
    got = langid.with_language(docs.select("doc_id", "_k1", "text"), fitted)
    assert got.columns == ["doc_id", "_k1", "lang_pred", "score"]
    want = [(i, *said) for (i, _, _), said in zip(rows, plain_language(train, [t for _, t, _ in rows]))]
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    found = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()), key=key)
    assert [key(r) for r in found] == [key(r) for r in sorted(want, key=key)]


def test_known_languages_keep_whole_rows(spark):
    rows = [(i, (EN, DE)[i % 2], ("en", "de")[i % 2]) for i in range(20)] + [(50, None, "en"), (51, "123", "en"), (3, DE, "de"), (None, EN, None)]
    kept = langid.keep_known(docs_of(spark, rows))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t, _ in rows if t and t != "123")
    assert langid.keep_known(docs_of(spark, rows).limit(0)).count() == 0


@needs_data
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert out and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.9


# --- licenses, URLs ---------------------------------------------------------------------


def test_licenses_of_odd_texts(spark):
    notice = licenses.NOTICES
    rows = ODD + [(50, f"{EN} {notice['mit']} {EN}", "en"), (51, (notice["apache-2.0"] + "\n" + notice["gpl-3.0"]).upper(), "en"),
                  (52, "licensed under the apache", "en")]
    out = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert out[50] == ["mit"] and out[51] == ["apache-2.0", "gpl-3.0"] and out[52] == [] and out[1] == []
    assert licenses.scan_licenses(docs_of(spark, ODD).limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs_of(spark, ODD), {"short": "two words"})


def test_urls_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.ORG/es/1?x#y"), (5, "https://x.org"), (6, "https://x.org/a://b"),
            (7, "https://example.org/en/12"), (8, "https://notorg/fr/"), (9, "https://a.com/de/x"), (9, "https://a.com/de/x")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, host string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    assert out[1][:3] == out[2][:3] == out[3][:3] == ("", "", None)
    assert out[4] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert out[5][:3] == ("x.org", "", None) and out[6][2:] == ("org/", "allow")
    assert out[7][2:] == ("example.org/en/1", "block") and out[8][2] is None and out[9][2:] == ("com/de/", "block")
    assert urls.judge_urls(pages).count() == len(rows)
    assert urls.judge_urls(pages.limit(0)).count() == 0


# --- tokens -----------------------------------------------------------------------------


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = [*"abc'sdtre lm  \n\t\r\x1c\x85\xa0\u3000\u00e9\u00df\u00f1\u00bd\u0663\u4e2d\U0001f600\u0300\u200b\x00\u0130", "<|endoftext|>", "'re", "aaa"]
    return [None, "", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)), "a" * 5000]


def test_byte_pairs_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    texts = odd_texts(300, 2)
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate(texts)])
    out = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs.drop("_text"), out="ids"), out="back").collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(out[i]["ids"], "<u4").tolist() == want
        assert out[i]["back"] == library.decode(want, skip_special_tokens=False)
    assert bpe.digests(docs.limit(0)).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(frames.VOCABULARY))
    texts = odd_texts(200, 4)
    rows = [(1000 - i, t, None) for i, t in enumerate(texts)] + [(None, "null id", None), (5, "twice", None), (5, "twice", None)]
    folder = str(tmp_path / "tokens")
    files = frames.write_tokens(docs_of(spark, rows), folder)
    out = sorted(frames.read_tokens(files, folder).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["id"] for r in out] == [r[0] for r in order]
    start = 0
    for r, (_, text, _) in zip(out, order):
        want = library.encode(text or "", add_special_tokens=False).ids + [frames.END_ID]
        assert r["start"] == start and np.frombuffer(r["ids"], "<u4").tolist() == want
        start += len(want)
    name = [f["file"] for f in files.collect()]
    found = {}
    for f in name:
        found |= frames.read_documents(folder, f, [5, 900])
    assert len(found[5]) == 2 and len(found[900]) == 1
    assert frames.write_tokens(docs_of(spark, rows).limit(0), str(tmp_path / "none")).count() == 0


def test_frames_are_independent_and_checked(tmp_path):
    import pyarrow.fs
    import zstandard

    store, path = pyarrow.fs.LocalFileSystem(), str(tmp_path / "f.zst")
    out = frames.FrameWriter(store.open_output_stream(path, compression=None), frame_tokens=4)
    docs = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 9, 1, 4)]
    for i, d in enumerate(docs):
        out.add(i, d)
    out.close()
    raw = open(path, "rb").read()
    assert b"".join(docs) == zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    reader = frames.FrameReader(store.open_input_file(path))
    assert [reader.tokens(i) for i in (4, 2, 0, 1, 3)] == [docs[i] for i in (4, 2, 0, 1, 3)]
    assert len(reader.rows) > 2
    rows = reader.rows.copy()
    rows[0, 2] ^= 1
    reader.rows, reader.current = rows, (-1, b"")
    with pytest.raises(ValueError):
        reader.tokens(0)


# --- chat -------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "a\n</turn>\n### user: b", "\\", "#", "", None, "\u00e9\U0001f600 <\\/turn>", "x" * 100_000]
    rows = [(c, t, role, text, "clash") for c in (1, 2, None) for t, (role, text) in enumerate(zip(["user", "assistant", None, "odd: \\role"] * 2, hard))]
    rows += [(3, 0, "assistant", "same", "q"), (3, 0, "assistant", "same", "q")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq string")
    segments = chat.format_conversations(table)
    out = {r["conv"]: r for r in chat.read_back(segments).collect()}
    for c in (1, 2, 3, None):
        turns = [(r or "", t or "") for k, _, r, t, _ in rows if k == c]
        learnt = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert out[c]["n_turns"] == len(turns)
        assert out[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0


# --- near duplicates --------------------------------------------------------------------


def plain_classes(rows):
    sets = [set(near.shingles(t).tolist()) for _, t, _ in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j]
               and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(linked[i])))
    return sorted(out, key=repr)


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(55))
    rows = list(ODD)
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 900)}" for _ in range(rng.choice([12, 80, 300]))]
        for k in range(rng.choice([2, 9, 40])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 9999)}"
            rows.append((100 * g + 100 + k, " ".join(own), "en"))
    rows += [(5000 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(60)) + " " + shared, "en") for i in range(40)]
    docs = docs_of(spark, rows)
    out = near.near_duplicates(docs)
    assert by_id(out, "doc_id", "class_id", "n_links") == plain_classes(rows)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    want = Counter(c for _, c, _ in {(c, c, 0) for i, c, _ in plain_classes(rows) if i not in (1, 2, 3)})
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == want + Counter({1: 1, 2: 1, 3: 1})
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_and_parts_find_the_same(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(120)] = f"e{k}x{rng.randint(0, 9999)}"
        rows.append((k, " ".join(own), "en"))
    monkeypatch.setattr(near, "BLOCK_SETS", 7)
    monkeypatch.setattr(near, "PART", 10)
    out = near.near_duplicates(docs_of(spark, rows))
    assert by_id(out, "doc_id", "class_id", "n_links") == plain_classes(rows)


def test_recall_of_the_whole_search_on_large_families(spark):
    """Ids divisible by 20 against all rows: families whose members differ more and more, short texts among them."""
    rng = random.Random(12)
    rows = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range((25, 60, 120, 300)[family])]
        own = list(base)
        for _ in range(150):
            if rng.random() < 0.3:
                own = list(base)
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 10**6)}"  # the next is a copy of this one with another change
            rows.append((len(rows), " ".join(own), "en"))
    rows += [(len(rows) + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(9)) + " the same end of many texts here", "en") for i in range(200)]
    want = {i: n for i, _, n in plain_classes(rows)}
    got = {r["doc_id"]: r["n_linked_sets"] for r in near.near_duplicates(docs_of(spark, rows)).collect()}
    asked = [i for i, _, _ in rows if i % 20 == 0]
    links = sum(want[i] for i in asked)
    assert links > 100 and all(got[i] <= want[i] for i in asked)
    assert sum(got[i] for i in asked) >= 0.99 * links


def test_small_buckets_tie_all_that_are_alike(spark):
    """A set that resembles two others which don't resemble each other ties both, whatever the order."""
    marks = np.random.default_rng(3).integers(1, 250, (3, near.BINS)).astype(np.uint8)
    marks[1, : near.BINS // 2] = marks[0, : near.BINS // 2]
    marks[1, near.BINS // 2 :] = marks[2, near.BINS // 2 :]
    rows = [(path, 1, path < 100, i, bytearray(m.tobytes())) for path in range(200) for i, m in enumerate(marks)]
    frame = spark.createDataFrame(rows, "path bigint, parts bigint, _brute boolean, _set bigint, _sketch binary")
    out = near.lead(frame, "0L", 0.45).where("b is not null").collect()
    ties = Counter(r["path"] for r in out)
    assert all(ties[p] == 2 for p in range(100))  # both ties in every order
    assert any(ties[p] == 1 for p in range(100, 200))  # leaders alone lose one in some orders


def test_runs_reach_the_recall():
    assert 1 - (1 - near.meeting(near.LEVELS)) ** near.runs_for(0.999) >= 0.999


# --- language model ---------------------------------------------------------------------


def test_network_gradients():
    rng = np.random.default_rng(0)
    words = [str(i).encode() for i in range(60)]
    counts = np.sort(rng.integers(1, 50, 60).astype(float))[::-1]
    old = lm.LEARNT_CLASSES, lm.CLASS_WORDS
    lm.LEARNT_CLASSES, lm.CLASS_WORDS = 4, 5
    try:
        layout = lm.lay_out(words, counts, rng.integers(0, 3, 60), 5000)
    finally:
        lm.LEARNT_CLASSES, lm.CLASS_WORDS = old
    p = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float64) for k, v in gru.initial(layout).items()}
    texts = [rng.integers(0, 61, n) for n in (5, 9, 3)]
    x, y, b, used, _ = gru.lanes_of(texts, 2, layout)
    real = y >= 0

    def loss():
        out, _, _ = gru.forward(p, x, b, np.zeros((x.shape[1], gru.HIDDEN)), False)
        return -gru.output_logs(p, layout, out[real], y[real])[0].sum()

    grad = {k: np.zeros_like(v) for k, v in p.items()}
    out, _, kept = gru.forward(p, x, b, np.zeros((x.shape[1], gru.HIDDEN)), True)
    _, dh = gru.output_logs(p, layout, out[real], y[real], grad)
    dh_out = np.zeros_like(out)
    dh_out[real] = dh
    gru.backward(p, x, b, kept, dh_out, grad)
    for k in p:
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            at, eps = p[k][i], 1e-2
            p[k][i] = at + eps
            up = loss()
            p[k][i] = at - eps
            down = loss()
            p[k][i] = at
            assert abs((up - down) / (2 * eps) - grad[k][i]) < 0.02 * max(1, abs(grad[k][i]))


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    words = [str(i).encode() for i in range(1500)]
    counts = np.sort(rng.integers(1, 500, 1500).astype(float))[::-1]
    layout = lm.lay_out(words, counts, rng.integers(0, lm.TOPICS + 1, 1500), int(counts.sum()) + 300)
    p = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in gru.initial(layout).items()}
    h = np.repeat(rng.normal(0, 1, (1, gru.HIDDEN)).astype(np.float32), 1501, 0)
    logs, _ = gru.output_logs(p, layout, h, np.arange(1501))
    assert abs(np.exp(logs).sum() - 1) < 1e-3


def test_state_is_carried_and_texts_are_independent():
    rng = np.random.default_rng(2)
    counts = np.sort(rng.integers(1, 50, 40).astype(float))[::-1]
    layout = lm.lay_out([b"%d" % i for i in range(40)], counts, np.zeros(40, int), 3000)
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in gru.initial(layout).items()}
    texts = [rng.integers(0, 41, n) for n in (1, 200, 37, 80, 3)]
    alone = [gru.score(p, layout, [t])[0] for t in texts]
    assert np.allclose(gru.score(p, layout, texts), alone, rtol=1e-4)
    one, two = gru.score(p, layout, [np.append(texts[1][:100], texts[2])])[0], gru.score(p, layout, [texts[1][:100]])[0]
    assert abs(one - two - gru.score(p, layout, [texts[2]])[0]) > 1e-3  # what follows depends on what was


def test_every_training_token_gives_a_gradient():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 50, 40).astype(float))[::-1]
    layout = lm.lay_out([b"%d" % i for i in range(40)], counts, np.zeros(40, int), 3000)
    texts = [rng.integers(0, 41, n) for n in (1, 900, 37, 16, 333)]
    trainer = gru.Trainer(gru.initial(layout), layout)
    trainer.learn(texts)
    assert trainer.weight == sum(map(len, texts))


def test_learnt_words_grow_with_the_vocabulary():
    learnt = []
    for n in (500, 1500, 40_000, 100_000):
        counts = np.sort(np.random.default_rng(4).integers(3, 500, n).astype(float))[::-1]
        layout = lm.lay_out([b"%d" % i for i in range(n)], counts, np.zeros(n, int), int(counts.sum()))
        learnt.append(int((layout.place >= 0).sum()))
        assert len(np.unique(layout.read_as[:-1][layout.place[:-1] >= 0])) == learnt[-1]
    assert learnt == [500, 1500, 200 * 64, 316 * 64]


def test_mean_of_copies_does_not_depend_on_their_order():
    rng = np.random.default_rng(5)
    x, weight = rng.normal(0, 20, (50, 7)).astype(np.float32), rng.integers(1, 1 << 40, 50)
    means = []
    for order in (np.arange(50), np.arange(50)[::-1]):
        table = lm.pa.table({"start": [0] * 50, "weight": weight[order], "x": lm.pa.array(list(x[order]), lm.pa.list_(lm.pa.float32()))})
        means.append(lm.mean_block(table)["x"][0].as_py())
    assert means[0] == means[1] and np.allclose(means[0], weight @ x.astype(np.float64) / weight.sum(), atol=1e-6)


def plain_base(rows):
    split = [lm.tokens(t) for _, t, _ in rows]
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _, _ in rows]
    c = Counter(w for words, h in zip(split, held) if not h for w in words)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
            for (i, _, _), w, h in zip(rows, split, held)]


def test_scores_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 12)  # most words are rare, so that the join with the counts matters
    rows = ODD + [(60 + i, f"{EN} only{i}", "en") for i in range(12)]
    out = lm.score_texts(docs_of(spark, rows)).collect()
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out), key=key)
    for g, w in zip(got, sorted(plain_base(rows), key=key)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert lm.score_texts(docs_of(spark, rows).limit(0)).count() == 0


def test_rare_words_only(spark, monkeypatch):
    """Without any frequent word the score is the class and the count of each rare word."""
    out = lm.score_texts(docs_of(spark, [(2, "a b", None)])).collect()  # held out or not, nothing else to learn from
    assert len(out) == 1 and math.isfinite(out[0]["score"])


@needs_data
def test_model_beats_its_base_on_held_out_texts(spark):
    out = lm.score_texts(spark.read.parquet(f"{SMALL}/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


# --- registered queries -----------------------------------------------------------------


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in catalog.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())


@needs_data
def test_pipeline_stages_keep_columns_and_work_on_what_is_left(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "byte_pairs":
            assert out.columns == docs.columns
            left = {r["doc_id"] for r in out.select("doc_id").collect()}
            assert left <= ids
            ids, docs = left, docs.where(docs.doc_id.isin(sorted(left)))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids
