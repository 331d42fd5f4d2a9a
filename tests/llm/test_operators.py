"""The training-data operators against brute force, on small tables with every odd case."""

import base64
import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import bpe, forest, langid, minmax, packing, pretok, quality_model, quality_rules, token_counts, token_store, toxicity
from mnemora.llm.components import components
from mnemora.llm.library import LibraryEncoder
from mnemora.llm.runtime import tokenizer_path
from tests.llm.brute import Forest

JSON, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, label string, digest string, kept boolean"


def rows_of(texts):
    return [(i, t, "en", "s", 0, 1, "x", "y", True) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = list("ab '\t\n stmdrvel1٣!?é漢🙂\x85\r") + ["'s", "'re", " it's", "<|endoftext|>", "  ", " the", " and"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(60)) for _ in range(8)]
    for b in base:
        words = b.split()
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = "zz" + str(rng.randint(0, 9))
            out.append(" ".join(w))
    return out + [None, "", " \n ", "one", "ONE", "two words", "two  WORDS", "word " * 3000, "x" * 5000, *base, *base]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_bpe_matches_tiktoken(spark, docs, texts):
    import public_tokenizers as P
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.roundtrip_digests(docs, RANKS))
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    full = bpe.encode_documents(docs, RANKS)
    own = bpe.codec(RANKS)
    for r in full.limit(40).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert own.decode_range(np.array(r["ids"]), np.array(r["offsets"]), 3, 17) == raw[3:17]
    assert all((r["content"] or b"") == (texts[r["doc_id"]] or "").encode() for r in bpe.decode_documents(full, RANKS).collect())


def test_pretok_every_code_point_as_regex():
    import public_tokenizers as P
    import regex

    pattern = regex.compile(P.PATTERN)
    rng = random.Random(1)
    some = [chr(c) for c in (*range(0x3000), *range(0x1F300, 0x1F700)) if (unicode_known(c))]
    for _ in range(300):
        t = "".join(rng.choice(some + [" "] * 400 + ["'s", "'ll"] * 50) for _ in range(50))
        assert [p.decode() for p in pretok.split([t])[0]] == pattern.findall(t)


def unicode_known(c):
    import unicodedata

    return unicodedata.category(chr(c)) not in ("Cn", "Cs")


def test_long_texts_in_segments(monkeypatch, texts):
    from mnemora.llm import words

    whole = bpe.ByteBPE(RANKS).encode([t or "" for t in texts])
    monkeypatch.setattr(words, "BLOCK_CHARS", 23)
    assert bpe.ByteBPE(RANKS).encode([t or "" for t in texts]) == whole


def test_full_caches_and_long_pieces(monkeypatch, texts, library):
    from mnemora.llm import words

    monkeypatch.setattr(words, "KEPT_BYTES", 40)
    own = LibraryEncoder(JSON, 60)
    for part in range(0, len(texts), 7):  # blocks of fewer pieces than the cache holds, and of more
        got = own.encode([t or "" for t in texts[part : part + 7]])
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == library[part : part + 7]
    odd = ["", "\0", "\0\0", "a\0b" * 9, "é" * 8, "é" * 9, "x" * 16, "x" * 17, "x" * 300, "ab" * 700]
    assert [len(x) // 4 for x in own.encode(odd)] == [len(own.tokenizer.encode(x, add_special_tokens=False).ids) for x in odd]


def test_segments_start_tokens():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ab1٣ \t\n'.!é漢s") for _ in range(rng.randint(0, 400)))
        for limit in (8, 20, 64):
            parts = pretok.segments(t, limit)
            assert "".join(parts) == t and [p for x in parts for p in pretok.split([x])[0]] == pretok.split([t])[0]
    assert max(map(len, pretok.segments("aB9+/x" * 5000, 1000))) <= 1000


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_store(spark, docs, texts, library, encoding, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, JSON, 2, encoding)
    got = by_id(token_store.checksums(token_store.read_tokens(spark, path)))
    start = 0
    for i in range(len(texts)):
        ids = [*library[i], 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    part = token_store.read_tokens(spark, path, 5, 9).orderBy("doc_id").collect()
    assert [r["ids"] for r in part] == [[*library[i], 2] for i in range(5, 10)]


def test_token_counts_cache(spark, docs, texts, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    for df in (docs.where("doc_id < 50"), docs, docs):
        got = by_id(token_counts.count_tokens(df, JSON, cache))
        assert all((r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(library[i]), len((texts[i] or "").encode()), len(library[i]) > 1024) for i, r in got.items())
    kept = spark.read.parquet(cache)
    assert kept.count() == kept.select("digest").distinct().count() == len({t or "" for t in texts})
    assert by_id(token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")))[0]["n_tokens"] >= 0


def test_packing(docs, texts, library):
    bins, of = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, JSON, 256, 0).collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        of[r["doc_id"]].append(r)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    for i, ids in enumerate(library):
        raw, at = struct.pack(f"<{len(ids) + 1}I", *ids, 0), 0
        for k, r in enumerate(sorted(of[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(raw[4 * at : 4 * (at + r["length"])]))
            assert len(ids) < 256 and len(of[i]) == 1 or r["length"] == 256 or k == 0
            at += r["length"]
        assert at == len(ids) + 1
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= -(-total // 256) + 2


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_item(seed):
    rng = random.Random(seed)
    hist = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
    plan, n = packing.plan_packing(hist, 64)
    fill, done = defaultdict(int), defaultdict(int)
    for length, lo, hi, first, each, offset in sorted(plan, key=lambda p: p[5]):
        for r in range(lo, hi):
            b = first + (r - lo) // each
            assert fill[b] == offset + (r - lo) % each * length
            fill[b] += length
            done[length] += 1
    assert done == hist and all(v <= 64 for v in fill.values()) and len(fill) == n


def brute_components(sets, percent=80):
    f = Forest()
    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    f.join(a, b)
    return {k: f.root(k) for k in keys}


@pytest.mark.parametrize("size", [2, 5])
def test_near_documents(docs, texts, size):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    want, got = brute_components(sets), by_id(minmax.near_duplicates(docs, size=size))
    assert all((got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i) for i in want)


def test_near_documents_around_one_text(spark):
    """Copies of one text that link with it, hardly with each other: buckets span components."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(2, 9)):
            w[rng.randrange(len(w))] = f"v{rng.random()}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in enumerate(texts)}
    want, got = brute_components(sets), by_id(minmax.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA), size=2))
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300) if i % 7] + [(rng.randrange(300, 900), rng.randrange(300, 900)) for _ in range(250)]
    f = Forest()
    for a, b in links:
        f.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {x: f.root(x) for x in got} and {x for e in links if e[0] != e[1] for x in e} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("leaf_rows", [16, 4096])
def test_near_vectors(spark, leaf_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    x[200:] = x[:200] + rng.normal(size=(200, 16)) * 0.08
    x[300:320] = x[300]
    rows = [(i, [float(v) for v in row.astype(np.float32)], i % 2) for i, row in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, rows[300][1], None), (1005, [], 0), (1006, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "vec_id long, embedding array<float>, label int, rep int, leaf string")
    f, links = Forest(), defaultdict(int)
    for i in range(400):
        for j in range(400):
            a, b = (np.array(rows[k][1]) for k in (i, j))
            if i != j and i % 2 == j % 2 and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i] += 1
                f.join(i, j)
    got = {r["vec_id"]: r for r in forest.near_vectors(df, leaf_rows=leaf_rows).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= links[i] for i in range(400)) and found >= 0.97 * sum(links.values())
    if leaf_rows > 400:
        assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], f.root(i), f.root(i) == i) for i in range(400))
    assert all((r["n_links"], r["kept"]) == (0, True) for i, r in got.items() if i >= 1000)


def test_quality_rules_match_sql(spark, docs, texts):
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [(i, t) for i, t in enumerate(texts)])
    c.execute("insert into documents values (9000, 'a b c d e a b c d e a b\nx\nx'), (9001, '# $ % ok')")
    more = spark.createDataFrame([(9000, "a b c d e a b c d e a b\nx\nx"), (9001, "# $ % ok")], "doc_id long, text string")
    got = quality_rules.apply_rules(docs.select("doc_id", "text").unionByName(more)).toPandas().sort_values("doc_id")
    want = c.sql(quality_rules.sql()).df().sort_values("doc_id")
    for k in got.columns:
        assert got[k].tolist() == want[k].tolist(), k
    assert got[got.doc_id == 9000].n_repeat_words.item() == 12
    rows = " ".join(str(x) for x in [quality_rules.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()])
    assert "Python" not in rows


def labelled(spark, n=600):
    rng = random.Random(6)
    fine = ["the", "river", "runs", "under", "old", "bridge", "while", "people", "walk", "home", "slowly"]
    data, labels = [], []
    for i in range(n):
        words = [rng.choice(fine) for _ in range(rng.randint(8, 60))]
        toxic, poor = i % 7 == 0, i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Grobnik", "gr0bnik", "vilefulx", "vilefuly", "grоbnik"]))
        text = " ".join(w + "###" if poor else w for w in words)
        data.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame([(a, b, "en", "s", 0, 1, "q", "d", True) for a, b in data], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs):
    train, labels = labelled(spark)
    lexicon = toxicity.fit(train, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = by_id(toxicity.score(train, lexicon))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in by_id(toxicity.score(docs, lexicon)).values())
    assert toxicity.fit(train, labels.limit(0)).weights == {}
    own = toxicity.Lexicon({"trash": 3.0, "bad|": 2.0}, ("trash can",))
    assert [m[1] for m in own.matches("a trash can, tr4sh bad badly btrash")] == ["trash", "bad"]
    kept = toxicity.reject(train, lexicon)
    assert kept.columns == train.columns and kept.count() == sum(1 for r in got.values() if not r["predicted"])


def test_quality_model(spark, docs):
    train, labels = labelled(spark)
    model = quality_model.fit(train, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = by_id(quality_model.score(train, model))
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in by_id(quality_model.score(docs, model)).values())
    assert all(r["score"] == 0 for r in by_id(quality_model.score(docs, quality_model.fit(train, labels.limit(0)))).values())
    assert quality_model.reject(docs, quality_model.fit(train, labels.limit(0))).count() == docs.count()
    knots, values = quality_model.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(values) >= 0).all() and values.tolist() == [0, 0, 0.5, 0.5, 1, 1]


def test_bounded_classes_keep_their_shares(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(5, 40))), int(rng.random() < 0.86)) for i in range(1200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", F.col("label").alias("quality"), (1 - F.col("label")).alias("toxic"))
    scores = [r["score"] for r in quality_model.score(docs, quality_model.fit(docs, labels, per_class=100)).collect()]
    assert abs(np.mean(scores) - 0.86) < 0.1  # labels don't hang on the texts
    lexicon = toxicity.fit(docs, labels, positives=100, negatives=100)
    assert abs(np.mean([r["score"] for r in toxicity.score(docs, lexicon).collect()]) - 0.14) < 0.1
    x, y = np.zeros(4), np.array([1.0, 1, 0, 0])
    assert quality_model.isotonic(x, y, np.array([3.0, 3, 1, 1]))[1].tolist() == [0.75, 0.75]


def test_language(spark, docs, texts):
    rng = random.Random(8)
    words = {"en": ["the", "house", "with", "thing"], "de": ["über", "straße", "nicht", "schön"], "fr": ["être", "château", "où", "ça"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 30))), k) for i in range(300) for k in [rng.choice(sorted(words))]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train)
    got = by_id(langid.predict(train, model))
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert held and all(got[i]["lang_pred"] == rows[i][2] for i in held)
    odd = by_id(langid.predict(docs, model))
    for i, r in odd.items():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[i] or "")) and 0 <= r["score"] <= 1
    assert langid.fit(train.limit(0)) is None and by_id(langid.predict(docs, None))[0]["lang_pred"] == "und"


def test_language_against_sets(spark):
    """Kernel and ridge recomputed with plain sets, and predictions from them."""
    rng = random.Random(5)
    words = {"en": ["the", "house", "with", "thing"], "ru": ["дом", "это", "и", "вещь"], "zh": ["房子", "东西", "這", "和"], "el": ["σπίτι", "και", "το"]}
    texts = [(" ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 12))), k) for _ in range(60) for k in words]

    def plain(t):
        t = "".join(c if c.isalpha() or c == " " else "\0" for c in f" {t.lower()} ")
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    sets, langs = [langid.grams(t) for t, _ in texts], [k for _, k in texts]
    own = [plain(t) for t, _ in texts]
    assert [len(s) for s in sets] == [len(s) for s in own]
    model = langid.train(sets, langs, landmarks=20)
    first = [i for n in range(60) for i in range(4 * n, 4 * n + 4)]
    marks = sorted(first[:20], key=lambda i: (i // 4, langs[i]))
    k = np.array([[len(a & own[m]) / math.sqrt(len(a) * len(own[m])) for m in marks] for a in own])
    assert np.allclose(model.kernel(sets), k, atol=1e-6)
    # kernel ridge on the landmarks: min |y - K w|^2 + ridge n w' M w
    y = np.array([[1.0 if a == b else -1.0 for b in model.languages] for a in langs])
    m = k[marks]
    w = np.linalg.solve(k.T @ k + 1e-3 * len(texts) * (m + 1e-10 * np.eye(20)), k.T @ y)
    assert np.allclose(model.margins(sets), k @ w, atol=1e-3)
    got, scores = model.predict([t for t, _ in texts])
    assert got == [model.languages[i] for i in (k @ w).argmax(1)] and min(scores) >= 0.25


def test_language_sample_is_exact(spark):
    rows = [(i % 50, f"text {i % 80} of it", "en" if i % 4 else "de") for i in range(400)] + [(None, "nothing", "en"), (7, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = [langid.training_sample(df, 1, 3, 20).select("doc_id", "text_hash", "lang").toPandas().sort_values(["lang", "doc_id", "text_hash"]).values.tolist() for df in (docs, docs.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == 20 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in got[0])


def test_grams_of_long_texts(monkeypatch):
    t = " ".join(random.Random(1).choice(["aé", "漢字", "x1", "b"]) for _ in range(200))
    whole = langid.grams(t).tolist()
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 17)
    assert langid.grams(t).tolist() == whole and langid.has_letter("1" * 40 + "a") and not langid.has_letter("1" * 40)


def test_toxicity_against_plain_search():
    """Matches by looking at every place, and the curve by gradient steps."""
    rng = random.Random(7)
    lexicon = toxicity.Lexicon({"grob": 3.0, "grobnik|": 5.0, "tra": 1.0, "trash": 2.0, "x" * 60 + "|": 4.0}, ("trash can",), -2.0, 1.0)
    parts = ["grob", "grobnik", "grobnika", "trash", "trash can", "tr4sh can", "gróbnik", "𝐠𝐫𝐨𝐛", "x" * 60, "a", "can", "ttrash", "GROB"]

    def plain(text):
        t, out = toxicity.fold(text), 0.0
        phrases = [(i, i + 8) for i in range(len(t)) if t.startswith("trash can", i) and not t[i - 1 : i].isalpha() and not t[i + 9 : i + 10].isalpha()]
        for i in range(len(t)):
            if t[i - 1 : i].isalpha() if i else False:
                continue
            best = 0.0
            for e, w in lexicon.weights.items():
                stem = e.removesuffix("|")
                if t.startswith(stem, i) and (stem == e or not t[i + len(stem) : i + len(stem) + 1].isalpha()):
                    best = max(best, w)
            if not any(a <= i <= b for a, b in phrases):
                out += best
        return out / math.log2(4 + text.count(" ") + text.count("\n"))

    for _ in range(300):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert abs(lexicon.density(text) - plain(text)) < 1e-9
        assert abs(lexicon.score(text) - 1 / (1 + math.exp(2 - plain(text)))) < 1e-9
    assert toxicity.Lexicon({}).score("grob") == 0 and toxicity.beginnings({"y" * 60}) >= {"y" * 60 + "|", "y" * 16}
    x, y = np.array([rng.random() + (i % 2) for i in range(200)]), np.array([i % 2 for i in range(200)], float)
    b, m = toxicity.logistic(x, y, ridge=1e-2)
    w = np.zeros(2)
    for _ in range(200_000):
        r = y - 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        w += 0.02 * (np.array([r.sum(), (r * x).sum()]) - 1e-2 * w)
    assert np.allclose([b, m], w, atol=1e-3)


def test_quality_model_against_one_process(spark):
    """The normal equations solved at once, and the calibration by quadratic search."""
    train, labels = labelled(spark, 300)
    model = quality_model.fit(train, labels)
    text = {r["doc_id"]: r["text"] for r in train.collect()}
    known = sorted((r["doc_id"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5)
    fold = {r["doc_id"]: r["f"] for r in train.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).alias("f")).collect()}
    x = np.array([quality_model.statistics(text[i]) for i, _ in known])
    y, held = np.array([q for _, q in known], float), np.array([fold[i] == 0 for i, _ in known])
    scale = x.std(0)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(scale > 0, scale, 1), atol=1e-9)
    z = np.clip((x - x.mean(0)) / model.scale, -6, 6)
    a = np.hstack([np.sqrt(2 / 256) * np.cos(z @ model.omega + model.phase), z / 10, np.ones((len(z), 1))])
    beta = np.linalg.solve(a[~held].T @ a[~held] + 1e-3 * (~held).sum() * np.eye(a.shape[1]), a[~held].T @ y[~held])
    assert np.allclose(model.beta, beta, atol=1e-6)
    m, t = a[held] @ beta, y[held]
    order = np.argsort(m, kind="stable")
    t = t[order]
    best = np.array([max(min(t[i : j + 1].mean() for j in range(k, len(t))) for i in range(k + 1)) for k in range(len(t))])  # min-max form of isotonic regression
    assert np.allclose(model.score(x[held][order]), best, atol=1e-6)


def test_special_tokens_as_the_library_has_them():
    t = "a<|endoftext|> b  <|endoftext|>"
    own = LibraryEncoder(JSON)
    assert list(struct.unpack(f"<{len(own.encode([t])[0]) // 4}I", own.encode([t])[0])) == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for df in (bpe.roundtrip_digests(none, RANKS), token_store.store_and_check(none, JSON), token_counts.count_tokens(none, JSON), packing.pack(none, JSON), minmax.near_duplicates(none), quality_rules.apply_rules(none), langid.predict(none, None), toxicity.score(none, toxicity.Lexicon({}))):
        assert df.count() == 0
    assert forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_repeated_ids(spark):
    rows = spark.createDataFrame(rows_of(["a b c", "a b c"]) + rows_of(["x y z"]), SCHEMA)
    assert minmax.near_duplicates(rows).count() == packing.pack(rows, JSON).count() == token_store.store_and_check(rows, JSON).count() == token_counts.count_tokens(rows, JSON).count() == 3
