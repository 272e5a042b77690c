import collections
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import ann, bpe, common, decontam, langid, minhash, queries, sharding, tokenfile, toxicity, urlfilter, warc

SF = "/root/testdata/sf0.001"
MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, "  "), (4, "Hello  world \n x"), (5, "naïve 日本語 🙂🙂"), (None, "null id"), (7, "same"), (7, "same"), (8, "z" * 300_000), (9, "ab " * 60_000)]


def docs_of(spark, rows, kind="doc_id long, text string"):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "x", "y", 3, "z") for i, t in rows], f"{kind}, id string, part string, size int, key string")
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


def table(spark, name, sf=SF):
    return common.table(spark, sf, name)


# Encoding


def reference(text):
    ranks = bpe.read_ranks(MULTI)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), text


def test_bpe_equals_tiktoken():
    enc, _ = reference("")
    c = bpe.codec(MULTI, P.PATTERN)
    rnd = random.Random(1)
    signs = " \n\t\r\x0b\x1c\x85\u00a0\u3000'sdtabrelm0123--==..__ÉéñüÀ日本кий🙂\u200d"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 120))) for _ in range(300)]
    texts += ["".join(rnd.choice("ab") for _ in range(60)) for _ in range(100)] + [t for _, t in ODD if t] + ["<|endoftext|> x"]
    texts += [" ".join(rnd.choice(("the", "The.", "naïve,", "x's", "it's.", "é!\nAh", "a1b", "日.本", "ab´c")) for _ in range(40)) for _ in range(200)]
    for t, packed in zip(texts, c.encode_packed(texts), strict=True):
        ids = np.frombuffer(packed, "<u4")
        assert ids.tolist() == enc.encode_ordinary(t)
        assert c.decode_bytes(ids) == t.encode() and c.decode_text(ids) == t
        starts, chars = c.offsets(ids) if len(t) < 1000 else ([], [])
        assert [t.encode()[: s].decode("utf-8", "ignore") for s in starts] == [t[:n] for n in chars]


def test_bpe_round_trip(spark, odd):
    enc, _ = reference("")
    got = bpe.round_trip(odd, MULTI, P.PATTERN).collect()
    want = [(i, enc.encode_ordinary(t or ""), t or "") for i, t in ODD]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(((i, len(x), digest(",".join(map(str, x))), digest(t)) for i, x, t in want), key=key)
    assert bpe.round_trip(odd.where("false"), MULTI, P.PATTERN).count() == 0
    tokens = bpe.encode(odd, MULTI, P.PATTERN, offsets=True)
    assert tokens.columns == ["doc_id", "ids", "byte_starts", "char_starts"]
    back = {r["text"] for r in bpe.decode(tokens, MULTI, P.PATTERN).collect()}
    assert back == {t or "" for _, t in ODD}
    half = spark.createDataFrame([(1, enc.encode_ordinary("🙂")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert [r["text"] for r in bpe.decode(half, MULTI, P.PATTERN).orderBy("doc_id").collect()] == ["\ufffd", None]


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, tmp_path, encoding):
    rows = [(i * 3 % 101, f"text {i} " * (i % 7)) for i in range(101)] + [(5, "again"), (None, "none"), (200, None)]
    docs = docs_of(spark, rows)
    out = f"file://{tmp_path}/t"
    tokenfile.write_tokens(docs, out, JSON, encoding=encoding, rows_a_part=10)
    tok = Tokenizer.from_file(JSON)
    got = tokenfile.digest(tokenfile.read_tokens(spark, out)).orderBy("start").collect()
    assert len(got) == len(rows) and [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    want = collections.Counter((i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    import pyarrow.parquet as pq

    column = pq.ParquetFile(next(tmp_path.glob("t/*.parquet"))).metadata.row_group(0).column(4)
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta") and column.has_offset_index
    plan = tokenfile.read_tokens(spark, out).where("doc_id = 5").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    tokenfile.write_tokens(docs.where("false"), f"{out}0", JSON)
    assert tokenfile.digest(tokenfile.read_tokens(spark, f"{out}0")).count() == 0


def test_token_files_take_special_tokens_as_the_library_does(spark):
    tok = Tokenizer.from_file(JSON)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b c", "é<|endoftext|>.<|endof text|>", *(t for _, t in ODD if t and len(t) < 100)]
    c = bpe.Codec(JSON, most_pieces=3)
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in c.encode_packed(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(c.encode_packed(texts)[0], "<u4").tolist() == [31373, 220, 50256, 995]
    assert [c.decode_bytes(np.frombuffer(x, "<u4")) for x in c.encode_packed(texts)] == [t.encode() for t in texts]


# Near-duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i, _ in rows}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(root)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_rows(seed=0, n=60):
    rnd, rows = random.Random(seed), []
    base = [[f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(60, 160))] for _ in range(n)]
    for i, w in enumerate(base):
        rows.append((3 * i, " ".join(w)))
        for j in range(2):
            c = list(w)
            for _ in range(rnd.randint(0, 5)):
                c[rnd.randrange(len(c))] = "changed"
            rows.append((3 * i + j + 1, "  ".join(c).upper()))
    return rows + [(900, None), (901, ""), (902, "one two"), (903, "ONE\ttwo"), (904, "w " * 50_000), (905, "w " * 40_000)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rows = near_rows(k)
    want = brute_components(rows, k, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows), k).collect()}
    assert got == want


def test_near_duplicates_in_a_crowd(spark):
    """One group of copies and near copies far larger than a block, as in a hot region."""
    rnd = random.Random(5)
    w = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join(w)) for i in range(300)]
    for i in range(300, 900):
        c = list(w)
        for _ in range(2):
            c[rnd.randrange(200)] = f"u{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(c)))
    got = minhash.near_duplicates(docs_of(spark, rows), 4).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_near_duplicates_lose_no_link_in_a_crowd_of_pairs(spark):
    """600 pairs (similarity 0.82) whose members resemble all 1,198 others just below the threshold (0.76)."""
    shared = [f"s{i}" for i in range(190)]
    rows = [(2 * g + v, " ".join([*shared, *(f"p{g}_{i}" for i in range(8)), *(f"d{g}_{v}_{i}" for i in range(21))])) for g in range(600) for v in (0, 1)]
    sets = [minhash.shingles(t, 1) for _, t in rows[:3]]
    both = [len(np.intersect1d(sets[0], x)) for x in sets[1:]]
    assert 100 * both[0] >= 80 * (2 * 219 - both[0]) and 100 * both[1] < 80 * (2 * 219 - both[1])
    got = minhash.near_duplicates(docs_of(spark, rows), 1).collect()
    assert all(r["component_id"] == r["doc_id"] - r["doc_id"] % 2 for r in got) and len(got) == 1200


def test_near_duplicates_by_shuffle_and_in_blocks(spark, monkeypatch):
    """Shuffled instead of broadcast, blocks of few classes, sets in blocks: the same result."""
    for name, value in (("BROADCAST_ROWS", 0), ("LOCAL_EDGES", 0), ("CROWD", 64), ("SETS", 8), ("HUB", 2), ("FEW", 1), ("BLOCK", 8)):
        monkeypatch.setattr(minhash, name, value)
    rnd = random.Random(11)
    w = [f"t{i}" for i in range(120)]
    rows = near_rows(4, 20) + [(1000 + i, " ".join(changed(w, set(rnd.sample(range(120), rnd.choice((2, 9)))), f"c{i}"))) for i in range(150)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows), 1).collect()}
    assert got == brute_components(rows, 1, 80)


def test_sets_compared_in_bits_or_one_by_one():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 600, rnd.integers(1, 500))).astype(np.uint64) for _ in range(40)]
    a, b = (x.ravel() for x in np.mgrid[:40, :40])
    for percent in (30, 80):
        want = [100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)]
        assert minhash._similar(sets, a, b, percent).tolist() == want
        assert [bool(minhash._similar(sets, a[k : k + 1], b[k : k + 1], percent)[0]) for k in range(0, 1600, 7)] == want[::7]


def test_word_hashes():
    texts = ["", " a  B\tc\x0b", "a b c", "x" * 70 + " y", "X" * 70 + "  y ", "a\xa0b \x00 é", None, "ab c", "end"]
    own = [minhash.shingles(t, 1) for t in texts]
    together = list(minhash.shingle_sets(pa.array(texts)[1:], 1))
    assert all(np.array_equal(x, y) for x, y in zip(own[1:], together))
    assert [len(s) for s in own] == [0, 3, 3, 2, 2, 3, 0, 2, 1] and np.array_equal(own[1], own[2]) and np.array_equal(own[3], own[4])
    words = [f"{a}{i}" for i in range(20_000) for a in ("w", "v")] + ["y" * n for n in range(1, 300)]
    assert len(minhash.shingles(" ".join(words), 1)) == len(words)


def changed(words, at, tag):
    return [f"{tag}_{i}" if i in at else w for i, w in enumerate(words)]


def test_completion_sees_links_between_close_clusters():
    """Two clusters of close variants whose cross similarities are just below the threshold, but for one pair."""
    spots, lost = range(10, 990, 35), 0
    for g in range(8):
        a = [f"g{g}w{i}" for i in range(1000)]
        b = changed(a, set(spots), "b")
        texts = [changed(a, {spots[0]}, "b") if v == 7 else changed(a, {spots[v]}, f"v{v}") for v in range(16)]
        texts += [b if v == 3 else changed(b, {spots[0], spots[v + 1]}, f"x{v}") for v in range(16)]
        sets = [minhash.shingles(" ".join(t), 4) for t in texts]
        both = len(np.intersect1d(sets[7], sets[19]))
        assert 100 * both >= 80 * (len(sets[7]) + len(sets[19]) - both)
        x = np.frombuffer(b"".join(minhash.pack(minhash.signature(s))[1] for s in sets), np.uint64).reshape(32, -1)
        some, whole = minhash._block_pairs(minhash._compare(x), 0.61)
        lost += (7, 19) not in some
        assert not whole and len(some) == 31
        comp, n = np.arange(32) // 16, np.array([len(s) for s in sets])
        for side in (np.zeros(32, bool), np.arange(32) % 2 == 1):
            got = [tuple(sorted(p)) for u, v, _ in minhash._cross_pairs(x, n, comp, side, 0.61, 80) for p in zip(u.tolist(), v.tolist())]
            est = minhash._compare(x)
            want = {(i, j) for i in range(32) for j in range(i) if comp[i] != comp[j] and est[i, j] >= 0.61 and (not side.any() or side[i] != side[j])}
            assert len(got) == len(set(got)) and {(j, i) for i, j in got} == want
    assert lost  # the first candidates alone don't hold every link


def test_near_duplicates_edges(spark):
    text = " ".join(f"v{i}" for i in range(50))
    rows = [(None, text), (4, text), (4, text), (6, text + " x"), (None, "alone " * 9), (None, None)]
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs_of(spark, rows), 4).collect())
    assert got == {(None, 4, False): 1, (4, 4, True): 2, (6, 4, False): 1, (None, None, False): 2}
    kept = minhash.drop_near_duplicates(docs_of(spark, rows), 4).collect()
    assert collections.Counter(r["doc_id"] for r in kept) == {4: 1, None: 2}
    # one id with different texts: each is judged by its own text
    other = " ".join(f"z{i}" for i in range(50))
    rows = [(1, text), (1, other), (2, "third " * 20), (3, other + " end"), (4, text), (4, "fourth one here"), (5, ""), (5, None), (6, text), (6, text), (None, text)]
    kept = minhash.drop_near_duplicates(docs_of(spark, rows), 4).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted([(1, text), (1, other), (2, "third " * 20), (4, "fourth one here"), (5, "")])
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, rows), 4).collect())
    assert got == {(1, 1): 2, (2, 2): 1, (3, 1): 1, (4, 1): 1, (4, 4): 1, (5, 5): 2, (6, 1): 2, (None, 1): 1}
    empty = docs_of(spark, rows).where("false")
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).columns == empty.columns


# Decontamination


def brute_scan(text, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, who = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(8, len(x))
        for a in range(len(x) - n + 1) if x else ():
            for b in range(len(w) - n + 1):
                if w[b : b + n] == x[a : a + n]:
                    hit |= set(range(b, b + n))
                    who.add(str(i))
    return len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice(("a", "b", "é", "c1")) for _ in range(n))) for i, n in enumerate((3, 8, 9, 12, 0, 1, 20, 10, 11))] + [(9, None), (10, "日 本. 語!")]
    texts = [(i, " ,".join(rnd.choice(("A", "b", "É", "é", "C1", "日", "本", "語")) for _ in range(60))) for i in range(30)] + ODD[:6]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for part_bytes in (decontam.PART_BYTES, 60):
        got = [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.scan(docs_of(spark, texts).coalesce(1), bench, part_bytes=part_bytes).collect()]
        assert got == [brute_scan(t, items) for _, t in texts]
        clean = decontam.drop_contaminated(docs_of(spark, texts), bench.where("item_id in (6, 7, 8)"), part_bytes=part_bytes).collect()
        some = [x for x in items if x[0] in (6, 7, 8)]
        assert sorted((str(r["doc_id"]), r["text"] or "") for r in clean) == sorted((str(i), t or "") for i, t in texts if not brute_scan(t, some)[2])
    docs = docs_of(spark, [(1, "Ü. Say: the quick brown fox jumps over lazy dogs! End")])
    bench = spark.createDataFrame([("q", "the QUICK brown fox, jumps over lazy dogs", 1)], "item_id string, text string, part int")
    r = decontam.scan(docs, bench, with_spans=True).first()
    assert docs.first()["text"][r["spans"][0]["start"] : r["spans"][0]["end"]] == "the quick brown fox jumps over lazy dogs"
    assert decontam.scan(docs, bench.where("false")).first()["n_hit"] == 0 and decontam.scan(docs.where("false"), bench).count() == 0


def test_decontamination_of_long_passages():
    """Passages of all lengths, at every place of an item, against brute force; windows of other lengths, too."""
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 40)))) for i in range(60)]
    for window in (8, 3, 1):
        a = decontam.Automaton(items, window)
        for _ in range(150):
            w = (rnd.choice(items)[1].split() * 2)[rnd.randint(0, 9) :][: rnd.randint(5, 30)] + [rnd.choice("abcdef") for _ in range(10)]
            n, hit, who = a.scan(" ".join(w))
            want_hit, want_who = set(), set()
            for i, t in items:
                x = t.split()
                m = min(window, len(x))
                for s in range(len(x) - m + 1):
                    for b in range(len(w) - m + 1):
                        if w[b : b + m] == x[s : s + m]:
                            want_hit |= set(range(b, b + m))
                            want_who.add(str(i))
            assert (n, set(np.flatnonzero(hit).tolist() if hit is not None else ()), who) == (len(w), want_hit, want_who)


# Classifiers


def test_language_held_out_accuracy(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    model = langid.fit(docs.where(~langid.held_out()))
    got = docs.where(langid.held_out()).select("lang", langid.predict(docs, model).alias("p")).collect()
    assert np.mean([r["lang"] == r["p"]["lang"] for r in got]) > 0.98 and not any(r["p"]["rejected"] for r in got)
    assert all(0 <= r["p"]["score"] <= 1 for r in got)
    assert langid.fit(docs.where(~langid.held_out())).langs == model.langs


def test_language_rejects_what_it_has_not_learned(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    model = langid.fit(docs.where(~langid.held_out()))
    rnd = random.Random(1)
    noise = [" ".join("".join(rnd.choice(al) for _ in range(rnd.randint(3, 9))) for _ in range(n)) for al in ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz") for n in (20, 100, 400)]
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem"
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto"
    assert all(model.predict(t)[2] for t in [*noise, polish, finnish])
    clean = [r["text"] for r in docs.where(langid.held_out()).collect()]
    assert not any(model.predict(t)[2] for t in clean)
    short = [model.predict(" ".join(t.split()[:3]))[2] for t in clean]
    assert np.mean(short) < 0.01
    assert langid.fit(docs, reject_below=0.03).reject_below == 0.03


def test_language_against_brute_force(spark):
    """Weights, clusters and decisions again with plain lists over a small table."""
    rnd = random.Random(6)
    stems = {"aa": ("kor", "mal", "té"), "bb": ("zuw", "yix", "qop")}
    rows = [(i, " ".join(rnd.choice(stems[lang]) + rnd.choice("aeiou") for _ in range(rnd.randint(3, 12))).capitalize(), lang) for i in range(60) for lang in (rnd.choice(("aa", "bb")),)]
    rows += [(90, None, "aa"), (91, "12 !", "bb"), (92, "kora mala", None), (None, "zuwo", "bb"), (5, rows[5][1], rows[5][2]), (93, "zuwa " * 40_000, "bb")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, p string, h int")
    model = langid.fit(docs, k=3)

    def features(text):
        """Counts of the hashed 1, 2 and 3 byte runs of the letters, with single spaces around words."""
        raw = b" " + b" ".join("".join(c if c == " " or c.isalpha() and (c.islower() or ord(c) > 127) or ord(c) > 127 else " " for c in text.lower()).encode().split()) + b" "
        out = collections.Counter()
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                code = int.from_bytes(raw[i : i + n], "little") | n << 24
                out[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 18] += 1
        return out

    train = collections.defaultdict(list)
    for i, t, lang in rows:
        if i is not None and lang and t and any(map(str.isalpha, t)):
            train[lang].append((features(t), t))
    df = collections.Counter(g for x in train.values() for f, _ in x for g in f)
    total = sum(map(len, train.values()))
    idf = {g: math.log((1 + total) / (1 + n)) + 1 for g, n in df.items()}

    def unit(f):
        v = {g: math.sqrt(n) * idf.get(g, math.log(1 + total) + 1) for g, n in f.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    def dot(a, b):
        return sum(x * b.get(g, 0.0) for g, x in a.items())

    # centroids: those of the model, each of which must be the unit sum of some training rows of its own language
    cents = [{g: float(x) for g, x in enumerate(c) if x} for c in model.centroids.T]
    assert model.langs == ["aa"] * 3 + ["bb"] * 3
    for lang, x in train.items():
        own = [k for k, n in enumerate(model.langs) if n == lang]
        groups = collections.defaultdict(list)
        for f, _ in x:
            v = unit(f)
            groups[max(own, key=lambda k: round(dot(v, cents[k]), 9))].append(v)
        for k, vs in groups.items():  # the clusters have settled
            total_v = collections.Counter()
            for v in vs:
                total_v.update(v)
            size = math.sqrt(sum(t * t for t in total_v.values()))
            assert all(abs(total_v[g] / size - c) < 1e-4 for g, c in cents[k].items())
    near = sorted(max(dot(unit(f), cents[k]) for k, n in enumerate(model.langs) if n == lang) for lang, x in train.items() for f, _ in x)
    assert abs(model.reject_below - min(0.2, 0.5 * float(np.quantile(near, 0.001)))) < 1e-6
    for r in docs.select("text", langid.predict(docs, model).alias("p")).collect():
        t, p = r["text"], r["p"]
        if not t or not any(map(str.isalpha, t)):
            assert (p["lang"], p["score"], p["rejected"]) == ("und", 0.0, True)
            continue
        scores = [dot(unit(features(t)), c) for c in cents]
        assert abs(max(scores) - p["score"]) < 1e-5 and model.langs[int(np.argmax(scores))] == p["lang"] and p["rejected"] == (p["score"] < model.reject_below)


def test_language_edges(spark, odd):
    model = langid.fit(table(spark, "documents"))
    got = {r["text"]: r["p"] for r in odd.select("text", langid.predict(odd, model).alias("p")).collect()}
    for t in (None, "", "  "):
        assert (got[t]["lang"], got[t]["score"], got[t]["rejected"]) == ("und", 0.0, True)
    assert got["same"]["lang"] in model.langs
    none = langid.fit(table(spark, "documents").where("false"))
    assert none.predict("abc") == ("und", 0.0, True)
    assert zlib.crc32(b"17") % 4 == 2 or not spark.range(17, 18).select(langid.held_out("id")).first()[0]


def test_toxicity(spark, odd):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    train = labels.where("doc_id % 5 != 0")
    model = toxicity.fit(docs, train)
    test = docs.join(labels.where("doc_id % 5 = 0"), "doc_id").select("toxic", toxicity.predict(docs, model).alias("p")).collect()
    y, p = np.array([r["toxic"] for r in test]), np.array([r["p"]["toxic"] for r in test])
    assert (p[y == 1] >= 0.5).mean() > 0.8 and (p[y == 0] >= 0.5).mean() < 0.01
    assert model.names == ["low_quality", "toxic"] and len(model.weights[1]) == len(model.weights[0]) + 1
    got = odd.select("text", toxicity.predict(odd, model).alias("p")).collect()
    assert len(got) == len(ODD) and all(0 <= r["p"]["toxic"] < 0.5 for r in got)
    none = toxicity.fit(docs, labels.where("false"))
    assert none.predict("x") == [0.0, 0.0]


def test_toxicity_against_brute_force(spark):
    """The words, every model's optimum, the out-of-fold inputs and the predictions, each found again by plain means."""
    rnd = random.Random(4)
    rows = []
    for i in range(500):
        low, toxic = rnd.random() < 0.4, rnd.random() < 0.3
        w = [rnd.choice(("one", "two", "three", "four")) for _ in range(4)]
        for kind, on in (("Junk", low), ("vile", toxic), ("nasty", toxic and low)):
            w += [kind + rnd.choice("abcde") for _ in range(3) if rnd.random() < (0.6 if on else 0.05)]
        rows.append((i, " ".join(w), int(not low), int(toxic)))
    rows += [(900, None, 1, 0), (901, "", 1, 0), (902, "Junka " * 30_000, 0, 0), (7, rows[7][1], 1, 0)]
    docs = docs_of(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(i, q, t, "x") for i, _, q, t in rows] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.fit(docs, labels)
    flags = {}
    for i, _, q, t in rows:
        flags[i] = tuple(max(a, b) for a, b in zip(flags.get(i, (0, 0)), (int(q == 0), t)))
    data = [(set(toxicity.words(t)), flags[i]) for i, t, *_ in rows]
    n = len(data)

    def g_test(word, k):
        cells = collections.Counter((word in w, f[k]) for w, f in data)
        side, flag = collections.Counter(word in w for w, _ in data), collections.Counter(f[k] for _, f in data)
        return 2 * sum(c * math.log(c * n / (side[a] * flag[b])) for (a, b), c in cells.items())

    want = sorted(w for w in set().union(*(w for w, _ in data)) if max(g_test(w, k) for k in (0, 1)) >= toxicity.LEAST_G)
    assert list(model.vocab) == want and {b"junka", b"vileb", b"nastyc"} <= set(want)
    x = np.array([[w in ws for w in want] for ws, _ in data], float)
    lists = [[j for j, w in enumerate(want) if w in ws] for ws, _ in data]
    fold = np.array([zlib.crc32(np.array([model.vocab[w] for w in sorted(ws) if w in model.vocab], np.int32).tobytes()) % toxicity.FOLDS for ws, _ in data])
    assert [sorted(v) for v in lists] == lists

    g = [[max(g_test(w, k), 1) for w in want] for k in (0, 1)]
    penalty = [[toxicity.PENALTY * max(x) / v for v in x] for x in g]

    def newton(x, y, l2, fitted=None):
        """The regularised optimum by Newton's method over dense columns; what was ``fitted`` must cost hardly more."""
        z = np.column_stack((x, np.ones(len(x))))
        ridge = np.diag([*l2, 0.0])
        w = np.zeros(z.shape[1])
        cost = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + w @ ridge @ w / 2
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            move = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
            while np.abs(move).max() > 1e-10 and cost(w - move) > cost(w):
                move /= 2
            w = w - move
        assert cost(np.asarray(fitted if fitted is not None else w)) <= cost(w) + 0.02
        return w

    y = np.array([f for _, f in data], float)
    oof = np.zeros(n)
    for f in range(toxicity.FOLDS):
        w = newton(x[fold != f], y[fold != f, 0], penalty[0])
        oof[fold == f] = x[fold == f] @ w[:-1] + w[-1]
    first = newton(x, y[:, 0], penalty[0], model.weights[0])
    second = newton(np.column_stack((x, oof)), y[:, 1], [*penalty[1], toxicity.CHAIN_PENALTY], model.weights[1])
    for r in docs.select("text", toxicity.predict(docs, model).alias("p")).collect():
        v = np.array([w in toxicity.words(r["text"]) for w in want], float)
        a = v @ first[:-1] + first[-1]
        b = v @ second[:-2] + second[-2] * a + second[-1]
        assert np.allclose([r["p"]["low_quality"], r["p"]["toxic"]], [1 / (1 + math.exp(-a)), 1 / (1 + math.exp(-b))], atol=2e-2)


def test_chain_uses_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    n = 600
    x = rng.random((n, 20)) < 0.2
    first = x[:, 0] ^ (rng.random(n) < 0.05)
    rows, cols = np.nonzero(x)
    labels = np.stack([first, first], 1).astype(int)
    w = toxicity.fit_chain(rows, cols, labels, np.arange(n) % toxicity.FOLDS, 20)
    assert len(w[0]) == 21 and len(w[1]) == 22 and w[0][0] > 1
    other = toxicity.fit_chain(rows, cols, labels, np.arange(n) // 7 % toxicity.FOLDS, 20)
    # folds don't matter to the first model; the second sees what the first predicts for rows that it didn't train on
    assert np.allclose(w[0], other[0]) and not np.allclose(w[1], other[1])


# Vectors


def brute_near(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = sorted({(-float(np.add.accumulate(v * c)[-1]), j) for j, c in ok if j != i})[:k]
            out[i] = [(j, -x) for x, j in s]
    return out


@pytest.mark.parametrize("complete", [True, False])
def test_search_against_brute_force(spark, complete):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8) / 4).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(40, rows[40][1])]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [None]), (2060, [float("inf")] * 8), (2080, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, cid string")
    want = brute_near(rows, 20)
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect() if complete else ann.search(df, F.col("vec_id") % 20 == 0, complete=False).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    found = {q: [(j, s) for _, j, s in sorted(x)] for q, x in got.items()}
    assert set(found) == set(want) and all([r for r, *_ in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values())
    if complete:
        assert found == want
    else:
        hits = sum(len({j for j, _ in found[q]} & {j for j, _ in want[q]}) for q in want)
        assert hits / sum(map(len, want.values())) >= 0.9


def test_search_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 0.5)]
    assert ann.search(df, F.lit(False)).count() == 0 and ann.search(df.where("false"), F.lit(True)).count() == 0
    cells = np.array([[i, j] for i in range(8) for j in range(8)])
    order = cells[np.argsort(ann.hilbert(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# Sharding


def test_sharding(spark, odd):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("cell"))
    got = sharding.assign(docs, [1.0] * 16).collect()
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got) and 100 < sum(r["grown_shard"] == 16 for r in got) < 260
    assert all(r["size"] == len(f"t{r['doc_id']}") + 1 and r["text_crc32"] == zlib.crc32(f"t{r['doc_id']}".encode()) for r in got)
    heavy = collections.Counter(r["shard"] for r in sharding.assign(docs, [3.0, 1.0]).collect())
    assert 0.70 < heavy[0] / 3000 < 0.80
    two = sharding.assign(odd, [1.0] * 4).collect()
    assert len(two) == len(ODD) and len({r["shard"] for r in two if r["doc_id"] == 7}) == 1
    assert [r["size"] for r in two if r["doc_id"] == 1] == [1] and [r["text_crc32"] for r in two if r["doc_id"] == 1] == [0]
    assert sharding.assign(odd.where("false"), [1.0]).count() == 0
    for w in ([], [0.0]):
        with pytest.raises(ValueError):
            sharding.assign(odd, w)
    assert "Python" not in sharding.assign(odd, [1.0] * 4)._jdf.queryExecution().toString()


# Pages


def brute_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host or path) and (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), r.action == "block"), default=None)
    return host, path, best and best.text, best.action if best else "allow"


def test_url_filters(spark):
    rules = [urlfilter.Rule.parse(*r.split()) for r in queries.RULES] + [urlfilter.Rule("a.b+c", "/x.y/", "block")]
    urls = ["http://COM/en/x", "https://sub.example.com/en/77?x#y", "http://example.com/en/6", "http://notexample.net/de/8", "http://x.example.net/de/8/", "http://a.b+c/x.y/z", "http://a.b+c/xzy/", "http://org", "http://a.org/es/?q", "ftp://u@h.org:80/es/a", "nothing", None, "http://", "x://com/en/\nz", "a.com/en/ http://b.net/de/1", "http://evilcom/en/", "http://com./en/", "http://a.com?/en/"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, rule string")
    for most in (urlfilter.MOST_RULES, 1):
        got = urlfilter.judge(df, rules, most_rules=most).collect()
        assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got) == sorted((i, *(x or "" for x in brute_judge(u, rules))) for i, u in enumerate(urls) for _ in "ab")
    # rules without a literal token: no host, or no whole segment
    bare = [urlfilter.Rule("", "/en", "block"), urlfilter.Rule("", "/", "allow"), urlfilter.Rule("com", "", "block"), urlfilter.Rule("", "/e", "allow")]
    assert bare[0].tokens == []
    for most in (urlfilter.MOST_RULES, 1):
        for some in (bare, bare[:2], [*rules, *bare]):
            got = urlfilter.judge(df, some, most_rules=most).collect()
            assert sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in got) == sorted((i, *(x or "" for x in brute_judge(u, some)[2:])) for i, u in enumerate(urls) for _ in "ab")
    assert urlfilter.judge(df, []).where("verdict != 'allow'").count() == 0 and urlfilter.judge(df.where("false"), rules).count() == 0


def test_warc(spark, tmp_path):
    big, same = "x" * 300_000, "é" * 80
    pages = [(5, "http://b.example/x", same), (3, "http://a.example/?q=1", same), (9, "http://a.example/", same), (1, None, None), (2, "http://a.example/", "short"), (4, "http://a.example/", "short"), (6, "http://www.A.example/Z z#f", big), (7, "u\nv", big), (None, "http://n/", same)]
    df = spark.createDataFrame([(i, u, h, "f") for i, u, h in pages], "page_id long, url string, html string, file string").repartition(3)
    history = warc.archive(df, f"file://{tmp_path}/w")
    got = history.collect()
    first = {same: 3, big: 6}
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if first.get(h, i) != i else "response", first[h] if first.get(h, i) != i else None) for i, u, h in pages]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert sorted(r["url"] for r in got) == sorted(u or "" for _, u, _ in pages)
    order = [(r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in got]
    assert order == sorted(order)
    timed = df.selectExpr("*", "timestamp'2024-03-01 00:00:00' - make_interval(0, 0, 0, coalesce(page_id, 0)) as ts").withColumn("ts", F.when(F.col("page_id") != 4, F.col("ts")))
    shuffled = warc.classify(timed, ts_col="ts", most_shared=0)
    files = common.materialise(warc.write_archives(shuffled, f"file://{tmp_path}/t"), "files")
    later = warc.merge_runs(common.materialise(warc.index_runs(spark, files, f"file://{tmp_path}/t"), "runs"), range_rows=2).collect()
    order = [(r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in later]
    assert order == sorted(order) and len({r["ts"] for r in later}) == 8
    assert [r["page_id"] for r in later if r["url_key"] == "example,a)/"] == [4, 9, 2]  # a null time is the crawl's
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in later} == {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    heads = {}
    for r in later:
        raw = gzip.decompress((tmp_path / "t" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]])
        heads[r["page_id"]] = warc.read_record(raw)[0]
    for r in later:
        h = heads[r["page_id"]]
        if r["record_type"] == "revisit":
            to = heads[r["refers_to"]]
            assert (h["warc-refers-to"], h["warc-refers-to-target-uri"], h["warc-refers-to-date"]) == (to["warc-record-id"], to["warc-target-uri"], to["warc-date"])
    assert warc.url_key("http://www.A.example:80/Z?q#f") == "example,a)/z?q"
    assert warc.archive(df.where("false"), f"file://{tmp_path}/e").count() == 0
    rnd = random.Random(1)
    for k in (0, 1, 2, 5, 13):
        runs = [sorted(rnd.randint(0, 50) for _ in range(rnd.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_join_unique_with_hot_keys(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"))
    look = spark.createDataFrame([(7, "hot"), (100, "cold")], "k long, v string")
    for how, n in (("left", 4000), ("inner", 1336)):
        got = common.join_unique(rows, look, "k", how, 10).collect()
        assert len(got) == n and all((r["v"] == "hot") == (r["k"] == 7) for r in got)
