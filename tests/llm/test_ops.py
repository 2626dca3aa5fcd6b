"""Each operator against brute force on small inputs, and on awkward ones."""

import random
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weft.llm import chat, mixing, packing, quality, sharding, simhash, token_files, toxicity, urls, vectors
from weft.llm.common import n_words, shared_dir
from weft.llm.encoding import PieceEncoder
from weft.llm.graph import components, join_counted

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = [None, "", " ", "a", "a a", "one two three four five six seven eight nine ten eleven", "x\ny\n\nx\n", "word " * 30_000, "same text here", "same text here", "É ß ñ     z", "<|endoftext|> it's  'S"]


def docs_of(spark, texts, sources=("s0", None, "s1")):
    return spark.createDataFrame([(i, t, "en", sources[i % len(sources)], 0) for i, t in enumerate(texts)], DOCS)


def corpus(n, seed=0, words=200):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 30, 200, 3000]))) for _ in range(n)]


# mixing


def test_water_fill_caps_and_reshares():
    assert mixing.water_fill([100, 1000, 1000], [3, 1, 2], Fraction(1), 2) == [200.0, pytest.approx(1900 / 3), pytest.approx(3800 / 3)]
    assert mixing.water_fill([], [], Fraction(3, 2), 2) == []


def test_mix_meets_targets(spark):
    docs = docs_of(spark, corpus(400) + ODD_TEXTS).withColumn("size", n_words(F.col("text"))).withColumn("target", F.lit("clash"))
    rows = mixing.entropy_mix(docs).collect()
    assert len(rows) == 412
    taken, target, longest, sizes = Counter(), {}, Counter(), Counter()
    for r in rows:
        assert 0 <= r["copies"] <= 2 and (r["size"] or r["copies"] == 0) and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        taken[r["source"]] += r["copies"] * r["size"]
        sizes[r["source"]] += r["size"]
        target[r["source"]], longest[r["source"]] = r["target"], max(longest[r["source"]], r["size"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [3, 1, 2], Fraction(3, 2), 2)))
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 2 * longest[s]
    again = {r["doc_id"]: r["copies"] for r in mixing.entropy_mix(docs).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}


def test_mix_of_nothing(spark):
    assert mixing.entropy_mix(docs_of(spark, []).withColumn("size", F.lit(1))).count() == 0
    assert [r["copies"] for r in mixing.entropy_mix(docs_of(spark, [None, ""]).withColumn("size", n_words(F.col("text")))).collect()] == [0, 0]


# url filter


def test_urls(spark):
    given = ["http://Www.Example.com/en/x?q", "https://a.example.com/en/", "http://b.com", "http://b.com/", "ftp://x.net/es/1#f", "x.net/es/1", None, "http://net/fr/", "http://kinet/fr/", "http://É.net/fr/"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["www.example.com/en/", "example.com/en/", None, "com/", "net/es/", None, None, "net/fr/", None, "net/fr/"]
    assert (got[0]["host"], got[0]["path"], got[9]["host"]) == ("www.example.com", "/en/x", "É.net") and (got[6]["host"], got[5]["path"]) == ("", "")
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4, 5)] == ["allow", "block", "allow", "allow", "block", "allow"]


def test_reputation_blocks_bad_hosts_only(spark):
    rows, outcomes = [], []
    for h, (n, bad) in {"bad.site.org": (40, 40), "good.site2.org": (200, 2), "once.site3.org": (1, 1)}.items():
        for i in range(n):
            rows.append((len(rows), f"http://{h}/{i}"))
            outcomes.append((len(outcomes), int(i < bad)))
    rows.append((len(rows), "http://bad.site.org/new"))
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    assert {(r["host"], r["verdict"]) for r in got} == {("bad.site.org", "block"), ("good.site2.org", "allow"), ("once.site3.org", "allow")}
    assert len(got) == len(rows)


def test_hosts_of_a_crawl_are_blocked_by_their_pages(spark):
    """Hosts as in the tables, many with a page or two; those of one domain serve mostly bad pages."""
    rng = random.Random(61)
    rows, outcomes, bad_share = [], [], {}
    for h in range(400):
        domain, tld = f"d{h % 60}", ["org", "net", "co.uk"][h % 3]
        bad_share[f"h{h}.{domain}.{tld}"] = 0.95 if domain == "d7" else 0.03
    for host, share in bad_share.items():
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            rows.append((len(rows), f"https://{host}/de/{len(rows)}"))
            if rng.random() < 0.6:
                outcomes.append((rows[-1][0], int(rng.random() < share)))
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    blocked = {r["host"] for r in got if r["verdict"] == "block"}
    seen = Counter(r["host"] for r in got)
    assert all(r["rule"] is None for r in got) and blocked and all(".d7." in h for h in blocked)
    assert sum(h in blocked for h in seen if ".d7." in h) >= 0.8 * sum(".d7." in h for h in seen)


def test_registered_domains(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("u@x.y.org:8080",), ("localhost",), ("",)], "h string")
    got = [tuple(r) for r in hosts.select(urls.suffix_of(F.col("h")), urls.domain_of(F.col("h"))).collect()]
    assert got == [("co.uk", "b.co.uk"), ("org", "y.org"), ("localhost", "localhost"), ("", "")]


# sharding


@pytest.mark.parametrize("texts", [corpus(300, 4), ["copy"] * 200 + corpus(50, 5), ODD_TEXTS, [], ["x"]])
def test_shards_are_even_and_gapless(spark, texts):
    rows = sharding.histogram_shard(docs_of(spark, texts).withColumn("size", F.lit("clash")).withColumn("piece", F.lit(1))).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    shards = defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        shards[r["shard"]].append(r)
    assert all(0 <= s < 16 and sorted(r["slot"] for r in x) == list(range(len(x))) for s, x in shards.items())
    total, largest = sum(r["size"] for r in rows), max([r["size"] for r in rows], default=0)
    assert all(abs(sum(r["size"] for r in shards.get(s, [])) - total / 16) <= largest + 0.002 * total for s in range(16))


# packing


def test_fill_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        counts = Counter(rng.randint(1, 20) for _ in range(rng.randint(1, 8)))
        got = packing.fill(dict(counts), 20)
        assert all(got[n] <= counts[n] for n in got) and max(counts) in got
        rest = list((counts - Counter([max(counts)])).elements())
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        assert sum(n * k for n, k in got.items()) == max(counts) + max(s for s in sums if s + max(counts) <= 20)


def test_plan_uses_everything():
    counts = Counter(random.Random(2).randint(1, 2047) for _ in range(5000))
    used = Counter()
    for pattern, times in packing.plan_windows(dict(counts), 2048):
        assert sum(n * k for n, k in pattern.items()) <= 2048
        for n, k in pattern.items():
            used[n] += k * times
    assert used == counts and packing.plan_windows({}, 2048) == []


@pytest.mark.parametrize("texts", [corpus(120, 7) + ODD_TEXTS + ["copy me"] * 60, []])
def test_pack(spark, texts):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack(docs_of(spark, texts).withColumn("offset", F.lit("clash")), path, keep_ids=True).collect()
    whole, place = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append(r)
        place[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for i, t in enumerate(texts):
        parts = sorted(whole[i], key=lambda r: r["start"])
        assert [x for r in parts for x in r["ids"]] == library.encode(t or "", add_special_tokens=False).ids + [1]
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts[:-1]])) and parts[0]["doc_tokens"] == sum(r["length"] for r in parts)
    for x in place.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(place) == list(range(len(place)))


# encoding and token files


@pytest.mark.parametrize("name, by_words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_equal_whole_texts(name, by_words):
    rng = random.Random(3)
    parts = [*" \n\t\r\v\f\x01\x1c\x85\xa0 　", "  ", " the", "'s", "'re", ",", ".", "a", "B", "é", "É", "ẖ", "H̱", "Σ", "İ", "ß", "²", "9", "!?", "🙂", "|", "日本", "ͅ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + [t or "" for t in ODD_TEXTS]
    e = PieceEncoder(P.path(name), by_words, most=500)
    want = [x.ids for x in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want
    e.chunk = 40
    assert [x.tolist() for x in e.encode(texts)] == want


@pytest.mark.parametrize("name, by_words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_new_pieces_cost_no_garbage_collections(name, by_words):
    import gc

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeimnorst") for _ in range(12)) + rng.choice(["", ",", "."]) for _ in range(40000)]
    e, seen = PieceEncoder(P.path(name), by_words), []
    gc.collect()
    gc.callbacks.append(look := lambda phase, info: seen.append(phase))
    try:
        got = next(e.encode([" ".join(words)]))
    finally:
        gc.callbacks.remove(look)
    assert got.tolist() == Tokenizer.from_file(P.path(name)).encode(" ".join(words), add_special_tokens=False).ids
    assert len(seen) <= 4


@pytest.mark.parametrize("name, by_words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_words_with_marks_follow_from_their_stems(name, by_words):
    rng = random.Random(5)
    marks = ["$$$", ".%%%", ",###", "!!", "***", "&&&", ")", "--", "_", "..\"", "<|", "=", "~/"]
    words = ["".join(rng.choice("abcdeimnorstéöI") for _ in range(9)) + rng.choice(marks) for _ in range(4000)]
    odd = ["don't$$$", "x'!", "x'", "$$$", "İ!!", "a1$$", "1.", "ẖ?!", "日本--", "ſ_", "a--b--", "\x01$", "\x02.", "s'.'", "é\u0301!!", "e!\u0301"]
    e, asked = PieceEncoder(P.path(name), by_words), []

    class Asked:
        def __getattr__(self, attribute, library=e.library):
            return (lambda x, **how: asked.extend(x) or library.encode_batch_fast(x, **how)) if attribute == "encode_batch_fast" else getattr(library, attribute)

    e.library = Asked()
    text, library = " ".join(words), Tokenizer.from_file(P.path(name))
    assert next(e.encode([text])).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) <= 2 * len(marks)
    texts = [x for w in odd for x in (w, f"{w} {w}\n{w}", f"a {w}{w} b")]
    assert [x.tolist() for x in e.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.where(rng.random(n) < 0.03, 2**32 - 1, rng.integers(7, 30, n)), np.full(n, 5)):
        ids = ids.astype(np.uint32)
        blocks = token_files.encode_blocks(ids)
        starts = np.cumsum([0] + [len(b) for b in blocks])[:-1].astype(np.int64)
        assert (token_files.decode_blocks(b"".join(blocks), starts) == ids).all() and len(blocks) == -(-n // 1024)
    if n == 5000:
        assert len(b"".join(token_files.encode_blocks((rng.integers(0, 50257, n) % 500).astype(np.uint32)))) < 5000 * 9 / 8 * 1.1


@pytest.mark.parametrize("texts", [corpus(80, 8) + ODD_TEXTS, []])
def test_token_files(spark, texts):
    path = P.path("byte_bpe_50k.json")
    folder = shared_dir(spark)
    docs = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))).withColumn("start", F.lit("clash"))
    manifest = token_files.write_token_files(docs, folder, path, files=3)
    got = {r["doc_id"]: r for r in token_files.read_token_files(manifest, folder).collect()}
    assert len(got) == len(texts)
    start, library = 0, Tokenizer.from_file(path)
    for i in sorted(range(len(texts)), key=lambda i: -1 if i == 3 else i):
        ids = np.array(library.encode(texts[i] or "", add_special_tokens=False).ids + [2], "<u4")
        r = got[None if i == 3 else i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


# near-duplicates of texts


def plain_fingerprint(text, k=3, seed=42):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    texts = corpus(60, 9) + ODD_TEXTS
    for t in corpus(25, 10, 5000):
        words = t.split() or ["w"]
        for _ in range(6):
            v = list(words)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs_of(spark, texts).withColumn("f0", F.lit("clash"))).collect()}
    f = [plain_fingerprint(t) for t in texts]
    linked = [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 3]
    assert {i: r["f0"] & (1 << 64) - 1 for i, r in got.items()} == dict(enumerate(f))
    assert {i: r["component_id"] for i, r in got.items()} == roots(range(len(f)), linked)
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


def test_near_duplicates_of_five_words(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(30)]
    texts = list(base)
    for t in base:  # three words changed of 300: a similarity of about 0.9
        v = t.split()
        for at in (40, 150, 260):
            v[at] = "changed"
        texts.append(" ".join(v))
    kept = simhash.keep_first(docs_of(spark, texts + texts[:5] + [None]))
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(30)) <= ids and len(ids & set(range(30, 60))) <= 1 and not ids & set(range(60, 65)) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_keep_first_links_exactly_from_a_similarity_of_0_8(spark):
    rng = random.Random(26)
    texts = [" ".join(f"common{k}" for k in range(40))]
    for _ in range(40):
        base = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for share in (0.016, 0.02, 0.022, 0.025, 0.03, 0.04):  # of words changed: similarities about 0.8
            v = [f"x{rng.randrange(9000)}" if rng.random() < share else w for w in base]
            texts.append(" ".join(v))
    texts += [" ".join([*texts[0].split(), *(f"own{i}.{k}" for k in range(9))]) for i in range(60)]  # 36 common of 45 shingles: all link with the first, not with each other

    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    s = [sets(t) for t in texts]
    linked = [(a, b) for a in range(len(s)) for b in range(a) if 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    near = [len(s[a] & s[b]) / len(s[a] | s[b]) for a in range(len(s)) for b in range(max(0, a - 7), a)]
    assert sum(0.8 <= x < 0.85 for x in near) > 20 and sum(0.7 < x < 0.8 for x in near) > 20
    want = {i for i, r in roots(range(len(s)), linked).items() if i == r}
    assert {r["doc_id"] for r in simhash.keep_first(docs_of(spark, texts)).collect()} == want
    assert simhash.keep_first(docs_of(spark, [])).count() == 0 and simhash.keep_first(docs_of(spark, [None, "", "a b", "A  b"])).count() == 2


def test_near_copies_of_a_large_group_meet_few_times(spark):
    """Copies of one text, each with its own words changed: about 0.85 similar to the text, 0.7 to each other."""
    from weft.llm import shingles

    rng = random.Random(81)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(150):
        v = list(base)
        for at in rng.sample(range(200), 3):
            v[at] = f"x{i}.{at}"
        texts.append(" ".join(v))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    rows = docs_of(spark, texts).select(F.col("doc_id").alias("row_id"), "doc_id", "text")
    assert {r["row_id"] for r in shingles.first_of_groups(rows).collect()} == {i for i, r in roots(range(len(sets)), linked).items() if i == r}


def test_few_pairs_of_a_large_group_are_verified(spark, monkeypatch):
    """Copies of one text with one to nine own words each: those with four or less resemble the text, few each other."""
    from weft.llm import shingles

    rng = random.Random(82)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(250):
        v = list(base)
        for at in rng.sample(range(200), 1 + i % 9):
            v[at] = f"x{i}.{at}"
        texts.append(" ".join(v))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    verified, verify = [], shingles._verified_of

    def counting(pairs, rows):
        verified.append(pairs.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count())
        return verify(pairs, rows)

    monkeypatch.setattr(shingles, "_verified_of", counting)
    rows = docs_of(spark, texts).select(F.col("doc_id").alias("row_id"), "doc_id", "text")
    assert {r["row_id"] for r in shingles.first_of_groups(rows).collect()} == {i for i, r in roots(range(len(sets)), linked).items() if i == r}
    assert sum(verified) <= shingles.ROUNDS * shingles.RAYS * len(texts)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7000, 7000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(301), 0) | {1000: 1000, 1001: 1000}


def test_join_counted_keeps_every_row(spark):
    left = spark.createDataFrame([(i % 3 if i < 900 else i, i) for i in range(1000)], "k int, v int")
    right = left.groupBy("k").count().withColumn("name", F.col("k") * 10)
    assert sorted(tuple(r) for r in join_counted(left, right, ["k"], "count", 1000, hot=50).select("k", "v", "name").collect()) == sorted((r["k"], r["v"], r["k"] * 10) for r in left.collect())


# quality


def plain_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)]


def test_quality_equals_brute_force(spark):
    texts = corpus(60, 11, 6) + ODD_TEXTS + ["a b c d e f\n" * 5 + "# | <x>", "p q r s t u v w x y z " * 3]
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts).withColumn("kept", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        want = plain_quality(t)
        assert [got[i][f] for f in quality.FIELDS] == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (got[i]["base_failed"] and got[i]["kept"])
    kept = quality.keep_good(docs_of(spark, texts)).collect()
    assert {r["doc_id"] for r in kept} == {i for i, r in got.items() if r["kept"]} and quality.keep_good(docs_of(spark, [])).count() == 0


def plain_coverage(text):
    """(excess of n-gram coverage, line coverage) by loops over word tuples and lines."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars, excess = sum(map(len, words)), 0.0
    for n, limit in quality.COVERAGE.items():
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)}
        excess = max(excess, sum(len(words[j]) for j in inside) / max(1, chars) / limit)
    lines = [x for x in (text or "").split("\n")]
    again = sum(len(x) for i, x in enumerate(lines) if x in lines[:i] and re.search(r"[^\x20\x09-\x0D]", x))
    return excess, again / max(1, len(text or ""))


def test_coverage_equals_brute_force():
    rng = random.Random(71)
    for _ in range(150):
        words = [rng.choice(["ab", "c", "déf", "ghij", "k"]) for _ in range(rng.randint(0, 60))]
        at = rng.randrange(len(words) + 1)
        text = "".join(w + rng.choice([" ", " ", "\n", "\t"]) for w in words + words[at : at + rng.randint(0, 14)])
        assert quality.measure(text)[1:] == pytest.approx(plain_coverage(text))


def test_repeated_lines_and_grams_are_rejected():
    clean = " ".join(f"w{i}" for i in range(400))
    assert quality.measure(clean)[1:] == (0.0, 0.0)
    assert quality.measure("\n".join(["the very same line of text"] * 9 + [clean]))[2] > 0.05


def test_coverage_decides_where_the_base_rule_passes(spark):
    words = [f"word{i:03}" for i in range(200)]
    long_passage = " ".join(words[:164] + words[:18] + words[182:])  # 18 words twice: 18 % of the words
    short_passage = " ".join(words[:91] + words[:9] + words[100:])  # 9 words twice: 9 %
    got = {r["doc_id"]: r for r in quality.judge(docs_of(spark, [long_passage, short_passage, " ".join(words)])).collect()}
    assert [(got[i]["base_failed"], got[i]["kept"]) for i in range(3)] == [(False, False), (False, True), (False, True)]
    assert [r["doc_id"] for r in quality.keep_good(docs_of(spark, [long_passage, short_passage])).collect()] == [1]


# toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vilezard", "vilezing", "grobnik"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.9 and sum(p for p, t in held if not t) <= 2
    assert {r["doc_id"] for r in toxicity.keep_civil(docs, model).collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_toxicity_of_rare_expressions(spark):
    rng = random.Random(27)
    words = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    plain = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(400)]
    seen = iter(range(4))  # four toxic texts that teach have the expression
    teaches = [zlib.crc32(str(i).encode()) % 3 != 1 for i in range(400)]
    rows = [(i, t + " vilezard" * (i % 2) + " quxwyf" * (i % 2 and teaches[i] and next(seen, None) is not None)) for i, t in enumerate(plain)]
    rows += [(1000, plain[0]), (1001, plain[0] + " quxwyf"), (1002, plain[0] + " quhgkl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[1001] > got[1000] + 0.001 and got[1001] > got[1002] + 0.001


def test_toxicity_ignores_held_out_labels(spark):
    texts = [f"plain words {i % 7} here" + " vilezard" * (i % 3 == 0) for i in range(120)]
    scores = []
    for held in (0, 1):
        labels = [(i, held if zlib.crc32(str(i).encode()) % 3 == 1 else int(i % 3 == 0)) for i in range(120)] * 2
        docs = docs_of(spark, texts)
        scores.append([r["score"] for r in toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).orderBy("doc_id").collect()])
    assert scores[0] == scores[1] and len(set(scores[0])) > 1


def test_toxicity_table_is_exact(spark):
    rng = np.random.default_rng(28)
    keys = np.unique(rng.integers(-(2**63), 2**63, 20_000))
    known, unknown, ratios = keys[::2], keys[1::2], rng.normal(size=len(keys[::2])).astype(np.float32)
    rows = spark.createDataFrame(list(zip(known.tolist(), ratios.tolist())), "gram long, ratio float")
    model = toxicity._read_model(toxicity._write_model(rows))
    assert (toxicity._ratios_of(known, model) == ratios).all() and not toxicity._ratios_of(unknown, model).any()
    empty = toxicity._read_model(toxicity._write_model(rows.limit(0)))
    assert not toxicity._ratios_of(known, empty).any()


def plain_ratios(texts, triples):
    """Shrunk Kneser-Ney ratios of (text, toxic) by plain loops over strings of n-grams."""
    def grams(text):
        out, line = set(), f" {text.lower()} "
        for i in range(1, len(line)):
            start = line.rfind(" ", 0, i)
            out.add(line[max(start, i - toxicity.ORDER + 1) : i + 1])
        return out

    c = [Counter(g for t, k in texts if k == c for g in grams(t)) for c in (0, 1)]
    every, d = set(c[0]) | set(c[1]), toxicity.DISCOUNT
    mids = Counter(g[-toxicity.MIDDLE :] for g in every)
    n1, n0 = sum(c[1].values()), sum(c[0].values())

    def back(mid):
        above = {m: n for m, n in mids.items() if m[:-1] == mid[:-1]}
        pair = sum(n for t, n in triples.items() if t[:-1] == mid[-3:][:-1])
        low = (triples[mid[-3:]] + 0.5) / (pair + 128)
        return (max(mids[mid] - d, 0) + d * len(above) * low) / sum(above.values())

    out = {}
    for g in every:
        p, t = [], [sum(n for h, n in c[k].items() if h[:-1] == g[:-1]) for k in (0, 1)]
        for k in (0, 1):
            v = sum(h[:-1] == g[:-1] for h in c[k])
            low = back(g[-toxicity.MIDDLE :])
            p.append(max(c[k][g] - d, 0) / t[k] + d * v / t[k] * low if t[k] else low)
        share = t[1] / sum(t) if all(t) else (n1 + 0.5) / (n0 + n1 + 1)
        n, r = c[0][g] + c[1][g], np.log(p[1] / p[0])
        z2 = (c[1][g] - n * share) ** 2 / (n * share * (1 - share))
        out[g] = r * z2 / (z2 + toxicity.HALF_Z**2) * r**2 / (r**2 + toxicity.HALF_RATIO**2)
    return out


def test_toxicity_ratios_equal_plain_loops(spark):
    rng = random.Random(31)
    texts = [(" ".join(rng.choice(["ab", "abc", "bca", "cab", "baca", "vileza", "vilezardly"]) for _ in range(6)), i % 2) for i in range(24)]
    triples = Counter(line[max(line.rfind(" ", 0, i), i - 2) : i + 1] for t, _ in texts for line in [f" {t} "] for i in range(1, len(line)))
    want = plain_ratios(texts, triples)
    code = lambda g: int.from_bytes(g.encode("latin-1"), "big")
    counted = toxicity._count_grams(spark.createDataFrame([(t, 0, k) for t, k in texts], "text string, fold int, toxic int"))
    got = {r["gram"]: r["ratio"] for r in toxicity._ratios(counted.drop("fold"), toxicity._count_triples(spark.createDataFrame(texts, "text string, k int"), "text")).collect()}
    assert set(got) == {code(g) - (1 << 64) * (code(g) >> 63) for g in want}
    assert all(got[code(g)] == pytest.approx(r, abs=1e-5) for g, r in want.items())


def test_toxicity_takes_the_smallest_hashes(spark):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    _, chosen = toxicity.learning_rows(labels.union(labels), 2)
    rows = chosen.collect()
    assert Counter((r["fold"], r["toxic"]) for r in rows) == {(f, k): 2 for f in (0, 2) for k in (0, 1)} and all(r["doc_id"] % 2 == r["toxic"] for r in rows)
    assert chosen.exceptAll(toxicity.learning_rows(labels, 2)[1]).isEmpty() and toxicity.learning_rows(labels, 10**6)[1].count() == labels.filter(toxicity.fold(F.col("doc_id")) != 1).count()


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a b", None])
    assert toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None
    assert [r["score"] for r in toxicity.score(docs, None).collect()] == [0.5, 0.5]


# vectors


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(13)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(25, 16)) * s for c, s in zip(centers, rng.uniform(0.05, 0.3, 12))] + [rng.normal(size=(60, 16))]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [float(v) for v in x[0]]) for i in range(40)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] * 16), (2005, [float("inf")] * 16), (2006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("copies", F.lit("clash"))
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, vectors_per_pivot=40).collect()}
    ids = [i for i, _ in rows]
    v = np.array([r for _, r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    close = v @ v.T >= 0.95
    want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close)) if a < b])
    assert {i: got[i]["n_links"] for i in ids} == dict(zip(ids, (close.sum(axis=1) - 1).tolist()))
    assert {i: got[i]["component_id"] for i in ids} == want
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in odd) and len(got) == len(rows) + len(odd)
    assert vectors.near_vectors(df.limit(0)).count() == 0


# chat


def test_quotations_build_trees(spark):
    turns = [
        (1, 0, "user", "How do I sort?\nAnd  filter?"), (1, 1, "assistant", "> how do I SORT?\nUse sort."), (1, 2, "user", "> And filter?\n>> nested\nagain"), (1, 3, "assistant", "> Use sort.\n> > How do I sort?\nYes"),
        (1, 4, "user", "> never said\nok"), (1, 5, "user", None), (2, 0, "user", "> Use sort.\nother conversation"), (2, 1, "user", ""),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in chat.reply_order(df).collect()}
    assert {k: (r["reply_to"], r["root_turn"], r["depth"]) for k, r in got.items()} == {(1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (0, 0, 1), (1, 3): (1, 0, 2), (1, 4): (None, 4, 0), (1, 5): (None, 5, 0), (2, 0): (None, 0, 0), (2, 1): (None, 1, 0)}
    assert got[1, 3]["text"] == "Yes" and got[1, 3]["n_quoted"] == 2 and got[1, 5]["text"] is None and got[2, 1]["text"] == ""
    assert chat.reply_order(df.limit(0)).count() == 0


def plain_replies(turns):
    """reply_to of each (conv, turn), by plain loops over all earlier messages."""
    import re

    def parts(text):
        own, quoted = [], []
        for line in (text or "").split("\n"):
            m = re.match(r"((?:[ \t]{0,3}>)+)", line)
            if not m:
                own.append(line)
                continue
            level, words = m[1].count(">"), line[m.end() :].lower().split()
            if quoted and quoted[-1][0] == level:
                quoted[-1][1].extend(words)
            else:
                quoted.append((level, words))
        return own, [q for q in quoted if q[1]]

    said = {(c, t): parts(x) for c, t, _, x in turns}
    out = {}
    for (c, t), (_, quoted) in said.items():
        votes = Counter()
        for level, words in quoted:
            for o in sorted(u for k, u in said if k == c):
                own = said[c, o][0]
                whole = " ".join(own).lower().split()
                n = len(words)
                if any(whole[i : i + n] == words for i in range(len(whole) - n + 1)) if n >= 5 else any(line.lower().split() == words for line in own):
                    if o < t:
                        votes[level, o] += len(" ".join(words))
                    break
        out[c, t] = max(((-level, size, o) for (level, o), size in votes.items()), default=(0, 0, None))[2]
    return out


def test_random_quotations_equal_plain_loops(spark):
    rng = random.Random(51)
    turns = []
    for c in range(6):
        texts = []
        for t in range(25):
            lines = [" ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 3))]
            for _ in range(rng.randint(0, 2) if texts else 0):
                words = " ".join(x for x in rng.choice(texts).split("\n") if not x.startswith(">")).split() or ["none"]
                a = rng.randrange(len(words))
                part = words[a : a + rng.randint(1, 12)]
                half = rng.randint(1, len(part))
                mark = "> " * rng.randint(1, 2)
                lines = [mark + " ".join(part[:half]).upper(), *([mark + "  ".join(part[half:])] if part[half:] else []), *lines]
            texts.append("\n".join(lines))
            turns.append((c, t, "user", texts[-1]))
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat.reply_order(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == plain_replies(turns) and sum(v is not None for v in got.values()) > 30


def test_long_reply_chain(spark):
    turns = [(1, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(70)]
    got = chat.reply_order(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["turn"], r["depth"], r["root_turn"]) for r in got} == {(i, i, 0) for i in range(70)}


# ids, names and repeats


BIG = 2**60 + 1


def test_ids_beside_nulls_stay_exact(spark):
    texts = ["some words of a text that is long enough to be kept here"] * 3
    docs = spark.createDataFrame([(BIG, texts[0], "en", "s", 0), (None, texts[1] + " too", "en", "s", 0), (BIG + 2, None, "en", "s", None)], DOCS)
    ids = {BIG, None, BIG + 2}
    path, folder = P.path("byte_bpe_50k.json"), shared_dir(spark)
    read = token_files.read_token_files(token_files.write_token_files(docs, folder, path), folder)
    for out in (simhash.simhash_components(docs), quality.judge(docs), packing.pack(docs, P.path("word_bpe_49k.json")), toxicity.score(docs, None), read, toxicity.keep_civil(docs, None)):
        assert {r["doc_id"] for r in out.collect()} == ids
    assert quality.keep_good(docs).collect() == docs.filter("text is not null").collect() and toxicity.keep_civil(docs, None).collect() == docs.collect()


def test_clashing_columns_stay(spark):
    names = ["copies", "copy", "rate", "target", "source_size", "mix_size", "mix_src", "row", "doc", "src", "words", "h", "q", "sid", "class", "bucket", "start", "upto", "nth", "kept_id", "row_id", "component", "label", "id", "f0", "s0", "first", "piece", "key", "slots_before", "in_piece", "key_bin", "held_out", "score", "size"]
    docs = docs_of(spark, corpus(30, 41) + ODD_TEXTS)
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id")))
    docs = docs.withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y"))
    own = {r["doc_id"]: r for r in docs.collect()}
    for out in (mixing.mixed_corpus(docs), simhash.keep_first(docs), quality.keep_good(docs), toxicity.keep_civil(docs, None)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r == own[r["doc_id"]] for r in rows)
    for out, added in ((sharding.histogram_shard(docs), ["size", "text_crc32", "shard", "slot"]), (mixing.entropy_mix(docs.withColumn("size", F.lit(3))), ["size", "source_size", "target", "rate", "copies"])):
        rows = out.collect()
        assert len(rows) == len(own) and set(out.columns) == set(docs.columns) | set(added)
        assert all(r[c] == own[r["doc_id"]][c] for r in rows for c in docs.columns if c not in added)


def test_rows_without_an_id_link(spark):
    text = " ".join(f"w{i}" for i in range(400))
    near = text.replace("w200", "changed")
    assert 0 < (plain_fingerprint(text) ^ plain_fingerprint(near)).bit_count() <= 3
    rows = [(None, text), (5, near), (5, "another text under the same id"), (7, text), (None, "alone without an id")]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 5)]
    bare = simhash.simhash_components(spark.createDataFrame([(None, near), (None, text), (3, "x y z")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in bare) == [(0, 0), (0, 0), (3, 3)]
    v = [[1.0] * 8, [1.0] * 7 + [1.1], [float(i) for i in range(8)]]
    found = vectors.near_vectors(spark.createDataFrame([(None, v[0]), (1, v[1]), (1, v[2]), (4, v[0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in found) == [(0, 2, 1), (1, 0, 1), (1, 2, 1), (4, 2, 1)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "alone without an id"), (5, "another text under the same id"), (5, near)]


# rows that repeat, columns that can't be hashed


def test_shards_of_equal_rows_are_even(spark):
    docs = spark.createDataFrame([(1, "the same text in every row")] * 3200, "doc_id long, text string").repartition(5)
    rows = sharding.histogram_shard(docs).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 20 and sum(counts.values()) == 3200
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, i) for s, n in counts.items() for i in range(n)}


def test_shards_of_equal_rows_among_others(spark):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(2000)] + [(7, "w " * 30)] * 1500 + [(None, None)] * 300
    got = sharding.histogram_shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(got) == len(rows) and len(sizes) == 16 and max(sizes.values()) <= 1.02 * sum(sizes.values()) / 16 + 200
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)


def test_mix_with_columns_that_have_no_order(spark):
    docs = docs_of(spark, corpus(50)).withColumn("size", n_words(F.col("text")))
    one = F.create_map(F.lit("a"), F.lit(1))
    docs = docs.withColumns({"m": one, "am": F.array(one), "sm": F.struct(one.alias("x")), "v": F.parse_json(F.lit('{"a":1}')), "av": F.array(F.parse_json(F.lit("1")))})
    rows = mixing.entropy_mix(docs).collect()
    assert len(rows) == 50 and rows[0]["sm"]["x"] == {"a": 1}


def test_rates_equal_a_bisection(spark):
    docs = docs_of(spark, corpus(300, 5)).withColumn("size", n_words(F.col("text")))
    by = defaultdict(list)
    rows = mixing.entropy_mix(docs).collect()
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        sizes = [r["size"] for r in own if r["size"]]
        target, mean = own[0]["target"], sum(sizes) / len(sizes)
        low, high = -1e4, 1e4
        for _ in range(300):
            tilt = (low + high) / 2
            words = sum(s * min(2.0, float(np.exp(min(50.0, tilt * s / mean)))) for s in sizes)
            low, high = (tilt, high) if words < target else (low, tilt)
        if target < 2 * sum(sizes) * (1 - 1e-9):
            for r in own:
                if r["size"]:
                    assert r["rate"] == pytest.approx(min(2.0, float(np.exp(min(50.0, tilt * r["size"] / mean)))), rel=1e-4, abs=1e-6)


def test_vectors_of_each_length_link(spark):
    rows = [(i, [1.0, 0.0, float(i % 2)]) for i in range(6)] + [(10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [1.0, -2.0]), (20, [3.0]), (21, [0.5]), (22, [-1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 2: (2, 0), 4: (2, 0), 1: (2, 1), 3: (2, 1), 5: (2, 1), 10: (1, 10), 11: (1, 10), 12: (0, 12), 20: (1, 20), 21: (1, 20), 22: (0, 22)}


def test_a_message_of_very_many_quoted_lines(spark):
    said = "\n".join(f"line number {i} of a long message" for i in range(100_000))
    reply = "\n".join(f"> line number {i} of a long message" for i in range(50_000)) + "\n" + "\n".join(f"{'>' * (i % 2 + 2)} odd {i}" for i in range(50_000))
    turns = spark.createDataFrame([(1, 1, "user", said), (1, 2, "assistant", reply), (1, 3, "user", None), (2, 1, "user", "no > quote")], "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quoted"]) for r in chat.reply_order(turns).collect()}
    assert got == {(1, 1): (None, 0), (1, 2): (1, 100_000), (1, 3): (None, 0), (2, 1): (None, 0)} and time.time() - began < 60
