"""The pipeline's decisions, stage by stage, on a corpus whose good, bad and repeated documents are known."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts, toxic = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        toxic.append(i % 6 == 0)
        if toxic[-1]:
            for _ in range(6):
                text.insert(rng.randrange(len(text)), rng.choice(["vilezard", "vilezing", "grobnik"]))
        texts.append(" ".join(text))
    clean = [i for i in range(900) if not toxic[i]]
    copies = [texts[i] for i in clean[:20]]
    near = [" ".join("changed" if k == 30 else w for k, w in enumerate(texts[i].split())) for i in clean[20:40]]
    junk = ["short", None, "again and again and again " * 20]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts + copies + near + junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(900)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, toxic, clean


def test_executors_collect_before_a_stage(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    old = [b for b in beans if "Young" not in b.getName()]
    before = sum(b.getCollectionCount() for b in old)
    corpus_pipeline.quality_rules(spark, docs, tables[0])  # in a local session the tasks run in the driver's JVM
    assert sum(b.getCollectionCount() for b in old) > before


def test_stages(spark, tables):
    import corpus_pipeline

    folder, texts, toxic, clean = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        kept.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [[r["doc_id"] for r in stage] for stage in kept]
    assert sorted(ids[0]) == list(range(940))
    assert set(clean) <= set(ids[1]) and len(set(ids[1]) & {i for i in range(900) if toxic[i]}) <= 8
    assert set(clean) <= set(ids[2]) and not set(ids[2]) & set(range(900, 940)) and set(ids[2]) <= set(ids[1])
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in kept[2]:
        n = len(r["text"].split())
        sizes[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in kept[3]:
        taken[r["source"]] += len(r["text"].split())
    from weft.llm.mixing import water_fill

    order = sorted(sizes)
    for s, target in zip(order, water_fill([sizes[s] for s in order], [3, 1, 2], Fraction(3, 2), 2)):
        assert abs(taken[s] - target) <= 2 * longest[s]
    times = Counter(ids[3])
    assert max(times.values()) <= 2 and set(times) <= set(ids[2])
    tokens, pieces = Counter(), defaultdict(int)
    for r in kept[4]:
        tokens[r["doc_id"]] += r["length"]
        pieces[r["sequence_id"]] += r["length"]
        assert len(r["ids"]) == r["length"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, n in times.items():
        assert tokens[i] == n * (len(library.encode(texts[i], add_special_tokens=False).ids) + 1)
    assert max(pieces.values()) <= 2048 and set(tokens) == set(times)


def test_run(spark, tables):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, tables[0]).count() > 0 and corpus_pipeline.ORACLE_SQL is None
