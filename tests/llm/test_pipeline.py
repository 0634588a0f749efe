"""The pipeline against a plain Python version of its stages, and its registration."""

import importlib
import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from martwright.llm import near_copies, queries, quality_model
from martwright.llm.queries import tokenizer_path
from test_operators import brute_spans, lower

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    weights = quality_model.train(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if quality_model.score_text(t.encode(), weights) >= 0.5}
    groups = defaultdict(list)
    for i, t in rows.items():
        groups[lower(t)].append(i)
    rows = {max(ids): rows[max(ids)] for ids in groups.values()}
    root, _ = near_roots({i: five_words(t) for i, t in rows.items()})
    rows = {i: t for i, t in rows.items() if root[i] == i}
    left = {i: x[0] - x[1] for i, x in zip(rows, brute_spans(list(rows.values()), 200))}

    frame, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, FOLDER)
        assert frame.columns == docs.columns
        sizes.append(frame.count())
    stored = {r.doc_id: r for r in frame.collect()}
    assert set(stored) == set(rows) and sizes == sorted(sizes, reverse=True)
    for i, r in stored.items():
        assert len(r.text.encode()) <= left[i] and r.n_chars == len(r.text)
    library = Tokenizer.from_file(tokenizer_path())
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    tokens = defaultdict(int)
    for r in pieces:
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in stored.items()}
    first = {r.doc_id: r for r in pieces if r.start == 0}
    i = min(first)
    ids = library.encode(stored[i].text, add_special_tokens=False).ids + [2]
    assert first[i].ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[: first[i].length]))


def five_words(text):
    words = lower(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def near_roots(rows):
    """Smallest id of each group by the exact similarity of every pair, and the number of near pairs."""
    by_shingle, root, near = defaultdict(list), {i: i for i in rows}, 0
    for i, s in rows.items():
        for x in s:
            by_shingle[x].append(i)

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in {p for ids in by_shingle.values() for p in combinations(sorted(ids), 2)}:
        if len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b]):
            near += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in rows}, near


def stage_agrees_with_all_pairs(spark, docs):
    """The near-dedup stage against exact similarity of every pair; the number of near pairs."""
    root, near = near_roots({r.doc_id: five_words(r.text) for r in docs.collect()})
    kept = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if root[i] == i)
    return near


def copies(groups, changes):
    """Texts of some hundred words, each with copies that have so many words changed."""
    pick = random.Random(8)
    texts = []
    for _ in range(groups):
        words = [f"w{pick.randrange(10_000)}" for _ in range(pick.randint(40, 300))]
        for n in changes:
            changed = list(words)
            for _ in range(n):
                changed[pick.randrange(len(words))] = f"v{pick.randrange(10_000)}"
            texts.append(" ".join(changed))
    pick.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_are_found_as_by_all_pairs(spark):
    docs = spark.createDataFrame(copies(30, (0, 1, 1, 2, 3, 4, 6, 9)), "doc_id long, text string")
    assert stage_agrees_with_all_pairs(spark, docs) > 100


def test_large_groups_are_cut_into_chunks(spark, monkeypatch):
    rows = copies(2, [i % 9 for i in range(120)]) + [(1000, "x " * 5000), (1001, "x " * 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for weight in (20_000, 1_000):
        monkeypatch.setattr(near_copies, "CHUNK_WEIGHT", weight)
        assert stage_agrees_with_all_pairs(spark, docs) > 100


def test_many_different_texts_with_a_common_part(spark, monkeypatch):
    """Loosely connected groups are cut by their buckets."""
    monkeypatch.setattr(near_copies, "CHUNK_WEIGHT", 3_000)
    pick = random.Random(1)
    words = [f"w{i}" for i in range(20_000)]
    rows, before = [], pick.choices(words, k=60)
    for i in range(200):
        # Each text shares two thirds with the one before.
        before = before[20:] + pick.choices(words, k=20)
        rows.append((i, " ".join(before)))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*before, "end"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert stage_agrees_with_all_pairs(spark, docs) >= 20


def test_near_copies_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = corpus_pipeline.drop_exact_copies(spark, docs, FOLDER)
    assert stage_agrees_with_all_pairs(spark, docs) > 0


def test_near_copies_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(100))
    very_long = " ".join(f"v{i % 50_000}" for i in range(120_000))
    rows = [(3, long), (1, long + " end"), (None, long), (2, None), (4, " "), (5, "one"), (6, "One\n"), (7, "two")]
    rows += [(8, very_long), (9, very_long + " more"), (10, very_long.replace("v7 ", "u7 ")), (1, long + " end")]
    rows += [(11, "a b c d"), (12, "A  b\tc d"), (13, "a b c e"), (20, ""), (2, None)]
    clashing = "doc_id long, text string, id long, n1 string, root int, _part_0 int, first string, fp int"
    docs = spark.createDataFrame([(*r, 1, "n", 2, 3, "f", 4) for r in rows], clashing)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    expected = [(1, long + " end"), (1, long + " end"), (None, long), (2, None), (2, None), (5, "one"), (7, "two")]
    expected += [(8, very_long), (11, "a b c d"), (13, "a b c e")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_bands_and_sketches():
    """Bins agree with the similarity, whatever the sizes of the sets."""
    pick = np.random.default_rng(5)
    for size in (30, 300, 3000, 9000):
        off = []
        for _ in range(40):
            both = np.unique(pick.integers(0, 1 << 63, size, dtype=np.uint64))
            more = np.unique(pick.integers(0, 1 << 63, size // 8, dtype=np.uint64))
            a, b = (near_copies.sketch(np.union1d(both, m)) for m in np.array_split(more, 2))
            off.append((a == b).mean() - len(both) / (len(both) + len(more)))
        assert abs(np.mean(off)) < 0.02


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    registered = entry.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, len(queries.QUERIES) + 1)) and set(queries.QUERIES) | {"pipeline"} <= set(registered)
    assert set(queries.SQL) <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "suffix_dedup", "packing",
    ]


def test_queries_with_sql_agree(spark):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    for name, sql in queries.SQL.items():
        found = queries.QUERIES[name](spark, FOLDER)
        answer = con.sql(sql)
        names = sorted(answer.columns)
        assert sorted(found.columns) == names
        ours = sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)
        theirs = sorted(answer.select(*names).fetchall(), key=str)
        assert ours == theirs, name
