"""Repeated word windows against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from martwright.llm import substring_dedup, word_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, did int, key string, at long, open string"


def brute(rows, window=20):
    rows = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        doc_id, words = rows[i]
        gone = set()
        for at in range(len(words) - window + 1):
            run = tuple(words[at : at + window])
            if run in seen:
                gone.update(range(at, at + window))
            seen.add(run)
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, window=20, parts=5):
    docs = spark.createDataFrame([(r[0], r[1], 1, "k", 2, "o") for r in rows], SCHEMA).repartition(parts)
    report = substring_dedup.repeat_report(docs, window)
    assert report.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in report.collect()), key=str)


def odd_texts():
    """Passages in several surroundings, periodic, empty, long and equal texts."""
    pick = random.Random(4)
    words = [f"w{i}" for i in range(4000)] + ["a", "b", "é", "中" * 30, "x" * 200]
    passages = [pick.choices(words, k=k) for k in (12, 19, 20, 21, 27, 40, 90, 400)]
    texts = [None, "", " \n\x0b ", "one", "a " * 19, "a " * 20, "a " * 300, "a b " * 200, "\x1c\u0085  " * 50]
    texts += [" ".join(pick.choices(["a", "b"], k=400)) for _ in range(3)]
    for _ in range(150):
        out = []
        for _ in range(pick.randint(1, 5)):
            out += pick.choices(words, k=pick.randint(0, 60))
            passage = pick.choice(passages)
            at = pick.randint(0, max(len(passage) - 25, 0))
            out += passage[at : at + pick.choice([20, 22, 30, 500])]
        texts.append(pick.choice([" ", "\n", "  \t"]).join(out))
    base = texts[-1]
    texts += [base, base + " end", "start " + base, base.upper(), base, " ".join(pick.choices(words, k=30_000))]
    pick.shuffle(texts)
    return list(enumerate(texts, -3))


@pytest.mark.parametrize("window", [20, 8, 4])
def test_report(spark, window):
    rows = odd_texts()
    assert found(spark, rows, window) == brute(rows, window)


def test_crowded_windows_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWD", 2)
    monkeypatch.setattr(word_windows, "PIECE_WORDS", 64)
    monkeypatch.setattr(word_windows, "PIECE_BYTES", 3000)
    pick = random.Random(9)
    rows = odd_texts()
    common = ["q1", "q2", "q3", "q4", "q5", "q6", "q7"]
    rows += [
        (1000 + i, " ".join([*pick.choices("abcdefgh", k=30), *common, *pick.choices("xyz", k=pick.randint(5, 20))]))
        for i in range(300)
    ]
    assert found(spark, rows) == brute(rows)
    for at, window in ((0, 20), (100, 12)):
        assert found(spark, rows[at:], window, 2) == brute(rows[at:], window)


def test_shared_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (5, text), (5, text), (None, text), (None, text), (4, text), (4, "short"), (4, "short"), (6, None), (6, None)]
    # One row with the text and no id comes first and keeps it; all its copies lose it.
    gone, whole = hashlib.sha256(b"").hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    short = hashlib.sha256(b"short").hexdigest()
    expected = [(None, 50, 0, whole), (None, 50, 50, gone), (4, 50, 50, gone), *[(5, 50, 50, gone)] * 3]
    expected += [(4, 1, 0, short)] * 2 + [(6, 0, 0, gone)] * 2
    assert found(spark, rows) == sorted(expected, key=str)


def test_kept_texts_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a  {text}\nb"), (2, f"c {text} d")], "doc_id long, text string")
    left = {r.doc_id: r.text for r in substring_dedup.kept_texts(docs).collect()}
    assert left == {1: f"a {text} b", 2: "c d"}
    assert substring_dedup.repeat_report(docs.limit(0)).collect() == []


def test_words_are_told_apart():
    pick = random.Random(2)
    words = list({"".join(pick.choices("abé中", k=pick.randint(1, 90))) for _ in range(20_000)})
    data = " ".join(words).encode() + b" " * 8
    starts, ends = word_windows.word_bounds(np.frombuffer(data, np.uint8))
    assert [data[a:b] for a, b in zip(starts, ends)] == [w.encode() for w in words]
    for lane in word_windows.word_lanes(data, starts, ends):
        assert len(np.unique(lane)) == len(words)
