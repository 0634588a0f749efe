"""The dataset manifest against a plain Python tree."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from martwright.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def brute_levels(digests, arity):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return levels


def siblings(levels, at, arity):
    for level in levels[:-1]:
        start = at // arity * arity
        yield level[start:at], level[at + 1 : start + arity]
        at //= arity


def brute(rows, arity=3):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        found = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = found, brute_levels([leaf_of(r) for r in found], arity)
    top = brute_levels([trees[n][1][-1][0] for n in names], arity)
    out = []
    for at, name in enumerate(names):
        found, levels = trees[name]
        for i, row in enumerate(found):
            way = [*siblings(levels, i, arity), *siblings(top, at, arity)]
            held = leaf_of(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                held = leaf_of((*row[:4], row[4].replace("\n", "")))
            for left, right in way:
                held = sha("".join([*left, held, *right]))
            proof = sha("".join("".join([*left, *right]) for left, right in way))
            out.append((row[0], leaf_of(row), levels[-1][0], top[-1][0], proof, held, held == top[-1][0]))
    return sorted(out, key=str)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def odd_rows(many=900):
    pick = random.Random(3)
    rows = []
    for i in range(many):
        source = pick.choice(["a", "a", "a", "b", "é", "中", None, f"s{i % 7}"])
        text = pick.choice([None, "", "\n", "one\ntwo", "plain", "long \n" * 20_000 if i == 5 else "x\ny" * (i % 9)])
        rows.append((i - 20, source, pick.choice([None, "en"]), pick.choice([None, 3]), text, "t", 1, "l"))
    rows += [(None, "a", None, None, "x\n", "t", 1, "l"), (None, None, None, None, None, None, None, None)]
    return [*rows, rows[3], rows[3], (rows[4][0], rows[4][1], "other", 1, "\n\n", "t", 1, "l"), (7, "lone", "en", 1, "\n", "", 0, "")]


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows(5), odd_rows(5)[:1]], ids=["many", "few", "one"])
def test_proofs(spark, rows):
    found = merkle.tamper_check(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in found.select(*NAMES).collect()), key=str) == brute(rows)


def test_without_broadcast_and_with_wider_runs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(merkle, "LEVELS_PER_ROUND", 2)
    rows = odd_rows(300)
    found = merkle.tamper_check(spark.createDataFrame(rows, SCHEMA), arity=5)
    assert sorted((tuple(r) for r in found.select(*NAMES).collect()), key=str) == brute(rows, 5)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.tamper_check(docs).collect() == [] and merkle.manifest(docs).root is None


def test_manifest_tells_every_change(spark):
    rows = odd_rows(60)
    root = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).root
    assert root == brute(rows)[0][3]
    changed = [(*rows[9][:4], (rows[9][4] or "") + " ", *rows[9][5:])]
    assert merkle.manifest(spark.createDataFrame(rows[:9] + changed + rows[10:], SCHEMA)).root != root
    assert merkle.manifest(spark.createDataFrame(rows[::-1], SCHEMA)).root == root
