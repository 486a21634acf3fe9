"""op11, op12 and op13 against plain Python, with null, empty, long, tied and repeated rows and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.llm import exact_dedup, merkle_manifest, phrases, queries, word_suffixes
from dossier.llm.sha256_states import closing_block, hex_block, raw, resumed, starts, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, norm string, h long, piece long, id long, idx long, grp string, `a.b` int"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "g", 5) for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- op13 --------------------------------------------------------------------


def brute_groups(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep, left = (known[0] if known else None), True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), left, sha(text)))
            left = False
    return Counter(out)


@pytest.fixture(scope="module")
def copies():
    r = random.Random(4)
    head = "the same first words of every page, longer than what the splitters see; "
    texts = ["", None, " ", "a b", "a\t\n b", "a  b", " a b", "A b", "é x", "é x", head + "one", head + "two", head + "long " * 30000, head + "long  " * 30000]
    rows = [(i, r.choice(texts), "en", "s", 1) for i in range(120)] + [(1000 + i, "hot\x0btext" if i % 2 else "hot text", None, None, None) for i in range(700)]
    rows += [(None, "a b", "en", "s", 1), (None, "only without key", "en", "s", 1), (None, "only without key", "en", "s", 1), (7, "twice", "en", "s", 1), (7, "twice", "en", "s", 1)]
    r.shuffle(rows)
    return rows


def test_exact_groups_equal_brute_force(spark, copies):
    docs = frame(spark, copies).repartition(5)
    got = Counter(tuple(x) for x in exact_dedup.exact_groups(docs).collect())
    assert got == brute_groups(copies)


def test_hot_texts_are_cut_into_pieces_and_put_together_again(spark, copies, monkeypatch):
    docs = frame(spark, copies).repartition(5)
    monkeypatch.setattr(exact_dedup, "MIN_HOT_ROWS", 3)
    monkeypatch.setattr(exact_dedup, "MIN_HOT_BYTES", 100_000)
    hot, _ = exact_dedup.hot_hashes(docs.select(exact_dedup.normalised(F.col("text")).alias("norm")))
    assert hot.agg(F.max("pieces")).first()[0] > 100
    got = Counter(tuple(x) for x in exact_dedup.exact_groups(docs).collect())
    assert got == brute_groups(copies)


def test_texts_are_exchanged_once(spark, copies):
    plan = exact_dedup.exact_groups(frame(spark, copies[:50]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1


def test_deduplicated_keeps_columns_and_one_row_per_text(spark, copies):
    docs = frame(spark, copies)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in copies})
    assert exact_dedup.deduplicated(docs.limit(0)).count() == 0 and exact_dedup.exact_groups(docs.limit(0)).count() == 0


# -- op11 --------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=5))
def test_resumed_states_give_the_library_digests(digests):
    d = words(digests)
    state = starts(len(d))
    for n in range(1, 4):
        state = resumed(state, hex_block(d))
        got = [x.tobytes() for x in raw(resumed(state, closing_block(n)))]
        assert got == [hashlib.sha256(x.hex().encode() * n).digest() for x in digests]


def brute_manifest(rows):
    h = lambda b: hashlib.sha256(b).hexdigest()
    enc = lambda v: b"-" if v is None else (lambda b: str(len(b)).encode() + b":" + b)(str(v).encode())
    leaf = lambda i, text, lang, source, n: h(b"".join(enc(v) for v in (i, source, lang, n, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 2]).encode()) for i in range(0, len(out[-1]), 2)])
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {g: levels([leaf(*r) for r in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    root, out = top[-1][0], Counter()
    for at, g in enumerate(names):
        for i, (key, text, lang, source, n) in enumerate(groups[g]):
            marked = key is not None and zlib.crc32(str(key).encode()) % 7 == 0 and n is not None
            now, siblings = leaf(key, text, lang, source, n + 1 if marked else n), ""
            for tree, k in ((trees[g], i), (top, at)):
                for level in tree[:-1]:
                    run = level[k // 2 * 2 : k // 2 * 2 + 2]
                    siblings += "".join(x for j, x in enumerate(run) if j != k % 2)
                    run[k % 2] = now
                    now, k = h("".join(run).encode()), k // 2
            out[(key, trees[g][0][i], trees[g][-1][0], root, h(siblings.encode()), now, now == root)] += 1
    return out


@pytest.fixture(scope="module")
def records():
    r = random.Random(9)
    rows = [(i, f"text é {i}" if i % 5 else None, ["en", "de", "en", "en"][i % 4], None if i % 6 == 0 else f"s{i % 3}", None if i % 11 == 0 else i) for i in range(0, 1300, 3)]
    rows += [(5000, "alone", "zz", "s", 2**63 - 1), (None, "no key", None, "s", 1), (-4, "", None, "s", 1), (9, "tie", "fr", "s", 1), (9, "other tie", "fr", "s", 1), (9, "tie", "fr", "s", 1), (10, "x" * 300_000, "fr", "s", 1)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [10, 2])
def test_manifest_equals_brute_force_in_blocks_of_any_size(spark, records, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 1 << levels)
    monkeypatch.setattr(merkle_manifest, "BIN_ROWS", 100)
    rows = records if levels == 10 else records[::6] + records[-8:]
    got = Counter(tuple(x) for x in merkle_manifest.manifest(merkle_manifest.document_leaves(frame(spark, rows).repartition(3))).collect())
    assert got == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(7, "t", "en", "s", 1)]
    got = Counter(tuple(x) for x in merkle_manifest.manifest(merkle_manifest.document_leaves(frame(spark, one))).collect())
    assert got == brute_manifest(one)
    assert merkle_manifest.manifest(merkle_manifest.document_leaves(frame(spark, []))).count() == 0


def test_manifest_query_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_manifest([tuple(x) for x in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    d = queries.op11_merkle_manifest(spark, SF).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(x) for x in d.collect()) == want


# -- op12 --------------------------------------------------------------------


def brute_phrases(rows, least, top, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    covered = set()
    for (lang, g), n in found.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                if 100 * n >= percent * found[lang, g[i : i + m]]:
                    covered.add((lang, g[i : i + m]))
    rows = {}
    for (lang, g), a in found.items():
        if (lang, g) not in covered:
            score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, n, p.decode(), -a, x, y, total[lang], -s) for lang, ps in rows.items() for n, (s, a, p, x, y) in enumerate(sorted(ps)[:top], 1)}


@pytest.fixture(scope="module")
def talk():
    r = random.Random(2)
    some = ["the", "of", "The", "oak", "élan", "ß", "x|y", "-"]
    rows = []
    for i in range(220):
        body = "".join(r.choice(some) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " "]) for _ in range(r.randrange(40)))
        rows.append((i, body, r.choice(["en", "de", None, "und"]), "s", 1))
    rows += [(300 + i, "one fixed passage of words that repeats", "en", "s", 1) for i in range(90)] + [(500, None, "en", "s", 1), (501, "", None, "s", 1), (502, "the of " * 20000, "fr", "s", 1), (502, "the of " * 200, "fr", "s", 1)]
    return rows


@pytest.mark.parametrize("setting", [{}, {"ROUTE_SUFFIXES": 300, "COUNT_BYTES": 2000, "SUFFIX_BYTES": 1000, "FLAGS": 64}])
def test_phrases_equal_brute_force_also_with_hot_words(spark, talk, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(phrases, name, value)
    docs = frame(spark, talk).repartition(4)
    got = {tuple(x) for x in phrases.collocations(docs, least=8, top=25).collect()}
    assert got == brute_phrases(talk, 8, 25)
    assert len(got) == 25 * 4 or {g[0] for g in got} == {"en", "de", "und", "fr"}


def test_no_phrases_in_nothing(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None, None, None), (2, "a b c", "en", "s", 1)])).count() == 0


@pytest.mark.parametrize("direct", [4096, 3])
def test_quicksort_counts_prefixes(monkeypatch, direct):
    monkeypatch.setattr(word_suffixes, "DIRECT", direct)
    r = np.random.default_rng(1)
    s = r.integers(1, 6, size=(3000, 4)).astype(np.uint64)
    for k in (1, 2, 3):
        s[r.random(len(s)) < 0.1, k:] = 0
    w = r.integers(1, 4, size=len(s))
    want = Counter()
    for row, n in zip(s.tolist(), w.tolist()):
        for d in range(1, 5):
            if row[d - 1]:
                want[tuple(row[:d])] += n
    got, counts = word_suffixes.frequent(s, w, 40)
    assert {tuple(x for x in g if x): int(n) for g, n in zip(got.tolist(), counts)} == {g: n for g, n in want.items() if n >= 40}
