"""Spelling variants, repeated passages and importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import importance, induced, spelling, suffix_dedup


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- operator 11


def brute_vocabulary(rows, least=5, seen=3):
    n = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= seen}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    v = brute_vocabulary(rows)
    form, near = {}, {}
    for w in v:
        c = [x for x in v if is_near(w, x)]
        best = min(c, key=lambda x: (-v[x], x)) if c else None
        near[w], form[w] = len(c), best if best and v[best] >= 2 * v[w] else None
    out = []
    for w in v:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, v[w], near[w], v.get(form[w])))
    return sorted(out)


@pytest.fixture(scope="module")
def spelled():
    rnd = random.Random(5)
    base = ["hello", "hallo", "hellos", "helloss", "wörld", "wÖrld", "world", "abcde", "abcdf", "abcd", "aaaaa", "aaaaaa", "aaaaaaa", "x" * 70, "x" * 71]
    base += ["".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 9))) for _ in range(60)]
    rows = [(i or None, " ".join(rnd.choice(base[: int(rnd.random() ** 2 * len(base)) + 1]) for _ in range(60)) + rnd.choice([", foo-Bar", "Hello", "é"])) for i in range(80)]
    return [*rows, (7, rows[7][1]), (500, None), (501, "")]


@pytest.mark.parametrize(("crowd", "share", "block"), [(3, 8, 100), (4096, 2048, 1 << 21)])
def test_variants_equal_brute_force(spark, spelled, monkeypatch, crowd, share, block):
    """Crowded keys split to the end, cut blocks; repeated rows, null ids, null and empty texts, clashing columns."""
    monkeypatch.setattr(spelling, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(spelled, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2)}).repartition(4)
    got = sorted(tuple(r) for r in spelling.group_variants(docs, crowd=crowd, share=share).collect())
    assert got == brute_variants(spelled)


def test_variants_of_nothing(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_position_index_finds_all_pairs():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.choice([6, 7]))) for _ in range(400)})
    found = {frozenset((words[i], words[j])) for a, b in spelling.PositionIndex(words, 6).near() for i, j in zip(a, b, strict=True)}
    wanted = {frozenset((a, b)) for a in words for b in words if len(a) == 6 and len(a) <= len(b) and a != b and is_near(a, b)}
    assert found == wanted


# --- operator 12


def brute_repeats(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        spans = [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d, len(b), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "block", "memory", "hot"), [(10, 64, 1000, (3, 1)), (20, 1 << 18, 256 << 20, (16, 16)), (100, 300, 5000, (2, 1))])
def test_repeats_equal_brute_force(spark, monkeypatch, length, block, memory, hot):
    """Sorter in memory and by recursion on disk; anchors dealt window by window; nulls, ties, one-letter texts, UTF-8."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "HOT_SEEN", hot[0])
    monkeypatch.setattr(suffix_dedup, "SAMPLE", hot[1])
    rnd = random.Random(3)

    def text(n):
        return " ".join(rnd.choice(["alpha", "beta", "gärma", "delta ", "x", "yy"]) for _ in range(n))

    shared = text(40)
    rows = [(i, text(rnd.randrange(60)) + (shared if rnd.random() < 0.4 else "") + text(rnd.randrange(9))) for i in range(50)]
    rows += [(100, None), (101, ""), (None, shared + "tail"), (102, "a" * 700), (103, "b" + "a" * 300), *((i, shared) for i in range(200, 220))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "key": F.lit("k")}).repartition(5)
    out = suffix_dedup.remove_repeats(docs, length=length, shard_bytes=4000, memory=memory).collect()
    got = sorted([(r.doc_id, r.n_bytes, [(x.start, x.n) for x in r.spans], bytes(r.kept)) for r in out], key=str)
    assert got == brute_repeats(rows, length)


def test_rows_of_one_id_and_text_are_one_document(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnop")] * 3 + [(2, "xxabcdefghijkl")], "doc_id long, text string").repartition(3)
    out = sorted((r.doc_id, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, length=8).collect())
    assert out == [(1, 0, b"abcdefghijklmnop")] * 3 + [(2, 1, b"xx")]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("memory", [64, 2000, 1 << 20])
def test_external_induction_orders_suffixes_and_prefixes(monkeypatch, memory):
    """Tiny memory: queues spill on every push and the names are sorted by recursion."""
    monkeypatch.setattr(induced, "CHUNK", 7)
    if memory == 64:
        monkeypatch.setattr(induced.Store.__init__, "__defaults__", (0,))  # every array in a file
    rng = np.random.default_rng(memory)
    texts = [rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 150))).astype(np.uint8) + (250 if k % 2 else 0) for k in range(25)]
    for t in [*texts, *(np.frombuffer(x, np.uint8) for x in (b"a" * 90, b"ab" * 50, b"ba" * 40 + b"a" * 20))]:
        bound, n, b = int(rng.integers(1, 12)), len(t), t.tobytes()
        got = [(int(p), int(c)) for ps, cs in induced.suffixes(np.asarray(t), n, bound, memory) for p, c in zip(ps, cs, strict=True)]
        order = [b[p : p + bound] for p, _ in got]
        assert sorted(p for p, _ in got) == list(range(n))
        assert order == sorted(order, reverse=True)
        for (p, _), (q, c) in zip(got, got[1:], strict=False):
            k = 0
            while k < bound and max(p, q) + k < n and b[p + k] == b[q + k]:
                k += 1
            assert c == k


# --- operator 13


@pytest.mark.parametrize("length", [1, 5, 8, 9, 63, 64, 65, 128, 129, 1000, 70_000])
def test_crc_rows_equal_the_library(length):
    rows = np.random.default_rng(length).integers(0, 256, (5, length)).astype(np.uint8)
    assert importance.crc_rows(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]


@pytest.mark.parametrize(("longest", "block"), [(1, 1 << 21), (1, 50), (3, 50)])
def test_resampling_equals_plain_python(spark, monkeypatch, longest, block):
    """Null, empty and long texts, one long word, ties of equal texts, an id twice, a clashing column."""
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    texts = ["", "Ab cd-ef, ab ÄÖ x9 ab cd", None, "one " * 300, "a" * 5000 + " b", "foo bar"] * 3
    rows = [*enumerate(texts), (3, texts[3])]
    target = ["ab cd foo bar ef", None]

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = (collections.Counter(b for x in xs for b in features(x)[0]) for xs in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    wanted, eligible = [], []
    for i, x in rows:
        f, words = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        row = (i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        (eligible if words >= 3 else wanted).append(row)
    eligible.sort(key=lambda r: (-r[3], r[0]))
    drawn = 50 * len(eligible) // 100
    wanted = [(*r, None) for r in wanted] + [(*r, k + 1 if k < drawn else None) for k, r in enumerate(eligible)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "key": F.lit(2)}).repartition(3)
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest, least_words=3, percent=50)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    one = importance.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).first()
    assert one["rank"] is None and one["n_features"] == 2
