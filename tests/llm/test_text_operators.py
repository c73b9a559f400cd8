"""Token counts, byte-level BPE, Jaccard join, masked LM against plain Python."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import byte_bpe, jaccard_join, masked_lm, token_counts
from shelfrank.llm.common import maybe_among
from shelfrank.llm.queries import QUERIES, tokenizer_bytes
from tests.conftest import SF001
from tests.llm.conftest import docs_rows, words

RANKS = tokenizer_bytes("byte_bpe_multi_50k.tiktoken")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def tiktoken_ids(text):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RANKS.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return enc.encode_ordinary(text or "")


def test_bpe_equals_tiktoken_and_round_trips(docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RANKS.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r[0], enc.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in docs_rows()), key=repr)
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted(((r[0], list(r[1]), bytes(r[2])) for r in got.collect()), key=repr) == want
    # the dictionary's size changes nothing
    few = byte_bpe.encode(docs, RANKS, P.PATTERN, dictionary_words=0)
    assert sorted(((r[0], list(r[1])) for r in few.collect()), key=repr) == [w[:2] for w in want]


def test_bpe_dictionary_is_put_together_by_tasks(spark, monkeypatch):
    """The words' ids lie in their buckets, and no word passes through the driver's Python."""
    rows = spark.createDataFrame([(0, "some words come twice, others <|x|> once"), (1, "some words come twice \u00e9t\u00e9"), (2, " \u00e9t\u00e9 words"), (3, None)], "doc_id long, text string")
    tables = byte_bpe.Tables(spark, byte_bpe.parse_ranks(RANKS))

    def refuse(*_):
        raise AssertionError("words on the driver")

    monkeypatch.setattr(type(rows), "toArrow", refuse)
    monkeypatch.setattr(type(rows), "toPandas", refuse)
    one = byte_bpe.dictionary(rows, tables, text="text", pattern=P.PATTERN, limit=100)
    buckets = one.select(F.size("t").alias("n"), F.filter(F.transform("t", lambda m, i: F.struct(i.alias("i"), m.alias("m"))), lambda x: F.size(x["m"]) > 0).alias("full")).collect()
    assert len(buckets) == 1 and buckets[0]["n"] == byte_bpe.WORD_BUCKETS
    got = {w: (x["i"], list(ids)) for x in buckets[0]["full"] for w, ids in x["m"].items()}
    twice = ["some", " words", " come", " twice", " \u00e9t\u00e9"]
    assert got == {w: (zlib.crc32(w.encode()) % byte_bpe.WORD_BUCKETS, tiktoken_ids(w)) for w in twice}
    none = byte_bpe.dictionary(rows, tables, text="text", pattern=P.PATTERN, limit=0)
    assert none.select(F.size("t"), F.size(F.filter("t", lambda m: F.size(m) > 0))).first()[:] == (byte_bpe.WORD_BUCKETS, 0)


def test_bpe_words_around_the_longest_fold(spark):
    texts = [" \u3000" * 200, "\u3000 " * 129 + "x", "\t\u2003\n" * 120, *[c * n for c in ("a", "\u00e9", "\U0001f600", "=") for n in (1, 2, 3, 5, 8, 63, 64, 65, 127, 128, 255, 256, 257)], " " + "\U0001f600" * 64]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, byte_bpe.encode(rows, RANKS, P.PATTERN).collect()))
    assert {i: list(v) for i, v in got.items()} == {i: tiktoken_ids(t) for i, t in enumerate(texts)}


def test_bpe_empty_table_and_query(spark, no_docs):
    assert byte_bpe.decode(byte_bpe.encode(no_docs, RANKS, P.PATTERN), RANKS).count() == 0
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RANKS.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op3_byte_bpe"](spark, SF001).collect():
        ids = enc.encode_ordinary(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


def test_token_counts_equal_the_library(spark, docs, no_docs):
    import sentencepiece

    model = tokenizer_bytes("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = sorted(((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in docs_rows()), key=repr)
    assert sorted_rows(token_counts.count_tokens(docs, model)) == want
    assert sorted_rows(token_counts.count_tokens(docs, model, batch_bytes=50)) == want
    assert token_counts.count_tokens(no_docs, model).count() == 0
    table = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in table), key=repr)
    assert sorted_rows(QUERIES["op6_token_counts"](spark, SF001).drop("over_limit")) == want


def shingles(text):
    w = [x.lower() for x in (text or "").encode().split()]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    top = {k: k for k, _ in sets if k is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is None or b is None or not s or not t:
                continue
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return sorted(((k, len(s), None if k is None else root(k)) for k, s in sets), key=repr)


def test_jaccard_components_equal_brute_force(docs, no_docs):
    want = brute_components([r[:2] for r in docs_rows()])
    got = jaccard_join.jaccard_components(docs)
    assert sorted_rows(got.select("doc_id", "n_shingles", "component_id")) == want
    assert len({c for _, _, c in want}) < len(want) - 20
    assert jaccard_join.jaccard_components(no_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_on_families_of_copies(spark, seed):
    """Families whose members differ in a few words, at and around the limit."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = words(rng, rng.choice([4, 6, 9, 20, 60, 200]))
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(PARTS_LIKE)
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, 2)])))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted_rows(got.select("doc_id", "n_shingles", "component_id")) == brute_components(rows)


PARTS_LIKE = ["zeta", "eta", "theta", "iota"]


def test_jaccard_parities_rule_out_no_link():
    """Sets of all sizes up to a bucket's step and over it: what links passes, and sets far apart don't, so few texts are read."""
    rng = np.random.default_rng(3)
    passed = 0
    for n in [1, 2, 3, 7, 40, 63, 64, 65, 300, 512, 513, 700, 1025, 5000]:
        for share in (0.0, 0.5, 0.74, 0.8, 0.9, 1.0):
            for m in {n, max(1, round(n * 0.76)), round(n * 1.3)}:
                both = rng.integers(0, 1 << 64, max(n, m) * 2, np.uint64)
                common = round(share * min(n, m))
                a, b = both[:n], np.concatenate([both[:common], both[n : n + m - common]])
                near = jaccard_join.may_be_linked(n, jaccard_join.parities(a), m, jaccard_join.parities(b))
                if jaccard_join.linked(common, n, m):
                    assert near
                elif share <= 0.5 and n >= 40:
                    passed += near
    assert passed == 0


def test_jaccard_texts_are_read_for_near_pairs_only(spark, monkeypatch):
    """Texts that share a rare passage meet in the lists; their parities keep them from the join with the texts."""
    rng = random.Random(9)

    def fresh(n):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))

    rows = []
    for i in range(0, 60, 2):
        passage = fresh(20)
        rows += [(i, f"{fresh(60)} {passage}"), (i + 1, f"{fresh(60)} {passage}")]
    base = fresh(80)
    rows += [(100, f"{base} end"), (101, f"{base} fin")]
    counted, plain = [], jaccard_join.written

    def count(df, name):
        out = plain(df, name)
        counted.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "written", count)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {**{i: i for i in range(60)}, 100: 100, 101: 100}
    assert sum(n for name, n in counted if name == "jaccard-open") > 10
    assert sum(n for name, n in counted if name == "jaccard-texts") == 2


def test_ids_in_hashed_bits(spark):
    """Every id asked for passes, few others do, with any number of bits."""
    rng = random.Random(5)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(3000)]
    rows = spark.createDataFrame([(i,) for i in ids + list(range(20000))] + [(None,)], "k long")
    asked = spark.createDataFrame([(i,) for i in ids], "k long")
    passed = {r["k"] for r in rows.where(maybe_among(F.col("k"), asked)).collect()}
    assert set(ids) <= passed and len(passed) < 3000 + 4000 and None not in passed
    assert rows.where(maybe_among(F.col("k"), asked.where("false"))).count() == 0


def test_jaccard_shuffles_no_texts_of_other_documents(spark, monkeypatch):
    """Where ids are too many for a broadcast, texts that no pair asks for stay out of the joins' shuffles."""
    rng = random.Random(11)

    def fresh(n):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))

    base, twin = fresh(80), fresh(40)
    rows = [(i, fresh(40)) for i in range(300)] + [(1000, base), (1001, f"{base} end"), (1002, twin), (1002, twin), (1003, twin), (None, base), (None, base)]
    joined, plain = {}, jaccard_join.written

    def filters(df):
        """Filters of a plan that look up the hashed bits."""
        return sum("bit_get" in line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line)

    def see(df, name):
        joined.setdefault(name, []).append(filters(df))
        return plain(df, name)

    monkeypatch.setattr(jaccard_join, "written", see)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
        assert got == [(False, i) for i in [*range(300), 1000, 1002]] + [(True, 0)] * 2
        assert all(joined["jaccard-texts"]) and filters(kept) >= 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_of_each_group_stays(docs, no_docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and jaccard_join.keep_one(no_docs).count() == 0
    want = {c for _, _, c in brute_components([r[:2] for r in docs_rows()])}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(want - {None})


def test_word_hashes_cut_words_as_python_does():
    texts = [r[1] for r in docs_rows()] + ["  lead", "", "trail \x0b\x0c", "one"]
    h, n = masked_lm.word_hashes(pa.array(texts))
    w = [[x.lower() for x in (t or "").encode().split()] for t in texts]
    assert n.tolist() == [len(x) for x in w]
    names = {}
    for word, value in zip([x for t in w for x in t], h.tolist(), strict=True):
        # words that differ only beyond the 64-byte period of the table may share a hash
        assert names.setdefault(word, value) == value


def test_long_texts_are_hashed_alike_in_any_chunk(monkeypatch):
    texts = pa.array([" ".join(words(random.Random(1), 4000)), "a b", "c" * 900])
    whole = masked_lm.word_hashes(texts)
    monkeypatch.setattr(masked_lm, "CHUNK", 100)
    small = masked_lm.word_hashes(texts)
    assert whole[0].tolist() == small[0].tolist() and whole[1].tolist() == small[1].tolist()


def test_network_gradient_and_probabilities():
    rng = np.random.default_rng(0)
    count = rng.integers(0, 50, masked_lm.VOCABULARY)
    net = masked_lm.Network.start(count, 1)
    net.members[:] = rng.normal(0, 0.3, net.members.shape)
    net.classes[:] = rng.normal(0, 0.3, net.classes.shape)
    around = rng.integers(0, masked_lm.VOCABULARY + 1, (1, 4))
    every = net.log_prob(np.arange(masked_lm.VOCABULARY), np.repeat(around, masked_lm.VOCABULARY, 0))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)
    target, many = rng.integers(0, masked_lm.VOCABULARY, 300), rng.integers(0, masked_lm.VOCABULARY, (300, 4))
    before = net.log_prob(target, many).mean()
    past = masked_lm.Network(np.zeros_like(net.flat))
    for _ in range(20):
        net.learn(target, many, past)
    assert net.log_prob(target, many).mean() > before + 0.5


def test_network_works_in_place():
    """A step equals the plain sums, and neither it nor scoring makes its arrays anew."""
    import tracemalloc

    rng = np.random.default_rng(2)
    side, n = 96, 8192
    net = masked_lm.Network.start(rng.integers(0, 50, side * side), 1)
    net.members[:], net.classes[:] = rng.normal(0, 0.3, net.members.shape), rng.normal(0, 0.3, net.classes.shape)
    target, around = rng.integers(0, side * side // 2, n), rng.integers(0, side * side + 1, (n, 4))
    tracemalloc.start()
    net.log_prob(target, around)
    assert tracemalloc.get_traced_memory()[1] < 1.9 * 4 * n * side  # logits once, not their exponentials too
    tracemalloc.stop()
    # the words of half of the classes: their gradient by plain sums, and the others as they were
    old, past = masked_lm.Network(net.flat.copy()), masked_lm.Network(np.zeros_like(net.flat))
    kind, member = np.divmod(target, side)
    _, h = old.hide(around)
    h = h.astype(np.float64)
    bias = np.zeros((side, side))
    for c, x, m in zip(kind, h, member, strict=True):
        p = np.exp(old.members[c * side : (c + 1) * side] @ x + old.member_bias[c * side : (c + 1) * side])
        bias[c] += p / p.sum()
        bias[c, m] -= 1
    net.learn(target, around, past)
    assert np.allclose(past.member_bias, (bias**2).ravel(), rtol=1e-2, atol=1e-3)
    assert np.allclose(net.member_bias, old.member_bias - masked_lm.RATE * bias.ravel() / (np.abs(bias.ravel()) + 1e-4), atol=1e-2)
    assert (net.members[side * side // 2 :] == old.members[side * side // 2 :]).all()


def test_lm_learns_word_order(spark, no_docs):
    """Held-out texts score higher than by word counts alone, and than with their words mixed."""
    rng = random.Random(4)
    names = [f"w{i}" for i in range(300)]

    def text():
        w, out = rng.randrange(300), []
        for _ in range(rng.randint(20, 60)):
            out.append(names[w])
            w = (w * 7 + rng.randrange(3)) % 300
        return out

    rows = [(i, " ".join(text())) for i in range(4000)]
    ids, count = masked_lm.encode_words(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    net = masked_lm.train(ids, count, rounds=6)
    known, number, _ = masked_lm.vocabulary(spark.createDataFrame(rows, "doc_id long, text string").select("text"))
    held = [text() for _ in range(100)]

    def mean(texts):
        h, n = masked_lm.word_hashes(pa.array([" ".join(t) for t in texts]))
        num, ends = masked_lm.numbers(h, known, number), np.concatenate([[0], np.cumsum(n)])
        row, at, _, _ = masked_lm.windows([num[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)])
        return net.log_prob(row[at], row[at[:, None] + masked_lm._AROUND]).mean()

    mixed = [rng.sample(t, len(t)) for t in held]
    assert mean(held) > -np.log(300) + 1 and mean(held) > mean(mixed) + 1


def test_lm_scores_every_row(docs, no_docs):
    out = masked_lm.score_documents(docs)
    got = sorted(((r["doc_id"], r["n_words"]) for r in out.collect()), key=repr)
    assert got == sorted(((r[0], len((r[1] or "").encode().split())) for r in docs_rows()), key=repr)
    bad = out.where("(n_words = 0 and (log_likelihood <> 0 or mean_log_prob is not null)) or (n_words > 0 and not log_likelihood < 0)")
    assert bad.count() == 0 and masked_lm.score_documents(no_docs).count() == 0
    assert out.select(F.sum("log_likelihood")).first()[0] < 0


def _clean_and_gibberish():
    """2,000 texts of 5,000 ordinary words, and 400 of words of random letters that occur once."""
    rng = random.Random(6)
    names = [f"{a}{b}" for a in words(rng, 50) for b in range(100)]
    rows = [(i, " ".join(rng.choices(names, k=50))) for i in range(2000)]
    return rows + [(2000 + i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(50))) for i in range(400)]


def test_lm_scores_gibberish_below_clean_text(spark):
    out = masked_lm.score_documents(spark.createDataFrame(_clean_and_gibberish(), "doc_id long, text string"))
    mean = {r["doc_id"]: r["mean_log_prob"] for r in out.collect()}
    assert len(mean) == 2400 and max(mean[i] for i in range(2000, 2400)) < min(mean[i] for i in range(2000)) - 1


def test_lm_divides_a_shared_number_among_its_words(spark):
    rows = [*_clean_and_gibberish(), (2400, None), (2401, "one two one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = masked_lm.count_words(docs.select("text"))
    ids, count = masked_lm.encode_words(docs, "doc_id", "text", counts)
    side = int(len(count) ** 0.5)
    each = {i: masked_lm.word_hashes(pa.array([t]))[0].view(np.int64).tolist() for i, t in rows}
    n = {}
    for h in each.values():
        for x in h:
            n[x] = n.get(x, 0) + 1
    frequent = set(sorted(n, key=lambda x: (-n[x], x))[: side * side - side])
    total, seen = [0.5] * side, [0.0] * side
    for x in set(n) - frequent:
        total[x % side] += n[x] + 0.5
        seen[x % side] += n[x] + 0.5
    share = {x: (n[x] + 0.5) / total[x % side] for x in set(n) - frequent}
    unseen = np.exp(masked_lm.log_unseen(side)) * 2**64 / side
    assert [a + unseen for a in seen] == pytest.approx(total)
    got = ids.join(masked_lm.rare_worth(ids, counts, side), "row", "left").select("k", (F.coalesce("worth", F.lit(0.0)) - F.col("totals")).alias("x"))
    got = {r["k"]: r["x"] for r in got.collect()}
    assert got == pytest.approx({i: sum(np.log(share[x]) for x in h if x in share) for i, h in each.items()})
    assert got[2400] == 0 and len(share) > 20000
    lost = masked_lm.rare_worth(ids, counts.where(F.lit(False)), side).agg(F.max("worth")).first()[0]
    assert lost < -30  # words without a count have the unseen words' share


def test_lm_numbers_grow_with_the_distinct_words(monkeypatch, spark):
    assert masked_lm.side_for(10) == 64 and masked_lm.side_for(10**9) > 2 * masked_lm.side_for(10**7) * 0.99 > 4 * 60
    monkeypatch.setattr(masked_lm, "GROWTH", 0.5)
    rows = spark.createDataFrame(_clean_and_gibberish(), "doc_id long, text string")
    known, number, count = masked_lm.vocabulary(rows.select("text"))
    assert len(count) == 158**2 and len(known) == len(set(number.tolist())) > 24000 and count.sum() == 120000  # every word has its own
    for side in (64, 65, 100, 158):
        net = masked_lm.Network.start(np.ones(side * side, np.int64), 1)
        assert net.side == side and net.members.shape == (side * side, masked_lm.WIDTH)
    out = masked_lm.score_documents(rows)
    assert out.where("log_likelihood < 0").count() == 2400


def test_lm_learns_from_every_word_once(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i + j) % 40}" for j in range(i % 12))) for i in range(400)]
    ids, count = masked_lm.encode_words(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    learned, average = [], masked_lm._average

    def recorded(copies, before):
        learned.append(copies.where("part = 0").agg(F.sum("weight")).first()[0] or 0)
        return average(copies, before)

    monkeypatch.setattr(masked_lm, "_average", recorded)
    for rounds in (masked_lm.ROUNDS, 1):
        learned.clear()
        masked_lm.train(ids, count, rounds=rounds)
        assert len(learned) == rounds and sum(learned) == count.sum() == sum(i % 12 for i in range(400))
    for parts in (1, 2):
        taken = sum(masked_lm.of_round(np.arange(9), turn, parts).astype(int) for turn in range(parts))
        assert taken.tolist() == [1] * 9
