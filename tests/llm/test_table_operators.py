"""HTML extraction, embeddings, WARC, quality rules, sharding and mixing against plain Python."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.llm import html_dom, html_extract, mixing, near_vectors, quality, sharding, warc
from shelfrank.llm.queries import QUERIES
from tests.conftest import SF01, SF001
from tests.llm.conftest import docs_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 1 -------------------------------------------------------------------------------------------
def test_extraction_of_plain_layouts(spark):
    para = "The quick river runs, as it did before, past the old mill. Nobody knows why it turned north in spring. "
    art = f"<article><h1>River &amp; mill</h1><p>{para}<b>Bold</b>\n  end.</p><p>{para * 2}</p></article>"
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script><style>p{}</style></head><body><header class=site-header><h2>Site</h2></header>"
        f"<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class=ad>Buy now. Cheap.</div>{art}"
        "<div class=comments><p>Nice text, I liked it. Thanks.</p></div><aside class=sidebar><a href=/>More</a></aside><footer>&copy; 2024 us</footer></body></html>"
    )
    want = f"River & mill\n{(para + 'Bold end.')}\n{(para * 2).strip()}"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", page), (5, "u", "<nav><a href=/>only a menu</a></nav>"), (6, "u", page.replace(para * 2, para * 3000))]
    out = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert got[1] == got[4] == want and got[2] == got[3] == got[5] == ""
    assert got[6] == want.replace((para * 2).strip(), (para * 3000).strip())
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


M10 = 10_000_000
BROKEN = (
    "<" + "a" * M10, '<p "' * (M10 // 4), "<a " * (M10 // 3), "<a" * (M10 // 2), "<!" * (M10 // 2), "<" * M10, "<a '>' " * (M10 // 7), '<a b="' * (M10 // 6) + ">",
    "<a b='>' c=" * (M10 // 11), "</x>" * (M10 // 4), "<div>" * (M10 // 5), "<li><ul>" * 50 + "<li></li>" * (M10 // 9), "<!--" * (M10 // 4), "&#" + "9" * M10,
)


@pytest.mark.parametrize("html", BROKEN, ids=[h[:9] for h in BROKEN])
def test_ten_megabytes_of_broken_markup_take_seconds(html):
    start = time.perf_counter()
    text = html_extract.extract_pages([html], html_extract.trained_model())[0]
    assert time.perf_counter() - start < 60 and len(text) <= len(html)


def test_markup_reader():
    def texts(html):
        return "".join(t for _, t, _ in html_dom.Page(html).pieces)

    assert texts("a<p title='x>y' data-a=\"b>c\">d</p >e") == "ade"
    assert texts('<p alt="it\'s 5" tall">text</p>') == "text"  # a quote that opens no value
    assert texts('<p a="open>text <p b=">">more') == '">more'  # closed by a later tag's quote
    assert texts('<p a="open>text <b>more</b>') == "text more"  # never closed
    assert texts("1 < 2 <3 </ 4 <!-- <p> --> <!doctype x> <?y?>5<br/>6") == "1 < 2 <3 </ 4   5 6"
    assert texts("x <p class='") == "x " and texts("x < y <") == "x < y <" and texts("a<!-- b") == "a"
    assert texts("&#65;&#0000000000066;&#x43;&#99999999999999;&amp;&unknown;") == "ABC\ufffd&&unknown;"
    deep = html_dom.Page("<div>" * 2000 + "<p>inside</p>")
    assert max(deep.depth) < html_dom.MAX_DEPTH and len(deep.parent) == 2002


def test_extraction_query_covers_all_pages(spark):
    out = QUERIES["op1_html_extract"](spark, SF01)
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    assert out.count() == pages.count()
    marks = out.where("text rlike '</?[a-z]+>' or text like '%track(%' or n_chars <> char_length(text)")
    assert marks.count() == 0


def test_decoding_has_no_contradictions():
    from shelfrank.llm.html_layouts import training_pages

    pages, labels = training_pages(60, seed=99)
    model = html_extract.trained_model()
    x, t = html_extract.node_features(pages)
    inside = html_extract.decode_tree(model.log_odds(x), t)
    y = np.concatenate(labels)
    text = t["own"] > 0  # held-out accuracy on nodes with text
    assert (inside[text] == y[text]).mean() > 0.95


# --- 4 -------------------------------------------------------------------------------------------
def vectors_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(300):
        v = base[i % 40] + rng.normal(size=16) * 0.04
        rows.append((i, v.tolist(), i % 40 % 3, "x"))
    rows += [(300 + i, rows[5][1], rows[5][2], None) for i in range(4)]  # exact copies
    rows += [(400, None, 0, ""), (401, [0.0] * 16, 0, ""), (402, [float("nan")] * 16, 0, ""), (403, [1.0, None], 0, ""), (404, rows[0][1], None, ""), (405, [1e300] * 16, 0, ""), (406, [1e-300] * 16, 0, ""), (407, [], 0, ""), (408, [1.0, 2.0], 0, "")]
    return rows


def brute_links(rows):
    def ok(v, lab):
        return lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = {i: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for i, v, lab, _ in rows if ok(v, lab)}
    lab = {i: x for i, _, x, _ in rows}
    return {(a, b) for a in unit for b in unit if a < b and lab[a] == lab[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98}


@pytest.mark.parametrize("block_rows", [512, 3])
def test_near_vectors_against_brute_force(spark, block_rows):
    rows = vectors_rows()
    links = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, block_rows=block_rows).collect()}
    assert len(got) == len(rows) and list(got[0].asDict()) == ["vec_id", "n_links", "component_id", "kept"]
    n = Counter(x for ab in links for x in ab)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(n.values())
    assert all(r["n_links"] <= n[i] for i, r in got.items())
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i) and (r["n_links"] > 0 or r["component_id"] == i)
    assert {got[i]["n_links"] for i in (400, 401, 402, 403, 404, 407, 408)} == {0} and got[405]["n_links"] == 1


def test_near_vectors_with_a_grid(spark, monkeypatch):
    """Many cells: recall stays over 0.9 and nothing below the limit links."""
    monkeypatch.setattr(near_vectors, "CELL_ROWS", 2)
    rows = vectors_rows()
    links = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_vectors(df).collect()}
    n = Counter(x for ab in links for x in ab)
    assert 0.9 * sum(n.values()) <= sum(got.values()) and all(got[i] <= n[i] for i in got)
    empty = spark.createDataFrame([], df.schema)
    assert near_vectors.near_vectors(empty).count() == 0


# --- 7 -------------------------------------------------------------------------------------------
def pages_rows():
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}?q=é%20", f"<p>{rng.randint(0, 60)}</p>" * rng.randint(1, 5), "x") for i in range(200)]
    return rows + [(200, None, None, ""), (201, "u", "", ""), (202, "u", None, ""), (203, "u\r\nv", "big " * 400_000, ""), (204, "w", "big " * 400_000, "")]


def test_warc_round_trip(spark):
    rows = pages_rows()
    first = {}
    for i, _, html, _ in rows:
        first.setdefault((html or "").encode(), i)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(7)
    path = warc.warc_path(spark)
    manifest = warc.write_warc(df, path, shard_bytes=20_000, file_bytes=2_000)
    assert manifest.count() > 10 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert len(got) == len(rows)
    for i, url, html, _ in rows:
        body, r = (html or "").encode(), got[i]
        assert r["block_ok"] and r["payload_bytes"] == len(body) and r["payload_digest"] == warc.digest32(body) and r["url"] == url
        own = first[body] == i
        assert r["record_type"] == ("response" if own else "revisit") and r["refers_to"] == (None if own else first[body])
        assert (r["payload"] == body) if own else r["payload"] is None
    # another partitioning writes the same files
    again = warc.write_warc(df.repartition(3), warc.warc_path(spark), shard_bytes=20_000, file_bytes=2_000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))


def test_warc_of_an_empty_table(spark):
    path = warc.warc_path(spark)
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path).count() == 0
    assert warc.read_warc(spark, path).count() == 0


# --- 8 -------------------------------------------------------------------------------------------
def base_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(hit)


LABELS = "doc_id long, quality int, toxic int"


def test_quality_base_counts(spark, docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    got = quality.quality_rules(docs, none)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted(((r[0], *base_counts(r[1])) for r in docs_rows()), key=repr)
    assert sorted(map(tuple, got.select("doc_id", *names).collect()), key=repr) == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    kept = quality.keep_quality(docs, none)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality.quality_rules(no_docs, none).count() == 0 and quality.keep_quality(no_docs, none).count() == 0


def test_quality_cutoffs_limit_false_rejection(spark):
    """Junk goes, and no more than the stated share of good texts, on labels and without crashes on odd ones."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        good = rng.random() < 0.7
        w = [("w%d" % rng.randrange(500)) if good or rng.random() < 0.4 else "x%%%&&|" for _ in range(rng.randint(30, 60))]
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "s", 0))
        labels.append((i, int(good), 0))
    labels += [(0, None, 0), (None, 1, 0), (5, 1 - labels[5][1], 0), (999_999, 1, 1)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS))
    kept = {r["doc_id"]: r["kept"] for r in got.where("not base_failed").collect()}
    truth = {i: q for i, q, _ in labels[:3000]}
    good, bad = [kept[i] for i in kept if truth[i]], [kept[i] for i in kept if not truth[i]]
    assert 1 - sum(good) / len(good) <= 2 * quality.MAX_FALSE and sum(bad) / len(bad) < 0.1


def test_binomial_tail_is_exact():
    from math import comb

    for k, n, p in ((0, 50, 0.02), (3, 100, 0.05), (40, 200, 0.2), (7, 7, 0.3)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


# --- 9 -------------------------------------------------------------------------------------------
def test_shards_and_permutation(spark, docs, no_docs):
    got = sharding.shard_rows(docs, shards=7).collect()
    rows = docs_rows()
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_rows(docs.repartition(3), shards=7)
    assert sorted(map(tuple, again.drop("row_no").collect()), key=repr) == sorted((tuple(r.asDict()[c] for c in again.drop("row_no").columns) for r in got), key=repr)
    assert sharding.shard_rows(no_docs).count() == 0
    for n in (1, 2, 5, 1000, 4097):
        i = np.arange(n)
        p = sharding.permute(i, n)
        assert sorted(p.tolist()) == i.tolist() and (sharding.unpermute(p, n) == i).all()
        shard, slot = sharding.locate(i, n, 3)
        assert (sharding.row_at(shard, slot, n, 3) == i).all()


# --- 10 ------------------------------------------------------------------------------------------
def brute_targets(sizes, ratio=1.5, weights=(3, 1, 2), cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, budget = {}, set(order), ratio * sum(sizes.values())
    while free:
        left = budget - sum(target.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s]]
        if not over:
            target.update({s: left * w[s] / sum(w[x] for x in free) for s in free})
            break
        for s in over:
            target[s] = cap * sizes[s]
            free.discard(s)
    return target


def test_mix_meets_its_targets(spark, docs, no_docs):
    big = spark.read.parquet(f"{SF01}/documents.parquet")
    for table in (docs, big):
        rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in table.collect()]
        sizes = Counter()
        for _, s, n in rows:
            sizes[s] += n
        target = brute_targets(sizes)
        got = mixing.mix_copies(table).collect()
        assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=repr) == sorted(rows, key=repr)
        taken = Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        for s in sizes:
            most = max(n for _, x, n in rows if x == s)
            assert abs(taken[s] - target[s]) <= most
    mixed = mixing.apply_mix(big)
    assert mixed.columns == big.columns
    assert sorted(Counter(r["doc_id"] for r in mixed.collect()).values())[-1] <= 2
    assert mixing.mix_copies(no_docs).count() == 0 and mixing.apply_mix(no_docs).count() == 0


def test_mix_reruns_agree_on_repeated_ids(spark):
    rng = random.Random(8)
    texts = ["a b c", "a b c", "one two three four five", "x"]
    repeated = [(7, rng.choice(texts), "s0", i % 2, "c") for i in range(900)]  # one id: rows that differ, and equal ones
    equal = [(8, "p q r s t u v", "s1", 0, "c")] * 500  # nothing parts them
    rows = repeated + equal + [(9, None, "s2", 0, None), (10, "last words here", None, 1, "d")]
    schema = "doc_id long, text string, source string, copies int, col string"
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    target = brute_targets(sizes)
    seen, mixed = set(), set()
    for parts in (1, 3, 7):
        table = spark.createDataFrame(rng.sample(rows, len(rows)), schema).repartition(parts)
        got = [tuple(r[c] for c in ("doc_id", "source", "size", "taken")) for r in mixing.mix_copies(table).collect()]
        assert len(got) == len(rows)
        seen.add(tuple(sorted(got, key=repr)))
        again = mixing.apply_mix(table)
        assert again.columns == table.columns
        mixed.add(tuple(sorted(map(tuple, again.collect()), key=repr)))
    assert len(seen) == len(mixed) == 1
    taken, words = Counter(), Counter()
    for _, s, _, n in seen.pop():
        taken[s] += n
    for r in mixed.pop():
        words[r[2]] += len(WORD.findall(r[1] or ""))
    for s, most in (("s0", 5), ("s1", 7), ("s2", 0), (None, 3)):
        assert abs(taken[s] - target[s]) <= most and abs(words[s] - target[s]) <= most


def test_mix_plan_is_native(docs):
    plan = mixing.mix_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_registered_contract_columns(spark):
    want = {
        "op1_html_extract": "page_id url text n_chars", "op4_multi_index": "vec_id n_links component_id kept", "op6_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op9_feistel_shards": "doc_id size text_crc32 law shard slot grown_shard", "op10_source_mix": "doc_id size source_size target taken",
    }
    for name, columns in want.items():
        out = QUERIES[name](spark, SF001)
        assert set(columns.split()) <= set(out.columns), name
        assert out.count() > 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    kept = p.quality_stage(spark, docs, SF001)
    assert kept.columns == docs.columns
    one = p.join_stage(spark, kept, SF001)
    ids = [r["doc_id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in kept.collect()}
    mixed = p.mixing_stage(spark, one, SF001)
    assert mixed.columns == docs.columns
    out = p.run(spark, SF001).collect()
    want = Counter(r["doc_id"] for r in mixed.collect())
    assert Counter(r["doc_id"] for r in out) == want
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)


def _xx(word, seed, back=False):
    """XXH64 of a long, as Spark chains it; ``back``: the long whose hash with ``seed`` is ``word``."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    m = (1 << 64) - 1

    def turn(x, n):
        return ((x << n) | (x >> (64 - n))) & m

    def inv(p):
        return pow(p, -1, 1 << 64)

    def unshift(x, n):
        y = x
        for _ in range(64 // n + 1):
            y = x ^ (y >> n)
        return y

    start = (seed + p5 + 8) & m
    if not back:
        h = start ^ (turn(word * p2 & m, 31) * p1 & m)
        h = (turn(h, 27) * p1 + p4) & m
        h = (h ^ (h >> 33)) * p2 & m
        h = (h ^ (h >> 29)) * p3 & m
        return h ^ (h >> 32)
    h = unshift(word, 32) * inv(p3) & m
    h = unshift(h, 29) * inv(p2) & m
    h = unshift(h, 33)
    h = turn((h - p4) * inv(p1) & m, 64 - 27) ^ start
    return turn(h * inv(p1) & m, 64 - 31) * inv(p2) & m


def test_vectors_of_one_hash_are_not_equal(spark):
    """Two vectors of one xxhash64 link only if they are near."""
    bits = lambda x: int(np.float64(x).view(np.uint64))
    goal = _xx(bits(2.0), _xx(bits(1.0), 42))
    for i in range(1, 1000):
        a = i * 1e-3
        b = float(np.uint64(_xx(goal, _xx(bits(a), 42), back=True)).view(np.float64))
        if 1e-3 < abs(b) < 1e3 and abs(a + 2 * b) / np.hypot(a, b) / np.sqrt(5) < 0.9:
            break
        if 1e-30 < abs(b) < 1e-4 or 1e4 < -b < 1e30:
            break
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [a, b], 0), (3, [1.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    assert rows.select(F.xxhash64("embedding")).distinct().count() == 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(rows).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1)}


def test_cutoffs_are_tried_below_half():
    """With good texts at low scores only, the cutoff is the last one whose exact test passes."""
    counts = np.zeros(quality.STEPS, np.int64)
    counts[:40], counts[200], counts[700] = 50, 3, 4
    n = int(counts.sum())
    passed = [quality.binomial_tail(int(counts[c:].sum()), n, 0.02) <= 0.05 for c in range(quality.STEPS)]
    want = max(c for c in range(quality.STEPS) if not passed[c]) + 1
    assert want < 100 and quality.choose_cutoff(counts, 0.02, 0.05) == want
