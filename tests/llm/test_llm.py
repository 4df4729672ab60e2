"""Operators for training data against brute force, on rows with nulls, copies, long and odd texts."""

import itertools
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.llm import common as C
from gridspark.llm import decontaminate, jaccard_join, kneser_ney, language_id, mixing, quality_rules, suffix_dedup, token_store, warc, weak_labels
from gridspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin string"


def sentence(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % words}{rng.choice(['', '', '.', ','])}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(1, 200)) for _ in range(60)]
    passage = sentence(rng, 70)
    texts = base + base[:10] + [f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}" for _ in range(6)]
    for t in base[10:25]:  # near copies
        w = t.split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "one", "ONE", "a b c d", "A b C d", "a b c d e", "x y é́ \x01 z", "line\nline\nother\n\nline", "the same " * 80, "LOUD!! " * 60, "你好 世界 " * 30, "w " * 30_000]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), len(t or ""), "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


# ---------------------------------------------------------------- quality rules
def test_quality_base_columns(docs, rows):
    got = {r.doc_id: r for r in quality_rules.quality_report(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        w, t = words(text), text or ""
        lines = [x for x in t.split("\n") if words(x)]
        seen, dup = set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_filter_keeps_rows_whole(docs, empty):
    kept = {r.doc_id for r in quality_rules.quality_report(docs).filter("kept").collect()}
    out = quality_rules.quality_filter(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert quality_rules.quality_report(empty).count() == 0


# ---------------------------------------------------------------- repeated passages
def test_repeated_spans(docs, rows, empty):
    texts = {i: [x.lower() for x in words(t)] for i, t, *_ in rows}
    count = Counter()
    for w in texts.values():
        count.update({tuple(w[j : j + 50]) for j in range(len(w) - 49)})
    want = set()
    for i, w in texts.items():
        cells = sorted({j + k for j in range(len(w) - 49) if count[tuple(w[j : j + 50])] > 1 for k in (0, 50)})
        hits = [j for j in range(len(w) - 49) if count[tuple(w[j : j + 50])] > 1]
        del cells
        for _, g in itertools.groupby(enumerate(hits), lambda p: p[1] - p[0]):
            run = [x for _, x in g]
            last = max((x for x in want if x[0] == i), key=lambda x: x[2], default=None)
            if last and run[0] <= last[2]:
                want.remove(last)
                want.add((i, last[1], run[-1] + 50))
            else:
                want.add((i, run[0], run[-1] + 50))
    assert {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_spans(docs).collect()} == want and want
    assert suffix_dedup.repeated_spans(empty).count() == 0


# ---------------------------------------------------------------- language
def test_language_id(spark, empty):
    rng = random.Random(1)
    stems = {"aa": ["tion", "ing", "the"], "bb": ["eau", "oui", "que"], "cc": ["ung", "sch", "der"]}
    data = [(i, " ".join("".join(rng.choices(stems[k], k=2)) for _ in range(30)), k) for i, k in enumerate(rng.choices(list(stems), k=240))]
    data += [(1000, None, "aa"), (1001, "12 ... 34", "aa"), (1002, "tion the ing", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_report(df).collect()}
    held = [i for i, *_ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i, r in got.items() if r.held_out and i < 1000] and {i for i, r in got.items() if r.held_out} == set(held)
    assert all(got[i].lang_pred == k for i, _, k in data if i < 1000)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1001].score == 0 and got[1002].lang_pred == "aa"
    assert language_id.language_report(empty).count() == 0


# ---------------------------------------------------------------- WARC
def test_warc_round_trip(spark, tmp_path):
    html = "<html lang='fr'><head><title>A &amp; B</title><style>x{}</style></head><body><p>One <b>two</b></p><script>no()</script><a href='/l?a=1&amp;b=2'>link</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html, "x"), (2, None, None, "x"), (3, "http://c/", "<p>open", "x")], "page_id long, url string, html string, record string")
    made = warc.derivatives(warc.responses(pages))
    assert [r.file for r in warc.write_warc(made.coalesce(1), f"file://{tmp_path}/w").collect()] == ["part-00000.warc.gz"]
    back = list(warc.read_warc((tmp_path / "w/part-00000.warc.gz").read_bytes()))
    assert len(back) == 6
    by = {r.record_id: r for r in made.collect()}
    for h, block in back:
        r = by[h["WARC-Record-ID"]]
        assert warc.digest(block) == h["WARC-Block-Digest"] == r.block_digest and h["WARC-Refers-To"] == r.refers_to
    text = [b for h, b in back if h["WARC-Type"] == "conversion" and h.get("WARC-Target-URI") == "http://a/"][0]
    assert text.decode() == "A & B\nOne two\nlink"
    meta = [b.decode() for h, b in back if h["WARC-Type"] == "metadata" and h.get("WARC-Target-URI") == "http://a/"][0]
    assert "title: A & B\r\n" in meta and "language: fr\r\n" in meta and "outlink: /l?a=1&b=2\r\n" in meta and "source-header: Content-Type: text/html" in meta
    assert warc.derivative_report(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- tokens
def test_token_store(docs, rows, spark, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in token_store.token_report(docs, tokenizer_path()).collect()}
    at = 0
    for i, text, *_ in sorted(rows):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)
    uri = C.shared_path(spark, "t")
    doubled = docs.union(docs.filter("doc_id = 3")).union(docs.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    token_store.write_store(doubled, tokenizer_path(), uri)
    store = token_store.Store(uri)
    assert len(store[3]) == 2 and len(store[None]) == 1 and store[10**9] == []
    assert store[5][0].tolist() == [*tok.encode(rows[5][1], add_special_tokens=False).ids, 2]
    assert token_store.token_report(empty, tokenizer_path()).count() == 0


def test_perfect_hash_is_minimal():
    keys = token_store.key_hashes(pa.array(range(5000), pa.int64()))
    entry = np.zeros(5000, token_store.INDEX_ROW)
    entry["row"], entry["print"] = np.arange(5000), token_store.prints(keys)
    index = token_store.Index(token_store.build_index(keys, entry))
    slots = index.find(keys)
    assert sorted(slots) == list(range(5000)) and (index.rows["row"][slots] == np.arange(5000)).all()
    assert (index.find(token_store.key_hashes(pa.array(range(10**6, 10**6 + 1000), pa.int64()))) == -1).all()


# ---------------------------------------------------------------- Jaccard join
def shingles(text):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_join(docs, rows, empty):
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_report(docs).collect()} == want
    assert {r.doc_id for r in jaccard_join.first_of_each(docs).collect()} == {i for i, (_, c) in want.items() if i == c}
    assert jaccard_join.join_report(empty).count() == 0


def test_jaccard_join_in_large_regions(spark, monkeypatch):
    """Many near copies around 0.75 share frequent shingles: blocks must connect what pairs would."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = base.copy()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_report(df).collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) > 1


def test_stages_judge_rows_whose_ids_are_null_or_repeat(spark):
    rng = random.Random(13)
    line = lambda n=60: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c, d, e, f, g, item = (line() for _ in range(8))
    held = f"{line()} {item} {line()}"
    rows = [(None, a, "s"), (None, b, "s"), (None, b + " end", "s"), (1, c, "s"), (1, c, "t"), (1, c, "t"), (1, d, "s"), (2, e, "s"), (3, e, "s"), (3, f, "s"), (4, g, "s"), (None, g, "s"), (None, None, "s"), (None, None, "s"), (5, "", "s"), (5, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = jaccard_join.first_of_each(docs)
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    late = [x for x in ((None, b), (None, b + " end")) if not got[x]]
    assert kept.columns == docs.columns and len(late) == 1
    assert got == Counter(x[:2] for x in rows if x[:2] not in (*late, (3, e), (None, g))) - Counter({(1, c): 2})
    docs = spark.createDataFrame([(None, held), (None, a), (7, b), (7, held), (None, None), (8, c)], "doc_id long, text string")
    kept = decontaminate.clean(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter([(None, a), (7, b), (None, None), (8, c)])


def test_components_by_rounds(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a long, b long").filter("a <> b")
    one = {(r.node, r.component) for r in C.components(spark, df, "a", "b").collect()}
    assert one == {(r.node, r.component) for r in C._rounds(spark, df.toDF("u", "v")).collect()}


# ---------------------------------------------------------------- decontamination
def test_decontamination(spark, empty):
    rng = random.Random(4)
    plain = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = [plain(25) for _ in range(4)]
    changed = item[1].split()
    changed[3] = changed[11] = "other"
    texts = [plain(120) for _ in range(20)]
    texts += [f"{texts[0]} {item[0].upper()} {texts[1]}", f"{texts[2]} {' '.join(changed)}", item[2], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(item), (9, None), (10, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(20, 0), (21, 1), (22, 2)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(25)) - {20, 21, 22}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    keyed = bench.withColumn("answer", F.when(F.col("item_id") == 0, "nowhere to be found"))
    assert (20, 0) not in {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, keyed).collect()}


def test_decontamination_finds_all_of_many_items(spark):
    """Items far beyond the rank of the latent space, each verbatim in one document."""
    rng = random.Random(11)
    plain = lambda n: " ".join(f"w{min(int(rng.paretovariate(0.4)), 30_000)}" for _ in range(n))
    items = [plain(rng.randint(15, 59)) for _ in range(2000)]
    docs = spark.createDataFrame([(i, f"{plain(80)} {t} {plain(80)}") for i, t in enumerate(items)], "doc_id long, text string").repartition(4)
    got = decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).filter("doc_id = item_id").collect()
    assert len(got) == len(items) and all(r.cover == 1 for r in got)


def test_decontamination_of_short_and_long_items(spark):
    """Items of 1 to 400 words, verbatim or with a quarter of the words replaced, among rarer words."""
    rng = random.Random(12)
    often = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rare = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    items = [["only1"], ["two2", "words2"], [f"five{i}" for i in range(5)], *(often(n) for n in (10, 12, 15, 20)), *(often(400) for _ in range(4))]
    texts = [rare(100) + t + rare(100) for t in items]
    for t in items[3:7]:
        df = Counter(w for x in texts for w in set(x))
        spare = sorted(range(len(t)), key=lambda i: -df[t[i]])[: len(t) // 4]
        texts.append(rare(100) + [w if i not in spare else rare(1)[0] for i, w in enumerate(t)] + rare(100))
    texts += [["words2", "two2"], ["two2", "x", "words2"], [f"five{i}" for i in (0, 1, 2, 4)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(i, i) for i in range(11)} | {(11 + i, 3 + i) for i in range(4)}


def test_decontamination_with_answers_beside_the_question(spark):
    rng = random.Random(14)
    line = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    ask, answer = line(20), "forty two apples"
    texts = [f"{line(60)} {ask} The answer: {answer} {line(60)}", f"{line(60)} {answer}. {ask} {line(60)}", f"{ask} {answer}", f"{line(60)} {ask} {line(200)} {answer}", f"{line(60)} {ask} {line(60)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, ask, answer)], "item_id long, text string, answer string")
    got = decontaminate.leaks(docs, bench).collect()
    assert {r.doc_id for r in got} == {0, 1, 2} and all(r.cover == 1 and r.end_word - r.start_word == 20 for r in got)


def test_latent_space_is_that_of_all_documents(spark):
    """Words of single documents among 40,000, and singular vectors against numpy's over every row."""
    texts = F.when(F.col("id") % 1000 == 7, F.format_string("rare%d rare%d common%d", F.col("id"), (F.col("id") + 1000) % 40_000, F.col("id") % 7)).otherwise(F.format_string("common%d filler%d", F.col("id") % 7, F.col("id") % 11))
    docs = spark.range(0, 40_000, 1, 4).select(texts.alias("text"))
    hashes, _ = decontaminate.words([f"rare{i}" for i in range(7, 40_000, 1000)] + [f"common{i}" for i in range(7)])
    used, weights = C.distinct(decontaminate.feature(hashes)), decontaminate.idf(docs)
    assert len(used) == 47
    ids, vectors = decontaminate.latent_space(docs, weights, used, rank=7, extra=73)
    assert ids.tolist() == used.tolist()
    rows = Counter(r.text for r in docs.collect())
    a = np.zeros((len(rows), 1 << decontaminate.FEATURE_BITS), np.float32)
    for row, (text, n) in zip(a, rows.items(), strict=True):
        f, w = decontaminate.tf_idf(decontaminate.words([text])[0], weights)
        row[f] = w * math.sqrt(n)
    exact = np.linalg.svd(a[:, used].astype(float), full_matrices=False)[2][:7]
    assert np.allclose(vectors @ vectors.T, exact.T @ exact, atol=1e-5)


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 70))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b)[0] == t[-1, -1]


# ---------------------------------------------------------------- language model
def test_kneser_ney(docs, rows, empty):
    texts = {i: [x.lower() for x in words(t)] for i, t, *_ in rows}
    train = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi = Counter(), Counter()
    for w in train:
        uni.update([*w, "E"])
        bi.update(zip(["S", *w], [*w, "E"], strict=True))
    n, v, types = sum(uni.values()), len(uni), len(bi)
    kinds, total, few = Counter(), Counter(), defaultdict(Counter)
    for (h, x), c in bi.items():
        kinds[x] += 1
        total[h] += c
        few[h][min(c, 3)] += 1
    d2 = kneser_ney.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    d1 = kneser_ney.discounts([sum(c == k for c in kinds.values()) for k in (1, 2, 3, 4)])
    spare = sum(d1[min(c, 3) - 1] for c in kinds.values()) / types
    one = lambda x: (max(kinds[x] - d1[min(kinds[x], 3) - 1], 0) / types if kinds[x] else 0) + spare / (v + 1)

    def two(h, x):
        if not total[h]:
            return one(x)
        c = bi[h, x]
        return (max(c - d2[min(c, 3) - 1], 0) if c else 0) / total[h] + sum(d2[k - 1] * m for k, m in few[h].items()) / total[h] * one(x)

    assert sum(two("S", x) for x in uni) + two("S", "unseen") == pytest.approx(1)
    for r in kneser_ney.lm_report(docs).collect():
        w = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in uni for x in [*w, "E"]), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in [*w, "E"]))
        assert r.score == pytest.approx(sum(math.log10(two(h, x)) for h, x in zip(["S", *w], [*w, "E"], strict=True)))
    assert kneser_ney.lm_report(empty).count() == 0


# ---------------------------------------------------------------- mixing
def test_targets():
    assert mixing.targets([100, 100, 100]) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 10]) == [0, 15]


def test_fit_is_as_near_as_any_choice():
    rng = random.Random(0)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 30), 4))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 80)
        take = mixing.fit(lengths, counts, budget)
        got = sum(n * t for n, t in zip(lengths, take, strict=True))
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and got <= budget
        share = [c * budget // max(1, sum(n * c for n, c in zip(lengths, counts, strict=True))) for c in counts]
        best = max((s for t in itertools.product(*(range(min(a, c), c + 1) for a, c in zip(share, counts, strict=True))) if (s := sum(n * k for n, k in zip(lengths, t, strict=True))) <= budget), default=0)
        assert got == min(best, sum(n * c for n, c in zip(lengths, counts, strict=True)))


def test_mix(docs, rows, empty):
    got = mixing.mix_report(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix_report(docs.repartition(5)).collect()}
    assert {r.doc_id: r.taken for r in got} == again and len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(words(r[1])) for r in rows}
    for s in (None, "s1", "s2"):
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(r.size == size[r.doc_id] and r.taken in (0, r.size, 2 * r.size) for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(60, 0.02 * mine[0].target) or s == source[rows[-1][0]]
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(mixed[r.doc_id] * r.size == r.taken for r in got if r.size)
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- weak labels
def test_weak_labels(spark, empty):
    rng = random.Random(6)
    good = [sentence(rng, 80) for _ in range(300)]
    bad = [" ".join(x.upper() + "!!" for x in sentence(rng, 80).split()) for _ in range(30)] + [" ".join(x + "%%%" for x in sentence(rng, 80).split()) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate([*good, *bad, None, ""])), "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in weak_labels.quality_scores(df).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 360))
    assert weak_labels.quality_scores(empty).count() == 0


def test_blobs_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**63, 100).astype(np.uint64))
    for n in (100, 1, 0):
        back = C.unpack(C.pack(keys[:n], np.arange(n, dtype=np.uint32)))
        assert (back[0] == keys[:n]).all() and (back[1] == np.arange(n)).all()


def test_store_meta(spark, docs):
    uri = C.shared_path(spark, "m")
    meta = token_store.write_store(docs, tokenizer_path(), uri)
    assert json.loads(token_store.get(f"{uri}/meta.json")) == meta
