"""The pipeline stage by stage and as a whole, on a small corpus."""

import random
from collections import Counter

import corpus_pipeline
from gridspark.llm import token_store
from gridspark.llm.queries import tokenizer_path


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = line(30)
    good = [line(80) for _ in range(40)]
    texts = [*good, good[0], good[1] + " end", f"{line(60)} {item} {line(20)}", "short", None, " ".join(f"{w}!!" for w in line(80).upper().split())]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), [set(range(43)), set(range(40)) | {42}, set(range(40))]
    for (_, stage), want in zip(corpus_pipeline.STAGES, kept, strict=False):
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns and {r.doc_id for r in at.collect()} == want
    mixed = corpus_pipeline.mixed(spark, at, str(tmp_path))
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(times) <= kept[2] and max(times.values()) <= 2
    words = {s: sum(80 * times[i] for i in kept[2] if i % 3 == s) for s in range(3)}
    assert words[0] > words[2] > words[1]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in out.collect()) == times
    want = token_store.token_report(mixed, tokenizer_path())
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_decontamination_judges_rows_alike_at_any_size(spark, tmp_path):
    """Items with their halves swapped go from 100 rows and from the same with 40,000 more."""
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [[f"i{i}x{k}" for k in range(30)] for i in range(24)]
    rows = [(i, f"{line(20)} {' '.join(t[15:] + t[:15])} {line(20)}") for i, t in enumerate(items)] + [(i, line(70)) for i in range(24, 100)]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    small = spark.createDataFrame(rows, "doc_id long, text string")
    large = small.union(spark.range(100, 40_100, 1, 4).selectExpr("id", "format_string('f%d g%d', id, id % 50)"))
    for docs in (small, large):
        kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
        assert [r.doc_id for r in kept.filter("doc_id < 100").orderBy("doc_id").collect()] == list(range(24, 100))
        assert kept.count() == docs.count() - 24


def test_decontamination_holds_when_common_words_fill_the_space(spark, tmp_path):
    """Items of rare and common words with their halves swapped go from 100 rows and from the same among 20,000."""
    rng = random.Random(9)
    line = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [[f"i{i}x{k}" if k % 3 else line(1)[0] for k in range(30)] for i in range(40)]
    rows = [(i, " ".join(line(20) + t[15:] + t[:15] + line(20))) for i, t in enumerate(items)] + [(i, " ".join(line(70))) for i in range(40, 100)]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    small = spark.createDataFrame(rows, "doc_id long, text string")
    large = small.union(spark.range(100, 20_000, 1, 4).selectExpr("id", "concat_ws(' ', transform(sequence(1, 30), k -> concat('w', pmod(xxhash64(id, k), 3000))))"))
    for docs in (small, large):
        kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
        assert [r.doc_id for r in kept.filter("doc_id < 100").orderBy("doc_id").collect()] == list(range(40, 100))
        assert kept.count() == docs.count() - 40
