"""Operators that draw, rearrange and select documents: 11, 12, 13."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from brute import corpus, documents, prose
from pyspark.sql import functions as F

from bridgelens.llm import catalog, exact_dedup, fill_middle, importance

KEY = lambda r: tuple((x is not None, x) for x in r)


@pytest.fixture(scope="module")
def rows():
    return corpus(seed=19)


# --- 11: importance resampling


def runs_of(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[k : k + n]).encode() for n in range(1, max_n + 1) for k in range(len(words) - n + 1)]


def resampled(rows, items, buckets=10_000, max_n=1, percent=10, least=20, seed=2024):
    """Plain version: {(doc_id, text): (n_words, n_features, weight, score)}, and the drawn (score, doc_id) in order."""
    own = [runs_of(t, max_n) for _, t in rows]
    s, t = (Counter(zlib.crc32(f) % buckets for _, fs in side for f in fs) for side in (own, [runs_of(x, max_n) for x in items]))
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets)))) for b in s}
    out, able = {}, []
    for (i, text), (n, fs) in zip(rows, own, strict=True):
        weight = sum(gain[zlib.crc32(f) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i, text] = (n, len(fs), weight, score)
        if n >= least:
            able.append((-score, i is None, i or 0))
    return out, [(-a, None if none else i) for a, none, i in sorted(able)[: percent * len(able) // 100]]


@pytest.mark.parametrize(("max_n", "buckets", "percent", "size"), [(1, 10_000, 10, 1 << 16), (2, 70_000, 50, 40), (3, 97, 100, 5), (1, 10_000, 1, 0)])
def test_resample_against_brute_force(spark, rows, max_n, buckets, percent, size):
    extra = [*rows, (900, "É" * 300 + " it's ÀB c_d 9x " * 9), (901, "ſ K İ x" * 30)]
    items = [rows[3][1], None, "", "the of and to", rows[8][1]]
    want, drawn = resampled(extra, items, buckets, max_n, percent)
    target = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "item_id long, text string")
    found = importance.resample(documents(spark, extra), target, buckets, max_n, percent=percent, head_size=size).collect()
    assert sorted((tuple(r)[:5] for r in found), key=KEY) == sorted(((i, *want[i, t]) for i, t in extra), key=KEY)
    ranked = sorted((r["rank"], r["score"], r["doc_id"]) for r in found if r["rank"] is not None)
    assert [r for r, _, _ in ranked] == list(range(1, len(drawn) + 1))
    assert [(s, i) for _, s, i in ranked] == drawn


def test_resample_of_few_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(documents(spark, []), none).collect() == []
    found = importance.resample(documents(spark, [(1, None), (2, ""), (None, "a b")]), none).collect()
    assert sorted(((r["doc_id"], r["n_features"], r["rank"]) for r in found), key=KEY) == [(None, 2, None), (1, 0, None), (2, 0, None)]
    same = documents(spark, [(5, "word " * 30)] * 40 + [(4, "word " * 30)])
    found = importance.resample(same, none, percent=50).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21))


def test_head_holds_all_from_a_count_on(spark):
    docs = documents(spark, [(1, "b a a c"), (2, "A b"), (3, None), (4, "a-b " + "x" * 70), (5, "x" * 70)])
    assert sorted(importance.head(docs, 1, 3)) == [b"a", b"b", b"c"]
    assert sorted(importance.head(docs, 1, 2)) == [b"a", b"b"]
    assert importance.head(docs, 1, 1) == [b"a"]
    assert importance.head(docs, 2, 1) == [b"a b"]
    assert importance.head(docs, 1, 0) == [] == importance.head(documents(spark, []), 1)


# --- 12: fill in the middle


def plain_form(i, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_against_brute_force(spark, rows):
    rng = random.Random(2)
    odd = ["<P>", "a <S> b", "x<M>", "<<P", "é" * 5000, "日本語 𝄞 \x00 " * 900, "<P", "S><", "́a", prose(rng, 3000)]
    extra = [*rows, *[(2000 + 7 * k + j, t) for k, t in enumerate(odd) for j in range(7)]]
    out = fill_middle.fill_in_middle(documents(spark, extra))
    found = out.withColumn("again", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    assert sorted((tuple(r)[:6] for r in found), key=KEY) == sorted(((i, *plain_form(i, t)) for i, t in extra), key=KEY)
    assert sorted(((r["doc_id"], r["again"]) for r in found), key=KEY) == sorted(((i, t or "") for i, t in extra), key=KEY)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(documents(spark, [])).collect() == []


def test_borders_of_units():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "é", "日", "𝄞", " ", "\n"]) for _ in range(rng.randint(0, 60)))
        for pattern in (None, re.compile(r"\s*\S+", re.S), re.compile("a+")):
            starts = range(len(text)) if pattern is None else fill_middle.unit_starts(text, pattern).tolist()
            blocks = fill_middle.Blocks(text.encode(), pattern, block=rng.choice([1, 2, 3, 8, 64]))
            assert blocks.n == len(starts)
            for k, at in enumerate([*starts, len(text)]):
                byte = len(text[:at].encode())
                assert blocks.border(k) == byte and blocks.chars_before(byte) == at


def test_fenwick_descent():
    rng = random.Random(6)
    for size in (0, 1, 2, 3, 7, 8, 9, 100):
        counts = [rng.choice([0, 0, 1, 5]) for _ in range(size)]
        tree = fill_middle.Fenwick(counts)
        things = [(b, k) for b, n in enumerate(counts) for k in range(n)]
        assert [tree.find(k) for k in range(len(things))] == things
        assert [tree.before(b) for b in range(size + 1)] == [sum(counts[:b]) for b in range(size + 1)]


def test_fill_in_middle_by_words(spark):
    docs = documents(spark, [(k, prose(random.Random(k), 40)) for k in range(40)])
    found = fill_middle.fill_in_middle(docs, rate=100, unit=r"\s*\S+").collect()
    for r in found:
        assert r["n"] == 40 and r["form"] != "plain"
        cut = re.split("<[PSM]>", r["output"])[1:]
        middle = cut[2]
        assert middle == "" or middle.startswith(" ") or r["prefix_chars"] == 0


# --- 13: exact duplicates


def equal_groups(rows):
    """(doc_id, text) -> (keep_id, group_size, text_sha256)."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), x in zip(rows, norm, strict=True):
        groups.setdefault(x, []).append(i)
    out = {}
    for (i, t), x in zip(rows, norm, strict=True):
        known = [k for k in groups[x] if k is not None]
        out[i, t] = (min(known) if known else None, len(groups[x]), hashlib.sha256(x.encode()).hexdigest())
    return out


def some_rows():
    rng = random.Random(23)
    rows = corpus(seed=29)
    rows += [(3000 + k, "hot   text" if k % 3 else "hot\ttext") for k in range(700)]  # over a third of all
    rows += [(5000, "twice"), (5000, "twice"), (5000, "other"), (None, "twice"), (None, "unnamed"), (None, "unnamed")]
    rows += [(6000 + k, x) for k, x in enumerate([" a", "a", "a ", "a\x0b", "a ", "\n", " ", "", None, "A", "a\x1c"])]
    rng.shuffle(rows)
    return rows


def test_exact_duplicates_against_brute_force(spark):
    rows = some_rows()
    want = equal_groups(rows)
    found = exact_dedup.exact_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=KEY) == sorted(((i, *want[i, t]) for i, t in rows), key=KEY)
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({w[2] for w in want.values()})
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    assert exact_dedup.exact_duplicates(documents(spark, [])).collect() == []


def test_winners_are_the_frequent_ones(spark):
    rows = documents(spark, some_rows())
    digests = exact_dedup.digests(rows)
    heavy = exact_dedup.winners(digests).collect()
    total = digests.count()
    counts = Counter(bytes(r["digest"]) for r in digests.collect())
    assert {bytes(r["digest"]): r["group_size"] for r in heavy} == {d: n for d, n in counts.items() if n * exact_dedup.SHARE >= total}


def test_frequent_digests_among_many(spark):
    """More distinct digests than counters: those with the share are found all the same."""
    rows = spark.range(0, 60_000, 1, 12).select(F.col("id").alias("doc_id"), F.unhex(F.sha2(F.when(F.col("id") % 250 < 2, F.col("id") % 250).otherwise(F.col("id")).cast("string"), 256)).alias("digest"), F.col("id").alias("row"))
    found = exact_dedup.winners(rows).collect()
    assert sorted(r["group_size"] for r in found) == [240, 240]


def test_tasks_without_rows(spark, tmp_path):
    documents(spark, [(k, f"text {k % 5}") for k in range(6)]).repartition(40).write.parquet(f"{tmp_path}/documents")
    conf = {"spark.sql.files.openCostInBytes": "1g", "spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.read.parquet(f"{tmp_path}/documents").repartition(30)
        found = exact_dedup.exact_duplicates(docs).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found) == [(0, 0, 2, True), (1, 1, 1, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 1, True), (5, 0, 2, False)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_keep_first(spark):
    rows = some_rows()
    docs = documents(spark, rows)
    want = equal_groups(rows)
    out = exact_dedup.keep_first(docs)
    assert out.columns == docs.columns
    found = [(r["doc_id"], re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")) for r in out.collect()]
    assert sorted(found, key=KEY) == sorted({(w[0], re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for (_, t), w in want.items()}, key=KEY)


def test_no_python_worker_in_exact_dedup(spark):
    plan = exact_dedup.exact_duplicates(documents(spark, some_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_queries_match_their_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in dict((i, t) for i, t in some_rows() if i is not None).items()]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[0][1]), (2, None), (3, "the of and")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for name in catalog.oracle_sql():
        found = catalog.queries()[name](spark, str(tmp_path))
        asked = con.execute(catalog.oracle_sql()[name])
        columns = [d[0] for d in asked.description]
        assert sorted(map(tuple, found.select(*columns).collect()), key=KEY) == sorted(asked.fetchall(), key=KEY), name
