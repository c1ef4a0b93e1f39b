"""Operators of the training-data subpackage against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gapweave.llm import decontamination, mixing, quality_rules, sharding, simhash, suffix_dedup, token_attribution, token_files, toxicity, url_reputation
from gapweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows(spark):
    """Nulls, blanks, ties, repeated rows, a very long text, columns with clashing names."""
    rng = random.Random(7)
    long = words(rng, 20_000)
    base = words(rng, 120)
    near = base.replace(" ", "  ", 3) + " tail"
    texts = [None, "", " \n\t ", "one", "a b c", base, base, near, long, long + " x", base + "\n" + base, words(rng, 60), "<|endoftext|> Été É’s don't", "#$% " * 30]
    rows = [(i if i != 3 else None, t, None, [None, "a", "b"][i % 3], 1, "n", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[5:6], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_rows(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 5), (3, 9), (4, 4)], "u long, v long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 7: 5}


def brute_components(ids, prints, bits):
    comp = list(range(len(ids)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_odd_rows(spark, odd, empty):
    rows = odd.collect()
    prints = [simhash.fingerprint(simhash.shingle_hashes((r.text or "").encode(), 4, 42)) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], brute_components([r.doc_id for r in rows], prints, 4)), key=repr)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(odd).collect()), key=repr)
    assert got == want
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("bits", [3, 4, 7])
def test_simhash_links_find_all_pairs(spark, bits):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:30]:
        for _ in range(3):
            x = p
            for b in rng.sample(range(64), rng.randint(1, 9)):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "node long, fp0 long")
    got = [tuple(r) for r in simhash.links(df, bits).collect()]
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= bits}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_of_each_keeps_one_row(spark, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    base = odd.filter("doc_id = 5").first().text
    assert sum(t is not None and t.startswith(base[:100]) and "\n" not in t for t in texts) == 1


def test_near_duplicates_equal_brute_force_on_pairs(spark):
    rng = random.Random(12)
    texts = []
    for n in range(160):  # pairs alone, at similarities just below, at and above 0.8
        w = [f"{n}x{rng.randrange(10**6)}" for _ in range(94)]
        texts += [" ".join(w), " ".join(w[: (72, 70, 76, 68)[n % 4] + 4] + [f"y{n}"] * (0, 0, 2, 1)[n % 4])]
    sets = [set(simhash.shingle_hashes(t.encode(), 5, 42)) for t in texts]  # every fourth pair: 72 of 90, exactly 0.8
    alike = {(i, i + 1) for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert 40 <= len(alike) < 160
    rows = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    classes = {}
    for r in rows:
        classes.setdefault(r.component, []).append(r.doc_id)
    assert {tuple(sorted(c)) for c in classes.values() if len(c) > 1} == alike
    assert sum(r.keeper for r in rows) == len(texts) - len(alike)


def test_decontamination_equals_brute_force(spark, odd, empty):
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate([3, 5, 8, 15, 40, 90, 300])] + [(8, None), (9, "")]
    docs = []
    for i, (_, t) in enumerate(items[:7]):
        w = t.split()
        docs.append((100 + i, words(rng, 500) + " " + t.upper() + " " + words(rng, 2000)))
        docs.append((200 + i, words(rng, 30) + " " + " ".join(w[: len(w) * 9 // 10]) + " " + words(rng, 30)))
        docs.append((300 + i, " ".join(w[: len(w) // 2]) + " " + words(rng, 50)))
        docs.append((400 + i, t))
    docs = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for r in docs.collect():
        own = decontamination.shingle_strings((r.text or "").encode(), 5)
        for i, t in items:
            q = decontamination.shingle_strings((t or "").encode(), 5)
            if q and len(q & own) >= 0.8 * len(q):
                want.add((r.doc_id, i))
    for block in (20_000, 2):
        assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, block_items=block).collect()} == want
    clean = decontamination.without_contaminated(docs, bench)
    assert clean.count() == docs.filter(~docs.doc_id.isin([d for d, _ in want]) | docs.doc_id.isNull()).count()
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_repeats_equal_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        size = rng.choice([3, 5, 8, 12])
        regions = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(size, 40))) for _ in range(rng.randint(1, 6))]
        weight = np.array([rng.choice([1, 1, 2]) for _ in regions])
        starts = np.array([len(r) - size + 1 for r in regions])
        count = {}
        for r, w in zip(regions, weight):
            for i in range(len(r) - size + 1):
                count[r[i : i + size]] = count.get(r[i : i + size], 0) + w
        want = [count[r[i : i + size]] > 1 for r in regions for i in range(len(r) - size + 1)]
        assert suffix_dedup.repeated_starts(regions, starts, weight, size).tolist() == want


def removed_by_brute_force(rows, length):
    count = {}
    for _, t in rows:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    want = []
    for d, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want.append((d, len(t), len(t) - len(kept), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return want


def removed(docs, *args, **how):
    return [tuple(r) for r in suffix_dedup.without_repeats(docs, *args, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


@pytest.mark.parametrize("how", [{}, {"full": 150, "most_ids": 1}])
def test_without_repeats(spark, odd, how):
    rng = random.Random(31)
    line = words(rng, 12)[:50]  # shorter than a repeat; some contexts make it one, on either side
    ends = [words(rng, 9) for _ in range(4)]
    boiler = [(500 + i, rng.choice(ends)[rng.randint(0, 30) :] + line + rng.choice(ends)[: rng.randint(0, 30)] + words(rng, 6)) for i in range(60)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(boiler, "doc_id long, text string"))
    want = removed_by_brute_force([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], 60)
    assert sum(w[2] > 0 for w in want[-60:]) > 20
    assert sorted(map(repr, removed(docs, 60, 12, **how))) == sorted(map(repr, want))


def passage_words_by_brute_force(texts, n):
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    held = {}
    for i, w in enumerate(rows):
        for j in range(len(w) - n + 1):
            held.setdefault(tuple(w[j : j + n]), set()).add(i)
    return [len({x for j in range(len(w) - n + 1) if len(held[tuple(w[j : j + n])]) > 1 for x in range(j, j + n)}) for w in rows]


@pytest.mark.parametrize("how", [{}, {"full": 150, "most_ids": 1}])
def test_passage_words_equal_brute_force(spark, odd, how):
    rng = random.Random(17)
    line, ends = words(rng, 7), [words(rng, 9) for _ in range(4)]
    texts = []
    for _ in range(60):  # a shared line that some contexts make a passage, on either side, with white space of its own
        t = rng.choice(ends).split()[rng.randint(0, 9) :] + line.split() + rng.choice(ends).split()[: rng.randint(0, 9)] + words(rng, 5).split()
        texts.append(rng.choice([" ", "\n", " \t "]).join(t))
    own = words(rng, 12)
    texts += [own + " " + own, "a b " * 40, "a b " * 8 + words(rng, 30)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = docs.collect()
    want = [(r.doc_id, n) for r, n in zip(rows, passage_words_by_brute_force([r.text for r in rows], 10))]
    assert sum(n > 0 for _, n in want[-63:]) > 20 and want[-3][1] == 0 < want[-1][1]
    got = [tuple(r) for r in suffix_dedup.without_repeats(docs, 60, 12, passage=10, passage_k=3, **how).select("doc_id", "n_passage_words").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_op3_finds_passages_of_over_50_words_that_have_fewer_than_400_bytes(spark, tmp_path):
    from gapweave.llm import queries

    rng = random.Random(23)
    passage = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(55))
    texts = [words(rng, 90) + " " + passage + " " + words(rng, 40), passage.replace(" ", "\n") + "\n" + words(rng, 70), words(rng, 200)]
    texts.append(" ".join([words(rng, 60)] * 2))  # what repeats inside one document only is no passage of two
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_passage_words) for r in queries.op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(passage) < 400 and [got[i] for i in range(3)] == [(0, 55), (0, 55), (0, 0)] and got[3][1] == 0


def test_a_collection_larger_than_a_transform(spark):
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    lines = letters[rng.integers(0, 26, (20_000, 80))]
    at = np.arange(20_000) * 80
    data = lines.ravel()
    least = int(np.argmin(suffix_dedup.range_hash(suffix_dedup.prefix_hash(data), at, at + 80, suffix_dedup.inverse_powers(len(data) + 1))))
    line = lines[least].tobytes().decode()  # an anchor of most strings that hold it, so stretches have 720 bytes
    texts = [letters[rng.integers(0, 26, 700)].tobytes().decode() for _ in range(3000)]
    texts = [t[:350] + line + t[350:] for t in texts]
    texts += [texts[5][:700], "x" + texts[6][200:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[2] for r in removed(docs)}
    assert {i: n for i, n in got.items() if n} == {5: 700, 6: 580, 3000: 700, 3001: 580}


def test_equal_strings_have_equal_anchors_beyond_the_place_width(monkeypatch):
    rng = random.Random(7)
    passage = rng.randbytes(400)
    texts = [rng.randbytes(300) + passage + rng.randbytes(4500) + passage + rng.randbytes(70), rng.randbytes(90) + passage]
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 9)
    anchors, starts = {}, set()
    for d, s0, n, h, a in zip(*(x.tolist() for x in suffix_dedup.stretches(texts, 50, 10))):
        assert 0 <= s0 + a <= len(texts[d]) - 10
        for i in range(s0, s0 + n):
            starts.add((d, i))
            anchors.setdefault(texts[d][i : i + 50], set()).add(h)
            assert h in suffix_dedup.range_hash(suffix_dedup.prefix_hash(np.frombuffer(texts[d][i : i + 50], np.uint8)), np.arange(41), np.arange(10, 51), suffix_dedup.inverse_powers(51)).tolist()
    assert starts == {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)}
    assert all(len(x) == 1 for x in anchors.values())


def test_without_repeats_of_nothing(empty):
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_min_cost_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(20):
        supply = [rng.randint(0, 50) for _ in range(5)]
        cap = sharding.shares(sum(supply), 6)
        flow = sharding.min_cost_flow(supply, cap, sharding.moving_cost(range(5), 6))
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= cap[j] for j in range(6))
        stay = sum(min(s, c) for s, c in zip(supply, cap))
        assert sum(f[i] for i, f in enumerate(flow)) == stay


def test_reshard(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i if i % 50 else None, rng.randint(1, 400), 0 if rng.random() < 0.4 else i % 12) for i in range(3000)] + [(1, 7, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, size long, old_shard int")
    got = sharding.reshard(df, 16, ["doc_id"]).cache()
    by = {r.shard: (r.b, r.n, r.lo, r.hi) for r in got.groupBy("shard").agg({"size": "sum", "slot": "count"}).selectExpr("shard", "`sum(size)` b", "`count(slot)` n", "0 lo", "0 hi").collect()}
    mean = sum(r[1] for r in rows) / 16
    assert len(by) == 16 and got.count() == len(rows) and all(abs(b - mean) <= 400 for b, *_ in by.values())
    for s, (_, n, *_) in by.items():
        assert sorted(r.slot for r in got.filter(f"shard = {s}").collect()) == list(range(n))
    assert sharding.reshard(df.limit(0), 16, ["doc_id"]).count() == 0
    path = f"file://{tmp_path}/shards"
    sharding.rewrite_affected(got, path, range(16))
    assert spark.read.parquet(path).count() == len(rows)


def test_reshard_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BLOCK", 4)
    df = spark.range(2000).selectExpr("id as doc_id", "1 + pmod(hash(id), 50) as size", "cast(if(id % 3 = 0, 0, id % 7) as int) as old_shard")
    got = sharding.reshard(df, 5, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    loads = [sum(r["size"] for r in got if r.shard == j) for j in range(5)]
    assert max(loads) - min(loads) <= 100
    for j in range(5):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(sum(r.shard == j for r in got)))


def test_reshard_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_BLOCK", 40)
    monkeypatch.setattr(sharding, "BYTES_A_FILE", 2000)
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(None if i % 60 == 7 else i % 900, "x" * rng.choice([0, 3, 20, 200]) if i % 40 else None, 0 if rng.random() < 0.5 else i % 5) for i in range(1500)]
    rows += [(1, "same", 9)] * 12  # equal rows, in a shard that goes
    docs = spark.createDataFrame(rows, "doc_id long, text string, of int").repartition(3)
    size, path = F.octet_length(F.coalesce("text", F.lit(""))) + 1, f"file://{tmp_path}/shards"
    sharding.lay_out(docs, path, F.col("of"))
    plan = sharding.reshard(docs.select("doc_id", "text", size.cast("long").alias("size"), F.col("of").alias("old_shard")), 7, ["doc_id", "text"])
    assert sharding.reshard_files(spark, path, docs.schema, 7, size, [F.col("doc_id"), F.col("text")]) == sharding.affected(plan)
    got = sharding.laid_out(spark, path, docs.schema)
    assert sorted(map(repr, map(tuple, got.select("doc_id", "text", "of").collect()))) == sorted(map(repr, rows))
    want = plan.select("doc_id", "text", "old_shard", "shard", "slot").collect()
    assert sorted(map(repr, map(tuple, got.select("doc_id", "text", "of", "shard", "slot").collect()))) == sorted(map(repr, map(tuple, want)))
    assert sorted(x.name for x in (tmp_path / "shards").glob("shard=*")) == [f"shard={j}" for j in range(7)]
    assert len(list((tmp_path / "shards").glob("shard=1/*.parquet"))) > 1


def test_reshard_files_leaves_what_is_not_affected(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.range(2000).selectExpr("id as doc_id", "cast(if(id < 1000, 0, if(id < 1900, 1, 2)) as int) as of")
    path = f"file://{tmp_path}/shards"
    files = lambda j: sorted((x.name, x.stat().st_mtime_ns) for x in (tmp_path / f"shards/shard={j}").glob("*.parquet"))
    sharding.lay_out(docs, path, F.col("of"))
    before = {j: files(j) for j in range(3)}
    assert sharding.reshard_files(spark, path, docs.schema, 3, F.lit(1), [F.col("doc_id")], [1000, 500, 500]) == [1, 2]
    assert files(0) == before[0] and files(1) != before[1]
    got = sharding.laid_out(spark, path, docs.schema).collect()
    assert sorted(r.doc_id for r in got) == list(range(2000)) and {r.doc_id for r in got if r.shard == 0} == set(range(1000))
    for j, n in enumerate((1000, 500, 500)):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(n))
    none = f"file://{tmp_path}/none"
    sharding.lay_out(docs.limit(0), none, F.col("of"))
    assert sharding.reshard_files(spark, none, docs.schema, 3, F.lit(1), [F.col("doc_id")]) == [] and sharding.laid_out(spark, none, docs.schema).count() == 0


def test_op4_returns_what_its_files_hold(spark, tmp_path, monkeypatch):
    import zlib

    from gapweave.llm import queries

    made = []
    monkeypatch.setattr(queries, "new_path", lambda *_: made.append(f"file://{tmp_path}/op4") or made[0])
    got = queries.op4_sharding(spark, "/root/testdata/sf0.001").collect()
    files = spark.read.parquet(made[0]).select("doc_id", "text", "shard").collect()
    own = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == sorted((r.doc_id, *own(r.text), r.shard) for r in files)
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() and {r.shard for r in got} == set(range(16))
    for j in range(16):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(sum(r.shard == j for r in got)))


def test_low_containment_has_the_functions_its_miss_rate_asks():
    index = decontamination.ItemIndex([(1, b"one two three four five six")], 5, 0.05)
    functions = index.classes[0][0]
    j = 0.05 * 2 / (2 * decontamination.BLOCK + 2 - 0.05 * 2)
    assert functions > 512 and (1 - j) ** functions <= 1e-6


def test_reshard_moves_the_fewest_bytes(spark):
    apart = [(i, 100, 0) for i in range(20)] + [(100 + i, 1, 1) for i in range(2000)]  # large ones in one shard, small in the other
    got = sharding.reshard(spark.createDataFrame(apart, "doc_id long, size long, old_shard int"), 2, ["doc_id"])
    assert got.filter("old_shard <> shard").count() == 0
    rng = random.Random(8)
    rows = [(i, rng.randint(1, 10) if i % 6 > 2 else rng.randint(50, 400), i % 6) for i in range(3000)]
    old = [sum(r[1] for r in rows if r[2] == i) for i in range(6)]
    got = sharding.reshard(spark.createDataFrame(rows, "doc_id long, size long, old_shard int"), 8, ["doc_id"]).collect()
    least = sum(old) - sum(min(x, sum(old) / 8) for x in old)
    assert least - 8 * 400 <= sum(r.size for r in got if r.shard != r.old_shard) <= least + 8 * 400


def test_quality_rules_odd_rows(spark, odd, empty):
    import re

    got = {(r.doc_id, r.n_words): r for r in quality_rules.judged(odd, ["doc_id"]).collect()}
    for r in odd.collect():
        t = r.text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g in set(grams) if False}
        cover = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 8)}
        x = got[r.doc_id, len(w)]
        assert (x.word_chars, x.n_symbols, x.n_repeat_words) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(cover))
        assert x.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
    assert quality_rules.judged(empty, ["doc_id"]).count() == 0


def test_a_bad_host_fails_all_its_documents(spark):
    rng = random.Random(1)
    rows = [(i, "x" if i % 20 else words(rng, 50), "bad") for i in range(400)] + [(1000 + i, words(rng, 50), "good") for i in range(400)]
    got = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"])
    assert got.filter("kept and doc_id < 1000").count() == 0 and got.filter("kept and doc_id >= 1000").count() == 400


def test_token_attribution():
    n, over = token_attribution.attributed(np.array([3, 4, 2, 1]), np.array([0, 5, 6, 10]))
    assert n.tolist() == [2, 0, 2] and over.tolist() == [1, 0, 0]


def test_token_attribution_rows(spark, odd, empty):
    import public_tokenizers as p

    path = p.path("byte_bpe_50k.tiktoken")
    got = token_attribution.section_tokens(odd, path, p.PATTERN).collect()
    enc, _ = token_attribution.encoding(path, p.PATTERN)
    assert sum(r.n_tokens for r in got) == sum(len(enc.encode_ordinary(r.text or "")) for r in odd.collect())
    assert sum(r.char_end - r.char_start for r in got) == sum(len(r.text or "") for r in odd.collect())
    assert token_attribution.section_tokens(empty, path, p.PATTERN).count() == 0


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    path, folder = p.path("word_bpe_49k.json"), f"file://{tmp_path}/a"
    made = token_files.write_tokens(odd, folder, path)
    found = token_files.read_back(token_files.look_up(made.select("doc_id", "occurrence"), folder), folder).collect()
    tok = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in odd.collect())
    assert sorted(r.ids_crc32 for r in found) == want
    missing = spark.createDataFrame([(10**9 + i, 0) for i in range(500)], "doc_id long, occurrence long")
    assert token_files.look_up(missing, folder).count() == 0
    assert token_files.write_tokens(empty, f"file://{tmp_path}/b", path).count() == 0


def test_targets_and_knapsack():
    t = mixing.targets([("b", 100), (None, 100), ("a", 100)])
    assert t == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    rng = random.Random(6)
    for _ in range(50):
        lengths = sorted(rng.sample(range(1, 30), 5))
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 120)
        got = mixing.knapsack(lengths, counts, budget)
        sums = {0}
        for x, c in zip(lengths, counts):
            sums = {s + x * k for s in sums for k in range(c + 1)}
        assert all(g <= c for g, c in zip(got, counts)) and sum(x * g for x, g in zip(lengths, got)) == max(s for s in sums if s <= budget)


def test_mixing_odd_rows(spark, odd, empty):
    got = mixing.mixed_documents(odd).collect()
    assert len(got) == odd.count() and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
    assert mixing.mixed_documents(empty).count() == 0


def test_mixing_hot_lengths_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT", 10)
    df = spark.createDataFrame([(i, "w " * (3 if i % 2 else 5), "s" if i % 3 else "t") for i in range(600)], "doc_id long, text string, source string")
    got = mixing.mixed_documents(df).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 5
    monkeypatch.setattr(mixing, "HOT", 50_000)
    assert sorted(mixing.mixed_documents(df).collect()) == sorted(got.itertuples(index=False, name=None))


def test_toxicity_learns_words(spark):
    rng = random.Random(8)
    bad = ["zorblax", "quimfrit", "vuxtopp"]
    rows, labels = [], []
    for i in range(700):
        t = words(rng, rng.randint(40, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows + [(9000, None), (9001, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id", how="left")
    held = got[got.held_out & got.toxic.notna()]
    assert len(got) == 702 and got.score.between(0, 1).all()
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.9
    none = toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).toPandas()
    assert len(none) == 702 and none.score.nunique() == 1


def test_urls(spark):
    urls = [None, "", "x.com/a", "http://A.Example.ORG/es/1?q#f", "https://example.org/en/12", "http://a.com/fr/1", "http://b.com/de/2", "http://c.net", "http://net/a://b", "http://x.org"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://bad.net/x/{i}") for i in range(60)] + [(200 + i, f"http://fine.info/x/{i + 100}") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 if i >= 100 else 0, None) for i in range(160)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.judged_pages(pages, labels).collect()}
    assert [(got[i].host, got[i].path) for i in range(4)] == [("", ""), ("", ""), ("", ""), ("a.example.org", "/es/1")]
    assert [got[i].rule for i in range(3, 10)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, None]
    assert [got[i].verdict for i in (3, 4, 5, 6)] == ["block", "block", "allow", "block"]
    assert got[100].verdict == "block" and got[200].verdict == "allow" and len(got) == len(urls) + 120
    assert url_reputation.judged_pages(pages.limit(0), labels).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(0, words(random.Random(1), 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            own = out.columns[: len(docs.columns)]
            assert own == docs.columns, name
            assert out.count() <= 2 * docs.count(), name
