"""Nulls, empties, ties, repeated rows, long texts, empty tables and clashing columns, with the rows they give."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import brute_components, brute_cover, brute_edits, prose
from tidewright.llm import decontamination, langid, line_dedup, ngram_join, pii, scratch, sharding, substring_dedup

CLASHES = ["id", "_id", "n", "tag", "at", "text_", "place", "found", "packed", "digests", "name", "token", "key", "class", "part", "score", "lang_pred", "n_removed", "slot", "shard", "item"]


def with_clashes(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


def repeated_documents():
    """Rows that repeat an id, with one text and with several, null ids, and a document of many words."""
    rng = random.Random(21)
    passage, lines = prose(rng, 50), [prose(rng, 6) for _ in range(9)]
    docs = [(i, f"{prose(rng, 8)}\n{chr(10).join(lines[:5])}\n{passage} {prose(rng, 9)}") for i in range(4)]
    docs += [(5, passage), (5, passage), (5, f"{prose(rng, 30)} {passage}"), (6, "\n".join(lines)), (6, "\n".join(lines)), (6, "\n".join([*lines[2:], "other"]))]
    docs += [(None, passage + " end"), (None, "\n".join(lines[1:])), (7, None), (8, ""), (9, prose(rng, 20_000)), (9, None)]
    return docs


def brute_removed(docs, split, width):
    """Words or lines left of each row; a run goes if it starts earlier by (id, start), null ids first."""
    rank = lambda d: -1 if d is None else d
    units = [(rank(d), split(t)) for d, t in docs]
    first = {}
    for d, u in units:
        for s in range(len(u) - width + 1):
            key = tuple(u[s : s + width])
            first[key] = min(first.get(key, (d, s)), (d, s))
    found = []
    for d, u in units:
        gone = {p for s in range(len(u) - width + 1) if first[tuple(u[s : s + width])] < (d, s) for p in range(s, s + width)}
        found.append([x for i, x in enumerate(u) if i not in gone])
    return found


def test_lines_of_repeated_ids(spark):
    docs = repeated_documents()
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    kept = brute_removed(docs, lambda t: [] if t is None else t.split("\n"), 3)
    wanted = Counter((d, None if t is None else "\n".join(k)) for (d, t), k in zip(docs, kept, strict=True))
    found = line_dedup.delete_repeated_runs(df, keep=["tag", "packed"])
    assert Counter((r.id, r.text) for r in found.collect()) == wanted and found.columns[-2:] == ["tag", "packed"]


def test_words_of_repeated_ids(spark):
    docs = repeated_documents()
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    kept = brute_removed(docs, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""), 20)
    wanted = Counter((d, " ".join(k)) for (d, _), k in zip(docs, kept, strict=True))
    assert Counter((r.id, bytes(r.kept).decode()) for r in substring_dedup.cut_repeats(df).collect()) == wanted


def test_sets_of_repeated_ids(spark):
    docs = [(1, "a b c d e"), (1, "z y x w v u"), (2, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, ""), (5, None), (6, "q")]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3)
    found = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, width=3, percent=90).collect()}
    # A repeated id has the fewest shingles of its rows.
    assert found == brute_components([(1, "a b c d e"), (2, "a b c d e"), (3, "a b c d e"), (4, ""), (5, None), (6, "q")], 3, 90)


def test_crowd_of_copies_below_the_threshold(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 1601):
        own = list(base)
        for k in rng.sample(range(150), rng.randrange(3, 8)):
            own[k] = f"e{i}x{k}"
        docs.append((i, " ".join(own)))
    for i in range(1, 1601, 400):  # a few link with each other, far from the base
        docs.append((5000 + i, docs[i][1] + f" tail{i}"))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r.id: r.component_id for r in ngram_join.jaccard_components(df, width=3, percent=90).collect()}
    wanted = {d: c for d, (_, c) in brute_components(docs, 3, 90).items()}
    assert found == wanted and len(set(wanted.values())) > 500


def thue_morse(n, a="a", b="b"):
    x = a
    for _ in range(n):
        x += x.translate(str.maketrans(a + b, b + a))
    return x


def test_words_that_polynomial_hashes_confuse(spark):
    one = thue_morse(10)
    two = one.translate(str.maketrans("ab", "ba"))
    assert len(one) == 1024
    rest = [f"w{i}" for i in range(19)]
    df = spark.createDataFrame([(1, " ".join([one, *rest])), (2, " ".join([two, *rest]))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.cut_repeats(df).collect()] == [0, 0]
    df = spark.createDataFrame([(1, f"x\n{one}\ny"), (2, f"x\n{two}\ny")], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.delete_repeated_runs(df).collect()] == [0, 0]
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r.id: r.component_id for r in ngram_join.jaccard_components(df, width=1).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5, 8, 11])
def test_runs_far_longer_than_the_least(spark, min_lines):
    rng = random.Random(min_lines)
    run = [f"line {i}" for i in range(300)]
    docs = [(1, "\n".join(run)), (2, "\n".join([*run[20:280], "x", *run[:9]])), (3, "\n".join(run[100:110] * 6)), (4, "\n".join(rng.choice("abc") for _ in range(200)))]
    docs += [(5 + i, "\n".join(rng.choice("abc") for _ in range(40))) for i in range(5)] + [(20, docs[0][1]), (21, "\n".join(["same"] * 100))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    wanted = brute_cover(docs, lambda t: t.split("\n"), min_lines)
    found = {r.id: r.text.split("\n") if r.n_lines > r.n_removed else [] for r in line_dedup.delete_repeated_runs(df, min_lines=min_lines).collect()}
    assert found == wanted


def test_doubling_ends_when_every_suffix_is_settled(spark, tmp_path):
    docs = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(40))), (2, "\n".join(f"l{i}" for i in range(5, 38)))], "id long, text string")
    found, rounds = line_dedup.later_copies(line_dedup._lines(docs, 3, None), scratch.Scratch(spark, "test"), 3)
    assert rounds == 6 and found.count() == 31  # 33 equal lines: ranks by 32 lines are shared, by 64 none


def test_language_ties_one_label_and_repeated_rows(spark):
    docs = [(1, "aaa bbb", "x"), (2, "aaa bbb", "y"), (3, "aaa", None), (3, "aaa", None), (4, None, "x"), (5, "²½ⅷ 12", "x"), (6, "", None), (None, "bbb", None)]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    both = langid.classify(df, langid.fit(df), keep=[F.col("doc_id")]).collect()
    assert Counter((r.doc_id, r.lang_pred, r.score) for r in both) == Counter([(1, "x", 0.0), (2, "x", 0.0), (3, "x", 0.0), (3, "x", 0.0), (4, "und", 0.0), (5, "und", 0.0), (6, "und", 0.0), (None, "x", 0.0)])
    one = langid.classify(df, langid.fit(df.filter("lang = 'y'")), keep=[F.col("doc_id")]).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("y", 1.0), ("und", 0.0)}
    hot = spark.createDataFrame([(1, "one text", "x")] * 500 + [(1, f"text {i}", "x") for i in range(300)] + [(2, "zwei", "y")], "doc_id long, text string, lang string")
    assert sum(map(len, langid.fit(hot).values())) == 2  # one row a label, hash bucket


def test_language_of_large_scripts_and_long_texts():
    rng = random.Random(3)
    words = {k: ["".join(chr(start + rng.randrange(1500)) for _ in range(3)) for _ in range(400)] for k, start in (("p", 0x4E00), ("q", 0x6000))}
    parser = langid.CrossParser({k: [" ".join(rng.choices(w, k=2000))] for k, w in words.items()})
    for k, w in words.items():
        text = " ".join(rng.choices(w, k=700))
        assert parser.predict([text])[0] == [k]
    long_ = "the cat " * 40_000
    parser = langid.CrossParser({"x": ["the cat " * 20], "y": ["z"]})
    counts = parser.phrases(*parser.codes([long_]))
    assert counts[0, 0] == -(-len(long_) // 160) and counts[1, 0] >= 250_000


def test_shards_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, "x" * rng.randrange(1, 60) + str(i % 40)) for i in range(120)] + [(7, "same"), (7, "same"), (None, "same"), (500, None), (501, ""), (502, None)]
    found = sharding.shard_documents(with_clashes(spark.createDataFrame(docs, "doc_id long, text string")), 3).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in docs)
    groups, where = Counter(), defaultdict(set)
    by_size = defaultdict(set)
    for r in found:
        by_size[r["doc_id"], r["size"], r["text_crc32"]].add(r["shard"])
    for d, t in docs:
        groups[t] += len((t or "").encode()) + 1
        where[t] |= by_size[d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())]
    assert all(len(s) == 1 for t, s in where.items() if t)  # equal texts share a shard
    loads = Counter()
    for r in found:
        loads[r["shard"]] += r["size"]
    # Brute force over all ways is out of reach; the least possible spread is 0 or 1 byte.
    assert max(loads.values()) - min(loads.values()) <= 2 and sum(loads.values()) == sum(groups.values())


def test_differencing_against_all_ways():
    rng = random.Random(9)
    for _ in range(60):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(3, 8))]
        got = sharding.differencing(sizes, 3)
        spread = lambda way: (lambda s: max(s) - min(s))([sum(z for z, k in zip(sizes, way, strict=True) if k == j) for j in range(3)])
        best = min(spread(way) for way in itertools.product(range(3), repeat=len(sizes)))
        assert best <= spread(got) <= best + max(sizes) / 2


def test_personal_data_of_odd_rows(spark):
    texts = [None, "", "no data", "a@b.co", "a@b.co", "+1 (988) 555-2485 " * 3000, "1.2.3.4 and 999.1.1.1", "4111 1111 1111 1111"]
    df = with_clashes(spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, "x@y.org")], "doc_id long, text string"))
    found = Counter((r.id, tuple(map(tuple, r.base))) for r in pii.find_spans(df, pii.fit(df)).collect())
    assert found == Counter([*((i // 2, tuple(pii.base_spans(t or ""))) for i, t in enumerate(texts)), (None, ((0, 0, 7),))])


def test_items_of_any_kind(spark):
    rng = random.Random(11)
    long_ = [f"w{rng.randrange(5000)}" for _ in range(10_000)]
    edited = [w for i, w in enumerate(long_) if i % 9]
    items = [("a", "one two three four five six seven"), ("a", "alpha beta gamma delta epsilon"), ("b", " ".join(long_)), (None, "never found at all"), ("c", None), ("d", "...")]
    docs = [(1, "x one two three FOUR, five six seven y"), (1, "alpha beta gamma delta epsilon"), (None, "one two three four six seven"), (2, "z " + " ".join(edited)), (3, None), (4, "one two"), (5, "never found at all")]
    bench = with_clashes(spark.createDataFrame(items, "item_id string, text string").withColumnRenamed("text", "t")).withColumnRenamed("t", "text")
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {(r.id, r.item): r.n_edits for r in decontamination.find_items(df, bench).collect()}
    assert found == {(1, "a"): 0, (None, "a"): 1, (2, "b"): len(long_) - len(edited)}
    stay = decontamination.drop_holders(df, bench)
    assert sorted(r.doc_id for r in stay.collect()) == [3, 4, 5] and stay.columns == df.columns
    for kind in ("int", "short", "double", "date"):
        typed = spark.createDataFrame([("1", items[0][1])], "item_id string, text string").select(F.expr("make_date(2020, 1, 2)").alias("item_id") if kind == "date" else F.col("item_id").cast(kind), "text")
        assert decontamination.find_items(df, typed).filter("id = 1").count() == 1


def test_banded_edits_equal_the_full_matrix():
    rng = random.Random(1)
    for _ in range(1500):
        m, e = rng.randrange(1, 14), rng.randrange(5)
        item = [rng.randrange(4) for _ in range(m)]
        text = list(item) if rng.random() < 0.7 else [rng.randrange(4) for _ in range(m)]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(text) + 1)
            text[k : k + rng.randrange(2)] = [rng.randrange(4)] if rng.random() < 0.6 else []
        text = text[: m + 2 * e]
        got, at = decontamination.least_edits(np.array(item, np.uint64), np.array(text, np.uint64), e)
        want = min(brute_edits(item, text), e + 1)
        assert got == want
        if want <= e:
            assert min(len_edits(item, text[at : at + n]) for n in range(len(text) - at + 1)) == got


def len_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class getConf:
                get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)
    assert hashlib.sha256(scratch.shared_dir(spark).encode()).digest()


def test_long_runs_take_the_short_lines_in_them(spark):
    rng = random.Random(6)
    lines = [prose(rng, n) for n in (30, 25, 12, 11)] + ["x", "y", ""]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    docs += [(90, f"{lines[0]}\nx\none"), (91, f"two\n{lines[0]}\nx"), (92, f"two\n{lines[0]}\nx")]
    seen, gone = {}, defaultdict(set)
    for d, t in docs:
        own = t.split("\n")
        for size in (1, 2, 3):
            for s in range(len(own) - size + 1):
                run = tuple(own[s : s + size])
                if size == 3 or len(" ".join(run).split()) >= 20:
                    if run in seen:
                        gone[d].update(range(s, s + size))
                    seen.setdefault(run, (d, s))
    found = {r.id: r for r in line_dedup.delete_repeated_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), min_words=20).collect()}
    for d, t in docs:
        kept = [x for i, x in enumerate(t.split("\n")) if i not in gone[d]]
        assert (found[d].n_removed, found[d].text) == (len(gone[d]), "\n".join(kept)), d
