"""The training-data operators against brute force, on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF, oracle, rows
from tidewright.llm import ann, bpe, decontamination, langid, line_dedup, ngram_join, pii, queries, recompression, sharding, substring_dedup, warc, words
from tidewright.llm.components import components
from tidewright.llm.worker import Generations

WORDS = ["the", "of", "and", "to", "in", "day", "night", "river", "stone", "light"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


def odd_documents():
    """Nulls, empties, one long text, exact and near copies, repeated rows, ties and clashing columns."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(25)]
    texts = [None, "", " \t\n", "A", "a b", "the " * 90, prose(rng, 6000), *base]
    long_ = base[3] + " " + prose(rng, 60)
    texts += [long_, long_ + " end", long_.upper(), base[5], base[5], base[5] + "\n\n" + base[6], prose(rng, 10) + " " + base[7] * 2]
    found = [(i, t, "en", f"src{i % 3}", len(t or ""), i, "n") for i, t in enumerate(texts)]
    return [*found, (5, texts[5], "en", "src2", 450, 5, "n"), (None, long_, None, None, None, 1, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string, source string, n_chars long, id long, name string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, id long, name string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(oracle(queries.ORACLES[name]))


# BPE


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_the_library_on_odd_texts():
    codec, lib = bpe.Codec(bpe.tokenizer_source(queries.tokenizer_path())), library()
    rng = random.Random(1)
    texts = ["don't I'LL", "İstanbul ΣΑΣ", "<|endoftext|>a<|startoftext|>", "½²x Ⅳ ́é ﬁ", "\x85\xa0x\x1c", "日本 テキスト 😀🏽", "", "</w> <|end", "a" * 3000, "." * 500, "ƲƜ ſK"]
    texts += ["".join(rng.choice("abcdeiothns'é1 .-<|>/w") for _ in range(rng.randrange(25))) for _ in range(2000)]
    texts += ["".join(chr(rng.randrange(0xD7FF)) for _ in range(rng.randrange(12))) for _ in range(500)]
    for text in texts:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, odd, none):
    lib = library()
    found = bpe.round_trip(odd, queries.tokenizer_path(), keep=["doc_id", "text", "id", "name"])
    for r in found.select("text", "decoded", "ids", *bpe.digests(found)).collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert found.count() == odd.count() and bpe.round_trip(none, queries.tokenizer_path(), keep=["doc_id"]).count() == 0
    coded = bpe.encode(odd, queries.tokenizer_path(), keep=["doc_id"])
    assert bpe.decode(coded, queries.tokenizer_path(), keep=["doc_id"]).count() == odd.count()


def test_memo_is_bounded():
    memo = Generations(lambda k: k * 2, 10)
    assert [memo[i % 37] for i in range(1000)] == [i % 37 * 2 for i in range(1000)]
    assert len(memo) <= 10 and len(memo.old) <= 10


# Nearest neighbours


def nearest(table, q, k=20):
    """Brute force: {id: best score} of the k nearest ids to any vector of q, ties to smaller ids."""
    best = {}
    for v in [v for i, v in table if i == q]:
        for i, x in table:
            if i != q and len(x) == len(v):
                best[i] = max(best.get(i, -math.inf), math.fsum(float(a) * float(b) for a, b in zip(v, x)))
    return sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]


def test_ann_reads_few_lists_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 16))
    x = (centres[rng.integers(200, size=16000)] + 0.25 * rng.normal(size=(16000, 16))).astype(np.float32).astype(float)
    top = np.sqrt((x**2).sum(1)).max()
    index = ann.Centroids(x, len(x) // ann.LIST_ROWS, top, 0.95, 20, len(x))
    row, own = index.lists_of(x)
    asks = np.arange(0, len(x), 20)
    q_row, q_list = index.lists_for(x[asks])
    assert len(index.centres) >= 50 and len(row) > len(x), "boundary vectors stand in several lists"
    read = [set(row[np.isin(own, q_list[q_row == i])].tolist()) for i in range(len(asks))]
    assert np.mean([len(r) for r in read]) <= 0.2 * len(x)
    df = spark.createDataFrame([(i, v.tolist(), i % 20) for i, v in enumerate(x)], "vec_id long, embedding array<float>, list int")
    found = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    for i, q in enumerate(asks.tolist()):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:20]
        mine = sorted(found[q])
        assert [k for k, *_ in mine] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-9 for _, v, s in mine)
        assert [v for _, v, _ in mine] == [v for _, v, _ in sorted(mine, key=lambda r: (-r[2], r[1]))]
        within = sorted(read[i] - {q}, key=lambda v: (-score[v], v))[:20]
        assert {v for _, v, _ in mine} == set(within) or math.isclose(score[within[-1]], mine[-1][2])
        hit += len({v for _, v, _ in mine} & set(best.tolist()))
    assert hit / (20 * len(asks)) >= 0.9 and set(found) == set(asks.tolist())


def test_ann_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    table = [(i, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    table += [(7, table[7][1])] * 40 + [(8, v) for _, v in table[20:60]]  # repeated rows; one id with many vectors
    table += [(i, table[100][1]) for i in range(400, 460)]  # ties
    table += [(500 + i, rng.normal(size=6).round(2).tolist()) for i in range(5)]  # another length: fewer than k candidates
    bad = [(900, None), (920, [0.0] * 4), (940, [float("nan")] * 4), (960, [float("inf")] * 4), (None, [1.0] * 4), (980, [None, 1.0, 1.0, 1.0])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(table + bad, schema)
    for c in ("id", "v", "asks", "query_id", "list", "shelf", "lists", "score", "rank"):
        df = df.withColumn(c, F.lit("x"))
    found = defaultdict(list)
    for r in ann.search(df, F.col("vec_id").isin(7, 8, 100, 420, 500, 900, 920, 940)).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {7, 8, 100, 420, 500}
    for q in found:
        mine, best = sorted(found[q]), nearest(table, q)
        assert [k for k, *_ in mine] == list(range(1, len(best) + 1)), q
        assert [v for _, v, _ in mine] == [v for v, _ in best] or len({v for _, v, _ in mine} & dict(best).keys()) >= 0.8 * len(best), q
    assert [v for _, v, _ in sorted(found[500])] == [v for v, _ in nearest(table, 500)]
    few = ann.search(spark.createDataFrame(table[:15], schema), F.col("vec_id") == 0).collect()
    assert len(few) == 14 and ann.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0


# N-gram join


def brute_components(docs, width, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_join_equals_brute_force(spark, width, percent):
    rng = random.Random(width)
    docs = [t for t in {d: t for d, t, *_ in odd_documents() if d is not None}.items()]
    core = prose(rng, 150).split()
    for i in range(60):  # a group of near copies around the threshold
        w = list(core)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        docs.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("class", F.lit(2)).repartition(4)
    found = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, width=width, percent=percent).collect()}
    assert found == brute_components(docs, width, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_ngram_join_links_short_sets_to_longer_ones(spark, percent):
    rng = random.Random(percent)
    docs = []
    for k in range(40):  # pairs of 20-23 and 16-19 words amid copies of their template that link with nothing
        template = [f"t{k}x{i}" for i in range(23)]
        large = rng.randrange(20, 24 if percent == 80 else 22)
        small = rng.randrange(-(-percent * large // 100), 20)
        crowd = [[*rng.sample(template, 12), *(f"o{k}x{j}x{i}" for i in range(8))] for j in range(24)]
        group = [*crowd[:12], template[:large], template[:small], *crowd[12:]]
        docs += [(100 * k + i, " ".join(w)) for i, w in enumerate(group)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, width=1, percent=percent).collect()}
    wanted = brute_components(docs, 1, percent)
    assert found == wanted and len({c for _, c in wanted.values()}) == len(docs) - 40


def test_commonest_parts_do_not_depend_on_the_order_of_rows(spark):
    placed = [(t, p) for t in range(20) for p in (2, 5, 3, 1)] + [(90, 4), (90, 4), (90, 7), (91, 4)]
    for ordered in (placed, placed[::-1], sorted(placed)):
        df = spark.createDataFrame(ordered, "token long, part long").coalesce(1)
        assert {tuple(r) for r in ngram_join._commonest_parts(df).collect()} == {*((t, 5) for t in range(20)), (90, 4)}


def test_ngram_join_with_odd_ids(spark, odd, none):
    found = ngram_join.jaccard_components(odd)
    assert found.count() == odd.select("doc_id").distinct().count()
    assert ngram_join.jaccard_components(none).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Repeated lines and passages


def brute_cover(docs, split, width):
    seen, gone = {}, defaultdict(set)
    units = {d: split(t) for d, t in docs}
    for d in sorted(units):
        for s in range(len(units[d]) - width + 1):
            key = tuple(units[d][s : s + width])
            if key in seen:
                gone[d].update(range(s, s + width))
            else:
                seen[key] = (d, s)
    return {d: [u for i, u in enumerate(us) if i not in gone[d]] for d, us in units.items()}


def unique_documents():
    return list({d: t for d, t, *_ in odd_documents() if d is not None}.items())


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    shared = [prose(rng, 60) for _ in range(4)]
    docs = unique_documents() + [(500 + i, f"{prose(rng, rng.randrange(30))} {shared[i % 4]} {prose(rng, 5)} {shared[(i + 1) % 4][:150]}") for i in range(40)] + [(600, "la " * 300), (601, "la " * 25 + "x " + "la " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("packed", F.lit(1)).repartition(4)
    wanted = brute_cover([(d, t or "") for d, t in docs], lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 20)
    for r in substring_dedup.cut_repeats(df).collect():
        assert bytes(r.kept).decode() == " ".join(wanted[r.id]) and r.n_words - r.n_removed == len(wanted[r.id])


def test_substring_dedup_of_odd_rows(spark, odd, none):
    found = substring_dedup.cut_repeats(odd)
    assert found.count() == odd.count() and substring_dedup.cut_repeats(none).count() == 0
    first = found.filter("id is null").first()
    assert first.n_removed == 0  # a null id comes first


def test_windows_are_known_by_equal_symbols():
    rng = random.Random(5)
    passage = prose(rng, 45)
    texts = [f"{prose(rng, n)} {passage} {prose(rng, n)}".encode() for n in (0, 3, 17, 40)]
    names, counts = words.word_hashes(texts)
    found = recompression.Windows(names, counts, 20)
    doc, code, name = found.symbols()
    twice = [k for k, n in Counter(name.tolist()).items() if n > 1]
    known = np.sort((doc << 35 | code)[np.isin(name, np.array(twice, np.uint64))])
    which = found.candidates(known)
    hashes = Counter(found.hashes(np.arange(len(found.starts))).tolist())
    repeated = {i for i, h in enumerate(found.hashes(np.arange(len(found.starts))).tolist()) if hashes[h] > 1}
    assert repeated <= set(which.tolist()) and len(repeated) >= 4 * 26


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    lines = [prose(rng, 4) for _ in range(12)]
    docs = unique_documents() + [(700 + i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(30)] + [(800, "x\n" * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("packed", F.lit(7)).repartition(4)
    wanted = brute_cover([(d, t) for d, t in docs], lambda t: [] if t is None else t.split("\n"), 3)
    texts = dict(docs)
    for r in line_dedup.delete_repeated_runs(df, keep=["packed"]).collect():
        assert r.text == (None if texts[r.id] is None else "\n".join(wanted[r.id])) and r.packed == 7
        assert r.n_lines - r.n_removed == len(wanted[r.id])


def test_line_dedup_takes_long_runs_of_few_lines(spark):
    rng = random.Random(12)
    lines = [prose(rng, n) for n in (3, 4, 9, 10, 11, 19, 20, 21, 60)] + ["", "x"]
    docs = unique_documents() + [(700 + i, "\n".join(rng.choice(lines) + rng.choice(["", f" {i}"]) for _ in range(rng.randrange(9)))) for i in range(40)] + [(800, lines[8] + "\nx\n" + lines[8])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    split = lambda t: [] if t is None else t.split("\n")
    seen, gone = set(), defaultdict(set)
    for d, t in sorted(docs):
        units = split(t)
        for width in (1, 2, 3):
            for s in range(len(units) - width + 1):
                run = tuple(units[s : s + width])
                if width == 3 or len(" ".join(run).split()) >= 20:
                    gone[d].update(range(s, s + width) if run in seen else [])
                    seen.add(run)
    texts = dict(docs)
    for r in line_dedup.delete_repeated_runs(df, min_words=20).collect():
        kept = [x for i, x in enumerate(split(texts[r.id])) if i not in gone[r.id]]
        assert r.text == (None if texts[r.id] is None else "\n".join(kept)) and r.n_lines - r.n_removed == len(kept)
    assert line_dedup.delete_repeated_runs(df).agg(F.sum("n_removed")).first()[0] < sum(map(len, gone.values()))


def test_line_dedup_of_odd_rows(odd, none):
    assert line_dedup.delete_repeated_runs(odd, keep=["id", "name"]).count() == odd.count()
    assert line_dedup.delete_repeated_runs(none).count() == 0


# Language


def test_language_on_held_out_rows(spark):
    found = queries.op5_cross_parsing(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out")
    assert held.count() > 20 and held.filter("lang = lang_pred").count() >= 0.95 * held.count()
    assert all(0 <= r.score <= 1 for r in found.collect())
    ids = {r.doc_id: r.held_out for r in found.collect()}
    assert ids == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in ids}


def test_language_of_odd_texts(spark, odd, none):
    sample = langid.fit(odd)
    found = {r.doc_id: r.lang_pred for r in langid.classify(odd, sample, keep=[F.col("doc_id"), F.col("id"), F.col("name")]).collect()}
    assert found[0] == found[1] == found[2] == "und" and found[3] == "en"
    assert langid.fit(none) == {} and langid.classify(odd, {}, keep=[F.col("doc_id")]).filter("lang_pred <> 'und'").count() == 0
    assert langid.classify(none, sample, keep=[F.col("doc_id")]).count() == 0


def test_cross_parsing_counts_phrases():
    sample = {"x": ["abcabc ab"], "y": ["zzz"]}
    parser = langid.CrossParser(sample)
    for text in ("abcabcabz", "zzzzz", "q"):
        counts = parser.phrases(*parser.codes([text]))
        for row, label in enumerate(parser.labels):
            known, n, at = sample[label][0], 0, 0
            while at < len(text):
                end = at + 1
                while end < len(text) and text[at : end + 1] in known:
                    end += 1
                n, at = n + 1, end
            assert counts[row, 0] == n


# Sharding


def test_sharding_balances_and_keeps_groups(spark, odd, none):
    found = sharding.shard_documents(odd, 4, slice_groups=7).toPandas()
    assert len(found) == odd.count()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = Counter(len((t or "").encode()) + 1 for _, t, *_ in odd_documents())
    assert Counter(found["size"]) == sizes
    texts = spark.createDataFrame([(i, "x" * (i % 90 + 1) + str(i)) for i in range(2000)], "doc_id long, text string")
    loads = sharding.shard_documents(texts, 8, slice_groups=300).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert loads.max() - loads.min() <= 20
    same = sharding.shard_documents(spark.createDataFrame([(i, "same") for i in range(50)] + [(99, None)], "doc_id long, text string"), 4)
    assert same.filter("size > 1").select("shard").distinct().count() == 1
    assert sharding.shard_documents(none, 4).count() == 0


def test_differencing_is_near_optimal():
    shard = sharding.differencing([8, 7, 6, 5, 4], 2)
    loads = [sum(s for s, k in zip([8, 7, 6, 5, 4], shard, strict=True) if k == j) for j in range(2)]
    assert abs(loads[0] - loads[1]) <= 2
    assert sorted(sharding.differencing([10, 10], 2, [20, 0])) == [1, 1]


# WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 1200
    pages = [(i, f"http://e/{i}", f"<html>{i}" + "body text " * (i % 50)) for i in range(300)] + [(400, None, big), (401, "u", big), (402, "u\r\nX", big), (403, "u", None), (404, "u", ""), (405, "u", "s"), (406, "u", "s")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    archives = warc.write_archives(df, f"file://{tmp_path}/w", archive_bytes=4000)
    found = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert len(found) == len(pages)
    for i, _, text in pages:
        payload = (text or "").encode()
        assert found[i].payload_bytes == len(payload) and found[i].payload_digest == hashlib.sha1(payload).hexdigest()
    assert [(found[i].record_type, found[i].refers_to) for i in (400, 401, 402, 405, 406)] == [("revisit", 402), ("revisit", 402), ("response", None), ("response", None), ("response", None)]
    files = sorted((tmp_path / "w").glob("*.warc.zst"))
    assert len(files) == archives.count() > 1 and {f"file://{f}" for f in files} == {r.archive for r in archives.collect()}
    assert all(struct.unpack("<I", f.read_bytes()[:4])[0] == 0x184D2A5D for f in files)
    assert sum(f.stat().st_size for f in files) == archives.agg(F.sum("bytes")).first()[0]
    (tmp_path / "w" / "pages-00000-9-00000.warc.zst").write_bytes(files[0].read_bytes())  # what a lost attempt left
    assert warc.read_archives(archives).count() == len(pages)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_of_odd_pages(spark):
    big = "y" * 5000
    pages = [(None, "u", big), (7, "u", big), (7, "u", big), (3, None, big), (9, "u", "z" * 3_000_000), (10, "é", "é" * 600), (11, None, "é" * 600), (12, "u", "a\r\n\r\nb" * 300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for c in ("id", "payload", "digest", "salt", "size", "frame", "target", "refers_to"):
        df = df.withColumn(c, F.lit("x"))
    found = sorted(((r.page_id or 0, r.url or "", r.payload_bytes, r.record_type, r.refers_to or 0, r.payload and r.payload.decode()) for r in warc.read_archives(warc.write_archives(df)).collect()))
    assert [(i, t, o) for i, _, _, t, o, _ in found] == [(0, "revisit", 7), (3, "revisit", 7), (7, "response", 0), (7, "response", 0), (9, "response", 0), (10, "revisit", 11), (11, "response", 0), (12, "response", 0)]
    assert [n for _, _, n, *_ in found] == [5000, 5000, 5000, 5000, 3_000_000, 1200, 1200, 1800] and found[4][5] == "z" * 3_000_000 and found[-1][5] == pages[-1][2]


# Personal data


def brute_spans(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return [True, kind == 1 and all(int(x) <= 255 for x in s.split(".")), 13 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15][kind]

    return [(k, m.start(), m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if ok(k, m.group())]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "%", "@", ".", "1", "2", "0", "5", "+", " ", "-", "(", "5105105105105100", "255", "@b.c", "é"]) for _ in range(rng.randrange(1, 25)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_skip_chain_adds_only_what_is_alike(odd, none):
    rng = random.Random(6)
    texts = [f"{prose(rng, 20)} a{i}@mail.example.org {prose(rng, 5)} +1 (988) 555-{i:04d} {prose(rng, 4)} {rng.randrange(100)} no {rng.randrange(10**9, 10**10)}, 2024-01-{i % 28 + 1:02d}" for i in range(80)]
    field = pii.Field.fit(texts)
    text = "Call +1 (988) 555-2485 today. Later 988 555 2485 again, order 12345678."
    assert [(k, text[a:b]) for k, a, b in field.decode(text, pii.base_spans(text))] == [(3, "988 555 2485")]
    clean = "order 12345678 of 2024-01-01, 988 555 2485"
    assert field.decode(clean, pii.base_spans(clean)) == []
    assert pii.find_spans(odd, field).count() == odd.count() and pii.find_spans(none, None).count() == 0
    assert pii.fit(none) is None


def exact_beliefs(field, graph):
    """Probabilities of all labels by going through every labelling."""
    n, k = len(graph.given), len(pii.KINDS) + 1
    unary, total = graph.shape @ field.shape, np.zeros((n, k))
    for labels in itertools.product(*[[g] if g else range(k) for g in graph.given.tolist()]):
        score = sum(unary[i, y] for i, y in enumerate(labels))
        score += sum(field.near[labels[a], labels[b]] for a, b in graph.near) + sum(field.skip[labels[a], labels[b]] for a, b in graph.skip)
        for i, y in enumerate(labels):
            total[i, y] += math.exp(score)
    return total / total.sum(1, keepdims=True)


def test_message_passing_equals_exact_inference():
    rng = np.random.default_rng(1)
    k = len(pii.KINDS) + 1
    for text in ("a 12 b +1 (988) 555-2485 c 77 d 13.4.5.6", "no 1234567 or 99", "+1 (988) 555-2485 or 988 555 2485"):  # chains: exact
        graph = pii.Graph([text], [pii.base_spans(text)])
        near, skip = rng.normal(size=(2, k, k))
        field = pii.Field(rng.normal(size=(graph.shape.shape[1], k)), near + near.T, skip + skip.T)
        if len(graph.near) + len(graph.skip) < len(graph.given):
            assert np.abs(field.beliefs(graph, 60) - exact_beliefs(field, graph)).max() < 1e-6
    text = "+1 (988) 555-2485 x 12 y 988 555 2485 z 40 w 988-555-2485"  # loops: near, and the same labels
    graph = pii.Graph([text], [pii.base_spans(text)])
    assert len(graph.skip) == 3 and len(graph.near) == 4
    field = pii.Field(rng.normal(size=(graph.shape.shape[1], k)) / 4, np.zeros((k, k)), 2.0 * np.eye(k))
    got, want = field.beliefs(graph, 60), exact_beliefs(field, graph)
    assert np.abs(got - want).max() < 0.1 and (got.argmax(1) == want.argmax(1)).all()


def test_skip_potentials_are_learned():
    rng = random.Random(2)
    texts = [f"{prose(rng, 3)} call +1 (988) 555-{i:04d} or +1 988 555 {i:04d}, order {10**9 + i} and {10**9 + i}" for i in range(60)]
    field = pii.Field.fit(texts)
    assert field.skip[4, 4] > field.skip[0, 4] + 2 and (field.skip == field.skip.T).all() and (field.near == field.near.T).all()
    many = [f"{t} again 988 555 {i:04d}" for i, t in enumerate(texts)]
    together = field.decode_all(many, [pii.base_spans(t) for t in many])
    assert together == [field.decode(t, pii.base_spans(t)) for t in many]


def test_labels_see_every_base_span():
    spans = [(0, 100), (200, 210)]
    base = [(1, 10 * i, 10 * i + 3) for i in range(9)] + [(0, 20, 95), (3, 205, 212)]
    assert pii.labels_of(spans, base) == [1, 4]


# Decontamination


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark, odd, none):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randrange(12, 40)).capitalize() + ".") for i in range(12)] + [(50, None), (51, ""), (52, "xylophone quartz")]
    docs = []
    for i in range(90):
        k, item = items[rng.randrange(12)]
        w = item.split()
        for _ in range(rng.randrange(0, len(w) // 3)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["zz"], [w[at], "yy"]])
            w = w or ["zz"]
        docs.append((i, f"{prose(rng, 15)} {' '.join(w)}, {prose(rng, 15)}"))
    docs += [(95, None), (96, ""), (97, "a Xylophone, quartz!"), (98, "xylophone only")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.id, r.item): r.n_edits for r in decontamination.find_items(df, bench).collect()}
    plain = lambda t: decontamination.normal_words([t])[0].split()
    wanted = {}
    for d, t in docs:
        for k, item in items:
            w = plain(item)
            if w and (e := brute_edits(w, plain(t))) <= len(w) * 20 // 100:
                wanted[d, k] = e
    assert set(found) <= set(wanted) and all(found[x] == wanted[x] for x in found)
    assert len(found) >= 0.97 * len(wanted) and {x for x, e in wanted.items() if not e} <= set(found)
    stay = {r.doc_id for r in decontamination.drop_holders(df, bench).collect()}
    assert stay == {d for d, _ in docs} - {d for d, _ in found}
    assert decontamination.find_items(odd, bench.limit(0)).count() == 0 and decontamination.find_items(none, bench).count() == 0
    assert decontamination.drop_holders(odd, bench).columns == odd.columns
