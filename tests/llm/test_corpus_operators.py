"""Mixing, neighbours, WARC, suffix arrays, Jaccard join and the pipeline on small tables, against brute force."""

import hashlib
import random
import re
import struct

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import ann, jaccard_join, mixing, suffix_dedup, warc
from gristmill.llm.common import bounded_batches, shared_dir, table
from gristmill.llm.components import components, least_reachable

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 300}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["_source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "_source string, _size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = {s for s in rest if share[s] >= 2 * sizes[s]}
        if not above:
            break
        full |= above
    want = share | {s: 2.0 * sizes[s] for s in full}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_pivotal_keeps_mass():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 1000):
        size, p = rng.integers(1, 500, n).astype(float), np.full(n, 0.3)
        size = -np.sort(-size)
        out = mixing.pivotal(size, mixing.giants(size, p, rng.random(n)), rng.random(n))
        assert abs((size * out).sum() - 0.3 * size.sum()) < 1e-6 and ((out > 0) & (out < 1)).sum() <= 1
    hits = np.mean([mixing.pivotal(np.array([5.0, 2, 9, 4]), np.array([0.2, 0.5, 0.7, 0.4]), rng.random(4)) for _ in range(20000)], axis=0)
    assert np.abs(hits - [0.2, 0.5, 0.7, 0.4]).max() < 0.02


def test_giants_are_taken_at_their_odds():
    """Large documents that the rest can balance are taken as often as their share says; one that it cannot balance keeps the sum."""
    rng = np.random.default_rng(2)
    size = np.array([40.0, 30.0] + [1.0] * 500)
    for p in (0.3, 0.7):
        took = np.mean([mixing.pivotal(size, mixing.giants(size, np.full(len(size), p), rng.random(len(size))), rng.random(len(size)))[[0, 1, 7]] for _ in range(4000)], axis=0)
        assert np.abs(took - p).max() < 0.03
    size = np.array([1000.0] + [1.0] * 500)
    for p in (0.3, 0.7):
        out = mixing.pivotal(size, mixing.giants(size, np.full(len(size), p), rng.random(len(size))), rng.random(len(size)))
        assert abs((size * out).sum() - p * size.sum()) < 1e-6


def test_mixing_repeated_rows(spark):
    """A row that is repeated far beyond a chunk is dealt over many chunks, and its words come near their target."""
    rows = [(None, "a b c", "x")] * 700 + [(k, "one two " * (k % 7 + 1), "y") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.allot(docs, chunk=32).collect()
    assert len(got) == len(rows)
    for s in ("x", "y"):
        mine = [r for r in got if r["_source"] == s]
        assert abs(sum(r["_size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 14 and all(r["copies"] <= 2 for r in mine)


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(1, 40)), rng.choice(["a", "b", "c", None]), 5) for k in range(900)] + [(1000, None, "a", 5), (1001, "", "b", 5), (1002, "w " * 3000, "c", 5)] + [(1003, "same row here", "a", 5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    told = lambda d, **o: sorted((r["_id"], r["_size"], r["copies"], round(r["target"], 6)) for r in mixing.allot(d, **o).collect())
    got = told(docs, chunk=50)
    assert len(got) == len(rows) and got == told(docs.repartition(7), chunk=50)
    got = told(docs)
    assert got == told(docs.repartition(5))
    source = {i: s for i, _, s, _ in rows}
    for s in ("a", "b", "c", None):
        mine = [g for g in got if source[g[0]] == s]
        assert all(0 <= c <= 2 for *_, c, _ in mine)
        assert abs(sum(n * c for _, n, c, _ in mine) - mine[0][3]) <= 60
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(c for _, _, c, _ in got if _ is not None)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[300:340] = x[7]  # a common vector: ties go to the smaller ids
    rows = [(k, [float(v) for v in x[k]]) for k in range(700)] + [(800, None), (820, [0.0] * 16), (840, [float("nan")] * 16), (860, [1.0] * 3), (880, [None] + [1.0] * 15), (None, [1.0] * 16), (20, [float(v) for v in x[20]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df, queries=lambda id: F.pmod(id, F.lit(20)) == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == set(range(0, 700, 20))
    full, hit = x.astype(float), 0
    for q, found in by.items():
        score = full @ full[q]
        order = [k for k in sorted(range(700), key=lambda k: (-score[k], k)) if k != q][:20]
        assert sorted(found) == list(range(1, 21)) and q not in {v for v, _ in found.values()}
        assert all(abs(s - score[v]) < 1e-9 for v, s in found.values())
        hit += len({v for v, _ in found.values()} & set(order))
    assert hit / (20 * len(by)) > 0.95
    few = ann.nearest_neighbours(df.where("vec_id < 5"), queries=lambda id: id == 0).collect()
    assert len(few) == 4
    assert ann.nearest_neighbours(df.limit(0)).collect() == []


def test_neighbours_that_codes_fit_badly(spark):
    """Rows in every direction, and rows that differ by less than codes can tell: none of the nearest is missed."""
    rng = np.random.default_rng(6)
    wide = rng.normal(size=(2500, 256)).astype(np.float32).astype(float)
    alike = rng.normal(size=8) + 1e-9 * rng.normal(size=(1000, 8))
    for x in (wide, alike, 1e-25 * wide[:400, :8] * 10.0 ** rng.integers(0, 40, 400)[:, None]):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann.nearest_neighbours(df, queries=lambda id: F.pmod(id, F.lit(50)) == 0).collect()
        found = {q: [v for _, v in sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)] for q in range(0, len(x), 50)}
        for q, ids in found.items():
            score = np.cumsum(x * x[q], axis=1)[:, -1]
            assert ids == [k for k in sorted(range(len(x)), key=lambda k: (-score[k], k)) if k != q][:20]


def test_warc(spark, tmp_path):
    big, other, small = "<p>é " + "x" * 1200, "y" * 1000, "z" * 500
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (2, "http://c\r\nX: y", other), (9, "http://d", small), (8, "http://e", small), (7, "u", None), (6, "u", ""), (None, "n", big), (4, "r", other), (4, "r", other)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int")
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(pages, folder)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = next(h for i, _, h in rows if i == r["page_id"] and (i is not None or h == big)) or ""
        assert r["payload_bytes"] == len(payload.encode()) and r["payload_digest"] == hashlib.sha1(payload.encode()).hexdigest()
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
    said = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got)
    assert said == sorted([("1", "revisit", "5"), ("3", "revisit", "5"), ("5", "response", "None"), ("2", "revisit", "4"), ("9", "response", "None"), ("8", "response", "None"), ("7", "response", "None"), ("6", "response", "None"), ("None", "response", "None"), ("4", "response", "None"), ("4", "revisit", "4")])
    for path in (tmp_path / "warc").iterdir():
        magic, size = struct.unpack("<II", path.read_bytes()[:8])
        assert magic == warc.SKIPPABLE and size > 0
    assert warc.read_archives(warc.write(pages.limit(0), folder)).collect() == []


def test_warc_trained_dictionary(tmp_path):
    rng, writer = random.Random(6), warc.Writer(f"file://{tmp_path}/w", most=40_000, sample=20_000)
    sent = [warc.record("response", k, 0, "http://x", "d" * 40, 400, None, ("<p>" + " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(80))).encode()[:400].ljust(400)) for k in range(300)]
    for data in sent:
        writer.add(data)
    writer.close()
    assert len(writer.done) > 1
    got = [block for path, _, _ in writer.done for fields, block in warc.records(path) if fields["WARC-Type"] == "response"]
    assert sorted(got) == sorted(warc.parse(d)[1] for d in sent)


def brute_repeats(texts, length):
    seen, cover = {}, {k: np.zeros(len(t), bool) for k, t in texts.items()}
    for k, t in texts.items():
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cover[k][i : i + length] = True
    return cover


def test_suffix_dedup(spark):
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh éß") for _ in range(n))
    shared, line = noise(260), noise(198)
    texts = [None, "", "short", noise(700), shared + noise(300), noise(250) + shared + noise(100), noise(50) + shared[:230] + noise(60), "a" * 900, "ab" * 300, line + noise(300), noise(100) + line + noise(300)]
    texts += [noise(400)] * 3 + [noise(3000) + shared + noise(20) + shared[30:]]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(3, texts[3], 3)], "doc_id long, text string, th int")
    data = {k: (t or "").encode() for k, t in enumerate(texts)} | {"again": texts[3].encode()}
    cover = brute_repeats(data, 200)
    cover_of = lambda k: cover[k]
    for hot in (suffix_dedup.HOT, 1):
        named = docs.select(F.col("doc_id").alias("id"), F.hash("text").alias("th"), "text")
        spans = {}
        for r in suffix_dedup.repeated_runs(named, hot=hot).collect():
            spans.setdefault(r["id"], np.zeros(len(data[r["id"]]), bool))[r["a"] : r["b"] + 200] = True
        for k in range(len(texts)):
            assert (spans.get(k, np.zeros(len(data[k]), bool)) == cover_of(k)).all(), (k, hot)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        kept = bytes(np.frombuffer(data[r["doc_id"]], np.uint8)[~cover[r["doc_id"]]])
        assert bytes(r["kept"]) == kept and r["n_removed"] == int(cover[r["doc_id"]].sum())
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_family_of_suffix_arrays():
    rng = random.Random(8)
    data = [bytes(rng.choice(b"ab") for _ in range(rng.randint(10, 60))) for _ in range(80)]
    want = brute_windows(data, 12)
    for at_once, batch in ((10_000, 10_000), (200, 16), (700, 5)):
        got = suffix_dedup.repeats(data, 12, at_once, batch)
        assert all((a == b).all() for a, b in zip(got, want))


def brute_windows(data, length):
    from collections import Counter

    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    return [np.array([count[d[i : i + length]] > 1 for i in range(max(0, len(d) - length + 1))], bool) for d in data]


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    name = list(range(len(sets)))

    def find(k):
        while name[k] != k:
            k = name[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                name[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {(i, len(s), least[find(k)] if s else i) for k, (i, s) in enumerate(sets)}


def test_jaccard_join(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.randint(20, 160))] for _ in range(12)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    for k in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):  # near copies from alike to unlike
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(400 + k, " ".join(common + [f"u{k}_{j}" for j in range(80)])) for k in range(40)]
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "One"), (905, "one two three four"), (906, "one two three four five"), (907, "one two three four"), (3, rows[3][1]), (5, "a different text under a known id")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(docs).collect()}
    assert got == brute_components(rows)
    assert jaccard_join.similar_components(docs).count() == len(rows)
    stay = jaccard_join.near_dedup(docs)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} >= {r[2] for r in got}
    assert jaccard_join.similar_components(docs.limit(0)).collect() == []


def test_components(spark):
    n = 300
    edges = [(k, k + 1) for k in range(n)] + [(1000, 1001), (1001, 1002), (5000, 1002), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert all(got[k] == 0 for k in range(n + 1)) and got[5000] == 1000
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_components_take_few_stages(spark):
    """A few edges are settled by one task, with the same result as by rounds of joins, which took too long on many partitions."""
    rng = random.Random(8)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(170)] + [(k, k + 1) for k in range(500, 560)] + [(999, k) for k in range(600, 660)]
    df = spark.createDataFrame(edges, "x long, y long")
    told = lambda found: sorted(map(tuple, found.collect()))
    ran = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    before = ran()
    few = told(components(df))
    took = ran() - before
    before = ran()
    assert few == told(components(df, few=0))
    assert took <= 12 and took < ran() - before
    u, v = np.array(edges).T
    loops = u == v
    assert few == sorted(zip(*(x.tolist() for x in least_reachable(u[~loops], v[~loops]))))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34 ##", "en", "src0", 8)], docs.schema)
    first = docs.limit(1).withColumn("doc_id", F.lit(10**6 + 2).cast("long"))
    whole = docs.unionByName(extra).unionByName(first)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    language = corpus_pipeline.language(spark, whole, SF)
    assert language.columns == docs.columns and set(ids(whole)) - set(ids(language)) >= {10**6, 10**6 + 1}
    assert {r["text"] for r in docs.join(language, "doc_id", "left_anti").collect()} <= {r["text"] for r in docs.collect() if not re.search(r"[^\W\d_]", r["text"])}
    exact = corpus_pipeline.exact(spark, language, SF)
    assert 10**6 + 2 not in ids(exact) and len(ids(exact)) == language.select(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).distinct().count()
    near = corpus_pipeline.near(spark, exact, SF)
    want = brute_components([(r["doc_id"], r["text"]) for r in exact.collect()])
    assert ids(near) == sorted({c for _, _, c in want})
    mixed = corpus_pipeline.mixed(spark, near, SF)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(near))
    tokens = corpus_pipeline.tokens(spark, mixed, SF)
    assert ids(tokens) == ids(mixed)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "tokens"]


def test_shared_folder_and_batches(spark):
    assert shared_dir(spark).startswith("file://")
    bounded_batches(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4194304b"


def test_jaccard_word_hashes_and_long_texts(spark, monkeypatch):
    """Words of regular patterns get different hashes; texts longer than a buffer give the set that whole ones do."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(20, one), (21, two)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.similar_components(docs).collect()} == {(20, 20), (21, 21)}
    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["x" * 900, "é " * 300, "\t" * 500]
    whole = [s.tolist() for s in jaccard_join.shingle_sets(texts)]
    for size in (64, 300):
        monkeypatch.setattr(jaccard_join, "BUFFER", size)
        assert [s.tolist() for s in jaccard_join.shingle_sets(texts)] == whole


def test_jaccard_costly_lists(spark, monkeypatch):
    """Passages shared by many documents make all their lists costly; every link is found all the same."""
    rng = random.Random(32)
    passages = [[f"p{k}_{j}" for j in range(30)] for k in range(3)]
    rows = []
    for k in range(220):
        own = [f"o{k}_{j}" for j in range(rng.choice([0, 2, 4, 8, 15, 40]))]
        kept = [w for w in rng.choice(passages)[: rng.randint(18, 30)] if rng.random() > 0.02]
        rows.append((k, " ".join(own + kept if rng.random() < 0.5 else kept + own)))
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for short in (1, 3):
        monkeypatch.setattr(jaccard_join, "SHORT", short)
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(docs).collect()} == want


def test_near_dedup_rows(spark):
    """One id with two texts, null ids, repeats, clashing names, an empty table: no text is lost, no copy stays."""
    base, other = " ".join(f"b{k}" for k in range(60)), " ".join(f"c{k}" for k in range(60))
    near = base + " tail"
    rows = [(1, base, 7), (5, base, 7), (5, other, 7), (None, near, 7), (None, "a text of its own under no id", 7), (9, base, 1), (9, base, 2), (3, None, 0), (3, None, 0), (4, "", 0), (None, other + " x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").withColumns({"stays": F.lit("s"), "root": F.lit("r"), "copies": F.lit(0)})
    got = jaccard_join.near_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, base), (5, other), (None, "a text of its own under no id"), (3, None), (3, None), (4, "")], key=str)
    again = jaccard_join.near_dedup(spark.createDataFrame([(9, base, 1), (9, base, 2)], "doc_id long, text string, n int"))
    assert again.count() == 1
    assert jaccard_join.near_dedup(docs.limit(0)).collect() == []


def test_pipeline_edges(spark):
    """Empty tables, nulls in every column, long texts, one id with two texts, ties and a clashing extra column pass each stage."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    train = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    long = " ".join(f"word{k % 5000} and the house" for k in range(40_000))
    odd = [(None, None, None, None, None), (1, long, "en", "src0", None), (2, long + " end", "en", None, 1), (2, "a quite different little text about the weather today", "en", "src0", 3), (2, "a quite different little text about the weather today", "en", "src0", 3)]
    docs = train.unionByName(spark.createDataFrame(odd, schema)).withColumns({"key": F.lit(1), "copies": F.lit("x"), "doc": F.lit(2.0)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, SF), "edges")
        assert docs.columns == train.columns + ["key", "copies", "doc"]
    left = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    assert all(t for _, t in left) and (2, long + " end") not in left
    assert corpus_pipeline.tokens(spark, docs, SF).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
