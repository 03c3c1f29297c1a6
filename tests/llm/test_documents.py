"""Every operator on documents against a brute-force version, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from attesta.llm import bpe, decontaminate, language, media, sharding, simhash, suffix_dedup, tokens, toxicity
from attesta.llm.common import connected_components


def raw(text):
    return (text or "").encode("utf-8", "surrogatepass")


def same(found, wanted):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def removed(raws, span=200):
    """Masks of bytes that a repeated window covers."""
    counts = Counter(r[i : i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        m = np.zeros(len(r), bool)
        for i in range(len(r) - span + 1):
            if counts[r[i : i + span]] > 1:
                m[i : i + span] = True
        out.append(m)
    return out


@pytest.mark.parametrize("hot", [1024, 3, 1])
def test_suffix_dedup(edge, edge_rows, hot):
    raws = [raw(r[1]) for r in edge_rows]
    wanted = []
    for r, b, m in zip(edge_rows, raws, removed(raws)):
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        wanted.append((r[0], len(b), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()))
    same(suffix_dedup.digest(edge, hot).collect(), wanted)


def test_suffix_dedup_tells_rows_apart(spark):
    """Different texts with one id and one 32-bit hash; one of them is repeated under another id."""
    text = F.concat(F.repeat(F.lit("lorem "), 2), F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 7).cast("string"), 512))
    pairs = spark.range(400_000).select(text.alias("t")).groupBy(F.hash("t")).agg(F.collect_list("t").alias("all"))
    a, b = pairs.where("size(all) > 1").first()["all"][:2]
    docs = spark.createDataFrame([(None, a), (None, b), (1, a)], "doc_id long, text string")
    found = {(r["doc_id"], r["kept_sha256"]): r["n_removed"] for r in suffix_dedup.digest(docs).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert found == {(None, nothing): len(a), (1, nothing): len(a), (None, hashlib.sha256(b.encode()).hexdigest()): 0}


def test_suffix_dedup_of_many_copies_is_linear(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    docs = spark.createDataFrame([(k % 7, text) for k in range(500)], "doc_id long, text string")
    own = suffix_dedup._with_ranges(docs, suffix_dedup.HOT)
    most, n = own.select(F.max(F.size("__ranges")), F.count("__ranges")).first()
    assert n == 500 and most < 3000 / 20
    assert {r["n_removed"] for r in suffix_dedup.digest(docs).collect()} == {3000}


def test_suffix_dedup_pieces(monkeypatch):
    """Texts longer than a piece give the same runs' windows."""
    rnd = random.Random(1)
    text = bytes(rnd.choice(b"abc ") for _ in range(5000))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    seen = np.zeros(len(text) - 199, int)
    for own in suffix_dedup.pieces([b"short", text, b""]):
        row, h, c, k, lo, w, d = suffix_dedup.runs(own)
        assert set(row) <= {1}
        for a, n in zip(lo, w):
            seen[a : a + n + 1] += 1
    assert (seen == 1).all()


def test_suffix_order_is_the_sorted_order():
    rnd = random.Random(2)
    parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    bucket = np.sort(np.array([rnd.randint(0, 12) for _ in parts]))
    sizes = np.array([len(p) for p in parts])
    s = suffix_dedup.Sorter(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes, bucket)
    assert [(bucket[i], parts[i]) for i in s.order] == sorted(zip(bucket, parts))
    assert s.verified()
    for k in range(1, len(parts)):
        a, b = s.order[k - 1], s.order[k]
        n = 0
        while bucket[a] == bucket[b] and n < min(sizes[a], sizes[b]) and parts[a][n] == parts[b][n]:
            n += 1
        assert s.common[k] == (n if bucket[a] == bucket[b] else -1)


def test_suffix_collisions_are_found():
    s = suffix_dedup.Sorter(np.frombuffer(b"abcabd", np.uint8), np.array([0, 3]), np.array([3, 3]), np.array([0, 0]))
    s.common = np.array([-1, 3])
    assert not s.verified()


def test_suffix_rewrite(edge, edge_rows):
    rows = suffix_dedup.rewrite(edge).collect()
    assert len(rows) == len(edge_rows) and rows[0].asDict().keys() == set(edge.columns)
    texts = {(r["doc_id"], r["text"]) for r in rows}
    assert (2, None) in texts and (4, "") in texts
    kept = next(r for r in rows if r["doc_id"] == 13)
    assert kept["text"] == "é" * 90 + "ü" * 90 and kept["n_chars"] == 180
    cut = suffix_dedup.whole_characters("aéb".encode(), [(0, 2), (2, 4)])
    assert cut == [(0, 1), (3, 4)]


def brute_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw(text).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))) if w]
    own = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(own))


def brute_components(items, linked):
    """items: (id, value); smallest id reached, None if there is none."""
    parent = list(range(len(items)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i][1], items[j][1]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(items))]


def test_simhash(edge, edge_rows):
    fps = [brute_fingerprint(r[1]) for r in edge_rows]
    comps = brute_components([(r[0], f) for r, f in zip(edge_rows, fps)], lambda a, b: (a ^ b).bit_count() <= 2)
    found = simhash.components(edge).select("doc_id", "fp", "component_id").collect()
    same([(d, f % 2**64, c) for d, f, c in found], [(r[0], f, c) for r, f, c in zip(edge_rows, fps, comps)])


@pytest.mark.parametrize("most", [32, 2, 1])
def test_simhash_links_planted(spark, monkeypatch, most):
    """All links within two bits, whether keys are few or hot, under any thresholds."""
    monkeypatch.setattr(simhash, "PAIRS", most)
    rnd = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(rnd.randint(0, 6)):
            f ^= 1 << rnd.randrange(64)
            fps.add(f)
            fps.add(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    wanted = brute_components([(simhash.signed(f), f) for f in fps], lambda a, b: (a ^ b).bit_count() <= 2)
    n, both = simhash.bit_statistics(df)
    assert n == len(fps) and both[5, 5] == sum(f >> 5 & 1 for f in fps)
    for groups, chosen in (
        simhash.plan(n, both), (simhash.group_bits(n, both, 2), [0, 1]), (simhash.group_bits(n, both, 2), [1, 0]),
        (simhash.group_bits(n, both, 3), [-1, 0, 1]),
    ):
        assert sorted(b for g in groups for b in g) == list(range(64)) and sum(chosen) == 2 - len(groups) + 1
        found = dict(connected_components(simhash.links(df, groups, chosen)).collect())
        assert [found.get(simhash.signed(f), simhash.signed(f)) for f in fps] == wanted


def test_simhash_keeps_one_of_each(edge, edge_rows):
    kept = simhash.deduplicate(edge).collect()
    ids = Counter(r["doc_id"] for r in kept)
    fps = [brute_fingerprint(r[1]) for r in edge_rows]
    comps = brute_components([(r[0], f) for r, f in zip(edge_rows, fps)], lambda a, b: (a ^ b).bit_count() <= 2)
    wanted = {c for r, c in zip(edge_rows, comps) if r[0] is not None}
    assert {d for d in ids if d is not None} == wanted and all(n == 1 for d, n in ids.items() if d is not None)
    assert ids[None] == sum(r[0] is None for r in edge_rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 99), (99, 100), (7, 7)], "a long, b long")
    found = dict(connected_components(edges).collect())
    assert found == {**{k: 0 for k in range(61)}, 99: 99, 100: 99}


def test_bpe(edge, edge_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    wanted = []
    for r in edge_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        wanted.append((r[0], len(ids), digest, hashlib.sha256(back.encode()).hexdigest(), ids))
    same(bpe.encode(edge, with_ids=True).collect(), wanted)
    same(bpe.encode(edge, limit=10).collect(), [w[:4] for w in wanted])


def test_both_splitters_agree():
    rnd = random.Random(8)
    usual = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xC0, 0x250), 0xA1, 0xA3, 0xB0, 0xB7, *range(0x2010, 0x2028))]
    for _ in range(3000):
        text = "".join(rnd.choice(usual if rnd.random() < 0.6 else " '\nsat0_") for _ in range(rnd.randint(0, 30)))
        if bpe.COMMON.fullmatch(text):
            assert bpe.COMMON_WORDS.findall(text) == bpe.WORDS.findall(text), text
    for odd in "\u00d7\u00f7\u00aa\u00b2\x1c\x85\xa0\u0301\u2028漢":
        assert not bpe.COMMON.fullmatch(odd)


def test_lexicon_shares_suffixes_and_keeps_ids():
    words = {w.encode(): [k, k + 1][: 1 + k % 2] for k, w in enumerate(["", "a", "talking", "walking", "walked", "talked", "é"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert {w: lexicon.ids_of(w) for w in words} == words
    assert [lexicon.ids_of(w) for w in (b"talk", b"walkings", b"x", b"b")] == [None] * 4
    both = len(bpe.Lexicon(bpe.compile_lexicon({b"talking": [1], b"walking": [2]})).final)
    assert both <= len(b"talking") + 1
    nothing = bpe.Lexicon(bpe.compile_lexicon({}))
    assert nothing.ids_of(b"a") is None


def test_tokens(edge, edge_rows):
    import tiktoken  # noqa: F401

    own, sizes = tokens.encoder(tokens.default_tokenizer())
    wanted = []
    for r in edge_rows:
        text = r[1] or ""
        lines = [x for x in re.split(rb"(?<=\n)", raw(text)) if x]
        owner = [k for k, x in enumerate(lines) for _ in x]
        counts, at, crossing = [0] * len(lines), 0, 0
        ids = own.encode_ordinary(text)
        for i in ids:
            held = Counter(owner[at : at + sizes[i]])
            counts[min(held, key=lambda k: (-held[k], k))] += 1
            crossing += len(held) > 1
            at += sizes[i]
        wanted.append((r[0], len(ids), len(lines), crossing, counts))
    same(tokens.count(edge).collect(), wanted)
    # a token over three sections goes to the one with most bytes, the first of equals
    assert [x.tolist() if k == 0 else x for k, x in enumerate(tokens.attribute(np.array([2, 9, 10]), np.array([3, 6, 10])))] == [[1, 1, 1], 1]


def brute_feature(p):
    mean = sum(p) / len(p)
    dev = (sum((x - mean) ** 2 for x in p) / len(p)) ** 0.5
    return len(p) // 64, mean, dev, [sum(x // 16 == k for x in p) for k in range(16)]


def test_media(spark, edge, edge_rows, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["doc_id"], r["payload_sha256"]): r for r in media.query(spark, str(tmp_path)).collect()}
    rows = media.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(edge_rows)
    for r in edge_rows:
        b = raw(r[1])
        p = b + b"\0" * ((-len(b)) % 64 or (0 if b else 64))
        got = found[r[0], hashlib.sha256(p).hexdigest()]
        assert (got["n_bytes"], got["payload_bytes"], got["tail_crc32"]) == (len(b), len(p), zlib.crc32(p[-64:]))
        form = b"P5\n64 %d\n255\n" % (len(p) // 64) + p
        assert (got["media_bytes"], got["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
        lines = [bool(x.split()) for x in (r[1] or "").split("\n")]
        assert got["caption"] == f"document {'null' if r[0] is None else r[0]}"
        assert (got["pos"], got["n_items"]) == (int(lines[0]), sum(lines) + 1)
        size, mean, dev, steps = got["feature"].split(":")
        height, *wanted, bins = brute_feature(p)
        assert size == f"64x{height}" and steps == ",".join(map(str, bins))
        assert np.allclose([float(mean), float(dev)], wanted, atol=1e-5)


def test_sequences_keep_order_and_captions(spark):
    html = (
        "<head><title>no</title><body>one <b>two</b><figure><img src='sha256:a' alt='x'><figcaption>first <i>cap</i></figcaption></figure>"
        "<p>three</p><figure><figcaption>before</figcaption><img src=sha256:b></figure><img src='http://h/i.png' alt='alone'>four &amp; five"
        "<noscript><img src=sha256:z>no</noscript><template><p>no</template><video><source src=sha256:c><source src=sha256:d></video>"
        "<picture><source src=sha256:z><img src=sha256:a></picture><figure><audio src='sha256:e'></audio><figcaption>open<p>six</figure>seven"
        "<figure><figure><img src=sha256:f><figcaption>inner</figcaption></figure><img src=sha256:g><figcaption>till the end"
    )
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<figcaption>no figure</figcaption><p>"), (3, "<script>x")], "page_id long, html string")
    found = {r["page_id"]: r["sequence"] for r in media.sequences(pages.limit(3), "page_id", "html").collect()}
    assert [(x["kind"], x["text"] or x["src"], x["caption"]) for x in found[1]] == [
        ("text", "one two", None), ("image", "sha256:a", "first cap"), ("text", "three", None), ("image", "sha256:b", "before"),
        ("image", "http://h/i.png", "alone"), ("text", "four & five", None), ("video", "sha256:c", None), ("image", "sha256:a", None),
        ("audio", "sha256:e", "open"), ("text", "six", None), ("text", "seven", None), ("image", "sha256:f", "till the end"),
        ("image", "sha256:g", "till the end"),
    ]
    assert found[2] == [] and [x["text"] for x in found[3]] == ["no figure"]
    payloads = spark.createDataFrame([(k, k * 3) for k in "abz"], "digest string, value string")
    rows = media.resolve(media.sequences(pages, "page_id", "html"), payloads, "page_id").orderBy("pos").collect()
    assert [(r["pos"], r["value"]) for r in rows] == [
        (1, "aaa"), (3, "bbb"), (4, None), (6, None), (7, "aaa"), (8, None), (11, None), (12, None)
    ]
    assert {r["n_items"] for r in rows} == {13}


def test_pages_of_the_tables_have_sequences(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = media.sequences(pages, "page_id", "html").collect()
    assert len(found) == pages.count() and all(any(x["kind"] == "text" for x in r["sequence"]) for r in found)
    assert all([x["pos"] for x in r["sequence"]] == list(range(len(r["sequence"]))) for r in found)


def test_shards_keep_rows_and_prune(spark, edge, small, tmp_path):
    import glob

    import pyarrow.parquet as pq

    sharding.write_shards(edge, f"{tmp_path}/edge", 5)
    back = spark.read.parquet(f"{tmp_path}/edge")
    same(back.select(*edge.columns).collect(), [tuple(r) for r in edge.collect()])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out", 24, 24)
    ranges = []
    for file in glob.glob(f"{tmp_path}/out/*/*.parquet"):
        meta = pq.read_metadata(file)
        at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
        stats = [[meta.row_group(g).column(at[f"__{c}"]).statistics for g in range(meta.num_row_groups)] for c in sharding.CELLS]
        ranges.append([(min(s.min for s in own), max(s.max for s in own)) for own in stats])
    shares = []
    for k, c in enumerate(sharding.CELLS):
        values = [r[0] for r in spark.read.parquet(f"{tmp_path}/out").select(f"__{c}").distinct().collect()]
        shares.append(sum(a <= v <= b for v in values for a, b in (r[k] for r in ranges)) / len(values) / len(ranges))
    # files read for one value; there are four languages only
    assert max(shares) < 0.75 and sum(shares) / 3 < 0.5, shares


def test_repeated_rows_spread_over_range_tasks(spark):
    docs = spark.createDataFrame([(7, "same", "en", "hot")] * 400, "doc_id long, text string, lang string, source string")
    rows = sharding.shard(docs, 8).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(k, i) for k in range(8) for i in range(50)]


def test_sharding(edge, edge_rows):
    rows = sharding.shard(edge, 5).collect()
    same(
        [(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows],
        [(r[0], len(raw(r[1])) + 8, zlib.crc32(raw(r[1])), "rows", None) for r in edge_rows],
    )
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(5)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    in_order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert in_order == sorted(in_order)


def test_hilbert_neighbours_touch(spark):
    from pyspark.sql import functions as F

    cube = spark.range(512).selectExpr("int(id % 8) a", "int(id div 8 % 8) b", "int(id div 64) c")
    rows = cube.withColumn("h", sharding.hilbert([F.col("a"), F.col("b"), F.col("c")], 3)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    for p, q in zip(rows, rows[1:]):
        assert sum(abs(p[k] - q[k]) for k in "abc") == 1


def test_language(spark, edge):
    rows = [(k, "the cat and the dog were here " * 3, "en") for k in range(40)] + [(k, "der hund und die katze waren hier " * 3, "de") for k in range(40, 80)]
    docs = spark.createDataFrame([*rows, (90, None, "en"), (91, "12 ?!", "de"), (92, "the dog was here and the cat", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs)).collect()}
    assert all(found[k]["lang_pred"] == lang for k, _, lang in rows)
    assert [found[k]["lang_pred"] for k in (90, 91, 92)] == ["und", "und", "en"]
    assert all(found[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= found[k]["score"] <= 1 for k in found)
    assert language.predict(edge, language.fit(edge)).count() == edge.count()


def test_toxicity(spark, edge):
    rnd = random.Random(4)
    plain = ["".join(rnd.choice("etaoin") for _ in range(5)) for _ in range(150)]
    word = lambda: rnd.choice(plain)
    rows, marks = [], []
    for k in range(300):
        bad = k % 3 == 0
        rows.append((k, " ".join([word() for _ in range(30)] + [rnd.choice(["zubbish", "zubbisher"])] * 2 * bad)))
        marks.append((k, int(bad)))
    rows += [(900, " ".join(word() for _ in range(20)) + " zubbishes zubbishly"), (901, None), (902, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [k for k, _ in marks if found[k]["held_out"]]
    assert sum(found[k]["predicted"] == dict(marks)[k] for k in held) >= 0.95 * len(held) > 20
    assert found[900]["predicted"] == 1 and found[901]["score"] == found[902]["score"] < 0.5
    assert toxicity.keep_clean(docs, model).count() == sum(r["predicted"] == 0 for r in found.values())
    none = toxicity.fit(edge, labels.where("false"))
    assert none == b"" and {r["score"] for r in toxicity.score(edge, none).collect()} == {0.0}


ITEM = "Anna has 12 apples and gives 5 kg of them to Bert before the long train ride home starts ."


def test_decontamination(spark):
    texts = {
        1: f"Something else. {ITEM} And more words.",
        2: "Today we read: " + ITEM.replace("Anna", "Carl").replace("12", "40").replace("Bert", "Dora") + " The end.",
        3: "He said so. " + ITEM.replace("train ride", "horse ride"),  # one word of many
        4: "Quite another text about apples and a long train ride home .",
        5: "", 6: None, 7: "tiny item", 8: "so tiny item it is", 9: " ".join(ITEM.split()[:9]),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "tiny item"), (3, None), (4, "  "), (None, ITEM)], "item_id long, text string")
    for size in (500_000, 3):
        found = {r["doc_id"]: dict(zip(map(str, r["item_ids"]), r["kinds"])) for r in decontaminate.report(docs, bench, size).collect()}
        assert {k: v for k, v in found.items() if v} == {
            1: {"1": "verbatim", "None": "verbatim"}, 2: {"1": "reparameterised", "None": "reparameterised"},
            7: {"2": "verbatim"}, 8: {"2": "verbatim"},
        }, size
    assert {r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect()} == {3, 4, 5, 6, 9}
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").count() == 0


def slow_longest(item, text, window=5):
    """Most windows of the item that stand in a text in order, in a stretch of hits no further apart than the item is long."""
    a, b = item.split(), text.split()
    hits = [(p, q) for p in range(len(b) - window + 1) for q in range(len(a) - window + 1) if b[p : p + window] == a[q : q + window]]
    best, top, edge = {}, 0, 0
    for k, (p, q) in enumerate(hits):
        if k and p - hits[k - 1][0] > len(a):
            edge = k
        best[k] = 1 + max((best[j] for j in range(edge, k) if hits[j][0] < p and hits[j][1] < q), default=0)
        top = max(top, best[k])
    return top


def test_occurrences_against_all_windows():
    """Items with repeated windows, in texts with parts left out, moved, repeated and put between: every longest chain is found."""
    rnd = random.Random(6)
    leaks = 0
    for _ in range(400):
        words = [f"w{rnd.randrange(rnd.choice([6, 40, 400]))}x" for _ in range(rnd.randint(12, 40))]
        item = [w.replace("x", "").replace("w", "") and "q" + "abcdefghij"[int(w[1:-1]) % 10] * (1 + int(w[1:-1]) // 10) for w in words]
        text = list(item)
        for _ in range(rnd.randint(0, 3)):
            k, n = rnd.randrange(len(text)), rnd.randint(1, 8)
            kind = rnd.randrange(4)
            if kind == 0:
                text[k : k + 1] = ["zz"]
            elif kind == 1:
                text[k:k] = item[k : k + n] + ["yy"]
            elif kind == 2:
                text[k:k] = ["vv"] * n
            else:
                text = text[k:] + ["uu"] * rnd.randint(0, 60) + text[:k]
        wanted = slow_longest(" ".join(item), " ".join(text)) >= 0.8 * (len(item) - 4)
        found = decontaminate.Index([(1, " ".join(item))]).occurrences([" ".join(text)], decontaminate.Words())[0]
        assert bool(found) == wanted, (item, text)
        leaks += wanted
    assert 80 < leaks < 360
    half = [f"h{'abcdefghij'[k % 10] * (k // 10 + 1)}" for k in range(60)]
    parts = [w for k in range(6) for w in [*half[k * 9 : k * 9 + 6], "between"]]
    split = " ".join(half[:30] + parts + half[30:])
    assert decontaminate.Index([(1, " ".join(half))]).occurrences([split], decontaminate.Words())[0]


def test_decontamination_of_awkward_rows(edge, empty):
    """Repeated rows, long texts, null ids and clashing columns: each row is judged, and kept columns stay."""
    bench = edge.select(edge["doc_id"].alias("item_id"), "text").where("doc_id = 4")
    rows = decontaminate.report(edge.union(edge), bench).collect()
    assert len(rows) == 2 * edge.count() and {r["doc_id"] for r in rows if r["contaminated"]} >= {4, 5, 6, 13}
    kept = decontaminate.keep_clean(edge, bench)
    assert kept.columns == edge.columns and decontaminate.keep_clean(empty, bench).count() == 0
    assert {r["doc_id"] for r in kept.collect()} >= {None, 1, 2, 7, 9}


def test_inconsistent_slots_are_no_leak(spark):
    item = "Take 7 from the first box then put 7 into the second box and count 7 more of the others there"
    same_ = item.replace("7", "9")
    mixed = item.replace("7", "9", 1).replace("7", "8", 1)
    docs = spark.createDataFrame([(1, same_), (2, mixed)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate.report(docs, bench).orderBy("doc_id").collect()] == [True, False]


def test_planted_items_are_found(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    wanted = {r["doc_id"] for r in docs.collect() if any(t in (r["text"] or "") for _, t in items)}
    found = {r["doc_id"] for r in decontaminate.report(docs, bench).where("contaminated").collect()}
    assert wanted <= found


def test_empty_tables(empty):
    assert suffix_dedup.digest(empty).count() == 0
    assert suffix_dedup.rewrite(empty).count() == 0
    assert simhash.components(empty).count() == 0
    assert simhash.deduplicate(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert bpe.encode(empty).count() == 0
    assert tokens.count(empty).count() == 0
    assert media.describe(empty).count() == 0
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert toxicity.score(empty, b"").count() == 0
    assert decontaminate.report(empty, empty.selectExpr("doc_id as item_id", "text")).count() == 0


def test_toxicity_learns_from_whole_texts(spark):
    """What tells texts apart stands at the end of long ones; repeated rows are learned once."""
    long = 4500
    rows = [(k, " ".join(["plain"] * long + (["vile"] * 2000 if k % 2 else ["kind"] * 2000))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    assert model == toxicity.fit(docs.union(docs), marks.union(marks))
    assert all(r["predicted"] == r["doc_id"] % 2 for r in toxicity.score(docs, model).collect())


def test_toxicity_learns_every_word(spark, monkeypatch):
    """A text of many different words travels as its weights by embedding row: the same training."""
    rnd = random.Random(2)
    rows = [(k, " ".join(f"w{rnd.randrange(9**4)}" for _ in range(300)) + " vile" * (k % 2 * 9)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    wanted = toxicity.fit(docs, marks)
    monkeypatch.setattr(toxicity, "MANY", 100)
    assert toxicity.fit(docs, marks) == wanted
    own, total = toxicity.bag(toxicity.words_of(rows[0][1]))
    at, weight = toxicity.vector(own, total, toxicity.Rows())
    slow = Counter()
    for w, c in own.items():
        for g in toxicity.grams(w):
            slow[g] += c * toxicity.SCALE / len(toxicity.grams(w)) / total
    assert at.tolist() == sorted(slow) and np.allclose(weight, [slow[k] for k in sorted(slow)])


def test_items_with_repeated_windows_are_found():
    """Lists and refrains: a window that an item repeats many times starts chains without closing the true one."""
    row = "<n> apples and then some more ripe pears and "
    for times, extra in ((11, 5), (10, 40), (30, 0)):
        words = "".join(row.replace("<n>", str(k)) for k in range(times)) + " ".join(f"tail{k}x" for k in range(extra))
        index = decontaminate.Index([(1, words)])
        other = words.replace("0", "70")
        cut = " ".join(w for k, w in enumerate(words.split()) if k != 20)
        found = index.occurrences([f"before it {words} after", other, cut, row * 3], decontaminate.Words())
        assert [[f[:2] for f in t] for t in found[:2]] == [[(1, "verbatim")], [(1, "reparameterised")]], times
        assert found[0][0][2:] == (2, 2 + len(words.split())) and [f[0] for f in found[2]] == [1] and not found[3]


def test_names_at_sentence_starts_and_other_case():
    """Names that begin sentences are slots; copies in lower or upper case are verbatim."""
    item = "Tom has 3 apples in a box . Tom buys 4 more at the market . Tom gives 2 away . How many apples does Tom have left ?"
    start = item.replace("does Tom", "does he")
    people = "Anna met Bert and Carl near Paris before Dora and Emil left Rome for London with Frank and Greta of Berlin ."
    index = decontaminate.Index([(1, item), (2, start), (3, people)])
    other = lambda t: t.replace("Tom", "Lea").replace("3", "9").replace("4", "8").replace("2", "5")
    texts = [other(item), other(start), people.lower(), people.upper(), item.lower(), "Tom has a box . How many apples are left ?"]
    found = [dict(f[:2] for f in t) for t in index.occurrences(texts, decontaminate.Words())]
    assert found[0][1] == found[1][2] == "reparameterised" and found[2] == found[3] == {3: "verbatim"}
    assert found[4][1] == "verbatim" and not found[5]


def test_toxicity_reads_words_to_their_end():
    """A passage late in a word without spaces counts."""
    rnd = random.Random(2)
    plain = ["".join(rnd.choice("etaoin") for _ in range(6)) for _ in range(80)]
    some = lambda n: [rnd.choice(plain) for _ in range(n)]
    texts = [" ".join(some(20) + ["zubbish"] * (k % 2)) for k in range(200)]
    scorer = toxicity.Scorer(toxicity.train(texts, [k % 2 for k in range(200)]))
    start = "_".join(some(40))
    assert scorer.score(start + "_zubbish" * 20) > 0.5 > scorer.score(start + "_" + "_".join(some(20)))
    for n in (1, 64, 65, 124, 125, 700):
        word = "".join(rnd.choice("abcdefgh") for _ in range(n))
        parts = toxicity.words_of(word)
        assert max(map(len, parts)) <= 64 and (n > 64 or parts == [word])
        assert {word[i : i + 5] for i in range(n - 4)} <= {p[i : i + 5] for p in parts for i in range(len(p) - 4)}


def test_language_learns_from_whole_texts(spark):
    """Every sampled text gives pieces from its beginning to its end, in any script, within the bound."""
    rows = [(k, "licence and terms of use " * 40 + f" word{k}x " + "жук и мышь " * 600 + f" last{k}x", "ru") for k in range(300)]
    rows += [(1000 + k, "a short one", "en") for k in range(5)]
    dicts = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = dicts["ru"]
    assert 0.9 * language.DICT_BYTES < len(own) <= language.DICT_BYTES and own.count("жук".encode()) > 2000
    kept = [k for k, _, lang in rows if lang == "ru" and zlib.crc32(str(k).encode()) % 5]
    assert all(f"last{k}x".encode() in own for k in kept)
    assert dicts["en"].count(b"a short one") == sum(zlib.crc32(str(1000 + k).encode()) % 5 != 0 for k in range(5))
    assert language.level([1, 5, 100, 100], 110) == 50 and language.level([3], 10) == 10


def labelled(sf_dir, column):
    import duckdb

    of = "documents" if column == "lang" else "labels"
    return dict(duckdb.sql(f"select doc_id, {column} from '{sf_dir}/{of}.parquet'").fetchall())


def test_languages_held_out(spark):
    """Whole tables: texts that nothing was learned from get their language."""
    sf_dir = "/root/testdata/sf0.01"
    lang = labelled(sf_dir, "lang")
    own = [r for r in language.query(spark, sf_dir).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert len(own) > 150 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in own) >= 0.97 * len(own)


def test_toxicity_held_out(spark):
    """Whole tables: of held-out toxic texts at least 0.78 are caught (0.80 as measured), of clean ones 0.02 at most are marked."""
    sf_dir = "/root/testdata/sf0.1"
    toxic = labelled(sf_dir, "toxic")
    found = [(r["predicted"], toxic[r["doc_id"]]) for r in toxicity.query(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in toxic]
    bad, fine = [p for p, y in found if y == 1], [p for p, y in found if y == 0]
    assert len(bad) > 80 and len(fine) > 600
    assert sum(bad) >= 0.78 * len(bad) and sum(fine) <= 0.02 * len(fine)
