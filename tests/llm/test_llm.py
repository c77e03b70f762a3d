"""Each operator against brute force, a round trip or held-out labels, and on awkward inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import buckets, components, dom, extraction, lines, mixing, packing, queries, simhash, syncmers, token_counts, tokenizer, topk, toxicity, warc
from panelspark.llm.common import table
from panelspark.llm.tokenizer import vocabulary

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASH = ["digest", "node", "bucket", "home", "rank", "size", "key", "step", "fp", "component", "length", "score", "positive", "c_source", "block", "own", "g_doc", "g_digests", "row", "n_lines", "toxicity", "times"]
LONG = "wörd " * 60_000 + "end"


def sql(query, sf=SF):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con.sql(query)


def awkward(spark, clash=True):
    rows = [
        (1, "a b c d e f g h i j", "en", "s1", 19), (2, "a b c d e f g h i j", "en", "s1", 19), (2, "a b c d e f g h i j", "en", "s1", 19), (3, None, None, None, None), (4, "", "en", "s2", 0),
        (None, "no id at all, but a line of some length", None, "s3", 39), (None, None, None, None, None), (5, " \t\n\x0b\x0c\r ", "en", "s2", 7), (6, LONG, "de", "s1", len(LONG)), (7, "漢字" * 50, "zh", "s4", 100),
        (8, "x" * 5000, "en", "s2", 5000), (9, "one line of some length here\none line of some length here\nshort\n", "en", "s2", 60), (10, "<|endoftext|> in a text   \x1c \xa0 é", "en", "s1", 30),
    ]
    docs = spark.createDataFrame(rows, DOC)
    return docs.withColumns({c: F.lit("x") for c in CLASH}) if clash else docs


def empty(spark):
    return spark.createDataFrame([], DOC)


# 1 token counts


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = queries.op1_token_counts(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    assert len(got) == len(texts)
    for r in got:
        n = len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_cache_is_filled_once(spark, tmp_path):
    docs, cache = awkward(spark), f"file://{tmp_path}/cache"
    first = token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), cache)
    want = sorted(map(str, first.collect()))
    path = f"{cache}/{token_counts.tokenizer_digest(vocabulary('byte_bpe_50k.json'))}"
    assert spark.read.parquet(path).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    again = token_counts.token_counts(docs.unionByName(docs.limit(1).withColumn("text", F.lit("brand new"))), vocabulary("byte_bpe_50k.json"), cache)
    assert spark.read.parquet(path).where("n_tokens > 0").count() + 1 == spark.read.parquet(path).count()
    assert len(want) == 13 and again.count() == 14
    assert token_counts.token_counts(empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0


def test_sentencepiece_counts(spark):
    import sentencepiece

    p = vocabulary("piece_bpe_32k.model")
    s = sentencepiece.SentencePieceProcessor(model_file=p)
    assert tokenizer.counts(p, ["some words", "", "é漢"]) == [len(s.encode(x)) for x in ("some words", "", "é漢")]


def test_pieces_give_the_ids_of_the_library():
    path = vocabulary("byte_bpe_50k.json")
    rng = random.Random(4)
    pools = ["abc XYZ 019 .,!?'\"-_", "àéîõüßñçøåæ œšž ÀÉ", " \t\n\r\x0b\x0c\x1c\x85\xa0", "''s 't're 've'm 'll'd ½²³ªº", "漢字 кириллица ελλ עברית", "‐‑–—‘’“”†•… ", "\u2003\u2028 \u3000\u200b \ufeff\u180e"]
    texts = ["".join(rng.choice(rng.choice(pools[: rng.randint(1, 7)])) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>x", " " * 5000, "x" * 5000, "x " * 5000, "", " ", "\n a"]
    assert tokenizer.may_cut(path)
    for at in range(0, len(texts), 256):
        some = texts[at : at + 256]
        want = tokenizer.whole_ids(path, some)
        assert [x.tolist() for x in tokenizer.ids(path, some)] == want and tokenizer.counts(path, some) == [len(x) for x in want]


def test_common_characters_are_cut_into_words_as_by_the_library():
    path = vocabulary("byte_bpe_50k.json")
    texts = [f"{c}a a{c}b 1{c} {c}{c}. '{c}s're{c} x'{c} .{c}\n {c}{c}a \n{c} a{c}.{c}, {c}" for c in map(chr, (*range(0x560), *range(0x560, 0xD7FF, 53), *range(0x2000, 0x2070)))]
    assert [x.tolist() for x in tokenizer.ids(path, texts)] == tokenizer.whole_ids(path, texts)


def test_new_words_go_to_the_model_and_frequent_ones_stay(monkeypatch):
    path, library, whole = vocabulary("byte_bpe_50k.json"), tokenizer.whole_ids, []
    batches = [[f"the Wört{k}, and über{k}x. the\nländ{'x' * k} isn't", f"the {k} and"] for k in range(40)]
    want = [library(path, b) for b in batches]
    tokenizer._known.cache_clear()
    monkeypatch.setattr(tokenizer, "REMEMBERED", 8)
    monkeypatch.setattr(tokenizer, "whole_ids", lambda p, texts: whole.extend(texts) or library(p, texts))
    assert [[x.tolist() for x in tokenizer.ids(path, b)] for b in batches] == want
    known = tokenizer._known(path)
    assert not whole and len(known) + len(known.old) < 30 and "and" in {**known, **known.old}
    tokenizer._known.cache_clear()


# 2 packing


def packed_well(rows, docs, capacity):
    """Every document whole, gapless sequences; returns the number of sequences."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in docs.items():
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert sum(r["length"] for r in pieces) == len(ids) and (len(ids) <= capacity) == (len(pieces) == 1)
        for k, r in enumerate(pieces):
            assert r["piece"] == k and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_is_whole_and_tight(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    rows = queries.op2_best_fit_packing(spark, SF).collect()
    used = packed_well(rows, docs, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        histogram = {rng.randint(1, 64): rng.randint(1, 150) for _ in range(rng.randint(1, 40))}
        sequences, ranks = defaultdict(list), defaultdict(list)
        for length, rank, n, first, offset in packing.plan_slots(histogram, 64):
            ranks[length] += range(rank, rank + n)
            for k in range(n):
                sequences[first + k].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
        room = []
        for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
            fits = [(b, k) for k, b in enumerate(room) if b >= length]
            if fits:
                room[min(fits)[1]] -= length
            else:
                room.append(64 - length)
        assert len(sequences) == len(room)


def test_packing_awkward(spark):
    rows = packing.pack(awkward(spark), vocabulary("byte_bpe_50k.json")).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in awkward(spark).collect())
    seen = defaultdict(list)
    for r in rows:
        seen[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty(spark), vocabulary("byte_bpe_50k.json")).count() == 0


def test_only_the_first_piece_is_short(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = {k: " ".join(f"w{i}" for i in range(k)) for k in (0, 1, 2, 3, 4, 5, 8, 11, 30)} | {100: "a b c d e f g", 101: "a b c d e f g h", 102: "x" * 200}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = set()
    for doc_id, text in texts.items():
        ids = np.asarray([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        ends = list(range(len(ids), 0, -8))[::-1]
        for piece, end in enumerate(ends):
            start = max(end - 8, 0)
            want.add((doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0, 8).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert all(r["length"] == 8 for r in got if r["piece"])


# 3 mixing


def filled(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, caps, clamped = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}, set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(caps[s] for s in clamped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= caps[s]}
        if not over:
            return {s: caps[s] if s in clamped else share[s] for s in sizes}
        clamped |= over
        if len(clamped) == len(sizes):
            return caps


def test_mix_meets_targets(spark):
    rows = queries.op3_source_mixing(spark, SF).collect()
    sizes, words = Counter(), {}
    for r in table(spark, SF, "documents").collect():
        words[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += words[r["doc_id"]]
    target = filled(sizes)
    taken = Counter()
    for r in rows:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    biggest = Counter()
    for r in rows:
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in sizes)
    assert sorted(rows) == sorted(queries.op3_source_mixing(spark, SF).repartition(3).collect())


def test_small_sources_are_clamped_in_rounds(spark):
    rows = [(k, "w " * 10, "en", "a", 1) for k in range(3)] + [(10 + k, "w " * 10, "en", "b", 1) for k in range(30)] + [(100 + k, "w " * 10, "en", None, 1) for k in range(300)]
    got = {r["source"]: r["target"] for r in mixing.plan(spark.createDataFrame(rows, DOC)).select("source", "target").distinct().collect()}
    want = filled({"a": 30, "b": 300, None: 3000})
    assert got == {s: pytest.approx(v) for s, v in want.items()} and got["a"] == 90 and got["b"] == 900


def test_mix_awkward(spark):
    docs = awkward(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    planned = Counter()
    for r in mixing.plan(docs).collect():
        planned[r["doc_id"], r["source"]] += r["times"]
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +planned
    assert mixing.mix(empty(spark)).count() == 0 and mixing.plan(empty(spark)).count() == 0


def test_rows_of_one_id_are_taken_one_by_one(spark):
    """A source made of one doc_id, or of none, meets a target that is a fraction of its words, and reruns agree."""
    for same in (7, None):
        rows = [(same, "w " * 10, "en", "a", 1)] * 60 + [(same, "w " * 10 + str(k), "en", "a", 1) for k in range(40)] + [(k, "w " * 10, "en", "b", 1) for k in range(1000, 1060)]
        docs = spark.createDataFrame(rows, DOC).repartition(5)
        got = mixing.plan(docs).collect()
        taken = Counter()
        for r in got:
            taken[r["source"]] += r["times"] * r["size"]
        assert all(abs(taken[r["source"]] - r["target"]) <= 11 for r in got) and taken["a"] % 1040
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.plan(docs.repartition(3)).collect()))


# 4 syncmers


def brute_edits(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        out[i] = text[: len(text) - cut] + after[:cut]
    return out


@pytest.mark.parametrize("rows", [4000, 17, 1])
def test_edits_follow_the_order(spark, rows, monkeypatch):
    monkeypatch.setattr(syncmers.block_starts, "__defaults__", (rows, 64))
    got = queries.op4_syncmer_fingerprints(spark, SF).collect()
    want = brute_edits([(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()])
    assert len(got) == len(want) and all(r["edited_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() for r in got)
    long = [r for r in got if r["n_chars"] > 200]
    assert all(0 <= r["near_edited"] <= 1 for r in got) and sum(r["near_edited"] > r["near_next"] + 0.2 for r in long) > 0.98 * len(long)


@pytest.mark.parametrize("rows", [4000, 3])
def test_rows_of_one_id_follow_each_other(spark, rows, monkeypatch):
    """Repeated and missing ids, brute force: an order of (id, text) in which rows alike stand side by side."""
    monkeypatch.setattr(syncmers.block_starts, "__defaults__", (rows, 64))
    monkeypatch.setattr(syncmers, "LOT", 2)
    docs = [(3, f"text {k} of three " * 9) for k in range(6)] + [(3, "copy " * 30)] * 5 + [(None, "none " * 20)] * 4 + [(None, f"other {k} " * 15) for k in range(5)] + [(9, "nine " * 40), (1, None), (2, "two two two")]
    got = syncmers.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = {hashlib.sha256(e.encode()).hexdigest(): (a, b) for _, a in docs for _, b in docs for a, b in [(a or "", b or "")] for e in [a[: len(a) - len(a) // 3] + b[: len(a) // 3]]}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in docs)
    ids = {}
    for i, t in docs:
        ids.setdefault(t or "", i)
    starts, ends, alike = Counter(), Counter(), 0
    for r in got:
        a, b = texts[r["edited_sha256"]]
        if a and len(a) // 3:
            starts[a] += 1
            ends[b] += 1
            alike += a == b
            x, y = ids[a], ids[b]
            assert x == y or (x, y) in ((9, 3), (3, 2), (2, 1), (None, 9)), (x, y)
    assert starts == Counter(t for _, t in docs if t and len(t) >= 3) and alike == 4 + 3


def brute_sketch(spark, texts):
    """The smallest anchors of each text by plain loops over word hashes."""
    words = [[w for w in re.split(r"\s+", t.lower()) if w] for t in texts]
    flat = spark.createDataFrame([(d, k, w) for d, ws in enumerate(words) for k, w in enumerate(ws)], "d int, k int, w string")
    hashes = defaultdict(list)
    for r in flat.select("d", "k", F.xxhash64("w").alias("h")).orderBy("d", "k").collect():
        hashes[r["d"]].append(r["h"])
    pairs = [(d, k, h[k], h[k + 1]) for d, h in hashes.items() for k in range(len(h) - 1)]
    s = {(r["d"], r["k"]): r["s"] for r in spark.createDataFrame(pairs, "d int, k int, a long, b long").select("d", "k", F.xxhash64("a", "b").alias("s")).collect()}
    closed = [(d, i, *(s[d, i + j] for j in range(4))) for d, h in hashes.items() for i in range(len(h) - 4) if min(s[d, i + j] for j in range(4)) in (s[d, i], s[d, i + 3])]
    out = defaultdict(set)
    for r in spark.createDataFrame(closed, "d int, i int, a long, b long, c long, e long").select("d", F.xxhash64("a", "b", "c", "e").alias("x")).collect():
        out[r["d"]].add(r["x"])
    return [sorted(out[d])[: syncmers.SKETCH] for d in range(len(texts))]


def test_fingerprints_against_brute_force(spark):
    """Fingerprints and both likenesses of plain texts, from loops and sets."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect() if r["text"] and r["text"].isascii() and 5 < len(r["text"].split()) and max(map(len, r["text"].split())) <= 32][:60]
    docs = [(i, t) for i, t in docs if not re.search(r"[\x1c-\x1f]", t)]
    got = {r["doc_id"]: r for r in syncmers.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    edits, order = brute_edits(docs), sorted(docs, reverse=True)
    own = dict(zip([i for i, _ in order], brute_sketch(spark, [t for _, t in order]), strict=True))
    other = dict(zip([i for i, _ in order], brute_sketch(spark, [edits[i] for i, _ in order]), strict=True))
    printed = lambda x: "".join(f"{h & (1 << 64) - 1:016x}" for h in x)

    def alike(a, b):
        joint = sorted(set(a) | set(b))[: syncmers.SKETCH]
        return len(set(joint) & set(a) & set(b)) / len(joint) if joint else 1.0

    assert len(order) > 30
    for k, (i, _) in enumerate(order):
        r, after = got[i], order[(k + 1) % len(order)][0]
        if len(edits[i].split()) >= 5:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (printed(own[i]), printed(other[i]))
            assert r["near_edited"] == pytest.approx(alike(own[i], other[i])) and r["near_next"] == pytest.approx(alike(own[i], own[after]))


def test_syncmers_are_context_free(spark):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "new words in front " + " ".join(words)), (3, " ".join(words[:25] + ["changed"] + words[26:]))], "doc_id long, text string")
    found = defaultdict(set)
    for r in syncmers.anchors(docs).collect():
        found[r["doc_id"]].add((r["anchor"], r["position"]))
    moved = {(a, p + 4) for a, p in found[1]}
    assert moved <= found[2] and len({a for a, _ in found[1] & found[3]}) >= 0.6 * len(found[1])
    a = syncmers.anchors(docs)
    best = syncmers.positional_matches(a.where("doc_id = 2"), a.where("doc_id = 1")).orderBy(F.desc("matches")).first()
    assert best["offset"] == 4 and best["matches"] == len(found[1])


def test_closed_rule_against_brute_force(spark):
    words = [f"w{k * 7919 % 101}" for k in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    h = [r[0] for r in spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string").orderBy("k").select(F.xxhash64("w")).collect()]
    s = [r[0] for r in spark.createDataFrame([(k, h[k], h[k + 1]) for k in range(299)], "k int, a long, b long").orderBy("k").select(F.xxhash64("a", "b")).collect()]
    want = [i for i in range(len(s) - 3) if min(s[i : i + 4]) in (s[i], s[i + 3])]
    assert sorted(r["position"] for r in syncmers.anchors(docs).collect()) == want


def test_fingerprints_awkward(spark):
    got = syncmers.fingerprint_edits(awkward(spark)).collect()
    assert len(got) == 13
    prints = defaultdict(set)
    for r in got:
        prints[r["doc_id"]].add(r["fingerprint"])
    assert prints[1] == prints[2] and len(prints[2]) == 1 and prints[3] == prints[4] == prints[5] == {""}
    one = syncmers.fingerprint_edits(awkward(spark).where("doc_id = 8")).first()
    assert one["near_next"] == 1.0
    assert syncmers.fingerprint_edits(empty(spark)).count() == 0
    plan = queries.op4_syncmer_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 5 extraction


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    tree = dom.parse("<body><div class=a><p>x</p><p>y</p></div><footer>z</footer></body>")
    forest = extraction.Forest([tree, dom.parse("<p>solo</p>")])
    n = len(forest.parents)
    unary, pair = rng.normal(size=(n, 2)), rng.normal(size=(extraction.N_KINDS, 2, 2))
    node, both, log_z = extraction.sum_product(forest, unary, pair)
    weight, total, joint = np.zeros((n, 2)), 0.0, np.zeros((n, 2, 2))
    for code in range(2**n):
        s = [(code >> i) & 1 for i in range(n)]
        w = np.exp(sum(unary[i, s[i]] for i in range(n)) + sum(pair[forest.kinds[i], s[forest.parents[i]], s[i]] for i in range(n) if forest.parents[i] >= 0))
        total += w
        for i in range(n):
            weight[i, s[i]] += w
            if forest.parents[i] >= 0:
                joint[i, s[forest.parents[i]], s[i]] += w
    child = forest.parents >= 0
    assert np.allclose(node, weight / total) and np.allclose(both[child], joint[child] / total) and log_z == pytest.approx(np.log(total))


def test_parser_forgives():
    tree = dom.parse("<ul><li>a<li>b &amp; c</ul><p><b>x<br>y<p>z<script>var p='<p>no</p>'</script><!-- n --><style>q{}")
    assert [t for t in tree.texts if t] == ["a", "b & c", "x y", "z"]
    for bad in ("", "<", "<<<>>>", "</p></p>", "<p", "<a href='x>y", "&#x110000; &lt", "<div " + "a='" * 50, "x" * 100_000, "<div>" * 2000 + "deep"):
        dom.parse(bad)


def test_tags_that_html_lets_out():
    shown = lambda page: [t for t in dom.parse(page).texts if t]
    assert shown("<html><head><title>t</title><article><p>one</p><p>two</p></article></html>") == ["one", "two"]
    assert shown("<html><head><meta a>words here<p>x") == ["words here", "x"] and shown("<title>t</title><p>x") == ["x"]
    assert shown("<head><script>'<p>'</script><body><p>b") == ["b"]
    for hidden in ("<button>Menu", "<svg><path d=x>", "<object data=x>fall", "<audio src=x>", "<select><option>a<option>b", "<video>"):
        assert shown(f"<div>{hidden}<p>hello</p></div><p>world</p>") == ["hello", "world"], hidden
    assert shown("<button><div>in</div></button><video><p>no</p></video><p>yes") == ["yes"] and shown("<button>a<button>b</button>c") == ["c"]
    assert shown("<noscript>x<p>y") == ["x", "y"] and shown("<noscript>x</noscript><p>y") == ["y"]
    assert shown("<p>&am<b>p;</b> &amp;am<i>p;</i> &lt;b</p>") == ["&amp; &amp; <b"]


def test_main_text_without_its_tags():
    """The same article however it is marked up, and where head and body are left out."""
    body = "".join(f"<p>Sentence {k} of the story tells what came of it, at some length, for readers.</p>" for k in range(6))
    side = "<nav class=nav><ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(6)) + "</ul></nav>"
    end = "<footer>&copy; Someone <a href=/x>Imprint</a></footer>"
    want = " ".join(f"Sentence {k} of the story tells what came of it, at some length, for readers." for k in range(6))
    for start, stop in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<div id=story>", "</div>"), ("<section class=post>", "")):
        pages = [f"<html><head><title>x</title></head><body>{side}{start}{body}{stop}{end}</body></html>", f"<title>x</title>{side}{start}{body}{stop}{end}", f"<html><head><title>x</title>{side}{start}{body}{stop}{end}"]
        assert extraction.main_texts(extraction.trained(), pages) == [want] * 3, start


def test_held_out_layouts():
    model = extraction.trained()
    right = total = 0
    for page in extraction.labelled_pages(150, 77):
        tree = dom.parse(page)
        truth = extraction.labels(tree)
        for i, p in enumerate(model.marginals([tree])[0]):
            if tree.names[i] == "#text":
                right += ((p >= 0.5) == truth[i]) * len(tree.texts[i])
                total += len(tree.texts[i])
    assert right / total > 0.95


def test_article_text_of_pages(spark):
    rows = queries.op5_html_extraction(spark, SF).collect()
    html = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    import html as h

    assert len(rows) == len(html)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", html[r["page_id"]], re.S)[1]
        inside = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inside))
        assert r["text"] == " ".join(h.unescape(inside).split()) and r["n_chars"] == len(r["text"])


def test_extraction_awkward(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<html><body></body></html>"), (3, "u", "<article><p>" + "word " * 50_000 + "</p></article>"), (3, "u", "<article><h1>t</h1><p>caf&eacute; &amp;  x</p></article><div class=comments><p>no no</p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("z")})
    got = sorted((r["n_chars"], r["text"][:12]) for r in extraction.extract(pages).collect())
    assert got[:3] == [(0, ""), (0, ""), (0, "")] and got[3] == (10, "t café & x") and got[4][0] == 249_999
    assert extraction.extract(pages.limit(0)).count() == 0


# 6 simhash


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("plan", simhash.PLANS)
def test_components_against_all_pairs(spark, plan):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    near = [(r["doc_id"], r["text"]) for r in docs.collect()]
    near += [(10_000 + i, " ".join(t.split()[:-1] + ["edited"])) for i, t in near[:60]]
    docs = spark.createDataFrame(near, "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, plan=plan).collect()}
    prints = [brute_print(t) for _, t in near]
    assert all(got[i][0] == f"{p:016x}" for (i, _), p in zip(near, prints, strict=True))
    order = sorted(range(len(near)), key=lambda k: near[k][0])
    links = [(a, b) for a in range(len(order)) for b in range(a) if (prints[order[a]] ^ prints[order[b]]).bit_count() <= 4]
    root = groups(len(order), links)
    assert len(links) > 30 and all(got[near[order[k]][0]][1] == near[order[root[k]]][0] for k in range(len(order)))


def test_every_anchor_in_reach_is_taken():
    rng = np.random.default_rng(0)
    part = simhash.Part(5, 16, 4, 1)
    fp = rng.integers(0, 2**63, 20).astype(np.uint64)
    row, anchor, home = simhash.anchors(fp, part)
    every = np.arange(1 << 16, dtype=np.uint64)
    code = every[simhash.nearest_anchor(every, part) == every]
    assert len(code) == part.anchors
    points = (fp >> np.uint64(5)) & np.uint64(0xFFFF)
    for k in range(20):
        reach = {int(c) for c in code if int(c ^ points[k]).bit_count() <= 2}
        taken = set(anchor[row == k].tolist())
        own = anchor[(row == k) & home]
        assert taken <= reach and len(own) == 1 and int(own[0] ^ points[k]).bit_count() <= 1
        # All anchors that a point within the threshold may call its nearest are among them.
        assert {int(simhash.nearest_anchor(points[k : k + 1] ^ np.uint64(1 << b), part)[0]) for b in range(16)} <= taken


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(buckets.dealt, "__defaults__", (20,))
    monkeypatch.setattr(buckets, "ESTIMATE", 1)
    centre = rng.getrandbits(64)
    prints = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)]
    prints = sorted(set(prints))
    points = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "node long, fp long")
    links = simhash.near_links(points, simhash.PLANS[0])
    assert links.count() < 40 * len(prints)
    parts = components.connected_components(links)
    want = groups(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r["node"]: r["component"] for r in parts.collect()}
    assert [got.get(k, k) for k in range(len(prints))] == want


def test_buckets_by_walk_and_by_pairs():
    rng = np.random.default_rng(1)
    for limit in (1 << 20, 60, 4):
        for _ in range(40):
            sizes = rng.integers(1, 12, 30)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            homes, v = rng.random(starts[-1]) < 0.5, rng.integers(0, 40, starts[-1])
            got = buckets.bucket_links(starts, homes, lambda i, j, v=v: np.abs(v[i] - v[j]) <= 2, limit)
            links = [(i, j) for k in range(30) for i in range(starts[k], starts[k + 1]) for j in range(starts[k], starts[k + 1]) if i != j and (homes[i] or homes[j]) and abs(v[i] - v[j]) <= 2]
            want = groups(int(starts[-1]), links)
            assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_long_chains_connect(spark):
    order = list(range(300))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(1000, 1001), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert {got[k] for k in range(300)} == {0} and got[1001] == 1000 and len(got) == 302
    assert components.connected_components(edges.limit(0)).count() == 0


def test_simhash_awkward(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == 13
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[3]["component_id"] == by[4]["component_id"] == by[5]["component_id"] == 3 and by[4]["fingerprint"] == "0" * 16
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([(None, "alone")], "doc_id long, text string")).first()["component_id"] is None


def test_a_row_without_an_id_is_a_bridge(spark):
    """Three texts in a chain, the middle one without an id: one component, named by the smallest id."""
    rng, found = random.Random(1), None
    words = [f"w{k}" for k in range(4000)]
    while found is None:
        base = [rng.choice(words) for _ in range(400)]
        chain = [base]
        for _ in range(2):
            nxt = list(chain[-1])
            nxt[rng.randrange(400)] = "changed" + str(rng.random())
            chain.append(nxt)
        p = [simhash.fingerprint(" ".join(t)) for t in chain]
        d = lambda a, b: (p[a] ^ p[b]).bit_count()
        if 0 < d(0, 1) <= 4 and 0 < d(1, 2) <= 4 and d(0, 2) > 4:
            found = [" ".join(t) for t in chain]
    docs = spark.createDataFrame([(5, found[0]), (None, found[1]), (3, found[2]), (8, "alone")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {5: 3, None: 3, 3: 3, 8: 8}


# 7 lines


def shingles(text):
    return {text[i : i + lines.SHINGLE] for i in range(len(text) - lines.SHINGLE + 1)}


def kept_lines(rows):
    """Texts by plain comparison of all lines."""
    first = {}
    for i, text in sorted(rows):
        for line in (text or "").split("\n"):
            if line.strip():
                first.setdefault(line.strip(), i)
    names = list(first)
    sets = [shingles(x) if len(x) >= lines.MIN_CHARS else {x} for x in names]
    links = [(a, b) for a in range(len(names)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(len(names), links)
    best = {}
    for k, r in enumerate(root):
        best.setdefault(r, []).append((first[names[k]], lines.line_digest(names[k]), names[k]))
    stays = {min(v)[2] for v in best.values()}
    out = {}
    for i, text in rows:
        seen, kept = set(), []
        for line in (text or "").split("\n"):
            bare = line.strip()
            if not bare or (bare in stays and first[bare] == i and bare not in seen):
                kept.append(line)
                seen.add(bare)
        out[i] = None if text is None else "\n".join(kept)
    return out, len(links)


def test_lines_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()][:120]
    rng = random.Random(2)
    for i, text in rows[:40]:
        changed = [x.replace("th", "ht", 1) if rng.random() < 0.7 else x for x in text.split("\n")]
        rows.append((1000 + i, "\n".join(changed)))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, links = kept_lines(rows)
    assert links > 30 and sum(got[i] == want[i] for i in want) >= len(want) - 1


def test_signatures_find_alike_lines():
    rng = random.Random(0)
    hit = total = 0
    for _ in range(800):
        a = "".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randint(40, 300)))
        b = list(a)
        for _ in range(max(1, len(a) // 100)):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        b = "".join(b)
        if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)):
            x, y = lines.band_hashes(lines.signatures([a, b]))
            hit, total = hit + bool((x == y).any()), total + 1
    assert total > 200 and hit >= 0.98 * total


def test_exact_jaccard():
    texts = ["hello world this is a line", "hello world this is a linf", "zzzz", "é" * 30, "completely different words here"]
    keys, bounds, bits = lines.shingle_sets(texts)
    assert np.diff(bounds).tolist() == [len(shingles(x)) for x in texts]
    for a in range(5):
        for b in range(5):
            if shingles(texts[a]) and shingles(texts[b]):
                j = len(shingles(texts[a]) & shingles(texts[b])) / len(shingles(texts[a]) | shingles(texts[b]))
                assert lines.alike(keys, bounds, bits, 0.7)(np.array([a]), np.array([b]))[0] == (j >= 0.7)


def test_lines_awkward(spark):
    docs = awkward(spark)
    got = lines.dedup_lines(docs)
    assert got.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"] and got.count() == 13
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r)
    assert by[3][0]["text"] is None and by[4][0]["text"] == "" and by[9][0]["text"] == "one line of some length here\nshort\n" and by[9][0]["n_dropped"] == 1
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_short_copies_go_exactly(spark):
    """Exact copies of any length go, but blank lines; lines under MIN_CHARS are never alike unless equal."""
    rows = [(1, "And.\nQui.\n\nÈ.\na line that is long enough to count"), (2, " And. \nOn.\n\nOn.\nThing 1"), (3, "Qui.\nÈ.\nThing 2\nshort but nineteen!"), (None, "On.\nnew\nshort but nineteen!")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "On.\n\nThing 1", 3: "Thing 2\nshort but nineteen!", None: "new"}


def test_rows_of_one_id_are_documents_of_their_own(spark):
    line, other = "a line that several rows hold in common", "another line of some length that stays"
    rows = [(None, f"{line}\n{other}"), (None, f"{line}\nonly here, and long enough to be compared"), (None, line), (4, f"{line}\nfour"), (4, line), (4, line), (2, "two"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lines.dedup_lines(docs).collect()
    every = Counter(x for r in got for x in (r["text"] or "").split("\n") if x)
    assert len(got) == len(rows) and set(every.values()) == {1} and set(every) == {x for _, t in rows for x in (t or "").split("\n") if x}
    assert [r["doc_id"] for r in got if line in (r["text"] or "")] == [4] and sum(r["text"] is None for r in got) == 1


def test_wide_batches_keep_rows_apart():
    texts = [f"line number {k % 70_000} of a batch of many rows" for k in range(70_001)]
    keys, bounds, bits = lines.shingle_sets(texts)
    assert bits == 47 and len(bounds) == 70_002
    near = lines.alike(keys, bounds, bits, 0.99)
    assert near(np.array([0, 0]), np.array([70_000, 1])).tolist() == [True, False]


def test_no_short_copy_is_left(spark):
    got = [r["text"] for r in queries.op7_line_dedup(spark, SF).collect()]
    short = Counter(x.strip() for t in got if t for x in t.split("\n") if 0 < len(x.strip()) < lines.MIN_CHARS)
    before = {x.strip() for r in table(spark, SF, "documents").collect() for x in (r["text"] or "").split("\n") if 0 < len(x.strip()) < lines.MIN_CHARS}
    assert len(short) > 50 and set(short) == before and max(short.values()) == 1


# 8 top k


def test_top_k_against_sql(spark):
    got = sorted(map(tuple, queries.op8_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(sql(queries.ORACLES["op8_top_k"]).fetchall())


@pytest.mark.parametrize("numbers", [1 << 22, 0])
def test_top_k_across_blocks_and_ties(spark, monkeypatch, numbers):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "GROUP", 3)
    monkeypatch.setattr(topk, "BROADCAST_NUMBERS", numbers)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 6) / 256]) for i in range(200)]
    rows += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [1.0] * 5), (505, []), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit("y"), "score": F.lit(1)})
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    v = {i: np.floor(256 * np.asarray(x)) for i, x in rows[:200]}
    for q in range(0, 200, 20):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in got if r["query_id"] == q] == best
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id < 3"), frame.where("vec_id = 0")).count() == 2


def test_reading_stops_once_outsiders_cannot_qualify():
    """On skewed vectors a query reads a part of each list only; what it returns is exact all the same."""
    rng = np.random.default_rng(3)
    n, k = 4000, 5
    ids = np.arange(n)
    block = np.floor(rng.normal(size=(n, 8)) * 3)
    block[:40] = np.abs(block[:40]) * 200 + 20
    queries = block[:6] / 100
    trace = []
    got = list(topk.read_lists(np.arange(6), queries, ids, block, k, trace))
    for q, (own, best, scores) in enumerate(got):
        want = sorted((-(queries[q] @ block[i]), i) for i in range(n) if i != own)[:k]
        assert np.allclose([-s for s, _ in want], scores) and best.tolist() == [i for _, i in want]
    assert [d for d, _ in trace] == sorted({d for d, _ in trace}) and trace[0] == (500, 6) and trace[-1][0] < n
    flat, full = rng.normal(size=(300, 4)), []
    list(topk.read_lists(np.arange(2), flat[:2], np.arange(300), flat, k, full))
    assert full[-1][0] == 300 or full[-1][1] < 2


# 9 WARC


def test_warc_against_sql(spark):
    got = sorted(map(str, map(tuple, queries.op9_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())))
    assert got == sorted(map(str, sql(queries.ORACLES["op9_warc"]).fetchall()))


def test_warc_round_trip(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\né" + "x" * 100
    rows = [(5, "http://a", tricky), (2, "http://b\r\nEvil: 1", tricky), (9, None, tricky), (3, "u", "short"), (4, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", tricky), (2, "http://b", tricky), (11, "u", "y" * 300_000), (None, "n", "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload_digest": F.lit("x"), "refers_to": F.lit("y")})
    path = f"file://{tmp_path}/warc"
    warc.write_archives(warc.resolve_revisits(pages), path, records_per_file=2)
    back = warc.resolve_payloads(warc.read_archives(spark, path)).collect()
    assert sorted((r["page_id"] or -1, bytes(r["payload"]).decode()) for r in back) == sorted((i or -1, h or "") for i, _, h in rows)
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in back if r["payload_bytes"] == len(tricky.encode()))
    assert kinds == [(-1, "revisit", 2), (2, "response", None), (2, "response", None), (5, "revisit", 2), (9, "revisit", 2)]
    assert all(r["record_type"] == "response" for r in back if r["payload_bytes"] < 100)
    none = f"file://{tmp_path}/none"
    warc.write_archives(warc.resolve_revisits(pages.limit(0)), none)
    assert warc.read_archives(spark, none).count() == 0


def test_large_pages_are_not_shuffled(spark, tmp_path):
    """Payloads of several MB, in files bounded by bytes; each record has an id of its own."""
    big = "m" * 3_000_000
    rows = [(k, "u", big + str(k // 2)) for k in range(12)] + [(k, "u", f"small page {k % 7} " * 20) for k in range(20, 60)] + [(70, "u", "same id " * 30), (70, "u", "same id " * 30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages")
    pages = spark.read.parquet(f"file://{tmp_path}/pages")
    resolved = warc.resolve_revisits(pages.where("page_id < 70"))
    shuffles = [x for x in resolved._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "Broadcast" not in x]
    assert not shuffles
    path = f"file://{tmp_path}/big"
    warc.write_archives(warc.resolve_revisits(pages), path)
    records = warc.read_archives(spark, path)
    assert {p.name for p in (tmp_path / "big").iterdir()} == {"class-0", "class-2"}
    back = warc.resolve_payloads(records).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in back) == sorted((i, h) for i, _, h in rows)
    assert records.select("record_id").distinct().count() == len(rows) and records.where("record_type = 'revisit'").count() == 6 + 33


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"HTTP/1.1\r\n\r\n"))


# 10 toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op10_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    truth, said = np.array([r["toxic"] for r in scored]), np.array([r["predicted"] for r in scored])
    assert said[truth == 1].mean() > 0.85 and said[truth == 0].mean() < 0.02
    again = {r["doc_id"]: r["score"] for r in queries.op10_toxicity(spark, sf).where("doc_id < 50").collect()}
    assert again == {r["doc_id"]: r["score"] for r in queries.op10_toxicity(spark, sf).repartition(7).where("doc_id < 50").collect()}


def test_held_out_ids_follow_crc32(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    got = {r["doc_id"]: r["h"] for r in ids.select("doc_id", toxicity.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.items())


def test_risk_stays_non_negative_and_finds_the_word(spark):
    rng = random.Random(0)
    plain = lambda: [f"p{'abcdefghij'[rng.randint(0, 9)]}{'klmnopqrst'[rng.randint(0, 9)]}{'uvwxyz'[rng.randint(0, 5)]}" for _ in range(40)]
    positive = [[*plain(), "bad"] for _ in range(120)]
    others = [[*plain(), "bad"] if k % 10 == 0 else plain() for k in range(900)]
    rows = spark.createDataFrame([(" ".join(t), True) for t in positive] + [(" ".join(t), False) for t in others], "text string, positive boolean")
    counts = toxicity.feature_counts(rows)
    brute = Counter(b for t in positive + others for b in {x for w in set(t) for x in toxicity.word_buckets(w)})
    assert {r["feature"]: r["n"] for r in counts.collect()} == brute
    names = toxicity.choose_features(counts, 120, 1020, 0.1)
    bad = toxicity.word_buckets("bad")[0]
    assert bad in names.tolist()
    of = lambda t: np.array([b for w in sorted(set(t)) for b in toxicity.word_buckets(w)])
    w, b = toxicity.fit_nnpu([of(t) for t in positive], [of(t) for t in others], names, 0.1)
    assert (w >= 0).all() and sum(w[names.tolist().index(x)] for x in toxicity.word_buckets("bad") if x in names) + b > 0 > b


def test_gradient_of_the_risk():
    """Finite differences, on either side of the correction."""
    rng = np.random.default_rng(5)
    names = np.arange(12)
    rows = lambda n: toxicity.Rows([rng.integers(0, 12, rng.integers(1, 6)) for _ in range(n)], names)
    p, u, seen = rows(30), rows(50), set()
    for scale in (0.3, 3.0, 8.0):
        w = rng.normal(size=13) * scale - scale * (scale > 1)
        for prior in (0.1, 0.5):
            _, clean, g = toxicity.risk(p, u, w, prior)
            seen.add(clean >= 0)
            goal = lambda v, keep=clean >= 0, prior=prior: (lambda r: (r[0] + r[1]) if keep else -r[1])(toxicity.risk(p, u, v, prior))
            for k in range(13):
                step = np.zeros(13)
                step[k] = 1e-6
                assert (goal(w + step) - goal(w - step)) / 2e-6 == pytest.approx(g[k], abs=1e-5)
    assert True in seen


def test_scores_by_plain_loops(spark):
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    if model is None:
        model = toxicity.Model(np.array(sorted(toxicity.word_buckets("vile"))), np.array([[1.0, 2.0, 0.5], [0.5, 1.0, 0.0]]), np.array([-2.0, -1.0]))
    of = dict(zip(model.names.tolist(), model.weights.T, strict=True))
    for text in ("", "plain words", "Vile, vile! and VILENESS", *[r["text"] or "" for r in table(spark, SF, "documents").limit(20).collect()]):
        total = [b + sum(of[h][k] for w in set(re.findall(r"[^\W\d_]+", text.lower())) for h in toxicity.word_buckets(w) if h in of) for k, b in enumerate(model.biases)]
        assert model.scores([text])[0] == pytest.approx(np.mean([1 / (1 + np.exp(-min(30, max(-30, x)))) for x in total]))


def test_repeated_ids_do_not_multiply(spark, monkeypatch):
    """60 rows of one id are 60 rows of training, not 60 times 60."""
    rows = [(i, f"plain words number {i % 7} here" + (" vile" if i % 4 == 0 else "")) for i in range(328)] + [(4, "vile words again")] * 60 + [(None, "plain words of nobody")] * 9
    marks = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(0, 328, 2)] * 3 + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "choose_features", lambda counts, p, n, prior, f=toxicity.choose_features: seen.update(p=p, n=n) or f(counts, p, n, prior))
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda p, u, *a, f=toxicity.fit_nnpu: seen.update(fp=len(p), fu=len(u)) or f(p, u, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert toxicity.train(docs, marks) is not None
    free = [i for i, _ in rows if zlib.crc32(str(i if i is not None else "").encode()) % 5]
    assert seen["n"] == len(free) and seen["fu"] == len({(i, t) for i, t in rows if i in set(free)}) and seen["p"] == sum(i is not None and i % 4 == 0 for i in free)


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    no_labels = spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, no_labels) is None
    got = toxicity.score(docs, None)
    assert got.count() == 13 and got.columns == [*(c for c in docs.columns if c != "toxicity"), "toxicity"] and got.where("toxicity <> 0").isEmpty()
    texts = [(i, f"plain words number {i % 7} here" + (" vile" if i % 4 == 0 else "")) for i in range(400)]
    marks = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(0, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark.createDataFrame(texts, "doc_id long, text string"), marks)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == 13 and all(0 <= r["toxicity"] <= 1 for r in scored)
    assert model.scores(["so vile"])[0] > model.scores(["so plain"])[0]
    assert toxicity.train(empty(spark), marks) is None


# the pipeline


def test_stages_by_hand(spark, tmp_path):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)

    def run(name, frame):
        stage[name](spark, frame, SF).write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    clean = run("toxicity", docs)
    assert clean.columns == docs.columns and clean.count() <= len(rows)
    model = toxicity.train(docs, table(spark, SF, "labels"))
    kept = {i for i, r in rows.items() if model is None or model.scores([r["text"]])[0] < 0.5}
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == kept
    lined = run("line_dedup", clean)
    texts = {r["doc_id"]: r["text"] for r in lined.collect()}
    want, _ = kept_lines([(i, rows[i]["text"]) for i in kept])
    assert sum(texts[i] == want[i] for i in kept) >= len(kept) - 1 and lined.where("n_chars <> length(text)").isEmpty()
    one = run("simhash_near_dedup", lined)
    order = sorted(texts)
    prints = [brute_print(texts[i]) for i in order]
    root = groups(len(order), [(a, b) for a in range(len(order)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {r["doc_id"] for r in one.collect()} == {order[k] for k in range(len(order)) if root[k] == k}
    mixed = run("source_mixing", one)
    times = {r["doc_id"]: r["times"] for r in mixing.plan(one).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})
    packed = run("best_fit_packing", mixed)
    assert packed.where("piece = 0").count() == mixed.count()


def test_near_duplicates_by_word_sets(spark):
    """Texts of five-word Jaccard 0.8 or more go, though their fingerprints differ in more than four bits; others stay."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(120)]
        texts += [base, base[:60] + ["new", "words"] + base[62:], [*base[:30], "x", *base[30:60], "y", *base[60:90], "z", *base[90:]], base[:60] + [rng.choice(words) for _ in range(60)]]
    rows = [(k, " ".join(t), "en", "s", len(" ".join(t))) for k, t in enumerate(texts)]
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    prints = [brute_print(r[1]) for r in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    bits = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = groups(len(rows), alike + bits)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOC), SF).collect()}
    assert len(set(alike) - set(bits)) > 20 and got == {k for k in range(len(rows)) if root[k] == k}


def test_one_id_with_two_texts(spark):
    """Unlike texts under one id, or under none, stay; copies and near copies go, whatever their ids."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()) + str(rng.randint(0, 99)) for _ in range(90))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, b), (1, a), (2, a), (None, c), (None, d), (None, c), (None, a), (3, c + " more"), (4, None), (5, ""), (6, d + " words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == Counter([(1, a), (1, b), (3, c + " more"), (4, None), (6, d + " words")])


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline_on_awkward_documents(spark, clash):
    docs = awkward(spark, clash)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "best_fit_packing" or out.columns == docs.columns
        out.count()
        docs = out if name != "best_fit_packing" else docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0, name
