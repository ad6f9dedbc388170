"""Each operator against a brute-force version, and the odd cases: nulls, empty
and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import bpe, components, embedding_dedup, exact_dedup, line_dedup, packing, pii, quality, simhash, subwords, suffix_dedup, toxicity
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.suffix_sort import equal_prefixes, suffix_order

ODD = [(1, None), (2, ""), (3, "  \n "), (4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, None), (5, "x " * 3000), (6, "A  b\tc d"), (7, "a b c d"), (8, "日本語 é"), (9, "one\ntwo\nthree"), (10, "zero\none\ntwo\nthree\n\nfour")]


def frame(spark, rows=ODD):
    """With extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 7, "k", None) for i, t in rows], "doc_id long, text string, fp int, kept string, bucket string")


def key(rows):
    return sorted(map(str, rows))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(80):
        a = rng.integers(1, 4, int(rng.integers(1, 40)))
        assert suffix_order(a.astype(np.int64), 1000).tolist() == sorted(range(len(a)), key=lambda i: tuple(a[i:]))
    text = np.frombuffer(b"abcabcabcabcabcx" * 9, np.uint8)
    starts = np.arange(len(text) - 20)
    number = equal_prefixes(text, starts, 20)
    for i in starts:
        for j in starts:
            assert (number[i] == number[j]) == (text[i : i + 20].tobytes() == text[j : j + 20].tobytes())


def brute_repeats(rows, length=50):
    last, first, out = 2**63 - 1, {}, []
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, last), last if i is None else i)
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (last if i is None else i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1500)
    rnd = random.Random(2)
    base = ["".join(rnd.choice("ab cé") for _ in range(200)) for _ in range(4)]
    rows = ODD + [(rnd.choice([i, i // 2, None]), rnd.choice([base[i % 4], base[i % 4][20:90] + "#" + base[i % 3][5:80], "a" * 120, "z" * 49])) for i in range(11, 60)]
    found = suffix_dedup.remove_repeats(frame(spark, rows).repartition(4), hot=hot).collect()
    assert key(tuple(r) for r in found) == key(brute_repeats(rows))
    assert suffix_dedup.remove_repeats(frame(spark, []), hot=hot).count() == 0


def brute_lines(rows, gram=line_dedup.GRAM, window=line_dedup.WINDOW):
    """Windows, selection, first places and extension, one line at a time."""
    docs, places = {}, []
    for i, t in rows:
        if i is None or (i, t or "") in docs:
            continue
        full = [(n, x.strip(" \t\n\r\x0b\x0c")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
        words = [len(re.findall("[^\x20\x09-\x0d]+", x)) for _, x in full]
        reach = lambda k, n: next((e for e in range(k, len(full)) if sum(words[k : e + 1]) >= n), None)
        name = lambda k, e: hashlib.md5("\n".join(x for _, x in full[k : e + 1]).encode()).hexdigest()
        grams = {k: (name(k, e), e) for k in range(len(full)) if (e := reach(k, gram)) is not None}
        windows = [(k, e) for k in range(len(full)) if (e := reach(k, window)) is not None]
        windows = windows or [(0, len(full) - 1)]
        picked = sorted({min(inside)[1] * -1 for k, e in windows if (inside := [(grams[g][0], -g) for g in range(k, e + 1) if g in grams and grams[g][1] <= e])})
        docs[i, t or ""] = full
        for n, k in enumerate(picked):
            lo, hi = picked[n - 1] if n else 0, picked[n + 1] if n + 1 < len(picked) else len(full) - 1
            order = (i, xxhash.xxh64_intdigest((t or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63), k)
            places.append((grams[k][0], order, (i, t or ""), grams[k][1], lo, hi))
    first, gone = {}, {}
    for p in sorted(places, key=lambda p: p[1]):
        first.setdefault(p[0], p)
    for g, order, doc, e, lo, hi in places:
        _, f_order, f_doc, f_e, f_lo, f_hi = first[g]
        if order > f_order:
            mine, other, a, b = docs[doc], docs[f_doc], order[2], e
            while a > lo and f_order[2] - (order[2] - a) > f_lo and mine[a - 1][1] == other[f_order[2] - (order[2] - a) - 1][1]:
                a -= 1
            while b < hi and f_e + (b - e) < f_hi and mine[b + 1][1] == other[f_e + (b - e) + 1][1]:
                b += 1
            gone.setdefault(doc, set()).update(range(mine[a][0], mine[b][0] + 1))
    return [(i, t if (i, t or "") not in gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t])) for i, t in rows]


def line_rows():
    rnd = random.Random(3)
    para = [" ".join("p%d_%d" % (k, j) for j in range(n)) for k, n in enumerate((9, 10, 19, 20, 21, 60))] + ["é" * 300, "  tail  of one \t"]
    some = ["aa", "bb ", "cc", "", " \t", "dd ee", "ee", "ff gg hh", *para]
    rows = ODD + [(i, "\n".join(rnd.choice([*some, f"only {i}"]) for _ in range(rnd.randint(0, 14)))) for i in range(11, 120)]
    block = "\n".join(["u%d v%d w%d" % (k, k, k) for k in range(40)])
    rows += [(i, f"start {i}\n{block}\n\nend {i}") for i in range(200, 210)] + [(210, block + "\n" + block), (210, "x\n" + block), (210, None)]
    return rows + [(300, "\n".join(["same", "again"] * 2_000))]


@pytest.mark.parametrize("hot", [line_dedup.HOT_SHARE, 1.0])
def test_line_dedup(spark, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "_GROUP", 2000)
    rows = line_rows()
    monkeypatch.setattr(line_dedup.repeated_runs, "__defaults__", (*line_dedup.repeated_runs.__defaults__[:-1], hot))
    found = line_dedup.dedup_lines(spark.createDataFrame([(i, t, 7, "k", None, 9) for i, t in rows], "doc_id long, text string, fp int, gone string, gram_a string, n_lines int"))
    assert set(found.columns) == {"doc_id", "text", "fp", "gone", "gram_a", "n_lines", "n_removed"}
    got, want = found.collect(), brute_lines(rows)
    assert key((r.doc_id, r.text) for r in got) == key(want)
    assert sum(r.n_removed for r in got) > 400 and all(r.n_lines == 4_000 for r in got if r.doc_id == 300)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_keeps_the_first_of_equal_lines_and_finds_windows(spark):
    rows = line_rows()
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()]
    strip = lambda t: {x.strip() for x in (t or "").split("\n")}
    assert set().union(*(strip(t) for _, t in rows)) - {""} == set().union(*(strip(t) for _, t in got)) - {""}
    # A line of a whole window's words stands once per id at most.
    long = [x for i, t in got if i is not None for x in (t or "").split("\n") if len(x.split()) >= line_dedup.WINDOW and i < 200]
    assert len(long) == len(set(long))


@pytest.mark.parametrize("options", [{}, {"capacity": 1, "max_depth": 4}, {"capacity": 1, "hot_share": 1.0}, {"hash_of": lambda c: F.shiftleft(F.length(c).cast("long"), 60)}, {"hash_of": lambda c: F.lit(-7).cast("long"), "hot_share": 1.0}])
def test_exact_dedup(spark, options):
    """Also with texts of equal hash in one chain, and with all rows under one."""
    rows = ODD + [(100 + k, f"text {k % 40}\v{'x' * (k % 7)}") for k in range(150)]
    found = exact_dedup.exact_duplicates(frame(spark, rows), **options).collect()
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert key(tuple(r) for r in found) == key(want)
    assert exact_dedup.exact_duplicates(frame(spark, []), **options).count() == 0


def test_exact_dedup_keeps_a_chain_in_the_bucket_that_owns_it(spark):
    rows = [(k, f"text {k % 60}") for k in range(240)]
    index = exact_dedup.Index(frame(spark, rows), capacity=4, hash_of=lambda c: F.xxhash64(F.substring(c, 1, 6)))
    pages = index.pages.collect()
    assert len(pages) == 60 and all(p.group_size == 4 for p in pages)
    chains = {}
    for p in pages:
        chains.setdefault(p.h, set()).add(p.bucket)
    assert len(chains) == 10 and all(len(b) == 1 for b in chains.values()) and len({p.bucket for p in pages}) > 1
    placed = {r.h: r.bucket for r in index.place(index.probes).collect()}
    assert all(chains[h] == {b} for h, b in placed.items())


def test_directory_splits_only_what_is_full():
    slots = exact_dedup.directory({0: 5, 1: 5, 8: 1, 15: 3}, capacity=5, max_depth=4)
    assert len(slots) == 16 and slots[0] == (0, 4) and slots[1] == (1, 4) and slots[15] == (8, 1)


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 300), rnd.randrange(100, 300)) for _ in range(120)] + [(400, k) for k in range(401, 450)]
    links = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "src long, dst long")
    want = roots(450, pairs)
    for limit in (1_000_000, 5):
        found = {r.node: r.component for r in components.components(links, limit).collect()}
        assert found == {n: want[n] for p in pairs for n in p if any(n in q and q[0] != q[1] for q in pairs)}
    assert components.components(links.limit(0)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("tile", [32_768, 3])
def test_simhash(spark, tile):
    rnd = random.Random(5)
    words = ["w%d" % k for k in range(50)]
    base = [[rnd.choice(words) for _ in range(200)] for _ in range(5)]
    rows = list(ODD)
    for i in range(20, 70):
        w = list(base[i % 5])
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(200)] = "n%d" % rnd.randrange(9)
        rows.append((i, " ".join(w)))
    fp = [brute_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3])
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in root}
    found = simhash.near_duplicates(frame(spark, rows), tile_rows=tile).collect()
    assert key((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == key((i, f, least[r]) for (i, _), f, r in zip(rows, fp, root))
    kept = {r.doc_id for r in simhash.deduplicate(frame(spark, rows)).collect()}
    assert kept == {i for (i, _), r in zip(rows, root) if i is None or least[r] == i}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((300, 16))
    v[40:90] = v[40] + 0.05 * rng.standard_normal((50, 16))
    v[100] = v[99]
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, tile=16).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    root = roots(300, [(a, b) for a, b in zip(*np.nonzero(link))])
    assert all((found[k].n_links, found[k].component_id, found[k].kept) == (link[k].sum(), root[k], root[k] == k) for k in range(300))
    assert all((found[k].n_links, found[k].component_id) == (0, k) for k in (900, 901, 902, 903, 904))
    assert found[906].component_id == 905 and found[905].n_links == 1 and found[None].component_id is None
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def pairs_and_cluster(spark, n=3000, cluster=1000, pairs=600, dim=64):
    """One cluster, isolated pairs of cosine 0.92, and single vectors."""
    rng = np.random.default_rng(11)
    v = rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:cluster] = v[0] + 0.01 * rng.standard_normal((cluster, dim))
    a = np.arange(cluster, cluster + pairs)
    away = v[a + pairs] - (v[a + pairs] * v[a]).sum(axis=1, keepdims=True) * v[a]
    v[a + pairs] = 0.92 * v[a] + np.sqrt(1 - 0.92**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    return a, a + pairs, spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")


def test_embedding_audit_sees_lost_pairs_beside_a_cluster(spark):
    a, b, table = pairs_and_cluster(spark)
    # Without local joins the first orders lose pairs; the cluster's links alone do not end the search.
    found = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(table, rounds=0).collect()}
    assert np.mean([found[x] == found[y] for x, y in zip(a.tolist(), b.tolist())]) >= embedding_dedup.RECALL
    assert {found[k] for k in range(1000)} == {0}


def test_embedding_audit_without_evidence_does_not_pass(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "AUDIT_MOST", embedding_dedup.AUDIT)
    _, nodes = embedding_dedup.nodes_of(pairs_and_cluster(spark, 3000, 0, 5)[2], "vec_id", "embedding")
    rows, enough = embedding_dedup.evidence(nodes, nodes.count())
    nothing = spark.createDataFrame([], "node long, n_links long")
    assert not enough and embedding_dedup.audit(rows, enough, nothing) == 0


@pytest.mark.parametrize("whole", [0, 1 << 16])
def test_embedding_dedup_ends_exactly_where_passes_do_not_reach(spark, monkeypatch, whole):
    for name, value in (("BLOCK", 4), ("PASSES", 2), ("WAVE", 500), ("WHOLE", whole)):
        monkeypatch.setattr(embedding_dedup, name, value, raising=name in ("BLOCK", "PASSES"))
    a, b, table = pairs_and_cluster(spark)
    copy = table.where("vec_id = 1000").selectExpr("9000L as vec_id", "embedding")
    short = spark.createDataFrame([(9001, [1.0, 2.0]), (9002, [2.0, 4.1])], table.schema)
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(table.union(copy).union(short), rounds=0).collect()}
    assert all((found[x].component_id, found[y].component_id, found[x].n_links) == (x, x, 1 + (x == 1000)) for x, y in zip(a.tolist(), b.tolist()))
    assert (found[1600].n_links, found[9000].n_links, found[9000].component_id, found[9002].component_id) == (2, 2, 1000, 9001)
    assert {(found[k].component_id, found[k].n_links) for k in range(1000)} == {(0, 999)}


def test_embedding_dedup_orders_grow_with_the_table():
    assert [embedding_dedup._orders(n) for n in (0, 1, 4096, 4097, 60_000, 1 << 20)] == [3, 3, 3, 4, 7, 11]


def test_suffix_anchor_among_many_texts(monkeypatch):
    """One anchor's strings in pieces of bounded size give what one array gives."""
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, (400, 76)).astype(np.uint8)
    text[:, 26:50] = 65
    text[:, :20], text[:, 56:] = text[rng.integers(0, 3, 400), :20], text[rng.integers(0, 3, 400), 56:]
    rows = np.concatenate([text, rng.integers(20, 27, (400, 2)).astype(np.uint8)], axis=1)
    least = rng.integers(0, 50, 400)
    want, first = [], {}
    strings = [[(o, bytes(r[26 - o : 76 - o])) if o <= r[76] and 26 - o <= r[77] else None for o in range(27)] for r in rows]
    for own, k in zip(strings, least.tolist()):
        for s in own:
            first[s] = min(first.get(s, k), k)
    for own, k in zip(strings, least.tolist()):
        want.append(sum(1 << o for o, s in enumerate(own) if s is not None and first[s] < k))
    sizes, whole = [], suffix_dedup.equal_prefixes
    monkeypatch.setattr(suffix_dedup, "equal_prefixes", lambda text, *a: (sizes.append(len(text)), whole(text, *a))[1])
    for most in (500, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", most)
        sizes.clear()
        assert suffix_dedup._by_string(rows, least, 50, 26).tolist() == want and any(want)
        assert max(sizes) < 20_000


def test_suffix_owners_follow_the_bytes_and_not_the_splits(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "OWNER_BYTES", 2000, raising=False)
    rnd = random.Random(12)
    shared = ["".join(rnd.choice("abcdef ") for _ in range(90)) for _ in range(30)]
    rows = [(i, "".join(rnd.choice([rnd.choice(shared), str(rnd.random())]) for _ in range(20))) for i in range(100)]
    kept, stored = {}, suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, label, *a: kept.setdefault(label, stored(df, label, *a)))
    found = suffix_dedup.remove_repeats(frame(spark, rows).coalesce(1)).collect()
    assert key(tuple(r) for r in found) == key(brute_repeats(rows))
    told = kept["surroundings"].where("owner >= 0").groupBy("owner").agg(F.sum(F.length("rows")).alias("n")).collect()
    assert len(told) > 30 and max(r.n for r in told) < sum(r.n for r in told) / 10


@pytest.mark.parametrize("hotter", [1, 3, 1000])
def test_suffix_hot_anchors_go_in_halves(spark, monkeypatch, hotter):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1500)
    monkeypatch.setattr(suffix_dedup, "HOTTER", hotter, raising=False)
    rnd = random.Random(15)
    base = ["".join(rnd.choice("ab cé") for _ in range(200)) for _ in range(5)]
    rows = ODD + [(i, base[i % 5][rnd.randint(0, 40) : rnd.randint(70, 200)] + str(i) + rnd.choice(base)[rnd.randint(0, 60) : 130]) for i in range(11, 90)]
    kept, stored = {}, suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, label, *a: kept.setdefault(label, stored(df, label, *a)))
    sent = []
    for hot in (1, 512):
        kept.clear()
        found = suffix_dedup.remove_repeats(frame(spark, rows).repartition(4), hot=hot).collect()
        assert key(tuple(r) for r in found) == key(brute_repeats(rows))
        sent.append(kept["surroundings"].where("owner >= 0").agg(F.sum(F.length("rows"))).first()[0])
    assert sent[0] <= 2 * sent[1] if hotter == 1000 else sent[0] > sent[1]  # before, string by string: over 2 x


def test_suffix_strings_of_hot_anchors_take_memory_once(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(suffix_dedup, "_SLICE", 1 << 12)
    line = bytes(random.Random(13).choices(range(97, 123), k=300))
    buf = np.frombuffer(line * 400 + bytes(58), np.uint8)
    where = np.repeat(np.arange(30, len(line) * 400 - 80, 30), 27)
    before = np.tile(np.arange(27), len(where) // 27)
    tracemalloc.start()
    rows, h, place, same = suffix_dedup._distinct_rows(buf, where, before, 26 - before, 26, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == len(np.unique(h)) == 10 * 27 and peak < 60 * len(where)  # 76 bytes of text for each of them before
    for k in random.Random(14).sample(range(len(where)), 300):
        b, a = int(before[k]), int(where[k])
        row = bytes(26 - b) + buf[a - b : a + 50 - b].tobytes() + bytes(b) + bytes([b, 26 - b])
        assert rows[same[k]].tobytes() == row and (where[place[same[k]]] - a) % 300 == 0 and before[place[same[k]]] == b


def test_suffix_anchor_of_the_least_hash(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_mix", np.zeros_like)
    batch = suffix_dedup.Batch({"ids": np.array([1], "<i8").tobytes(), "sizes": np.array([50], "<i8").tobytes(), "text": bytes(range(50))}, 50, 24)
    assert len(batch.anchors()[0])


def test_ibans_of_the_whole_registry():
    for code in ("RO49AAAA1B31007593840000", "TR330006100519786457841326", "BG80BNBG96611020345678", "HR1210010051863000160", "SK3112000000198742637541", "SI56263300012039086", "EE382200221020145685", "LV80BANK0000435195001", "LT121000011101001000", "SA0380000000608010167519"):
        wrong = code[:-1] + str((int(code[-1]) + 1) % 10)
        assert (pii.mod97(code), pii.mod97(wrong), pii.mod97(code[:-1])) == (True, False, False)
        # A base span that happens to lie inside stays and comes first.
        assert pii.base_spans(code) or pii.mask(f"account {code} x") == "account [IBAN] x"
    assert pii.mask("account TR330006100519786457841326, HR1210010051863000160") == "account [IBAN], [IBAN]"


def test_bpe_and_packing(spark):
    from tokenizers import Tokenizer

    tool, rnd = Tokenizer.from_file(tokenizer_path()), random.Random(7)
    rows = ODD + [(20 + k, "".join(rnd.choice("abehilnorst ABC'éßü.,!?0１ñ日Σς\n\x1c ") for _ in range(rnd.randint(0, 60)))) for k in range(200)]
    rows += [(300, "a" * 9000), (301, "<|endoftext|>x<|startoftext|><|ENDOFTEXT|>"), (302, "don't we'LL 'S ''''"), (303, "ΑΣ İ ½ Ⅷ _a_ é")]
    ids = [tool.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    found = bpe.encode_decode(frame(spark, rows), tokenizer_path()).collect()
    assert key((r.doc_id, bytes(r.ids), r.decoded) for r in found) == key((i, np.array(x, "<u4").tobytes(), tool.decode(x, skip_special_tokens=False)) for (i, _), x in zip(rows, ids))
    pieces = packing.pack(frame(spark, rows).repartition(3), tokenizer_path(), window=64).collect()
    places = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    total = sum(len(x) + 1 for x in ids)
    at = 0
    for sequence, offset, length in places:  # gapless and within the window
        assert (sequence * 64 + offset, offset + length <= 64, length > 0) == (at, True, True)
        at += length
    assert at == total
    for (i, _), x in zip(rows, ids):
        if i is not None and sum(j == i for j, _ in rows) == 1:
            mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
            whole, start = np.array([*x, 2], "<u4"), 0
            for p in mine:
                assert (p.start, p.doc_tokens, p.ids_crc32) == (start, len(whole), zlib.crc32(whole[start : start + p.length].tobytes()))
                start += p.length
            assert start == len(whole)
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0 == bpe.encode_decode(frame(spark, []), tokenizer_path()).count()


def test_automaton_equals_merging_in_order():
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("ab", "a</w>"), ("b", "b</w>")]
    vocab = {t: k for k, t in enumerate(["a", "b", "a</w>", "b</w>", *dict.fromkeys(a + b for a, b in merges)])}
    tool = bpe.Automaton(vocab, merges)
    for n in range(1, 10):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            parts = [*word[:-1], word[-1] + "</w>"]
            for a, b in merges:
                k = 0
                while k < len(parts) - 1:
                    if parts[k] == a and parts[k + 1] == b:
                        parts[k : k + 2] = [a + b]
                    k += 1
            assert [tool.label[t] for t in tool.encode(word)] == parts


def test_pii(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab1234567890..@@+-() 0_%é") for _ in range(rnd.randint(1, 80))) for _ in range(3000)]
    texts += [None, "", "card 4111 1111 1111 1111", "iban DE89 3704 0044 0532 0130 00 x", "9" * 20_000, "a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1", "mail é.x@y.zz tel +1 (974) 555-3436"]

    def base(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return out

    # Long texts too: plain patterns are slow on 20,000 digits, not wrong.
    texts += ["x " * 50_000 + "a@b.cc 10.0.0.1 " + "y " * 50_000 + "4111-1111-1111-1111", "1.1.1.1 " * 5000]
    assert all([tuple(s[:3]) for s in pii.base_spans(t or "")] == base(t or "") for t in texts)
    found = pii.spans(frame(spark, list(enumerate(texts)))).collect()
    for r in found:
        assert r.base == ",".join("%s:%d:%d" % s for s in base(texts[r.doc_id] or ""))
        assert len(r.scores) == len(list(filter(None, r.spans.split(",")))) and all(0 <= x <= 1 for x in r.scores)
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    scored = lambda t: pii.find(t)[1][0].score
    assert scored("order 4111 1111 1111 1111") < scored("4111 1111 1111 1111") < scored("card 4111 1111 1111 1111")
    assert pii.mask("iban DE89 3704 0044 0532 0130 00 x") == "iban [IBAN] x" and pii.mask("a@b.cc, +1 (974) 555-3436") == "[EMAIL], [PHONE]"
    assert {r.text for r in pii.masked(frame(spark)).collect()} == {t for _, t in ODD}


def synthetic(n=400):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    texts, toxic, good = [], [], []
    for k in range(n):
        bad, junk = k % 4 == 0, k % 3 == 0
        text = [". ".join(" ".join(rnd.choice(words) for _ in range(8)) for _ in range(rnd.randint(1, 6)))]
        text = [t.replace(" ", "### ") if junk else t for t in text] + [". awful scoundrel here." if bad else "."]
        texts.append("".join(text)), toxic.append(float(bad)), good.append(float(not junk))
    return texts, np.array(toxic), np.array(good)


def test_classifiers(spark):
    texts, toxic, good = synthetic()
    t = toxicity.train(texts[:300], toxic[:300])
    of = t.scorer()
    assert np.mean([(of(x)[0] >= 0.3) == y for x, y in zip(texts[300:], toxic[300:])]) > 0.9
    score, sentences = of("abc def. you awful scoundrel. abc")
    assert score >= 0.3 and sentences.argmax() == 1 and of("")[0] == 0.0
    q = quality.train(texts[:300], good[:300], epochs=6)
    of = q.scorer()
    assert np.mean([(of(x) >= 0.5) == y for x, y in zip(texts[300:], good[300:])]) > 0.9
    for rows in (toxicity.score(frame(spark), t).collect(), quality.score(frame(spark), q).collect()):
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(frame(spark), labels).constant is not None and toxicity.fit(frame(spark), labels.limit(0)).constant == 0.0
    assert toxicity.score(frame(spark, []), t).count() == 0 == quality.score(frame(spark, []), q).count()
    assert toxicity.reject_toxic(frame(spark), t).count() == len(ODD)


def test_toxicity_score_is_a_noisy_or_of_logistic_sentences():
    texts, toxic, _ = synthetic(300)
    model = toxicity.train(texts, toxic)
    of = model.scorer()
    for text in [*texts[:40], "awful awful scoundrel. x\ny! z?", "", "...", "é " * 20_000]:
        clean, whole = [], 1.0
        for sentence in re.split(r"(?<=[.!?])(?= )|\n", text.lower()):
            words = {w.strip(toxicity._TRIM) for w in sentence.split(" ")} - {""}
            if words:
                z = model.bias + sum(float(model.weights[k]) for w in words for k in toxicity.features(w))
                clean.append(1 / (1 + math.exp(-z)))
                whole *= 1 - clean[-1]
        got, sentences = of(text)
        assert got == pytest.approx(1 - whole if clean else 0, abs=1e-9) and sentences.tolist() == pytest.approx(clean, abs=1e-9)


def test_quality_score_is_a_softmax_of_mean_word_vectors():
    texts, _, good = synthetic(200)
    model = quality.train(texts, good)
    of = model.scorer()
    for text in [*texts[:20], "", "a a a b"]:
        words = quality.words(text)
        mean = sum(float(np.mean([model.weights[k] for k in subwords.features(w)])) for w in words) / max(len(words), 1)
        assert of(text) == pytest.approx(1 / (1 + math.exp(-mean - model.bias)), abs=1e-6)


def test_held_out_rows_never_reach_a_fit(spark):
    texts, toxic, good = synthetic(200)
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    labels = [(k, int(toxic[k]), int(good[k])) for k in range(200)]
    seen = []
    for flip in (False, True):
        docs = spark.createDataFrame([(k, "other words" if flip and held(k) else t) for k, t in enumerate(texts)], "doc_id long, text string")
        table = spark.createDataFrame([(k, 1 - a if flip and held(k) else a, 1 - b if flip and held(k) else b) for k, a, b in labels], "doc_id long, toxic int, quality int")
        seen.append([subwords.training_sample(docs, table, name, rows=30) for name in ("toxic", "quality")])
    for one, other in zip(*seen):
        assert one[0] == other[0] and one[1].tolist() == other[1].tolist() and len(one[0]) == 60
        assert not {t for k, t in enumerate(texts) if held(k)} & set(one[0])
    # Text ids, and texts over the bound are replaced by others.
    docs = spark.createDataFrame([(f"d{k}", t * (50 if k % 2 else 1)) for k, t in enumerate(texts)], "doc_id string, text string")
    table = spark.createDataFrame([(f"d{k}", a) for k, a, _ in labels], "doc_id string, toxic int")
    found, y = subwords.training_sample(docs, table, "toxic", rows=10, chars=600)
    assert y.tolist().count(1) == y.tolist().count(0) == 10 and max(map(len, found)) <= 600
