"""Operators against plain Python and inline fixtures of invented text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import facts, markup
from lodestone.functions import text as tx
from lodestone.operators import chunking, corpus, diff, retrieval, verify
from lodestone.plans import ask, refresh
from lodestone.sources import bundle, rest


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def brute_chunks(text, limit=220, overlap=30):
    n = lambda s: len(s.split())
    out = []
    for part in re.split(r"\n(?=## )", text):
        part = part.strip()
        m = re.match(r"## (.+)", part)
        blocks = []
        for b in part.split("\n\n"):
            if n(b) <= limit or b.lstrip().startswith("|"):
                blocks.append(b)
                continue
            cur, size = [], 0
            for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", b):
                if cur and size + n(s) > limit:
                    blocks.append(" ".join(cur))
                    cur, size = [], 0
                cur.append(s)
                size += n(s)
            blocks.append(" ".join(cur))
        if n(part) <= limit:
            made = [part]
        else:
            made, cur, size = [], [], 0
            for b in blocks:
                if cur and size + n(b) > limit:
                    made.append("\n\n".join(cur))
                    w = cur[-1].split()
                    cur = [" ".join(w[-overlap:]) if len(w) > overlap else cur[-1]]
                    size = n(cur[0])
                cur.append(b)
                size += n(b)
            made.append("\n\n".join(cur))
        out += [(m[1] if m else None, t) for t in made if t.strip()]
    return out


def test_chunking(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(3))
    para = lambda k: ". ".join(" ".join(word() for _ in range(rnd.randint(3, 40))).capitalize() for _ in range(k)) + "."
    docs = ["", "  ", "# T\n\nintro\n## A\nx\n### B\ny\n\n\n## C", "| a | b |\n" * 150]
    docs += ["\n\n".join(rnd.choice([f"## H{k}\n" + para(3), para(rnd.randint(1, 25)), "| t | u |\n" * 90]) for k in range(rnd.randint(1, 8))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc int, text string")
    found = {}
    for r in chunking.chunk_docs(df).orderBy("doc", "chunk_index").collect():
        found.setdefault(r.doc, []).append((r.section_heading, r.text))
        assert r.word_count == len(r.text.split())
    assert found == {k: c for k, t in enumerate(docs) if (c := brute_chunks(t))}


@pytest.mark.parametrize(
    ("value", "key"),
    [("2026-08-07", "2026-08-07"), ("7/8/26", "2026-08-07"), ("7 August 2026", "2026-08-07"), ("Aug 07, 2026", "2026-08-07"), ("august 2026", "2026-08"), ("soon", None)],
)
def test_date_key(spark, value, key):
    assert one(spark, value, facts.date_key) == key


def test_facts(spark):
    assert [tuple(f) for f in one(spark, "Pay RM 1,000 or MYR 50.00 by 7 August 2026, call +60 3-2118 6200, mail a.b@c.org. Ref 12", facts.extract)] == [("email", "a.b@c.org"), ("amount", "RM 1,000"), ("amount", "MYR 50.00"), ("date", "7 August 2026"), ("phone", "+60 3-2118 6200")]
    assert one(spark, "၀၃-၂၁၁၈ ၆၂၀၀", tx.digits) == "0321186200"
    df = spark.createDataFrame([("Fee RM50, call 03-2118 6200 or 012-345 6789 on 28/8/26; again RM 50.00", "fee rm500 +60321186200 in 28 August 2026")], "a string, h string")
    assert [tuple(f) for f in df.select(facts.unverified(F.col("a"), F.col("h")).alias("u")).first().u] == [("phone", "012-345 6789")]
    assert one(spark, [("phone", "1")], facts.describe, "array<struct<kind:string,value:string>>").endswith("phone number 1.")


def test_scripts_and_small_text(spark):
    for text, want in (("hello", "latin"), ("မြန်မာ", "myanmar"), ("日本", "cjk"), ("привет", "other"), ("123", "unknown")):
        assert one(spark, text, tx.script) == want
    assert one(spark, "\n\t x  ", tx.strip) == "x"
    assert one(spark, "abcdefghijklmnop", tx.secret_hint) == "abcd...mnop"


def test_markup(spark):
    html = '<h2>Head</h2><script>x()</script><p>One <b>two</b> <a href="/p">three</a></p><ul><li>a</li><li>b</li></ul>'
    assert markup.html_to_markdown(html, "T &amp; U") == "# T & U\n\n## Head\n\nOne **two** [three](/p)\n\n- a\n- b\n"
    links = '<a href="https://drive.google.com/x"><a href="/a.pdf?x=1"><a href="#t"><a href="mailto:q"><a href="https://youtu.be/1"><a href="https://help.example.org/b"><a href="https://else.where/">'
    df = spark.createDataFrame([(links,)], "h string").select(F.explode(markup.hrefs(F.col("h"))).alias("u")).select("u", markup.link_bucket(F.col("u"), "example.org").alias("b"))
    assert [r.b for r in df.collect()] == ["drive", "file", "video", "internal", "external"]
    assert one(spark, "https://github.com/a/b/blob/main/c.zip", markup.share_link) == "https://raw.githubusercontent.com/a/b/main/c.zip"
    assert one(spark, "### **T**\n* a `b`\n|---|\n[l](https://x.y)\n\n\n\nz", markup.plain) == "T\n- a b\nl (https://x.y)\n\nz"


RESULT = "struct<title:string,section:string,url:string,source:string,status:string,text:string,doc_path:string,score:double,citation:string,source_document:string,review_by:string>"


def answer(spark, text, results, question="q?", top=0.9, today="2026-08-10"):
    full = [(r.get("title", "T"), None, r.get("url", "https://s.org/a"), r.get("source", "live"), r.get("status", "current"), r.get("text", "body"), "p", 1.0, None, None, r.get("review_by")) for r in results]
    df = spark.createDataFrame([(1, text, question, top, False, full)], f"answer_id int, answer string, question string, top_raw double, lang_drift boolean, results array<{RESULT}>")
    r = verify.verify(df, today).first()
    return r.answer, [w.code for w in r.warnings], [s.tag for s in r.sources], r


def test_verify(spark):
    text, codes, tags, _ = answer(spark, "### [S1]\nYes [SD2, ] [S1, S9] [REMEMBER] see https://no.where/x. [ok](https://s.org/a)", [{}, {}])
    assert "S9" not in text and "REMEMBER" not in text and "no.where" not in text and "https://s.org/a" in text
    assert codes == ["invented", "links"] and tags == ["S1"]
    assert answer(spark, "[source 2] fine", [{}, {"source": "retired"}])[1] == ["retired"]
    assert answer(spark, "nothing", [{}], top=0.3)[1] == ["uncited", "weak"]
    assert answer(spark, "ok [S1]", [{"text": "Service is suspended", "review_by": "2026-08-01"}])[1] == ["expired", "outage"]
    assert answer(spark, "ok [S1]", [{"review_by": "bad"}, {}])[1] == []
    assert answer(spark, "ok [S1]", [{"review_by": "2026-08-20"}])[1] == ["expiring"]
    assert answer(spark, "Please register [S1]", [{}])[0].endswith("**Where to go:**\n- [T](https://s.org/a) [S1]")
    long = "word " * 30 + "end"
    assert "copied" in answer(spark, "ok [S1]\n" + long, [{"text": long}])[1]
    assert [tuple(u) for u in answer(spark, "Call 03-2118 6200 [S1]", [{}])[3].unverified] == [("phone", "03-2118 6200")]


def test_ranks_have_no_ties(spark):
    rnd = random.Random(2)
    rows = [(q, k, float(rnd.choice([0, 0, 0, 1, 2, rnd.random()]))) for q in range(3) for k in range(500)]
    got = retrieval.ranked(spark.createDataFrame(rows, "q int, id int, s double"), {"s": "r"}).collect()
    for q in range(3):
        want = {i: n for n, (_, i) in enumerate(sorted((-s, i) for p, i, s in rows if p == q), 1)}
        assert {r.id: r.r for r in got if r.q == q} == want


def test_diffs_and_refresh(spark):
    snap = lambda rows: spark.createDataFrame(rows, "id int, title string, modified string")
    changes, ids = refresh.check(snap([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")]), snap([(1, "a", "x"), (2, "b", "y"), (4, "d", "x")]))
    assert {(r.id, r.change) for r in changes.collect()} == {(2, "changed"), (3, "removed"), (4, "added")} and [r.id for r in ids.collect()] == [2, 4]
    assert refresh.check(None, snap([(1, "a", "x")]))[0].count() == 0
    docs = lambda rows: spark.createDataFrame(rows, "doc_path string, text string")
    got = diff.critical_diff(docs([("a", "RM 10 03-2118 6200"), ("b", "x@y.org")]), docs([("a", "RM 20 03-2118 6200")])).collect()
    assert {(r.doc_path, r.kind, r.change, tuple(r.lost), tuple(r.gained)) for r in got} == {("a", "money", "edited", ("RM 10",), ("RM 20",)), ("b", "email", "lost", ("x@y.org",), ())}


def test_corpus_rules(spark):
    chunks = spark.createDataFrame([("live", "current", "Old FEE here", "n"), ("partner", "current", "old fee", "n"), ("retired", "kept", "new", "n")], "source string, status string, text string, currency_note string")
    rules = spark.createDataFrame([(1, "here", "late"), (0, "old fee", "first")], "ord int, match string, reason string")
    assert [(r.status, r.currency_note) for r in corpus.supersede(chunks, rules).collect()] == [("superseded", "first"), ("current", "n"), ("kept", "n")]


def test_ask_helpers(spark):
    history = [("user", " a "), ("tool", "x"), ("bot", ""), ("bot", "b" * 2000)]
    kind = "array<struct<role:string,text:string>>"
    assert [(h.role, len(h.text)) for h in one(spark, history, ask.clean_history, kind)] == [("user", 1), ("bot", 1000)]
    assert one(spark, 'Question: "How much?"\nmore', ask.condensed) == "How much?" and one(spark, "x" * 400, ask.condensed) is None


def test_sources_without_network():
    assert rest.retry_delay(1, None) == 8.0 and rest.retry_delay(0, "999") == 120.0 and rest.crawl_delay(None) == 2.0
    pages = {1: [{}] * 100, 2: [{}] * 3}
    assert len(list(rest.paginate(pages.__getitem__))) == 103
    waits, replies = [], [(503, {"Retry-After": "7"}, b""), (200, {"ETag": "e"}, b"ok"), (304, {}, b"")]
    polite = rest.Polite(lambda u, h: replies.pop(0), lambda u: True, sleep=waits.append, now=lambda: 0.0)
    assert polite.get("https://a.b/") == b"ok" and waits[0] == 7.0 and polite.get("https://a.b/") is None
    with pytest.raises(rest.Refused):
        rest.Polite(None, lambda u: False).get("https://a.b/")
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(bundle.Unsafe):
            bundle.check_members([bad])
    with pytest.raises(bundle.Unsafe):
        bundle.sniff(b"<html>")


def test_entry(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and e.entry(spark).count() > 0


def test_dense_scores_questions_in_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "id long, vector array<double>")
    asked = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(7)], "q long, vector array<double>")
    whole = sorted(map(tuple, retrieval.dense(chunks, asked).collect()))
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 3)
    assert len(whole) == 21 and sorted(map(tuple, retrieval.dense(chunks, asked).collect())) == whole
    assert retrieval.dense(chunks, asked.limit(0)).count() == 0


def test_ranking_by_arrays_is_the_ranking_by_rows(spark, monkeypatch):
    rnd = random.Random(5)
    say = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(n))
    texts = [say(6) for _ in range(30)]
    vectors = [[float(rnd.randint(-2, 2)) for _ in range(3)] for _ in range(20)] + [None, [1.0], [0.0, 0.0, 0.0]]
    rows = [(f"c{k}", rnd.choice([*texts, None, "..."]), rnd.choice(vectors), rnd.choice([0.6, 0.9, 1.0]), rnd.choice(["live", "retired", "partner"])) for k in range(150)]
    chunks = spark.createDataFrame(rows, "id string, text string, vector array<double>, weight double, source string").repartition(3)
    asked = spark.createDataFrame([(k, say(k), [float(k), 1.0, -1.0]) for k in range(5)], "q long, text string, vector array<double>")
    kept, stored = [], retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df, *a: (kept.append(out := stored(df, *a)), out)[1])

    def answers():
        whole = sorted(retrieval.hybrid(chunks, asked).select("q", "id", "raw", "bm25", "rank_dense", "rank_bm25", F.round("fused", 12), "score", "rank").collect())
        return [whole, *(sorted(retrieval.hybrid_top(chunks, asked, 4, c).select("q", "id", "position", "rank", "source", "score", "raw").collect()) for c in (None, "new", "old"))]

    lean, most = answers(), max(t.count() for t in kept)
    assert len(lean[0]) == 750 and most < 150
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 2)
    assert answers() == lean
    monkeypatch.setattr(retrieval, "WHOLE", 10)
    assert answers() == lean and max(t.count() for t in kept) == 750


def test_texts_stay_out_of_the_joins_of_a_ranking(spark):
    rnd = random.Random(6)
    texts = spark.createDataFrame([(k, rnd.choice(["a b", "b b c", "d", None]), rnd.choice(["live", "retired"])) for k in range(90)], "id long, text string, source string").repartition(3)
    more = spark.createDataFrame([(k, [float(k % 7), 1.0], 0.5 + k % 3 / 4) for k in range(0, 180, 2)], "id long, vector array<double>, weight double")
    seen = []

    def join(d):
        seen.append(d.columns)
        return d.join(more, "id", "left").fillna(0.9, "weight")

    chunks, late = join(texts), (texts, join)
    asked = spark.createDataFrame([(1, "b c", [1.0, 0.0]), (2, "d a", [0.0, 1.0]), (3, "", [1.0, 1.0])], "q long, text string, vector array<double>")
    seen.clear()
    assert sorted(retrieval.hybrid(chunks, asked, late).collect()) == sorted(retrieval.hybrid(chunks, asked).collect())
    best = retrieval.hybrid_top(chunks, asked, 4, "new", late)
    assert sorted(best.select("q", "id", "rank").collect()) == sorted(retrieval.hybrid_top(chunks, asked, 4, "new").select("q", "id", "rank").collect())
    assert seen and not any("text" in c for c in seen)
    assert retrieval.only(best, chunks, late).count() == best.select("id").distinct().count()


def test_packed_scores_come_back_in_fewer_bytes():
    import numpy as np

    x = retrieval._half_up(np.random.default_rng(1).uniform(-1, 1, 1000))
    x[::2] = np.nan
    assert np.array_equal(retrieval._unpack(retrieval._pack(x, np.nan), 1000, np.nan), x, equal_nan=True) and len(retrieval._pack(x, np.nan)) < 3000
    odd = np.array([0.0, np.inf, 1e12, np.nan, 0.1 + 0.2])
    assert np.array_equal(retrieval._unpack(retrieval._pack(odd, 0.0), 5, 0.0), odd, equal_nan=True)


def test_scores_of_one_round_are_on_disk_at_a_time(spark, monkeypatch):
    import os
    import time

    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n))
    rows = [(k, say(9), [rnd.uniform(-1, 1) for _ in range(3)] if k % 5 else None, rnd.choice([0.6, 1.0]), rnd.choice(["live", "retired"])) for k in range(3000)]
    chunks = spark.createDataFrame(rows, "id long, text string, vector array<float>, weight double, source string").repartition(3).persist()
    asked = spark.createDataFrame([(k, say(5) if k else "", [float(k), 1.0, -1.0]) for k in range(11)], "q long, text string, vector array<double>")
    dirs = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    answer = lambda c: sorted(retrieval.hybrid_top(chunks, asked, 4, c).select("q", "id", "position", "rank", "source", "score", "raw").collect())
    whole = [answer(c) for c in (None, "new")]
    kept, stored = [], retrieval.stored

    def keep(df, label, *a):
        before, out = shuffled(), stored(df, label, *a)
        for _ in range(50):
            if not (left := shuffled() - before):
                break
            time.sleep(0.1)
        kept.append((label, len(left), out.count()))
        return out

    monkeypatch.setattr(retrieval, "stored", keep)
    monkeypatch.setattr(retrieval, "_ROUND", 4, raising=False)
    monkeypatch.setattr(retrieval, "_ROUND_PAIRS", 1, raising=False)
    assert [answer(c) for c in (None, "new")] == whole
    assert [k[0] for k in kept] == ["vocabulary", "counts", "best", "best", "best", "picked"] * 2
    assert not any(left for _, left, _ in kept) and [n for label, _, n in kept[:6] if label == "best"] == [16, 16, 12]
    assert max(n for label, _, n in kept if label == "counts") < 100


def test_refusal_gate_asks_in_rounds(spark, monkeypatch):
    import __spark_entry__ as e

    gate = lambda: sorted(e.queries()["refusal_gate"](spark, e.SMOKE_DIR).collect())
    whole, kept, stored = gate(), [], retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df, label, *a: (kept.append((label, out := stored(df, label, *a))), out)[1])
    monkeypatch.setattr(retrieval, "_ROUND", 16, raising=False)
    monkeypatch.setattr(retrieval, "_ROUND_PAIRS", 1, raising=False)
    assert gate() == whole and len(whole) == 40
    assert [t.count() for label, t in kept if label == "best"] == [14 * 8, 14 * 8, 12 * 8]


def test_pairs_of_one_round_are_on_disk_at_a_time(spark, monkeypatch):
    import __spark_entry__ as e

    from lodestone.sources import scratch

    monkeypatch.setattr(retrieval, "WHOLE", 10)
    gate = lambda: sorted(e.queries()["refusal_gate"](spark, e.SMOKE_DIR).collect())
    live = lambda: sorted(e.queries()["hybrid_topk_live"](spark, e.SMOKE_DIR).collect())
    whole, kept, stored = [gate(), live()], [], retrieval.stored
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.FileSystem.get(spark.sparkContext._jvm.java.net.URI(scratch.scratch_dir(spark)), spark.sparkContext._jsc.hadoopConfiguration())

    def there():
        return [p.getPath().getName() for top in fs.listStatus(hadoop.Path(scratch.scratch_dir(spark)).getParent()) for p in fs.listStatus(top.getPath())]

    before = len(there())

    def keep(df, label, *a):
        out = stored(df, label, *a)
        kept.append((label, there().count("pairs"), out.count()))
        return out

    pairs = there().count("pairs")
    monkeypatch.setattr(retrieval, "stored", keep)
    monkeypatch.setattr(retrieval, "_ROUND_ROWS", 16 * 200, raising=False)
    assert [gate(), live()] == whole and len(whole[0]) == 40
    assert max(n for _, n, _ in kept) == pairs + 1 and [n for label, _, n in kept if label == "pairs"] == [16 * 200, 16 * 200, 8 * 200] * 2
    # A few best ones of each round are left, and the vocabulary that was counted.
    left = there()
    assert len(left) - before == 2 * (3 + 1) and left.count("pairs") == pairs


def test_best_keywords_are_found_without_moving_postings(spark, monkeypatch):
    import __spark_entry__ as e

    rnd = random.Random(9)
    say = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n))
    texts = [(k if k != 7 else None, say(rnd.randint(0, 9)) if k % 11 else rnd.choice(["a b", "", None])) for k in range(700)]
    asked = spark.createDataFrame([*((k, say(5)) for k in range(9)), (3, "a aa"), (20, ""), (21, "zz"), (22, None), (None, "b b")], "q long, text string")
    kept, stored = [], retrieval.stored
    monkeypatch.setattr(retrieval, "stored", lambda df, label, *a: (kept.append(label), stored(df, label, *a))[1])
    answer = lambda d: sorted((tuple(r) for r in d.select("q", "id", "rank", F.round("bm25", 9)).collect()), key=str)
    for more, labels in ([], ["vocabulary"]), ([(3, "a b"), (3, "c")], ["postings"]):
        chunks = spark.createDataFrame(texts + more, "id long, text string").repartition(3).persist()
        whole = answer(retrieval.best(retrieval.bm25(chunks, asked), "bm25", 4))
        for block, pairs, most in (1024, 1 << 20, 10_000), (50, 64, 4):
            kept.clear()
            with monkeypatch.context() as m:
                for name, value in ("_BLOCK", block), ("_PAIRS", pairs), ("MAX_QUERIES", most):
                    m.setattr(retrieval, name, value)
                assert answer(retrieval.bm25_top(chunks, asked, 4)) == whole and len(whole) == 40
            assert kept == labels
    kept.clear()
    assert e.queries()["bm25_topk"](spark, e.SMOKE_DIR).count() == 320 and kept == ["vocabulary"]
