import random
import re
import zlib

import numpy as np
from test_operators import brute_fingerprint, brute_lines, roots

import corpus_pipeline
from lodestone.llm import toxicity
from lodestone.llm.common import stored
from lodestone.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.agg({"length": "sum"}).first()[0] > before
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a\nb\nc", None, "s", 5), (2, "a\nb\nc", None, "s", 5), (3, "a\nb\nd", "x", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stored(stage(spark, table, SF), "x")
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()


def fixture_rows():
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7))) for _ in range(400)]
    para = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    shared, rows = [para(30) for _ in range(3)], []
    for k in range(1, 161):
        lines = [para(rnd.randint(5, 40)) for _ in range(rnd.randint(1, 5))]
        if k % 5 == 0:
            lines.insert(rnd.randrange(len(lines) + 1), rnd.choice(shared))
        if k % 4 == 0:
            lines.append("You vile scoundrel, you wretched fool.")
        if k % 7 == 0:
            lines.append(f"Write to user{k}@mail.example or 10.0.0.{k} or 4111 1111 1111 1111 or +1 (974) 555-34{k}.")
        rows.append((k, "\n".join(lines)))
    for k in range(161, 200):  # near copies: one word of a long text changed
        source = rnd.choice(rows[:60])[1].split(" ")
        source[rnd.randrange(len(source))] = "changed"
        rows.append((k, " ".join(source)))
    return [*rows, (200, None), (201, ""), (202, " \n ")]


def masked(text):
    spans = []
    for kind, pattern in (("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("IP", r"[0-9]+(?:\.[0-9]+){3}"), ("CARD", r"[0-9](?:[\x20-]?[0-9])+"), ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(x if j % 2 == 0 else sum(divmod(2 * x, 10)) for j, x in enumerate(d[::-1])) % 10 == 0
            if kind == "EMAIL" or kind == "IP" and all(int(x) < 256 for x in m[0].split(".")) or kind == "CARD" and 13 <= len(d) <= 19 and luhn or kind == "PHONE" and 9 <= len(d) <= 15:
                spans.append((*m.span(), kind))
    for a, b, kind in sorted(spans, reverse=True):
        text = text[:a] + f"[{kind}]" + text[b:]
    return text


def test_run_equals_a_brute_force_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = fixture_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("scoundrel" in (t or ""))) for i, t in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = {i: y for i, _, y in labels if not held(i)}
    sample = [(t, known[i]) for i, t in rows if i in known and t is not None]
    of = toxicity.train([t for t, _ in sample], np.array([float(y) for _, y in sample])).scorer()
    left = [(i, t) for i, t in rows if of(t or "")[0] < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(left) < 80
    cut = brute_lines(left)
    assert cut != left
    fp = [brute_fingerprint(t) for _, t in cut]
    root = roots(len(cut), [(a, b) for a in range(len(cut)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3])
    single = [r for k, r in enumerate(cut) if root[k] == k]
    assert len(single) < len(cut)
    final = [(i, masked(t or "")) for i, t in single]
    assert any("[CARD]" in t and "[PHONE]" in t and "[IP]" in t for _, t in final)
    tool = Tokenizer.from_file(tokenizer_path())
    want = {i: np.array([*tool.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in final}
    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda p: (p.sequence_id, p.offset))
    assert {p.doc_id for p in pieces} == set(want)
    at = 0
    for p in pieces:
        assert (p.sequence_id * 4096 + p.offset, p.doc_tokens) == (at, len(want[p.doc_id])) and p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start : p.start + p.length].tobytes())
        at += p.length
    assert at == sum(map(len, want.values()))


def test_stages_bound_their_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:]:
        for before, after in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(key, before)
            stage(spark, docs.limit(3), SF)
            assert spark.conf.get(key) == after
    spark.conf.unset(key)


def test_packing_takes_small_groups(monkeypatch):
    import pyarrow as pa

    from lodestone.llm import packing

    seen, texts = [], ["some words here " * 2000] * 100 + [None, "end"]
    ids = packing.Counter.ids
    monkeypatch.setattr(packing.Counter, "ids", lambda self, part: seen.append(part.nbytes) or ids(self, part))
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    run = {}
    frame = type("D", (), {"dtypes": [("doc_id", "long")], "mapInArrow": lambda self, f, _: run.update(f=f)})()
    monkeypatch.setattr(packing, "id_text", lambda *a: frame)
    packing.tokenize(frame, tokenizer_path())
    batch = pa.RecordBatch.from_arrays([pa.array(range(102)), pa.array([t or "" for t in texts])], ["doc_id", "text"])
    out = list(run["f"](iter([batch])))
    assert sum(b.num_rows for b in out) == 102 and len(out) > 1 and max(seen) < 2_000_000
    assert out[-1].column("before")[-1].as_py() == sum(sum(b.column("n").to_pylist()) for b in out) - out[-1].column("n")[-1].as_py()
