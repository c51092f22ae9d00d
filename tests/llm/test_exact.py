"""Exact dedup and line chunks against brute force."""

import hashlib
import itertools
import random
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from codeatlas.llm import exact_dedup as E
from codeatlas.llm import line_dedup as L


def groups(pairs):
    out = defaultdict(list)
    for i, t in pairs:
        out[E.normalise(t)].append(i)
    return out


def test_classes(docs, pairs):
    got = E.classes(docs).collect()
    assert len(got) == len(pairs)
    best = {k: max((x for x in v if x is not None), default=None) for k, v in groups(pairs).items()}
    for r in got:
        content = next(k for k in best if hashlib.sha256(k).hexdigest() == r["text_sha256"])
        assert r["keep_id"] == best[content] and r["group_size"] == len(groups(pairs)[content])
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(best)


def test_rows(docs, pairs):
    kept = E.dedup_rows(docs)
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert len(rows) == len(groups(pairs)) and {E.normalise(r["text"]) for r in rows} == set(groups(pairs))
    assert len({r["row"] for r in rows}) == len(rows)


def test_rows_with_clashing_columns(spark):
    rows = [(1, "A", b"1", "x"), (2, "a", b"2", "y"), (3, None, None, None), (None, "", b"4", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest binary, record string")
    kept = E.dedup_rows(docs)
    assert kept.schema == docs.schema and {tuple(r)[:2] for r in kept.collect()} == {(2, "a"), (3, None)}


def test_records_count_too():
    """Records alone make a table spill, and folded records grow in place."""
    grace = E.GraceTable(lambda a, b: a + b, 20_000)
    for k in range(200):
        grace.add(hashlib.sha256(b"%d" % k).digest(), b"%d" % k, b"r" * 300)
    assert grace.files is not None and len(list(grace.groups())) == 200
    one = E.struct.pack(E._FORM, 5, 1, 0, 0) + E.struct.pack(E._REP_FORM, 0, 0)
    folded = one
    for k in range(1, 50):
        folded = E._fold_listing(folded, E.struct.pack(E._FORM, k, 1, k, 0) + E.struct.pack(E._REP_FORM, k, 0))
    assert E.struct.unpack_from(E._FORM, folded) == (49, 50, 49, 0) and len(folded) == E._FORM_BYTES + 50 * 16


def test_no_rows(empty):
    assert E.classes(empty).count() == 0 and E.dedup_rows(empty).count() == 0 and L.remove_repeated(empty).count() == 0


def test_grace_spills_and_compares_content():
    fold = lambda a, b: a + b
    for limit in (1, 500, 1 << 20):
        grace = E.GraceTable(fold, limit)
        for k in range(400):
            content = b"content %d" % (k % 130)
            grace.add(hashlib.sha256(content).digest(), content, b"x")
        # One digest, two contents: told apart even where no level can part them.
        for content in (b"one", b"two", b"one"):
            grace.add(b"\0" * 32, content, b"y")
        got = {c: r for _, c, r in grace.groups()}
        assert len(got) == 132 and got[b"one"] == b"yy" and got[b"two"] == b"y"
        assert all(len(r) in (3, 4) for c, r in got.items() if c.startswith(b"content"))


def test_chunks_move_with_content():
    text = "\n".join(f"line {k * k % 37} of text" for k in range(60))
    parts = L.chunks(text)
    assert b"".join(c for c, _ in parts).decode() == text and sum(n for _, n in parts) == 60
    moved = {c for c, _ in L.chunks("a new first line\n" + text)}
    assert sum(c in moved for c, _ in parts) >= len(parts) - 2
    assert L.chunks(None) == [] and L.chunks("") == [] and L.chunks("x") == [(b"x", 1)]


def test_line_chunks(docs, pairs):
    rows = docs.select(F.monotonically_increasing_id().alias("at"), "doc_id", "text").collect()
    seen, want = set(), []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["at"])):
        kept = []
        for c, n in L.chunks(r["text"]):
            if n < L.MIN_LINES or c not in seen:
                kept.append(c)
            if n >= L.MIN_LINES:
                seen.add(c)
        want.append((str(r["doc_id"]), None if r["text"] is None else b"".join(kept).decode()))
    got = L.remove_repeated(docs).collect()
    key = lambda x: (x[0], x[1] is not None, x[1] or "")
    assert sorted(((str(r["doc_id"]), r["clean_text"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["removed_chunks"] for r in got) > 0


def repeated_runs(rows, words):
    """What stays of each text, by a search of all runs of lines for an earlier copy that does not overlap."""
    held = [(r["doc_id"], L.text_lines(r["text"]), r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["at"]))]
    out = []
    for d, (doc, lines, text) in enumerate(held):
        gone = set()
        for e in range(d + 1):
            for i in range(len(lines)):
                for j in range(len(held[e][1]) if e < d else i):
                    n = 0
                    while i + n < len(lines) and j + n < (len(held[e][1]) if e < d else i) and lines[i + n] == held[e][1][j + n]:
                        n += 1
                    if n > 1:
                        gone |= set(range(i, i + n))
                    elif n and len(lines[i].split()) > words:
                        gone.add(i)
        whole = [x + b"\n" for x in lines]
        if lines and not text.endswith("\n"):
            whole[-1] = lines[-1]
        out.append((str(doc), None if text is None else b"".join(x for k, x in enumerate(whole) if k not in gone).decode(), len(gone)))
    return out


def passages():
    """Runs of 2 to 8 lines and long lines inside otherwise different texts, at their ends and next to each other."""
    rng, fresh = random.Random(8), itertools.count()
    line = lambda n=4: " ".join(f"w{next(fresh)}" for _ in range(n))
    runs = [[line() for _ in range(n)] for n in range(2, 9)] + [[line(60)], ["common", line(51)], ["", ""], ["x"] * 5, ["\r", "a\rb"]]
    texts = [None, "", "\n", "x\nx\nx\nx\nx", "only short", "only short", "short\n", "a\nb", "a\nb\n", "b\nc\na\nb"]
    for _ in range(60):
        parts = [rng.choice(runs) if rng.random() < 0.5 else [line() for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 5))]
        texts.append("\n".join(x for p in parts for x in p) + rng.choice(["", "\n"]))
    return [(None if k % 17 == 0 else 100 - k // 2, t) for k, t in enumerate(texts)]


def test_repeated_passages(spark, docs, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame(passages(), "doc_id long, text string").repartition(4).write.parquet(path)
    key = lambda x: (x[0], x[1] is not None, x[1] or "")
    for source in (docs, spark.read.parquet(path)):
        rows = source.select(F.monotonically_increasing_id().alias("at"), "doc_id", "text").collect()
        got = [(str(r["doc_id"]), r["clean_text"], r["removed_lines"]) for r in L.remove_passages(source).collect()]
        assert sorted(got, key=key) == sorted(repeated_runs(rows, L.LINE_WORDS), key=key)


def test_query_finds_a_short_passage(spark, tmp_path):
    """Three lines in the midst of two different texts, which share no chunk."""
    middle = "one of three\ntwo of three\nthree of three\n"
    texts = [(1, "\n".join(f"first {k}" for k in range(7)) + "\n" + middle + "end 1"), (2, "\n".join(f"second {k}" for k in range(9)) + "\n" + middle + "end 2")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["removed_lines"], r["removed_chunks"], r["clean_sha256"]) for r in L.op10_line_chunk_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (3 * (i - 1), i - 1, hashlib.sha256((t if i == 1 else t.replace(middle, "")).encode()).hexdigest()) for i, t in texts}


def test_lines_of_one_digest():
    """Lines that share a digest are told apart by their bytes, and take part in no unit."""
    same = L._digest(b"a")
    lines = pa.RecordBatch.from_pydict({"digest": [same, same, same, L._digest(b"c")], "content": [b"a", b"b", b"a", b"c"]})
    for limit in (1, 1 << 20):
        assert [b.column(0).to_pylist() for b in L._clashes([lines], limit)] == [[same]]
    texts = pa.RecordBatch.from_pydict({"row": [0], "doc_id": [None], "text": ["c\na\nc\nd\n"]}, schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())]))
    assert [[b.column(2).to_pylist(), b.column(3).to_pylist()] for b in L._units([texts], frozenset([same]), 50)] == [[[2], [2]]]
