"""Packing, segmentation, sharding, archives and media."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeatlas.llm import media as M
from codeatlas.llm import nbest as N
from codeatlas.llm import packing as P
from codeatlas.llm import registry, sharding, warc
from codeatlas.llm.common import new_folder

SF = "/root/testdata/sf0.001"
TABLES = "documents pages labels benchmark".split()


@pytest.fixture(scope="module")
def hugging():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


ODD = ["", " ", "  ", "a", " a", "a  b", "a \n b", "\n\n a\t b ", "x<|endoftext|>y", "it's we'll", "a b 　c", " \x1c a", "naïve — test…", "日本語 text", "a" * 3000, "tail  "]


def test_ids_are_the_tokenizers(spark, hugging):
    coder = P.ByteBpe()
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    for t in texts + texts[:5]:
        assert np.frombuffer(coder.encode_added(t), "<u4").tolist() == hugging(t), repr(t[:50])


def test_added_tokens_are_the_tokenizers(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert P.ADDED == {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    m = "<|endoftext|>"
    texts = [*ODD, m, m + m, f" {m}\n", f"a  {m}  b", f"a {m} b", f"{m}{m[:-1]} x{m} \n{m}y"]
    for x in texts:
        assert np.frombuffer(P.encoder().encode_added(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x[:50])
    [row] = P.pack_documents(spark.createDataFrame([(1, f"x{m}y")], "doc_id long, text string")).collect()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [87, 50256, 88, 0] and row["doc_tokens"] == 4


def check_packing(rows, pairs, hugging, window=P.WINDOW):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    want = Counter((i, (tuple(hugging(t or "")) + (0,))) for i, t in pairs)
    for doc in {i for i, _ in pairs}:
        total = sum(r["length"] for r in by_doc[doc])
        assert total == sum(len(ids) * n for (i, ids), n in want.items() if i == doc)
    return 1 - sum(r["length"] for r in rows) / (window * len(by_sequence))


def test_packing(docs, pairs, empty, hugging):
    rows = P.pack_documents(docs).collect()
    assert check_packing(rows, pairs, hugging) < 0.2  # three windows at most are open at the end
    for doc, text in ((9, dict(pairs)[9]), (10, dict(pairs)[10])):
        pieces = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in pieces)
        assert np.frombuffer(ids, "<u4").tolist() == [*hugging(text), 0] and all(4 * r["length"] == len(r["ids"]) for r in pieces)
        assert {r["doc_tokens"] for r in pieces} == {len(ids) // 4}
    assert P.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_windows_fill(seed):
    rng = random.Random(seed)
    texts = [(k, "x" * rng.choice([0, 3, 40, 63, 64, 65, 700])) for k in range(300)]
    encode = lambda t: np.arange(len(t), dtype="<u4").tobytes()
    windows = list(P.pack_rows(texts, 64, encode))
    sizes = [sum(len(p[2]) // 4 for p in w) for w in windows]
    assert sum(s < 64 for s in sizes) <= 1 and max(sizes) == 64
    got = defaultdict(dict)
    for w in windows:
        for doc, start, ids, total in w:
            got[doc][start] = ids
    for k, t in texts:
        assert b"".join(got[k][s] for s in sorted(got[k])) == encode(t) + b"\0\0\0\0"


def test_open_windows_are_bounded():
    """Documents of little over half a window never fill one: the emptiest are cut up, and next to nothing is padded."""
    encode = lambda t: np.arange(len(t), dtype="<u4").tobytes()
    for sizes in ([600] * 3000, [520 + k * 37 % 180 for k in range(3000)], [0] * 3000):
        packer_held, windows, seen = [], [], 0
        original = P.SumOfSquares.place
        try:
            P.SumOfSquares.place = lambda self, piece, size: (packer_held.append(self.held), original(self, piece, size))[1]
            for w in P.pack_rows(((k, "x" * n) for k, n in enumerate(sizes)), 1024, encode, 50_000):
                windows.append(sum(len(p[2]) // 4 for p in w))
        finally:
            P.SumOfSquares.place = original
        assert max(packer_held) <= 50_000 and max(windows) <= 1024 and sum(windows) == sum(sizes) + len(sizes)
        assert sum(n < 1024 for n in windows) <= 1


def test_placement_minimises_the_sum_of_squares():
    rng = random.Random(9)
    packer = P.SumOfSquares(32)
    for _ in range(400):
        size = rng.randrange(1, 32)
        count = packer.count.copy()

        def after(level):
            c = count.copy()
            if level:
                c[level] -= 1
            if level + size < 32:
                c[level + size] += 1
            return int((c[1:32] ** 2).sum())

        options = [0] + [h for h in range(1, 33 - size) if count[h]]
        assert after(packer.level_for(size)) == min(map(after, options))
        packer.place((0, 0, b"\0" * 4 * size, size), size)


@pytest.fixture(scope="module")
def lattice():
    return N.Lattice()


def all_ways(lattice, word):
    arcs, _ = lattice.forward(word)
    ways = {0: [(0.0, ())]}
    for end in range(1, len(word) + 1):
        ways[end] = [(s + sc, ids + i) for start, i, sc in arcs[end] for s, ids in ways[start]]
    return sorted(ways[len(word)], key=lambda w: -w[0])


@pytest.mark.parametrize("word", ["▁the", "▁stone", "▁ab.\nc", "▁日本語", "▁▁▁a", "x", "▁ü日"])
def test_n_best_of_a_word(lattice, word):
    every = all_ways(lattice, word)
    for n in (1, 4, 50):
        got = lattice.n_best(word, n)
        assert len(got) == min(n, len(every)) and np.allclose([s for s, _ in got], [s for s, _ in every[: len(got)]])
        assert len({i for _, i in got}) == len(got) and all(lattice.decode(i) == word.replace("▁", " ").removeprefix(" ") for _, i in got)


@pytest.mark.parametrize("text", ["the stone", "a  b ", " to be", "tea tea tea", "x"])
def test_n_best_of_a_text(lattice, text):
    coder = N.Encoder(lattice, 4)
    per_word = [all_ways(lattice, w) for w in re.findall("▁+[^▁]*|[^▁]+", "▁" + text.replace(" ", "▁"))]
    every = sorted((sum(s for s, _ in way) for way in itertools.product(*(w[:6] for w in per_word))), reverse=True)
    got = coder.encode(text)
    assert np.allclose([s for s, _, _ in got], every[: len(got)]) and len({i for _, i, _ in got}) == len(got) == min(4, len(every))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(N.MODEL_FILE))
    for _, ids, pieces in got:
        assert len(ids) == 4 * pieces and model.decode(np.frombuffer(ids, "<u4").tolist()) == text == lattice.decode(np.frombuffer(ids, "<u4").tolist())


def test_segment(docs, pairs, empty):
    rows = N.segment(docs).collect()
    best = [r for r in rows if r["rank"] == 1]
    assert len(best) == len(pairs) and all(r["round_trip"] for r in rows) and N.segment(empty).count() == 0
    assert {r["n_pieces"] for r in best if r["doc_id"] in (1, 2, 3)} == {0}


def test_round_trip_comes_from_the_ids(lattice):
    """A fault in splicing shows in the rank that has it, and a mark in a text as a space."""

    class Faulty(N.Encoder):
        def encode(self, text):
            out = super().encode(text)
            score, ids, pieces = out[2]
            return [*out[:2], (score, ids[4:], pieces), *out[3:]]

    text = "the stone is ünder 日本"
    for coder, want in ((N.Encoder(lattice, 4), [True] * 4), (Faulty(lattice, 4), [True, True, False, True])):
        assert [r[-1] for r in N.ranked(coder, text)] == want
    whole = N.Encoder(lattice, 4)
    assert not any(r[-1] for r in N.ranked(whole, "a▁b")) and [r[-1] for t in (None, "") for r in N.ranked(whole, t)] == [True] * 2


def test_shards(docs, empty, pairs):
    rows = sharding.stratified_shards(docs, bucket_rows=5).collect()
    assert len(rows) == len(pairs) and sharding.stratified_shards(empty).count() == 0
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs)
    other = sharding.stratified_shards(docs.repartition(7), bucket_rows=1000).collect()
    place = lambda rs: sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["stratum"], r["shard"], r["slot"]) for r in rs)
    assert [x[:4] for x in place(rows)] == [x[:4] for x in place(other)] and sum(a == b for a, b in zip(place(rows), place(other))) >= len(rows) - 4


def test_every_shard_has_the_mixture(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    rows = sharding.stratified_shards(d, bucket_rows=100).groupBy("shard", "stratum").count().collect()
    by = defaultdict(list)
    for r in rows:
        by[r["stratum"]].append(r["count"])
    assert all(len(v) == 8 and max(v) - min(v) <= 2 for v in by.values())


def test_archives(spark):
    rows = [(1, "u", "<p>x</p>"), (2, "u v\r\nX-Bad: 1", "<p>x</p>"), (3, None, None), (4, "w", ""), (None, "n", "<p>x</p>"), (5, "c", "a\r\n\r\nb\r\nWARC/1.1\r\n\r\n"), (5, "c", "a\r\n\r\nb\r\nWARC/1.1\r\n\r\n"), (6, "z", "ü" * 100_000)]
    caps = warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.read_archives(spark, warc.write_deduplicated(caps, new_folder(spark, "t"), date="2020-01-01T00:00:00Z")).collect()
    assert len(got) == len(rows)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(2, "response", None), (1, "revisit", 2), (None, "revisit", 2), (4, "response", None), (3, "revisit", 4), (5, "response", None), (5, "revisit", 5), (6, "response", None)} == kinds
    assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == {h or "" for _, _, h in rows}
    assert all("\n" not in r["uri"] and " " not in r["uri"] for r in got)
    small = warc.read_archives(spark, warc.write_deduplicated(caps, new_folder(spark, "t"), min_bytes=9))
    assert small.filter("payload_bytes < 9 and record_type <> 'response'").count() == 0
    none = warc.captures(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(spark, warc.write_deduplicated(none, new_folder(spark, "t"))).count() == 0


def test_archives_of_bounded_size(spark):
    """Many files where the bytes ask for them; columns of other names, also those of captures, do not matter."""
    rows = [(k, f"u{k}", "".join(chr(97 + (k * j) % 26) for j in range(3000)), "x", k, "y", b"z") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row string, digest long, record_type string, payload binary")
    path = warc.write_deduplicated(warc.captures(pages), new_folder(spark, "t"), archive_bytes=10_000)
    assert spark.read.format("binaryFile").load(path).count() > 10
    got = {r["page_id"]: (r["record_type"], bytes(r["payload"]).decode()) for r in warc.read_archives(spark, path).collect()}
    by_text = defaultdict(list)
    for k, _, t, *_ in rows:
        by_text[t].append(k)
    assert got == {k: ("response", t) if k == max(by_text[t]) else ("revisit", "") for k, _, t, *_ in rows}


def test_captured_revisits(spark):
    caps = warc.captures(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"))
    later = caps.withColumn("row", F.lit(10).cast("long")).withColumn("page_id", F.lit(9).cast("long")).withColumn("record_type", F.lit("revisit")).withColumn("payload", F.lit(None).cast("binary"))
    lost = later.withColumn("row", F.lit(11).cast("long")).withColumn("digest", F.lit("X" * 32))
    got = warc.resolve(caps.unionByName(later).unionByName(lost).drop("payload")).collect()
    assert {(r["row"], r["resolved_type"], r["refers_page"]) for r in got if r["row"] in (10, 11)} == {(10, "revisit", 1), (11, "revisit", None)}


def test_sequences():
    page = '<head><title>no</title></head><p>One <b>two</b></p><figure><img src="sha256:a" alt="x"><figcaption>Cap <i>tion</i></figcaption></figure>tail<img src="b.png" alt="alt"><script>no</script><video src="sha256:c"></video>'
    got = [(i["position"], i["kind"], i["text"] or i["media_ref"], i["caption"]) for i in M.parse_sequence(page)]
    assert got == [(0, "text", "One two", None), (1, "media", "sha256:a", "Cap tion"), (2, "text", "tail", None), (3, "media", "b.png", "alt"), (4, "media", "sha256:c", None)]
    assert M.parse_sequence(None) == M.parse_sequence("") == [] and M.parse_sequence("<figure><img src=x><figcaption>open")[0]["caption"] == "open"


def test_resolved_sequences_stay_aligned(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:' + "0" * 64 + '" alt="k"><p>b</p><img src="gone.png">'), (2, None)], "row long, html string")
    media = spark.createDataFrame([("0" * 64, "payload")], "digest string, what string")
    rows = {r["row"]: r["items"] for r in M.interleave(M.resolve(M.sequences(pages, "row", "html"), media), "what").collect()}
    assert [(i["position"], i["kind"], i["what"], i["caption"]) for i in rows[1]] == [(0, "text", None, None), (1, "media", "payload", "k"), (2, "text", None, None), (3, "media", None, None)]
    assert rows[2] == []


def test_common_digest_in_many_sequences(spark):
    """Pages that hold one medium several times, some of it beside others; and no pages at all."""
    digest = lambda c: c * 64
    img = lambda c, alt: f'<img src="sha256:{digest(c)}" alt="{alt}">'
    pages = [(k, f"<p>{k}</p>" + img("a", "one") + img("b" if k % 2 else "a", "two") + "<p>end</p>" + img("c", "lost")) for k in range(20)]
    media = spark.createDataFrame([(digest("a"), "A"), (digest("b"), "B")], "digest string, what string")
    frame = spark.createDataFrame(pages, "row long, html string")
    rows = {r["row"]: r["items"] for r in M.interleave(M.resolve(M.sequences(frame, "row", "html"), media), "what").collect()}
    for k, _ in pages:
        assert [(i["position"], i["text"], i["caption"], i["what"]) for i in rows[k]] == [(0, str(k), None, None), (1, None, "one", "A"), (2, None, "two", "B" if k % 2 else "A"), (3, "end", None, None), (4, None, "lost", None)]
    assert M.interleave(M.resolve(M.sequences(frame.limit(0), "row", "html"), media), "what").count() == 0


def test_payloads_of_a_common_medium(spark):
    """References of many pages meet the one payload that is kept, at their places; unknown ones have none."""
    digest = lambda c: c * 64
    pages = spark.createDataFrame([(k, f'<p>{k}</p><img src="sha256:{digest("a" if k % 3 else "b")}" alt="c{k}"><img src="sha256:{digest("e")}"><img src="x.png">', f"d{k}") for k in range(30)], "row long, html string, name string")
    store = spark.createDataFrame([(r, bytes.fromhex(digest(c)), m) for r, c, m in ((1, "a", b"A"), (2, "a", None), (3, "b", b"B"), (4, "a", b"A"))], "row long, digest binary, media binary")
    rows = M.resolve_payloads(M.references(M.sequences(pages, "row", "html", "name"), "name"), store).collect()
    got = {(r["row"], r["position"]): (r["name"], r["caption"], r["media"] and bytes(r["media"])) for r in rows}
    assert len(rows) == len(got) == 60 and all(got[k, 1] == (f"d{k}", f"c{k}", b"A" if k % 3 else b"B") and got[k, 2] == (f"d{k}", None, None) for k in range(30))


def test_media_of_no_documents(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert M.op8_interleaved_media(spark, str(tmp_path)).count() == 0


def test_pixmaps():
    for n in (1, 2, 50):
        payload = bytes(range(192)) * n
        assert M.decode_pixmap(M.encode_pixmap(payload)) == (64, n, payload)
    with pytest.raises(ValueError):
        M.decode_pixmap(b"P6\n64 2\n255\nshort")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_against_sql(spark, docs, name, tmp_path):
    """On the smallest tables, and on the edge rows in place of documents."""
    for folder, documents in ((SF, f"{SF}/documents.parquet"), (None, None)):
        if folder is None:
            folder = str(tmp_path)
            docs.write.parquet(f"{folder}/documents.parquet")
            documents = f"{folder}/documents.parquet/*.parquet"
            spark.read.parquet(f"{SF}/pages.parquet").limit(5).write.parquet(f"{folder}/pages.parquet")
        pages = f"{folder}/pages.parquet" + ("/*.parquet" if folder != SF else "")
        c = duckdb.connect()
        c.sql(f"create view documents as select * from '{documents}'")
        c.sql(f"create view pages as select * from '{pages}'")
        cursor = c.execute(registry.SQL[name])
        columns = [x[0] for x in cursor.description]
        df = registry.QUERIES[name](spark, folder)
        assert sorted(df.columns) == sorted(columns)
        drop = {"shard", "slot", "kept"} if folder != SF else set()  # fully equal rows may swap places
        flat = lambda cols, rows: sorted(tuple(str(r[cols.index(k)]) for k in sorted(set(cols) - drop)) for r in rows)
        assert flat(df.columns, map(tuple, df.collect())) == flat(columns, cursor.fetchall())
