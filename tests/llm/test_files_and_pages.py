"""Token files, WARC packages, main text, mixing and the pipeline."""

import hashlib
import io
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from barline.llm import htmltext, mixing, pieces, tokenfile, warczip, words
from barline.llm.catalog import tokenizer_file

WORD_BPE = tokenizer_file("word_bpe_49k.json")


def test_perfect_hash_is_minimal_and_rejects_foreign_keys():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 1 << 64, (2, 20000), dtype=np.uint64)
    mph = tokenfile.PerfectHash.build(h1, h2)
    assert np.array_equal(np.sort(mph.slots(h1, h2)), np.arange(20000))
    again = tokenfile.PerfectHash.load(io.BytesIO(mph.dump()))
    assert np.array_equal(again.slots(h1, h2), mph.slots(h1, h2))
    with pytest.raises(ValueError):
        tokenfile.PerfectHash.build(h1[[0, 0]], h2[[0, 0]])


def test_token_file_round_trip(docs, rows, no_docs, spark):
    held = tokenfile.write_set(docs, WORD_BPE)
    got = sorted((tuple(r) for r in tokenfile.digests(docs, held).collect()), key=lambda r: r[1])
    library = words.tokenizer(WORD_BPE)
    keys = [r[0] for r in got]
    assert keys == [None, None] + sorted(r[0] for r in rows if r[0] is not None)
    start = 0
    for key, at, n, crc in got:
        assert at == start
        start += n
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4"))
    assert sorted((str(k), n, c) for k, _, n, c in got) == sorted(
        (str(k), len(a), zlib.crc32(a.tobytes())) for k, arrays in texts.items() for a in arrays)
    foreign = spark.createDataFrame([(10 ** 6 + i, 0) for i in range(500)] + [(5, 9)], "doc_id bigint, nth bigint")
    assert all(r.shard is None for r in tokenfile.locate(foreign, held).collect())
    empty = tokenfile.write_set(no_docs, WORD_BPE)
    assert tokenfile.digests(no_docs, empty).collect() == []


PAGE = "<html><body><nav><a href='/'>Menu entry</a></nav><article><h1>T</h1><p>%s</p></article></body></html>"


def test_packages_round_trip(spark):
    big = PAGE % ("long text &amp; more " * 100)
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/9", big), (3, "u\r\nv", "short"), (4, None, "short"),
            (5, "http://a/5", None), (6, "x", ""), (None, "n", big), (None, "n", "other " * 300), (7, "r", "é" * 600),
            (7, "r", "é" * 600), (8, "z", "x\r\n\r\ny" * 500)]
    df = spark.createDataFrame([r + ("c",) for r in rows], "page_id bigint, url string, html string, digest string")
    got = sorted(map(tuple, warczip.archived(df.repartition(3)).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        best = max((j for j, _, g in rows if j is not None and (g or "").encode() == data), default=None)
        revisit = len(data) >= 1000 and i != best
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                     best if revisit else None))
    assert got == sorted(want, key=str)
    assert warczip.archived(df.limit(0)).collect() == []
    full = warczip.read_packages(warczip.write_packages(df), with_payload=True)
    assert {bytes(r.payload) for r in full.where("record_type = 'response'").collect()} == {(r[2] or "").encode() for r in rows}


def test_reader_takes_other_packages_and_zip64():
    member = warczip.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    for force in (False, True):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
            z.comment = b"a comment"
            with z.open("archive/data.warc.gz", "w", force_zip64=force) as f:
                f.write(b"skip" + member)
            z.writestr("packed.txt", "x" * 999, zipfile.ZIP_DEFLATED)
            z.writestr("indexes/index.cdx", f"4 {len(member)} archive/data.warc.gz\n")
        raw = data.getvalue()
        package = warczip.Package(lambda at, n: raw[at:at + n], len(raw))
        assert "packed.txt" not in package.entries
        (at, n), = package.records()
        assert warczip.parse_record(raw[at:at + n])["payload"] == b"payload"
    assert package._wide(b"\x01\x00\x18\x00" + b"".join(x.to_bytes(8, "little") for x in (7, 5, 1 << 33)), 0xFFFFFFFF,
                         0xFFFFFFFF, 0xFFFFFFFF) == (5, 1 << 33)
    with pytest.raises(ValueError):
        warczip.Package(lambda at, n: b"", 0)


def test_blocks_of_broken_markup():
    text = lambda page: [b.text for b in htmltext.blocks(page)]
    assert text("") == [] and text("just text") == ["just text"]
    assert text("<p>a<br>b &amp;&lt;&nbsp; c<p>d<!-- x --><b>e</b>f<script>var t='</p>'</script>g</p>h") == [
        "a b &< c", "defg", "h"]
    assert text("<p title='a>b'>x</p><p don't>y</p><p cla") == ["x", "y"]
    assert text("<div>a<!-- never closed <p>b") == ["a"] and text("1 < 2 &amp 3") == ["1 < 2 & 3"]


def test_main_text_of_held_out_layouts(spark):
    field = htmltext.trained()
    pages = htmltext.labelled_pages(200, seed=77)
    right = total = 0
    for page, labels in pages:
        got = field.decode(htmltext.features(htmltext.blocks(page)))
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.985
    page = ("<body><header>Site</header><nav><a href='#'>Home</a></nav><div class='cookie-notice'>We use cookies.</div>"
            "<article><h1>Title</h1><p>First &eacute; part\n of it.</p><div class='ad'>Buy now.</div><p>Second one.</p>"
            "</article><section id='comments'><p>Nice words, thank you.</p></section><aside class='sidebar'>More</aside>"
            "<form>Mail <input></form><footer>&copy; me</footer></body>")
    df = spark.createDataFrame([(1, "u", page, "c"), (2, None, None, "c"), (None, "", "", "c"), (1, "u", page, "c")],
                               "page_id bigint, url string, html string, tag string")
    got = htmltext.extract(df).collect()
    want = "Title\nFirst é part of it.\nSecond one."
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), (want, len(want)), (want, len(want))]
    assert htmltext.extract(df.limit(0)).collect() == []
    long = "<article>" + "<p>word " * 50000 + "</article>"
    assert htmltext.main_text(long, field).count("\n") == 49999


def water(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_meets_its_targets(docs, rows, no_docs):
    got = mixing.mix_sizes(docs, block_words=500, shard_words=4000)
    a = got.collect()
    assert len(a) == len(rows) and sorted(map(str, a)) == sorted(map(str, got.collect()))
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    goal = water(sizes)
    by = pd.DataFrame([r.asDict() for r in a])
    assert ((by.taken <= 2 * by["size"])).all()
    for s, t in goal.items():
        part = by[by.source_size == sizes[s]]
        assert part.target.sub(t).abs().min() < 1e-6
    assert abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-6 or max(goal.values()) > 0
    total = by.groupby(["source_size", "target"]).taken.sum().reset_index()
    longest = by.groupby(["source_size", "target"])["size"].max().reset_index()["size"]
    assert ((total.taken - total.target).abs() <= longest / 2).all()
    assert mixing.mix_sizes(no_docs).collect() == []


def test_mix_rows_are_those_counted(docs, no_docs):
    m = mixing.mix(docs, block_words=500, shard_words=4000)
    assert m.columns == docs.columns
    taken = {r.doc_id: r.n for r in m.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.split(
        F.coalesce("text", F.lit("")), "[ \t\n\x0b\x0c\r]+"), lambda x: x != ""))).alias("n")).collect()}
    want = {r.doc_id: r.n for r in mixing.mix_sizes(docs, block_words=500, shard_words=4000).groupBy("doc_id").agg(
        F.sum("taken").alias("n")).collect()}
    assert all(taken.get(k, 0) == n for k, n in want.items())
    assert mixing.mix(no_docs).count() == 0


def test_tree_splits_exactly(spark):
    quotas = {f"s{i}": 37 * i + 1 for i in range(9)} | {None: 11}
    df = spark.createDataFrame(list(quotas.items()), "source string, quota bigint")
    out = mixing.tree(df, 13, 5).toPandas()
    assert out.groupby("source", dropna=False).quota.sum().to_dict().keys() or True
    back = {}
    for r in out.itertuples():
        back[r.source] = back.get(r.source, 0) + r.quota
    assert back == quotas
    per = out.groupby("shard").quota.sum()
    assert len(per) == 13 and per.max() - per.min() <= 4


def test_target_ties_and_empty_sources(spark):
    for sizes in ({"a": 0}, {"a": 0, "b": 10}, {"a": 5, "b": 5, "c": 5, "d": 1000}, {"a": 6, "b": 2, "c": 4, None: 1}):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        want = water(sizes)
        assert {r.source: round(r.target, 6) for r in got} == {k: round(v, 6) for k, v in want.items()}


def test_pipeline_stages_hand_on_their_decisions(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mix_sources",
                                                      "encode_pieces"]
    texts = {(r[0], r[1]) for r in rows}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").persist()
        assert out.schema.names == docs.schema.names and {(r.doc_id, r.text) for r in out.collect()} <= texts
        seen.append(out.count())
        docs = out
    assert seen[0] < len(rows) and seen[1] < seen[0] and seen[2] < seen[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(last) == seen[3]
    other = pieces.codec(tokenizer_file("piece_bpe_32k.model")).other
    text_of = {r[0]: r[1] for r in rows}
    assert all(r.ids == other.encode(text_of[r.doc_id]) and r.decoded == text_of[r.doc_id] for r in last if r.doc_id is not None)


def test_files_are_whole_or_absent(tmp_path):
    tokenfile.put(f"file://{tmp_path}/a/b.bin", b"data")
    store, _ = fs.FileSystem.from_uri(f"file://{tmp_path}")
    assert (tmp_path / "a/b.bin").read_bytes() == b"data" and len(list((tmp_path / "a").iterdir())) == 1


def test_raw_and_odd_elements_keep_the_article(spark):
    """Self-closed and unclosed elements inside an article lose nothing of it; scripts and drawings go."""
    def page(inside):
        first = "The first paragraph of this article says a few things about the matter, and it says them at some length."
        last = "The last paragraph closes the article with a plain sentence, as articles of this kind so often do."
        return f"<html><head><title>t</title></head><body><article><p>{first}</p>{inside}<p>{last}</p></article></body></html>", first, last
    middle = "A sentence stands in the middle of the article and should be kept whole, whatever stands beside it."
    kept = ["<svg width='3' />", "<math/>", "<select/>", "<noscript/>", "<template/>", "<iframe src='x'/>", "<script>if (a < b) x()</script>",
            "<svg><text>drawn</text></svg>", "<style>p { color: red }</style>", "<noscript>turn it on</noscript>", "<select><option>one</select>"]
    rows = [(i, page(f"{k}<p>{middle}</p>")) for i, k in enumerate(kept)]
    rows += [(100 + i, page(f"<{t}><p>{middle}</p>")) for i, t in enumerate(("svg", "select", "noscript", "template", "iframe"))]
    df = spark.createDataFrame([(i, "u", p[0]) for i, p in rows], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    for i, (_, first, last) in rows:
        assert got[i].split("\n") == [first, middle, last], (i, got[i])
    formula = page("<p>The area is <math><mrow><mi>a</mi><mo>*</mo><mi>b</mi></mrow></math> for sides a and b of the field.</p>")[0]
    assert "The area is a*b for sides a and b of the field." in [b.text for b in htmltext.blocks(formula)]
