"""The training-data operators against brute force, libraries and SQL, with hostile rows."""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomtrail.llm import bpe, chain_dedup, near_vectors, ngram_join, packing, pairwise_quality, quality_rules, suffix_dedup, token_files, warc
from loomtrail.llm.common import Stages
from loomtrail.llm.components import components
from loomtrail.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, count long, component string"
random.seed(11)
WORDS = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 7))) for _ in range(400)]


def prose(n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> dict[int, str | None]:
    rng = random.Random(5)
    out: dict[int, str | None] = {i: prose(rng.randint(1, 120), rng) for i in range(60)}
    long = prose(150, rng)
    for i in range(60, 90):
        words = long.split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out[i] = " ".join(words)
    passage = prose(70, rng)
    for i in range(90, 100):
        out[i] = f"{prose(60, rng)} {passage} {prose(60, rng)}"
    out.update({100: None, 101: "", 102: "  \n\t ", 103: "one two", 104: "One two", 105: out[3], 106: out[3], 107: "ab " * 100, 108: "x" * 5000, 109: prose(20_000, rng), 110: "Σas İs it's 'LL don't \r\n 日本 🙂", 111: "hello <|endoftext|> world", 112: "<|startoftext|>a<|endoftext|><|endoftext|>"})
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, v, "en", None, len(v or ""), 1, 2, "c") for k, v in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without an id, and rows that share one."""
    return spark.createDataFrame([(None, "a b c d e f", "en", None, 1, 1, 1, "c"), (1, None, "en", None, 1, 1, 1, "c"), (1, "a b c d e f", "en", None, 1, 1, 1, "c"), (2, "a b c d e f", None, None, 1, 1, 1, "c")], SCHEMA)


def test_token_files(spark, docs, texts, empty, odd, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    token_files.write_token_ids(docs, str(tmp_path / "t"), path)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    sums = {r.doc_id: r for r in token_files.checksums(token_files.read_tokens(spark, str(tmp_path / "t"))).collect()}
    start = 0
    for k in sorted(texts):
        ids = [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids) == (start, len(ids), ids)
        assert sums[k].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.read_tokens(spark, str(tmp_path / "t"), 10, 12).count() == 3
    for name, df, n in (("e", empty, 0), ("o", odd, 4)):
        token_files.write_token_ids(df, str(tmp_path / name), path)
        assert token_files.read_metadata(spark, str(tmp_path / name)).count() == n


def test_token_files_are_read_selectively(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    rng = random.Random(13)
    monkeypatch.setattr(token_files, "ROW_GROUP", 64 << 10)
    path, docs = str(tmp_path / "t"), spark.createDataFrame([(i, prose(120, rng)) for i in range(3000)], "doc_id long, text string").repartition(3)
    token_files.write_token_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    files = [pq.ParquetFile(f) for f in sorted(glob.glob(f"{path}/ids/*.parquet"))]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert len(groups) > len(files) and sum(g.num_rows for g in groups) == 3000
    for g in groups:
        own = {g.column(i).path_in_schema: g.column(i) for i in range(g.num_columns)}
        ids, doc = next(c for k, c in own.items() if k.startswith("ids")), own["doc_id"]
        assert any("DICTIONARY" in e for e in ids.encodings) and ids.has_offset_index and doc.has_column_index and doc.statistics.has_min_max
        assert g.total_byte_size < 4 * token_files.ROW_GROUP
    bounds = sorted((doc.statistics.min, doc.statistics.max) for g in groups for doc in [next(g.column(i) for i in range(g.num_columns) if g.column(i).path_in_schema == "doc_id")])
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))  # so a range of ids touches few groups

    def scan(df) -> str:
        plan = df._jdf.queryExecution().executedPlan().toString()
        return next(line for line in plan.split("\n") if "FileScan parquet [part" in line)

    meta, some = scan(token_files.read_metadata(spark, path)), scan(token_files.read_tokens(spark, path, 10, 12))
    assert "ids" not in meta.partition("ReadSchema")[2] and "ids:array<int>" in some
    assert "GreaterThanOrEqual(doc_id,10)" in some and "LessThanOrEqual(doc_id,12)" in some
    assert [r.doc_id for r in token_files.read_tokens(spark, path, 10, 12).orderBy("doc_id").collect()] == [10, 11, 12]


def test_byte_bpe(docs, texts, empty, odd):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {r.doc_id: r.ids for r in bpe.bpe_encode(docs, path).collect()}
    back = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect()}
    for k, text in texts.items():
        assert ids[k] == own.encode_ordinary(text or "")
        assert bytes(back[k].decoded) == (text or "").encode()
    assert bpe.bpe_encode(empty, path).count() == 0
    assert bpe.bpe_encode(odd, path).count() == 4


def test_long_pre_tokens_and_falling_ranks():
    ranks = {bytes([b]): 300 + b for b in range(97, 103)} | {b"ab": 9, b"bc": 2, b"abc": 1, b"cd": 4, b"abcd": 0, b"aa": 5, b"aaa": 3}
    queue = bpe.RankQueue(500)
    rng = random.Random(2)
    for _ in range(400):
        data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 60)))
        parts = [data[i : i + 1] for i in range(len(data))]
        while data not in ranks:
            found = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if found is None:
                break
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        assert bpe.merge(data, ranks, queue) == ([ranks[data]] if data in ranks else [ranks[p] for p in parts])
        assert not queue.top and not queue.buckets


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(60):
        parts = [[rng.randint(97, 97 + rng.choice([0, 1, 3, 20])) for _ in range(rng.randint(0, 40))] + [0] for _ in range(rng.randint(1, 9))]
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        got = suffix_dedup.suffix_arrays(np.array([c for p in parts for c in p]), first)
        for k, p in enumerate(parts):
            assert (got[first[k] : first[k + 1]] - first[k]).tolist() == sorted(range(len(p)), key=lambda i: p[i:])


def test_suffix_dedup(docs, texts, empty, odd):
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    seen: set[bytes] = set()
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        out = [False] * len(raw)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                out[i : i + 100] = [True] * 100
            seen.add(raw[i : i + 100])
        runs = sum(o and not (i and out[i - 1]) for i, o in enumerate(out))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (len(raw), sum(out), runs, bytes(c for c, o in zip(raw, out, strict=True) if not o)), k
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(odd).count() == 2


def test_suffix_dedup_of_texts_that_share_less_than_a_string(spark):
    """Stretches that meet by their anchor and the bytes beside it may have no whole string in common; then nothing goes."""
    rng = random.Random(17)
    some = lambda n: "".join(rng.choices("abcdefghij", k=n))
    shared = some(90)
    texts = [some(150) + shared + some(150) for _ in range(3)]
    assert suffix_dedup.repeats([[(k, 0, t[110:290].encode()) for k, t in enumerate(texts)]]) == []
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_removed, bytes(r.kept).decode()) for r in got} == {k: (0, t) for k, t in enumerate(texts)}


def test_suffix_dedup_of_many_small_texts(spark):
    """Mutated copies, periodic texts and pieces over small alphabets, each case in ids of its own and letters of its own."""
    rng = random.Random(1)
    rows = []
    for case in range(24):
        letters = [chr(0x100 + 40 * case + i) for i in range(rng.choice([2, 3, 8, 26]))]
        base = [rng.choice(letters) for _ in range(rng.choice([80, 200, 450]))]
        for i in range(rng.randint(2, 12)):
            kind, t = rng.random(), list(base)
            if kind < 0.6:
                for _ in range(rng.randint(0, 5)):
                    t[rng.randrange(len(t))] = rng.choice(letters)
                at = rng.randrange(len(t))
                t[at:at] = [rng.choice(letters) for _ in range(rng.randint(0, 9))]
            elif kind < 0.75:
                t = rng.choice([letters[:1], letters[:2], base[:15], base[:45]]) * rng.randint(1, 60)
            else:
                t = base[rng.randrange(len(base)) :] + base[: rng.randrange(len(base))]
            rows.append((1000 * case + 3 * i, "".join(t)))
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    seen: set[bytes] = set()
    for k, text in rows:
        raw = text.encode()
        out = [False] * len(raw)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                out[i : i + 100] = [True] * 100
            seen.add(raw[i : i + 100])
        assert got[k] == bytes(c for c, o in zip(raw, out, strict=True) if not o), k


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_ngram_join(docs, texts, empty, odd):
    sets = {k: shingle_set(v) for k, v in texts.items()}
    root = {k: k for k in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {k: (len(sets[k]), find(k)) for k in sets}
    assert ngram_join.ngram_join(empty).count() == 0
    assert {tuple(r) for r in ngram_join.ngram_join(odd).collect()} == {(1, 2, 1), (2, 2, 1)}


@pytest.mark.parametrize("front", [4, 256])
def test_ngram_join_across_components(spark, monkeypatch, front):
    """Chains of near copies and long texts, with prefixes that are sent along or too long for it."""
    monkeypatch.setattr(ngram_join, "FRONT", front)
    rng = random.Random(12)
    texts = {}
    for case in range(12):
        words = plain(300 if case else 20_000, rng).split()
        for i in range(6):
            texts[100 * case + i] = " ".join(words)
            for _ in range(len(words) // 75):
                words[rng.randrange(len(words))] = f"y{rng.randrange(9000)}"
    sets = {k: shingle_set(v) for k, v in texts.items()}
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a // 100 == b // 100 else 0
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == root


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(3), Stages(spark, "test")).collect()))
    assert all(got[i] == 0 for i in range(61))
    assert all(got[a] == got[b] for a, b in edges if a != b)


def test_quality_rules_match_their_sql(spark, docs, empty, odd):
    import duckdb

    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(ORACLE["op5_quality_rules"].replace("FROM documents", "FROM documents")).fetchall()
    got = quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.quality_rules(odd).count() == 4
    assert quality_rules.kept_rows(docs).columns == docs.columns
    assert {r.doc_id for r in quality_rules.kept_rows(docs).collect()} == {r[0] for r in want if r[7]}


def test_near_vectors_of_one_dense_group(spark):
    """Every link of a group of near copies is found, however large it is."""
    rng = np.random.default_rng(14)
    centre = rng.standard_normal(64)
    x = centre + 0.25 * rng.standard_normal((4000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = int(sum((unit[i : i + 500] @ unit.T >= 0.9).sum() for i in range(0, 4000, 500))) - 4000
    got = near_vectors.near_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), "vec_id", "embedding").agg(F.sum("n_links"), F.countDistinct("component_id")).first()
    assert true > 10_000_000 and 0.98 * true <= got[0] <= true and got[1] == 1


def test_the_fit_is_the_least_loss(spark):
    """Newton's weights against plain gradient descent on the same pairs."""
    rng = np.random.default_rng(15)
    x = rng.standard_normal((300, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.standard_normal(300) > 0).astype(float)
    model = pairwise_quality.fit(x, y, pairs=2000)
    spread, mean = x.std(axis=0), x.mean(axis=0)
    z, pick = (x - mean) / spread, np.random.default_rng(5)
    good, bad = np.flatnonzero(y > 0.5), np.flatnonzero(y < 0.5)
    d, w = z[pick.choice(good, 2000)] - z[pick.choice(bad, 2000)], np.zeros(4)
    for _ in range(4000):
        w -= 0.5 * (1e-3 * w - d.T @ (1 / (1 + np.exp(d @ w))) / 2000)
    assert np.allclose(np.array(model["w"]) * spread, w, atol=1e-3)
    assert model["at"] == pytest.approx(np.quantile(z @ w, len(bad) / 300), abs=1e-3)


def test_names_that_operators_use_themselves(spark, data, docs):
    clashing = ["words", "lines", "stop", "n_words", "x", "y", "score", "_text", "_cuts", "_t", "kept", "h", "word_chars"]
    wide = docs.select("doc_id", "text", *(F.lit(-7 - i).alias(c) for i, c in enumerate(clashing)))
    found = chain_dedup.passages(wide)
    model = pairwise_quality.fit(np.ones((2, 1)), np.ones(2)) | {"w": [0.0] * len(wide.limit(1).transform(pairwise_quality.features).first()["__q_x"])}
    for out in (quality_rules.kept_rows(wide), pairwise_quality.kept_rows(wide, model), chain_dedup.without(wide, found)):
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(tuple(r)[2:] == tuple(-7 - i for i in range(len(clashing))) for r in rows)


def test_cuts_go_to_the_rows_they_were_found_in(spark):
    rng = random.Random(8)
    a = plain(200, rng)
    lesser, greater = "A" + plain(100, rng), "é" + plain(100, rng)  # of an id's texts the greatest one is searched
    df = spark.createDataFrame([(0, a), (1, a), (1, None), (1, lesser), (2, a), (2, a), (3, a), (3, greater), (None, a)], "doc_id long, text string")
    out = [tuple(r) for r in chain_dedup.without(df, chain_dedup.passages(df)).collect()]
    assert sorted(out, key=str) == sorted([(0, a), (1, ""), (1, None), (1, lesser), (2, ""), (2, ""), (3, a), (3, greater), (None, a)], key=str)


def test_four_documents_with_quotes(spark):
    rng = random.Random(9)
    passage = plain(80, rng).split()
    texts = [" ".join(passage[:40]), " ".join(passage[40:]), " ".join(passage), " ".join(passage)]
    df = spark.createDataFrame([(i, f"{plain(60, rng)} {t} {plain(60, rng)}") for i, t in enumerate(texts)], "doc_id long, text string")
    assert [(r.doc_id, r.source_id, r.n_words) for r in chain_dedup.passages(df).collect()] == [(3, 2, 80)]


def test_very_long_texts(spark):
    """Texts longer than the pieces that are hashed at once, with copies across their borders."""
    rng = random.Random(10)
    long = plain(300_000, rng)
    df = spark.createDataFrame([(0, long), (1, "x" + long[1_000_000:1_200_000] + "y"), (2, plain(100, rng))], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(df).collect()}
    assert got == {0: (0, 0), 1: (200_000, 1), 2: (0, 0)}


def test_bm25_scores(spark):
    rng = np.random.default_rng(11)
    size = rng.integers(1, 60, 40)
    ids = rng.integers(0, 50, int(size.sum()))
    rows = np.split(ids, np.cumsum(size)[:-1])
    df = np.array([sum(t in r for r in rows) for t in range(50)])
    idf = np.log(1 + (40 - df + 0.5) / (df + 0.5))
    index = packing.Index(ids, size, idf, float(size.mean()))
    unused = rng.random(40) < 0.8
    for seed in range(40):
        score = np.zeros(40)
        for d, row in enumerate(rows):
            for t in set(rows[seed]):
                tf = int((row == t).sum())
                score[d] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(row) / size.mean()))
        best = [d for d in sorted(range(40), key=lambda d: (-round(score[d], 9), d)) if unused[d] and score[d] > 0][:16]
        assert [round(score[d], 6) for d in index.neighbours(seed, unused)] == [round(score[d], 6) for d in best]


def test_packing(docs, texts, empty, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    found, windows = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs, path).collect():
        found[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    for k, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert [i for r in sorted(found[k], key=lambda r: r.start) for i in r.ids] == ids
        assert {r.doc_tokens for r in found[k]} == {len(ids)}
    for pieces in windows.values():
        total = 0
        for offset, n in sorted(pieces):
            assert offset == total
            total += n
        assert total == 4096 or total & (total - 1) == 0
    assert packing.packed(empty, path).count() == 0
    assert packing.packed(odd, path).selectExpr("sum(length)").first()[0] == packing.encode(odd, path).selectExpr("sum(size(ids))").first()[0]


def test_warc_audit_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>é{i}\r\n\r\nx</p>", "x") for i in range(1100)] + [(None, "u", "b", "x"), (5, None, None, "x")], "page_id long, url string, html string, digest string")
    recs = warc.records(pages)
    warc.write_warc(recs, str(tmp_path / "w"))
    read = {r.place: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    stages = Stages(spark, "test")
    a = warc.written_leaves(recs, stages, "a")
    assert {r.place: (r.offset, r.length, r.digest) for r in warc.leaves(recs).collect()} == {k: (r.offset, r.length, r.digest) for k, r in read.items()}
    assert a.exceptAll(warc.leaves(recs).select(*a.columns)).isEmpty() and a.count() == 1100
    b = warc.written_leaves(warc.records(warc.spoiled(pages)), stages, "b")
    want = {i: "missing" if i % 103 == 9 else "bytes" if i % 97 == 5 else "length" for i in range(1100) if i % 97 == 5 or i % 101 == 7 or i % 103 == 9}
    found = {r.place: r.fault for r in warc.audit(a, b, Stages(spark, "t1")).collect()}
    assert {k: v for k, v in found.items() if v != "moved"} == want
    shift, moved, rows = 0, set(), {r.place: r.length for r in a.collect()}
    for i in range(1100):
        shift = 0 if i % 1024 == 0 else shift
        if want.get(i) is None and shift:
            moved.add(i)
        shift += {"missing": rows[i], "length": 1}.get(want.get(i), 0)
    assert {k for k, v in found.items() if v == "moved"} == moved
    assert warc.audit(a, a, Stages(spark, "t2")).count() == 0
    assert warc.audit(a, a.limit(0), Stages(spark, "t3")).count() == 1100
    assert warc.audit(warc.written_leaves(warc.records(pages.limit(0)), stages, "c"), a, Stages(spark, "t4")).count() == 1100
    swapped = a.selectExpr("place", "file", "offset + 1 as offset", "length", "digest")  # equal records, laid out differently
    assert {r.fault for r in warc.audit(a, swapped, Stages(spark, "t5")).collect()} == {"moved"}


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 16))
    rows = [(i, base[i].tolist(), 1) for i in range(300)] + [(300 + i, (base[i] + 0.1 * rng.standard_normal(16)).tolist(), 2) for i in range(100)] + [(400 + i, base[0].tolist(), 3) for i in range(30)]
    hostile = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [None, *[1.0] * 15], 1), (504, [float("nan")] * 16, 1), (505, [float("inf")] * 16, 1), (506, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + hostile, "vec_id long, embedding array<double>, label int")
    got = {r.id: r for r in near_vectors.near_vectors(df, "vec_id", "embedding", window=16).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = ((x @ x.T) >= 0.9).sum(axis=1) - 1
    n = [got[r[0]].n_links for r in rows]
    assert all(a <= b for a, b in zip(n, true, strict=True))
    assert sum(n) >= 0.97 * true.sum()
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(500, 507))
    assert {got[400 + i].component_id for i in range(30)} == {0}
    assert near_vectors.near_vectors(df.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("spread", [0.28, 0.5])  # cosines of about 0.93 and 0.8 within the topic
def test_near_vectors_of_one_hot_topic(spark, spread):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32))
    x[:1000] = x[0] + spread * rng.standard_normal((1000, 32))
    x[1:1000:2] = x[0:1000:2] + 0.25 * spread * np.linalg.norm(x[0]) / 32**0.5 * rng.standard_normal((500, 32))
    x[2001::2] = x[2000::2] + 0.3 * rng.standard_normal((500, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    for more in ({}, {"block": 100}):
        got = {r.id: r for r in near_vectors.near_vectors(df, "vec_id", "embedding", window=16, **more).collect()}
        n = np.array([got[i].n_links for i in range(3000)])
        assert (n <= true).all()
        for part in (slice(0, 1000), slice(1000, 3000)):
            assert n[part].sum() >= 0.98 * true[part].sum()


def test_chain_dedup(docs, texts, empty, odd):
    found = chain_dedup.passages(docs).collect()
    hit = {r.doc_id for r in found}
    assert hit >= {105, 106, *range(91, 100)}
    assert hit <= {105, 106, *range(61, 90), *range(91, 100)}
    assert all(r.source_id < r.doc_id and r.n_words >= 50 and 100 * r.n_same >= 75 * r.n_words for r in found)
    kept = {r.doc_id: r for r in chain_dedup.without(docs, chain_dedup.passages(docs)).collect()}
    assert kept[105].text == "" or len(kept[105].text.split()) < 50
    assert kept[0].text == texts[0]
    assert chain_dedup.without(docs, chain_dedup.passages(docs)).columns == docs.columns
    assert chain_dedup.passages(empty).count() == 0
    assert chain_dedup.passages(odd).count() == 0


def covered(found, text: str, doc: int, least: float, start: int, n: int) -> bool:
    """Whether the passages of a document cover that share of its ``n`` words from word ``start`` on."""
    at = [m.span() for m in re.finditer(r"\S+", text)]  # the text is ASCII here
    hit = [any(r.start <= lo and hi <= r.end for r in found if r.doc_id == doc) for lo, hi in at[start : start + n]]
    return sum(hit) >= least * n


def plain(n: int, rng: random.Random) -> str:
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize(("n", "gap"), [(60, 100), (120, 120), (120, 200), (200, 300), (200, 60)])
def test_two_shared_passages_around_different_text(spark, n, gap):
    rng = random.Random(n + gap)
    texts = {}
    for i in range(0, 40, 2):
        head, foot = plain(n, rng), plain(n, rng)
        texts.update({i + j: f"{head} {plain(gap, rng)} {foot}" for j in range(2)})
    found = chain_dedup.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for i in range(1, 40, 2):
        assert covered(found, texts[i], i, 1, 0, n) and covered(found, texts[i], i, 1, n + gap, n)
        assert not covered(found, texts[i], i, 0.2, n, gap)


@pytest.mark.parametrize(("n", "quote"), [(80, 40), (60, 30), (100, 45), (50, 35)])
def test_whole_copy_after_quotes_of_its_parts(spark, n, quote):
    rng = random.Random(n)
    texts = {}
    for case in range(30):
        passage = plain(n, rng).split()
        head, tail = " ".join(passage[:quote]), " ".join(passage[-quote:])
        for i, part in enumerate([head, tail, " ".join(passage), head, tail, " ".join(passage)]):
            texts[1000 * i + case] = f"{plain(40, rng)} {part} {plain(40, rng)}"
    found = chain_dedup.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert all(covered(found, texts[5000 + case], 5000 + case, 1, 40, n) for case in range(30))


@pytest.mark.parametrize("every", [6, 8, 10])
def test_recall_over_the_change_rate(spark, every):
    rng = random.Random(every)
    texts = {}
    for case in range(60):
        passage = plain(80, rng).split()
        changed = [f"x{rng.randrange(5000)}" if i % every == every - 1 else w for i, w in enumerate(passage)]
        for i, part in enumerate((passage, changed)):
            texts[1000 * i + case] = f"{plain(40, rng)} {' '.join(part)} {plain(40, rng)}"
    found = chain_dedup.passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sum(covered(found, texts[1000 + case], 1000 + case, 0.9, 40, 80) for case in range(60)) == 60


def test_fenwick_chain_is_the_best_one():
    rng = random.Random(6)
    for _ in range(50):
        at = np.array(sorted(rng.randint(0, 60) for _ in range(14)))
        source = np.array([rng.randint(0, 60) for _ in at])
        best = [0.0] * len(at)
        order = np.lexsort((-source, at))
        for n, i in enumerate(order):
            gains = [best[j] - chain_dedup.GAP * (at[i] - at[j] + source[i] - source[j]) for j in order[:n] if at[j] <= at[i] and source[j] < source[i]]
            best[i] = chain_dedup.GAIN + max([0.0, *gains])
        top = chain_dedup.chains(at, source)[0]
        total = sum(chain_dedup.GAIN for _ in top) - chain_dedup.GAP * (at[top[-1]] - at[top[0]] + source[top[-1]] - source[top[0]])
        assert total == pytest.approx(max(best))


def test_pairwise_quality_on_held_out_rows(spark, data, docs, empty):
    big = data.replace("sf0.001", "sf0.01")
    got = QUERIES["op10_pairwise_quality"](spark, big)
    both = got.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in both if r.quality == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    assert np.mean([r.predicted == r.quality for r in both]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in both)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    model = pairwise_quality.train(docs, labels)
    assert pairwise_quality.score(docs, model).where("abs(score - 0.3) < 1e-9").count() == docs.count()
    assert pairwise_quality.score(empty, model).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline

    stages, docs = Stages(spark, "test"), spark.read.parquet(f"{data}/documents.parquet")
    n, names = docs.count(), docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stages.write(stage(spark, docs, data), str(k))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            assert docs.count() <= n
            n = docs.count()
    left = before.select("doc_id").distinct()
    assert docs.select("doc_id").distinct().exceptAll(left).isEmpty() and left.exceptAll(docs.select("doc_id").distinct()).isEmpty()



def test_pipeline_stages_with_odd_rows(spark, docs, odd):
    """Rows without an id or a text, repeated ids and an empty table go through every stage."""
    import corpus_pipeline

    rng, names = random.Random(16), "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c = (" ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(900)}", f"v{rng.randrange(900)}"]) for _ in range(400)) for _ in range(3))
    rows = [(0, a), (1, a), (1, None), (1, b), (2, a), (2, a), (None, b), (None, None), (3, ""), (4, c)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], names)
    near = corpus_pipeline.near_copies(spark, table, "")
    assert near.columns == table.columns
    greater = max(a, b)
    gone = {2} | ({1} if greater == a else set())
    assert sorted(map(str, near.collect())) == sorted(str(r) for r in table.collect() if r.doc_id not in gone)
    cut = corpus_pipeline.passages(spark, table, "").collect()
    assert {(r.doc_id, r.text) for r in cut if r.doc_id in (0, None, 3, 4)} == {(0, a), (None, b), (None, None), (3, ""), (4, c)} and all(r.n_chars == len(r.text) for r in cut if r.text)
    for df in (table, table.limit(0)):
        assert corpus_pipeline.rules(spark, df, "").columns == table.columns
        assert corpus_pipeline.windows(spark, df, "").selectExpr("coalesce(sum(length), 0)").first()[0] >= df.count()
